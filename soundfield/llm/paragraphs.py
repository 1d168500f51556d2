"""Near-duplicate paragraphs across documents by MinHash banding.

A paragraph is a line; lines of more than LONG words are cut at sentence ends, so that a passage put into the middle of
another text has paragraphs of its own.  Paragraphs of fewer than LEAST words are too short to tell and stay.

1. Each paragraph gets a hash of its lower-cased words.  Equal ones are one row, whatever their number.
2. MinHash over 5-word shingles in BANDS bands of ROWS values.  At a Jaccard similarity of 0.8, 5 bands of 2 find
   1 - (1 - 0.8 ** 2) ** 5 = 99.4 % of the pairs; at 0.3 they still drop 62 %.  All paragraphs have bands (SHINGLED = LEAST).
3. Paragraphs that collide in a band are compared by their exact Jaccard similarity with the first of their bucket, which
   settles large classes in comparisons that grow with a bucket's size, not its square.
4. What that leaves is found without loss: two paragraphs of SIMILAR or more share one of their first n - ceil(SIMILAR * n) + 1
   shingles in any common order.  The order puts shingles last that are frequent in a sample, so that paragraphs meet at rare ones;
   which they are changes the work, never the result.  Paragraphs meet by shingle and by both lengths, and only where their
   lengths and places leave room for enough common shingles from there on; pairs whose classes differ so far are compared.  Of each shingle's members those of its most frequent
   class are not listed against each other.  A 64-bit map of each paragraph's shingles keeps pairs out that differ in too
   many: a bit that only one of two maps has stands for a shingle that only one has, so no similar pair is lost.
5. Components of the verified links, with equal paragraphs, are classes.  The first occurrence, by doc_id and place, stays.

Null and empty texts have no paragraphs.  Rows without doc_id are left out: they can neither be named nor ordered.  Rows with
the same doc_id are one document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundfield.llm.shared import components, slices, stored

LONG, LEAST, SHINGLE, SHINGLED, SIMILAR = 24, 8, 5, 8, 0.8
BANDS, ROWS, STEP = 5, 2, 1.05
SAMPLE, FREQUENT = 20_000, 1 << 16  # documents counted for frequent shingles, and shingles held
SENTENCE_END = re.compile(r"[.!?…]\s+")
LINE = re.compile(r"[^\n]+")

_rng = np.random.default_rng(5)
ODD = _rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
ADD = _rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
FREQUENCY = np.dtype([("gram", np.uint64), ("rank", np.int64)])


def pieces(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of every paragraph of LEAST words or more."""
    for line in LINE.finditer(text):
        words = line[0].lower().split()
        if len(words) <= LONG:
            if len(words) >= LEAST:
                yield line.start(), line.end(), words
            continue
        at = 0
        for stop in [m.end() for m in SENTENCE_END.finditer(line[0])] + [len(line[0])]:
            own = line[0][at:stop].lower().split()
            if len(own) >= LEAST:
                yield line.start() + at, line.start() + stop, own
            at = stop


class Hasher:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 300_000):
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, set(words)
        for w in new:
            self.known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def grams_of(h: np.ndarray) -> np.ndarray:
    """Hashes of SHINGLE successive words at each place of `h`, those across paragraphs included."""
    with np.errstate(over="ignore"):
        grams = h[: len(h) - SHINGLE + 1].copy()
        for j in range(1, SHINGLE):
            grams = grams * BASE + h[j : len(h) - SHINGLE + 1 + j]
    return grams ^ (grams >> np.uint64(31))


def prefixes(h: np.ndarray, size: np.ndarray, frequent: np.ndarray, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of paragraphs of `size` words with hashes `h`: the prefixes' shingles, their paragraphs, and each paragraph's count of
    different shingles.  Those in `frequent` (sorted by hash; a hash and its rank, 1 or more) come last, in the order of their ranks.
    """
    owner, place = np.repeat(np.arange(len(size)), size), np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    inside = np.flatnonzero(place <= np.repeat(size, size) - SHINGLE)
    grams, owner = grams_of(h)[inside], owner[inside]
    at = np.minimum(np.searchsorted(frequent["gram"], grams), max(len(frequent) - 1, 0))
    rank = np.where(frequent["gram"][at] == grams, frequent["rank"][at], 0) if len(frequent) else np.zeros(len(grams), np.int64)
    order = np.lexsort((grams, rank, owner))
    grams, owner = grams[order], owner[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))[: len(grams)]
    grams, owner = grams[new], owner[new]
    n = np.bincount(owner, minlength=len(size))
    kept = np.arange(len(grams)) - np.repeat(np.cumsum(n) - n, n) <= np.repeat(n - np.ceil(similar * n - 1e-9).astype(np.int64), n)
    return grams[kept].view(np.int64), owner[kept], n


def bitmaps(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits for each paragraph of `size` words with hashes `h`: those that any of its shingles falls on."""
    owner, place = np.repeat(np.arange(len(size)), size), np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    inside = np.flatnonzero(place <= np.repeat(size, size) - SHINGLE)
    out = np.zeros(len(size), np.uint64)
    with np.errstate(over="ignore"):
        bit = (grams_of(h)[inside] * BASE) >> np.uint64(58)
    np.bitwise_or.at(out, owner[inside], np.uint64(1) << bit)
    return out.view(np.int64)


def signatures(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of paragraphs at first.. of word hashes `h`: a hash each, and 32-bit band keys (zeros below SHINGLED words)."""
    with np.errstate(over="ignore"):
        place = np.arange(len(h)) - np.repeat(first, size)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()), BASE)]))
        whole = np.add.reduceat((h ^ (h >> np.uint64(29))) * power[place], first)
        grams = grams_of(h)
        outside = np.zeros(len(h), bool)
        outside[: len(grams)] = place[: len(grams)] > np.repeat(size, size)[: len(grams)] - SHINGLE
        outside[len(grams) :] = True
        bands = np.zeros((len(first), BANDS), np.int64)
        for b in range(BANDS):
            key = np.zeros(len(first), np.uint64)
            for r in range(ROWS):
                v = np.full(len(h), np.uint64(2**64 - 1))
                v[: len(grams)] = (grams * ODD[b * ROWS + r]) ^ ADD[b * ROWS + r]
                v[outside] = np.uint64(2**64 - 1)
                low = np.minimum.reduceat(v, first)
                key = (key * BASE + low) ^ (low >> np.uint64(32))
            bands[:, b] = ((key ^ (key >> np.uint64(33))) & np.uint64(0x7FFFFFFF)).astype(np.int64)
    bands[size < SHINGLED] = 0
    return whole.view(np.int64), bands


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list, np.ndarray, np.ndarray]]:
    """Documents, numbers, starts and ends of the paragraphs of a few texts, their sizes, and the hashes of all their words."""
    hasher = Hasher()
    for batch in slices(batches):
        docs, number, starts, ends, words, size = [], [], [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for k, (start, end, own) in enumerate(pieces(text or "")):
                docs.append(doc), number.append(k), starts.append(start), ends.append(end), size.append(len(own))
                words += own
        if docs:
            yield docs, number, starts, ends, np.array(size), hasher.of(words)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, FREQUENCY)
    for *_, size, h in _parsed(batches):
        grams, owner, _ = prefixes(h, size, none, 0.0)  # at 0 every shingle is in the prefix
        u, _ = signatures(h, np.cumsum(size) - size, size)
        yield pa.RecordBatch.from_arrays([pa.array(u[owner]), pa.array(grams)], ["u", "gram"])


def frequent_shingles(own: DataFrame) -> np.ndarray:
    """The shingles that different paragraphs of a bounded sample of documents share most, sorted by hash, with their ranks."""
    n = own.count()
    few = own if n <= SAMPLE else own.where(F.xxhash64("doc_id").bitwiseAND(2**63 - 1) < int(2**63 * SAMPLE / n))
    counts = few.mapInArrow(_sampled, "u long, gram long").distinct().groupBy("gram").count().where("count > 2")
    rows = counts.orderBy(F.desc("count"), "gram").limit(FREQUENT).collect()
    out = np.array([(r.gram % (1 << 64), len(rows) - i) for i, r in enumerate(rows)], FREQUENCY)
    return np.sort(out, order="gram")


def _units(frequent: np.ndarray, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "paragraph", "start", "end", "u", "bands", "n", "prefix", "bits"]
        for docs, number, starts, ends, size, h in _parsed(batches):
            u, bands = signatures(h, np.cumsum(size) - size, size)
            grams, owner, n = prefixes(h, size, frequent, similar)
            long = size >= SHINGLED
            lists = pa.array([b.tolist() if x else None for b, x in zip(bands, long, strict=True)], pa.list_(pa.int32()))
            parts = np.split(grams, np.cumsum(np.bincount(owner, minlength=len(size)))[:-1])
            prefix = pa.array([g if x else None for g, x in zip(parts, long, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(number, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(u), lists, pa.array(n, pa.int32()), prefix, pa.array(bitmaps(h, size))], names)

    return run


def shingles(text: str) -> set[tuple[str, ...]]:
    words = text.lower().split()
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, b in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist(), strict=True):
            x, y = shingles(a), shingles(b)
            common = len(x & y)
            out.append(common / max(len(x) + len(y) - common, 1))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def partners(n: str, at: str, similar: float, own: str, other: str) -> list[Column]:
    """Classes of the length of a paragraph with `n` shingles, and, a row each, of the lengths that one similar to it can have if
    their first common shingle has `at` others before it: n - at shingles hold all common ones, at least s / (1 + s) of both lengths.

    A class spans 5 %, so there are at most eleven rows however long the paragraph is.
    """
    size = lambda c: F.floor(F.log(c) / F.log(F.lit(STEP))).cast("int")
    n, at = F.col(n), F.col(at)
    least = F.ceil(similar * n - 1e-6)
    most = F.least(F.floor(n / similar + 1e-6), F.floor((n - at) * (1 + similar) / similar - n + 1e-6))
    return [size(n).alias(own), F.explode(F.sequence(size(least), size(F.greatest(least, most)))).alias(other)]


def duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, paragraph, start, end, class_doc_id, class_paragraph, removed): every paragraph whose class spans two documents.

    `paragraph` counts a document's paragraphs from 0, start and end are its code points, class_* names the first occurrence
    in the class, which is the one that is not removed.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    run = _units(frequent_shingles(own), similar)
    units = stored(own.mapInArrow(run, "doc_id long, paragraph int, start int, end int, u long, bands array<int>, n int, prefix array<long>, bits long"), "paragraphs-units")
    place = F.struct("doc_id", "paragraph", "start", "end")
    distinct = units.groupBy("u").agg(F.min(place).alias("first"), F.max("doc_id").alias("last_doc"), *[F.max(c).alias(c) for c in ("bands", "n", "prefix", "bits")])
    distinct = stored(distinct, "paragraphs-distinct", tidy=True)
    keys = distinct.select("u", F.posexplode("bands").alias("band", "key"))
    bucket = Window.partitionBy("band", "key")
    met = keys.withColumn("hub", F.min("u").over(bucket)).where("u <> hub").select("u", "hub").distinct()
    met = stored(met, "paragraphs-met", tidy=True)
    posts = distinct.select("u", "n", F.posexplode("prefix").alias("at", "gram"))
    busy = posts.groupBy("gram").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo < hi").select("gram")
    posts = stored(posts.join(busy, "gram"), "paragraphs-posts", tidy=True)
    wanted = met.select("u").unionByName(met.select(F.col("hub").alias("u"))).unionByName(posts.select("u")).distinct()
    wanted = wanted.join(distinct.select("u", "first", "bits"), "u").select("u", "first.*", "bits")
    texts = wanted.join(own, "doc_id").select("u", "bits", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("words"))
    texts = stored(texts.groupBy("u", "bits").agg(F.min("words").alias("words")), "paragraphs-texts", tidy=True)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a = pairs.distinct().join(texts.select(F.col("u").alias("a"), F.col("words").alias("a_text")), "a")
        both = a.join(texts.select(F.col("u").alias("b"), F.col("words").alias("b_text")), "b").select("a", "b", "a_text", "b_text")
        return stored(both.mapInArrow(_jaccard, "a long, b long, similarity double"), name)

    first = verified(met.select(F.col("u").alias("a"), F.col("hub").alias("b")), "paragraphs-first")
    roots = components(first.where(F.col("similarity") >= similar).select("a", "b"), "paragraphs-links").withColumnRenamed("node", "u")
    mapped = posts.join(texts.select("u", "bits"), "u").join(roots, "u", "left")
    members = stored(mapped.withColumn("root", F.coalesce("root", "u")), "paragraphs-members")
    main = members.groupBy("gram", "root").count().groupBy("gram").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"))
    main = main.where("roots > 1").select("gram", "main")
    x = members.join(main, "gram").where("root <> main")
    x = x.select("gram", "main", *partners("n", "at", similar, "x_size", "y_size"), *[F.col(c).alias(f"x_{c}") for c in ("u", "n", "at", "root", "bits")])
    y = members.join(main.select("gram"), "gram")
    y = y.select("gram", *partners("n", "at", similar, "y_size", "x_size"), *[F.col(c).alias(f"y_{c}") for c in ("u", "n", "at", "root", "bits")])
    differing, total = F.bit_count(F.col("x_bits").bitwiseXOR(F.col("y_bits"))), F.col("x_n") + F.col("y_n")
    pairs = x.join(y, ["gram", "x_size", "y_size"]).where("x_root <> y_root and (x_u < y_u or y_root = main)")
    behind = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    pairs = pairs.where(behind * (1 + similar) + 1e-6 >= similar * total).where(differing * (1 + similar) <= (1 - similar) * total + 1e-6)
    second = verified(pairs.select(F.greatest("x_u", "y_u").alias("a"), F.least("x_u", "y_u").alias("b")), "paragraphs-second")
    near = second.where(F.col("similarity") >= similar).select("a", "b")
    for side in ("a", "b"):  # the classes that these pairs join
        root = roots.select(F.col("u").alias(side), F.col("root").alias("of"))
        near = near.join(root, side, "left").withColumn(side, F.coalesce("of", side)).drop("of")
    tops = components(near, "paragraphs-tops").select(F.col("node").alias("own"), F.col("root").alias("top"))
    placed = distinct.join(roots.withColumnRenamed("root", "own"), "u", "left").withColumn("own", F.coalesce("own", "u"))
    placed = placed.join(tops, "own", "left").withColumn("root", F.coalesce("top", "own"))
    classes = placed.groupBy("root").agg(F.min("first").alias("head"), F.max("last_doc").alias("last_doc")).where("head.doc_id < last_doc")
    of_unit = placed.select("u", "root").join(classes, "root").select("u", F.col("head.doc_id").alias("class_doc_id"), F.col("head.paragraph").alias("class_paragraph"))
    out = units.select("doc_id", "paragraph", "start", "end", "u").join(of_unit, "u").drop("u")
    return out.withColumn("removed", (F.col("doc_id") != F.col("class_doc_id")) | (F.col("paragraph") != F.col("class_paragraph")))
