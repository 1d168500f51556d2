"""Repeated passages of MIN_LEN bytes or more across documents, by enhanced suffix arrays over anchored neighbourhoods.

A suffix array of the whole corpus would have to be one sorted list of all bytes.  Here it falls into many small ones:

1. Anchors.  Of every MIN_LEN bytes the K-byte string with the least hash (the leftmost of equals) is an anchor.  Two equal
   strings of MIN_LEN bytes have the same anchor at the same place, so all that can repeat meets under its anchor's hash.
   About one byte in 16 starts an anchor.
2. Neighbourhood: the bytes in which any MIN_LEN bytes around the anchor can lie.  Each anchor goes out as its hash and a
   64-bit hash of its neighbourhood, in packed arrays without the bytes.  A task settles at once what it has itself seen in a
   smaller document; of equal neighbourhoods it hands on those of its least document, so a passage in every third document
   is no hot key.  Anchors that only one place has drop out.
3. Equal neighbourhoods (equal in both hashes) form a class.  In all documents but the class's least one they are removed whole.
4. What is left to compare are the classes under one anchor, each in its least document.  Only these fetch their bytes.  Their
   suffixes are sorted, with the common prefix of each with the one before.  A scan with a stack gives the tree of common-prefix
   intervals; those of MIN_LEN or more whose occurrences differ in the byte to their left (or reach the neighbourhood's edge)
   are the maximal repeat groups, with all their occurrences.  A longer repeat shows as a chain of groups that overlap.
   An anchor with more than MOST neighbourhoods (a frequent phrase in ever different company) is split by the MIN_LEN-byte
   strings themselves, which are grouped as any key is; the result is the same.

Removal takes the bytes of all occurrences in a group that has a smaller doc_id.  Whole copies need no path of their own: all
their neighbourhoods are settled by the hashes.

Disk: anchors are written once, in a folder for each part of the hashes.  Steps 2 to 4 go part by part and remove the folder of
a part when it is done, so what they shuffle is a part's share; of each part there stay a row of stretches for every text.

Texts are UTF-8 bytes, null is empty, repeats never cross documents.  A null doc_id counts as greater than all others.
Rows with equal doc_id do not remove each other.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundfield.llm.shared import dropped, slices, stored, written

MIN_LEN, K, MOST = 50, 20, 4096
REACH = MIN_LEN - K  # bytes on either side of an anchor
SPAN, FLUSH, LAST = 1 << 20, 1 << 19, 2**63 - 1
PASS, PASSES = 1 << 28, 16  # bytes of text for each pass, and how many passes there are at most

BYTE_CODES = np.random.default_rng(14).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of every K-byte string of `data`: strings of 1, 2, 4, ... bytes, put together as K's binary digits say."""
    h, width, power = BYTE_CODES[data], 1, STEP
    whole, done = None, 0
    with np.errstate(over="ignore"):
        while width <= K:
            if K & width:
                whole = h if whole is None else whole[: len(h) - done] * power + h[done : done + len(whole)]
                whole, done = whole[: len(data) - done - width + 1], done + width
            h = h[:-width] * power + h[width:] if 2 * width <= K else h
            power, width = power * power, 2 * width
        h = whole
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def powers(base: int) -> np.ndarray:
    """base ** 0, 1, 2, ... modulo 2 ** 64, enough for a buffer and the reach on either side."""
    out = np.full(SPAN + 2 * MIN_LEN, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, UNDONE = powers(int(STEP)), powers(pow(int(STEP), -1, 1 << 64))


def digests(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of every stretch first..last of `data`, from sums of byte codes times powers."""
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(BYTE_CODES[data] * POWERS[: len(data)], dtype=np.uint64))
        g = (sums[last] - sums[first]) * UNDONE[first] + (last - first).astype(np.uint64)
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        return g ^ (g >> np.uint64(29))


def anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending) and hashes of the anchors of the documents that lie at first..last of `data`; less than SPAN bytes."""
    if len(data) < MIN_LEN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hashes(data)
    low = (h & ~np.uint64(SPAN - 1)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost is least
    width = 1
    while 2 * width <= REACH + 1:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    rest = REACH + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    whole = np.zeros(len(low) + 1, np.int32)
    has = last - first >= MIN_LEN
    np.add.at(whole, first[has], 1)
    np.add.at(whole, last[has] - MIN_LEN + 1, -1)
    place = (low & np.uint64(SPAN - 1)).astype(np.int64)[np.cumsum(whole[:-1]) > 0]
    place = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
    return place, h[place]


def text_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, place in it, anchor's hash, neighbourhood's start, end and hash) of all anchors, a buffer at a time.

    Long texts go in overlapping spans.
    """
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and size + len(texts[stop]) < SPAN:
            size += len(texts[stop])
            stop += 1
        if stop > start:
            sizes = np.array([len(t) for t in texts[start:stop]])
            last = np.cumsum(sizes)
            data = np.frombuffer(b"".join(texts[start:stop]), np.uint8)
            place, h = anchors(data, last - sizes, last)
            which = np.searchsorted(last, place, "right")
            base = (last - sizes)[which]
            near, end = np.maximum(base, place - REACH), np.minimum(last[which], place + MIN_LEN)
            yield start + which, place - base, h, near - base, end - base, digests(data, near, end)
        else:
            data, at, seen = np.frombuffer(texts[start], np.uint8), 0, -1
            while at == 0 or at + MIN_LEN <= len(data):
                part = data[at : at + SPAN - 1]
                place, h = anchors(part, np.zeros(1, np.int64), np.array([len(part)]))
                place = place + at
                new = place > seen
                near, end = np.maximum(0, place - REACH), np.minimum(len(data), place + MIN_LEN)
                low = max(0, at - REACH)
                g = digests(data[low : at + SPAN + MIN_LEN], near - low, end - low)
                yield np.full(new.sum(), start), place[new], h[new], near[new], end[new], g[new]
                seen = max(seen, int(place[-1])) if len(place) else seen
                at += len(part) - MIN_LEN + 1
            stop = start + 1
        start = stop


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


SETTLED, FRESH, KNOWN, ALSO = 0, 1, 2, 128
MEMBERS = "doc long, text_key long, start int, end int, h long, key long"
PACKED = "bucket int, kind byte, h binary, key binary, doc binary, text_key binary, start binary, size binary"
SPANS = "doc long, text_key long, spans array<struct<start:int,end:int>>"
_NAMES = ["doc", "text_key", "start", "end", "h", "key"]


def _planes(values: np.ndarray) -> bytes:
    """The low bytes of all numbers, then the next ones, and so on: high bytes are mostly zero and compress to nothing."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def merged(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one text that meet or overlap, as one; in order of text and place."""
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], end[order]
    other = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
    shift = np.cumsum(other) * (1 << 33)  # puts each text beyond the one before, so that one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    begins = np.flatnonzero(np.append(True, (start + shift)[1:] > reach[:-1]))
    closes = np.append(begins[1:], len(doc)) - 1
    return doc[begins], key[begins], start[begins], (reach - shift)[closes]


def _sender(buckets: int, settle: bool, parts: int = 1):
    """Texts in, packed rows out: settled stretches, one anchor of each hash by its hash, and all anchors of hashes met again.

    The remainder of a bucket by `parts` is that of its hashes, also where anchors of one hash are dealt over buckets by document.

    A hash is cut to 32 bits beside its bucket: anchors that then seem equal cost comparisons, their neighbourhoods still differ.
    A size above ALSO marks the one anchor of a hash that is among those met again too.
    """
    names = ["bucket", "kind", "h", "key", "doc", "text_key", "start", "size"]
    types = [pa.int32(), pa.int8()] + [pa.binary()] * 6

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, text, start, end, h, key = (np.concatenate(x) for x in zip(*held, strict=True))
        h = ((h // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) + h % np.uint64(buckets)
        order = np.lexsort((start, text, doc, key, h))
        doc, text, start, end, h, key = (x[order] for x in (doc, text, start, end, h, key))
        rows = []

        def send(kind: int, b: np.ndarray, h: np.ndarray, key: np.ndarray, doc: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
            order = np.lexsort((start, text, doc, b))
            for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(b) else []:
                anchor = [b"", b""]
                if kind != SETTLED:
                    anchor = [((h[part] // np.uint64(buckets)).astype("<u4") if kind == FRESH else h[part]).tobytes(), key[part].tobytes()]
                rows.append((int(b[part[0]]), kind, *anchor, doc[part].astype("<i8").tobytes(), text[part].astype("<i8").tobytes(), _planes(start[part]), _planes(end[part] - start[part])))

        if settle:
            new = np.append(True, (h[1:] != h[:-1]) | (key[1:] != key[:-1]))
            late = doc > doc[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            own = merged(doc[late], text[late], start[late], end[late]) if late.any() else [np.zeros(0, np.int64)] * 4
            send(SETTLED, own[0] % buckets, *[np.zeros(0, np.uint64)] * 2, *own)
            doc, text, start, end, h, key = (x[~late] for x in (doc, text, start, end, h, key))
        first = np.append(True, h[1:] != h[:-1])
        again = np.append(~first[1:], False) | ~first
        marked = end + np.where(again, ALSO, 0)
        send(FRESH, (h[first] % np.uint64(buckets)).astype(np.int64), *(x[first] for x in (h, key, doc, text, start, marked)))
        dealt = (h[again] % np.uint64(parts)).astype(np.int64) + doc[again] % (buckets // parts) * parts
        send(KNOWN, dealt, *(x[again] for x in (h, key, doc, text, start, end)))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            ids, keys = (np.array(batch.column(n).to_pylist(), np.int64) for n in ("doc", "text_key"))
            for which, _, h, start, end, key in text_anchors(_bytes(batch.column("text"))):
                held.append((ids[which], keys[which], start, end, h, key))
                size += len(h)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _receiver(buckets: int):
    """Of one partition's packed rows the settled stretches (h is null), and the anchors whose hash came twice or more."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def out(doc, text, start, size, h=None, key=None) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(len(doc), pa.int64())
        columns = [pa.array(doc), pa.array(text), pa.array(start), pa.array(start + size), *(none if x is None else pa.array(x.view(np.int64)) for x in (h, key))]
        yield from slices(iter([pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], _NAMES)]), 100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for bucket, kind, h, key, doc, text, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [np.frombuffer(doc, "<i8"), np.frombuffer(text, "<i8"), _from_planes(start), _from_planes(size)]
                if kind == FRESH:
                    held.append([*own, np.frombuffer(h, "<u4").astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket), np.frombuffer(key, np.uint64)])
                else:
                    yield from out(*own, *((np.frombuffer(h, np.uint64), np.frombuffer(key, np.uint64)) if kind else ()))
        if held:
            doc, text, start, size, h, key = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            own = order[np.append(False, same) | np.append(same, False)]
            own = own[size[own] < ALSO]
            yield from out(*(x[own] for x in (doc, text, start, size, h, key)))

    return run


def members(docs: DataFrame) -> DataFrame:
    """MEMBERS of `docs` (doc, text, text_key): anchors whose hash has several places, with start, end and hash of the neighbourhood."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select("doc", "text", "text_key").mapInArrow(_sender(buckets, settle=False), PACKED)
    return sent.repartition("bucket").mapInArrow(_receiver(buckets), MEMBERS)


def members_by_part(docs: DataFrame) -> Iterator[DataFrame]:
    """The members of one part of the hashes after the other; what is behind a part is removed when the next one is asked for.

    Rows without h are stretches that a smaller document of the same task has too; their anchors do not appear.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(PASSES, -(-size // PASS)))
    buckets = parts * -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)
    packed = docs.select("doc", "text", "text_key").mapInArrow(_sender(buckets, settle=True, parts=parts), PACKED)
    sent = written(packed.withColumn("part", F.col("bucket") % parts), "repeats-sent", by="part")
    for part in range(parts):
        own = spark.read.schema(f"{PACKED}, part int").parquet(sent).where(F.col("part") == part).drop("part")
        yield own.repartition("bucket").mapInArrow(_receiver(buckets), MEMBERS)
        dropped(spark, f"{sent}/part={part}")
    dropped(spark, sent)


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "text_key", "start", "h", "key", "n", "hi", "near"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in slices(batches, 64):
        rows = []
        for doc, own, text, places in zip(batch.column("doc").to_pylist(), batch.column("text_key").to_pylist(), _bytes(batch.column("text")), batch.column("places").to_pylist(), strict=True):
            rows += [(doc, own, p["start"], p["h"], p["key"], p["n"], p["hi"], text[p["start"] : p["end"]]) for p in places]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (doc, text_key, start, end, h, key, n, hi) with the bytes `near`; of equal rows of `docs` one answers."""
    lists = wanted.groupBy("doc", "text_key").agg(F.collect_set(F.struct("start", "end", "h", "key", "n", "hi")).alias("places"))
    once = docs.withColumn("copy", F.row_number().over(Window.partitionBy("doc", "text_key").orderBy(F.lit(0)))).where("copy = 1")
    found = once.join(lists, ["doc", "text_key"]).select("doc", "text_key", "text", "places")
    return found.mapInArrow(_neighbourhoods, "doc long, text_key long, start int, h long, key long, n long, hi long, near binary")


def intervals(lcp: list[int], left: list[int], lo: list[int], least: int) -> Iterator[tuple[int, int, int, int, list[tuple[int, int]]]]:
    """Maximal common-prefix intervals (first, last, length, least of `lo`, new) of sorted suffixes, by a scan with a stack.

    lcp[i] is the common prefix of suffixes i - 1 and i (lcp[0] is 0); left[i] is the byte before suffix i, -1 at an edge.
    An interval is maximal to the right by its nature; it is reported if the bytes to its left differ or one is an edge.
    `new` are the ranges of the interval that no longer one inside it, with the same least, has reported.
    """
    stack: list[list] = []  # first, length, left byte or -2 if they differ, least of lo, (first, last, least) of reported ones inside
    for i in range(1, len(lcp) + 1):
        here = lcp[i] if i < len(lcp) else 0
        first, byte, low, inside = i - 1, left[i - 1] if left[i - 1] >= 0 else -2, lo[i - 1], []
        while stack and stack[-1][1] > here:
            begin, length, own, least_own, held = stack.pop()
            byte, low = own if own == byte else -2, min(least_own, low)
            held += inside
            if byte == -2:
                new, at = [], begin
                for a, b, x in held:
                    if x == low:
                        if a > at:
                            new.append((at, a - 1))
                        at = b + 1
                if at < i:
                    new.append((at, i - 1))
                yield begin, i - 1, length, low, new
                held = [(begin, i - 1, low)]
            first, inside = begin, held
        if here >= least:
            if stack and stack[-1][1] == here:
                top = stack[-1]
                top[2], top[3] = top[2] if top[2] == byte else -2, min(top[3], low)
                top[4] += inside
            else:
                stack.append([first, here, byte, low, inside])


def groups(near: list[bytes], lo: list[int], hi: list[int], whole: bool = True, anchor: list[int] | None = None) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Maximal repeat groups (length, least doc, [(neighbourhood, start)]) among neighbourhoods of one anchor.

    With all occurrences, or, if not `whole`, without those that a longer group with the same least doc has.
    With `anchor`, the number of each neighbourhood's anchor, those of many anchors are scanned at once; groups stay within one.

    Suffixes enter the array only if their first MIN_LEN bytes occur twice with different bytes to the left, or at an edge:
    no interval around any other suffix can be maximal.
    """
    for i, (text, a, b) in enumerate(zip(near, lo, hi, strict=True)):
        if b > a:  # a leaf that several documents share
            yield len(text), a, [(i, 0)]
    if len(near) < 2:
        return
    width = REACH + MIN_LEN
    grid = np.zeros((len(near), width + REACH), np.uint8)
    for i, text in enumerate(near):
        grid[i, : len(text)] = np.frombuffer(text, np.uint8) + 1  # UTF-8 has no byte 255; 0 is the end
    size = np.array([len(t) for t in near])
    own = np.zeros(len(near), np.uint32) if anchor is None else np.array(anchor, np.uint32)
    which, start = np.nonzero(np.arange(REACH + 1)[None, :] + MIN_LEN <= size[:, None])
    left = np.where(start > 0, grid[which, np.maximum(start - 1, 0)].astype(np.int64), -1)
    docs = np.array(lo, np.int64)[which]
    with np.errstate(over="ignore"):
        sums = np.cumsum(np.pad(BYTE_CODES[grid[:, :width]] * POWERS[:width], ((0, 0), (1, 0))), axis=1, dtype=np.uint64)
        g = (sums[which, start + MIN_LEN] - sums[which, start]) * UNDONE[start]
        g = (g ^ g >> np.uint64(32)) * STEP + own[which].astype(np.uint64) * BYTE_CODES[0]
    order = np.argsort(g, kind="stable")
    begins = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1]))
    count = np.diff(np.append(begins, len(g)))
    least, most = np.minimum.reduceat(left[order], begins), np.maximum.reduceat(left[order], begins)
    wanted = (count > 1) & ((least < 0) | (least < most))
    if not whole:  # nothing to remove where one document has them all
        wanted &= np.minimum.reduceat(docs[order], begins) < np.maximum.reduceat(np.array(hi, np.int64)[which][order], begins)
    kept = np.sort(order[np.repeat(wanted, count)])
    if not len(kept):
        return
    which, start, left, docs = which[kept], start[kept], left[kept], docs[kept]
    view = np.lib.stride_tricks.sliding_window_view(grid, width, axis=1)
    rows = np.concatenate([own[which].astype(">u4").view(np.uint8).reshape(-1, 4), view[which, start]], axis=1)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width + 4}").ravel(), kind="stable")
    rows, which, start, left, docs = rows[order], which[order], start[order], left[order], docs[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1) - 4, width)
    lcp = np.append(0, np.clip(lcp, 0, np.minimum((size[which] - start)[1:], (size[which] - start)[:-1])))
    busy = np.flatnonzero((lcp >= MIN_LEN) | np.append(lcp[1:] >= MIN_LEN, False))
    for run in np.split(busy, np.flatnonzero(lcp[busy] < MIN_LEN)[1:]) if len(busy) else []:
        own = lcp[run].copy()
        own[0] = 0
        places = list(zip(which[run].tolist(), start[run].tolist(), strict=True))
        for first, last, length, low, new in intervals(own.tolist(), left[run].tolist(), docs[run].tolist(), MIN_LEN):
            if whole:
                yield length, low, places[first : last + 1]
            elif new:
                yield length, low, [x for a, b in new for x in places[a : b + 1]]


def _by_anchor(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[int, list[tuple]]]:
    """(h, rows) of batches sorted by h."""
    held, current = [], None
    for batch in batches:
        for h, *row in zip(*(batch.column(n).to_pylist() for n in ("h", *names)), strict=True):
            if h != current and held:
                yield current, held
                held = []
            current = h
            held.append(tuple(row))
    if held:
        yield current, held


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, 20_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbourhoods sorted by h in, the stretches of each that a smaller document has out."""

    def settled(rows: list[tuple]) -> Iterator[tuple]:
        bits: dict[int, int] = {}
        docs = [r[1] for r in rows]
        for length, low, places in groups([r[0] for r in rows], docs, docs, whole=False, anchor=[r[4] for r in rows]):
            for i, start in places:
                if low < docs[i]:
                    bits[i] = bits.get(i, 0) | ((1 << length) - 1) << start
        for i, own in bits.items():
            _, doc, text, base, _ = rows[i]
            for run in re.finditer("1+", f"{own:b}"[::-1]):
                yield doc, text, base + run.start(), base + run.end()

    def spans() -> Iterator[tuple]:
        held: list[tuple] = []
        for k, (_, rows) in enumerate(_by_anchor(batches, "near", "doc", "text_key", "start")):
            if len(held) + len(rows) > MOST:
                yield from settled(held)
                held = []
            held += [(*r, k % (1 << 32)) for r in rows]
        yield from settled(held)

    yield from _batched(spans(), ["doc", "text_key", "start", "end"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])


def _by_text(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _compared(near: DataFrame, most: int) -> DataFrame:
    """(doc, text_key, start, end): what of the neighbourhoods a smaller document has."""
    few = near.where(F.col("n") <= most).select("h", "near", "doc", "text_key", "start").repartition("h").sortWithinPartitions("h")
    runs = few.mapInArrow(_grouped, "doc long, text_key long, start int, end int")
    many = near.where(F.col("n") > most)
    strings = many.select("doc", "text_key", "start", F.posexplode(F.expr(f"transform(sequence(1, length(near) - {MIN_LEN - 1}), i -> substring(near, i, {MIN_LEN}))")).alias("at", "s"))
    least = strings.groupBy("s").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("s", "least")
    split = strings.join(least, "s").where("least < doc").selectExpr("doc", "text_key", "start + at as start", f"start + at + {MIN_LEN} as end")
    return runs.unionByName(split)


def removable(docs: DataFrame, most: int = MOST) -> DataFrame:
    """SPANS, a row for a text: bytes of `docs` (doc, text, text_key; doc without nulls) in a repeat group with a smaller doc."""
    spark, done, wanted = docs.sparkSession, [], []
    zero, columns = F.lit(0).cast("long"), "doc long, text_key long, start int, end int, h long, key long, n long, hi long"
    for places in members_by_part(docs):
        places = places.withColumn("key", F.coalesce("key", F.xxhash64("doc", "text_key")))
        open_ = F.expr("h is not null and doc = min(doc) over (partition by h, key)")
        classed = places.withColumn("first", open_).withColumn("h", F.when(F.col("first"), F.col("h"))).drop("key")
        path = written(classed, "repeats-classes", tidy=True)
        classed = spark.read.schema(classed.schema).parquet(path)
        done.append(written(_by_text(classed.where("not first")), "repeats-whole", tidy=True))
        firsts = classed.where("first").drop("first")
        sizes = firsts.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("h", "n")
        open_ones = firsts.join(sizes, "h").select("doc", "text_key", "start", "end", "h", zero.alias("key"), "n", zero.alias("hi"))
        wanted.append(written(open_ones, "repeats-open", tidy=True))
        dropped(spark, path)
    near = fetched(docs, spark.read.schema(columns).parquet(*wanted)).select("doc", "text_key", "start", "h", "n", "near")
    path = written(near.withColumn("part", F.pmod("h", F.lit(len(wanted)))), "repeats-near", tidy=True, by="part")
    dropped(spark, *wanted)
    for part in range(len(wanted)):
        own = spark.read.schema(near.withColumn("part", F.lit(0).cast("long")).schema).parquet(path).where(F.col("part") == part).drop("part")
        done.append(written(_by_text(_compared(own, most)), "repeats-runs", tidy=True))
        dropped(spark, f"{path}/part={part}")
    dropped(spark, path)
    found = spark.read.schema(SPANS).parquet(*done).groupBy("doc", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = stored(found, "repeats-spans", tidy=True)
    dropped(spark, *done)
    return out


def repeat_groups(docs: DataFrame) -> DataFrame:
    """Every maximal repeat group of `docs` (doc_id, text): one row (h, group, length, doc_id, start) for each occurrence.

    h and group name the group.  Rows without doc_id take no part.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).where("doc is not null")
    own = own.withColumn("text_key", F.xxhash64("text"))
    held = stored(members(own).distinct(), "repeats-members")
    first = held.groupBy("h", "key").agg(F.min(F.struct("doc", "text_key", "start", "end")).alias("x"), F.max("doc").alias("hi"))
    near = fetched(own, first.select("h", "key", "x.*", F.lit(0).cast("long").alias("n"), "hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for h, own in _by_anchor(batches, "near", "doc", "hi", "key"):
                for k, (length, _, places) in enumerate(groups(*([r[j] for r in own] for j in range(3)))):
                    yield from ((h, k, length, own[i][3], at) for i, at in places)

        yield from _batched(rows(), ["h", "group", "length", "key", "at"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()])

    found = near.repartition("h").sortWithinPartitions("h", "near").mapInArrow(run, "h long, group int, length int, key long, at int")
    return found.join(held, ["h", "key"]).selectExpr("h", "group", "length", "doc as doc_id", "start + at as start").distinct()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in slices(batches):
        rows = []
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), _bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            at, kept, runs, end = 0, [], 0, -1
            for s in sorted((s["start"], s["end"]) for s in spans or []):
                if s[0] > end or end < 0:
                    runs += 1
                    kept.append(text[at : s[0]])
                end = at = max(end, s[1])
            kept.append(text[at:])
            left = b"".join(kept)
            rows.append((doc, len(text), len(text) - len(left), runs, hashlib.sha256(left).hexdigest(), left))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def deduplicated(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row per row of `docs` (doc_id, text).

    `kept` has the bytes that stay; a cut can fall inside a character.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("text_key", F.xxhash64("text"))
    spans = removable(own.select("doc", "text", "text_key"), most)
    marked = own.join(spans.hint("merge"), ["doc", "text_key"], "left")
    return marked.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
