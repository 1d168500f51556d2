"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints x and y within 3 bits have a point z within 1 bit of the one and 2 of the other.  So every
fingerprint emits the points of its ball of radius 1, and some emit points at distance 2; fingerprints that meet at a
point are linked.  Within a point's bucket all members at distance 1 or less are within 2 of each other and within 3 of
the members at distance 2, so one star around any of the near ones holds every link that the bucket stands for: links
grow with the number of points, never with the square of a group.

Three facts keep the balls small and lose nothing:
* distance 0 to 2 is settled by balls of radius 1, so points at distance 2 serve pairs at distance 3 only;
* such pairs have odd and even parity, so only even fingerprints emit them;
* of three differing bits two lie in the same half of the word, so only pairs of flips within one half are needed.
Before that, fingerprints without any other one whose left or right half is within 1 bit of theirs drop out of the search
(not out of the result): a pair within 3 bits has such a half.

Equal fingerprints are one node, so a group of copies of any size costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundfield.llm.shared import components, slices, stored

SEED = 42
CHUNK = 1 << 15


def simhash(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of the 3-word shingles, repeats included; 0 without words or for null."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(words, words[1:], words[2:], strict=False))) if len(words) > 2 else [b" ".join(words)]
    ones = np.zeros(64, np.int64)
    for start in range(0, len(shingles), CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[start : start + CHUNK]], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([simhash(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(prints)], [*kept, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per row of `docs`; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_batches, "doc_id long, fp long")


def text_key():
    """128 bits that tell texts apart; null is the empty text, as for fingerprints."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


ONE_FLIP = [0] + [_signed(1 << i) for i in range(64)]
TWO_FLIPS = [_signed(1 << i | 1 << j) for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of `nodes` (column fp, distinct) that differ in at most 3 bits."""
    halves = nodes.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.expr("fp & 4294967295").alias("half")),
        F.struct(F.lit(1).alias("side"), F.expr("shiftrightunsigned(fp, 32)").alias("half")),
    )).alias("h")).select("fp", "h.side", "h.half")
    held = halves.groupBy("side", "half").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    near = halves.select("fp", "side", F.explode(F.array(*[F.col("half").bitwiseXOR(F.lit(x)) for x in [0] + [1 << i for i in range(32)]])).alias("half"))
    # Spark sizes an exploded table like what it came from, so without the hint it would broadcast the larger side
    busy = stored(near.hint("merge").join(held, ["side", "half"]).where("fp <> lo or fp <> hi").select("fp").distinct(), "simhash-busy")
    flips = lambda masks: F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("fp").bitwiseXOR(m))).alias("z")
    points = busy.select("fp", flips(ONE_FLIP)).unionByName(busy.where("bit_count(fp) % 2 = 0").select("fp", flips(TWO_FLIPS)))
    hub = F.min(F.when(F.expr("bit_count(fp ^ z) <= 1"), F.col("fp"))).over(Window.partitionBy("z"))
    met = points.withColumn("hub", hub).where("fp <> hub and bit_count(fp ^ hub) <= 3")
    return met.select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of `docs` (doc_id, text; other columns are ignored).

    Null and empty texts have fingerprint zero and are linked like any other.  A null doc_id stays and takes part in
    linking, but never names a component, unless a component has no other (then component_id is null).
    """
    prints = stored(fingerprints(docs), "simhash-prints")
    placed = _placed(prints)
    least = placed.groupBy("root").agg(F.min("lo").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _placed(prints: DataFrame, least: str = "doc_id") -> DataFrame:
    """(fp, lo, root): each fingerprint of `prints` once, with the least of its column `least` and the root of its component."""
    nodes = prints.groupBy("fp").agg(F.min(least).alias("lo"))
    roots = components(links(nodes.select("fp")), "simhash-links")
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` without the near-duplicates: exactly one row of each component stays.

    It is the one with the least doc_id, null after all others; of several with that doc_id, the one with the least hash of
    its text.  Which of several rows of equal doc_id and text stays is open.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("row_key"))
    prints = stored(own.mapInArrow(_batches, "doc_id long, row_key binary, fp long"), "simhash-prints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    firsts = _placed(prints.select("fp", row.alias("row")), "row").groupBy("root").agg(F.min("lo").alias("row")).select("row").hint("merge")
    ranked = firsts.select(F.col("row.doc_id").alias("doc_id"), F.col("row.row_key").alias("row_key"))
    given = docs.select(F.struct("*").alias("given"))  # one column, so that no name of the given ones can clash
    given = given.select("given", F.col("given.doc_id").cast("long").alias("own_id"), F.unhex(F.md5(F.coalesce("given.text", F.lit("")).cast("binary"))).alias("own_key"))
    kept = given.join(ranked, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("row_key")))
    first = F.row_number().over(Window.partitionBy("own_id", "own_key").orderBy("own_id"))
    return kept.withColumn("nth", first).where("nth = 1").select("given.*")
