"""Document fingerprints from closed syncmers, in DataFrame functions only.

A closed syncmer is a k-mer whose least inner s-mer (by hash) stands at its first or last place.  Whether a k-mer is chosen
depends on itself alone, so the same passage gives the same anchors wherever it stands, and an edit disturbs only the anchors
that it touches.  The letters are words for texts of WORDS_FROM words or more (k = 3, s = 1), and characters for texts of
fewer than WORDS_TO words, such as notes or texts without blanks (k = 4, s = 2; shorter ones are one k-mer); texts in between
have both.

The fingerprint is the `keep` least 32-bit hashes of the distinct syncmers, eight hexadecimal digits each.  The likeness of
two fingerprints is the share of common ones among the `keep` least of both together, an estimate of the Jaccard similarity
of the syncmer sets; it is 1 for two empty ones.  Null is the empty text, whose fingerprint is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundfield.llm.shared import stored

KEEP, WORDS_FROM, WORDS_TO = 48, 24, 40
LOW = 0xFFFFFFFF


def anchors(df: DataFrame, text: str, name: str = "anchors") -> DataFrame:
    """`df` with `name`: the hashes of the closed syncmers of column `text` in their order in it, repeats included."""
    df = df.withColumn("own_words", F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+"), ""))
    df = df.withColumn("own_hashes", F.transform("own_words", lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("own_words") - 2, F.lit(0))
    part = lambda start: F.slice("own_hashes", start, n)
    pairs = F.zip_with(part(1), part(2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    closed = F.zip_with(pairs, part(3), lambda p, c: F.when(p["b"] >= F.least(p["a"], c), F.xxhash64(p["a"], p["b"], c).bitwiseAND(LOW)))
    by_word = F.when(F.size("own_words") >= WORDS_FROM, F.filter(closed, lambda x: x.isNotNull()))
    inner = lambda m, i: F.xxhash64(F.substring(m, i, 2))
    df = df.withColumn("own_chars", F.when(F.size("own_words") < WORDS_TO, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)."), F.lit(0))))
    run = lambda start: F.slice("own_chars", start, F.greatest(F.size("own_chars") - 3, F.lit(0)))
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y))
    mers = F.filter(joined(joined(run(1), run(2)), joined(run(3), run(4))), lambda m: inner(m, 2) >= F.least(inner(m, 1), inner(m, 3)))
    whole = F.filter(F.array(F.coalesce(text, F.lit(""))), lambda t: (t != "") & (F.length(t) < 4))
    by_char = F.when(F.size("own_words") < WORDS_TO, F.transform(F.concat(mers, whole), lambda m: F.xxhash64(m).bitwiseAND(LOW)))
    none = F.array().cast("array<bigint>")
    return df.withColumn(name, F.concat(F.coalesce(by_word, none), F.coalesce(by_char, none))).drop("own_words", "own_hashes", "own_chars")


def least(hashes: str, keep: int = KEEP) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, keep)


def fingerprint(hashes: str) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: str, b: str, keep: int = KEEP) -> Column:
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, keep)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def ring(keys: DataFrame) -> DataFrame:
    """`keys` (k, h, n; distinct in k and h) with k, h and n of the one before in the order of (k, h), the last before the first.

    Sorted in ranges; the last row of each range is handed to the next, one row for each range.
    """
    ranged = stored(keys.select("k", "h", "n").repartitionByRange("k", "h").withColumn("range", F.spark_partition_id()), "syncmers-ranges")
    here = F.struct("k", "h", "n")
    ends = ranged.groupBy("range").agg(F.max(here).alias("end"))
    carried = ends.select("range", F.coalesce(F.lag("end").over(Window.orderBy("range")), F.max("end").over(Window.partitionBy())).alias("carried"))
    before = F.coalesce(F.lag(here).over(Window.partitionBy("range").orderBy("k", "h")), F.col("carried"))
    return ranged.join(F.broadcast(carried), "range").select("k", "h", before.alias("before"))


def with_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text, edited, hashes, edited_hashes, next_hashes): a row for each row of `docs` (doc_id, text).

    `edited` is the text with its last quarter of code points replaced by as many from the next document's start.  Next is
    by ascending doc_id, null first, equal ids in the order of a hash of the text; rows equal in both are one document.
    """
    named = F.col("doc_id").cast("long")
    own = docs.select(named.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(named, F.lit(-(2**63))).alias("k"))
    own = own.withColumn("h", F.xxhash64("doc_id", "text"))
    marked = anchors(own, "text").select("k", "h", F.col("doc_id").isNull().alias("unnamed"), F.length("text").alias("n"), least("anchors").alias("hashes"))
    marked = stored(marked, "syncmers-hashes")
    distinct = marked.groupBy("k", "h").agg(*[F.first(c).alias(c) for c in ("unnamed", "n", "hashes")])
    known = stored(distinct.join(ring(marked.select("k", "h", "n").distinct()), ["k", "h"]), "syncmers-known").hint("merge")
    # both uses of the texts ask for the same columns, so Spark moves them once
    rows = own.select("k", "h", "text").hint("merge").join(known, ["k", "h"])
    heads = rows.select(
        F.col("before.k").alias("k"), F.col("before.h").alias("h"), F.substr("text", F.lit(1), F.floor(F.col("before.n") / 4).cast("int")).alias("head"), F.col("hashes").alias("next_hashes"),
    ).dropDuplicates(["k", "h"])
    both = rows.join(heads.hint("merge"), ["k", "h"])
    kept = F.substr("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int"))
    out = anchors(both.withColumn("edited", F.concat(kept, "head")), "edited", "edited_anchors")
    return out.select(
        F.when(~F.col("unnamed"), F.col("k")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "text", "edited", "hashes", least("edited_anchors").alias("edited_hashes"), "next_hashes",
    )
