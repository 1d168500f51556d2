"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item's windows are its runs of `size` words (the whole item if it is shorter).  A document is contaminated by
the words inside any exact occurrence of a window.

1. Rarity: how many documents hold each word of the benchmark, counted over all documents.
2. Prefix: any occurrence of a window holds the window's rarest word, so that word alone (ties: the first in order) is what
   has to be joined; windows with a common rarest word share it.
3. Candidates: of a document only the places of such words leave its row, each with the words that can lie in a window
   around it, never more than 2 * size - 1.
4. Bounds and verification: the window fixes where in it the rare word stands; its start must not lie before the document's,
   its end not behind it, and all words are compared.

The benchmark is broadcast, and its rare words are a literal set, only if it has at most `most_windows` windows; beyond that
the same joins run as shuffles, keyed by the word, which Spark can split where one word is frequent.

Words: A-Z lower-cased, then runs of ASCII digits and letters and of all characters above ASCII.  Null and empty texts have
no words.  Repeated rows are judged each.  Items with the same text or id count once per id.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundfield.llm.shared import stored

SIZE, MOST_WINDOWS = 13, 50_000
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of words.  `lower` would also fold letters above ASCII, so texts that have some go by a table of 26 letters."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, APART), "")


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item, window): the distinct windows of each item, as arrays of words."""
    w = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return w.select("item", F.explode(F.array_distinct(F.transform(starts, lambda i: F.slice("w", i, size)))).alias("window")).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """(row_key, doc_id, n_words, n_hit, items): a row for each row of `docs`; items is a sorted array of item ids.

    `row_key` tells repeated rows apart and is the hash of doc_id and text: rows equal in both get equal results.
    """
    own = windows(items, size)
    small = own.limit(most_windows + 1).count() <= most_windows
    send = F.broadcast if small else (lambda df: df)
    terms = own.select(F.explode("window").alias("term")).distinct()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), words(F.col("text")).alias("w"))
    if small:
        wanted = [r.term for r in terms.collect()]  # size * most_windows words at most
        picked = F.filter(F.array_distinct("w"), lambda x: x.isin(wanted)) if wanted else F.array().cast("array<string>")
        frequency = keyed.select(F.explode(picked).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    else:
        frequency = keyed.select(F.explode(F.array_distinct("w")).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    ranked = own.select("item", "window", F.posexplode("window").alias("place", "term")).join(frequency, "term")
    rarest = ranked.groupBy("item", "window").agg(F.count("*").alias("met"), F.min(F.struct("n", "place", "term")).alias("r"))
    # a window with a word that no document has cannot occur
    rare = rarest.where("met = size(window)").groupBy("window", "r").agg(F.collect_set("item").alias("window_items"))
    # stored, so that the corpus is counted once and not again for every reader
    rare = stored(rare.select("window", "window_items", F.col("r.place").alias("place"), F.col("r.term").alias("term")), "decontam-rare")

    around = lambda i: F.struct(
        F.element_at("w", i).alias("term"), i.alias("at"), F.least(i - 1, F.lit(size - 1)).alias("left"),
        F.slice("w", F.greatest(i - (size - 1), F.lit(1)), 2 * size - 1).alias("near"),
    )
    anchors = [r.term for r in rare.select("term").distinct().collect()] if small else []
    if small and not anchors:
        spots = keyed.select("row_key", F.lit(None).cast("string").alias("term"), F.lit(0).alias("at"), F.lit(0).alias("left"), "w").withColumnRenamed("w", "near").limit(0)
    else:
        numbered = F.transform("w", lambda x, i: F.when(x.isin(anchors), i + 1)) if small else F.transform("w", lambda x, i: i + 1)
        spots = keyed.select("row_key", F.explode(F.transform(F.array_compact(numbered), around)).alias("s")).select("row_key", "s.*")
    met = spots.join(send(rare), "term")
    met = met.where("left >= place and size(near) >= left - place + size(window) and slice(near, left - place + 1, size(window)) = window")
    hits = stored(met.select("row_key", (F.col("at") - F.col("place")).alias("start"), F.size("window").alias("n"), "window_items"), "decontam-hits")
    # repeated rows share their key; a document has at most as many starts as words
    per_row = hits.select("row_key", "start", "n").distinct().groupBy("row_key").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.expr("start + n - 1")))))).cast("long").alias("n_hit"))
    of_items = hits.select("row_key", F.explode("window_items").alias("item")).distinct().groupBy("row_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = per_row.join(of_items, "row_key")
    rows = keyed.select("row_key", "doc_id", F.size("w").cast("long").alias("n_words"))
    out = rows.join(found, "row_key", "left")
    return out.select("row_key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs`, all columns, without contaminated rows."""
    bad = contamination(docs, items).where(is_contaminated()).select(F.col("row_key").alias("bad_key")).distinct()
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"]) == F.col("bad_key"), "left_anti")
