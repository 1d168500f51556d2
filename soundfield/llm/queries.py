"""The registered queries of this subpackage, thin over its operators, and their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundfield.llm import alignment, concatenation, decontam, negatives, packing, paragraphs, pii, quality, repeats, simhash, syncmers, toxicity, urls
from soundfield.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = toxicity.scored(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, folder, "labels")), "score")
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = pii.found(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.is_contaminated().alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES["op7_decontamination"] = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select distinct item_id::varchar as item, {_WORDS} as w from benchmark where item_id is not null),
bw as (select distinct item, len(win) as n, array_to_string(win, ' ') as win from (
  select item, unnest(list_transform(generate_series(1, greatest(len(w) - 12, 1)), lambda i: w[i:i + 12])) as win from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as win from (
  select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from d, sizes)),
hits as (select doc_id, s, dw.n, item from dw join bw on dw.win = bw.win and dw.n = bw.n),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as h from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""


@query
def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), spark.createDataFrame(urls.RULES, "host string, path string, verdict string"))


_RULE_ROWS = ", ".join(str(r) for r in urls.RULES)
ORACLES["op6_urls"] = f"""
with rules(rh, rp, v) as (values {_RULE_ROWS}),
p as (select page_id, row_number() over () as k, case when instr(coalesce(url, ''), '://') > 0 then url[instr(url, '://') + 3:] else '' end as rest from pages),
q as (select page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
best as (select k, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as v from q join rules
  on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by k)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from q left join best using (k)"""


@query
def op9_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.with_edited(table(spark, folder, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), syncmers.fingerprint("hashes").alias("fingerprint"),
        syncmers.fingerprint("edited_hashes").alias("edited_fingerprint"), syncmers.likeness("hashes", "edited_hashes").alias("near_edited"),
        syncmers.likeness("hashes", "next_hashes").alias("near_next"),
    )


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = quality.scored(docs.select("doc_id", "text"), *quality.train(docs, table(spark, folder, "labels")), "score")
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query
def op4_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.deduplicated(table(spark, folder, "documents")).drop("kept")


@query
def op2_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs.duplicates(table(spark, folder, "documents"))


@query
def op13_concatenation(spark: SparkSession, folder: str) -> DataFrame:
    return concatenation.concatenated(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, folder, "embeddings"))


ORACLES["op12_negatives"] = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select row_number() over () as k, a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as id, list_inner_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (select * from (select anchor_id, id, score, row_number() over (partition by anchor_id order by score desc, id) as nth from scores where same) where nth <= 5),
ranked as (select p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score,
  row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id)::int as rank
  from positives p join scores n on p.anchor_id = n.anchor_id and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10"""
