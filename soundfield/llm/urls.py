"""URL rules by a sort-merge range join, in DataFrame functions only.

A rule is a host and a path prefix; it fits its host and all subdomains if the url's path starts with its path.  A host with
its labels reversed, each ended by a dot ("org.example.www."), makes a domain and its subdomains one interval of keys, and
path prefixes are intervals already.  Two sweeps of the same kind follow: over reversed hosts, which finds for every url the
nested rule hosts it lies in, and over (rule host, path), which finds for each of those the nested path prefixes.

A sweep sorts interval starts and points together.  Intervals of prefixes are nested or apart, so the stack of intervals that
are open at a point is the part of the last started interval's own stack (itself and those around it) that still reaches the
point.  Every start carries its stack, which is as deep as its key has prefixes, and a point takes over that of the last
start before it: a running value, not a join.  Points are dealt out by key ranges, equal keys by row, so a host with a third
of all urls spreads; the last stack of each range, one row, is handed on to the next ranges.

The longest fitting rule (host and path together) wins; of equal rules "block" wins.  Without one, the verdict is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundfield.llm.shared import stored

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host(url: Column) -> Column:
    rest = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first "://"; nothing for null or without it."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def reversed_host(column: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(column, r"\.")), "."), F.lit("."))


def _starts(keys: DataFrame) -> DataFrame:
    """(key, stack): each distinct key with the keys that are its prefixes, longest first, itself included."""
    keys = keys.select("key").distinct()
    cut = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substr("key", F.lit(1), i))).alias("outer"))
    held = cut.join(keys.select(F.col("key").alias("outer")), "outer")
    return held.groupBy("key").agg(F.reverse(F.array_sort(F.collect_list("outer"))).alias("stack"))


def sweep(points: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """(id, key, open): for each point (id, key) the keys of `keys` that are prefixes of its key, longest first."""
    events = _starts(keys).select("key", F.lit(None).cast("long").alias("id"), "stack", F.lit(0).alias("kind"))
    both = events.unionByName(points.select("key", "id", F.lit(None).cast("array<string>").alias("stack"), F.lit(1).alias("kind")))
    ranged = both.repartitionByRange("key", "kind", "id").withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, name)
    before = Window.partitionBy("range").orderBy("key", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = ranged.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
    ranges = ranged.select("range").distinct().join(last, "range", "left")  # a row for each range of the sort
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("range", F.last("stack", ignorenulls=True).over(earlier).alias("carried"))
    swept = ranged.withColumn("own", F.last("stack", ignorenulls=True).over(before)).where("kind = 1").join(F.broadcast(carried), "range")
    reach = F.filter(F.coalesce("own", "carried"), lambda k: F.col("key").startswith(k))
    return swept.select("id", "key", F.coalesce(reach, F.array().cast("array<string>")).alias("open"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of `pages` (page_id, url; other columns are ignored).

    `rules` has host, path, verdict.  Null urls and those without "://" have empty host and path, fit no rule and get the
    default.  Rules with a null or an empty host fit nothing; a null path is the empty one.  Repeated rows stay.
    """
    rules = rules.where("host <> ''").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" comes after "allow"
    rules = rules.withColumn("key", F.concat(reversed_host(F.col("host")), F.lit(" "), F.col("path")))
    own = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("id"))
    own = stored(own, "urls-pages")
    rule_hosts = rules.select(reversed_host(F.col("host")).alias("key"))
    hosts = own.where("host <> ''")
    nested = sweep(hosts.select("id", reversed_host(F.col("host")).alias("key")), rule_hosts, "urls-hosts").where("size(open) > 0")
    inside = nested.select("id", F.explode("open").alias("rule_host")).join(own.select("id", "path"), "id")
    inside = inside.select("id", F.concat("rule_host", F.lit(" "), "path").alias("key"))
    fitting = sweep(inside, rules.select("key"), "urls-paths").where("size(open) > 0").select("id", F.get("open", F.lit(0)).alias("key"))
    ruled = fitting.join(rules.select("key", F.concat("host", "path").alias("rule"), "verdict"), "key")
    best = ruled.groupBy("id").agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("best"))
    return own.join(best, "id", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
