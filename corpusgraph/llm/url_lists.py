"""URL filters over dated lists: entries become validity intervals, and each capture is judged by those active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a bucket of the interval join.
BUCKET_DAYS = 32

_PARTS = r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"


def host(url: str) -> Column:
    """Lower-cased host without a final dot; null for what is no absolute URL."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, _PARTS, 1)), F.lit(".")), F.lit(""))


def keys(url: str) -> Column:
    """What list patterns a URL can match: its host, each domain above it (and itself) of two labels at least, and each path prefix that ends at a slash or the path's end."""
    labels = F.split(F.col("host"), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    path = F.regexp_extract(url, _PARTS, 2)
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(steps))), lambda i: F.concat(F.lit("prefix:"), F.col("host"), F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))))
    return F.concat(F.array(F.concat(F.lit("host:"), F.col("host"))), domains, F.coalesce(prefixes, F.array().cast("array<string>")))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (days; the end is open, null if the entry still stands) of dated entries (list, pattern, action, day).

    An entry is on its list from the day it is added to the day it is removed; on one day a removal comes after an addition. Entries
    lacking a list, pattern or day, and actions other than add and remove, are no events. A pattern has one event a day at most once
    they are combined, so that its history is bounded by the calendar, not by the number of rows.
    """
    events = entries.filter("list is not null and pattern is not null and day is not null and action in ('add', 'remove')")
    events = events.groupBy("list", "pattern", "day").agg(F.min(F.when(F.col("action") == "remove", 0).otherwise(1)).alias("on"))
    w = Window.partitionBy("list", "pattern").orderBy("day")
    turns = events.withColumn("was", F.lag("on", 1, 0).over(w)).filter("on <> was")
    turns = turns.withColumn("valid_to", F.lead("day").over(w))
    return turns.filter("on = 1").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """A row for each capture (page_id, url, day): page_id, host, day, lists (active ones that match, sorted), n_active (entries), verdict.

    Intervals are dealt into buckets of days, so that the join is an equality of (pattern, bucket) and few intervals meet a capture;
    intervals of an entry do not overlap, so an entry has a row for each bucket at most besides its changes. The verdict is `block`
    if an entry is active, else `allow`. URLs that are null or not absolute, and captures without a day, match nothing; repeated rows
    each get a row; empty tables give no rows, or captures that are all allowed.
    """
    rows = captures.groupBy("page_id", "url", "day").agg(F.count(F.lit(1)).alias("copies")).withColumn("host", host("url"))
    spans = validity_intervals(entries)
    # days after the last capture, or before the first, need no buckets
    first, last = captures.agg(F.min("day"), F.max("day")).first()
    low, high = F.greatest("valid_from", F.lit(first)), F.least(F.coalesce(F.col("valid_to") - 1, F.lit(last)), F.lit(last))
    spans = spans.withColumns({"low": low, "high": high}).filter("low <= high")
    bucket = lambda c: F.floor(F.col(c) / bucket_days)
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket("low"), bucket("high")))).select("list", "pattern", "bucket", "valid_from", "valid_to")
    asked = rows.filter("host is not null and day is not null").withColumn("pattern", F.explode(F.array_distinct(keys("url")))).withColumn("bucket", bucket("day"))
    active = asked.join(spans, ["pattern", "bucket"]).filter("valid_from <= day and (valid_to is null or day < valid_to)")
    found = active.groupBy("page_id", "url", "day").agg(F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"), F.count(F.lit(1)).alias("n_active"))
    found = found.withColumnsRenamed({"page_id": "f_id", "url": "f_url", "day": "f_day"})
    met = rows.join(found, F.col("page_id").eqNullSafe(F.col("f_id")) & (F.col("url") == F.col("f_url")) & (F.col("day") == F.col("f_day")), "left")
    out = met.select("page_id", "host", "day", F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n_active", F.lit(0)).alias("n_active"), F.when(F.col("n_active") > 0, "block").otherwise("allow").alias("verdict"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


# The given tables hold no fetch times and no lists; both are derived from all pages, by these rules. Days count from an epoch of no meaning.
def derived_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.col("page_id") * 7919 % 730).cast("int").alias("day"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Each page names its host, its domain or its address on a list, or takes it off again."""
    id_ = F.col("page_id")
    named = pages.withColumn("host", host("url")).withColumn("keys", keys("url"))
    pattern = F.when(id_ % 3 == 0, F.element_at("keys", 1)).when(id_ % 3 == 1, F.element_at("keys", 2)).otherwise(F.element_at("keys", -1))
    return named.select(
        F.element_at(F.array(*map(F.lit, ("adult", "malware", "phishing", "spam"))), (id_ * 31 % 97 % 4 + 1).cast("int")).alias("list"),
        pattern.alias("pattern"), F.when(id_ * 17 % 101 % 3 == 0, "remove").otherwise("add").alias("action"), (id_ * 104729 % 811 - 40).cast("int").alias("day"),
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, CAST(page_id * 7919 % 730 AS INTEGER) AS day,
    nullif(rtrim(lower(regexp_extract(url, '^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)', 1)), '.'), '') AS host,
    regexp_extract(url, '^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)', 2) AS path
  FROM pages),
s AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps FROM p),
k AS (
  SELECT *, list_concat(['host:' || host],
      list_transform(range(1, greatest(2, len(labels))), lambda i: 'domain:' || array_to_string(labels[i:], '.')),
      list_transform(range(1, len(steps) + 1), lambda i: 'prefix:' || host || '/' || array_to_string(steps[:i], '/'))) AS keys
  FROM s WHERE host IS NOT NULL),
e AS (
  SELECT ['adult', 'malware', 'phishing', 'spam'][CAST(page_id * 31 % 97 % 4 + 1 AS INTEGER)] AS list,
    CASE page_id % 3 WHEN 0 THEN keys[1] WHEN 1 THEN keys[2] ELSE keys[-1] END AS pattern,
    CASE WHEN page_id * 17 % 101 % 3 = 0 THEN 0 ELSE 1 END AS added, CAST(page_id * 104729 % 811 - 40 AS INTEGER) AS day
  FROM k),
d AS (SELECT list, pattern, day, min(added) AS added FROM e GROUP BY ALL),
a AS (SELECT DISTINCT page_id, day, unnest(keys) AS pattern FROM k),
last AS (SELECT a.page_id, d.list, d.pattern, arg_max(d.added, d.day) AS added FROM a JOIN d ON a.pattern = d.pattern AND d.day <= a.day GROUP BY ALL),
f AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n_active FROM last WHERE added = 1 GROUP BY page_id)
SELECT p.page_id, p.host, p.day, coalesce(f.lists, '') AS lists, coalesce(f.n_active, 0) AS n_active, CASE WHEN f.n_active > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN f USING (page_id)
"""
