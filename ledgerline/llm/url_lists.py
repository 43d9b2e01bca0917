"""Temporal list join: dated list entries become validity intervals; an as-of join tests every capture.

Built-in Spark functions only.  An entry adds or removes a domain (it covers its
sub-domains) or a URL prefix (host and leading path) on a named list at a time.  The
entries of one list and pattern, in order of time, give half-open intervals in which
the pattern is listed.  A capture is tested against the intervals that hold at its
fetch time, so later entries never change earlier captures.

Defined cases: entries with a null field are dropped; of several entries at one time
the removal wins, equal ones count once; a capture with a null or hostless URL or a
null time has no hit; repeated captures each keep their row; empty tables give no hits
or no rows; other columns of the captures are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A list of at most so many intervals is broadcast (about 100 bytes each); a larger one is joined by shuffle.
BROADCAST_INTERVALS = 100_000


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (list, kind, pattern, valid_from, valid_to) from entries (list, kind, pattern, action, at)."""
    e = entries.select("list", "kind", F.lower("pattern").alias("pattern"), "action", "at").dropna()
    e = e.groupBy("list", "kind", "pattern", "at").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    w = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    e = e.withColumn("before", F.lag("action").over(w))
    turns = e.filter(~F.col("action").eqNullSafe(F.col("before"))).withColumn("valid_to", F.lead("at").over(w))
    return turns.filter(F.col("action") == "add").select("list", "kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def _candidates(url: Column) -> Column:
    """The patterns that can cover a URL: each suffix of its host, and host with each leading part of its path."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    labels = F.split(host, "\\.")
    parts = F.array_remove(F.split(path, "/"), "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.lower(F.concat_ws("/", host, F.slice(parts, F.lit(1), i))).alias("pattern")))
    return F.when(F.length(host) > 0, F.concat(domains, prefixes))


def temporal_list_join(captures: DataFrame, entries: DataFrame, capture_id: str, url: str, at: str, broadcast_intervals: int = BROADCAST_INTERVALS) -> DataFrame:
    """Per capture: ``lists`` (sorted names of the lists that hold it at its time) and ``matched`` (sorted list=pattern)."""
    intervals = validity(entries)
    small = intervals.limit(broadcast_intervals + 1).count() <= broadcast_intervals
    c = captures.select(F.col(capture_id).alias("capture_id"), F.col(url).alias("url"), F.col(at).alias("at"))
    c = c.withColumn("row", F.monotonically_increasing_id())
    keys = c.select("row", "capture_id", "url", "at", F.explode_outer(_candidates(F.col("url"))).alias("k")).select("row", "capture_id", "url", "at", "k.kind", "k.pattern")
    v = intervals.withColumnsRenamed({"kind": "v_kind", "pattern": "v_pattern"})
    on = (F.col("kind") == F.col("v_kind")) & (F.col("pattern") == F.col("v_pattern")) & (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    # The rows of a capture lie in one task, so the partial aggregation sends one row a capture.
    hits = keys.join(F.broadcast(v) if small else v, on, "left")
    return hits.groupBy("row", "capture_id").agg(
        F.first("url").alias("url"), F.first("at").alias("at"),
        F.array_sort(F.collect_set("list")).alias("lists"),
        F.array_sort(F.collect_set(F.when(F.col("list").isNotNull(), F.concat_ws("=", "list", "pattern")))).alias("matched"),
    ).drop("row")


#: The query's dated list: the tables carry none.
ENTRIES = (
    ("spam", "domain", "spam-farm.example.org", "add", "2023-03-01"),
    ("spam", "domain", "spam-farm.example.org", "remove", "2023-09-15"),
    ("spam", "domain", "spam-farm.example.org", "add", "2024-02-01"),
    ("pharma", "domain", "cheap-pills.example.com", "add", "2023-01-10"),
    ("pharma", "domain", "cheap-pills.example.net", "add", "2023-06-01"),
    ("gambling", "domain", "free-bets.example.com", "add", "2023-05-20"),
    ("gambling", "domain", "free-bets.example.net", "add", "2023-05-20"),
    ("gambling", "domain", "free-bets.example.net", "remove", "2024-05-20"),
    ("gambling", "domain", "casino-win.example.net", "add", "2023-11-11"),
    ("ads", "domain", "ads-track.example.org", "add", "2023-01-01"),
    ("ads", "domain", "ads-track.example.com", "add", "2024-01-01"),
    ("adult", "domain", "adult-x.example.com", "add", "2023-02-14"),
    ("adult", "domain", "adult-x.example.com", "remove", "2023-02-14"),
    ("adult", "domain", "adult-x.example.com", "add", "2023-08-01"),
    ("mirror", "prefix", "tionsh.example.net/fr", "add", "2023-07-01"),
    ("mirror", "prefix", "tionsh.example.net/fr", "remove", "2024-07-01"),
)


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture; the table has no fetch time, so page_id days modulo 730 after 2023-01-01 stand for it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr("timestamp_ntz'2023-01-01' + make_interval(0, 0, 0, CAST(page_id % 730 AS INT))").alias("fetched_at"))
    entries = spark.createDataFrame(ENTRIES, "list string, kind string, pattern string, action string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    found = temporal_list_join(pages, entries, "page_id", "url", "fetched_at")
    return found.select(
        F.col("capture_id").alias("page_id"), "url", F.date_format("at", "yyyy-MM-dd").alias("fetched_on"),
        (F.size("lists") > 0).alias("blocked"), F.array_join("lists", ",").alias("lists"), F.array_join("matched", ",").alias("matched"),
    )


ORACLE = r"""
WITH e(list, kind, pattern, action, day) AS (VALUES {values}),
d AS (SELECT list, kind, pattern, CAST(day AS TIMESTAMP) AS day, max(action) AS action FROM e GROUP BY ALL),
l AS (SELECT *, lag(action) OVER w AS before FROM d WINDOW w AS (PARTITION BY list, kind, pattern ORDER BY day)),
v AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS until FROM l WHERE action IS DISTINCT FROM before),
p AS (
  SELECT page_id, url, TIMESTAMP '2023-01-01' + to_days(CAST(page_id % 730 AS INTEGER)) AS day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1) AS path FROM pages),
h AS (
  SELECT page_id, list, v.pattern FROM p JOIN v ON v.action = 'add' AND p.host <> '' AND p.day >= v.day AND (v.until IS NULL OR p.day < v.until)
   AND CASE v.kind WHEN 'domain' THEN p.host = v.pattern OR ends_with(p.host, '.' || v.pattern)
       ELSE lower(p.host || rtrim(p.path, '/')) = v.pattern OR starts_with(lower(p.host || p.path), v.pattern || '/') END)
SELECT p.page_id, p.url, strftime(p.day, '%Y-%m-%d') AS fetched_on, count(h.list) > 0 AS blocked,
       coalesce(string_agg(DISTINCT h.list, ',' ORDER BY h.list), '') AS lists,
       coalesce(string_agg(DISTINCT h.list || '=' || h.pattern, ',' ORDER BY h.list || '=' || h.pattern), '') AS matched
FROM p LEFT JOIN h USING (page_id) GROUP BY p.page_id, p.url, p.day
""".replace("{values}", ", ".join(str(e) for e in ENTRIES))
