"""The fixed tables seen as research records, for both engines.

Each view has a Spark form and a SQL form (``SQL``) with equal rows; queries take the
first, their oracles the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that are much work each, dealt over the cores by key, as a file or row group may hold all of them.

    What a query makes of a row (payloads, bodies) comes after this, so that few bytes a row move.
    """
    spark = rows.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys)


def spread(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    return dealt(table(spark, sf_dir, name), *keys)


def uu(c: Column) -> Column:
    return F.concat(F.lit("00000000-0000-7000-8000-"), F.lpad(c.cast("string"), 12, "0"))


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def claims(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    u, i = F.col("user_id"), F.col("event_id")
    return e.select(
        i.alias("id"), _join("agency:", i % 7).alias("claimant"), F.col("event_type").alias("kind"), _join("company:", u % 10).alias("rel_from"), _join("mine:", k % 10).alias("rel_to"),
        _join("host", u % 20, "#recipe:", uu(u % 20), "@v", i % 3 + 1).alias("source_id"), (F.col("value") / 500).alias("confidence"), F.col("ts").alias("observed_at"),
    )


def plans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, d, "region").select(uu(k).alias("plan_id"), F.lower("r_name").alias("topic"), F.when(k % 3 == 0, "accepted").when(k % 3 == 1, "pending").otherwise("rejected").alias("status"), k.cast("long").alias("seq"))


def recipes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(uu(k).alias("recipe_id"), uu(k % 5).alias("plan_id"), _join("host", k).alias("source_id"), (k % 3 + 1).alias("version"), (k % 20).alias("slot"), F.col("s_acctbal").alias("score"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), uu(F.col("o_custkey") % 5).alias("plan_id"), (F.col("o_orderkey") % 40).alias("run_id"), F.when(status == "F", "succeeded").when(status == "O", "declined").otherwise("failed").alias("kind"),
        uu(F.col("o_custkey") % 20).alias("recipe_id"), _join("nom:", uu(F.col("o_custkey") % 7), F.when(F.col("o_orderkey") % 2 == 0, _join(":", F.lower(F.substring("o_orderpriority", 1, 1)), ":", F.col("o_orderkey") % 4)).otherwise("")).alias("source_id"),
        F.col("o_orderpriority").alias("message"), F.col("o_orderdate").alias("attempted_at"),
    )


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(uu(F.col("l_suppkey")).alias("recipe_id"), (F.col("l_returnflag") == "N").alias("succeeded"), F.col("l_shipdate").alias("attempted_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_orderkey").alias("parent"), F.concat("l_returnflag", "l_linestatus").alias("metric"), F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("valid_at"),
        _join("host", F.col("l_suppkey"), "#recipe:", uu(F.col("l_suppkey")), "@v1").alias("source_id"), F.col("l_partkey").alias("part"),
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    i, n = F.col("doc_id"), F.substring("source", 4, 9).cast("int")
    kind = F.when(i % 4 == 0, "text/html; charset=utf-8").when(i % 4 == 1, "Application/JSON").when(i % 4 == 2, "application/pdf").otherwise("text/plain")
    return table(spark, d, "documents").select(i.alias("id"), _join("host", n, "#recipe:", uu(n), "@v1").alias("source_id"), kind.alias("mime"), F.col("text").alias("body"), F.col("lang").alias("lang"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    license = F.when(k % 4 == 0, "extracted").when(k % 4 == 1, "classifier-emitted").when(k % 4 == 2, "unknown").otherwise("derived")
    return table(spark, d, "customer").select(k.alias("seq"), _join("company:", k % 300).alias("entity_id"), F.lower("c_mktsegment").alias("kind"), F.col("c_name").alias("canonical_name"), license.alias("license"), F.col("c_acctbal").alias("score"), F.col("c_nationkey").cast("long").alias("nation"))


SQL = {
    "claims": """SELECT event_id AS id, 'agency:' || (event_id % 7) AS claimant, event_type AS kind, 'company:' || (user_id % 10) AS rel_from,
      'mine:' || (CAST(json_extract_string(props, '$.k') AS INT) % 10) AS rel_to,
      'host' || (user_id % 20) || '#recipe:' || uu(user_id % 20) || '@v' || (1 + event_id % 3) AS source_id, value / 500 AS confidence, ts AS observed_at
      FROM events""",
    "plans": """SELECT uu(r_regionkey) AS plan_id, lower(r_name) AS topic, CASE r_regionkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'pending' ELSE 'rejected' END AS status,
      CAST(r_regionkey AS BIGINT) AS seq FROM region""",
    "recipes": "SELECT uu(s_suppkey) AS recipe_id, uu(s_suppkey % 5) AS plan_id, 'host' || s_suppkey AS source_id, s_suppkey % 3 + 1 AS version, s_suppkey % 20 AS slot, s_acctbal AS score FROM supplier",
    "outcomes": """SELECT o_orderkey AS id, uu(o_custkey % 5) AS plan_id, o_orderkey % 40 AS run_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'declined' ELSE 'failed' END AS kind,
      uu(o_custkey % 20) AS recipe_id, 'nom:' || uu(o_custkey % 7) || CASE WHEN o_orderkey % 2 = 0 THEN ':' || lower(substr(o_orderpriority, 1, 1)) || ':' || (o_orderkey % 4) ELSE '' END AS source_id,
      o_orderpriority AS message, o_orderdate AS attempted_at FROM orders""",
    "attempts": "SELECT uu(l_suppkey) AS recipe_id, l_returnflag = 'N' AS succeeded, l_shipdate AS attempted_at, l_orderkey * 10 + l_linenumber AS seq FROM lineitem",
    "observations": """SELECT l_orderkey * 10 + l_linenumber AS seq, l_orderkey AS parent, l_returnflag || l_linestatus AS metric, l_extendedprice AS value, l_shipdate AS valid_at,
      'host' || l_suppkey || '#recipe:' || uu(l_suppkey) || '@v1' AS source_id, l_partkey AS part FROM lineitem""",
    "docs": """SELECT doc_id AS id, 'host' || CAST(substr(source, 4) AS INT) || '#recipe:' || uu(CAST(substr(source, 4) AS INT)) || '@v1' AS source_id,
      CASE doc_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'Application/JSON' WHEN 2 THEN 'application/pdf' ELSE 'text/plain' END AS mime, text AS body, lang FROM documents""",
    "entities": """SELECT c_custkey AS seq, 'company:' || (c_custkey % 300) AS entity_id, lower(c_mktsegment) AS kind, c_name AS canonical_name,
      CASE c_custkey % 4 WHEN 0 THEN 'extracted' WHEN 1 THEN 'classifier-emitted' WHEN 2 THEN 'unknown' ELSE 'derived' END AS license, c_acctbal AS score, CAST(c_nationkey AS BIGINT) AS nation FROM customer""",
}


def _uu_inlined(sql: str) -> str:
    """DuckDB knows no uu(): the calls, which hold no bracket but a cast's, are written out."""
    out, at = "", 0
    while (k := sql.find("uu(", at)) >= 0:
        depth, end = 1, k + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:k] + f"('00000000-0000-7000-8000-' || lpad(CAST({sql[k + 3 : end - 1]} AS VARCHAR), 12, '0'))"
        at = end
    return out + sql[at:]


def oracle(views: str, body: str, also: str = "", recursive: bool = False) -> str:
    """SQL over the named views, with further common tables in ``also``."""
    parts = [f"{v} AS ({SQL[v]})" for v in views.split()] + ([also] if also else [])
    return _uu_inlined(("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body)
