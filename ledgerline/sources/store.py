"""Records at rest: envelopes as rows and junction tables, typed reads, files in and out."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("observation", "event", "entity", "relation", "document", "assertion")
#: Record types in the order in which an id is looked up.
CHILDREN = ("entities", "places", "topics", "derived_from")


def exploded(records: DataFrame) -> dict[str, DataFrame]:
    """The junction tables of records (id, record_type, entities, places, topics, derived_from, ...)."""
    one = lambda c: records.select(F.col("id").alias("record_id"), "record_type", F.explode(c).alias("value")).distinct()
    edges = records.select(F.col("id").alias("child_id"), F.col("record_type").alias("child_type"), F.explode("derived_from").alias("e")).select("child_id", "child_type", "e.*")
    return {"entities": one("entities"), "places": one("places"), "topics": one("topics"), "derived_from": edges.distinct()}


def rebuilt(rows: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Records with their envelopes: one aggregation a junction table instead of a look-up a row."""
    out = rows
    for c in ("entities", "places", "topics"):
        lists = children[c].groupBy(F.col("record_id").alias("id"), "record_type").agg(F.array_sort(F.collect_list("value")).alias(c))
        out = out.join(lists, ["id", "record_type"], "left").withColumn(c, F.coalesce(c, F.expr("array()").cast("array<string>")))
    edges = children["derived_from"].groupBy(F.col("child_id").alias("id"), F.col("child_type").alias("record_type")).agg(F.array_sort(F.collect_list(F.struct("parent_id", "parent_type", "role"))).alias("derived_from"))
    none = F.expr("array()").cast("array<struct<parent_id:string,parent_type:string,role:string>>")
    return out.join(edges, ["id", "record_type"], "left").withColumn("derived_from", F.coalesce("derived_from", none))


def decoded(rows: DataFrame, content: str, schema: str, required: tuple[str, ...], strict: bool = True) -> DataFrame:
    """Rows with their content as columns; a row without a required field fails, or is left out if not strict."""
    parsed = rows.withColumn("_c", F.from_json(content, schema))
    good = F.col("_c").isNotNull()
    for field in required:
        good = good & F.col(f"_c.{field}").isNotNull()
    if strict:
        parsed = parsed.withColumn("_c", F.when(good, F.col("_c")).otherwise(F.raise_error(F.lit("content does not decode"))))
    else:
        parsed = parsed.filter(good)
    return parsed.select(*[c for c in rows.columns if c != content], "_c.*")


def types_of(ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The type of each id: the first table in order that has it."""
    ranked = None
    for rank, name in enumerate(t for t in TYPES if t in tables):
        part = tables[name].select("id", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name")).alias("t"))
        ranked = part if ranked is None else ranked.union(part)
    return ids.join(ranked, "id").groupBy("id").agg(F.min("t").alias("t")).select("id", F.col("t.name").alias("record_type"))


def found(table: DataFrame, column: str, value: object) -> DataFrame:
    """The row with a key; an error if there is none."""
    hit = table.filter(F.col(column) == F.lit(value))
    if hit.isEmpty():
        raise KeyError(f"no row with {column} = {value!r}")
    return hit


def written(records: DataFrame, folder: str, batch: str) -> None:
    """Junction tables first and records last, each under its batch: a reader that starts from records sees whole ones, and a batch written again after a failure replaces itself."""
    for name, child in exploded(records).items():
        child.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    records.drop(*CHILDREN).write.mode("overwrite").parquet(f"{folder}/records/batch={batch}")


def appended(rows: DataFrame, folder: str, batch: str) -> None:
    """Audit rows (runs, outcomes, attempts, histories) under their batch: nothing that is there changes, and a batch written again after a failure replaces itself."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    return rebuilt(spark.read.parquet(f"{folder}/records").drop("batch"), {c: spark.read.parquet(f"{folder}/{c}").drop("batch") for c in CHILDREN})


def fetched(ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of the ids from the first table in order that has each; ids that none has are left out."""
    typed = types_of(ids, {t: tables[t].select("id") for t in tables})
    out = None
    for t in (t for t in TYPES if t in tables):
        part = tables[t].join(typed.filter(F.col("record_type") == t), "id")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def sources_from_toml(spark: SparkSession, text: str, limit: int | None = None) -> DataFrame:
    """A list of [[source]] tables as rows; keys that a source lacks are null."""
    rows = tomllib.loads(text).get("source", [])[:limit]
    columns = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns or ["name"]))


def registry_from_toml(spark: SparkSession, text: str) -> DataFrame:
    """[[entry]] tables as claimant, topic and quorum; a quorum under one counts as none."""
    rows = [(e["claimant"], e.get("topic"), e["quorum"] if (e.get("quorum") or 0) >= 1 else None) for e in tomllib.loads(text).get("entry", []) if e.get("claimant")]
    return spark.createDataFrame(rows, "claimant string, topic string, quorum int")


def probes_from_tsv(lines: DataFrame, agents: tuple[str, ...] = ("plain", "browser", "bot", "none")) -> DataFrame:
    """Probes from lines (line_no, value) of host, agent, status; the header, short lines and unknown agents are left out."""
    p = F.split("value", "\t")
    rows = lines.filter((F.col("line_no") > 0) & (F.size(p) >= 3)).select(F.lower(F.trim(p[0])).alias("host"), F.trim(p[1]).alias("agent"), F.trim(p[2]).try_cast("int").alias("status"), F.col("line_no").alias("seq"))
    return rows.filter(F.col("agent").isin(*agents) & F.col("status").isNotNull())


def appended_jsonl(report: DataFrame, folder: str) -> None:
    report.write.mode("append").json(folder)


def pending_migrations(available: DataFrame, applied: DataFrame) -> DataFrame:
    return available.join(applied.select("version"), "version", "left_anti").orderBy("version")


def text_file(path: str) -> str:
    """A small configuration file on the driver."""
    return Path(path).read_text()


def attribute_text(value: Column) -> Column:
    """An attribute value (JSON with kind and value) as a tile shows it; a kind that tiles do not know is shown as its JSON."""
    get = lambda p: F.get_json_object(value, p)
    kind = get("$.kind")
    number = F.concat_ws(" ", F.regexp_replace(F.call_function("format_number", get("$.value.value").try_cast("double"), F.lit("#,##0.###")), r"\.$", ""), F.nullif(get("$.value.unit"), F.lit("")))
    return F.when(kind == "number", number).when(kind.isin("text", "boolean", "country", "topic", "entity"), get("$.value")).otherwise(value)
