"""What is shown of records and fetched bytes: previews, formats, summaries, orders, tables and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import attribute_text

# Byte bounds of previews and excerpts.
HTML_INPUT, BODY, STRUCTURED, EXCERPT = 128 << 10, 32 << 10, 128 << 10, 64 << 10
SAMPLES, TILES, KINDS, MIN_ROWS, POINTS, TICKS = 8, 6, 12, 2, 500, 5


def _read(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def first_bytes(text: Column, limit: int) -> Column:
    """The longest beginning of a text with at most so many bytes."""
    def cut(t: Column) -> Column:
        # A character cut in two decodes to one replacement character.
        most = F.length(_read(F.substring(F.encode(t, "UTF-8"), 1, limit)))
        return T.once(F.substr(t, F.lit(1), most), lambda whole: F.when(F.octet_length(whole) <= limit, whole).otherwise(F.substr(whole, F.lit(1), F.length(whole) - 1)))

    return T.once(text, lambda t: F.when(F.octet_length(t) <= limit, t).otherwise(cut(t)))


def lossy_excerpt(data: Column, limit: int = EXCERPT) -> Column:
    """Bytes read as text with replacement characters, so many bytes at most."""
    return first_bytes(_read(F.substring(data, 1, limit)), limit)


def truncated(text: Column, budget: int) -> Column:
    return F.when(F.octet_length(text) <= budget, text).otherwise(F.concat(first_bytes(text, budget), F.lit(f"[...truncated at {budget} bytes]")))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def body_preview(mime: Column, body: Column) -> Column:
    html = first_bytes(T.stripped_html(first_bytes(body, HTML_INPUT)), BODY)
    return F.when(T.is_binary(mime), "").when(T.is_html(mime), html).when(T.is_structured(mime), first_bytes(body, STRUCTURED)).otherwise(first_bytes(body, BODY))


def sniffed(body: Column) -> Column:
    """pdf, html, json or other, by the first bytes."""
    start = F.lower(F.regexp_replace(F.substring(body, 1, 4096), "^﻿?[ \t\n\r\f]*", ""))
    return F.when(body.startswith("%PDF-"), "pdf").when(start.startswith("<!doctype") | start.rlike("^<html[ \t\n\r\f>/]|^<html$"), "html").when(start.startswith("{") | start.startswith("["), "json").otherwise("other")


def fetched_documents(fetches: DataFrame) -> DataFrame:
    """Documents from fetches: source_id, recipe_id, version, source_url, content_type, body, topics, fetched_at."""
    m = T.mime(F.col("content_type"))
    return fetches.select(
        F.col("source_url").alias("dedup_key"), T.document_kind(m).alias("kind"), m.alias("mime"), body_preview(m, F.col("body")).alias("body"), F.concat("source_id", F.lit("#recipe:"), "recipe_id", F.lit("@v"), "version").alias("source_id"),
        "source_url", F.lit("unknown").alias("license"), "topics", F.col("fetched_at").alias("observed_at"), F.lit(1.0).cast("float").alias("confidence"),
    )


def placed(rows: DataFrame, key: str, step: str, order: list[Column]) -> DataFrame:
    """place: the turn of each row of a key, from 1, in an order that begins with a step of few values (a day), last ones first.

    Rows of a step are counted in their order, and the rows of the steps before added: no task meets all rows of a key.
    """
    before = Window.partitionBy("_key").orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = rows.groupBy(F.col(key).alias("_key"), F.col(step).alias("_step")).agg(F.count("*").alias("_n"))
    steps = steps.select("_key", "_step", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    turn = F.row_number().over(Window.partitionBy(key, step).orderBy(*order))
    both = rows.withColumn("_turn", turn).join(F.broadcast(steps), F.col(key).eqNullSafe(F.col("_key")) & F.col(step).eqNullSafe(F.col("_step")))
    return both.withColumn("place", F.col("_before") + F.col("_turn")).drop("_key", "_step", "_before", "_turn")


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    part = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(unit))
    return F.when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s, "s"))).when(m > 0, F.concat_ws(" ", part(m, "m"), part(s, "s"))).otherwise(part(s, "s"))


def retry_after(seconds: Column) -> Column:
    return F.coalesce(F.concat(F.lit("rate-limited; retry after "), duration(seconds)), F.lit("rate-limited; no Retry-After provided"))


def classifier_id(stored: Column) -> Column:
    """provider and version of provider@version; the version is null if either side is empty."""
    at = F.instr(stored, "@")
    provider, version = F.substr(stored, F.lit(1), at - 1), F.substr(stored, at + 1)
    return F.struct(F.when((at > 0) & (provider != ""), provider).otherwise(stored).alias("provider"), F.when((at > 0) & (provider != "") & (version != ""), version).alias("version"))


def summary(record_type: Column, content: Column) -> Column:
    """One line for a record from its content (JSON)."""
    get = lambda p: F.coalesce(F.get_json_object(content, f"$.{p}"), F.lit(""))
    or_ = lambda *c: F.coalesce(*[F.when(x != "", x) for x in c[:-1]], c[-1])
    metric, value, unit = get("metric"), get("value"), get("unit")
    observation = F.when(metric == "", "(observation)").when(value == "", metric).otherwise(F.concat(metric, F.lit(": "), value, F.when(unit != "", F.concat(F.lit(" "), unit)).otherwise("")))
    name, kind = get("canonical_name"), get("kind")
    entity = F.when(name == "", or_(kind, F.lit("(entity)"))).otherwise(F.concat(name, F.lit(" ("), kind, F.lit(")")))
    start, end = get("from"), get("to")
    relation = F.when(kind == "", "(relation)").when((start == "") | (end == ""), kind).otherwise(F.concat(kind, F.lit(": "), start, F.lit(" → "), end))
    document = F.when(F.trim(get("title")) != "", get("title")).otherwise(or_(kind, F.lit("(document)")))
    assertion = F.concat(or_(get("claimant"), F.lit("(unknown)")), F.lit(" "), or_(get("stance"), F.lit("asserted")))
    event = or_(get("headline"), get("event_type"), F.lit("(event)"))
    return F.when(record_type == "observation", observation).when(record_type == "event", event).when(record_type == "entity", entity).when(record_type == "relation", relation).when(record_type == "document", document).otherwise(assertion)


def matches(text: Column, query: Column) -> Column:
    """Whether a text has the query in it, whatever the case; a blank query fits all."""
    q = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    return (q == "") | F.coalesce(F.contains(F.lower(text), q), F.lit(False))


def backoff_order(hosts: DataFrame) -> DataFrame:
    """Hosts (host, failures, wait) with their tone and place: blocked, recovering, clean, then by name."""
    tone = F.when((F.col("failures") == 0) & (F.col("wait") == 0), "clean").when(F.col("wait") > 0, "blocked").otherwise("recovering")
    rank = F.when(F.col("tone") == "blocked", 0).when(F.col("tone") == "recovering", 1).otherwise(2)
    return hosts.withColumn("tone", tone).orderBy(rank, "host")


def samples(rows: DataFrame, key: str, value: str, order: list[str], cap: int = SAMPLES) -> DataFrame:
    """The first distinct trimmed values of each key in the given order, blanks left out."""
    v = F.trim(value)
    first = rows.select(key, v.alias("v"), F.struct(*order).alias("o")).filter("v <> ''").groupBy(key, "v").agg(F.min("o").alias("o"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("o", "v"))).filter(F.col("r") <= cap)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("samples"))


def entity_tiles(assertions: DataFrame) -> DataFrame:
    """entity_id, key and value of what was last said of each entity (id, observed_at, content), with its place: the newest key first.

    A value that shows as nothing is passed over for an older one.
    """
    get = lambda p: F.get_json_object("content", p)
    said = assertions.filter(get("$.asserted_kind") == "entity_attribute").select(get("$.entity_id").alias("entity_id"), get("$.key").alias("key"), attribute_text(get("$.value")).alias("value"), F.struct("observed_at", "id").alias("at"))
    last = said.filter("entity_id IS NOT NULL AND key IS NOT NULL AND value <> ''").groupBy("entity_id", "key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("at"))) - 1).drop("at")


# How many rows each listing shows; the list of sources is cut at its own limit.
LISTED = {"topics": 30, "runs": 50, "recipes": 100, "feedback": 100, "history": 50, "plans": 50, "attempts": 50, "outcomes": 50}


def newest(rows: DataFrame, listing: str, by: str, tie: str) -> DataFrame:
    """The newest rows of a listing with their places: only as many as it shows leave each task."""
    top = rows.orderBy(F.desc_nulls_last(by), F.desc(tie)).limit(LISTED[listing])
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), F.desc(tie))))


def table_columns(rows: DataFrame, table: str, content: str) -> DataFrame:
    """Columns of each table of JSON objects with two rows at least: most frequent first, then by name."""
    keys = rows.select(table, F.explode(F.array_distinct(F.json_object_keys(content))).alias("name")).groupBy(table, "name").agg(F.count("*").alias("n"))
    size = rows.filter(F.json_object_keys(content).isNotNull()).groupBy(table).agg(F.count("*").alias("rows")).filter(F.col("rows") >= MIN_ROWS)
    place = F.row_number().over(Window.partitionBy(table).orderBy(F.desc("n"), "name"))
    return keys.join(size, table).withColumn("place", place)


def sorted_rows(rows: DataFrame, by: str, tie: str, descending: bool) -> DataFrame:
    """Rows by a column, as numbers if all that is there are; what is missing comes last going up and first going down."""
    v = F.nullif(F.trim(by), F.lit(""))
    numeric = rows.agg(F.coalesce(F.every(v.try_cast("double").isNotNull() | v.isNull()), F.lit(False)).alias("numeric"))
    both = rows.crossJoin(F.broadcast(numeric)).withColumn("_n", F.when(F.col("numeric"), v.try_cast("double"))).withColumn("_t", v)
    order = [F.desc_nulls_first("_n"), F.desc_nulls_first("_t")] if descending else [F.asc_nulls_last("_n"), F.asc_nulls_last("_t")]
    return both.orderBy(*order, tie).drop("_n", "_t", "numeric")


def nearest(series: DataFrame, key: str, at: str, value: str, wanted: Column) -> DataFrame:
    """Per key the value at the time nearest to the wanted one, the earlier of two."""
    return series.groupBy(key).agg(F.min_by(F.col(value), F.struct(F.abs(F.col(at) - wanted), F.col(at))).alias("nearest"))


def ticks(domains: DataFrame, n: int = TICKS) -> DataFrame:
    """Evenly spaced marks from lo to hi."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tick")
    return domains.select("*", i).withColumn("at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("tick") / (n - 1))


def strided(series: DataFrame, key: str, order: list[str], points: int = POINTS) -> DataFrame:
    """Every so manieth row of each series, so that about ``points`` are left, and the last one."""
    w = Window.partitionBy(key)
    n = series.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.ceil(F.col("_n") / points)
    return n.filter((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def framed_page(number: Column, tables: Column) -> Column:
    """A page of a PDF as text: its tables (array of rows of cells) with places, or a note that there is none."""
    row = lambda r, i: F.concat(F.lit("  row "), i, F.lit(" (col 0.."), F.size(r) - 1, F.lit("): "), F.array_join(F.transform(r, lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), "  "))
    one = lambda t, i: F.concat(F.lit("[PDF page "), number, F.lit(", table "), i, F.lit("] ("), F.size(t), F.lit(" rows × "), F.size(t[0]), F.lit(" cols)\n"), F.array_join(F.transform(t, row), "\n"))
    return F.when(F.size(tables) == 0, F.concat(F.lit("[PDF page "), number, F.lit("] (no table detected)"))).otherwise(F.array_join(F.transform(tables, one), "\n"))


def emitted(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """The selected pages of each document in order, with a mark where pages were left out."""
    w = Window.partitionBy(doc).orderBy(page_no)
    gap = F.col(page_no) - F.lag(page_no).over(w) - 1
    mark = F.when(gap > 0, F.concat(F.lit("[... "), gap, F.lit(" pages skipped (low topic relevance) ...]\n\n"))).otherwise("")
    each = pages.select(doc, page_no, F.concat(mark, text).alias("_t"))
    return each.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page_no, "_t"))), lambda x: x["_t"]), "\n\n").alias("text"))
