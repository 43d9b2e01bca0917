"""Documents: index pages, cull of their claims, re-extraction routing, page selection, JSON shapes, drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..functions.keys import with_source_key
from ..functions.python_udfs import anchor_density
from .audit import latest_by

# Parts of a URL path that name an index page, and the two thresholds.
INDEX_TOKENS = ("/topic/", "/topics/", "/category/", "/categories/", "/tag/", "/tags/", "/section/", "/sections/", "/archive/", "/archives/", "/index", "/all/", "/all-", "/listing/", "/browse/")
PROSE_FLOOR, DENSITY = 400, 0.5
# Fixed value: the longest preview of a cull.
PREVIEW = 50


def with_index_signal(pages: DataFrame, page: str, mime: str, url: str) -> DataFrame:
    """Adds anchor, other and signal: article, index or unknown."""
    m, path = F.lower(F.col(mime)), T.url_path(F.col(url))
    token = F.lit(False)
    for t in INDEX_TOKENS:
        token = token | path.contains(t)
    scanned = pages.withColumn("_d", anchor_density(F.col(page))).withColumns({"anchor": F.col("_d.anchor"), "other": F.col("_d.other")}).drop("_d")
    a, o = F.col("anchor"), F.col("other")
    signal = (
        F.when(~((m == "") | T.is_html(m)), "unknown").when((o < PROSE_FLOOR) & ~token & (a == 0), "unknown").when(o < PROSE_FLOOR, "index").when(token | (a / (a + o) >= DENSITY), "index").otherwise("article")
    )
    return scanned.withColumn("signal", signal)


def cull(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims with what is done to them by the signal of the latest document of their source: unrouted, culled, kept_article, kept_unknown."""
    latest = latest_by(documents, ["source_id"], F.desc("observed_at"), F.desc("id")).select("source_id", "signal")
    return claims.join(latest, "source_id", "left").withColumn("action", F.when(F.col("signal").isNull(), "unrouted").when(F.col("signal") == "index", "culled").otherwise(F.concat(F.lit("kept_"), "signal"))).drop("signal")


def cull_preview(claims: DataFrame, documents: DataFrame, cap: int = PREVIEW) -> DataFrame:
    """The newest claims that a cull would take, with the page that each comes from; nothing is changed.

    claims: id, source_id, content_kind, observed_at.  documents: source_id, source_url, signal, observed_at, id.
    """
    latest = latest_by(documents, ["source_id"], F.desc("observed_at"), F.desc("id")).select("source_id", "source_url", "signal")
    taken = claims.join(latest.filter("signal = 'index'"), "source_id").orderBy(F.desc("observed_at"), F.desc("id")).limit(cap)
    return taken.select("id", "content_kind", T.shortened(T.hostless(F.coalesce("source_url", F.lit("")))).alias("source_path"), "signal")


def reextraction_routes(documents: DataFrame, recipes: DataFrame) -> DataFrame:
    """Documents with the recipe that their source id names, if it exists."""
    known = recipes.select("recipe_id", F.lit(True).alias("routed"))
    return with_source_key(documents).join(known, "recipe_id", "left").withColumn("routed", F.coalesce("routed", F.lit(False)))


def selected_pages(pages: DataFrame, budget: int) -> DataFrame:
    """Pages (doc, page_no, score, size) to read: the first three, then by score while the budget lasts; all if nothing scores."""
    w = Window.partitionBy("doc")
    order = Window.partitionBy("doc").orderBy(F.when(F.col("page_no") < 3, 0).otherwise(1), F.when(F.col("page_no") < 3, F.lit(0)).otherwise(-F.col("score")), "page_no")
    ranked = pages.withColumn("_best", F.max("score").over(w)).withColumn("_sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # The first page over the budget ends the choice: running sums only grow.
    return ranked.filter((F.col("_best") <= 0) | (F.col("page_no") < 3) | (F.col("_sum") <= budget)).drop("_best", "_sum")


def valid_assertions(drafts: DataFrame, predicates: list[str]) -> DataFrame:
    """Drafts of assertions that keep the rules; an empty list of predicates allows all."""
    d = drafts.withColumns({c: F.trim(c) for c in ("claimant", "subject", "object", "predicate")})
    ok = V.is_entity_id(F.col("subject")) & V.is_entity_id(F.col("object")) & (F.col("claimant") != "") & (F.col("predicate") != "") & F.col("stance").isin(*V.STANCES)
    ok = ok & F.col("predicate").isin(*predicates) if predicates else ok
    return d.filter(F.coalesce(ok, F.lit(False))).withColumn("confidence", V.clamped_confidence(F.col("confidence")))


def valid_events(drafts: DataFrame, types: list[str]) -> DataFrame:
    """Drafts of events of an allowed type; blank actors are left out, a bad actor drops the row, an unknown direction is null."""
    actors = F.filter(F.transform("actors", lambda a: F.trim(a)), lambda a: a != "")
    d = drafts.withColumn("actors", actors)
    ok = V.is_event_type(F.col("event_type")) & F.col("event_type").isin(*types) & (F.trim("headline") != "") & F.forall("actors", lambda a: V.is_entity_id(a))
    return d.filter(F.coalesce(ok, F.lit(False))).withColumn("direction", F.when(F.col("direction").isin(*V.DIRECTIONS), F.col("direction")))


def valid_observations(drafts: DataFrame, metrics: list[str]) -> DataFrame:
    """Drafts of observations of an allowed metric in a fixed period; a bad currency is null."""
    ok = F.col("metric").isin(*metrics) & V.is_unit(F.col("unit")) & F.col("period").isin(*V.PERIODS)
    return drafts.filter(F.coalesce(ok, F.lit(False))).withColumn("currency", F.when(V.is_currency(F.col("currency")), F.col("currency")))


def valid_entities(drafts: DataFrame, kinds: list[str]) -> DataFrame:
    ok = V.is_entity_id(F.col("entity_id")) & (F.trim("canonical_name") != "")
    ok = ok & F.col("kind").isin(*kinds) if kinds else ok
    return drafts.filter(F.coalesce(ok, F.lit(False)))


def plan_gate(drafts: DataFrame, kinds: list[str]) -> tuple[DataFrame, Column]:
    """Drafts of the plan's kinds (all if it names none), and the sorted first 16 of the other kinds."""
    other = F.slice(F.array_sort(F.collect_set(F.when(~F.col("kind").isin(*kinds), F.col("kind")))), 1, 16) if kinds else F.expr("array()")
    return (drafts.filter(F.col("kind").isin(*kinds)) if kinds else drafts), other
