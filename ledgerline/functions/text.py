"""Scalar text functions as column expressions: MIME classes, URLs, markup, relevance words, scrubbing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# MIME prefixes of structured text and of binary content.
STRUCTURED_PREFIXES = ("application/json", "text/json", "application/xml", "text/xml", "text/csv")
STRUCTURED_EXACT = ("text/tab-separated-values", "application/vnd.ms-excel")
BINARY_PREFIXES = ("image/", "audio/", "video/")
BINARY_EXACT = ("application/pdf", "application/octet-stream", "application/zip", "application/x-tar", "application/gzip")
# Named character references that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—",
    "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "copy": "©", "reg": "®", "trade": "™",
}
# Words that say nothing about relevance.
STOPWORDS = (
    "this that these those with from into have been will their they them what when where while which such also more than only over about annual data report page table year https http".split()
)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def mime(raw: Column) -> Column:
    """Before the semicolon, trimmed, small; an empty one is octet-stream."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(t == "", "application/octet-stream").otherwise(F.lower(F.trim(F.substring_index(t, ";", 1))))


def is_html(m: Column) -> Column:
    return m.startswith("text/html") | m.startswith("application/xhtml")


def is_structured(m: Column) -> Column:
    return _any([m.startswith(p) for p in STRUCTURED_PREFIXES]) | m.isin(*STRUCTURED_EXACT)


def is_binary(m: Column) -> Column:
    return _any([m.startswith(p) for p in BINARY_PREFIXES]) | m.isin(*BINARY_EXACT)


def document_kind(m: Column) -> Column:
    return F.when(is_html(m), "article").when(m == "application/pdf", "filing").when(is_structured(m), "data_feed").when(m.startswith("text/plain"), "transcript").otherwise("data_feed")


def length_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 256, "1-255").when(n < 4096, "256-4k").when(n < 32768, "4k-32k").otherwise("32k+")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def url_path(url: Column) -> Column:
    p = F.regexp_extract(F.lower(url), r"://[^/]*(/.*)$", 1)
    return F.when(p == "", "/").otherwise(p)


def hostless(url: Column) -> Column:
    """What follows the host of an address; all of it if it has none."""
    rest = F.regexp_extract(url, r"(?s)://[^/]*(/.*)\z", 1)
    return F.when(~url.contains("://"), url).when(rest == "", "/").otherwise(rest)


def shortened(path: Column, limit: int = 80) -> Column:
    return F.when(F.length(path) <= limit, path).otherwise(F.concat(F.substring(path, 1, limit - 1), F.lit("…")))


def stripped_html(page: Column) -> Column:
    """Scripts, styles, comments and tags become blanks; references are decoded; blanks are collapsed."""
    t = F.regexp_replace(page, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    t = decoded(t)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


# A reference ends within nine bytes of its ampersand.
_REFERENCE = "&(?:" + "|".join(ENTITIES) + "|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"


def _character(reference: Column) -> Column:
    """What a reference stands for; a number that is no character (a surrogate, or beyond the last one) stays as it is."""
    named = F.get(F.array(*[F.lit(v) for v in ENTITIES.values()]), F.array_position(F.array(*[F.lit(f"&{n};") for n in ENTITIES]), reference).cast("int") - 1)
    digits = F.regexp_extract(reference, "([0-9a-fA-F]+);$", 1)
    code = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    sound = (code < 0xD800) | code.between(0xE000, 0x10FFFF)
    numeric = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.coalesce(F.when(reference.contains("#"), numeric).otherwise(named), reference)


def decoded(t: Column) -> Column:
    """References replaced, each once: what a decoded ampersand begins is not decoded again."""
    read = lambda x: F.zip_with(F.split(x, _REFERENCE, -1), F.regexp_extract_all(x, F.lit(_REFERENCE), F.lit(0)), lambda part, r: F.concat(part, F.coalesce(F.when(r.isNull(), ""), _character(r))))
    return F.array_join(once(t, read), "")


def relevance_words(*texts: Column) -> Column:
    """Sorted set of words of four ASCII letters or digits and more, with a letter, without stop words."""
    words = F.split(F.lower(F.concat_ws(" ", *texts)), "[^a-z0-9]+")
    long = F.filter(words, lambda w: (F.length(w) >= 4) & w.rlike("[a-z]"))
    return F.array_sort(F.array_except(F.array_distinct(long), F.array(*[F.lit(w) for w in STOPWORDS])))


def relevance_score(text: Column, words: Column) -> Column:
    low = F.lower(text)
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.floor((F.length(low) - F.length(F.replace(low, w, F.lit("")))) / F.length(w)).cast("long"))


def occurrences(text: Column, part: Column) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def scrubbed(t: Column) -> Column:
    """Bearer tokens, keys with a known prefix and long opaque runs become asterisks."""
    t = F.regexp_replace(t, r"([Bb]earer )\S+", "$1***")
    t = F.regexp_replace(t, r"(sk-ant-|sk-proj-|xai-|AIza)[A-Za-z0-9_-]*?([A-Za-z0-9_-]{4})(?![A-Za-z0-9_-])", "$1***$2")
    t = F.regexp_replace(t, r"[A-Za-z0-9+/_-]{40,}", "***")
    return F.regexp_replace(t, r"[0-9A-Fa-f]{32,}", "***")


def status_class(code: Column) -> Column:
    return F.when(code == 401, "host_requires_auth").when(code == 403, "host_blocked_by_waf").when(code.between(400, 499), "url_shape_mismatch").otherwise("host_unreachable")


def _one_left_out(word: Column) -> Column:
    """A word and what is left of it without each one of its letters."""
    n = F.length(word)
    return F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1))), word))


def _swapped(a: Column, b: Column) -> Column:
    """Whether two words of one length differ by a swap of neighbours."""
    at = lambda w, i: F.substr(w, i, F.lit(1))
    spot = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), at(a, i + 1), at(a, i), F.substr(a, i + 2)) == b
    return (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), spot)


def near_misses(words: DataFrame, word: str, allowed: DataFrame, name: str) -> DataFrame:
    """word and suggestion: the only allowed name at one edit or one swap of neighbours from each distinct word; words without one have no row.

    Two such words share a form of which a letter may be left out, so that an index of these
    forms finds all pairs by an equi-join; each pair is then looked at once.
    """
    index = allowed.select(F.col(name).alias("_name")).distinct().select("_name", F.explode(_one_left_out(F.col("_name"))).alias("_form"))
    asked = words.select(F.col(word)).distinct().select(word, F.explode(_one_left_out(F.col(word))).alias("_form"))
    pairs = asked.join(index, "_form").select(word, "_name").distinct()
    # A swap of two equal letters gives the word itself, which is no miss.
    near = pairs.filter((F.col(word) != F.col("_name")) & ((F.levenshtein(F.col(word), F.col("_name")) == 1) | _swapped(F.col("_name"), F.col(word))))
    return near.groupBy(word).agg(F.count("*").alias("_n"), F.min("_name").alias("suggestion")).filter("_n = 1").drop("_n")


def _mask(name: Column) -> Column:
    """The places of a name at which LIKE takes any character."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substr(name, i, F.lit(1)) == "_")


def _masked(token: Column, places: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.when(F.array_contains(places, i), "_").otherwise(F.substr(token, i, F.lit(1)))), "")


def quoted_names(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """key and name of each text that LIKE '%"name"%' fits, an underscore in a name being any character.

    What stands between two quotes of a text is masked like the names of its length, and met by
    an equi-join; a name with a percent sign, which fits any run, is an error.
    """
    n = F.col(name)
    checked = F.when(n.contains("%"), F.raise_error(F.concat(F.lit("percent sign in "), n))).otherwise(n)
    known = names.select(checked.alias(name)).distinct().filter(F.length(name) > 0).withColumn("_size", F.length(name)).withColumn("_mask", _mask(n))
    shapes = known.select("_size", "_mask").distinct()
    bounds = shapes.agg(F.max("_size").alias("_most"), F.max(F.size("_mask")).alias("_inner"))  # one row of two numbers
    texts = texts.select(key, F.split(F.col(text), '"', -1).alias("_parts")).crossJoin(F.broadcast(bounds))
    # A span between two quotes may hold quotes itself, but only where a name has underscores.
    span = lambda k, j: F.array_join(F.slice("_parts", k + 1, j + 1), '"')
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_parts") - 2), lambda k: F.transform(F.sequence(F.lit(0), F.least(F.col("_inner"), F.size("_parts") - 2 - k)), lambda j: span(k, j))))
    tokens = texts.filter(F.size("_parts") > 2).select(key, "_most", F.explode(F.array_distinct(spans)).alias("_token")).withColumn("_size", F.length("_token")).filter("_size BETWEEN 1 AND _most")
    met = tokens.join(shapes, "_size").withColumn(name, _masked(F.col("_token"), F.col("_mask")))
    return met.select(key, name, "_size", "_mask").distinct().join(known, [name, "_size", "_mask"]).select(key, name).distinct()
