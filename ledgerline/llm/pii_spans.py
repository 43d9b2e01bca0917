"""Personal data: expressions propose spans, checksums confirm them, context words move the score.

Built-in Spark functions only.  Spark's expression functions give matches without
their places, so a text is also split at the matches: match i starts after gaps 0..i
and matches 0..i-1, which is a running sum over lengths in code points.

Defined cases: a null or empty text has no spans; equal rows get equal results; an
empty table gives an empty one; other columns are not read.  Spans of different kinds
may overlap; those of one kind do not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points before and after a span in which context words count.
CONTEXT = 40
CHUNK = 64


def _parts_ok(m: Column) -> Column:
    low = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, "\\."), lambda p: (F.length(low(p)) == 0) | ((F.length(low(p)) <= 3) & (F.substring(low(p), 1, 3).try_cast("int") <= 255)))


def _digits(m: Column) -> Column:
    return F.translate(m, "+ ().-", "")


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(14, 19) & F.call_function("luhn_check", d)


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def _iban(m: Column) -> Column:
    """Country, check digits and account moved as the standard says; the number they spell is 1 modulo 97."""
    d = F.translate(m, " ", "")
    moved = F.split(F.concat(F.substring(d, 5, 40), F.substring(d, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(moved, F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97))
    return F.length(d).between(15, 34) & (rest == 1)


@dataclass(frozen=True)
class Kind:
    """pattern finds the same matches as the plain one; its look-behinds and possessive loops keep long runs linear."""

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    needs: str
    score: float
    words: str
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", None, "@", 0.9, "e-?mail|contact|write|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", _parts_ok, ".", 0.5, "ip|address|host|server|login"),
    Kind("card", r"(?=[0-9])(?:\G|(?<![0-9][\x20-])(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++", _card, "", 0.7, "card|visa|credit|payment|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, "+", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?=[A-Z]{2}[0-9]{2})(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban, "", 0.8, "iban|bank|account|transfer", base=False),
)


def _ends(lengths: Column) -> Column:
    """Running sums, by chunks of CHUNK elements so that the work grows with the number of elements."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    n = F.size(lengths)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: add(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK))))
    before = F.slice(F.aggregate(chunks, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)), F.lit(1), F.size(chunks))
    # A chunk's own sums hang on the sum before it; each chunk is short.
    return F.flatten(
        F.transform(
            F.arrays_zip(before.alias("b"), F.sequence(F.lit(0), F.size(chunks) - 1).alias("c")),
            lambda z: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(CHUNK), n - z["c"] * CHUNK)),
                lambda i: z["b"] + add(F.slice(lengths, z["c"] * CHUNK + 1, i)),
            ),
        )
    )


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Per document ``spans``: structs of start, rank of the kind, kind, end, score, base; sorted by start, then kind."""
    step = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = lambda k: F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0))
    step = step.select("doc_id", "t", *[(F.when(F.contains("t", F.lit(k.needs)), found(k)) if k.needs else found(k)).alias(f"m_{k.name}") for k in kinds])
    # One array of (gap + match) lengths a kind; its running sums are the ends of the matches.
    gap = lambda k: F.transform(F.slice(F.split("t", k.pattern, -1), F.lit(1), F.size(f"m_{k.name}")), F.length)
    some = lambda k: F.size(f"m_{k.name}") > 0
    step = step.select("doc_id", "t", *[F.when(some(k), F.col(f"m_{k.name}")).alias(f"m_{k.name}") for k in kinds], *[F.when(some(k), F.zip_with(gap(k), F.transform(f"m_{k.name}", F.length), lambda a, b: a + b)).alias(f"l_{k.name}") for k in kinds])
    step = step.select("doc_id", "t", *[f"m_{k.name}" for k in kinds], *[F.when(F.col(f"l_{k.name}").isNotNull(), _ends(F.col(f"l_{k.name}"))).alias(f"e_{k.name}") for k in kinds])
    return step.select("doc_id", F.sort_array(F.concat(*[_spans(k, rank) for rank, k in enumerate(kinds)])).alias("spans"))


def _spans(k: Kind, rank: int) -> Column:
    both = F.zip_with(f"m_{k.name}", f"e_{k.name}", lambda m, e: F.struct(m.alias("m"), e.alias("e")))
    good = F.filter(both, lambda x: F.coalesce(k.valid(x["m"]), F.lit(False))) if k.valid else both
    made = F.transform(
        good,
        lambda x: F.struct(
            (x["e"] - F.length(x["m"])).cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(k.name).alias("kind"), x["e"].cast("long").alias("end"), _score(k, x).alias("score"), F.lit(k.base).alias("base")
        ),
    )
    return F.coalesce(made, F.expr("array()"))


def _score(k: Kind, x: Column) -> Column:
    start = x["e"] - F.length(x["m"])
    lo = F.greatest(start - CONTEXT, F.lit(0))
    around = F.concat(F.substring(F.col("t"), lo + 1, start - lo), F.lit(" "), F.substring(F.col("t"), x["e"] + 1, F.lit(CONTEXT)))
    near = F.lower(around).rlike(rf"(?<![a-z])(?:{k.words})(?![a-z])")
    return F.round(F.least(F.lit(1.0), F.lit(k.score) + F.when(near, 0.2).otherwise(0.0)), 2)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the base digest and all spans as text."""
    of = lambda test: F.filter("spans", test)
    return found.select(
        "doc_id",
        *[F.size(of(_is(k.name))).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(joined(of(lambda x: x["base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: F.format_string("%.2f", x["score"])), ",").alias("scores"),
    )


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _oracle() -> str:
    """The same in SQL, from the plain patterns; a word boundary stands for the look-arounds of IBANs."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    }
    luhn = "list_sum(list_transform(range(1, length(g) + 1), lambda j: CAST(substr(reverse(g), j, 1) AS INT) * (2 - j % 2) - CASE WHEN j % 2 = 0 AND CAST(substr(reverse(g), j, 1) AS INT) > 4 THEN 9 ELSE 0 END)) % 10 = 0"
    spelled = "list_transform(string_split(substr(q, 5) || substr(q, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    valid = f"""CASE kind WHEN 'email' THEN true
      WHEN 'ip' THEN list_max(list_transform(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT), 999))) <= 255
      WHEN 'card' THEN length(g) BETWEEN 14 AND 19 AND {luhn}
      WHEN 'phone' THEN length(g) BETWEEN 10 AND 15
      ELSE length(q) BETWEEN 15 AND 34 AND list_reduce({spelled}, lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1 END"""
    each = " UNION ALL ".join(
        f"SELECT doc_id, t, {rank} AS rank, '{k.name}' AS kind, {str(k.base).lower()} AS base, {k.score} AS least, '(^|[^a-z])({k.words})([^a-z]|$)' AS words, regexp_extract_all(t, '{plain[k.name]}', 0) AS ms, string_split_regex(t, '{plain[k.name]}') AS gs FROM d"
        for rank, k in enumerate(KINDS)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({each}),
x AS (SELECT doc_id, t, rank, kind, base, least, words, ms[i] AS m,
        CAST(list_sum(list_transform(gs[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS s
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0)),
v AS (SELECT *, s + length(m) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS g, replace(m, ' ', '') AS q FROM x),
o AS (SELECT *, kind || ':' || s || ':' || e AS span,
        printf('%.2f', least(1.0, least + CASE WHEN regexp_matches(lower(substr(t, greatest(s - {CONTEXT}, 0) + 1, s - greatest(s - {CONTEXT}, 0)) || ' ' || substr(t, e + 1, {CONTEXT})), words) THEN 0.2 ELSE 0 END)) AS score
      FROM v WHERE {valid}),
r AS (SELECT doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (WHERE base), '')) AS base_sha256, string_agg(span, ',' ORDER BY s, rank) AS spans, string_agg(score, ',' ORDER BY s, rank) AS scores FROM o GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS if k.base)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""


ORACLE = _oracle()
