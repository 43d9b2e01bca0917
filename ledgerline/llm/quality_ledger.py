"""Quality rules as a bitmask ledger, in built-in Spark functions only.

Every rule is evaluated once per document.  The ledger row keeps the measurements
and one failure bit per rule; policies are masks over these bits, so another
policy or an ablation reads the ledger and never the text again.

Defined cases: a null or empty text has no words and fails ``few_words``; repeated
rows get equal ledger rows; an empty table gives an empty ledger.  Only the named id
and text columns are read, so other columns with any names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Name and test of each rule; its place is its bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "50 * n_symbols > word_chars"),
    ("repeated_lines", "n_lines >= 8 AND 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 30 * n_words"),
    ("short_words", "2 * word_chars < 3 * n_words"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
#: Versioned policies: a document is kept if none of the policy's bits is set.
POLICIES: dict[str, int] = {"v1-base": BASE, "v2-all": sum(BITS.values())}


def _measured(docs: DataFrame, id_column: Column, text: str) -> DataFrame:
    t = F.coalesce(F.col("t"), F.lit(""))
    step = docs.select(id_column.alias("doc_id"), F.col(text).alias("t"))
    step = step.select(
        "doc_id",
        F.array_remove(F.split(t, BLANKS), "").alias("w"),
        F.length(F.translate(t, BLANK_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0).alias("lines"),
    )
    # 64-bit hashes stand for 3-word windows; they are compared within one text only.
    window = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    step = step.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.slice(window, F.lit(1), F.size("w") - 2)).alias("h"),
    )
    return step.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).withColumn(
        "n_repeat_words", F.coalesce(_covered(F.col("p")).cast("long"), F.lit(0).cast("long"))
    )


def _covered(pairs: Column) -> Column:
    """Words in windows whose hash stands next to an equal one in the sorted pairs."""
    same = lambda x, k: x["h"].eqNullSafe(F.get(pairs, k)["h"])
    twice = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def quality_ledger(docs: DataFrame, doc_id: str | Column = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and ``rule_bits`` of every document."""
    m = _measured(docs, F.col(doc_id) if isinstance(doc_id, str) else doc_id, text)
    bits = F.lit(0).cast("long")
    for name, test in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", bits.alias("rule_bits"))


def passes(policy: str, bits: str | Column = "rule_bits") -> Column:
    """Whether a ledger row meets the policy."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def kept(docs: DataFrame, policy: str, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns; the whole row travels in the ledger's id."""
    ledger = quality_ledger(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text)
    # The row number, never negative, keeps the optimizer from moving the test below the
    # projections, where it would compute the measurements once for each use.
    numbered = ledger.withColumn("row", F.monotonically_increasing_id())
    return numbered.filter(passes(policy) & (F.col("row") >= 0)).select("doc_id.*")


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail nothing else, and that pass without it.

    The ledger is first counted by bit pattern (at most two to the number of rules
    groups), so the rules are compared over that small table.
    """
    mask = POLICIES[policy]
    seen = ledger.groupBy(F.col("rule_bits").bitwiseAND(F.lit(mask).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).cast("long").alias("bit")) for k, v in BITS.items() if v & mask]))
    each = seen.select("b", "n", rules.alias("r"))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    has = F.col("b").bitwiseAND(F.col("r.bit"))
    return each.groupBy(F.col("r.name").alias("rule")).agg(
        count(has != 0).alias("n_fail"),
        count(F.col("b") == F.col("r.bit")).alias("n_fail_only"),
        count((F.col("b") - has) == 0).alias("n_kept_without"),
    )


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("rule_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0).alias("base_failed"),
        passes("v2-all").alias("kept"), "rule_bits",
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 50 * n_symbols > word_chars THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 8 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 30 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * word_chars < 3 * n_words THEN 32 ELSE 0 END AS BIGINT) AS rule_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (rule_bits & 3) <> 0 AS base_failed, rule_bits = 0 AS kept, rule_bits FROM b
"""
