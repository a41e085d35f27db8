"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; policies are versioned masks over those bits, so that a new policy or an ablation costs bitwise
operations and no second look at the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WHITE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A named bit: the rule fails where the condition over the measurements holds."""

    name: str
    bit: int
    fails: str


#: Bits never change their meaning; new rules take new bits.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 15 * n_words"),
)
BIT = {r.name: 1 << r.bit for r in RULES}
#: Each version's rules; a version, once published, stays as it is.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": BIT["few_words"] | BIT["repeated_words"] | BIT["symbols"] | BIT["repeated_lines"],
    "v2": sum(BIT.values()),
}
LATEST = "v2"


def covered(starts: Column) -> Column:
    """Positions within windows of three that start at the sorted positions."""
    first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
    return F.aggregate(starts, first, step, lambda a: a["n"])


def measured(docs: DataFrame) -> DataFrame:
    """The documents' id with their measurements; a null text has none of anything.

    Repeated windows: windows' hashes are sorted with their places, so that equal ones are neighbours,
    and the places they cover are counted in order. That is n log n in a text's words. Texts whose
    windows are all distinct skip it.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", F.array_remove(F.split("text", WHITE), "").alias("words"), F.regexp_count("text", F.lit(SYMBOL)).alias("n_symbols"), lines.alias("lines"))
    n = F.size("words")
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    windows = F.when(n >= 4, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id",
        n.alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        windows.alias("windows"),
    )
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("placed", F.when(twice, F.sort_array(placed))).drop("windows")
    equal = lambda x, k: (F.get("placed", k - 1)["h"] == x["h"]) | (F.get("placed", k + 1)["h"] == x["h"])
    starts = F.sort_array(F.transform(F.filter("placed", equal), lambda x: x["i"]))
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered(starts), F.lit(0))).drop("placed")
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in counts])


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and the bits of all failed rules (failed), each rule evaluated once."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return measured(docs).withColumn("failed", total.cast("bigint"))


def verdict(mask: int) -> Column:
    """Whether a row of the ledger passes the policy of this mask."""
    return F.col("failed").bitwiseAND(F.lit(mask)) == 0


def apply_policy(entries: DataFrame, version: str = LATEST) -> DataFrame:
    return entries.withColumn("kept", verdict(POLICIES[version]))


def ablations(entries: DataFrame, version: str = LATEST) -> DataFrame:
    """For each rule of the policy: documents it fails, fails alone, and what is kept without it.

    Distinct bit patterns are counted first, 64 at most, so that all ablations share one aggregation.
    """
    mask = POLICIES[version]
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if mask & 1 << r.bit]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in rules])).alias("r")
    rows = patterns.select("failed", "n", each).select("failed", "n", "r.rule", "r.bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return rows.groupBy("rule").agg(
        count(F.col("failed").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        count(F.col("failed") == F.col("bit"))("n_failed_alone"),
        count(F.col("failed").bitwiseAND(F.bitwise_not("bit")) == 0)("n_kept_without"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, the measurements, base_failed, kept and the bits of failed rules. Null and
    empty texts have no words and fail; null ids and repeated rows stay.
    """
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), LATEST)
    failed = ~verdict(POLICIES["base"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"), "n_lines", "failed")


ORACLE_SQL = {
    "op9_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS three
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM g) WHERE n > 1),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 3)) AS k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN hit USING (r)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
             + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, n_lines, failed FROM f
""",
}
QUERIES = {"op9_quality_rules": op9_quality_rules}
