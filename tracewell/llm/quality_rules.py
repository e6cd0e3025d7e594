"""Quality rules as a ledger of failure bits.

``ledger`` evaluates every rule once per document: it keeps the measurements and one long whose bit *i* says that rule
*i* failed. What follows needs no text: ``apply_policy`` reads a versioned policy (which failures reject, and how
many of the others are too many) off the bits, and ``ablation`` counts, from one row per combination of bits, what each
rule rejects, what it alone rejects, and what any policy would keep without it.

All of it is column expressions over one row at a time; there is no shuffle before the small aggregate of ``ablation``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import WORD

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of every window of five words."""
    last = F.size(words) - WINDOW
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort the hashes with their places, keep the places of equal
    neighbours, and add up what each window adds to the one before it."""

    def places(s: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        kept = F.transform(s, lambda x, j: F.when(same(j - 1, x) | same(j + 1, x), x["i"]))
        return F.sort_array(F.array_compact(kept))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(ordered, places), total))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the long columns ``MEASURES``; null text counts as empty.

    Window equality is equality of 64-bit hashes within one document. Extra columns pass through, but those named like a
    measurement are replaced by it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    staged = docs.select(
        F.struct("*").alias("row"), F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"), lines.alias("lines"), F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"), F.regexp_count(text, F.lit("[A-Z]")).alias("n_upper")).withColumn("hashes", _window_hashes(F.col("words")))
    made = {
        "n_words": F.size("words"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"), "n_lines": F.size("lines"), "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_upper": F.col("n_upper"), "n_repeat_words": _covered(F.col("hashes")),
    }
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in MEASURES]
    return staged.select(*kept, *[made[m].cast("long").alias(m) for m in MEASURES])


@dataclass(frozen=True)
class Rule:
    """A rule's name and the SQL condition, over measurements, under which a document fails it."""

    name: str
    fails: str


#: The order is the order of bits; rules are only ever added at the end, so that kept ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("shouting", "2 * n_upper > word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """Rules whose failure rejects; of the others in ``soft``, more than ``allowed`` failures reject."""

    reject: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0


BASE = ("few_words", "repeated_windows")
POLICIES = {
    1: Policy(BASE),
    2: Policy(BASE + ("symbols", "shouting"), ("duplicate_lines", "short_words", "long_words"), 1),
}
CURRENT = 2


def bits(names: tuple[str, ...]) -> int:
    at = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << at[n] for n in names)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``measure`` plus ``failures``, the long with a bit for each of ``RULES``."""
    failed = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)]
    mask = failed[0]
    for f in failed[1:]:
        mask = mask.bitwiseOR(f)
    return measure(docs, text_col).withColumn("failures", mask)


def passes(policy: Policy, failures: Column) -> Column:
    return (failures.bitwiseAND(F.lit(bits(policy.reject))) == 0) & (F.bit_count(failures.bitwiseAND(F.lit(bits(policy.soft)))) <= policy.allowed)


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """A ledger's rows with ``kept`` under a policy's version."""
    return rows.withColumn("kept", passes(POLICIES[version], F.col("failures")))


def ablation(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """(rule, failed, only_failure, kept, kept_without) for every rule: documents that fail it, that fail it and nothing
    else, that the policy keeps, and that it would keep with the rule's bit ignored.

    One aggregate over the bits of the ledger, added up on the map side; it gives one row, which becomes a row a rule.
    """
    policy, failures = POLICIES[version], F.col("failures")
    count = lambda condition: F.coalesce(F.sum(condition.cast("long")), F.lit(0))
    each = [
        F.struct(F.lit(r.name).alias("rule"), F.coalesce(F.sum(F.shiftright(failures, i).bitwiseAND(F.lit(1))), F.lit(0)).cast("long").alias("failed"), count(failures == 1 << i).alias("only_failure"),
                 count(passes(policy, failures)).alias("kept"), count(passes(policy, failures.bitwiseAND(F.lit(~(1 << i))))).alias("kept_without"))
        for i, r in enumerate(RULES)
    ]
    return rows.agg(F.array(*each).alias("rules")).select(F.inline("rules"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents: measurements, base_failed, kept, and the failure bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.col("failures").bitwiseAND(F.lit(bits(BASE))) != 0
    return apply_policy(ledger(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures")


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    """What each quality rule rejects of all documents, alone and together with the others."""
    return ablation(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), grams AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)
), f AS (
  SELECT *, (n_words < 10)::BIGINT AS f0, (100 * n_repeat_words > 20 * n_words)::BIGINT AS f1, (10 * n_symbols > 2 * n_words)::BIGINT AS f2,
         (10 * n_dup_lines > 3 * n_lines)::BIGINT AS f3, (word_chars < 2 * n_words)::BIGINT AS f4, (word_chars > 15 * n_words)::BIGINT AS f5, (2 * n_upper > word_chars)::BIGINT AS f6
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 + f1 > 0 AS base_failed, f0 + f1 + f2 + f6 = 0 AND f3 + f4 + f5 <= 1 AS kept,
       f0 + 2 * f1 + 4 * f2 + 8 * f3 + 16 * f4 + 32 * f5 + 64 * f6 AS failures
FROM f
"""

ABLATION_SQL = f"""
WITH l AS ({OP2_SQL}), p AS (SELECT failures, unnest([0, 1, 2, 3, 4, 5, 6]) AS i FROM l), q AS (
  SELECT i, failures, 1::BIGINT << i AS bit, failures & ~(1::BIGINT << i) AS left_over FROM p
)
SELECT ['{"', '".join(r.name for r in RULES)}'][i + 1] AS rule, count(*) FILTER (failures & bit <> 0)::BIGINT AS failed, count(*) FILTER (failures = bit)::BIGINT AS only_failure,
       count(*) FILTER (failures & {bits(POLICIES[CURRENT].reject)} = 0 AND bit_count(failures & {bits(POLICIES[CURRENT].soft)}) <= {POLICIES[CURRENT].allowed})::BIGINT AS kept,
       count(*) FILTER (left_over & {bits(POLICIES[CURRENT].reject)} = 0 AND bit_count(left_over & {bits(POLICIES[CURRENT].soft)}) <= {POLICIES[CURRENT].allowed})::BIGINT AS kept_without
FROM q GROUP BY i
"""
