"""Quality rules as a bitmask ledger: every rule is measured once, policies are bit operations afterwards.

``ledger`` takes each text once and stores the measurements and one failure bit per rule. A policy is a named, versioned
set of bits; applying it, or asking what dropping a rule would change, is bitwise arithmetic on the ledger. All of it is
DataFrame expressions.

Defined cases: a null text has no words and fails the length rule; lines are cut at newline only; texts of any length are
measured whole, in time near to linear in their words; repeated and null ``doc_id`` values pass through, a row in is a
row out; an empty table gives an empty ledger; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import common

_WINDOW = 5
_SYMBOLS = "#*$%&|<>"
#: Rules in bit order: name and failing condition over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 30 * n_words",
    "capitals": "2 * n_capitals > n_letters and n_words >= 10",
}
#: Versioned policies as the rules that they enforce.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "capitals"),
}


def bits(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more in the text.

    Windows are compared by hash. Only a text with a repeat sorts its windows with their places; the places of repeats,
    in order, then cover ``min(5, distance to the next)`` words each.
    """
    n = F.size(words)

    def window(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(_WINDOW)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, i, j: F.coalesce(F.get(s, i + j)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])

        def spread(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(_WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(_WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)

        return _bind(placed, lambda s: _bind(F.array_sort(places(s)), spread))

    hashes = F.transform(F.sequence(F.lit(0), n - _WINDOW), window)
    whole = _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n <= _WINDOW, F.lit(0).cast("long")).otherwise(whole)


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``fail_mask`` (a bit per rule of ``RULES``)."""
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, common.SPACES, "")
    trimmed = F.trim(text, F.lit(common.SPACES))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(common.SPACES)) != "")
    # words are needed twice; as a column of their own they are cut once
    cut = docs.select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+", -1)).alias("words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))).alias("lines"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"),
        F.regexp_count(text, F.lit("[a-z]")).alias("small"),
    )
    measured = cut.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("lines.n") - F.col("lines.distinct")).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"),
        F.col("capitals").cast("long").alias("n_capitals"),
        (F.col("capitals") + F.col("small")).cast("long").alias("n_letters"),
    )
    mask = F.lit(0)
    for bit, condition in enumerate(RULES.values()):
        mask = mask.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)))
    return measured.withColumn("fail_mask", mask)


def apply_policy(table: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept`` under a policy: no enforced bit is set."""
    return table.withColumn("kept", F.col("fail_mask").bitwiseAND(F.lit(bits(POLICIES[policy]))) == 0)


def ablations(table: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per policy and rule: documents that fail it, that only it rejects, and that all rules together reject.

    The ledger is first aggregated to one row per mask, at most ``2 ** rules`` rows.
    """
    masks = table.groupBy("fail_mask").agg(F.count("*").alias("n"))
    wanted = [(p, r, bits(rules), bits((r,))) for p, rules in policies.items() for r in rules]
    named = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(a).alias("all"), F.lit(b).alias("bit")) for p, r, a, b in wanted)))
    each = masks.select("fail_mask", "n", named.alias("x")).select("fail_mask", "n", "x.*")
    hit = F.col("fail_mask").bitwiseAND(F.col("all"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("policy", "rule").agg(
        count(hit.bitwiseAND(F.col("bit")) != 0)("failing"), count(hit == F.col("bit"))("only_by_this"), count(hit != 0)("rejected_by_policy")
    )


def stored(docs: DataFrame) -> DataFrame:
    """The ledger as a table in the shared folder, read back: policies and ablations read it, never the texts again."""
    return common.settle(ledger(docs), "quality-ledger")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version rejects, over all documents."""
    return ablations(stored(common.table(spark, sf_dir, "documents")))


def op5(spark: SparkSession, sf_dir: str, policy: str = "v2") -> DataFrame:
    table = apply_policy(stored(common.table(spark, sf_dir, "documents")), policy).withColumn("policy", F.lit(policy))
    failed = F.col("fail_mask").bitwiseAND(F.lit(bits(POLICIES["base"]))) != 0
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "n_lines", "fail_mask", "policy")
