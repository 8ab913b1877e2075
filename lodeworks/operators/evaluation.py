"""Retrieval and answer metrics, gates and matrices. Null means not applicable and stays out of averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(value: str, share: float) -> Column:
    """Nearest-rank percentile as an aggregate."""
    return F.expr(f"percentile_disc({share}) within group (order by {value})")


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per ``qid``: recall, precision (over ``k``), reciprocal rank, hit, duplicates.

    ``ranked(qid, rank, target, same)`` with ``same`` the identity used for duplicates; ``gold(qid, target)``. Recall is over
    distinct gold targets; the precision's denominator is ``k`` also when fewer were returned.
    """
    goals = gold.distinct()
    sizes = goals.groupBy("qid").agg(F.count("*").alias("n_gold"))
    top = ranked.where(F.col("rank") <= k)
    marked = top.join(goals.withColumn("hit", F.lit(1)), ["qid", "target"], "left")
    per = marked.groupBy("qid").agg(
        F.countDistinct(F.when(F.col("hit") == 1, F.col("target"))).alias("found"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), (F.count("*") - F.countDistinct("same")).alias("duplicates")
    )
    joined = sizes.join(per, "qid", "left").na.fill(0, ["found", "hits", "duplicates"])
    return joined.select(
        "qid", (F.col("found") / F.col("n_gold")).alias("recall"), (F.col("hits") / k).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("hits") > 0).alias("hit"), "duplicates"
    )


def summarize(metrics: DataFrame, by: list[str], fields: list[str], digits: int = 4) -> DataFrame:
    """Means over rows that have a value."""
    return metrics.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(f).cast("double")), digits).alias(f) for f in fields))


def by_tag(metrics: DataFrame, tags: str, fields: list[str]) -> DataFrame:
    return summarize(metrics.withColumn("tag", F.explode(tags)), ["tag"], fields)


def criteria_coverage(text: Column, criteria: Column) -> Column:
    """Share of criteria of which some alternative stands in the text; null without criteria."""
    return F.when(F.size(criteria) > 0, F.size(F.filter(criteria, lambda alternatives: F.exists(alternatives, lambda a: F.contains(text, a)))) / F.size(criteria))


def failure_class(answerable: Column, recall: Column, grounded: Column, policy_in: Column, final: Column) -> Column:
    """Where an answer lost coverage first; null for unanswerable questions."""
    return F.when(
        answerable,
        F.when(recall < 1, "retrieval_gap").when(grounded < 1, "chunk_ranking_gap").when(final < policy_in, "policy_deletion").when(final < 1, "generation_gap").otherwise("complete"),
    )


def confusion(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Per label of ``rows(expected, predicted)``: tp, fp, fn, precision, recall, f1."""
    counts = rows.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    each = counts.select("expected", "predicted", "n", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    e, p, x = F.col("expected"), F.col("predicted"), F.col("label")
    per = each.groupBy("label").agg(s((e == x) & (p == x)).alias("tp"), s((e != x) & (p == x)).alias("fp"), s((e == x) & (p != x)).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.select("label", "tp", "fp", "fn", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def confusion_summary(rows: DataFrame, labels: list[str]) -> DataFrame:
    """One row of ``rows(expected, predicted)``: how many, accuracy, and the means over labels of precision, recall and f1."""
    per = confusion(rows, labels).agg(*(F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    total = rows.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.col("expected").eqNullSafe(F.col("predicted")).cast("double")), F.lit(0.0)), 6).alias("accuracy"))
    return total.crossJoin(F.broadcast(per))  # two single rows


def threshold_sweep(rows: DataFrame, thresholds: list[float], positive: str = "entailed", fallback: str = "unknown") -> DataFrame:
    """Accuracy and dangerous acceptances of ``rows(expected, predicted, confidence)`` when weak predictions become unknown."""
    each = rows.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    said = F.when(F.col("confidence") < F.col("threshold"), fallback).otherwise(F.col("predicted"))
    return each.withColumn("said", said).groupBy("threshold").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("said") == F.col("expected")).cast("double")), 6).alias("accuracy"), F.count_if((F.col("said") == positive) & (F.col("expected") != positive)).alias("dangerous")
    )


def promotion_gate(summary: DataFrame, gain: float = 0.01, regression: float = 0.01, ratio: float = 2.0, overhead: float = 10.0, least: int = 20) -> DataFrame:
    """Whether a challenger replaces the base. ``summary`` has one row with ``*_base`` and ``*_new`` of quality, recall, coverage, p95, and n, errors."""
    better = F.col("quality_new") - F.col("quality_base") >= gain
    safe = (F.col("recall_new") - F.col("recall_base") >= -regression) & (F.col("coverage_new") - F.col("coverage_base") >= -regression)
    fast = F.col("p95_new") <= F.greatest(F.col("p95_base") * ratio, F.col("p95_base") + overhead)
    enough, clean = F.col("n") >= least, F.col("errors") == 0
    reasons = F.array_compact(F.array(
        F.when(~better, "QUALITY_GAIN_BELOW_THRESHOLD"), F.when(~safe, "QUALITY_REGRESSION"), F.when(~fast, "SEARCH_P95_OVERHEAD_TOO_HIGH"), F.when(~enough, "INSUFFICIENT_ANSWERABLE_SAMPLES"),
        F.when(~clean, "CHALLENGER_ERRORS_PRESENT"), F.when(better & safe & fast & enough & clean, "CHALLENGER_MEETS_PROMOTION_GATE"),
    ))
    return summary.select((better & safe & fast & enough & clean).alias("promote"), F.array_join(reasons, ",").alias("reasons"))


def rank_stability(runs: DataFrame) -> DataFrame:
    """Per ``mode, qid``: the share of repetitions whose ranking equals the first one's. ``runs(mode, qid, rep, rank, id)``."""
    signed = runs.groupBy("mode", "qid", "rep").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "id")))), 256).alias("s"))
    w = Window.partitionBy("mode", "qid").orderBy("rep")
    return signed.withColumn("first", F.first("s").over(w)).groupBy("mode", "qid").agg(F.avg((F.col("s") == F.col("first")).cast("double")).alias("stability"))


def missing_diagnosis(gold: DataFrame, fused: DataFrame, recalled: DataFrame) -> DataFrame:
    """Gold targets that the fused list lacks: lost in fusion if some retriever had them, else not recalled."""
    lost = gold.join(fused.select("qid", "target").distinct(), ["qid", "target"], "left_anti")
    return lost.join(recalled.select("qid", "target").distinct().withColumn("had", F.lit(True)), ["qid", "target"], "left").select("qid", "target", F.when(F.col("had"), "fusion_lost").otherwise("not_recalled").alias("reason"))


def agent_ranking(summary: DataFrame, weights: dict[str, float], eligible: Column) -> DataFrame:
    """Agents by weighted score, then fewer tokens, lower p95, name; those not eligible last."""
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    scored = summary.withColumn("score", F.round(score, 6)).withColumn("eligible", eligible)
    order = Window.orderBy(F.desc("eligible"), F.desc("score"), "tokens", "p95", "agent")  # a handful of agents
    return scored.withColumn("place", F.row_number().over(order))


def grid(spark, axes: dict[str, list]) -> DataFrame:
    """All settings of a parameter grid, one explode per axis."""
    out = spark.range(1).select(F.lit(1).alias("one_"))
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out.drop("one_")


def quality_gate(metrics: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """``name, value, bound, passed`` for dotted metric paths of one row; a missing metric fails."""
    cells = [
        F.struct(F.lit(path).alias("name"), F.col(path).cast("double").alias("value"), F.lit(f"{op} {bound}").alias("bound"), F.coalesce((F.col(path) >= bound) if op == ">=" else (F.col(path) <= bound), F.lit(False)).alias("passed"))
        for path, (op, bound) in thresholds.items()
    ]
    return metrics.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
