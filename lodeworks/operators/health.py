"""Knowledge health: data, retrieval and trust scores, version-series anomalies, trends. One plan scores every base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points per anomaly and their cap, and the longest gap between versions.
PENALTIES = {"DUPLICATE_DOCUMENTS": 10, "TEMPORAL_OVERLAP": 10, "SERIES_GAP": 5, "SERIES_SUPERSEDE_ANOMALY": 10, "SERIES_ORPHANED": 5}
PENALTY_CAP, GAP_DAYS, LEAST_SAMPLE = 40, 90, 3


def series_anomalies(docs: DataFrame, today: Column) -> DataFrame:
    """Anomaly counts per ``kb, family, code`` of ``docs(kb, id, family, start, end, sha256)``; documents without a start drop.

    An end before the start excludes a document; of equal content the earliest stays; more than one current version counts
    each beyond the first; neighbours by start overlap, leave a gap, or end without a successor.
    """
    dated = docs.where("start is not null and family is not null")
    bad = F.col("end") < F.col("start")
    wrong = dated.where(bad).groupBy("kb", "family").agg(F.count("*").alias("n")).select("kb", "family", F.lit("SERIES_SUPERSEDE_ANOMALY").alias("code"), "n")
    valid = dated.where(~F.coalesce(bad, F.lit(False)))
    same = Window.partitionBy("kb", "family", "sha256").orderBy("start", "id")
    ranked = valid.withColumn("nth", F.row_number().over(same))
    repeats = ranked.groupBy("kb", "family").agg(F.count_if(F.col("nth") == 2).alias("n")).where("n > 0").select("kb", "family", F.lit("DUPLICATE_DOCUMENTS").alias("code"), "n")
    chain = Window.partitionBy("kb", "family").orderBy("start", "id")
    own = ranked.where("nth = 1").withColumns({"next": F.lead("start").over(chain), "latest": F.max("start").over(Window.partitionBy("kb", "family"))})
    per = own.groupBy("kb", "family").agg(
        F.greatest(F.count_if(F.col("end").isNull() & (F.col("start") <= today)) - 1, F.lit(0)).alias("SERIES_SUPERSEDE_ANOMALY"),
        F.count_if(F.col("latest") < F.col("end")).alias("SERIES_ORPHANED"),
        F.count_if(F.col("next") < F.col("end")).alias("TEMPORAL_OVERLAP"),
        F.count_if(F.datediff("next", "end") > GAP_DAYS).alias("SERIES_GAP"),
    )
    codes = ("SERIES_SUPERSEDE_ANOMALY", "SERIES_ORPHANED", "TEMPORAL_OVERLAP", "SERIES_GAP")
    wide = per.select("kb", "family", F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in codes))).alias("x")).select("kb", "family", "x.code", "x.n").where("n > 0")
    return wrong.unionByName(repeats).unionByName(wide).groupBy("kb", "family", "code").agg(F.sum("n").alias("n"))


def series_penalty(anomalies: DataFrame) -> DataFrame:
    points = F.create_map(*(x for k, v in PENALTIES.items() for x in (F.lit(k), F.lit(v))))
    return anomalies.groupBy("kb").agg(F.least(F.lit(PENALTY_CAP), F.sum(points[F.col("code")] * F.col("n"))).cast("long").alias("penalty"))


def data_health(docs: DataFrame, indexed: DataFrame, penalties: DataFrame | None = None) -> DataFrame:
    """``kb, total, ready, failed, empty, score`` of ``docs(kb, status, page_count)`` and ``indexed(kb, verified)``.

    70 points for readiness, 15 for the absence of failures, 15 for a verified index, less the series penalty, within 0
    to 100. A base without documents scores 0.
    """
    per = docs.groupBy("kb").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if((F.col("status") == "ready") & (F.coalesce("page_count", F.lit(0)) == 0)).alias("empty")
    )
    joined = indexed.join(per, "kb", "left").na.fill(0, ["total", "ready", "failed", "empty"])
    joined = joined.join(penalties, "kb", "left") if penalties is not None else joined.withColumn("penalty", F.lit(0))
    raw = 100 * (0.70 * F.col("ready") / F.col("total") + 0.15 * (1 - F.col("failed") / F.col("total")) + F.when(F.col("verified"), 0.15).otherwise(0.0)) - F.coalesce("penalty", F.lit(0))
    score = F.when(F.col("total") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
    return joined.select("kb", "total", "ready", "failed", "empty", F.round(score, 1).alias("score"))


def retrieval_health(answers: DataFrame) -> DataFrame:
    """``kb, n, score`` of ``answers(kb, cited, insufficient, refused)``; null under three answers."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    per = answers.groupBy("kb").agg(F.count("*").alias("n"), (100 * (0.60 * rate("cited") + 0.20 * (1 - rate("insufficient")) + 0.20 * (1 - rate("refused")))).alias("s"))
    return per.select("kb", "n", F.when(F.col("n") >= LEAST_SAMPLE, F.round("s", 1)).alias("score"))


def trust_health(claims: DataFrame) -> DataFrame:
    """``kb, n, score`` of ``claims(kb, supported, invalid, inconsistent, contradicted)``; null under three claims."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    per = claims.groupBy("kb").agg(F.count("*").alias("n"), (100 * (0.55 * rate("supported") + 0.20 * (1 - rate("invalid")) + 0.15 * (1 - rate("inconsistent")) + 0.10 * (1 - rate("contradicted")))).alias("s"))
    return per.select("kb", "n", F.when(F.col("n") >= LEAST_SAMPLE, F.round("s", 1)).alias("score"))


def overall(data: Column, retrieval: Column, trust: Column) -> Column:
    """Weighted from the rounded scores; null if any is null."""
    return F.round(0.4 * data + 0.3 * retrieval + 0.3 * trust, 1)


def level(score: Column) -> Column:
    return F.when(score < 40, "critical").when(score < 60, "warning").when(score.isNotNull(), "healthy")


def deductions(score: dict[str, tuple[Column, str]]) -> Column:
    """Codes whose condition holds, in the order given."""
    return F.array_compact(F.array(*(F.when(condition, code) for code, (condition, _) in score.items())))


def snapshot_deltas(snapshots: DataFrame) -> DataFrame:
    """``snapshots(kb, at, id, score)`` in order with the change since the one before; null-safe, one decimal."""
    w = Window.partitionBy("kb").orderBy("at", "id")
    return snapshots.withColumn("delta", F.round(F.col("score") - F.lag("score").over(w), 1)).withColumn("level", level(F.col("score")))


def latest_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order; the window limit keeps one row per key and task before the shuffle."""
    return rows.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth_ = 1").drop("nth_")


def health_distribution(bases: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``bucket, n``: latest level per base, ``partial`` for a null score and ``unknown`` without a snapshot."""
    last = latest_per(snapshots, ["kb"], [F.desc("at"), F.desc("id")]).select("kb", F.coalesce(level(F.col("score")), F.lit("partial")).alias("bucket"))
    return bases.select("kb").join(last, "kb", "left").groupBy(F.coalesce("bucket", F.lit("unknown")).alias("bucket")).agg(F.count("*").alias("n"))


def kpi(value: Column, delta: Column, base: Column) -> Column:
    """Struct ``value, delta, delta_pct``; not comparable without a positive base."""
    ok = base > 0
    return F.struct(value.alias("value"), F.when(ok, delta).alias("delta"), F.when(ok, F.round(delta / base * 100, 2)).alias("delta_pct"))


def calendar_series(events: DataFrame, day: Column, first: str, days: int, measures: list[Column]) -> DataFrame:
    """One row for each of ``days`` days from ``first``, with measures, zero where nothing happened."""
    calendar = events.sparkSession.range(days).select(F.expr(f"date_add(date'{first}', cast(id as int))").alias("day"))
    counted = events.withColumn("day", day).where(F.col("day").between(F.lit(first).cast("date"), F.expr(f"date_add(date'{first}', {days - 1})"))).groupBy("day").agg(*measures)
    joined = calendar.join(counted, "day", "left")
    return joined.na.fill(0)


def answer_quality(runs: DataFrame) -> DataFrame:
    """Success rate, uncited successes, cancelled runs and mean latency of ``runs(status, cited, latency)``."""
    ok, failed = F.count_if(F.col("status") == "succeeded"), F.count_if(F.col("status") == "failed")
    return runs.agg(
        F.round(F.when(ok + failed > 0, ok / (ok + failed) * 100), 2).alias("success_rate"), (ok + failed).alias("sample_count"),
        F.count_if((F.col("status") == "succeeded") & ~F.coalesce("cited", F.lit(False))).alias("uncited"), F.count_if(F.col("status") == "cancelled").alias("cancelled"), F.round(F.avg("latency"), 2).alias("average_latency"),
    )
