"""A gate over reports: thresholds on dotted paths, and aggregates held against the details that they sum up.

Reports are JSON texts; a threshold is a row ``report, path, op, value``, so any number of them is one join. The details
are a table; the means and counts of their groups are computed again and compared with what the report claims.

Defined cases: a path that a report lacks, or a value that is no number where one is compared, fails; a report without
details fails; ``eq`` compares texts where the wanted value is no number; null details count as rows, not in means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thresholds(reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """``report, name, passed, detail`` of ``wanted(report, path, op, value)`` on ``reports(report, body)``; ``op`` is ge, gt, le, lt or eq."""
    joined = wanted.join(reports.select("report", "body"), "report", "left").withColumn("actual", F.call_function("get_json_object", F.col("body"), F.concat(F.lit("$."), F.col("path"))))
    a, v = F.expr("try_cast(actual as double)"), F.expr("try_cast(value as double)")
    passed = (
        F.when(F.col("op") == "ge", a >= v).when(F.col("op") == "gt", a > v).when(F.col("op") == "le", a <= v).when(F.col("op") == "lt", a < v)
        .when(F.col("op") == "eq", F.when(v.isNull(), F.col("actual") == F.col("value")).otherwise(a == v))
    )
    return joined.select("report", F.concat(F.lit("threshold:"), "path").alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), F.concat_ws(" ", F.coalesce("actual", F.lit("missing")), "op", "value").alias("detail"))


def recomputed(reports: DataFrame, details: DataFrame, group: str, means: list[str], tolerance: float = 1e-6) -> DataFrame:
    """``report, name, passed, detail``: each report's ``metrics.<group>.<field>`` and ``rows`` against its details.

    ``details(report, group, means...)``; a group that only one side has fails.
    """
    sums = details.groupBy("report", F.col(group).cast("string").alias("g")).agg(F.count("*").cast("double").alias("rows"), *(F.avg(F.col(m).cast("double")).alias(m) for m in means))
    fields = ["rows", *means]
    actual = sums.select("report", "g", F.explode(F.map_from_arrays(F.array(*(F.lit(f) for f in fields)), F.array(*(F.col(f) for f in fields)))).alias("field", "actual"))
    claims = reports.select("report", F.explode(F.from_json(F.get_json_object("body", "$.metrics"), "map<string, map<string, double>>")).alias("g", "m")).select("report", "g", F.explode("m").alias("field", "claimed")).where(F.col("field").isin(fields))
    both = actual.join(claims, ["report", "g", "field"], "full")
    close = F.col("actual").eqNullSafe(F.col("claimed")) | F.coalesce(F.abs(F.col("actual") - F.col("claimed")) <= tolerance, F.lit(False))
    shown = lambda c: F.coalesce(F.round(c, 6).cast("string"), F.lit("none"))
    return both.select("report", F.concat_ws(".", F.lit("recomputed:metrics"), "g", "field").alias("name"), close.alias("passed"), F.concat(F.lit("claimed="), shown(F.col("claimed")), F.lit(", actual="), shown(F.col("actual"))).alias("detail"))


def verdict(checks: DataFrame) -> DataFrame:
    """``report, passed, n, failed``: a report passes if all its checks do; at most twenty names of failed ones, in order."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("name"))))
    return checks.groupBy("report").agg(F.bool_and("passed").alias("passed"), F.count("*").alias("n"), F.slice(failed, 1, 20).alias("failed"))
