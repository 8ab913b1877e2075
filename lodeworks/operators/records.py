"""Operational records as tables: queue heads, leases, attempts, guards, pages with totals, and answer metrics.

Updates are rewrites: each function returns the new state of its table, which the caller writes as a new version. Row
locks have no form in Spark; one writer at a time is the caller's to ensure. Null keys never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How an answer says that it has none.
REFUSALS = (
    "没有相关信息", "未找到相关", "资料中未提及", "文档中未提及", "无法从", "无法给出有充分依据的回答", "no relevant information", "not mentioned",
    "not provided", "cannot determine", "没有负载测试数据", "没有给出具体数值", "未提供具体数值", "未明确规定", "not specified", "no evidence",
)


def queue_heads(jobs: DataFrame, queue: str, order: list[str], free: Column) -> DataFrame:
    """The next job of each queue that is free to be taken, by a total order."""
    w = Window.partitionBy(queue).orderBy(*order)
    return jobs.where(free).withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def lease_free(lease: Column, now: Column) -> Column:
    """Whether a lease was never taken or has run out."""
    return lease.isNull() | (lease <= now)


def acquire(rows: DataFrame, wanted: DataFrame, key: str, now: Column, seconds: int) -> DataFrame:
    """``rows`` after the holders in ``wanted(key, holder)`` tried to take a lease: only free rows change, each has one winner.

    Adds ``taken``; of several holders that ask at once the smallest name wins.
    """
    ask = wanted.groupBy(key).agg(F.min("holder").alias("ask_"))
    joined = rows.join(ask, key, "left").withColumn("taken", F.col("ask_").isNotNull() & lease_free(F.col("lease"), now))
    return joined.withColumns({"holder": F.when(F.col("taken"), F.col("ask_")).otherwise(F.col("holder")), "lease": F.when(F.col("taken"), now + F.make_dt_interval(secs=F.lit(seconds))).otherwise(F.col("lease"))}).drop("ask_")


def renew(rows: DataFrame, held: DataFrame, key: str, now: Column, seconds: int) -> DataFrame:
    """``rows`` after the holders in ``held(key, holder)`` renewed: a lease moves on only for whoever holds it. Adds ``renewed``."""
    own = held.select(key, F.col("holder").alias("own_")).distinct()
    hit = F.coalesce(F.col("own_") == F.col("holder"), F.lit(False))
    return rows.join(own.withColumnRenamed(key, "key_"), (F.col(key) == F.col("key_")) & (F.col("holder") == F.col("own_")), "left").withColumn("renewed", hit).withColumn("lease", F.when(F.col("renewed"), now + F.make_dt_interval(secs=F.lit(seconds))).otherwise(F.col("lease"))).drop("key_", "own_")


def release(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """``rows`` after the holders in ``held(key, holder)`` let go: holder and lease become null only for whoever holds it. Adds ``released``."""
    own = held.select(F.col(key).alias("key_"), F.col("holder").alias("own_")).distinct()
    joined = rows.join(own, (F.col(key) == F.col("key_")) & (F.col("holder") == F.col("own_")), "left").withColumn("released", F.col("own_").isNotNull())
    return joined.withColumns({c: F.when(~F.col("released"), F.col(c)) for c in ("holder", "lease")}).drop("key_", "own_")


def without(rows: DataFrame, condition: Column) -> DataFrame:
    """``rows`` less those for which the condition holds; a null condition deletes nothing."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def next_attempts(documents: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """Each document with the number of its next attempt, 1 for the first."""
    last = attempts.groupBy(key).agg(F.max("attempt").alias("last_"))
    return documents.join(last, key, "left").withColumn("next_attempt", F.coalesce("last_", F.lit(0)) + 1).drop("last_")


def busy(owners: DataFrame, documents: DataFrame, key: str, states: tuple[str, ...] = ("queued", "processing")) -> DataFrame:
    """``owners`` with ``busy``: whether any of their documents is in one of the states."""
    at_work = documents.where(F.col("status").isin(*states)).select(key).distinct().withColumn("busy", F.lit(True))
    return owners.join(at_work, key, "left").withColumn("busy", F.coalesce("busy", F.lit(False)))


def guarded(asked: DataFrame, bases: DataFrame, members: DataFrame) -> DataFrame:
    """``asked(user, base)`` with ``found``: the base exists and the user is in its workspace.

    A base that is missing and one that is not the user's give the same answer.
    """
    # what is asked leads, so that no base meets members who did not ask for it
    placed = asked.select("user", "base").distinct().join(bases.select("base", "workspace").distinct(), "base")
    open_ = placed.join(members, ["user", "workspace"], "left_semi").select("user", "base").distinct().withColumn("found", F.lit(True))
    return asked.join(open_, ["user", "base"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def page_with_total(rows: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """One page by a total order, and one row with the ``total`` of all pages, counted apart so that the page stays a top-k."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), rows.agg(F.count("*").alias("total"))


def refusal(answer: Column) -> Column:
    """Whether an answer says that it has none."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    hit = F.lit(False)
    for marker in REFUSALS:
        hit = hit | F.contains(text, F.lit(marker))
    return hit


def citation_scores(cited: DataFrame, gold: DataFrame, key: str, item: str) -> DataFrame:
    """``key, precision, recall`` of cited against gold items, both distinct; null where there is nothing to divide by."""
    c, g = cited.select(key, item).distinct(), gold.select(key, item).distinct()
    both = c.withColumn("c_", F.lit(1)).join(g.withColumn("g_", F.lit(1)), [key, item], "full")
    per = both.groupBy(key).agg(F.count("c_").alias("c_"), F.count("g_").alias("g_"), F.count_if(F.col("c_").isNotNull() & F.col("g_").isNotNull()).alias("hit_"))
    return per.select(key, F.when(F.col("c_") > 0, F.col("hit_") / F.col("c_")).alias("precision"), F.when(F.col("g_") > 0, F.col("hit_") / F.col("g_")).alias("recall"))


def claim_rates(claims: DataFrame, key: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """``key, claims`` and for each value the share of claims that have it."""
    share = lambda v: (F.count_if(F.col(column) == v) / F.count("*")).alias(f"{v}_rate")
    return claims.groupBy(key).agg(F.count("*").alias("claims"), *(share(v) for v in values))


def recall_at(ranked: DataFrame, gold: DataFrame, key: str, item: str, ks: tuple[int, ...]) -> DataFrame:
    """``key`` and recall among the first ``k`` distinct items for each ``k``. ``ranked(key, item, rank)``."""
    best = ranked.groupBy(key, item).agg(F.min("rank").alias("rank"))
    per = gold.select(key, item).distinct().join(best, [key, item], "left").groupBy(key)
    return per.agg(*((F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks))
