"""Retrieval in rounds: every question that is still open asks its next queries, all of them in one job a round.

A planner's proposals are a table, so nothing is asked of a model inside the loop. Each round joins the open questions
with their proposals, drops queries that the question has asked before, searches for all of them at once, and adds what
is new to the question's evidence. Whether a question goes on is decided from its own counts; the loop ends when none is
open or after the last round. Every round writes its steps and its new evidence to the work folder, so no round's plan
holds the ones before it, and a lost executor repeats one round at most.

Defined cases: a question without proposals stops in its first round; a null or blank proposal counts as none; proposals
equal up to case and white space are one query; several questions of one id are one question; a search may return no
rows; an empty table of questions gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.session import settle

#: ``search(asked)`` takes ``qid, query`` and returns ``qid, query, rank, id, source``.
Search = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Enough:
    """Evidence with which a question that is neither broad nor risky stops after its first round."""

    items: int = 4
    sources: int = 2


def core(query: Column) -> Column:
    """A query without regard to case and white space; null for a blank one."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(query), r"\s+", " ")), F.lit(""))


def _evidence_so_far(rounds: list[DataFrame]) -> DataFrame:
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def _new_queries(proposals: DataFrame, active: DataFrame, number: int) -> DataFrame:
    """``qid, query, core``: what the open questions ask in this round for the first time."""
    up_to = proposals.where(F.col("round") <= number).withColumn("core", core(F.col("query"))).where("core is not null").join(active.select("qid"), "qid", "left_semi")
    first = up_to.groupBy("qid", "core").agg(F.min(F.struct("round", "query")).alias("f"))
    return first.where(F.col("f.round") == number).select("qid", "core", F.col("f.query").alias("query"))


def iterative_retrieval(questions: DataFrame, proposals: DataFrame, search: Search, rounds: int = 3, limit: int = 10, enough: Enough = Enough()) -> tuple[DataFrame, DataFrame]:
    """Several queries a round, merged by rank: ``(outcomes, evidence)``.

    ``questions(qid, comprehensive, high_risk)``; ``proposals(qid, round, query)``. ``outcomes`` has for each question
    ``rounds, n_queries, n_items, n_sources, stop_reason``, the reason being ``enough_evidence`` (after the first round),
    ``no_new_query`` or ``max_rounds``; ``evidence`` has ``qid, round, id, source`` once for each item of a question, of
    the ``limit`` best of each round.
    """
    spark = questions.sparkSession
    active = settle(questions.groupBy("qid").agg(F.coalesce(F.max("comprehensive"), F.lit(False)).alias("comprehensive"), F.coalesce(F.max("high_risk"), F.lit(False)).alias("high_risk")).withColumns({"n_queries": F.lit(0), "n_items": F.lit(0), "n_sources": F.lit(0)}), "loop-open")
    found = [spark.createDataFrame([], "qid long, round int, id long, source string").select(F.col("qid").cast(questions.schema["qid"].dataType), "round", "id", "source")]
    ended: list[DataFrame] = []
    for number in range(1, rounds + 1):
        if active.isEmpty():
            break
        asked = settle(_new_queries(proposals, active, number), f"loop-asked-{number}")
        hits = search(asked.select("qid", "query"))
        merged = hits.groupBy("qid", "id").agg(F.min("rank").alias("rank"), F.min("source").alias("source"))
        best = merged.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))).where(F.col("place") <= limit)
        new = best.join(_evidence_so_far(found).select("qid", "id"), ["qid", "id"], "left_anti")
        found.append(settle(new.select("qid", F.lit(number).alias("round"), "id", "source"), f"loop-evidence-{number}"))
        counts = _evidence_so_far(found).groupBy("qid").agg(F.count("*").cast("int").alias("items"), F.countDistinct("source").cast("int").alias("sources"))
        queries = asked.groupBy("qid").agg(F.count("*").cast("int").alias("queries"))
        step = active.join(queries, "qid", "left").join(counts, "qid", "left")
        satisfied = ~F.col("comprehensive") & ~F.col("high_risk") & (F.col("n_items") >= enough.items) & (F.col("n_sources") >= enough.sources)
        reason = F.when(F.col("queries") == 0, "no_new_query").when(F.lit(number == 1) & satisfied, "enough_evidence").when(F.lit(number == rounds), "max_rounds")
        state = step.select(
            "qid", "comprehensive", "high_risk", F.coalesce("queries", F.lit(0)).alias("queries"), (F.col("n_queries") + F.coalesce("queries", F.lit(0))).alias("n_queries"),
            F.coalesce("items", F.lit(0)).alias("n_items"), F.coalesce("sources", F.lit(0)).alias("n_sources"),
        )
        state = settle(state.withColumn("stop_reason", reason).withColumn("rounds", F.lit(number) - (F.col("queries") == 0).cast("int")), f"loop-state-{number}")
        ended.append(state.where("stop_reason is not null").select("qid", "rounds", "n_queries", "n_items", "n_sources", "stop_reason"))
        active = state.where("stop_reason is null").drop("stop_reason", "rounds", "queries")
    if not ended:
        ended = [active.select("qid", F.lit(0).alias("rounds"), "n_queries", "n_items", "n_sources", F.lit("max_rounds").alias("stop_reason"))]
    return _evidence_so_far(ended), _evidence_so_far(found)


def chain_retrieval(questions: DataFrame, proposals: DataFrame, search: Search, steps: int = 4, least: int = 3, longest: int = 512) -> tuple[DataFrame, DataFrame]:
    """One query a step, each guarded against those before it: ``(steps, evidence)``.

    ``questions(qid)``; ``proposals(qid, round, query, enough)``, at most one a round, ``enough`` being the planner's
    word, after the step, that it needs no more. A question stops at a query that is empty, too long or a repetition, at
    a step without proposal, when it has ``least`` items of evidence and the planner says so
    (``enough_verified_evidence``), or after the last step (``max_iterations``). ``steps`` has a row for each step taken:
    ``qid, step, query, trusted, new_items, n_items, confidence, gate, stop_reason``; confidence is the share of
    ``least`` that the question has.
    """
    spark = questions.sparkSession
    key = questions.schema["qid"].dataType
    active = settle(questions.select("qid").distinct().withColumn("had", F.lit(0)), "chain-open")
    found = [spark.createDataFrame([], "qid long, step int, id long, source string").select(F.col("qid").cast(key), "step", "id", "source")]
    taken: list[DataFrame] = []
    for number in range(1, steps + 1):
        if active.isEmpty():
            break
        own = proposals.where(F.col("round") == number).groupBy("qid").agg(F.min("query").alias("query"), F.coalesce(F.max("enough"), F.lit(False)).alias("enough"), F.lit(True).alias("proposed"))
        before = proposals.where(F.col("round") < number).groupBy("qid", F.col("round").alias("r")).agg(F.min("query").alias("q")).select("qid", core(F.col("q")).alias("core"), F.lit(True).alias("again")).distinct()
        guarded = active.join(own, "qid", "left").withColumn("core", core(F.col("query"))).join(before, ["qid", "core"], "left")
        refusal = (
            F.when(F.col("proposed").isNull(), "no_followup_query").when(F.col("core").isNull(), "empty_followup_query").when(F.length(F.trim("query")) > longest, "followup_query_too_long").when(F.col("again"), "duplicate_followup_query")
        )
        asked = settle(guarded.select("qid", "had", "query", "enough", refusal.alias("refusal")), f"chain-asked-{number}")
        hits = search(asked.where("refusal is null").select("qid", "query"))
        supported = settle(hits.groupBy("qid", "id").agg(F.min("source").alias("source")), f"chain-hits-{number}")  # read twice, searched once
        new = supported.join(_evidence_so_far(found).select("qid", "id"), ["qid", "id"], "left_anti")
        found.append(settle(new.select("qid", F.lit(number).alias("step"), "id", "source"), f"chain-evidence-{number}"))
        hit = supported.groupBy("qid").agg(F.lit(True).alias("hit"))
        more = found[-1].groupBy("qid").agg(F.count("*").cast("int").alias("new"))
        step = asked.join(hit, "qid", "left").join(more, "qid", "left").withColumn("new_items", F.coalesce("new", F.lit(0))).withColumn("n_items", F.col("had") + F.col("new_items"))
        gate = (
            F.when(F.col("refusal").isNotNull(), F.lit(None)).when(F.col("n_items") < least, "insufficient_unique_evidence")
            .when(F.col("enough"), "model_has_enough_verified_evidence").otherwise("model_requests_more_verified_evidence")
        )
        reason = F.coalesce(F.col("refusal"), F.when(F.col("gate") == "model_has_enough_verified_evidence", "enough_verified_evidence"), F.when(F.lit(number == steps), "max_iterations"))
        state = step.withColumn("gate", gate).select(
            "qid", F.lit(number).alias("step"), "query", F.coalesce("hit", F.lit(False)).alias("trusted"), "new_items", "n_items",
            F.round(F.least(F.lit(1.0), F.col("n_items") / F.lit(least)), 3).alias("confidence"), "gate", reason.alias("stop_reason"),
        )
        taken.append(settle(state, f"chain-step-{number}"))
        active = taken[-1].where("stop_reason is null").select("qid", F.col("n_items").alias("had"))
    if not taken:
        shape = "step int, query string, trusted boolean, new_items int, n_items int, confidence double, gate string, stop_reason string"
        taken = [active.select("qid", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in shape.split(", "))).where("false")]
    return _evidence_so_far(taken), _evidence_so_far(found)
