"""Entailment of claims, relative times against evidence, requirements of risky questions, and the trust report.

Exact spans are decided natively. What a checker finds comes in as a table and is joined back; a claim without a usable
finding stays unknown. Nulls: a missing text is empty, a missing finding is a failed checker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators.text import strip_marks

#: Where a clause ends, the fields that name a source in order, and the most claims of an answer for a checker.
CLAUSE_END = "\n。！？!?；;，,"
SOURCE_FIELDS = ("source_url", "document_id", "reference", "display_name", "location_id", "evidence_id")
MOST_CHECKED = 32


def exact_clause(claim: Column, evidence: Column, start: Column, end: Column) -> Column:
    """Whether the clauses of the evidence that hold ``[start, end)`` say the claim and nothing else, up to marks and case."""
    within = (start >= 0) & (end > start) & (end <= F.length(evidence))
    before = F.regexp_extract(F.substring(evidence, F.lit(1), start), f"[^{CLAUSE_END}]*$", 0)
    after = F.regexp_extract(F.substring(evidence, end + 1, F.length(evidence)), f"^[^{CLAUSE_END}]*", 0)
    core = strip_marks(claim)
    whole = F.concat(before, F.substring(evidence, start + 1, end - start), after)
    return F.coalesce(within & (core != "") & (strip_marks(whole) == core), F.lit(False))


def to_check(claims: DataFrame, most: int = MOST_CHECKED) -> DataFrame:
    """Claims for a checker: supported, not rejected and not exact, the first ``most`` of an answer by ``claim_index``."""
    open_ = claims.where("status = 'supported' and effective_status <> 'unsupported' and not exact and size(evidence_ids) > 0")
    return open_.withColumn("nth_", F.row_number().over(Window.partitionBy("answer_id").orderBy("claim_index"))).where(F.col("nth_") <= most).drop("nth_")


def entail(claims: DataFrame, findings: DataFrame | None, least: float = 0.0) -> DataFrame:
    """Adds ``entailment, method, confidence, reason`` and settles ``effective_status``; a contradicted claim is unsupported.

    ``claims(answer_id, claim_index, status, effective_status, evidence_ids, exact)``; ``findings(answer_id, claim_index,
    verdict, confidence)`` come from a checker, None where there is none. A claim with two findings has none that counts;
    a verdict of less confidence than ``least`` is unknown.
    """
    if findings is None:
        found = claims.withColumns({"verdict_": F.lit(None).cast("string"), "confidence_": F.lit(None).cast("double")})
    else:
        once = findings.groupBy("answer_id", "claim_index").agg(F.count("*").alias("n_"), F.first("verdict").alias("verdict_"), F.first("confidence").cast("double").alias("confidence_")).where("n_ = 1").drop("n_")
        found = claims.join(once, ["answer_id", "claim_index"], "left")
    sure = F.col("confidence_").between(0.0, 1.0) & ~F.isnan("confidence_")
    decided = F.col("verdict_").isin("entailed", "contradicted") & F.coalesce(sure, F.lit(False))
    low = decided & (F.col("confidence_") < least)
    verdict = F.when(decided & ~low, F.col("verdict_")).otherwise("unknown")
    reason = (
        F.when(~F.col("status").isin("supported", "conflicting") | (F.col("effective_status") == "unsupported"), "ENTAILMENT_VALID_SUPPORTED_CITATION_REQUIRED")
        .when(F.col("status") == "conflicting", "ENTAILMENT_CONFLICT_REQUIRES_DISCLOSURE")
        .when(F.col("exact"), "ENTAILMENT_EXACT_MATCH")
        .when(F.size("evidence_ids") == 0, "ENTAILMENT_EVIDENCE_TEXT_MISSING")
        .when(F.lit(findings is None), "ENTAILMENT_CHECKER_DISABLED")
        .when(F.col("verdict_").isNull(), "ENTAILMENT_RESULT_MISSING")
        .when(low, "ENTAILMENT_LOW_CONFIDENCE")
        .otherwise(F.concat(F.lit("ENTAILMENT_"), F.upper(verdict)))
    )
    told = found.withColumn("reason", reason)
    exact, model = F.col("reason") == "ENTAILMENT_EXACT_MATCH", ~F.col("reason").isin(
        "ENTAILMENT_VALID_SUPPORTED_CITATION_REQUIRED", "ENTAILMENT_CONFLICT_REQUIRES_DISCLOSURE", "ENTAILMENT_EXACT_MATCH", "ENTAILMENT_EVIDENCE_TEXT_MISSING", "ENTAILMENT_CHECKER_DISABLED"
    )
    out = told.withColumns({
        "entailment": F.when(exact, "entailed").when(model, verdict).otherwise("not_checked"),
        "method": F.when(exact, "exact_match").when(model, "semantic_nli").otherwise("not_checked"),
        "confidence": F.when(exact, 1.0).when(model & F.coalesce(sure, F.lit(False)), F.col("confidence_")),
    })
    return out.withColumn("effective_status", F.when(F.col("entailment") == "contradicted", "unsupported").otherwise(F.col("effective_status"))).drop("verdict_", "confidence_")


def propagate(final: DataFrame, assessed: DataFrame) -> DataFrame:
    """``final(answer_id, text, evidence_ids, effective_status…)`` with the ``entailment`` of the same claim before the policy.

    The same text and evidence is the same claim; of several the last by ``claim_index`` counts. Others are not checked.
    """
    last = assessed.groupBy("answer_id", "text", "evidence_ids").agg(F.max_by("entailment", "claim_index").alias("entailment"))
    joined = final.join(last, ["answer_id", "text", "evidence_ids"], "left").withColumn("entailment", F.coalesce("entailment", F.lit("not_checked")))
    return joined.withColumn("effective_status", F.when(F.col("entailment") == "contradicted", "unsupported").otherwise(F.col("effective_status")))


def source_name(fields: dict[str, Column]) -> Column:
    """``field:value`` of the first field in order that has a value; null without any."""
    return F.coalesce(*(F.when(F.coalesce(fields[f].cast("string"), F.lit("")) != "", F.concat(F.lit(f"{f}:"), fields[f].cast("string"))) for f in SOURCE_FIELDS if f in fields))


def risk_checks(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``risk_status, risk_reasons`` and rejects claims that miss a requirement.

    ``claims(answer_id, claim_index, effective_status, entailment, evidence_ids, high, decisive, allow_unknown, need_evidence,
    need_sources)``; ``sources(answer_id, evidence_id, source)``. Only claims still supported have requirements.
    """
    cited = claims.select("answer_id", "claim_index", F.explode("evidence_ids").alias("evidence_id")).join(sources, ["answer_id", "evidence_id"])
    counts = cited.groupBy("answer_id", "claim_index").agg(F.countDistinct("source").alias("sources_"))
    joined = claims.join(counts, ["answer_id", "claim_index"], "left").withColumn("sources_", F.coalesce("sources_", F.lit(0)))
    asks = F.col("high") & F.col("decisive")
    decided = F.col("entailment").isin("entailed", "contradicted")
    passes = decided | ((F.col("entailment") == "unknown") & F.col("allow_unknown"))
    evidence, sources_ = F.size(F.array_distinct("evidence_ids")) >= F.col("need_evidence"), F.col("sources_") >= F.col("need_sources")
    reasons = F.array_compact(F.array(
        F.when(asks, F.when(decided, "HIGH_RISK_ENTAILMENT_DECISIVE").otherwise("HIGH_RISK_ENTAILMENT_REQUIRED")),
        F.when(evidence, "RISK_EVIDENCE_COUNT_MET").otherwise("HIGH_RISK_MINIMUM_EVIDENCE_NOT_MET"),
        F.when(sources_, "RISK_DISTINCT_SOURCE_COUNT_MET").otherwise("HIGH_RISK_MINIMUM_DISTINCT_SOURCES_NOT_MET"),
    ))
    status = F.col("effective_status")
    fails = (asks & ~passes) | ~evidence | ~sources_
    told = joined.withColumns({
        "risk_status": F.when(status == "conflicting", "conflict_disclosed").when(status != "supported", "not_applicable").when(fails, "rejected").otherwise("passed"),
        "risk_reasons": F.when(status == "conflicting", F.array(F.lit("RISK_CONFLICT_DISCLOSED"))).when(status != "supported", F.array(F.lit("RISK_CLAIM_ALREADY_REJECTED"))).otherwise(reasons),
    })
    return told.withColumn("effective_status", F.when(F.col("risk_status") == "rejected", "unsupported").otherwise(status)).drop("sources_")


def relative_time_check(claim_values: Column, terms: Column, reference: Column, evidence_values: Column, unanchored: Column) -> Column:
    """Struct ``status, reason, missing`` of a claim's relative times; null for a claim without any.

    ``claim_values`` are the terms resolved on ``reference``; ``evidence_values`` what the evidence states or resolves to
    on its own publication dates; ``unanchored`` its relative terms without a date.
    """
    missing = F.array_sort(F.array_except(claim_values, evidence_values))

    def told(status: str, reason: str, what: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), what.alias("missing"))

    return (
        F.when(F.size(terms) == 0, F.lit(None))
        .when(reference.isNull(), told("unknown", "RELATIVE_TIME_REFERENCE_MISSING", terms))
        .when((F.size(missing) > 0) & (F.size(unanchored) > 0), told("unknown", "RELATIVE_TIME_EVIDENCE_ANCHOR_MISSING", F.array_sort(F.array_distinct(unanchored))))
        .when(F.size(missing) > 0, told("inconsistent", "RELATIVE_TIME_NOT_IN_EVIDENCE", missing))
        .otherwise(told("consistent", "RELATIVE_TIME_VALUES_MATCH", missing))
    )


def consistency_status(statuses: Column) -> Column:
    """One status from the statuses of a claim's checks: inconsistent, then unknown, then consistent, else not applicable."""
    has = lambda s: F.array_contains(statuses, s)
    return F.when(has("inconsistent"), "inconsistent").when(has("unknown"), "unknown").when(F.size(statuses) > 0, "consistent").otherwise("not_applicable")


def trust_report(claims: DataFrame, states: DataFrame) -> DataFrame:
    """``answer_id, trust_status, verification_level, limitations`` of assessed claims and final states.

    ``claims(answer_id, method, entailment, relative_time, freshness)`` with the statuses of these two checks (null: none);
    ``states(answer_id, state, snapshot)``. Limitations come in a fixed order.
    """
    per = claims.groupBy("answer_id").agg(
        F.count_if(F.col("method") == "semantic_nli").alias("checked"), F.count_if(F.col("method") == "exact_match").alias("exact"), F.count_if(F.col("entailment") == "unknown").alias("unknown"),
        F.coalesce(F.bool_or(F.col("relative_time") == "unknown"), F.lit(False)).alias("open_time"), F.coalesce(F.bool_or(F.col("freshness") == "unknown"), F.lit(False)).alias("open_freshness"),
    )
    joined = states.join(per, "answer_id", "left").na.fill(0, ["checked", "exact", "unknown"]).na.fill(False, ["open_time", "open_freshness"])
    level = (
        F.when((F.col("checked") > 0) & (F.col("unknown") > 0), "semantic_entailment_partial").when(F.col("checked") > 0, "semantic_entailment")
        .when(F.col("exact") > 0, "exact_match_and_deterministic_consistency").otherwise("deterministic_consistency")
    )
    limits = F.array_compact(F.array(
        F.when(F.col("open_freshness"), "FRESHNESS_VERIFICATION_INCOMPLETE"), F.when(F.col("open_time"), "RELATIVE_TIME_VERIFICATION_INCOMPLETE"),
        F.when(F.col("checked") == 0, "SEMANTIC_ENTAILMENT_NOT_CHECKED").when(F.col("unknown") > 0, "SEMANTIC_ENTAILMENT_INCOMPLETE"),
        F.lit("OPEN_ENDED_SEMANTIC_CONSISTENCY_NOT_CHECKED"), F.lit("SAFETY_NOT_EVALUATED"),
    ))
    return joined.select("answer_id", F.when(F.col("snapshot"), F.col("state")).otherwise("not_assessed").alias("trust_status"), level.alias("verification_level"), limits.alias("limitations"))
