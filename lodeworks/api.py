"""The verbs of the library on DataFrames: load, retrieve, query."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import chunking, entailment, fusion, grounding, retrieval, trust, understanding
from lodeworks.plugins import Embedder, HashingEmbedder, embed_chunks
from lodeworks.session import ship_package, work_folder
from lodeworks.sources.collections import CollectionStore
from lodeworks.sources.loaders import LoaderRegistry


def load_from_local_files(spark: SparkSession, path: str, store: CollectionStore, name: str, embedder: Embedder | None = None, size: int = 1500, overlap: int = 100, registry: LoaderRegistry | None = None) -> str:
    """Files to an active collection version: load, split, embed, build, switch. One lineage, one write."""
    ship_package(spark)
    embedder = embedder or HashingEmbedder()
    found = (registry or LoaderRegistry()).load_directory(spark, path)
    docs = found.select(F.xxhash64("reference", "page_content").alias("doc_id"), F.col("page_content").alias("text"), "reference")
    chunks = chunking.recursive_chunks(docs, size, overlap)
    rows = chunks.select(F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("chunk").alias("text"), "chunk_index", "char_start", "char_end")
    embedded = embed_chunks(rows, embedder, F.col("text"))
    physical = store.build(name, embedded, embedder.dimension, fingerprint=getattr(embedder, "fingerprint", lambda: "")())
    if store.spark.read.parquet(f"{store.root}/{physical}").isEmpty():
        raise ValueError("the files gave no chunks")
    store.activate(name, physical)
    return physical


def retrieve(store: CollectionStore, name: str, questions: Sequence[tuple[int, str]], k: int = 8, mode: str = "hybrid", embedder: Embedder | None = None) -> DataFrame:
    """``qid, rank, id, score, document_id, text`` for a stated list of questions, all in one plan."""
    spark = store.spark
    ship_package(spark)
    embedder = embedder or HashingEmbedder()
    rows = store.read(name).withColumnRenamed("chunk_id", "id")
    if mode not in ("dense", "bm25", "hybrid", "sparse"):
        raise ValueError(f"unknown retrieval mode {mode}")
    dense = sparse = None
    if mode in ("dense", "hybrid"):
        vectors = embedder.embed([q for _, q in questions])
        dense = retrieval.dense_topk([(i, v.tolist()) for (i, _), v in zip(questions, vectors, strict=True)], rows, k)
    if mode != "dense":
        asked = spark.createDataFrame([(i, q) for i, q in questions], "qid long, text string")
        sparse = retrieval.bm25_topk(rows.select("id", "text"), asked, k)
    hits = dense if sparse is None else sparse if dense is None else fusion.weighted_rrf(dense, sparse, limit=k).select("qid", "rank", "id", "score")
    return hits.join(rows.select("id", "document_id", "text"), "id").select("qid", "rank", "id", "score", "document_id", "text")


def naive_retrieve(store: CollectionStore, name: str, question: str, k: int = 8) -> DataFrame:
    return retrieve(store, name, [(0, question)], k, "dense")


REFUSAL = "No relevant information found"


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the work folder and read back: two passes and the text extraction in Python are then done once."""
    path = f"{work_folder(df.sparkSession)}/lodeworks/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def assess(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims of ``answers(answer_id, answer)`` with ``status``, ``exact`` and ``effective_status``.

    ``evidence(answer_id, evidence_id)`` may have a ``text``: then a claim whose dates, versions, quantities or bounds none
    of its cited texts has is unsupported, and ``exact`` tells whether a cited text says just the claim. A claim with no
    text to hold it against keeps its status; null texts are empty; repeated evidence rows change nothing.
    """
    found = grounding.claim_status(grounding.claims(answers), evidence)
    if "text" not in evidence.columns:
        return found.withColumns({"exact": F.lit(False), "effective_status": F.col("status")})
    key = ["answer_id", "claim_index"]
    kinds = ("dates", "versions", "quantities", "ranges")
    told = evidence.select("answer_id", "evidence_id", F.coalesce("text", F.lit("")).alias("said")).distinct().withColumn("has", trust.values("said"))
    pairs = found.select(*key, "text", F.explode("evidence_ids").alias("evidence_id")).join(told, ["answer_id", "evidence_id"]).withColumn("span", grounding.citation_span("text", "said"))
    exact = entailment.exact_clause(F.col("text"), F.col("said"), F.col("span.start"), F.col("span.end"))
    per = pairs.groupBy(*key).agg(F.bool_or(exact).alias("exact"), *(F.flatten(F.collect_list(f"has.{k}")).alias(k) for k in kinds))
    joined = found.withColumn("own", trust.values("text")).join(per, key, "left")
    lacks = [F.size(trust.missing_values(F.col(f"own.{k}"), F.col(k))) > 0 for k in kinds]
    consistency = F.when(F.coalesce(reduce(Column.__or__, lacks), F.lit(False)), "inconsistent").otherwise("consistent")
    return joined.withColumns({"exact": F.coalesce("exact", F.lit(False)), "effective_status": trust.effective_status(F.col("status"), consistency)}).drop("own", *kinds)


def checked(claims: DataFrame, evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """Assessed claims held against their question: adds ``freshness, relative_time, risk_status, risk_reasons``.

    ``questions(answer_id, question, reference)``, one an answer, with the day on which it is asked. ``evidence`` may have
    ``text, family, effective, superseded, published, web`` and what names a source; what it lacks is null. A claim whose
    freshness or relative times fail or stay open is unsupported, and one of a risky question that misses a requirement.
    """
    key = ["answer_id", "claim_index"]
    kinds = {"text": "string", "family": "string", "effective": "date", "superseded": "date", "published": "date", "web": "boolean"}
    known = [F.col(c).cast(t).alias(c) if c in evidence.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    source = entailment.source_name({c: F.col(c) for c in evidence.columns})
    told = evidence.select("answer_id", "evidence_id", *known, source.alias("source")).distinct().withColumn("web", F.coalesce("web", F.lit(False))).withColumnRenamed("text", "said")
    asked = questions.groupBy("answer_id").agg(F.min(F.struct("question", F.col("reference").cast("date").alias("reference"))).alias("q"))
    asked = asked.select("answer_id", F.col("q.reference").alias("reference"), understanding.freshness_intent(F.col("q.question")).alias("mode"), understanding.risk_profile(F.col("q.question")).alias("risk"))
    base = claims.join(asked, "answer_id", "left").withColumns({"mode": F.coalesce("mode", F.lit("none")), "claim_id": F.concat_ws(":", "answer_id", "claim_index"), "terms": trust.relative_terms("text")})
    pairs = base.select("claim_id", "evidence_ids", "mode", "reference", "answer_id").join(told, "answer_id").withColumn("cited", F.array_contains("evidence_ids", F.col("evidence_id")))
    fresh = trust.freshness(pairs.where("mode <> 'none'"), F.col("mode"), F.col("reference")).select("claim_id", F.col("status").alias("freshness"))
    # what cited texts state, and what their own relative times mean on the day they were published
    own = pairs.where("cited").select("claim_id", "published", trust.relative_terms("said").alias("theirs"), trust.values("said").getField("dates").alias("dates"))
    stated = F.flatten(F.transform("dates", lambda d: F.when(trust.strict_date(d).isNotNull(), trust.containing_values(trust.strict_date(d))).otherwise(F.array(d))))
    resolved = F.when(F.col("published").isNotNull(), F.transform("theirs", lambda t: trust.resolve_relative(t, F.col("published")))).otherwise(F.expr("cast(array() as array<string>)"))
    open_ = F.when(F.col("published").isNull(), F.col("theirs")).otherwise(F.expr("cast(array() as array<string>)"))
    times = own.select("claim_id", F.concat(stated, resolved).alias("v"), open_.alias("o")).groupBy("claim_id").agg(F.flatten(F.collect_list("v")).alias("v"), F.flatten(F.collect_list("o")).alias("o"))
    none = F.expr("cast(array() as array<string>)")
    joined = base.join(fresh, "claim_id", "left").join(times, "claim_id", "left")
    mine = F.transform("terms", lambda t: trust.resolve_relative(t, F.col("reference")))
    told_time = entailment.relative_time_check(F.coalesce(mine, none), F.col("terms"), F.col("reference"), F.coalesce("v", none), F.coalesce("o", none))
    state = joined.withColumn("relative_time", told_time.getField("status"))
    for check in ("freshness", "relative_time"):
        state = state.withColumn("effective_status", trust.effective_status(F.col("effective_status"), F.col(check)))
    risk = F.col("risk")
    ready = state.withColumns({
        "high": F.coalesce(risk["risk_level"] == "high", F.lit(False)), "decisive": F.lit(True), "allow_unknown": F.lit(False),
        "need_evidence": F.coalesce(risk["min_evidence"], F.lit(1)), "need_sources": F.coalesce(risk["min_sources"], F.lit(1)),
    })
    judged = entailment.risk_checks(ready, told.select("answer_id", "evidence_id", "source").distinct())
    return judged.select(*claims.columns, "freshness", "relative_time", "risk_status", "risk_reasons")


def finalize(answers: DataFrame, evidence: DataFrame, findings: DataFrame | None = None, questions: DataFrame | None = None, least_confidence: float = 0.0) -> DataFrame:
    """Answers as they may be delivered: ``answer_id, original_state, action, answer, state``.

    With ``questions(answer_id, question, reference)`` claims are held against freshness, relative times and the
    requirements of risky questions in both passes (``checked``), and each answer has its report: ``trust_status,
    verification_level, limitations``.

    First pass: claims are assessed against ``evidence(answer_id, evidence_id[, text])`` and a checker's ``findings``
    (``answer_id, claim_index, verdict, confidence``), and the policy decides on the state. Second pass: the text that the
    policy leaves is cut into claims and assessed anew, with the findings of the first pass carried over to equal claims;
    ``state`` is that of the delivered text. An answer without claims is refused; null answers are empty.
    """
    ship_package(answers.sparkSession)

    def states(claims: DataFrame) -> DataFrame:
        return grounding.grounding_state(claims.select("answer_id", F.col("effective_status").alias("status"))).select("answer_id", "state")

    told = entailment.entail(assess(answers, evidence), findings, least_confidence)
    first = _kept(told if questions is None else checked(told, evidence, questions), "assessed")
    joined = answers.select("answer_id", F.col("answer").alias("original")).join(states(first), "answer_id", "left").join(trust.rewrite_answer(first.drop("status").withColumnRenamed("effective_status", "status"), REFUSAL), "answer_id", "left")
    state = F.coalesce("state", F.lit("insufficient_evidence"))
    action = trust.policy(state, F.lit(True))
    text = F.when(action.isin("allow", "disclose_conflict"), F.col("original")).when(action == "downgrade", F.col("answer")).otherwise(REFUSAL)
    given = _kept(joined.select("answer_id", state.alias("original_state"), action.alias("action"), text.alias("answer")), "delivered")
    second = entailment.propagate(assess(given, evidence), first)
    if questions is not None:
        second = checked(second, evidence, questions)
    final = given.join(states(second), "answer_id", "left").withColumn("state", F.coalesce("state", F.lit("insufficient_evidence")))
    if questions is None:
        return final
    report = entailment.trust_report(first.select("answer_id", "method", "entailment", "relative_time", "freshness"), final.select("answer_id", "state", F.lit(True).alias("snapshot")))
    return final.join(report, "answer_id", "left")
