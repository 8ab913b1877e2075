"""Evidence blocks, persisted claims, sections, leases, reranking and roll-ups over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import chunking, entailment, evaluation, fusion, grounding, health, provenance, records, relational
from lodeworks.plans.registry import register
from lodeworks.session import table
from lodeworks.streaming import incremental

_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@register(
    "rendered_evidence",
    f"""SELECT page_id, '<Evidence id="E' || page_id || '" url="' || {_ESC.format('url')} || '"' || CASE WHEN page_id % 2 = 0 THEN ' page="' || page_id % 7 || '"' ELSE '' END || '>' || chr(10) || {_ESC.format("coalesce(html, '')")} || chr(10) || '</Evidence>' AS block FROM pages WHERE url IS NOT NULL""",
)
def rendered_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where("url is not null")
    page = F.when(F.col("page_id") % 2 == 0, F.col("page_id") % 7)
    number = F.concat(F.lit('"E'), F.col("page_id").cast("string"), F.lit('"'))
    return p.select("page_id", grounding.render_evidence(number, F.coalesce("html", F.lit("")), {"url": F.col("url"), "page": page}).alias("block"))


@register(
    "claim_persistence",
    """WITH c AS (SELECT l_orderkey AS m, l_linenumber AS i, CASE l_linenumber % 3 WHEN 0 THEN 'conflicting' WHEN 1 THEN 'supported' ELSE 'unsupported' END AS s, list_distinct([min(l_suppkey) % 5, min(l_partkey) % 5]) AS e FROM lineitem GROUP BY ALL),
t AS (SELECT DISTINCT l_orderkey AS m, l_suppkey % 5 AS e FROM lineitem WHERE l_linenumber <= 3),
j AS (SELECT c.m, c.i, c.s, list_sort(list(DISTINCT t.e + 1) FILTER (t.e IS NOT NULL)) AS x FROM (SELECT m, i, s, unnest(e) AS e FROM c) c LEFT JOIN t ON t.m = c.m AND t.e = c.e GROUP BY c.m, c.i, c.s)
SELECT m AS message_id, i AS claim_index, CASE WHEN len(coalesce(x, [])) < CASE s WHEN 'conflicting' THEN 2 WHEN 'supported' THEN 1 ELSE 0 END THEN 'invalid_citation' ELSE s END AS status, array_to_string(coalesce(x, []), ',') AS citations FROM j""",
)
def claim_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    e = lambda c: (F.col(c) % 5).cast("long")
    status = F.when(F.col("l_linenumber") % 3 == 0, "conflicting").when(F.col("l_linenumber") % 3 == 1, "supported").otherwise("unsupported")
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    claims = one.select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("claim_index"), status.alias("status"), F.array_distinct(F.array(e("l_suppkey"), e("l_partkey"))).alias("evidence_ids"))
    cited = li.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("message_id"), e("l_suppkey").alias("evidence_id"), (e("l_suppkey") + 1).cast("int").alias("citation_index")).distinct()
    return grounding.claim_citations(claims, cited).select("message_id", "claim_index", "status", F.array_join(F.col("citation_indices").cast("array<string>"), ",").alias("citations"))


@register("name_repairs", "SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NOT NULL THEN p_name ELSE 'part ' || l_partkey END AS display_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) ON p_partkey = l_partkey")
def name_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("document_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("display_name"))
    present = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("display_name"))
    return grounding.repair_names(cited, present).select("l_orderkey", "l_linenumber", "display_name")


@register(
    "document_sections",
    """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, text, unnest([{'a': 0, 'b': n // 3, 't': 'head'}, {'a': n // 3, 'b': n // 3, 't': 'empty'}, {'a': n // 3, 'b': n, 't': 'rest'}]) AS s FROM d)
SELECT doc_id, s.t AS section_title, s.a AS char_start, sha256(trim(substring(text, s.a + 1, s.b - s.a))) AS chunk FROM s WHERE trim(substring(text, s.a + 1, s.b - s.a)) <> ''""",
)
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    span = lambda a, b, t: F.struct(a.alias("start"), b.alias("end"), F.lit(t).alias("title"), F.lit(t).alias("path"), F.lit(1).alias("level"))
    pages = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.lit(1).alias("page"), "text", F.array(span(F.lit(0), third, "head"), span(third, third, "empty"), span(third, n, "rest")).alias("spans"))
    return chunking.sections(pages).select("doc_id", "section_title", F.col("char_start").cast("long").alias("char_start"), F.sha2("chunk", 256).alias("chunk"))


@register(
    "lease_renewals",
    """WITH r AS (SELECT c_custkey AS k, 'w' || c_custkey % 4 AS holder, TIMESTAMP '2024-01-01 00:00:00' AS lease FROM customer), a AS (SELECT *, k % 3 = 0 AND holder = 'w1' AS renewed FROM r), b AS (SELECT k, holder, CASE WHEN renewed THEN TIMESTAMP '2024-01-01 02:10:00' ELSE lease END AS lease, renewed, k % 5 = 0 AND holder = 'w' || k % 2 AS released FROM a)
SELECT k AS c_custkey, CASE WHEN NOT released THEN holder END AS holder, CASE WHEN NOT released THEN lease END AS lease, renewed, released FROM b""",
)
def lease_renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("w"), (k % 4).cast("string")).alias("holder"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("lease"))
    asked = rows.where(k % 3 == 0).select("c_custkey", F.lit("w1").alias("holder"))
    left = rows.where(k % 5 == 0).select("c_custkey", F.concat(F.lit("w"), (k % 2).cast("string")).alias("holder"))
    after = records.renew(rows, asked, "c_custkey", F.lit("2024-01-01 02:00:00").cast("timestamp_ntz"), 600)
    return records.release(after, left, "c_custkey").select("c_custkey", "holder", "lease", "renewed", "released")


@register(
    "batch_rerank",
    """WITH c AS (SELECT o_custkey AS qid, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS at FROM orders), b AS (SELECT *, at // 4 AS batch, at % 4 AS i, count(*) OVER (PARTITION BY qid, at // 4) AS n FROM c),
k AS (SELECT *, CASE qid % 5 WHEN 0 THEN list_filter([2, 0, 2, 9], lambda x: x < n) WHEN 1 THEN [] WHEN 2 THEN range(0, n) WHEN 3 THEN range(0, n) ELSE list_filter([3, 1], lambda x: x < n) END AS f FROM b),
g AS (SELECT *, CASE WHEN len(f) = 0 AND qid % 5 = 4 THEN range(0, n) ELSE f END AS h FROM k)
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY batch, list_position(h, i)) AS INTEGER) AS place FROM g WHERE list_contains(h, i)""".replace(" AS at ", " AS pos0 ").replace("at // 4", "pos0 // 4").replace("at % 4", "pos0 % 4"),
)
def batch_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer in batches of four, with five kinds of answers: some wrong indices, none, broken, missing, perhaps all wrong."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), (-F.col("o_totalprice")).alias("pos"), F.col("o_orderkey").alias("id"))
    kind = F.col("qid") % 5
    chosen = F.when(kind == 0, F.array(*map(F.lit, (2, 0, 2, 9)))).when(kind == 1, F.array().cast("array<int>")).when(kind == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(3), F.lit(1)))
    batches = orders.groupBy("qid").agg(F.count("*").alias("n")).where(kind != 3).select("qid", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 4).cast("int"))).alias("batch"))
    answers = batches.select("qid", "batch", chosen.alias("chosen"), (kind == 2).alias("broken"))
    return fusion.batch_rerank(orders, answers, 4).select("qid", "id", "place")


@register(
    "ranking_stability",
    """WITH r AS (SELECT o_custkey % 40 AS qid, CAST(o_orderkey % 3 AS INTEGER) AS rep, o_orderkey // 3 AS base FROM orders), k AS (SELECT qid, rep, list(base ORDER BY base) AS b FROM (SELECT DISTINCT qid, rep, CASE WHEN qid % 4 = 0 THEN base + rep % 2 ELSE qid END AS base FROM r) GROUP BY qid, rep),
f AS (SELECT qid, arg_min(b, rep) AS first FROM k GROUP BY qid) SELECT 'dense' AS mode, k.qid, round(avg(CASE WHEN b = first THEN 1.0 ELSE 0.0 END), 6) AS stability FROM k JOIN f ON k.qid = f.qid GROUP BY k.qid""",
)
def ranking_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, rep, base = F.col("o_custkey") % 40, (F.col("o_orderkey") % 3).cast("int"), F.floor(F.col("o_orderkey") / 3)
    runs = table(spark, sf_dir, "orders").select(F.lit("dense").alias("mode"), q.alias("qid"), rep.alias("rep"), F.when(q % 4 == 0, base + rep % 2).otherwise(q).alias("id")).distinct().withColumn("rank", F.col("id"))
    return evaluation.rank_stability(runs).select("mode", "qid", F.round("stability", 6).alias("stability"))


@register(
    "confusion_summary",
    """WITH r AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS e, CASE WHEN l_partkey % 4 = 0 THEN 'a' WHEN l_suppkey % 5 = 0 THEN 'c' WHEN l_linenumber % 3 = 0 THEN 'a' WHEN l_linenumber % 3 = 1 THEN 'b' ELSE 'c' END AS p FROM lineitem),
l AS (SELECT x, count(*) FILTER (WHERE e = x AND p = x) AS tp, count(*) FILTER (WHERE e <> x AND p = x) AS fp, count(*) FILTER (WHERE e = x AND p <> x) AS fn FROM r CROSS JOIN (SELECT unnest(['a', 'b', 'c']) AS x) GROUP BY x)
SELECT (SELECT count(*) FROM r) AS n, round((SELECT avg(CASE WHEN e = p THEN 1.0 ELSE 0.0 END) FROM r), 6) AS accuracy, round(avg(round(tp / (tp + fp), 6)), 6) AS macro_precision, round(avg(round(tp / (tp + fn), 6)), 6) AS macro_recall, round(avg(round(2 * tp / (2 * tp + fp + fn), 6)), 6) AS macro_f1 FROM l""",
)
def confusion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    e = F.when(n == 0, "a").when(n == 1, "b").otherwise("c")
    p = F.when(F.col("l_partkey") % 4 == 0, "a").when(F.col("l_suppkey") % 5 == 0, "c").otherwise(e)
    return evaluation.confusion_summary(table(spark, sf_dir, "lineitem").select(e.alias("expected"), p.alias("predicted")), ["a", "b", "c"])


@register(
    "health_deductions",
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN n = 0 THEN 'NO_ORDERS' END, CASE WHEN o > 1 THEN 'OPEN_ORDERS' END, CASE WHEN c_acctbal < 0 THEN 'NEGATIVE_BALANCE' END], lambda x: x IS NOT NULL), ',') AS codes
FROM (SELECT c_custkey, any_value(c_acctbal) AS c_acctbal, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)""",
)
def health_deductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(per, "c_custkey", "left").fillna(0, ["n", "o"])
    codes = health.deductions({"NO_ORDERS": (F.col("n") == 0, ""), "OPEN_ORDERS": (F.col("o") > 1, ""), "NEGATIVE_BALANCE": (F.col("c_acctbal") < 0, "")})
    return c.select("c_custkey", F.array_join(codes, ",").alias("codes"))


@register(
    "index_identities",
    """WITH s AS (SELECT DISTINCT source AS c, 'm' || length(source) AS m FROM documents WHERE source IS NOT NULL)
SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 'dynamic_unbound' WHEN count(*) > 32 THEN 'partial' ELSE 'complete' END AS status, sha256('[' || (SELECT string_agg('{"collection":"' || c || '","manifest":"' || m || '"}', ',' ORDER BY c) FROM (SELECT * FROM s ORDER BY c LIMIT 32)) || ']') AS digest FROM s""",
)
def index_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("collection"), F.concat(F.lit("m"), F.length("source").cast("string")).alias("manifest")).distinct()
    return provenance.index_identity(s)


@register("due_syncs", "SELECT c_custkey AS id, least(2 * pow(2.0, c_custkey % 7), 60.0) AS wait FROM customer WHERE c_custkey % 2 = 0 AND TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 30) DAY <= TIMESTAMP '2024-01-15'")
def due_syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(k % 30).cast("int"))
    syncs = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 2 == 0).alias("active"), at.alias("next_run"))
    return incremental.due(syncs, F.lit("2024-01-15").cast("timestamp_ntz")).select("id", relational.backoff(F.col("id") % 7 + 1).alias("wait"))


@register(
    "consistency_rollup",
    """WITH c AS (SELECT l_orderkey, list(CASE WHEN l_partkey % 11 = 0 THEN 'inconsistent' WHEN l_partkey % 7 = 0 THEN 'unknown' WHEN l_partkey % 2 = 0 THEN 'consistent' END) FILTER (l_partkey % 11 = 0 OR l_partkey % 7 = 0 OR l_partkey % 2 = 0) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN list_contains(s, 'inconsistent') THEN 'inconsistent' WHEN list_contains(s, 'unknown') THEN 'unknown' WHEN len(s) > 0 THEN 'consistent' ELSE 'not_applicable' END AS status FROM c""",
)
def consistency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    told = F.when(k % 11 == 0, "inconsistent").when(k % 7 == 0, "unknown").when(k % 2 == 0, "consistent")
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(told).alias("s"))  # three values at most
    return per.select("l_orderkey", entailment.consistency_status(F.col("s")).alias("status"))
