"""Named queries over planning, entailment and record operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.operators import entailment, planning, records
from lodeworks.plans.registry import register
from lodeworks.session import ship_package, table


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_ASKED = """CASE p_partkey % 6 WHEN 0 THEN '从' || p_brand || '到' || p_type || '的变化' WHEN 1 THEN '不能把' || p_brand || '直接当成' || p_type || '？' WHEN 2 THEN p_brand || '，是否意味着' || p_type
WHEN 3 THEN '如何' || p_brand || '与，' || p_name || '！之间' WHEN 4 THEN '从A到' || p_type || '的' ELSE p_name END"""


def _topics_sql() -> str:
    clean = f"trim(regexp_replace(trim(regexp_replace({{}}, {_quoted(planning.TOPIC_ENDS)}, '', 'g')), {_quoted(planning.TOPIC_LEADS)}, '', 'g'))"
    tries = []
    for pattern in planning.TOPICS:
        sides = [clean.format(f"regexp_extract(q, {_quoted(pattern)}, {i})") for i in (1, 2)]
        tries.append(f"WHEN length({sides[0]}) >= 2 AND length({sides[1]}) >= 2 THEN {sides[0]} || ' / ' || {sides[1]}")
    return f"SELECT p_partkey, CASE {' '.join(tries)} ELSE '' END AS topics FROM (SELECT p_partkey, {_ASKED} AS q FROM part)"


@register("question_topics", _topics_sql())
def question_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(planning.topics(F.expr(_ASKED)), " / ").alias("topics"))


_PLAN_ASKED = "'Compare ' || p_brand || ' and ' || p_name"
_PLAN_PROPOSED = "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ['zz qq'] WHEN 2 THEN [p_name, ' ' || p_name || ' ', 'zz qq', ''] ELSE [p_brand] END"


@register(
    "query_plans",
    f"""WITH q AS (SELECT p_partkey, {_PLAN_ASKED} AS q, p_name, p_brand, {_PLAN_PROPOSED} AS p FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'planner_failed' WHEN p_partkey % 4 = 1 THEN 'no_valid_subqueries' ELSE 'decomposed' END AS reason,
CASE p_partkey % 4 WHEN 2 THEN q || '|' || p_name WHEN 3 THEN q || '|' || p_brand ELSE q END AS queries FROM q""",
)
def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    proposed = F.when(k == 1, F.array(F.lit("zz qq"))).when(k == 2, F.array(F.col("p_name"), F.concat(F.lit(" "), "p_name", F.lit(" ")), F.lit("zz qq"), F.lit(""))).when(k == 3, F.array("p_brand"))
    plan = table(spark, sf_dir, "part").select("p_partkey", planning.query_plan(F.expr(_PLAN_ASKED), proposed).alias("p"))
    return plan.select("p_partkey", "p.reason", F.array_join("p.queries", "|").alias("queries"))


_TURNS = """SELECT conv_id, count(*) FILTER (WHERE role IN ('user', 'assistant') AND turn < last) AS n, trim(max(CASE WHEN turn = last THEN text END)) AS q, trim(max_by(text, CASE WHEN role = 'user' AND turn < last THEN turn END)) AS topic,
trim(max_by(text, CASE WHEN role = 'assistant' AND turn < last THEN turn END)) AS answer FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE last IS NOT NULL GROUP BY conv_id"""
_CASES = """SELECT conv_id, n, topic, answer, CASE WHEN conv_id % 7 = 5 THEN '换个问题 ' || q ELSE q END AS q, CASE WHEN conv_id % 7 IN (2, 3) THEN true WHEN conv_id % 7 <> 6 THEN false END AS depends,
CASE conv_id % 7 WHEN 0 THEN NULL WHEN 1 THEN q WHEN 2 THEN q || ' more' WHEN 3 THEN 'zzqqzz' WHEN 4 THEN 'other words' ELSE q END AS rewrite FROM ({})"""


@register(
    "contextual_queries",
    f"""WITH c AS ({_CASES.format(_TURNS.replace("max_by(text, CASE WHEN role = 'user' AND turn < last THEN turn END)", "arg_max(text, CASE WHEN role = 'user' AND turn < last THEN turn END)").replace("max_by(text, CASE WHEN role = 'assistant' AND turn < last THEN turn END)", "arg_max(text, CASE WHEN role = 'assistant' AND turn < last THEN turn END)"))}),
r AS (SELECT *, CASE WHEN n = 0 THEN 'no_history' WHEN conv_id % 7 = 5 THEN 'topic_switched' WHEN rewrite IS NULL THEN 'contextualizer_failed' WHEN depends IS NULL OR (NOT depends AND rewrite <> q) THEN 'invalid_output' WHEN depends AND rewrite = 'zzqqzz' THEN 'rewrite_drifted' WHEN depends THEN 'rewritten' ELSE 'standalone' END AS reason FROM c)
SELECT conv_id, reason, CASE WHEN reason = 'rewritten' THEN left(array_to_string(list_filter(CASE WHEN topic = q THEN [q] ELSE [topic, q] END, lambda x: x IS NOT NULL AND x <> ''), ' '), 4000) ELSE q END AS query,
CASE WHEN reason IN ('contextualizer_failed', 'invalid_output', 'rewrite_drifted') THEN 'unknown' WHEN reason = 'rewritten' THEN 'dependent' ELSE 'standalone' END AS status FROM r""",
)
def contextual_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "conversations").createOrReplaceTempView("lodeworks_turns")
    cases = spark.sql(_CASES.format(_TURNS.replace("conversations", "lodeworks_turns")))
    told = cases.select("conv_id", planning.contextual_query(F.col("q"), F.col("topic"), F.col("answer"), F.col("n"), F.col("depends"), F.col("rewrite")).alias("c"))
    return told.select("conv_id", "c.reason", "c.query", "c.status")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@register(
    "collection_routes",
    f"""WITH s AS (SELECT unnest({list(_SEGMENTS)}) AS name, unnest([0, 1, 2, 3, 4]) AS i), u AS (SELECT c_custkey AS request, list_sort(list(name)) AS names, coalesce(list_sort(list(name) FILTER (WHERE i = 2 OR name = 'BUILDING')), []) AS auto FROM customer, s WHERE (c_custkey + i) % 4 < c_custkey % 5 GROUP BY 1),
p AS (SELECT c_custkey AS request, CASE c_custkey % 3 WHEN 0 THEN ['GHOST'] ELSE list_distinct([c_mktsegment, 'GHOST']) END AS picks FROM customer),
j AS (SELECT request, picks, coalesce(names, []) AS names, coalesce(auto, []) AS auto FROM p LEFT JOIN u USING (request)), v AS (SELECT *, list_filter(picks, lambda x: list_contains(names, x)) AS valid FROM j),
c AS (SELECT *, list_concat(valid, list_filter(auto, lambda x: NOT list_contains(valid, x))) AS chosen FROM v)
SELECT request, array_to_string(CASE WHEN len(names) <= 1 THEN names WHEN len(chosen) > 0 THEN chosen ELSE [names[1]] END, ',') AS selected,
CASE WHEN len(names) = 0 THEN 'no_allowed_collections' WHEN len(names) = 1 THEN NULL WHEN len(chosen) = 0 THEN 'no_valid_collection_selected' WHEN len(valid) = 0 THEN 'automatic_collection_fallback' WHEN len(valid) < len(picks) THEN 'hallucinated_collections_filtered' END AS reason FROM c""",
)
def collection_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    names = spark.createDataFrame([(s, None if i == 2 else "described") for i, s in enumerate(_SEGMENTS)], "name string, description string")
    each = c.select(F.col("c_custkey").alias("request"), F.posexplode(F.array(*map(F.lit, _SEGMENTS))).alias("i", "name"))
    allowed = each.where((F.col("request") + F.col("i")) % 4 < F.col("request") % 5).select("request", "name")
    picks = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("GHOST"))).otherwise(F.array("c_mktsegment", F.lit("GHOST")))
    out = planning.route_collections(c.select(F.col("c_custkey").alias("request"), picks.alias("picks")), names, allowed, "BUILDING")
    return out.select("request", F.array_join("selected", ",").alias("selected"), "reason")


@register(
    "validated_lists",
    """WITH w AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), ['', p_brand, string_split(p_name, ' ')[1]]) AS v, p_brand FROM part), f AS (SELECT p_partkey, list_filter(v, lambda x, i: x <> '' AND x <> p_brand AND list_position(v, x) = i) AS ok, v FROM w)
SELECT p_partkey, array_to_string(ok[1:2], '|') AS kept, CAST(len(v) - len(ok[1:2]) AS INTEGER) AS rejected FROM f""",
)
def validated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    values = F.concat(words, F.array(F.lit(""), F.col("p_brand"), words[0]))
    told = table(spark, sf_dir, "part").select("p_partkey", planning.valid_strings(values, 2, excluded=F.array("p_brand")).alias("v"))
    return told.select("p_partkey", F.array_join("v.kept", "|").alias("kept"), F.size("v.rejected").alias("rejected"))


@register(
    "agent_routes",
    """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ' ' || (o_orderkey % 7) || ' ' WHEN 1 THEN 'agent ' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END AS s, o_orderstatus = 'P' AS web FROM orders), n AS (SELECT *, CASE WHEN regexp_matches(trim(s), '^[0-9]+$') THEN CAST(trim(s) AS BIGINT) - 1 END AS i FROM r)
SELECT o_orderkey, CASE WHEN web THEN 2 WHEN i BETWEEN 0 AND 3 THEN CAST(i AS INTEGER) ELSE 1 END AS agent, CASE WHEN web THEN 'web_search_requested' WHEN i IS NULL THEN 'invalid_index_format' WHEN i NOT BETWEEN 0 AND 3 THEN 'index_out_of_range' END AS reason FROM n""",
)
def agent_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, F.concat(F.lit(" "), (k % 7).cast("string"), F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("agent "), k.cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    mode = F.when(F.col("o_orderstatus") == "P", "web").otherwise("knowledge")
    told = table(spark, sf_dir, "orders").select("o_orderkey", planning.route_agent(mode, said, (False, False, True, False), 1).alias("a"))
    return told.select("o_orderkey", F.col("a.index").alias("agent"), "a.reason")


@register(
    "followup_guard",
    """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'So, what now?' ELSE text END AS q FROM conversations), k AS (SELECT *, regexp_replace(lower(coalesce(q, '')), '[^\\pL\\pN]', '', 'g') AS core FROM c)
SELECT conv_id, turn, CASE WHEN core = '' THEN 'empty_followup_query' WHEN length(trim(q)) > 120 THEN 'followup_query_too_long' WHEN row_number() OVER (PARTITION BY conv_id, core ORDER BY turn) > 1 THEN 'duplicate_followup_query' END AS reason FROM k""",
)
def followup_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    q = F.when(F.col("turn") % 3 == 2, "So, what now?").otherwise(F.col("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", q.alias("q")).withColumn("core", planning.comparable("q"))
    # a question that came before is the same core at an earlier place; no turn gathers those before it
    again = F.row_number().over(Window.partitionBy("conv_id", "core").orderBy("turn")) > 1
    return turns.withColumn("earlier", F.when(again, F.array("core"))).select("conv_id", "turn", planning.followup_reason(F.col("q"), F.col("core"), F.col("earlier"), 120).alias("reason"))


@register("comprehensive_flags", f"SELECT conv_id, turn, {' OR '.join(f'''contains(lower(coalesce(text, '')), '{m}')''' for m in planning.COMPREHENSIVE)} AS comprehensive FROM conversations")
def comprehensive_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", planning.comprehensive(F.col("text")).alias("comprehensive"))


@register(
    "exact_entailment",
    """WITH l AS (SELECT item_id, text AS e, greatest(length(text) - 30, 1) AS n FROM benchmark), s AS (SELECT item_id, e, 10 AS a, CAST(10 + n // 2 AS INTEGER) AS b FROM l WHERE length(e) > 60), x AS (SELECT *, regexp_extract(substring(e, 1, a), '[^\\n。！？!?；;，,]*$') || substring(e, a + 1, b - a) || regexp_extract(substring(e, b + 1), '^[^\\n。！？!?；;，,]*') AS whole FROM s)
SELECT item_id, CASE WHEN item_id % 2 = 0 THEN true ELSE regexp_replace(lower(whole), '[^\\pL\\pN]', '', 'g') = regexp_replace(lower(substring(e, 12, b - 11)), '[^\\pL\\pN]', '', 'g') END AS exact FROM x""",
)
def exact_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").where(F.length("text") > 60).select("item_id", F.col("text").alias("e"), F.lit(10).alias("start"), F.expr("cast(10 + greatest(length(text) - 30, 1) div 2 as int)").alias("end"))
    # the claim is the clause itself in lower case, or a part of it
    clause = F.concat(F.regexp_extract(F.expr("substring(e, 1, start)"), f"[^{entailment.CLAUSE_END}]*$", 0), F.expr("substring(e, start + 1, end - start)"), F.regexp_extract(F.expr("substring(e, end + 1)"), f"^[^{entailment.CLAUSE_END}]*", 0))
    claim = F.when(F.col("item_id") % 2 == 0, F.concat(F.lower(clause), F.lit(" !"))).otherwise(F.expr("substring(e, start + 2, end - start - 1)"))
    return b.select("item_id", entailment.exact_clause(claim, F.col("e"), F.col("start"), F.col("end")).alias("exact"))


_STATUSES = ("supported", "conflicting", "unsupported", "invalid_citation")


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("claim_index")).agg(F.min("l_suppkey").alias("k"))
    status = F.element_at(F.array(*map(F.lit, _STATUSES)), (F.col("k") % 4 + 1).cast("int"))
    ids = F.when(F.col("k") % 5 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat(F.lit("E"), (F.col("k") % 3 + 1).cast("string")), F.lit("E1")))
    return li.select("answer_id", "claim_index", "k", status.alias("status"), F.when(status == "supported", "supported").otherwise(status).alias("effective_status"), F.array_distinct(ids).alias("evidence_ids"), (F.col("k") % 7 == 0).alias("exact"))


def _findings(claims: DataFrame) -> DataFrame:
    verdict = F.element_at(F.array(*map(F.lit, ("entailed", "contradicted", "unknown", "nonsense"))), (F.col("k") % 11 % 4 + 1).cast("int"))
    return claims.where("k % 6 <> 4").select("answer_id", "claim_index", verdict.alias("verdict"), F.when(F.col("k") % 13 == 0, 1.5).otherwise(0.8).alias("confidence"))


_ENTAIL = """l AS (SELECT l_orderkey AS answer_id, l_linenumber AS claim_index, min(l_suppkey) AS k FROM lineitem GROUP BY 1, 2), c AS (SELECT *, ['supported', 'conflicting', 'unsupported', 'invalid_citation'][CAST(k % 4 AS INTEGER) + 1] AS s FROM l),
e AS (SELECT *, CASE WHEN s IN ('unsupported', 'invalid_citation') THEN 'ENTAILMENT_VALID_SUPPORTED_CITATION_REQUIRED' WHEN s = 'conflicting' THEN 'ENTAILMENT_CONFLICT_REQUIRES_DISCLOSURE' WHEN k % 7 = 0 THEN 'ENTAILMENT_EXACT_MATCH' WHEN k % 5 = 0 THEN 'ENTAILMENT_EVIDENCE_TEXT_MISSING'
WHEN k % 6 = 4 THEN 'ENTAILMENT_RESULT_MISSING' WHEN k % 11 % 4 > 1 OR k % 13 = 0 THEN 'ENTAILMENT_UNKNOWN' WHEN k % 11 % 4 = 0 THEN 'ENTAILMENT_ENTAILED' ELSE 'ENTAILMENT_CONTRADICTED' END AS reason FROM c),
t AS (SELECT *, CASE WHEN reason IN ('ENTAILMENT_EXACT_MATCH', 'ENTAILMENT_ENTAILED') THEN 'entailed' WHEN reason = 'ENTAILMENT_CONTRADICTED' THEN 'contradicted' WHEN reason IN ('ENTAILMENT_UNKNOWN', 'ENTAILMENT_RESULT_MISSING') THEN 'unknown' ELSE 'not_checked' END AS entailment FROM e),
x AS (SELECT *, CASE WHEN entailment = 'contradicted' THEN 'unsupported' ELSE s END AS eff FROM t)"""


@register("entailment_findings", f"WITH {_ENTAIL} SELECT answer_id, claim_index, entailment, reason, eff AS effective_status FROM x")
def entailment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _assessed(spark, sf_dir)
    return entailment.entail(claims, _findings(claims)).select("answer_id", "claim_index", "entailment", "reason", "effective_status")


@register("entailment_batch", f"WITH {_ENTAIL} SELECT answer_id, claim_index FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY claim_index) AS n FROM c WHERE s = 'supported' AND k % 7 <> 0 AND k % 5 <> 0) WHERE n <= 1")
def entailment_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entailment.to_check(_assessed(spark, sf_dir), 1).select("answer_id", "claim_index")


@register(
    "entailment_propagation",
    f"WITH {_ENTAIL}, o AS (SELECT answer_id, 'claim ' || k AS txt, arg_max(entailment, claim_index) AS entailment FROM x GROUP BY 1, 2) SELECT x.answer_id, x.claim_index, CASE WHEN claim_index % 3 = 0 THEN 'not_checked' ELSE o.entailment END AS entailment FROM x JOIN o ON x.answer_id = o.answer_id AND 'claim ' || x.k = o.txt",
)
def entailment_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _assessed(spark, sf_dir)
    text = F.concat(F.lit("claim "), F.col("k").cast("string"))
    done = entailment.entail(claims, _findings(claims)).withColumn("text", text)
    kept = claims.withColumn("text", F.when(F.col("claim_index") % 3 == 0, F.lit("reworded")).otherwise(text))
    return entailment.propagate(kept, done).select("answer_id", "claim_index", "entailment")


@register(
    "risk_requirements",
    f"""WITH {_ENTAIL}, n AS (SELECT *, CASE WHEN k % 5 = 0 THEN 0 WHEN k % 3 = 0 THEN 1 ELSE 2 END AS ev, CASE WHEN k % 5 = 0 THEN 0 WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 1 ELSE 2 END AS src, answer_id % 2 = 0 AS high FROM x)
SELECT answer_id, claim_index, CASE WHEN eff = 'conflicting' THEN 'conflict_disclosed' WHEN eff <> 'supported' THEN 'not_applicable' WHEN (high AND entailment NOT IN ('entailed', 'contradicted')) OR ev < CASE WHEN high THEN 2 ELSE 1 END OR src < CASE WHEN high THEN 2 ELSE 1 END THEN 'rejected' ELSE 'passed' END AS risk_status FROM n""",
)
def risk_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _assessed(spark, sf_dir)
    high = F.col("answer_id") % 2 == 0
    need = F.when(high, 2).otherwise(1)
    asked = entailment.entail(claims, _findings(claims)).withColumns({"high": high, "decisive": F.lit(True), "allow_unknown": F.lit(False), "need_evidence": need, "need_sources": need})
    # E1 and E2 are of one document, E3 is known by its address
    ids = claims.select("answer_id").distinct().withColumn("evidence_id", F.explode(F.array(*map(F.lit, ("E1", "E2", "E3")))))
    fields = {"source_url": F.when(F.col("evidence_id") == "E3", "https://a.example/x"), "document_id": F.lit("d1"), "evidence_id": F.col("evidence_id")}
    return entailment.risk_checks(asked, ids.withColumn("source", entailment.source_name(fields))).select("answer_id", "claim_index", "risk_status")


@register(
    "relative_time_checks",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'RELATIVE_TIME_REFERENCE_MISSING' WHEN user_id % 3 = 0 THEN 'RELATIVE_TIME_VALUES_MATCH' WHEN user_id % 3 = 1 THEN 'RELATIVE_TIME_EVIDENCE_ANCHOR_MISSING' ELSE 'RELATIVE_TIME_NOT_IN_EVIDENCE' END AS reason FROM events""",
)
def relative_time_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.operators.trust import containing_values, resolve_relative

    day, k = F.col("ts").cast("date"), F.col("user_id") % 3
    terms = F.when(F.col("event_id") % 4 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("day:-1"), F.lit("week:0")))
    reference = F.when(F.col("event_id") % 4 != 1, day)
    claimed = F.transform(terms, lambda t: resolve_relative(t, reference))
    none = F.expr("cast(array() as array<string>)")
    stated = F.when(k == 0, F.concat(containing_values(F.date_sub(day, 1)), containing_values(day))).otherwise(containing_values(F.date_sub(day, 40)))
    check = entailment.relative_time_check(claimed, terms, reference, stated, F.when(k == 1, F.array(F.lit("day:0"))).otherwise(none))
    return table(spark, sf_dir, "events").select("event_id", check["reason"].alias("reason"))


@register(
    "trust_reports",
    f"""WITH {_ENTAIL}, p AS (SELECT answer_id, count(*) FILTER (WHERE reason LIKE 'ENTAILMENT_%' AND entailment <> 'not_checked' AND reason <> 'ENTAILMENT_EXACT_MATCH') AS checked, count(*) FILTER (WHERE reason = 'ENTAILMENT_EXACT_MATCH') AS exact, count(*) FILTER (WHERE entailment = 'unknown') AS unknown, bool_or(k % 17 = 0) AS t, bool_or(k % 19 = 0) AS f FROM x GROUP BY answer_id)
SELECT answer_id, CASE WHEN answer_id % 3 = 0 THEN 'not_assessed' ELSE 'fully_grounded' END AS trust_status, CASE WHEN checked > 0 AND unknown > 0 THEN 'semantic_entailment_partial' WHEN checked > 0 THEN 'semantic_entailment' WHEN exact > 0 THEN 'exact_match_and_deterministic_consistency' ELSE 'deterministic_consistency' END AS verification_level,
concat_ws(',', CASE WHEN f THEN 'FRESHNESS_VERIFICATION_INCOMPLETE' END, CASE WHEN t THEN 'RELATIVE_TIME_VERIFICATION_INCOMPLETE' END, CASE WHEN checked = 0 THEN 'SEMANTIC_ENTAILMENT_NOT_CHECKED' WHEN unknown > 0 THEN 'SEMANTIC_ENTAILMENT_INCOMPLETE' END, 'OPEN_ENDED_SEMANTIC_CONSISTENCY_NOT_CHECKED', 'SAFETY_NOT_EVALUATED') AS limitations FROM p""",
)
def trust_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _assessed(spark, sf_dir)
    told = entailment.entail(claims, _findings(claims))
    checks = told.withColumns({"relative_time": F.when(F.col("k") % 17 == 0, "unknown").otherwise("consistent"), "freshness": F.when(F.col("k") % 19 == 0, "unknown")})
    states = claims.select("answer_id").distinct().select("answer_id", F.lit("fully_grounded").alias("state"), (F.col("answer_id") % 3 != 0).alias("snapshot"))
    return entailment.trust_report(checks, states).select("answer_id", "trust_status", "verification_level", F.array_join("limitations", ",").alias("limitations"))


@register("queue_heads", "SELECT o_orderpriority AS queue, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') WHERE n = 1")
def queue_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "queue")
    return records.queue_heads(o, "queue", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "O").select("queue", "o_orderkey")


@register(
    "lease_updates",
    """WITH w AS (SELECT o_custkey, min(o_orderkey) AS ask FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 5) HOUR END AS lease, -1 AS holder FROM customer)
SELECT c_custkey, CASE WHEN ok THEN ask ELSE -1 END AS holder, CASE WHEN ok THEN TIMESTAMP '2024-01-01 02:10:00' ELSE lease END AS lease, ok AS taken FROM (SELECT r.*, ask, ask IS NOT NULL AND (lease IS NULL OR lease <= TIMESTAMP '2024-01-01 02:00:00') AS ok FROM r LEFT JOIN w ON c_custkey = o_custkey)""",
)
def lease_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, start + F.make_dt_interval(hours=(F.col("c_custkey") % 5).cast("int"))).alias("lease"), F.lit(-1).cast("long").alias("holder"))
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("holder"))
    return records.acquire(rows, wanted, "c_custkey", F.lit("2024-01-01 02:00:00").cast("timestamp_ntz"), 600).select("c_custkey", "holder", "lease", "taken")


@register("live_sessions", "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND ts < TIMESTAMP '2024-01-15')")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.without(table(spark, sf_dir, "events"), (F.col("event_type") == "error") & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))).select("event_id")


@register("next_attempts", "SELECT c_custkey, coalesce(max(o_orderkey % 9), 0) + 1 AS next_attempt FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def next_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 9).alias("attempt"))
    return records.next_attempts(table(spark, sf_dir, "customer").select("c_custkey"), tries, "c_custkey").select("c_custkey", "next_attempt")


@register("busy_guard", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS busy FROM customer")
def busy_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"))
    return records.busy(table(spark, sf_dir, "customer").select("c_custkey"), docs, "c_custkey", ("P",)).select("c_custkey", "busy")


@register("tenancy_guard", 'SELECT c_custkey AS "user", c_custkey * 7 % 1200 AS base, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey * 7 % 1200 AND s_nationkey = c_nationkey) AS found FROM customer')
def tenancy_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    bases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("base"), F.col("s_nationkey").alias("workspace"))
    members = c.select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("workspace"))
    asked = c.select(F.col("c_custkey").alias("user"), (F.col("c_custkey") * 7 % 1200).alias("base"))
    return records.guarded(asked, bases, members).select("user", "base", "found")


@register("refusals", f"SELECT conv_id, turn, {' OR '.join(f'''contains(lower(coalesce(text, '')), '{m}')''' for m in records.REFUSALS)} AS refusal FROM conversations")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", records.refusal(F.col("text")).alias("refusal"))


@register(
    "citation_scores",
    """WITH c AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 10 AS i FROM lineitem WHERE l_linenumber % 2 = 1), g AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 10 AS i FROM lineitem WHERE l_linenumber < 4), f AS (SELECT coalesce(c.k, g.k) AS k, c.i AS ci, g.i AS gi FROM c FULL JOIN g ON c.k = g.k AND c.i = g.i)
SELECT k AS answer_id, count(*) FILTER (WHERE ci = gi) / nullif(count(ci), 0) AS precision, count(*) FILTER (WHERE ci = gi) / nullif(count(gi), 0) AS recall FROM f GROUP BY k""",
)
def citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "answer_id")
    cited = li.where("l_linenumber % 2 = 1").select("answer_id", (F.col("l_suppkey") % 10).alias("item"))
    return records.citation_scores(cited, li.where("l_linenumber < 4").select("answer_id", (F.col("l_partkey") % 10).alias("item")), "answer_id", "item")


@register("claim_rates", f"WITH {_ENTAIL} SELECT answer_id, count(*) AS claims, count(*) FILTER (WHERE eff = 'supported') / count(*) AS supported_rate, count(*) FILTER (WHERE eff = 'unsupported') / count(*) AS unsupported_rate, count(*) FILTER (WHERE eff = 'invalid_citation') / count(*) AS invalid_citation_rate FROM x GROUP BY answer_id")
def claim_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _assessed(spark, sf_dir)
    return records.claim_rates(entailment.entail(claims, _findings(claims)), "answer_id", "effective_status", ("supported", "unsupported", "invalid_citation"))


@register(
    "title_recall",
    """WITH g AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 10 AS i FROM lineitem), r AS (SELECT l_orderkey AS k, l_suppkey % 10 AS i, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2)
SELECT g.k AS answer_id, count(*) FILTER (WHERE rank <= 2) / count(*) AS recall_2, count(*) FILTER (WHERE rank <= 5) / count(*) AS recall_5 FROM g LEFT JOIN r ON g.k = r.k AND g.i = r.i GROUP BY g.k""",
)
def title_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "answer_id")
    ranked = li.select("answer_id", (F.col("l_suppkey") % 10).alias("title"), F.col("l_linenumber").alias("rank"))
    return records.recall_at(ranked, li.select("answer_id", (F.col("l_partkey") % 10).alias("title")), "answer_id", "title", (2, 5))
