"""Named queries over grounding, trust, provenance, incremental and stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.operators import grounding, provenance, trust
from lodeworks.operators.text import bigrams, letters_and_digits
from lodeworks.plans.registry import register
from lodeworks.session import settle, ship_package, table, work_folder
from lodeworks.streaming import incremental, state

# answers are conversation turns of the assistant with markers put in by rule, evidence is what their number allows
_ANSWER = "CASE turn % 4 WHEN 1 THEN 'First claim stands here [E1]. Second one too [E2].' WHEN 3 THEN 'They differ [CONFLICT:E1,E2].' ELSE 'Nothing cited. Wrong one [E9].' END"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.expr(_ANSWER).alias("answer"))


def _evidence(answers: DataFrame) -> DataFrame:
    many = F.when(F.col("answer_id") % 5 == 0, F.array(F.lit("E1"))).otherwise(F.array(F.lit("E1"), F.lit("E2"), F.lit("E3")))
    return answers.select("answer_id", F.explode(many).alias("evidence_id"))


_CL = f"""a AS (SELECT conv_id * 1000 + turn AS answer_id, {_ANSWER} AS answer FROM conversations WHERE role = 'assistant'), c AS (SELECT answer_id, unnest(string_split_regex(answer, '\\.\\s+')) AS u FROM a),
k AS (SELECT answer_id, u, contains(u, 'CONFLICT') AS conflict, list_distinct(list_concat(regexp_extract_all(u, '\\[(E[0-9]+)\\]', 1), string_split(nullif(regexp_extract(u, 'CONFLICT:([E0-9,]+)', 1), ''), ','))) AS ids,
CASE WHEN answer_id % 5 = 0 THEN ['E1'] ELSE ['E1', 'E2', 'E3'] END AS known FROM c),
s AS (SELECT answer_id, u, CASE WHEN len(list_filter(coalesce(ids, []), lambda x: NOT list_contains(known, x))) > 0 THEN 'invalid_citation' WHEN conflict THEN 'conflicting' WHEN len(coalesce(ids, [])) > 0 THEN 'supported' ELSE 'unsupported' END AS status FROM k)"""


@register("claim_statuses", f"WITH {_CL} SELECT answer_id, status, count(*) AS n FROM s GROUP BY answer_id, status")
def claim_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    answers = _answers(spark, sf_dir)
    return grounding.claim_status(grounding.claims(answers), _evidence(answers)).groupBy("answer_id", "status").agg(F.count("*").alias("n"))


@register(
    "grounding_state_rollup",
    f"""WITH {_CL}, g AS (SELECT answer_id, count(*) AS claims, count(*) FILTER (WHERE status IN ('supported', 'conflicting')) AS supported, bool_or(status = 'conflicting') AS conflict FROM s GROUP BY answer_id)
SELECT answer_id, claims, supported, CASE WHEN conflict THEN 'conflicting_evidence' WHEN supported = claims THEN 'fully_grounded' WHEN supported > 0 THEN 'partially_grounded' ELSE 'insufficient_evidence' END AS state FROM g""",
)
def grounding_state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    answers = _answers(spark, sf_dir)
    return grounding.grounding_state(grounding.claim_status(grounding.claims(answers), _evidence(answers)))


@register(
    "answer_policy",
    f"""WITH {_CL}, g AS (SELECT answer_id, count(*) AS claims, count(*) FILTER (WHERE status IN ('supported', 'conflicting')) AS supported, bool_or(status = 'conflicting') AS conflict FROM s GROUP BY answer_id)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN answer_id % 7 = 0 THEN 'observe' WHEN conflict THEN 'disclose_conflict' WHEN supported = claims THEN 'allow' WHEN supported > 0 THEN 'downgrade' ELSE 'refuse' END AS action FROM g) GROUP BY action""",
)
def answer_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = grounding_state_rollup(spark, sf_dir)
    return rolled.groupBy(trust.policy(F.col("state"), F.col("answer_id") % 7 != 0).alias("action")).agg(F.count("*").alias("n"))


@register("claim_units")
def claim_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return grounding.claims(t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.col("text").alias("answer")))


_GRAM = "list_distinct(list_transform(range(1, length(x)), lambda i: substring(x, i, 2)))"


def _citing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents as evidence of one item each, all items in turn."""
    count = items.agg(F.count("*").alias("items"))  # one row
    return docs.crossJoin(F.broadcast(count)).select("doc_id", F.col("text").alias("evidence"), (F.col("doc_id") % F.col("items")).alias("item_id"))


@register(
    "citation_overlap",
    f"""WITH p AS (SELECT d.doc_id, b.item_id, regexp_replace(lower(b.text), '[^\\pL\\pN]', '', 'g') AS c, regexp_replace(lower(d.text), '[^\\pL\\pN]', '', 'g') AS e FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id WHERE d.text IS NOT NULL),
g AS (SELECT doc_id, item_id, list_distinct(list_transform(range(1, length(c)), lambda i: substring(c, i, 2))) AS cg, list_distinct(list_transform(range(1, length(e)), lambda i: substring(e, i, 2))) AS eg FROM p)
SELECT doc_id, item_id, round(len(list_intersect(cg, eg)) / len(cg), 6) AS score FROM g""",
)
def citation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    own = settle(b.select("item_id", bigrams(letters_and_digits(F.col("text"))).alias("own")), "claim-bigrams")  # once an item, not once a document
    d = _citing(table(spark, sf_dir, "documents").where("text is not null"), b)
    return d.join(own, "item_id").select("doc_id", "item_id", "own", letters_and_digits(F.col("evidence")).alias("e")).select("doc_id", "item_id", F.round(grounding.overlap_of(F.col("own"), F.col("e")), 6).alias("score"))


@register("citation_spans")
def citation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim"))
    d = _citing(table(spark, sf_dir, "documents"), b)
    return d.join(b, "item_id").select("doc_id", "item_id", grounding.citation_span(F.col("claim"), F.col("evidence")).alias("s")).select("doc_id", "item_id", "s.*")


@register(
    "citation_numbers",
    """WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) * 100000000 + l_suppkey AS pos FROM lineitem GROUP BY l_orderkey, l_suppkey), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS i FROM f) SELECT l_orderkey AS message_id, l_suppkey, CAST(i AS INTEGER) AS citation_index FROM n WHERE i <= 4""",
)
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("message_id"), "l_suppkey").agg((F.min("l_linenumber").cast("long") * 100_000_000 + F.col("l_suppkey")).alias("pos"))
    return grounding.citations(hits, ["l_suppkey"], 4).select("message_id", "l_suppkey", "citation_index")


@register(
    "value_set_checks",
    """WITH d AS (SELECT doc_id, 'release v' || (doc_id % 9) || '.' || (doc_id % 4) || ' and 2.0.' || (doc_id % 3) || ' by ' || source AS claim, 'we saw V' || (doc_id % 9) || '.' || (doc_id % 5) || ' or 2.0.1' AS evidence FROM documents),
v AS (SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(lower(claim), 'v([0-9]+\\.[0-9]+)', 1), regexp_extract_all(claim, ' ([0-9]+\\.[0-9]+\\.[0-9]+)', 1)))) AS c,
list_distinct(list_concat(regexp_extract_all(lower(evidence), 'v([0-9]+\\.[0-9]+)', 1), regexp_extract_all(evidence, ' ([0-9]+\\.[0-9]+\\.[0-9]+)', 1))) AS e FROM d)
SELECT doc_id, array_to_string(list_filter(c, lambda x: NOT list_contains(e, x)), ',') AS missing FROM v""",
)
def value_set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    s = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    claim = s("release v", i % 9, ".", i % 4, " and 2.0.", i % 3, " by ", F.col("source"))
    evidence = s("we saw V", i % 9, ".", i % 5, " or 2.0.1")
    missing = trust.missing_values(trust.versions_native(claim), trust.versions_native(evidence))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(missing, ",").alias("missing"))


@register("extracted_values")
def extracted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return table(spark, sf_dir, "documents").select("doc_id", trust.values(F.col("text")).alias("v")).select("doc_id", *(F.array_join(f"v.{k}", ",").alias(k) for k in ("dates", "versions", "quantities", "ranges")))


@register(
    "validity_asof",
    """WITH e AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS sup FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN eff IS NULL THEN 'validity_missing' WHEN eff > DATE '2023-01-01' THEN 'future' WHEN sup <= DATE '2023-01-01' THEN 'superseded' ELSE 'active' END AS state
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS eff, sup FROM orders LEFT JOIN e ON o_orderkey = l_orderkey)""",
)
def validity_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_shipdate").cast("date")).alias("sup"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate").cast("date")).alias("eff")).join(ends, "o_orderkey", "left")
    return o.select("o_orderkey", trust.temporal_state(F.col("eff"), F.col("sup"), F.lit("2023-01-01").cast("date")).alias("state"))


@register(
    "freshness_check",
    """WITH x AS (SELECT o_custkey AS claim_id, o_orderstatus AS family, CAST(o_orderdate AS DATE) AS eff, o_orderkey % 3 = 0 AS cited FROM orders), n AS (SELECT *, max(CASE WHEN eff <= DATE '2025-01-01' THEN eff END) OVER (PARTITION BY claim_id, family) AS newest FROM x),
p AS (SELECT claim_id, count(DISTINCT family) AS fams, bool_or(eff > DATE '2025-01-01') AS inactive, bool_or(eff = newest) AS has FROM n WHERE cited GROUP BY claim_id),
r AS (SELECT claim_id, CASE WHEN inactive THEN 'FRESHNESS_EVIDENCE_NOT_ACTIVE' WHEN fams > 1 THEN 'FRESHNESS_VERSION_FAMILY_AMBIGUOUS' WHEN NOT coalesce(has, false) THEN 'FRESHNESS_NEWER_EVIDENCE_AVAILABLE' END AS reason FROM p)
SELECT claim_id, CASE WHEN reason IS NULL THEN 'consistent' WHEN reason IN ('FRESHNESS_EVIDENCE_NOT_ACTIVE', 'FRESHNESS_NEWER_EVIDENCE_AVAILABLE') THEN 'inconsistent' ELSE 'unknown' END AS status, reason FROM r""",
)
def freshness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("date")
    ev = o.select(F.col("o_custkey").alias("claim_id"), F.col("o_orderstatus").alias("family"), F.col("o_orderdate").cast("date").alias("effective"), none.alias("superseded"), none.alias("published"), (F.col("o_orderkey") % 3 == 0).alias("cited"), F.lit(False).alias("web"))
    return trust.freshness(ev, F.lit("latest_effective"), F.lit("2025-01-01").cast("date"))


@register(
    "relative_time_values",
    """SELECT event_id, strftime(CAST(ts AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') AS yesterday, strftime(CAST(ts AS DATE) + INTERVAL 7 DAY, '%G-W%V') AS next_week, strftime(date_trunc('month', ts) - INTERVAL 1 MONTH, '%Y-%m') AS last_month,
year(date_trunc('month', ts) - INTERVAL 3 MONTH) || '-Q' || quarter(date_trunc('month', ts) - INTERVAL 3 MONTH) AS last_quarter, CAST(year(ts) + 1 AS VARCHAR) AS next_year FROM events""",
)
def relative_time_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("ts").cast("date")
    at = lambda t, name: trust.resolve_relative(F.lit(t), day).alias(name)
    return table(spark, sf_dir, "events").select("event_id", at("day:-1", "yesterday"), at("week:1", "next_week"), at("month:-1", "last_month"), at("quarter:-1", "last_quarter"), at("year:1", "next_year"))


@register("relative_terms")
def relative_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    stated = F.element_at(F.array(*map(F.lit, ("见 the day before yesterday", "今年上周", "next quarter and last month", "nothing"))), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(trust.relative_terms(stated), ",").alias("terms"))


@register(
    "negation_polarity",
    """WITH c AS (SELECT conv_id AS claim_id, turn, 'the server accepts uploads of kind ' || (conv_id % 5) AS a, CASE WHEN turn % 2 = 0 THEN '不' ELSE '' END || 'the server accepts uploads of kind ' || (conv_id % 3) AS b FROM conversations)
SELECT claim_id, bool_or(contains(b, '不')) AS conflict FROM c WHERE contains(replace(b, '不', ''), a) OR contains(a, replace(b, '不', '')) GROUP BY claim_id""",
)
def negation_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    stem = F.lit("the server accepts uploads of kind ")
    claim = t.select(F.col("conv_id").alias("claim_id"), trust.polarity(F.concat(stem, (F.col("conv_id") % 5).cast("string"))).alias("p")).select("claim_id", "p.*").distinct()
    theirs = t.select(F.col("conv_id").alias("claim_id"), trust.polarity(F.concat(F.when(F.col("turn") % 2 == 0, "不").otherwise(""), stem, (F.col("conv_id") % 3).cast("string"))).alias("p")).select("claim_id", "p.*").distinct()
    return trust.negation_conflicts(claim, theirs)


@register(
    "entity_mismatches",
    """WITH x AS (SELECT l_orderkey AS claim_id, CAST(l_linenumber AS VARCHAR) AS v, l_returnflag AS e, l_linestatus = 'O' AS mine FROM lineitem), c AS (SELECT * FROM x WHERE mine AND e <> 'N'), t AS (SELECT l_orderkey AS claim_id, CAST(l_linenumber AS VARCHAR) AS v, CASE l_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'R' ELSE '' END AS e FROM lineitem)
SELECT DISTINCT c.claim_id, c.v AS value FROM c WHERE EXISTS (SELECT 1 FROM t WHERE t.claim_id = c.claim_id AND t.v = c.v) AND NOT EXISTS (SELECT 1 FROM t WHERE t.claim_id = c.claim_id AND t.v = c.v AND (t.e = '' OR t.e = c.e))""",
)
def entity_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").cast("string").alias("value"), "l_returnflag", "l_linestatus", "l_suppkey")
    claims = li.where("l_linestatus = 'O'").select("claim_id", "value", F.when(F.col("l_returnflag") != "N", F.array("l_returnflag")).otherwise(F.array().cast("array<string>")).alias("entities"))
    k = F.col("l_suppkey") % 3
    theirs = li.select("claim_id", "value", F.when(k == 0, F.array(F.lit("A"))).when(k == 1, F.array(F.lit("R"))).otherwise(F.array().cast("array<string>")).alias("entities"))
    return trust.entity_mismatches(claims, theirs)


@register(
    "effective_claim_status",
    """SELECT event_id, CASE WHEN s IN ('supported', 'conflicting') AND c IN ('inconsistent', 'unknown') THEN 'unsupported' ELSE s END AS status FROM (SELECT event_id, list_extract(['supported', 'conflicting', 'unsupported', 'invalid_citation'], CAST(event_id % 4 AS INTEGER) + 1) AS s, list_extract(['consistent', 'inconsistent', 'unknown', 'not_applicable', 'not_checked'], CAST(user_id % 5 AS INTEGER) + 1) AS c FROM events)""",
)
def effective_claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))
    s = pick(("supported", "conflicting", "unsupported", "invalid_citation"), F.col("event_id"))
    c = pick(("consistent", "inconsistent", "unknown", "not_applicable", "not_checked"), F.col("user_id"))
    return table(spark, sf_dir, "events").select("event_id", trust.effective_status(s, c).alias("status"))


@register("condition_checks")
def condition_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (c % len(xs) + 1).cast("int"))
    claim = pick(("只有管理员才能删除文档", "只有管理员或所有者才能删除文档", "普通文本"), F.col("turn"))
    evidence = pick(("只有管理员才能删除文档", "只有管理员和所有者才能删除文档"), F.col("conv_id"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", trust.condition_check(claim, evidence).alias("status"))


@register("strict_dates", "SELECT event_id, try_strptime(d, '%Y-%m-%d')::DATE AS day FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 1 THEN '2024-02-30' ELSE '2024/01/01' END AS d FROM events)")
def strict_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, "2024-02-30").otherwise("2024/01/01")
    return table(spark, sf_dir, "events").select("event_id", trust.strict_date(d).alias("day"))


@register("content_fingerprint", "SELECT doc_id, 'sha256:' || sha256(text) AS fingerprint FROM documents WHERE text IS NOT NULL")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", provenance.digest(F.col("text")).alias("fingerprint"))


_PART = "('0x' || substring(h, {a}, 15))::UBIGINT::HUGEINT"


@register(
    "manifest_version",
    f"""WITH d AS (SELECT source, sha256(coalesce(text, '')) AS h FROM documents), s AS (SELECT source, count(*) AS n, sum({_PART.format(a=1)}) AS a, sum({_PART.format(a=16)}) AS b, sum({_PART.format(a=31)}) AS c FROM d GROUP BY source)
SELECT source, n, sha256(concat_ws('|', n::VARCHAR, a::HUGEINT::VARCHAR, b::HUGEINT::VARCHAR, c::HUGEINT::VARCHAR)) AS version FROM s""",
)
def manifest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.manifest_version(table(spark, sf_dir, "documents"), "source", "text")


@register(
    "evidence_identity",
    """WITH h AS (SELECT source, doc_id, text, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos FROM documents), k AS (SELECT lang, pos, concat_ws('|', sha256(coalesce(text, '')), source, CAST(doc_id AS VARCHAR)) AS item FROM h WHERE pos <= 25)
SELECT lang AS qid, CAST(least(count(*), 20) AS BIGINT) AS n, CASE WHEN count(*) <= 20 THEN 'complete' ELSE 'partial' END AS status, sha256(string_agg(item, chr(10) ORDER BY pos) FILTER (WHERE pos <= 20)) AS digest FROM k GROUP BY lang""",
)
def evidence_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy("doc_id")
    hits = table(spark, sf_dir, "documents").withColumn("pos", F.row_number().over(w)).where("pos <= 25")
    return provenance.evidence_identity(hits.select(F.col("lang").alias("qid"), "pos", "text", "source", F.col("doc_id").cast("string").alias("locator")))


@register("audit_diff")
def audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("props").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("event_id", F.explode(provenance.audit_diff(F.col("before"), F.col("props"))).alias("d")).select("event_id", "d.*")


@register("usage_rollup", "SELECT event_type AS stage, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS user_id FROM events GROUP BY event_type")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.usage_rollup(table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), "stage", ["user_id"])


@register("budget_admission")
def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.length("text").cast("long").alias("cost"))
    return provenance.budget_admission(t, 4, 3000)


_SNAPSHOTS = """o AS (SELECT doc_id AS id, n_chars AS size, doc_id % 17 AS mtime, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 5 = 0 THEN 99 ELSE doc_id % 17 END AS mtime, md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    old = d.where("doc_id % 10 <> 3").select(i.alias("id"), F.col("n_chars").alias("size"), (i % 17).alias("mtime"), F.md5("text").alias("content_hash"))
    text = F.when(i % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    new = d.where("doc_id % 10 <> 4").select(i.alias("id"), F.when(i % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), F.when(i % 5 == 0, 99).otherwise(i % 17).alias("mtime"), F.md5(text).alias("content_hash"))
    return old, new


@register(
    "change_detection",
    f"""WITH {_SNAPSHOTS} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.h IS DISTINCT FROM n.h THEN 'modified' ELSE 'touched' END AS change FROM o FULL JOIN n ON o.id = n.id
WHERE o.id IS NULL OR n.id IS NULL OR o.size IS DISTINCT FROM n.size OR o.mtime IS DISTINCT FROM n.mtime""",
)
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changes(*_snapshots(spark, sf_dir))


@register("sync_cursor", f"WITH {_SNAPSHOTS} SELECT id, size FROM n UNION ALL SELECT id, size FROM o WHERE id NOT IN (SELECT id FROM n) AND id % 20 = 4")
def sync_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return incremental.next_cursor(old, new, old.where("id % 20 = 4")).select("id", "size")


@register("resume_pending", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "purchase", "succeeded").otherwise("failed").alias("status"))
    return incremental.pending(e.select("event_id"), e, ["event_id"])


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), t.alias("t"))


@register("rate_limit_replay")
def rate_limit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return state.rate_limit(_requests(spark, sf_dir), 2, 86_400)


@register("ingest_job_states")
def ingest_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    kind = F.element_at(F.array(*map(F.lit, ("claim", "fail", "claim", "succeed", "claim", "expire", "fatal"))), (F.col("event_id") % 7 + 1).cast("int"))
    return state.job_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), kind.alias("event")))


@register("circuit_breaker")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    e = table(spark, sf_dir, "events")
    return state.circuit_breaker(e.select((F.col("user_id") % 10).cast("string").alias("provider"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") != "error").alias("ok")), 2, 3600.0)


@register("fair_permits")
def fair_permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    e = table(spark, sf_dir, "events")
    return state.fair_permits(e.select((F.col("user_id") % 5).alias("pool"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), (F.col("value") * 100).alias("hold")), 3, 3600.0)


@register("event_sequence_gaps", "SELECT conv_id, before AS after_number, turn AS next_number FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE turn % 5 <> 2) WHERE before IS NOT NULL AND turn <> before + 1")
def event_sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.sequence_gaps(table(spark, sf_dir, "conversations").where("turn % 5 <> 2"), "conv_id", "turn")


@register(
    "envelope_status",
    """WITH p AS (SELECT conv_id AS request, count(*) AS n, count(DISTINCT turn) AS d, min(turn + 1) AS lo, max(turn + 1) AS hi, arg_max(role, turn) AS last, count(*) FILTER (WHERE role = 'assistant') AS ends FROM conversations GROUP BY conv_id)
SELECT request, CASE WHEN NOT (lo = 1 AND hi = n AND d = n) THEN 'gap' WHEN ends <> 1 OR last <> 'assistant' THEN 'open' ELSE 'complete' END AS status FROM p""",
)
def envelope_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return state.envelope_status(t.select(F.col("conv_id").alias("request"), F.lit(1).alias("version"), (F.col("turn") + 1).alias("sequence"), F.col("role").alias("event")), 1, ["assistant"])


@register("heartbeat_status", "SELECT user_id AS worker, arg_max(event_type <> 'error', CAST(epoch(ts) AS BIGINT)) AND epoch(TIMESTAMP '2024-01-31') - max(CAST(epoch(ts) AS BIGINT)) <= 43200 AS alive FROM (SELECT user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(epoch(ts) AS BIGINT) ORDER BY event_id) = 1) GROUP BY user_id")
def heartbeat_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    one = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "t").orderBy("event_id"))).where("n = 1")
    return state.heartbeat_status(one.select(F.col("user_id").alias("worker"), "t", (F.col("event_type") != "error").alias("running")), F.unix_timestamp(F.lit("2024-01-31 00:00:00")), 43_200)


@register("tumbling_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.tumbling_counts(table(spark, sf_dir, "events"), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@register(
    "session_activity",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sessions(table(spark, sf_dir, "events"), "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register(
    "summary_window",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conv_id) AS t FROM conversations) WHERE t >= 6 AND b > 3",
)
def summary_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.summary_window(table(spark, sf_dir, "conversations"), 6, 3).select("conv_id", "turn")


@register("html_documents")
def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.sources.loaders import html_text

    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("page_content"))


@register(
    "container_families",
    "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' WHEN page_id % 4 = 1 THEN 'zip' ELSE 'text' END AS family FROM pages",
)
def container_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.sources.loaders import container_family

    i = F.col("page_id") % 4
    content = F.when(i == 0, F.concat(F.lit("%PDF-1.7 "), "html")).when(i == 1, F.concat(F.lit("PK\x03\x04"), "html")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", container_family(content.cast("binary")).alias("family"))


def _streamed(spark: SparkSession, sf_dir: str, build, mode: str, name: str) -> DataFrame:
    """Run a streaming twin to the end of what is there and return what it wrote: Parquet files, one folder per batch.

    In complete mode the last batch holds everything.
    """
    import uuid

    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    folder = f"{work_folder(spark)}/lodeworks/{name}-{uuid.uuid4().hex}"
    result = build(source)
    batches: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        batches.append(number)

    result.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    wanted = sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(result.schema).parquet(*(f"{folder}/rows/{n}" for n in wanted)) if wanted else spark.createDataFrame([], result.schema)


@register("streaming_tumbling_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, sf_dir, lambda e: incremental.tumbling_counts(e, "1 day", late="1 day"), "complete", "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@register("streaming_rate_limit")
def streaming_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    build = lambda e: state.rate_limit_stream(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t")), 2, 86_400)
    return _streamed(spark, sf_dir, build, "append", "limited")
