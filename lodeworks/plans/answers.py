"""Answers and what they rest on: definitions, conditions, literals, neighbours, gates, provenance, fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import ann, conditions, definitions, gates, literals, provenance, retrieval
from lodeworks.operators.text import anchor_terms
from lodeworks.plans.registry import register
from lodeworks.session import settle, ship_package, table
from lodeworks.streaming import routing

_REL = "(contains({0}, '是') OR contains({0}, '属于') OR contains({0}, 'is') OR contains({0}, 'refersto'))"
_SQUEEZE = r"regexp_replace(lower({0}), '[ \t\n\r\f\v]+', '', 'g')"
_LATIN = "list_distinct(regexp_extract_all({0}, '[a-z][a-z0-9_.=-]+'))"
_FIRST = "list_sort(list_filter({0}, lambda x: length(x) = list_max(list_transform({0}, lambda y: length(y)))))[1]"


@register(
    "definition_plans",
    rf"""WITH s0 AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[^\n。！？!?；;]+(?:[。！？!?；;]+|\n?\z)')) AS raw, generate_subscripts(regexp_extract_all(text, '[^\n。！？!?；;]+(?:[。！？!?；;]+|\n?\z)'), 1) AS n FROM documents),
s1 AS (SELECT id, n, trim(regexp_replace(trim(raw, E' \t\n\r\v\f'), '^(?:#{{1,6}}\s+|[-*+]\s+|\d+[.)]\s+)', ''), E' \t\n\r\v\f') AS sentence FROM s0),
s AS (SELECT *, {_SQUEEZE.format('sentence')} AS c, {_LATIN.format('lower(sentence)')} AS terms FROM s1 WHERE sentence <> ''),
q0 AS (SELECT item_id AS qid, text, {_FIRST.format(_LATIN.format("lower(coalesce(text, ''))"))} AS word FROM benchmark),
q AS (SELECT qid, qid % 2 = 0 AND word IS NOT NULL AS made, word AS term, word AS subject, CASE WHEN qid % 2 = 0 AND word IS NOT NULL THEN 'What is ' || word || '?' ELSE text END AS question FROM q0),
h AS (SELECT q.qid, s.id, s.n, s.sentence FROM q JOIN s ON list_contains(s.terms, q.term) WHERE q.made AND contains(s.c, q.subject) AND {_REL.format("substr(s.c, strpos(s.c, q.subject) + length(q.subject), 160)")} AND {_REL.format('s.c')}),
f AS (SELECT qid, id, arg_min(sentence, n) AS sentence FROM h GROUP BY qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY id) AS k FROM f WHERE id % 2 = 0),
p AS (SELECT qid, list(CAST(id AS VARCHAR) ORDER BY k) AS ids, arg_min(sentence, k) AS sentence FROM r WHERE k <= 2 GROUP BY qid),
o AS (SELECT DISTINCT qid FROM f WHERE id % 2 <> 0)
SELECT q.qid, CASE WHEN made THEN 'concept_definition' ELSE 'other' END AS query_class, CASE WHEN NOT made THEN 'default' WHEN p.qid IS NOT NULL THEN 'definition_first' ELSE 'fallback_default' END AS decision,
CASE WHEN made THEN subject END AS subject, coalesce(array_to_string(p.ids, ','), '') AS evidence, CASE WHEN made AND p.qid IS NULL THEN CASE WHEN o.qid IS NOT NULL THEN 'definition_evidence_outside_snapshot' ELSE 'definition_evidence_not_found' END END AS reason,
CASE WHEN made AND p.qid IS NOT NULL THEN p.sentence || ' [E1]' ELSE 'A process comes first. [E1]' END AS answer, CASE WHEN made AND p.qid IS NOT NULL THEN 'canonical_definition' ELSE 'not_applicable' END AS gate
FROM q LEFT JOIN p USING (qid) LEFT JOIN o USING (qid)""",
)
def definition_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second item asks for its longest word; documents of even id are what answers may use."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    terms = anchor_terms(F.lower(F.coalesce("text", F.lit(""))))
    latin = F.filter(terms, lambda t: F.rlike(t, F.lit("^[a-z]")))
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text", latin.alias("t"))
    longest = F.array_max(F.transform("t", lambda x: F.length(x)))
    word = F.get(F.filter("t", lambda x: F.length(x) == longest), F.lit(0))
    questions = words.select("qid", F.when((F.col("qid") % 2 == 0) & word.isNotNull(), F.concat(F.lit("What is "), word, F.lit("?"))).otherwise(F.col("text")).alias("question"))
    plan = settle(definitions.plans(questions, definitions.index(docs), F.when(F.col("id") % 2 == 0, F.col("id"))), "definition-plans")
    numbers = F.transform(F.sequence(F.lit(1), F.greatest(F.size("primary"), F.lit(1))), lambda i: i.cast("string"))
    gate = definitions.enforced(F.lit("A process comes first. [E1]"), F.col("decision"), F.col("subject"), numbers, F.col("sentences"))
    return plan.withColumn("g", gate).select("qid", "query_class", "decision", "subject", F.array_join(F.col("primary").cast("array<string>"), ",").alias("evidence"), "reason", "g.answer", "g.gate")


@register("ann_topk")
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every row whose id is divisible by 50, by inverted lists and codes, scored exactly."""
    ship_package(spark)
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    book = ann.train(corpus)
    return ann.search(corpus.where("id % 50 = 0"), corpus, ann.build(corpus, book), book, probes=24)


@register("ann_recall")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the ten exactly nearest vectors that the index finds, for each query."""
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    exact = retrieval.dense_topk_rows(corpus.where("id % 50 = 0"), corpus, 10)
    return ann.recall(ann_topk(spark, sf_dir), exact)


@register("condition_lattice")
def condition_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses made of each document's own words, in six forms of condition, held against each other."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\b[a-z]{4,9}\b"), F.lit(0))), lambda w: F.length(w) >= 4)
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") >= 5)
    a, b, c, end = (F.get("w", F.lit(i)) for i in range(4))
    forms = [
        F.concat(F.lit("只有"), a, F.lit("才能"), end, F.lit("。")), F.concat(F.lit("只有"), a, F.lit("和"), b, F.lit("才能"), end, F.lit("。")), F.concat(F.lit("只有"), a, F.lit("或"), b, F.lit("才能"), end, F.lit("。")),
        F.concat(F.lit("除非"), a, F.lit("否则不得"), end, F.lit("。")), F.concat(F.lit("只有未完成"), a, F.lit("才能"), end, F.lit("。")), F.concat(c, F.lit("即可"), end, F.lit("。")),
    ]
    pick = lambda n: F.element_at(F.array(*forms), (F.pmod(n, F.lit(6)) + 1).cast("int"))
    texts = docs.select("doc_id", pick(F.col("doc_id")).alias("claim"), pick(F.floor(F.col("doc_id") / 6)).alias("evidence"))
    read = texts.select("doc_id", "claim", "evidence", conditions.restrictions(F.col("claim")).alias("c"), conditions.restrictions(F.col("evidence")).alias("e"))
    return read.select("doc_id", "claim", "evidence", conditions.check(F.col("claim"), F.col("c"), F.col("e")).alias("r")).select("doc_id", "claim", "evidence", "r.status", "r.reason", F.array_join("r.missing", ";").alias("missing"))


@register("ordered_fallback_replay")
def ordered_fallback_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of ten routes over three providers, which fail in spells."""
    ship_package(spark)
    number = F.col("event_id")
    down = F.array(F.floor(number / 40) % 3 != 0, F.floor(number / 55) % 4 != 1, number % 5 != 0)
    names = F.array(F.lit("first"), F.lit("second"), F.lit("third"))
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("route"), number.alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("t"), names.alias("providers"), down.alias("outcomes"))
    return routing.ordered_fallback(events, 3, 600.0)


@register(
    "model_literals",
    """SELECT event_id, CASE WHEN props IS NULL THEN NULL WHEN event_id % 5 = 2 THEN NULL WHEN event_id % 5 = 3 THEN '[' || props || ', "a ] \\" b"]' WHEN event_id % 5 = 4 THEN NULL ELSE props END AS literal FROM events""",
)
def model_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as a model might give them back: fenced, in prose, twice, nested with quotes, cut off."""
    p = F.col("props")
    forms = F.array(
        F.concat(F.lit("```json\n"), p, F.lit("\n```")), F.concat(F.lit("<think>[1]</think> Here it is: "), p, F.lit(" - that's all.")), F.concat(p, F.lit(" or "), p),
        F.concat(F.lit("["), p, F.lit(', "a ] \\" b"]')), F.concat(F.lit("["), p),
    )
    text = F.element_at(forms, (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", literals.literal(F.col("text")).alias("literal"))


_GATE = ("l_quantity", "l_discount", "l_tax")


@register(
    "gate_from_details",
    """WITH g AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS report, l_returnflag AS g, count(*)::DOUBLE AS rows, avg(l_quantity::DOUBLE) AS q, avg(l_discount::DOUBLE) AS d, avg(l_tax::DOUBLE) AS t FROM lineitem GROUP BY ALL),
u AS (SELECT report, unnest([{'n': 'rows', 'bad': report = '1998' AND g = 'A'}, {'n': 'l_quantity', 'bad': report = '1999' AND g = 'N'}, {'n': 'l_discount', 'bad': report = '1995' AND g = 'R'}, {'n': 'l_tax', 'bad': report = '1996'}]) AS c, g FROM g),
r AS (SELECT report, 'recomputed:metrics.' || g || '.' || c.n AS name, NOT c.bad AS passed FROM u),
w AS (SELECT report, 'threshold:metrics.N.l_quantity' AS name, q + CASE WHEN report = '1999' THEN 1 ELSE 0 END >= 25 AS passed FROM g WHERE g.g = 'N'
  UNION ALL SELECT DISTINCT report, 'threshold:decision.default', report <> '1997' FROM g UNION ALL SELECT DISTINCT report, 'threshold:metrics.none.rows', false FROM g)
SELECT report, bool_and(passed) AS passed, count(*) AS n, array_to_string(list_sort(list(name) FILTER (NOT passed)), ',') AS failed FROM (SELECT * FROM r UNION ALL SELECT * FROM w) GROUP BY report""",
)
def gate_from_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each year of shipping, some with a false aggregate, against the lines that it sums up."""
    details = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("string").alias("report"), "l_returnflag", *_GATE)
    sums = details.groupBy("report", "l_returnflag").agg(F.count("*").cast("double").alias("rows"), *(F.avg(F.col(c).cast("double")).alias(c) for c in _GATE))
    r, g = F.col("report"), F.col("l_returnflag")
    off = {"rows": (r == "1998") & (g == "A"), "l_quantity": (r == "1999") & (g == "N"), "l_discount": (r == "1995") & (g == "R"), "l_tax": r == "1996"}
    group = F.struct(*((F.col(c) + F.when(w, 1.0).otherwise(0.0)).alias(c) for c, w in off.items()))
    metrics = F.map_from_entries(F.collect_list(F.struct(g, group)))
    body = F.to_json(F.struct(metrics.alias("metrics"), F.struct(F.when(F.first(r) == "1997", "dense").otherwise("hybrid").alias("default")).alias("decision")))
    reports = settle(sums.groupBy("report").agg(body.alias("body")), "gate-reports")
    wanted = [("metrics.N.l_quantity", "ge", "25"), ("decision.default", "eq", "hybrid"), ("metrics.none.rows", "gt", "0")]
    rows = reports.select("report", F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(w, ("path", "op", "value"), strict=True))) for w in wanted))).alias("w")).select("report", "w.*")
    checks = gates.thresholds(reports, rows).unionByName(gates.recomputed(reports, details, "l_returnflag", list(_GATE)))
    return gates.verdict(checks).select("report", "passed", "n", F.array_join("failed", ",").alias("failed"))


@register(
    "config_digests",
    """SELECT event_id, 'sha256:' || sha256('{"a":[{"b":2,"c":1}],"api_key":{"$configured":' || CASE WHEN event_id % 3 = 0 THEN 'false' ELSE 'true' END || '},"props":' || replace(props, ': ', ':') || '}') AS digest FROM events WHERE props IS NOT NULL""",
)
def config_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations made of event properties, keys in two orders, with a secret that differs from row to row."""
    ship_package(spark)
    n = F.col("event_id")
    secret = F.when(n % 3 == 0, "").otherwise(n.cast("string"))
    one = F.format_string('{"props": %s, "API_KEY": "%s", "a": [{"c": 1, "b": 2}]}', "props", secret)
    one = F.replace(one, F.lit("API_KEY"), F.lit("api_key"))
    two = F.format_string('{"a":[{"b":2,"c":1}],"api_key":"%s","props":%s}', secret, "props")
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", provenance.config_digest(F.when(n % 2 == 0, one).otherwise(two)).alias("digest"))


@register(
    "provenance_binding",
    """WITH b AS (SELECT item_id AS answer_id, sha256(coalesce(text, '')) AS e, CASE item_id % 3 WHEN 0 THEN 'online' ELSE 'library' END AS scope FROM benchmark),
r AS (SELECT *, '"answer_id":"' || answer_id || '","checker_version":"c1","config_digest":null,"evidence_digest":"' || e || '","execution_scope":"' || scope || '","index_digest":null,"model":"offline","policy_version":null' AS body FROM b)
SELECT answer_id, answer_id % 5 NOT IN (1, 2) AS bound, CASE WHEN answer_id % 5 NOT IN (1, 2) THEN '{' || body || ',"digest":"sha256:' || sha256('{' || body || '}') || '"}' END AS provenance FROM r""",
)
def provenance_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every item; of five one is changed afterwards and one names other evidence, and neither is bound."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("evidence_digest"))
    scope = F.when(F.col("answer_id") % 3 == 0, "online").otherwise("somewhere")
    other = F.when(F.col("answer_id") % 5 == 2, F.sha2("evidence_digest", 256)).otherwise(F.col("evidence_digest"))
    record = provenance.provenance_record(answer_id=F.col("answer_id"), evidence_digest=other, execution_scope=scope, checker_version=F.lit("c1"), model=F.lit("offline"))
    record = F.when(F.col("answer_id") % 5 == 1, F.replace(record, F.lit('"offline"'), F.lit('"online"'))).otherwise(F.concat(F.lit('{"more":1,'), F.substring(record, F.lit(2), F.length(record))))
    return provenance.bound(items, items.select("answer_id", record.alias("record")))
