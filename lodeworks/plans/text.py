"""Named queries over text, chunking and question-understanding operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.operators import chunking, text, understanding
from lodeworks.plans.registry import register
from lodeworks.session import ship_package, table


@register(
    "url_canonical",
    """WITH p AS (SELECT page_id, trim(url) AS u FROM pages), s AS (SELECT page_id, regexp_extract(u, '^([A-Za-z]+)://([^/?#]*)([^?#]*)', 1) AS scheme, regexp_extract(u, '^([A-Za-z]+)://([^/?#]*)([^?#]*)', 2) AS auth,
regexp_extract(u, '^([A-Za-z]+)://([^/?#]*)([^?#]*)', 3) AS path FROM p), h AS (SELECT *, lower(regexp_replace(auth, ':[0-9]+$', '')) AS host, regexp_extract(auth, ':([0-9]+)$', 1) AS port FROM s)
SELECT page_id, CASE WHEN lower(scheme) IN ('http', 'https') AND NOT contains(auth, '@') AND port IN ('', '80', '443') AND host <> '' AND host <> 'localhost' AND NOT ends_with(host, '.localhost') AND NOT ends_with(host, '.local')
AND NOT regexp_matches(host, '^\\[|^[0-9]+(\\.[0-9]+){3}$') THEN lower(scheme) || '://' || host || CASE WHEN port = '' OR (lower(scheme) = 'http' AND port = '80') OR (lower(scheme) = 'https' AND port = '443') THEN '' ELSE ':' || port END
|| CASE WHEN path = '' THEN '/' ELSE path END END AS canonical FROM h""",
)
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@register(
    "web_results_dedup",
    """WITH c AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^([^?#]*)', 1) AS address FROM pages),
f AS (SELECT * FROM c WHERE NOT (host = 'example.org' OR ends_with(host, '.example.org')) AND (host = 'example.net' OR ends_with(host, '.example.net') OR host = 'example.com' OR ends_with(host, '.example.com')))
SELECT page_id, host, address FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY page_id) AS n FROM f) WHERE n = 1""",
)
def web_results_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1).alias("host"), F.regexp_extract("url", r"^([^?#]*)", 1).alias("address"))
    kept = pages.where(text.source_allowed(F.col("host"), ["example.net", "example.com"], ["example.org"]))
    first = Window.partitionBy("address").orderBy("page_id")
    return kept.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


@register(
    "redact_text",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
trim(regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g'), ' '), '(?i)\b(api[_-]?key|access[_-]?token|token|password|secret)\b\s*[:=]\s*([^\s,;]+)', '\1=[REDACTED]', 'g'),
'(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}', 'Bearer [REDACTED]', 'g'), '\bsk-[A-Za-z0-9_-]{8,}\b', '[REDACTED_API_KEY]', 'g'), '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[REDACTED_EMAIL]', 'g')) AS redacted_md5 FROM documents""",
)
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(text.redact(F.col("text"), 1_000_000_000), F.lit(""))).alias("redacted_md5"))


_STRIDE = """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents), c AS (SELECT doc_id, text, n, unnest(range(0, CASE WHEN n > 0 THEN greatest(n - 1 - 100, 0) + 1 ELSE 0 END, 1400)) AS s FROM d),
k AS (SELECT doc_id, text, n, s, least(s + 1500, n) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i FROM c)"""


@register(
    "sentence_window_chunks",
    f"""{_STRIDE} SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(s AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end, md5(substring(text, s + 1, e - s)) AS chunk_md5,
CAST(least(e + 300, n) - greatest(s - 300, 0) AS BIGINT) AS wider_len, md5(substring(text, greatest(s - 300, 0) + 1, least(e + 300, n) - greatest(s - 300, 0))) AS wider_md5 FROM k""",
)
def sentence_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1 - 100, F.lit(0)), F.lit(1400)))
    # the text stays beside its chunks: no join is needed for the wider window
    cut = docs.select("doc_id", "text", F.posexplode(starts).alias("chunk_index", "char_start")).withColumn("char_end", F.least(F.col("char_start") + 1500, n))
    around = chunking.wider()
    return cut.select("doc_id", "chunk_index", F.col("char_start").cast("long"), F.col("char_end").cast("long"), F.md5(F.expr("substring(text, char_start + 1, char_end - char_start)")).alias("chunk_md5"), F.length(around).cast("long").alias("wider_len"), F.md5(around).alias("wider_md5"))


@register(
    "chunk_ids",
    f"""{_STRIDE} SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substring(sha256(concat_ws('|', CAST(doc_id AS VARCHAR), 'None', CAST(s AS VARCHAR), CAST(e AS VARCHAR), 'None')), 1, 24) AS location_id,
'page=1&char=' || s || '-' || e AS source_locator FROM k""",
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.stride_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    none = F.lit(None).cast("string")
    return cut.select("doc_id", "chunk_index", chunking.location_id(F.col("doc_id"), none, F.col("char_start"), F.col("char_end"), none).alias("location_id"), chunking.source_locator(F.lit(1), F.col("char_start"), F.col("char_end")).alias("source_locator"))


@register("recursive_chunks")
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return chunking.recursive_chunks(table(spark, sf_dir, "documents"))


@register("code_aware_chunks")
def code_aware_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return chunking.code_aware_chunks(table(spark, sf_dir, "documents"))


@register(
    "running_chunk_index",
    "SELECT l_orderkey AS doc_id, l_linenumber AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS INTEGER) AS chunk_index FROM lineitem",
)
def running_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id").withColumnRenamed("l_linenumber", "page")
    order = ("page", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return chunking.running_index(parts, order=order).select("doc_id", "page", "chunk_index")


@register(
    "edge_noise_lines",
    """WITH l AS (SELECT source AS doc, doc_id AS page, unnest([{'band': 'header', 'text': split_part(text, chr(10), 1)}, {'band': 'footer', 'text': list_extract(string_split(text, chr(10)), -1)}]) AS x FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc, page, x.band AS band, regexp_replace(lower(trim(x.text, ' ')), '[0-9 \\t\\n\\r\\f\\x0b]+', '', 'g') AS norm FROM l WHERE length(trim(x.text, ' ')) <= 40),
p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY doc)
SELECT doc, band, norm, CAST(n AS BIGINT) AS on_pages FROM (SELECT doc, band, norm, count(DISTINCT page) AS n FROM s WHERE norm <> '' GROUP BY doc, band, norm) JOIN p USING (doc) WHERE n >= 3 AND n >= 0.01 * pages""",
)
def edge_noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = F.split("text", "\n", -1)
    ends = F.array(F.struct(F.lit("header").alias("band"), lines[0].alias("text")), F.struct(F.lit("footer").alias("band"), F.element_at(lines, -1).alias("text")))
    rows = docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.explode(ends).alias("x")).select("doc", "page", "x.*")
    return chunking.edge_noise(rows, share=0.01).select("doc", "band", "norm", F.col("on").alias("on_pages"))


@register(
    "span_box_union",
    """SELECT l.l_orderkey AS chunk_id, min(l2.l_discount) AS x0, min(l2.l_tax) AS y0, max(l2.l_discount) AS x1, max(l2.l_tax) AS y1 FROM (SELECT DISTINCT l_orderkey FROM lineitem) l
JOIN lineitem l2 ON l.l_orderkey = l2.l_orderkey WHERE l2.l_linenumber + l2.l_quantity > 10 AND l2.l_linenumber < 30 GROUP BY l.l_orderkey""",
)
def span_box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    chunks = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_orderkey").alias("chunk_id"), F.lit(10).alias("char_start"), F.lit(30).alias("char_end")).distinct()
    spans = lines.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("span_start"), (F.col("l_linenumber") + F.col("l_quantity")).alias("span_end"),
        F.col("l_discount").alias("x0"), F.col("l_tax").alias("y0"), F.col("l_discount").alias("x1"), F.col("l_tax").alias("y1"),
    )
    return chunking.union_boxes(chunks, spans)


@register(
    "column_gutter",
    """WITH w AS (SELECT l_suppkey % 20 AS doc, l_linenumber AS page, least(l_quantity / 50.0 * 100, CASE WHEN l_quantity > 25 THEN 60 + l_discount * 100 ELSE 40 END) AS x1, CASE WHEN l_quantity > 25 THEN 52.0 ELSE 1.0 END AS x0 FROM lineitem),
t AS (SELECT doc, page, x0, greatest(x1, x0 + 1) AS x1, 0.35 + i * 0.01 AS share FROM w, range(31) r(i)), s AS (SELECT doc, page, CAST(share AS DOUBLE) AS share, count(*) FILTER (WHERE x1 <= share * 100) AS l, count(*) FILTER (WHERE x0 >= share * 100) AS r,
avg(CASE WHEN x0 < share * 100 AND x1 > share * 100 THEN 1.0 ELSE 0.0 END) AS c FROM t GROUP BY doc, page, share)
SELECT doc, page, round(arg_min(share, (round(c + 0.1 * abs(l - r) / (l + r), 9), share)), 2) AS gutter FROM s WHERE l >= 3 AND r >= 3 AND c <= 0.14 GROUP BY doc, page""",
)
def column_gutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    right = F.col("l_quantity") > 25
    x0 = F.when(right, 52.0).otherwise(1.0)
    x1 = F.greatest(F.least(F.col("l_quantity") / 50.0 * 100, F.when(right, 60 + F.col("l_discount") * 100).otherwise(40.0)), x0 + 1)
    words = lines.select((F.col("l_suppkey") % 20).alias("doc"), F.col("l_linenumber").alias("page"), x0.alias("x0"), x1.alias("x1"), F.lit(100.0).alias("width"))
    return chunking.column_gutter(words).select("doc", "page", F.round("gutter", 2).alias("gutter"))


@register(
    "heading_levels",
    """WITH b AS (SELECT p_brand, median(p_size) AS body FROM part GROUP BY p_brand)
SELECT p_partkey, CASE WHEN p_size / body >= 1.9 THEN 1 WHEN p_size / body >= 1.5 THEN 2 WHEN p_size / body >= 1.2 AND NOT regexp_matches(p_name, '[.!?;]$') THEN 3 END AS level FROM part JOIN b USING (p_brand)""",
)
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    body = part.groupBy("p_brand").agg(F.median("p_size").alias("body"))
    return part.join(body, "p_brand").select("p_partkey", chunking.heading_level(F.col("p_size"), F.col("body"), F.lit(0.0), F.col("p_name")).alias("level"))


_RISK_QUESTIONS = [
    "公司报销额度上限是多少", "推荐剂量怎么用药", "how does python work", "show me the api key", "restart production server", "生产环境重启服务", "合同", "谁有管理员权限", "latest release notes", "当前项目配置",
    "目前有效的制度", "近期新闻", "最新版本发布", "你好", "继续", "对比 Kafka 与 Redis 的区别", "compare alpha_one and beta_two", "what is rust",
]


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, and stated questions beside each assistant turn so that every rule is met."""
    stated = F.array(*map(F.lit, _RISK_QUESTIONS))
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    picked = F.element_at(stated, (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(_RISK_QUESTIONS))) + 1).cast("int"))
    return turns.select("conv_id", "turn", "role", F.concat(picked, F.when(F.col("role") == "user", F.concat(F.lit(" "), "text")).otherwise("")).alias("q"))


_Q = f"""WITH q AS (SELECT conv_id, turn, role, list_extract({_RISK_QUESTIONS!r}, CAST((conv_id * 7 + turn) % {len(_RISK_QUESTIONS)} AS INTEGER) + 1) || CASE WHEN role = 'user' THEN ' ' || text ELSE '' END AS q FROM conversations WHERE text IS NOT NULL)"""


def _rx(pattern: str) -> str:
    return "regexp_matches(s, '" + pattern.replace("'", "''") + "')"


_RISK_SQL = f"""{_Q}, t AS (SELECT conv_id, turn, substring(q, 1, 4000) AS s FROM q), m AS (SELECT *, {', '.join(f'{_rx(p)} AS d{i}' for i, (_, _, p) in enumerate(understanding.DOMAINS))},
{_rx(understanding.DECISION)} AS decision, {_rx(understanding.QUANTITATIVE)} AS quantity, {_rx(understanding.IMMEDIATE)} AS immediate, ({' OR '.join(map(_rx, understanding.CREDENTIAL))}) AS credential, {_rx(understanding.PRODUCTION)} AS production FROM t),
h AS (SELECT *, credential OR production OR ((d0 OR d1 OR d2 OR d3) AND (decision OR immediate)) AS high FROM m)
SELECT conv_id, turn, CASE WHEN high THEN 'high' ELSE 'medium' END AS risk_level, CASE WHEN d0 THEN 'health_safety' WHEN d1 THEN 'financial_policy' WHEN d2 THEN 'legal_compliance' WHEN d3 OR credential THEN 'access_control' ELSE 'general_knowledge' END AS query_type,
CASE WHEN high AND quantity THEN 2 ELSE 1 END AS min_sources, CASE WHEN credential THEN 'reject' WHEN production THEN 'review' ELSE 'allow' END AS preflight FROM h"""


@register("risk_flags", _RISK_SQL)
def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = understanding.risk_profile(F.col("q"))
    return _questions(spark, sf_dir).select("conv_id", "turn", risk.alias("r")).select("conv_id", "turn", "r.risk_level", "r.query_type", "r.min_sources", "r.preflight")


_FRESH = {k: p for k, p in (("latest", understanding.LATEST), ("recent", understanding.RECENT), ("publication", understanding.PUBLICATION), ("cur", understanding.CURRENT))}


@register(
    "freshness_flags",
    f"""{_Q}, t AS (SELECT conv_id, turn, q AS s, replace(q, chr(10), ' ') AS flat FROM q), m AS (SELECT *, {', '.join(f'{_rx(p)} AS {k}' for k, p in _FRESH.items())},
regexp_matches(s, '当前(?:(?:本地|生产)(?:项目|环境|选择|配置|实现)?|项目|仓库|代码|实现|配置|字段|接口|系统|产品)') AND NOT regexp_matches(s, '当前.*(?:有效|生效|现行)') AS bound FROM t)
SELECT conv_id, turn, CASE WHEN recent AND NOT latest THEN 'recent' WHEN latest AND publication THEN 'latest_published' WHEN latest THEN 'latest_effective' WHEN cur AND NOT bound THEN 'current' ELSE 'none' END AS mode FROM m""",
)
def freshness_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", understanding.freshness_intent(F.col("q")).alias("mode"))


_U = understanding


@register(
    "route_rules",
    f"""{_Q}, t AS (SELECT conv_id, turn, trim(q, ' ') AS s, turn > 0 AS hist FROM q), r AS (SELECT conv_id, turn, CASE WHEN {_rx(_U.SOCIAL)} THEN 'social_greeting' WHEN hist AND {_rx(_U.SAFE_FOLLOWUP)} THEN 'safe_followup'
WHEN hist AND ({_rx(_U.FACT_FOLLOWUP)} OR {_rx(_U.FACT_REFERENCE)}) THEN 'fact_followup' WHEN {_rx(_U.ENTERPRISE)} OR {_rx(_U.ENTERPRISE_CONTEXT)} THEN 'enterprise_anchor' WHEN {_rx(_U.EXTERNAL)} THEN 'external_current_fact' WHEN {_rx(_U.PUBLIC)} THEN 'general_public_question' END AS reason_code FROM t)
SELECT conv_id, turn, reason_code, CASE reason_code WHEN 'fact_followup' THEN 'knowledge' WHEN 'enterprise_anchor' THEN 'knowledge' WHEN 'external_current_fact' THEN 'web' WHEN 'social_greeting' THEN 'chat' WHEN 'safe_followup' THEN 'chat' WHEN 'general_public_question' THEN 'chat' END AS answer_mode FROM r""",
)
def route_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = understanding.route_rule(F.col("q"), F.col("turn") > 0)
    return _questions(spark, sf_dir).select("conv_id", "turn", route.alias("r")).select("conv_id", "turn", "r.reason_code", "r.answer_mode")


@register(
    "needs_decomposition",
    f"""{_Q}, t AS (SELECT conv_id, turn, ' ' || lower(q) || ' ' AS s FROM q)
SELECT conv_id, turn, ({' OR '.join(f"contains(s, '{m}')" for m in _U.MULTI_TOPIC)}) OR len(list_filter(list_distinct(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9_.=-]{{2,}}')), lambda x: x NOT IN ('the', 'and', 'why', 'what', 'how'))) >= 2 AS decompose FROM t""",
)
def needs_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", understanding.needs_decomposition(F.col("q")).alias("decompose"))


@register(
    "anchor_terms",
    f"""{_Q} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(lower(q), '[a-z][a-z0-9_.=-]+'),
flatten(list_transform(regexp_extract_all(q, '[一-鿿]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))))), ' ') AS terms FROM q WHERE role <> 'user'""",
)
def anchor_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).where("role <> 'user'").select("conv_id", "turn", F.array_join(text.anchor_terms(F.col("q")), " ").alias("terms"))


@register(
    "retrieval_modes",
    "SELECT r_regionkey, CASE WHEN lower(trim(m)) IN ('knowledge', 'web', 'hybrid') THEN lower(trim(m)) WHEN coalesce(r_regionkey % 2 = 0, false) THEN 'hybrid' ELSE 'knowledge' END AS mode FROM (SELECT r_regionkey, list_extract(['WEB', ' hybrid', 'none', NULL, 'Knowledge'], r_regionkey + 1) AS m FROM region)",
)
def retrieval_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("WEB", " hybrid", "none", None, "Knowledge")))
    return table(spark, sf_dir, "region").select("r_regionkey", understanding.retrieval_mode(F.get(names, F.col("r_regionkey")), F.col("r_regionkey") % 2 == 0).alias("mode"))


@register("subquery_validation")
def subquery_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    words = F.split("text", " ")
    proposals = F.array(F.array_join(F.slice(words, 1, 3), " "), F.lit("unrelated zzz"), F.upper(F.array_join(F.slice(words, 1, 3), " ")), F.lit(" "), F.array_join(F.slice(words, 4, 4), " "))
    return turns.select("conv_id", "turn", understanding.valid_subqueries(F.col("text"), proposals, text.anchor_terms).alias("queries"))


_BOUND = """WITH t AS (SELECT conv_id, turn, role, substring(trim(coalesce(text, ''), ' '), 1, 1200) AS text FROM conversations), k AS (SELECT * FROM t WHERE text <> '' AND (role = 'user' OR (role = 'assistant' AND turn % 4 <> 1))),
n AS (SELECT *, row_number() OVER w AS nth, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))"""


@register("history_bound", f"{_BOUND} SELECT conv_id, turn, role, md5(substring(text, 1, CAST(3000 - before AS BIGINT))) AS text_md5 FROM n WHERE nth <= 8 AND before < 3000")
def history_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("grounded", F.col("turn") % 4 != 1)
    return understanding.bound_history(turns, 8, 3000).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@register(
    "safe_history_query",
    """WITH q AS (SELECT conv_id, max(turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id), p AS (SELECT c.conv_id, arg_max(trim(text, ' '), turn) FILTER (WHERE role = 'user' AND turn < q) AS topic, arg_max(trim(text, ' '), turn) FILTER (WHERE role = 'assistant' AND turn < q) AS answer,
max(trim(text, ' ')) FILTER (WHERE turn = q) AS question FROM conversations c JOIN q USING (conv_id) GROUP BY c.conv_id)
SELECT conv_id, md5(substring(concat_ws(' ', nullif(topic, ''), CASE WHEN answer IS DISTINCT FROM topic THEN nullif(answer, '') END, CASE WHEN question IS DISTINCT FROM topic AND question IS DISTINCT FROM answer THEN nullif(question, '') END), 1, 4000)) AS query_md5 FROM p""",
)
def safe_history_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understanding.safe_history_query(table(spark, sf_dir, "conversations")).select("conv_id", F.md5("query").alias("query_md5"))


@register("version_families")
def version_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return table(spark, sf_dir, "part").select("p_partkey", text.version_family(F.concat(F.lit(" "), "p_name", F.lit("  Ｖ1"))).alias("family"))
