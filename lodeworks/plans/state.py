"""Manifests, sync runs and version chains over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import manifests, schedule
from lodeworks.plans.registry import register
from lodeworks.session import settle, table, work_folder
from lodeworks.sources.commits import TableLog
from lodeworks.streaming import incremental, sync

_WORD = "CAST(('0x' || substr(h, {at}, 16)) AS UBIGINT)"


@register(
    "manifest_mutations",
    f"""WITH i AS (SELECT coalesce(source, 'none') AS collection, sha256('{{"id":' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ',"text":"' || sha256(coalesce(text, '')) || '"}}') AS h FROM documents WHERE doc_id % 5 <> 0),
s AS (SELECT collection, count(*) AS n, sum(CAST({_WORD.format(at=1)} AS HUGEINT)) % 18446744073709551616 AS a, sum(CAST({_WORD.format(at=17)} AS HUGEINT)) % 18446744073709551616 AS b FROM i GROUP BY collection),
k AS (SELECT coalesce(source, 'none') AS collection, CAST(max(CAST(doc_id % 3 <> 0 AS INTEGER)) + max(CAST(doc_id % 3 = 0 AS INTEGER)) + max(CAST(doc_id % 5 = 0 AS INTEGER)) AS INTEGER) AS data_version FROM documents GROUP BY ALL),
j AS (SELECT k.collection, data_version, coalesce(n, 0) AS n, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM k LEFT JOIN s USING (collection))
SELECT collection, n, data_version, 'sha256:' || sha256(CAST(n AS VARCHAR) || '|' || CAST(a AS VARCHAR) || '|' || CAST(b AS VARCHAR)) AS version FROM j""",
)
def manifest_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents in three steps, two parts appended and a fifth taken away; the twin scans what is left."""
    digest = manifests.fingerprint(id=F.col("doc_id"), text=F.sha2(F.coalesce("text", F.lit("")), 256))
    items = settle(table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("collection"), "doc_id", digest.alias("h")), "manifest-items")
    empty = spark.createDataFrame([], "collection string, n long, a decimal(20,0), b decimal(20,0), data_version int")
    parts = [manifests.state(items.where(w), "collection", "h") for w in ("doc_id % 3 <> 0", "doc_id % 3 = 0", "doc_id % 5 = 0")]
    after = manifests.moved(manifests.moved(manifests.moved(empty, "collection", parts[0]), "collection", parts[1]), "collection", removed=parts[2])
    return after.select("collection", "n", "data_version", manifests.version(F.col("n"), F.col("a"), F.col("b")).alias("version"))


@register(
    "manifest_append_guard",
    """WITH s AS (SELECT source, count(DISTINCT lang) AS langs, max(length(source)) AS l FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT source AS collection, array_to_string(list_filter([CASE WHEN langs % 2 = 1 THEN 'embedding_dimension' END, CASE WHEN l % 2 = 1 THEN 'metric_type' END, CASE WHEN ascii(substr(source, l, 1)) % 3 = 0 THEN 'chunk_config_version' END], lambda x: x IS NOT NULL), ',') AS mismatches FROM s""",
)
def manifest_append_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts made from each source's own figures, held against the ones of the collection."""
    per = table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("collection")).agg(F.countDistinct("lang").alias("langs"), F.max(F.length("source")).alias("l"), F.max(F.ascii(F.expr("right(source, 1)"))).alias("last"))
    fixed = {"embedding_provider": "offline", "embedding_model": "hash", "normalization": "l2", "chunk_algorithm": "sentences"}
    common = [F.lit(v).alias(k) for k, v in fixed.items()]
    current = per.select("collection", *common, F.lit(64).alias("embedding_dimension"), F.lit("COSINE").alias("metric_type"), F.lit("c1").alias("chunk_config_version"))
    incoming = per.select(
        "collection", *common, (64 + F.col("langs") % 2).cast("int").alias("embedding_dimension"), F.when(F.col("l") % 2 == 1, "L2").otherwise("COSINE").alias("metric_type"),
        F.when(F.col("last") % 3 == 0, "c2").otherwise("c1").alias("chunk_config_version"),
    )
    return manifests.mismatches(current, incoming, "collection").select("collection", F.array_join("mismatches", ",").alias("mismatches"))


@register(
    "sync_runs",
    """WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS external_id, sha256(coalesce(text, '')) AS h, n_chars FROM documents),
o AS (SELECT *, doc_id % 10 <> 0 AS in1, doc_id % 10 <> 1 AS in2, doc_id % 7 = 0 AS touched, doc_id % 14 = 0 AS changed, doc_id % 20 = 1 AS busy FROM d),
r AS (SELECT external_id, n_chars, CASE WHEN in1 AND NOT in2 THEN CASE WHEN busy THEN 'active' ELSE 'deleted' END ELSE 'active' END AS status,
  CASE WHEN in1 AND (in2 IS FALSE OR NOT changed) THEN h WHEN changed THEN sha256(h || 'x') ELSE h END AS content_hash,
  CASE WHEN NOT in2 THEN CASE WHEN busy THEN 0 END WHEN touched THEN 2 ELSE 1 END AS mtime,
  CASE WHEN NOT in2 THEN CASE WHEN busy THEN 0 END ELSE n_chars END AS size,
  CASE WHEN in1 AND in2 AND changed THEN 2 ELSE 1 END AS attempts FROM o WHERE in1 OR in2)
SELECT external_id, status, content_hash, mtime, size, CAST(attempts AS BIGINT) AS attempts FROM r""",
)
def sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings of the documents: a tenth new, a tenth gone (half of these busy), a seventh touched, half of these changed."""
    log = TableLog(spark, f"{work_folder(spark)}/lodeworks/sync-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("external_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.col("n_chars").alias("size"))
    docs = settle(docs, "sync-documents")
    one = docs.where("doc_id % 10 <> 0").select("external_id", F.lit(1).cast("long").alias("mtime"), "size", F.col("h").alias("content_hash"))
    changed = F.when(F.col("doc_id") % 14 == 0, F.sha2(F.concat("h", F.lit("x")), 256)).otherwise(F.col("h"))
    two = docs.where("doc_id % 10 <> 1").select("external_id", F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).cast("long").alias("mtime"), "size", changed.alias("content_hash"))
    busy = docs.where("doc_id % 20 = 1").select("external_id")
    sync.run(log, one, busy, 1)
    sync.run(log, two, busy, 2)
    items, cursor, queue = log.read("items", sync.ITEMS), log.read("cursor", sync.CURSOR), log.read("queue", sync.QUEUE)
    attempts = queue.groupBy("external_id").agg(F.count("*").alias("attempts"))
    return items.join(cursor.withColumnRenamed("size", "cursor_size"), "external_id", "left").join(attempts, "external_id", "left").select("external_id", "status", "content_hash", F.col("mtime").cast("int").alias("mtime"), F.col("cursor_size").alias("size"), "attempts")


@register(
    "version_chains",
    """WITH RECURSIVE v AS (SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 97 <> 1 THEN CAST(c_custkey - 1 AS BIGINT) END AS parent FROM customer),
r AS (SELECT id, id AS root, CAST(0 AS BIGINT) AS depth FROM v WHERE parent IS NULL OR parent NOT IN (SELECT id FROM v) UNION ALL SELECT v.id, r.root, r.depth + 1 FROM v JOIN r ON v.parent = r.id)
SELECT id, root, depth FROM r""",
)
def version_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to 97 customers, all of them at once."""
    c = F.col("c_custkey").cast("long")
    return incremental.roots(table(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 97 != 1, c - 1).alias("parent")))


_CRONS = {
    "*/15 9-17 * * 1-5": "minute(m) % 15 = 0 AND hour(m) BETWEEN 9 AND 17 AND isodow(m) <= 5",
    "0 3 * * 7": "minute(m) = 0 AND hour(m) = 3 AND isodow(m) = 7",
    "30 2 1,15 * *": "minute(m) = 30 AND hour(m) = 2 AND day(m) IN (1, 15)",
    "5,35 */6 10-20 2-11/3 *": "minute(m) IN (5, 35) AND hour(m) % 6 = 0 AND day(m) BETWEEN 10 AND 20 AND month(m) IN (2, 5, 8, 11)",
    "0 12 13 * FRI": "minute(m) = 0 AND hour(m) = 12 AND (day(m) = 13 OR isodow(m) = 5)",
    "* * * * *": "true",
}
_CRON_SQL = "\n  UNION ALL ".join(f"SELECT {i} AS c, m FROM minutes WHERE {where}" for i, where in enumerate(_CRONS.values()))


@register(
    "cron_next_runs",
    f"""WITH last AS (SELECT user_id, max(ts) AS moment, user_id % {len(_CRONS)} AS c FROM events GROUP BY user_id),
minutes AS (SELECT unnest(generate_series(date_trunc('day', min(moment)), max(moment) + INTERVAL 400 DAY, INTERVAL 1 MINUTE)) AS m FROM last),
runs AS ({_CRON_SQL})
SELECT l.user_id, r.m - INTERVAL 8 HOUR AS next_run FROM last l ASOF JOIN runs r ON l.c = r.c AND l.moment + INTERVAL 8 HOUR < r.m""",
)
def cron_next_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run of each user's schedule after the user's last event, on Shanghai's clock."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("at"))
    cron = F.element_at(F.array(*(F.lit(c) for c in _CRONS)), (F.col("user_id") % len(_CRONS) + 1).cast("int"))
    return last.select("user_id", schedule.next_run(cron, F.col("at"), F.lit("Asia/Shanghai")).alias("next_run"))
