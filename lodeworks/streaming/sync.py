"""Sync runs of a connector: a listing against the cursor, items and queue brought up to it, all in one commit.

Semantics: an external item is new if the cursor lacks it and a candidate if its time or size differs; a candidate whose
content has no hash, or the hash that the item has already, is skipped; new and changed ones are upserted and queued. An
item that the listing lacks is deleted, unless it is busy: then it stays, and stays in the cursor with time and size 0,
so that the next run tries again. The cursor moves only together with items and queue, in one commit of ``TableLog``.

Defined cases: rows of a listing without an id are left out; of several rows with one id the latest counts; the first
run starts from empty tables; a run that stops before its commit leaves items, queue and cursor of the run before it; a
busy item that is listed and has changed is upserted like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.session import settle
from lodeworks.sources.commits import TableLog

ITEMS = "external_id string, content_hash string, size long, status string, run int"
QUEUE = "external_id string, attempt int, run int"
CURSOR = "external_id string, mtime long, size long"


def planned(listing: DataFrame, cursor: DataFrame, items: DataFrame, busy: DataFrame) -> DataFrame:
    """``external_id, outcome, ...``: what a run does with every item that is listed or in the cursor.

    ``listing(external_id, mtime, size, content_hash)``, ``busy(external_id)``. Outcomes: ``added``, ``updated``,
    ``skipped``, ``unchanged``, ``deleted``, ``retained``.
    """
    latest = listing.where("external_id is not null").groupBy("external_id").agg(F.max(F.struct("mtime", "size", "content_hash")).alias("l")).select("external_id", "l.*", F.lit(True).alias("listed"))
    seen = cursor.select("external_id", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.lit(True).alias("known"))
    held = items.where("status = 'active'").select("external_id", F.col("content_hash").alias("old_hash"), F.lit(True).alias("held"))
    marked = busy.select("external_id").distinct().withColumn("busy", F.lit(True))
    all_ = latest.join(seen, "external_id", "full").join(held, "external_id", "left").join(marked, "external_id", "left")
    same = F.col("known").isNotNull() & F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("size").eqNullSafe(F.col("old_size"))
    outcome = (
        F.when(F.col("listed").isNull(), F.when(F.col("busy"), "retained").otherwise("deleted"))
        .when(same, "unchanged")
        .when(F.col("content_hash").isNull() | (F.col("content_hash") == F.col("old_hash")), "skipped")
        .when(F.col("held"), "updated")
        .otherwise("added")
    )
    return all_.select("external_id", outcome.alias("outcome"), "mtime", "size", "content_hash")


def run(log: TableLog, listing: DataFrame, busy: DataFrame, number: int, after: Callable[[str], None] = lambda step: None) -> dict[str, int]:
    """One sync run: the counts of its outcomes. Without the commit at its end nothing of it is visible."""
    base = log.version()
    items, queue, cursor = log.read("items", ITEMS, base), log.read("queue", QUEUE, base), log.read("cursor", CURSOR, base)
    plan = settle(planned(listing, cursor, items, busy), "sync-plan")
    after("planned")
    upserts = plan.where("outcome in ('added', 'updated')")
    gone = plan.where("outcome = 'deleted'").select("external_id")
    kept = items.join(upserts.select("external_id"), "external_id", "left_anti").join(gone.withColumn("gone", F.lit(True)), "external_id", "left")
    kept = kept.select("external_id", "content_hash", "size", F.when(F.col("gone"), "deleted").otherwise(F.col("status")).alias("status"), F.when(F.col("gone"), F.lit(number)).otherwise(F.col("run")).alias("run"))
    new_items = kept.unionByName(upserts.select("external_id", "content_hash", "size", F.lit("active").alias("status"), F.lit(number).alias("run")))
    attempts = queue.groupBy("external_id").agg(F.max("attempt").alias("last"))
    queued = upserts.join(attempts, "external_id", "left").select("external_id", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("attempt"), F.lit(number).alias("run"))
    new_cursor = plan.where("outcome <> 'deleted'").select("external_id", F.when(F.col("outcome") == "retained", 0).otherwise(F.col("mtime")).cast("long").alias("mtime"), F.when(F.col("outcome") == "retained", 0).otherwise(F.col("size")).cast("long").alias("size"))
    counts = {r["outcome"]: r["n"] for r in plan.groupBy("outcome").agg(F.count("*").alias("n")).collect()}  # six rows at most
    log.commit(base, {"items": new_items, "queue": queue.unionByName(queued), "cursor": new_cursor}, {"run": number, "counts": counts}, after)
    return counts
