"""Incremental views: change detection between snapshots, resumable work, windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.session import settle


def changes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``id, change``: added, removed, modified (the content differs) or touched (only size or time differ); unchanged rows drop.

    Snapshots are ``(id, size, mtime, content_hash)``; one full outer join on the key.
    """
    o = old.select(key, *(F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "content_hash")), F.lit(True).alias("was"))
    n = new.select(key, "size", "mtime", "content_hash", F.lit(True).alias("is"))
    j = o.join(n, key, "full")
    candidate = ~F.col("size").eqNullSafe(F.col("old_size")) | ~F.col("mtime").eqNullSafe(F.col("old_mtime"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(candidate & ~F.col("content_hash").eqNullSafe(F.col("old_content_hash")), "modified").when(candidate, "touched")
    return j.select(key, kind.alias("change")).where("change is not null")


def next_cursor(old: DataFrame, new: DataFrame, busy: DataFrame, key: str = "id") -> DataFrame:
    """The snapshot to compare with next time: the new one and removed items that are still busy."""
    kept = old.join(new.select(key), key, "left_anti").join(busy.select(key).distinct(), key, "left_semi")
    return new.unionByName(kept)


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a checkpoint does not list as succeeded; failed items are tried again."""
    return work.join(done.where("status = 'succeeded'").select(*key).distinct(), key, "left_anti")


def due(syncs: DataFrame, now) -> DataFrame:
    return syncs.where(F.col("active") & (F.col("next_run") <= now)).orderBy("next_run", "id")


def tumbling_counts(events: DataFrame, width: str, at: str = "ts", late: str | None = None) -> DataFrame:
    """Counts per type and window; with ``late`` as a watermark on a stream. Stamps without a zone are taken as UTC."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp"))
    stamped = stamped.withWatermark(at, late) if late else stamped
    return stamped.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, at: str = "ts") -> DataFrame:
    stamped = events.withColumn(at, F.col(at).cast("timestamp"))
    return stamped.groupBy("user_id", F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def chains(versions: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``head, depth, id``: the versions from each head (by default every version) to its root, by pointer doubling.

    ``versions(id, parent)``. Round ``k`` joins what is known with the ``2^k``-th ancestors and those with themselves, so
    a chain of 10 000 takes 14 rounds. A parent that is missing ends a chain; a chain of more links than there are versions
    is a loop and an error. Without heads the result has a row for every pair of a version and its ancestor; ``roots``
    is for the ends alone. Tables of a round are written, so that its plan doesn't hold the rounds before it.
    """
    known = versions.select("id", "parent").where("id is not null").dropDuplicates(["id"])
    up = settle(known.join(known.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", F.col("parent").alias("to")), "chain-up")
    found = settle((known if heads is None else heads.join(known.select("id"), "id", "left_semi")).select(F.col("id").alias("head"), F.lit(0).alias("depth"), "id").distinct(), "chain-found")
    step, most = 1, known.count()
    while not up.isEmpty():
        if step > most:
            raise ValueError("a version is its own ancestor")
        further = found.join(up, "id").select("head", (F.col("depth") + step).alias("depth"), F.col("to").alias("id"))
        found, step = settle(found.unionByName(further), "chain-found"), 2 * step
        up = settle(up.join(up.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), "chain-up")
    return found


def roots(versions: DataFrame) -> DataFrame:
    """``id, root, depth`` of every version: its oldest known ancestor and the steps to it; one row a version in every round."""
    known = versions.select("id", "parent").where("id is not null").dropDuplicates(["id"])
    parent = known.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    at = settle(known.join(parent, "parent", "left").select("id", F.coalesce(F.when(F.col("there"), F.col("parent")), F.col("id")).alias("root"), F.coalesce(F.col("there"), F.lit(False)).cast("long").alias("depth")), "root-step")
    step, most = 1, at.count()
    while True:
        onward = at.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = settle(at.join(onward, "root").select("id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "root-step")
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        at, step = moved.drop("moved"), 2 * step
        if step > 2 * most:  # a round more than the longest chain takes
            raise ValueError("a version is its own ancestor")


def config_chain(versions: DataFrame, head: str) -> DataFrame:
    """``depth, id`` from ``head`` to the root over ``versions(id, parent)``."""
    named = versions.sparkSession.createDataFrame([(head,)], "id string")
    return chains(versions, named).select("depth", "id")


def summary_window(turns: DataFrame, start: int = 12, keep: int = 6) -> DataFrame:
    """Turns to fold into a conversation's summary: those but the last ``keep``, once there are ``start``."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    total = F.count("*").over(Window.partitionBy("conv_id"))
    return turns.withColumns({"back_": back, "total_": total}).where((F.col("total_") >= start) & (F.col("back_") > keep)).drop("back_", "total_")


def parse_dag(nodes: list[dict]) -> list[str]:
    """The order of a pipeline's nodes ``{"id", "type", "next": [...]}``, or an error naming what is wrong with it."""
    ids = [n["id"] for n in nodes]
    if len(set(ids)) != len(ids):
        raise ValueError("node ids repeat")
    after = {n["id"]: list(n.get("next", [])) for n in nodes}
    unknown = {m for ms in after.values() for m in ms} - set(ids)
    if unknown:
        raise ValueError(f"unknown nodes {sorted(unknown)}")
    into = dict.fromkeys(ids, 0)
    for ms in after.values():
        for m in ms:
            into[m] += 1
    starts, ends = [i for i in ids if not into[i]], [i for i in ids if not after[i]]
    kinds = {n["id"]: n["type"] for n in nodes}
    if len(starts) != 1:
        raise ValueError("there must be one start")
    if len(ends) != 1 or kinds[ends[0]] != "index":
        raise ValueError("there must be one end, an index node")
    order, ready = [], starts
    while ready:
        node = ready.pop()
        order.append(node)
        for m in after[node]:
            into[m] -= 1
            if not into[m]:
                ready.append(m)
    if len(order) != len(ids):
        raise ValueError("the nodes form a cycle")
    return order
