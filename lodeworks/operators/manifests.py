"""Manifests of collections: versions that appends and deletes move without a rescan, and the guard of what may be appended.

A collection's contents are a multiset of fingerprints. Its state is their number and the sums of their two leading
64-bit words, modulo 2^64; so an append adds a batch's sums, a delete subtracts them, a merge adds two states, and any
order of these gives what a scan of the contents would. The version is a digest of the state. Sums are partial
aggregates of one row per collection and task.

Defined cases: equal items count each time; a null field is a value of its own; an empty batch changes nothing and does
not advance ``data_version``; taking away what a collection doesn't hold gives a state that no contents have (the caller
takes only what is there); a collection that ends with no items has the version of the empty state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.provenance import struct_digest

_MOD = "cast(18446744073709551616 as decimal(38,0))"
#: What two collections must agree on before one is appended to the other.
CONTRACT = ("embedding_provider", "embedding_model", "embedding_dimension", "normalization", "metric_type", "chunk_config_version", "chunk_algorithm")


def fingerprint(**fields: Column) -> Column:
    """The digest of an item's named values, in hexadecimal."""
    return F.substring(struct_digest(**fields), 8, 64)


def state(items: DataFrame, key: str, fingerprints: str) -> DataFrame:
    """``key, n, a, b`` of the items of each collection."""
    word = lambda at: F.conv(F.substring(fingerprints, at, 16), 16, 10).cast("decimal(20,0)")
    total = lambda at: F.expr(f"cast(pmod(s{at}, {_MOD}) as decimal(20,0))")
    sums = items.groupBy(key).agg(F.count("*").alias("n"), F.sum(word(1)).cast("decimal(38,0)").alias("s1"), F.sum(word(17)).cast("decimal(38,0)").alias("s2"))
    return sums.select(key, "n", total(1).alias("a"), total(2).alias("b"))


def moved(manifests: DataFrame, key: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Manifests after the states ``added`` and ``removed``; ``data_version`` grows by one where there were any.

    ``manifests(key, n, a, b, data_version, ...)``; further columns stay as they are, and are null for new collections.
    """
    columns = manifests.columns
    rest = [c for c in columns if c not in (key, "n", "a", "b", "data_version")]
    changes = [d.select(key, F.col("n") * s, *(F.col(c).cast("decimal(38,0)") * s for c in "ab")).toDF(key, "dn", "da", "db") for d, s in ((added, 1), (removed, -1)) if d is not None]
    if not changes:
        return manifests
    delta = (changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])).groupBy(key).agg(F.sum("dn").alias("dn"), F.sum("da").alias("da"), F.sum("db").alias("db"))
    both = manifests.join(delta.withColumn("hit", F.lit(True)), key, "full")
    word = lambda c: F.expr(f"cast(pmod(cast(coalesce({c}, 0) as decimal(38,0)) + cast(coalesce(d{c}, 0) as decimal(38,0)), {_MOD}) as decimal(20,0))").alias(c)
    return both.select(
        key, (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).cast("long").alias("n"), word("a"), word("b"),
        (F.coalesce("data_version", F.lit(0)) + F.coalesce(F.col("hit"), F.lit(False)).cast("int")).alias("data_version"), *rest,
    ).select(*columns)


def version(n: Column, a: Column, b: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", n.cast("string"), a.cast("string"), b.cast("string")), 256))


def mismatches(current: DataFrame, incoming: DataFrame, key: str, contract: tuple[str, ...] = CONTRACT) -> DataFrame:
    """``key, mismatches``: fields in which an incoming collection's contract differs from that of the one it is meant for.

    Nulls agree with nulls only. A collection that doesn't exist yet has no mismatches.
    """
    both = incoming.select(key, *(F.col(c).alias(f"new_{c}") for c in contract)).join(current.select(key, F.lit(True).alias("known"), *contract), key, "left")
    wrong = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in contract)))
    return both.select(key, F.when(F.col("known"), wrong).otherwise(F.expr("cast(array() as array<string>)")).alias("mismatches"))


def append(manifests: DataFrame, incoming: DataFrame, items: DataFrame, key: str, fingerprints: str, contract: tuple[str, ...] = CONTRACT) -> tuple[DataFrame, DataFrame]:
    """Manifests after the items of those collections whose contracts agree, and ``key, mismatches`` of the refused ones."""
    judged = mismatches(manifests, incoming, key, contract)
    allowed = items.join(judged.where(F.size("mismatches") == 0), key, "left_semi")
    return moved(manifests, key, state(allowed, key, fingerprints)), judged.where(F.size("mismatches") > 0)
