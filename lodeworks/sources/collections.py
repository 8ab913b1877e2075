"""Versioned collections of chunks on plain Parquet: build, activate, roll back, delete, list, describe.

Every build is a table of its own, ``<name>__v_<stamp>_<nonce>``. Which one a name stands for is a row in an append-only log,
newest last, so a switch is one small append that readers see whole or not at all. Deletions are rows of ids that reads
leave out, until ``compact`` rewrites a version.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "name string, physical string, action string, at long, dimension int, metric string, fingerprint string"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,120}")


def version_name(name: str, stamp: int | None = None, nonce: str | None = None) -> str:
    return f"{name}__v_{stamp if stamp is not None else int(time.time() * 1000)}_{nonce or uuid.uuid4().hex[:8]}"


def owns(name: str, physical: str) -> bool:
    """Whether a physical table is a version of a collection."""
    return re.fullmatch(re.escape(name) + r"__v_\d+_[0-9a-f]+", physical) is not None


class CollectionStore:
    """Collections below one folder of any file system that Spark can write."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, path: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")

    def log(self) -> DataFrame:
        return self._table("_log", _LOG)

    def _append(self, *row) -> None:
        self.spark.createDataFrame([row], _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/_log")

    def _history(self, name: str) -> list:
        return sorted(self.log().where(F.col("name") == name).collect(), key=lambda r: r["at"])

    def _active(self, name: str):
        entries = [r for r in self._history(name) if r["action"] != "build"]
        return entries[-1] if entries and entries[-1]["action"] == "activate" else None

    def build(self, name: str, chunks: DataFrame, dimension: int, metric: str = "cosine", fingerprint: str = "", batch: int | None = None) -> str:
        """Write a new version without making it visible; ``chunks`` needs ``chunk_id, document_id, text, embedding``."""
        if not _NAME.fullmatch(name) or "__v_" in name:
            raise ValueError(f"{name!r} is no collection name")
        physical = version_name(name)
        writer = chunks.write.mode("errorifexists")
        (writer.option("maxRecordsPerFile", batch) if batch else writer).parquet(f"{self.root}/{physical}")
        self._append(name, physical, "build", time.time_ns(), dimension, metric, fingerprint)
        return physical

    def init(self, name: str, dimension: int, metric: str = "cosine", force_new: bool = False) -> str:
        """The active version of a collection, made empty if there is none; asking for a new one of a used name is an error."""
        now = self._active(name)
        if now is not None:
            if force_new:
                raise ValueError(f"collection {name} exists")
            if now["dimension"] != dimension or now["metric"] != metric:
                raise ValueError(f"collection {name} has {now['dimension']} dimensions and metric {now['metric']}")
            return now["physical"]
        empty = self.spark.createDataFrame([], "chunk_id long, document_id string, text string, embedding array<float>")
        physical = self.build(name, empty, dimension, metric)
        self.activate(name, physical)
        return physical

    def insert(self, name: str, chunks: DataFrame, fingerprint: str = "") -> None:
        """Append to the active version; a different embedding fingerprint is refused."""
        now = self._require(name)
        if fingerprint and now["fingerprint"] and fingerprint != now["fingerprint"]:
            raise ValueError("the chunks were embedded differently from the collection")
        chunks.write.mode("append").parquet(f"{self.root}/{now['physical']}")

    def _require(self, name: str):
        now = self._active(name)
        if now is None:
            raise KeyError(name)
        return now

    def activate(self, name: str, physical: str) -> None:
        """Point a name at one of its versions."""
        if not owns(name, physical):
            raise ValueError(f"{physical} is no version of {name}")
        built = [r for r in self._history(name) if r["physical"] == physical and r["action"] == "build"]
        if not built:
            raise KeyError(physical)
        self._append(name, physical, "activate", time.time_ns(), built[-1]["dimension"], built[-1]["metric"], built[-1]["fingerprint"])

    def rollback(self, name: str, physical: str | None = None) -> str:
        """Back to a stated version, or to the one that was active before."""
        if physical is None:
            past = [r["physical"] for r in self._history(name) if r["action"] == "activate"]
            earlier = [p for p in past if p != past[-1]] if past else []
            if not earlier:
                raise ValueError(f"{name} has no earlier version")
            physical = earlier[-1]
        self.activate(name, physical)
        return physical

    def read(self, name: str) -> DataFrame:
        """Rows of the active version without those of deleted documents."""
        physical = self._require(name)["physical"]
        rows = self.spark.read.parquet(f"{self.root}/{physical}")
        gone = self._table(f"_deleted/{physical}", "document_id string")
        return rows.join(gone.distinct(), "document_id", "left_anti").select(*rows.columns)

    def delete_documents(self, name: str, ids: DataFrame) -> None:
        """Soft delete of ``ids(document_id)``: one append, no rewrite."""
        ids.select(F.col("document_id").cast("string")).write.mode("append").parquet(f"{self.root}/_deleted/{self._require(name)['physical']}")

    def compact(self, name: str) -> str:
        """Rewrite the active version without its deleted rows and switch to it."""
        now = self._require(name)
        physical = self.build(name, self.read(name), now["dimension"], now["metric"], now["fingerprint"] or "")
        self.activate(name, physical)
        return physical

    def drop(self, name: str) -> list[str]:
        """Forget a collection and delete its own versions only."""
        versions = sorted({r["physical"] for r in self._history(name) if owns(name, r["physical"])})
        self._append(name, "", "drop", time.time_ns(), 0, "", "")
        for v in versions:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{v}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return versions

    def list(self, dimension: int | None = None) -> DataFrame:
        """``name, physical, dimension, metric`` of the collections that are active; versions stay hidden."""
        last = self.log().where("action <> 'build'").groupBy("name").agg(F.max_by(F.struct("physical", "action", "dimension", "metric"), "at").alias("r"))
        live = last.where("r.action = 'activate'").select("name", "r.physical", "r.dimension", "r.metric")
        return live.where(F.col("dimension") == dimension) if dimension is not None else live

    def describe(self, name: str) -> dict:
        now, rows = self._require(name), self.read(name)
        return {"name": name, "rows": rows.count(), "fields": [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields], "dimension": now["dimension"], "metric": now["metric"], "modes": ["dense", "bm25", "hybrid"]}
