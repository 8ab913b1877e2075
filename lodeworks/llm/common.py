"""Shared plumbing: scratch tables in the cluster's shared folder, byte files for the executors, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lodeworks.session import ship_package

#: What the contracts call a word: a run without the six ASCII white-space characters.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch, where the session does not name its own: whole documents vary from bytes to megabytes, and
#: a batch lies in memory on both sides of each worker.
BATCH_BYTES = 5 << 20
_BATCHES, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864", "67108864b", "64m", "64MB")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    if spark.conf.get(_BATCHES) in _UNSET:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a local session takes a temporary folder of its own; on a cluster it is an error, since its
    machines share no local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='lodeworks-')}"
        named = _own[app]
    return named.rstrip("/")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each lengthened until no column of ``taken`` has it (Spark tells no case apart)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lodeworks/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage: a lost executor costs only tasks that read these files.
    """
    ship_package(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Put a bounded side file in the shared folder and have Spark deliver it to every executor.

    Returns the name under which ``SparkFiles.get`` finds it in a task.
    """
    folder = scratch(spark, "files")
    leaf = f"{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{leaf}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(f"{folder}/{leaf}")
    return leaf


def release() -> None:
    """Give freed memory back to the system: workers are used again, and what one stage leaves adds to the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this kind of C library
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over a task's batches, with ``release`` after the last."""

    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidy


def documents_in_pieces(batches: Iterator[pa.RecordBatch], text_at: int, chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut into runs of rows holding about ``chars`` characters, with their texts (null: empty).

    A single longer text is a run of its own; nothing is cut inside a text.
    """
    for batch in batches:
        column = batch.column(text_at)
        sizes = pc.binary_length(column).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > chars:
                yield batch.slice(start, i - start), [x or "" for x in column.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start), [x or "" for x in column.slice(start).to_pylist()]
    release()
