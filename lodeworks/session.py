"""Session construction and table access shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "lodeworks") -> SparkSession:
    """A local session with the settings the engine expects; clusters bring their own session."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LODEWORKS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; only Spark's own readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, for what one job writes and the next reads.

    Where that is unset, a local session takes a temporary folder of its own; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='lodeworks-')}")
    return named.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the work folder and read it back, so that what follows has no lineage behind it."""
    ship_package(df.sparkSession)
    path = f"{work_folder(df.sparkSession)}/lodeworks/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="lodeworks-code-")) / "lodeworks.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(archive))  # the driver serves it to the executors
