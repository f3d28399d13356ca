"""Session helpers: settings a run relies on, and tables staged between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "arborlift", **conf) -> SparkSession:
    """Session with the settings the plans assume; a cluster may override any."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the executors of a cluster this package, once per context.

    A local master runs where the package already is.
    """
    context = spark.sparkContext
    if context.master.startswith("local") or getattr(context, "_arborlift_shipped", False):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="arborlift-")) / "arborlift.zip"  # served by the driver
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, file.relative_to(home.parent))
    context.addPyFile(str(archive))
    context._arborlift_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a local master gets a temporary folder; on a cluster
    executors would each write to their own disk, so that is refused.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="arborlift-")
        context.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    return f"{shared_folder(spark).rstrip('/')}/arborlift/{name}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    A written table cuts lineage and survives lost executors, and unlike a row
    checkpoint it stays columnar, so later steps read only what they use. What was
    shuffled for it is of no use any more and goes from the disks at once.
    """
    path = shared_path(df.sparkSession, name)
    before = df.sparkSession.conf.get(SHUFFLE_CLEANUP, None)
    df.sparkSession.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            df.sparkSession.conf.unset(SHUFFLE_CLEANUP)
        else:
            df.sparkSession.conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_A_TASK = 200_000


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_TASK))


def dealt(staged: DataFrame, *keys: str) -> DataFrame:
    """Deal a staged table out by ``keys`` into tasks of about ``ROWS_A_TASK`` rows.

    Spark merges small partitions by their bytes on the wire, and rows that compress
    well are many in a sorter; the number of tasks follows the rows instead.
    """
    return staged.repartition(tasks_for(staged.count()), *keys)
