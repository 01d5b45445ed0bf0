"""Session helpers: nothing here overrides what a cluster already configured."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "aislegraph") -> SparkSession:
    """A local session for tests and benchmarks. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small local inputs would otherwise coalesce into one task on one core.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; a temporary one
    is only created for a local master that names none (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Shuffle files and checkpoints of frames that nothing refers to any more go now, not when the
    driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as files in a new shared folder. They survive the loss of any executor like a checkpoint, whose
    rows are neither compressed nor by column and take several times the disk. The shuffles that made them go."""
    folder = shared_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    release(frame.sparkSession)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def reuse(frame: DataFrame) -> DataFrame:
    """Keep a frame that several branches of one job read (recomputable on loss)."""
    return frame.persist(StorageLevel.MEMORY_AND_DISK)


def by_sorting(frame: DataFrame) -> DataFrame:
    """``frame``, joined by sorting only. Spark takes what is exploded or kept compressed for as small as the files it
    comes from, and would build it whole on the driver to broadcast it."""
    return frame.hint("merge")


def worked_out(rows: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, each of these worked out once a row. Filters and projections that read them
    later are not merged with their expressions, since they come out of a generated row."""
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return rows.select(*keep, F.inline(F.array(made)))
