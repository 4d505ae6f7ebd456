"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


#: Spark's own bound on an Arrow batch, and the smaller one that is set in its place: several batches are held at a time.
ARROW_DEFAULT, ARROW_BYTES = "67108864b", "4m"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; elsewhere it comes by --py-files.

    Arrow batches get a smaller bound, unless the session has set its own.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    # Without a second argument: with one, an unset bound reads as that, and not as Spark's own.
    if spark.conf.get(bound) == ARROW_DEFAULT:
        spark.conf.set(bound, ARROW_BYTES)
    held = spark.sparkContext.environment
    paths = [p for p in held.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        held["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one in local mode;
    on a cluster this raises, as no local folder is shared."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="voxmeter-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: iterations cut their lineage so, and lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: for rows that are few bytes but take long, as files are cut by bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def named_dir(spark: SparkSession, name: str) -> str:
    """A folder of this name that later runs find again: right under spark.checkpoint.dir, not in the application's own folder."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or shared_dir(spark)}/named/{name}"
