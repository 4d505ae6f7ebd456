"""Streams of events: windows and sessions. Totals that go on in later runs are in `accumulate`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmeter.sources.session import shared_dir


def source(spark: SparkSession, path: str) -> DataFrame:
    """A table of files as a stream; a table that is one file is found in its folder by name."""
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 4)
    folder, _, name = path.rstrip("/").rpartition("/")
    # A table that is one file is its own only input; the listing of a folder isn't asked for.
    if table.select("_metadata.file_path").limit(1).where(F.col("file_path").endswith(f"/{name}")).count():
        return stream.option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder)
    return stream.parquet(path)


def windowed(spark: SparkSession, path: str, size: str, late: str = "60 days") -> DataFrame:
    """start, event_type, n, total of tumbling windows, after all input that is there has run through the stream.

    Each trigger writes the windows that it changed; of a window's rows the last one counts. The watermark bounds the state.
    """
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    counted = source(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    rows = counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    told = spark.read.schema("start timestamp, event_type string, n long, total double, batch int").parquet(out)
    return told.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("l")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "l.n", "l.total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start, end, n: sessions that end after a gap; for streams and tables alike."""
    told = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return told.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
