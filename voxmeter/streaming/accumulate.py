"""Running totals over streams that stop and start again: an update, a reading and a reset, with all state at a named path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


class Accumulator:
    """Sums by key of everything that ever came through, whatever runs it came in.

    `update` takes the input that is new since the last run, also one that was killed: Spark's state store holds the sums, and
    its checkpoint says which input they include, both under `path`. A trigger writes the keys that it changed into a folder
    of its number, so a trigger that is run again after a loss writes the same folder again. `totals` reads each key's last
    row. Folders of triggers are put together every `compact` triggers, so reading doesn't grow with the number of runs.
    `reset` begins a new series of totals beside the old one. State grows with the number of keys only.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: dict[str, Column], compact: int = 64):
        self.spark, self.path, self.keys, self.sums, self.compact = spark, path.rstrip("/"), keys, sums, compact

    def _series(self) -> int:
        """The number of the present series: that of the resets so far."""
        store = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = store.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(store):
            return 0
        return sum(1 for f in files.listStatus(store) if f.getPath().getName().startswith("reset-"))

    def _folder(self, name: str) -> str:
        return f"{self.path}/series-{self._series()}/{name}"

    def _there(self, folder: str) -> list[str]:
        held = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = held.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(held):
            return []
        # A folder counts once its writer has finished.
        done = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(f.getPath().getName() for f in files.listStatus(held) if f.isDirectory() and done(f.getPath()))

    def update(self, stream: DataFrame) -> int:
        """Take in what is there and new; returns the number of triggers that it took."""
        folder, state = self._folder("changes"), self._folder("state")
        sums = stream.groupBy(*self.keys).agg(*(F.sum(c).alias(n) for n, c in self.sums.items()))

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("trigger", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/t{number:012d}")
            if number and number % self.compact == 0:
                # Everything up to the trigger before, in one folder; what it holds is skipped from then on.
                self._last(number - 1).write.mode("overwrite").parquet(f"{folder}/c{number - 1:012d}")

        run = sums.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
        return len(run.recentProgress)

    def _last(self, upto: int | None = None) -> DataFrame | None:
        """Each key's last row, with its trigger, from the newest put-together folder and the triggers after it."""
        folder = self._folder("changes")
        names = [n for n in self._there(folder) if upto is None or int(n[1:]) <= upto]
        base = max((int(n[1:]) for n in names if n[0] == "c"), default=-1)
        held = [f"{folder}/{n}" for n in names if (n[0] == "c" and int(n[1:]) == base) or (n[0] == "t" and int(n[1:]) > base)]
        if not held:
            return None
        rows = self.spark.read.parquet(*held)
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.sums, "trigger"), "trigger").alias("l"))
        return newest.select(*self.keys, "l.*")

    def totals(self, schema: T.StructType | str = "") -> DataFrame:
        """keys and sums so far; before any update an empty table of the schema."""
        held = self._last()
        return self.spark.createDataFrame([], schema) if held is None else held.select(*self.keys, *self.sums)

    def reset(self) -> None:
        """Begin again from nothing; the input is taken in anew by the next update."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/reset-{self._series()}")
        mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(mark)


def missing_runs(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The runs of a plan that have no output yet: what a resumed plan still has to do."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def changes(totals: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """keys, at, value, change: a total's growth from one reading to the next of the same keys."""
    by = Window.partitionBy(*keys).orderBy(at)
    return totals.select(*keys, at, value, (F.col(value) - F.coalesce(F.lag(value).over(by), F.lit(0))).alias("change"))
