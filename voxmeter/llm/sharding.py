"""Sharding by a two-pass external shuffle, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.llm.common import byte_size, materialize

SHARDS, SEED, BUCKET_BYTES = 8, 20240601, 16 << 20
#: Prefix sums over buckets go through groups of so many, so that no single task gets a row for each bucket.
GROUP = 4096
#: Tasks of the second pass at most; beyond them a task takes several buckets, one after another.
MOST_TASKS = 1 << 15


def prefix_sums(counts: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, before: the sum of the values of smaller keys, by two levels of windows."""
    grouped = counts.withColumn("_g", F.floor(F.col(key) / GROUP))
    inner = Window.partitionBy("_g").orderBy(key)
    groups = grouped.groupBy("_g").agg(F.sum(value).alias("_n"))
    groups = groups.select("_g", (F.sum("_n").over(Window.orderBy("_g")) - F.col("_n")).alias("_base"))
    return grouped.withColumn("_in", F.sum(value).over(inner) - F.col(value)).join(groups, "_g").select(key, (F.col("_base") + F.col("_in")).alias("before"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of docs, with shard (int) and slot (long, gapless from 0 in the shard): a seeded global shuffle.

    Law `rows`: the shards' row counts are at most one apart. Pass 1 deals every row once, by a seeded hash of its id and
    its own number in the input, and writes it with that hash; so rows of one source, text or id, and equal rows, are spread
    alike, and the deal stays as it is even if the input would come in another order when read again. Pass 2 gathers buckets
    of about bucket_bytes (all columns counted), sorts each by another hash, and shuffles it by Fisher-Yates (Spark's
    shuffle()). A row's place in all buckets together, mod `shards`, is its shard, the quotient its slot. The outcome follows
    from the seed and the layout of the input. Columns of docs named shard or slot give way to the new ones. Null text has no
    bytes; null ids are hashed as nulls; an empty table gives no rows. A bucket holds no more than its share of rows plus one
    very long row.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(F.struct(*own).alias("row"), F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id()).alias("h"))
    dealt = materialize(rows, "dealt")
    total = dealt.agg(F.sum(byte_size(F.col("row"), dealt.schema["row"].dataType) + 32)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    keyed = dealt.select(F.pmod("h", F.lit(buckets)).alias("bucket"), F.xxhash64(F.lit(seed + 1), "h").alias("order"), "row")
    counts = dealt.groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    item = F.collect_list(F.struct("order", "row"))
    gathered = keyed.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").agg((F.array_sort(item) if _sortable(docs) else item).alias("rows"))
    shuffled = gathered.join(prefix_sums(counts, "bucket", "n"), "bucket").select("before", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("at", "item"))
    place = F.col("before") + F.col("at")
    return shuffled.select("item.row.*", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def _sortable(docs: DataFrame) -> bool:
    """Maps and variants have no order; with such a column the shuffle alone gives the order."""
    return not any(w in docs.schema.simpleString() for w in ("map<", "variant"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard, rows in slot order within each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
