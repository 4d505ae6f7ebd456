"""Average-linkage clusters of vectors by cosine distance, for recordings of any size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.operators.aggregates import count_if
from voxmeter.sources.session import written

#: Vectors of a recording that one task clusters; a larger recording goes in rounds over blocks of so many.
LARGE, BLOCK = 4096, 1024
#: Cosines that a task holds at a time.
CELLS = 1 << 22


def merged(sums: np.ndarray, size: np.ndarray, cutoff: float) -> np.ndarray:
    """A label for each group (sum and number of its unit vectors), the smallest row in its cluster: average linkage below the cutoff.

    The mean cosine between two groups is the product of their mean vectors, so groups are sums and counts. A round merges all
    mutual nearest neighbours; no group comes nearer to a merged one than to the nearer of its two parts, so only the
    merged groups, and those whose neighbour merged, look for a neighbour again, and a group without one stays as it is.
    """
    sums, size = sums.copy(), np.array(size, float)
    up, alive, mean = np.arange(len(sums)), np.ones(len(sums), bool), sums / size[:, None]
    near, who = np.full(len(sums), -np.inf), np.zeros(len(sums), int)
    todo = live = np.flatnonzero(np.isfinite(mean).all(axis=1))
    while len(live) > 1:
        held, rows = mean[live], max(1, CELLS // len(live))
        for some in np.split(todo, range(rows, len(todo), rows)):
            s = mean[some] @ held.T
            s[np.arange(len(some)), np.searchsorted(live, some)] = -np.inf
            best = s.argmax(axis=1)
            near[some], who[some] = s[np.arange(len(some)), best], live[best]
        alive[live[~(1 - near[live] < cutoff)]] = False
        live = live[alive[live]]
        found = live[alive[who[live]]]
        a = found[(who[who[found]] == found) & (found < who[found])]
        # Rounding may leave a ring of almost equal neighbours: then the nearest pair merges.
        if not len(a) and len(found):
            top = found[near[found].argmax()]
            a = np.array([min(top, who[top])])
            who[a] = max(top, who[top])
        b = who[a]
        sums[a] += sums[b]
        size[a] += size[b]
        mean[a] = sums[a] / size[a][:, None]
        up[b], alive[b] = a, False
        live = live[alive[live]]
        changed = ~alive
        changed[a] = True
        todo = live[changed[live] | changed[who[live]]]
    while (up[up] != up).any():
        up = up[up]
    return up


def linked(x: np.ndarray, cutoff: float) -> np.ndarray:
    """A label for each unit vector: average linkage, merges below the cutoff."""
    return merged(x, np.ones(len(x)), cutoff)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _in_one(pdf: pd.DataFrame, rec: str, id_col: str, cutoff: float) -> pd.DataFrame:
    pdf = pdf.sort_values(id_col, kind="stable", ignore_index=True)
    label = linked(_units(np.stack([np.asarray(v, float) for v in pdf["_v"]])), cutoff)
    return pd.DataFrame({rec: pdf[rec], id_col: pdf[id_col], "cluster": pdf[id_col].to_numpy()[label]})


def _rest(pdf: pd.DataFrame, cutoff: float) -> pd.DataFrame:
    """What the groups that rounds have left of a recording come to: group (id), into."""
    pdf = pdf.sort_values("id", kind="stable", ignore_index=True)
    label = merged(np.stack([np.asarray(s, float) for s in pdf["s"]]), pdf["n"].to_numpy(), cutoff)
    return pd.DataFrame({"rec": pdf["rec"], "id": pdf["id"], "into": pdf["id"].to_numpy()[label]})


def _block(lists: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and mean vectors of a block, without a Python object for each number."""
    held = lists[i].values
    ids, m = held.field("id").to_numpy(zero_copy_only=False), held.field("m").flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)
    order = ids.argsort()
    return ids[order], m[order]


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks of groups (ids and mean vectors of both sides) -> each group's nearest one of the other side."""
    for batch in batches:
        rec, a, b, both = (batch.column(c) for c in ("rec", "a", "b", "both"))
        for i in range(batch.num_rows):
            (ia, xa), (ib, xb) = _block(a, i), _block(b, i)
            s = xa @ xb.T
            _, mine, other = np.intersect1d(ia, ib, assume_unique=True, return_indices=True)
            s[mine, other] = -np.inf
            s[~np.isfinite(xa).all(axis=1)] = s[:, ~np.isfinite(xb).all(axis=1)] = -np.inf
            for mine, other, near in ((ia, ib, s), (ib, ia, s.T))[: 2 if both[i].as_py() else 1]:
                # Of equal ones the first, which has the smallest id: the same pair for both.
                at = near.argmax(axis=1)
                best = near[np.arange(len(at)), at]
                some = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array([rec[i].as_py()] * int(some.sum()), rec.type), pa.array(mine[some]), pa.array(best[some]), pa.array(other[at[some]])], names=["rec", "id", "sim", "other"])


def _neighbours(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """rec, id, sim, other: the nearest group of each group to do. Pairs of blocks are compared in tasks of their own: blocks of
    groups to do with one another, once for both sides, and with blocks of the rest."""
    kind = groups.schema["rec"].dataType.simpleString()
    parts = counts.where("todo > 0").select("rec", F.ceil(F.col("todo") / BLOCK).cast("int").alias("ps"), F.ceil((F.col("n") - F.col("todo")) / BLOCK).cast("int").alias("qs"))
    part = F.when(F.col("todo"), F.pmod(F.xxhash64("id"), "ps")).otherwise(F.col("ps") + F.pmod(F.xxhash64("id"), "qs")).cast("int")
    mean = groups.join(parts, "rec").select("rec", "todo", "ps", "qs", part.alias("part"), F.struct("id", F.transform("s", lambda x: x / F.col("n")).alias("m")).alias("x"))
    left = mean.where("todo").select("rec", "ps", F.col("part").alias("p"), F.explode(F.sequence(F.col("part"), F.col("ps") + F.col("qs") - 1)).alias("q"), "x", F.lit(True).alias("side"))
    right = mean.select("rec", "ps", F.explode(F.sequence(F.lit(0), F.least(F.col("part"), F.col("ps") - 1))).alias("p"), F.col("part").alias("q"), "x", F.lit(False).alias("side"))
    item = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("x")))
    blocks = left.unionByName(right).groupBy("rec", "ps", "p", "q").agg(item(True).alias("a"), item(False).alias("b"))
    near = blocks.where("size(a) > 0 and size(b) > 0").select("rec", "a", "b", (F.col("q") < F.col("ps")).alias("both")).mapInArrow(_nearest, f"rec {kind}, id long, sim double, other long")
    return near.groupBy("rec", "id").agg(F.max_by(F.struct("sim", "other"), F.struct("sim", -F.col("other"))).alias("b")).select("rec", "id", "b.*")


def _in_rounds(rows: DataFrame, cutoff: float, large: int) -> DataFrame:
    """rec, id, cluster of unit vectors (rec, id, v): rounds that merge every pair of mutual nearest neighbours below the cutoff.

    Such pairs stay nearest until they merge, so the rounds end with the same groups as one merge at a time. Equal vectors
    are one group from the start. As in merged(), a round looks for neighbours only of groups that are new or whose neighbour
    merged, and a group without one below the cutoff leaves for good; as soon as `large` groups of a recording or fewer are left,
    they end in one task.
    """
    rows = written(rows, "vectors")
    # What equals nothing, itself included, stays on its own: vectors without length or with numbers that are none.
    sound = F.coalesce(F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.lit(cutoff > 0)
    halves = F.array(F.shiftright("id", 32).cast("double"), F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"))
    keyed = rows.withColumn("k", F.when(sound, F.col("v")).otherwise(F.concat("v", halves)))
    same = written(keyed.groupBy("rec", F.size("v").alias("d"), "k").agg(F.min("id").alias("first"), F.count(F.lit(1)).cast("double").alias("n")), "groups")
    copies = same.where("n > 1").select("rec", "k", "first")
    label = written(keyed.join(copies, ["rec", "k"], "left").select("rec", "id", F.coalesce("first", "id").alias("cluster")), "labels")
    groups = same.select("rec", F.col("first").alias("id"), F.transform(F.slice("k", F.lit(1), F.col("d")), lambda x: x * F.col("n")).alias("s"), "n", F.lit(True).alias("todo"), F.lit(None).cast("double").alias("sim"), F.lit(None).cast("long").alias("other"))
    kept = []
    while True:
        counts = written(groups.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("todo")).alias("todo")), "counts")
        wide = counts.where(F.col("n") > large)
        kept.append(groups.join(counts.where(F.col("n") <= large).select("rec"), "rec", "left_semi").select("rec", "id", "s", "n"))
        if wide.isEmpty():
            break
        groups = groups.join(wide.select("rec"), "rec", "left_semi")
        best = _neighbours(groups, wide).select("rec", "id", F.struct("sim", "other").alias("b"))
        met = groups.join(best, ["rec", "id"], "left").withColumns({c: F.when(F.col("todo"), F.col(f"b.{c}")).otherwise(F.col(c)) for c in ("sim", "other")})
        met = written(met.select("rec", "id", "s", "n", "sim", "other").where(1 - F.col("sim") < cutoff), "nearest")
        pair = met.select("rec", "id", "other", "sim").join(met.select("rec", F.col("id").alias("other"), F.col("other").alias("back")), ["rec", "other"])
        mutual = written(pair.where("id = back and id > other").select("rec", "id", F.col("other").alias("into")), "merged")
        if mutual.isEmpty():
            # Rounding may leave a ring of almost equal neighbours: then the nearest pair merges.
            top = pair.groupBy("rec").agg(F.max_by(F.struct("id", "other"), F.struct("sim", "id")).alias("t"))
            mutual = written(top.select("rec", F.greatest("t.id", "t.other").alias("id"), F.least("t.id", "t.other").alias("into")), "merged")
        part = met.join(mutual.unionByName(mutual.select("rec", F.col("into").alias("id"), "into")), ["rec", "id"], "left")
        # A neighbour that merged, or is gone, must be looked for again.
        gone = part.select("rec", F.col("id").alias("other"), F.col("into").isNotNull().alias("hit"))
        told = part.join(gone, ["rec", "other"], "left").select("rec", F.coalesce("into", "id").alias("id"), "s", "n", (F.col("into").isNotNull() | F.coalesce("hit", F.lit(True))).alias("todo"), "sim", "other")
        # Two rows at most come together.
        each = told.groupBy("rec", "id").agg(F.collect_list("s").alias("ss"), F.sum("n").alias("n"), F.bool_or("todo").alias("todo"), F.first("sim").alias("sim"), F.first("other").alias("other"))
        total = F.when(F.size("ss") == 1, F.col("ss")[0]).otherwise(F.zip_with(F.col("ss")[0], F.get("ss", F.lit(1)), lambda a, b: a + b))
        groups = written(each.select("rec", "id", total.alias("s"), "n", "todo", "sim", "other"), "groups")
        label = written(label.join(mutual.withColumnRenamed("id", "cluster"), ["rec", "cluster"], "left").select("rec", "id", F.coalesce("into", "cluster").alias("cluster")), "labels")
    kind = rows.schema["rec"].dataType.simpleString()
    rest = reduce(DataFrame.unionByName, kept).groupBy("rec").applyInPandas(lambda pdf: _rest(pdf, cutoff), f"rec {kind}, id long, into long")
    return label.join(rest.withColumnRenamed("id", "cluster"), ["rec", "cluster"], "left").select("rec", "id", F.coalesce("into", "cluster").alias("cluster"))


def clustered(df: DataFrame, rec: str, id_col: str, vector: str, cutoff: float, large: int | None = None) -> DataFrame:
    """rec, id, cluster (the smallest id in it): average-linkage clusters of each recording's vectors by cosine distance.

    Merges stop at the cutoff: two groups at exactly that distance stay apart. Ids are whole numbers, one row each. Recordings
    of up to `large` vectors are each a group of a task; larger ones are clustered in rounds over blocks, until `large` groups
    or fewer are left.
    """
    rows = df.where(F.col(vector).isNotNull()).select(rec, id_col, F.col(vector).cast("array<double>").alias("_v"))
    large = LARGE if large is None else large
    sizes = rows.groupBy(rec).agg(F.count(F.lit(1)).alias("_n"))
    wide = written(sizes.where(F.col("_n") > large).select(rec), "large")
    kind = f"{rec} {df.schema[rec].dataType.simpleString()}, {id_col} long, cluster long"
    few = rows.join(wide, rec, "left_anti").groupBy(rec).applyInPandas(lambda pdf: _in_one(pdf, rec, id_col, cutoff), kind)
    if wide.isEmpty():
        return few
    # The length of a vector is worked out before the loop over its numbers, not within it.
    norm = F.greatest(F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    unit = F.transform(F.array(norm), lambda n: F.transform("_v", lambda x: x / n))[0]
    many = rows.join(wide, rec, "left_semi").select(F.col(rec).alias("rec"), F.col(id_col).cast("long").alias("id"), unit.alias("v"))
    return few.unionByName(_in_rounds(many, cutoff, large).select(F.col("rec").alias(rec), F.col("id").alias(id_col), "cluster"))


def clusters(df: DataFrame, rec: str, id_col: str, vector: str, cutoff: float) -> DataFrame:
    """rec, n, clusters: how many vectors and clusters a recording has; two clusters or more tell a second voice."""
    told = clustered(df, rec, id_col, vector, cutoff)
    return told.groupBy(rec).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("clusters"))
