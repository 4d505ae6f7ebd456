"""Long signals in blocks: convolution by overlap-add, babble from a pool of voices, and seeded perturbations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmeter.functions.hashing import unit_hash


def in_blocks(samples: DataFrame, key: str, at: str, value: str, size: int) -> DataFrame:
    """key, block, x: samples (at from 0, value) as arrays of `size`; places without a sample are silent."""
    place = F.struct((F.col(at) % size).cast("int").alias("i"), F.col(value).cast("double").alias("v"))
    held = samples.groupBy(key, F.floor(F.col(at) / size).cast("long").alias("block")).agg(F.map_from_entries(F.collect_list(place)).alias("m"))
    return held.select(key, "block", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x"))


def convolved(blocks: DataFrame, key: str, response: list[float], size: int) -> DataFrame:
    """key, block, x: blocks of a signal in a room of the impulse response, in full length, tail and all.

    Each block is convolved by itself; what reaches past its end is added to the blocks after it, so a signal of any length
    is many small tasks, and no task holds one. Blocks that are missing are silent.
    """
    h = np.asarray(response, float)
    if not len(h):
        raise ValueError("the impulse response is empty")
    kind = blocks.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 1 << (size + len(h) - 2).bit_length() if size + len(h) > 2 else 1
        spectrum = np.fft.rfft(h, width)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.zeros((n, size))
            edges, flat = batch.column(2).offsets.to_numpy(), np.asarray(batch.column(2).values)
            for r in range(n):
                own = flat[edges[r] : edges[r + 1]][:size]
                x[r, : len(own)] = own
            y = np.fft.irfft(np.fft.rfft(x, width, axis=1) * spectrum, width, axis=1)[:, : size + len(h) - 1]
            parts = -(-y.shape[1] // size)
            y = np.pad(y, ((0, 0), (0, parts * size - y.shape[1]))).reshape(n * parts, size)
            block = (batch.column(1).to_numpy()[:, None] + np.arange(parts)).reshape(-1)
            rows = batch.column(0).take(pa.array(np.repeat(np.arange(n), parts)))
            yield pa.RecordBatch.from_arrays([rows, pa.array(block), pa.ListArray.from_arrays(pa.array(np.arange(n * parts + 1, dtype=np.int32) * size), pa.array(y.reshape(-1)))], names=[key, "block", "x"])

    pieces = blocks.select(key, F.col("block").cast("long").alias("block"), F.col("x").cast("array<double>").alias("x")).mapInArrow(run, f"{key} {kind.simpleString()}, block long, x array<double>")
    # A block gets as many pieces as the response is blocks long, and one.
    added = pieces.groupBy(key, "block").agg(F.collect_list("x").alias("xs"))
    zero = F.array_repeat(F.lit(0.0), size)
    return added.select(key, "block", F.aggregate("xs", zero, lambda s, x: F.zip_with(s, x, lambda a, b: a + b)).alias("x"))


def babble(rows: DataFrame, key: str, pool: DataFrame, voice: str, n: int, voices: int = 4, seed: int = 0) -> DataFrame:
    """key, x: n samples of several voices of a pool at once, their mean; each row's voices follow from its key and the seed.

    pool: place (from 1, without gaps) and an array of samples. Short voices begin again, empty ones are left out; a pool of
    fewer voices gives all it has. Each row meets its own voices by their places, no others.
    """
    usable = pool.where(F.size(voice) > 0).select("place", voice)
    count = usable.agg(F.count(F.lit(1)).alias("_n"))
    picked = rows.select(key).crossJoin(F.broadcast(count)).where("_n > 0")
    begin = F.floor(unit_hash(F.col(key).cast("string"), seed=seed) * F.col("_n")).cast("long")
    picked = picked.select(key, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(voices).cast("long"), F.col("_n")) - 1)).alias("_j"), begin.alias("_b"))
    picked = picked.select(key, F.least(F.lit(voices).cast("long"), F.col("_n")).alias("_k"), ((F.col("_b") + F.col("_j")) % F.col("_n") + 1).alias("place"))
    met = picked.join(usable, "place").select(key, "_k", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(voice, i % F.size(voice)).cast("double") / F.col("_k")).alias("x"))
    zero = F.array_repeat(F.lit(0.0), n)
    return met.groupBy(key).agg(F.collect_list("x").alias("xs")).select(key, F.aggregate("xs", zero, lambda s, x: F.zip_with(s, x, lambda a, b: a + b)).alias("x"))


def louder(c: Column, db: float = 1.0) -> Column:
    """The signal so many decibels louder: whether a system minds the level."""
    return F.transform(c, lambda x: x.cast("double") * 10 ** (db / 20))


def later(c: Column, rate: int, seconds: float = 0.020) -> Column:
    """The signal after so much silence, as long as before: whether a system minds the alignment."""
    shift = int(seconds * rate)
    size = F.size(c)
    return F.slice(F.concat(F.array_repeat(F.lit(0.0), shift), c.cast("array<double>")), F.lit(1), size)


def hissing(c: Column, seed: Column, db: float = -45.0) -> Column:
    """The signal with Gaussian noise of so many decibels under full scale, the same for a seed: two uniform hashes a sample."""
    low = lambda i, k: (F.pmod(F.xxhash64(seed, i, F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    noise = lambda i: F.sqrt(-2 * F.log(low(i, 0))) * F.cos(2 * 3.141592653589793 * low(i, 1))
    return F.transform(c, lambda x, i: x.cast("double") + noise(i) * 10 ** (db / 20))
