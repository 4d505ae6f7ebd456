"""Identities of the signal functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmeter.functions import signal


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(0)
    t = np.sin(np.arange(4000) * 0.05)
    rows = [(1, t.tolist(), t.tolist()), (2, t.tolist(), (t + 0.1 * rng.standard_normal(4000)).tolist()), (3, rng.standard_normal(4000).tolist(), t.tolist())]
    return spark.createDataFrame(rows, "id int, a array<double>, b array<double>").cache()


def of(df, c):  # values in the order of id
    return [r[0] for r in df.orderBy("id").select(c.alias("x")).collect()]


def test_levels(df):
    a = F.col("a")
    assert abs(of(df, signal.rms(a))[0] - 2**-0.5) < 1e-2
    assert abs(of(df, signal.peak(a))[0] - 1) < 1e-3
    assert all(of(df, signal.finite(a)))
    k = signal.noise_scale(a, F.col("b"), F.lit(6.0))
    ratio = of(df, signal.rms(a) / (signal.rms(F.col("b")) * k))
    assert all(abs(20 * np.log10(r) - 6) < 1e-6 for r in ratio)


def test_ratios_and_spectra(df):
    same, near, far = of(df, signal.si_snr(F.col("b"), F.col("a")))
    assert same > 60 > near > 10 > far
    d = of(df, signal.distortion(F.col("a"), F.col("b")))
    assert d[0]["log_mel"] == d[0]["convergence"] == 0
    assert d[0]["correlation"] > 0.999
    s = of(df, signal.spectral(F.col("a")))
    assert s[0]["flatness"] < 0.06 < s[2]["flatness"]


def test_shapes(df, spark):
    one = spark.range(1)
    x = F.array(*[F.lit(float(i)) for i in range(5)])
    assert of(one, signal.cyclic(x, F.lit(3), 4)) == [[3.0, 4.0, 0.0, 1.0]]
    assert of(one, signal.fit(x, 3))[0]["how"] == "crop"
    assert of(one, signal.fit(x, 7))[0]["x"] == [0.0, 1.0, 2.0, 3.0, 4.0, 0.0, 0.0]
    assert len(of(one, signal.crossfade(x, x, 2))[0]) == 8
    y = F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0, 0.0, 0.0)])
    assert of(one, signal.activity(y, 2)) == [[False, True, False]]
    assert of(one, signal.resize(F.array(F.lit(True), F.lit(False)), 4)) == [[True, True, False, False]]
    assert of(one, signal.convolve(y, F.array(F.lit(0.0), F.lit(2.0))))[0] == pytest.approx([0, 0, 0, 1, 1, 0], abs=1e-9)
    noise = of(one, signal.coloured_noise(F.lit(3), 64, "pink"))
    assert noise == of(one, signal.coloured_noise(F.lit(3), 64, "pink"))


