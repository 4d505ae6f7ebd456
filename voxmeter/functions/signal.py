"""Waveform functions over ARRAY<FLOAT> columns: plain expressions for sums, Arrow UDFs (numpy) for transforms."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmeter.functions.vectors import dot

EPS = 1e-12


def _sum(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + f(x.cast("double")))


def rms(c: Column) -> Column:
    """Root mean square; null for an empty signal."""
    return F.sqrt(_sum(c, lambda x: x * x) / F.nullif(F.size(c), F.lit(0)))


def peak(c: Column) -> Column:
    return F.array_max(F.transform(c, lambda x: F.abs(x.cast("double"))))


def clipped(c: Column, at: float = 0.999) -> Column:
    """Share of samples at full scale."""
    return _sum(c, lambda x: F.when(F.abs(x) >= at, 1.0).otherwise(0.0)) / F.nullif(F.size(c), F.lit(0))


def finite(c: Column) -> Column:
    return F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def gain(db: Column) -> Column:
    """Amplitude factor of decibels."""
    return F.pow(F.lit(10.0), db / 20)


def noise_scale(signal: Column, noise: Column, snr_db: Column) -> Column:
    """Factor for the noise that gives the ratio of signal to noise."""
    return rms(signal) / F.greatest(rms(noise), F.lit(EPS)) / gain(snr_db)


def mix(signal: Column, noise: Column, scale: Column) -> Column:
    """signal + scale * noise; the shorter one is taken as silent beyond its end."""
    return F.zip_with(signal, noise, lambda a, b: F.coalesce(a.cast("double"), F.lit(0.0)) + scale * F.coalesce(b.cast("double"), F.lit(0.0)))


def si_snr(estimate: Column, target: Column) -> Column:
    """Scale-invariant ratio in dB of signals of one length, without their means; null for a silent target."""
    n = F.nullif(F.size(target), F.lit(0))
    centre = lambda c: F.transform(c, lambda x: x.cast("double") - _sum(c, lambda y: y) / n)
    e, t = centre(estimate), centre(target)
    tt = dot(t, t)
    s = F.pow(dot(e, t), 2) / F.nullif(tt, F.lit(0.0))
    return 10 * F.log10((s + EPS) / (F.greatest(dot(e, e) - s, F.lit(0.0)) + EPS))


def cyclic(c: Column, start: Column, n: int) -> Column:
    """n samples from `start`, beginning again at the end."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(c, ((start + i) % F.size(c) + 1).cast("int")))


def fit(c: Column, n: int) -> Column:
    """Exactly n samples, and what was done: cropped, padded or kept."""
    size = F.size(c)
    out = F.when(size >= n, F.slice(c, 1, n)).otherwise(F.concat(c, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(n) - size, F.lit(0)))))
    return F.struct(out.alias("x"), F.when(size > n, "crop").when(size < n, "pad").otherwise("keep").alias("how"))


def crossfade(a: Column, b: Column, n: int) -> Column:
    """a then b, the last n samples of a fading into the first n of b."""
    head, tail = F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0))), F.slice(b, n + 1, F.greatest(F.size(b) - n, F.lit(1)))
    fade = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(a, F.size(a) - n + 1 + i).cast("double") * (1 - (i + 1) / (n + 1)) + F.element_at(b, i + 1).cast("double") * (i + 1) / (n + 1))
    return F.concat(head.cast("array<double>"), fade, F.when(F.size(b) > n, tail).otherwise(F.array().cast("array<double>")).cast("array<double>"))


def _spectra(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    n = max(1, 1 + (len(x) - size) // hop)
    x = np.pad(x, (0, max(0, size + (n - 1) * hop - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:n] * np.hanning(size)
    return np.abs(np.fft.rfft(frames, axis=1))


def spectral(c: Column, rate: int = 16000, size: int = 512, hop: int = 256) -> Column:
    """struct<flatness, centroid, low_high>: geometric over arithmetic mean of the power, mean frequency, power below over above 1 kHz."""
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in ("flatness", "centroid", "low_high")])

    def one(v: np.ndarray | None) -> tuple:
        x = np.nan_to_num(np.asarray([] if v is None else v, float))
        if not len(x) or not np.abs(x).max() > 0:
            return (None, None, None)
        p = (_spectra(x, size, hop) ** 2).mean(axis=0) + EPS
        f = np.fft.rfftfreq(size, 1 / rate)
        return (float(np.exp(np.log(p).mean()) / p.mean()), float((f * p).sum() / p.sum()), float(p[f < 1000].sum() / p[f >= 1000].sum()))

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in s], columns=["flatness", "centroid", "low_high"])

    return run(c)


#: A frame of 32 ms and its step of 10 ms at 16 kHz, and the least samples of a signal that can be judged.
FRAME, STEP, LEAST_SAMPLES = 512, 160, 64
QUALITY = ("rms", "peak", "clipping_rate", "snr_est", "silence_ratio", "zero_crossing_rate", "high_freq_ratio", "spectral_centroid", "spectral_flatness")


def quality(c: Column, rate: int = 16000) -> Column:
    """struct of nine signals of a recording's quality; nulls for fewer than LEAST_SAMPLES samples.

    Level, peak, share of samples over 0.99; of the frames' levels the ninth decile over the first and the share under a tenth
    of the median; sign changes a second; and of the frames' power, each frame's mean: the share from 4 kHz on, the mean
    frequency, and geometric over arithmetic mean. A signal shorter than a frame is one frame, silent at its end.
    """
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in QUALITY])
    window, freqs = np.hanning(FRAME + 1)[:-1], np.fft.rfftfreq(FRAME, 1 / rate)

    def one(v: np.ndarray | None) -> tuple:
        x = np.asarray([] if v is None else v, float)
        if len(x) < LEAST_SAMPLES:
            return (None,) * len(QUALITY)
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::STEP] if len(x) >= FRAME else x[None]
        levels = np.sqrt((frames**2).mean(axis=1)) + EPS
        low, middle, high = np.percentile(levels, (10, 50, 90))
        crossed = (np.diff(np.sign(frames), axis=1) != 0).mean(axis=1) * rate / 2
        padded = np.pad(frames, ((0, 0), (0, FRAME - frames.shape[1])))
        power = np.abs(np.fft.rfft(padded * window, axis=1)) ** 2
        total, held = power.sum(axis=1) + EPS, np.maximum(power, EPS)
        flat = np.exp(np.log(held).mean(axis=1)) / (held.mean(axis=1) + EPS)
        told = (
            np.sqrt((x**2).mean()) + EPS, np.abs(x).max(), (np.abs(x) > 0.99).mean(), high / (low + EPS), (levels < 0.1 * middle).mean(), crossed.mean(),
            (power[:, freqs >= 4000].sum(axis=1) / total).mean(), ((power * freqs).sum(axis=1) / total).mean(), flat.mean(),
        )
        return tuple(float(t) for t in told)

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in s], columns=list(QUALITY))

    return run(c)


def target_slice(c: Column, segments: Column, rate: int, least: float = 0.3) -> Column:
    """A target's segments (start, end in seconds) joined, in order of time; the whole recording where they last less than `least`."""
    place = lambda x: F.floor(x * rate).cast("int")
    ordered = F.array_sort(F.transform(segments, lambda s: F.struct(s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end"))))
    cut = F.flatten(F.transform(ordered, lambda s: F.slice(c, place(s["start"]) + 1, F.greatest(place(s["end"]) - place(s["start"]), F.lit(0)))))
    return F.when(F.size(F.coalesce(cut, F.slice(c, 1, 0))) < rate * least, c).otherwise(cut)


def mel_bank(bands: int, size: int, rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)[None]
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((f - low) / np.maximum(mid - low, EPS), (high - f) / np.maximum(high - mid, EPS)), 0, None)


def distortion(raw: Column, enhanced: Column, rate: int = 16000, size: int = 512, hop: int = 256, bands: int = 40) -> Column:
    """struct<log_mel, convergence, correlation> between two signals of about one length; zeros for equal ones."""
    names = ("log_mel", "convergence", "correlation")
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    bank = mel_bank(bands, size, rate)

    def one(a: np.ndarray | None, b: np.ndarray | None) -> tuple:
        if a is None or b is None or not min(len(a), len(b)):
            return (None, None, None)
        n = min(len(a), len(b))
        x, y = np.asarray(a[:n], float), np.asarray(b[:n], float)
        p, q = _spectra(x, size, hop), _spectra(y, size, hop)
        mel = np.abs(np.log(p**2 @ bank.T + 1e-8) - np.log(q**2 @ bank.T + 1e-8)).mean()
        spread = np.std(x) * np.std(y)
        return (float(mel), float(np.linalg.norm(p - q) / max(np.linalg.norm(p), EPS)), float(((x - x.mean()) * (y - y.mean())).mean() / spread) if spread > 0 else None)

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x, y) for x, y in zip(a, b, strict=True)], columns=list(names))

    return run(raw, enhanced)


def activity(c: Column, hop: int, below_peak_db: float = 30.0) -> Column:
    """array<boolean>: frames of `hop` samples whose level is within so many dB of the loudest frame."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(c) - 1) / hop), F.lit(0)).cast("int"))
    levels = F.transform(starts, lambda i: F.coalesce(rms(F.slice(c, (i * hop + 1).cast("int"), F.lit(hop))), F.lit(0.0)))
    top = F.array_max(levels)
    return F.transform(levels, lambda v: (top > 0) & (v >= top * 10 ** (-below_peak_db / 20)))


def resize(mask: Column, n: int) -> Column:
    """A mask at another frame rate: the frame that holds each new frame's middle."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(mask, F.least((F.floor((i + 0.5) * F.size(mask) / n) + 1).cast("int"), F.size(mask))))


def coloured_noise(seed: Column, n: int, kind: str = "white") -> Column:
    """n samples of white or pink noise of unit deviation, the same for a seed."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            x = np.random.default_rng(int(v)).standard_normal(n)
            if kind == "pink":
                f = np.fft.rfft(x)
                f[1:] /= np.sqrt(np.arange(1, len(f)))
                f[0] = 0
                x = np.fft.irfft(f, n)
            out.append((x / max(x.std(), EPS)).tolist())
        return pd.Series(out)

    return run(seed)


def convolve(c: Column, response: Column) -> Column:
    """The signal in a room of the impulse response, as long as the signal and as loud at its peak."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, h in zip(a, b, strict=True):
            if x is None or h is None or not len(x) or not len(h):
                out.append(None if x is None else list(map(float, x)))
                continue
            size = 1 << (len(x) + len(h) - 2).bit_length()
            y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[: len(x)]
            out.append((y * (np.abs(x).max() / max(np.abs(y).max(), EPS))).tolist())
        return pd.Series(out)

    return run(c, response)
