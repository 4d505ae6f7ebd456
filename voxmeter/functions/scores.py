"""Decisions and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def linear_drop(v: Column, full_at: float, zero_at: float, full: float) -> Column:
    """Full score up to one value, none from another on, a line between."""
    return F.when(v <= full_at, F.lit(full)).when(v >= zero_at, F.lit(0.0)).otherwise(full * (zero_at - v) / (zero_at - full_at))


def steps(v: Column, full: float) -> Column:
    """All, 70 %, 40 % or nothing of the score, by bounds 0.5, 1 and 2."""
    return F.when(v < 0.5, F.lit(full)).when(v < 1.0, F.lit(0.7 * full)).when(v < 2.0, F.lit(0.4 * full)).otherwise(F.lit(0.0))


def decide_reject(sim: Column, verdict: Column, strategy: str, threshold: float | Column, use_verdict: bool = True, gate: Column | None = None) -> Column:
    """Whether a row is rejected. sim_only: below the threshold; llm_only: not accepted; llm_or_sim: both at once.

    With a gate, a row that passes the threshold but isn't a command is rejected too.
    """
    low, no = sim < threshold, F.coalesce(verdict != "accept", F.lit(True))
    base = low if not use_verdict or strategy == "sim_only" else no if strategy == "llm_only" else no & low
    return base if gate is None else base | (~low & ~gate)


def fuse(verdict: Column, sim: Column, ratio: Column, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), sim_at: float = 0.5, ratio_at: float = 0.1) -> Column:
    """Weighted accept score of three signals; a missing one says no."""
    parts = (verdict == "accept", sim >= sim_at, ratio >= ratio_at)
    return sum((w * F.coalesce(p, F.lit(False)).cast("double") for w, p in zip(weights, parts, strict=True)), F.lit(0.0))


def noise_class(flatness: Column, low_high: Column, babble: float = 0.06, pink: float = 0.18) -> Column:
    """babble, pink or white, and the attenuation that goes with it."""
    kind = F.when(flatness < babble, "babble").when((flatness < pink) & (low_high > 3.0), "pink").otherwise("white")
    return F.struct(kind.alias("noise"), F.when(kind == "pink", 6).otherwise(0).alias("atten"))


def reasons(**rules: Column) -> Column:
    """The names of the rules that hold, in order; a null rule doesn't."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())


def failure_mode(rate: Column, overlap: Column, hyp_len: Column, ref_len: Column, wrong_target: Column) -> Column:
    """Why a row failed, by ordered rules."""
    return (
        F.when(rate < 0.2, "M0_fine").when(hyp_len <= 1, "M5_empty").when(F.coalesce(wrong_target, F.lit(False)), "M2_wrong_target")
        .when((hyp_len <= 2) & (ref_len >= 3), "M3_cut")
        .when((overlap < 0.3) & (rate >= 0.8), F.when(hyp_len >= ref_len * 1.5, "M1a_loop").otherwise("M1b_words"))
        .when((overlap >= 0.5) & (rate < 0.8), "M4_near").when(overlap < 0.5, "M1b_words").otherwise("M4_near")
    )


def tier(rate: Column) -> Column:
    """Five tiers of an error rate."""
    return F.when(rate <= 0, "0_perfect").when(rate <= 0.2, "1_small").when(rate <= 0.5, "2_middle").when(rate <= 1.0, "3_large").otherwise("4_blown")


def bucket(v: Column, bounds: list[float]) -> Column:
    """Index of the half-open interval [b0, b1), [b1, b2) ... that holds the value; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(bounds) - 2, -1, -1):
        out = F.when((v >= bounds[i]) & (v < bounds[i + 1]), F.lit(i)).otherwise(out)
    return out


def active(tags: Column, note: Column) -> Column:
    """Whether an annotated row says anything: a tag, or a note that isn't blank."""
    return (F.coalesce(F.size(tags), F.lit(0)) > 0) | (F.trim(F.coalesce(note, F.lit(""))) != "")


def holds_marker(value: Column, marker: str) -> Column:
    """Whether a struct, array or map holds the marker anywhere, in names or values."""
    return F.contains(F.to_json(value), F.lit(marker))


def nested_strings(value: Column, kind: T.DataType) -> Column:
    """All strings in a nested value, in order; nulls are left out."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        out = F.array(value)
    elif isinstance(kind, T.StructType):
        out = F.concat(none, *[nested_strings(value[f.name], f.dataType) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        out = F.flatten(F.transform(value, lambda x: nested_strings(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        out = F.concat(nested_strings(F.map_keys(value), T.ArrayType(kind.keyType)), nested_strings(F.map_values(value), T.ArrayType(kind.valueType)))
    else:
        out = none
    return F.filter(F.coalesce(out, none), lambda x: x.isNotNull())


def break_even(positives: Column, negatives: Column) -> Column:
    """The least precision at which taking rows back pays, by the weights of both sides."""
    return 1 / (1 + 0.9 * negatives / positives)


# What limits a bucket: too few rows, the audio, the recognizer, rather the recognizer, neither clearly.
BOTTLENECKS = ["样本少", "切片瓶颈", "转写器瓶颈", "偏转写器", "混合/两难"]


def bottleneck(strong: Column, base: Column, n: Column) -> Column:
    """From mean rates of a strong and a base system."""
    few, audio, recognizer, rather, mixed = map(F.lit, BOTTLENECKS)
    far = base - strong > 0.15
    return F.when(n < 10, few).when(strong > 0.5, audio).when(far, F.when(strong < 0.3, recognizer).otherwise(rather)).otherwise(mixed)
