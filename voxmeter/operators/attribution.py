"""Why results differ: causes of changes between repeated runs, and signals fused under a sealed hold-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmeter.operators.windows import cumulative

# Causes of changes between runs with what to do about them, in the order in which they are told.
CAUSES = [
    ("R1_gpu_nondeterminism", "use_deterministic_algorithms"),
    ("R2_batch_mismatch", "submit_batch1_dev_caveat"),
    ("R5_numeric_boundary", "archive_holdout_reject"),
    ("R3_input_generalization", "archive_external_training"),
    ("R4_voice_locking", "archive_enroll_augment_holdout"),
]
# The run that others are held against, the one of single batches, and the one with more enrollments.
BASELINE, SINGLE, MORE_ENROLLMENTS = "A_s42_r0", "B1_b1_r0", "B4_auguon"


def root_causes(runs: DataFrame, uid: str, run: str, said: str) -> DataFrame:
    """uid, causes, fixes, n_runs, n_distinct of each row whose transcripts tell a cause of change.

    A run's kind is its name up to the first underscore. Runs of one kind that differ among themselves tell R1 (A) or R5 (B2);
    a run that differs from the baseline tells R2 (single batches), R3 (any of B3 that said something) or R4. One row for each
    uid and run; a null transcript is empty, and without a baseline only R1 and R5 can be told. A uid has as many transcripts
    as there are runs, so they meet in one group.
    """
    kind, told = F.split(F.col(run), "_")[0], F.coalesce(F.col(said), F.lit(""))
    of = lambda name: F.max(F.when(F.col(run) == name, told))
    each = runs.groupBy(uid).agg(
        F.countDistinct(F.when(kind == "A", told)).alias("a"), F.countDistinct(F.when(kind == "B2", told)).alias("b2"), of(BASELINE).alias("base"), of(SINGLE).alias("one"),
        of(MORE_ENROLLMENTS).alias("more"), F.collect_set(F.when(kind == "B3", told)).alias("b3"), F.count(F.lit(1)).alias("n_runs"), F.countDistinct(told).alias("n_distinct"))
    base = F.coalesce("base", F.lit(""))
    other = lambda c: (base != "") & (F.coalesce(c, F.lit("")) != "") & (F.coalesce(c, F.lit("")) != base)
    holds = [F.col("a") > 1, other(F.col("one")), F.col("b2") > 1, F.exists("b3", other), other(F.col("more"))]
    picked = lambda k: F.filter(F.array(*[F.when(h, F.lit(c[k])) for h, c in zip(holds, CAUSES, strict=True)]), lambda x: x.isNotNull())
    return each.select(uid, picked(0).alias("causes"), picked(1).alias("fixes"), "n_runs", "n_distinct").where(F.size("causes") > 0)


def volatility_by_kind(runs: DataFrame, uid: str, run: str, said: str) -> DataFrame:
    """kind, n_runs, total, volatile, rate: of the uids that a kind of runs has, those whose transcripts differ within it."""
    told = runs.select(uid, F.split(F.col(run), "_")[0].alias("kind"), F.col(run).alias("_run"), F.coalesce(F.col(said), F.lit("")).alias("_said"))
    each = told.groupBy("kind", uid).agg((F.countDistinct("_said") > 1).alias("v"))
    names = told.groupBy("kind").agg(F.countDistinct("_run").alias("n_runs"))
    # A row for each kind of runs.
    rates = each.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("v").cast("long")).alias("volatile"))
    return names.join(rates, "kind").select("kind", "n_runs", "total", "volatile", (F.col("volatile") / F.col("total")).alias("rate"))


def _net(cost: Column, held: Column, base_cost: Column, base_held: Column, n_pos: Column, n_neg: Column) -> tuple[Column, Column, Column]:
    """Gains of positives' rate and of negatives' rejection over the base, and half of both together."""
    d_cer = (base_cost - cost) / F.nullif(n_pos.cast("double"), F.lit(0.0))
    d_rr = (held - base_held) / F.nullif(n_neg.cast("double"), F.lit(0.0))
    return d_cer, d_rr, 0.5 * d_cer + 0.5 * d_rr


def sealed_fusion(df: DataFrame, signals: list[str], positive: str, cost: str, rejected: str, fold: str, k: int) -> DataFrame:
    """fold, thr, train_net, d_cer, d_rr, net, recovered, precision: several signals fused and judged on folds they never saw.

    For each of k folds everything is fitted on the others alone: each signal's mean and deviation, its weight 2 AUC - 1, and
    the threshold from which the weighted sum of z-scores accepts a row (the best net gain, then the smallest). The sealed fold
    is scored once with them. A positive that is accepted costs its `cost`, any other 1; a negative should be rejected; the
    base is what `rejected` says. Signals that are null add nothing. AUC and the sweep come from cumulative sums within folds,
    over ranges of values: no task holds a fold, and no pairs are formed. precision is that of rows that the base rejected.
    """
    y, c, low = F.col(positive), F.col(cost), F.col(rejected)
    rows = df.select(F.col(fold).alias("_f"), y.alias("_y"), c.cast("double").alias("_c"), low.alias("_low"), *[F.col(s).cast("double").alias(f"_s{i}") for i, s in enumerate(signals)])
    turns = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k")
    train = rows.select("*", turns).where("_f <> k")
    long = train.select("k", "_y", F.inline(F.array(*[F.struct(F.lit(i).alias("signal"), F.col(f"_s{i}").alias("v")) for i in range(len(signals))]))).where("v is not null")
    told = cumulative(long, "v", {"p": F.sum(F.when(F.col("_y"), 1).otherwise(0)), "q": F.sum(F.when(F.col("_y"), 0).otherwise(1))}, within=("k", "signal"))
    auc = F.sum(F.col("p") * (F.col("q_upto") - F.col("q") / 2.0)) / F.nullif((F.sum("p") * F.sum("q")).cast("double"), F.lit(0.0))
    weights = told.groupBy("k", "signal").agg((2 * F.coalesce(auc, F.lit(0.5)) - 1).alias("w"))
    fits = long.groupBy("k", "signal").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).join(weights, ["k", "signal"])
    # A row for each fold, with as many entries as signals.
    fits = fits.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("signal", F.struct("m", "s", "w")))).alias("fit"))
    scored = rows.select("*", turns).join(F.broadcast(fits), "k")
    part = lambda i: F.coalesce((F.col(f"_s{i}") - F.col("fit")[i]["m"]) / F.nullif(F.col("fit")[i]["s"], F.lit(0.0)) * F.col("fit")[i]["w"], F.lit(0.0))
    scored = scored.select("k", "_f", "_y", "_c", "_low", F.round(reduce(lambda a, b: a + b, [part(i) for i in range(len(signals))]), 9).alias("score"))
    seen = scored.where("_f <> k")
    base = seen.groupBy("k").agg(
        F.sum(F.col("_y").cast("long")).alias("n_pos"), F.sum((~F.col("_y")).cast("long")).alias("n_neg"), F.sum(F.when(F.col("_y"), F.when(F.col("_low"), 1.0).otherwise(F.col("_c")))).alias("b_cost"), F.sum((~F.col("_y") & F.col("_low")).cast("long")).alias("b_held"))
    sweep = cumulative(seen, "score", {"g": F.sum(F.when(F.col("_y"), 1.0 - F.col("_c")).otherwise(0.0)), "q": F.sum((~F.col("_y")).cast("long"))}, descending=True, within=("k",)).join(F.broadcast(base), "k")
    net = _net(F.col("n_pos") - F.col("g_upto"), F.col("n_neg") - F.col("q_upto"), F.col("b_cost"), F.col("b_held"), F.col("n_pos"), F.col("n_neg"))[2]
    best = sweep.groupBy("k").agg(F.max_by(F.struct(F.col("score").alias("thr"), net.alias("train_net")), F.struct(F.round(net, 9), -F.col("score"))).alias("b")).select("k", "b.*")
    ok, yes = F.col("score") >= F.col("thr"), F.col("_y")
    held = scored.where("_f = k").join(F.broadcast(best), "k").groupBy("k", "thr", "train_net").agg(
        F.sum(F.when(yes, F.when(ok, F.col("_c")).otherwise(1.0))).alias("cost"), F.sum((~yes & ~ok).cast("long")).alias("held"), F.sum(F.when(yes, F.when(F.col("_low"), 1.0).otherwise(F.col("_c")))).alias("b_cost"),
        F.sum((~yes & F.col("_low")).cast("long")).alias("b_held"), F.sum(yes.cast("long")).alias("n_pos"), F.sum((~yes).cast("long")).alias("n_neg"), F.sum((ok & F.col("_low")).cast("long")).alias("recovered"), F.sum((ok & F.col("_low") & yes).cast("long")).alias("right"))
    d_cer, d_rr, net = _net(F.col("cost"), F.col("held"), F.col("b_cost"), F.col("b_held"), F.col("n_pos"), F.col("n_neg"))
    return held.select(F.col("k").alias("fold"), "thr", "train_net", d_cer.alias("d_cer"), d_rr.alias("d_rr"), net.alias("net"), "recovered", (F.col("right") / F.nullif(F.col("recovered"), F.lit(0))).alias("precision"))
