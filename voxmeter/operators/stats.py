"""Statistics with ties done right, from cumulative counts; no pairs of rows are formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.operators.windows import cumulative, mean_ranks


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """auc, n_pos, n_neg: chance that a positive scores above a negative, ties a half; null with one class only."""
    y = F.col(positive)
    told = cumulative(df.where(y.isNotNull()), score, {"p": F.sum(F.when(y, 1).otherwise(0)), "q": F.sum(F.when(y, 0).otherwise(1))})
    wins = F.sum(F.col("p") * (F.col("q_upto") - F.col("q") / 2.0))
    p, q = F.sum("p"), F.sum("q")
    return told.agg((wins / F.nullif((p * q).cast("double"), F.lit(0.0))).alias("auc"), p.alias("n_pos"), q.alias("n_neg"))


def pr_curve(df: DataFrame, score: str, positive: str) -> DataFrame:
    """thr, tp, fp, precision, recall, f1 when rows with a score of thr or more are called positive, for each score."""
    y = F.col(positive)
    told = cumulative(df, score, {"p": F.sum(F.when(y, 1).otherwise(0)), "q": F.sum(F.when(y, 0).otherwise(1))}, descending=True)
    tp, fp = F.col("p_upto"), F.col("q_upto")
    recall = F.when(F.col("p_all") > 0, tp / F.col("p_all")).otherwise(0.0)
    return told.select(F.col(score).alias("thr"), tp.alias("tp"), fp.alias("fp"), (tp / (tp + fp)).alias("precision"), recall.alias("recall"), (2 * tp / (tp + fp + F.col("p_all"))).alias("f1"))


def curve_points(curve: DataFrame, least_tp: int = 10) -> DataFrame:
    """Best F1 with its threshold, highest precision with least_tp found, and highest precision at recall of a half."""
    enough, half = F.col("tp") >= least_tp, F.col("recall") >= 0.5
    return curve.agg(F.max("f1").alias("best_f1"), F.max_by("thr", F.struct("f1", "thr")).alias("best_f1_thr"), F.max(F.when(enough, F.col("precision"))).alias("p_max"), F.max(F.when(half, F.col("precision"))).alias("p_at_half"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho: correlation of mean ranks."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("_w"))
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx, ry = mean_ranks(rows, x, "_rx").select(x, "_rx"), mean_ranks(rows, y, "_ry").select(y, "_ry")
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    s = known.join(rx, x).join(ry, y).agg(F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    top = F.col("n") * F.col("ab") - F.col("a") * F.col("b")
    low = F.sqrt((F.col("n") * F.col("aa") - F.col("a") ** 2) * (F.col("n") * F.col("bb") - F.col("b") ** 2))
    return s.select((top / F.nullif(low, F.lit(0.0))).alias("rho"), "n")


def z_score(df: DataFrame, value: str, name: str) -> DataFrame:
    """Distance from the mean in population standard deviations; 0 where there is no deviation."""
    told = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.crossJoin(F.broadcast(told)).withColumn(name, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def _fit(sums: DataFrame, folds: list[str]) -> DataFrame:
    """Of cumulative sums by feature: the threshold with the fewest errors, then fewest accepted, then smallest."""
    return sums.groupBy(*folds).agg(F.min(F.struct("errors", "accepted", "thr")).alias("b")).select(*folds, "b.*")


def fit_threshold(df: DataFrame, feature: str, raw: str, enhanced: str) -> DataFrame:
    """thr, errors, accepted: rows with feature <= thr take the enhanced errors, others the raw ones; null takes raw."""
    e, r = F.col(enhanced), F.col(raw)
    total = df.agg(F.coalesce(F.sum(r), F.lit(0)).alias("base"))
    told = cumulative(df, feature, {"d": F.sum(e - r), "n": F.count(F.lit(1))})
    none = total.select(F.lit(float("-inf")).alias("thr"), F.col("base").alias("errors"), F.lit(0).cast("long").alias("accepted"))
    at = told.crossJoin(F.broadcast(total)).select(F.col(feature).alias("thr"), (F.col("base") + F.col("d_upto")).alias("errors"), F.col("n_upto").alias("accepted"))
    return _fit(none.unionByName(at), [])


def leave_one_out(df: DataFrame, group: str, feature: str, raw: str, enhanced: str) -> DataFrame:
    """group, thr, errors, accepted: the threshold fitted on all other groups, and this group's errors and accepted rows by it.

    All rows' cumulative sums by threshold, less the group's own, are each fold's errors. Between two of the group's own
    values its own sums stay, so the best threshold there is the best of all rows' sums: each such stretch is a few nodes of
    a binary tree of minima over the thresholds, and meets just these by equal keys. No group meets every threshold.
    """
    e, r = F.col(enhanced), F.col(raw)
    known = df.where(F.col(feature).isNotNull())
    total = df.agg(F.sum(r).alias("base"))
    own = df.groupBy(group).agg(F.sum(r).alias("own_base"))
    every = cumulative(known, feature, {"d": F.sum(e - r), "n": F.count(F.lit(1)), "k": F.max(F.lit(1).cast("long"))})
    # Thresholds are numbered from 0; a node of level l holds 2^l of them.
    every = every.select(F.col(feature).alias("thr"), (F.col("k_upto") - 1).alias("at"), F.col("k_all").alias("all"), F.col("n").alias("here"), F.struct(F.col("d_upto").alias("d"), F.col("n_upto").alias("n"), F.col(feature).alias("thr")).alias("best"))
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("all") + 1)).cast("int"))
    tree = every.select("best", "at", F.explode(levels).alias("level")).groupBy("level", F.expr("shiftright(at, level)").alias("node")).agg(F.min("best").alias("best"))
    mine = known.groupBy(group, F.col(feature).alias("thr")).agg(F.sum(e - r).alias("md"), F.count(F.lit(1)).alias("mn")).join(every.select("thr", "at", "all", "here"), "thr")
    by = Window.partitionBy(group).orderBy("at")
    # A value that only this group has is no candidate of its fold.
    stretch = F.struct(F.when(F.col("here") > F.col("mn"), F.col("at")).otherwise(F.col("at") + 1).alias("lo"), F.coalesce(F.lead("at").over(by), F.col("all")).alias("hi"), F.sum("md").over(by).alias("ud"), F.sum("mn").over(by).alias("un"))
    first = F.struct(F.lit(0).cast("long").alias("lo"), F.when(F.row_number().over(by) == 1, F.col("at")).otherwise(0).cast("long").alias("hi"), (F.sum("md").over(by) * 0).alias("ud"), (F.sum("mn").over(by) * 0).alias("un"))
    parts = mine.select(group, first.alias("_a"), stretch.alias("_b")).select(group, F.inline(F.array("_a", "_b")))
    alone = own.join(known.select(group).distinct(), group, "left_anti").crossJoin(F.broadcast(every.agg(F.max("all").alias("hi")))).where("hi is not null")
    parts = parts.unionByName(alone.select(group, F.lit(0).cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.lit(0).cast("long").alias("ud"), F.lit(0).cast("long").alias("un"))).where("lo < hi")

    def climb(a: Column, level: Column) -> Column:
        low, high = a["lo"], a["hi"]
        open_ = low < high
        left, right = open_ & (low % 2 == 1), open_ & (high % 2 == 1)
        node = lambda place: F.array(F.struct(level.alias("level"), place.alias("node")))
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        some = F.concat(a["nodes"], F.when(left, node(low)).otherwise(none), F.when(right & (high - 1 >= low + left.cast("long")), node(high - 1)).otherwise(none))
        lo, hi = F.floor((low + left.cast("long")) / 2), F.floor((high - right.cast("long")) / 2)
        return F.struct(lo.cast("long").alias("lo"), F.when(open_, hi).otherwise(lo).cast("long").alias("hi"), some.alias("nodes"))

    start = F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.array().cast("array<struct<level:int,node:bigint>>").alias("nodes"))
    nodes = F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, climb, lambda a: a["nodes"])
    met = parts.select(group, "ud", "un", F.inline(nodes)).join(tree, ["level", "node"])
    fold = met.join(own, group).crossJoin(F.broadcast(total)).select(group, F.col("best.thr").alias("thr"), (F.col("base") - F.col("own_base") + F.col("best.d") - F.col("ud")).alias("errors"), (F.col("best.n") - F.col("un")).alias("accepted"))
    none = own.crossJoin(F.broadcast(total)).select(group, F.lit(float("-inf")).alias("thr"), (F.col("base") - F.col("own_base")).alias("errors"), F.lit(0).cast("long").alias("accepted"))
    fits = _fit(fold.unionByName(none), [group]).select(group, "thr")
    return df.join(fits, group).groupBy(group, "thr").agg(F.sum(F.when(F.col(feature) <= F.col("thr"), e).otherwise(r)).alias("errors"), F.sum(F.when(F.col(feature) <= F.col("thr"), 1).otherwise(0)).alias("accepted"))


def bootstrap_threshold(df: DataFrame, key: str, sim: str, rate: str, negative: str, thresholds: DataFrame, replicates: int = 100, seed: int = 42) -> DataFrame:
    """replicate, thr: the best threshold of each bootstrap replicate (the smallest of equal ones), by Poisson weights of keys.

    Facts are summed by replicate and similarity first, so thresholds, a checked grid, meet those sums.
    """
    from voxmeter.operators.sweep import CER_LEG, REJECT_LEG

    pos, w, e = ~F.col(negative), F.col("w"), F.col(rate)
    facts = poisson_weights(df, key, replicates, seed).groupBy("replicate", F.col(sim).alias("s")).agg(
        F.sum(F.when(pos, w).otherwise(0)).alias("p"), F.sum(F.when(pos, w * e).otherwise(0.0)).alias("e"), F.sum(F.when(pos, 0).otherwise(w)).alias("n"))
    met = facts.crossJoin(F.broadcast(thresholds)).withColumn("low", F.coalesce(F.col("s") < F.col("thr"), F.lit(True)))
    cost = F.sum(F.when(F.col("low"), F.col("p").cast("double")).otherwise(F.col("e"))) / F.nullif(F.sum("p"), F.lit(0))
    held = F.sum(F.when(F.col("low"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0))
    total = met.groupBy("replicate", "thr").agg(((1 - cost) * CER_LEG + held * REJECT_LEG).alias("total"))
    return total.where("total is not null").groupBy("replicate").agg(F.max_by("thr", F.struct(F.bround("total", 9), -F.col("thr"))).alias("thr"))


def bootstrap_means(df: DataFrame, cluster: str, value: str, replicates: int = 100, seed: int = 42) -> DataFrame:
    """replicate, mean: the mean of a value in each replicate of whole clusters; replicates without a row give none."""
    sums = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("c"))
    return poisson_weights(sums, cluster, replicates, seed).groupBy("replicate").agg((F.sum(F.col("w") * F.col("v")) / F.sum(F.col("w") * F.col("c"))).alias("mean"))


def bootstrap_spearman(df: DataFrame, key: str, x: str, y: str, replicates: int = 20, seed: int = 42) -> DataFrame:
    """replicate, rho: rank correlation of each replicate, with mean ranks by weighted counts of equal values."""
    rows = poisson_weights(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), key, replicates, seed).groupBy("replicate", x, y).agg(F.sum("w").alias("w"))

    def ranked(c: str, name: str) -> DataFrame:
        # Ranges of values within each replicate, so no task holds one.
        told = cumulative(rows, c, {"_c": F.sum("w")}, within=("replicate",))
        return told.select("replicate", c, (F.col("_c_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias(name))

    w, a, b = F.col("w"), F.col("_a"), F.col("_b")
    s = rows.join(ranked(x, "_a"), ["replicate", x]).join(ranked(y, "_b"), ["replicate", y]).groupBy("replicate").agg(F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    low = F.sqrt((F.col("n") * F.col("aa") - F.col("a") ** 2) * (F.col("n") * F.col("bb") - F.col("b") ** 2))
    return s.select("replicate", ((F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.nullif(low, F.lit(0.0))).alias("rho"))


def bootstrap_pooled(df: DataFrame, groups: list[str], cluster: str, err: str, units: str, replicates: int = 100, seed: int = 42) -> DataFrame:
    """groups, pooled, lo, hi, valid: pooled rates with their intervals over replicates of whole clusters, each group by itself.

    Null bounds where fewer than max(20, a tenth of the replicates) hold any unit. Sums by cluster come first.
    """
    sums = df.groupBy(*groups, cluster).agg(F.sum(err).alias("_e"), F.sum(units).alias("_u"))
    w = F.col("w")
    each = poisson_weights(sums, cluster, replicates, seed).groupBy(*groups, "replicate").agg(F.sum(w * F.col("_e")).alias("e"), F.sum(w * F.col("_u")).alias("u")).where("u > 0")
    ok = F.count(F.lit(1))
    at = lambda q: F.when(ok >= max(20, replicates // 10), F.percentile(F.col("e") / F.col("u"), F.lit(q)))
    told = each.groupBy(*groups).agg(at(0.025).alias("lo"), at(0.975).alias("hi"), ok.alias("valid"))
    return sums.groupBy(*groups).agg((F.sum("_e") / F.nullif(F.sum("_u"), F.lit(0))).alias("pooled")).join(told, groups).select(*groups, "pooled", "lo", "hi", "valid")


def bootstrap_gain(df: DataFrame, cluster: str, err: str, units: str, negative: str, base: str, gated: str, legs: tuple[float, float] = (0.4, 0.4), replicates: int = 100, seed: int = 42) -> DataFrame:
    """gain, lo, hi, valid: what a gate gains over the base on the same rows, with its interval over replicates of whole clusters.

    base and gated say which rows are rejected: a rejected positive costs all its units, a rejected negative is right. The gain
    is the fall of the pooled rate and the rise of the negatives' rejection, each times its leg.
    """
    pos, neg = ~F.col(negative), F.col(negative)
    cost = lambda c: F.sum(F.when(pos, F.when(F.col(c), F.col(units)).otherwise(F.col(err))).otherwise(0))
    sums = df.groupBy(cluster).agg((cost(base) - cost(gated)).alias("_c"), F.sum(F.when(pos, F.col(units)).otherwise(0)).alias("_u"), F.sum(F.when(neg, F.col(gated).cast("int") - F.col(base).cast("int")).otherwise(0)).alias("_r"), F.sum(neg.cast("int")).alias("_n"))
    gain = lambda w: legs[0] * F.sum(w * F.col("_c")) / F.nullif(F.sum(w * F.col("_u")), F.lit(0)) + legs[1] * F.sum(w * F.col("_r")) / F.nullif(F.sum(w * F.col("_n")), F.lit(0))
    each = poisson_weights(sums, cluster, replicates, seed).groupBy("replicate").agg(gain(F.col("w")).alias("gain"))
    return sums.agg(gain(F.lit(1)).alias("gain")).crossJoin(F.broadcast(interval(each, "gain", replicates)))


def bootstrap_auc(df: DataFrame, key: str, score: str, positive: str, replicates: int = 100, seed: int = 42) -> DataFrame:
    """replicate, auc: each replicate's AUC, ties a half, from cumulative weights within it; null with one class only."""
    y, w = F.col(positive), F.col("w")
    rows = poisson_weights(df.where(F.col(score).isNotNull() & y.isNotNull()), key, replicates, seed)
    told = cumulative(rows, score, {"p": F.sum(F.when(y, w).otherwise(0)), "q": F.sum(F.when(y, 0).otherwise(w))}, within=("replicate",))
    wins = F.sum(F.col("p") * (F.col("q_upto") - F.col("q") / 2.0))
    return told.groupBy("replicate").agg((wins / F.nullif((F.sum("p") * F.sum("q")).cast("double"), F.lit(0.0))).alias("auc"))


def interval(replicates: DataFrame, value: str, wanted: int, share: float = 0.95) -> DataFrame:
    """lo, hi, valid: the interval of a statistic over its replicates; null unless max(20, a tenth of those wanted) are valid."""
    ok = F.count(value)
    enough = ok >= max(20, wanted // 10)
    at = lambda q: F.when(enough, F.percentile(value, F.lit(q)))
    return replicates.agg(at((1 - share) / 2).alias("lo"), at((1 + share) / 2).alias("hi"), ok.alias("valid"))


def fit_by_fold(df: DataFrame, k: int, feature: str, raw: str, enhanced: str) -> DataFrame:
    """fold, thr, errors: for each fold (column fold) the threshold fitted on the others, and its errors by it."""
    return leave_one_out(df.where(F.col("fold") < k), "fold", feature, raw, enhanced)


def poisson_weights(df: DataFrame, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """The rows once for each replicate, with weight w: a Poisson(1) count by the MD5 of key, replicate and seed."""
    from voxmeter.functions.hashing import unit_hash

    u = unit_hash(F.col(key), F.col("replicate"), seed=seed)
    total, p, bounds = 0.0, 0.36787944117144233, []
    for k in range(8):
        total += p
        bounds.append(total)
        p /= k + 1
    w = sum((F.when(u >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", w).where("w > 0")


def bootstrap_delta(df: DataFrame, key: str, units: str, before: str, after: str, replicates: int = 100, seed: int = 42) -> DataFrame:
    """delta of pooled rates with its 2.5 and 97.5 percentiles over bootstrap replicates; key may be a cluster of rows."""
    sums = df.groupBy(key).agg(F.sum(units).alias("u"), F.sum(before).alias("b"), F.sum(after).alias("a"))
    each = poisson_weights(sums, key, replicates, seed).groupBy("replicate").agg(F.sum(F.col("w") * F.col("u")).alias("u"), F.sum(F.col("w") * F.col("b")).alias("b"), F.sum(F.col("w") * F.col("a")).alias("a"))
    ci = each.where("u > 0").agg(F.percentile((F.col("a") - F.col("b")) / F.col("u"), F.lit(0.025)).alias("lo"), F.percentile((F.col("a") - F.col("b")) / F.col("u"), F.lit(0.975)).alias("hi"))
    return sums.agg(((F.sum("a") - F.sum("b")) / F.sum("u")).alias("delta")).crossJoin(F.broadcast(ci))


def folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Column fold, from 0: by the MD5 of the key, the same in every run."""
    from voxmeter.functions.hashing import unit_hash

    return df.withColumn("fold", F.floor(unit_hash(F.col(key), seed=seed) * k).cast("int"))


def oracle_pick(errs: dict[str, Column]) -> Column:
    """Struct of the least errors and the first system that has them."""
    return F.array_min(F.array(*[F.struct(c.cast("long").alias("errors"), F.lit(i).alias("place"), F.lit(k).alias("system")) for i, (k, c) in enumerate(errs.items())]))
