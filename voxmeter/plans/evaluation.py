"""Queries about error rates, rejection and policies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.functions import errors, scores, text
from voxmeter.functions.hashing import md5_half
from voxmeter.operators import aggregates as agg
from voxmeter.operators import joins, stats, sweep, windows
from voxmeter.plans.fixtures import UTT_SQL, read, utterances, weight_sql
from voxmeter.plans.registry import query

THR = 0.27


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("q2_eval_summary", f"""WITH {UTT_SQL}
SELECT count(*) FILTER (NOT negative) AS n_pos, count(*) FILTER (negative) AS n_neg,
 round(sum(err) FILTER (NOT negative) / sum(n) FILTER (NOT negative), 6) AS pooled_cer,
 round(sum(CASE WHEN sim < {THR} THEN n ELSE err END) FILTER (NOT negative) / sum(n) FILTER (NOT negative), 6) AS pooled_cer_reject,
 round(avg(CASE WHEN sim < {THR} OR hyp = '' THEN 1.0 ELSE cer END) FILTER (NOT negative), 6) AS mean_cer,
 round(avg(CASE WHEN cer < 0.5 AND sim >= {THR} THEN 1.0 ELSE 0.0 END) FILTER (NOT negative), 6) AS correct_rate,
 round(avg(CASE WHEN sim < {THR} THEN 1.0 ELSE 0.0 END) FILTER (negative), 6) AS reject_rate,
 count(*) FILTER (negative AND sim >= {THR}) AS leaked,
 round(avg(CASE WHEN sim >= {THR} THEN length(hyp) END) FILTER (negative), 6) AS leaked_length FROM utt""")
def eval_summary(spark, d):
    """Both sides of an evaluation in one pass: pooled and mean error rates with rejection, and what leaks."""
    u, pos, neg, low = utterances(spark, d), ~F.col("negative"), F.col("negative"), F.col("sim") < THR
    kept = errors.rejected_errors(F.col("err"), F.col("n"), low)
    return u.agg(
        agg.count_if(pos).alias("n_pos"), agg.count_if(neg).alias("n_neg"),
        r6(errors.pooled(F.when(pos, F.col("err")), F.when(pos, F.col("n"))), "pooled_cer"),
        r6(errors.pooled(F.when(pos, kept), F.when(pos, F.col("n"))), "pooled_cer_reject"),
        r6(F.avg(F.when(pos, F.when(low | (F.col("hyp") == ""), 1.0).otherwise(F.col("cer")))), "mean_cer"),
        r6(F.avg(F.when(pos, ((F.col("cer") < 0.5) & ~low).cast("double"))), "correct_rate"),
        r6(F.avg(F.when(neg, low.cast("double"))), "reject_rate"), agg.count_if(neg & ~low).alias("leaked"),
        r6(F.avg(F.when(neg & ~low, F.length("hyp"))), "leaked_length"),
    )


@query("q1_submission", f"""WITH {UTT_SQL}
SELECT concat(CASE WHEN negative THEN 'neg_' ELSE 'pos_' END, uid) AS id, CASE WHEN sim < {THR} THEN 'reject' ELSE 'accept' END AS label,
 CASE WHEN sim < {THR} THEN '' ELSE hyp END AS text, CASE WHEN negative THEN NULL WHEN sim < {THR} THEN 1.0 ELSE round(cer, 6) END AS cer FROM utt""")
def submission(spark, d):
    """A row for each utterance: label, text and, for positives, the rate; rejected ones count in full."""
    low = F.col("sim") < THR
    side = F.when(F.col("negative"), "neg_").otherwise("pos_")
    cer = F.when(F.col("negative"), F.lit(None)).when(low, 1.0).otherwise(F.round("cer", 6))
    return utterances(spark, d).select(F.concat(side, F.col("uid").cast("string")).alias("id"), F.when(low, "reject").otherwise("accept").alias("label"), F.when(low, "").otherwise(F.col("hyp")).alias("text"), cer.alias("cer"))


@query("cer_dialects", r"""WITH x AS (SELECT p_name AS ref, CASE WHEN p_size % 2 = 0 THEN concat(upper(p_name), '. ') ELSE replace(p_name, ' ', '  ') END AS hyp FROM part),
y AS (SELECT 'official' AS dialect, regexp_replace(lower(ref), '[\p{P}\s]', '', 'g') AS r, regexp_replace(lower(hyp), '[\p{P}\s]', '', 'g') AS h FROM x
 UNION ALL SELECT 'legacy', regexp_replace(lower(ref), '[ \n]', '', 'g'), regexp_replace(lower(hyp), '[ \n]', '', 'g') FROM x
 UNION ALL SELECT 'punct', regexp_replace(lower(ref), '[\s,.!?;:''"]', '', 'g'), regexp_replace(lower(hyp), '[\s,.!?;:''"]', '', 'g') FROM x
 UNION ALL SELECT 'raw', ref, hyp FROM x)
SELECT dialect, sum(levenshtein(r, h))::BIGINT AS errors, sum(length(r))::BIGINT AS units, round(sum(levenshtein(r, h)) / sum(length(r)), 6) AS pooled_cer FROM y GROUP BY dialect""")
def dialects(spark, d):
    """The four dialects of the error rate side by side."""
    hyp = F.when(F.col("p_size") % 2 == 0, F.concat(F.upper("p_name"), F.lit(". "))).otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")))
    sides = [F.struct(F.lit(k).alias("dialect"), errors.errors(hyp, F.col("p_name"), k, True).alias("e"), errors.units(F.col("p_name"), k, True).alias("n")) for k in errors.DIALECTS]
    rows = read(spark, d, "part").select(F.explode(F.array(*sides)).alias("x")).select("x.*")
    return rows.groupBy("dialect").agg(F.sum("e").alias("errors"), F.sum("n").alias("units"), r6(errors.pooled(F.col("e"), F.col("n")), "pooled_cer"))


GRID_SQL = "g AS (SELECT round(i * 0.01, 6) AS thr FROM range(101) t(i))"
SWEEP_SQL = f"""WITH {UTT_SQL}, {GRID_SQL}, s0 AS (SELECT thr, avg(CASE WHEN sim < thr THEN 1.0 ELSE cer END) FILTER (NOT negative) AS pos_cer, avg(CASE WHEN sim < thr THEN 1.0 ELSE 0.0 END) FILTER (negative) AS neg_rr,
 avg(CASE WHEN sim >= thr AND cer < 0.5 THEN 1.0 ELSE 0.0 END) FILTER (NOT negative) AS pos_correct FROM utt, g GROUP BY thr),
s AS (SELECT *, (1 - pos_cer) * 40 + neg_rr * 30 AS total FROM s0)"""


@query("q4_threshold_sweep", SWEEP_SQL + " SELECT thr, round(pos_cer, 6) AS pos_cer, round(neg_rr, 6) AS neg_rr, round(pos_correct, 6) AS pos_correct, round(total, 6) AS total FROM s")
def threshold_sweep(spark, d):
    """Every threshold of a grid against sums by similarity."""
    u = utterances(spark, d)
    s = sweep.threshold_sweep(u, sweep.grid(u, 0.0, 0.01, 101), "sim", "cer", "negative")
    return s.select("thr", *[r6(F.col(c), c) for c in ("pos_cer", "neg_rr", "pos_correct", "total")])


@query("q4_best_threshold", SWEEP_SQL + """, b AS (SELECT * FROM s ORDER BY round_even(total, 9) DESC, thr LIMIT 1)
SELECT b.thr, round(b.total, 6) AS total, (SELECT min(thr) FROM s WHERE s.total >= b.total - 0.1) AS plateau_from, (SELECT max(thr) FROM s WHERE s.total >= b.total - 0.1) AS plateau_to FROM b""")
def best_threshold(spark, d):
    """The best threshold and its plateau."""
    u = utterances(spark, d)
    return sweep.best(sweep.threshold_sweep(u, sweep.grid(u, 0.0, 0.01, 101), "sim", "cer", "negative")).select("thr", r6(F.col("total"), "total"), "plateau_from", "plateau_to")


@query("q4_stress", f"""WITH {UTT_SQL}, v AS (SELECT k, CASE k WHEN 'scaled' THEN sim * 0.9 WHEN 'shifted' THEN CASE WHEN negative THEN sim ELSE sim - 0.05 END ELSE sim END AS s, negative, cer FROM utt, (VALUES ('plain'), ('scaled'), ('shifted')) t(k))
SELECT k AS stress, round(avg(CASE WHEN s < {THR} THEN 1.0 ELSE cer END) FILTER (NOT negative), 6) AS pos_cer, round(avg(CASE WHEN s < {THR} THEN 1.0 ELSE 0.0 END) FILTER (negative), 6) AS neg_rr FROM v GROUP BY k""")
def stress(spark, d):
    """The working point under scaled similarities and under positives shifted down."""
    s = F.col("sim")
    kinds = {"plain": s, "scaled": s * 0.9, "shifted": F.when(F.col("negative"), s).otherwise(s - 0.05)}
    rows = utterances(spark, d).withColumn("k", F.explode(F.array(*[F.struct(F.lit(k).alias("stress"), c.alias("s")) for k, c in kinds.items()])))
    low = F.col("k.s") < THR
    return rows.groupBy(F.col("k.stress").alias("stress")).agg(r6(F.avg(F.when(~F.col("negative"), F.when(low, 1.0).otherwise(F.col("cer")))), "pos_cer"), r6(F.avg(F.when(F.col("negative"), low.cast("double"))), "neg_rr"))


@query("q5_policies", f"""WITH {UTT_SQL}, p AS (SELECT *, verdict = 'accept' AS llm, sim >= 0.3 AS s FROM utt),
x AS (SELECT 'sim_only' AS policy, s AS ok, * FROM p UNION ALL SELECT 'llm_only', llm, * FROM p UNION ALL SELECT 'or', llm OR s, * FROM p UNION ALL SELECT 'and', llm AND s, * FROM p
 UNION ALL SELECT 'weighted', 0.6 * llm::INT + 0.4 * s::INT >= 0.5, * FROM p UNION ALL SELECT 'three_way', 0.4 * llm::INT + 0.4 * s::INT + 0.2 * (sim_b >= 0.1)::INT >= 0.5, * FROM p)
SELECT policy, count(*) AS n, round(avg(ok::INT), 6) AS accept_rate, round(avg((NOT ok)::INT) FILTER (negative), 6) AS reject_rate, round(sum(CASE WHEN ok THEN err ELSE n END) FILTER (NOT negative) / sum(n) FILTER (NOT negative), 6) AS cer_final,
 round(sum(err) FILTER (NOT negative AND ok) / sum(n) FILTER (NOT negative AND ok), 6) AS cer_accepted, round(avg((ok <> negative)::INT), 6) AS correct_rate FROM x GROUP BY policy""")
def policies(spark, d):
    """Accept rules side by side, in one pass."""
    llm, s = F.col("verdict") == "accept", F.col("sim") >= 0.3
    rules = {
        "sim_only": s, "llm_only": llm, "or": llm | s, "and": llm & s, "weighted": 0.6 * llm.cast("int") + 0.4 * s.cast("int") >= 0.5,
        "three_way": scores.fuse(F.col("verdict"), F.col("sim"), F.col("sim_b"), sim_at=0.3) >= 0.5,
    }
    p = sweep.policies(utterances(spark, d), rules, "err", "n", "negative")
    return p.select("policy", "n", *[r6(F.col(c), c) for c in p.columns[2:]])


@query("f7_decide_reject", f"""WITH {UTT_SQL} SELECT uid, sim < {THR} AS sim_only, verdict <> 'accept' AS llm_only, verdict <> 'accept' AND sim < {THR} AS llm_or_sim FROM utt""")
def decide(spark, d):
    """The three rejection strategies."""
    return utterances(spark, d).select("uid", *[scores.decide_reject(F.col("sim"), F.col("verdict"), s, THR).alias(s) for s in ("sim_only", "llm_only", "llm_or_sim")])


@query("q3_by_dimension", f"""WITH {UTT_SQL}, x AS (SELECT 'noise' AS dimension, noise AS value, * FROM utt UNION ALL SELECT 'overlap', overlap::VARCHAR, * FROM utt UNION ALL SELECT 'all', 'all', * FROM utt)
SELECT dimension, value, count(*) AS n, round(sum(err) / sum(n), 6) AS pooled_cer, round(avg(cer), 6) AS mean_cer, round(avg((cer < 0.5)::INT), 6) AS correct_rate FROM x GROUP BY dimension, value""")
def by_dimension(spark, d):
    """Rates by each dimension alone and in all."""
    aggs = [F.count(F.lit(1)).alias("n"), r6(errors.pooled(F.col("err"), F.col("n")), "pooled_cer"), r6(F.avg("cer"), "mean_cer"), r6(agg.share(F.col("cer") < 0.5), "correct_rate")]
    return agg.by_each(utterances(spark, d), ["noise", "overlap"], aggs)


@query("q3_cube", f"""WITH {UTT_SQL} SELECT coalesce(noise, 'ALL') AS noise, coalesce(overlap::VARCHAR, 'ALL') AS overlap, count(*) AS n, sum(err)::BIGINT AS errors, sum(n)::BIGINT AS units FROM utt GROUP BY CUBE (noise, overlap)""")
def cube(spark, d):
    """Cells of two dimensions and all their totals."""
    told = utterances(spark, d).cube("noise", "overlap").agg(F.count(F.lit(1)).alias("n"), F.sum("err").alias("errors"), F.sum("n").alias("units"))
    return told.select(F.coalesce("noise", F.lit("ALL")).alias("noise"), F.coalesce(F.col("overlap").cast("string"), F.lit("ALL")).alias("overlap"), F.col("n"), "errors", "units")


@query("q26_pivot", f"""WITH {UTT_SQL} SELECT noise, count(*) FILTER (overlap = 0) AS ov0, count(*) FILTER (overlap = 1) AS ov1, count(*) FILTER (overlap = 2) AS ov2, count(*) FILTER (overlap = 3) AS ov3 FROM utt GROUP BY noise""")
def pivot(spark, d):
    """Counts of two dimensions as a table."""
    p = utterances(spark, d).groupBy("noise").pivot("overlap", [0, 1, 2, 3]).count()
    return p.select("noise", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"ov{i}") for i in range(4)])


@query("a9_precision_recall", f"""WITH {UTT_SQL}, c AS (SELECT count(*) FILTER (negative AND sim < {THR}) AS tp, count(*) FILTER (NOT negative AND sim < {THR}) AS fp, count(*) FILTER (NOT negative AND sim >= {THR}) AS tn, count(*) FILTER (negative AND sim >= {THR}) AS fn FROM utt)
SELECT tp, fp, tn, fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM c""")
def precision_recall(spark, d):
    """Rejection as the positive class."""
    told = utterances(spark, d).agg(*agg.precision_recall(F.col("negative"), F.col("sim") < THR))
    return told.select("tp", "fp", "tn", "fn", *[r6(F.col(c), c) for c in told.columns[4:]])


@query("q6_ab_audit", f"""WITH {UTT_SQL}, x AS (SELECT sim < {THR} AS ra, sim_b < {THR} AS rb, CASE WHEN sim < {THR} THEN 1.0 ELSE cer END AS a, CASE WHEN sim_b < {THR} THEN 1.0 ELSE cer_b END AS b FROM utt WHERE NOT negative),
y AS (SELECT *, CASE WHEN ra AND rb THEN 'both_rejected' WHEN ra THEN 'only_a_rejected' WHEN rb THEN 'only_b_rejected' WHEN b < a THEN 'better' WHEN b > a THEN 'worse' ELSE 'same' END AS bucket FROM x)
SELECT bucket, count(*) AS n, round(sum(b - a), 6) AS delta, round(sum(b - a) / (SELECT sum(b - a) FROM x), 6) AS share FROM y GROUP BY bucket""")
def ab_audit(spark, d):
    """The change between two systems, by exhaustive buckets that add up to it."""
    ra, rb = F.col("sim") < THR, F.col("sim_b") < THR
    rows = utterances(spark, d).where(~F.col("negative")).withColumns({"a": F.when(ra, 1.0).otherwise(F.col("cer")), "b": F.when(rb, 1.0).otherwise(F.col("cer_b"))}).withColumn("delta", F.col("b") - F.col("a"))
    bucket = F.when(ra & rb, "both_rejected").when(ra, "only_a_rejected").when(rb, "only_b_rejected").when(F.col("delta") < 0, "better").when(F.col("delta") > 0, "worse").otherwise("same")
    out = agg.decompose(rows, "delta", bucket)
    return out.select("bucket", "n", r6(F.col("delta"), "delta"), r6(F.col("share"), "share"))


@query("a10_crosstab", f"""WITH {UTT_SQL} SELECT sim < {THR} AS a_rejected, sim_b < {THR} AS b_rejected, count(*) AS n FROM utt GROUP BY 1, 2""")
def crosstab(spark, d):
    """Rejected by one system, by the other, by both, by none."""
    return agg.confusion(utterances(spark, d).select((F.col("sim") < THR).alias("a_rejected"), (F.col("sim_b") < THR).alias("b_rejected")), "a_rejected", "b_rejected")


@query("q31_paired_deltas", f"""WITH {UTT_SQL} SELECT noise, count(*) FILTER (cer_b - cer < -0.01) AS better, count(*) FILTER (abs(cer_b - cer) <= 0.01) AS same, count(*) FILTER (cer_b - cer > 0.01) AS worse, round(avg(cer_b - cer), 6) AS mean_delta,
 CASE WHEN avg(cer_b - cer) < -0.01 THEN 'helps' WHEN avg(cer_b - cer) > 0.01 THEN 'hurts' ELSE 'even' END AS verdict FROM utt GROUP BY noise""")
def paired(spark, d):
    """Better, same and worse with a dead band, and a verdict."""
    told = utterances(spark, d).groupBy("noise").agg(*agg.deltas(F.col("cer"), F.col("cer_b"), 0.01))
    m = F.col("mean_delta")
    return told.withColumn("verdict", F.when(m < -0.01, "helps").when(m > 0.01, "hurts").otherwise("even")).withColumn("mean_delta", F.round(m, 6))


@query("q18_failure_modes", f"""WITH {UTT_SQL}, x AS (SELECT *, list_distinct(string_split(nr, '')) AS sr, list_distinct(string_split(nh, '')) AS sh FROM utt),
y AS (SELECT *, CASE WHEN nr = '' OR nh = '' THEN 0.0 ELSE len(list_intersect(sr, sh)) / least(len(sr), len(sh)) END AS ov FROM x),
z AS (SELECT CASE WHEN cer < 0.2 THEN 'M0_fine' WHEN length(nh) <= 1 THEN 'M5_empty' WHEN cer_b < cer - 0.2 THEN 'M2_wrong_target' WHEN length(nh) <= 2 AND length(nr) >= 3 THEN 'M3_cut'
 WHEN ov < 0.3 AND cer >= 0.8 THEN CASE WHEN length(nh) >= length(nr) * 1.5 THEN 'M1a_loop' ELSE 'M1b_words' END WHEN ov >= 0.5 AND cer < 0.8 THEN 'M4_near' WHEN ov < 0.5 THEN 'M1b_words' ELSE 'M4_near' END AS mode, cer FROM y)
SELECT mode, count(*) AS n, round(avg(cer), 6) AS mean_cer FROM z GROUP BY mode""")
def failure_modes(spark, d):
    """Rows by why they failed."""
    h, r = text.normalize(F.col("hyp"), True), text.normalize(F.col("ref"), True)
    mode = scores.failure_mode(F.col("cer"), text.overlap(h, r), F.length(h), F.length(r), F.col("cer_b") < F.col("cer") - 0.2)
    return utterances(spark, d).withColumn("mode", mode).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("cer"), "mean_cer"))


@query("q21_tiers", f"""WITH {UTT_SQL} SELECT uid, ref, hyp, CASE WHEN cer <= 0 THEN '0_perfect' WHEN cer <= 0.2 THEN '1_small' WHEN cer <= 0.5 THEN '2_middle' WHEN cer <= 1 THEN '3_large' ELSE '4_blown' END AS tier, round(cer, 6) AS cer FROM utt ORDER BY tier, cer DESC""")
def tiers(spark, d):
    """The error export, by tier and rate."""
    return utterances(spark, d).select("uid", "ref", "hyp", scores.tier(F.col("cer")).alias("tier"), r6(F.col("cer"), "cer")).orderBy("tier", F.desc("cer"))


@query("q20_sim_buckets", f"""WITH {UTT_SQL} SELECT CASE WHEN sim < 0.2 THEN 0 WHEN sim < 0.3 THEN 1 WHEN sim < 0.4 THEN 2 WHEN sim < 0.6 THEN 3 ELSE 4 END AS bin, count(*) AS n, round(sum(err) / sum(n), 6) AS pooled_cer, round(sum(err_b) / sum(n), 6) AS pooled_cer_b,
 CASE WHEN count(*) < 10 THEN 'few' WHEN sum(err_b) < sum(err) THEN 'b' ELSE 'a' END AS winner FROM utt GROUP BY 1""")
def sim_buckets(spark, d):
    """Half-open similarity buckets, two systems, and which wins where there are rows enough."""
    told = utterances(spark, d).groupBy(scores.bucket(F.col("sim"), [0.0, 0.2, 0.3, 0.4, 0.6, 1.01]).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("err").alias("e"), F.sum("err_b").alias("f"), F.sum("n").alias("u"))
    return told.select("bin", "n", r6(F.col("e") / F.col("u"), "pooled_cer"), r6(F.col("f") / F.col("u"), "pooled_cer_b"), F.when(F.col("n") < 10, "few").when(F.col("f") < F.col("e"), "b").otherwise("a").alias("winner"))


@query("a18_histogram", f"""WITH {UTT_SQL}, b AS (SELECT CASE WHEN cer < 0.1 THEN 0 WHEN cer < 0.5 THEN 1 WHEN cer < 1 THEN 2 WHEN cer < 100 THEN 3 END AS bin, count(*) AS n FROM utt GROUP BY 1) SELECT bin, n, round(n / sum(n) OVER (), 6) AS share FROM b""")
def histogram(spark, d):
    """Rates in explicit bins, with shares."""
    return agg.histogram(utterances(spark, d), F.col("cer"), [0.0, 0.1, 0.5, 1.0, 100.0]).withColumn("share", F.round("share", 6))


@query("o2_worst_rows", f"""WITH {UTT_SQL} SELECT uid, ref, hyp, hyp_b, round(cer_b - cer, 6) AS delta FROM utt ORDER BY cer_b - cer DESC, uid LIMIT 20""")
def worst_rows(spark, d):
    """A report of the twenty rows that lose the most."""
    return utterances(spark, d).withColumn("d", F.col("cer_b") - F.col("cer")).orderBy(F.desc("d"), "uid").limit(20).select("uid", "ref", "hyp", "hyp_b", r6(F.col("d"), "delta"))


@query("m20_oracle", f"""WITH {UTT_SQL} SELECT CASE WHEN err_b < err THEN 'b' ELSE 'a' END AS system, count(*) AS n, sum(least(err, err_b))::BIGINT AS errors, sum(n)::BIGINT AS units FROM utt GROUP BY 1""")
def oracle(spark, d):
    """What choosing the better system of each row would give."""
    pick = stats.oracle_pick({"a": F.col("err"), "b": F.col("err_b")})
    return utterances(spark, d).withColumn("p", pick).groupBy(F.col("p.system").alias("system")).agg(F.count(F.lit(1)).alias("n"), F.sum("p.errors").alias("errors"), F.sum("n").alias("units"))


@query("q22_efficiency_leg", f"""WITH {UTT_SQL}, r AS (SELECT noise, sum(wall_sec) / sum(audio_sec) AS rtf FROM utt GROUP BY noise),
s AS (SELECT noise, rtf, unnest([CASE WHEN rtf <= 1 THEN 20.0 WHEN rtf >= 3 THEN 0 ELSE 20 * (3 - rtf) / 2 END, CASE WHEN rtf <= 0.5 THEN 20.0 WHEN rtf >= 2 THEN 0 ELSE 20 * (2 - rtf) / 1.5 END, CASE WHEN rtf <= 0.1 THEN 20.0 WHEN rtf >= 0.5 THEN 0 ELSE 20 * (0.5 - rtf) / 0.4 END,
 CASE WHEN rtf < 0.5 THEN 20.0 WHEN rtf < 1 THEN 14 WHEN rtf < 2 THEN 8 ELSE 0 END]::DOUBLE[]) AS score FROM r)
SELECT noise, round(rtf, 6) AS rtf, round(min(score), 6) AS least, round(max(score), 6) AS most FROM s GROUP BY noise, rtf""")
def efficiency(spark, d):
    """Real-time factors, and the range of scores that candidate mappings give."""
    r = utterances(spark, d).groupBy("noise").agg((F.sum("wall_sec") / F.nullif(F.sum("audio_sec"), F.lit(0.0))).alias("rtf"))
    x = F.col("rtf")
    marks = F.array(scores.linear_drop(x, 1.0, 3.0, 20.0), scores.linear_drop(x, 0.5, 2.0, 20.0), scores.linear_drop(x, 0.1, 0.5, 20.0), scores.steps(x, 20.0))
    return r.select("noise", r6(x, "rtf"), r6(F.array_min(marks), "least"), r6(F.array_max(marks), "most"))


@query("f9_md5_holdout", f"""WITH {UTT_SQL}, x AS (SELECT *, ('0x' || right(md5(concat(uid, '|seed=7')), 1))::BIGINT % 2 AS half FROM utt) SELECT half::INT AS half, count(*) AS n, round(sum(err) / sum(n), 6) AS pooled_cer FROM x GROUP BY half""")
def holdout(spark, d):
    """Two halves by the parity of a hash."""
    return agg.error_summary(utterances(spark, d).withColumn("half", md5_half(F.col("uid"), 7)), ["half"], "err", "n").withColumn("pooled_cer", F.round("pooled_cer", 6))


@query("q29_templates", """SELECT p_type, count(*) AS n, count(DISTINCT p_name) AS names, count(*) FILTER (m > 1) AS repeated FROM (SELECT *, count(*) OVER (PARTITION BY p_name, p_type) AS m FROM part) GROUP BY p_type""")
def templates(spark, d):
    """How many references repeat."""
    each = read(spark, d, "part").groupBy("p_type", "p_name").agg(F.count(F.lit(1)).alias("m"))
    return each.groupBy("p_type").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("names"), F.sum(F.when(F.col("m") > 1, F.col("m")).otherwise(0)).alias("repeated"))


@query("t10_edit_counts", f"""WITH {UTT_SQL} SELECT uid, err AS distance FROM utt""")
def edit_counts(spark, d):
    """Substitutions, deletions and insertions add up to the distance."""
    ops = text.edit_script(text.normalize(F.col("ref"), True), text.normalize(F.col("hyp"), True))
    return utterances(spark, d).select("uid", F.size(ops).cast("long").alias("distance"))


@query("t20_replacements", f"""WITH {UTT_SQL}, c AS (SELECT uid, string_split(ref, '') AS a, string_split(hyp_b, '') AS b FROM utt WHERE length(ref) = length(hyp_b)),
u AS (SELECT uid, unnest(a) AS x, unnest(b) AS y FROM c), k AS (SELECT uid, x, y, count(*) OVER (PARTITION BY uid) AS m FROM u WHERE x <> y) SELECT y AS wrong, x AS right, count(*) AS n FROM k WHERE m = 1 GROUP BY 1, 2""")
def replacements(spark, d):
    """Characters that stand for others."""
    from voxmeter.operators.sampling import replacement_pairs

    return replacement_pairs(utterances(spark, d), "ref", "hyp_b")


@query("t21_ngrams", """WITH g AS (SELECT substr(p_name, i, k) AS gram FROM (SELECT p_name, k, unnest(range(1, length(p_name) - k + 2)) AS i FROM part, (VALUES (2), (3), (4)) t(k))) SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 3""")
def ngrams(spark, d):
    """The vocabulary of 2- to 4-grams seen three times."""
    g = F.concat(*[text.grams(F.col("p_name"), k) for k in (2, 3, 4)])
    return read(spark, d, "part").select(F.explode(g).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("t33_text_features", f"""WITH {UTT_SQL}, x AS (SELECT uid, ref, hyp, list_distinct(string_split(ref, '')) AS a, CASE WHEN hyp = '' THEN [] ELSE list_distinct(string_split(hyp, '')) END AS b FROM utt)
SELECT uid, round(len(b) / greatest(length(hyp), 1), 6) AS diversity, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS jaccard,
 round(CASE WHEN hyp = '' THEN 0.0 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END, 6) AS overlap, length(regexp_replace(hyp, '[^A-Za-z]', '', 'g'))::INT AS letters FROM x""")
def text_features(spark, d):
    """Character diversity, Jaccard, overlap and letters."""
    h, r = F.col("hyp"), F.col("ref")
    return utterances(spark, d).select("uid", r6(text.diversity(h), "diversity"), r6(text.jaccard(r, h), "jaccard"), r6(text.overlap(r, h), "overlap"), F.regexp_count(h, F.lit("[A-Za-z]")).alias("letters"))


@query("t26_command_gate", r"""WITH t AS (SELECT role, text, regexp_replace(coalesce(text, ''), '[^\p{L}\p{M}\p{N}\p{Pc}]', '', 'g') AS s FROM conversations),
p AS (SELECT role, text, len(list_filter(range(1, length(text)), lambda i: len(list_filter([2, 3, 4, 5, 6], lambda k: i + 3 * k - 1 <= length(text) AND substr(text, i, k) = substr(text, i + k, k) AND substr(text, i, k) = substr(text, i + 2 * k, k) AND NOT contains(substr(text, i, k), chr(10)))) > 0)) > 0 AS loop FROM t)
SELECT role, coalesce(length(text) >= 4 AND loop, false) AS loop, count(*) AS n, count(*) FILTER (regexp_matches(text, '[\x{4e00}-\x{9fff}]')) AS chinese FROM p GROUP BY 1, 2""")
def gate(spark, d):
    """Conversations' turns by whether they loop, and how many could be commands at all: those with a Chinese character."""
    t = F.col("text")
    return read(spark, d, "conversations").groupBy("role", F.coalesce(text.is_loop(t, marks=["\0"]), F.lit(False)).alias("loop")).agg(F.count(F.lit(1)).alias("n"), agg.count_if(text.cjk_count(text.or_empty(t)) > 0).alias("chinese"))


@query("t26_commands", """SELECT p_size % 3 = 0 AS command, count(*) AS n, CASE p_size % 3 WHEN 0 THEN 5.5 WHEN 1 THEN -8.5 ELSE -5.0 END::DOUBLE AS score FROM part GROUP BY 1, 3""")
def commands(spark, d):
    """Texts by whether they are commands, with their scores: a command, news, and an empty one."""
    t = F.element_at(F.array(*map(F.lit, ("打开空调", "中国市场同比增长", " "))), F.col("p_size") % 3 + 1)
    return read(spark, d, "part").groupBy(text.is_command(t).alias("command"), text.command_score(t).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("t35_verdicts", """SELECT event_type, CASE WHEN lower(event_type) = 'click' THEN 'accept' ELSE 'reject' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2""")
def verdicts(spark, d):
    """Answers with code fences and noise around their JSON."""
    told = F.when(F.col("event_type") == "click", " Accept ").when(F.col("event_type") == "view", "reject").otherwise("maybe")
    raw = F.concat(F.lit('```json\n{"verdict": "'), told, F.lit('", "k": '), F.col("event_id").cast("string"), F.lit("}\n``` so"))
    return read(spark, d, "events").groupBy("event_type", text.parse_verdict(raw).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("t37_tag_counts", """SELECT tag, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag""")
def tag_counts(spark, d):
    """Tags between separators, counted."""
    cell = F.replace(F.col("p_name"), F.lit(" "), F.lit(" ；"))
    return read(spark, d, "part").select(F.explode(text.tags(cell)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("m7_auc", f"""WITH {UTT_SQL}, r AS (SELECT NOT negative AS y, rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2.0 AS k FROM utt),
s AS (SELECT sum(k) FILTER (y) AS sp, count(*) FILTER (y) AS np, count(*) FILTER (NOT y) AS nn FROM r) SELECT round((sp - np * (np + 1) / 2.0) / (np * nn), 6) AS auc, np AS n_pos, nn AS n_neg FROM s""")
def auc(spark, d):
    """Area under the curve, ties a half."""
    return stats.auc(utterances(spark, d).withColumn("y", ~F.col("negative")), "sim", "y").withColumn("auc", F.round("auc", 6))


CURVE_SQL = f"""WITH {UTT_SQL}, g AS (SELECT sim AS thr, count(*) FILTER (NOT negative) AS p, count(*) FILTER (negative) AS q FROM utt GROUP BY sim), c AS (SELECT thr, sum(p) OVER (ORDER BY thr DESC)::BIGINT AS tp, sum(q) OVER (ORDER BY thr DESC)::BIGINT AS fp, sum(p) OVER ()::BIGINT AS np FROM g),
v AS (SELECT thr, tp, fp, tp / (tp + fp) AS "precision", tp / np AS recall, 2 * tp / (tp + fp + np) AS f1 FROM c)"""


@query("m8_pr_curve", CURVE_SQL + ' SELECT round(thr, 6) AS thr, tp, fp, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM v')
def pr_curve(spark, d):
    """Precision and recall at each distinct score."""
    c = stats.pr_curve(utterances(spark, d).withColumn("y", ~F.col("negative")), "sim", "y")
    return c.select(r6(F.col("thr"), "thr"), "tp", "fp", *[r6(F.col(x), x) for x in ("precision", "recall", "f1")])


@query("m9_curve_points", CURVE_SQL + ' SELECT round(max(f1), 6) AS best_f1, round((SELECT thr FROM v ORDER BY f1 DESC, thr DESC LIMIT 1), 6) AS best_f1_thr, round(max("precision") FILTER (tp >= 10), 6) AS p_max, round(max("precision") FILTER (recall >= 0.5), 6) AS p_at_half FROM v')
def curve_points(spark, d):
    """Best F1, highest precision, precision at half recall."""
    p = stats.curve_points(stats.pr_curve(utterances(spark, d).withColumn("y", ~F.col("negative")), "sim", "y"))
    return p.select(*[r6(F.col(c), c) for c in p.columns])


@query("m11_spearman", f"""WITH {UTT_SQL}, r AS (SELECT rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2.0 AS x, rank() OVER (ORDER BY cer) + (count(*) OVER (PARTITION BY cer) - 1) / 2.0 AS y FROM utt) SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM r""")
def spearman(spark, d):
    """Rank correlation of similarity and error."""
    return stats.spearman(utterances(spark, d), "sim", "cer").withColumn("rho", F.round("rho", 6))


@query("m12_quartiles", f"""WITH {UTT_SQL}, c AS (SELECT sim AS v, count(*) AS k, sum(count(*)) OVER (ORDER BY sim) - count(*) AS b, sum(count(*)) OVER () AS a FROM utt GROUP BY sim),
q AS (SELECT least(b // greatest(a // 4, 1), 3) + 1 AS part, v FROM c) SELECT part::INT AS part, count(*) AS n, round(sum(err) / sum(n), 6) AS pooled_cer, round(avg((cer < 0.5)::INT), 6) AS correct_rate FROM utt JOIN q ON sim = v GROUP BY part""")
def quartiles(spark, d):
    """Rates by quartile of similarity; equal values stay together."""
    q = windows.quartile(utterances(spark, d), "sim")
    return q.groupBy("part").agg(F.count(F.lit(1)).alias("n"), r6(errors.pooled(F.col("err"), F.col("n")), "pooled_cer"), r6(agg.share(F.col("cer") < 0.5), "correct_rate"))


@query("w10_trend", f"""WITH {UTT_SQL}, b AS (SELECT overlap, avg(cer) AS m FROM utt GROUP BY overlap), x AS (SELECT m - lag(m) OVER (ORDER BY overlap) AS dd FROM b) SELECT count(*) FILTER (dd > 0) AS rises, count(*) FILTER (dd < 0) AS falls FROM x""")
def dose(spark, d):
    """Whether errors rise along ordered buckets."""
    return windows.trend(utterances(spark, d).groupBy("overlap").agg(F.avg("cer").alias("m")), "overlap", "m")


FIT_SQL = f"""WITH {UTT_SQL}, c AS (SELECT DISTINCT sim AS thr FROM utt UNION ALL SELECT '-infinity'::DOUBLE)"""


@query("m17_fit_threshold", FIT_SQL + """, f AS (SELECT thr, sum(CASE WHEN sim <= thr THEN err_b ELSE err END)::BIGINT AS errors, count(*) FILTER (sim <= thr) AS accepted FROM utt, c GROUP BY thr) SELECT thr, errors, accepted FROM f ORDER BY errors, accepted, thr LIMIT 1""")
def fit(spark, d):
    """The best threshold for taking the second system."""
    return stats.fit_threshold(utterances(spark, d), "sim", "err", "err_b").select("thr", "errors", "accepted")


@query("m18_leave_one_out", f"""WITH {UTT_SQL}, h AS (SELECT DISTINCT spk FROM utt), c AS (SELECT DISTINCT h.spk, sim AS thr FROM h JOIN utt u ON u.spk <> h.spk UNION ALL SELECT spk, '-infinity'::DOUBLE FROM h),
f AS (SELECT c.spk, thr, sum(CASE WHEN sim <= thr THEN err_b ELSE err END) AS errors, count(*) FILTER (sim <= thr) AS accepted FROM c JOIN utt u ON u.spk <> c.spk GROUP BY c.spk, thr),
b AS (SELECT spk, thr FROM (SELECT *, row_number() OVER (PARTITION BY spk ORDER BY errors, accepted, thr) AS k FROM f) WHERE k = 1) SELECT spk, thr, sum(CASE WHEN sim <= thr THEN err_b ELSE err END)::BIGINT AS errors FROM b JOIN utt USING (spk) GROUP BY spk, thr""")
def leave_one_out(spark, d):
    """Thresholds fitted without a speaker, used on that speaker."""
    return stats.leave_one_out(utterances(spark, d), "spk", "sim", "err", "err_b").drop("accepted")


@query("m5_bootstrap_delta", f"""WITH {UTT_SQL}, c AS (SELECT spk, sum(n) AS u, sum(err) AS b, sum(err_b) AS a FROM utt GROUP BY spk), w AS (SELECT *, {weight_sql('spk', 'replicate')} AS w FROM c, range(100) r(replicate)), x AS (SELECT replicate, (sum(w * a) - sum(w * b)) / sum(w * u) AS d FROM w WHERE w > 0 GROUP BY replicate)
SELECT (SELECT round((sum(a) - sum(b)) / sum(u), 6) FROM c) AS delta, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi FROM x""")
def bootstrap(spark, d):
    """Confidence interval of the change between two systems, by speaker clusters."""
    return stats.bootstrap_delta(utterances(spark, d), "spk", "n", "err", "err_b").select(*[r6(F.col(c), c) for c in ("delta", "lo", "hi")])


@query("m15_folds", f"""WITH {UTT_SQL}, x AS (SELECT *, floor(('0x' || substr(md5(concat(uid, '|0')), 1, 8))::BIGINT / 4294967296.0 * 5)::INT AS fold FROM utt) SELECT fold, count(*) AS n, round(sum(err) / sum(n), 6) AS pooled_cer FROM x GROUP BY fold""")
def folds(spark, d):
    """Five folds by hash."""
    return agg.error_summary(stats.folds(utterances(spark, d), "uid", 5), ["fold"], "err", "n").withColumn("pooled_cer", F.round("pooled_cer", 6))


@query("m13_fusion_grid", f"""WITH {UTT_SQL}, z AS (SELECT negative, (sim - avg(sim) OVER ()) / stddev_pop(sim) OVER () AS a, (sim_b - avg(sim_b) OVER ()) / stddev_pop(sim_b) OVER () AS b FROM utt), g AS (SELECT i / 4.0 AS alpha FROM range(5) t(i)),
s AS (SELECT alpha, negative, round(alpha * a + (1 - alpha) * b, 9) AS v FROM z, g), r AS (SELECT alpha, negative, rank() OVER (PARTITION BY alpha ORDER BY v) + (count(*) OVER (PARTITION BY alpha, v) - 1) / 2.0 AS k FROM s),
c AS (SELECT alpha, sum(k) FILTER (NOT negative) AS sp, count(*) FILTER (NOT negative) AS np, count(*) FILTER (negative) AS nn FROM r GROUP BY alpha) SELECT alpha::DOUBLE AS alpha, round((sp - np * (np + 1) / 2.0) / (np * nn), 5) AS auc FROM c""")
def fusion_grid(spark, d):
    """Area under the curve of a weighted sum of two z-scores, by weight."""
    z = stats.z_score(stats.z_score(utterances(spark, d), "sim", "a"), "sim_b", "b").withColumn("y", ~F.col("negative"))
    each = [stats.auc(z.withColumn("v", F.round(F.lit(x) * F.col("a") + F.lit(1 - x) * F.col("b"), 9)), "v", "y").select(F.lit(x).alias("alpha"), F.round("auc", 5).alias("auc")) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]
    return sweep.union(each)


@query("q30_reproducible", """SELECT event_type, count(*) AS n, count(*) FILTER (value <> round(value, 1)) AS differs FROM events GROUP BY event_type""")
def reproducible(spark, d):
    """Values that differ between two runs, by group."""
    e = read(spark, d, "events")
    joined = e.select("event_id", "event_type", F.col("value").alias("a")).join(e.select("event_id", F.round("value", 1).alias("b")), "event_id", "full_outer")
    return joined.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), agg.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))


@query("p8_noise_class", """WITH x AS (SELECT CASE WHEN o_totalprice / 500000 < 0.06 THEN 'babble' WHEN o_totalprice / 500000 < 0.18 AND o_custkey % 7 > 3 THEN 'pink' ELSE 'white' END AS noise FROM orders) SELECT noise, CASE noise WHEN 'pink' THEN 6 ELSE 0 END AS atten, count(*) AS n FROM x GROUP BY noise""")
def noise(spark, d):
    """Three noise classes by two features."""
    c = scores.noise_class(F.col("o_totalprice") / 500000, (F.col("o_custkey") % 7).cast("double"))
    return read(spark, d, "orders").select(c.alias("c")).groupBy("c.noise", "c.atten").agg(F.count(F.lit(1)).alias("n"))


@query("p10_route_reasons", """WITH x AS (SELECT concat_ws('|', CASE WHEN l_discount < 0.03 THEN 'cosine_low' END, CASE WHEN l_tax > 0.06 THEN 'rms_high' END, CASE WHEN l_quantity < 5 THEN 'too_short' END) AS reasons FROM lineitem) SELECT reasons, reasons = '' AS ok, count(*) AS n FROM x GROUP BY reasons""")
def route_reasons(spark, d):
    """All reasons against a row, in order."""
    r = scores.reasons(cosine_low=F.col("l_discount") < 0.03, rms_high=F.col("l_tax") > 0.06, too_short=F.col("l_quantity") < 5)
    return read(spark, d, "lineitem").groupBy(F.array_join(r, "|").alias("reasons")).agg(F.count(F.lit(1)).alias("n")).withColumn("ok", F.col("reasons") == "")
