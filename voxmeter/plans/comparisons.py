"""Queries that compare systems, annotators, selectors and protocols."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmeter.functions import errors, scores, text, vectors
from voxmeter.operators import aggregates as agg
from voxmeter.operators import joins, protocol, sampling, stats, sweep, windows
from voxmeter.plans.evaluation import THR, r6
from voxmeter.plans.fixtures import SEG_SQL, UTT_SQL, read, segments, utterances
from voxmeter.plans.registry import query


@query("q24_context_baseline", f"""WITH {UTT_SQL} SELECT spk, count(*) AS n, round(sum(err) / sum(n), 6) AS base, round(sum(err_b) / sum(n), 6) AS context, count(*) FILTER (cer_b < cer) AS better, count(*) FILTER (cer_b > cer) AS worse FROM utt GROUP BY spk""")
def context_baseline(spark, d):
    """Two systems by speaker, pooled, with the rows that gain and lose."""
    e, f, n = F.col("err"), F.col("err_b"), F.col("n")
    better, _, worse, _ = agg.deltas(F.col("cer"), F.col("cer_b"))
    return utterances(spark, d).groupBy("spk").agg(F.count(F.lit(1)).alias("rows"), r6(errors.pooled(e, n), "base"), r6(errors.pooled(f, n), "context"), better, worse).withColumnRenamed("rows", "n")


@query("q25_layered_accuracy", f"""WITH {UTT_SQL}, g AS (SELECT DISTINCT ref AS t, 'accept' AS fix FROM utt WHERE ref LIKE 'red%'), x AS (SELECT noise, verdict, coalesce(fix, CASE WHEN negative THEN 'reject' ELSE 'accept' END) AS gold FROM utt LEFT JOIN g ON t = ref)
SELECT noise, count(*) AS n, count(*) FILTER (gold = 'accept' AND verdict = 'accept') AS tp, count(*) FILTER (gold <> 'accept' AND verdict = 'accept') AS fp, round(avg((gold = verdict)::INT), 6) AS accuracy FROM x GROUP BY noise""")
def layered(spark, d):
    """Accuracy by layer, with labels put right by a table of texts."""
    u = utterances(spark, d)
    fix = u.where("ref LIKE 'red%'").select("ref").distinct().withColumn("fix", F.lit("accept"))
    gold = F.coalesce("fix", F.when(F.col("negative"), "reject").otherwise("accept"))
    ok, yes = gold == "accept", F.col("verdict") == "accept"
    return u.join(fix, "ref", "left").groupBy("noise").agg(F.count(F.lit(1)).alias("n"), agg.count_if(ok & yes).alias("tp"), agg.count_if(~ok & yes).alias("fp"), r6(agg.share(gold == F.col("verdict")), "accuracy"))


@query("q27_decision_flips", f"""WITH {UTT_SQL}, x AS (SELECT negative, sim < {THR} AS a, verdict = 'reject' AND sim < {THR} AS b FROM utt) SELECT CASE WHEN negative AND a AND NOT b THEN 'escaped' WHEN negative AND b AND NOT a THEN 'caught' WHEN a AND NOT b THEN 'saved' WHEN b AND NOT a THEN 'killed' ELSE 'same' END AS flip, count(*) AS n FROM x GROUP BY 1""")
def flips(spark, d):
    """Decisions that change from one strategy to another."""
    a = scores.decide_reject(F.col("sim"), F.col("verdict"), "sim_only", THR)
    b = scores.decide_reject(F.col("sim"), F.col("verdict"), "llm_or_sim", THR)
    neg = F.col("negative")
    flip = F.when(neg & a & ~b, "escaped").when(neg & b & ~a, "caught").when(a & ~b, "saved").when(b & ~a, "killed").otherwise("same")
    return utterances(spark, d).groupBy(flip.alias("flip")).agg(F.count(F.lit(1)).alias("n"))


@query("q28_tags_vs_gold", """WITH t AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS gold, list_distinct(string_split(replace(lower(p_name || ' ' || p_type), 'e', 'e'), ' ')) AS found FROM part)
SELECT sum(len(list_intersect(gold, found)))::BIGINT AS hit, sum(len(gold) - len(list_intersect(gold, found)))::BIGINT AS miss, sum(len(found) - len(list_intersect(gold, found)))::BIGINT AS extra,
 round(sum(len(list_intersect(gold, found))) / sum(len(found)), 6) AS "precision", round(sum(len(list_intersect(gold, found))) / sum(len(gold)), 6) AS recall FROM t WHERE len(gold) > 0""")
def tags_vs_gold(spark, d):
    """Hits, misses and extras of tag sets."""
    cell = lambda c: F.replace(c, F.lit(" "), F.lit(";"))
    t = read(spark, d, "part").select(text.tags(cell(F.col("p_name"))).alias("g"), text.tags(cell(F.lower(F.concat_ws(" ", "p_name", "p_type")))).alias("f")).where("size(g) > 0")
    hit = F.sum(F.size(F.array_intersect("g", "f")))
    return t.agg(hit.alias("hit"), F.sum(F.size(F.array_except("g", "f"))).alias("miss"), F.sum(F.size(F.array_except("f", "g"))).alias("extra"), r6(hit / F.sum(F.size("f")), "precision"), r6(hit / F.sum(F.size("g")), "recall"))


@query("q32_selectors", f"""WITH {UTT_SQL}, x AS (SELECT *, [cer, cer_b] AS each, (sim_b > sim)::INT AS pick, (cer_b < cer)::INT AS best FROM utt) SELECT noise, round(avg(each[pick + 1]), 6) AS picked, round(avg(least(cer, cer_b)), 6) AS oracle, round(avg((each[pick + 1] = least(cer, cer_b))::INT), 6) AS accuracy FROM x GROUP BY noise""")
def selectors(spark, d):
    """What a selector's choice of system gives, against the best choice."""
    each = F.array("cer", "cer_b")
    picked = F.element_at(each, F.when(F.col("sim_b") > F.col("sim"), 2).otherwise(1))
    return utterances(spark, d).groupBy("noise").agg(r6(F.avg(picked), "picked"), r6(F.avg(F.array_min(each)), "oracle"), r6(agg.share(picked == F.array_min(each)), "accuracy"))


@query("q33_rescued", f"""WITH {UTT_SQL} SELECT spk, count(*) FILTER (cer >= 0.5 AND cer_b < 0.5) AS rescued, count(*) FILTER (cer >= 0.5 AND cer_b >= 0.5) AS stuck FROM utt GROUP BY spk""")
def rescued(spark, d):
    """Failed rows that another system gets right, and those that none does."""
    bad, good = F.col("cer") >= 0.5, F.col("cer_b") < 0.5
    return utterances(spark, d).groupBy("spk").agg(agg.count_if(bad & good).alias("rescued"), agg.count_if(bad & ~good).alias("stuck"))


@query("q35_adaptive_threshold", f"""WITH {UTT_SQL}, g AS (SELECT unnest([0.0, 0.1, 0.2]) AS raise), x AS (SELECT raise, negative, err, n, sim < CASE WHEN overlap >= 2 THEN 0.2 + raise ELSE 0.2 END AS low FROM utt, g) SELECT round(raise::DOUBLE, 6) AS raise, round(sum(CASE WHEN low THEN n ELSE err END) FILTER (NOT negative) / sum(n) FILTER (NOT negative), 6) AS cer, round(avg(low::INT) FILTER (negative), 6) AS rr FROM x GROUP BY raise""")
def adaptive(spark, d):
    """A higher threshold for polluted rows, by how much higher."""
    rows = utterances(spark, d).withColumn("raise", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.2)])))
    low = F.col("sim") < F.when(F.col("overlap") >= 2, F.lit(0.2) + F.col("raise")).otherwise(0.2)
    pos = ~F.col("negative")
    return rows.groupBy("raise").agg(r6(errors.pooled(F.when(pos, errors.rejected_errors(F.col("err"), F.col("n"), low)), F.when(pos, F.col("n"))), "cer"), r6(F.avg(F.when(~pos, low.cast("double"))), "rr"))


@query("q37_backends_equal", f"""WITH {UTT_SQL} SELECT count(*) AS n, count(*) FILTER (hyp = hyp_b) AS identical, round(avg(cer_b - cer), 6) AS delta, round(sum(wall_sec) / sum(audio_sec), 6) AS rtf, round(avg(wall_sec / audio_sec), 6) AS mean_rtf FROM utt""")
def backends(spark, d):
    """How alike two backends are, and both kinds of real-time factor."""
    w, a = F.col("wall_sec"), F.col("audio_sec")
    return utterances(spark, d).agg(F.count(F.lit(1)).alias("n"), agg.count_if(F.col("hyp") == F.col("hyp_b")).alias("identical"), r6(F.avg(F.col("cer_b") - F.col("cer")), "delta"), r6(F.sum(w) / F.sum(a), "rtf"), r6(F.avg(w / F.nullif(a, F.lit(0.0))), "mean_rtf"))


@query("q38_wide_export", f"""WITH {UTT_SQL} SELECT printf('utt%04d_cmd_%d', uid, uid) AS id, ref, hyp, CASE WHEN cer < 0.5 THEN '✓' ELSE '✗' END AS flag FROM utt""")
def wide_export(spark, d):
    """A table for people, with keys and flags."""
    return utterances(spark, d).select(F.format_string("utt%04d_cmd_%d", "uid", "uid").alias("id"), "ref", "hyp", F.when(F.col("cer") < 0.5, "✓").otherwise("✗").alias("flag"))


@query("q13_rescue_rules", f"""WITH {UTT_SQL}, x AS (SELECT *, sim < {THR} AS base, sim_b > 0.8 AS r1, verdict = 'accept' AS r2 FROM utt) SELECT count(*) FILTER (base AND NOT negative) AS lost, count(*) FILTER (base AND NOT negative AND r1) AS rescued_1, count(*) FILTER (base AND NOT negative AND NOT r1 AND r2) AS rescued_2, count(*) FILTER (base AND negative AND (r1 OR r2)) AS leaked FROM x""")
def rescue_rules(spark, d):
    """What rules, one after another, bring back, and what they let through."""
    base, r1, r2, neg = F.col("sim") < THR, F.col("sim_b") > 0.8, F.col("verdict") == "accept", F.col("negative")
    return utterances(spark, d).agg(agg.count_if(base & ~neg).alias("lost"), agg.count_if(base & ~neg & r1).alias("rescued_1"), agg.count_if(base & ~neg & ~r1 & r2).alias("rescued_2"), agg.count_if(base & neg & (r1 | r2)).alias("leaked"))


@query("m14_net_sweep", f"""WITH {UTT_SQL}, s AS (SELECT sim_b AS thr, count(*) FILTER (negative) AS p, count(*) FILTER (NOT negative) AS q FROM utt GROUP BY sim_b) SELECT round(thr, 6) AS thr, sum(p) OVER (ORDER BY thr)::BIGINT AS caught, sum(q) OVER (ORDER BY thr)::BIGINT AS killed, round(30.0 * sum(p) OVER (ORDER BY thr) / sum(p) OVER () - 40.0 * sum(q) OVER (ORDER BY thr) / sum(q) OVER (), 6) AS net FROM s""")
def net_sweep(spark, d):
    """Net score of rejecting up to each threshold."""
    c = windows.cumulative(utterances(spark, d), "sim_b", {"p": agg.count_if(F.col("negative")), "q": agg.count_if(~F.col("negative"))})
    net = sweep.REJECT_LEG * F.col("p_upto") / F.col("p_all") - sweep.CER_LEG * F.col("q_upto") / F.col("q_all")
    return c.select(r6(F.col("sim_b"), "thr"), F.col("p_upto").alias("caught"), F.col("q_upto").alias("killed"), r6(net, "net"))


@query("m10_signal_report", f"""WITH {UTT_SQL}, l AS (SELECT 'sim' AS signal, negative, sim AS v FROM utt UNION ALL SELECT 'sim_b', negative, sim_b FROM utt UNION ALL SELECT 'cer', negative, cer FROM utt) SELECT signal, negative, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.5), 6) AS median FROM l GROUP BY 1, 2""")
def signal_report(spark, d):
    """Moments and medians of several signals by class, in one pass."""
    long = utterances(spark, d).select("negative", F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("v")) for c in ("sim", "sim_b", "cer")])).alias("s")).select("negative", "s.*")
    return long.groupBy("signal", "negative").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v"), "mean"), r6(F.stddev_pop("v"), "sd"), r6(F.percentile("v", F.lit(0.5)), "median"))


@query("m25_group_response", """WITH g AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS np, count(*) FILTER (l_returnflag <> 'N') AS na, avg(l_discount) FILTER (l_returnflag = 'N') AS sp, avg(l_discount) FILTER (l_returnflag <> 'N') AS sa FROM lineitem GROUP BY 1) SELECT l_orderkey, round(sp - sa, 6) AS response FROM g WHERE np = 2 AND na = 1""")
def responses(spark, d):
    """Present less absent, where a group has two and one."""
    li = read(spark, d, "lineitem").withColumn("present", F.col("l_returnflag") == "N")
    return protocol.group_response(li, "l_orderkey", "present", "l_discount").withColumn("response", F.round("response", 6))


@query("m26_gate", f"""WITH {UTT_SQL}, m AS (SELECT avg(cer) AS c, avg((sim < {THR})::INT) FILTER (negative) AS r FROM utt) SELECT c <= 0.9 AND r >= 0.2 AND false AS passed, c <= 0.9 AS cer, r >= 0.2 AS rr FROM m""")
def quality_gate(spark, d):
    """Metrics against bounds set before; one that is missing fails."""
    m = utterances(spark, d).agg(F.avg("cer").alias("cer"), F.avg(F.when(F.col("negative"), (F.col("sim") < THR).cast("double"))).alias("rr"))
    m = m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in ("cer", "rr")])).alias("m")).select("m.*")
    rules = spark.createDataFrame([("cer", "<=", 0.9), ("rr", ">=", 0.2), ("rtf", "<=", 1.0)], "name string, op string, bound double")
    return protocol.gate(m, rules).select("passed", F.col("checks")["cer"].alias("cer"), F.col("checks")["rr"].alias("rr"))


@query("j5_semi", """SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def semi(spark, d):
    """Customers with an urgent order."""
    urgent = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("j16_label_matrix", """WITH m AS (SELECT user_id, list_distinct(list(event_type)) AS s FROM events WHERE value > 120 GROUP BY 1), b AS (SELECT event_type AS spk, min(event_id) AS q FROM events GROUP BY 1)
SELECT user_id, count(q) AS present, 5 - count(q) AS absent FROM (SELECT user_id, unnest(s) AS spk FROM m) LEFT JOIN b USING (spk) GROUP BY 1""")
def label_matrix(spark, d):
    """Queries of a bank that each mixture holds, and how many it doesn't."""
    e = read(spark, d, "events")
    m = e.where("value > 120").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    out = protocol.label_matrix(m, e.select("event_type", "event_id"), "user_id", "s", "event_id", "event_type")
    return out.select("user_id", F.size("present").cast("long").alias("present"), F.col("absent").cast("long").alias("absent"))


@query("i7_ghosts", f"""WITH {SEG_SQL}, d AS (SELECT rec, spk, sum(e - s) AS total FROM seg GROUP BY 1, 2), o AS (SELECT a.rec, a.spk, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS lap FROM seg a JOIN seg b ON a.rec = b.rec AND a.spk <> b.spk AND a.s < b.e AND b.s < a.e GROUP BY 1, 2)
SELECT rec, count(*) FILTER (total < 500000000 OR coalesce(lap, 0) > 0.8 * total) AS ghosts, count(*) AS speakers FROM d LEFT JOIN o USING (rec, spk) GROUP BY rec""")
def ghosts(spark, d):
    """Speakers that are too short or nearly always overlapped."""
    s = segments(spark, d)
    total = s.groupBy("rec", "spk").agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    met = joins.overlapping(s.drop("seg"), s.select("rec", "start", "end", F.col("spk").alias("other")), "rec", 600e6).where("spk <> other")
    lap = met.groupBy("rec", "spk").agg(F.sum(F.least("end", "other_end") - F.greatest("start", "other_start")).alias("lap"))
    ghost = (F.col("total") < 500000000) | (F.coalesce("lap", F.lit(0)) > 0.8 * F.col("total"))
    return total.join(lap, ["rec", "spk"], "left").groupBy("rec").agg(agg.count_if(ghost).alias("ghosts"), F.count(F.lit(1)).alias("speakers"))


@query("w7_hopping_windows", """WITH h AS (SELECT event_type, time_bucket(INTERVAL '6 hours', ts) - o AS b, value FROM events, (VALUES (INTERVAL '0 hours'), (INTERVAL '6 hours')) t(o)) SELECT event_type, b AS "start", count(*) AS n, round(max(value), 6) AS most FROM h GROUP BY 1, 2""")
def hopping(spark, d):
    """Windows of twelve hours, every six."""
    e = read(spark, d, "events")
    told = e.groupBy("event_type", F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), r6(F.max("value"), "most"))
    return told.select("event_type", F.col("w.start").alias("start"), "n", "most")


@query("c2_weighted_choice", """WITH u AS (SELECT ('0x' || substr(md5(concat(o_orderkey, '|snr|0')), 1, 8))::BIGINT / 4294967296.0 AS h FROM orders) SELECT CASE WHEN h < 0.5 THEN 'low' WHEN h < 0.8 THEN 'mid' ELSE 'high' END AS snr, count(*) AS n FROM u GROUP BY 1""")
def weighted_choice(spark, d):
    """Draws from weighted buckets."""
    return sampling.weighted_choice(read(spark, d, "orders"), "o_orderkey", [("low", 0.5), ("mid", 0.3), ("high", 0.2)], "snr").groupBy("snr").agg(F.count(F.lit(1)).alias("n"))


@query("c14_exclusion", """SELECT count(*) AS n, count(DISTINCT o_custkey) AS speakers FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def exclusion(spark, d):
    """Rows of speakers that no earlier manifest has."""
    gone = read(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").join(gone, "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("speakers"))


@query("p9_rule_map", """SELECT p_type, CASE p_type WHEN 'ECONOMY' THEN '0' WHEN 'SMALL' THEN '6' END AS atten, count(*) AS n FROM part GROUP BY 1, 2""")
def rule_map(spark, d):
    """A rule table given as text."""
    rule = F.str_to_map(F.lit("ECONOMY:0,SMALL:6"), F.lit(","), F.lit(":"))
    return read(spark, d, "part").groupBy("p_type", rule[F.col("p_type")].alias("atten")).agg(F.count(F.lit(1)).alias("n"))


@query("t31_repetition", f"""WITH {UTT_SQL}, g AS (SELECT uid, hyp, list_transform(range(1, length(hyp)), lambda i: substr(hyp, i, 2)) AS x FROM utt) SELECT uid, CASE WHEN length(hyp) >= 2 THEN round(1 - len(list_distinct(x)) / len(x), 6) END AS repeat_2 FROM g""")
def repetition(spark, d):
    """How far bigrams repeat."""
    return utterances(spark, d).select("uid", r6(text.repeat_rate(F.col("hyp"), 2), "repeat_2"))


@query("t8_pooled_by_policy", f"""WITH {UTT_SQL} SELECT overlap, sum(CASE WHEN sim < {THR} THEN n ELSE least(err, err_b) END)::BIGINT AS errors, sum(n)::BIGINT AS units FROM utt WHERE NOT negative GROUP BY overlap""")
def oracle_with_reject(spark, d):
    """The better of two systems, with rejection."""
    best = stats.oracle_pick({"a": F.col("err"), "b": F.col("err_b")})["errors"]
    return utterances(spark, d).where(~F.col("negative")).groupBy("overlap").agg(F.sum(errors.rejected_errors(best, F.col("n"), F.col("sim") < THR)).alias("errors"), F.sum("n").alias("units"))


@query("v5_class_spread", """WITH e AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY 1, 2), a AS (SELECT label, list(m ORDER BY i) AS c FROM p GROUP BY 1)
SELECT label, count(*) AS n, round(avg(list_cosine_similarity(v, c)), 6) AS mean, round(min(list_cosine_similarity(v, c)), 6) AS least FROM e JOIN a USING (label) GROUP BY label""")
def class_spread(spark, d):
    """How near a class's vectors are to their mean."""
    from voxmeter.operators.intervals import mean_vectors

    e = read(spark, d, "embeddings")
    sim = vectors.cosine(F.col("embedding"), F.col("mean"))
    return e.join(mean_vectors(e, "label", "embedding"), "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(sim), "mean"), r6(F.min(sim), "least"))
