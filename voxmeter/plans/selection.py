"""Queries that choose: submissions, taxonomies, corrections, bootstraps, hold-outs, systems, routes, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.functions import errors, hashing, scores, text, vectors
from voxmeter.operators import aggregates as agg
from voxmeter.operators import intervals, protocol, sampling, stats, sweep, windows
from voxmeter.plans.evaluation import CURVE_SQL, THR, r6
from voxmeter.plans.fixtures import UTT_SQL, read, utterances, weight_sql
from voxmeter.plans.registry import query
from voxmeter.sources import sinks


def numeral_sql(n: str) -> str:
    """SQL of a number from 1 to 99 in Chinese numerals."""
    digit = lambda x: f"substr('一二三四五六七八九', {x}, 1)"
    ones = f"CASE WHEN {n} % 10 = 0 THEN '' ELSE {digit(f'({n} % 10)')} END"
    return f"(CASE WHEN {n} < 10 THEN {digit(n)} ELSE CASE WHEN {n} < 20 THEN '十' ELSE {digit(f'({n} // 10)::INT')} || '十' END || {ones} END)"


@query("q1_summary", f"""WITH {UTT_SQL} SELECT round(sum(CASE WHEN sim < {THR} THEN n ELSE err END) FILTER (NOT negative) / sum(n) FILTER (NOT negative), 3) AS final_cer, round(avg((sim < {THR})::INT) FILTER (negative), 4) AS avg_rr, round(sum(wall_sec), 3) AS duration FROM utt""")
def submission_summary(spark, d):
    """A submission's pooled rate, reject rate and seconds."""
    u = utterances(spark, d).select(F.col("uid").alias("id"), F.when(F.col("negative"), "").otherwise(F.col("ref")).alias("ref"), F.col("wall_sec").alias("infer_sec"), F.col("hyp").alias("text"), (F.col("sim") < THR).alias("rejected"))
    manifest = u.select("id", "ref", "infer_sec")
    return sinks.submission_summary(sinks.submission(u.select("id", "text", "rejected"), manifest), manifest)


@query("q11_taxonomy", """WITH x AS (SELECT p_size % 4 AS k FROM part) SELECT CASE k WHEN 0 THEN '标点' WHEN 1 THEN '数字错误' WHEN 2 THEN '增字' ELSE '英文品牌名' END AS class, count(*) AS n, sum(CASE WHEN k = 0 THEN 0 ELSE 1 END)::BIGINT AS edits FROM x GROUP BY 1""")
def taxonomy(spark, d):
    """Rows by the class of their errors, from the classes of their edits."""
    ref = text.normalize(F.col("p_brand"), True)
    k = F.col("p_size") % 4
    hyp = F.when(k == 0, ref).when(k == 1, F.concat(ref, F.lit("7"))).when(k == 2, F.concat(ref, F.lit("灯"))).otherwise(F.substr(ref, F.lit(2)))
    ops = read(spark, d, "part").select(ref.alias("ref"), hyp.alias("hyp")).withColumn("ops", text.edit_script(F.col("ref"), F.col("hyp")))
    told = ops.withColumn("cer", errors.rate(F.size("ops").cast("long"), F.length("ref").cast("long")))
    each = told.select(text.row_class(F.col("ref"), F.col("hyp"), F.col("cer"), F.transform("ops", lambda op: text.edit_class(op))).alias("class"), F.size("ops").alias("m"))
    return each.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("edits"))


@query("t16_spelled", f"""SELECT concat('调到', {numeral_sql('p_size')}, '度占百分之', {numeral_sql('p_size')}, '编号10234') AS said, count(*) AS n FROM part GROUP BY 1""")
def spelled(spark, d):
    """Numbers and percentages in words; long numbers stay."""
    said = text.spell_digits(F.concat(F.lit("调到"), F.col("p_size").cast("string"), F.lit("度占"), F.col("p_size").cast("string"), F.lit("%编号10234")))
    return read(spark, d, "part").groupBy(said.alias("said")).agg(F.count(F.lit(1)).alias("n"))


@query("t17_read", """SELECT concat('一百', CASE WHEN p_size < 10 THEN '' ELSE substr('一二三四五', (p_size // 10)::INT, 1) || '十' END, CASE WHEN p_size % 10 = 0 THEN '' ELSE substr('一二三四五六七八九', p_size % 10, 1) END, '点零五') AS said, count(*) AS n FROM part GROUP BY 1""")
def read_numbers(spark, d):
    """Numbers read with units, decimals digit by digit."""
    return read(spark, d, "part").groupBy(text.read_digits(F.concat((F.col("p_size") + 100).cast("string"), F.lit(".05"))).alias("said")).agg(F.count(F.lit(1)).alias("n"))


@query("t18_submitted", f"""SELECT concat('开', {numeral_sql('p_size')}, '度轻干洗') AS said, count(*) AS n FROM part GROUP BY 1""")
def submitted(spark, d):
    """The whole chain before a text is handed in."""
    told = text.submitted(F.concat(F.lit("開"), F.col("p_size").cast("string"), F.lit("度轻干喜")), "開", "开", {"洗": "xi3", "喜": "xi3"})
    return read(spark, d, "part").groupBy(told.alias("said")).agg(F.count(F.lit(1)).alias("n"))


@query("q12_replacements", f"""WITH {UTT_SQL}, c AS (SELECT uid, string_split(ref, '') AS a, string_split(hyp_b, '') AS b FROM utt WHERE length(ref) = length(hyp_b)),
u AS (SELECT uid, unnest(a) AS x, unnest(b) AS y FROM c), k AS (SELECT uid, x, y, count(*) OVER (PARTITION BY uid) AS m FROM u WHERE x <> y), p AS (SELECT y AS wrong, x AS "right", count(*) AS n FROM k WHERE m = 1 GROUP BY 1, 2 HAVING count(*) >= 2),
b AS (SELECT wrong, arg_max("right", (n, "right")) AS best FROM p GROUP BY wrong), s AS (SELECT uid, i, substr(hyp_b, i, 1) AS ch FROM (SELECT uid, hyp_b, unnest(range(1, length(hyp_b) + 1)) AS i FROM utt)),
f AS (SELECT uid, string_agg(coalesce(best, ch), '' ORDER BY i) AS fixed FROM s LEFT JOIN b ON wrong = ch GROUP BY uid),
e AS (SELECT err_b, n, levenshtein(nr, regexp_replace(lower(coalesce(fixed, '')), '[\\p{{P}}\\s]', '', 'g')) AS after FROM utt LEFT JOIN f USING (uid)) SELECT count(*) FILTER (after < err_b) AS better, count(*) FILTER (after > err_b) AS worse, round(sum(err_b) / sum(n), 6) AS before, round(sum(after) / sum(n), 6) AS after FROM e""")
def replacement_scheme(spark, d):
    """Single characters put right by what was mined, and what that does to the rates."""
    u = utterances(spark, d)
    pairs = sampling.replacement_pairs(u, "ref", "hyp_b").where("n >= 2").groupBy("wrong").agg(F.collect_list(F.struct(F.col("right").alias("char"), "n")).alias("to"))
    # One row: a map over the characters of a script.
    better = pairs.agg(F.map_from_entries(F.collect_list(F.struct("wrong", "to"))).alias("better"))
    after = errors.errors(text.apply_replacements(F.col("hyp_b"), F.col("better")), F.col("ref"), ascii_only=True)
    rows = u.crossJoin(F.broadcast(better)).select("err_b", "n", after.alias("after"))
    b, a = F.col("err_b"), F.col("after")
    return rows.agg(agg.count_if(a < b).alias("better"), agg.count_if(a > b).alias("worse"), r6(errors.pooled(b, F.col("n")), "before"), r6(errors.pooled(a, F.col("n")), "after"))


@query("t13_loops", """SELECT event_id % 3 >= 1 AS cyclic, event_id % 3 = 2 AS loop, count(*) AS n FROM events GROUP BY 1, 2""")
def loops(spark, d):
    """Texts that repeat a piece twice, and three times."""
    t = F.expr("repeat(substr(concat(event_type, 'xyzq'), 1, 4), CAST(event_id % 3 + 1 AS INT))")
    return read(spark, d, "events").select(t.alias("t")).groupBy(text.is_cyclic(F.col("t")).alias("cyclic"), text.is_loop(F.col("t")).alias("loop")).agg(F.count(F.lit(1)).alias("n"))


@query("t38_picks", f"""WITH {UTT_SQL}, x AS (SELECT *, sim >= 0.5 AS a, sim_b >= 0.5 AS b FROM utt) SELECT uid, CASE WHEN a AND b THEN 'longest' WHEN a OR b THEN 'unique' ELSE 'none' END AS mode, CASE WHEN a AND b THEN CASE WHEN length(hyp_b) > length(hyp) THEN hyp_b ELSE hyp END WHEN a THEN hyp WHEN b THEN hyp_b ELSE '' END AS text FROM x""")
def picks(spark, d):
    """One of several speakers' texts."""
    by = lambda a, b: F.create_map(F.lit("a"), a, F.lit("b"), b)
    said = lambda c: F.when(F.col(c) >= 0.5, "accept").otherwise("reject")
    return utterances(spark, d).select("uid", protocol.pick_of_many(by(F.col("hyp"), F.col("hyp_b")), by(said("sim"), said("sim_b"))).alias("p")).select("uid", "p.mode", "p.text")


@query("t41_drift", r"""WITH x AS (SELECT concat(substr(p_name, 1, p_size % 9), repeat('灯', p_size % 7)) AS t FROM part), y AS (SELECT length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS l FROM x) SELECT l >= 4 AND a / greatest(l, 1) > 0.4 AS drifted, count(*) AS n FROM y GROUP BY 1""")
def drift(spark, d):
    """Texts that drifted into English."""
    t = F.expr("concat(substr(p_name, 1, p_size % 9), repeat('灯', p_size % 7))")
    return read(spark, d, "part").groupBy(text.drifted(t).alias("drifted")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_active", """SELECT event_type, count(*) AS n FROM events WHERE value > 10 OR event_id % 5 = 0 GROUP BY event_type""")
def active(spark, d):
    """Annotated rows: those with a tag or a note."""
    tags, note = F.when(F.col("value") > 10, F.array(F.lit("high"))).otherwise(F.array().cast("array<string>")), F.when(F.col("event_id") % 5 == 0, " seen ")
    return read(spark, d, "events").where(scores.active(tags, note)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("p12_first_rows", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100""")
def first_rows(spark, d):
    """The first hundred rows in the order of the input, told by its ordinal."""
    rows = read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return rows.orderBy("file", "at").limit(100).select("o_orderkey", "o_totalprice")


@query("p13_guard", """SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderpriority LIKE '%URGENT%') AS marked, count(DISTINCT o_orderpriority) AS strings FROM orders GROUP BY 1""")
def guard(spark, d):
    """Rows whose nested values hold a marker anywhere, and the distinct strings in them."""
    o = read(spark, d, "orders").select("o_orderstatus", F.struct(F.struct("o_custkey", F.array("o_orderpriority").alias("deep")).alias("in")).alias("nested"))
    strings = scores.nested_strings(F.col("nested"), o.schema["nested"].dataType)
    told = o.select("o_orderstatus", scores.holds_marker(F.col("nested"), "URGENT").alias("marked"), F.explode(strings).alias("s"))
    return told.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), agg.count_if(F.col("marked")).alias("marked"), F.countDistinct("s").alias("strings"))


@query("j14_factorial", """WITH s AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier), g AS (SELECT s_suppkey AS target, ov AS overlap, snr, (r + ov + snr + 1) % n AS pick FROM s, (VALUES (0), (2), (4)) a(ov), (VALUES (0), (5), (10)) b(snr))
SELECT target, overlap, snr, s_suppkey AS interferer, s_name AS name FROM g JOIN s ON r = pick""")
def factorial(spark, d):
    """Each target in each cell of a grid of conditions, with another supplier as interferer, by dense numbers."""
    s = read(spark, d, "supplier")
    numbered = sampling.numbered(s.select("s_suppkey", "s_name"), "s_suppkey")
    grid = numbered.select(F.col("s_suppkey").alias("target"), "place", "all", F.explode(F.array(*map(F.lit, (0, 2, 4)))).alias("overlap")).withColumn("snr", F.explode(F.array(*map(F.lit, (0, 5, 10)))))
    picked = grid.select("target", "overlap", "snr", ((F.col("place") + F.col("overlap") + F.col("snr")) % F.col("all") + 1).alias("place"))
    return picked.join(numbered.select("place", F.col("s_suppkey").alias("interferer"), F.col("s_name").alias("name")), "place").select("target", "overlap", "snr", "interferer", "name")


@query("c4_pairs", """WITH c AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS n FROM customer WHERE c_custkey % 3 <> 1), t AS (SELECT c_custkey AS target, (r + k * 7 - 1) % n + 1 AS pick FROM c, range(1, 4) x(k)) SELECT target, c_custkey AS other, c_mktsegment AS segment FROM t JOIN c ON r = pick WHERE target <> c_custkey""")
def pairs(spark, d):
    """Three interferers for each target by their dense numbers, whatever gaps the ids have; never the target itself."""
    c = sampling.numbered(read(spark, d, "customer").where("c_custkey % 3 <> 1").select("c_custkey", "c_mktsegment"), "c_custkey")
    t = c.select(F.col("c_custkey").alias("target"), "place", "all", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select("target", ((F.col("place") + F.col("k") * 7 - 1) % F.col("all") + 1).alias("place"))
    return t.join(c.select("place", F.col("c_custkey").alias("other"), F.col("c_mktsegment").alias("segment")), "place").where("target <> other").select("target", "other", "segment")


@query("j19_positional", """SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax) - 1)::INT AS place, l_quantity AS a, l_tax AS b FROM lineitem""")
def positional(spark, d):
    """Two lists side by side, by place."""
    lists = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_tax"))).alias("x"))
    return lists.select("l_orderkey", F.posexplode(F.arrays_zip(F.col("x.l_quantity").alias("a"), F.col("x.l_tax").alias("b"))).alias("place", "z")).select("l_orderkey", "place", "z.a", "z.b")


@query("j20_merged_views", """SELECT event_id, (value + round(value, 0)) / 2 AS mean FROM events""")
def merged_views(spark, d):
    """Means of two views of the same rows; views of other rows raise."""
    e = read(spark, d, "events")
    both = e.select("event_id", F.col("value").alias("a")).join(e.select("event_id", F.round("value", 0).alias("b"), F.lit(1).alias("there")), "event_id", "full_outer")
    ok = F.col("a").isNotNull() & F.col("there").isNotNull()
    return both.select("event_id", F.when(ok, (F.col("a") + F.col("b")) / 2).otherwise(F.raise_error(F.lit("views of other rows"))).alias("mean"))


@query("a25_metric_means", """SELECT user_id, event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def metric_means(spark, d):
    """Means over whatever metrics the rows name."""
    e = read(spark, d, "events").select("user_id", F.explode(F.create_map("event_type", "value")).alias("metric", "v"))
    return e.groupBy("user_id", "metric").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v"), "mean"))


@query("a28_lineage", """WITH u AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT p_brand, count(*) AS sources, count(DISTINCT sha256(p_name)) AS digests, min(n) AS least, max(n) AS most FROM u JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def lineage(spark, d):
    """How often each source is used, by digest of what it is."""
    used = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return used.join(read(spark, d, "part"), "p_partkey").groupBy("p_brand").agg(F.count(F.lit(1)).alias("sources"), F.countDistinct(F.sha2("p_name", 256)).alias("digests"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("w16_sessions", """WITH s AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS m FROM s) SELECT a.user_id, a.day::VARCHAR AS day, b.day::VARCHAR AS other FROM k a JOIN k b ON a.user_id = b.user_id AND b.i = (a.i + 1 + a.user_id % (a.m - 1)) % a.m WHERE a.m > 1""")
def sessions(spark, d):
    """Each session with another one of its user, in a seeded rotation."""
    s = read(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    by = Window.partitionBy("user_id")
    k = s.select("user_id", "day", (F.row_number().over(by.orderBy("day")) - 1).alias("i"), F.count(F.lit(1)).over(by).alias("m")).where("m > 1")
    a = k.select("user_id", F.col("day").cast("string").alias("day"), ((F.col("i") + 1 + F.col("user_id") % (F.col("m") - 1)) % F.col("m")).alias("i"))
    return a.join(k.select("user_id", "i", F.col("day").cast("string").alias("other")), ["user_id", "i"]).select("user_id", "day", "other")


@query("w17_renamed", """SELECT event_id, CASE WHEN k = 1 THEN concat(user_id, '_', event_type) ELSE concat(user_id, '_', event_type, '_', k) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)""")
def renamed(spark, d):
    """Names in a space of their own, repeated ones numbered."""
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    name = F.concat_ws("_", F.col("user_id").cast("string"), "event_type", F.when(F.col("k") > 1, F.col("k").cast("string")))
    return read(spark, d, "events").withColumn("k", k).select("event_id", name.alias("name"))


@query("f11_seeds", """SELECT p_partkey, ('0x' || substr(sha256(p_name), 1, 8))::BIGINT AS high, xor(('0x' || substr(sha256(p_name), 9, 8))::BIGINT, 42) AS low FROM part""")
def seeds(spark, d):
    """A seed from a text: the first eight bytes of its SHA-256, with a base seed."""
    return read(spark, d, "part").select("p_partkey", hashing.text_seed(F.col("p_name"), 42).alias("s")).select("p_partkey", "s.high", "s.low")


@query("f12_pairs", """SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2""")
def pair_keys(spark, d):
    """Pairs whatever their order."""
    key = hashing.pair_key(F.col("l_partkey"), F.col("l_suppkey"))
    return read(spark, d, "lineitem").where("l_partkey <> l_suppkey").select(key.alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


REPLICAS = 8
BOOT = f"{UTT_SQL}, w AS (SELECT *, {weight_sql('uid', 'replicate')} AS w FROM utt, range({REPLICAS}) r(replicate))"


@query("m4_threshold_bootstrap", f"""WITH {BOOT}, t AS (SELECT i / 20.0 AS thr FROM range(21) g(i)), s AS (SELECT replicate, thr::DOUBLE AS thr, (1 - sum(w * CASE WHEN sim < thr THEN 1.0 ELSE cer END) FILTER (NOT negative) / sum(w) FILTER (NOT negative)) * 40 + sum(w * (sim < thr)::INT) FILTER (negative) / sum(w) FILTER (negative) * 30 AS total FROM w, t GROUP BY 1, 2)
SELECT replicate, arg_max(thr, (round(total, 9), -thr)) AS thr FROM s GROUP BY replicate""")
def threshold_bootstrap(spark, d):
    """How the best threshold varies over replicates."""
    u = utterances(spark, d)
    return stats.bootstrap_threshold(u, "uid", "sim", "cer", "negative", sweep.grid(u, 0.0, 0.05, 21), REPLICAS)


@query("m6_mean_interval", f"""WITH {UTT_SQL}, c AS (SELECT spk, sum(cer) AS v, count(*) AS c FROM utt GROUP BY spk), w AS (SELECT *, {weight_sql('spk', 'replicate')} AS w FROM c, range(40) r(replicate)), m AS (SELECT replicate, sum(w * v) / sum(w * c) AS mean FROM w WHERE w > 0 GROUP BY replicate)
SELECT round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi, count(*) AS valid FROM m""")
def mean_interval(spark, d):
    """The interval of a mean, by clusters of speakers; null with too few valid replicates."""
    told = stats.interval(stats.bootstrap_means(utterances(spark, d), "spk", "cer", 40), "mean", 40)
    return told.select(r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"), "valid")


@query("m6_spearman_replicates", f"""WITH {UTT_SQL}, w AS (SELECT *, {weight_sql('uid', 'replicate')} AS w FROM utt, range(4) r(replicate)), x AS (SELECT replicate, sim, cer FROM w, range(w.w)), k AS (SELECT replicate, rank() OVER (PARTITION BY replicate ORDER BY sim) + (count(*) OVER (PARTITION BY replicate, sim) - 1) / 2.0 AS a, rank() OVER (PARTITION BY replicate ORDER BY cer) + (count(*) OVER (PARTITION BY replicate, cer) - 1) / 2.0 AS b FROM x)
SELECT replicate, round(corr(a, b), 6) AS rho FROM k GROUP BY replicate""")
def spearman_replicates(spark, d):
    """Rank correlation in each replicate."""
    return stats.bootstrap_spearman(utterances(spark, d), "uid", "sim", "cer", 4).select("replicate", r6(F.col("rho"), "rho"))


def loso_sql(group: str, feature: str, name: str) -> str:
    """SQL of leave-one-out errors, a CTE named `name`."""
    return f"""{name}_c AS (SELECT DISTINCT h.g, {feature} AS thr FROM (SELECT DISTINCT {group} AS g FROM x) h JOIN x u ON u.{group} <> h.g UNION ALL SELECT DISTINCT {group}, '-infinity'::DOUBLE FROM x),
{name}_f AS (SELECT c.g, thr, sum(CASE WHEN {feature} <= thr THEN err_b ELSE err END) AS errors, count(*) FILTER ({feature} <= thr) AS accepted FROM {name}_c c JOIN x u ON u.{group} <> c.g GROUP BY c.g, thr),
{name}_b AS (SELECT g, thr FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY errors, accepted, thr) AS k FROM {name}_f) WHERE k = 1),
{name} AS (SELECT g, thr, sum(CASE WHEN {feature} <= thr THEN err_b ELSE err END)::BIGINT AS errors, count(*) FILTER ({feature} <= thr) AS accepted FROM {name}_b JOIN x ON {group} = g GROUP BY g, thr)"""


@query("m15_holdout", f"""WITH {UTT_SQL}, x AS (SELECT *, floor(('0x' || substr(md5(concat(uid, '|0')), 1, 8))::BIGINT / 4294967296.0 * 5)::INT AS fold FROM utt), {loso_sql('fold', 'sim', 'o')} SELECT g AS fold, thr, errors FROM o""")
def holdout(spark, d):
    """Thresholds fitted on four folds, used on the fifth."""
    return stats.fit_by_fold(stats.folds(utterances(spark, d), "uid", 5), 5, "sim", "err", "err_b").drop("accepted")


@query("q15_proxies", f"""WITH {UTT_SQL}, x AS (SELECT *, audio_sec AS len FROM utt), {loso_sql('overlap', 'sim', 'o')}, {loso_sql('overlap', 'len', 'p')}, a AS (SELECT 'sim' AS proxy, sum(errors) AS errors, sum(accepted) AS accepted FROM o UNION ALL SELECT 'len', sum(errors), sum(accepted) FROM p)
SELECT proxy, round(errors / (SELECT sum(n) FROM utt), 6) AS loso_cer, accepted::BIGINT AS accepted, row_number() OVER (ORDER BY errors, accepted, proxy) = 1 AS best FROM a""")
def proxies(spark, d):
    """Each proxy's errors when its threshold comes from other speakers' data, and the best one."""
    u = utterances(spark, d).withColumn("len", F.col("audio_sec")).withColumn("grp", F.col("overlap"))
    each = [stats.leave_one_out(u, "grp", p, "err", "err_b").agg(F.sum("errors").alias("errors"), F.sum("accepted").alias("accepted")).select(F.lit(p).alias("proxy"), "errors", "accepted") for p in ("sim", "len")]
    told = sweep.union(each).crossJoin(F.broadcast(u.agg(F.sum("n").alias("units"))))
    # A row for each proxy.
    best = F.row_number().over(Window.orderBy("errors", "accepted", "proxy")) == 1
    return told.select("proxy", r6(F.col("errors") / F.col("units"), "loso_cer"), "accepted", best.alias("best"))


@query("m22_break_even", f"""WITH {UTT_SQL} SELECT round(1 / (1 + 0.9 * count(*) FILTER (negative) / count(*) FILTER (NOT negative)), 6) AS least FROM utt""")
def break_even(spark, d):
    """The precision from which rescuing rejected rows pays."""
    return utterances(spark, d).agg(r6(scores.break_even(agg.count_if(~F.col("negative")), agg.count_if(F.col("negative"))), "least"))


@query("m23_selected_limit", f"""WITH {UTT_SQL}, s AS (SELECT seed, length(hyp) AS len, negative, err, n, ('0x' || right(md5(concat(uid, '|seed=', seed)), 1))::INT % 2 AS half FROM utt, range(3) r(seed)), l AS (SELECT (i * 6 + 6)::INT AS lim FROM range(8) r(i)),
t AS (SELECT seed, half, lim, round((1 - sum(CASE WHEN len <= lim THEN err ELSE n END) FILTER (NOT negative) / sum(n) FILTER (NOT negative)) * 40 + avg((len > lim)::INT) FILTER (negative) * 30, 9) AS total FROM s, l GROUP BY 1, 2, 3), b AS (SELECT seed, arg_max(lim, (total, -lim)) AS lim FROM t WHERE half = 0 GROUP BY seed) SELECT b.seed::INT AS seed, b.lim AS "limit", round(t.total, 6) AS total FROM b JOIN t ON t.seed = b.seed AND t.lim = b.lim AND t.half = 1""")
def selected_limit(spark, d):
    """The longest text to accept, chosen on one half and judged on the other, for several seeds."""
    from voxmeter.operators.sweep import CER_LEG, REJECT_LEG

    u = utterances(spark, d).withColumn("seed", F.explode(F.array(*map(F.lit, range(3)))))
    half = sum((F.when(F.col("seed") == s, hashing.md5_half(F.col("uid"), s)).otherwise(0) for s in range(3)), F.lit(0))
    sums = u.groupBy("seed", half.alias("half"), F.length("hyp").alias("len"), "negative").agg(F.sum("err").alias("e"), F.sum("n").alias("u"), F.count(F.lit(1)).alias("c"))
    met = sums.withColumn("limit", F.explode(F.array(*[F.lit(6 * i + 6) for i in range(8)])))
    kept, pos = F.col("len") <= F.col("limit"), ~F.col("negative")
    cost = F.sum(F.when(pos, F.when(kept, F.col("e")).otherwise(F.col("u")))) / F.sum(F.when(pos, F.col("u")))
    held = F.sum(F.when(~pos & ~kept, F.col("c")).otherwise(0)) / F.sum(F.when(~pos, F.col("c")))
    told = met.groupBy("seed", "half", "limit").agg(F.round((1 - cost) * CER_LEG + held * REJECT_LEG, 9).alias("total"))
    best = told.where("half = 0").groupBy("seed").agg(F.max_by("limit", F.struct("total", -F.col("limit"))).alias("limit"))
    return told.where("half = 1").join(best, ["seed", "limit"]).select("seed", "limit", F.round("total", 6).alias("total"))


@query("m24_agreement", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.label, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT label, count(*) AS n, round(avg(c), 5) AS mean, round(median(c), 5) AS middle, round(quantile_cont(c, 0.1), 5) AS low, round(min(c), 5) AS least FROM p GROUP BY label""")
def agreement(spark, d):
    """How like each other two views of a query are."""
    e = read(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    p = e.join(other, "vec_id").select("label", F.round(vectors.cosine(F.col("embedding"), F.col("o")), 9).alias("c"))
    told = p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 5).alias("mean"), F.round(F.min("c"), 5).alias("least"))
    each = windows.percentiles(p, "c", {"middle": 0.5, "low": 0.1}, ("label",))
    return told.join(each, "label").select("label", "n", "mean", F.round("middle", 5).alias("middle"), F.round("low", 5).alias("low"), "least")


@query("i5_overlaps", """WITH x AS (SELECT l_orderkey * 8 + l_linenumber AS id, (l_quantity * 10)::BIGINT AS q, l_linenumber AS k FROM lineitem) SELECT id, CASE k % 3 WHEN 0 THEN 's' WHEN 1 THEN 'i' ELSE 'c' END AS source, greatest(0, CASE k % 3 WHEN 0 THEN 16 * q WHEN 1 THEN q ELSE greatest(q, 100) END - 20) AS "start", least(9000, CASE k % 3 WHEN 0 THEN 16 * q + 800 WHEN 1 THEN q + 90 ELSE greatest(q, 100) + 50 END + 20) AS "end"
FROM x WHERE least(9000, CASE k % 3 WHEN 0 THEN 16 * q + 800 WHEN 1 THEN q + 90 ELSE greatest(q, 100) + 50 END) > CASE k % 3 WHEN 0 THEN 16 * q WHEN 1 THEN q ELSE greatest(q, 100) END""")
def overlaps(spark, d):
    """Overlaps as they are told, from samples or computed, with some context around them."""
    q, k = (F.col("l_quantity") * 10).cast("long"), F.col("l_linenumber") % 3
    explicit = F.when(k == 0, F.array(F.struct((q / 1000).alias("start"), ((q + 50) / 1000).alias("end"))))
    single = F.when(k == 1, F.struct(q.alias("start"), (q + 90).alias("end")))
    told = intervals.overlap_intervals(explicit, F.lit("seconds"), single, q, F.lit(100).cast("long"), F.lit(50).cast("long"), 9000, 16000)
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.when(k == 0, "s").when(k == 1, "i").otherwise("c").alias("source"), F.explode(told).alias("o"))
    return rows.select("id", "source", intervals.with_context(F.col("o"), 9000, 20).alias("o")).select("id", "source", "o.start", "o.end")


@query("i8_target_seconds", """SELECT user_id, round(CASE WHEN sum(value) FILTER (event_type = 'click') >= 100 THEN sum(value) FILTER (event_type = 'click') ELSE sum(value) END, 4) AS seconds FROM events GROUP BY user_id""")
def target_seconds(spark, d):
    """Seconds of a target's own segments, or of the whole recording where these are too short."""
    own = F.sum(F.when(F.col("event_type") == "click", F.col("value")))
    return read(spark, d, "events").groupBy("user_id").agg(F.round(intervals.target_seconds(own, F.sum("value"), 100), 4).alias("seconds"))


@query("q7_scene_routes", f"""WITH {UTT_SQL}, x AS (SELECT CASE WHEN overlap = 0 THEN 'one' WHEN overlap = 1 THEN 'two' ELSE 'more' END AS speakers, err, err_b, n, verdict = 'accept' AND hyp_b <> '' AS ok FROM utt WHERE NOT negative)
SELECT speakers, count(*) AS n, round(sum(err) / sum(n), 6) AS base, round(sum(err_b) / sum(n), 6) AS other, round(sum(CASE WHEN ok THEN err_b ELSE err END) / sum(n), 6) AS routed, round(sum(least(err, err_b)) / sum(n), 6) AS oracle, count(*) FILTER (ok AND err_b < err) AS recovered, count(*) FILTER (NOT ok) AS fallback FROM x GROUP BY 1""")
def scene_routes(spark, d):
    """Base, other, routed and best possible rates by number of speakers, with what was recovered and what fell back."""
    a, b, n, ok = F.col("err"), F.col("err_b"), F.col("n"), (F.col("verdict") == "accept") & (F.col("hyp_b") != "")
    speakers = F.when(F.col("overlap") == 0, "one").when(F.col("overlap") == 1, "two").otherwise("more")
    return utterances(spark, d).where(~F.col("negative")).groupBy(speakers.alias("speakers")).agg(
        F.count(F.lit(1)).alias("n"), r6(errors.pooled(a, n), "base"), r6(errors.pooled(b, n), "other"), r6(errors.pooled(F.when(ok, b).otherwise(a), n), "routed"),
        r6(errors.pooled(F.least(a, b), n), "oracle"), agg.count_if(ok & (b < a)).alias("recovered"), agg.count_if(~ok).alias("fallback"))


@query("q14_paired", f"""WITH {UTT_SQL}, x AS (SELECT n, CASE WHEN sim < {THR} THEN n ELSE err END AS a, CASE WHEN sim_b < {THR} THEN n ELSE err_b END AS b FROM utt WHERE NOT negative) SELECT count(*) AS rows, round(sum(a) / sum(n), 6) AS raw, round(sum(b) / sum(n), 6) AS enhanced, round(sum(least(a, b)) / sum(n), 6) AS oracle, count(*) FILTER (b < a) AS better, count(*) FILTER (a = b) AS same, count(*) FILTER (b > a) AS worse FROM x""")
def paired(spark, d):
    """Two systems on the same rows, with rejection, and the best of both."""
    rej = lambda e, s: errors.rejected_errors(F.col(e), F.col("n"), F.col(s) < THR)
    x = utterances(spark, d).where(~F.col("negative")).select("n", rej("err", "sim").alias("a"), rej("err_b", "sim_b").alias("b"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    return x.agg(F.count(F.lit(1)).alias("rows"), r6(errors.pooled(a, n), "raw"), r6(errors.pooled(b, n), "enhanced"), r6(errors.pooled(F.least(a, b), n), "oracle"), agg.count_if(b < a).alias("better"), agg.count_if(a == b).alias("same"), agg.count_if(b > a).alias("worse"))


@query("q19_bottlenecks", f"""WITH {UTT_SQL}, g AS (SELECT least(floor(sim * 5), 4)::INT AS bucket, count(*) AS n, avg(cer_b) AS m, avg(cer) AS v FROM utt GROUP BY 1) SELECT bucket, n, round(m, 6) AS strong, round(v, 6) AS base, CASE WHEN n < 10 THEN '样本少' WHEN m > 0.5 THEN '切片瓶颈' WHEN m < 0.3 AND v - m > 0.15 THEN '转写器瓶颈' WHEN v - m > 0.15 THEN '偏转写器' ELSE '混合/两难' END AS verdict FROM g""")
def bottlenecks(spark, d):
    """What limits each bucket of similarity: the audio, the recognizer, or neither clearly; few rows say nothing."""
    g = utterances(spark, d).groupBy(F.least(F.floor(F.col("sim") * 5), F.lit(4)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("cer_b").alias("m"), F.avg("cer").alias("v"))
    return g.select("bucket", "n", r6(F.col("m"), "strong"), r6(F.col("v"), "base"), scores.bottleneck(F.col("m"), F.col("v"), F.col("n")).alias("verdict"))


@query("q23_conditional_merge", """WITH x AS (SELECT o_orderstatus = 'F' AS six, o_orderkey % 3 <> 0 AS has0, o_orderkey % 4 <> 0 AS has6, o_totalprice AS v0, -o_totalprice AS v6 FROM orders)
SELECT CASE WHEN six THEN '6' ELSE '0' END AS wanted, count(*) FILTER (has0 OR has6) AS used, count(*) FILTER (NOT has0 AND NOT has6) AS missing, round(sum(CASE WHEN six AND has6 THEN v6 WHEN six THEN CASE WHEN has0 THEN v0 END WHEN has0 THEN v0 WHEN has6 THEN v6 END), 2) AS total FROM x GROUP BY 1""")
def conditional_merge(spark, d):
    """Of two versions the one that a rule by group wants, else the other one."""
    o = read(spark, d, "orders")
    zero = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_totalprice").alias("v0"))
    six = o.where("o_orderkey % 4 <> 0").select("o_orderkey", (-F.col("o_totalprice")).alias("v6"))
    rule = F.coalesce(F.try_element_at(F.create_map(F.lit("F"), F.lit("6"), F.lit("O"), F.lit("0")), F.col("o_orderstatus")), F.lit("0"))
    both = o.select("o_orderkey", rule.alias("wanted")).join(zero, "o_orderkey", "left").join(six, "o_orderkey", "left")
    v = F.when(F.col("wanted") == "6", F.coalesce("v6", "v0")).otherwise(F.coalesce("v0", "v6"))
    return both.groupBy("wanted").agg(F.count(v).alias("used"), agg.count_if(v.isNull()).alias("missing"), F.round(F.sum(v), 2).alias("total"))


@query("q34_systems", f"""WITH {UTT_SQL}, x AS (SELECT overlap = 0 AS same, 'raw' AS system, err AS e, err, n FROM utt UNION ALL SELECT overlap = 0, 'overlap_only', CASE WHEN overlap = 0 THEN err ELSE err_b END, err, n FROM utt UNION ALL SELECT overlap = 0, 'always', err_b, err, n FROM utt)
SELECT system, count(*) AS rows, round(sum(e) / sum(n), 6) AS pooled_cer, round(avg(err - e), 6) AS improvement, bool_and(e = err) FILTER (same) AS passthrough FROM x GROUP BY system""")
def systems(spark, d):
    """A table of systems: rates, mean improvement, and whether rows without overlap pass unchanged."""
    e = F.col("err")
    sides = {"raw": e, "overlap_only": F.when(F.col("overlap") == 0, e).otherwise(F.col("err_b")), "always": F.col("err_b")}
    x = utterances(spark, d).select("overlap", "err", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("system"), v.alias("e")) for k, v in sides.items()])).alias("s")).select("*", "s.system", "s.e")
    same = F.bool_and(F.when(F.col("overlap") == 0, F.col("e") == e))
    return x.groupBy("system").agg(F.count(F.lit(1)).alias("rows"), r6(errors.pooled(F.col("e"), F.col("n")), "pooled_cer"), r6(F.avg(e - F.col("e")), "improvement"), same.alias("passthrough"))


@query("q34_gate", f"""WITH {UTT_SQL}, t AS (SELECT DISTINCT sim AS thr FROM utt UNION ALL SELECT -1.0 UNION ALL SELECT 1.000001), s AS (SELECT thr, sum(CASE WHEN sim >= thr THEN err - err_b ELSE 0 END)::BIGINT AS gain FROM utt, t GROUP BY thr) SELECT thr::DOUBLE AS thr, gain FROM s ORDER BY gain DESC, thr DESC LIMIT 1""")
def gate_sweep(spark, d):
    """The cosine from which a second system's output is used: the best gain, the larger of equal thresholds."""
    from voxmeter.operators.windows import cumulative

    g = cumulative(utterances(spark, d), "sim", {"g": F.sum(F.col("err") - F.col("err_b"))}, descending=True)
    ends = g.agg(F.max("g_all").alias("all")).select(F.inline(F.array(F.struct(F.lit(-1.0).alias("thr"), F.col("all").alias("gain")), F.struct(F.lit(1.000001).alias("thr"), F.lit(0).cast("long").alias("gain")))))
    every = g.select(F.col("sim").alias("thr"), F.col("g_upto").alias("gain")).unionByName(ends)
    return every.agg(F.max(F.struct("gain", "thr")).alias("b")).select("b.thr", "b.gain")


@query("q39_models", f"""WITH {UTT_SQL}, x AS (SELECT 'a' AS model, err AS e, sim, n FROM utt WHERE NOT negative UNION ALL SELECT 'b', err_b, sim_b, n FROM utt WHERE NOT negative UNION ALL SELECT 'best', least(err, err_b), greatest(sim, sim_b), n FROM utt WHERE NOT negative), t AS (SELECT unnest([0.2, 0.27, 0.4]) AS thr)
SELECT model, thr::DOUBLE AS thr, round(sum(e) / sum(n), 6) AS pooled_cer, round(sum(CASE WHEN sim < thr THEN n ELSE e END) / sum(n), 6) AS rejected_cer FROM x, t GROUP BY 1, 2""")
def models(spark, d):
    """Three models, with and without rejection at several thresholds; one pass."""
    sides = F.array(*[F.struct(F.lit(k).alias("model"), e.alias("e"), s.alias("s")) for k, e, s in (("a", F.col("err"), F.col("sim")), ("b", F.col("err_b"), F.col("sim_b")), ("best", F.least("err", "err_b"), F.greatest("sim", "sim_b")))])
    x = utterances(spark, d).where(~F.col("negative")).select("n", F.explode(sides).alias("m")).select("n", "m.*", F.explode(F.array(*map(F.lit, (0.2, 0.27, 0.4)))).alias("thr"))
    return x.groupBy("model", "thr").agg(r6(errors.pooled(F.col("e"), F.col("n")), "pooled_cer"), r6(errors.pooled(errors.rejected_errors(F.col("e"), F.col("n"), F.col("s") < F.col("thr")), F.col("n")), "rejected_cer"))


@query("q40_verdicts", f"""WITH {UTT_SQL}, x AS (SELECT CASE WHEN hyp = '' THEN 'reject' ELSE verdict END AS verdict, hyp = '' AS short, wall_sec FROM utt) SELECT verdict, count(*) AS n, count(*) FILTER (short) AS shortcut, round(sum(wall_sec) FILTER (NOT short) / greatest(count(*) FILTER (NOT short), 1), 6) AS seconds FROM x GROUP BY verdict""")
def verdict_counts(spark, d):
    """Verdicts, those given without a model as the text is empty, and seconds an item."""
    short = F.col("hyp") == ""
    x = utterances(spark, d).select(F.when(short, "reject").otherwise(F.col("verdict")).alias("verdict"), short.alias("short"), "wall_sec")
    asked = agg.count_if(~F.col("short"))
    return x.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), agg.count_if(F.col("short")).alias("shortcut"), r6(F.sum(F.when(~F.col("short"), F.col("wall_sec"))) / F.greatest(asked, F.lit(1)), "seconds"))


@query("qa4_digests", """SELECT p_brand, count(*) AS n, count(*) FILTER (p_size % 7 = 0) AS wrong FROM part GROUP BY 1""")
def digests(spark, d):
    """Contents whose SHA-256 is not the declared one."""
    from voxmeter.operators.audit import verify_digests

    p = read(spark, d, "part")
    declared = p.select("p_partkey", F.when(F.col("p_size") % 7 == 0, F.sha2(F.concat("p_name", F.lit("!")), 256)).otherwise(F.sha2("p_name", 256)).alias("declared"))
    told = verify_digests(p, declared, "p_partkey", "p_name", "declared")
    return told.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), agg.count_if(~F.col("ok")).alias("wrong"))


@query("qa8_warnings", f"""WITH {UTT_SQL}, g AS (SELECT overlap, sum(wall_sec) / sum(audio_sec) AS rtf, avg((sim < {THR})::INT) FILTER (negative) AS rr FROM utt GROUP BY overlap) SELECT overlap, concat_ws('|', CASE WHEN rtf > 0.1 THEN 'slow' END, CASE WHEN rr < 0.9 THEN 'leaky' END) AS warnings FROM g""")
def warnings(spark, d):
    """Runs that are too slow or let too much through."""
    g = utterances(spark, d).groupBy("overlap").agg((F.sum("wall_sec") / F.sum("audio_sec")).alias("rtf"), F.avg(F.when(F.col("negative"), (F.col("sim") < THR).cast("double"))).alias("rr"))
    return g.select("overlap", F.array_join(scores.reasons(slow=F.col("rtf") > 0.1, leaky=F.col("rr") < 0.9), "|").alias("warnings"))


@query("o3_extremes", f"""WITH {UTT_SQL}, x AS (SELECT uid, overlap, cer, CASE WHEN overlap = 3 AND cer < 0.3 THEN 'hard_but_right' WHEN overlap = 0 AND cer > 0.3 THEN 'easy_but_wrong' END AS kind FROM utt), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE kind WHEN 'hard_but_right' THEN round(cer, 9) ELSE -round(cer, 9) END, uid) AS "rank" FROM x WHERE kind IS NOT NULL) SELECT kind, "rank"::INT AS "rank", uid FROM k WHERE "rank" <= 10""")
def extremes(spark, d):
    """Ten hard rows that went right, and ten easy ones that went wrong."""
    kind = F.when((F.col("overlap") == 3) & (F.col("cer") < 0.3), "hard_but_right").when((F.col("overlap") == 0) & (F.col("cer") > 0.3), "easy_but_wrong")
    x = utterances(spark, d).withColumn("kind", kind).where("kind is not null")
    cer = F.round("cer", 9)
    by = Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "hard_but_right", cer).otherwise(-cer), "uid")
    return x.withColumn("rank", F.row_number().over(by)).where("rank <= 10").select("kind", "rank", "uid")


@query("t39_templates", """SELECT DISTINCT p_type AS cat, concat('请把', ['灯', '空调', '电视'][p_partkey % 3 + 1], '调到', p_size, '档') AS said FROM part""")
def filled(spark, d):
    """Sentences from templates, slots filled by seeded picks, each once in its class."""
    slot = F.element_at(F.array(*map(F.lit, ("灯", "空调", "电视"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, d, "part").select(F.col("p_type").alias("cat"), F.concat(F.lit("请把"), slot, F.lit("调到"), F.col("p_size").cast("string"), F.lit("档")).alias("said")).dropDuplicates(["cat", "said"])


@query("c12_cached_vectors", """SELECT d.doc_id, e.vec_id IS NOT NULL AS hit, len(e.embedding)::INT AS width FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def cached_vectors(spark, d):
    """Manifest rows with the vectors that a cache holds for them."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("hit"), F.size("embedding").alias("width"))
    return read(spark, d, "documents").select("doc_id").join(e, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"), "width")


@query("c11_timings", """WITH x AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS a, l_extendedprice / 1000 AS b, ('0x' || substr(md5(concat(l_orderkey * 8 + l_linenumber, '|7')), 1, 8))::BIGINT / 4294967296.0 AS u FROM lineitem), y AS (SELECT *, u * greatest(a - b / 2, 0) AS s FROM x) SELECT id, round(s, 6) AS "start", round(greatest(least(a, s + b) - s, 0), 6) AS overlap, round(greatest(a, s + b), 6) AS total FROM y""")
def timings(spark, d):
    """A second source's random beginning, and the overlap that it gives."""
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    told = rows.select("id", sampling.placed(F.col("a"), F.col("b"), hashing.unit_hash(F.col("id"), seed=7)).alias("p"))
    return told.select("id", *[r6(F.col(f"p.{c}"), c) for c in ("start", "overlap", "total")])


#: Sentence whose beginnings are commands of any length, in the hold-out query.
SENTENCE = "请把客厅的灯打开再将卧室空调升至二十六度然后关上窗帘"
LIMITS = (15, 18, 20, 22, 25, 30)


@query("q9_gate_holdout", f"""WITH {UTT_SQL}, x AS (SELECT negative, sim < {THR} AS low, err, n, (p_size % 27) AS len, ('0x' || right(md5(concat(uid, '|seed=7')), 1))::INT % 2 AS half FROM utt JOIN part ON p_partkey = uid),
l AS (SELECT unnest([{", ".join(map(str, LIMITS))}, NULL]) AS lim), y AS (SELECT *, low OR (lim IS NOT NULL AND (len = 0 OR len > lim)) AS gone FROM x, l),
t AS (SELECT half, lim, sum(CASE WHEN gone THEN n ELSE err END) FILTER (NOT negative) / sum(n) FILTER (NOT negative) AS cer, avg(gone::INT) FILTER (negative) AS rr FROM y GROUP BY 1, 2),
b AS (SELECT lim FROM t WHERE half = 0 AND lim IS NOT NULL ORDER BY round(0.4 * (1 - cer) + 0.4 * rr, 9) DESC, lim LIMIT 1)
SELECT b.lim AS "limit", round(w.cer, 6) AS cer, round(w.rr, 6) AS reject_rate, round(g.cer, 6) AS gated_cer, round(g.rr, 6) AS gated_reject_rate, round(0.4 * (w.cer - g.cer) + 0.4 * (g.rr - w.rr), 6) AS gain FROM b JOIN t g ON g.lim = b.lim AND g.half = 1 JOIN t w ON w.lim IS NULL AND w.half = 1""")
def gate_holdout(spark, d):
    """A gate's longest command, chosen on one half, and what the gate gains on the other; all lengths in one pass."""
    lengths = read(spark, d, "part").select(F.col("p_partkey").alias("uid"), F.substr(F.lit(SENTENCE), F.lit(1), F.col("p_size") % 27).alias("said"))
    u = utterances(spark, d).join(lengths, "uid").withColumn("half", hashing.md5_half(F.col("uid"), 7))
    pos, low, n = ~F.col("negative"), F.col("sim") < THR, F.col("n")
    gone = {0: low} | {limit: low | ~text.is_command(F.col("said"), limit) for limit in LIMITS}
    told = {limit: F.struct(F.lit(limit).alias("limit"), errors.pooled(F.when(pos, F.when(g, n).otherwise(F.col("err"))), F.when(pos, n)).alias("cer"), F.avg(F.when(~pos, g.cast("double"))).alias("rr")) for limit, g in gone.items()}
    rows = u.groupBy("half").agg(F.array(*[told[limit] for limit in LIMITS]).alias("gated"), told[0].alias("plain"))
    train, held = (F.max(F.when(F.col("half") == h, F.struct("gated", "plain"))) for h in (0, 1))
    total = lambda t: F.round(0.4 * (1 - t["cer"]) + 0.4 * t["rr"], 9)
    best = F.array_max(F.transform("train.gated", lambda t: F.struct(total(t).alias("total"), (-t["limit"]).alias("least"))))
    both = rows.agg(train.alias("train"), held.alias("held")).select((-best["least"]).alias("limit"), F.col("held.plain").alias("w"), "held.gated")
    g = F.filter("gated", lambda t: t["limit"] == F.col("limit"))[0]
    gain = 0.4 * (F.col("w.cer") - F.col("g.cer")) + 0.4 * (F.col("g.rr") - F.col("w.rr"))
    return both.select("limit", "w", g.alias("g")).select("limit", r6(F.col("w.cer"), "cer"), r6(F.col("w.rr"), "reject_rate"), r6(F.col("g.cer"), "gated_cer"), r6(F.col("g.rr"), "gated_reject_rate"), r6(gain, "gain"))


@query("q10_root_cause", f"""WITH {UTT_SQL}, x AS (SELECT CASE WHEN overlap = 0 THEN 1 ELSE 2 END AS speakers, CASE WHEN overlap = 0 THEN 0.0 ELSE sim_b END AS ratio, err, n, length(hyp) > 1.6 * length(ref) AS longer FROM utt WHERE NOT negative),
c AS (SELECT ratio AS v, count(*) AS k, sum(count(*)) OVER (ORDER BY ratio) - count(*) AS b, sum(count(*)) OVER () AS a FROM x WHERE speakers = 2 GROUP BY ratio), q AS (SELECT least(b // greatest(a // 4, 1), 3) + 1 AS part, v FROM c),
y AS (SELECT 'speakers_' || speakers AS grp, ratio, err, n, longer FROM x UNION ALL SELECT 'quartile_' || part::INT, ratio, err, n, longer FROM x JOIN q ON ratio = v WHERE speakers = 2)
SELECT grp, count(*) AS rows, round(sum(err) / sum(n), 6) AS pooled_cer, round(avg(ratio), 6) AS mean_ratio, round(avg(longer::INT), 6) AS overlong FROM y GROUP BY grp""")
def root_cause(spark, d):
    """Whether errors go with overlapped speech: by number of speakers, and by quartile of overlap where there are two."""
    from voxmeter.operators.windows import quartile

    two = F.col("overlap") != 0
    x = utterances(spark, d).where(~F.col("negative")).select(F.when(two, 2).otherwise(1).alias("speakers"), F.when(two, F.col("sim_b")).otherwise(0.0).alias("ratio"), "err", "n", (F.length("hyp") > 1.6 * F.length("ref")).alias("longer"))
    sides = [x.withColumn("grp", F.concat(F.lit("speakers_"), "speakers")), quartile(x.where("speakers = 2"), "ratio").withColumn("grp", F.concat(F.lit("quartile_"), "part"))]
    y = sides[0].select("grp", "ratio", "err", "n", "longer").unionByName(sides[1].select("grp", "ratio", "err", "n", "longer"))
    return y.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), r6(errors.pooled(F.col("err"), F.col("n")), "pooled_cer"), r6(F.avg("ratio"), "mean_ratio"), r6(agg.share(F.col("longer")), "overlong"))


@query("q36_signal_probe", CURVE_SQL + f""", s AS (SELECT count(*) FILTER (NOT negative) AS n_pos, count(*) FILTER (negative) AS n_neg, avg(sim) FILTER (NOT negative) AS mp, avg(sim) FILTER (negative) AS mn FROM utt), o AS (SELECT thr, "precision", recall FROM v WHERE recall >= 0.5 ORDER BY round("precision", 9) DESC, thr LIMIT 1)
SELECT n_pos, n_neg, round(mp, 6) AS mean_pos, round(mn, 6) AS mean_neg, round((SELECT max(f1) FROM v), 6) AS best_f1, round(o.thr, 6) AS thr, round(o."precision", 6) AS "precision", round(o.recall, 6) AS recall FROM s, o""")
def signal_probe(spark, d):
    """How well a signal tells both classes apart, and the smallest threshold of the highest precision at half recall."""
    y = utterances(spark, d).withColumn("y", ~F.col("negative"))
    half = F.when(F.col("recall") >= 0.5, F.struct(F.round("precision", 9).alias("p"), (-F.col("thr")).alias("t"), "precision", "recall"))
    curve = stats.pr_curve(y, "sim", "y").agg(F.max("f1").alias("best_f1"), F.max(half).alias("o"))
    sides = y.agg(agg.count_if(F.col("y")).alias("n_pos"), agg.count_if(~F.col("y")).alias("n_neg"), F.avg(F.when(F.col("y"), F.col("sim"))).alias("mp"), F.avg(F.when(~F.col("y"), F.col("sim"))).alias("mn"))
    # Two tables of one row each.
    one = sides.withColumn("k", F.lit(1)).join(curve.withColumn("k", F.lit(1)), "k")
    return one.select("n_pos", "n_neg", r6(F.col("mp"), "mean_pos"), r6(F.col("mn"), "mean_neg"), r6(F.col("best_f1"), "best_f1"), r6(-F.col("o.t"), "thr"), r6(F.col("o.precision"), "precision"), r6(F.col("o.recall"), "recall"))


@query("qa10_smoke", """SELECT p_type AS noise, count(*) AS n, count(*) FILTER (p_size / 2 NOT BETWEEN 3 AND 20) AS bad_duration, round(avg(p_size / 2), 6) AS mean_duration, round(avg((p_partkey % 4 <> 0)::INT), 6) AS quiet, round(avg((p_partkey % 7 = 0)::INT), 6) AS polluted, count(*) FILTER (p_name = '') AS no_text FROM part GROUP BY 1""")
def smoke(spark, d):
    """A synthetic set's checks by kind of noise: durations out of bounds, shares of quiet and polluted rows, missing texts."""
    sec, key = F.col("p_size") / 2, F.col("p_partkey")
    return read(spark, d, "part").groupBy(F.col("p_type").alias("noise")).agg(F.count(F.lit(1)).alias("n"), agg.count_if(~sec.between(3, 20)).alias("bad_duration"), r6(F.avg(sec), "mean_duration"), r6(agg.share(key % 4 != 0), "quiet"), r6(agg.share(key % 7 == 0), "polluted"), agg.count_if(F.col("p_name") == "").alias("no_text"))


@query("o7_layers", """WITH x AS (SELECT o_orderkey, o_orderstatus, o_totalprice, md5(concat(o_orderkey, '|3')) AS h FROM orders), a AS (SELECT o_orderkey, 'a' AS layer FROM x WHERE o_totalprice > 100000 ORDER BY h, o_orderkey LIMIT 40),
b AS (SELECT o_orderkey, 'b' AS layer FROM x WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY h, o_orderkey LIMIT 40), c AS (SELECT o_orderkey, 'c' AS layer FROM x WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a UNION ALL SELECT o_orderkey FROM b) ORDER BY h, o_orderkey LIMIT 25)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def layered(spark, d):
    """A test set in layers, each sampled from its pool without what the layers before took."""
    pools = {"a": F.col("o_totalprice") > 100000, "b": F.col("o_orderstatus") == "F", "c": F.lit(True)}
    return sampling.layers(read(spark, d, "orders"), "o_orderkey", pools, {"a": 40, "b": 40, "c": 25}, 3).select("o_orderkey", "layer")


@query("c5_rotation", """WITH x AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY ('0x' || substr(md5(concat(c_custkey, '|0')), 1, 8))::BIGINT, c_custkey) - 1 AS i, count(*) OVER () // 3 AS g FROM customer),
y AS (SELECT k, i // 3 AS rank, i % 3 AS c, g, r FROM x, range(6) t(r) WHERE i // 3 < g), z AS (SELECT k, r, (((rank - c * r) % g) + g) % g AS grp, (c + r) % 3 AS role FROM y)
SELECT r::INT AS "round", grp::BIGINT AS grp, max(k) FILTER (role = 0) AS "A", max(k) FILTER (role = 1) AS "B", max(k) FILTER (role = 2) AS "C" FROM z GROUP BY 1, 2""")
def rotated(spark, d):
    """Six rounds of groups of three in which roles rotate and nobody meets anybody twice."""
    return sampling.rotation(read(spark, d, "customer"), "c_custkey", 6).select("round", F.col("grp").cast("long").alias("grp"), "A", "B", "C")
