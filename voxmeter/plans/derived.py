"""Queries over what the tables' columns make: files' bytes, sentences of home commands, runs, phrases, signals, running totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmeter.functions import errors, hashing, phrases, signal, text, vectors
from voxmeter.operators import aggregates as agg
from voxmeter.operators import attribution, corrections, intervals, joins, linkage, sampling, stats, waves, windows
from voxmeter.plans.evaluation import THR, r6
from voxmeter.plans.fixtures import SEG_SQL, UTT_SQL, read, segments, utterances, weight_sql
from voxmeter.plans.registry import query
from voxmeter.sources import pdf
from voxmeter.sources.session import named_dir, spread
from voxmeter.streaming import accumulate, events


@query("s12_pdf_text", """SELECT p_partkey AS id, 3 AS pieces, concat(p_name, ' (', p_brand, ') \\ ', p_type, ' ', p_size) AS said FROM part""")
def pdf_text(spark, d):
    """What PDF streams show that hold each part's name: escaped, in an array, and in hexadecimal."""
    name = F.concat(F.col("p_name"), F.lit(" \\("), F.col("p_brand"), F.lit("\\) \\\\"))
    content = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Length 0 >>\nstream\nBT /F1 9 Tf ("), name, F.lit(") Tj 0 1 Td [("), F.col("p_type"), F.lit(") -20] TJ <"), F.hex(F.col("p_size").cast("string")), F.lit("> Tj ET\nendstream endobj"))
    told = read(spark, d, "part").select(F.col("p_partkey").alias("id"), pdf.pieces(F.encode(content, "UTF-8")).alias("p"))
    return told.select("id", F.size("p").alias("pieces"), F.array_join("p", " ").alias("said"))


@query("s16_running_totals", """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def running_totals(spark, d):
    """Totals by kind of event, taken in by a stream whose state stays at a named path: a later run goes on from there."""
    path = f"{d}/events.parquet"
    # The path's name follows from the files, so other files have totals of their own.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    sums = {"n": F.lit(1), "total": F.col("value")}
    totals = accumulate.Accumulator(spark, named_dir(spark, f"events-{files['n']}-{files['h']}"), ["event_type"], sums)
    totals.update(events.source(spark, path))
    return totals.totals().select("event_type", "n", F.round("total", 4).alias("total"))


@query("t40_candidates", """WITH p AS (SELECT p_partkey AS p, list_concat(string_split(p_name, ' '), [p_type]) AS t FROM part WHERE p_partkey % 25 = 0), s AS (SELECT p_partkey AS id, list_concat([p_type], string_split(p_name, ' ')) AS s FROM part),
m AS (SELECT id, p, t, max(n) AS n FROM s, p, range(1, 3) r(n) WHERE s.s[-n:] = t[1:n] GROUP BY id, p, t), l AS (SELECT id, list_distinct(list(t[n + 1])) AS later FROM m GROUP BY id), f AS (SELECT list_distinct(list(t[1])) AS firsts FROM p)
SELECT s.id, array_to_string(list_sort(list_distinct(list_concat(coalesce(later, []), firsts))), '|') AS candidates FROM s LEFT JOIN l USING (id), f""")
def candidates(spark, d):
    """Words that may come next after each part's words, by a table of phrases: first words, and what goes on after an open beginning."""
    part = read(spark, d, "part")
    words = F.split("p_name", " ")
    known = part.where("p_partkey % 25 = 0").select(F.col("p_partkey").alias("p"), F.concat(words, F.array("p_type")).alias("t"))
    told = phrases.next_tokens(part.select(F.col("p_partkey").alias("id"), F.concat(F.array("p_type"), words).alias("s")), "id", "s", known, "p", "t")
    return told.select("id", F.array_join("candidates", "|").alias("candidates"))


VOCABULARY_SQL = """g AS (SELECT substr(nr, i, k) AS gram FROM (SELECT nr, k, unnest(range(1, length(nr) - k + 2)) AS i FROM utt, (VALUES (2), (3), (4)) t(k))), v AS (SELECT gram FROM g GROUP BY gram HAVING count(*) >= 3),
c0 AS (SELECT uid, string_split(nr, '') AS a, string_split(nb, '') AS b FROM utt WHERE length(nr) = length(nb)), u0 AS (SELECT uid, unnest(a) AS x, unnest(b) AS y FROM c0),
k0 AS (SELECT uid, x, y, count(*) OVER (PARTITION BY uid) AS m FROM u0 WHERE x <> y), p AS (SELECT y AS wrong, x AS "right", count(*) AS n FROM k0 WHERE m = 1 GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _texts(spark, d):
    """Utterances with normalized texts, the vocabulary of 2- to 4-grams seen three times, and pairs (wrong, right, n) seen twice."""
    u = utterances(spark, d).select("uid", "err_b", "n", "ref", text.normalize(F.col("ref"), True).alias("nr"), text.normalize(F.col("hyp_b"), True).alias("nb"))
    words = u.select(F.explode(F.concat(*[text.grams(F.col("nr"), k) for k in (2, 3, 4)])).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c")).where("c >= 3").select("word")
    return u, words, sampling.replacement_pairs(u, "nr", "nb").where("n >= 2")


@query("t23_corrected", f"""WITH RECURSIVE {UTT_SQL}, {VOCABULARY_SQL},
w AS (SELECT gram, i AS place, substr(gram, 1, i - 1) || '*' || substr(gram, i + 1) AS form, substr(gram, i, 1) AS r FROM (SELECT gram, unnest(range(1, length(gram) + 1)) AS i FROM v)),
s AS (SELECT DISTINCT uid, nb, i, k, substr(nb, i, k) AS span FROM (SELECT uid, nb, k, unnest(range(1, length(nb) - k + 2)) AS i FROM utt, (VALUES (2), (3), (4)) t(k))),
f AS (SELECT span, j AS place, substr(span, 1, j - 1) || '*' || substr(span, j + 1) AS form, substr(span, j, 1) AS x FROM (SELECT span, unnest(range(1, length(span) + 1)) AS j FROM (SELECT DISTINCT span FROM s))),
b AS (SELECT span, arg_min(gram, (-w.place, gram)) AS word FROM f JOIN w USING (form, place) JOIN p ON p.wrong = x AND p."right" = r WHERE x <> r GROUP BY span),
c AS (SELECT uid, i, max(k) AS k, arg_max(word, k) AS word FROM s JOIN b USING (span) GROUP BY uid, i),
st AS (SELECT uid, nb, 1::BIGINT AS i, '' AS out FROM utt UNION ALL SELECT st.uid, nb, st.i + coalesce(c.k, 1), out || coalesce(c.word, substr(nb, st.i, 1)) FROM st LEFT JOIN c ON c.uid = st.uid AND c.i = st.i WHERE st.i <= length(nb))
SELECT uid, out AS after, len(list_filter(range(1, length(nb) + 1), lambda j: substr(nb, j, 1) <> substr(out, j, 1)))::INT AS changed FROM st WHERE i > length(nb)""")
def corrected(spark, d):
    """Transcripts with spans one character away from a word put right, longest spans first."""
    u, words, pairs = _texts(spark, d)
    told = corrections.fuzzy_corrected(u, "uid", "nb", words, "word", pairs)
    return told.select("uid", "after", F.size("changes").alias("changed"))


#: Sounds of the letters that the second system confuses, for the scheme that wants equal ones.
SOUNDS = {"i": "i", "y": "i", "r": "r", "l": "l"}


@query("q12_schemes", f"""WITH RECURSIVE {UTT_SQL}, {VOCABULARY_SQL}, m AS (SELECT unnest(['A', 'B', 'B+']) AS scheme), h(x, z) AS (VALUES ('i', 'i'), ('y', 'i'), ('r', 'r'), ('l', 'l')),
q AS (SELECT wrong, "right", n, coalesce(a.z = b.z, false) AS alike FROM p LEFT JOIN h a ON a.x = wrong LEFT JOIN h b ON b.x = "right"),
st AS (SELECT scheme, uid, nb, 1::BIGINT AS i, '' AS out FROM utt, m UNION ALL
  SELECT st.scheme, uid, nb, i + 1, out || coalesce(arg_max(q."right", (q.n, q."right")), substr(nb, i, 1)) FROM st LEFT JOIN q ON q.wrong = substr(nb, i, 1) AND (scheme = 'A' OR (right(out, 1) || q."right") IN (SELECT gram FROM v WHERE length(gram) = 2) OR (q."right" || substr(nb, i + 1, 1)) IN (SELECT gram FROM v WHERE length(gram) = 2)) AND (scheme <> 'B+' OR alike)
  WHERE i <= length(nb) GROUP BY st.scheme, uid, nb, i, out),
e AS (SELECT scheme, err_b, n, levenshtein(nr, out) AS after FROM st JOIN utt USING (uid) WHERE i > length(st.nb))
SELECT scheme, count(*) FILTER (after < err_b) AS better, count(*) FILTER (after > err_b) AS worse, round(sum(err_b) / sum(n), 6) AS before, round(sum(after) / sum(n), 6) AS after FROM e GROUP BY scheme""")
def schemes(spark, d):
    """Three schemes of putting single characters right: by frequency, by known bigrams too, and by equal sound too."""
    u, words, pairs = _texts(spark, d)
    # One row: a map and a list over the characters of a script.
    better = pairs.groupBy("wrong").agg(F.collect_list(F.struct(F.col("right").alias("char"), "n")).alias("to")).agg(F.map_from_entries(F.collect_list(F.struct("wrong", "to"))).alias("better"))
    bigrams = words.where(F.length("word") == 2).agg(F.collect_list("word").alias("bigrams"))
    rows = u.crossJoin(F.broadcast(better)).crossJoin(F.broadcast(bigrams))
    fixed = lambda **more: text.apply_replacements(F.col("nb"), F.col("better"), **more)
    told = {"A": fixed(), "B": fixed(bigrams=F.col("bigrams")), "B+": fixed(bigrams=F.col("bigrams"), sounds=SOUNDS)}
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("scheme"), c.alias("said")) for k, c in told.items()]))
    after = rows.select("err_b", "n", "ref", each).select("scheme", "err_b", "n", errors.errors(F.col("said"), F.col("ref"), ascii_only=True).alias("after"))
    b, a = F.col("err_b"), F.col("after")
    return after.groupBy("scheme").agg(agg.count_if(a < b).alias("better"), agg.count_if(a > b).alias("worse"), r6(errors.pooled(b, F.col("n")), "before"), r6(errors.pooled(a, F.col("n")), "after"))


@query("m21_clusters")
def clusters(spark, d):
    """Voices in each class's vectors: average-linkage clusters. SQL has no word for merging; tests hold it against brute force."""
    e = read(spark, d, "embeddings").where("embedding is not null and label is not null")
    return linkage.clusters(e.select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 0.6)


ROOM = [0.5, 0.25, 0.0, -0.125, 0.0625]


@query("f21_reverb", f"""WITH y AS (SELECT event_type AS sig, event_id + k AS i, value * h AS v FROM events, (VALUES {", ".join(f"({k}, {h}::DOUBLE)" for k, h in enumerate(ROOM))}) t(k, h)), s AS (SELECT sig, i, sum(v) AS v FROM y GROUP BY 1, 2)
SELECT sig, i // 256 AS block, round(sum(v), 6) AS total, round(max(v), 6) AS top FROM (SELECT sig, i, v FROM s UNION ALL SELECT DISTINCT sig, (i // 256) * 256 + j, 0.0 FROM s, range(256) r(j) WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.sig = s.sig AND z.i = (s.i // 256) * 256 + j)) GROUP BY 1, 2 HAVING sum(abs(v)) > 0""")
def reverb(spark, d):
    """Each kind of event as a signal over the events' numbers, in a room of five echoes, block by block."""
    blocks = waves.in_blocks(read(spark, d, "events"), "event_type", "event_id", "value", 256)
    told = waves.convolved(blocks, "event_type", ROOM, 256).where(F.exists("x", lambda v: F.abs(v) > 1e-9))
    return told.select(F.col("event_type").alias("sig"), "block", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.round(F.array_max("x"), 6).alias("top"))


def _pick(words: list[str], place: str) -> str:
    """SQL, for both engines, of one of the words."""
    return f"split_part('{'|'.join(words)}', '|', CAST(({place}) % {len(words)} + 1 AS INT))"


def _sentence(kind: str, k: str) -> str:
    """SQL, for both engines, of a text that meets one of the rules: commands, news, blanks, questions, digits, loops."""
    device, action, feature, question, brand, news = (_pick(w, k) for w in (text.DEVICES, text.ACTIONS, text.FEATURES, text.QUESTIONS, text.BRAND_NAMES, text.NEWS_WORDS))
    return f"CASE {kind} WHEN 0 THEN concat({device}, {action}) WHEN 1 THEN concat('今天', {news}, {_pick(text.NEWS_WORDS, k + ' + 7')}) WHEN 2 THEN '' WHEN 3 THEN concat({feature}, '，', {question}) WHEN 4 THEN concat({brand}, '一二三四五') WHEN 5 THEN repeat({device}, 9) WHEN 6 THEN ' ' ELSE concat({action}, {device}, '哈哈哈哈') END"


SENTENCES = ["p_partkey AS id", f"{_sentence('p_size % 8', 'p_partkey')} AS a", f"{_sentence('p_partkey % 8', 'p_partkey + p_size')} AS b"]
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_held = lambda c, words: f"len(list_filter({_list(words)}, lambda w: contains({c}, w)))"
_run = lambda c: f"coalesce(list_max(list_transform(range(1, length({c}) + 1), lambda i: len(list_filter(range(1, length({c}) - i + 2), lambda k: substr({c}, i, k) = repeat(substr({c}, i, 1), k))))), 0)"
_cjk = lambda c: f"length(regexp_replace({c}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))"
_various = lambda c: f"len(list_distinct(string_split({c}, '')))"

#: side, t of both texts, with whether each is a command and its score.
SCORED_SQL = f"""w AS (SELECT {", ".join(SENTENCES)} FROM part), t AS (SELECT id, 'a' AS side, a AS t FROM w UNION ALL SELECT id, 'b', b FROM w), s AS (SELECT *, regexp_replace(t, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]', '', 'g') AS s FROM t),
f AS (SELECT *, length(s) AS n, {_cjk('s')} AS cjk, {_held('s', text.NEWS_WORDS)} AS snews, {_held('t', text.NEWS_WORDS)} AS news, {_run('s')} AS run, {_various('s')} AS various, coalesce(list_max(list_transform(regexp_extract_all(t, '[零一二三四五六七八九百千万点十0-9]+'), lambda x: length(x))), 0) AS digits,
 {_held('t', text.DEVICES)} > 0 AS h0, {_held('t', text.ACTIONS)} > 0 AS h1, {_held('t', text.FEATURES)} > 0 AS h2, {_held('t', text.QUESTIONS)} > 0 AS h3, {_held('t', text.BRAND_NAMES)} > 0 AS h4 FROM s),
g AS (SELECT *, CASE WHEN trim(t) = '' THEN false ELSE NOT (n = 0 OR cjk = 0 OR (n >= 3 AND cjk < n * 0.5) OR snews > 0 OR n > 22 OR run >= 4 OR (n >= 10 AND various / n < 0.35)) END AS command FROM f),
x AS (SELECT id, side, t, n, command, CASE WHEN trim(t) = '' THEN -5.0 ELSE h0::INT * 2.0 + h1::INT * 2.0 + h2::INT * 1.5 + h3::INT * 2.0 + h4::INT * 3.0 + (h0 AND h1)::INT + (h1 AND h2)::INT + CASE WHEN command THEN 0 ELSE -3 END - 3.0 * news - CASE WHEN digits >= 4 THEN 2 ELSE 0 END
 + CASE WHEN n BETWEEN 3 AND 15 THEN 0.5 WHEN n > 22 THEN -2 WHEN n < 3 THEN -1 ELSE 0 END END::DOUBLE AS score FROM g)"""


@query("t28_scores", f"""WITH {SCORED_SQL} SELECT id, side, t AS said, command, score FROM x""")
def command_scores(spark, d):
    """How like a home command each sentence is, and whether it passes for one: sentences that meet every rule."""
    rows = read(spark, d, "part").selectExpr(*SENTENCES).select("id", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("said")) for s in "ab"])))
    return rows.select("id", "side", "said", text.is_command(F.col("said")).alias("command"), text.command_score(F.col("said")).alias("score"))


@query("t29_routes", f"""WITH {SCORED_SQL}, y AS (SELECT a.id, a.score AS sa, b.score AS sb, a.command AS ca, b.command AS cb, a.n AS na, b.n AS nb FROM x a JOIN x b ON a.id = b.id AND a.side = 'a' AND b.side = 'b')
SELECT id, CASE WHEN abs(sa - sb) >= 1e-6 THEN (sb > sa)::INT WHEN ca <> cb THEN cb::INT WHEN NOT (ca OR cb) THEN 0 ELSE (nb < na)::INT END AS idx, CASE WHEN abs(sa - sb) >= 1e-6 THEN printf('score_%.2f_vs_%.2f', sa, sb) WHEN ca <> cb THEN 'tie_valid_only_one' WHEN NOT (ca OR cb) THEN 'tie_both_invalid_fallback_src0' ELSE 'tie_both_valid_shorter' END AS reason FROM y""")
def routes(spark, d):
    """Which of two transcripts to take, and why."""
    # Step by step, as columns of their own: an expression that another one holds several times is worked out as often.
    rows = spread(read(spark, d, "part").select("p_partkey", "p_size")).selectExpr(*SENTENCES)
    of = lambda what: (F.col(f"a_{what}"), F.col(f"b_{what}"))
    rows = rows.withColumns({f"{c}_marks": text.strip_marks(F.col(c)) for c in "ab"})
    hits = {f"{c}_hit{i}": h for c in "ab" for i, h in enumerate(text.word_hits(F.col(c)))}
    rows = rows.withColumns({f"{c}_command": text.is_command(F.col(c), stripped=F.col(f"{c}_marks")) for c in "ab"} | hits)
    rows = rows.withColumns({f"{c}_score": text.command_score(F.col(c), stripped=F.col(f"{c}_marks"), command=F.col(f"{c}_command"), hits=[F.col(f"{c}_hit{i}") for i in range(len(text.FAMILIES))]) for c in "ab"})
    return rows.select("id", text.pick_route(F.col("a"), F.col("b"), *of("score"), of("marks"), of("command")).alias("r")).select("id", "r.idx", "r.reason")


_limits = lambda p: f"(CASE WHEN t = '' THEN false ELSE run >= {p['run']} OR (n >= {p['len_abs']} AND n / greatest(m, 1) >= {p['len_ratio']}) OR (cjk / greatest(n, 1) < {p['cn']} AND n > 3) OR (various / greatest(n, 1) < {p['div']} AND n >= 10) OR (n >= 6 AND news > 0) OR ({p['short_len']} > 0 AND n <= {p['short_len']} AND pieces = 0) END)"


@query("t30_invented", f"""WITH w AS (SELECT {", ".join(SENTENCES)} FROM part), s AS (SELECT id, trim(a) AS t, b AS r FROM w), f AS (SELECT *, length(t) AS n, length(r) AS m, {_run('t')} AS run, {_cjk('t')} AS cjk, {_various('t')} AS various, {_held('t', text.INVENTED_NEWS)} AS news, {_held('t', text.COMMAND_PIECES)} AS pieces FROM s)
{" UNION ALL ".join(f"SELECT '{k}' AS limits, count(*) AS n, count(*) FILTER ({_limits(p)}) AS invented FROM f" for k, p in text.INVENTED_LIMITS.items())}""")
def invented(spark, d):
    """How many transcripts each of the detector's four sets of limits takes for invented."""
    rows = read(spark, d, "part").selectExpr(*SENTENCES)
    flags = F.array(*[F.struct(F.lit(k).alias("limits"), text.is_invented(F.col("a"), F.col("b"), p).alias("bad")) for k, p in text.INVENTED_LIMITS.items()])
    return rows.select(F.inline(flags)).groupBy("limits").agg(F.count(F.lit(1)).alias("n"), agg.count_if(F.col("bad")).alias("invented"))


ANSWER = "concat(CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN ' (b) ' WHEN 2 THEN '是的，' WHEN 3 THEN 'No: ' WHEN 4 THEN '我说否' ELSE '?' END, p_type, CASE p_partkey % 4 WHEN 0 THEN ' yes' WHEN 1 THEN ' 是' WHEN 2 THEN ' 否' ELSE '' END)"


@query("t36_choices", f"""WITH r AS (SELECT {ANSWER} AS raw FROM part), t AS (SELECT raw, trim(raw) AS t FROM r)
SELECT nullif(regexp_extract(upper(raw), '([AB])', 1), '') AS choice, CASE WHEN regexp_matches(t, '^(是|Yes|yes|YES)') THEN true WHEN regexp_matches(t, '^(否|No|no|NO)') THEN false WHEN contains(t, '是') AND NOT contains(t, '否') THEN true WHEN contains(t, '否') AND NOT contains(t, '是') THEN false
 WHEN contains(lower(t), 'yes') THEN true WHEN contains(lower(t), 'no') THEN false END AS yes, count(*) AS n FROM t GROUP BY 1, 2""")
def choices(spark, d):
    """A or B, and yes or no, from answers in prose."""
    raw = F.expr(ANSWER)
    return read(spark, d, "part").groupBy(text.parse_choice(raw).alias("choice"), text.parse_yes_no(raw).alias("yes")).agg(F.count(F.lit(1)).alias("n"))


RUNS = {"A_s42_r0": "hyp", "A_s42_r1": "CASE WHEN uid % 11 = 0 THEN concat(hyp, 'x') ELSE hyp END", "B1_b1_r0": "CASE WHEN uid % 7 = 0 THEN hyp_b ELSE hyp END", "B2_s1": "hyp_b", "B2_s2": "CASE WHEN uid % 13 = 0 THEN ref ELSE hyp_b END", "B3_gauss": "CASE WHEN uid % 5 = 0 THEN '' WHEN uid % 3 = 0 THEN hyp_b ELSE hyp END", "B4_auguon": "CASE WHEN uid % 17 = 0 THEN ref ELSE hyp END"}


def _runs(spark, d):
    """uid, run, said of seven runs."""
    told = F.array(*[F.struct(F.lit(k).alias("run"), F.expr(c).alias("said")) for k, c in RUNS.items()])
    return utterances(spark, d).select("uid", F.inline(told))


@query("q8_root_causes", f"""WITH {UTT_SQL}, r AS (SELECT uid, {", ".join(f"{c} AS {k}" for k, c in RUNS.items())} FROM utt), o AS (SELECT *, A_s42_r0 <> A_s42_r1 AS r1, A_s42_r0 <> '' AND B1_b1_r0 <> '' AND B1_b1_r0 <> A_s42_r0 AS r2, B2_s1 <> B2_s2 AS r5, A_s42_r0 <> '' AND B3_gauss <> '' AND B3_gauss <> A_s42_r0 AS r3, A_s42_r0 <> '' AND B4_auguon <> '' AND B4_auguon <> A_s42_r0 AS r4 FROM r)
SELECT uid, concat_ws('|', CASE WHEN r1 THEN 'R1_gpu_nondeterminism' END, CASE WHEN r2 THEN 'R2_batch_mismatch' END, CASE WHEN r5 THEN 'R5_numeric_boundary' END, CASE WHEN r3 THEN 'R3_input_generalization' END, CASE WHEN r4 THEN 'R4_voice_locking' END) AS causes,
 7::BIGINT AS n_runs, len(list_distinct([{", ".join(RUNS)}]))::BIGINT AS n_distinct FROM o WHERE r1 OR r2 OR r3 OR r4 OR r5""")
def root_causes(spark, d):
    """Why repeated runs differ, row by row."""
    told = attribution.root_causes(_runs(spark, d), "uid", "run", "said")
    return told.select("uid", F.array_join("causes", "|").alias("causes"), "n_runs", "n_distinct")


@query("q8_volatility", f"""WITH {UTT_SQL}, r AS (SELECT uid, {", ".join(f"{c} AS {k}" for k, c in RUNS.items())} FROM utt) SELECT 'A' AS kind, 2::BIGINT AS n_runs, count(*) AS total, count(*) FILTER (A_s42_r0 <> A_s42_r1) AS volatile FROM r UNION ALL SELECT 'B2', 2, count(*), count(*) FILTER (B2_s1 <> B2_s2) FROM r UNION ALL SELECT unnest(['B1', 'B3', 'B4']), 1, count(*), 0 FROM r""")
def volatility(spark, d):
    """How many rows differ within each kind of runs."""
    return attribution.volatility_by_kind(_runs(spark, d), "uid", "run", "said").select("kind", "n_runs", "total", "volatile")


SIGNALS = ["sim", "sim_b", "audio_sec"]
FOLD_SQL = "floor(('0x' || substr(md5(concat(uid, '|0')), 1, 8))::BIGINT / 4294967296.0 * 3)::INT"


@query("q16_sealed_fusion", f"""WITH {UTT_SQL}, r AS (SELECT uid, NOT negative AS y, cer AS c, sim < {THR} AS low, {FOLD_SQL} AS f, sim, sim_b, audio_sec FROM utt), k AS (SELECT unnest(range(3)) AS k),
l AS (SELECT k, y, s, v FROM (SELECT k, y, unnest([0, 1, 2]) AS s, unnest([sim, sim_b, audio_sec]) AS v FROM r, k WHERE f <> k)), a AS (SELECT k, s, y, rank() OVER (PARTITION BY k, s ORDER BY v) + (count(*) OVER (PARTITION BY k, s, v) - 1) / 2.0 AS rk FROM l),
w AS (SELECT k, s, 2 * (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) - 1 AS w FROM a GROUP BY 1, 2), z AS (SELECT k, s, avg(v) AS m, stddev_pop(v) AS d FROM l GROUP BY 1, 2),
q AS (SELECT k, max(w) FILTER (s = 0) AS w0, max(w) FILTER (s = 1) AS w1, max(w) FILTER (s = 2) AS w2, max(m) FILTER (s = 0) AS m0, max(m) FILTER (s = 1) AS m1, max(m) FILTER (s = 2) AS m2, max(d) FILTER (s = 0) AS d0, max(d) FILTER (s = 1) AS d1, max(d) FILTER (s = 2) AS d2 FROM w JOIN z USING (k, s) GROUP BY k),
o AS (SELECT k, f, y, c, low, round((sim - m0) / d0 * w0 + (sim_b - m1) / d1 * w1 + (audio_sec - m2) / d2 * w2, 9) AS sc FROM r, q), g AS (SELECT k, sc, sum(CASE WHEN y THEN 1.0 - c ELSE 0 END) AS g, count(*) FILTER (NOT y) AS n FROM o WHERE f <> k GROUP BY 1, 2),
e AS (SELECT k, count(*) FILTER (y) AS np, count(*) FILTER (NOT y) AS nn, sum(CASE WHEN low THEN 1.0 ELSE c END) FILTER (y) AS bc, count(*) FILTER (NOT y AND low) AS bh FROM o WHERE f <> k GROUP BY 1),
h AS (SELECT k, sc, 0.5 * (bc - (np - gu)) / np + 0.5 * (nn - nu - bh) / nn AS net FROM (SELECT k, sc, sum(g) OVER u AS gu, sum(n) OVER u AS nu FROM g WINDOW u AS (PARTITION BY k ORDER BY sc DESC)) JOIN e USING (k)), b AS (SELECT k, arg_max(sc, (round(net, 9), -sc)) AS thr, max(net) AS train_net FROM h GROUP BY k),
j AS (SELECT k, thr, train_net, (sum(CASE WHEN low THEN 1.0 ELSE c END) FILTER (y) - sum(CASE WHEN sc >= thr THEN c ELSE 1.0 END) FILTER (y)) / count(*) FILTER (y) AS d_cer, (count(*) FILTER (NOT y AND sc < thr) - count(*) FILTER (NOT y AND low)) / count(*) FILTER (NOT y) AS d_rr, count(*) FILTER (sc >= thr AND low) AS recovered, count(*) FILTER (sc >= thr AND low AND y) AS rt FROM o JOIN b USING (k) WHERE f = k GROUP BY 1, 2, 3)
SELECT k::INT AS fold, round(thr, 5) AS thr, round(train_net, 6) AS train_net, round(d_cer, 6) AS d_cer, round(d_rr, 6) AS d_rr, round(0.5 * d_cer + 0.5 * d_rr, 6) AS net, recovered, round(rt / nullif(recovered, 0), 6) AS "precision" FROM j""")
def sealed_fusion(spark, d):
    """Three signals fused on two folds and judged on the third, with what that gains over the similarity's own threshold."""
    u = stats.folds(utterances(spark, d), "uid", 3).withColumns({"y": ~F.col("negative"), "low": F.col("sim") < THR})
    told = attribution.sealed_fusion(u, SIGNALS, "y", "cer", "low", "fold", 3)
    return told.select("fold", F.round("thr", 5).alias("thr"), *[r6(F.col(c), c) for c in ("train_net", "d_cer", "d_rr", "net")], "recovered", r6(F.col("precision"), "precision"))


@query("q14_interval", f"""WITH {UTT_SQL}, x AS (SELECT spk, n, CASE WHEN sim < {THR} THEN n ELSE err END AS a, CASE WHEN sim_b < {THR} THEN n ELSE err_b END AS b FROM utt WHERE NOT negative), c AS (SELECT spk, sum(n) AS u, sum(a) AS a, sum(b) AS b FROM x GROUP BY spk), w AS (SELECT *, {weight_sql('spk', 'replicate')} AS w FROM c, range(100) r(replicate)), y AS (SELECT replicate, (sum(w * b) - sum(w * a)) / sum(w * u) AS d FROM w WHERE w > 0 GROUP BY replicate)
SELECT (SELECT round((sum(b) - sum(a)) / sum(u), 6) FROM c) AS delta, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi FROM y""")
def paired_interval(spark, d):
    """What enhancing gains over the raw system, with rejection, and its interval by clusters of speakers."""
    rej = lambda e, s: errors.rejected_errors(F.col(e), F.col("n"), F.col(s) < THR)
    x = utterances(spark, d).where(~F.col("negative")).select("spk", "n", rej("err", "sim").alias("a"), rej("err_b", "sim_b").alias("b"))
    return stats.bootstrap_delta(x, "spk", "n", "a", "b").select(*[r6(F.col(c), c) for c in ("delta", "lo", "hi")])


@query("q10_intervals", f"""WITH {UTT_SQL}, c AS (SELECT overlap, spk, sum(err) AS e, sum(n) AS u FROM utt WHERE NOT negative GROUP BY 1, 2), w AS (SELECT *, {weight_sql('spk', 'replicate')} AS w FROM c, range(60) r(replicate)), y AS (SELECT overlap, replicate, sum(w * e) / sum(w * u) AS v FROM w WHERE w > 0 GROUP BY 1, 2 HAVING sum(w * u) > 0), i AS (SELECT overlap, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, count(*) AS valid FROM y GROUP BY 1)
SELECT overlap, (SELECT round(sum(e) / sum(u), 6) FROM c WHERE c.overlap = i.overlap) AS pooled, CASE WHEN valid >= 20 THEN round(lo, 6) END AS lo, CASE WHEN valid >= 20 THEN round(hi, 6) END AS hi, valid FROM i""")
def overlap_intervals(spark, d):
    """Pooled rates by overlap, with intervals by clusters of speakers; null with too few valid replicates."""
    told = stats.bootstrap_pooled(utterances(spark, d).where(~F.col("negative")), ["overlap"], "spk", "err", "n", 60)
    return told.select("overlap", *[r6(F.col(c), c) for c in ("pooled", "lo", "hi")], "valid")


@query("q36_auc_interval", f"""WITH {UTT_SQL}, w AS (SELECT *, {weight_sql('uid', 'replicate')} AS w FROM utt, range(24) r(replicate)), s AS (SELECT replicate, sim, sum(w) FILTER (NOT negative) AS p, sum(w) FILTER (negative) AS q FROM w WHERE w > 0 GROUP BY 1, 2), t AS (SELECT replicate, coalesce(p, 0) AS p, coalesce(q, 0) AS q, sum(coalesce(q, 0)) OVER (PARTITION BY replicate ORDER BY sim) AS upto FROM s), a AS (SELECT replicate, sum(p * (upto - q / 2.0)) / (sum(p) * sum(q)) AS auc FROM t GROUP BY 1)
SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(median(auc), 6) AS middle, round(quantile_cont(auc, 0.975), 6) AS hi, count(*) AS valid FROM a""")
def auc_interval(spark, d):
    """The interval of a signal's AUC over replicates."""
    u = utterances(spark, d).withColumn("y", ~F.col("negative"))
    each = stats.bootstrap_auc(u, "uid", "sim", "y", 24)
    told = stats.interval(each, "auc", 24).withColumn("k", F.lit(1)).join(each.agg(F.percentile("auc", F.lit(0.5)).alias("middle")).withColumn("k", F.lit(1)), "k")
    return told.select(*[r6(F.col(c), c) for c in ("lo", "middle", "hi")], "valid")


@query("v3_unit_anchor", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS w FROM e), p AS (SELECT label, i, avg(w[i]) AS m FROM (SELECT label, w, unnest(range(1, len(w) + 1)) AS i FROM u) GROUP BY 1, 2), a AS (SELECT label AS anchor, list(m ORDER BY i) AS c FROM p GROUP BY 1),
s AS (SELECT vec_id, anchor, list_cosine_similarity(v, c) AS sim FROM e, a), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, anchor) AS k FROM s) SELECT vec_id, anchor, round(sim, 6) AS max_sim FROM r WHERE k = 1""")
def unit_anchor(spark, d):
    """The class whose enrollment is nearest: the mean of its vectors of length one."""
    e = read(spark, d, "embeddings")
    return intervals.nearest_anchor(e, "vec_id", "embedding", "label", unit=True).select("vec_id", "anchor", r6(F.col("max_sim"), "max_sim"))


@query("i3_target_ratios", f"""WITH {SEG_SQL}, f AS (SELECT DISTINCT rec, spk, unnest(range(s // 1000000, (e - 1) // 1000000 + 1)) AS frame FROM seg WHERE e > s), g AS (SELECT rec, frame, bool_or(spk = 'click') AS tgt, bool_or(spk <> 'click') AS oth FROM f GROUP BY 1, 2)
SELECT rec, round(count(*) FILTER (tgt AND NOT oth) / (max(frame) - min(frame) + 1), 9) AS exclusive, round(count(*) FILTER (tgt) / (max(frame) - min(frame) + 1), 9) AS active FROM g GROUP BY rec""")
def target_ratios(spark, d):
    """Shares of a recording's seconds in which the target speaks alone, and at all."""
    f = intervals.frames(segments(spark, d), ["rec", "spk"], 1_000_000)
    told = intervals.stno_ratios(f, "rec", "spk", "frame", "click")
    return told.select("rec", F.round("exclusive", 9).alias("exclusive"), F.round("active", 9).alias("active"))


@query("i8_target_slice", """WITH o AS (SELECT l_orderkey AS id, list(l_quantity::INT ORDER BY l_linenumber, l_quantity) AS x FROM lineitem GROUP BY 1), s AS (SELECT id, x, list_concat(x[id % 3 + 1:id % 3 + 1], x[4:id % 5 + 3]) AS cut FROM o)
SELECT id, len(CASE WHEN len(cut) < 2 THEN x ELSE cut END)::INT AS samples, list_sum(CASE WHEN len(cut) < 2 THEN x ELSE cut END)::BIGINT AS total FROM s""")
def target_slice(spark, d):
    """Each order's quantities as a signal of ten samples a second: two segments of it, or all where these are too short."""
    x = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"].cast("int"))
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(x.alias("x"))
    at = lambda n: n / F.lit(10.0)
    segs = F.array(F.struct(at(F.lit(3)).alias("start"), at(F.col("id") % 5 + 3).alias("end")), F.struct(at(F.col("id") % 3).alias("start"), at(F.col("id") % 3 + 1).alias("end")))
    # In order of time the shorter segment comes first.
    cut = signal.target_slice(F.col("x"), segs, 10, 0.2)
    return rows.select("id", cut.alias("cut")).select("id", F.size("cut").alias("samples"), F.aggregate("cut", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query("c12_content_cache", """WITH c AS (SELECT sha256(coalesce(text, '~')) AS k, min(doc_id) AS maker FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) SELECT d.doc_id, maker IS NOT NULL AS hit, maker FROM documents d LEFT JOIN c ON k = sha256(coalesce(text, '~'))""")
def content_cache(spark, d):
    """Documents with what a cache by content holds for them: copies share an entry, whatever their ids."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 3 = 0").groupBy(joins.content_key("text").alias("key")).agg(F.min("doc_id").alias("maker"))
    return joins.with_cached(docs, cache, ["text"], "maker").select("doc_id", "hit", "maker")


@query("i9_dilated", """WITH h AS (SELECT user_id AS rec, epoch_us(ts) // 3600000000 AS f, max(value) AS v FROM events WHERE value > 20 GROUP BY 1, 2), g AS (SELECT *, coalesce((f - lag(f) OVER w > 7)::INT, 1) AS far FROM h WINDOW w AS (PARTITION BY rec ORDER BY f)), i AS (SELECT *, sum(far) OVER (PARTITION BY rec ORDER BY f) AS k FROM g)
SELECT rec, min(f) - 3 AS "start", max(f) + 4 AS "end", count(*) AS frames, round(avg(v), 6) AS mean FROM i GROUP BY rec, k""")
def dilated(spark, d):
    """Hours in which a user's events reach a value, widened by three on both sides and joined, with their mean."""
    hits = read(spark, d, "events").where("value > 20").select(F.col("user_id").alias("rec"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("f"), "value")
    return windows.dilated(hits, ["rec"], "f", "value").select("rec", "start", "end", "frames", r6(F.col("mean"), "mean"))


@query("m24_capacity", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS w FROM e), p AS (SELECT label, i, avg(w[i]) AS m FROM (SELECT label, w, unnest(range(1, len(w) + 1)) AS i FROM u) GROUP BY 1, 2), a AS (SELECT label, list(m ORDER BY i) AS c FROM p GROUP BY 1),
s AS (SELECT e.label, true AS same, round(list_cosine_similarity(v, c), 9) AS s FROM e JOIN a ON a.label = e.label UNION ALL SELECT e.label, false, round(list_cosine_similarity(v, c), 9) FROM e JOIN a ON a.label = (e.label + 1) % 10),
k AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY s) + (count(*) OVER (PARTITION BY label, s) - 1) / 2.0 AS r FROM s)
SELECT label, count(*) FILTER (same) AS same, count(*) FILTER (NOT same) AS different, round((sum(r) FILTER (same) - count(*) FILTER (same) * (count(*) FILTER (same) + 1) / 2.0) / (count(*) FILTER (same) * count(*) FILTER (NOT same)), 5) AS auc, round(avg(s) FILTER (same), 5) AS mean_same, round(avg(s) FILTER (NOT same), 5) AS mean_different FROM k GROUP BY label""")
def capacity(spark, d):
    """How well each class's vectors tell its own enrollment from the next class's: AUC of same against different."""
    e = read(spark, d, "embeddings").select("label", "embedding")
    means = intervals.mean_vectors(e, "label", "embedding", unit=True)
    sides = e.select("label", "embedding", F.inline(F.array(F.struct(F.lit(True).alias("same"), F.col("label").alias("to")), F.struct(F.lit(False).alias("same"), ((F.col("label") + 1) % 10).alias("to")))))
    s = sides.join(means.withColumnRenamed("label", "to"), "to").select("label", "same", F.round(vectors.cosine(F.col("embedding"), F.col("mean")), 9).alias("s"))
    told = windows.cumulative(s, "s", {"p": F.sum(F.col("same").cast("long")), "q": F.sum((~F.col("same")).cast("long"))}, within=("label",))
    p, q = F.sum("p"), F.sum("q")
    auc = F.sum(F.col("p") * (F.col("q_upto") - F.col("q") / 2.0)) / F.nullif((p * q).cast("double"), F.lit(0.0))
    mean = lambda c: F.sum(F.col(c) * F.col("s")) / F.nullif(F.sum(c), F.lit(0))
    return told.groupBy("label").agg(p.alias("same"), q.alias("different"), F.round(auc, 5).alias("auc"), F.round(mean("p"), 5).alias("mean_same"), F.round(mean("q"), 5).alias("mean_different"))


@query("q9_gain_interval", f"""WITH {UTT_SQL}, x AS (SELECT spk, negative, err, n, sim < {THR} AS base, sim < {THR} OR length(hyp) > 20 AS gated FROM utt WHERE ('0x' || right(md5(concat(uid, '|seed=7')), 1))::INT % 2 = 1),
c AS (SELECT spk, coalesce(sum(CASE WHEN base THEN n ELSE err END - CASE WHEN gated THEN n ELSE err END) FILTER (NOT negative), 0) AS c, coalesce(sum(n) FILTER (NOT negative), 0) AS u, coalesce(sum(gated::INT - base::INT) FILTER (negative), 0) AS r, count(*) FILTER (negative) AS n FROM x GROUP BY spk),
w AS (SELECT *, {weight_sql('spk', 'replicate')} AS w FROM c, range(50) t(replicate)), g AS (SELECT replicate, 0.4 * sum(w * c) / nullif(sum(w * u), 0) + 0.4 * sum(w * r) / nullif(sum(w * n), 0) AS gain FROM w WHERE w > 0 GROUP BY replicate)
SELECT (SELECT round(0.4 * sum(c) / sum(u) + 0.4 * sum(r) / sum(n), 6) FROM c) AS gain, round(quantile_cont(gain, 0.025), 6) AS lo, round(quantile_cont(gain, 0.975), 6) AS hi, count(gain) AS valid FROM g""")
def gain_interval(spark, d):
    """What a limit of length gains on the sealed half, with its interval by clusters of speakers."""
    low = F.col("sim") < THR
    x = utterances(spark, d).where(hashing.md5_half(F.col("uid"), 7) == 1).withColumns({"base": low, "gated": low | (F.length("hyp") > 20)})
    told = stats.bootstrap_gain(x, "spk", "err", "n", "negative", "base", "gated", replicates=50)
    return told.select(*[r6(F.col(c), c) for c in ("gain", "lo", "hi")], "valid")


VERDICT = "CASE p_size % 6 WHEN 0 THEN 'accept' WHEN 1 THEN ' Reject ' WHEN 2 THEN 'ACCEPT' WHEN 3 THEN 'maybe' WHEN 4 THEN '' ELSE p_type END"


@query("t35_answers", f"""WITH x AS (SELECT p_partkey AS id, lower(trim({VERDICT})) AS v, p_partkey % 5 AS k FROM part) SELECT id, CASE WHEN k <> 3 AND k <> 4 AND v IN ('accept', 'reject') THEN v ELSE 'reject' END AS verdict FROM x""")
def answers(spark, d):
    """Verdicts from answers that hold JSON plainly, within a fence, with words around it, cut off, or not at all."""
    body = F.concat(F.lit('{"verdict": "'), F.expr(VERDICT), F.lit('", "why": "'), F.col("p_name"), F.lit('"}'))
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("I think: "), body, F.lit(" - done"))).when(k == 3, F.substr(body, F.lit(1), F.length(body) - 4)).otherwise(F.col("p_name"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.parse_verdict(raw).alias("verdict"))
