"""Truth tables and goldens of the functions."""

import pytest
from pyspark.sql import functions as F

from voxmeter.functions import errors, hashing, scores, text, vectors


def one(spark, c, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(c.alias("x")).first()[0]


@pytest.mark.parametrize(("a", "b", "dialect", "want"), [
    ("空调开", "空调关", "official", (1, 3)), ("ＡＢ c，d！", "abcd", "official", (0, 4)), (None, "ab", "official", (2, 2)),
    ("a b", "ab", "legacy", (0, 2)), ("a.b", "ab", "legacy", (1, 2)), ("a b", "ab", "raw", (1, 2)), ("a，b", "ab", "punct", (0, 2)),
])
def test_dialects(spark, a, b, dialect, want):
    h, r = F.lit(a).cast("string"), F.lit(b)
    row = spark.range(1).select(errors.errors(h, r, dialect).alias("e"), errors.units(r, dialect).alias("n")).first()
    assert tuple(row) == want


def test_rate_of_nothing(spark):
    assert one(spark, errors.rate(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, errors.rate(F.lit(2), F.lit(0))) == 1.0
    assert spark.range(0).agg(errors.pooled(F.col("id"), F.col("id"))).first()[0] == 0.0


@pytest.mark.parametrize(("sim", "verdict", "strategy", "thr", "use", "want"), [
    (0.10, "accept", "sim_only", 0.2, True, True), (0.30, "reject", "sim_only", 0.2, True, False), (0.05, "accept", "llm_only", 0.2, True, False),
    (0.90, "reject", "llm_only", 0.2, True, True), (0.10, "accept", "llm_or_sim", 0.2, True, False), (0.30, "reject", "llm_or_sim", 0.2, True, False),
    (0.10, "reject", "llm_or_sim", 0.2, True, True), (0.10, "accept", "llm_or_sim", 0.2, False, True), (0.30, "accept", "llm_or_sim", 0.2, False, False),
])
def test_decide_reject(spark, sim, verdict, strategy, thr, use, want):
    assert one(spark, scores.decide_reject(F.lit(sim), F.lit(verdict), strategy, thr, use)) is want


@pytest.mark.parametrize(("t", "want"), [
    ("打开空调", True), ("", False), ("   ", False), ("ok", False), ("中国市场同比增长", False), ("把" + "空调温度" * 8, False),
    ("手手手手骨", False), ("打开abcdefgh", False), ("请打开客厅的空调。", True),
])
def test_command_gate(spark, t, want):
    assert one(spark, text.is_command(F.lit(t))) is want


def test_routes_and_loops(spark):
    a, b = F.lit("打开空调"), F.lit("中国市场同比增长")
    assert one(spark, text.pick_route(a, b, text.command_score(a), text.command_score(b)))["idx"] == 0
    assert one(spark, text.is_loop(F.lit("帮忙帮忙帮忙"))) is True
    assert one(spark, text.is_loop(F.lit("打开空调"))) is False
    assert one(spark, text.is_cyclic(F.lit("abcdabcd"))) is True
    assert one(spark, text.is_cyclic(F.lit("abcabc"))) is False
    assert one(spark, text.longest_run(F.lit("aabbbc"))) == 3
    assert one(spark, text.longest_run(F.lit(""))) == 0
    assert one(spark, text.digit_run(F.lit("调到二十五度916213"))) == 6
    assert one(spark, text.command_score(F.lit(""))) == -5.0


def test_parsers(spark):
    for raw, want in (('```json\n{"verdict": "Accept"}\n```', "accept"), ("no", "reject"), (None, "reject"), ('{"verdict": "maybe"}', "reject"), ('so {"verdict":"reject"} .', "reject")):
        assert one(spark, text.parse_verdict(F.lit(raw).cast("string"))) == want
    assert one(spark, text.tags(F.lit("a； b，c;;a , "))) == ["a", "b", "c"]
    assert one(spark, text.parse_choice(F.lit("b."))) == "B"
    assert one(spark, text.parse_choice(F.lit("the answer"))) == "A"


def test_digits_and_names(spark):
    for t, want in (("25度", "二十五度"), ("50%", "百分之五十"), ("14.55", "十四点五十五"), ("7.05", "七点零五"), ("916213", "916213"), ("105", "一百零五"), ("110", "一百一十"), (None, None)):
        assert one(spark, text.spell_digits(F.lit(t).cast("string"))) == want
    for t, want in (("1000%", "百分之一千"), ("14.55%", "十四.百分之五十五"), ("10005%", "百分之一万零五"), ("100500%", "百分之十万零五百"), ("1.2.3", "一点二.三"), ("123.45", "一百二十三.四十五"), ("007", "七"), ("12:00", "十二:零"), ("第10个", "第十个"), ("20010000%", "百分之二千零一万")):
        assert one(spark, text.spell_digits(F.lit(t))) == want
    for t, want in (("１２度", "十二度".replace("十", "一十")), ("105", "一百五"), ("3.14", "三点一四"), ("0.5", "零点五"), ("x", "x")):
        assert one(spark, text.read_digits(F.lit(t))) == want
    assert one(spark, text.submitted(F.lit("開25度轻干喜"), "開", "开", {"洗": "xi3", "喜": "xi3"})) == "开二十五度轻干洗"
    sounds = {"洗": "xi3", "喜": "xi3", "系": "xi4"}
    assert one(spark, text.fix_homophones(F.lit("打开轻干喜"), sounds)) == "打开轻干洗"
    assert one(spark, text.fix_homophones(F.lit("打开轻干系"), sounds)) == "打开轻干系"


def test_corrections_and_classes(spark):
    better = F.map_from_entries(F.array(F.struct(F.lit("条").alias("k"), F.array(F.struct(F.lit("调").alias("char"), F.lit(5).cast("long").alias("n")), F.struct(F.lit("挑").alias("char"), F.lit(2).cast("long").alias("n"))).alias("v"))))
    assert one(spark, text.apply_replacements(F.lit("空条一条"), better)) == "空调一调"
    assert one(spark, text.apply_replacements(F.lit("空条一条"), better, F.array(F.lit("空调"), F.lit("一挑")))) == "空调一挑"
    op = lambda o, a, b: F.struct(F.lit(o).alias("op"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    for e, want in ((("sub", "2", "二"), "数字错误"), (("del", "二", ""), "数字错误"), (("ins", "", "a"), "英文品牌名"), (("sub", "喜", "洗"), "同音字"), (("sub", "系", "洗"), "近音字"), (("sub", "二", "洗"), "近音字"), (("del", "开", ""), "删字"), (("ins", "", "开"), "增字")):
        assert one(spark, text.edit_class(op(*e), {"喜": "xi", "洗": "xi"})) == want
    kinds = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, text.row_class(F.lit("打开空调"), F.lit("打开空条"), F.lit(0.25), kinds("同音字"))) == "同音字"
    assert one(spark, text.row_class(F.lit("打开空调"), F.lit("打开空调"), F.lit(0.0), kinds())) == "标点"
    assert one(spark, text.row_class(F.lit("打开空调"), F.lit("关上电视"), F.lit(1.0), kinds("近音字"))) == "完全幻觉"
    assert one(spark, text.row_class(F.lit("打开空调吧"), F.lit("打开空条"), F.lit(0.4), kinds("删字", "近音字"))) == "近音字"
    assert one(spark, text.drifted(F.lit("turn on 灯"))) is True
    assert one(spark, text.retried(F.lit("turn on 灯"), F.lit("打开 灯"))) == "打开 灯"
    assert one(spark, text.retried(F.lit("打开灯"), F.lit("on"))) == "打开灯"


def test_edit_script(spark):
    ops = one(spark, text.edit_script(F.lit("kitten"), F.lit("sitting")))
    assert [(o["op"], o["a"], o["b"]) for o in ops] == [("sub", "k", "s"), ("sub", "e", "i"), ("ins", "", "g")]


def test_scores(spark):
    assert one(spark, scores.linear_drop(F.lit(2.0), 1.0, 3.0, 20.0)) == 10.0
    assert one(spark, scores.steps(F.lit(0.7), 10.0)) == 7.0
    assert one(spark, scores.noise_class(F.lit(0.1), F.lit(4.0)))["noise"] == "pink"
    assert one(spark, scores.reasons(a=F.lit(True), b=F.lit(None).cast("boolean"), c=F.lit(True))) == ["a", "c"]
    assert one(spark, scores.bucket(F.lit(0.2), [0.0, 0.2, 0.4])) == 1
    assert abs(one(spark, scores.fuse(F.lit("accept"), F.lit(None).cast("double"), F.lit(0.2))) - 0.6) < 1e-9


def test_vectors_and_hashes(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert abs(one(spark, vectors.cosine(a, b)) - 0.96) < 1e-12
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, vectors.top_mean(F.array(*[F.lit(float(x)) for x in range(8)]))) == 6.5
    assert one(spark, hashing.md5_half(F.lit("u1"), 3)) in (0, 1)
    assert one(spark, hashing.role(F.lit(1), F.lit(1))) == "C"
    assert abs(sum(x * x for x in one(spark, vectors.blend(a, b, 0.5, 5))) - 1) < 1e-9
