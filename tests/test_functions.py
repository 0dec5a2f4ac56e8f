"""Scalar functions on hand-worked cases."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill import lexicons as L
from grainmill.functions import gates, jsonx, rewards, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_space(spark):
    t = F.col("t")
    assert one(spark, text.strip(t), t="　 a b \x1c\n") == "a b"
    assert one(spark, text.compact(t), t="　a \tb c") == "abc"
    assert one(spark, text.blank(t), t=" 　") and one(spark, text.blank(F.lit(None).cast("string")))


def test_paths(spark):
    t = F.col("t")
    assert one(spark, text.stem(t), t="a/b.c/d.e.jpg") == "d.e"
    assert one(spark, text.stem(t), t="noext") == "noext"
    assert one(spark, text.cluster_key(t), t="x/palm_jpg.rf.0a1b.jpg") == "palm_jpg"
    assert one(spark, text.cluster_key(t), t="x/plain.png") == "plain"


def test_counts(spark):
    t = F.col("t")
    assert one(spark, text.term_hits(t, ("aa", "a")), t="aaaa") == 6
    assert one(spark, text.pattern_hits(t, ("a.b",)), t="a b a\nb axb") == 2
    assert one(spark, text.han_count(t), t="手相ab線。") == 3


def test_ngrams(spark):
    t = F.col("t")
    assert sorted(one(spark, text.ngram_set(t), t="a b　ab")) == ["ab", "ba"]
    assert one(spark, text.ngram_set(t), t="a") == ["a"] and one(spark, text.ngram_set(t), t=" ") == []
    assert one(spark, text.ngram_set(t), t="\U0001f600x") == ["\U0001f600x"]
    assert one(spark, text.jaccard(t, F.lit("abd")), t="abc") == pytest.approx(1 / 3)
    assert one(spark, text.jaccard(t, F.lit("")), t="abc") == 0


def test_sections(spark):
    words = {"A": ("A",), "B": ("B", "Bee"), "C": ("C",)}
    got = one(spark, text.sections(F.col("t"), words), t="intro B two A one")
    assert got["B"] == "B two" and got["A"] == "A one" and got["C"] is None
    score = text.ordered_score(F.col("t"), (("a",), ("b",), ("c",), ("d",)))
    assert one(spark, score, t="a c b d") == 0.75  # after c, b lies before it
    assert one(spark, score, t="") == 0
    assert one(spark, text.mention_score(F.col("t"), ("a", "z")), t="abc") == 0.5
    assert one(spark, text.duration(F.lit(75))) == "01:15" and one(spark, text.duration(F.lit(3700))) == "01:01:40"


def test_display(spark):
    got = one(spark, text.display_sections(F.col("t"), L.DISPLAY_HEADINGS, L.DISPLAY_CORE, L.DISPLAY_ENERGY), t="一、整体印象：很好\n\n2. 整体能量与近期运势\n \n随便")
    assert [tuple(r) for r in got] == [("整体印象", "很好", "core"), ("整体能量与近期运势", "", "energy"), ("", "随便", "guidance")]


# JSON.


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"a": 1}', '{"a": 1}'),
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('```JSON {"a": 1} ```', '{"a": 1}'),
        ('<think>{"b": 2}</think> {"a": 1}', '{"a": 1}'),
        ('</think>{"a": 1}', '{"a": 1}'),
        ('so {"a": "}"} and {"b": 2}', '{"a": "}"}'),
        ('so {"a": "\\"}"} end', '{"a": "\\"}"}'),
        ('[{"a": 1}, {"b": 2}]', '{"a": 1}'),
        ('{"a": 1} tail', '{"a": 1}'),
        ("{'a': 1}", None),
        ('{"a": 1,}', None),
        ('{"a": NaN}', '{"a": NaN}'),
        ('{"a": 1, "a": 2}', '{"a": 1, "a": 2}'),
        ('{"a": ', None),
        ("3", None),
        ("", None),
    ],
)
def test_extract(spark, raw, want):
    rows = jsonx.extract(spark.createDataFrame([(1, raw)], "id int, raw string"), "raw").collect()
    assert [r["payload"] for r in rows] == [want]


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(max_size=5), lambda s: st.dictionaries(st.text(max_size=3), s, max_size=3), max_leaves=6).filter(lambda v: isinstance(v, dict)))
def test_first_object_finds_what_is_there(value):
    found = jsonx.first_object("note: " + json.dumps(value) + " end")
    assert json.loads(found) == value


def payload(**changes):
    line = dict.fromkeys(L.LINE_FIELDS, "清晰")
    lines = {n: dict(line) for n in L.REQUIRED_LINES}
    out = {"lines": lines, **dict.fromkeys(L.REPORT_FIELDS, "仅供参考")}
    for path, value in changes.items():
        name, _, field = path.partition("__")
        if name == "drop":
            out.pop(field, None)
            lines.pop(field, None)
        elif field:
            lines.setdefault(name, dict(line))[field] = value
        else:
            out[name] = value
    return json.dumps({L.TOP_KEY: out}, ensure_ascii=False)


def parsed(raw):
    return jsonx.parse(F.lit(raw))


@pytest.mark.parametrize(
    ("raw", "errors"),
    [
        (payload(), []),
        ("{}", ["Missing object: palmistry_analysis"]),
        (payload(drop__lines=0), ["Missing object: palmistry_analysis.lines"]),
        (payload(drop__智慧线=0), ["Missing line: 智慧线"]),
        (payload(生命线__长度="　"), ["Missing or empty field: 生命线.长度"]),
        (payload(婚姻线__深浅=""), ["Missing or empty field: 婚姻线.深浅"]),
        (payload(blessing=" "), ["Missing or empty field: palmistry_analysis.blessing"]),
    ],
)
def test_payload_errors(spark, raw, errors):
    assert one(spark, jsonx.payload_errors(parsed(raw))) == errors


def test_canonical(spark):
    raw = payload(生命线__长度=" 长 ")
    text_ = one(spark, jsonx.canonical(parsed(raw)))
    assert json.loads(text_)[L.TOP_KEY]["lines"]["生命线"]["长度"] == "长" and "婚姻线" not in text_ and ": " not in text_
    assert one(spark, jsonx.canonical(parsed(text_))) == text_


def test_uncertainty(spark):
    raw = payload(生命线__长度="模糊", 智慧线__清晰度="无法看", 婚姻线__长度="遮挡")
    assert one(spark, jsonx.uncertain_lines(parsed(raw), L.GATE_MARKERS)) == 2
    assert one(spark, jsonx.uncertain_lines(parsed(raw), L.CHALLENGE_TERMS, None)) == 3


def test_sanitize_and_quality(spark):
    raw = payload(生命线__图像依据="完全不可见", 智慧线__图像依据="无法辨认，但主体延伸")
    got = one(spark, jsonx.sanitized(parsed(raw)))
    # "完全不可见" holds the positive "可见" too, so nothing is downgraded
    assert got["issues"] == []
    got = one(spark, jsonx.sanitized(parsed(payload(生命线__图像依据="无法判断"))))
    assert got["issues"] == ["生命线: downgraded_to_unknown"]
    line = got["payload"][L.TOP_KEY]["lines"]["生命线"]
    assert line["图像依据"] == "无法判断" and line["长度"] == "难以判断"
    unknown = {f"{n}__{f}": "难以判断" for n in ("生命线", "智慧线") for f in L.LINE_FIELDS}
    assert one(spark, jsonx.quality_issues(parsed(payload(**unknown)))) == ["too_many_uncertain_main_lines:2", "uncertain_lines_without_report_uncertainty"]
    assert one(spark, jsonx.quality_issues(parsed(payload(**unknown, blessing="图像质量")))) == ["too_many_uncertain_main_lines:2"]
    assert one(spark, jsonx.quality_issues(parsed("{}"))) == ["missing_analysis"]


def judgment(decision, *scores, reason="ok"):
    return F.struct(F.lit(decision).alias("decision"), *[F.lit(s).cast("string").alias(f) for f, s in zip(L.JUDGE_SCORES, scores, strict=True)], F.lit(reason).alias("reason"))


def test_judge(spark):
    assert one(spark, jsonx.judge_errors(judgment("accept", 0, 5, 3, 3))) == []
    assert one(spark, jsonx.judge_errors(judgment("maybe", -0.1, 5.1, "x", 3, reason=" "))) == ["Invalid decision", *[f"Invalid judge score: {f}" for f in L.JUDGE_SCORES[:3]], "Missing or empty field: teacher_judgment.reason"]
    assert one(spark, jsonx.judge_verdict(judgment("accept", 3, 4, 3, 4))).asDict() == {"average_score": 3.5, "issues": [], "final_decision": "accept"}
    got = one(spark, jsonx.judge_verdict(judgment("accept_cautious", 2.5, 3, 3, 3), L.JudgeLimits(allow_cautious=False)))
    assert got["issues"] == ["judge_average_below_threshold:2.88", "judge_visual_grounding_below_threshold:2.50", "judge_decision:accept_cautious_not_allowed"] and got["final_decision"] == "reject"


# Gates.


@pytest.mark.parametrize(
    ("p", "want"),
    [
        ((0.54, 0.26, 0.20), "cautious"),
        ((0.60, 0.20, 0.20), "cautious"),
        ((0.65, 0.20, 0.15), "continue"),
        ((0.20, 0.15, 0.65), "retake"),
        ((0.16, 0.20, 0.64), "cautious"),
        ((0.1, 0.8, 0.1), "cautious"),
    ],
)
def test_thresholds(spark, p, want):
    assert one(spark, gates.thresholded(F.array(*[F.lit(x) for x in p]))) == want


def test_gate_rules(spark):
    assert one(spark, gates.normalize(F.lit(" 建议重拍 "))) == "retake" and one(spark, gates.normalize(F.lit("?"))) == "cautious"
    assert [one(spark, gates.from_counts(F.lit(n))) for n in (0, 1, 3, 4)] == ["continue", "cautious", "cautious", "retake"]
    assert one(spark, gates.from_reasons(F.array(F.lit("cluster_quota_exceeded"), F.lit("too_dark")))) == "retake"
    assert one(spark, gates.from_reasons(F.array().cast("array<string>"))) == "cautious"
    assert [one(spark, gates.whole_number(F.lit(t))) for t in (" 3 ", "3.0", "x", "-2")] == [3, 0, 0, -2]
    assert one(spark, gates.softmax(F.array(F.lit(1.0), F.lit(1.0)))) == [0.5, 0.5]
    assert one(spark, gates.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert one(spark, gates.refine(F.lit("continue"), F.lit(2), F.lit(False))) == "cautious"
    assert one(spark, gates.metadata(F.lit("retake")))["visible_lines"] == 1
    gate = F.struct(F.lit("").alias("decision"), F.lit("继续分析").alias("decision_label"), F.lit(None).cast("string").alias("suggestion"), F.lit("清晰").alias("clarity"), F.lit("4").alias("visible_lines"), F.lit(" ").alias("occlusion"), F.lit("r").alias("rationale"))
    got = one(spark, gates.policy(gate))
    assert (got["decision"], got["visible_lines"], got["error"]) == ("continue", 4, "Missing gate field: occlusion")
    line = F.struct(*[F.lit(v).alias(k) for k, v in {"清晰度": "高", "长度": "不足", "深浅": "较低", "图像依据": "好"}.items()])
    assert not one(spark, gates.line_uncertain(line))
    assert one(spark, gates.force_low_confidence(F.lit(1), F.lit(1), F.lit(True), F.lit(False), F.lit(3)))


# Rewards.


def test_report_format(spark):
    cases = {"手" * 119: 119 / 120, "手" * 120: 1.0, "手" * 1800: 1.0, "手" * 1801: 0.6, "手" * 200 + "{": 0.0, "": 0.0}
    for t, want in cases.items():
        assert one(spark, rewards.report_format(F.lit(t))) == pytest.approx(want)


def test_safety(spark):
    assert [one(spark, rewards.safety(F.lit(t))) for t in ("仅供参考", "仅供参考但保证", "别的")] == [1.0, 0.0, 0.2]


def test_structured(spark):
    full, hollow = payload(), payload(生命线__长度="", blessing="")
    assert one(spark, rewards.json_schema(parsed(full))) == 1 and one(spark, rewards.json_schema(parsed(hollow))) == 0
    assert one(spark, rewards.line_coverage(parsed(hollow))) == pytest.approx(27 / 28)
    assert one(spark, rewards.report_coverage(parsed(hollow))) == pytest.approx(4 / 5)
    assert one(spark, rewards.structured_alignment(parsed(full), parsed(full))) == pytest.approx(1.0)
    assert one(spark, rewards.payload_safety(parsed(full))) == 1.0


def test_gate_matrix(spark):
    for e, row in L.GATE_REWARDS.items():
        for p, want in zip(L.DECISIONS, row, strict=True):
            assert one(spark, rewards.gate_matrix(F.lit(e), F.lit(p))) == want


def test_report_rewards_by_hand(spark):
    """Reference: life line blurred, the others clear. The completion is careful about it and copies one other line."""
    reference = parsed(payload(生命线__清晰度="模糊"))
    clear = "智慧线\n" + "\n".join(["清晰"] * 7)
    completion = F.lit(f"生命线看不清。{clear}")
    at = lambda build: one(spark, build(completion, reference))
    # honesty: (1 for the careful line, 0.9 for the clear one, 0 for two absent) / 4 + 0.1 for cautious as expected
    assert at(rewards.uncertainty_honesty) == pytest.approx((1 + 0.9) / 4 + 0.1)
    assert at(rewards.gate_decision) == 1.0
    # consistency: 1, and min(1, 0.2 + 0.8 * 1) for equal texts
    assert at(rewards.line_consistency) == pytest.approx(2 / 4)
    # evidence: the careful line 1; the clear one covers its only term: 0.65 + 0.35 * 1
    assert at(rewards.evidence_coverage) == pytest.approx(2 / 4)
    assert at(rewards.hallucination_penalty) == 1.0 and at(rewards.contradiction_penalty) == 1.0
    # cautious expected and predicted, one mention beyond none: term hits of 看不清 = 1, allowance 2; mean evidence of certain lines 1/3
    assert at(rewards.caution_balance) == pytest.approx(1.0)


def test_penalties(spark):
    reference = parsed(payload(生命线__清晰度="模糊"))
    bold = F.lit("生命线深刻有力，岛纹。")
    # not careful 1 + 0.35 for one detail + 0.2 for one assertive match where both occur: below zero
    assert one(spark, rewards.hallucination_penalty(bold, reference)) == 0.0
    # doubtful reference and bold text: 0.5 + 0.2 + 0.2
    assert one(spark, rewards.contradiction_penalty(bold, reference)) == pytest.approx(0.1)
    assert one(spark, rewards.report_alignment(F.lit(""), parsed("{}"))) == 0.0


def test_registry(spark):
    with pytest.raises(ValueError, match="does not end"):
        rewards.Registry().add("wrong", lambda completion: completion)
    df = spark.createDataFrame([("生命线", payload())], "c string, r string").select("c", jsonx.parse(F.col("r")).alias("p"))
    row = df.select(*rewards.REPORT_REWARDS.columns(completion=F.col("c"), parsed=F.col("p"))).first()
    assert len(row) == 11 and all(0 <= v <= 1 for v in row)
    shared = df.withColumn("f", rewards.facts(F.col("c"), F.col("p")))
    assert shared.select(*rewards.REPORT_REWARDS.columns(completion=F.col("c"), parsed=F.col("p"), shared=F.col("f"))).first() == row
    assert len(df.select(*rewards.STRUCTURED_REWARDS.columns(parsed=F.col("p"), reference=F.col("p"))).first()) == 5


def test_plain_rewards(spark):
    assert one(spark, rewards.think_format(F.lit("<think>\na\n</think>\n<answer>\nb\n</answer>"))) == 1.0
    assert one(spark, rewards.think_format(F.lit("x<think>\na\n</think>\n<answer>\nb\n</answer>"))) == 0.0
    assert one(spark, rewards.accuracy(F.lit(" Yes "), F.lit("yes"))) == 1.0
