"""What a row costs: expressions that were computed again and again, or grew with the square of something, once."""

from __future__ import annotations

import json
import time

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grainmill import lexicons as L
from grainmill import queries as core
from grainmill import queries_records  # noqa: F401  registers flat_payload_text
from grainmill.functions import grams, jsonx, rewards, text
from grainmill.operators import quality
from grainmill.sources import arrays

DATA = "/root/testdata/sf0.001"
ODD = ["", " ", None, "a", "ab", "a b", "生命线 清晰 断裂 \U0001f600\U0001f601 模糊 x", "整体印象 生命线 较长 \x1c 智慧线 模糊模糊 感情线 断裂 分叉 事业线 谨慎分析 重拍一张", "\x00a", "abab" * 50]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payload_is_parsed_once(spark):
    assert plan(core.QUERIES["built_payload_validate"](spark, DATA)).count("from_json") == 1


def test_json_payload_is_parsed_once(spark):
    assert plan(core.QUERIES["json_payload_validate"](spark, DATA)).count("from_json") == 1


def test_strip_looks_at_the_ends_only(spark):
    inner = "x" + " " * 150_000 + "y"
    began = time.perf_counter()
    got = spark.createDataFrame([("　 \x1c" + inner + "\x85\n",)], "t string").select(text.strip(F.col("t"))).first()[0]
    assert got == inner
    assert time.perf_counter() - began < 10


def test_similarity_equals_expression(spark):
    rows = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(ODD) for j, b in enumerate(ODD)], "i int, j int, a string, b string")
    rows = rows.withColumn("n", F.get(grams.jaccards(F.array("a"), F.array("b")), F.lit(0)))
    for r in rows.select("a", "b", "n", text.jaccard(F.col("a"), F.col("b")).alias("e")).collect():
        assert r["n"] == r["e"], r


def _reports(spark):
    raw = '{"%s": {"lines": {"生命线": {"清晰度": "清晰 断裂", "长度": " 较长 "}, "感情线": {"图像依据": "模糊 噪点"}}, "blessing": "清晰 模糊模糊"}}' % L.TOP_KEY
    rows = spark.createDataFrame([(i, t, raw if k else None) for i, t in enumerate(ODD) for k in (0, 1)], "i int, completion string, raw string")
    return rows.withColumn("p", jsonx.parse(F.col("raw")))


def test_facts_of_tables_equal_facts_of_columns(spark):
    c, p = F.col("completion"), F.col("p")
    rows = rewards.with_facts(_reports(spark), "completion", "p", "shared").withColumn("own", rewards.facts(c, p))
    for r in rows.collect():
        assert r["shared"] == r["own"], r


def test_alignment_takes_few_facts(spark):
    rows = rewards.with_facts(_reports(spark), "completion", "p", "shared", rewards.EVIDENCE_FACTS)
    assert "k" not in rows.schema["shared"].dataType["lines"].dataType.elementType.names
    c, p = F.col("completion"), F.col("p")
    for r in rows.select(rewards.report_alignment(c, p, F.col("shared")).alias("x"), rewards.report_alignment(c, p).alias("y")).collect():
        assert r["x"] == r["y"], r


def test_shared_rewards_equal_single_ones(spark):
    inputs = {"completion": F.col("completion"), "parsed": F.col("p")}
    rows = rewards.with_facts(_reports(spark), "completion", "p", "shared")
    many, one = rewards.REPORT_REWARDS.columns(**inputs, shared=F.col("shared")), rewards.REPORT_REWARDS.columns(**inputs)
    for r in rows.select(F.struct(*many).alias("many"), F.struct(*one).alias("one")).collect():
        assert r["many"] == r["one"], r


def test_report_rewards_look_the_completion_through_once(spark):
    told = plan(core.QUERIES["report_rewards"](spark, DATA))
    assert told.count("locate(") <= 30 and told.count("regexp_count") + told.count("regexp_extract_all") <= 8


def test_penalty_asks_for_no_similarity(spark):
    assert "array_intersect" not in plan(core.QUERIES["line_penalty_reward"](spark, DATA))


def test_structured_rewards_make_no_array_of_characters(spark):
    assert "array_intersect" not in plan(core.QUERIES["structured_rewards"](spark, DATA))


def test_flat_text_is_made_once(spark):
    told = plan(core.QUERIES["flat_payload_text"](spark, DATA))
    assert told.count("differ") == 1 and told.count("array_join") + told.count("concat_ws") <= 4


NEAR = ["清晰 ab 断裂", "清晰abcd断裂 深a长 深abc长", "清晰abcde断裂", "清晰 \n断裂", "清晰\U0001f600\U0001f601\U0001f602\U0001f603断裂 明显x清晰y岛纹", "线条 the 清晰, and the 走势  深刻abcdef贯穿掌心", *ODD]


def test_texts_near_han_hold_all_matches(spark):
    rows = spark.createDataFrame([(t,) for t in NEAR], "t string").select("t", text.near_han(F.col("t"), L.DETAIL_TERMS).alias("near"), text.han_set(F.col("t"), L.DETAIL_TERMS).alias("once"))
    for r in rows.select("t", "near", rewards.assertive(F.col("t")).alias("x"), rewards.assertive(F.col("near")).alias("y"), *[F.struct(F.col("t").contains(k), F.col("once").contains(k)).alias(k) for k in L.EVIDENCE_TERMS]).collect():
        assert r["x"] == r["y"], r
        assert all(a == b for a, b in (r[k] for k in L.EVIDENCE_TERMS)), r


def test_penalty_compares_no_text_byte_by_byte(spark):
    told = plan(core.QUERIES["line_penalty_reward"](spark, DATA))
    assert told.count("replace(") - told.count("regexp_replace(") == 0 and told.count("[^一-鿿]{5,}") >= 1


def test_alignment_reads_the_lines_of_a_reference_once(spark):
    assert plan(core.QUERIES["alignment_reward"](spark, DATA)).count(L.LINE_FIELDS[0]) <= 5


def test_bigrams_of_common_characters_are_narrow():
    assert grams.bigrams(grams.points("生命 线"), False).dtype.itemsize == 4
    for a in [*ODD, *NEAR]:
        for b in ODD:
            x, y = ({t[i : i + 2] for i in range(max(1, len(t) - 1))} if t else set() for t in ("".join((s or "").split()) for s in (a, b)))
            assert grams.similarity(a, b) == (len(x & y) / len(x | y) if x and y else 0.0)


def _curated(spark):
    rows = [(None if k % 11 == 0 else k * k % 7, k, float(k * 37 % 50), float(k % 5), float(k % 3), 30.0 + k * 17 % 200) for k in range(300)]
    df = spark.createDataFrame(rows, "cluster_key int, id int, sharpness double, contrast double, entropy double, brightness double")
    return quality.curate(df, ["id"])


def test_large_clusters_are_ranked_like_others(spark, monkeypatch):
    few = sorted(map(repr, _curated(spark).collect()))
    monkeypatch.setattr(quality, "CLUSTER_ROWS", 30)
    assert sorted(map(repr, _curated(spark).collect())) == few


def test_ordinary_clusters_are_shuffled_once(spark):
    told = _curated(spark)._jdf.queryExecution().executedPlan().toString()
    assert told.count("Exchange hashpartitioning") == 1 and "Join" not in told


def _written(monkeypatch):
    seen, write = {}, quality.scratch.materialize
    monkeypatch.setattr(quality.scratch, "materialize", lambda df, label: seen.setdefault(label, df.schema) and write(df, label))
    return seen


def test_scored_rows_are_written_without_copies_of_columns(spark, monkeypatch):
    seen = _written(monkeypatch)
    _curated(spark)
    fields = [g for f in seen["scored"] for g in (f.dataType if isinstance(f.dataType, StructType) else [f])]
    assert len(fields) == 7  # six columns and the score


def test_clusters_are_counted_only_where_a_part_is_large(spark, monkeypatch):
    seen = _written(monkeypatch)
    few = sorted(map(repr, _curated(spark).collect()))
    assert "large-clusters" not in seen
    monkeypatch.setattr(quality, "CLUSTER_PARTS", 1)
    for rows in (30, 100):  # with and without a large cluster in the large part
        monkeypatch.setattr(quality, "CLUSTER_ROWS", rows)
        assert sorted(map(repr, _curated(spark).collect())) == few
    assert "large-clusters" in seen


def test_sets_of_reasons_are_counted_before_they_are_taken_apart(spark):
    told = plan(core.QUERIES["reject_reason_counts"](spark, DATA))
    assert told.count("Aggregate") == 2 and "lambdafunction" not in told
    rows = spark.createDataFrame([(["a", "b"],), (["b"],), (["b"],), ([],), (None,)], "reject_reasons array<string>")
    assert sorted(map(tuple, quality.reason_counts(rows).collect())) == [("a", 1), ("b", 3)]
    assert sorted(map(tuple, quality.reason_counts(rows, none="-").collect())) == [("-", 1), ("a", 1), ("b", 3)]


def test_sets_of_reasons_are_counted_before_they_are_judged(spark):
    assert plan(core.QUERIES["gate_label_from_reasons"](spark, DATA)).count("Aggregate") == 2


def test_array_is_written_without_scratch_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays.scratch, "materialize", None)
    df = spark.createDataFrame([(None, "b"), (None, "b"), (2, "]"), (1, None), (2, "z"), (2, "z")], "k int, t string").repartition(3)
    arrays.write_json_array(df, str(tmp_path / "out"), ["k", "t"])
    told = "\n".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    assert [(x["k"], x["t"]) for x in json.loads(told)] == [(None, "b"), (None, "b"), (1, None), (2, "]"), (2, "z"), (2, "z")]
