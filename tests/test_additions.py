"""Readers' errors and precedence, policy terms by hand, scratch folders."""

from __future__ import annotations

from math import exp
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from grainmill import scratch
from grainmill.functions import jsonx, losses
from grainmill.operators import quality, ranking, records
from grainmill.sources import io


def test_records_come_from_the_manifest_or_the_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b.PNG", "in/a.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "list.jsonl").write_text('{"id": "m1", "image": "x.png"}\n\n{"id": "m2", "image": "y.png"}\n')
    (tmp_path / "none.jsonl").write_text("\n")
    folder, manifest = str(tmp_path), str(tmp_path / "list.jsonl")
    assert [r["id"] for r in io.load_records(spark, manifest, folder, limit=1).collect()] == ["m1"]
    assert [r["id"] for r in io.load_records(spark, folder=folder, limit=9).collect()] == ["b", "in_a"]
    with pytest.raises(ValueError):
        io.load_records(spark)
    with pytest.raises(ValueError):
        io.read_json_lines(spark, str(tmp_path / "none.jsonl"), "id string", some=True)
    assert io.read_json_lines(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0


def test_policy_terms_by_hand(spark):
    rows = [("a", -1.0, -1.5, -1.0, 2.0, 1), ("a", -2.0, -2.0, -1.0, 2.0, 0), ("b", -1.0, None, -1.0, -1.0, 1)]
    tokens = spark.createDataFrame(rows, "seq string, logp double, old_logp double, reference_logp double, advantage double, mask int")
    by_token = losses.policy_terms(tokens, ["seq"], beta=0.5).orderBy("seq", "logp").collect()
    ratio = exp(0.5)
    gate = 0.2 + 0.8 * exp(-4 * (ratio - 1))
    assert by_token[1]["ratio"] == pytest.approx(ratio) and by_token[1]["loss"] == pytest.approx(-(gate * ratio + (1 - gate) * 1.2) * 2)
    assert by_token[0]["loss"] == pytest.approx(-2 + 0.5 * (exp(1) - 2)) and by_token[1]["high_clipped"] and not by_token[2]["low_clipped"]
    by_sequence = losses.policy_terms(tokens, ["seq"], by_sequence=True).orderBy("seq", "logp").collect()
    assert [r["ratio"] for r in by_sequence] == pytest.approx([ratio, ratio, 1.0])
    with_mask = losses.policy_summary(losses.policy_terms(tokens, ["seq"])).first()
    assert with_mask["loss"] == pytest.approx((by_token[1]["loss"] + 1.0) / 2) and with_mask["divergence"] == 0


def test_flat_text_of_any_nesting(spark):
    raw = ['{"a": {"b": [" x ", 1, {"c": "y"}, " "]}, "d": null}', '"z"', "{broken", None, "[]"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").select("i", jsonx.flatten_any(F.col("raw")).alias("t"))
    assert [r["t"] for r in rows.orderBy("i").collect()] == ["x\ny", "z", None, None, ""]


def test_history_of_questions(spark):
    none = F.lit(None).cast("array<struct<question:string,answer:string>>")
    row = spark.range(1).select(records.ask(records.ask(none, F.lit("q"), F.lit(""), F.lit("a"), "no report"), F.lit("r"), F.lit("report"), F.lit("b")).alias("h")).first()
    assert [(x["question"], x["answer"]) for x in row["h"]] == [("q", "no report"), ("r", "b")]


def test_ranks_with_clashing_names(spark):
    df = spark.createDataFrame([(3, "x"), (1, "y"), (2, None)], "o0 int, row string").withColumns({"range": F.lit(7), "v0": F.lit(8)})
    out = ranking.running_total(df, ["o0"], {"rank": F.lit(1)}).orderBy("o0").collect()
    assert [(r["o0"], r["row"], r["range"], r["v0"], r["rank"]) for r in out] == [(1, "y", 7, 8, 0), (2, None, 7, 8, 1), (3, "x", 7, 8, 2)]


def test_equal_rows_do_not_exceed_the_quota(spark):
    rows = [(1, 5.0, 5.0, 5.0, 100.0)] * 5
    out = quality.curate(spark.createDataFrame(rows, "cluster_key int, sharpness double, contrast double, entropy double, brightness double"), []).collect()
    assert sorted(str(r["cluster_rank"]) for r in out) == ["1", "2", "None", "None", "None"]


def test_scratch_wants_a_shared_folder_on_a_cluster():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(RuntimeError):
        scratch.shared_dir(spark)
