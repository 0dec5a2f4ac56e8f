"""Operators over tables: properties, ties, nulls and empty inputs."""

from __future__ import annotations

import base64
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill import lexicons as L
from grainmill import scratch
from grainmill.operators import genlog, metrics, quality, ranking, records, selection, splits
from grainmill.sources import io
from grainmill.streaming import rollup


def rows(n=300, seed=1):
    rnd = random.Random(seed)
    return [(i, f"c{rnd.randrange(60)}", float(rnd.randrange(50)), rnd.random(), rnd.random(), rnd.random() * 255) for i in range(n)]


SCHEMA = "id long, cluster_key string, sharpness double, contrast double, entropy double, brightness double"


def test_running_total_and_rank(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([5, 3, None, 3, 9, 1])], "k int, v int")
    got = ranking.running_total(df, ["k", "v"], {"rank": F.lit(1).cast("long"), "before": F.col("v")}).orderBy("rank").collect()
    assert [(r["k"], r["rank"], r["before"]) for r in got] == [(None, 0, 0), (1, 1, 2), (3, 2, 7), (3, 3, 8), (5, 4, 11), (9, 5, 11)]
    assert ranking.running_total(df.limit(0), ["k"], {"rank": F.lit(1)}).count() == 0


@pytest.mark.parametrize("leaf", [256, 2])
def test_running_total_by_hash(spark, leaf):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("part"), F.xxhash64("id").alias("h"), (F.col("id") % 5).alias("v"))
    got = ranking.running_total_by_hash(df, "part", "h", "id", "v", "at", 500, fan=3, leaf=leaf).orderBy("id").collect()
    want = df.withColumn("at", F.coalesce(F.sum("v").over(Window.partitionBy("part").orderBy(F.expr("h >= 0 = false"), "h", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert {r["id"]: r["at"] for r in got} == {r["id"]: r["at"] for r in want.collect()}


def test_cume_dist_and_quantiles(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    want = df.withColumn("w", F.cume_dist().over(Window.orderBy("sharpness")))
    got = ranking.cume_dist(want, {"sharpness": "g"})
    assert got.where("g <> w").count() == 0 and got.count() == 300
    values = sorted(r[2] for r in rows())
    assert ranking.floor_quantiles(df, "sharpness", [0.0, 0.4, 1.0]) == {q: values[int(q * 299)] for q in (0.0, 0.4, 1.0)}
    assert ranking.floor_quantiles(df.limit(0), "sharpness", [0.5]) == {0.5: None}


def test_curate_properties(spark):
    out = quality.curate(spark.createDataFrame(rows(), SCHEMA), ["id"]).collect()
    assert len(out) == 300
    kept = {}
    for r in out:
        clean = r["quality_bucket"] == "clean"
        assert clean == (r["reject_reasons"] == []) == (r["cluster_rank"] is not None)
        assert r["reject_reasons"] == [x for x in quality.REASONS if x in r["reject_reasons"]]
        assert ("too_dark" in r["reject_reasons"]) == (r["brightness"] < 45)
        if clean:
            kept.setdefault(r["cluster_key"], []).append(r["cluster_rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 2 for v in kept.values())


def test_curate_boundaries(spark):
    """Brightness at both limits is kept; a dark best row leaves rank 1 to its successor."""
    data = [(1, "a", 9.0, 1.0, 1.0, 10.0), (2, "a", 9.0, 1.0, 1.0, 45.0), (3, "b", 9.0, 1.0, 1.0, 215.0), (4, "c", 1.0, 0.0, 0.0, 128.0)]
    limits = L.CurationLimits(secondary_ratio=0.1)
    out = {r["id"]: r for r in quality.curate(spark.createDataFrame(data, SCHEMA), ["id"], limits=limits).collect()}
    assert "too_dark" in out[1]["reject_reasons"] and out[2]["reject_reasons"] == [] and out[2]["cluster_rank"] == 1
    assert "too_bright" not in out[3]["reject_reasons"]


def test_splits(spark):
    df = spark.createDataFrame([(i, f"c{i % 37}") for i in range(400)], "id long, c string")
    out = splits.cluster_split(df, "c", [("eval", 0.15), ("grpo", 0.25)], "sft")
    assert out.count() == 400 and {r["shared"] for r in splits.leakage(out, "c").collect()} == {0}
    sizes = {r["split"]: r["rows"] for r in splits.split_summary(out, "c").collect()}
    assert 60 <= sizes["eval"] < 60 + 11 and 100 <= sizes["grpo"] < 100 + 11 and sum(sizes.values()) == 400
    mixed = out.unionByName(out.where("split = 'eval'").limit(1).withColumn("split", F.lit("sft")))
    assert sum(r["shared"] for r in splits.leakage(mixed, "c").collect()) == 1
    with pytest.raises(ValueError, match="ratio"):
        splits.cluster_split(df, "c", [("a", 0.6), ("b", 0.5)], "rest")
    assert splits.target_size(3906, 0.25) == 976 and splits.target_size(1, 0.1) == 1


def test_stratified_split(spark):
    data = [(i, "a") for i in range(425)] + [(1000 + i, "b") for i in range(927)] + [(3000 + i, "c") for i in range(1098)] + [(9000, "one"), (9001, "two"), (9002, "two")]
    out = splits.stratified_split(spark.createDataFrame(data, "id long, y string"), "y", "id", 0.2)
    n = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert (n["a", "val"], n["b", "val"], n["c", "val"]) == (85, 185, 220)
    assert n["one", "val"] == 1 and ("one", "train") not in n and (n["two", "val"], n["two", "train"]) == (1, 1)
    with pytest.raises(Exception, match="unknown label"):
        splits.stratified_split(spark.createDataFrame(data, "id long, y string"), "y", "id", 0.2, labels=["a"]).collect()


def brute_stratified(data, most, limit, least):
    queues = {}
    for r in sorted(data, key=lambda r: (-r[3], -r[0])):
        if r[2] >= least:
            queues.setdefault(r[2], []).append(r)
    used, out = {}, []
    while len(out) < limit and any(queues.values()):
        for level in sorted(queues, reverse=True):
            while queues[level]:
                r = queues[level].pop(0)
                if used.get(r[1], 0) < most:
                    used[r[1]] = used.get(r[1], 0) + 1
                    out.append(r[0])
                    break
            if len(out) >= limit:
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_stratified_selection(spark, seed):
    rnd = random.Random(seed)
    data = [(i, f"c{rnd.randrange(12)}", rnd.randrange(5), float(rnd.randrange(6))) for i in range(80)]
    df = spark.createDataFrame(data, "id long, c string, level int, score double")
    order = [F.desc("score"), F.desc("id")]
    got = [r["id"] for r in selection.stratified_exact(df, "id", "level", "c", order, 2, 17, 1).orderBy("pick").collect()]
    assert got == brute_stratified(data, 2, 17, 1)
    own = [(i, f"c{lv}-{i % 3}", lv, s) for i, _, lv, s in data]
    got = [r["id"] for r in selection.stratified(spark.createDataFrame(own, "id long, c string, level int, score double"), "level", "c", order, 2, 17, 1).collect()]
    assert got == brute_stratified(own, 2, 17, 1)


def test_selection(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "x", 6)], "id long, c string, n int")
    b = spark.createDataFrame([(3, "x", ["r"]), (4, "y", ["r"])], "id long, c string, reasons array<string>")
    got = selection.two_source_quota([a, b], "c", ["id"], 2).orderBy("id").collect()
    assert [(r["id"], r["n"], r["reasons"]) for r in got] == [(1, 5, None), (2, 6, None), (4, None, ["r"])]
    ids = spark.createDataFrame([(9, 0), (7, 1), (9, 2)], "id long, o int")
    data = spark.createDataFrame([(7, "old", 0), (7, "new", 1), (9, "only", 2)], "id long, v string, o int")
    assert [(r["id"], r["v"]) for r in selection.lookup(ids, data, "id", "o", "o").orderBy("_at").collect()] == [(9, "only"), (7, "new")]
    assert selection.missing_ids(ids, data.where("id = 7"), "id").count() == 1
    assert selection.top(a, "c", [F.desc("n")], 1, 0).count() == 1


def conversation(*turns):
    return [{"from": f, "value": v} for f, v in turns]


def test_records(spark):
    data = [(1, conversation(("human", "<image>\nhi"), ("gpt", " "), ("gpt", " yes　"))), (2, conversation(("human", "x"))), (3, conversation(("system", "s"), ("human", "<image>q\n<image>\n")))]
    df = spark.createDataFrame(data, f"id long, c {records.TURN}")
    out = df.select("id", records.to_messages(F.col("c")).alias("m"), records.first_answer(F.col("c")).alias("a")).orderBy("id").collect()
    assert out[0]["m"][0].asDict() == {"role": "user", "content": L.IMAGE_TOKENS + "hi"} and out[0]["a"] == "yes" and out[1]["a"] is None
    assert out[2]["m"][1]["content"] == L.IMAGE_TOKENS + "q" + L.IMAGE_TOKENS and out[2]["m"][0]["role"] == "system"
    rep = records.report_mode(df.withColumnRenamed("c", "conversations"), "P").orderBy("id").collect()
    assert rep[0]["conversations"][0]["value"] == "<image>\nP" and rep[0]["id"] == "1_report" and rep[1]["error"] and rep[1]["conversations"] is None
    sample = df.where("id = 1").select(records.grpo_sample(F.col("c")).alias("s")).first()["s"]
    assert [m["content"] for m in sample["prompt"]] == [L.SYSTEM_MESSAGE, "hi"] and sample["assistant"] == " "


def test_arrays(spark):
    df = spark.createDataFrame([(0, [1, 2], [3]), (0, [1], [3, 4, 5]), (1, [0], [9])], "b int, p array<int>, r array<int>")
    right = records.collate(df, "b", "p", "r").orderBy("b", F.size("p")).collect()
    assert right[0]["input_ids"] == [1, 3, 4, 5] and right[0]["labels"] == [-100, 3, 4, 5]
    assert right[1]["input_ids"] == [1, 2, 3, 0] and right[1]["attention_mask"] == [1, 1, 1, 0] and right[1]["labels"] == [-100, -100, 3, -100]
    assert right[2]["attention_mask"] == [0, 1]
    left = records.collate(df, "b", "p", "r", left=True).where(F.size("p") == 2).first()
    assert left["input_ids"] == [0, 1, 2, 3]
    x = spark.createDataFrame([([1, 2, 3, 4],)], "x array<int>")
    assert x.select(records.truncate(F.col("x"), 3, 9)).first()[0] == [1, 2, 9]
    assert [tuple(p) for p in x.select(records.turn_pairs(F.col("x"))).first()[0]] == [(1, 2), (3, 4)]
    with pytest.raises(Exception, match="odd number"):
        x.select(records.turn_pairs(F.slice("x", 1, 3))).collect()
    m = spark.createDataFrame([([1, 0, 2], ["a", "b", "c"])], "n array<int>, m array<string>")
    assert m.select(records.media_slices(F.col("n"), F.col("m"))).first()[0] == [["a"], [], ["b", "c"]]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string")
    rep = {r["label"]: r for r in metrics.class_report(df, "t", "p", ["a", "b", "z"]).collect()}
    assert rep["a"]["precision"] == 1 and rep["a"]["recall"] == 0.5 and rep["z"]["f1"] == 0 and rep["b"]["support"] == 1
    assert metrics.macro(metrics.class_report(df, "t", "p", ["a", "b"])).first()["macro_f1"] == pytest.approx(2 / 3)
    assert metrics.accuracy(df, "t", "p").first()[0] == pytest.approx(2 / 3)
    assert metrics.summary(df.limit(0), {"x": F.col("t") == "a"}).first().asDict() == {"num_samples": 0, "x": 0.0}
    epochs = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 0.5), (4, 0.4), (5, 0.3), (6, 0.9)], "e int, f double")
    assert metrics.best_epoch(epochs, "e", "f", 2).first()["e"] == 2 and metrics.best_epoch(epochs, "e", "f", 9).first()["e"] == 6
    w = metrics.balanced_weights(metrics.class_counts(df, "t", ["a", "b", "z"]), 3).collect()
    assert sum(r["weight"] for r in w) == pytest.approx(3)


def test_generation_log(spark):
    log = [("a", "error", 1, None, None), ("a", "ok", 2, "j", "accept"), ("b", "filtered", 1, None, None), ("b", "filtered", 2, None, None), ("c", "ok", 1, "j", "accept_cautious"), ("c", "error", 2, None, None), ("d", "ok", 1, "k", "accept")]
    df = spark.createDataFrame(log, "id string, status string, attempt int, judge_model string, judge_decision string")
    manifest = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    done, pending = genlog.resume(manifest, genlog.latest(df, "id", "attempt", genlog.reusable()), "id")
    assert ids(done) == ["a", "c", "d"] and ids(pending) == ["b", "e"]
    assert ids(genlog.resume(manifest, df.where(genlog.reusable("j", allow_cautious=False)), "id")[0]) == ["a"]
    assert {r["id"]: r["outcome"] for r in genlog.final_outcome(df, "id", "attempt", 3).collect()} == {"a": "ok", "b": "filtered", "c": "failed", "d": "ok"}
    attempt = lambda rows, n: rows.select("id", F.when(F.col("id") <= chr(96 + n), "ok").otherwise("error").alias("status"))
    full = genlog.with_retries(manifest, attempt, "id", 3)
    assert full.count() == 5 + 4 + 3 and ids(full.where("status = 'ok'")) == ["a", "b", "c"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1"}, {"id": "2"}]))
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    for name in ("a.json", "b.jsonl"):
        assert [r["id"] for r in io.read_manifest(spark, str(tmp_path / name), "id string").orderBy("id").collect()] == ["1", "2"]
    (tmp_path / "c.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_manifest(spark, str(tmp_path / "c.jsonl"), "id string").collect()
    (tmp_path / "img/x").mkdir(parents=True)
    (tmp_path / "img/x/y.JPG").write_bytes(b"z" * 100)
    (tmp_path / "img/n.txt").write_bytes(b"z")
    got = io.scan_images(spark, str(tmp_path / "img")).withColumn("url", io.data_url(F.col("path"), F.col("content"))).collect()
    assert [r["id"] for r in got] == ["x_y"] and got[0]["url"] == "data:image/jpeg;base64," + base64.b64encode(b"z" * 100).decode()
    paths = spark.createDataFrame([("/a",), ("b",), ("https://c",)], "p string")
    assert [r[0] for r in paths.select(io.resolve(F.col("p"), "/r/")).collect()] == ["/a", "/r/b", "https://c"]
    io.append_log(paths, str(tmp_path / "log"))
    io.append_log(paths, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_raster_statistics(spark):
    raster = np.arange(12, dtype=np.uint8).reshape(3, 4)
    df = spark.createDataFrame([(raster.tobytes(), 3, 4)], "pixels binary, height int, width int")
    r = io.score_rasters(df).first()
    assert r["brightness"] == pytest.approx(5.5) and r["contrast"] == pytest.approx(raster.std()) and r["sharpness"] == pytest.approx(5.0)


def test_stream_equals_batch(spark, tmp_path):
    events = [(["a", "b"], "x"), ([], "x"), (None, "y"), (["a"], "x")]
    df = spark.createDataFrame(events, "reject_reasons array<string>, gate_decision string")
    for k in range(2):
        df.where(F.expr(f"{k} = 0")).write.mode("append").json(str(tmp_path / "in"))
    stream = rollup.read_log(spark, str(tmp_path / "in"), "reject_reasons array<string>, gate_decision string", 1)
    rollup.maintain(rollup.reason_rates(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("reason", "gate_decision", "n").collect()}
    assert got == {tuple(r) for r in rollup.reason_rates(df).select("reason", "gate_decision", "n").collect()}


def test_scratch(spark):
    df = scratch.materialize(spark.range(5), "t")
    assert df.count() == 5 and scratch.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
