"""Symbolic answers, restarted logs, histories, arrays, objects, images, services and encoders, by hand and against brute force."""

from __future__ import annotations

import json
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.functions import encoding, jsonx, objects, symbolic
from grainmill.operators import genlog, quality, ranking, selection, splits
from grainmill.sources import arrays, io, png, service
from grainmill.streaming import history, restart, rollup

# Symbolic answers.

EQUAL = [
    ("1/2", "0.5"),
    (r"\frac{1}{2}", "$0.5$"),
    (r"$\dfrac12$", "1/2"),
    (r"The answer is $\boxed{\frac{2}{4}}$.", r"$\frac{1}{2}$"),
    (r"\boxed{50\%}", "1/2"),
    ("$x^2-1$", "$(x-1)(x+1)$"),
    (r"$\frac{x^2-1}{x-1}$", "x+1"),
    (r"2\sqrt{2}", r"$\sqrt{8}$"),
    (r"\sqrt[3]{27}", "3"),
    ("$1,234$", "1234"),
    ("(1,2)", "$(1, 2)$"),
    (r"$\{2,1\}$", r"\{1,2\}"),
    ("x = 5", "5"),
    ("$2x+y=3$", "$4x+2y=6$"),
    ("Yes ", "yes"),
    (r"$\sin^2 x+\cos^2 x$", "1"),
    (r"$90^\circ$", "90"),
    (r"$5\text{ cm}$", "5"),
    ("2^{-1}", "0.5"),
    (r"$2\pi r$", r"$2 r \pi$"),
    ("[0,1)", "[0,1)"),
    ("3!", "6"),
    ("", ""),
    ("$e^{x}e^{y}$", "$e^{x+y}$"),
    ("2*-3", "-6"),
    ("$x_1+x_{2}$", "$x_2+x_1$"),
    ("9" * 50, "9" * 50),
]
DIFFERENT = [("$x^2+1$", "$(x-1)(x+1)$"), ("(2,1)", "(1,2)"), ("$2x+y=3$", "$4x+2y=7$"), ("no", "yes"), ("[0,1]", "[0,1)"), ("hello world", "2"), ("((((", "1"), ("\\boxed{3", "3"), ("9" * 49 + "8", "9" * 50), ("(1,2,3)", "(1,2)"), ("1" + "+1" * 3000, "3001")]
NONE = [("1/0", "1"), ("1", "1/0"), (None, "1"), ("1", None), (r"\frac{1}{x-x}", "$x$")]


def test_symbolic_answers_by_hand(spark):
    rows = [(*p, w) for pairs, w in ((EQUAL, 1.0), (DIFFERENT, 0.0), (NONE, None)) for p in pairs] * 2
    df = spark.createDataFrame(rows, "a string, b string, want double").withColumn("accuracy", F.lit("clash"))
    for found in (symbolic.with_accuracy(df, "a", "b"), df.withColumn("accuracy", symbolic.accuracy(F.col("a"), F.col("b")))):
        got = found.collect()
        assert len(got) == len(rows) and [(r["a"], r["b"], r["accuracy"]) for r in got if r["accuracy"] != r["want"]] == []


def test_polynomials_are_one_if_their_expansions_are():
    rnd = random.Random(5)
    for _ in range(60):
        a, b, c, d = (rnd.randint(-9, 9) for _ in range(4))
        product, wrong = f"$({a}x+{b}y)({c}x-{d})$", f"{a * c}x^2 - {a * d}x + ({b * c})yx + ({-b * d})y"
        assert symbolic.accurate(product, f"${wrong.replace('- -', '+ ')}$") == 1.0
        assert symbolic.accurate(product, f"${wrong} + 1$") == 0.0


# Restarted logs and histories.


def run_log(spark, tmp_path, waves, done=None, stop_at=()):
    """Waves of (id, value) rows, each worked off; a stop in the batch of that number comes once."""
    folder, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    asked, stopped = [], set()

    def make(rows):
        asked.extend(r["id"] for r in rows.collect())
        return rows.select("id", "value", F.when(F.col("value") < 0, "error").otherwise("ok").alias("status"))

    def after(number):
        if number in stop_at and number not in stopped:
            stopped.add(number)
            raise RuntimeError("stopped")

    schema = "id long, value long, status string"
    for wave in waves:
        spark.createDataFrame(wave, "id long, value long").coalesce(1).write.mode("append").json(folder)
        for _ in range(3):
            log = rollup.read_log(spark, folder, "id long, value long", files_per_batch=1)
            try:
                restart.work_off(log, store, checkpoint, make, schema, "id", "value", done=done, after=after).awaitTermination()
                break
            except Exception as e:
                assert "stopped" in str(e)
    return restart.finished(spark, store, schema), asked


def test_restart_finishes_each_id_once(spark, tmp_path):
    waves = [[(i, i) for i in range(20)] + [(3, 1), (None, 5)], [(i, 100 + i) for i in range(10, 30)], [(5, 0), (40, 1), (None, 6)]]
    found, asked = run_log(spark, tmp_path, waves, stop_at=(0, 2))
    rows = found.collect()
    assert Counter(r["id"] for r in rows if r["id"] is not None) == Counter([*range(30), 40])
    assert {r["id"]: r["value"] for r in rows if r["id"] is not None} == {3: 1} | {i: i for i in range(20) if i != 3} | {i: 100 + i for i in range(20, 30)} | {40: 1}
    assert sorted(r["value"] for r in rows if r["id"] is None) == [5, 6]
    assert Counter(asked)[7] == 2 and Counter(asked)[25] == 1 and Counter(asked)[40] == 2  # only what a stop cut off was asked twice
    # As the batch anti-join of the same log.
    log = spark.createDataFrame([(k, *r) for k, w in enumerate(waves) for r in w if r[0] is not None], "wave int, id long, value long")
    for k in range(3):
        had = found.where(F.col("batch") < k)
        _, pending = genlog.resume(log.where(F.col("wave") == k).select("id").distinct(), had, "id")
        assert {r["id"] for r in pending.collect()} == {r["id"] for r in rows if r["batch"] == k and r["id"] is not None}


def test_restart_asks_again_for_what_failed(spark, tmp_path):
    found, asked = run_log(spark, tmp_path, [[(1, -1), (2, 2)], [(1, 1), (2, 9)], [(1, 7)]], done=F.col("status") == "ok")
    assert sorted((r["id"], r["value"], r["status"]) for r in found.collect()) == [(1, -1, "error"), (1, 1, "ok"), (2, 2, "ok")]
    assert asked == [1, 2, 1] or sorted(asked) == [1, 1, 2]


def test_history_grows_over_batches(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    waves = [
        [(1, 0, "user", "a?"), (1, 1, "assistant", "A"), (2, 0, "user", " \n"), (2, 1, "assistant", "no question"), (None, 0, "user", "x")],
        [(1, 2, "user", "b?"), (2, 2, "user", "first?"), (2, 3, "user", "second?"), (3, 0, "assistant", "nobody asked")],
        [(1, 3, "assistant", None), (1, 2, "user", "again"), (1, 1, "assistant", "again"), (2, 4, "assistant", "B"), (2, 5, "system", "s"), (2, 6, "assistant", "more")],
    ]
    for wave in waves:
        spark.createDataFrame(wave, "conv_id long, turn int, role string, text string").write.mode("append").json(folder)
        told = history.follow(rollup.read_log(spark, folder, "conv_id long, turn int, role string, text string"), "conv_id")
        writer = told.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        writer.foreachBatch(lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/of={n}")).trigger(availableNow=True).start().awaitTermination()
    last = genlog.latest(spark.read.parquet(out).drop("of"), "conv_id", "batch").collect()
    assert {r["conv_id"]: [tuple(p) for p in r["history"]] for r in last} == {1: [("a?", "A"), ("b?", None)], 2: [("second?", "B")], 3: []}


# Arrays of JSON.


def test_arrays_in_splits_of_any_size(spark, tmp_path):
    rnd = random.Random(4)

    def value(depth=0):
        kind = rnd.randrange(6)
        if kind == 0 and depth < 3:
            return {rnd.choice(["a", "b{", 'c"', "d\\"]): value(depth + 1) for _ in range(rnd.randrange(4))}
        if kind == 1 and depth < 3:
            return [value(depth + 1) for _ in range(3)]
        return rnd.choice(["}{", '"', "\\", '\\"}', "x\ny", "é}", 1, None, True, "\\\\", "{}" * 5])

    made = [{"id": i, "o": value() if i % 3 else {}} for i in range(400)]
    (tmp_path / "pretty.json").write_text(json.dumps(made, indent=2))
    (tmp_path / "line.json").write_text(json.dumps(made, ensure_ascii=False))
    (tmp_path / "empty.json").write_text("[]\n")
    (tmp_path / "mixed.json").write_text('[1, null, {"id": 0}, [2], {"id": 7}]')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        for most, name in (("700", "pretty.json"), ("5000", "line.json"), ("128m", "pretty.json")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            got = arrays.scan_objects(spark, str(tmp_path / name)).orderBy("place").collect()
            assert [json.loads(r["object"]) for r in got] == made and [r["place"] for r in got] == list(range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert arrays.scan_objects(spark, str(tmp_path / "empty.json")).count() == 0
    assert [tuple(r) for r in arrays.read_json_array(spark, str(tmp_path / "mixed.json"), "id int").orderBy("place").collect()] == [(0, 0), (1, 7)]


def test_arrays_are_written_as_one(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f'{{"}}]\\ {i}\n') for i in range(100)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(7).withColumn("rank", F.lit(1))
    arrays.write_json_array(df, str(tmp_path / "out"), ["id"])
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert json.loads(whole) == [{"id": i, "t": t, "rank": 1} for i, t in rows]
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    got = arrays.read_json_array(spark, str(tmp_path / "out"), "id int, t string").orderBy("place")
    assert [(r["id"], r["t"]) for r in got.collect()] == rows
    arrays.write_json_array(df.limit(0), str(tmp_path / "none"), ["id"])
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []


# Objects and nested strings.


def test_objects_of_texts(spark):
    texts = ['{"a": 1} and {"b": {"c": "}"}} {bad} [{"d": 2}]', "none", None, "", '{"a": 1', 'é{"x": "\\""}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = objects.explode_objects(df, F.col("t"), outer=True).orderBy("i", "place").collect()
    assert [(r["i"], r["place"], r["object"]) for r in got] == [(0, 0, '{"a": 1}'), (0, 1, '{"b": {"c": "}"}}'), (0, 2, '{"d": 2}'), (1, None, None), (2, None, None), (3, None, None), (4, None, None), (5, 0, '{"x": "\\""}')]
    assert all(texts[r["i"]][r["start"] : r["start"] + r["length"]] == r["object"] for r in got if r["object"])
    assert objects.explode_objects(df, F.col("t")).count() == 4


def test_flat_strings_against_a_walk(spark):
    rnd = random.Random(9)
    leaf = lambda: rnd.choice(["a", " b ", "", "  ", 'q"', "back\\", '\\"', "k:", "é\n", 1, None, True, 2.5, "x" * 5000, '\\" : ' * 2000])

    def value(depth):
        kind = rnd.randrange(3) if depth < 4 else 2
        return {f'{rnd.choice("zya")}{k}"': value(depth + 1) for k in range(3)} if kind == 0 else [value(depth + 1) for _ in range(2)] if kind == 1 else leaf()

    def strings(node):
        if isinstance(node, str):
            yield node.strip()
        elif isinstance(node, (dict, list)):
            for x in node.values() if isinstance(node, dict) else node:
                yield from strings(x)

    made = [value(0) for _ in range(80)]
    rows = [(i, json.dumps(m, indent=rnd.choice([None, 1]), ensure_ascii=bool(i % 2))) for i, m in enumerate(made)]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, raw string").select("i", jsonx.flatten_any(F.col("raw")).alias("t")).collect()}
    assert got == {i: "\n".join(s for s in strings(m) if s) for i, m in enumerate(made)}


# Images.


def any_png(pixels, colour, filters, palette=None):
    """A PNG by the definition of its filters, pixel for pixel."""
    height, width, step = pixels.shape
    lines, flat = [], pixels.reshape(height, -1).astype(int)
    for y in range(height):
        line = [filters[y]]
        for x in range(width * step):
            a, b = (flat[y][x - step] if x >= step else 0), (flat[y - 1][x] if y else 0)
            c = flat[y - 1][x - step] if y and x >= step else 0
            paeth = min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]
            line.append((flat[y][x] - (0, a, b, (a + b) // 2, paeth)[filters[y]]) % 256)
        lines.append(bytes(line))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + b"crc!"
    body = zlib.compress(b"".join(lines))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)), chunk(b"PLTE", palette) if palette else b"", chunk(b"IDAT", body[:20]), chunk(b"IDAT", body[20:]), chunk(b"IEND", b"")]
    return png.SIGNATURE + b"".join(parts)


@pytest.mark.parametrize("colour", [0, 2, 3, 4, 6])
def test_pixels_of_every_kind(colour):
    rnd = np.random.default_rng(colour)
    pixels = rnd.integers(0, 256, (11, 7, png.CHANNELS[colour]), dtype=np.uint8)
    palette = rnd.integers(0, 256, 768, dtype=np.uint8).tobytes() if colour == 3 else None
    got = png.decode(any_png(pixels, colour, [int(f) for f in rnd.integers(0, 5, 11)], palette))
    want = np.frombuffer(palette, np.uint8).reshape(-1, 3)[pixels[:, :, 0]] if palette else pixels[:, :, :3] if colour in (2, 6) else np.repeat(pixels[:, :, :1], 3, axis=2)
    assert (got == want).all()
    for kind in range(3):
        if colour in (2, 6):
            assert (png.decode(png.encode(pixels, kind)) == want).all()


def test_downscale_against_loops():
    pixels = np.random.default_rng(3).integers(0, 256, (13, 20, 3), dtype=np.uint8)
    got = png.downscale(pixels, 8)

    def line(values, new):
        out, scale = [], len(values) / new
        for i in range(new):
            centre = (i + 0.5) * scale
            weights = [max(0.0, 1 - abs(j + 0.5 - centre) / scale) for j in range(len(values))]
            out.append(int(sum(w * v for w, v in zip(weights, values, strict=True)) / sum(weights) + 0.5))
        return out

    assert got.shape == (5, 8, 3) and png.downscale(pixels, 20) is pixels
    for c in range(3):
        across = [line(pixels[y, :, c].tolist(), 8) for y in range(13)]
        want = np.array([line([row[x] for row in across], 5) for x in range(8)]).T
        assert np.abs(got[:, :, c].astype(int) - want).max() <= 1  # halves


def test_scores_of_files(spark):
    grey = np.random.default_rng(2).integers(0, 256, (6, 9), dtype=np.uint8)
    whole = png.encode(grey, 2)
    rows = [(0, bytearray(whole)), (1, bytearray(whole[:50])), (2, None), (3, bytearray(b"")), (4, bytearray(b"GIF89a"))]
    got = {r["i"]: r for r in png.score_images(spark.createDataFrame(rows, "i int, content binary").withColumn("entropy", F.lit(1))).collect()}
    assert [got[0][s] for s in png.STATISTICS] == pytest.approx(io.image_statistics(grey))
    assert all(got[i][s] is None for i in range(1, 5) for s in png.STATISTICS)


# Services and encoders.


def test_budget_and_pauses():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    budget = service.Budget(4, lambda: now[0], sleep)
    for _ in range(3):
        budget.wait()
    assert slept == [0.25, 0.25] and now[0] == 0.5
    budget.wait(2.0)
    assert now[0] == 2.5
    waits = [service.pause(service.request_key(1, k), k, 0.5, 4.0) for k in range(1, 8)]
    assert waits[0] == 0 and all(w / 2 <= x <= w for w, x in zip((0.5, 1, 2, 4, 4, 4), waits[1:], strict=True))


def test_a_task_run_twice_sends_the_same_keys(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def connect():
        def client(key, row):
            with open(seen, "a") as f:
                f.write(f"{row['id']} {key}\n")
            if row["id"] == 2 or (row["id"] == 1 and key == service.request_key(1, 1)):
                raise service.Failed("busy")
            return f"r{row['id']}"

        return client

    rows = spark.createDataFrame([(i,) for i in range(4)], "id long")
    logs = [sorted(tuple(r) for r in service.ask(rows, "id", connect, attempts=2, first_pause=0.0).collect()) for _ in range(2)]
    assert logs[0] == logs[1]
    assert [(r[0], r[1], r[3], r[4]) for r in logs[0]] == [(0, 1, "ok", "r0"), (1, 1, "error", "busy"), (1, 2, "ok", "r1"), (2, 1, "error", "busy"), (2, 2, "error", "busy"), (3, 1, "ok", "r3")]
    with open(seen) as f:
        assert set(Counter(f.read().splitlines()).values()) == {2}
    final = genlog.final_outcome(spark.createDataFrame(logs[0], "id long, attempt int, key string, status string, response string"), "id", "attempt", 2)
    assert {r["id"]: r["outcome"] for r in final.collect()} == {0: "ok", 1: "ok", 2: "failed", 3: "ok"}


def test_encoders_are_made_once_a_worker(spark, tmp_path):
    made = str(tmp_path / "made")

    def make():
        with open(made, "a") as f:
            f.write("x")
        return lambda texts: [[ord(c) for c in t] for t in texts]

    df = spark.createDataFrame([(1, "ab", "c"), (1, "", "defg"), (2, None, "h")], "b int, p string, r string").coalesce(1)
    rows = encoding.training_rows(df, "p", "r", "b", str(tmp_path), make, most=3, end=9)
    got = sorted((r["b"], r["input_ids"], r["labels"], r["attention_mask"]) for r in rows.collect())
    assert got == [(1, [97, 98, 99, 9], [-100, -100, 99, 9], [1, 1, 1, 1]), (1, [100, 101, 9, 0], [100, 101, 9, -100], [1, 1, 1, 0]), (2, [104, 9], [104, 9], [1, 1])]
    with open(made) as f:
        assert f.read() in ("x", "xx")  # the columns may have a worker each


# Names that clash, and elements at a place.


def test_clashing_names_pass(spark):
    names = ("_row", "_i", "_best", "_heads", "_rs", "row", "at", "q", "s", "c", "e", "y", "cluster", "_n", "_k", "_prio", "_turn", "_order", "_bucket", "_rank", "_size", "_key", "order", "bucket", "label", "key", "of", "l", "b", "val")
    rows = [(i, i % 4, float(i), float(i % 3), float(i % 5), 100.0, i % 2) for i in range(24)]
    plain = spark.createDataFrame(rows, "id long, kind int, sharpness double, contrast double, entropy double, brightness double, side int")
    full = plain.withColumns({n: F.lit(n) for n in names})
    for run in (
        lambda df: quality.curate(df, ["id"], cluster="kind"),
        quality.score,
        lambda df: selection.per_cluster(df, "kind", ["id"], 2),
        lambda df: selection.two_source_quota([df, df.withColumn("id", F.col("id") + 50)], "kind", ["id"], 7),
        lambda df: selection.stratified(df, "side", "kind", ["id"], 2, 5),
        lambda df: selection.stratified_exact(df, "id", "side", "kind", ["id"], 2, 5),
        lambda df: splits.stratified_split(df, "side", "id", 0.3),
        lambda df: splits.cluster_split(df, "kind", [("val", 0.25)], "train"),
    ):
        want, got = run(plain), run(full)
        new = want.columns
        assert sorted(map(str, got.select(*new).collect())) == sorted(map(str, want.collect()))
        assert all(r[n] == n for r in got.collect() for n in names)


def test_element_at_a_place(spark):
    rnd = random.Random(11)
    values = [rnd.choice([rnd.random(), 5.0, 1e300, -1e300, 1e-300, float(rnd.randrange(5))]) for _ in range(400)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    order = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    for share in (0.0, 0.1, 0.5, 0.9, 0.99):
        assert ranking.element_at(df, "x", share) == order[int(share * (len(order) - 1))]
    assert ranking.element_at(df, "x", 1.0) != ranking.element_at(df, "x", 1.0)  # NaN
    whole = spark.createDataFrame([(v,) for v in (2**62 + 1, 2**62, 7, 7, None)], "x long")
    assert [ranking.element_at(whole, "x", q) for q in (0.0, 0.4, 0.7, 1.0)] == [7, 7, 2**62, 2**62 + 1]
    assert ranking.element_at(df.limit(0), "x", 0.5) is None
