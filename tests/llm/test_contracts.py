"""Trained models against reference solutions, and queries by name against brute force over their whole tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from grainmill import scratch
from grainmill.llm import langid, quality_classifier, quality_rules, queries, simhash, simhash_similar, url_filter

FOLDER = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def descend(objective, start, rounds=4000):
    """Gradient descent with halved steps, by central differences."""
    x, step, best = start.copy(), 1.0, objective(start)
    for _ in range(rounds):
        slope = np.array([(objective(x + 1e-5 * e) - objective(x - 1e-5 * e)) / 2e-5 for e in np.eye(len(x))])
        while (new := objective(x - step * slope)) > best - 1e-4 * step * (slope @ slope) and step > 1e-12:
            step /= 2
        x, best, step = x - step * slope, min(best, new), step * 2
        if np.abs(slope).max() < 1e-7:
            break
    return x, best


def test_ordinal_fit_against_a_generic_optimiser():
    rnd = np.random.default_rng(4)
    places = np.array([11, 500, 4096])
    x = rnd.normal(size=(120, 3))
    grades = np.digitize(x @ np.array([1.5, -1.0, 0.3]) + rnd.logistic(size=120), [-1.0, 1.0])
    ridge = 0.05

    def objective(p):
        theta = np.array([p[3], p[3] + np.exp(p[4])])
        above = 1 / (1 + np.exp(theta[None, :] - (x @ p[:3])[:, None]))  # P(grade > k)
        whole = np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))])
        each = whole[np.arange(len(x)), grades] - whole[np.arange(len(x)), grades + 1]
        return -np.log(each).mean() + ridge / 2 * (p[:3] @ p[:3])

    want, least = descend(objective, np.array([0.0, 0, 0, -1, 0.5]))
    model = quality_classifier.Model.fit([(places.astype(np.int32), r.astype(np.float32)) for r in x], grades, 3, ridge=ridge, rounds=3000, rate=0.02)
    got = np.append(model.weights[places], [model.thresholds[0], np.log(np.diff(model.thresholds))[0]])
    assert objective(got) <= least + 1e-5 and np.abs(got - want).max() < 0.02
    assert not np.delete(model.weights, places).any()


def test_grades_against_the_formula(spark):
    rnd = np.random.default_rng(5)
    model = quality_classifier.Model(rnd.normal(size=quality_classifier.DIM), np.array([-0.4, 0.7]))
    texts = ["Some words, some WORDS!!", "", None, "x " * 3000, "12 ab12 -- ?!?", "é \U0001f600"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", quality_classifier.graded(model, F.col("t")).alias("g")).collect()
    for r in got:
        places, values = quality_classifier.features(texts[r["i"]])
        s = float(model.weights[places] @ values.astype(float))
        above = 1 / (1 + np.exp(model.thresholds - s))
        assert (r["g"]["expected_grade"], r["g"]["top_probability"]) == pytest.approx((above.sum(), above[-1]), rel=1e-5)


def test_machines_against_a_generic_optimiser():
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(80, 3))
    y = np.where(x @ np.array([1.0, -2.0, 0.5]) + 0.4 + rnd.normal(size=80) > 0, 1.0, -1.0)
    last = np.sqrt((x * x).sum(1).mean())
    objective = lambda w: 0.5 * (w @ w) + 10.0 / len(y) * (np.maximum(0, 1 - y * (x @ w[:3] + w[3] * last)) ** 2).sum()
    want, least = descend(objective, np.zeros(4))
    w, b = langid.svm(x, y, rounds=3000)
    got = np.append(w, b / last)
    assert objective(got) <= least * (1 + 1e-4) and np.abs(got - want).max() < 1e-2


def test_language_scores_against_whole_vectors():
    rnd = random.Random(7)
    words = {"en": "the of and with".split(), "de": "der und mit nicht".split(), "es": "el de con para".split(), "ru": "и в не на".split()}
    rows = [(a, " ".join(rnd.choice(w) for _ in range(12))) for a, w in words.items() for _ in range(20)]
    model = langid.Model.train(np.stack([langid.vector(t) for _, t in rows]), [a for a, _ in rows])
    texts = [t for _, t in rows] + [None, "", "123 --", "x", "der the el " * 2000, rows[0][1].upper()]
    lang, score = langid.Scorer(model).predict(texts)
    for text, a, s in zip(texts, lang, score, strict=True):
        if (v := langid.vector(text)) is None:
            assert (a, s) == ("und", 0)
        else:
            (want,), (sure,) = model.decide((v @ model.weights + model.biases)[None, :])
            assert a == want and s == pytest.approx(sure)
    assert [a for a, _ in rows] == list(lang[: len(rows)])


def test_op2_by_name(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_mixing"](spark, FOLDER).collect()}
    docs = table("documents")
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    sources = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    held = {s: sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in sources}
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    target, full = {}, set()
    while True:  # the excess goes to those below their bound
        left = sum(held.values()) - sum(3 * held[s] for s in full)
        total = sum(weight[s] for s in sources if s not in full)
        target = {s: 3 * held[s] if s in full else left * weight[s] / total for s in sources}
        over = {s for s in sources if s not in full and target[s] > 3 * held[s]}
        if not over:
            break
        full |= over
    taken = dict.fromkeys(sources, 0)
    assert set(got) == set(size)
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[d["doc_id"]], held[d["source"]]) and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(target[d["source"]])
        taken[d["source"]] += r["taken"]
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in sources)


def test_op3_by_name(spark):
    pages = {p["page_id"]: (p["html"] or "").encode() for p in table("pages")}
    first = {}
    for i, payload in pages.items():
        first[payload] = max(i, first.get(payload, i))
    want = {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if first[p] == i else ("revisit", first[p]))) for i, p in pages.items()}
    got = queries.QUERIES["op3_warc"](spark, FOLDER).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want and len(got) == len(pages)


def test_op5_by_name(spark):
    from test_llm_operators import brute_verdicts

    folder = "/root/testdata/sf0.01"
    pages = pq.read_table(f"{folder}/pages.parquet", columns=["page_id", "url"]).to_pylist()
    want = brute_verdicts([p["url"] or "" for p in pages], url_filter.RULES)
    got = {r["page_id"]: r for r in queries.QUERIES["op5_url_filter"](spark, folder).collect()}
    assert [got[p["page_id"]]["verdict"] for p in pages] == want
    for p in pages:
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p["url"]).groups() if "://" in (p["url"] or "") else ("", "")
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [r for _, r in url_filter.RULES if (host == (o := r.partition("/")[0]) or host.endswith("." + o)) and path.startswith(r[len(o) :])]
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits, key=len) if fits else None)


# Large subtrees of the trie walks.


def classes_of(edges):
    return {r["node"]: r["label"] for r in simhash.connected(edges).collect()}


def test_links_in_blocks_are_all_links(spark):
    """A ball of fingerprints around one, which share their first bits, in tasks of few."""
    rnd = np.random.default_rng(8)
    centre = 0x0123456789ABCDEF
    ball = {centre ^ sum(1 << int(b) for b in rnd.choice(40, rnd.integers(0, 9), replace=False)) for _ in range(600)}
    values = np.array(sorted({*ball, *map(int, rnd.integers(0, 2**63, 200))}), np.uint64)
    apart = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    want = np.arange(len(values))
    while True:
        new = np.array([want[row].min() for row in apart])
        if (new == want).all():
            break
        want = new
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    depth = 2
    heads = df.groupBy(F.shiftrightunsigned("fp", 64 - depth).alias("head")).agg(F.count("*").alias("n"))
    pairs = df.withColumn("l", F.shiftrightunsigned("fp", 64 - depth)).withColumn("r", F.col("l"))
    blocks = simhash.in_blocks(pairs, heads, 50, "fp").groupBy("l", "r", "x", "y").count().agg(F.max("count")).first()[0]
    assert blocks <= 150 < len(ball)
    label = classes_of(simhash.links(df, least_depth=depth, most=50))
    mine = [label.get(int(v), int(v)) for v in values.view(np.int64)]
    assert len(set(zip(mine, want.tolist(), strict=True))) == len(set(mine)) == len(set(want.tolist()))


def test_near_copies_in_blocks(spark):
    """Five hundred edited copies of one text: what links them does not depend on blocks, and nearly all similar pairs are linked."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(500):
        own = list(base)
        for _ in range(rnd.randrange(4)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(own))
    texts = sorted(set(texts)) + [" ".join(f"w{rnd.randrange(5000)}" for _ in range(100)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = scratch.materialize(simhash_similar.sketches(docs).select(F.col("doc_id").alias("node"), "sketch"), "nodes")
    whole, cut = classes_of(simhash_similar.near(nodes)), classes_of(simhash_similar.near(nodes, subtree=200, largest=100))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    similar = [(i, j) for j in range(len(texts)) for i in range(j) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    assert len(similar) > 20_000
    for label in (whole, cut):
        met = sum(label.get(i, i) == label.get(j, j) for i, j in similar)
        assert met >= 0.99 * len(similar)


# The cascade's order.


def test_rules_cost_what_they_cost_beside_known_measures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    apart = quality_rules.Cascade.fit(docs)
    beside = quality_rules.Cascade.fit(docs, known=quality_rules.BASE)
    place = lambda c, name: [m.rule.name for m in c.measured].index(name)
    # Only the share of capitals is made from the text, so what rejects more than it goes before it.
    upper = next(m for m in beside.measured if m.rule.name == "max_upper_share")
    assert all(place(beside, m.rule.name) < place(beside, "max_upper_share") for m in beside.measured if m.rejected > upper.rejected)
    cost = lambda c: {m.rule.name: m.seconds_per_row for m in c.measured}["max_repeated_share"]
    assert cost(beside) < cost(apart)
    rows = lambda c: sorted(map(tuple, quality_rules.digest(docs, c).collect()))
    assert rows(apart) == rows(beside)


def test_the_order_decides_what_is_computed(spark):
    docs = spark.createDataFrame([(1, "a word " * 60)], "doc_id long, text string")
    none = quality_rules.Rule("none", lambda t: t["n_words"] < 0)
    fails = quality_rules.Rule("fails", lambda t: F.raise_error(F.concat(F.lit("read "), F.substr(t.text, F.lit(1), F.lit(3)))).cast("boolean"))
    first = quality_rules.Cascade([quality_rules.Measured(none, 1e-5, 1.0), quality_rules.Measured(fails, 1.0, 1.0)])
    assert [r["kept"] for r in quality_rules.digest(docs.withColumn("text", F.expr("repeat('one two three four ', 1) || array_join(transform(sequence(1, 60), i -> 'w' || i), ' ')")), first).collect()] == [False]
    last = quality_rules.Cascade([quality_rules.Measured(none, 1.0, 1.0), quality_rules.Measured(fails, 1e-5, 1.0)])
    with pytest.raises(Exception, match="read one"):
        quality_rules.digest(docs.withColumn("text", F.expr("'one two ' || array_join(transform(sequence(1, 60), i -> 'w' || i), ' ')")), last).collect()
