"""Each operator on small tables with nulls, empty and long texts, ties, repeats and clashing names, against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill import scratch
from grainmill.llm import ann, langid, mixing, packing, quality_classifier, quality_rules, queries, simhash, simhash_similar, token_store, tokens, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[^\x20\x09-\x0D]+"
BYTE, WORD = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")


def sentence(rnd: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    texts = [sentence(rnd, rnd.randint(1, 120)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[3] + " extra", texts[5].upper(), None, "", "   \n\t", "a", "a b", sentence(rnd, 6000), "line one here\n" * 40, "ends \u00e9\u00e8 \u3000 \x1c \U0001f600 <|endoftext|>!"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "\u00e9"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, (None, "no id at all", None, "s1", 3), rows[7], rows[7]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def cluttered(docs):
    """The documents with columns named like those the operators use."""
    names = ("size", "row_id", "fp", "label", "key", "m", "host", "kept", "component_id", "target", "_length", "piece", "score", "hash", "block", "tie")
    return docs.withColumns({n: F.lit(7) for n in names})


# Tokens.


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZ's \n\t.,!9\u00e9\u0301\u00a0\u3000\x1c\x00<|>\u03a3\u0663\U0001f600\u5b57")), max_size=30), max_size=6))
def test_encoder_equals_library(texts):
    for path in (BYTE, WORD):
        own = tokens.Encoder.of(path)
        ids, counts = own.encode(texts)
        want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_encoder_starts_afresh():
    own = tokens.Encoder(BYTE, keep=3)
    for text in ("one two three four", "five six seven", "one two", ""):
        assert own.encode([text])[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


# 1. Nearest neighbours.


def vectors(spark, n=600, dim=16, copies=40):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[5 : 5 + copies] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, None), (n + 100, [0.0] * dim), (n + 1, [None, *[1.0] * (dim - 1)]), (n + 2, [float("nan"), *[1.0] * (dim - 1)]), (n + 3, [float("inf"), *[1.0] * (dim - 1)]), (n + 4, [1.0]), (n + 5, []), (None, [1.0] * dim)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize(("piece", "leaf"), [(1 << 14, 256), (64, 16)])
def test_neighbours(spark, monkeypatch, piece, leaf):
    for name, value in (("PIECE", piece), ("LEAF", leaf), ("MOST_SHARDS", 4), ("QUERIES", 40), ("ROWS_SENT", 50)):
        monkeypatch.setattr(ann, name, value)
    x, df = vectors(spark)
    found = {}
    for r in ann.search(df.withColumn("id", F.lit(0)), F.col("vec_id") % 10 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(found) == set(range(0, len(x), 10))
    hits = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        apart = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort([np.arange(len(x)), apart]) if i != q][:10]
        assert [r[1] for r in rows] == [apart[r[2]] for r in rows]
        assert rows == sorted(rows, key=lambda r: (r[1], r[2]))
        hits += len(set(want) & {r[2] for r in rows})
    assert hits / (10 * len(found)) >= 0.9


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 3.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 7, 0.0), (0, 2, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 7, 1.0)]
    two = df.union(spark.createDataFrame([(200, [0.0, 0.0, 1.0]), (8, [0.0, 0.0, 3.0]), (300, [5.0])], df.schema)).withColumns({n: F.lit(1) for n in ("v", "asked", "point", "shard")})
    rows = ann.search(two, F.col("vec_id") % 100 == 0).where("query_id >= 200").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(200, 1, 8, 2.0)]  # each length among its own
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df, F.lit(False)).count() == 0


def test_pieces_close_leaves_where_vectors_cluster():
    """With clusters far apart a query opens few leaves; the share verified stays small and nothing near is lost."""
    rng = np.random.default_rng(8)
    centres = 20 * rng.standard_normal((40, 64))
    x = centres[rng.integers(0, 40, 8000)] + rng.standard_normal((8000, 64))
    axes, limit = rng.standard_normal((64, ann.DIMS)), ann.chi_square_quantile(ann.CONFIDENCE, ann.DIMS)
    piece, hits, verified = ann.Piece(x, x @ axes, [[i] for i in range(len(x))]), 0, 0
    for q in range(0, 8000, 200):
        apart = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = np.argsort(apart)[:11]
        best, done = piece.nearest(x[q], x[q] @ axes, 11, apart[want].max() * 1.2, limit)
        hits, verified = hits + len({i for _, i in best} & set(want.tolist())), verified + done
    assert hits >= 0.95 * 11 * 40 and verified <= 0.05 * 40 * len(x)


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.50731, abs=1e-4)


# 2. Mixing.


def check_mix(rows, weights=mixing.WEIGHTS, most=3):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, sum(sizes.values()), set(order)
    while free:
        share = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= most * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    return target


@pytest.mark.parametrize("block", [1024, 7])
def test_mix(docs, block):
    found = mixing.mix(docs, block=block)
    rows = found.documents.collect()
    assert len(rows) == docs.count()
    sizes = {(r["doc_id"], r["text"]): len(re.findall(SPACE, r["text"] or "")) for r in docs.collect()}
    assert Counter(r["size"] for r in rows) == Counter(sizes[(r["doc_id"], r["text"])] for r in docs.collect())
    check_mix(rows)
    again = mixing.mix(docs.repartition(3), block=block).documents
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again.collect()))
    slots = [r["slot"] for r in found.takes.collect()]
    assert len(set(slots)) <= max(slots) + 1


def test_mix_schedule_is_even(spark):
    plan = spark.createDataFrame([(0, 1000), (1, 3000), (2, 6000)], "ordinal long, slots long")
    rows = mixing.schedule(plan).orderBy("slot").collect()
    assert Counter(r["ordinal"] for r in rows) == {0: 1000, 1: 3000, 2: 6000}
    for o, n in ((0, 1000), (1, 3000), (2, 6000)):
        assert sorted(r["rank"] for r in rows if r["ordinal"] == o) == list(range(n))
    early = Counter(r["ordinal"] for r in rows[:500])
    assert abs(early[2] - 300) < 10 and abs(early[1] - 150) < 10


def test_mix_as_documents(cluttered, empty):
    out = mixing.apply(cluttered, block=7)
    assert out.columns == cluttered.columns
    counts = Counter()
    for r in out.collect():
        counts[(r["doc_id"], r["source"])] += len(re.findall(SPACE, r["text"]))
        assert r["n_chars"] == len(r["text"])
    want = Counter()
    for r in mixing.mix(cluttered, block=7).documents.collect():
        want[(r["doc_id"], r["source"])] += r["taken"]
    assert +counts == +want
    assert mixing.apply(empty).count() == 0 and mixing.mix(empty).documents.count() == 0
    blank = empty.sparkSession.createDataFrame([(1, None, None, "a", None), (2, " ", None, None, 1)], DOCS)
    assert [r["taken"] for r in mixing.mix(blank).documents.collect()] == [0, 0]


# 3. WARC.


def test_warc(spark):
    rows = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, None, None), (9, "http://a/9\r\nEvil: 1", ""), (4, "u", "\u00e9" * 50_000), (5, "u", "x\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "sha": F.lit(2), "refers_to": F.lit(3)})
    index = warc.write(pages)
    got = {r["page_id"]: r for r in warc.read(index).collect()}
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[(html or "").encode()] = max(i, last.get((html or "").encode(), i))
    for i, _, html in rows:
        data, r = (html or "").encode(), got[i]
        first = i is None or last[data] == i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", last[data]))
    assert {r["record_type"] for r in warc.read(warc.write(pages, least=10)).where("payload_bytes < 10").collect()} == {"response"}
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    named = spark.createDataFrame([("None", "u", "x"), (None, "u", "y")], "page_id string, url string, html string")
    assert {(r["page_id"], r["payload_bytes"]) for r in warc.read(warc.write(named)).collect()} == {("None", 1), (None, 1)}


def test_bundle_seeks_and_rolls(spark, monkeypatch):
    import zstandard

    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2500)
    monkeypatch.setattr(warc, "FRAME_BYTES", 1500)
    pages = spark.range(30).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.repeat(F.lit("ab"), F.col("id").cast("int")).alias("html")).coalesce(1)
    index = warc.write(pages).orderBy("page_id").collect()
    assert len({r["bundle"] for r in index}) > 1
    r = index[11]
    assert len({(x["bundle"], x["frame"]) for x in index}) < 30 and any(x["offset"] > 0 for x in index)  # several records a frame
    with warc.BundleReader(r["bundle"]) as bundle:
        own, http, payload = warc.parse(bundle.frame(r["frame"])[r["offset"] : r["offset"] + r["length"]])
        assert own["WARC-Record-ID"] == "<urn:page:11>" and payload == b"ab" * 11 and http["Content-Length"] == "22"
        whole = zstandard.ZstdDecompressor().stream_reader(bundle.file.read_at(bundle.file.size(), 0), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == sum(x["bundle"] == r["bundle"] for x in index)


# 4. Quality rules.


def brute_rules(text):
    w = re.findall(SPACE, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    chars = sum(map(len, w))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    dup = len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    upper = sum(c.isupper() for c in text or "")
    kept = not failed and 2 * len(w) <= chars <= 15 * len(w) and symbols <= 0.3 * len(w) and dup <= 0.5 * len(lines) and upper <= 0.5 * chars
    return len(w), chars, symbols, dup, len(covered), failed, kept


def test_quality_rules(cluttered, empty):
    extra = [(900, "X Y Z " * 30 + sentence(random.Random(4), 300), None, None, 1), (901, sentence(random.Random(5), 80).upper() + "!!", None, None, 1), (902, "a b c d " + sentence(random.Random(6), 60) + " a b c d", None, None, 1), (903, "$$ " * 60 + sentence(random.Random(7), 90), None, None, 1)]
    spark = empty.sparkSession
    everything = cluttered.select(*empty.columns).union(spark.createDataFrame(extra, DOCS))
    cascade = quality_rules.Cascade.fit(everything)
    got = Counter(tuple(r) for r in quality_rules.digest(everything, cascade).collect())
    assert got == Counter((r["doc_id"], *brute_rules(r["text"])) for r in everything.collect())
    kept = cascade.apply(cluttered)
    assert kept.columns == cluttered.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in cluttered.collect() if brute_rules(r["text"])[-1])
    named = everything.select(cascade.rejected_by(F.col("text")).alias("by"), cascade.verdict(F.col("text")).alias("v"))
    assert all((r["by"] is None) == r["v"] for r in named.collect())
    none = quality_rules.Cascade.fit(empty)
    assert quality_rules.digest(empty, none).count() == 0 and none.apply(empty).count() == 0


def test_cascade_order(spark):
    rules = [quality_rules.Rule("never", lambda t: F.lit(True)), quality_rules.Rule("always", lambda t: F.lit(False))]
    df = spark.createDataFrame([("a",)] * 50, "text string")
    assert [m.rule.name for m in quality_rules.Cascade.fit(df, rules).measured] == ["always", "never"]
    m = [quality_rules.Measured(rules[0], 1.0, 0.5), quality_rules.Measured(rules[1], 0.1, 0.2)]
    assert [x.rule.name for x in quality_rules.Cascade(m).measured] == ["always", "never"]


# 5. URL filter.


def test_url_rules(spark):
    urls = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "http://WWW.Example.com/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://m.example.com/en/1": ("m.example.com", "/en/1", "example.com/en/", "block"),
        "https://b.net/es/": ("b.net", "/es/", "net/es/", "block"),
        "https://b.net/es": ("b.net", "/es", None, "allow"),
        "http://a.com": ("a.com", "", None, "allow"),
        "http://notcom/x": ("notcom", "/x", None, "allow"),
        "x://a://b/c": ("a:", "//b/c", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string").withColumns({"host": F.lit("?"), "n": F.lit(1), "shape": F.lit("s")})
    out = url_filter.judge(pages)
    assert out.count() == 2 * len(urls)
    for r in out.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["url"]]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_tree_alone_decides(spark):
    """Open pages join branches that look alike where the labels agree; elsewhere nothing is rejected."""
    rules = [("block", f"bad.org/go/{v}/ad/") for v in "abcd"] + [("block", "two.org/es/"), ("block", "two.org/fr/"), ("block", "mixed.org/es/"), ("allow", "mixed.org/fr/"), ("block", "few.org/x/1"), ("block", "shape.org/es/")]
    urls = [f"http://bad.org/go/{v}/ad/{n}" for v in "abcd" for n in range(50)]
    urls += [f"http://{h}.org/{v}/{n}" for h in ("two", "mixed") for v in ("es", "fr") for n in range(50)] + ["http://few.org/x/1"]
    urls += [f"http://shape.org/es/{n}" for n in range(90)] + [f"http://shape.org/about/team/{v}" for v in "abcdefghijklmnopqrst"]
    asked = {"http://bad.org/go/new/ad/7": "block", "http://two.org/en/1": "block", "http://mixed.org/en/1": "allow", "http://shape.org/about/team/z": "allow", "http://few.org/x/2": "allow", "http://other.org/1": "allow", "": "allow"}
    out = url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *asked])], "page_id long, url string"), rules)
    assert {r["url"]: r["verdict"] for r in out.collect() if r["url"] in asked} == asked


def brute_verdicts(urls, rules, most_children=32, z=2.0, alpha=0.05, purity=0.9, weight=3.0):
    """The tree in plain loops over single pages."""
    pages = []
    for url in urls:
        host, path = (re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()) if "://" in url else ("", "")
        fits = [(len(r), k) for k, r in rules if (host == (o := r.partition("/")[0]) or host.endswith("." + o)) and path.startswith(r[len(o) :])]
        pages.append({"host": host, "ruled": max(fits)[1] if fits else None, "seg": re.sub("[0-9]+", "#", re.sub("^/", "", path)).split("/"), "template": ""})
    count = lambda rows: (len(rows), sum(p["ruled"] is not None for p in rows), sum(p["ruled"] == "block" for p in rows))
    for level in range(max(len(p["seg"]) for p in pages)):
        names = {}
        live = [p for p in pages if len(p["seg"]) > level]
        for node in {(p["host"], p["template"]) for p in live}:
            here = [p for p in live if (p["host"], p["template"]) == node]
            following = lambda rows: Counter((p["seg"] + ["/"])[level + 1] for p in rows)
            n, l, b = count(here)
            for at in (kids := {p["seg"][level] for p in here}):
                own = [p for p in here if p["seg"][level] == at]
                m, lab, blk = count(own)
                common = sum(min(c / m, following(here)[k] / n) for k, c in following(own).items())
                looks = len(kids) > 1 and 1 - common <= np.sqrt((len(following(here)) * np.log(2) + np.log(1 / alpha)) / (2 * m))
                agrees = lab == 0 or abs(blk / lab - b / l) <= z * np.sqrt(b / l * (1 - b / l) / lab)
                names[(*node, at)] = "*" if len(kids) > most_children or (looks and agrees) else at
        for p in live:
            p["template"] += "/" + names[p["host"], p["template"], p["seg"][level]]
    out = []
    for p in pages:
        _, hl, hb = count([q for q in pages if q["host"] == p["host"]])
        _, tl, tb = count([q for q in pages if q["host"] == p["host"] and q["template"] == p["template"]])
        prior = (hb + weight / 2) / (hl + weight)
        out.append(p["ruled"] or ("block" if tl and (tb + weight * prior) / (tl + weight) >= purity else "allow"))
    return out


def test_url_tree_equals_brute_force(spark):
    rnd = random.Random(6)
    rules = [("block", "a.net/es/"), ("block", "a.net/fr/"), ("allow", "b.net/es/"), ("block", "b.net/"), ("block", "c.net/x/")]
    hosts, words = ["a.net", "m.a.net", "b.net", "c.net", "d.net"], ["es", "fr", "en", "x"]
    urls = []
    for _ in range(500):
        parts = [rnd.choice(words), rnd.choice(["7", "8.html", "w", "page9"]), *rnd.sample(["", "deep", "1"], rnd.randrange(3))]
        urls.append(f"http://{rnd.choice(hosts)}/" + "/".join(parts[: rnd.randint(1, 4)]))
    urls += [f"http://c.net/x/{w}{n}" for n, w in enumerate(rnd.choices("pqrs", k=60))] + [f"http://c.net/{chr(97 + n % 26)}{chr(97 + n // 26)}/1" for n in range(60)]
    out = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    got = {r["page_id"]: r["verdict"] for r in out.collect()}
    want = brute_verdicts(urls, rules)
    assert [got[i] for i in range(len(urls))] == want
    assert "block" in {v for u, v in zip(urls, want, strict=True) if "//a.net/en" in u} and {v for u, v in zip(urls, want, strict=True) if "d.net" in u} == {"allow"}


def test_url_tree_on_unseen_labels(spark):
    """Pages whose labels the tree has not seen: what it blocks, the rules block."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    ruled = url_filter.judge(pages).where("rule IS NOT NULL").select("page_id", F.col("verdict").alias("true"))
    held = url_filter.judge(pages, labelled=F.col("page_id") % 5 != 0).where("page_id % 5 = 0").join(ruled, "page_id")
    found = Counter((r["verdict"], r["true"]) for r in held.collect())
    assert found["block", "block"] > found["allow", "block"] and found["block", "allow"] <= 0.05 * found["block", "block"]


def test_url_tree_decides_on_few_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    open_pages = {r["verdict"]: r["count"] for r in url_filter.judge(pages).where("rule IS NULL").groupBy("verdict").count().collect()}
    assert 0 < open_pages["block"] < open_pages["allow"]


def test_url_columns_with_clashing_names(spark):
    names = ("seen", "ruled", "shape", "asked", "bad", "n", "template", "_host", "_bad")
    pages = spark.createDataFrame([(1, "http://x.net/es/1"), (2, None), (3, "http://x.org/" + "a/" * 3000)], "page_id long, url string").withColumns({n: F.lit(n) for n in names})
    out = url_filter.judge(pages.withColumn("page", F.lit("p")))
    assert {r["page_id"]: r["verdict"] for r in out.collect()} == {1: "block", 2: "allow", 3: "allow"}
    assert all([r[n] for n in (*names, "page")] == [*names, "p"] for r in out.collect())


def test_url_templates(spark):
    """A template of blocked pages takes an unruled page with it; clean hosts and branches stay."""
    rules = (("block", "bad.org/x/ads/1"), ("block", "bad.org/x/ads/2"), ("block", "bad.org/y/ads/"), ("allow", "bad.org/news/"), ("allow", "good.org/x/"))
    urls = [f"http://bad.org/x/ads/{n}" for n in range(100, 300)] + ["http://bad.org/x/ads/7"]
    urls += [f"http://bad.org/news/{n}" for n in range(50)] + ["http://bad.org/other/7"] + [f"http://good.org/x/{n}" for n in range(50)] + ["http://good.org/z/1"]
    out = url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules)
    verdict = {r["url"]: r["verdict"] for r in out.collect()}
    assert verdict["http://bad.org/x/ads/7"] == "block"
    assert {verdict[u] for u in ("http://bad.org/other/7", "http://good.org/z/1", "http://bad.org/news/3")} == {"allow"}


# 6. Quality classifier.


def test_quality_classifier(spark, cluttered, empty):
    rnd = random.Random(8)
    rows, rated = [], []
    for i in range(300):
        grade = i % 3
        text = sentence(rnd, 60) + {0: " awful ### awful", 1: " plain", 2: " fine lovely"}[grade]
        rows.append((i, text, None, None, 1))
        rated.append((i, grade))
    docs = spark.createDataFrame(rows, DOCS)
    model = quality_classifier.train(docs.where("doc_id % 5 <> 0"), spark.createDataFrame([*rated, (5000, None), (None, 1), (1, 9)], "doc_id long, grade int"), 3)
    assert (np.diff(model.thresholds) > 0).all()
    held = quality_classifier.select(docs.where("doc_id % 5 = 0"), model).collect()
    assert np.mean([r["kept"] == (r["doc_id"] % 3 == 2) for r in held]) > 0.9
    mean = [np.mean([r["expected_grade"] for r in held if r["doc_id"] % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    out = quality_classifier.select(cluttered, model)
    assert out.count() == cluttered.count() and all(0 <= r["top_probability"] <= 1 for r in out.collect())
    untaught = quality_classifier.train(empty, spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert {round(r["expected_grade"], 6) for r in quality_classifier.select(docs.limit(3), untaught).collect()} == {1.0}
    assert quality_classifier.select(empty, model).count() == 0


# 7. SimHash.


def brute_fingerprint(text):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def brute_components(fps, budget=3):
    label = list(range(len(fps)))
    near = [[j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= budget] for i in range(len(fps))]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_simhash(cluttered, empty):
    rows = [r for r in cluttered.collect() if r["doc_id"] is not None]
    got = simhash.components(cluttered).withColumn("hex", simhash.hex_fingerprint()).collect()
    assert len(got) == cluttered.count()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    ids = sorted(fps)
    label = brute_components([fps[i] for i in ids])
    want = {i: ids[label[k]] for k, i in enumerate(ids)}
    for r in got:
        if r["doc_id"] is not None:
            assert r["hex"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]
    kept = simhash.deduplicate(cluttered)
    assert kept.columns and {r["doc_id"] for r in kept.collect()} == {i for i in ids if want[i] == i} | {None}
    assert simhash.components(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


@pytest.mark.parametrize("leaf", [1, 32])
def test_trie_equals_all_pairs(spark, monkeypatch, leaf):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 60, dtype=np.uint64)
    near = [int(v) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for v in base for _ in range(6)]
    values = np.unique(np.array([*map(int, base), *near, 0, 2**64 - 1], np.uint64))
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    want = brute_components([int(v) for v in values])
    assert simhash.trie_classes(values, 0, 0, 0, 3).tolist() == want
    monkeypatch.undo()
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    label = {r["node"]: r["label"] for r in simhash.connected(simhash.links(df)).collect()}
    mine = [label.get(int(v), int(v)) for v in values.view(np.int64)]
    assert len({(a, b) for a, b in zip(mine, want, strict=True)}) == len(set(want)) == len(set(mine))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(300)]
    label = {r["node"]: r["label"] for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {label[i] for i in range(61)} == {0} and {label[200 + i] for i in range(300)} == {100}
    assert simhash.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def changed(rnd: random.Random, text: str, n: int) -> str:
    """The text with ``n`` words replaced."""
    words = text.split()
    for k in rnd.sample(range(len(words)), n):
        words[k] = f"new{rnd.random()}"
    return " ".join(words)


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_similar_texts(spark, empty):
    """Copies and near copies leave one document each; what shares less stays, as does what has no id."""
    rnd = random.Random(12)
    texts, group = [], []
    for g in range(60):
        base = sentence(rnd, 300, 50_000)
        family = [base, base, base.upper(), *(changed(rnd, base, 1 + k % 4) for k in range(4))]
        texts += family
        group += [g] * len(family)
        if g % 2:  # about half of the shingles in common
            texts.append(changed(rnd, base, 20))
            group.append(1000 + g)
    texts += [sentence(rnd, n, 50_000) for n in range(1, 40)] + [None, "", " "]
    group += [*range(2000, 2039), 3000, 3000, 3000]
    rows = [(i, t, None, None, 1) for i, t in enumerate(texts)] + [(None, texts[0], None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(7) for n in ("fp", "sketch", "node", "first", "label", "a", "b", "value", "component_id")})
    kept = simhash_similar.deduplicate(docs)
    assert set(kept.columns) == set(docs.columns)
    ids = [r["doc_id"] for r in kept.collect()]
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    kept_ids = {i for i in ids if i is not None}
    assert len(ids) == len(kept_ids) + 1 and kept_ids >= set(first.values())
    assert len(kept_ids - set(first.values())) <= 0.02 * (len(texts) - len(first))  # the bands' recall
    assert simhash_similar.deduplicate(empty).count() == 0


def classes_of(n, pairs):
    """Smallest member of the component of each of ``n`` nodes."""
    label = list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in pairs:
        i, j = top(i), top(j)
        label[max(i, j)] = min(i, j)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("limit", [4_000_000, 3000])
def test_links_of_clusters_are_exact(spark, limit):
    """Whole clusters, and one cut into blocks, link what brute force links, and nothing else."""
    rnd = random.Random(13)
    base = [sentence(rnd, 120, 5000) for _ in range(12)]
    texts = base + [changed(rnd, b, n) for b in base for n in (1, 2, 3, 4, 5, 6, 6, 7)] + [changed(rnd, base[0], 1 + k % 7) for k in range(150)]
    sets = [shingles(t) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = {(i, j) for j in range(len(texts)) for i in range(j) if alike(i, j)}
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    same = simhash_similar.sketches(docs, "node").select("node", "same")
    held = docs.join(same, "node").withColumn("cluster", F.when(F.col("node") == 5, 1).otherwise(0).cast("long"))
    sets_of = scratch.materialize(simhash_similar.shingle_sets(held), "sets")
    assert sets_of.count() == len(texts)
    found = {tuple(sorted((r["a"], r["b"]))) for r in simhash_similar.cluster_pairs(sets_of, shingles=limit, shared=8).collect()}
    assert found <= want and len(found) <= 12 * len(texts)
    assert classes_of(len(texts), found) == classes_of(len(texts), {p for p in want if 5 not in p})


def test_near_copies_make_rows_in_proportion(spark):
    """Walks and comparisons return forests: no more rows than texts, band by band, however many lie near each other."""
    rnd = random.Random(16)
    base = sentence(rnd, 300, 50_000)
    made = {}
    for n in (300, 1200):
        texts = [base, *(changed(rnd, base, k % 12) for k in range(n))]
        docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
        nodes = scratch.materialize(simhash_similar.sketches(docs, "node"), "nodes").dropDuplicates(["same"])
        made[n] = simhash_similar.near(nodes).count()
        sets = [shingles(t) for t in texts]
        want = classes_of(len(texts), [(0, j) for j, t in enumerate(sets) if len(t & sets[0]) >= 0.8 * len(t | sets[0])])
        kept = simhash_similar.deduplicate(docs.withColumnRenamed("node", "doc_id")).count()
        assert abs(kept - len(set(want))) <= 0.02 * n
    assert made[1200] <= 5 * made[300]


def start_of_sketch(texts):
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    return simhash.majority(np.array([h for s in sets for h in s], np.uint64), np.array([len(s) for s in sets]))


def test_majority_counts_bits():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 255, 256, 0, 1000, 3])
    hashes = rng.integers(0, 1 << 64, counts.sum(), np.uint64)
    want, at = [], 0
    for n in counts:
        own = [int(h) for h in hashes[at : at + n]]
        want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n))
        at += n
    assert simhash.majority(hashes, counts).tolist() == want


@pytest.mark.parametrize("near", [None, lambda i, j: (i + j) % 3 > 0])
def test_walk_of_large_ranges(near):
    """Ranges compared only across classes give the classes of all pairs."""
    rng = np.random.default_rng(4)
    values = np.sort((rng.integers(0, 4, 900).astype(np.uint64) << np.uint64(62)) | rng.integers(0, 3, 900).astype(np.uint64))
    got = simhash.trie_classes(values, 0, 0, 0, 1, 62, near)
    pairs = [(i, j) for j in range(900) for i in range(j) if int(values[i] ^ values[j]).bit_count() <= 1 and (near is None or near(i, j))]
    assert got.tolist() == classes_of(900, pairs)


def test_similar_keeps_what_only_looks_near(spark):
    """Texts below the similarity stay though the first 64 bits of their sketches are within 3."""
    rnd = random.Random(14)
    base = sentence(rnd, 300, 50_000)
    texts = [base, *(changed(rnd, base, 9) for _ in range(4000))]
    apart = np.bitwise_count(start_of_sketch(texts) ^ start_of_sketch([base]))
    texts = [t for t, d in zip(texts, apart, strict=True) if d <= 3]
    sets = [shingles(t) for t in texts]
    assert len(texts) > 3 and all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], DOCS)
    assert simhash_similar.deduplicate(docs).count() == len(texts)


def test_similar_chains(spark):
    """What is similar to any member of a group goes with it, not only what is similar to its first."""
    rnd = random.Random(15)
    texts, group = [], []
    for g in range(20):
        a = sentence(rnd, 300, 50_000)
        others = [changed(rnd, a, 4) for _ in range(300)]
        b = others[int(np.argmin(np.bitwise_count(start_of_sketch(others) ^ start_of_sketch([a]))))]
        alike = lambda s, t, least: len(shingles(s) & shingles(t)) >= least * len(shingles(s) | shingles(t))
        x = next(t for t in (changed(rnd, b, 4) for _ in range(1000)) if alike(t, b, 0.85) and not alike(t, a, 0.8))
        texts += [a, b, x]
        group += [g] * 3
    long_chain = [sentence(rnd, 300, 50_000)]
    for _ in range(60):
        long_chain.append(changed(rnd, long_chain[-1], 3))
    hub = sentence(rnd, 300, 50_000)
    texts += long_chain + [hub, *(changed(rnd, hub, 3) for _ in range(60))]
    group += [20] * 61 + [21] * 61
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], DOCS)
    kept, first = {r["doc_id"] for r in simhash_similar.deduplicate(docs).collect()}, {group.index(g) for g in range(22)}
    assert kept >= first and len(kept - first) <= 0.02 * (len(texts) - len(first))  # the bands' recall


def test_band_plan_grows_slowly():
    assert simhash_similar.share_apart(1.0) == 0 and 0.15 < simhash_similar.share_apart(0.8) < 0.16
    few, many = simhash_similar.band_plan(1000, 0.8, 0.9), simhash_similar.band_plan(10**9, 0.8, 0.9)
    assert few.shape[1] == 16 and many.shape[1] == 32 and len(few) < len(many) < 150
    assert all(len(set(b)) == len(b) for b in many.tolist())


# 8. Packing.


def test_packing(cluttered, empty):
    own = tokens.Encoder.of(BYTE)
    for capacity in (2048, 50):
        rows = packing.pack(packing.pieces(cluttered, BYTE, 0, capacity, with_ids=True), capacity).collect()
        of = {}
        for r in cluttered.collect():
            of.setdefault(r["doc_id"], set()).add((*own.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0))
        total = 0
        for r in rows:
            (ids,) = of[r["doc_id"]]
            part = ids[r["start"] : r["start"] + r["length"]]
            assert list(part) == r["ids"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
            n = -(-len(ids) // capacity)
            assert 0 <= r["piece"] < n and (r["piece"] == 0 or r["length"] == capacity)
            total += r["length"]
        assert total == sum(len(next(iter(of[r["doc_id"]]))) for r in cluttered.collect())
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) <= total / capacity * 1.1 + 2
    built = packing.assemble(packing.pack(packing.pieces(cluttered, BYTE, 0, with_ids=True)))
    assert sum(len(r["ids"]) for r in built.collect()) == total
    assert packing.pack(packing.pieces(empty, BYTE, 0)).count() == 0


def test_fullest_is_optimal():
    rnd = random.Random(2)
    for _ in range(200):
        counts = Counter(rnd.randint(1, 30) for _ in range(rnd.randint(1, 8)))
        capacity = rnd.randint(0, 60)
        used = packing.fullest(dict(counts), capacity, sorted(counts, reverse=True))
        sums = {0}
        for n in counts.elements():
            sums |= {s + n for s in sums}
        assert all(used[n] <= counts[n] for n in used)
        assert sum(n * c for n, c in used.items()) == max(s for s in sums if s <= capacity)


def test_plan_uses_everything():
    rnd = random.Random(3)
    counts = Counter(min(2048, int(rnd.expovariate(1 / 300)) + 1) for _ in range(20_000))
    left = Counter()
    made = packing.plan(dict(counts))
    for times, used in made:
        assert sum(n * c for n, c in used.items()) <= 2048
        for n, c in used.items():
            left[n] += times * c
    assert left == counts
    assert sum(t for t, _ in made) == -(-sum(n * c for n, c in counts.items()) // 2048)


# 9. Language identification.


def test_language_id(spark, cluttered, empty):
    vocabulary = {"en": "the of and with that this there water", "de": "der die und nicht wasser schon über auch", "fr": "le les des être où eau déjà avec", "es": "el los las niño agua está mañana con"}
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices(words.split(), k=12)), lang, None, 1) for i, (lang, words) in enumerate([*vocabulary.items()] * 60)]
    docs = spark.createDataFrame([*rows, (9001, "123 ½ --- ٣", "en", None, 1), (9002, None, "en", None, 1), (9003, "", None, None, 1), (None, "the water", "en", None, 1)], DOCS)
    out = langid.digest(docs, langid.train(docs)).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert len(held) > 20 and np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in held]) > 0.95
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"] for r in out if r["lang_pred"] == "und"} == {9001, 9002, 9003}
    model = langid.train(docs)
    assert langid.keep_known(cluttered, model).columns == cluttered.columns
    assert langid.digest(empty, model).count() == 0
    untaught = langid.train(empty)
    assert {r["lang_pred"] for r in langid.digest(docs.limit(4), untaught).collect()} == {"und"}


def test_language_stage_rejects_by_score(spark, empty):
    """Letters in no known language go, documents in one stay; without labels nothing goes."""
    vocabulary = {"en": "the of and with that this there water", "de": "der die und nicht wasser schon über auch", "fr": "le les des être où eau déjà avec", "es": "el los las niño agua está mañana con"}
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choices(words.split(), k=12)), lang, None, 1) for i, (lang, words) in enumerate([*vocabulary.items()] * 60)]
    rows += [(1000 + i, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz   ", k=200)), None, None, 1) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r["doc_id"] for r in langid.keep_known(docs, langid.train(docs)).collect()}
    clean = {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(kept & clean) >= 0.95 * len(clean) and len([i for i in kept if i >= 1000]) <= 2
    assert langid.keep_known(docs, langid.train(empty)).count() == docs.count()


def test_language_id_ignores_other_columns(spark):
    docs = spark.createDataFrame([(i, "the water" if i % 2 else "die nacht", "en" if i % 2 else "de", "s", 1) for i in range(80)], DOCS)
    model = langid.train(docs)
    moved = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"), "n_chars")
    a = [r["lang_pred"] for r in langid.digest(docs, model).orderBy("doc_id").collect()]
    assert a == [r["lang_pred"] for r in langid.digest(moved, model).orderBy("doc_id").collect()]


# 10. Token files.


def test_token_files(cluttered, empty, monkeypatch):
    own = tokens.Encoder.of(WORD)
    rows = cluttered.collect()
    want = {}
    for r in rows:
        want.setdefault(r["doc_id"], []).append([*own.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    got = token_store.read(token_store.write(cluttered, WORD, 2)).collect()
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        ids = want[r["doc_id"]].pop()
        assert r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i or 0))
    assert token_store.read(token_store.write(empty, WORD, 2)).count() == 0


@pytest.mark.parametrize("top", [200, 70_000, 2**32])
def test_random_access(tmp_path, top):
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(5000) < 0.5, rng.integers(0, 250, 5000), rng.integers(0, top, 5000)).astype(np.uint32)
    cuts = np.unique(np.concatenate([[0, 5000], rng.integers(0, 5000, 40)]))
    for whole in (False, True):
        with token_store.TokenFile(token_store.write_file(str(tmp_path), ids, cuts), whole) as f:
            assert f.n_tokens == 5000 and f.firsts.tolist() == cuts.tolist()
            for i in (0, 1, 511, 512, 513, 4999, *rng.integers(0, 5000, 100).tolist()):
                assert f.token(i) == ids[i]
            for a, b in ((0, 5000), (0, 0), (5000, 5000), (511, 513), (4998, 5000), (1000, 1001)):
                assert f.slice(a, b).tolist() == ids[a:b].tolist()
    with token_store.TokenFile(token_store.write_file(str(tmp_path), ids[:0], np.array([0]))) as f:
        assert f.n_tokens == 0 and not len(f.slice(0, 0))
