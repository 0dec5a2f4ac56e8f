"""The manifest and the exact searches, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import lexical, merkle, queries, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = str.maketrans(merkle.UPPER, merkle.LOWER)


# Manifest.


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def brute_manifest(rows, fan=16):
    """A row of the audit for each of (doc_id, text, lang, source, n_chars)."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
        return levels

    def proof(levels, i):
        for level in levels[:-1]:
            first = i // fan * fan
            yield "".join(level[first:i]), "".join(level[i + 1 : first + fan])
            i //= fan

    fields = lambda r, text: (r[0], r[3], r[2], r[4], text)
    groups = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {g: sorted(((r, leaf_of(fields(r, r[1]))) for r in rows if r[3] == g), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for g in groups}
    trees = {g: tree([leaf for _, leaf in m]) for g, m in members.items()}
    top = tree([trees[g][-1][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        for i, (r, leaf) in enumerate(members[g]):
            steps = [*proof(trees[g], i), *proof(top, k)]
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf_of(fields(r, r[1] and r[1].translate(SMALL)))
            for left, right in steps:
                node = h(left, node, right)
            root = top[-1][0]
            out.append((r[0], leaf, trees[g][-1][0], root, h(*[a + b for a, b in steps]), node, node == root))
    return Counter(out)


def manifest_rows(n, seed=1):
    rnd = random.Random(seed)
    sources = ["hot"] * 6 + ["é", "", None] + [f"s{i}" for i in range(20)]
    return [(i if i % 50 else None, rnd.choice([None, "", f"Abc é{i}", "low", "ÀB\n"]), rnd.choice([None, "en"]), rnd.choice(sources), rnd.choice([None, 3])) for i in range(n)]


@pytest.mark.parametrize("rows", [[], [(1, "A", None, None, None)], manifest_rows(17) * 2, [*manifest_rows(600), (7, "X" * 300_000, "en", "hot", 1)]], ids=["none", "one", "repeats", "many"])
def test_audit(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("group", "node", "row", "leaf", "steps", "pos", "n", "rank")})
    assert Counter(tuple(r) for r in merkle.audit(docs).collect()) == (brute_manifest(rows) if rows else Counter())


@pytest.mark.parametrize("fan,levels", [(2, 2), (3, 1), (2, 3)])
def test_manifest_in_several_rounds(spark, fan, levels):
    rows = manifest_rows(300)
    leaves = spark.createDataFrame(rows, DOCS).select("doc_id", "source", merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"))
    proved = merkle.prove(leaves, "leaf", "source", "doc_id", fan, levels)
    assert proved.where(merkle.fold(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0
    got = proved.select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")))
    assert Counter(tuple(r) for r in got.collect()) == Counter([x[:5] for x in brute_manifest(rows, fan).elements()])


# Top k.


def brute_top(rows, k=10):
    whole = {(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = Counter()
    for q, own in (x for x in whole if x[0] % 5 == 0):
        scored = [(-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in whole if i != q and len(v) == len(own)]
        out.update((q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1))
    return out


def top_rows():
    rnd = random.Random(3)
    vec = lambda n=9: [rnd.uniform(-1, 1) for _ in range(n)]
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec()) for i in range(200)]
    rows += [(300, None), (305, [0.0] * 9), (310, [float("nan")] * 9), (315, [None] * 9), (316, [float("inf")] * 9), (320, vec(5)), (321, vec(5)), (325, []), (326, []), (None, hot)]
    return [*rows, (330, [2.0**18] * 9), (331, [2.0**18, -(2.0**18)] * 4 + [0.0]), (5, hot), (3, hot), rows[1], rows[1]]


@pytest.mark.parametrize("lists,shard", [(2, 1 << 14), (4, 16), (1, 50), (12, 100)])
def test_top_k(spark, lists, shard):
    vectors = spark.createDataFrame(top_rows(), "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("query", "score", "point", "v", "id", "list", "length")})
    got = topk.search(vectors, F.col("vec_id") % 5 == 0, lists=lists, shard_size=shard)
    assert Counter(tuple(r) for r in got.collect()) == brute_top(top_rows())


def test_top_k_of_few(spark):
    vectors = spark.createDataFrame(top_rows()[:4], "vec_id long, embedding array<float>")
    assert topk.search(vectors, F.lit(True)).count() == 12
    assert topk.search(vectors, F.lit(False)).count() == topk.search(vectors.limit(0), F.lit(True)).count() == 0


def test_products_beyond_doubles():
    q, v = np.array([[2**40, 1], [-(2**31), 3]]), np.array([[2**19, 1], [2**20, -5]])
    assert topk.product(q, v).tolist() == [[2**59 + 1, 2**60 - 5], [-(2**50) + 3, -(2**51) - 15]]


# Ranked search.


def words(text):
    return [w.translate(SMALL) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_ranked(docs, items, k=10):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n_docs, n_terms, df = len(bags), sum(n for *_, n in bags), Counter(t for _, c, _ in bags for t in c)
    out = Counter()
    for item, text in {x for x in items if x[0] is not None}:
        asked, scored = set(words(text)), []
        for i, c, n in bags:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out.update((item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1))
    return out


def corpus():
    rnd = random.Random(2)
    voc = [f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(3000)] + ["Äé", "ä", "İx", "Ω", "ΩΣ", "_a-b", "A1"]
    text = lambda *n: " ".join(rnd.choice(voc) for _ in range(rnd.choice(n)))
    docs = [(i % 390 if i % 17 else None, text(0, 1, 3, 30, 200)) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "--- !"), (503, "W1 w1\x00w1"), (504, "w1 " * 5000), (504, "w1 " * 5000), (505, "w1 w2"), (506, "w1 w2"), (506, "w1 w2"), (2**60 + 1, "w1 w2")]
    items = [(i, text(0, 1, 5, 40)) for i in range(30)]
    return docs, [*items, (None, "w1"), (40, None), (41, "zzz"), (1, "w5 w9"), (1, "w5 w9"), (42, " ".join(voc))]


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 20), (300, 200), (5000, 5000)])
def test_ranked_search(spark, shard, block):
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("term", "ids", "counts", "shard", "id", "score")}).repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string").withColumns({c: F.lit("x") for c in ("item", "rank", "at", "asked")})
    got = lexical.search(lexical.index(table, shard_terms=shard), asked, block_terms=block)
    assert Counter(tuple(r) for r in got.collect()) == brute_ranked(docs, items)


def test_ranked_search_of_nothing(spark):
    docs, items = corpus()
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert lexical.search(lexical.index(table.limit(0)), asked).count() == lexical.search(lexical.index(table), asked.limit(0)).count() == 0


def test_borders_cost_least():
    rnd = random.Random(2)
    lists = [np.array([rnd.choice([1, 5, 9, 100, rnd.randrange(1000)]) for _ in range(rnd.choice([1, 2, 7, 50, 200]))]) for _ in range(30)]
    for own, ends in zip(lists, lexical.borders(lists, 8, 20), strict=True):
        own = own.tolist()
        error = lambda a, b, x=own: max(x[a:b]) * (b - a) - sum(x[a:b])
        even = range(0, len(own), 8)
        price = sum(error(a, a + 8 if a + 8 < len(own) else len(own)) for a in even) // len(even) + 1
        least = [0]
        for e in range(1, len(own) + 1):
            least.append(min(least[a] + error(a, e) + price for a in range(max(0, e - 20), e)))
        assert ends[-1] == len(own) and sum(error(a, b) + price for a, b in zip([0, *ends[:-1]], ends, strict=True)) == least[-1]


def test_blocks_are_skipped():
    """Documents whose blocks cannot reach the threshold are not scored, and what is found is the same."""
    rnd = np.random.default_rng(1)
    n = 4000
    norms = np.where(np.arange(n) // 100 == 7, 10, 2000)  # a stretch of short documents
    lists = {f"t{i}": (p := np.flatnonzero(rnd.random(n) < 0.3), rnd.integers(1, 3, len(p))) for i in range(5)}
    shard = lexical.Shard(np.arange(n), norms, lists, dict.fromkeys(lists, 1000))
    found, scored = shard.best(list(lists), 10)
    whole = np.zeros(n, np.int64)
    for p, c in lists.values():
        whole[p] += 1000 * (10**9 * c // (1000 * c + 8 * norms[p]))
    assert found == [(int(whole[i]), int(i)) for i in np.lexsort((np.arange(n), -whole))[:10]]
    assert scored < n / 4


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exact_top_k", "op13_ranked_search"])
def test_query_equals_sql(spark, name):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())
