"""The pipeline's stages on a planted corpus against brute force, and the queries by name."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from grainmill import scratch
from grainmill.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOICES = {"en": "the of and to in is with that for on this be by as are", "fr": "le la de et les des en un que qui dans pour par sur", "de": "und der die das ist nicht ein mit von zu den auf"}


def voice(rnd: random.Random, lang: str, n: int) -> str:
    common = VOICES[lang].split()
    return " ".join(rnd.choice(common) if rnd.random() < 0.5 else "".join(rnd.choice(common) for _ in range(2)) + str(rnd.choice("abcdefgh")) for _ in range(n))


def rejected(text: str | None) -> bool:
    """The stage's rules in plain loops."""
    w = WORD.findall(text or "")
    if not w:
        return True
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    repeats = {k + d for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, w))
    upper = sum(c.isupper() for c in text)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return 100 * len(repeats) > 50 * len(w) or not 2 * len(w) <= chars <= 15 * len(w) or symbols > 0.3 * len(w) or len(lines) - len(set(lines)) > 0.5 * len(lines) or upper > 0.5 * chars


def shingles(text: str) -> frozenset:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(21)
    texts = []
    for lang in VOICES:
        for _ in range(40):
            texts.append((voice(rnd, lang, rnd.randint(20, 200)), lang))
    base = voice(rnd, "en", 300).split()
    for k in range(40):  # copies with up to eight words changed
        words = list(base)
        for place in rnd.sample(range(300), k % 9):
            words[place] = f"new{rnd.randrange(10**6)}"
        texts.append((" ".join(words), "en"))
    texts += [texts[3], texts[3], texts[50], ("Short and clean text here.", "en"), ("###$$$ %%% &&& |||", None), ("SHOUT THIS OUT!! " * 9, "en"), ("again and again\n" * 20, "en"), (None, "en"), ("", None), ("12 34 56 78 90 11", None)]
    rows = [(i, t, lang, ["a", "b", None][i % 3], len(t or "")) for i, (t, lang) in enumerate(texts)]
    folder = scratch.new_path(spark, "corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


@pytest.fixture(scope="module")
def staged(spark, corpus):
    docs, out = spark.read.parquet(f"{corpus[0]}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.materialize(stage(spark, docs, corpus[0]), name.replace(" ", "-"))
        out.append(docs)
    return out


def ids(df) -> set:
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_quality_stage(corpus, staged):
    assert ids(staged[0]) == {i for i, t, *_ in corpus[1] if not rejected(t)}
    assert staged[0].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage(corpus, staged):
    before, after = ids(staged[0]), ids(staged[1])
    texts = {i: t for i, t, *_ in corpus[1]}
    assert after <= before and not any(not re.search(r"[^\W\d_]", texts[i]) for i in after)
    assert len(after) >= len(before) - 2  # the digits, and a clean one at most


def test_dedup_stage(corpus, staged):
    texts = {i: shingles(t) for i, t, *_ in corpus[1]}
    before, label = sorted(ids(staged[1])), {}
    for i in before:
        label[i] = i
    for a in before:
        for b in before:
            if a < b and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert ids(staged[2]) == {i for i in before if label[i] == i} and len(before) > len(set(label.values())) + 10


def test_mixing_stage(staged):
    taken, size = Counter(), Counter()
    for r in staged[2].collect():
        size[r["source"]] += len(WORD.findall(r["text"]))
    for r in staged[3].collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    weights = dict(zip([*sorted(s for s in size if s), *([None] if None in size else [])], (1, 2, 3), strict=False))
    total, free, target = sum(size.values()), set(size), {}
    while True:
        scale = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if scale * weights[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    target |= {s: scale * weights[s] for s in free}
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)


def test_packing_stage(staged):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in staged[3].collect():
        want[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    got, held = Counter(), defaultdict(list)
    for r in staged[4].collect():
        got[r["doc_id"]] += r["length"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in held.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert ends[-1] <= 2048 and [at for at, _ in sorted(pieces)] == [0, *ends[:-1]]
    assert len(held) <= -(-sum(want.values()) // 2048) + 1


def test_run_is_its_stages(spark, corpus, staged):
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, corpus[0]).collect())) == sorted(map(key, staged[4].collect()))


# The queries by name, over whole tables.


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_op1_query(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table(spark, "embeddings") if r["embedding"] is not None}
    found, hits = defaultdict(list), 0
    for r in queries.op1_nearest_neighbours(spark, SF).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    names = np.array(sorted(rows))
    every = np.stack([rows[i] for i in names])
    for q, got in found.items():
        apart = np.sqrt(((every - rows[q]) ** 2).sum(1))
        want = [int(i) for i in names[np.lexsort([names, apart])] if i != q][:10]
        assert [n for n, _, _ in sorted(got)] == list(range(1, 11)) and all(abs(s - np.sqrt(((rows[i] - rows[q]) ** 2).sum())) < 1e-9 for _, i, s in got)
        hits += len(set(want) & {i for _, i, _ in got})
    assert len(found) == sum(i % 100 == 0 for i in rows) and hits >= 0.9 * 10 * len(found)


def test_op7_query(spark):
    got = {r["doc_id"]: r for r in queries.op7_simhash(spark, SF).collect()}
    prints = {}
    for r in table(spark, "documents"):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))
    label = {i: i for i in prints}
    for a in sorted(prints):
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", label[i]) for i in prints}


def test_op8_and_op10_queries(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in table(spark, "documents")))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    byte, word = (Tokenizer.from_file(queries.tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    want, at = {}, 0
    for i, t in docs:
        ids = [*word.encode(t, add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op10_token_output(spark, SF).collect()} == want
    whole = {i: [*byte.encode(t, add_special_tokens=False).ids, 0] for i, t in docs}
    got = Counter()
    for r in queries.op8_packing(spark, SF).collect():
        assert r["ids_crc32"] == crc(whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]) and r["length"] <= 2048
        got[r["doc_id"]] += r["length"]
    assert got == {i: len(x) for i, x in whole.items()}


def test_other_queries(spark):
    docs, pages = table(spark, "documents"), table(spark, "pages")
    mixed = queries.op2_mixing(spark, SF).collect()
    assert len(mixed) == len(docs) and all(r["taken"] <= 3 * r["size"] for r in mixed)
    assert len(queries.op3_warc(spark, SF).collect()) == len(queries.op5_url_filter(spark, SF).collect()) == len(pages)
    langs = {r["doc_id"]: r["lang"] for r in docs}
    said = [r for r in queries.op9_language_id(spark, SF).collect() if r["held_out"] and langs[r["doc_id"]] is not None]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in said]) >= 0.95
    grades = {r["doc_id"]: r["quality"] + 1 - r["toxic"] for r in table(spark, "labels")}
    graded = [(grades[r["doc_id"]], r["expected_grade"]) for r in queries.op6_quality_classifier(spark, SF).collect() if r["doc_id"] in grades]
    assert np.mean([e for g, e in graded if g == 2]) > np.mean([e for g, e in graded if g < 2])
