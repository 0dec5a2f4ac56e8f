"""SimHash near-duplicates: fingerprints, a binary trie self-join, and connected components.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word shingles. Texts link when
their fingerprints differ in at most ``budget`` bits. The join walks a binary trie of the distinct
fingerprints against itself: a pair of nodes carries the bits in which their paths differ, and is dropped
as soon as that exceeds the budget.

The first ``depth`` bits of that walk are a Spark shuffle: each fingerprint goes to every pair of
subtrees whose paths are still within the budget, and one task walks one pair of subtrees. Copies cost
nothing there, as only distinct fingerprints take part. A task returns a spanning forest of the links
it found, never the links of a whole group; the forests are joined by label propagation on tables.

Texts that are null or blank have fingerprint zero. Repeated rows share a fingerprint. A null id never
becomes a component id unless the whole component has no other. Very long texts are hashed whole within one task. Other columns are
never read, so any names go. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill import scratch
from grainmill.operators.ranking import looked_up

SEED = 42
#: Shingles whose bits are counted at once, and pairs of trie nodes walked at once, in one task.
SHINGLES_AT_ONCE = 200_000
PAIRS_AT_ONCE = 400_000
#: Two nodes with at most so many pairs of fingerprints are compared outright; beyond the second number, only those in different classes.
LEAF = 32
MANY = 1 << 16
_BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, width: int = 3) -> list[int]:
    """Hashes of the word shingles of a UTF-8 text, A-Z lower-cased; of the whole sequence if shorter."""
    words = (text or b"").lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of ``counts`` hashes; a run of none gives zero.

    Each byte of a word counts one of its bits, so stretches of up to 255 hashes are added as words.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        n = counts[full]
        parts = -(-n // 255)
        first = np.cumsum(parts) - parts
        starts = np.repeat(np.cumsum(n) - n - 255 * first, parts) + 255 * np.arange(parts.sum())
        ones = np.empty((len(full), 64), np.int64)
        for k in range(8):
            lanes = np.add.reduceat(hashes >> np.uint64(k) & _BYTES, starts).astype("<u8")
            ones[:, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint's 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps, hashes, counts = [], [], []

            def flush(fps=fps, hashes=hashes, counts=counts) -> None:
                fps.append(majority(np.array(hashes, np.uint64), np.array(counts, np.int64)))
                hashes.clear()
                counts.clear()

            for text in texts:
                found = shingle_hashes(text.as_py(), width)
                hashes += found
                counts.append(len(found))
                if len(hashes) > SHINGLES_AT_ONCE:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps).view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of i and j in ``labels``, where each label is the smallest index of its class."""
    while len(i):
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def trie_classes(values: np.ndarray, prefix_bits: int, left: int, right: int, budget: int, bits: int = 64, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Label of each of the sorted ``values`` after walking subtree ``left`` against ``right``.

    The two subtrees are the values whose first ``prefix_bits`` bits are those numbers. A node is a
    contiguous range of the sorted values, so the trie needs no other storage. Only the first ``bits`` bits
    count; ``near`` says of places of values within the budget whether they link, as all do without it.
    """
    labels = np.arange(len(values))
    root = lambda p: np.searchsorted(values, np.array([p << (64 - prefix_bits)], np.uint64))[0] if p < 1 << prefix_bits else len(values)
    span = lambda p: (root(p), root(p + 1)) if prefix_bits else (0, len(values))
    (a, b), (c, d) = span(left), span(right)
    apart = (left ^ right).bit_count()
    if a == b or c == d or apart > budget:
        return labels
    stack = [(prefix_bits, np.array([[a, b, c, d, apart]], np.int64))]
    while stack:
        depth, nodes = stack.pop()
        if len(nodes) > PAIRS_AT_ONCE:
            half = len(nodes) // 2
            stack += [(depth, nodes[:half]), (depth, nodes[half:])]
            continue
        a, b, c, d, apart = nodes.T
        small = ((b - a) * (d - c) <= LEAF) | (depth >= bits)
        if small.any():
            _compare(values, labels, a[small], b[small], c[small], d[small], budget, near)
        nodes = nodes[~small]
        if not len(nodes):
            continue
        a, b, c, d, apart = nodes.T
        bit = np.uint64(1 << (63 - depth))
        keep = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - depth)) - 1)) if depth else np.uint64(0)
        m = np.searchsorted(values, (values[a] & keep) | bit)
        n = np.searchsorted(values, (values[c] & keep) | bit)
        twin = a == c
        child = np.concatenate(
            [
                np.stack([a, m, c, n, apart], 1),
                np.stack([m, b, n, d, apart], 1),
                np.stack([a, m, n, d, apart + 1], 1),
                np.stack([m, b, c, n, apart + 1], 1)[~twin],
            ]
        )
        child = child[(child[:, 0] < child[:, 1]) & (child[:, 2] < child[:, 3]) & (child[:, 4] <= budget)]
        lone = (child[:, 0] == child[:, 2]) & (child[:, 1] - child[:, 0] == 1)
        child = child[~lone]
        if len(child):
            stack.append((depth + 1, child))
    return labels


def _compare(values: np.ndarray, labels: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, budget: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
    """Link what lies within the budget between the ranges [a, b) and [c, d), in bounded blocks."""
    many = (b - a) * (d - c) > MANY
    for spans in zip(a[many], b[many], c[many], d[many], strict=True):
        _compare_many(values, labels, *map(int, spans), budget, near)
    a, b, c, d = a[~many], b[~many], c[~many], d[~many]
    most = 4 * PAIRS_AT_ONCE
    rows = np.maximum(1, most // (d - c))  # of [a, b) in one block
    parts = -(-(b - a) // rows)
    of = np.repeat(np.arange(len(a)), parts)
    a = a[of] + rows[of] * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    b, c, d = np.minimum(b[of], a + rows[of]), c[of], d[of]
    sizes = (b - a) * (d - c)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        n = sizes[at:to]
        which = np.repeat(np.arange(at, to), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (d - c)[which]
        i, j = a[which] + k // width, c[which] + k % width
        _link(values, labels, i, j, budget, near)
        at = to


def _link(values: np.ndarray, labels: np.ndarray, i: np.ndarray, j: np.ndarray, budget: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
    """Link what lies within the budget of the pairs (i, j)."""
    within = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i != j)
    i, j = i[within], j[within]
    if near is not None:
        linked = near(i, j)
        i, j = i[linked], j[linked]
    _merge(labels, i, j)


def _compare_many(values: np.ndarray, labels: np.ndarray, a: int, b: int, c: int, d: int, budget: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
    """As :func:`_compare` for two large ranges: a few rows at a time, and only against what is not in their class by then.

    Where nearly all of the ranges are one class, that takes time in proportion to them.
    """
    step = 1
    while a < b:
        rows = np.arange(a, min(b, a + step))
        before = labels[rows]
        for label in np.unique(before):
            own = rows[before == label]  # one class still, whatever it has joined since
            rest = np.arange(c, d)
            rest = rest[labels[rest] != labels[own[0]]]
            _link(values, labels, np.repeat(own, len(rest)), np.tile(rest, len(own)), budget, near)
        a += step
        step = min(2 * step, max(1, PAIRS_AT_ONCE // (d - c)), 64)


def in_blocks(pairs: DataFrame, heads: DataFrame, most: int, item: str, by: Sequence[str] = ()) -> DataFrame:
    """Cut the pairs of subtrees ``l`` and ``r`` that hold more than ``most`` items into pairs of blocks ``x`` and ``y``.

    ``heads`` has the number ``n`` of items below each ``head``, and ``by`` like ``pairs``. Items are dealt to blocks by a hash, and each block meets itself and every other, so
    all that share a subtree still meet, in tasks of at most about three times ``most`` items.
    """
    large = scratch.materialize(heads.where(F.col("n") > most // 2), "large-subtrees")
    if large.isEmpty():
        return pairs.withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")})
    for side in ("l", "r"):
        pairs = pairs.join(looked_up(large.select(*by, F.col("head").alias(side), F.col("n").alias(f"n_{side}"))), [*by, side], "left")
    size = F.coalesce("n_l", F.lit(0)) + F.when(F.col("l") != F.col("r"), F.coalesce("n_r", F.lit(0))).otherwise(0)
    pairs = pairs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(size / most)).cast("long")).withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")))
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return pairs.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("n_l", "n_r", "blocks", "own", "other")


def links(fps: DataFrame, budget: int = 3, subtree: int = 1 << 20, least_depth: int = 6, most: int = 1 << 22) -> DataFrame:
    """A spanning forest (``a``, ``b``) of the links between distinct fingerprints in column ``fp``.

    ``subtree`` is the mean number of fingerprints below one node of the depth at which the walk is
    shared out; the depth grows with the logarithm of the number of fingerprints. Subtrees that near copies fill beyond ``most`` are walked in blocks.
    """
    distinct = scratch.materialize(fps.select("fp").distinct(), "fingerprints")
    depth = max(least_depth, ceil(log2(max(distinct.count(), 1) / subtree)))
    masks = [sum(1 << x for x in c) for r in range(budget + 1) for c in combinations(range(depth), r)]
    head = F.shiftrightunsigned("fp", 64 - depth)
    pairs = (
        distinct.withColumn("p", head)
        .withColumn("q", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(F.col("p")))))
        .select("fp", F.least("p", "q").alias("l"), F.greatest("p", "q").alias("r"))
    )
    pairs = in_blocks(pairs, distinct.groupBy(head.alias("head")).agg(F.count("*").alias("n")), most, "fp")

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(group["fp"].to_numpy().view(np.uint64))
        labels = trie_classes(values, depth, int(key[0]), int(key[1]), budget)
        tied = np.flatnonzero(labels != np.arange(len(values)))
        signed = values.view(np.int64)
        return pd.DataFrame({"a": signed[tied], "b": signed[labels[tied]]})

    return pairs.groupBy("l", "r", "x", "y").applyInPandas(walk, "a long, b long")


def connected(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``node`` and ``label`` for every node of the edges (``a``, ``b``); equal labels mean one component.

    Rounds of smallest-label propagation with pointer jumping, each written to the shared folder. Every
    join has the labels, unique by node, on one side, so a hub only makes a skewed join that Spark splits.
    """
    # One pass over the edges gives both directions; a union would compute them twice.
    both = edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    both = scratch.materialize(both.select("e.a", "e.b").distinct(), "edges")
    labels = scratch.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        lower = labels.join(near, "node").select("node", F.least("label", "other").alias("up"), "label")
        top = labels.select(F.col("node").alias("up"), F.col("label").alias("upper"))
        moved = lower.join(top, "up").select("node", F.least("up", "upper").alias("new"), "label")
        moved = scratch.materialize(moved, "labels")
        changed = moved.where("new <> label").limit(1).count()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, width: int = 3) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id``: the smallest id that links reach from the row."""
    return grouped(scratch.materialize(fingerprints(docs, id_col, text_col, width), "simhash"), id_col, budget)


def grouped(fps: DataFrame, id_col: str = "doc_id", budget: int = 3) -> DataFrame:
    """Components as above of a written table of ``id_col`` and ``fp``."""
    own = fps.groupBy("fp").agg(F.min(id_col).alias("first"))
    labels = connected(links(fps, budget))
    classes = own.join(labels, own["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    classes = scratch.materialize(classes, "classes")
    # Classes of one fingerprint, nearly all of them, need no second grouping.
    joint = labels.select("label").distinct()
    smallest = classes.join(joint, "label", "left_semi").groupBy("label").agg(F.min("first").alias("component_id"))
    named = classes.join(smallest, "label", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    """Sixteen lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, width: int = 3) -> DataFrame:
    """The rows of one document of each component, that with the smallest id; rows without an id stay."""
    found = components(docs, id_col, text_col, budget, width)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
