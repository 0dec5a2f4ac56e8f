"""Near-duplicates by the similarity of their shingle sets, on longer SimHash sketches.

A 64-bit fingerprint within 3 bits tells copies, but two texts that share four fifths of their shingles
differ in about ten bits. Here a text has a sketch of ``64 * WORDS`` bits, the majorities over its distinct word
shingles. The share of bits in which two sketches differ is the angle between the shingle sets over pi, so
a similarity gives the number of bits allowed.

1. Texts with the same shingle set become one node.
2. A trie is walked over each of several bands of bits with a budget of its own, and whole sketches are held
   against each other where the band is within it. The bits of a band grow with the logarithm of the number of nodes,
   and the number of bands so that a pair just at the similarity meets in one of them with probability ``recall``; more
   similar pairs do so more surely. A walk returns a spanning forest of what it found near, so a group of n near
   texts makes at most n rows a band. What these forests connect is a cluster.
3. All pairs of a cluster are held exactly, by their shingles, within tasks that return spanning forests of the links.
   Clusters of up to ``SHINGLES`` shingles are dealt to tasks whole, many small ones to one. A larger one is cut
   into blocks. In a first round each block is compared within itself and with some texts of its cluster that all blocks get; in a second the texts that
   are not in the cluster's largest class so far go to every block. No pair is left out but those already in one class.

Groups are what links connect. Every link is exact; only clusters are found by sketch, so a pair may be missed but none is joined
wrongly. Work within a block grows with the square of the texts that are near by sketch and have four fifths of their shingles in common
with others of the block, yet are in different classes.

Texts that are null or blank have the sketch zero and form one group. Repeated rows share a sketch. Rows that
share an id stand or fall together; rows without an id stay. Columns of ``docs`` other than the id and the text are never read, so
any names go. A very long text is hashed whole in one task. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, floor, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill import scratch
from grainmill.llm import simhash

#: Words of 64 bits in a sketch.
WORDS = 4
#: Differing bits that the walk over a band allows.
BAND_BUDGET = 1
#: Shingles of the texts that one task compares with each other.
SHINGLES = 4_000_000
#: Texts of a large cluster that each of its blocks gets in the first round.
SHARED = 64
#: Words that a worker keeps hashes of before it starts afresh.
WORDS_KEPT = 1_000_000
_ALL = (1 << 64) - 1


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several independent hashes made from one; that for 0 is the hash itself."""
    if not k:
        return hashes
    # Increment and multipliers of SplitMix64.
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * k & _ALL)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of a text's word shingles, from those of its words, which a worker makes once."""

    def __init__(self, width: int):
        self.width = width
        self.index: dict[bytes, int] = {}
        self.hashes = np.zeros(1024, np.uint64)

    def _row(self, word: bytes) -> int:
        n = self.index[word] = len(self.index)
        if n >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = xxhash.xxh64_intdigest(word, simhash.SEED)
        return n

    def distinct(self, text: bytes | None) -> np.ndarray:
        """Sorted hashes of the distinct shingles, A-Z lower-cased; of the whole sequence if shorter, none without a word."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.index) > WORDS_KEPT:
            self.index = {}
        get, row = self.index.get, self._row
        rows = [r if (r := get(w)) is not None else row(w) for w in words]
        own = self.hashes[rows]
        n = max(1, len(words) - self.width + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(self.width, len(words))):
            out = out * np.uint64(0xBF58476D1CE4E5B9) + own[k : k + n]
        return np.unique(mixed(out, 1))


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``id_col``, ``sketch`` and ``same`` (a digest of the shingle set, equal for equal sets) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            found, held, same = [], [], []

            def flush(found=found, held=held) -> None:
                h = np.concatenate([np.zeros(0, np.uint64), *held])
                n = np.array([len(x) for x in held], np.int64)
                found.append(np.stack([simhash.majority(mixed(h, k), n) for k in range(WORDS)], 1))
                held.clear()

            size = 0
            for text in batch.column(1).cast(pa.binary()):
                own = shingler.distinct(text.as_py())
                held.append(own)
                same.append(_digest(own))
                size += len(own)
                if size > simhash.SHINGLES_AT_ONCE:
                    flush()
                    size = 0
            flush()
            rows = np.ascontiguousarray(np.concatenate(found).astype("<u8"))
            data = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data, pa.array(same, pa.binary())], [id_col, "sketch", "same"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, sketch binary, same binary")


def share_apart(similarity: float) -> float:
    """Expected share of differing bits of two equally large sets with that Jaccard similarity."""
    return acos(2 * similarity / (1 + similarity)) / pi


def most_apart(similarity: float, bits: int = 64 * WORDS) -> int:
    """Differing bits allowed between two sketches: three standard deviations above those expected."""
    p = share_apart(similarity)
    return floor(bits * p + 3 * sqrt(bits * p * (1 - p)))


def band_plan(n: int, similarity: float, recall: float, seed: int = 29) -> np.ndarray:
    """Places of the bits of each band, one row a band."""
    bits, p = max(16, ceil(log2(max(n, 2))) + 2), share_apart(similarity)
    met = sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(BAND_BUDGET + 1))
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(64 * WORDS)[:bits] for _ in range(ceil(log(1 - recall) / log(1 - met)))])


def _unpacked(sketch: pa.Array | pd.Series) -> np.ndarray:
    data = sketch.to_pylist() if isinstance(sketch, pa.Array) else sketch
    return np.frombuffer(b"".join(data), np.uint8).reshape(-1, 8 * WORDS)


def _values(sketch: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits at ``places`` as the leading ones of 64."""
    head = np.zeros((len(sketch), 64), np.uint8)
    head[:, : len(places)] = np.unpackbits(sketch, axis=1, bitorder="little")[:, places]
    return np.packbits(head, axis=1).view(">u8").ravel().astype(np.uint64)


def near(nodes: DataFrame, similarity: float = 0.8, recall: float = 0.99, subtree: int = 1 << 18, largest: int = 1 << 20) -> DataFrame:
    """A spanning forest (``a``, ``b``) for each walk of what is near, of rows of ``node`` (long) and ``sketch``.

    As :func:`simhash.links`, with a walk for each pair of subtrees of each band, in blocks beyond ``largest`` nodes.
    """
    n = nodes.count()
    plan, most = band_plan(n, similarity, recall), most_apart(similarity)
    bits = plan.shape[1]
    depth = max(1, ceil(log2(max(n, 1) / subtree)))
    flips = np.array([0, *(1 << k for k in range(depth))], np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = _unpacked(batch.column(1))
            for band, places in enumerate(plan):
                own = _values(every, places) >> np.uint64(64 - depth)
                for flip in flips:
                    low, high = np.minimum(own, own ^ flip), np.maximum(own, own ^ flip)
                    columns = [pa.array(np.full(len(own), band, np.int32)), pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["node", "sketch", "band", "l", "r"])

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        raw, node = _unpacked(group["sketch"]), group["node"].to_numpy()
        values = _values(raw, plan[key[0]])
        order = np.argsort(values, kind="stable")
        values, node, whole = values[order], node[order], raw.view("<u8")[order]
        apart = lambda i, j: np.bitwise_count(whole[i] ^ whole[j]).sum(1, dtype=np.int64)
        labels = simhash.trie_classes(values, depth, int(key[1]), int(key[2]), BAND_BUDGET, bits, lambda i, j: apart(i, j) <= most)
        # The smallest node of a class stands for it, so that walks of other bands name the same one for the most part.
        least = node.copy()
        np.minimum.at(least, labels, node)
        tied = np.flatnonzero(least[labels] != node)
        return pd.DataFrame({"a": node[tied], "b": least[labels[tied]]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = _unpacked(batch.column(0))
            for band, places in enumerate(plan):
                heads, times = np.unique(_values(every, places) >> np.uint64(64 - depth), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), band, np.int32)), pa.array(heads.astype(np.int64)), pa.array(times)], ["band", "head", "n"])

    dealt = nodes.select("node", "sketch").mapInArrow(deal, "node long, sketch binary, band int, l long, r long")
    if n > largest // 2:  # else no subtree is large
        heads = nodes.select("sketch").mapInArrow(count, "band int, head long, n long").groupBy("band", "head").agg(F.sum("n").alias("n"))
        dealt = simhash.in_blocks(dealt, heads, largest, "node", ["band"])
    else:
        dealt = dealt.withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")})
    return dealt.groupBy("band", "l", "r", "x", "y").applyInPandas(walk, "a long, b long")


def shingle_sets(texts: DataFrame, width: int = 5) -> DataFrame:
    """``node``, ``cluster`` and the hashes of the distinct shingles, from these two, ``same`` and ``text``.

    Rows whose text has not the shingle set ``same`` are left out: those share an id with the one meant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            found = [shingler.distinct(t.as_py()) for t in batch.column(3).cast(pa.binary())]
            meant = pa.array([_digest(f) == s.as_py() for f, s in zip(found, batch.column(2), strict=True)], pa.bool_())
            data = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], ["node", "cluster", "shingles"]).filter(meant)

    return texts.select("node", "cluster", "same", "text").mapInArrow(run, "node long, cluster long, shingles array<long>")


def cluster_links(sets: list[np.ndarray], labels: np.ndarray, own: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different labels, one of them ``own``, that are that similar, as a spanning forest over the labels.

    Only shingles that two sets have count for what is common, so a set's number of those bounds its similarity to any.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(m), size)
    _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = times[shingle] > 1
    row, shingle = row[kept], shingle[kept]
    common = np.bincount(row, minlength=m)
    ends = np.cumsum(common)
    order = np.argsort(shingle, kind="stable")  # postings: the rows of each shingle
    postings, starts = row[order], np.searchsorted(shingle[order], np.arange(len(times) + 1))
    enough = lambda both, i, j: both >= similarity * (size[i] + size[j] - both) - 1e-9
    label, out, turn = labels.copy(), [], np.lexsort((np.arange(m), size - common))  # the least edited first
    for at, i in enumerate(turn):
        rest = turn[at + 1 :]
        rest = rest[(label[rest] != label[i]) & (own[rest] | own[i]) & enough(np.minimum(common[rest], common[i]), i, rest)]
        if not len(rest):
            continue
        of = shingle[ends[i] - common[i] : ends[i]]
        both = np.bincount(np.concatenate([postings[starts[s] : starts[s + 1]] for s in of]), minlength=m)[rest]
        rest = rest[enough(both, i, rest)]
        _, first = np.unique(label[rest], return_index=True)
        out += [(i, j) for j in rest[first]]
        if len(first):
            label[np.isin(label, label[rest[first]])] = label[i]
    return out


def compare(dealt: DataFrame, similarity: float) -> DataFrame:
    """Links (``a``, ``b``) of rows of ``node``, ``cluster``, ``label``, ``own`` and ``shingles`` within a ``cluster`` and a ``part``.

    Rows that are not ``own`` visit the part, and are compared with its own rows alone.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        node, cluster, label, own = (group[c].to_numpy() for c in ("node", "cluster", "label", "own"))
        order = np.lexsort((node, cluster))
        edges = np.flatnonzero(np.diff(cluster[order], prepend=cluster[order[0]] - 1, append=cluster[order[-1]] + 1))
        found, sets = [], group["shingles"].to_numpy()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                at = order[a:b]
                found += [(node[at[i]], node[at[j]]) for i, j in cluster_links([sets[k] for k in at], label[at], own[at], similarity)]
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    return dealt.groupBy("part").applyInPandas(run, "a long, b long")


def cluster_pairs(sets: DataFrame, similarity: float = 0.8, shingles: int = SHINGLES, shared: int = SHARED) -> DataFrame:
    """All links within clusters, as ``a`` and ``b``, of written ``node``, ``cluster`` and ``shingles``."""
    sets = sets.withColumn("weight", F.size("shingles") + 16)
    sizes = scratch.materialize(sets.groupBy("cluster").agg(F.sum("weight").alias("weight")), "clusters")
    total = sizes.agg(F.sum("weight")).first()[0] or 0
    large = sizes.where(F.col("weight") > shingles).select("cluster", F.ceil(2 * F.col("weight") / shingles).alias("blocks"))
    own = F.concat_ws(":", F.lit("w"), F.pmod(F.xxhash64("cluster"), F.lit(max(1, ceil(2 * total / shingles)))))
    whole = sets.join(large, "cluster", "left_anti").withColumns({"label": F.col("node"), "own": F.lit(True), "part": own})
    columns = ["node", "cluster", "label", "own", "part", "shingles"]
    links = compare(whole.select(*columns), similarity)
    if large.isEmpty():
        return links

    cut = sets.join(large, "cluster").withColumn("draw", F.xxhash64("node")).withColumn("block", F.pmod("draw", F.col("blocks")))
    cut = scratch.materialize(cut, "cut-clusters")
    every, alone = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.array("block")

    def round_of(rows: DataFrame, visits: Column) -> DataFrame:
        sent = rows.withColumn("to", F.explode(F.when(visits, every).otherwise(alone)))
        sent = sent.withColumns({"own": F.col("to") == F.col("block"), "part": F.concat_ws(":", F.lit("b"), "cluster", "to")})
        return compare(sent.select(*columns), similarity)

    # About ``shared`` texts of each cluster go to all its blocks.
    counted = cut.join(cut.groupBy("cluster").agg(F.count("*").alias("n")), "cluster").withColumn("label", F.col("node"))
    found = round_of(counted, F.col("draw") / F.lit(2.0**64) + 0.5 < F.lit(float(shared)) / F.col("n"))
    found = scratch.materialize(found, "block-links")
    classes = cut.join(simhash.connected(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_size = classes.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = by_size.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    return links.unionByName(found).unionByName(round_of(classes.join(main, "cluster"), F.col("label") != F.col("main")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """The rows of one document of each group, that with the smallest id."""
    made = scratch.materialize(sketches(docs, id_col, text_col, width), "sketches")
    nodes = made.groupBy("same").agg(F.min(id_col).alias("first"), F.min("sketch").alias("sketch"), F.count("*").alias("rows")).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.materialize(nodes, "sketch-nodes")
    clusters = simhash.connected(near(nodes, similarity, recall))
    asked = nodes.join(clusters, "node").select("node", "first", "same", F.col("label").alias("cluster"))
    texts = docs.select(F.col(id_col).alias("first"), F.col(text_col).alias("text")).join(asked, "first")
    sets = scratch.materialize(shingle_sets(texts, width).dropDuplicates(["node"]), "shingle-sets")
    labels = simhash.connected(cluster_pairs(sets, similarity))
    joint = nodes.join(labels, "node")  # nodes with a link
    least = joint.groupBy("label").agg(F.min("first").alias("least"))
    moved = joint.join(least, "label").where("first <> least").select("same", F.lit(True).alias("moved"))
    # Only texts that another row has too, or that leave for another, matter from here on.
    classes = nodes.select("same", "first", "rows").join(moved, "same", "left").where("moved OR rows > 1")
    gone = made.select(id_col, "same").join(classes, "same").where((F.col(id_col) != F.col("first")) | F.col("moved")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
