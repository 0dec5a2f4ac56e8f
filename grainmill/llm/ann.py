"""Nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Vectors are projected to ``dims`` dimensions by independent normal weights. Over the projection, the squared
projected distance of two vectors divided by their squared distance follows a chi-square law with ``dims``
degrees of freedom. Projected neighbours are therefore visited in order of projected distance and
verified on the original vectors, until the test holds: the next projected distance is so large that a
vector as near as the k-th found would lie below it with probability ``confidence``. Each true neighbour is
thus found with at least that probability.

A kd-tree of the projections, split at the medians of a bounded sample (``SAMPLED`` vectors a shard, at most ``MOST_SHARDS`` shards), deals every vector
to a shard; a shard is cut by hash into pieces of about ``PIECE`` vectors, however many it holds. A task has one piece, and a kd-tree
of its own over it. A query visits its own piece first; the distance of the k-th found there, with the test,
names the shards that it must still visit, by their bounding boxes, and within a piece the leaves. Queries go to pieces by a
join on the piece, at most about ``QUERIES`` of them to a task, so neither all vectors nor all queries meet in one place.

Where vectors have no structure, as directions drawn evenly from 64 dimensions, hardly any box closes and the test alone saves
work; then each query goes to every piece.

Equal vectors form one point that keeps the smallest ``k + 1`` of their ids: with ties to the smaller id no
other can be among a query's k nearest. So a vector that a third of all rows share is one point. Vectors
that are null, empty, all zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors of each length
are searched among their own. An id with several vectors stands for each of
them, never for its own neighbour. Other columns are never read, so any names go. Empty tables, and tables with no query, give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, exp, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill import scratch

DIMS = 24
CONFIDENCE = 0.95
#: Points of a piece and of a leaf within it; shards at most, and vectors a shard that the splits between shards are fitted on.
PIECE = 1 << 14
LEAF = 256
MOST_SHARDS = 1 << 16
SAMPLED = 16
#: Queries that meet a piece in one task.
QUERIES = 1 << 16
#: Rows of queries sent to other pieces that a task makes at once.
ROWS_SENT = 10_000
#: Projected neighbours verified between two tests.
STEP = 128


def chi_square_quantile(p: float, dims: int) -> float:
    """The p-quantile of the chi-square law with an even number of degrees of freedom."""

    def above(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(dims // 2):
            total += term
            term *= x / 2 / (i + 1)
        return exp(-x / 2) * total

    low, high = 0.0, 40.0 + 20 * dims
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > 1 - p else (low, mid)
    return high


def valid(v: Column) -> Column:
    """Vectors that take part."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class Tree:
    """Complete kd-tree in heap order: node n has the children 2n + 1 and 2n + 2."""

    axes: np.ndarray
    cuts: np.ndarray
    depth: int

    @classmethod
    def fit(cls, points: np.ndarray, depth: int) -> Tree:
        axes, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = {0: points}
        for n in range(len(axes)):
            own = parts.pop(n)
            if len(own):
                axes[n] = int(np.argmax(own.max(0) - own.min(0)))
                cuts[n] = np.median(own[:, axes[n]])
            below = own[:, axes[n]] <= cuts[n]
            parts[2 * n + 1], parts[2 * n + 2] = own[below], own[~below]
        return cls(axes, cuts, depth)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + np.where(points[np.arange(len(points)), self.axes[node]] <= self.cuts[node], 1, 2)
        return node - len(self.axes)


class Piece:
    """Points under a kd-tree of their projections, its leaves as stretches of rows with their boxes."""

    def __init__(self, points: np.ndarray, shadows: np.ndarray, ids: Sequence):
        tree = Tree.fit(shadows, max(0, ceil(log2(max(len(points), 1) / LEAF))))
        leaf = tree.leaf(shadows)
        order = np.argsort(leaf, kind="stable")
        self.points, self.shadows, self.ids = points[order], shadows[order], [ids[i] for i in order]
        self.starts = np.flatnonzero(np.diff(leaf[order], prepend=-1))
        self.ends = np.append(self.starts[1:], len(points))
        self.low, self.high = np.minimum.reduceat(self.shadows, self.starts), np.maximum.reduceat(self.shadows, self.starts)

    def nearest(self, query: np.ndarray, shadow: np.ndarray, want: int, bound: float, limit: float) -> tuple[list[tuple[float, int]], int]:
        """The ``want`` nearest (distance, id), none farther than ``bound``, ties to smaller ids; and the points verified."""
        near = np.flatnonzero(box_distance(shadow, self.low, self.high) <= limit * bound * bound)
        rows = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in near]) if len(near) else np.zeros(0, np.int64)
        apart = ((self.shadows[rows] - shadow) ** 2).sum(1)
        order = np.argsort(apart, kind="stable")
        best: list[tuple[float, int]] = []
        reach, done = bound, 0
        for at in range(0, len(order), STEP):
            if apart[order[at]] > limit * reach * reach:  # the stopping test
                break
            part = rows[order[at : at + STEP]]
            distance = np.sqrt(((self.points[part] - query) ** 2).sum(1))
            for k in np.flatnonzero(distance <= reach):
                best += [(float(distance[k]), int(i)) for i in self.ids[part[k]]]
            if len(best) > want:
                best = sorted(best)[:want]
            if len(best) == want:
                reach = min(reach, max(best)[0])
            done += len(part)
        return sorted(best)[:want], done


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point from boxes."""
    return (np.maximum(0, np.maximum(low - point, point - high)) ** 2).sum(1)


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = 23) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col`` and ``score`` (the distance) of each query's ``k`` nearest.

    ``queries`` is a condition on ``vectors`` that names the rows to search for; all rows are candidates.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("v")))
    counts = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c"), F.count_if("asked").alias("asked"))
    lengths = {r["n"]: r["c"] for r in counts.where("asked > 0").orderBy("n").collect()}  # others have nothing to find
    found = [_search(rows.where(F.size("v") == n), total, n, k, dims, confidence, seed) for n, total in (lengths or {1: 0}).items()]
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)


def _search(rows: DataFrame, total: int, length: int, k: int, dims: int, confidence: float, seed: int) -> DataFrame:
    """The search among ``total`` vectors ``v`` of one length, with ``id`` and ``asked``."""
    want, limit = k + 1, chi_square_quantile(confidence, dims)
    axes = np.random.default_rng(seed).standard_normal((length, dims))
    kind = rows.schema["v"].dataType.simpleString()

    # Equal vectors, grouped in salted parts first.
    salts = max(16, total // 4096)
    least = lambda x: F.slice(F.array_sort(F.array_distinct(x)), 1, want)
    points = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(least(F.collect_list("id")).alias("ids"))
    points = points.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn("point", F.monotonically_increasing_id())
    points = scratch.materialize(points, "ann-points")
    n = points.count()

    @F.pandas_udf("array<double>")
    def shadow(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(list(np.stack(v).astype(float) @ axes)) if len(v) else pd.Series([], dtype=object)

    shadowed = points.withColumn("y", shadow("v"))
    depth = min(int(log2(MOST_SHARDS)), max(0, ceil(log2(max(n, 1) / PIECE))))
    fraction = min(1.0, SAMPLED * (1 << depth) / max(n, 1))
    sample = [r["y"] for r in shadowed.sample(fraction=fraction, seed=seed).select("y").collect()] if depth else []
    tree = Tree.fit(np.array(sample).reshape(-1, dims), depth)

    @F.pandas_udf("int")
    def shard(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for y in batches:
            yield pd.Series(tree.leaf(np.stack(y)).astype(np.int32) if len(y) else np.zeros(0, np.int32))

    placed = scratch.materialize(shadowed.withColumn("shard", shard("y")), "ann-index")
    corners = placed.groupBy("shard").agg(F.count("*").alias("n"), *[f(F.col("y")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(dims)]).orderBy("shard")
    corners = corners.collect()  # a row a shard
    shards = np.array([r["shard"] for r in corners], np.int64)
    pieces = np.array([ceil(r["n"] / PIECE) for r in corners], np.int64)
    low, high = (np.array([[r[f"{f}{i}"] for i in range(dims)] for r in corners]).reshape(-1, dims) for f in ("min", "max"))
    cut = rows.sparkSession.createDataFrame([(int(s), int(p)) for s, p in zip(shards, pieces, strict=True)], "shard int, pieces long")
    placed = placed.join(F.broadcast(cut), "shard").withColumn("piece", F.pmod(F.xxhash64("point"), F.col("pieces")))  # at most MOST_SHARDS rows

    asked = rows.where("asked").select(F.col("id").alias("query_id"), "v").distinct()
    asked = scratch.materialize(asked.join(placed.select("v", "point", "shard", "piece"), "v"), "ann-queries")
    sought = scratch.materialize(asked.dropDuplicates(["point"]).select("point", "v", shadow("v").alias("y"), "shard", "piece"), "ann-sought")
    blocks = max(1, ceil(sought.count() / QUERIES))
    block = F.pmod(F.xxhash64("point", F.lit(1)), F.lit(blocks))
    key = ["shard", "piece", "block"]
    every = F.lit(0).cast("long") if blocks == 1 else F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    index = placed.select("v", "y", "ids", "shard", "piece", every.alias("block"))

    def visit(_: tuple, held: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(sought):
            piece = Piece(np.stack(held["v"]).astype(float), np.stack(held["y"]), held["ids"].tolist())
            for q in sought.itertuples():
                best, _ = piece.nearest(np.asarray(q.v, float), np.asarray(q.y, float), want, q.bound, limit)
                out += [(q.point, distance, i) for distance, i in best]
        return pd.DataFrame(out, columns=["point", "score", "id"])

    def visited(of: DataFrame) -> DataFrame:
        return index.groupBy(*key).cogroup(of.withColumn("block", block).groupBy(*key)).applyInPandas(visit, "point long, score double, id long")

    near = scratch.materialize(visited(sought.withColumn("bound", F.lit(float("inf")))), "ann-near")
    bounds = near.groupBy("point").agg(F.count("*").alias("c"), F.max("score").alias("bound"))
    bounded = sought.join(bounds, "point", "left").withColumn("bound", F.when(F.col("c") >= want, F.col("bound")).otherwise(F.lit(float("inf"))))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q in batches:
            at, to, part = [], [], []

            def sent(q=q, at=at, to=to, part=part) -> pd.DataFrame:
                out = q.iloc[np.repeat(np.array([a for a, _ in at], np.int64), [n for _, n in at])][["point", "v", "y", "bound"]]
                out = out.assign(shard=np.concatenate(to).astype(np.int32), piece=np.concatenate(part).astype(np.int64))
                for x in (at, to, part):
                    x.clear()
                return out

            for i, row in enumerate(q.itertuples()):
                open_ = np.flatnonzero(box_distance(np.asarray(row.y, float), low, high) <= limit * row.bound**2)
                s, p = np.repeat(shards[open_], pieces[open_]), np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in pieces[open_])])
                other = (s != row.shard) | (p != row.piece)
                at.append((i, int(other.sum())))
                to.append(s[other])
                part.append(p[other])
                if sum(n for _, n in at) > ROWS_SENT:
                    yield sent()
            if at:
                yield sent()

    farther = bounded.select("point", "v", "y", "shard", "piece", "bound").mapInPandas(others, f"point long, v {kind}, y array<double>, bound double, shard int, piece long")
    found = near.unionByName(visited(farther))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("point").orderBy("score", "id"))).where(F.col("n") <= want).drop("n")
    own = asked.select("query_id", "point").join(first, "point").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "point").orderBy("score", "id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
