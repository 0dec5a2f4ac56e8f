"""Exact top-k by inner product in three phases with a uniform threshold.

Vectors are cut into ``lists`` stretches of components. For a query, each stretch is a list of local scores, one a vector, and a
vector's score is the sum of its local scores. Lists are held in shards of about ``SHARD`` vectors, so a node is one
stretch of one shard.

1. Gather: every node returns the k highest local scores; the scores of the vectors found are made whole, and the k-th
   highest of them is a cutoff that no vector of the true top k lies below.
2. Collect: the cutoff goes to every node. A vector whose score reaches it has a local score of at least a
   ``lists``-th of it in some list, so each node returns all entries from there on. What cannot reach the cutoff even if its unknown
   local scores stand just below that threshold is dropped.
3. Resolve: nodes return the missing local scores of the rest, and the highest whole scores are the result.

The result is exact, whatever the data; they decide only how many entries are collected. Few long lists prune
best for vectors without structure. A node answers all three requests in one place (:func:`_answers`): queries go to nodes as
rows of a join on the node, at most about ``QUERIES`` of them to a task, and nothing but counts goes to the driver. If
all of a query's scores tie at the cutoff, all its entries are collected.

Equal vectors form one point that keeps the smallest ``k + 1`` of their ids, grouped in salted parts first: with ties to the smaller id no other
can be among a query's k highest. So a vector that a third of all rows share is one point. Vectors that are null, or hold null or non-finite
components take no part, nor do rows without an id; vectors of zeros or without components score 0. Vectors of each length are searched among
their own. An id with several vectors stands for each of them, never for its own neighbour. Components are held
to 64 bits and local scores to ``LARGEST``, far beyond which no real vector goes. Columns beside the two named ones are never
read, so any names go. Empty tables, and tables with no query, give an empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill import scratch

LISTS = 2
#: Vectors of a shard, queries that meet it in one task, and scores made at once there.
SHARD = 1 << 14
QUERIES = 1 << 12
SCORES_AT_ONCE = 1 << 22
LARGEST = 1 << 60
KEY = ["length", "list", "shard", "block"]


def quantised(v: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component; null unless all components are finite."""
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return F.when(fine, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def product(queries: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Inner products, a row a query: in doubles where these are exact, else in Python's integers, within ``LARGEST``."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(held)), np.int64)
    largest = float(np.abs(queries.astype(float)).max()) * float(np.abs(held.astype(float)).max()) * queries.shape[1]
    if largest < 2**53:
        return (queries.astype(float) @ held.astype(float).T).astype(np.int64)
    return np.clip(queries.astype(object) @ held.astype(object).T, -LARGEST, LARGEST).astype(np.int64)


def _answers(want: int):
    def answer(key: tuple, held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """What a node returns: its highest entries, those from the query's cutoff on, or those of the points wanted."""
        out = []
        if len(held) and len(asks):
            held = held.sort_values("point", ignore_index=True)
            points, ids, vectors = held["point"].to_numpy(), held["ids"].to_numpy(), np.stack(held["part"])
            step = max(1, SCORES_AT_ONCE // len(points))
            for at in range(0, len(asks), step):
                some = asks.iloc[at : at + step]
                scores = product(np.stack(some["part"]), vectors)
                for ask, own in zip(some.itertuples(), scores, strict=True):
                    if ask.wanted is not None:
                        found = np.searchsorted(points, np.asarray(ask.wanted))
                    elif not pd.isna(ask.cut):
                        found = np.flatnonzero(own >= int(ask.cut))
                    elif ask.all:
                        found = np.arange(len(points))
                    else:
                        found = np.argpartition(-own, want)[:want] if len(own) > want else np.arange(len(own))
                    out.append(pd.DataFrame({"query": ask.query, "list": key[1], "point": points[found], "ids": ids[found], "score": own[found]}))
        columns = ["query", "list", "point", "ids", "score"]
        return pd.concat(out)[columns] if out else pd.DataFrame([], columns=columns)

    return answer


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS, shard_size: int = SHARD) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col`` and ``score`` (long) of each query's ``k`` highest inner products of quantised vectors.

    ``queries`` is a condition on ``vectors`` that names the rows to search for; all rows are candidates.
    """
    want = k + 1
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = scratch.materialize(rows.where("id IS NOT NULL AND v IS NOT NULL"), "topk-rows")
    least = lambda x: F.slice(F.array_sort(F.array_distinct(x)), 1, want)
    salt = F.pmod(F.xxhash64("id"), F.lit(max(16, rows.count() // 4096)))
    points = rows.groupBy("v", salt.alias("salt")).agg(least(F.collect_list("id")).alias("ids"))
    points = points.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn("point", F.monotonically_increasing_id())
    points = scratch.materialize(points.withColumn("length", F.size("v")), "topk-points")
    asked = rows.where("asked").select(F.col("id").alias("query_id"), "v").distinct()
    asked = scratch.materialize(asked.join(points.select("v", "point", "length"), "v").withColumnRenamed("point", "query"), "topk-queries")
    sought = scratch.materialize(asked.dropDuplicates(["query"]).select("query", "length", "v"), "topk-sought")

    shards, blocks = max(1, ceil(points.count() / shard_size)), max(1, ceil(sought.count() / QUERIES))
    shard = lambda point: F.pmod(F.xxhash64(point), F.lit(shards))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    starts = lambda i: F.floor(F.size("v") * i / lists).cast("int")
    stretches = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("list"), F.slice("v", starts(i) + 1, starts(i + 1) - starts(i)).alias("part")) for i in range(lists)])).alias("of")
    index = points.select("length", "point", F.size("ids").cast("long").alias("ids"), shard("point").alias("shard"), stretches).select("length", "of.*", "shard", "point", "ids", number(blocks).alias("block"))
    asking = sought.select("query", "length", stretches, F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).select("query", "length", "of.*", "block")
    everywhere = asking.select("*", number(shards).alias("shard"))
    nothing = {"cut": F.lit(None).cast("long"), "wanted": F.lit(None).cast("array<long>"), "all": F.lit(False)}

    def entries(asks: DataFrame, label: str) -> DataFrame:
        asks = asks.select(*KEY, "query", "part", "cut", "wanted", "all")
        answers = index.groupBy(*KEY).cogroup(asks.groupBy(*KEY)).applyInPandas(_answers(want), "query long, list long, point long, ids long, score long")
        return scratch.materialize(answers, f"topk-{label}")

    def known(found: DataFrame) -> DataFrame:
        return found.groupBy("query", "point").agg(F.first("ids").alias("ids"), F.sum("score").alias("score"), F.collect_set("list").alias("lists"))

    def resolved(found: DataFrame, label: str) -> DataFrame:
        """Whole scores of the points ``found``, of which some lists are known."""
        missing = found.select("query", "point", F.explode(F.array_except(F.array(*[F.lit(i).cast("long") for i in range(lists)]), "lists")).alias("list"))
        wanted = missing.groupBy("query", "list", shard("point").alias("shard")).agg(F.collect_list("point").alias("wanted"))
        more = entries(asking.join(wanted, ["query", "list"]).withColumns({k: v for k, v in nothing.items() if k != "wanted"}), label)
        whole = found.select("query", "point", "ids", "score").unionByName(more.drop("list"))
        return whole.groupBy("query", "point").agg(F.first("ids").alias("ids"), F.sum("score").alias("score"))

    first = resolved(scratch.materialize(known(entries(everywhere.withColumns(nothing), "gathered")), "topk-known"), "made-whole")
    downwards = Window.partitionBy("query").orderBy(F.desc("score"))  # at most ``lists`` times ``want`` entries a shard
    enough = first.withColumn("sum", F.sum("ids").over(downwards)).where(F.col("sum") >= want)
    cutoffs = scratch.materialize(enough.groupBy("query").agg(F.max("score").alias("cutoff")), "topk-cutoffs")

    cut = F.expr(f"cutoff div {lists} + int(cutoff % {lists} > 0)")
    asks = everywhere.join(cutoffs, "query", "left").withColumns(nothing | {"cut": cut, "all": F.col("cutoff").isNull()})
    collected = known(entries(asks, "collected")).join(cutoffs, "query", "left")
    reach = F.col("score") + (lists - F.size("lists")) * (cut - 1)
    collected = scratch.materialize(collected.where(F.col("cutoff").isNull() | (reach >= F.col("cutoff"))), "topk-sufficient")
    final = resolved(collected, "resolved").join(cutoffs, "query", "left").where(F.col("cutoff").isNull() | (F.col("score") >= F.col("cutoff")))

    each = final.select("query", "point", "score").join(points.select("point", F.explode("ids").alias("id")), "point")
    best = each.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("n") <= want)
    own = asked.select("query_id", "query").join(best, "query").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
