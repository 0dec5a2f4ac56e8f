"""Splits that keep a cluster whole, stratified splits, and leakage checks.

A seeded order is that of ``md5(key#seed)``: the same everywhere, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill import scratch
from grainmill.operators.ranking import running_total


def seeded(key: Column | str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(f"#{seed}")))


def target_size(n: int, share: float) -> int:
    """At least 1, half to even."""
    return max(1, round(n * share))


def greedy_cutoff(clusters: DataFrame, key: str, size: str, target: int, seed: int) -> DataFrame:
    """Clusters in seeded order while the rows taken before are fewer than ``target``."""
    ordered = clusters.select(key, size, seeded(key, seed).alias("_order"))
    return running_total(ordered, ["_order", key], {"_before": F.col(size)}, "greedy").where(F.col("_before") < target).select(key, size)


def check_ratios(*shares: float) -> None:
    if not all(0 < s < 1 for s in shares) or sum(shares) >= 1:
        raise ValueError("each ratio lies between 0 and 1, and so does their sum")


def cluster_split(df: DataFrame, key: str, stages: Sequence[tuple[str, float]], rest: str, seed: int = 42) -> DataFrame:
    """Add ``split``: each stage takes whole clusters from what the stages before left; ``rest`` gets what remains."""
    check_ratios(*[s for _, s in stages])
    left = scratch.materialize(df.groupBy(key).agg(F.count("*").alias("_size")), "clusters")
    total = left.agg(F.sum("_size")).first()[0] or 0
    chosen = None
    for k, (name, share) in enumerate(stages):
        taken = scratch.materialize(greedy_cutoff(left, key, "_size", target_size(total, share), seed + k), "stage").withColumn("split", F.lit(name))
        chosen = taken if chosen is None else chosen.unionByName(taken)
        left = left.join(taken.select(key), key, "left_anti")
    rows = df.select(F.struct("*").alias("row"), F.col(key).alias("of"))
    rows = rows.join(chosen.select(F.col(key).alias("key"), "split"), F.col("of") == F.col("key"), "left")
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns if c != "split"], F.coalesce("split", F.lit(rest)).alias("split"))


def stratified_split(df: DataFrame, label: str, key: str, share: float, seed: int = 42, labels: Sequence[str] | None = None) -> DataFrame:
    """Add ``split``: of each label max(1, round(n * share)) rows are ``val``, but one stays in ``train`` if there are two.

    Labels outside ``labels``, if given, are an error. The seeded order within a label is found by bucket, so
    no window grows with a label.
    """
    if labels is not None:
        df = df.where(F.assert_true(F.col(label).isin(*labels), F.concat(F.lit("unknown label: "), F.col(label).cast("string"))).isNull())
    rows = df.select(F.struct("*").alias("row"), F.col(label).alias("label"), F.col(key).alias("key"), seeded(key, seed).alias("order")).withColumn("bucket", F.substring("order", 1, 2))
    counts = rows.groupBy("label", "bucket").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 256 buckets a label
    n = F.sum("c").over(Window.partitionBy("label"))
    n_val = F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("long"))
    sums = counts.select(F.col("label").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"), F.when((n_val >= n) & (n > 1), n - 1).otherwise(n_val).alias("val"))
    rank = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("order", "key"))
    placed = rows.withColumn("rank", rank).join(sums, F.col("label").eqNullSafe(F.col("l")) & (F.col("bucket") == F.col("b")))
    split = F.when(F.col("before") + F.col("rank") <= F.col("val"), "val").otherwise("train")
    return placed.select(*[F.col("row")[c].alias(c) for c in df.columns if c != "split"], split.alias("split"))


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """``a``, ``b`` and ``shared``: clusters that two splits have in common, for every pair of splits."""
    held = df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("_in"))  # as many as there are splits
    pairs = F.flatten(F.transform("_in", lambda a: F.transform(F.filter("_in", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    found = held.select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count("*").alias("shared"))
    names = df.select(F.col(split).alias("a")).distinct()
    every = names.join(names.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return every.join(found.select("p.a", "p.b", "shared"), ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


def split_summary(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """``rows``, ``clusters`` and the share of rows of each split."""
    sums = df.groupBy(split).agg(F.count("*").alias("rows"), F.countDistinct(key).alias("clusters"))
    total = sums.agg(F.sum("rows").alias("_total"))
    return sums.join(F.broadcast(total)).select(split, "rows", "clusters", (F.col("rows") / F.col("_total")).alias("share"))  # a row a split, and one row
