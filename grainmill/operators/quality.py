"""Curation: global scores, rank within clusters, rejection with all reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill import scratch
from grainmill.lexicons import CurationLimits
from grainmill.operators.ranking import cume_dist, floor_quantiles, looked_up, value_counts

REASONS = ("too_dark", "too_bright", "below_quality_floor", "below_sharpness_floor", "cluster_quota_exceeded", "cluster_relative_quality_low")
#: Rows of a cluster that one task may sort.
CLUSTER_ROWS = 100_000
#: Parts that clusters are hashed to in the search for larger ones.
CLUSTER_PARTS = 16_384


def score(df: DataFrame, sharpness: str = "sharpness", contrast: str = "contrast", entropy: str = "entropy", brightness: str = "brightness", counts: DataFrame | None = None) -> DataFrame:
    """Add ``quality_score``: ranks of three measures over all rows, less for brightness far from the middle.

    ``counts`` are the :func:`value_counts` of sharpness, contrast and entropy, if they are there. Columns of ``df`` are carried whole, whatever their names.
    """
    scored = _scored(_packed(df, sharpness, contrast, entropy, brightness), counts)
    return scored.select(*[F.col(f"r{k}").alias(c) for k, c in enumerate(df.columns) if c != "quality_score"], F.col("q").alias("quality_score"))


def _packed(df: DataFrame, *measures: str) -> DataFrame:
    """Columns of ``df`` as ``r0``, ``r1`` and so on, with the measures beside them."""
    own = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    return df.select(*[F.col(c).alias(f"r{k}") for k, c in enumerate(own)], *[F.col(m).alias(name) for m, name in zip(measures, "scey", strict=True)])


def _scored(rows: DataFrame, counts: DataFrame | None) -> DataFrame:
    """Add ``q`` to rows with sharpness, contrast, entropy and brightness as ``s``, ``c``, ``e`` and ``y``."""
    ranked = cume_dist(rows, {"s": "rs", "c": "rc", "e": "re"}, counts)
    value = 0.60 * F.col("rs") + 0.25 * F.col("rc") + 0.15 * F.col("re") - 0.12 * F.least(F.lit(1.0), F.abs(F.col("y") - 128.0) / 128.0)
    return ranked.withColumn("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).drop("rs", "rc", "re")


def curate(
    df: DataFrame,
    ties: Sequence[str],
    cluster: str = "cluster_key",
    sharpness: str = "sharpness",
    contrast: str = "contrast",
    entropy: str = "entropy",
    brightness: str = "brightness",
    limits: CurationLimits = CurationLimits(),
) -> DataFrame:
    """Add ``quality_score``, ``quality_bucket``, ``reject_reasons`` (in fixed order) and ``cluster_rank``.

    ``ties`` orders rows of a cluster whose score, sharpness and contrast are equal. Clusters of up to :data:`CLUSTER_ROWS` rows are ranked in one
    shuffle. Of a larger one, the first rows, as many as the quota, come from a rank that Spark limits before its shuffle; all other rows need only the
    best score and whether they are among them, so no task sorts a large cluster.
    Rows equal in all of these are ranked as they come. Columns of ``df`` are carried whole, whatever their names; results replace columns of theirs.
    """
    counts = value_counts(df, [sharpness, contrast, entropy])
    places = {c.lower(): f"r{k}" for k, c in enumerate(df.columns)}
    roles = {name: places.get(m.lower(), name) for m, name in zip((sharpness, contrast, brightness), "scy", strict=True)}  # a measure that is a column is written once
    carried = [*places.values()]
    rows = _scored(_packed(df, sharpness, contrast, entropy, brightness), counts)
    written = scratch.materialize(rows.select(*carried, *{r: r for r in roles.values() if r not in carried}, "q"), "scored")
    scored = written.select(*carried, "q", F.col(places[cluster.lower()]).alias("cluster"), *[F.col(r).alias(name) for name, r in roles.items()], F.monotonically_increasing_id().alias("at"))
    floor = floor_quantiles(written, "q", [limits.quality_quantile])[limits.quality_quantile]
    sharp = floor_quantiles(df, sharpness, [limits.sharpness_quantile], counts)[limits.sharpness_quantile]
    own = (F.col("y") < limits.min_brightness, F.col("y") > limits.max_brightness, F.col("q") < F.lit(floor), F.col("s") < F.lit(sharp))
    flags = sum((F.coalesce(t, F.lit(False)).cast("int") * (1 << k) for k, t in enumerate(own)), F.lit(0))
    order = [F.desc("q"), F.desc("s"), F.desc("c"), *[places[t.lower()] for t in ties], "at"]
    scored = scored.withColumn("flags", flags).drop("y")

    large = _large(scored.select("cluster"))
    if large is None:
        ranked = _ranked(scored, order, limits, carried)
    else:
        in_large = F.col("cluster").eqNullSafe(F.col("of"))  # at most one in so many rows is a cluster of that size
        few = scored.join(F.broadcast(large), in_large, "left_anti")
        many = scratch.materialize(scored.join(F.broadcast(large), in_large, "left_semi"), "in-large-clusters")
        ranked = _ranked(few, order, limits, carried).unionByName(_ranked_large(many, order, limits, carried))

    clean = F.col("mask") == 0
    made = {"quality_score": F.col("q"), "reject_reasons": _reasons(), "quality_bucket": F.when(clean, "clean").otherwise("hard_case"), "cluster_rank": F.when(clean, F.col("kept"))}
    return ranked.select(*[F.col(f"r{k}").alias(c) for k, c in enumerate(df.columns) if c not in made], *[c.alias(name) for name, c in made.items()])


def _large(clusters: DataFrame) -> DataFrame | None:
    """Clusters of more than :data:`CLUSTER_ROWS` rows as ``of``, None if there are none. They are counted only in the parts that hold as many."""
    part = F.pmod(F.hash("cluster"), F.lit(CLUSTER_PARTS))
    full = clusters.groupBy(part.alias("part")).agg(F.count("*").alias("n")).where(F.col("n") > CLUSTER_ROWS)
    parts = [r["part"] for r in full.collect()]  # at most CLUSTER_PARTS rows
    if not parts:
        return None
    large = clusters.where(part.isin(parts)).groupBy(F.col("cluster").alias("of")).agg(F.count("*").alias("n")).where(F.col("n") > CLUSTER_ROWS).select("of")
    large = scratch.materialize(large, "large-clusters")
    return None if large.isEmpty() else large


def _reasons() -> Column:
    """The reasons of a ``mask``, looked up: a row makes no array of its own."""
    chosen = [F.array(*[F.lit(r) for k, r in enumerate(REASONS) if mask & (1 << k)]).cast("array<string>") for mask in range(1 << len(REASONS))]
    return F.get(F.array(*chosen), F.col("mask"))


def _mask(limits: CurationLimits) -> Column:
    """A bit for each of :data:`REASONS`, of rows with their tests ``flags``, place ``i``, score ``q`` and their cluster's ``best``."""
    return F.col("flags") + (F.col("i") >= limits.max_per_cluster).cast("int") * 16 + ((F.col("i") > 0) & _behind(F.col("q"), limits)).cast("int") * 32


def _behind(q: Column, limits: CurationLimits) -> Column:
    return F.coalesce(q < F.col("best") * limits.secondary_ratio, F.lit(False))


def _ranked(scored: DataFrame, order: list[Column | str], limits: CurationLimits, carried: list[str]) -> DataFrame:
    """The ``carried`` columns, ``q``, ``mask`` and ``kept``, the rows without a reason so far in the cluster."""
    within = Window.partitionBy("cluster").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    ranked = scored.withColumns({"i": F.row_number().over(within) - 1, "best": F.first("q").over(so_far)}).withColumn("mask", _mask(limits))
    return ranked.withColumn("kept", F.sum((F.col("mask") == 0).cast("int")).over(so_far).cast("int")).select(*carried, "q", "mask", "kept")


def _ranked_large(scored: DataFrame, order: list[Column | str], limits: CurationLimits, carried: list[str]) -> DataFrame:
    """As :func:`_ranked`, no cluster in one task; of a written table, as ``at`` must stay."""
    first = scored.withColumn("i", F.row_number().over(Window.partitionBy("cluster").orderBy(*order)) - 1).where(F.col("i") < limits.max_per_cluster)
    heads = first.groupBy(F.col("cluster").alias("of")).agg(F.max_by("q", -F.col("i")).alias("best"), F.array_sort(F.collect_list(F.struct("i", "at", (F.col("flags") != 0).alias("fails"), "q"))).alias("heads"))
    heads = looked_up(scratch.materialize(heads, "heads"))  # a row a cluster
    ranked = scored.join(heads, F.col("cluster").eqNullSafe(F.col("of")))
    at = F.array_position(F.transform("heads", lambda h: h["at"]), F.col("at"))
    ranked = ranked.withColumn("i", F.when(at > 0, at - 1).otherwise(F.lit(limits.max_per_cluster)).cast("int")).withColumn("mask", _mask(limits))
    kept = F.size(F.filter("heads", lambda h: (h["i"] <= F.col("i")) & ~h["fails"] & ~((h["i"] > 0) & _behind(h["q"], limits))))
    return ranked.select(*carried, "q", "mask", kept.alias("kept"))


def reason_counts(df: DataFrame, reasons: str = "reject_reasons", none: str | None = None) -> DataFrame:
    """Rows by reason; a row counts under each of its reasons, or under ``none`` if that is given. Equal arrays are counted first, then taken apart."""
    values = F.col("v") if none is None else F.when(F.size("v") == 0, F.array(F.lit(none))).otherwise(F.col("v"))
    alike = df.groupBy(F.col(reasons).alias("v")).agg(F.count("*").alias("m"))
    return alike.select(F.explode(values).alias("reason"), "m").groupBy("reason").agg(F.sum("m").alias("n"))


def cluster_size_histogram(df: DataFrame, cluster: str, top: int = 10) -> DataFrame:
    """The commonest cluster sizes, with the number of clusters; ties to the smaller size."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("clusters")).orderBy(F.desc("clusters"), "size").limit(top)
