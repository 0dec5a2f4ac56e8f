"""Global ranks and running totals without a single-partition window.

Rows are dealt out by ranges of their order, each range is summed, and the sums of the ranges before a
range (one row a range) are added to the ranks within it. Nulls come first, as in Spark's ascending order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from grainmill import scratch

_BEFORE = (Window.unboundedPreceding, -1)
#: Rows that a table of a few columns may have to be sent to all tasks.
BROADCAST_ROWS = 100_000
#: Distinct values of a column whose shares are sent to all tasks, at about 100 bytes each.
SHARE_ROWS = 1_000_000
#: Buckets that one pass of :func:`element_at` counts.
BUCKETS = 4096


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has: ``name``, with underscores before it if need be."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def looked_up(df: DataFrame) -> DataFrame:
    """A written table that is to be joined to a larger one: sent to all tasks where it is small, so that keys of the larger one may be hot."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def running_total(df: DataFrame, order: Sequence[str], values: dict[str, Column | str], label: str = "ranges") -> DataFrame:
    """Add a column for each of ``values``: the sum of that expression over the rows before, in ``order``.

    ``order`` names columns of ``df`` that should tell rows apart. ``{"rank": lit(1)}`` gives ranks from 0.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = [f"o{k}" for k in range(len(order))]
    added = [(F.expr(v) if isinstance(v, str) else v).alias(f"v{k}") for k, v in enumerate(values.values())]
    kept = df.select(F.struct("*").alias("row"), *[F.col(c).alias(p) for c, p in zip(order, places, strict=True)], *added)
    kept = kept.repartitionByRange(parts, *places).withColumn("range", F.spark_partition_id())
    kept = scratch.materialize(kept, label)
    sums = kept.groupBy("range").agg(*[F.sum(f"v{k}").alias(f"s{k}") for k in range(len(values))])
    ranges = Window.orderBy("range").rowsBetween(*_BEFORE)  # one row a range
    sums = sums.select("range", *[F.coalesce(F.sum(f"s{k}").over(ranges), F.lit(0)).alias(f"b{k}") for k in range(len(values))])
    within = Window.partitionBy("range").orderBy(*places).rowsBetween(*_BEFORE)
    kept = kept.withColumns({f"w{k}": F.coalesce(F.sum(f"v{k}").over(within), F.lit(0)) for k in range(len(values))})
    out = kept.join(sums, "range")
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns], *[(F.col(f"b{k}") + F.col(f"w{k}")).alias(name) for k, name in enumerate(values)])


def running_total_by_hash(df: DataFrame, part: str, hash_col: str, tie: str, value: str, out: str, rows: int, fan: int = 8, leaf: int = 256) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``part`` with a smaller (hash, tie).

    ``hash_col`` is an evenly spread long. Columns whose names begin with ``_h``, ``_b`` or ``_w`` are its own. Levels of ``2**fan`` buckets are summed until a bucket holds about
    ``leaf`` of the ``rows`` rows, so no window grows with the size of a part.
    """
    depth = 1
    while (1 << (fan * depth)) * leaf < rows and fan * (depth + 1) <= 62:
        depth += 1
    names = [f"_h{k}" for k in range(depth)]
    kept = df.withColumns({n: F.shiftrightunsigned(hash_col, 64 - fan * (k + 1)).bitwiseAND((1 << fan) - 1) for k, n in enumerate(names)})
    total = F.lit(0).cast("long")
    for k in range(depth):
        keys = [part, *names[:k]]
        sums = kept.groupBy(*keys, names[k]).agg(F.sum(value).alias("_s"))
        before = Window.partitionBy(*keys).orderBy(names[k]).rowsBetween(*_BEFORE)
        sums = sums.select(*keys, names[k], F.coalesce(F.sum("_s").over(before), F.lit(0)).alias(f"_b{k}"))
        kept = kept.join(sums, [*keys, names[k]])
        total = total + F.col(f"_b{k}")
    within = Window.partitionBy(part, *names).orderBy(hash_col, tie).rowsBetween(*_BEFORE)
    kept = kept.withColumn("_w", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return kept.select(*df.columns, (total + F.col("_w")).alias(out))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column`` (its place in ``cols``), ``value``, its ``n`` rows, ``before``: rows of the column with a smaller value, and ``total``. Nulls are left out.

    Columns of one type, all in one pass; a written table.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(c).alias("value")) for k, c in enumerate(cols)]))
    counts = df.select(each.alias("e")).select("e.column", "e.value").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    counts = scratch.materialize(running_total(counts, ["column", "value"], {"at": F.col("n")}, "values"), "value-counts")
    first = counts.groupBy("column").agg(F.min("at").alias("first"), F.sum("n").alias("total"))
    return counts.join(F.broadcast(first), "column").select("column", "value", "n", (F.col("at") - F.col("first")).alias("before"), "total")  # a row a column


def cume_dist(df: DataFrame, cols: dict[str, str], counts: DataFrame | None = None) -> DataFrame:
    """Add for each ``{column: name}``, columns of one type, the share of rows with the same or a smaller value.

    As the window function without a partition, but no task sees more than a range of the distinct values;
    the values come back by an equality join. Null stays null. ``counts`` are the :func:`value_counts` of these columns, if they are there.
    """
    out, counts = df, value_counts(df, list(cols)) if counts is None else counts
    few = {r["column"] for r in counts.groupBy("column").agg(F.count("*").alias("n")).where(F.col("n") <= SHARE_ROWS).collect()}  # a row a column
    for k, (col, name) in enumerate(cols.items()):
        shares = counts.where(F.col("column") == k).select(F.col("value").alias("_value"), ((F.col("before") + F.col("n")) / F.col("total")).alias(name))
        out = out.join(F.broadcast(shares) if k in few else shares, F.col(col) == F.col("_value"), "left").drop("_value")
    return out


def element_at(df: DataFrame, col: str, share: float) -> object:
    """The element at place floor(``share`` * (n - 1)) of a numeric column in ascending order; nulls do not count, NaN is the largest.

    Each pass counts the values of a range in at most ``BUCKETS`` even buckets and goes on with the one that holds the place, from its least to its largest value.
    """
    x = F.col(col)
    number = F.when(~F.isnan(x), x) if df.schema[col].dataType.typeName() in ("float", "double") else x
    row = df.agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count(number).alias("n"), F.count(x).alias("all")).first()
    low, high, below = row["low"], row["high"], 0
    place = int(share * (row["all"] - 1))
    if place >= row["n"]:
        return float("nan") if row["all"] else None
    while low != high:
        width = (float(high) - float(low)) / BUCKETS
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((x.cast("double") - float(low)) / width)) if 0 < width < float("inf") else x
        counts = df.where(number.between(low, high)).groupBy(bucket.alias("k")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for r in counts.orderBy("k").toLocalIterator():
            if below + r["n"] > place:
                low, high = r["low"], r["high"]
                break
            below += r["n"]
    return low


def floor_quantiles(df: DataFrame, col: str, quantiles: Sequence[float], counts: DataFrame | None = None, place: int = 0) -> dict[float, float | None]:
    """The element at place floor(q * (n - 1)) in ascending order, without interpolation; None without rows.

    ``counts`` are :func:`value_counts` in which the column has that ``place``, if they are there.
    """
    if counts is None and isinstance(df.schema[col].dataType, NumericType):
        return {q: element_at(df, col, q) for q in quantiles}
    counts = (value_counts(df, [col]) if counts is None else counts).where(F.col("column") == place)
    at = lambda q: F.floor(F.lit(q) * (F.col("total") - 1))
    hit = [F.max(F.when((F.col("before") <= at(q)) & (F.col("before") + F.col("n") > at(q)), F.col("value"))).alias(f"q{k}") for k, q in enumerate(quantiles)]
    row = counts.agg(*hit).first()
    return {q: row[k] for k, q in enumerate(quantiles)}
