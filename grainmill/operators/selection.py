"""Choosing evaluation sets: scored, limited by cluster, by level, by id."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby as runs

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill.operators.ranking import fresh


def challenge_score(required: Column, total: Column, hits: Column, report_hits: Column) -> Column:
    base = required * 10.0 + total * 3.0 + F.least(hits, F.lit(12)) * 0.5 + F.least(report_hits, F.lit(8)) * 0.75
    return base + F.when(required >= 3, 4.0).otherwise(0.0) + F.when(total >= 4, 2.0).otherwise(0.0)


def qualify(df: DataFrame, required: str, hits: str, least_required: int, least_hits: int, excluded: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Rows uncertain enough by either count, with an id, and not excluded."""
    out = df.where((F.col(required) >= least_required) | (F.col(hits) >= least_hits)).where(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != ""))
    return out if excluded is None else exclude(out, excluded, id_col=id_col)


def exclude(df: DataFrame, *others: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in none of the others."""
    ids = others[0].select(id_col)
    for o in others[1:]:
        ids = ids.union(o.select(id_col))
    return df.join(ids.distinct(), id_col, "left_anti")


def per_cluster(df: DataFrame, cluster: str, order: Sequence[Column | str], most: int, rank: str | None = None) -> DataFrame:
    """The first ``most`` rows of each cluster."""
    own = rank or fresh(df, "_n")
    out = df.withColumn(own, F.row_number().over(Window.partitionBy(cluster).orderBy(*order))).where(F.col(own) <= most)
    return out if rank else out.drop(own)


def two_source_quota(sources: Sequence[DataFrame], cluster: str, order: Sequence[str], most: int) -> DataFrame:
    """First ``most`` rows of each cluster over all sources, earlier sources first; columns a source lacks are null.

    Every admitted row counts against the same quota, so rank within the cluster decides.
    """
    source = "_prio"
    for s in sources:
        source = max(source, fresh(s, source), key=len)
    united = sources[0].withColumn(source, F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        united = united.unionByName(s.withColumn(source, F.lit(k)), allowMissingColumns=True)
    return per_cluster(united, cluster, [source, *order], most).drop(source)


def top(df: DataFrame, cluster: str, order: Sequence[Column | str], most_per_cluster: int, limit: int) -> DataFrame:
    """Best rows by ``order``, at most ``most_per_cluster`` of a cluster; ``limit`` is at least 1."""
    return per_cluster(df, cluster, order, most_per_cluster).orderBy(*order).limit(max(1, limit))


def stratified(df: DataFrame, level: str, cluster: str, order: Sequence[Column | str], most_per_cluster: int, limit: int, least_level: int = 0) -> DataFrame:
    """Rounds over the levels, from the highest, one row of each, until ``limit``; clusters lie within one level.

    Where a cluster spans levels the outcome depends on the order of picks; see :func:`stratified_exact`.
    """
    kept = per_cluster(df.where(F.col(level) >= least_level), cluster, [F.desc(level), *order], most_per_cluster)
    turn = fresh(kept, "_turn")
    ranked = kept.withColumn(turn, F.row_number().over(Window.partitionBy(level).orderBy(*order)))
    return ranked.orderBy(turn, F.desc(level)).limit(limit).drop(turn)


def stratified_exact(df: DataFrame, id_col: str, level: str, cluster: str, order: Sequence[Column | str], most_per_cluster: int, limit: int, least_level: int = 0) -> DataFrame:
    """The sequential rule for clusters that span levels: one row a level and round, skipping full clusters.

    Only rows that can be picked take part in the sequence: a cluster gives at most ``most_per_cluster`` rows, and
    so does each of its levels, and a level at most ``limit`` rows beyond those it skips. The candidates are thus
    bounded by the result's size and walked on the driver as ids; rows come back by a join.
    """
    best = per_cluster_level(df.where(F.col(level) >= least_level), cluster, level, order, most_per_cluster)
    rank = F.row_number().over(Window.partitionBy(level).orderBy(*order))
    place = fresh(best, "_n")
    rows = best.withColumn(place, rank).where(F.col(place) <= limit * (most_per_cluster + 1)).select(id_col, level, cluster, place).collect()
    queues = {k: list(g) for k, g in runs(sorted(rows, key=lambda r: (-r[level], r[place])), key=lambda r: r[level])}
    used: dict = {}
    picked: list = []
    while len(picked) < limit and any(queues.values()):
        for queue in queues.values():
            while queue and used.get(queue[0][cluster], 0) >= most_per_cluster:
                queue.pop(0)
            if queue and len(picked) < limit:
                row = queue.pop(0)
                used[row[cluster]] = used.get(row[cluster], 0) + 1
                picked.append(row[id_col])
    chosen = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(picked)], f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, pick int")
    return df.join(chosen, id_col).orderBy("pick")


def per_cluster_level(df: DataFrame, cluster: str, level: str, order: Sequence[Column | str], most: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(cluster, level).orderBy(*order))
    own = fresh(df, "_k")
    return df.withColumn(own, n).where(F.col(own) <= most).drop(own)


def lookup(ids: DataFrame, rows: DataFrame, id_col: str, ids_order: str, rows_order: str) -> DataFrame:
    """Rows by a list of ids, in the list's order, each id once; of equal ids among the rows the last wins."""
    wanted = ids.groupBy(id_col).agg(F.min(ids_order).alias("_at"))
    columns = [c for c in rows.columns if c != id_col]
    last = rows.groupBy(id_col).agg(F.max_by(F.struct(*columns), F.col(rows_order)).alias("_row"))
    return wanted.join(last, id_col).select(id_col, "_at", *[F.col(f"_row.{c}").alias(c) for c in columns])


def missing_ids(ids: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    return ids.select(id_col).distinct().join(rows.select(id_col), id_col, "left_anti")


def head(df: DataFrame, order: str, limit: int | None) -> DataFrame:
    """First rows in input order; all of them without a limit."""
    return df if limit is None else df.orderBy(order).limit(limit)


def level_counts(df: DataFrame, level: str, score: str) -> DataFrame:
    """Rows and mean score by level."""
    return df.groupBy(level).agg(F.count("*").alias("rows"), F.avg(score).alias("mean_score"))


def preview(df: DataFrame, order: Sequence[Column | str], columns: Sequence[str], limit: int = 20) -> DataFrame:
    """One row with ``preview``: the first rows as structs, for a summary. The array is as long as the limit."""
    first = df.orderBy(*order).limit(limit).select(*columns).withColumn("_at", F.monotonically_increasing_id())
    rows = F.array_sort(F.collect_list(F.struct("_at", F.struct(*columns).alias("row"))))
    return first.agg(F.transform(rows, lambda r: r["row"]).alias("preview"))


def without_terms(df: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """Rows whose key contains none of the terms; a null key stays."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.col(key).contains(t)
    return df.where(~F.coalesce(hit, F.lit(False)))
