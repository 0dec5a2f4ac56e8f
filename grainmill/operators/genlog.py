"""Generation logs: append-only events by id, resumed, retried, rolled up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill import scratch


def latest(log: DataFrame, id_col: str, order: str, where: Column | None = None) -> DataFrame:
    """Last event of each id, of those that ``where`` admits."""
    rows = log if where is None else log.where(where)
    columns = [c for c in log.columns if c != id_col]
    return rows.groupBy(id_col).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_r")).select(id_col, *[F.col(f"_r.{c}").alias(c) for c in columns])


def reusable(judge_model: str | None = None, allow_cautious: bool = True) -> Column:
    """Events whose result a restart may take over."""
    ok = (F.col("status") == "ok") & F.col("id").isNotNull()
    if judge_model is None:
        return ok
    decisions = ["accept", "accept_cautious"] if allow_cautious else ["accept"]
    return ok & (F.col("judge_model") == judge_model) & F.col("judge_decision").isin(*decisions)


def resume(manifest: DataFrame, done: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the manifest with a result to reuse, and rows still to be made."""
    ids = done.select(id_col).distinct()
    return manifest.join(ids, id_col, "left_semi"), manifest.join(ids, id_col, "left_anti")


def final_outcome(log: DataFrame, id_col: str, attempt: str, most: int) -> DataFrame:
    """``outcome`` by id of the last attempt within the bound: ok, filtered or failed."""
    last = latest(log.where(F.col(attempt) <= most), id_col, attempt)
    return last.select(id_col, attempt, F.when(F.col("status") == "error", "failed").otherwise(F.col("status")).alias("outcome"))


def outcome_summary(final: DataFrame) -> DataFrame:
    return final.groupBy("outcome").agg(F.count("*").alias("n"))


def generate(pending: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Results of a model, a batch of rows at a time; ``scorer`` stands for its client, made once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return pending.mapInPandas(run, schema)


def with_retries(pending: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], id_col: str, most: int) -> DataFrame:
    """Log of up to ``most`` attempts: each asks only for ids without an ``ok`` event. Logs are written tables."""
    log = None
    for n in range(1, most + 1):
        events = scratch.materialize(attempt(pending, n).withColumn("attempt", F.lit(n)), "attempt")
        log = events if log is None else log.unionByName(events)
        pending = pending.join(events.where("status = 'ok'").select(id_col), id_col, "left_anti")
    return log
