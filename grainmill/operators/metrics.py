"""Rollups of evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import ratio


def class_dim(df: DataFrame, classes: Sequence, name: str = "label") -> DataFrame:
    kind = "string" if isinstance(classes[0], str) else "int"
    return df.sparkSession.createDataFrame([(c,) for c in classes], f"`{name}` {kind}")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    """``label``, ``precision``, ``recall``, ``f1`` and ``support`` of every class, 0 where a divisor is."""
    sums = []
    for k, c in enumerate(classes):
        t, p = F.col(truth) == c, F.col(predicted) == c
        sums += [F.count_if(t & p).alias(f"h{k}"), F.count_if(p).alias(f"p{k}"), F.count_if(t).alias(f"t{k}")]
    row = df.agg(*sums)
    entry = lambda k, c: F.struct(F.lit(c).alias("label"), F.col(f"h{k}").alias("h"), F.col(f"p{k}").alias("p"), F.col(f"t{k}").alias("t"))
    rows = row.select(F.explode(F.array(*[entry(k, c) for k, c in enumerate(classes)])).alias("r")).select("r.*")
    precision, recall = ratio(F.col("h"), F.col("p")), ratio(F.col("h"), F.col("t"))
    return rows.select("label", precision.alias("precision"), recall.alias("recall"), F.col("t").alias("support")).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def macro(report: DataFrame) -> DataFrame:
    return report.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(ratio(F.count_if(F.col(truth) == F.col(predicted)), F.count("*")).alias("accuracy"))


def class_counts(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """Rows by class, classes without rows included."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return class_dim(df, classes).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def inverse_weights(counts: DataFrame, n_classes: int) -> DataFrame:
    """total / (classes * max(n, 1))."""
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("weight", F.col("_total") / (n_classes * F.greatest("n", F.lit(1)))).drop("_total")  # one row


def balanced_weights(counts: DataFrame, n_classes: int, beta: float = 0.999) -> DataFrame:
    """(1 - beta) / (1 - beta^n), scaled to sum to the number of classes; classes without rows weigh 0."""
    raw = counts.withColumn("_w", F.when(F.col("n") > 0, (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))).otherwise(0.0))
    total = raw.agg(F.sum("_w").alias("_total"))
    return raw.join(F.broadcast(total)).withColumn("weight", ratio(F.col("_w"), F.col("_total")) * n_classes).drop("_w", "_total")


def rates(flags: dict[str, Column]) -> list[Column]:
    """Share of rows for which each flag holds; 0 without rows."""
    return [F.coalesce(F.avg(F.coalesce(f.cast("double"), F.lit(0.0))), F.lit(0.0)).alias(name) for name, f in flags.items()]


def summary(df: DataFrame, flags: dict[str, Column], means: Sequence[str] = ()) -> DataFrame:
    """One row: ``num_samples``, the rates, and each mean over the rows that have the measure."""
    return df.agg(F.count("*").alias("num_samples"), *rates(flags), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"mean_{m}") for m in means])


def summary_by_reason(df: DataFrame, reasons: str, flags: dict[str, Column], none: str = "__none__") -> DataFrame:
    """The rates by reason; a row counts under each of its reasons, or under ``none``."""
    named = F.when(F.coalesce(F.size(reasons), F.lit(0)) > 0, F.col(reasons)).otherwise(F.array(F.lit(none)))
    return df.withColumn("reason", F.explode(named)).groupBy("reason").agg(F.count("*").alias("samples"), *rates(flags))


def best_epoch(df: DataFrame, epoch: str, score: str, patience: int) -> DataFrame:
    """The epoch of the best score, the first at a tie, before training would have stopped.

    It stops once ``patience`` epochs pass without a strict improvement. Epochs are few: one row each.
    """
    from pyspark.sql.window import Window

    so_far = F.max(score).over(Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_better", so_far.isNull() | (F.col(score) > so_far))
    last = F.max(F.when(F.col("_better"), F.col(epoch))).over(Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_stale", F.col(epoch) - F.coalesce(last, F.col(epoch)) > patience)
    stopped = F.max(F.col("_stale").cast("int")).over(Window.orderBy(epoch))
    return marked.withColumn("_stop", stopped).where("_stop = 0 AND _better").orderBy(F.desc(epoch)).limit(1).select(epoch, score)


def binary_report(df: DataFrame, truth: str, predicted: str, positive: object = 1) -> DataFrame:
    """One row: ``acc``, ``precision``, ``recall`` and ``f1`` of the positive class; 0 where a divisor is."""
    t, p = F.col(truth) == F.lit(positive), F.col(predicted) == F.lit(positive)
    counts = df.agg(F.count_if(t & p).alias("h"), F.count_if(t).alias("t"), F.count_if(p).alias("p"), F.count_if(F.col(truth) == F.col(predicted)).alias("e"), F.count("*").alias("n"))
    precision, recall = ratio(F.col("h"), F.col("p")), ratio(F.col("h"), F.col("t"))
    return counts.select(ratio(F.col("e"), F.col("n")).alias("acc"), precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("h"), F.col("t") + F.col("p")).alias("f1"))
