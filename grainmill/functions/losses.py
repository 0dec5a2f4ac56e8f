"""Losses as columns over logged values: of classifiers, and of a policy's tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.gates import softmax
from grainmill.functions.lang import let

def log_probability(logits: Column, label: Column) -> Column:
    """Natural logarithm of the softmax of the true class."""
    return F.log(F.get(softmax(logits), label))


def focal_loss(logits: Column, label: Column, gamma: float = 2.0, weight: Column | None = None) -> Column:
    """-weight (1 - p)^gamma log p of the true class, p at least 1e-8; ``gamma`` 0 is cross entropy."""
    loss = let(log_probability(logits, label), lambda l: -F.pow(1 - F.greatest(F.exp(l), F.lit(1e-8)), F.lit(gamma)) * l)
    return loss if weight is None else weight * loss


def weighted_mean(loss: Column, weight: Column) -> Column:
    """Aggregate: the sum of losses over that of their weights."""
    return F.sum(loss) / (F.sum(weight) + 1e-12)


def soft_gate(ratio: Column, center: float = 1.0, temperature: float = 4.0, least: float = 0.2) -> Column:
    """Decays exponentially with the distance of the ratio from the centre, down to ``least``."""
    least = max(0.0, min(float(least), 1.0))
    gate = F.exp(-temperature * F.abs(ratio - center))
    return F.least(F.lit(1.0), least + (1 - least) * gate)


def divergence(reference: Column, logp: Column) -> Column:
    """exp(d) - d - 1 of the difference d of two logarithms."""
    return F.exp(reference - logp) - (reference - logp) - 1


def policy_terms(tokens: DataFrame, rows: list[str], low: float = 0.2, high: float = 0.2, delta: float | None = None, beta: float = 0.0, by_sequence: bool = False, **gate: float) -> DataFrame:
    """Add ``ratio``, ``gate``, ``loss``, ``divergence``, ``low_clipped`` and ``high_clipped`` to rows of one token each.

    ``tokens`` has ``logp``, ``old_logp`` (null: as ``logp``), ``reference_logp``, ``advantage`` and ``mask`` (0 or 1). ``rows`` names the sequence a token is of: with
    ``by_sequence`` a token's ratio is that of its sequence, from the mean difference over the mask. ``gate`` goes to :func:`soft_gate`.
    """
    from pyspark.sql.window import Window

    difference = F.col("logp") - F.coalesce("old_logp", "logp")
    if by_sequence:
        whole = Window.partitionBy(*rows)
        difference = F.sum(difference * F.col("mask")).over(whole) / F.greatest(F.sum("mask").over(whole), F.lit(1))
    out = tokens.withColumn("ratio", F.exp(difference))
    clipped = F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), F.col("ratio")))
    out = out.withColumn("_clipped", clipped)
    if delta is not None:
        out = out.withColumn("ratio", F.least("ratio", F.lit(delta)))
    out = out.withColumn("gate", soft_gate(F.col("ratio"), **gate))
    soft = F.col("gate") * F.col("ratio") + (1 - F.col("gate")) * F.col("_clipped")
    apart = divergence(F.col("reference_logp"), F.col("logp")) if beta else F.lit(0.0)
    out = out.withColumn("divergence", apart).withColumn("loss", -(soft * F.col("advantage")) + beta * F.col("divergence"))
    return out.withColumns({"low_clipped": (F.col("ratio") < 1 - low) & (F.col("advantage") < 0), "high_clipped": (F.col("ratio") > 1 + high) & (F.col("advantage") > 0)}).drop("_clipped")


def policy_summary(terms: DataFrame, items: Column | None = None) -> DataFrame:
    """One row: the masked loss over ``items`` (tokens within the mask if not given), and masked means of the other terms."""
    mask = F.col("mask")
    n = F.greatest(F.sum(mask), F.lit(1))
    mean = lambda x: F.sum(x * mask) / n
    flag = lambda c: F.col(c).cast("int")
    return terms.agg(
        (F.sum(F.col("loss") * mask) / (n if items is None else items)).alias("loss"),
        mean(F.col("divergence")).alias("divergence"),
        mean(F.col("gate")).alias("gate_mean"),
        F.min("gate").alias("gate_min"),
        F.max("gate").alias("gate_max"),
        mean(flag("low_clipped")).alias("low_clip"),
        mean(flag("high_clipped")).alias("high_clip"),
        mean((F.col("low_clipped") | F.col("high_clipped")).cast("int")).alias("region_clip"),
    )
