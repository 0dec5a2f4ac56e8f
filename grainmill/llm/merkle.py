"""Merkle manifest of a dataset: a root over all rows, a subroot for each group, and a proof for each row.

A leaf is the digest of a row's fields. Within a group, leaves stand in order and every ``FAN`` consecutive nodes become their
digest, level by level, until one is left, the group's subroot; the subroots, in the order of their groups, become the
root in the same way. Digests are lowercase hex SHA-256 of the joined hex texts of what they cover.

The work is done in blocks: arrays of at most ``FAN ** LEVELS`` ordered nodes of one group. Within a block, higher-order
functions collapse ``LEVELS`` levels at once (``sequence`` numbers the runs, ``slice`` cuts them, ``transform`` digests each,
``aggregate`` goes from level to level); the blocks' roots are the nodes of the next round, a table ``FAN ** LEVELS`` times smaller.
Proofs come down the same tables: a block hands its own siblings to its nodes. So a group with a third of all rows is many
blocks, and ranks come from ranges (:mod:`grainmill.operators.ranking`), not from a window over a group. Each round's blocks are a
written table. Nothing but a number, the size of the largest group, goes to the driver.

A null group is a group of its own and comes first, as do null orders; groups and orders are compared as Spark does, strings by their bytes. Rows with the same
place in the order stand by their leaves, and equal rows side by side, each with a proof of its own. A null field, a null text
and an empty one give different leaves. A table without rows has no root and gives no proofs. Columns of any
name are carried whole in a struct, so none clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill import scratch
from grainmill.operators.ranking import running_total

FAN = 16
#: Levels that a block collapses at once: 4,096 nodes, some 270 KB of digests.
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the parts, joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A field as a leaf covers it: ``-`` for null, else its number of UTF-8 bytes, ``:`` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*[field(c) for c in fields])


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _collapse(nodes: Column, fan: int) -> Column:
    """The level above: a digest for each run of ``fan`` nodes, also for a run of one."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan).cast("int"))
    return F.transform(runs, lambda r: digest(_joined(F.slice(nodes, r * fan + 1, fan))))


def _ranked(rows: DataFrame) -> DataFrame:
    """``pos`` (from 0) and ``n`` within ``group`` by ``order`` and ``node``, beside ``group``, ``node`` and ``row``."""
    ranked = scratch.materialize(running_total(rows, ["group", "order", "node"], {"rank": F.lit(1)}, "merkle-ranges"), "merkle-ranks")
    groups = ranked.groupBy(F.col("group").alias("own")).agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    return ranked.join(groups, F.col("group").eqNullSafe(F.col("own"))).select("group", (F.col("rank") - F.col("first")).alias("pos"), "n", "node", "row")


def _climb(nodes: DataFrame, fan: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds' blocks, lowest first, and a ``root`` for each ``group``.

    ``nodes`` has ``group``, ``pos``, ``n`` (nodes of the group), ``node`` and ``row``.
    """
    size, rounds = fan**levels, []
    block = F.floor(F.col("pos") / size).cast("long")
    while True:
        held = F.array_sort(F.collect_list(F.struct("pos", "node", "row"))).alias("held")
        blocks = nodes.groupBy("group", block.alias("block"), "n").agg(held)
        # Levels until one node of the group is left, but no more than a block has.
        deep = sum((F.when(F.col("n") > fan**k, 1).otherwise(0) for k in range(levels)), F.lit(0))
        first = F.array(_collapse(F.transform("held", lambda h: h["node"]), fan))
        further = F.when(deep > 1, F.sequence(F.lit(2), deep)).otherwise(F.array().cast("array<int>"))
        up = F.aggregate(further, first, lambda a, _: F.concat(a, F.array(_collapse(F.element_at(a, -1), fan))))
        blocks = scratch.materialize(blocks.withColumn("levels", F.when(deep > 0, up).otherwise(F.array().cast("array<array<string>>"))), f"merkle-blocks-{len(rounds)}")
        rounds.append(blocks)
        root = F.when(F.size("levels") > 0, F.element_at(F.element_at("levels", -1), 1)).otherwise(F.col("held")[0]["node"])
        roots = blocks.select("group", F.col("block").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), root.alias("node"), F.lit(None).cast("string").alias("row"))
        if (blocks.agg(F.max("n")).first()[0] or 0) <= size:
            return rounds, roots.select("group", F.col("node").alias("root"))
        nodes = roots


def _step(nodes: Column, at: Column) -> Column:
    """What stands left and right of place ``at`` in a run."""
    return F.named_struct(F.lit("left"), _joined(F.slice(nodes, F.lit(1), at)), F.lit("right"), _joined(F.slice(nodes, at + 2, F.size(nodes))))


def _descend(rounds: list[DataFrame], above: DataFrame, fan: int, levels: int) -> DataFrame:
    """``group``, ``node``, ``row``, ``top`` and ``steps`` of each lowest node.

    ``above`` has ``steps`` from a group's root up, and ``top``, for each ``group``.
    """
    upper = above.select(F.col("group").alias("own"), F.lit(0).cast("long").alias("place"), "top", "steps")
    for k, blocks in reversed(list(enumerate(rounds))):
        joined = blocks.join(upper, F.col("group").eqNullSafe(F.col("own")) & (F.col("block") == F.col("place")))
        # The nodes of a run have all but their first step in common.
        number = F.sequence(F.lit(0), F.floor((F.size("held") - 1) / fan).cast("int"))
        runs = joined.select("group", "top", "steps", "levels", F.posexplode(F.transform(number, lambda r: F.slice("held", r * fan + 1, fan))).alias("run", "held"))
        shared = [F.col("steps")]
        for level in range(levels - 1, 0, -1):
            at = F.floor(F.col("run") / fan ** (level - 1)).cast("int")  # the place among the nodes of this level
            own = F.array(_step(F.slice(F.col("levels")[level - 1], F.floor(at / fan).cast("int") * fan + 1, fan), F.pmod(at, F.lit(fan))))
            shared.insert(0, F.when(F.size("levels") > level, own).otherwise(F.array().cast(STEPS)))
        runs = runs.select("group", "top", (F.size("levels") > 0).alias("runs"), F.concat(*shared).alias("steps"), F.transform("held", lambda h: h["node"]).alias("nodes"), F.posexplode("held").alias("at", "it"))
        steps = F.when(F.col("runs"), F.concat(F.array(_step(F.col("nodes"), F.col("at"))), F.col("steps"))).otherwise(F.col("steps"))
        each = runs.select("group", F.col("it.pos").alias("place"), "top", "it.node", "it.row", steps.alias("steps"))
        if k:
            upper = scratch.materialize(each.select(F.col("group").alias("own"), "place", "top", "steps"), f"merkle-steps-{k}")
        else:
            return each.select("group", "node", "row", "top", "steps")


def prove(rows: DataFrame, leaf_col: str, group_col: str, order_col: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """The other columns of ``rows`` in a struct ``row``, with ``leaf``, ``subroot``, ``root`` and ``steps``.

    ``steps`` are the proof from the leaf to the root: for each level the digests to the ``left`` and ``right`` of the own
    node within its run, joined. A level at which the node is alone in its run has a step of two empty texts; a group of one leaf
    has no level of its own. Columns that ``rows`` carries must be of types that Spark can compare.
    """
    leaves = rows.select(F.col(group_col).alias("group"), F.col(order_col).alias("order"), F.col(leaf_col).alias("node"), F.struct(*[c for c in rows.columns if c != leaf_col]).alias("row"))
    rounds, subroots = _climb(_ranked(leaves), fan, levels)
    tops = subroots.select(F.lit(0).alias("group"), F.col("group").alias("order"), F.col("root").alias("node"), F.struct(F.col("group").alias("group"), F.col("root").alias("subroot")).alias("row"))
    top_rounds, root = _climb(_ranked(tops), fan, levels)
    above = _descend(top_rounds, root.select("group", F.col("root").alias("top"), F.array().cast(STEPS).alias("steps")), fan, levels)
    above = above.select("row.group", F.struct("row.subroot", F.col("top").alias("root")).alias("top"), "steps")
    out = _descend(rounds, above, fan, levels)
    return out.select("row", F.col("node").alias("leaf"), "top.subroot", "top.root", "steps")


def proof_digest(steps: Column) -> Column:
    """H of the siblings from leaf to root, left to right within a level."""
    return digest(_joined(F.transform(steps, lambda s: F.concat(s["left"], s["right"]))))


def fold(node: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(steps, node, lambda h, s: digest(s["left"], h, s["right"]))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` and whether each row, tampered with where five divides its id's CRC-32, still verifies."""
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    changed = leaf(*own[:4], F.translate("text", UPPER, LOWER))
    rows = docs.select("doc_id", "source", leaf(*own).alias("leaf"), F.when(tampered, changed).alias("claimed"))
    proved = prove(rows, "leaf", "source", "doc_id")
    folded = proved.select("row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), fold(F.coalesce("row.claimed", "leaf"), F.col("steps")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
