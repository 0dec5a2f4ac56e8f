"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's target is its share of all words by weight, but at most ``most_epochs`` times its own size;
what a capped source cannot take is shared again by weight. Slots of ``block`` words are dealt to sources
by mapping the points of the golden-ratio sequence through the cumulative target weights, so every stretch of
the schedule has each source in proportion. A source's documents are shuffled by a seeded hash
and its words cut into blocks of equal size; the r-th slot of a source takes its r-th block, beginning anew
after the last one. The last slot of a source is cut so that it takes its target to the word.

All of it is joins, windows and sums of columns. A block's position comes from sums over hash buckets and a
slot's rank from sums over stretches of the schedule, so no window grows with a source; a source that holds a
third of all rows only has more buckets' worth of rows.

Null and blank texts have size 0 and are never taken. The null source comes last. Repeated rows are
rows of their own. Very long documents span blocks. Other columns are carried only where asked for, under whatever name. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill import scratch
from grainmill.functions.lang import word_count, words
from grainmill.operators.ranking import running_total, running_total_by_hash

BLOCK = 1024
WEIGHTS = (1.0, 2.0, 3.0)
MOST_EPOCHS = 3
#: Consecutive slots among which slots of a source are ranked by one window.
STRETCH = 4096
GOLDEN = (sqrt(5) - 1) / 2
_BEFORE = (Window.unboundedPreceding, -1)


def golden_point(i: Column) -> Column:
    """Fractional part of (i + 1) times the golden ratio, from two products so that it stays exact to 1e-10."""
    high, low = F.shiftright(i + 1, 16), (i + 1).bitwiseAND(65535)
    x = high * F.lit(65536 * GOLDEN - floor(65536 * GOLDEN)) + low * F.lit(GOLDEN)
    return x - F.floor(x)


@dataclass(frozen=True)
class Mix:
    """``documents``: one row each of the input, ``row_id``, ``source_size``, ``target`` and ``taken`` among its columns.
    ``takes``: the schedule's content, ``slot``, ``row_id``, ``epoch``, ``start`` and ``length`` in words of the document."""

    documents: DataFrame
    takes: DataFrame


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``ordinal``, ``weight`` and ``target`` from sizes by ``source``.

    ``weights`` repeat over the sources in code-point order, null last. Each round caps the sources above
    their limit; rounds end when none is, which takes no more rounds than there are distinct weights per size.
    """
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_total(named.withColumn("_null", F.col("source").isNull()), ["_null", "source"], {"ordinal": F.lit(1).cast("long")}, "sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("ordinal"), F.lit(len(weights))).cast("int"))
    ranked = scratch.materialize(ranked.drop("_null").withColumn("weight", weight), "sources")
    limit = most_epochs * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    scale = 0.0
    while True:
        capped = limit <= scale * F.col("weight")
        row = ranked.agg(F.sum(F.when(capped, limit).otherwise(0)).alias("fixed"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        new = (total - row["fixed"]) / row["free"] if row["free"] else scale
        if new <= scale:
            break
        scale = new
    return ranked.withColumn("target", F.least(limit.cast("double"), F.lit(scale) * F.col("weight")))


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot``, ``ordinal`` of the source, and ``rank`` of the slot among those of its source.

    ``plan`` has ``ordinal`` and ``slots``, the number each source needs. Points of the sequence give a source
    its number to within the sequence's discrepancy; ranks it lacks follow after the last slot.
    """
    spark = plan.sparkSession
    row = plan.agg(F.sum("slots").alias("n"), F.count("*").alias("sources")).first()
    n, cells = row["n"] or 0, max(1024, 4 * row["sources"])
    ends = running_total(plan.select("ordinal", "slots").where("slots > 0"), ["ordinal"], {"low": F.col("slots")}, "slots")
    ends = ends.select("ordinal", "slots", (F.col("low") / F.lit(float(max(n, 1)))).alias("low"), ((F.col("low") + F.col("slots")) / F.lit(float(max(n, 1)))).alias("high"))
    # A source's interval meets a few cells of an even grid, which makes the lookup an equality join.
    grid = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1).cast("long")))))
    points = spark.range(n).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    dealt = points.join(grid, "cell").where("u >= low AND u < high").select("slot", "ordinal", "slots")
    dealt = scratch.materialize(dealt.withColumn("stretch", F.floor(F.col("slot") / STRETCH)), "schedule")
    sums = dealt.groupBy("ordinal", "stretch").agg(F.count("*").alias("n"))
    sums = sums.select("ordinal", "stretch", F.coalesce(F.sum("n").over(Window.partitionBy("ordinal").orderBy("stretch").rowsBetween(*_BEFORE)), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("n", F.row_number().over(Window.partitionBy("ordinal", "stretch").orderBy("slot")) - 1).join(sums, ["ordinal", "stretch"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("n")).where("rank < slots").select("slot", "ordinal", "rank")
    got = dealt.groupBy("ordinal").agg(F.count("*").alias("got"))
    lacking = plan.join(got, "ordinal", "left").where("slots > coalesce(got, 0)")
    lacking = lacking.select("ordinal", F.explode(F.expr("sequence(coalesce(got, 0), slots - 1)")).alias("rank"))
    return ranked.unionByName(lacking.select((F.lit(n) + F.col("rank")).alias("slot"), "ordinal", "rank"))


def mix(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    block: int = BLOCK,
    seed: int = 11,
    carry: tuple[str, ...] = ("doc_id",),
    shuffle_by: tuple[str, ...] = ("doc_id",),
) -> Mix:
    """Take words of ``docs`` until every source has its target.

    ``carry`` names columns to keep; ``shuffle_by``, with the text, is what the shuffle hashes.
    """
    rows = docs.select(*[F.col(c).alias(f"c_{c}") for c in carry], F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), *shuffle_by, text_col).alias("hash"))
    rows = scratch.materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "sized")
    plan = targets(rows, weights, most_epochs)
    quota = F.floor(F.col("target") + 0.5).cast("long")
    plan = plan.withColumn("quota", F.when(F.col("source_size") > 0, quota).otherwise(F.lit(0).cast("long")))
    blocks = F.ceil(F.col("source_size") / block)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0)
    rest = F.col("quota") - F.col("whole") * F.col("source_size")
    plan = plan.withColumn("blocks", blocks).withColumn("whole", whole).withColumn("slots", F.col("whole") * F.col("blocks") + F.ceil(rest / block))
    plan = scratch.materialize(plan, "mix-plan")

    rows = rows.join(plan.select("source", "ordinal", "source_size", "target"), rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    placed = running_total_by_hash(rows.where("size > 0").select("row_id", "ordinal", "hash", "size"), "ordinal", "hash", "row_id", "size", "at", rows.count())
    parts = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    low, high = F.greatest(F.col("block") * block, F.col("at")), F.least((F.col("block") + 1) * block, F.col("at") + F.col("size"))
    parts = parts.select("row_id", "ordinal", "block", (low - F.col("at")).alias("start"), (low - F.col("block") * block).alias("low"), (high - F.col("block") * block).alias("high"))

    slots = schedule(plan, block).join(plan.select("ordinal", "blocks", "source_size", "quota"), "ordinal")
    epoch = F.floor(F.col("rank") / F.col("blocks"))
    slots = slots.withColumn("epoch", epoch).withColumn("block", F.col("rank") - F.col("epoch") * F.col("blocks"))
    room = F.col("quota") - F.col("epoch") * F.col("source_size") - F.col("block") * block
    slots = slots.select("slot", "ordinal", "epoch", "block", room.alias("room"))
    takes = slots.join(parts, ["ordinal", "block"]).withColumn("length", F.least("high", "room") - F.col("low"))
    takes = scratch.materialize(takes.where("length > 0").select("slot", "row_id", "epoch", "start", "length"), "takes")

    taken = takes.groupBy("row_id").agg(F.sum("length").alias("taken"))
    documents = rows.join(taken, "row_id", "left").select("row_id", *[F.col(f"c_{c}").alias(c) for c in carry], "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    return Mix(documents, takes)


def apply(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The mix as documents: a row for each epoch in which a document is taken, with the columns of ``docs``.

    A document that its source's last slot cuts short keeps the words taken, joined by single spaces.
    """
    keyed = scratch.materialize(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("copy")), "mix-input")
    source_col = options.pop("source_col", "source")
    found = mix(keyed, text_col=f"row.`{text_col}`", source_col=f"row.`{source_col}`", carry=("copy",), shuffle_by=(f"row.`{id_col}`",), **options)
    spans = found.takes.groupBy("row_id", "epoch").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    spans = spans.join(found.documents.select("row_id", "copy", "size"), "row_id").select("copy", F.struct("start", "length", "size").alias("span"))
    out, span, row = keyed.join(spans, "copy"), F.col("span"), F.col("row")
    part = F.array_join(F.slice(words(row[text_col]), (span["start"] + 1).cast("int"), span["length"].cast("int")), " ")
    cut = F.when(span["length"] == span["size"], row[text_col]).otherwise(part)
    columns = [cut.alias(c) if c == text_col else F.length(cut).cast("long").alias(c) if c == "n_chars" else row[c].alias(c) for c in docs.columns]
    return out.select(*columns)


def digest(found: Mix) -> DataFrame:
    return found.documents.select("doc_id", "size", "source_size", "target", "taken")
