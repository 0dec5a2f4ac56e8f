"""JSON arrays of any size, read and written by many tasks.

Reading does not need the array in one place. The text reader cuts files at closing braces, within its ordinary splits, and an object is put together from its
fragments. Whether a fragment begins within a string, how deep it is nested, and which object it belongs to are
sums over what comes before it: of quotes, of braces outside of strings, and of braces that close an object of the array. Each is summed within a split
and, a row a split, over the splits before.

Writing sorts the rows by ranges once, with a row for the closing bracket after them; the files of the folder, in the order of
their names, are one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill import scratch
from grainmill.operators.ranking import running_total

_SPLIT = ["file", "block"]


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _before(splits: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the splits before."""
    return running_total(splits, _SPLIT, {out: F.col(value)}, "json-splits").select(F.col("file").alias("in_file"), F.col("block").alias("in_block"), out)


def _with(rows: DataFrame, before: DataFrame) -> DataFrame:
    same = (F.col("file") == F.col("in_file")) & (F.col("block") == F.col("in_block"))
    return rows.join(before, same).drop("in_file", "in_block")


def scan_objects(spark: SparkSession, path: str) -> DataFrame:
    """``place`` (from 0) and ``object`` (its JSON) of each object in an array that is one file, or the files of a folder by name.

    Elements of the array that are not objects are left out. A file holds whole objects; one object must fit a task.
    """
    within = Window.partitionBy(*_SPLIT).orderBy("n")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    rows = rows.withColumn("n", F.monotonically_increasing_id()).withColumn("bare", F.regexp_replace("value", r"(?s)\\.", "")).withColumn("quotes", _count(F.col("bare"), '"').cast("long"))
    splits = scratch.materialize(rows.groupBy(*_SPLIT).agg(F.sum("quotes").alias("quotes"), F.max("n").alias("last"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size")), "json-splits")
    # What follows a file's last brace is a fragment that no brace ends.
    ends = splits.groupBy("file").agg(F.max(F.struct("block", "last")).alias("end"), F.sum("bytes").alias("bytes"), F.max("size").alias("size")).where("bytes > size")
    ends = ends.select(F.col("file").alias("in_file"), F.col("end.block").alias("in_block"), F.col("end.last").alias("tail"))
    starts = _before(splits, "quotes", "quotes_before").join(ends, ["in_file", "in_block"], "left")

    rows = _with(rows, starts).withColumn("quoted", (F.col("quotes_before") + F.coalesce(F.sum("quotes").over(earlier), F.lit(0))) % 2 == 1)
    outside = F.regexp_replace(F.concat(F.when(F.col("quoted"), '"').otherwise(""), "bare"), '"[^"]*("|$)', "")
    closes = (F.col("quoted").cast("int") + F.col("quotes")) % 2 == 0
    closes = closes & ~F.coalesce(F.col("n") == F.col("tail"), F.lit(False))
    rows = rows.withColumns({"closes": closes, "change": (_count(outside, "{") - closes.cast("int")).cast("long")}).withColumn("depth", F.sum("change").over(so_far))
    ended = F.when(closes | ~F.coalesce(F.col("n") == F.col("tail"), F.lit(False)), F.concat("value", F.lit("}"))).otherwise(F.col("value"))
    rows = scratch.materialize(rows.select(*_SPLIT, "n", ended.alias("value"), "closes", "change", "depth"), "json-fragments")

    depths = _before(rows.groupBy(*_SPLIT).agg(F.sum("change").alias("change")), "change", "depth_before")
    rows = _with(rows, depths).withColumn("ends", (F.col("closes") & (F.col("depth") + F.col("depth_before") == 0)).cast("long"))
    rows = rows.withColumn("ends_before", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    # Fragments of one split and object together first; an object that several splits share is joined across them.
    pieces = rows.groupBy(*_SPLIT, "ends_before").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "").alias("text"), F.sum("ends").alias("ends"))
    pieces = scratch.materialize(pieces, "json-pieces")
    objects = _before(pieces.groupBy(*_SPLIT).agg(F.sum("ends").alias("ends")), "ends", "objects_before")
    whole = _with(pieces, objects).groupBy((F.col("objects_before") + F.col("ends_before")).alias("place"))
    whole = whole.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_SPLIT, "text"))), lambda x: x["text"]), "").alias("text"), F.max("ends").alias("ends"))
    return whole.where("ends > 0").select("place", F.regexp_extract("text", r"(?s)^[^{]*(\{.*)$", 1).alias("object"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of an array as rows of the ``schema``, with their ``place``; an object that does not parse is an error."""
    found = scan_objects(spark, path)
    return found.select("place", F.from_json("object", schema, {"mode": "FAILFAST"}).alias("of")).select("place", "of.*")


def write_json_array(df: DataFrame, path: str, order: Sequence[str], mode: str = "errorifexists") -> None:
    """The rows in order as one array in a folder of files, a row a line. ``order`` should tell rows apart; nulls come first.

    Rows are dealt out by ranges and sorted once. The first row is the first of its range among those with the least key; the closing bracket is a row
    after all others. So the columns of ``order`` must be the same whenever ``df`` is computed.
    """
    names = [f"by{k}" for k in range(len(order))]
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)], F.lit(0).alias("end"))
    least = rows.agg(F.min(F.struct(*names)).alias("least"))
    if not rows.take(1):
        df.sparkSession.createDataFrame([("[]",)], "value string").write.mode(mode).text(path)
        return
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    closing = df.sparkSession.range(1).select(F.lit("]").alias("value"), *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in names], F.lit(1).alias("end"))
    dealt = rows.unionByName(closing).repartitionByRange(parts, "end", *names).sortWithinPartitions("end", *names)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # within the range
    dealt = dealt.withColumn("place", place).crossJoin(F.broadcast(least))  # one row
    opens = (F.col("place") == 0) & F.struct(*names).eqNullSafe(F.col("least"))
    text = F.concat(F.when(F.col("end") == 1, "").when(opens, "[").otherwise(","), "value")
    dealt.select(text.alias("value")).write.mode(mode).text(path)
