"""An append-only log worked off by a stream that may stop anywhere and start again.

Each micro-batch leaves out the ids that earlier batches finished and writes its results to a folder of its own in the store, named by the
batch's number. The stream's checkpoint knows which files a batch has; a batch that was cut off, even after its results were written, runs
again under its number over the same files, reads only what earlier batches finished, and replaces its own folder. So every id is finished
once, whenever the stream stops, and ids that come again later are left out.

The store is keyed by batch, so that a look-up reads one column of it, and joins by id as Spark sees fit. Rows without an id are never
finished and are made each time they come. Within a batch the first row by ``order`` counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainmill.operators import genlog


def _make_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)


def finished(spark: SparkSession, store: str, schema: str, before: int | None = None) -> DataFrame:
    """Results in the store with their ``batch``; those of batches ``before`` one, if it is given."""
    _make_folder(spark, store)
    found = spark.read.schema(f"{schema}, batch long").option("basePath", store).parquet(store)
    return found if before is None else found.where(F.col("batch") < before)


def work_off(
    log: DataFrame, store: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], schema: str, id_col: str, order: str, done: Column | None = None, after: Callable[[int], None] | None = None
) -> StreamingQuery:
    """Start the stream over the rows that are there; ``make`` turns rows into results of the ``schema``, which has the id.

    Results that ``done`` does not admit are kept but not finished: their ids are made again when they come again. ``after`` is called when a batch's
    results are written, before the checkpoint knows of it.
    """
    spark = log.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        had = finished(rows.sparkSession, store, schema, number)
        named = rows.where(F.col(id_col).isNotNull())
        first = named.groupBy(id_col).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("row")).select("row.*")
        _, pending = genlog.resume(first, had if done is None else had.where(done), id_col)
        made = make(pending.unionByName(rows.where(F.col(id_col).isNull())))
        made.write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={number}")
        if after:
            after(number)

    _make_folder(spark, store)
    return log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
