"""Queries that run streams in several goes, each beside its equivalent in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill import scratch
from grainmill.operators import genlog
from grainmill.registry import query
from grainmill.registry import table as _t
from grainmill.streaming import history, restart, rollup


@query(
    """WITH w AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS go FROM documents)
    SELECT doc_id, min(length(coalesce(text, '')))::INT AS n, CASE WHEN min(go) = 1 OR min(doc_id) % 7 = 0 THEN 1 ELSE 0 END::INT AS go, 1::BIGINT AS times FROM w WHERE doc_id IS NOT NULL GROUP BY doc_id"""
)
def restarted_log(spark, sf):
    """A log worked off, appended to with repeats, and worked off again from the same checkpoint after a stop in mid-batch.

    In the first go, documents whose id seven divides fail, so that only the second go finishes them.
    """
    folder, store, checkpoint = (scratch.new_path(spark, f"restart-{x}") for x in ("in", "store", "checkpoint"))
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    result, schema = "ok", "doc_id long, n int, status string, go int"

    class Stopped(Exception):
        pass

    def go(k: int, stop: bool) -> None:
        def make(rows):
            status = F.when((F.lit(k) == 0) & (F.col("doc_id") % 7 == 0), F.lit("error")).otherwise(F.lit(result))
            return rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), status.alias("status"), F.lit(k).alias("go"))

        def after(number: int) -> None:
            if stop:
                raise Stopped

        log = rollup.read_log(spark, folder, "doc_id long, text string", files_per_batch=2)
        run = restart.work_off(log, store, checkpoint, make, schema, "doc_id", "text", done=F.col("status") == result, after=after)
        try:
            run.awaitTermination()
        except Exception:
            if not stop:
                raise

    docs.where(F.col("doc_id") % 3 != 0).repartition(4, "doc_id").write.mode("append").json(folder)
    go(0, stop=True)  # its first batch is written but not known to the checkpoint
    go(0, stop=False)
    again = docs.where((F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 5 == 0) | (F.col("doc_id") % 7 == 0))
    again.repartition(4, "doc_id").write.mode("append").json(folder)
    go(1, stop=True)
    go(1, stop=False)
    ok = restart.finished(spark, store, schema).where(F.col("status") == result)
    return ok.groupBy("doc_id").agg(F.min("n").alias("n"), F.min("go").alias("go"), F.count("*").alias("times"))


@query(
    r"""WITH t AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS question FROM conversations WHERE turn IS NOT NULL AND role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT conv_id, turn, question, text AS answer FROM t WHERE role = 'assistant' AND before = 'user' AND trim(coalesce(question, ''), ' ' || chr(10) || chr(9) || chr(13)) <> '')
    SELECT c.conv_id, count(p.turn)::INT AS n, md5(coalesce(string_agg(question || '|' || coalesce(answer, '-'), '#' ORDER BY p.turn), '')) AS told
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN p ON c.conv_id = p.conv_id GROUP BY c.conv_id"""
)
def streamed_history(spark, sf):
    """Every conversation's history, of turns that arrive in three goes with the last ones sent again, from state kept between them."""
    folder, out, checkpoint = (scratch.new_path(spark, f"history-{x}") for x in ("in", "out", "checkpoint"))
    turns = _t(spark, sf, "conversations")
    for first, last in ((0, 2), (2, 5), (4, 1 << 40)):
        turns.where((F.col("turn") >= first) & (F.col("turn") <= last)).write.mode("append").json(folder)
        log = rollup.read_log(spark, folder, "conv_id long, turn long, role string, text string")
        told = history.follow(log, "conv_id")
        writer = told.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/of={n}"))
        writer.trigger(availableNow=True).start().awaitTermination()
    told = genlog.latest(spark.read.parquet(out).drop("of"), "conv_id", "batch")
    pairs = F.transform("history", lambda p: F.concat(p["question"], F.lit("|"), F.coalesce(p["answer"], F.lit("-"))))
    return told.select("conv_id", F.size("history").alias("n"), F.md5(F.array_join(pairs, "#").cast("binary")).alias("told"))
