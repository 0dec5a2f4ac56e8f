"""Queries of records, judgments, messages and checks whose rows take every branch, each beside its equivalent in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill import lexicons as L
from grainmill.functions import gates, jsonx
from grainmill.operators import records, selection, splits
from grainmill.registry import query
from grainmill.registry import table as _t

_SCORE = "(doc_id + {0}) % 8"
_BAD = ", ".join(f"CASE WHEN {_SCORE.format(k)} >= 6 THEN 'Invalid judge score: {f}' END" for k, f in enumerate(L.JUDGE_SCORES))


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'Missing object: teacher_judgment' ELSE array_to_string(list_filter([CASE WHEN doc_id % 5 >= 3 THEN 'Invalid decision' END, {_BAD},
    CASE WHEN coalesce(lang, '') IN ('', 'de') THEN 'Missing or empty field: teacher_judgment.reason' END], lambda e: e IS NOT NULL), '; ') END AS errors FROM documents"""
)
def judgment_errors(spark, sf):
    """What judgments lack: scores out of range or no numbers, unknown decisions, blank reasons, or all of it."""
    key = F.col("doc_id")
    score = lambda k: F.when((key + k) % 8 == 6, "7").when((key + k) % 8 == 7, "high").otherwise(((key + k) % 8).cast("string"))
    decision = F.when(key % 5 < 3, F.get(F.lit(list(L.JUDGE_DECISIONS)), (key % 5).cast("int"))).when(key % 5 == 3, "maybe")
    reason = F.when(F.col("lang") == "de", " \n").otherwise(F.col("lang"))
    judgment = F.struct(decision.alias("decision"), *[score(k).alias(f) for k, f in enumerate(L.JUDGE_SCORES)], reason.alias("reason"))
    raw = F.when(key % 13 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(judgment.alias("teacher_judgment"))))
    parsed = _t(spark, sf, "documents").select("doc_id", jsonx.parse(raw, jsonx.JUDGE).alias("p"))
    return parsed.select("doc_id", F.array_join(jsonx.judge_errors(F.col("p.teacher_judgment")), "; ").alias("errors"))


@query("SELECT doc_id, coalesce(lang, '?') || ' {1} ' || coalesce(source, '?') AS told, TRUE AS same FROM documents")
def caution_messages(spark, sf):
    """Messages of several templates by document: the text filled in, and the same template whenever it is asked for."""
    templates = ("One: {line_text}", "Two: {line_text}", "Three: {line_text}")
    lines = F.concat(F.coalesce("lang", F.lit("?")), F.lit(" {1} "), F.coalesce("source", F.lit("?")))
    made = gates.caution_message(F.col("doc_id").cast("string"), templates, lines)
    again = gates.caution_message((F.col("doc_id") + 0).cast("string"), templates, lines)
    return _t(spark, sf, "documents").select("doc_id", F.regexp_replace(made, "^(One|Two|Three): ", "").alias("told"), (made == again).alias("same"))


@query(
    f"""SELECT page_id, 'human|' || CASE WHEN page_id % 3 <> 0 THEN '{L.IMAGE_TAG}' || chr(10) ELSE '' END || coalesce(url, '-') || '|gpt|' || length(html) AS told FROM pages"""
)
def conversation_records(spark, sf):
    """Records of two turns, with an image or without one."""
    image = F.when(F.col("page_id") % 3 != 0, F.col("page_id").cast("string"))
    record = records.conversation_record(image, F.coalesce("url", F.lit("-")), F.length("html").cast("string"))
    return _t(spark, sf, "pages").select("page_id", F.array_join(F.flatten(F.transform(record, lambda t: F.array(t["from"], t["value"]))), "|").alias("told"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN '{L.IMAGE_TAG}' WHEN conv_id % 3 = 1 THEN '{L.VIDEO_TAG}' ELSE '' END AS tag, text FROM conversations WHERE conv_id % 5 <> 4 OR turn = 0),
    c AS (SELECT conv_id, count(*) AS n, string_agg(text, '#' ORDER BY turn) FILTER (turn > 0) AS rest, any_value(tag) AS tag FROM t GROUP BY conv_id)
    SELECT conv_id, conv_id || '_report' AS id, CASE WHEN n < 2 THEN 'fewer than two turns' END AS error,
           CASE WHEN n >= 2 THEN md5(CASE WHEN tag <> '' THEN tag || chr(10) ELSE '' END || 'Write a report.#' || rest) END AS told FROM c"""
)
def report_records(spark, sf):
    """Records turned to reports, with an image, a video or neither; those of one turn are errors."""
    key, tag = F.col("conv_id"), F.when(F.col("conv_id") % 3 == 0, L.IMAGE_TAG).when(F.col("conv_id") % 3 == 1, L.VIDEO_TAG).otherwise("")
    turns = _t(spark, sf, "conversations").where((key % 5 != 4) | (F.col("turn") == 0))
    value = F.when(F.col("turn") == 0, F.concat(tag, "text")).otherwise(F.col("text"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct(F.col("role").alias("from"), value.alias("value")).alias("of")))).alias("turns"))
    rows = held.select("conv_id", F.col("conv_id").alias("id"), F.transform("turns", lambda t: t["of"]).alias("conversations"))
    out = records.report_mode(rows, "Write a report.")
    return out.select("conv_id", "id", "error", F.md5(F.array_join(F.transform("conversations", lambda t: t["value"]), "#").cast("binary")).alias("told"))


_SPREAD = "(doc_id % 5) * 10.0 + (n_chars % 7) * 3.0 + least(n_chars % 29, 12) * 0.5 + least(doc_id % 13, 8) * 0.75 + CASE WHEN doc_id % 5 >= 3 THEN 4.0 ELSE 0 END + CASE WHEN n_chars % 7 >= 4 THEN 2.0 ELSE 0 END"


@query(
    f"""WITH s AS (SELECT doc_id, source, ({_SPREAD})::DOUBLE AS score FROM documents WHERE n_chars IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM s) SELECT doc_id, source, score FROM r WHERE r <= 7 ORDER BY score DESC, doc_id LIMIT 60"""
)
def challenge_spread_top(spark, sf):
    """The best by scores that differ, a few of each source."""
    key, n = F.col("doc_id"), F.col("n_chars")
    score = selection.challenge_score(key % 5, n % 7, n % 29, key % 13).cast("double")
    rows = _t(spark, sf, "documents").where(n.isNotNull()).select("doc_id", "source", score.alias("score"))
    return selection.top(rows, "source", [F.desc("score"), "doc_id"], 7, 60)


_SPLIT = "CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END"


@query(
    f"""WITH o AS (SELECT o_custkey, {_SPLIT} AS split FROM orders), p AS (SELECT * FROM (VALUES ('train', 'val'), ('test', 'train'), ('test', 'val')) t(a, b))
    SELECT a, b, (SELECT count(*) FROM (SELECT o_custkey FROM o WHERE split = p.a INTERSECT SELECT o_custkey FROM o WHERE split = p.b)) AS shared FROM p"""
)
def leaky_split_check(spark, sf):
    """A split by order, not by customer: customers that two splits have in common."""
    split = F.when(F.col("o_orderkey") % 10 < 8, "train").when(F.col("o_orderkey") % 10 == 8, "val").otherwise("test")
    return splits.leakage(_t(spark, sf, "orders").withColumn("split", split), "o_custkey")
