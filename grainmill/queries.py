"""Queries of the core library over the driver's tables, each beside its equivalent in SQL.

The tables stand in for the records of the domain: line items for scored images, orders for clustered
records, documents for reports, events for a generation log. Word lists are English where texts are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill import lexicons as L
from grainmill.functions import gates, jsonx, rewards, text
from grainmill.operators import genlog, metrics, quality, records, selection, splits
from grainmill.operators.ranking import floor_quantiles
from grainmill.queries_reports import _WS, _strip
from grainmill.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from grainmill.registry import table as _t
from grainmill.session import spread

def _terms(terms: tuple[str, ...], column: str = "text") -> str:
    return " + ".join(f"((length({column}) - length(replace({column}, '{t}', ''))) // {len(t)})" for t in terms)


def _any(terms: tuple[str, ...], column: str = "text") -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


# English stand-ins for the domain's word lists.
DOUBT = ("the", "tion", "of ")
CAREFUL = ("ing ", "and ")
AGAIN = ("idiot", "!!")
GROUPS = (("the",), ("of",), ("and", "with"), ("is", "to"), ("for",))
LINES = {"the": ("the",), "of": ("of",), "and": ("and", "with")}
SIGNALS = ("(the|of).{0,4}(th|er)", "[A-Z][a-z]+,")

# Curation.

_SCORED = """
    m AS (SELECT *, l_extendedprice AS sharpness, l_quantity AS contrast, l_discount AS entropy, l_tax * 2000 AS brightness FROM lineitem),
    r AS (SELECT *, cume_dist() OVER (ORDER BY sharpness) AS rs, cume_dist() OVER (ORDER BY contrast) AS rc, cume_dist() OVER (ORDER BY entropy) AS re FROM m),
    s AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, 0.60::DOUBLE * rs + 0.25::DOUBLE * rc + 0.15::DOUBLE * re
                 - 0.12::DOUBLE * least(1::DOUBLE, abs(brightness - 128::DOUBLE) / 128::DOUBLE))) AS q FROM r),
    f AS (SELECT (SELECT q FROM (SELECT q, row_number() OVER (ORDER BY q) AS n FROM s)
                  WHERE n = 1 + floor(0.45::DOUBLE * ((SELECT count(*) FROM s) - 1))::BIGINT) AS qf,
                 (SELECT sharpness FROM (SELECT sharpness, row_number() OVER (ORDER BY sharpness) AS n FROM s)
                  WHERE n = 1 + floor(0.40::DOUBLE * ((SELECT count(*) FROM s) - 1))::BIGINT) AS sf),
    k AS (SELECT *, row_number() OVER w - 1 AS i, first_value(q) OVER w AS best FROM s
          WINDOW w AS (PARTITION BY l_orderkey ORDER BY q DESC, sharpness DESC, contrast DESC, l_linenumber, l_partkey, l_suppkey)),
    x AS (SELECT k.*, list_filter([
              CASE WHEN brightness < 45 THEN 'too_dark' END, CASE WHEN brightness > 215 THEN 'too_bright' END,
              CASE WHEN q < qf THEN 'below_quality_floor' END, CASE WHEN sharpness < sf THEN 'below_sharpness_floor' END,
              CASE WHEN i >= 2 THEN 'cluster_quota_exceeded' END,
              CASE WHEN i > 0 AND q < best * 0.88::DOUBLE THEN 'cluster_relative_quality_low' END], lambda v: v IS NOT NULL) AS reasons
          FROM k, f),
    c AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'clean' ELSE 'hard_case' END AS bucket,
                 CASE WHEN len(reasons) = 0 THEN (sum(CASE WHEN len(reasons) = 0 THEN 1 ELSE 0 END) OVER (
                     PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INT END AS cluster_rank FROM x)"""


def _curated(spark: SparkSession, sf: str) -> DataFrame:
    items = _t(spark, sf, "lineitem").select(
        *("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        F.col("l_extendedprice").alias("sharpness"),
        F.col("l_quantity").alias("contrast"),
        F.col("l_discount").alias("entropy"),
        (F.col("l_tax") * 2000).alias("brightness"),
    )
    return quality.curate(spread(items), ["l_linenumber", "l_partkey", "l_suppkey"], cluster="l_orderkey")


@query(
    f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, l_partkey, round(q, 9) AS quality_score, bucket AS quality_bucket, "
    "array_to_string(reasons, ',') AS reasons, cluster_rank FROM c"
)
def quality_curate(spark, sf):
    return _curated(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("quality_score", 9).alias("quality_score"), "quality_bucket", F.array_join("reject_reasons", ",").alias("reasons"), "cluster_rank"
    )


@query(f"WITH {_SCORED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM c) GROUP BY reason")
def reject_reason_counts(spark, sf):
    return quality.reason_counts(_curated(spark, sf))


@query(f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, l_partkey, cluster_rank FROM c WHERE bucket = 'clean'")
def cluster_rank_clean(spark, sf):
    return _curated(spark, sf).where("quality_bucket = 'clean'").select("l_orderkey", "l_linenumber", "l_partkey", "cluster_rank")


@query(
    f"WITH {_SCORED}, d AS (SELECT CASE WHEN list_has_any(reasons, ['below_quality_floor','below_sharpness_floor','too_dark','too_bright']) "
    "THEN 'retake' ELSE 'cautious' END AS gate_decision FROM c WHERE bucket = 'hard_case') SELECT gate_decision, count(*) AS n FROM d GROUP BY gate_decision"
)
def gate_label_from_reasons(spark, sf):
    hard = _curated(spark, sf).where("quality_bucket = 'hard_case'")
    alike = hard.groupBy("reject_reasons").agg(F.count("*").alias("m"))  # few sets of reasons, many rows
    return alike.select(gates.from_reasons(F.col("reject_reasons")).alias("gate_decision"), "m").groupBy("gate_decision").agg(F.sum("m").alias("n"))


@query(
    f"WITH {_SCORED}, e AS (SELECT *, unnest(CASE WHEN len(reasons) = 0 THEN ['__none__'] ELSE reasons END) AS reason FROM c) "
    "SELECT reason, count(*) AS samples, round(avg((q < 0.5)::INT), 9) AS low_confidence_rate, round(avg((brightness < 128)::INT), 9) AS gate_retake_rate FROM e GROUP BY reason"
)
def hard_summary_by_reason(spark, sf):
    flags = {"low_confidence_rate": F.col("quality_score") < 0.5, "gate_retake_rate": F.col("brightness") < 128}
    out = metrics.summary_by_reason(_curated(spark, sf), "reject_reasons", flags)
    return out.select("reason", "samples", *[F.round(f, 9).alias(f) for f in flags])


@query("SELECT size, count(*) AS clusters FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size ORDER BY clusters DESC, size LIMIT 10")
def cluster_size_histogram(spark, sf):
    return quality.cluster_size_histogram(_t(spark, sf, "lineitem"), "l_orderkey")


@query(
    """WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS n, count(*) OVER () AS c FROM orders)
    SELECT q, v AS value FROM o, (SELECT unnest([0.1::DOUBLE, 0.4::DOUBLE, 0.45::DOUBLE, 0.9::DOUBLE]) AS q) WHERE n = 1 + floor(q * (c - 1))::BIGINT"""
)
def floor_quantile_values(spark, sf):
    found = floor_quantiles(_t(spark, sf, "orders"), "o_totalprice", [0.1, 0.4, 0.45, 0.9])
    return spark.createDataFrame(list(found.items()), "q double, value double")


# Splits.

_GREEDY = """
    k AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey),
    g AS (SELECT *, coalesce(sum(size) OVER (ORDER BY md5(o_custkey::VARCHAR || '#42') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
    n AS (SELECT count(*) AS n FROM orders),
    a AS (SELECT o_custkey FROM g, n WHERE before < greatest(1, round_even(n * 0.15::DOUBLE, 0))),
    g2 AS (SELECT *, coalesce(sum(size) OVER (ORDER BY md5(o_custkey::VARCHAR || '#43') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM k WHERE o_custkey NOT IN (SELECT o_custkey FROM a)),
    b AS (SELECT o_custkey FROM g2, n WHERE before < greatest(1, round_even(n * 0.25::DOUBLE, 0))),
    sp AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM a) THEN 'eval' WHEN o_custkey IN (SELECT o_custkey FROM b) THEN 'grpo' ELSE 'sft' END AS split FROM orders)"""


def _staged(spark: SparkSession, sf: str) -> DataFrame:
    return splits.cluster_split(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", [("eval", 0.15), ("grpo", 0.25)], "sft")


@query(f"WITH {_GREEDY} SELECT o_custkey FROM a")
def greedy_cluster_split(spark, sf):
    out = splits.cluster_split(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", [("val", 0.15)], "train")
    return out.where("split = 'val'").select("o_custkey").distinct()


@query(f"WITH {_GREEDY} SELECT o_orderkey, o_custkey, split FROM sp")
def three_stage_split(spark, sf):
    return _staged(spark, sf)


@query(
    f"""WITH {_GREEDY}, s AS (SELECT DISTINCT split FROM sp), p AS (SELECT x.split AS a, y.split AS b FROM s x, s y WHERE x.split < y.split)
    SELECT a, b, (SELECT count(*) FROM (SELECT o_custkey FROM sp WHERE split = p.a INTERSECT SELECT o_custkey FROM sp WHERE split = p.b)) AS shared FROM p"""
)
def split_leakage_check(spark, sf):
    return splits.leakage(_staged(spark, sf), "o_custkey")


@query(f"WITH {_GREEDY} SELECT split, count(*) AS rows, count(DISTINCT o_custkey) AS clusters, round(count(*)::DOUBLE / (SELECT n FROM n), 9) AS share FROM sp GROUP BY split")
def split_summary(spark, sf):
    return splits.split_summary(_staged(spark, sf), "o_custkey").withColumn("share", F.round("share", 9))


@query(
    """WITH l AS (SELECT doc_id, quality * 2 + toxic AS label, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(doc_id::VARCHAR || '#42'), doc_id) AS r,
                         count(*) OVER (PARTITION BY quality, toxic) AS n FROM labels),
    v AS (SELECT *, greatest(1, round_even(n * 0.2::DOUBLE, 0)) AS w FROM l)
    SELECT doc_id, label, CASE WHEN r <= CASE WHEN w >= n AND n > 1 THEN n - 1 ELSE w END THEN 'val' ELSE 'train' END AS split FROM v"""
)
def stratified_label_split(spark, sf):
    labels = _t(spark, sf, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label"))
    return splits.stratified_split(labels, "label", "doc_id", 0.2)


@query(
    """WITH u AS (SELECT 0 AS prio, doc_id AS id, source AS cluster, n_chars, NULL AS url FROM documents UNION ALL
                  SELECT 1, page_id, 'src' || (page_id % 25)::VARCHAR, NULL, url FROM pages)
    SELECT id, cluster, n_chars, url FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY prio, id) AS r FROM u) WHERE r <= 52"""
)
def two_source_quota(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("cluster"), "n_chars")
    pages = _t(spark, sf, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("src"), F.col("page_id") % 25).alias("cluster"), "url")
    return selection.two_source_quota([docs, pages], "cluster", ["id"], 52)


# Text measures and selection.


@query(
    f"""WITH c AS (SELECT doc_id, {" + ".join(f"contains(text, '{t}')::INT" for t in ("idiot", "worthless", "!!", "|", "$$"))} AS uncertain FROM documents)
    SELECT doc_id, uncertain, CASE WHEN uncertain <= 0 THEN 'continue' WHEN uncertain <= 1 THEN 'cautious' ELSE 'retake' END AS gate_decision FROM c"""
)
def gate_label_from_counts(spark, sf):
    flags = text.sum_of([F.col("text").contains(t).cast("int") for t in ("idiot", "worthless", "!!", "|", "$$")])
    out = _t(spark, sf, "documents").select("doc_id", flags.alias("uncertain"))
    return out.withColumn("gate_decision", gates.from_counts(F.col("uncertain"), 0, 1))


@query(f"SELECT doc_id, ({_terms(DOUBT)})::INT AS hits FROM documents")
def term_hits(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.term_hits(F.col("text"), DOUBT).alias("hits"))


@query("""SELECT doc_id, (len(regexp_extract_all(text, '(the|of)[^\n]{0,4}(th|er)')) + len(regexp_extract_all(text, '[A-Z][a-z]+,')))::INT AS hits FROM documents""")
def regex_signal_count(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.pattern_hits(F.col("text"), SIGNALS).alias("hits"))


_CHALLENGE = f"""
    h AS (SELECT doc_id, source, text, {" + ".join(f"contains(text, '{t}')::INT" for t in ("the", "of", "and", "with"))} AS req, {" + ".join(f"contains(text, '{t}')::INT" for t in ("the", "of", "and", "with", "for"))} AS tot,
                 ({_terms(("tion",))}) AS hits, ({_terms(("ing",))}) AS rep FROM documents),
    sc AS (SELECT doc_id, source, req, hits, req * 10.0::DOUBLE + tot * 3.0::DOUBLE + least(hits, 12) * 0.5::DOUBLE + least(rep, 8) * 0.75::DOUBLE
                  + CASE WHEN req >= 3 THEN 4.0::DOUBLE ELSE 0::DOUBLE END + CASE WHEN tot >= 4 THEN 2.0::DOUBLE ELSE 0::DOUBLE END AS score FROM h),
    ql AS (SELECT * FROM sc WHERE (req >= 2 OR hits >= 4) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


def _challenge(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    count = lambda words: text.sum_of([t.contains(w).cast("int") for w in words])
    docs = _t(spark, sf, "documents").select(
        *("doc_id", "source"),
        count(("the", "of", "and", "with")).alias("req"),
        count(("the", "of", "and", "with", "for")).alias("tot"),
        text.term_count(t, "tion").alias("hits"),
        text.term_count(t, "ing").alias("rep"),
    )
    scored = docs.withColumn("score", selection.challenge_score(F.col("req"), F.col("tot"), F.col("hits"), F.col("rep")))
    return selection.qualify(scored, "req", "hits", 2, 4, _t(spark, sf, "labels").where("toxic = 1"), "doc_id")


@query(
    f"""WITH {_CHALLENGE} SELECT doc_id, source, req, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, hits DESC, doc_id DESC) AS r FROM ql)
    WHERE r <= 3 ORDER BY score DESC, hits DESC, doc_id DESC LIMIT 40"""
)
def challenge_score_top(spark, sf):
    out = selection.top(_challenge(spark, sf), "source", [F.desc("score"), F.desc("hits"), F.desc("doc_id")], 3, 40)
    return out.select("doc_id", "source", "req", F.round("score", 6).alias("score"))


@query(
    f"""WITH RECURSIVE {_CHALLENGE}, lv AS (SELECT list(DISTINCT req ORDER BY req DESC) AS ls FROM ql WHERE req >= 1),
    st AS (SELECT 0 AS turn, 0 AS idle, []::STRUCT(id BIGINT, c VARCHAR)[] AS picks
        UNION ALL
        SELECT turn + 1, CASE WHEN p IS NULL THEN idle + 1 ELSE 0 END, CASE WHEN p IS NULL THEN picks ELSE list_append(picks, p) END FROM (
            SELECT turn, idle, picks, arg_max({{'id': doc_id, 'c': source}}, row(score, hits, doc_id)) FILTER (req = ls[turn % len(ls) + 1]
                AND NOT list_contains(list_transform(picks, lambda x: x.id), doc_id) AND len(list_filter(picks, lambda x: x.c IS NOT DISTINCT FROM source)) < 3) AS p
            FROM st, lv, ql WHERE len(picks) < 40 AND idle < len(ls) GROUP BY turn, idle, picks)),
    done AS (SELECT picks FROM st ORDER BY turn DESC LIMIT 1), k AS (SELECT unnest(picks) AS p, unnest(range(len(picks))) AS pick FROM done)
    SELECT doc_id, source, req, pick::INT AS pick FROM ql JOIN k ON k.p.id = doc_id"""
)
def challenge_stratified(spark, sf):
    rows = _challenge(spark, sf)
    return selection.stratified_exact(rows, "doc_id", "req", "source", [F.desc("score"), F.desc("hits"), F.desc("doc_id")], 3, 40, 1).select("doc_id", "source", "req", "pick")


@query(f"WITH {_CHALLENGE} SELECT req, count(*) AS rows, round(avg(score), 6) AS mean_score FROM ql GROUP BY req")
def challenge_summary(spark, sf):
    return selection.level_counts(_challenge(spark, sf), "req", "score").withColumn("mean_score", F.round("mean_score", 6))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL UNION SELECT item_id FROM benchmark)")
def exclude_anti_join(spark, sf):
    bench = _t(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return selection.exclude(_t(spark, sf, "documents"), _t(spark, sf, "labels"), bench, id_col="doc_id").select("doc_id", "n_chars")


@query(
    """WITH i AS (SELECT doc_id, min(doc_id % 17 * 100000 + doc_id) AS place FROM labels GROUP BY doc_id)
    SELECT doc_id, place, lang, n_chars FROM i JOIN (SELECT doc_id, arg_max(lang, n_chars) AS lang, max(n_chars) AS n_chars FROM documents GROUP BY doc_id) USING (doc_id)"""
)
def fixed_subset_lookup(spark, sf):
    ids = _t(spark, sf, "labels").select("doc_id", (F.col("doc_id") % 17 * 100000 + F.col("doc_id")).alias("order"))
    found = selection.lookup(ids, _t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id", "order", "n_chars")
    return found.withColumnRenamed("_at", "place")


# Conversations.

_TURNS = """v AS (SELECT conv_id, list({'from': CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, 'value': CASE WHEN turn = 0 THEN '<image>' || chr(10) || text ELSE text END} ORDER BY turn) AS c FROM conversations GROUP BY conv_id)"""


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    value = F.when(F.col("turn") == 0, F.concat(F.lit("<image>\n"), "text")).otherwise(F.col("text"))
    turns = _t(spark, sf, "conversations").select("conv_id", F.struct("turn", role.alias("from"), value.alias("value")).alias("t"))
    sorted_turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value")))
    return turns.groupBy("conv_id").agg(sorted_turns.alias("c"))  # a conversation is one record of the domain


_ROLE = "CASE x['from'] WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x['from'] END"
_MEDIA = r"regexp_replace(x['value'], '\n?<image>\n?', '<|vision_start|><|image_pad|><|vision_end|>', 'g')"


@query(f"WITH {_TURNS} SELECT conv_id, to_json(list_transform(c, lambda x: {{'role': {_ROLE}, 'content': {_MEDIA}}}))::VARCHAR AS messages FROM v")
def conversation_to_messages(spark, sf):
    return _conversations(spark, sf).select("conv_id", F.to_json(records.to_messages(F.col("c"))).alias("messages"))


@query(f"WITH {_TURNS} SELECT conv_id, trim(list_filter(c, lambda x: x['from'] = 'gpt' AND trim(x['value']) <> '')[1]['value'], ' ' || chr(10) || chr(9) || chr(13)) AS answer FROM v")
def first_assistant_turn(spark, sf):
    return _conversations(spark, sf).select("conv_id", records.first_answer(F.col("c")).alias("answer"))


@query(
    f"""WITH {_TURNS} SELECT CASE WHEN len(c) >= 2 THEN to_json(list_transform(c, lambda x, i: {{'from': x['from'], 'value': CASE WHEN i = 1 THEN
    CASE WHEN contains(x['value'], '<image>') THEN '<image>' || chr(10) ELSE '' END || 'Write a report.' ELSE x['value'] END}}))::VARCHAR END AS conversations,
    conv_id::VARCHAR || '_report' AS id, CASE WHEN len(c) < 2 THEN 'fewer than two turns' END AS error FROM v"""
)
def report_mode_rewrite(spark, sf):
    rows = _conversations(spark, sf).select(F.col("conv_id").alias("id"), F.col("c").alias("conversations"))
    return records.report_mode(rows, "Write a report.").select("id", F.to_json("conversations").alias("conversations"), "error")


@query(
    """WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, text FROM conversations WHERE role <> 'system'),
    n AS (SELECT conv_id, count(*) // 2 AS pairs FROM p GROUP BY conv_id)
    SELECT a.conv_id, (a.i // 2)::INT AS pair, (length(a.text) + length(b.text))::INT AS n_ids, length(a.text)::INT AS n_masked
    FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.i = a.i + 1 AND a.i % 2 = 0 JOIN n ON n.conv_id = a.conv_id"""
)
def turn_pairs_label_mask(spark, sf):
    """Turns in pairs; the last of an odd number has no partner and is left out beforehand."""
    turns = _t(spark, sf, "conversations").where("role <> 'system'")
    record = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))  # a conversation is one record of the domain
    pairs = records.turn_pairs(F.slice("c", F.lit(1), F.size("c") - F.size("c") % 2))
    pairs = record.where(F.size("c") > 1).select("conv_id", F.posexplode(pairs).alias("pair", "p"))
    ids = lambda c: F.transform(F.split(c, ""), F.ascii)  # noqa: E731  a token a character
    pairs = pairs.select("conv_id", "pair", ids(F.col("p.a.text")).alias("p"), ids(F.col("p.b.text")).alias("r"))
    masked = F.size(F.filter(records.masked_labels(F.col("p"), F.col("r")), lambda x: x == L.IGNORE_INDEX))
    return pairs.select("conv_id", "pair", F.size(records.input_ids(F.col("p"), F.col("r"))).alias("n_ids"), masked.alias("n_masked"))


@query(
    """WITH b AS (SELECT vec_id, vec_id // 8 AS batch, 1 + vec_id % 5 AS np, 2 + vec_id % 7 AS nr FROM embeddings),
    w AS (SELECT *, max(np + nr) OVER (PARTITION BY batch) AS width FROM b)
    SELECT vec_id, array_to_string(list_concat(range(1, np + 1), range(100, 100 + nr), list_transform(range(width - np - nr), lambda x: 0)), ',') AS input_ids,
           array_to_string(list_concat(list_transform(range(np), lambda x: -100), range(100, 100 + nr), list_transform(range(width - np - nr), lambda x: -100)), ',') AS labels,
           (np + nr)::BIGINT AS attended FROM w"""
)
def pad_to_batch(spark, sf):
    ids = _t(spark, sf, "embeddings").select(
        "vec_id",
        F.floor(F.col("vec_id") / 8).alias("batch"),
        F.sequence(F.lit(1), (1 + F.col("vec_id") % 5).cast("int")).alias("p"),
        F.sequence(F.lit(100), (101 + F.col("vec_id") % 7).cast("int")).alias("r"),
    )
    out = records.collate(ids, "batch", "p", "r")
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("vec_id", join("input_ids"), join("labels"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("attended"))


# Similarity and rewards.

_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: {0}[i:i + 1]))"


@query(
    rf"""WITH p AS (SELECT a.conv_id, regexp_replace(a.text, '\s+', '', 'g') AS x, regexp_replace(b.text, '\s+', '', 'g') AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
    g AS (SELECT conv_id, {_GRAMS.format("x")} AS gx, {_GRAMS.format("y")} AS gy FROM p)
    SELECT conv_id, round(CASE WHEN len(gx) = 0 OR len(gy) = 0 THEN 0 ELSE len(list_intersect(gx, gy))::DOUBLE / (len(gx) + len(gy) - len(list_intersect(gx, gy))) END, 9) AS jaccard FROM g"""
)
def bigram_jaccard(spark, sf):
    turns = _t(spark, sf, "conversations")
    a = turns.where("turn = 0").select("conv_id", F.col("text").alias("x"))
    b = turns.where("turn = 1").select("conv_id", F.col("text").alias("y"))
    return a.join(b, "conv_id").select("conv_id", F.round(text.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


def _positions() -> str:
    out = []
    for k, g in enumerate(GROUPS):
        out.append(f"least({', '.join(f'''nullif(strpos(text, '{w}'), 0)''' for w in g)}, 9999999)" if len(g) > 1 else f"coalesce(nullif(strpos(text, '{g[0]}'), 0), 9999999)")
        out[-1] += f" AS p{k}"
    return ", ".join(out)


def _ordered() -> str:
    steps, last = [], "0"
    for k in range(len(GROUPS)):
        steps.append(f"s{k} AS (SELECT *, CASE WHEN p{k} < 9999999 AND p{k} > last{k} THEN p{k} ELSE last{k} END AS last{k + 1}, hits{k} + CASE WHEN p{k} < 9999999 AND p{k} > last{k} THEN 1 ELSE 0 END AS hits{k + 1} FROM {'s' + str(k - 1) if k else 'pos'})")
    return f"pos AS (SELECT doc_id, text, {_positions()}, {last} AS last0, 0 AS hits0 FROM documents), " + ", ".join(steps)


@query(
    f"""WITH {_ordered()} SELECT doc_id, round(hits{len(GROUPS)} / {len(GROUPS)}::DOUBLE, 9) AS ordered,
    round((contains(text, 'the')::INT + contains(text, 'of')::INT + contains(text, 'and')::INT) / 3::DOUBLE, 9) AS mention FROM s{len(GROUPS) - 1}"""
)
def section_order_score(spark, sf):
    t = F.col("text")
    return _t(spark, sf, "documents").select("doc_id", F.round(text.ordered_score(t, GROUPS), 9).alias("ordered"), F.round(text.mention_score(t, list(LINES)), 9).alias("mention"))


@query(f"SELECT doc_id, CASE WHEN {_any(AGAIN)} THEN 0.0 WHEN {_any(('with', 'for'))} THEN 1.0 ELSE 0.2 END::DOUBLE AS safety FROM documents")
def safety_language(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", rewards.safety(F.col("text"), ("with", "for"), AGAIN).alias("safety"))


@query(
    f"""WITH d AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'retake' WHEN quality = 0 THEN 'cautious' ELSE 'continue' END AS expected,
        CASE WHEN {_any(AGAIN)} THEN 'retake' WHEN {_any(("$$", "|"))} THEN 'cautious' ELSE 'continue' END AS predicted FROM labels JOIN documents USING (doc_id)),
    m(expected, predicted, reward) AS (VALUES {", ".join(f"('{e}', '{p}', {v}::DOUBLE)" for e, row in L.GATE_REWARDS.items() for p, v in zip(L.DECISIONS, row, strict=True))})
    SELECT doc_id, expected, predicted, reward FROM d JOIN m USING (expected, predicted)"""
)
def gate_reward_matrix(spark, sf):
    rows = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    expected = F.when(F.col("toxic") == 1, "retake").when(F.col("quality") == 0, "cautious").otherwise("continue")
    predicted = F.when(text.contains_any(F.col("text"), AGAIN), "retake").when(text.contains_any(F.col("text"), ("$$", "|")), "cautious").otherwise("continue")
    rows = rows.select("doc_id", expected.alias("expected"), predicted.alias("predicted"))
    return rows.withColumn("reward", rewards.gate_matrix(F.col("expected"), F.col("predicted")))


# Payloads and judgments.


_JUDGED = """j AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'reject' WHEN l_returnflag = 'A' THEN 'accept_cautious' ELSE 'accept' END AS decision,
    l_quantity / 10 AS vg, l_discount * 50 AS uh, l_tax * 60 AS lc, 4.0::DOUBLE AS sq FROM lineitem)"""


@query(
    f"""WITH {_JUDGED}, a AS (SELECT *, (vg + uh + lc + sq) / 4 AS average FROM j)
    SELECT l_orderkey, l_linenumber, l_partkey, round(average, 6) AS average_score,
           CASE WHEN average < 3.5 OR vg < 3 OR uh < 3 OR decision = 'reject' THEN 'reject' ELSE decision END AS final_decision,
           ((average < 3.5)::INT + (vg < 3)::INT + (uh < 3)::INT + (decision = 'reject')::INT)::INT AS n_issues FROM a"""
)
def judge_filter(spark, sf):
    d = F.when(F.col("l_returnflag") == "R", "reject").when(F.col("l_returnflag") == "A", "accept_cautious").otherwise("accept")
    scores = (F.col("l_quantity") / 10, F.col("l_discount") * 50, F.col("l_tax") * 60, F.lit(4.0))
    judgment = F.struct(d.alias("decision"), *[s.cast("string").alias(f) for s, f in zip(scores, L.JUDGE_SCORES, strict=True)], F.lit("stated").alias("reason"))
    v = jsonx.judge_verdict(F.col("j"))
    lines = spread(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_discount", "l_tax"))
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", judgment.alias("j")).withColumn("v", v)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round("v.average_score", 6).alias("average_score"), F.col("v.final_decision").alias("final_decision"), F.size("v.issues").alias("n_issues"))


# Decisions.


@query(
    """WITH l AS (SELECT vec_id, [embedding[1]::DOUBLE * 8, embedding[2]::DOUBLE * 8, embedding[3]::DOUBLE * 8] AS x FROM embeddings),
    e AS (SELECT vec_id, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM l),
    p AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e),
    s AS (SELECT vec_id, p, list_max(p) AS top, list_sort(p, 'DESC') AS d, ['continue', 'cautious', 'retake'][list_position(p, list_max(p))] AS name FROM p)
    SELECT vec_id, round(top, 9) AS confidence, round(d[1] - d[2], 9) AS margin,
           CASE WHEN top < 0.55 OR d[1] - d[2] < 0.10 THEN 'cautious' WHEN name <> 'cautious' AND top < 0.65 THEN 'cautious' ELSE name END AS gate_decision FROM s"""
)
def softmax_threshold_gate(spark, sf):
    logits = F.array(*[F.col("embedding")[k].cast("double") * 8 for k in range(3)])
    rows = _t(spark, sf, "embeddings").select("vec_id", gates.softmax(logits).alias("p"))
    return rows.select("vec_id", F.round(F.array_max("p"), 9).alias("confidence"), F.round(gates.margin(F.col("p")), 9).alias("margin"), gates.thresholded(F.col("p")).alias("gate_decision"))


@query(
    """WITH d AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'continue' WHEN 'O' THEN 'cautious' ELSE 'retake' END AS decision,
        ['清晰', '一般', '模糊'][1 + (o_orderkey % 3)::INT] AS clarity, ['无', '轻微', '明显'][1 + (o_custkey % 3)::INT] AS occlusion, (o_custkey % 5)::INT AS lines FROM orders)
    SELECT o_orderkey, decision = 'cautious' OR clarity = '一般' OR occlusion = '轻微' OR lines IN (2, 3) AS cautious, decision = 'retake' OR clarity = '模糊' OR occlusion = '明显' OR lines < 2 AS retake FROM d"""
)
def visibility_rules(spark, sf):
    pick = lambda k, v: F.get(F.array(*[F.lit(x) for x in v]), (F.col(k) % 3).cast("int"))
    d = F.when(F.col("o_orderstatus") == "F", "continue").when(F.col("o_orderstatus") == "O", "cautious").otherwise("retake")
    args = (d, pick("o_orderkey", ("清晰", "一般", "模糊")), pick("o_custkey", ("无", "轻微", "明显")), (F.col("o_custkey") % 5).cast("int"))
    return _t(spark, sf, "orders").select("o_orderkey", gates.visibility_cautious(*args).alias("cautious"), gates.visibility_retake(*args).alias("retake"))


# Rollups.

_TRUTH = "t AS (SELECT quality AS truth, CASE WHEN n_chars < 700 OR contains(text, '$$') OR contains(text, '!!') THEN 0 ELSE 1 END AS predicted FROM labels JOIN documents USING (doc_id))"


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    bad = (F.col("n_chars") < 700) | text.contains_any(F.col("text"), ("$$", "!!"))
    return rows.select(F.col("quality").alias("truth"), F.when(bad, 0).otherwise(1).alias("predicted"))


@query(
    f"""WITH {_TRUTH}, c AS (SELECT l AS label, count(*) FILTER (truth = l AND predicted = l) AS h, count(*) FILTER (predicted = l) AS p, count(*) FILTER (truth = l) AS n FROM t, (SELECT unnest([0, 1, 2]) AS l) GROUP BY l),
    r AS (SELECT label, n AS support, CASE WHEN p = 0 THEN 0 ELSE h / p::DOUBLE END AS precision, CASE WHEN n = 0 THEN 0 ELSE h / n::DOUBLE END AS recall FROM c)
    SELECT label, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1 FROM r"""
)
def confusion_macro_f1(spark, sf):
    out = metrics.class_report(_judged(spark, sf), "truth", "predicted", [0, 1, 2])
    return out.select("label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_TRUTH} SELECT truth, predicted, count(*) AS n FROM t GROUP BY truth, predicted")
def confusion_matrix(spark, sf):
    return metrics.confusion(_judged(spark, sf), "truth", "predicted")


@query(f"WITH {_TRUTH} SELECT count(*) AS num_samples, round(avg((truth = predicted)::INT), 9) AS gate_match_rate, round(avg((predicted = 0)::INT), 9) AS low_confidence_rate, round(avg(truth), 9) AS mean_truth FROM t")
def val_summary(spark, sf):
    out = metrics.summary(_judged(spark, sf), {"gate_match_rate": F.col("truth") == F.col("predicted"), "low_confidence_rate": F.col("predicted") == 0}, ["truth"])
    return out.select("num_samples", *[F.round(c, 9).alias(c) for c in ("gate_match_rate", "low_confidence_rate", "mean_truth")])


@query(
    """WITH d AS (SELECT unnest(range(0, 11))::INT AS label), c AS (SELECT d.label, count(e.label) AS n FROM d LEFT JOIN embeddings e USING (label) GROUP BY d.label),
    w AS (SELECT label, n, CASE WHEN n > 0 THEN (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n)) ELSE 0 END AS w FROM c)
    SELECT label, n, round(sum(n) OVER () / (11 * greatest(n, 1))::DOUBLE, 9) AS inverse, round(w / sum(w) OVER () * 11, 9) AS balanced FROM w"""
)
def class_weights(spark, sf):
    counts = metrics.class_counts(_t(spark, sf, "embeddings"), "label", list(range(11)))
    inverse = metrics.inverse_weights(counts, 11).select("label", "n", F.round("weight", 9).alias("inverse"))
    balanced = metrics.balanced_weights(counts, 11).select("label", F.round("weight", 9).alias("balanced"))
    return inverse.join(balanced, "label")


# Logs.

_STATUS = "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'filtered' ELSE 'ok' END"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "filtered").otherwise("ok")
    return _t(spark, sf, "events").select("user_id", "event_id", "ts", "value", status.alias("status"))


@query(f"SELECT user_id, arg_max({_STATUS}, row(ts, event_id)) AS status, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_status(spark, sf):
    log = _log(spark, sf).withColumn("at", F.struct("ts", "event_id"))
    return genlog.latest(log, "user_id", "at").select("user_id", "status", "value")


@query(f"SELECT c_custkey, c_custkey IN (SELECT user_id FROM events WHERE {_STATUS} = 'ok' AND value >= 50) AS reused FROM customer")
def resume_pending(spark, sf):
    done = _log(spark, sf).where("status = 'ok' AND value >= 50").withColumnRenamed("user_id", "c_custkey")
    reused, pending = genlog.resume(_t(spark, sf, "customer").select("c_custkey"), done, "c_custkey")
    return reused.withColumn("reused", F.lit(True)).unionByName(pending.withColumn("reused", F.lit(False)))


@query(
    f"""WITH a AS (SELECT user_id, {_STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events),
    l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY attempt DESC) AS r FROM a WHERE attempt <= 3)
    SELECT user_id, attempt::INT AS attempt, CASE WHEN status = 'error' THEN 'failed' ELSE status END AS outcome FROM l WHERE r = 1"""
)
def retry_final_outcome(spark, sf):
    attempts = _log(spark, sf).withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return genlog.final_outcome(attempts, "user_id", "attempt", 3)


@query(f"SELECT reason, gate_decision, count(*) AS n FROM (SELECT CASE WHEN value >= 100 THEN 'high' ELSE '__none__' END AS reason, {_STATUS} AS gate_decision FROM events) GROUP BY reason, gate_decision")
def stream_summary(spark, sf):
    """The streaming rollup over the events, run to its end; equal to the batch one."""
    from grainmill import scratch
    from grainmill.streaming import rollup

    folder, out = scratch.new_path(spark, "stream-in"), scratch.new_path(spark, "stream-out")
    reasons = F.when(F.col("value") >= 100, F.array(F.lit("high"))).otherwise(F.array().cast("array<string>"))
    _log(spark, sf).select(reasons.alias("reject_reasons"), F.col("status").alias("gate_decision")).write.json(folder)
    stream = rollup.read_log(spark, folder, "reject_reasons array<string>, gate_decision string")
    run = rollup.maintain(rollup.reason_rates(stream), out, scratch.new_path(spark, "stream-checkpoint"))
    run.awaitTermination()
    return spark.read.parquet(out)


_PARAGRAPHS = """replace(replace(replace(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), chr(10) || 'The ', chr(10) || 'The: '), chr(10) || 'And ', chr(10) || '2、 And：'), chr(10) || 'Of the', chr(10) || '12. In' || chr(10) || chr(10) || 'Of the')"""


@query(
    rf"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_strip(_PARAGRAPHS)}, '
{_WS}*
'), lambda x: regexp_replace({_strip("x")}, '^{_WS}*(?:[一二三四五六七八九十]+、|[0-9]+[.、]){_WS}*', '')), lambda x: x <> '') AS parts FROM documents),
    p AS (SELECT doc_id, unnest(range(len(parts)))::INT AS place, unnest(parts) AS x FROM d),
    t AS (SELECT *, {" ".join(f"CASE WHEN x = '{h}' OR starts_with(x, '{h}：') OR starts_with(x, '{h}:') THEN '{h}' ELSE" for h in ("The", "And", "In"))} '' {"END " * 3} AS title FROM p)
    SELECT doc_id, place, title, CASE title WHEN 'The' THEN 'core' WHEN 'And' THEN 'energy' ELSE 'guidance' END AS module,
           length(CASE WHEN title = '' THEN x WHEN x = title THEN '' ELSE {_strip("substr(x, length(title) + 2)")} END)::INT AS n_body FROM t"""
)
def display_sections(spark, sf):
    paragraphs = F.replace(F.replace("text", F.lit(". "), F.lit(".\n \n")), F.lit("\nThe "), F.lit("\nThe: "))
    paragraphs = F.replace(F.replace(paragraphs, F.lit("\nAnd "), F.lit("\n2、 And：")), F.lit("\nOf the"), F.lit("\n12. In\n\nOf the"))
    parts = text.display_sections(paragraphs, ("The", "And", "In"), ("The",), ("And",))
    rows = _t(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("place", "part"))
    return rows.select("doc_id", "place", "part.title", "part.module", F.length("part.body").alias("n_body"))
