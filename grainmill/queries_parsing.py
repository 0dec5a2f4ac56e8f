"""Queries that read answers, objects and files, each beside its equivalent in SQL."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill import scratch
from grainmill.functions import encoding, jsonx, objects, symbolic
from grainmill.queries_records import _told
from grainmill.registry import query
from grainmill.registry import table as _t
from grainmill.sources import arrays, png, service


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, round(l_discount * 100)::BIGINT + 1 AS n, (l_orderkey + l_linenumber) % 14 AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN k IN (3, 7, 11) THEN 0.0 WHEN k IN (6, 9) THEN NULL WHEN k = 8 THEN CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END WHEN k = 12 THEN CASE WHEN n = 2 THEN 1.0 ELSE 0.0 END ELSE 1.0 END::DOUBLE AS score FROM l"""
)
def symbolic_answers(spark, sf):
    """A quotient in many forms, right and wrong; some have no value, some are words."""
    lines = _t(spark, sf, "lineitem")
    q, n, k = F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long") + 1, F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(14))
    put = lambda form: F.replace(F.replace(F.lit(form), F.lit("Q"), q.cast("string")), F.lit("N"), n.cast("string"))
    forms = [
        r"So it is $\frac{2 \cdot Q}{2 \cdot N}$.",
        r"Therefore \boxed{Q/N}",
        r"\[Q \times N^{-1}\]",
        r"$Q/(N+1)$",
        r"$\dfrac{Q x^2 - Q}{N (x - 1)(x + 1)}$",
        r"$\sqrt{Q^2} \div N$",
        r"$\frac{Q}{N-N}$",
        r"about Q of them",
        r"$Q.0$",
        None,
        r" yes ",
        r"no",
        r"$x = \frac{Q}{2}$",
        r"$\frac{Q}{N}\text{ units}$",
    ]
    own, gold = F.lit(None).cast("string"), F.when(k.isin(10, 11), F.lit("Yes")).otherwise(put(r"$\frac{Q}{N}$"))
    for i, form in enumerate(forms):
        own = F.when(k == i, F.lit(None) if form is None else put(form)).otherwise(own)
    rows = lines.select("l_orderkey", "l_linenumber", own.alias("own"), gold.alias("gold"))
    return symbolic.with_accuracy(rows, "own", "gold", "score").select("l_orderkey", "l_linenumber", "score")


@query(
    r"""SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS place, doc_id, length(text || '{"}\')::INT AS n, md5(coalesce(text || '{"}\', '-')) AS told, lang, n_chars
    FROM documents"""
)
def array_round_trip(spark, sf):
    """Documents, with braces, quotes and backslashes in their texts and an object within, as one JSON array and back."""
    docs = _t(spark, sf, "documents").select("doc_id", F.concat("text", F.lit('{"}\\')).alias("text"), F.struct("lang", F.struct("n_chars").alias("size")).alias("about"))
    path = scratch.new_path(spark, "json-array")
    arrays.write_json_array(docs, path, ["doc_id"])
    back = arrays.read_json_array(spark, path, "doc_id long, text string, about struct<lang:string,size:struct<n_chars:long>>")
    return back.select("place", "doc_id", F.length("text").alias("n"), F.md5(F.coalesce("text", F.lit("-")).cast("binary")).alias("told"), "about.lang", "about.size.n_chars")


_AT = "doc_id % 9"


@query(
    f"""WITH o AS (
        SELECT doc_id, 0 AS place, 0 AS gap, doc_id::VARCHAR AS k, length(text)::INT AS n FROM documents WHERE {_AT} = 0
        UNION ALL SELECT doc_id, 0, 20, doc_id::VARCHAR, length(text)::INT FROM documents WHERE {_AT} = 1
        UNION ALL SELECT doc_id, 0, 13, '0', NULL FROM documents WHERE {_AT} = 2
        UNION ALL SELECT doc_id, 1, 9, doc_id::VARCHAR, length(text)::INT FROM documents WHERE {_AT} = 2
        UNION ALL SELECT doc_id, 0, 27, doc_id::VARCHAR, length(text)::INT FROM documents WHERE {_AT} = 3
        UNION ALL SELECT doc_id, 0, 4, doc_id::VARCHAR, length(text)::INT FROM documents WHERE {_AT} = 4
        UNION ALL SELECT doc_id, 0, 10, (doc_id + 1)::VARCHAR, length(text)::INT FROM documents WHERE {_AT} = 5
        UNION ALL SELECT doc_id, 1, 0, doc_id::VARCHAR, length(text)::INT FROM documents WHERE {_AT} = 5
        UNION ALL SELECT doc_id, 0, 13, doc_id::VARCHAR, length(text)::INT FROM documents WHERE {_AT} = 8)
    SELECT d.doc_id, o.place::INT AS place, o.gap::INT AS gap, o.k, o.n FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id"""
)
def all_objects(spark, sf):
    """Every object of every output, with the characters between it and the object before; outputs without one have nulls."""
    rows = _t(spark, sf, "documents").select("doc_id", _told().alias("raw"))
    found = objects.explode_objects(rows, F.col("raw"), outer=True).drop("raw")
    before = F.lag(F.col("start") + F.col("length"), 1, 0).over(Window.partitionBy("doc_id").orderBy("place"))
    found = found.withColumn("gap", F.col("start") - before)
    return found.select("doc_id", "place", "gap", F.get_json_object("object", "$.k").alias("k"), F.length(F.get_json_object("object", "$.t")).alias("n"))


@query(
    """WITH t AS (SELECT conv_id, turn, trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) AS told, role FROM conversations)
    SELECT conv_id, md5(string_agg(CASE WHEN told = '' THEN role ELSE told || chr(10) || role END, chr(10) ORDER BY turn) || chr(10) || 'end"\\') AS flat FROM t GROUP BY conv_id"""
)
def nested_texts(spark, sf):
    """The strings of conversations as nested objects whose fields are not in the order of their names, depth first."""
    turn = F.struct(F.struct(F.array(F.col("text"), F.lit(" ")).alias("z"), F.col("turn").alias("y")).alias("said"), F.struct(F.col("role").alias("b"), F.lit(1.5).alias("a")).alias("by"))
    turns = _t(spark, sf, "conversations").select("conv_id", "turn", turn.alias("of"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "of"))).alias("turns"))
    raw = F.to_json(F.struct(F.transform("turns", lambda t: t["of"]).alias("turns"), F.struct(F.lit('end"\\').alias("last")).alias("also")))
    return whole.select("conv_id", F.md5(jsonx.flatten_any(raw).cast("binary")).alias("flat"))


@query(
    """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE * 4 + 1) * 127.5)))::BIGINT) AS p FROM embeddings),
    g AS (SELECT vec_id, p, list_avg(list_transform(list_filter(range(1, 65), lambda i: i % 8 <> 0), lambda i: abs(p[i + 1] - p[i]))) + list_avg(list_transform(range(1, 57), lambda i: abs(p[i + 8] - p[i]))) AS s FROM p),
    h AS (SELECT vec_id, sum(-(c * 256 / 16320.0::DOUBLE) * log2(c * 256 / 16320.0::DOUBLE)) AS e FROM (SELECT vec_id, x, count(*) AS c FROM (SELECT vec_id, unnest(p) AS x FROM p) GROUP BY vec_id, x) GROUP BY vec_id)
    SELECT vec_id, CASE WHEN vec_id % 7 <> 6 THEN round(s * 56)::BIGINT END AS sharpness, CASE WHEN vec_id % 7 <> 6 THEN round(list_stddev_pop(p), 2) END AS contrast,
           CASE WHEN vec_id % 7 <> 6 THEN list_sum(p)::BIGINT END AS brightness, CASE WHEN vec_id % 7 <> 6 THEN round(e, 2) END AS entropy FROM g JOIN h USING (vec_id)"""
)
def image_scores(spark, sf):
    """Statistics of PNG files of several kinds and filters, made of embeddings; every seventh is cut off."""

    @F.pandas_udf("binary")
    def made(ids: pd.Series, pixels: pd.Series) -> pd.Series:
        def one(i: int, p: np.ndarray) -> bytes:
            grey = np.asarray(p, np.uint8).reshape(8, 8)
            data = png.encode(grey if i % 2 else np.repeat(grey[:, :, None], 3, axis=2), i % 3)
            return data[:60] if i % 7 == 6 else data

        return pd.Series([one(i, p) for i, p in zip(ids, pixels, strict=True)])

    pixels = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((x.cast("double") * 4 + 1) * 127.5).cast("double"))).cast("int"))
    files = _t(spark, sf, "embeddings").select("vec_id", made("vec_id", pixels).alias("content"))
    whole = {"sharpness": 56, "brightness": 64}  # these are sums then
    return png.score_images(files).select("vec_id", *[F.round(F.col(s) * whole[s]).cast("long").alias(s) if s in whole else F.round(s, 2).alias(s) for s in png.STATISTICS])


@query(
    """WITH a AS (SELECT doc_id, k::INT AS attempt, ('0x' || substr(md5(doc_id || ':' || k), 1, 8))::BIGINT % 3 = 0 AS fails, length(coalesce(text, '')) AS n FROM documents, (SELECT unnest(range(1, 5)) AS k)),
    b AS (SELECT *, coalesce(bool_and(fails) OVER (PARTITION BY doc_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS asked FROM a)
    SELECT doc_id, attempt, CASE WHEN fails THEN 'error' ELSE 'ok' END AS status, CASE WHEN fails THEN 'busy' ELSE n::VARCHAR END AS response, sha256(':' || doc_id || ':' || attempt) AS key FROM b WHERE asked"""
)
def service_log(spark, sf):
    """Attempts at a service that fails now and then, as its requests tell."""

    def connect():
        def client(key: str, row: dict) -> str:
            attempt = next(k for k in range(1, 5) if service.request_key(row["doc_id"], k) == key)
            if int(hashlib.md5(f"{row['doc_id']}:{attempt}".encode()).hexdigest()[:8], 16) % 3 == 0:
                raise service.Failed("busy")
            return str(len(row["text"] or ""))

        return client

    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return service.ask(docs, "doc_id", connect, attempts=4, first_pause=0.0)


def _word_ids():
    """Words by length and first letter."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    return lambda texts: [[1 + (31 * len(w) + ord(w[0])) % 997 for w in word.findall(t)] for t in texts]


_IDS = r"list_transform(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'), lambda w: 1 + (31 * length(w) + unicode(w)) % 997)"


@query(
    f"""WITH t AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS q FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT conv_id, turn, {_IDS.format("coalesce(q, '')")} AS p, {_IDS.format("coalesce(text, '')")} AS r FROM t WHERE role = 'assistant' AND before = 'user'),
    c AS (SELECT conv_id, turn, CASE WHEN len(p) > 64 THEN p[1:63] ELSE p END AS p, list_append(CASE WHEN len(r) > 64 THEN r[1:63] ELSE r END, 2) AS r FROM p),
    w AS (SELECT *, max(len(p) + len(r)) OVER (PARTITION BY conv_id) AS width, len(p) + len(r) AS n FROM c)
    SELECT conv_id, turn, array_to_string(list_concat(list_concat(p, r), list_transform(range(width - n), lambda i: 0)), ',') AS ids,
           array_to_string(list_concat(list_concat(list_transform(p, lambda i: -100), r), list_transform(range(width - n), lambda i: -100)), ',') AS labels, n::INT AS attended FROM w"""
)
def encoded_batches(spark, sf):
    """Questions and answers as padded batches by conversation, by an encoder of words that is made in the worker."""
    turns = _t(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    by = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumns({"before": F.lag("role").over(by), "q": F.lag("text").over(by)}).where("role = 'assistant' AND before = 'user'")
    rows = encoding.training_rows(pairs.select("conv_id", "turn", "q", "text"), "q", "text", "conv_id", "words", _word_ids, most=64, end=2)
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias
    return rows.select("conv_id", "turn", join("input_ids")("ids"), join("labels")("labels"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"))
