"""The subpackage's queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import ann, langid, mixing, packing, quality_classifier, quality_rules, queries_search, simhash, token_store, url_filter, warc
from grainmill.session import reach_workers, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file on this machine; the files are the same on all."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(_table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf_dir, "pages")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.digest(docs, quality_rules.Cascade.fit(docs, known=quality_rules.BASE))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: one for good quality, one more for text that is not toxic."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    model = quality_classifier.train(docs, ratings, 3)
    return quality_classifier.select(docs.select("doc_id", "text"), model).drop("text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json"), 0))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.digest(docs, langid.train(docs))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read(token_store.write(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filter": op5_url_filter,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_token_output": op10_token_output,
    **queries_search.QUERIES,
}

ORACLE_SQL: dict[str, str] = {
    **queries_search.ORACLE_SQL,
    "op4_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM documents),
        g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (
                  SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM (
                      SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1)
              GROUP BY doc_id),
        m AS (SELECT d.doc_id, text, len(w)::BIGINT AS n_words,
                     length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                     (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
                     coalesce(r.n, 0)::BIGINT AS n_repeat_words
              FROM d LEFT JOIN r USING (doc_id)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed
               AND word_chars >= 2.0 * n_words AND word_chars <= 15.0 * n_words
               AND n_symbols <= 0.3 * n_words
               AND n_dup_lines <= 0.5 * n_lines
               AND length(regexp_replace(text, '\P{Lu}+', '', 'g')) <= 0.5 * word_chars AS kept
        FROM f""",
}
