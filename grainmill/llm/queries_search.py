"""The manifest and the exact searches as queries over their whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import lexical, merkle, topk
from grainmill.registry import table
from grainmill.session import spread


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(spread(table(spark, sf_dir, "documents")))


#: CRC-32 of a text of digits, by its definition.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, d: xor(c >> 8, list_reduce(list_prepend(xor(c, d) & 255, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

OP11_SQL = f"""
    WITH RECURSIVE
    d AS (SELECT *, row_number() OVER () AS row_id, xor({_CRC.format("doc_id::VARCHAR")}, 4294967295) % 5 = 0 AS changed FROM documents),
    f AS (SELECT row_id, doc_id, source, coalesce(changed, FALSE) AS changed,
                 coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                 || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                 text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
          FROM d),
    l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM (
              SELECT row_id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                     CASE WHEN changed THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS claimed
              FROM f)),
    sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
    nodes AS (
        SELECT g, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source
        UNION ALL
        SELECT g, level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 15) // 16 FROM nodes WHERE n > 1 GROUP BY g, level, place // 16),
    subroots AS (SELECT g, node AS subroot, level AS depth FROM nodes WHERE n = 1),
    tops AS (
        SELECT 0 AS level, g AS place, subroot AS node, count(*) OVER () AS n FROM subroots
        UNION ALL
        SELECT level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 15) // 16 FROM tops WHERE n > 1 GROUP BY level, place // 16),
    every AS (SELECT t.g, t.level, t.place, t.node FROM nodes t JOIN subroots s ON t.g = s.g AND t.level < s.depth
              UNION ALL SELECT NULL, level, place, node FROM tops WHERE n > 1),
    steps AS (
        SELECT row_id, g, level, level AS k, place // 16 AS run, place FROM (
            SELECT row_id, s.g, unnest(range(depth)) AS level, l.place // (16 ** unnest(range(depth)))::BIGINT AS place
            FROM l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source JOIN subroots r ON r.g = s.g)
        UNION ALL
        SELECT row_id, NULL, level, depth + level, place // 16, place FROM (
            SELECT row_id, depth, t.level, s.g // (16 ** t.level)::BIGINT AS place
            FROM l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source JOIN subroots r ON r.g = s.g, (SELECT DISTINCT level FROM tops WHERE n > 1) t)),
    proof AS (
        SELECT row_id, k, coalesce(string_agg(node, '' ORDER BY e.place) FILTER (WHERE e.place < s.place), '') AS a,
               coalesce(string_agg(node, '' ORDER BY e.place) FILTER (WHERE e.place > s.place), '') AS b
        FROM steps s JOIN every e ON e.g IS NOT DISTINCT FROM s.g AND e.level = s.level AND e.place // 16 = s.run GROUP BY row_id, k),
    proofs AS (SELECT row_id, string_agg(a || b, '' ORDER BY k) AS all_steps, list([a, b] ORDER BY k) AS steps FROM proof GROUP BY row_id),
    folded AS (
        SELECT l.row_id, coalesce(claimed, leaf) AS h, 0 AS k, steps FROM l LEFT JOIN proofs p ON p.row_id = l.row_id
        UNION ALL
        SELECT row_id, sha256(steps[k + 1][1] || h || steps[k + 1][2]), k + 1, steps FROM folded WHERE k < coalesce(len(steps), 0))
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(all_steps, '')) AS proof_sha256, h AS folded_root, h = root AS verified
    FROM l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source JOIN subroots r ON r.g = s.g, (SELECT node AS root FROM tops WHERE n = 1)
    LEFT JOIN proofs p ON p.row_id = l.row_id JOIN folded o ON o.row_id = l.row_id AND o.k = coalesce(len(o.steps), 0)"""


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id,
                 coalesce(list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
          FROM v AS q JOIN v ON len(q.v) = len(v.v) AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(spread(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "benchmark"))


_TERMS = r"list_transform(regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
OP13_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
    t AS (SELECT row_id, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d WHERE len(terms) > 0),
    p AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
    a AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), a),
    q AS (SELECT DISTINCT item_id, text, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    s AS (SELECT item_id, text, row_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
          FROM q JOIN p USING (term) JOIN w USING (term), a WHERE doc_id IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest, "op12_exact_top_k": op12_exact_top_k, "op13_ranked_search": op13_ranked_search}
ORACLE_SQL = {"op11_merkle_manifest": OP11_SQL, "op12_exact_top_k": OP12_SQL, "op13_ranked_search": OP13_SQL}
