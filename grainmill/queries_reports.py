"""Queries of payloads, rewards and model outputs, each beside its equivalent in SQL.

The domain's reports are in Chinese, the driver's texts are not. So each document is put into the domain's words by
replacing common words and syllables with terms of the word lists, the same way in Spark and in SQL: as a completion, and, with
other terms, as the analysis that the completion is held against.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill import lexicons as L
from grainmill.functions import jsonx, rewards, text
from grainmill.functions.lang import let
from grainmill.registry import query
from grainmill.registry import table as _t
from grainmill.session import spread

COMPLETION = (
    *((" the ", " 生命线 "), (" of ", " 智慧线 "), (" and ", " 感情线 "), (" to ", " 事业线与发展节奏 "), (" is ", " 整体印象 "), (" for ", " 近期运势 "), (" this ", " 现实建议 "), (" as ", " 总结 ")),
    *((" in ", " 较长 "), (" with ", " 清晰"), (" by ", " 分叉 "), (" be ", " 断裂 "), (" on ", " 深长有力 "), (" that ", " 谨慎分析 "), ("ndble", "重拍一张"), ("hawh", "仅供参考"), ("worthless", "注定"), ("idiot", "绝对")),
    *((" le ", " 生命线 "), (" de ", " 智慧线 "), (" la ", " 模糊 "), (" und ", " 生命线 "), (" der ", " 羽毛状 "), (" el ", " 感情线 ")),
)
REFERENCE = (
    *((" the ", " 弧形 "), (" of ", " 较长 "), (" and ", " 清晰 "), (" with ", " 分叉 "), (" by ", " 岛纹 "), (" to ", " 月丘 "), (" on ", " 深 "), ("ndble", "模糊"), ("hawh", "看不清")),
    *((" le ", " 上扬 "), (" la ", " 短 "), (" und ", " 断续 "), ("worthless", "确诊"), ("thand", "仅供参考")),
)
#: White space as :func:`grainmill.functions.text.strip` takes it.
_WS = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NAMES = (*L.REQUIRED_LINES, *L.OPTIONAL_LINES)


def put(df: DataFrame, texts: dict[str, tuple[tuple[str, str], ...]]) -> DataFrame:
    """``doc_id`` and, for each of ``texts``, the ``text`` with each pair's first replaced by its second, one pair after the other.

    Python's search skips ahead, where Spark's compares at every byte, once a pair: two fifths of what a reward took.
    """

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column("text").to_pylist()
            out = [[t if t is None else reduce(lambda c, p: c.replace(*p), pairs, t) for t in told] for pairs in texts.values()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.string()) for x in out]], ["doc_id", *texts])

    return df.select("doc_id", "text").mapInArrow(replaced, ", ".join(["doc_id long", *[f"{n} string" for n in texts]]))


def put_sql(column: str, pairs: tuple[tuple[str, str], ...]) -> str:
    return reduce(lambda c, p: f"replace({c}, '{p[0]}', '{p[1]}')", pairs, column)


def payload(column: Column, key: Column) -> Column:
    """An analysis as JSON: a text dealt to the 28 fields of the lines, and again to the five reports.

    By the key a field is blank, a line is absent, all lines are, or there is an optional line, at times with a blank field.
    """
    width, lines = len(L.LINE_FIELDS), len(L.REQUIRED_LINES)

    def parts(t: Column, size: Column, n: int, groups: int = 1) -> Column:
        """The text of that size in ``n`` parts, cut out of ``groups`` even ones first, as a cut counts the characters before it."""
        at = lambda k: F.floor(size * k / n).cast("int")
        each = n // groups
        cut = lambda x, begin, k: F.substr(x, at(k) - begin + 1, at(k + 1) - at(k))
        inner = lambda g: F.transform(F.sequence(g["k"], g["k"] + each - 1), lambda k: cut(g["text"], g["begin"], k))
        outer = lambda k: F.struct(F.substr(t, at(k) + 1, at(k + each) - at(k)).alias("text"), at(k).alias("begin"), k.alias("k"))
        if groups == 1:
            return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: cut(t, 0, k))
        return F.flatten(F.transform(F.transform(F.sequence(F.lit(0), F.lit(n - 1), F.lit(each)), outer), inner))

    def whole(x: Column) -> Column:
        field = lambda i, k: F.when(key % 9 == k, "  ").otherwise(F.get(x["small"], i * width + k))
        line = lambda i: F.when(~((key % 11 == 5) & (i == 2)), F.struct(*[field(i, k).alias(f) for k, f in enumerate(L.LINE_FIELDS)]))
        shown = F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), line)
        more = [F.when(key % 4 == 0, F.struct(*[(F.when(key % 8 != 0, F.get(x["small"], F.lit(2))) if k == 2 else field(F.lit(0), k)).alias(f) for k, f in enumerate(L.LINE_FIELDS)])) for _ in L.OPTIONAL_LINES]
        found = F.map_filter(F.map_from_arrays(F.lit(list(_NAMES)), F.concat(shown, F.array(*more))), lambda _, v: v.isNotNull())
        reports = [F.get(x["large"], F.lit(k)).alias(f) for k, f in enumerate(L.REPORT_FIELDS)]
        return F.to_json(F.struct(F.struct(F.when(key % 10 != 9, found).alias("lines"), *reports).alias(L.TOP_KEY)))

    cut = lambda x: F.struct(parts(x["t"], x["size"], width * lines, lines).alias("small"), parts(x["t"], x["size"], len(L.REPORT_FIELDS)).alias("large"))
    return let(F.struct(column.alias("t"), F.length(column).alias("size")), lambda x: let(cut(x), whole))


def _payload_sql(column: str) -> str:
    """The same as ``ls``, a list of the five lines' lists of values or nulls (null without lines), and ``ps``, the five reports."""
    width, n = len(L.LINE_FIELDS), len(L.LINE_FIELDS) * len(L.REQUIRED_LINES)
    part = lambda k, m: f"substr({column}, length({column}) * {k} // {m} + 1, length({column}) * {k + 1} // {m} - length({column}) * {k} // {m})"
    field = lambda i, k: f"CASE WHEN doc_id % 9 = {k} THEN '  ' ELSE {part(width * i + k, n)} END"
    line = lambda i: "[" + ", ".join(field(i, k) for k in range(width)) + "]"
    rows = [f"CASE WHEN doc_id % 11 = 5 THEN NULL ELSE {line(i)} END" if i == 2 else line(i) for i in range(len(L.REQUIRED_LINES))]
    extra = "[" + ", ".join(f"CASE WHEN doc_id % 8 <> 0 THEN {part(2, n)} END" if k == 2 else field(0, k) for k in range(width)) + "]"
    lines = f"[{', '.join(rows)}, CASE WHEN doc_id % 4 = 0 THEN {extra} END]"
    return f"CASE WHEN doc_id % 10 <> 9 THEN {lines} END AS ls, [{', '.join(part(k, len(L.REPORT_FIELDS)) for k in range(len(L.REPORT_FIELDS)))}] AS ps"


def _rows(spark: SparkSession, sf: str, completions: bool = True) -> DataFrame:
    """``doc_id``, ``raw``, the reference in JSON, and with ``completions`` ``completion`` and ``answer`` (the completion as an analysis, in JSON)."""
    key = F.col("doc_id")
    docs = put(spread(_t(spark, sf, "documents").select("doc_id", "text")), {"reference": REFERENCE} | ({"completion": COMPLETION} if completions else {}))
    told = ["completion", payload(F.col("completion"), key + 3).alias("answer")] if completions else []
    return docs.select("doc_id", *told, payload(F.col("reference"), key).alias("raw"))


def _any(x: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def _hits(x: str, terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"(length({x}) - length(replace({x}, '{t}', ''))) // {len(t)}" for t in terms) + ")"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _chars(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(coalesce({x}, ''), '{_WS}+', '', 'g'), ''), lambda c: c <> '')"


def _grams(x: str) -> str:
    """Distinct bigrams of a list of characters."""
    return f"CASE WHEN len({x}) = 1 THEN {x} ELSE list_distinct(list_transform(range(1, len({x})), lambda i: {x}[i] || {x}[i + 1])) END"


def _jaccard(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0 ELSE len(list_intersect({x}, {y}))::DOUBLE / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END"


def _line_text(i: int) -> str:
    return f"CASE WHEN ls IS NULL OR ls[{i + 1}] IS NULL THEN '' ELSE array_to_string(list_concat(['{_NAMES[i]}'], list_filter(list_transform(ls[{i + 1}], lambda v: {_strip('v')}), lambda v: v <> '')), chr(10)) END"


def _least_position(words: tuple[str, ...]) -> str:
    return f"least({', '.join([*(f'''coalesce(nullif(strpos(t, '{w}'), 0), 9999999)''' for w in words), '9999999'])})"


def _ordered_sql(groups: tuple[tuple[str, ...], ...], source: str, columns: str) -> str:
    """CTEs that end in ``ordered``: the columns named, and the share of groups in order."""
    out = [f"o0 AS (SELECT {columns}, 0 AS last, 0 AS hits, {', '.join(f'{_least_position(g)} AS g{k}' for k, g in enumerate(groups))} FROM {source})"]
    for k in range(len(groups)):
        up = f"g{k} < 9999999 AND g{k} > last"
        out.append(f"o{k + 1} AS (SELECT * REPLACE (CASE WHEN {up} THEN g{k} ELSE last END AS last, hits + CASE WHEN {up} THEN 1 ELSE 0 END AS hits) FROM o{k})")
    return ", ".join([*out, f"ordered AS (SELECT {columns}, hits / {len(groups)}::DOUBLE AS ordered FROM o{len(groups)})"])


def _sections_sql() -> str:
    names = list(L.LINE_KEYWORDS)
    ends = []
    for i in range(len(names)):
        later = ", ".join(f"CASE WHEN p{j} {'>' if j < i else '>='} p{i} THEN p{j} ELSE 9999999 END" for j in range(len(names)) if j != i)
        ends.append(f"CASE WHEN p{i} < 9999999 THEN {_strip(f'substr(t, p{i}, least({later}, length(t) + 1) - p{i})')} ELSE '' END")
    return "[" + ", ".join(ends) + "]"


_FACTS = f"""
    d AS (SELECT doc_id, {put_sql("text", COMPLETION)} AS t, {put_sql("text", REFERENCE)} AS r FROM documents),
    v AS (SELECT doc_id, t, {_payload_sql("r")} FROM d),
    x AS (SELECT doc_id, t, ls, ps, {", ".join(f"{_line_text(i)} AS r{i}" for i in range(len(_NAMES)))}, {", ".join(f"{_least_position(k)} AS p{i}" for i, k in enumerate(L.LINE_KEYWORDS.values()))} FROM v),
    y AS (SELECT *, {_sections_sql()} AS secs, [r0, r1, r2, r3] AS refs,
                 array_to_string(list_filter(list_concat([r0, r1, r2, r3, r4], list_transform(ps, lambda p: {_strip("p")})), lambda p: p <> ''), chr(10)) AS whole FROM x),
    u AS (SELECT doc_id, unnest(range(1, 5)) AS i, secs, refs FROM y),
    l AS (SELECT doc_id, secs[i] AS sec, refs[i] AS ref, {_chars("secs[i]")} AS cs, {_chars("refs[i]")} AS cr FROM u),
    g AS (SELECT *, {_grams("cs")} AS gs, {_grams("cr")} AS gr FROM l),
    f AS (SELECT doc_id, {_any("ref", L.UNCERTAIN_TERMS)} AS u, {_any("sec", L.CAUTIOUS_TERMS)} AS c, {_any("sec", L.RETAKE_TERMS)} AS k,
                 {" + ".join(f"(contains(sec, '{t}') AND NOT contains(ref, '{t}'))::INT" for t in L.DETAIL_TERMS)} AS d,
                 {" + ".join(f"len(regexp_extract_all(sec, '{p}'))" for p in L.ASSERTIVE_PATTERNS)} AS a, {_jaccard("gs", "gr")} AS j,
                 {" + ".join(f"(contains(sec, '{t}') AND contains(ref, '{t}'))::INT" for t in L.EVIDENCE_TERMS)} AS cov,
                 {" + ".join(f"contains(ref, '{t}')::INT" for t in L.EVIDENCE_TERMS)} AS terms, sec <> '' AS s, ref <> '' AS r FROM g),
    f1 AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, c::INT - least(0.6::DOUBLE, 0.2::DOUBLE * d) - least(0.6::DOUBLE, 0.2::DOUBLE * a))) AS careful,
                  greatest(0::DOUBLE, a - 1) AS extra, cov / greatest(terms, 1)::DOUBLE AS share FROM f),
    f2 AS (SELECT *, CASE WHEN NOT s OR NOT r THEN 0 WHEN u THEN careful ELSE greatest(0::DOUBLE, least(1::DOUBLE, j - least(0.35::DOUBLE, 0.08::DOUBLE * d + 0.04::DOUBLE * extra))) END AS grounding,
                  CASE WHEN c THEN greatest(0::DOUBLE, share - 0.12::DOUBLE) ELSE share END AS cover FROM f1),
    f3 AS (SELECT *, CASE WHEN NOT s OR NOT r THEN 0 WHEN u THEN careful WHEN terms = 0 THEN grounding
                          ELSE greatest(0::DOUBLE, least(1::DOUBLE, 0.65::DOUBLE * cover + 0.35::DOUBLE * grounding - least(0.25::DOUBLE, 0.06::DOUBLE * d + 0.03::DOUBLE * extra))) END AS evidence,
                  CASE WHEN u THEN greatest(0::DOUBLE, least(1::DOUBLE, (c OR k)::INT - least(0.6::DOUBLE, 0.2::DOUBLE * d) - least(0.6::DOUBLE, 0.25::DOUBLE * a)))
                       WHEN NOT s THEN 0 WHEN c OR k THEN 0.55::DOUBLE ELSE 0.9::DOUBLE END AS honest,
                  CASE WHEN NOT s THEN 0 WHEN u THEN c::INT ELSE least(1::DOUBLE, 0.2::DOUBLE + 0.8::DOUBLE * j) END AS consistent,
                  (u AND NOT c)::INT + least(1::DOUBLE, 0.35::DOUBLE * d)
                      + CASE WHEN d > 0 AND a > 0 THEN least(0.6::DOUBLE, 0.2::DOUBLE * a) WHEN u THEN least(0.5::DOUBLE, 0.15::DOUBLE * a) ELSE 0 END AS invented,
                  (c AND (a > 0 OR d > 0))::INT + CASE WHEN u AND (a > 0 OR d > 0) THEN least(1::DOUBLE, 0.5::DOUBLE + 0.2::DOUBLE * d + 0.2::DOUBLE * a) ELSE 0 END AS against FROM f2),
    m AS (SELECT doc_id, coalesce(avg(evidence) FILTER (r), 0) AS evidence, coalesce(avg(evidence) FILTER (r AND NOT u), 0) AS certain_evidence, avg(honest) FILTER (r) AS honest,
                 coalesce(avg(consistent) FILTER (r), 0) AS consistent, coalesce(greatest(0, 1 - avg(invented) FILTER (s AND r)), 0) AS not_invented,
                 coalesce(greatest(0, 1 - avg(against) FILTER (s AND r)), 0) AS not_against, sum(u::INT) AS doubts,
                 CASE WHEN sum(u::INT) >= 3 THEN 'retake' WHEN sum(u::INT) >= 1 THEN 'cautious' ELSE 'continue' END AS expected FROM f3 GROUP BY doc_id),
    {_ordered_sql(L.SECTIONS, "y", "doc_id, t, secs, whole")},
    w AS (SELECT doc_id, t, whole, ordered, ({" + ".join(f"contains(t, '{n}')::INT" for n in L.LINE_KEYWORDS)}) / 4::DOUBLE AS mention, len(list_filter(secs, lambda s: s <> '')) / 4::DOUBLE AS presence,
                 {_chars("t")} AS ct, {_chars("whole")} AS cw, length(regexp_replace(t, '[^一-鿿]+', '', 'g')) AS han,
                 CASE WHEN {_any("t", L.RETAKE_TERMS)} THEN 'retake' WHEN {_any("t", L.CAUTIOUS_TERMS)} THEN 'cautious' ELSE 'continue' END AS predicted,
                 {_hits("t", L.CAUTIOUS_TERMS)} AS mentions, least(1::DOUBLE, {_hits("whole", L.UNCERTAIN_TERMS)} / 6::DOUBLE) AS doubt FROM ordered),
    w2 AS (SELECT *, {_grams("ct")} AS gt, {_grams("cw")} AS gw FROM w),
    w3 AS (SELECT *, {_jaccard("gt", "gw")} AS jac FROM w2 JOIN m USING (doc_id)),
    gates(expected, predicted, gate) AS (VALUES {", ".join(f"('{e}', '{p}', {v}::DOUBLE)" for e, row in L.GATE_REWARDS.items() for p, v in zip(L.DECISIONS, row, strict=True))})"""

_OVER = "greatest(0, mentions - {0})"
_FORMAT = "CASE WHEN regexp_matches(t, '[{{}}]|```') THEN 0 WHEN han < {0} THEN han / {0}::DOUBLE WHEN han <= {1} THEN 1 ELSE 0.6 END"
REPORT_SQL = {
    "report_format_reward": _FORMAT.format(120, 1800),
    "section_structure_reward": "0.45 * ordered + 0.25 * mention + 0.30 * presence",
    "reference_alignment_reward": "0.45 * jac + 0.35 * evidence + 0.20 * (0.4 * ordered + 0.3 * mention + 0.3 * presence)",
    "evidence_coverage_reward": "evidence",
    "line_level_consistency_reward": "consistent",
    "hallucination_penalty_reward": "not_invented",
    "caution_balance_reward": f"""greatest(0::DOUBLE, least(1::DOUBLE, 1 - CASE
        WHEN expected = 'continue' THEN CASE predicted WHEN 'cautious' THEN 0.35 WHEN 'retake' THEN 0.70 ELSE 0 END + 0.03::DOUBLE * {_OVER.format(1)} + CASE WHEN certain_evidence < 0.35 THEN 0.25 ELSE 0 END
        WHEN expected = 'cautious' THEN CASE WHEN predicted = 'continue' AND doubts >= 2 THEN 0.20 WHEN predicted = 'retake' THEN 0.20 ELSE 0 END + 0.02::DOUBLE * {_OVER.format("(doubts + 1)")} + CASE WHEN certain_evidence < 0.25 THEN 0.15 ELSE 0 END
        ELSE CASE predicted WHEN 'continue' THEN 0.60 WHEN 'cautious' THEN 0.15 ELSE 0 END END))""",
    "gate_decision_reward": "gate",
    "uncertainty_honesty_reward": f"""least(1::DOUBLE, coalesce(honest, CASE WHEN doubt >= 0.5 THEN {_any("t", L.CAUTIOUS_TERMS)}::INT WHEN {_any("t", L.CAUTIOUS_TERMS)} THEN 0.4 ELSE 0.7 END)
        + CASE WHEN expected = 'retake' AND predicted = 'retake' THEN 0.1 WHEN expected = 'cautious' AND predicted <> 'continue' THEN 0.1 WHEN expected = 'continue' AND predicted = 'continue' THEN 0.05 ELSE 0 END)""",
    "uncertainty_contradiction_penalty_reward": "not_against",
    "safety_language_reward": f"CASE WHEN {_any('t', L.REPORT_BANNED)} THEN 0 WHEN {_any('t', L.REPORT_SAFE)} THEN 1 ELSE 0.2 END",
}


@query(f"WITH {_FACTS} SELECT doc_id, {', '.join(f'round(({e})::DOUBLE, 9) AS {n}' for n, e in REPORT_SQL.items())} FROM w3 JOIN gates USING (expected, predicted)")
def report_rewards(spark, sf):
    """All rewards of reports."""
    rows = _rows(spark, sf).select("doc_id", "completion", jsonx.parse(F.col("raw")).alias("p"))
    rows = rewards.with_facts(rows, "completion", "p", "shared")
    found = rows.select("doc_id", *rewards.REPORT_REWARDS.columns(completion=F.col("completion"), parsed=F.col("p"), shared=F.col("shared")))
    return found.select("doc_id", *[F.round(n, 9).alias(n) for n in REPORT_SQL])


@query(f"WITH {_FACTS} SELECT doc_id, round(({REPORT_SQL['reference_alignment_reward']})::DOUBLE, 9) AS alignment FROM w3")
def alignment_reward(spark, sf):
    rows = _rows(spark, sf).select("doc_id", "completion", jsonx.parse(F.col("raw")).alias("p"))
    rows = rewards.with_facts(rows, "completion", "p", "shared", rewards.EVIDENCE_FACTS)
    return rows.select("doc_id", F.round(rewards.report_alignment(F.col("completion"), F.col("p"), F.col("shared")), 9).alias("alignment"))


@query(f"WITH {_FACTS} SELECT doc_id, round(not_invented::DOUBLE, 9) AS reward FROM w3")
def line_penalty_reward(spark, sf):
    rows = _rows(spark, sf).select("doc_id", "completion", jsonx.parse(F.col("raw")).alias("p"))
    return rows.select("doc_id", F.round(rewards.hallucination_penalty(F.col("completion"), F.col("p")), 9).alias("reward"))


_HAN = f"h AS (SELECT doc_id, t, length(regexp_replace(t, '[^一-鿿]+', '', 'g')) AS han FROM (SELECT doc_id, {put_sql('text', COMPLETION)} || CASE WHEN doc_id % 13 = 0 THEN '{{' ELSE '' END AS t FROM documents))"


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """Completions, some with a brace."""
    brace = F.when(F.col("doc_id") % 13 == 0, "{").otherwise("")
    return put(_t(spark, sf, "documents"), {"told": COMPLETION}).select("doc_id", F.concat("told", brace).alias("t"))


@query(f"WITH {_HAN} SELECT doc_id, han::INT AS han, round(({_FORMAT.format(120, 1800)})::DOUBLE, 9) AS report_format FROM h")
def format_reward(spark, sf):
    return _marked(spark, sf).select("doc_id", text.han_count(F.col("t")).alias("han"), F.round(rewards.report_format(F.col("t")), 9).alias("report_format"))


@query(
    f"""WITH {_HAN}, k AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '<think>' || chr(10) || t || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || t || chr(10) || '</answer>'
        WHEN 1 THEN '<think>' || t || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || t || chr(10) || '</answer>'
        WHEN 2 THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || chr(10) || '</answer>' || chr(10) || t
        WHEN 3 THEN '<think>' || chr(10) || t || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || t || chr(10) || '</answer> more' ELSE t END AS wrapped FROM h)
    SELECT doc_id, round(({_FORMAT.format(20, 200)})::DOUBLE, 9) AS length_band,
           regexp_matches(wrapped, '(?s)^<think>\n.*\n</think>\n<answer>\n.*\n</answer>(\n|$)')::INT::DOUBLE AS think_format FROM h JOIN k USING (doc_id)"""
)
def length_band_reward(spark, sf):
    """Length bands of other limits, and the format of thinking and answer on texts that have it, nearly have it or lack it."""
    t = F.col("t")
    whole = lambda head, x, tail: F.concat(F.lit(f"<think>{head}"), x, F.lit("\n</think>\n<answer>\n"), x, F.lit(f"\n</answer>{tail}"))
    k = F.col("doc_id") % 5
    wrapped = F.when(k == 0, whole("\n", t, "")).when(k == 1, whole("", t, "")).when(k == 2, F.concat(whole("\n", F.lit(""), "\n"), t)).when(k == 3, whole("\n", t, " more")).otherwise(t)
    return _marked(spark, sf).select("doc_id", F.round(rewards.report_format(t, 20, 200), 9).alias("length_band"), rewards.think_format(wrapped).alias("think_format"))


_ERRORS = f"""CASE WHEN ls IS NULL THEN ['Missing object: {L.TOP_KEY}.lines'] ELSE list_concat({", ".join(
    [f"CASE WHEN ls[{i + 1}] IS NULL THEN {'[]::VARCHAR[]' if n in L.OPTIONAL_LINES else f"['Missing line: {n}']"} ELSE list_filter([" + ", ".join(
        f"CASE WHEN coalesce({_strip(f'ls[{i + 1}][{k + 1}]')}, '') = '' THEN 'Missing or empty field: {n}.{f}' END" for k, f in enumerate(L.LINE_FIELDS)) + "], lambda e: e IS NOT NULL) END" for i, n in enumerate(_NAMES)]
    + ["list_filter([" + ", ".join(f"CASE WHEN {_strip(f'ps[{k + 1}]')} = '' THEN 'Missing or empty field: {L.TOP_KEY}.{f}' END" for k, f in enumerate(L.REPORT_FIELDS)) + "], lambda e: e IS NOT NULL)"])}) END"""
_REFERENCE = f"d AS (SELECT doc_id, {put_sql('text', REFERENCE)} AS r FROM documents), v AS (SELECT doc_id, {_payload_sql('r')} FROM d)"


@query(f"WITH {_REFERENCE} SELECT doc_id, array_to_string({_ERRORS}, '; ') AS errors FROM v")
def json_payload_validate(spark, sf):
    """What payloads lack, in order."""
    return _rows(spark, sf, completions=False).select("doc_id", F.array_join(jsonx.payload_errors(jsonx.parse(F.col("raw"))), "; ").alias("errors"))


@query(f"WITH {_REFERENCE} SELECT doc_id, len({_ERRORS})::INT AS n_errors FROM v")
def built_payload_validate(spark, sf):
    found = jsonx.extract(_rows(spark, sf, completions=False), "raw")
    return found.select("doc_id", F.size(jsonx.payload_errors(jsonx.parse(F.col("payload")))).alias("n_errors"))


def _quoted(x: str) -> str:
    return f"to_json({_strip(f'coalesce({x}, $$$$)')})::VARCHAR"


def _canonical_sql() -> str:
    lines = ", ".join(
        f"CASE WHEN ls IS NOT NULL AND ls[{i + 1}] IS NOT NULL THEN '\"{n}\":{{' || " + " || ',' || ".join(f"'\"{f}\":' || {_quoted(f'ls[{i + 1}][{k + 1}]')}" for k, f in enumerate(L.LINE_FIELDS)) + " || '}' END" for i, n in enumerate(_NAMES)
    )
    reports = " || ".join(f"',\"{f}\":' || {_quoted(f'ps[{k + 1}]')}" for k, f in enumerate(L.REPORT_FIELDS))
    return f"'{{\"{L.TOP_KEY}\":{{\"lines\":{{' || array_to_string(list_filter([{lines}], lambda x: x IS NOT NULL), ',') || '}}' || {reports} || '}}}}'"


@query(f"WITH {_REFERENCE} SELECT doc_id, {_canonical_sql()} AS canonical FROM v")
def payload_canonical(spark, sf):
    return _rows(spark, sf, completions=False).select("doc_id", jsonx.canonical(jsonx.parse(F.col("raw"))).alias("canonical"))


_FLAT = lambda ls, ps: f"array_to_string(list_filter(list_transform(list_concat(flatten(list_filter(coalesce({ls}, []), lambda l: l IS NOT NULL)), {ps}), lambda p: {_strip('p')}), lambda p: p <> ''), chr(10))"
_LINE_SHARE = " + ".join(f"(coalesce({_strip(f'als[{i + 1}][{k + 1}]')}, '') <> '')::INT" for i in range(4) for k in range(len(L.LINE_FIELDS)))
_REPORT_SHARE = " + ".join(f"({_strip(f'aps[{k + 1}]')} <> '')::INT" for k in range(len(L.REPORT_FIELDS)))


@query(
    f"""WITH d AS (SELECT doc_id, {put_sql("text", REFERENCE)} AS r, {put_sql("text", COMPLETION)} AS t FROM documents), v AS (SELECT doc_id, {_payload_sql("r")} FROM d),
    e AS (SELECT doc_id - 3 AS doc_id, ls AS als, ps AS aps, {_ERRORS} AS errors FROM (SELECT doc_id, {_payload_sql("t")} FROM (SELECT doc_id + 3 AS doc_id, t FROM d))),
    b AS (SELECT *, {_chars(_FLAT("ls", "ps"))} AS cr, {_chars(_FLAT("als", "aps"))} AS ca FROM v JOIN e USING (doc_id)),
    g AS (SELECT *, {_grams("cr")} AS gr, {_grams("ca")} AS ga, ({_LINE_SHARE}) / 28::DOUBLE AS lines, ({_REPORT_SHARE}) / 5::DOUBLE AS reports, aps[4] || chr(10) || aps[5] AS told FROM b)
    SELECT doc_id, (len(errors) = 0)::INT::DOUBLE AS json_schema_reward, round(lines, 9) AS line_field_coverage_reward, round(reports, 9) AS report_field_coverage_reward,
           round(0.6 * {_jaccard("gr", "ga")} + 0.4 * (0.5 * lines + 0.5 * reports), 9)::DOUBLE AS reference_alignment_reward,
           (CASE WHEN {_any("told", L.PAYLOAD_BANNED)} THEN 0 WHEN {_any("told", L.PAYLOAD_SAFE)} THEN 1 ELSE 0.2 END)::DOUBLE AS safety_language_reward FROM g"""
)
def structured_rewards(spark, sf):
    """All rewards of payloads, each document's answer against its reference."""
    rows = _rows(spark, sf).select("doc_id", jsonx.parse(F.col("answer")).alias("a"), jsonx.parse(F.col("raw")).alias("r"))
    found = rows.select("doc_id", *rewards.STRUCTURED_REWARDS.columns(parsed=F.col("a"), reference=F.col("r")))
    return found.select("doc_id", *[F.round(n, 9).alias(n) for n in rewards.STRUCTURED_REWARDS])
