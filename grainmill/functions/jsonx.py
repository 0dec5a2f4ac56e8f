"""JSON that models wrote: extraction, validation, canonical form, filters.

Texts that hold one plain object are parsed by Spark. Only the rest goes to a Python function, which finds the
first balanced object that parses.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill import lexicons as L
from grainmill.functions.lang import let
from grainmill.functions.text import any_of, blank, matches_any, strip, sum_of

_LINE = "struct<" + ",".join(f"`{f}`:string" for f in L.LINE_FIELDS) + ">"
PAYLOAD = f"`{L.TOP_KEY}` struct<lines:map<string,{_LINE}>," + ",".join(f"{f}:string" for f in L.REPORT_FIELDS) + ">"
JUDGE = "teacher_judgment struct<decision:string," + ",".join(f"{f}:string" for f in L.JUDGE_SCORES) + ",reason:string>"
_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def clean(text: Column) -> Column:
    """Without thinking blocks and tags; the inside of the first fenced block if there is one."""
    bare = F.regexp_replace(F.regexp_replace(strip(text), r"(?is)<think>.*?</think>", ""), r"(?i)</?think>", "")
    return let(strip(bare), lambda t: F.when(t.rlike(r"(?is)```(?:json)?\s*.*?```"), strip(F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1))).otherwise(t))


def object_spans(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of outermost ``{...}`` runs, braces within strings aside."""
    depth, start, quoted, escaped = 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start = start if depth else i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                yield start, i + 1


def balanced_objects(text: str) -> Iterator[str]:
    for start, end in object_spans(text):
        yield text[start:end]


def first_object(text: str | None) -> str | None:
    """The text itself if it is an object, or the first balanced object within it that parses."""
    for candidate in (text or "", *balanced_objects(text or "")):
        try:
            if isinstance(json.loads(candidate), dict):
                return candidate
        except (ValueError, RecursionError):
            continue
    return None


def extract(df: DataFrame, text_col: str, out: str = "payload") -> DataFrame:
    """Add the first JSON object of each text, or null.

    Python sees only the texts that Spark, after cleaning, cannot take as one object; for the others it gets a null.
    """

    @F.pandas_udf("string")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(first_object)

    rows = df.select(F.struct("*").alias("row"), clean(F.col(text_col)).alias("c"))
    plain = F.coalesce(F.col("c").rlike(r"(?s)\A\{.*\}\z") & F.try_parse_json("c").isNotNull(), F.lit(False))
    rows = rows.withColumn("plain", plain).withColumn("found", search(F.when(~F.col("plain"), F.col("c"))))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c != out]
    return rows.select(*kept, F.when(F.col("plain"), F.col("c")).otherwise(F.col("found")).alias(out))


def parse(payload: Column, schema: str = PAYLOAD) -> Column:
    return F.from_json(payload, schema, _STRICT)


def _lines(parsed: Column) -> Column:
    return parsed[L.TOP_KEY]["lines"]


def payload_errors(parsed: Column) -> Column:
    """Ordered list of what a payload lacks; stops at a missing object. ``parsed`` is computed once a row, whatever expression it is."""
    return let(parsed, _errors)


def _errors(parsed: Column) -> Column:
    analysis, lines = parsed[L.TOP_KEY], _lines(parsed)

    def fields(name: str) -> list[Column]:
        return [F.when(blank(lines[name][f]), F.lit(f"Missing or empty field: {name}.{f}")) for f in L.LINE_FIELDS]

    found = []
    for name in L.REQUIRED_LINES:
        found.append(F.when(lines[name].isNull(), F.array(F.lit(f"Missing line: {name}"))).otherwise(F.array_compact(F.array(*fields(name)))))
    for name in L.OPTIONAL_LINES:
        absent = ~F.coalesce(F.array_contains(F.map_keys(lines), name), F.lit(False))
        found.append(
            F.when(absent, F.array().cast("array<string>"))
            .when(lines[name].isNull(), F.array(F.lit(f"Invalid optional line object: {name}")))
            .otherwise(F.array_compact(F.array(*fields(name))))
        )
    found.append(F.array_compact(F.array(*[F.when(blank(analysis[f]), F.lit(f"Missing or empty field: {L.TOP_KEY}.{f}")) for f in L.REPORT_FIELDS])))
    return (
        F.when(parsed.isNull() | analysis.isNull(), F.array(F.lit(f"Missing object: {L.TOP_KEY}")))
        .when(lines.isNull(), F.array(F.lit(f"Missing object: {L.TOP_KEY}.lines")))
        .otherwise(F.concat(*found))
    )


def canonical(parsed: Column) -> Column:
    """Compact JSON with the fixed order of lines and fields, values stripped; absent lines are left out."""
    lines = _lines(parsed)

    def line(name: str) -> Column:
        return F.when(lines[name].isNotNull(), F.struct(*[strip(F.coalesce(lines[name][f], F.lit(""))).alias(f) for f in L.LINE_FIELDS])).alias(name)

    inner = F.struct(
        F.struct(*[line(n) for n in (*L.REQUIRED_LINES, *L.OPTIONAL_LINES)]).alias("lines"),
        *[strip(F.coalesce(parsed[L.TOP_KEY][f], F.lit(""))).alias(f) for f in L.REPORT_FIELDS],
    )
    return F.to_json(F.struct(inner.alias(L.TOP_KEY)))


def flatten_text(parsed: Column) -> Column:
    """All values that are not blank, stripped, in order, joined by line feeds."""
    lines = _lines(parsed)
    values = [lines[n][f] for n in (*L.REQUIRED_LINES, *L.OPTIONAL_LINES) for f in L.LINE_FIELDS]
    values += [parsed[L.TOP_KEY][f] for f in L.REPORT_FIELDS]
    return F.array_join(F.filter(F.transform(F.array(*values), strip), lambda v: v != ""), "\n")


def flatten_any(raw: Column) -> Column:
    """All strings of a JSON text of any nesting that are not blank, stripped, depth first, joined by line feeds; null if it does not parse.

    Depth first is the order of the text, so the strings are read off it: literals that no colon follows. A variant would sort the
    fields of objects by name. Control characters, which no JSON text holds as they are, stand for escaped quotes and backslashes meanwhile.
    """
    quote, back = F.lit("\x01"), F.lit("\x02")
    plain = F.replace(F.replace(raw, F.lit("\\\\"), back), F.lit('\\"'), quote)
    literals = F.regexp_extract_all(plain, F.lit(r'"[^"]*"(?:\s*:)?'), F.lit(0))
    told = F.array_join(F.filter(literals, lambda x: x.endswith('"')), ",")
    told = F.replace(F.replace(told, quote, F.lit('\\"')), back, F.lit("\\\\"))
    texts = F.from_json(F.concat(F.lit("["), told, F.lit("]")), "array<string>")
    found = F.array_join(F.filter(F.transform(texts, strip), lambda x: x != ""), "\n")
    return F.when(F.try_parse_json(raw).isNotNull(), found)


def line_text(parsed: Column, name: str | Column, with_name: bool = True) -> Column:
    """A line's known fields, with its name first; empty if the line is absent."""
    line, name = _lines(parsed)[name], name if isinstance(name, Column) else F.lit(name)
    values = F.filter(F.transform(F.array(*[line[f] for f in L.LINE_FIELDS]), strip), lambda v: v != "")
    head = F.array(name) if with_name else F.array().cast("array<string>")
    return F.when(line.isNull(), F.lit("")).otherwise(F.array_join(F.concat(head, values), "\n"))


def line_texts(parsed: Column, names: Sequence[str] = (*L.REQUIRED_LINES, *L.OPTIONAL_LINES)) -> Column:
    """:func:`line_text` of each name, in order."""
    return F.transform(F.lit(list(names)), lambda n: line_text(parsed, n))


def reference_text(parsed: Column, lines: Column | None = None) -> Column:
    """All that is told, with the names of lines; ``lines`` are :func:`line_texts`, if they are there."""
    lines = line_texts(parsed) if lines is None else lines
    reports = F.transform(F.array(*[parsed[L.TOP_KEY][f] for f in L.REPORT_FIELDS]), strip)
    return F.array_join(F.filter(F.concat(lines, reports), lambda v: v != ""), "\n")


def uncertain_lines(parsed: Column, terms: tuple[str, ...], names: tuple[str, ...] | None = L.REQUIRED_LINES) -> Column:
    """Lines with any of the terms in any field; of all names if ``names`` is None."""
    if names is not None:
        return sum_of([any_of([line_text(parsed, n, False).contains(t) for t in terms]).cast("int") for n in names])
    joined = lambda v: F.concat_ws("\n", *[v[f] for f in L.LINE_FIELDS])
    return F.size(F.filter(F.map_values(_lines(parsed)), lambda v: any_of([joined(v).contains(t) for t in terms])))


def _unknown(value: Column) -> Column:
    """Blank or of the unknown value; a missing value is neither."""
    return value.isNotNull() & (blank(value) | value.contains(L.UNKNOWN_VALUE))


def unknown_lines(parsed: Column) -> Column:
    """Required lines that are absent or unknown in every field but the evidence."""
    lines = _lines(parsed)
    flags = []
    for name in L.REQUIRED_LINES:
        every = F.lit(True)
        for f in L.LINE_FIELDS:
            if f != L.EVIDENCE_FIELD:
                every = every & _unknown(lines[name][f])
        flags.append((lines[name].isNull() | F.coalesce(every, F.lit(False))).cast("int"))
    return sum_of(flags)


def quality_issues(parsed: Column, most_unknown: int = 1) -> Column:
    n = unknown_lines(parsed)
    told = any_of([F.coalesce(matches_any(parsed[L.TOP_KEY][f], L.REPORT_UNCERTAIN), F.lit(False)) for f in L.REPORT_FIELDS])
    issues = F.array_compact(
        F.array(
            F.when(n > most_unknown, F.concat(F.lit("too_many_uncertain_main_lines:"), n.cast("string"))),
            F.when((n > 0) & ~told, F.lit("uncertain_lines_without_report_uncertainty")),
        )
    )
    return (
        F.when(parsed.isNull() | parsed[L.TOP_KEY].isNull(), F.array(F.lit("missing_analysis")))
        .when(_lines(parsed).isNull(), F.array(F.lit("missing_lines")))
        .otherwise(issues)
    )


def sanitized(parsed: Column) -> Column:
    """Struct of ``payload``, with lines whose evidence only denies set to unknown, and ``issues``."""
    known = (*L.REQUIRED_LINES, *L.OPTIONAL_LINES)
    denied = lambda v: F.coalesce(~blank(v[L.EVIDENCE_FIELD]) & matches_any(v[L.EVIDENCE_FIELD], L.HARD_UNCERTAIN) & ~matches_any(v[L.EVIDENCE_FIELD], L.POSITIVE_BASIS), F.lit(False))

    def unknown(v: Column) -> Column:
        return F.struct(*[(strip(v[f]) if f == L.EVIDENCE_FIELD else F.lit(L.UNKNOWN_VALUE)).alias(f) for f in L.LINE_FIELDS])

    lines = _lines(parsed)
    new = F.transform_values(lines, lambda k, v: F.when(k.isin(*known) & denied(v), unknown(v)).otherwise(v))
    issues = F.array_compact(F.array(*[F.when(denied(lines[n]), F.lit(f"{n}: downgraded_to_unknown")) for n in known]))
    payload = F.when(lines.isNotNull(), parsed.withField(L.TOP_KEY, parsed[L.TOP_KEY].withField("lines", new))).otherwise(parsed)
    return F.struct(payload.alias("payload"), F.when(lines.isNull(), F.array().cast("array<string>")).otherwise(issues).alias("issues"))


def judge_score(value: Column) -> Column:
    """A number from 0 to 5, or null."""
    x = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    return F.when(x.between(0, 5), x)


def judge_errors(judgment: Column) -> Column:
    bad = [F.when(judge_score(judgment[f]).isNull(), F.lit(f"Invalid judge score: {f}")) for f in L.JUDGE_SCORES]
    decision = F.when(~F.coalesce(judgment["decision"].isin(*L.JUDGE_DECISIONS), F.lit(False)), F.lit("Invalid decision"))
    reason = F.when(blank(judgment["reason"]), F.lit("Missing or empty field: teacher_judgment.reason"))
    return F.when(judgment.isNull(), F.array(F.lit("Missing object: teacher_judgment"))).otherwise(F.array_compact(F.array(decision, *bad, reason)))


def judge_verdict(judgment: Column, limits: L.JudgeLimits = L.JudgeLimits()) -> Column:
    """Struct of ``average_score``, ``issues`` and ``final_decision`` of a valid judgment."""
    score = {f: judge_score(judgment[f]) for f in L.JUDGE_SCORES}
    total = score[L.JUDGE_SCORES[0]]
    for f in L.JUDGE_SCORES[1:]:
        total = total + score[f]
    decision = strip(judgment["decision"])

    def verdict(average: Column) -> Column:
        low = lambda name, x, least: F.when(x < least, F.concat(F.lit(f"judge_{name}_below_threshold:"), F.format_string("%.2f", x)))
        found = [
            low("average", average, limits.average),
            low("visual_grounding", score["visual_grounding"], limits.grounding),
            low("uncertainty_honesty", score["uncertainty_honesty"], limits.honesty),
            F.when(decision == "reject", F.lit("judge_decision:reject")),
        ]
        if not limits.allow_cautious:
            found.append(F.when(decision == "accept_cautious", F.lit("judge_decision:accept_cautious_not_allowed")))
        return let(F.array_compact(F.array(*found)), lambda i: F.struct(average.alias("average_score"), i.alias("issues"), F.when(F.size(i) > 0, F.lit("reject")).otherwise(decision).alias("final_decision")))

    return let(total / len(L.JUDGE_SCORES), verdict)
