"""Text rewards as columns, each from 0 to 1, over a completion and a parsed reference payload.

A completion or reference that cannot be parsed scores 0. ``REGISTRY`` maps names to builders and takes more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill import lexicons as L
from grainmill.functions import grams, jsonx
from grainmill.functions.lang import let
from grainmill.functions.text import (
    blank,
    clamp,
    contains_any,
    han_count,
    han_runs,
    han_set,
    jaccard,
    mention_score,
    near_han,
    ordered_score,
    pattern_hits,
    presence_score,
    ratio,
    sections,
    strip,
    sum_of,
    term_hits,
)


def _least(limit: float, x: Column) -> Column:
    return F.least(F.lit(limit), x)


def _terms(terms: Sequence[str]) -> Column:
    """The terms as one literal: an expression over it does not grow with their number."""
    return F.lit(list(terms))


def _has(text: Column, terms: Sequence[str]) -> Column:
    return F.exists(_terms(terms), lambda t: text.contains(t))


def _size_of(terms: Sequence[str], told: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(_terms(terms), told))


def unsupported(section: Column, reference: Column, terms: Sequence[str] = L.DETAIL_TERMS) -> Column:
    """Terms in the section that the reference lacks."""
    return _size_of(terms, lambda t: section.contains(t) & ~reference.contains(t))


def assertive(section: Column, patterns: Sequence[str] = L.ASSERTIVE_PATTERNS) -> Column:
    return pattern_hits(section, patterns)


_LINE_TERMS = (*L.UNCERTAIN_TERMS, *L.CAUTIOUS_TERMS, *L.RETAKE_TERMS, *L.DETAIL_TERMS, *L.EVIDENCE_TERMS)
FACTS = ("u", "c", "k", "d", "a", "j", "cov", "terms", "s", "r")


def line_facts(section: Column, reference: Column, needs: Sequence[str] = FACTS, similarity: Column | None = None) -> Column:
    """What the rules of one line ask for, once: struct of u, c, k, d, a, j, cov, terms, s, r; of those that ``needs`` names.

    ``similarity`` is the Jaccard similarity of the two, if it is there.
    """

    def whole(h: Column) -> Column:
        told, given = h["section"], h["reference"]
        known = F.filter(_terms(L.EVIDENCE_TERMS), lambda t: given.contains(t))
        made = {
            "u": lambda: _has(given, L.UNCERTAIN_TERMS),
            "c": lambda: _has(told, L.CAUTIOUS_TERMS),
            "k": lambda: _has(told, L.RETAKE_TERMS),
            "d": lambda: unsupported(told, given).cast("double"),
            "a": lambda: assertive(h["near"]).cast("double"),
            "j": lambda: jaccard(section, reference) if similarity is None else similarity,
            "cov": lambda: F.size(F.filter(known, lambda t: told.contains(t))).cast("double"),
            "terms": lambda: F.size(known).cast("double"),
            "s": lambda: section != "",
            "r": lambda: reference != "",
        }
        return F.struct(*[made[n]().alias(n) for n in FACTS if n in needs])

    near = lambda t: F.struct(t.alias("near"), han_set(t, _LINE_TERMS).alias("section"), han_set(reference, _LINE_TERMS).alias("reference"))
    return let(near_han(section, _LINE_TERMS), lambda t: let(near(t), whole))


def _pairs(cut: Column, lines: Column) -> Column:
    """Array of ``section`` and ``reference`` of the required lines, in order; ``lines`` are :func:`jsonx.line_texts`."""
    return F.array(*[F.struct(F.coalesce(cut[n], F.lit("")).alias("section"), F.get(lines, F.lit(k)).alias("reference")) for k, n in enumerate(L.REQUIRED_LINES)])


def _lines_of(cut: Column, parsed: Column, needs: Sequence[str] = FACTS) -> Column:
    pairs = let(jsonx.line_texts(parsed, L.REQUIRED_LINES), lambda lines: _pairs(cut, lines))
    return F.transform(pairs, lambda x: line_facts(x["section"], x["reference"], needs))


def with_facts(df: DataFrame, completion: str, parsed: str, out: str, needs: Sequence[str] = FACTS) -> DataFrame:
    """Add :func:`facts` of two columns as ``out``, the similarities from :mod:`grainmill.functions.grams`; for many or long texts."""
    text = F.coalesce(F.col(completion), F.lit(""))
    both = F.struct(sections(text, L.LINE_KEYWORDS).alias("cut"), jsonx.line_texts(F.col(parsed)).alias("lines"))
    told = let(both, lambda b: F.struct(_pairs(b["cut"], b["lines"]).alias("pairs"), presence_score(b["cut"], list(L.LINE_KEYWORDS)).alias("presence"), jsonx.reference_text(F.col(parsed), b["lines"]).alias("told")))
    rows = df.select(F.struct("*").alias("row"), text.alias("text"), told.alias("x"), _own(F.col(completion)).alias("own"))
    left, right = F.concat("x.pairs.section", F.array("text")), F.concat("x.pairs.reference", F.array("x.told"))
    rows = rows.withColumn("js", grams.jaccards(left, right))
    lines = F.transform("x.pairs", lambda x, i: line_facts(x["section"], x["reference"], needs, F.get("js", i)))
    found = F.struct(lines.alias("lines"), F.col("x.presence"), F.get("js", F.lit(len(L.REQUIRED_LINES))).alias("similarity"), _doubt(F.col("x.told")).alias("doubt"), F.col("own"))
    # A struct that is only taken apart again would be inlined by Catalyst, its lines computed anew for each reward.
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns if c != out], let(found, lambda x: x).alias(out))


def facts(completion: Column, parsed: Column) -> Column:
    """What rewards of a report share, as one struct: ``lines``, an array of :func:`line_facts` of the required lines; the ``presence`` of
    sections; the ``similarity`` of the whole texts; the ``doubt`` in the reference; and ``own``, what :func:`_own` has of the completion. As a column it serves all of them.
    """
    text = F.coalesce(completion, F.lit(""))

    def each(x: Column) -> Column:
        return F.struct(
            _lines_of(x["cut"], parsed).alias("lines"),
            presence_score(x["cut"], list(L.LINE_KEYWORDS)).alias("presence"),
            jaccard(text, x["told"]).alias("similarity"),
            _doubt(x["told"]).alias("doubt"),
            _own(completion).alias("own"),
        )

    return let(F.struct(sections(text, L.LINE_KEYWORDS).alias("cut"), jsonx.reference_text(parsed).alias("told")), each)


_TEXT_TERMS = (*L.CAUTIOUS_TERMS, *L.RETAKE_TERMS, *L.LINE_KEYWORDS, *[k for group in L.SECTIONS for k in group], *L.REPORT_SAFE, *L.REPORT_BANNED)


def _own(completion: Column) -> Column:
    """What rewards ask of the completion alone, all of its terms looked for in its Han characters: these keep their order."""

    def whole(t: Column) -> Column:
        return F.struct(
            ordered_score(t, L.SECTIONS).alias("ordered"),
            mention_score(t, list(L.LINE_KEYWORDS)).alias("mention"),
            predicted_gate(t).alias("predicted"),
            contains_any(t, L.CAUTIOUS_TERMS).alias("mentioned"),
            term_hits(t, L.CAUTIOUS_TERMS).alias("mentions"),
            safety(t).alias("safe"),
        )

    return let(han_runs(completion, _TEXT_TERMS), whole)


def _doubt(reference: Column) -> Column:
    return _least(1.0, term_hits(reference, L.UNCERTAIN_TERMS) / 6.0)


def _extra(f: Column) -> Column:
    return F.greatest(F.lit(0.0), f["a"] - 1)


def honesty(f: Column) -> Column:
    doubtful = clamp((f["c"] | f["k"]).cast("double") - _least(0.6, 0.2 * f["d"]) - _least(0.6, 0.25 * f["a"]))
    return F.when(f["u"], doubtful).when(~f["s"], 0.0).when(f["c"] | f["k"], 0.55).otherwise(0.9)


def _doubtful(f: Column) -> Column:
    return clamp(f["c"].cast("double") - _least(0.6, 0.2 * f["d"]) - _least(0.6, 0.2 * f["a"]))


def grounding(f: Column) -> Column:
    certain = clamp(f["j"] - _least(0.35, 0.08 * f["d"] + 0.04 * _extra(f)))
    return F.when(~f["s"] | ~f["r"], 0.0).when(f["u"], _doubtful(f)).otherwise(certain)


def evidence(f: Column) -> Column:
    cover = f["cov"] / F.greatest(f["terms"], F.lit(1.0))
    cover = F.when(f["c"], F.greatest(F.lit(0.0), cover - 0.12)).otherwise(cover)
    scored = clamp(0.65 * cover + 0.35 * grounding(f) - _least(0.25, 0.06 * f["d"] + 0.03 * _extra(f)))
    return F.when(~f["s"] | ~f["r"], 0.0).when(f["u"], _doubtful(f)).when(f["terms"] == 0, grounding(f)).otherwise(scored)


def _mean(lines: Column, score: Callable[[Column], Column], when: Callable[[Column], Column], empty: Column | float) -> Column:
    """Mean score of the lines that count; ``empty`` without any."""
    total = lambda some: F.aggregate(some, F.lit(0.0), lambda a, f: a + score(f))
    return let(F.filter(lines, when), lambda some: F.when(F.size(some) > 0, total(some) / F.size(some)).otherwise(empty))


def _penalised(lines: Column, penalty: Callable[[Column], Column]) -> Column:
    return let(_mean(lines, penalty, lambda f: f["s"] & f["r"], F.lit(None).cast("double")), lambda m: F.when(m.isNotNull(), F.greatest(F.lit(0.0), 1 - m)).otherwise(0.0))


def _uncertain_required(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda f: f["u"]))


def expected_gate(lines: Column) -> Column:
    return let(_uncertain_required(lines), lambda n: F.when(n >= 3, "retake").when(n >= 1, "cautious").otherwise("continue"))


def predicted_gate(text: Column) -> Column:
    return F.when(contains_any(text, L.RETAKE_TERMS), "retake").when(contains_any(text, L.CAUTIOUS_TERMS), "cautious").otherwise("continue")


def gate_matrix(expected: Column, predicted: Column, table: dict[str, Sequence[float]] = L.GATE_REWARDS) -> Column:
    out = F.lit(None).cast("double")
    for e, row in table.items():
        for p, value in zip(L.DECISIONS, row, strict=True):
            out = F.when((expected == e) & (predicted == p), F.lit(float(value))).otherwise(out)
    return out


#: What a score of evidence, and a penalty, ask for.
EVIDENCE_FACTS, _PENALTY = ("u", "c", "d", "a", "j", "cov", "terms", "s", "r"), ("u", "c", "d", "a", "s", "r")


def _over(completion: Column, parsed: Column, shared: Column | None, body: Callable[[Column], Column], needs: Sequence[str]) -> Column:
    """``body`` of the lines' facts that it ``needs``: those of the column ``shared``, if it is given, as for several rewards at once."""
    if shared is not None:
        return body(shared["lines"])
    text = F.coalesce(completion, F.lit(""))
    if "j" not in needs:  # Without a similarity no fact asks for more of the completion.
        text = near_han(text, [*_LINE_TERMS, *[k for words in L.LINE_KEYWORDS.values() for k in words]])
    return let(let(text, lambda t: sections(t, L.LINE_KEYWORDS)), lambda c: let(_lines_of(c, parsed, needs), body))


# Rewards of reports.


def report_format(completion: Column, low: int = 120, high: int = 1800) -> Column:
    return let(
        han_count(completion),
        lambda n: F.when(completion.rlike(r"[{}]|```"), 0.0).when(n < low, n / low).when(n <= high, 1.0).otherwise(0.6),
    )


def section_structure(completion: Column, groups: Sequence[Sequence[str]] = L.SECTIONS, keywords: dict = L.LINE_KEYWORDS, shared: Column | None = None) -> Column:
    """``shared`` has the order, mentions and presence of :data:`L.SECTIONS` and :data:`L.LINE_KEYWORDS`, whatever is given here."""
    if shared is not None:
        return 0.45 * shared["own"]["ordered"] + 0.25 * shared["own"]["mention"] + 0.30 * shared["presence"]
    names = list(keywords)
    return 0.45 * ordered_score(completion, groups) + 0.25 * mention_score(completion, names) + 0.30 * presence_score(sections(completion, keywords), names)


def report_alignment(completion: Column, parsed: Column, shared: Column | None = None) -> Column:
    if shared is None:
        return let(facts(completion, parsed), lambda x: report_alignment(completion, parsed, x))
    shape = 0.4 * shared["own"]["ordered"] + 0.3 * shared["own"]["mention"] + 0.3 * shared["presence"]
    covered = _mean(shared["lines"], evidence, lambda x: x["r"], 0.0)
    return 0.45 * shared["similarity"] + 0.35 * covered + 0.20 * shape


def evidence_coverage(completion: Column, parsed: Column, shared: Column | None = None) -> Column:
    return _over(completion, parsed, shared, lambda f: _mean(f, evidence, lambda x: x["r"], 0.0), EVIDENCE_FACTS)


def line_consistency(completion: Column, parsed: Column, shared: Column | None = None) -> Column:
    one = lambda x: F.when(~x["s"], 0.0).when(x["u"], x["c"].cast("double")).otherwise(_least(1.0, 0.2 + 0.8 * x["j"]))
    return _over(completion, parsed, shared, lambda f: _mean(f, one, lambda x: x["r"], 0.0), ("u", "c", "j", "s", "r"))


def hallucination_penalty(completion: Column, parsed: Column, shared: Column | None = None) -> Column:
    def penalty(f: Column) -> Column:
        both = F.when((f["d"] > 0) & (f["a"] > 0), _least(0.6, 0.2 * f["a"])).when(f["u"], _least(0.5, 0.15 * f["a"])).otherwise(0.0)
        return (f["u"] & ~f["c"]).cast("double") + _least(1.0, 0.35 * f["d"]) + both

    return _over(completion, parsed, shared, lambda f: _penalised(f, penalty), _PENALTY)


def caution_balance(completion: Column, parsed: Column, shared: Column | None = None) -> Column:
    own = _own(completion) if shared is None else shared["own"]

    def balance(f: Column, x: Column) -> Column:
        expected, n = expected_gate(f), _uncertain_required(f)
        mentions, predicted = x["mentions"], x["predicted"]
        mean = _mean(f, evidence, lambda x: x["r"] & ~x["u"], 0.0)
        over = lambda k: F.greatest(F.lit(0), mentions - k)
        certain = F.when(predicted == "cautious", 0.35).when(predicted == "retake", 0.70).otherwise(0.0) + 0.03 * over(F.lit(1)) + F.when(mean < 0.35, 0.25).otherwise(0.0)
        careful = F.when((predicted == "continue") & (n >= 2), 0.20).when(predicted == "retake", 0.20).otherwise(0.0) + 0.02 * over(n + 1) + F.when(mean < 0.25, 0.15).otherwise(0.0)
        again = F.when(predicted == "continue", 0.60).when(predicted == "cautious", 0.15).otherwise(0.0)
        return clamp(1 - F.when(expected == "continue", certain).when(expected == "cautious", careful).otherwise(again))

    return _over(completion, parsed, shared, lambda f: let(own, lambda x: balance(f, x)), EVIDENCE_FACTS)


def gate_decision(completion: Column, parsed: Column, shared: Column | None = None) -> Column:
    both = F.struct(_over(completion, parsed, shared, expected_gate, ("u",)).alias("expected"), (predicted_gate(completion) if shared is None else shared["own"]["predicted"]).alias("predicted"))
    return let(both, lambda x: gate_matrix(x["expected"], x["predicted"]))


def uncertainty_honesty(completion: Column, parsed: Column, shared: Column | None = None) -> Column:
    doubt = let(jsonx.reference_text(parsed), _doubt) if shared is None else shared["doubt"]
    own = F.struct((_own(completion) if shared is None else shared["own"]).alias("own"), doubt.alias("doubt"))

    def score(f: Column, x: Column) -> Column:
        expected, predicted, mentioned = expected_gate(f), x["own"]["predicted"], x["own"]["mentioned"]
        none = F.when(x["doubt"] >= 0.5, mentioned.cast("double")).when(mentioned, 0.4).otherwise(0.7)
        bonus = (
            F.when((expected == "retake") & (predicted == "retake"), 0.1)
            .when((expected == "cautious") & predicted.isin("cautious", "retake"), 0.1)
            .when((expected == "continue") & (predicted == "continue"), 0.05)
            .otherwise(0.0)
        )
        return _least(1.0, _mean(f, honesty, lambda x: x["r"], none) + bonus)

    return _over(completion, parsed, shared, lambda f: let(own, lambda x: score(f, x)), ("u", "c", "k", "d", "a", "s", "r"))


def contradiction_penalty(completion: Column, parsed: Column, shared: Column | None = None) -> Column:
    def penalty(f: Column) -> Column:
        bold = (f["a"] > 0) | (f["d"] > 0)
        return (f["c"] & bold).cast("double") + F.when(f["u"] & bold, _least(1.0, 0.5 + 0.2 * f["d"] + 0.2 * f["a"])).otherwise(0.0)

    return _over(completion, parsed, shared, lambda f: _penalised(f, penalty), _PENALTY)


def safety(text: Column, safe: Sequence[str] = L.REPORT_SAFE, banned: Sequence[str] = L.REPORT_BANNED) -> Column:
    return F.when(contains_any(text, banned), 0.0).when(contains_any(text, safe), 1.0).otherwise(0.2)


def report_safety(completion: Column, shared: Column | None = None) -> Column:
    return safety(completion) if shared is None else shared["own"]["safe"]


# Rewards of structured payloads.


def json_schema(parsed: Column) -> Column:
    return (F.size(jsonx.payload_errors(parsed)) == 0).cast("double")


def line_coverage(parsed: Column) -> Column:
    lines = parsed[L.TOP_KEY]["lines"]
    filled = [(~blank(lines[n][f])).cast("int") for n in L.REQUIRED_LINES for f in L.LINE_FIELDS]
    return F.coalesce(sum_of(filled) / len(filled), F.lit(0.0))


def report_coverage(parsed: Column) -> Column:
    filled = [(~blank(parsed[L.TOP_KEY][f])).cast("int") for f in L.REPORT_FIELDS]
    return F.coalesce(sum_of(filled) / len(filled), F.lit(0.0))


def structured_alignment(parsed: Column, reference: Column) -> Column:
    similar = F.get(grams.jaccards(F.array(jsonx.flatten_text(parsed)), F.array(jsonx.flatten_text(reference))), F.lit(0))
    return 0.6 * similar + 0.4 * (0.5 * line_coverage(parsed) + 0.5 * report_coverage(parsed))


def payload_safety(parsed: Column) -> Column:
    text = F.concat_ws("\n", parsed[L.TOP_KEY]["medical_report"], parsed[L.TOP_KEY]["blessing"])
    return F.when(parsed.isNull() | parsed[L.TOP_KEY].isNull(), 0.0).otherwise(safety(text, L.PAYLOAD_SAFE, L.PAYLOAD_BANNED))


# Rewards of plain answers.


def accuracy(completion: Column, solution: Column) -> Column:
    """1 where the answers are equal up to case and outer space; null where either is missing."""
    return (F.lower(strip(completion)) == F.lower(strip(solution))).cast("double")


def think_format(completion: Column) -> Column:
    return completion.rlike(r"(?sd)\A<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>(?=\n|\z)").cast("double")


class Registry(dict):
    """Rewards by name; names end in ``_reward``."""

    def add(self, name: str, builder: Callable[..., Column]) -> None:
        if not name.endswith("_reward"):
            raise ValueError(f"{name} does not end in _reward")
        self[name] = builder

    def columns(self, names: Sequence[str] | None = None, **inputs: Column) -> list[Column]:
        """The rewards, 0 for null; each takes the inputs its parameters name, in the order they were added."""
        out = []
        for name, build in self.items():
            if names is None or name in names:
                wanted = {k: v for k, v in inputs.items() if k in build.__code__.co_varnames[: build.__code__.co_argcount]}
                out.append(F.coalesce(build(**wanted), F.lit(0.0)).alias(name))
        return out


REPORT_REWARDS = Registry()
for _name, _build in {
    "report_format": report_format,
    "section_structure": section_structure,
    "reference_alignment": report_alignment,
    "evidence_coverage": evidence_coverage,
    "line_level_consistency": line_consistency,
    "hallucination_penalty": hallucination_penalty,
    "caution_balance": caution_balance,
    "gate_decision": gate_decision,
    "uncertainty_honesty": uncertainty_honesty,
    "uncertainty_contradiction_penalty": contradiction_penalty,
}.items():
    REPORT_REWARDS.add(f"{_name}_reward", _build)
REPORT_REWARDS.add("safety_language_reward", report_safety)

STRUCTURED_REWARDS = Registry()
for _name, _build in {
    "json_schema": json_schema,
    "line_field_coverage": line_coverage,
    "report_field_coverage": report_coverage,
    "reference_alignment": structured_alignment,
    "safety_language": payload_safety,
}.items():
    STRUCTURED_REWARDS.add(f"{_name}_reward", _build)
