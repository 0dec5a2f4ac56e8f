"""Decisions to continue, be cautious or retake: ladders of conditions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill import lexicons as L
from grainmill.functions.lang import let
from grainmill.functions.text import blank, contains_any, pick, strip


def normalize(decision: Column) -> Column:
    """One of the three decisions; what is unknown is cautious."""
    known = {**{d: d for d in L.DECISIONS}, **{v: k for k, v in L.DECISION_LABELS.items()}}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(table[F.lower(strip(decision))], F.lit("cautious"))


def label(decision: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in L.DECISION_LABELS.items() for x in kv])[decision]


def metadata(decision: Column) -> Column:
    """Struct of ``clarity``, ``visible_lines`` and ``occlusion`` that a decision alone implies."""
    out = F.lit(None).cast("struct<clarity:string,visible_lines:int,occlusion:string>")
    for d, (clarity, lines, occlusion) in L.DECISION_METADATA.items():
        out = F.when(decision == d, F.struct(F.lit(clarity).alias("clarity"), F.lit(lines).alias("visible_lines"), F.lit(occlusion).alias("occlusion"))).otherwise(out)
    return out


def from_counts(uncertain: Column, most_continue: int = 0, most_cautious: int = 3) -> Column:
    return F.when(uncertain <= most_continue, "continue").when(uncertain <= most_cautious, "cautious").otherwise("retake")


def from_reasons(reasons: Column, severe: tuple[str, ...] = L.SEVERE_REASONS) -> Column:
    return F.when(F.coalesce(F.arrays_overlap(reasons, F.array(*[F.lit(s) for s in severe])), F.lit(False)), "retake").otherwise("cautious")


def whole_number(text: Column) -> Column:
    """Integer value of a text, 0 if it has none."""
    return let(strip(text.cast("string")), lambda t: F.coalesce(F.when(t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("int")), F.lit(0)))


def policy(gate: Column) -> Column:
    """Struct of decision, label, clarity, visible lines, occlusion, rationale and error of a gate object.

    ``gate`` has string fields decision, decision_label, suggestion, clarity, visible_lines, occlusion, rationale.
    """
    given = F.coalesce(*[F.nullif(gate[f], F.lit("")) for f in ("decision", "decision_label", "suggestion")])
    field = lambda f: strip(F.coalesce(gate[f], F.lit("")))
    error = F.when(gate.isNull(), "Missing gate_policy object.")
    for f in ("clarity", "occlusion", "rationale"):
        error = error.when(blank(gate[f]), f"Missing gate field: {f}")
    return let(
        normalize(F.coalesce(given, F.lit(""))),
        lambda d: F.struct(
            d.alias("decision"),
            label(d).alias("decision_label"),
            field("clarity").alias("clarity"),
            whole_number(F.coalesce(gate["visible_lines"], F.lit(""))).alias("visible_lines"),
            field("occlusion").alias("occlusion"),
            field("rationale").alias("rationale"),
            error.alias("error"),
        ),
    )


def softmax(logits: Column) -> Column:
    shifted = lambda x: let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return let(shifted(logits), lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t)))


def argmax(values: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def margin(values: Column) -> Column:
    return let(F.sort_array(values, asc=False), lambda s: s[0] - s[1])


def thresholded(probabilities: Column, limits: L.GateThresholds = L.GateThresholds()) -> Column:
    """Decision from the probabilities of continue, cautious and retake, in this order."""

    def ladder(s: Column) -> Column:
        top, name = s["top"], s["name"]
        weak = ((name == "continue") & (top < limits.least_continue)) | ((name == "retake") & (top < limits.least_retake))
        return F.when((top < limits.least) | (s["margin"] < limits.margin) | weak, "cautious").otherwise(name)

    name = F.get(F.array(*[F.lit(d) for d in L.DECISIONS]), argmax(probabilities))
    return let(F.struct(F.array_max(probabilities).alias("top"), name.alias("name"), margin(probabilities).alias("margin")), ladder)


def visibility_cautious(decision: Column, clarity: Column, occlusion: Column, lines: Column) -> Column:
    return (decision.isin("cautious", L.DECISION_LABELS["cautious"])) | (clarity == "一般") | (occlusion == "轻微") | lines.isin(2, 3)


def visibility_retake(decision: Column, clarity: Column, occlusion: Column, lines: Column) -> Column:
    return (decision.isin("retake", L.DECISION_LABELS["retake"])) | (clarity == "模糊") | (occlusion == "明显") | (lines < 2)


def line_uncertain(line: Column, core: tuple[str, ...] = ("清晰度", "长度", "深浅", "图像依据"), markers: tuple[str, ...] = L.RUNTIME_MARKERS) -> Column:
    """The runtime rule over four fields: blank counts as uncertain, a missing field does not."""
    flag = lambda f: line[f].isNotNull() & (blank(line[f]) | contains_any(line[f], markers))
    clarity, evidence = core[0], core[3]
    n = flag(core[0]).cast("int") + flag(core[1]).cast("int") + flag(core[2]).cast("int") + flag(core[3]).cast("int")
    return F.coalesce(((flag(clarity) | flag(evidence)) & (n >= 1)) | (n >= 3), F.lit(False))


def force_low_confidence(main: Column, total: Column, assessed: Column, cautious: Column, visible: Column) -> Column:
    return (main >= 2) | (assessed & (main == 1) & (cautious | (visible < 4))) | ((total >= 3) & cautious)


def refine(decision: Column, main: Column, forced: Column) -> Column:
    return F.when(decision == "retake", "retake").when((main >= 2) | (decision == "cautious") | forced, "cautious").otherwise("continue")


def caution_message(key: Column, templates: tuple[str, ...], lines: Column) -> Column:
    """A template, the same for the same key, with ``{line_text}`` filled in."""
    return F.replace(pick(key, templates), F.lit("{line_text}"), lines)
