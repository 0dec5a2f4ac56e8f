"""Quality rules as a short-circuit cascade.

Each rule is a Boolean column over the text. On a bounded sample its cost (seconds a row) and its
selectivity (share of rows rejected) are measured; rules then run in descending order of rejection per
cost. The cascade is one CASE expression, so a row leaves at the first rule that rejects it and the
dearer rules below never see it. The order changes only the time taken: a row is kept when all rules keep it.

Null and blank texts have no words, hence fail the minimum length. Very long texts are processed whole
within one row; no row is moved, so ties, repeated rows and skewed keys need no treatment. An empty
table gives an empty result; columns other than the text pass through under their own names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill import scratch
from grainmill.functions.lang import GAP, WORD, let, word_count, words

SYMBOLS = r"[#*$%&|<>]"


def word_chars(text: Column) -> Column:
    """Code points that belong to words."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, "")).cast("long")


def symbol_count(text: Column) -> Column:
    """Characters among ``# * $ % & | < >``."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^#*$%&|<>]+", "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def line_count(text: Column) -> Column:
    """Lines with a word."""
    return F.size(_lines(text)).cast("long")


def repeated_words(word_array: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text, first occurrence included.

    A window's 64-bit hash and its position share one long, so the windows of a text are grouped by
    sorting primitives instead of shuffling one row a word. The low bits hold the position; equal
    neighbours are compared word by word, so two different windows never count as one.
    """
    shift = lambda x, n: F.call_function("shiftleft", x, n)
    back = lambda x, n: F.call_function("shiftright", x, n)

    def counted(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w).cast("long")))
        return let(bits, lambda b: covered(w, b))

    def covered(w: Column, b: Column) -> Column:
        mask = lambda x: x.bitwiseAND(shift(F.lit(1).cast("long"), b) - 1).cast("int")
        # sort_array sorts primitives where array_sort would call a comparator; coalesce says that none is null.
        packed = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.coalesce(shift(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), b).bitwiseOR(i.cast("long")), F.lit(0).cast("long")),
            )
        )

        def same(x: Column, y: Column) -> Column:
            p, q = mask(x), mask(y)
            equal = F.lit(True)
            for k in range(3):
                equal = equal & (F.get(w, p + k) == F.get(w, q + k))
            return (back(x, b) == back(y, b)) & equal

        found = let(
            packed,
            lambda s: F.filter(
                s,
                lambda x, j: F.coalesce((j > 0) & same(x, F.get(s, j - 1)), F.lit(False))
                | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)),
            ),
        )
        places = F.sort_array(F.transform(found, lambda x: F.coalesce(mask(x), F.lit(0))))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - x), F.lit(3))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            ),
        )

    return let(word_array, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(counted(w)))


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": word_count,
    "word_chars": word_chars,
    "n_symbols": symbol_count,
    "n_dup_lines": duplicate_lines,
    "n_lines": line_count,
    "n_repeat_words": lambda t: repeated_words(words(t)),
    "n_upper": lambda t: F.length(F.regexp_replace(F.coalesce(t, F.lit("")), r"\P{Lu}+", "")).cast("long"),
}


class Text:
    """A text column and its measures: a column where one is known already, else an expression over the text."""

    def __init__(self, text: Column, known: dict[str, Column] | None = None):
        self.text, self.known = text, known or {}

    def __getitem__(self, measure: str) -> Column:
        return self.known[measure] if measure in self.known else MEASURES[measure](self.text)


@dataclass(frozen=True)
class Rule:
    """``keep`` maps a :class:`Text` to a Boolean column; null counts as rejected."""

    name: str
    keep: Callable[[Text], Column]


def min_words(least: int) -> Rule:
    return Rule("min_words", lambda t: t["n_words"] >= least)


def max_repeated_share(percent: int) -> Rule:
    def keep(t: Text) -> Column:
        if "n_repeat_words" in t.known:
            return 100 * t["n_repeat_words"] <= percent * t["n_words"]
        return let(words(t.text), lambda w: 100 * repeated_words(w) <= percent * F.size(w))  # the words are cut once

    return Rule("max_repeated_share", keep)


def mean_word_length(least: float, most: float) -> Rule:
    def keep(t: Text) -> Column:
        sizes = F.struct(t["n_words"].alias("n"), t["word_chars"].alias("c"))
        return let(sizes, lambda s: (s["n"] > 0) & (s["c"] >= least * s["n"]) & (s["c"] <= most * s["n"]))

    return Rule("mean_word_length", keep)


def max_symbols_per_word(most: float) -> Rule:
    return Rule("max_symbols_per_word", lambda t: t["n_symbols"] <= most * t["n_words"])


def max_duplicate_line_share(most: float) -> Rule:
    """Duplicate lines over lines with a word; a text without lines passes."""
    return Rule("max_duplicate_line_share", lambda t: t["n_dup_lines"] <= most * t["n_lines"])


def max_upper_share(most: float) -> Rule:
    """Upper-case letters over characters in words."""
    return Rule("max_upper_share", lambda t: t["n_upper"] <= most * t["word_chars"])


#: The thresholds are wide: they reject what no prose shows and leave clean documents alone.
PRODUCTION = (
    min_words(50),
    max_repeated_share(50),
    mean_word_length(2.0, 15.0),
    max_symbols_per_word(0.3),
    max_duplicate_line_share(0.5),
    max_upper_share(0.5),
)


#: What a rule costs a row at least; less cannot be told from noise.
LEAST_SECONDS = 2e-6


#: For filtering a corpus: clean documents may be short.
FILTER = (min_words(1), *PRODUCTION[1:])


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds_per_row: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds_per_row, LEAST_SECONDS)


class Cascade:
    """Rules in the order in which they run."""

    def __init__(self, measured: Sequence[Measured]):
        self.measured = tuple(sorted(measured, key=lambda m: (-m.gain, m.seconds_per_row, m.rule.name)))

    @classmethod
    def fit(cls, df: DataFrame, rules: Sequence[Rule] = PRODUCTION, text: str = "text", sample_rows: int = 2000, seed: int = 17, passes: int = 2, known: Sequence[str] = ()) -> Cascade:
        """Measure each rule on a Bernoulli sample of about ``sample_rows`` rows of the whole table.

        A rule's cost is the least of ``passes`` timed passes, less the least time of a pass that only reads the texts, as starting a job takes longer than a
        cheap rule does. Measures that are ``known`` when the cascade runs are columns of the sample, so that a rule costs what it then costs beside them.
        On an empty table every rule measures 0 and the order is by name.
        """
        total = df.count()
        fraction = min(1.0, sample_rows / max(total, 1))
        drawn = df.select(F.col(text).alias("text")).sample(fraction=fraction, seed=seed).repartition(4)
        sample = scratch.materialize(drawn.withColumns({m: MEASURES[m](F.col("text")) for m in known}), "rule-sample")
        rows = max(sample.count(), 1)

        def timed(keep: Column) -> tuple[float, int]:
            counted = sample.agg(F.sum(F.when(F.coalesce(keep, F.lit(False)), 0).otherwise(1)).alias("n"))
            rejected = counted.first()["n"] or 0  # compiles the expression
            took = []
            for _ in range(passes):
                began = time.perf_counter()
                counted.first()
                took.append(time.perf_counter() - began)
            return min(took), rejected

        idle, _ = timed(F.length("text") >= 0)
        out = []
        for rule in rules:
            took, rejected = timed(rule.keep(Text(F.col("text"), {m: F.col(m) for m in known})))
            out.append(Measured(rule, max(took - idle, 0.0) / rows, rejected / rows))
        return cls(out)

    def verdict(self, text: Column, known: dict[str, Column] | None = None) -> Column:
        """True for rows that every rule keeps; ``known`` are measures that are columns already."""
        out = F.lit(True)
        for m in reversed(self.measured):
            out = F.when(F.coalesce(m.rule.keep(Text(text, known)), F.lit(False)), out).otherwise(F.lit(False))
        return out

    def rejected_by(self, text: Column) -> Column:
        """Name of the first rule, in cascade order, that rejects the row; null when kept."""
        out = F.lit(None).cast("string")
        for m in reversed(self.measured):
            out = F.when(F.coalesce(m.rule.keep(Text(text)), F.lit(False)), out).otherwise(F.lit(m.rule.name))
        return out

    def apply(self, df: DataFrame, text: str = "text") -> DataFrame:
        """The rows kept, with the columns of ``df``."""
        return df.where(self.verdict(F.col(text)))


#: Measures that :func:`digest` makes for every document.
BASE = ("n_words", "n_repeat_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines")


def digest(docs: DataFrame, cascade: Cascade) -> DataFrame:
    """One row a document: the base measures, whether the base rules fail it, and the cascade's verdict.

    The base measures are wanted for every document, so they are made once and the cascade takes them as they are; fit it with :data:`BASE` known. What other
    rules need is made only for documents that the rules before them keep.
    """
    lines = let(_lines(F.col("text")), lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines")))
    repeats = let(words(F.col("text")), lambda x: F.struct(F.size(x).cast("long").alias("n_words"), repeated_words(x).alias("n_repeat_words")))
    sizes = F.struct(word_chars(F.col("text")).alias("word_chars"), symbol_count(F.col("text")).alias("n_symbols"))
    names = {"r": ("n_words", "n_repeat_words"), "s": ("word_chars", "n_symbols"), "l": ("n_dup_lines", "n_lines")}

    def judged(m: Column) -> Column:
        known = {name: m[part][name] for part, group in names.items() for name in group}
        failed = (known["n_words"] < 50) | (100 * known["n_repeat_words"] > 50 * known["n_words"])
        kept = F.when(failed, F.lit(False)).otherwise(cascade.verdict(F.col("text"), known))
        return F.struct(*[c.alias(n) for n, c in known.items()], failed.alias("base_failed"), kept.alias("kept"))

    out = docs.select("doc_id", let(F.struct(repeats.alias("r"), sizes.alias("s"), lines.alias("l")), judged).alias("m"))
    return out.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
