"""Text measures as columns: no Python runs on executors."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions.lang import let

#: Unicode white space, with the four separators that other languages' regex engines count too.
_SPACE = r"(?U)[\s\x1c-\x1f]"


#: Its characters one by one.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends. Only these are looked at, where a pattern would be tried at all white space within."""
    return F.btrim(text, F.lit(_SPACES))


def blank(text: Column) -> Column:
    """Null, empty, or white space alone."""
    return F.coalesce(strip(text) == "", F.lit(True))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_SPACE}+", "")


def stem(path: Column) -> Column:
    """Last component of a path without its last suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def cluster_key(path: Column, pattern: str = r"^(.+)\.rf\.[^.]+$") -> Column:
    """The stem without its augmentation suffix; null without a path."""
    return let(stem(path), lambda s: let(F.regexp_extract(s, pattern, 1), lambda b: F.when(b == "", s).otherwise(b)))


def any_of(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    return any_of([text.contains(t) for t in terms])


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    return any_of([text.rlike("(?d)" + p) for p in patterns])


def sum_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def term_count(text: Column, term: str) -> Column:
    """Occurrences that do not overlap."""
    # Bytes are known, characters would be counted.
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term)))) / len(term.encode())).cast("int")


def han_runs(text: Column, terms: Sequence[str]) -> Column:
    """The Han characters, a line feed for what lies between them: it holds terms of such characters where, and as often as, the text does, and is
    shorter where many are looked for. With a term of other characters, the text itself.
    """
    return F.regexp_replace(text, r"[^一-鿿]+", "\n") if all(re.fullmatch("[一-鿿]+", t) for t in terms) else text


def han_set(text: Column, terms: Sequence[str]) -> Column:
    """As :func:`han_runs`, but each run of Han characters once: it holds the terms that the text does, not as often, and is short."""
    runs = han_runs(text, terms)
    return text if runs is text else F.array_join(F.array_distinct(F.split(runs, "\n")), "\n")


def near_han(text: Column, terms: Sequence[str], gap: int = 4) -> Column:
    """As :func:`han_runs`, but what lies between Han characters is kept up to a length of ``gap``: it also holds the matches of patterns that let no
    more than that between such terms, without line feeds.
    """
    return F.regexp_replace(text, f"[^一-鿿]{{{gap + 1},}}", "\n") if all(re.fullmatch("[一-鿿]+", t) for t in terms) else text


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """Sum over the terms; terms may overlap each other."""
    return let(han_runs(text, terms), lambda t: sum_of([term_count(t, x) for x in terms]))


def pattern_hits(text: Column, patterns: Sequence[str]) -> Column:
    """Matches of all patterns; a dot matches all but the line feed."""
    return sum_of([F.regexp_count(text, F.lit("(?d)" + p)) for p in patterns])


def han_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^一-鿿]+", ""))


def ngram_set(text: Column, n: int = 2) -> Column:
    """Distinct character n-grams of the text without white space; a shorter text is its own only one."""

    # A match takes one character and looks at those that follow.
    every = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=({'.' * n}))."), 1))
    return let(compact(F.coalesce(text, F.lit(""))), lambda t: F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(every(t)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 when either is empty."""
    return let(
        F.size(F.array_intersect(a, b)),
        lambda both: F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both)),
    )


def jaccard(a: Column, b: Column, n: int = 2) -> Column:
    return let(F.struct(ngram_set(a, n).alias("a"), ngram_set(b, n).alias("b")), lambda s: set_jaccard(s["a"], s["b"]))


def first_position(text: Column, keywords: Sequence[str]) -> Column:
    """Smallest position, from 1, of any keyword; null if none occurs."""
    found = [F.when(text.contains(k), F.locate(k, text)) for k in keywords]
    return F.least(*found) if len(found) > 1 else found[0]


def ordered_score(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Share of keyword groups that first occur after the last group counted."""
    state = F.struct(F.lit(0).alias("last"), F.lit(0).alias("hits"))
    step = lambda s, p: F.when(p > s["last"], F.struct(p.alias("last"), (s["hits"] + 1).alias("hits"))).otherwise(s)
    positions = F.array(*[F.coalesce(first_position(text, g), F.lit(0)) for g in groups])
    return F.aggregate(positions, state, step, lambda s: s["hits"] / len(groups))


def mention_score(text: Column, names: Sequence[str]) -> Column:
    return sum_of([text.contains(n).cast("int") for n in names]) / len(names)


def sections(text: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Struct with a field for each name: the text from its first keyword up to the next name's; null if absent.

    Names that start at the same place keep their order, so the earlier one is empty.
    """
    names = list(keywords)

    def cut(at: Column) -> Column:
        out = []
        for i, name in enumerate(names):
            later = [
                F.when((at[f"p{j}"] > at[f"p{i}"]) if j < i else (at[f"p{j}"] >= at[f"p{i}"]), at[f"p{j}"]) for j in range(len(names)) if j != i
            ]
            end = F.least(*later, F.length(text) + 1) if later else F.length(text) + 1
            out.append(F.when(at[f"p{i}"].isNotNull(), strip(F.substr(text, at[f"p{i}"], F.coalesce(end, F.length(text) + 1) - at[f"p{i}"]))).alias(name))
        return F.struct(*out)

    return let(F.struct(*[first_position(text, keywords[n]).alias(f"p{i}") for i, n in enumerate(names)]), cut)


def presence_score(found: Column, names: Sequence[str]) -> Column:
    """Share of names whose section is not empty."""
    return sum_of([F.coalesce(found[n] != "", F.lit(False)).cast("int") for n in names]) / len(names)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column) -> Column:
    """Zero where the divisor is zero or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def pick(key: Column, choices: Sequence[str]) -> Column:
    """One of the choices, the same for the same key."""
    return F.get(F.array(*[F.lit(c) for c in choices]), F.pmod(F.xxhash64(key), F.lit(len(choices))).cast("int"))


def duration(seconds: Column) -> Column:
    """``mm:ss``, or ``hh:mm:ss`` from one hour on."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def display_sections(text: Column, headings: Sequence[str], core: Sequence[str], energy: Sequence[str]) -> Column:
    """Array of ``title``, ``body``, ``module``: paragraphs, numbering removed, with a leading heading split off.

    A paragraph without a heading has an empty title; modules are core, energy and guidance.
    """

    def one(part: Column) -> Column:
        plain = F.regexp_replace(part, r"(?U)\A\s*(?:[一二三四五六七八九十]+、|\d+[.、])\s*", "")

        def titled(p: Column) -> Column:
            title, body = F.lit(""), p
            for h in reversed(headings):
                opens = p.startswith(h + "：") | p.startswith(h + ":")
                title = F.when(opens | (p == h), F.lit(h)).otherwise(title)
                body = F.when(opens, strip(F.substr(p, F.lit(len(h) + 2)))).when(p == h, F.lit("")).otherwise(body)
            module = lambda t: F.when(t.isin(*core), "core").when(t.isin(*energy), "energy").otherwise("guidance")
            return let(F.struct(title.alias("t"), body.alias("b")), lambda s: F.struct(s["t"].alias("title"), s["b"].alias("body"), module(s["t"]).alias("module")))

        return let(plain, titled)

    parts = F.filter(F.transform(F.split(strip(F.coalesce(text, F.lit(""))), r"(?U)\n\s*\n"), strip), lambda p: p != "")
    return F.transform(parts, one)


def should_emit(index: Column, total: Column, every: int) -> Column:
    """First, last, and every so many."""
    at = (index == 1) | (index == total)
    return at | (index % every == 0) if every > 0 else at


def progress(name: Column, index: Column, total: Column, elapsed: Column) -> Column:
    """One line: place, share, time gone and left, speed; ``elapsed`` in seconds."""

    def line(s: Column) -> Column:
        left = F.when(s["rate"] > 0, (total - index) / s["rate"]).otherwise(0.0)
        return F.format_string("[%s] %d/%d (%.1f%%) elapsed=%s eta=%s speed=%.2f samples/s", name, index, total, 100.0 * index / total, duration(s["spent"]), duration(left), s["rate"])

    spent = F.greatest(elapsed, F.lit(1e-6))
    return let(F.struct(spent.alias("spent"), (index / spent).alias("rate")), line)


def model_name(path: Column) -> Column:
    """Last component of a path; of a checkpoint with its parent before it."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    return let(parts, lambda p: F.when(F.element_at(p, -1).startswith("checkpoint-"), F.concat_ws("_", F.try_element_at(p, F.lit(-2)), F.element_at(p, -1))).otherwise(F.element_at(p, -1)))


def or_default(value: Column, default: str | Column | None) -> Column:
    """The default for null and empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default if isinstance(default, Column) else F.lit(default))
