"""Answers compared as mathematics: ``1/2``, ``0.5`` and ``\\frac{1}{2}`` are one answer.

A text's answer is the inside of its first ``\\boxed{}``, else of its first LaTeX span, else the whole text, if that has no words. An answer is read straight
into a value at a point, a random rational for each of its variables. Rational arithmetic is exact, so two
rational expressions that agree at several points are the same but for a chance of about one in a million for each point and degree.
Roots, logarithms and the like are taken in floating point and compared within ``TOLERANCE``.

Reading and comparing run in Arrow batches within tasks: a row is a few microseconds of work for each character, and no row needs another.
Distinct pairs are compared once where answers repeat (:func:`with_accuracy`). An answer longer than ``LONGEST`` characters is no expression.
"""

from __future__ import annotations

import cmath
import random
import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9
POINTS = 3
LONGEST = 2000
#: Powers beyond this are taken in floating point.
MOST_POWER = 64
_SPANS = (r"\$\$(.+?)\$\$", r"\$(.+?)\$", r"\\\[(.+?)\\\]", r"\\\((.+?)\\\)")
_TOKEN = re.compile(r"\s*(\d+\.?\d*|\.\d+|\\[A-Za-z]+|\\%|\*\*|[A-Za-z]+|\S)")
_FUNCTIONS = {"sqrt": cmath.sqrt, "ln": cmath.log, "log": cmath.log10, "exp": cmath.exp, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan}
_CONSTANTS = {"pi": cmath.pi, "e": cmath.e, "i": 1j}
#: Spacing and sizes that mean nothing, and other names of operators.
_NOTHING = re.compile(r"\\(?:left|right|displaystyle|limits|quad|qquad|big[lr]?|Big[lr]?)(?![A-Za-z])|\\[,;!: ]|~|\\(?:text|mathrm|textbf|mbox)\s*\{[^{}]*\}|\^\s*\{?\s*\\circ\s*\}?|\\\$")
_NAMES = {"\\cdot": "*", "\\times": "*", "**": "^", "\\div": "/", "×": "*", "·": "*", "÷": "/", "−": "-", "\\%": "%", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "π": "\\pi", "\\lbrace": "{", "\\rbrace": "}"}


#: A plain text with a word is prose.
_WORD = re.compile(r"(?<![\\A-Za-z])(?!(?:sqrt|ln|log|exp|sin|cos|tan|pi)(?![A-Za-z]))[A-Za-z]{2,}")


class Unreadable(ValueError):
    """The text is no expression that this module knows."""


def inside(text: str) -> str | None:
    """The answer within a text; prose without a box or a span has none."""
    at = text.find("\\boxed{")
    if at >= 0:
        depth = 0
        for i in range(at + 6, len(text)):
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            if not depth:
                return text[at + 7 : i]
        return None
    for span in _SPANS:
        if found := re.search(span, text, re.DOTALL):
            return found[1]
    return None if _WORD.search(text) else text


class Reader:
    """Recursive descent over the tokens of one expression, into its value at a point."""

    def __init__(self, text: str, seed: int):
        self.tokens = [_NAMES.get(t, t) for t in _TOKEN.findall(text)]
        self.at, self.seed = 0, seed

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        token = self.peek()
        if not token or (wanted and token != wanted):
            raise Unreadable(f"{token or 'the end'} where {wanted or 'more'} was due")
        self.at += 1
        return token

    def whole(self):
        value = self.sum()
        if self.peek():
            raise Unreadable(f"unexpected {self.peek()}")
        return value

    def sum(self):
        value = self.product()
        while self.peek() in ("+", "-"):
            value = value + self.product() if self.take() == "+" else value - self.product()
        return value

    def product(self):
        sign = 1
        while self.peek() in ("+", "-"):
            sign = -sign if self.take() == "-" else sign
        value = self.power()
        while (token := self.peek()) and token not in ("+", "-", ")", "}", "]", ","):
            if token in ("*", "/"):
                self.take()
                if self.peek() in ("+", "-"):  # a sign binds the factor that follows
                    sign = -sign if self.take() == "-" else sign
                value = value * self.power() if token == "*" else value / self.power()
            elif token == "%":
                self.take()
                value = value / 100
            else:
                value = value * self.power()
        return sign * value

    def power(self):
        base = self.atom()
        while self.peek() == "!":
            self.take()
            if not isinstance(base, Fraction) or base.denominator != 1 or not 0 <= base <= 100:
                raise Unreadable("a factorial of no small number")
            value = 1
            for k in range(2, int(base) + 1):
                value *= k
            base = Fraction(value)
        if self.peek() != "^":
            return base
        self.take()
        sign = 1
        if self.peek() == "-":
            self.take()
            sign = -1
        exponent = sign * self.power()
        if isinstance(base, Fraction) and isinstance(exponent, Fraction):
            if exponent.denominator == 1 and abs(exponent) <= MOST_POWER:
                return base ** int(exponent)
            return complex(base) ** float(exponent)
        return complex(base) ** complex(exponent)

    def group(self, close: str):
        value = self.sum()
        self.take(close)
        return value

    def argument(self):
        """What follows a command: a group, or a single digit or factor."""
        if self.peek() in ("{", "("):
            return self.group("}" if self.take() == "{" else ")")
        token = self.peek()
        if token[:1].isdigit() and len(token) > 1 and token.isdigit():
            self.tokens[self.at] = token[1:]
            return Fraction(token[0])
        return self.atom()

    def atom(self):
        token = self.take()
        if token[0].isdigit() or token[0] == ".":
            return Fraction(token)
        if token in ("(", "{", "["):
            return self.group({"(": ")", "{": "}", "[": "]"}[token])
        if token == "|":
            value = self.sum()
            self.take("|")
            return abs(value)
        if token == "\\frac":
            return self.argument() / self.argument()
        name = token.lstrip("\\")
        if token == "√":
            name = "sqrt"
        if name in _FUNCTIONS:
            return self.function(name)
        if name in _CONSTANTS and (token[0] == "\\" or name != "pi" or token == "pi"):
            return complex(_CONSTANTS[name])
        if token[0] == "\\":
            return self.variable(token)
        if token.isalpha():  # letters in a row are factors
            self.tokens[self.at : self.at] = list(token[1:])
            return self.variable(token[0]) if token[0] not in _CONSTANTS else complex(_CONSTANTS[token[0]])
        raise Unreadable(f"unexpected {token}")

    def function(self, name: str):
        if name == "sqrt" and self.peek() == "[":
            self.take()
            root = self.group("]")
            return complex(self.argument()) ** (1 / complex(root))
        if self.peek() == "^":  # sin^2 x
            self.take()
            power = self.argument()
            return _FUNCTIONS[name](complex(self.argument())) ** complex(power)
        value = self.argument()
        if name == "sqrt" and isinstance(value, Fraction) and value >= 0:
            exact = Fraction(round(value.numerator**0.5), round(value.denominator**0.5)) if value.numerator < 1 << 52 and value.denominator < 1 << 52 else None
            if exact is not None and exact * exact == value:
                return exact
        return _FUNCTIONS[name](complex(value))

    def variable(self, name: str):
        if self.peek() == "_":
            self.take()
            if self.peek() == "{":
                self.take()
                while (token := self.take()) != "}":
                    name += token
            else:
                name += self.take()
        if not re.fullmatch(r"\\?[A-Za-z]\w*|\\[A-Za-z]+", name):
            raise Unreadable(f"unexpected {name}")
        return 1 + Fraction(random.Random(f"{self.seed} {name}").randrange(1, 1_000_000), 1_000_000)


def parts(text: str) -> tuple[str, list[str]]:
    """The kind of an answer (``tuple``, ``set``, an interval's brackets or ``one``) and its elements."""
    text = _NOTHING.sub(" ", text).strip().rstrip(".").strip()
    for old, new in (("\\{", "\x01"), ("\\}", "\x02"), ("\\lbrace", "\x01"), ("\\rbrace", "\x02")):
        text = text.replace(old, new)
    kind = "one"
    if len(text) > 1 and text[0] + text[-1] in ("()", "[]", "(]", "[)", "\x01\x02"):
        kind = {"\x01\x02": "set"}.get(text[0] + text[-1], text[0] + text[-1])
        inner = _split(text[1:-1])
        if inner is not None and (len(inner) > 1 or kind == "set"):
            return kind, inner
    plain = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text)  # thousands
    found = _split(plain)
    return ("one", [plain]) if found is None or len(found) < 2 else ("tuple", found)


def _split(text: str) -> list[str] | None:
    """At commas outside of brackets; None if brackets do not match."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{\x01") - (c in ")]}\x02")
        if depth < 0:
            return None
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return None if depth else [*out, text[start:]]


def values(text: str) -> list:
    """The value at each point; that of an equation is what its sides differ by, or its right side if the left is a variable."""
    sides = re.split(r"(?<![<>!])=", text)
    if len(sides) > 2 or not sides[-1].strip():
        raise Unreadable("a chain of equations")
    if len(sides) == 2 and re.fullmatch(r"\s*\\?[A-Za-z]\w?(_\{?\w+\}?)?(\([A-Za-z]\))?\s*", sides[0]):
        sides = sides[1:]
    found = [[Reader(s, seed).whole() for s in sides] for seed in range(POINTS)]
    return [("equation", v[0] - v[1]) if len(v) == 2 else ("value", v[0]) for v in found]


def near(a, b) -> bool:
    if isinstance(a, Fraction) and isinstance(b, Fraction):
        return a == b
    a, b = complex(a), complex(b)
    return abs(a - b) <= TOLERANCE * max(1.0, abs(a), abs(b))


def same(a: list, b: list) -> bool:
    if {k for k, _ in a} != {k for k, _ in b}:
        return False
    if a[0][0] == "value":
        return all(near(x, y) for (_, x), (_, y) in zip(a, b, strict=True))
    if any(not y for _, y in b) or any(not x for _, x in a):
        return all(bool(x) == bool(y) for (_, x), (_, y) in zip(a, b, strict=True))
    return near(a[0][1] / b[0][1], a[1][1] / b[1][1]) and near(a[0][1] / b[0][1], a[2][1] / b[2][1])  # equations up to a factor


def accurate(completion: str | None, solution: str | None) -> float | None:
    """1 where the completion's answer equals the solution's, else 0; null where either is missing or its value fails, as in a division by zero.

    A solution that is no expression is compared as text, up to case and outer space.
    """
    if completion is None or solution is None:
        return None
    try:
        gold_text = inside(solution)
        kind, gold = parts(gold_text) if gold_text is not None and len(gold_text) <= LONGEST else (None, [])
        gold = [values(g) for g in gold]
    except (Unreadable, RecursionError):
        gold = []
    except (ArithmeticError, ValueError):
        return None
    if not gold:
        return float(completion.strip().lower() == solution.strip().lower())
    try:
        own_text = inside(completion)
        if own_text is None or len(own_text) > LONGEST:
            return 0.0
        own_kind, own = parts(own_text)
        own = [values(v) for v in own]
    except (Unreadable, RecursionError):
        return 0.0
    except (ArithmeticError, ValueError):
        return None
    if len(own) != len(gold) or (kind != own_kind and {kind, own_kind} != {"tuple", "()"}):
        return 0.0
    try:
        if kind != "set":
            return float(all(same(a, b) for a, b in zip(own, gold, strict=True)))
        left = list(gold)
        for a in own:
            match = next((b for b in left if same(a, b)), None)
            if match is None:
                return 0.0
            left.remove(match)
        return 1.0
    except (ArithmeticError, ValueError):
        return None


def accuracy(completion: Column, solution: Column) -> Column:
    """:func:`accurate` as a column."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for own, gold in batches:
            yield pd.Series([accurate(a, b) for a, b in zip(own, gold, strict=True)], dtype="float64")

    return run(completion, solution)


def with_accuracy(df: DataFrame, completion: str, solution: str, out: str = "accuracy") -> DataFrame:
    """Add ``out``, reading each distinct pair once, which pays where few answers stand in many rows.

    Columns whose names begin with ``_own`` or ``_gold`` are its own.
    """
    pairs = df.select(F.col(completion).alias("_own"), F.col(solution).alias("_gold")).distinct()
    pairs = pairs.withColumn(out, accuracy(F.col("_own"), F.col("_gold")))
    same_pair = F.col(completion).eqNullSafe(F.col("_own")) & F.col(solution).eqNullSafe(F.col("_gold"))
    return df.drop(out).join(pairs, same_pair, "left").drop("_own", "_gold")
