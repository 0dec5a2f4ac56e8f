"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score is one inner product of shared weights with hashed features of its words; ordered
thresholds turn it into the probability that the grade exceeds each step, hence the expected grade and
the probability of the top grade, by which documents are selected. Features are the distinct words, in
lower case and by their shape (``THAT!!`` has the shape ``A!``), divided by the root of the number of distinct
words, and two of the text as a whole: its length and its share of distinct words. A word's share
of the score does not depend on its neighbours, so words are scored once in a worker and looked up after.

The model learns from a bounded sample, at most about ``sample_rows`` rated documents and ``sample_features`` features (8 bytes each) of theirs, chosen by a hash of the id;
prediction reads every whole text. Other columns pass through under whatever name; ``expected_grade``, ``top_probability`` and ``kept`` are replaced. Null and blank texts have features of their length alone. Null ratings teach nothing; where
none is given, every document gets the middle grade. Ratings of the same document all count. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill import scratch

DIM = 1 << 16
WORDS_KEPT = 500_000
_SHAPES = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1"))
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % DIM


def word_features(word: str) -> tuple[int, int]:
    shape = word
    for pattern, to in _SHAPES:
        shape = pattern.sub(to, shape)
    return _hash("w " + _EDGE.sub("", word.lower())), _hash("s " + shape)


def text_features(n_words: int, n_distinct: int) -> tuple[int, int]:
    share = 10 * n_distinct // n_words if n_words else 0
    return _hash(f"n {int(log2(n_words + 1))}"), _hash(f"d {share} {min(3, int(log2(n_words + 1)) // 3)}")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    words = (text or "").split()
    distinct = set(words)
    places = [p for w in sorted(distinct) for p in word_features(w)]
    values = [1 / sqrt(len(distinct))] * len(places) if distinct else []
    return np.array([*places, *text_features(len(words), len(distinct))], np.int32), np.array([*values, 1.0, 1.0], np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Model:
    """``weights`` shared by all steps; ``thresholds`` ascending, one below each grade but the first."""

    weights: np.ndarray
    thresholds: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def fit(cls, rows: Sequence[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, ridge: float = 2e-5, rounds: int = 200, rate: float = 0.1) -> Model:
        """Maximum penalised likelihood by Adam on all rows at once, from zero."""
        places = np.concatenate([p for p, _ in rows])
        values = np.concatenate([v for _, v in rows]).astype(float)
        sizes = np.array([len(p) for p, _ in rows])
        starts, row = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(rows)), sizes)
        n = len(rows)
        share = np.array([(grades <= k).mean() for k in range(n_grades - 1)]).clip(1 / (n + 2), 1 - 1 / (n + 2))
        theta = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
        params = np.concatenate([np.zeros(DIM), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))])
        m1, m2 = np.zeros_like(params), np.zeros_like(params)
        for t in range(1, rounds + 1):
            gaps = np.exp(params[DIM + 1 :])
            theta = params[DIM] + np.concatenate([[0], np.cumsum(gaps)])
            s = np.add.reduceat(params[places] * values, starts)
            a = np.where(grades < n_grades - 1, _sigmoid(theta[np.minimum(grades, n_grades - 2)] - s), 1.0)
            b = np.where(grades > 0, _sigmoid(theta[np.maximum(grades - 1, 0)] - s), 0.0)
            p = np.maximum(a - b, 1e-9)
            slope = (1 - a - b) / n
            grad = np.zeros_like(params)
            grad[:DIM] = np.bincount(places, weights=slope[row] * values, minlength=DIM) + ridge * params[:DIM]
            up = np.bincount(np.minimum(grades, n_grades - 2), weights=np.where(grades < n_grades - 1, -a * (1 - a) / p, 0) / n, minlength=n_grades - 1)
            down = np.bincount(np.maximum(grades - 1, 0), weights=np.where(grades > 0, b * (1 - b) / p, 0) / n, minlength=n_grades - 1)
            each = up + down
            grad[DIM] = each.sum()
            grad[DIM + 1 :] = np.cumsum(each[::-1])[::-1][1:] * gaps
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            params -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        return cls(params[:DIM], params[DIM] + np.concatenate([[0], np.cumsum(np.exp(params[DIM + 1 :]))]))

    def grades(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of the top grade."""
        above = 1 - _sigmoid(self.thresholds[None, :] - scores[:, None])
        return above.sum(1), above[:, -1]


class Scorer:
    """A model with the scores of the words its worker has seen."""

    _made: dict[str, Scorer] = {}

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    @classmethod
    def of(cls, model: Model) -> Scorer:
        if model.key not in cls._made:
            cls._made.clear()
            cls._made[model.key] = cls(model)
        return cls._made[model.key]

    def _word(self, word: str) -> float:
        a, b = word_features(word)
        self.known[word] = out = float(self.model.weights[a] + self.model.weights[b])
        return out

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        distinct, get, make = set(words), self.known.get, self._word
        total = sum(sorted(s if (s := get(w)) is not None else make(w) for w in distinct))
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        whole = sum(float(self.model.weights[p]) for p in text_features(len(words), len(distinct)))
        return (total / sqrt(len(distinct)) if distinct else 0.0) + whole


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_rows: int = 6000, sample_features: int = 6_000_000, seed: int = 9) -> Model:
    """Fit on a sample of the rated documents as the module says; ``ratings`` has the id and a grade from 0."""
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).between(0, n_grades - 1)).select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
    n = rated.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = min(1.0, sample_rows / max(n, 1))
    chosen = rated.where(draw < F.lit(share))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p.tobytes() for p, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["id", "grade", "p", "v"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    made = scratch.materialize(sample.mapInArrow(run, f"id {kind}, grade int, p binary, v binary"), "rated-features")
    size = (made.agg(F.sum(F.length("p"))).first()[0] or 0) / 4
    rows = made.where(draw < F.lit(share * min(1.0, sample_features / max(size, 1)))).toArrow().sort_by([("id", "ascending"), ("grade", "ascending"), ("p", "ascending")])
    if not rows.num_rows:
        return Model(np.zeros(DIM), np.linspace(-1, 1, n_grades - 1) if n_grades > 2 else np.zeros(n_grades - 1))
    pairs = [(np.frombuffer(p.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32)) for p, v in zip(rows["p"], rows["v"], strict=True)]
    return Model.fit(pairs, np.array(rows["grade"].to_pylist()), n_grades)


def graded(model: Model, text: Column) -> Column:
    """Struct of ``expected_grade`` and ``top_probability`` for a text column."""

    @F.pandas_udf("expected_grade double, top_probability double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer.of(model)
        for texts in batches:
            expected, top = model.grades(np.array([scorer.score(t) for t in texts], float))
            yield pd.DataFrame({"expected_grade": expected, "top_probability": top})

    return run(text)


def select(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``expected_grade``, ``top_probability`` and ``kept``: the top grade is at least that likely."""
    out = docs.select(F.struct("*").alias("row"), graded(model, F.col(text_col)).alias("g"))
    names = ("expected_grade", "top_probability", "kept")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in names], "g.expected_grade", "g.top_probability", (F.col("g.top_probability") >= least).alias("kept"))
