"""Language identification in two steps: the family first, then one against one within the family.

A text is the mean of its words, and a word the mean of its hashed character 1- to 3-grams and itself, all
lower-cased and letters only. A linear machine's score of a text is then the mean of its words' scores, so
words are scored once in a worker and looked up after. One-versus-rest linear support vector
machines choose the family; within it, one-versus-one machines vote among its languages.

The machines learn from a bounded sample, at most about ``per_language`` labelled texts of each language and ``most_rows`` in all,
chosen by a hash of the id; features are made by Spark tasks and only their vectors of ``DIM`` 4-byte floats reach the driver, 100 MB at most by default.
Pairs of languages have a machine only within a family, so the machines are at most about 100 a family and one for each family.
Prediction reads every whole text, and nothing but the text.

Texts that are null or have no letter are ``und`` with score 0, as is everything when no row is labelled.
Null labels teach nothing. Repeated rows get equal predictions; extra columns pass through under whatever name. Ties go to
the language first in order. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ISO 639-1 codes by family. Any other label is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("am", "ar", "he"),
    "east-asian": ("ja", "ko", "zh"),
}
DIM = 4096
UNKNOWN = "und"
#: Words that a worker keeps scores of before it starts afresh, and characters looked up at once.
WORDS_KEPT = 1_000_000
CHARS_AT_ONCE = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().partition("-")[0] in codes), f"={lang}")


def text_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower()) if text else []


def grams(word: str) -> list[int]:
    """Hashed features of a word; none if it has no letter (numerals such as one half)."""
    if not any(c.isalpha() for c in word):
        return []
    edged = f"<{word}>"
    found = [edged, *word, *(edged[i : i + 2] for i in range(len(edged) - 1)), *(edged[i : i + 3] for i in range(len(edged) - 2))]
    return [zlib.crc32(g.encode()) % DIM for g in found]


def vector(text: str | None) -> np.ndarray | None:
    """A text's feature vector; None without a letter."""
    counts: dict[str, int] = {}
    for w in text_words(text):
        counts[w] = counts.get(w, 0) + 1
    out, n = np.zeros(DIM), 0
    for w, c in counts.items():
        if found := grams(w):
            np.add.at(out, found, c / len(found))
            n += c
    return out / n if n else None


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """A linear machine under squared hinge loss, by accelerated gradient descent from zero."""
    n = len(y)
    x1 = np.hstack([x, np.full((n, 1), np.sqrt((x * x).sum(1).mean()), x.dtype)])
    top = np.ones(x1.shape[1], x.dtype)
    for _ in range(20):  # the largest singular value, by powers
        top = x1.T @ (x1 @ (top / np.linalg.norm(top)))
    step = 1 / (1 + 2.2 * cost * np.linalg.norm(top) / n)
    w = v = np.zeros(x1.shape[1], x.dtype)
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * (x1 @ v))
        new = v - step * (v - 2 * cost / n * (x1.T @ (gap * y)))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1] * x1[0, -1])


@dataclass
class Model:
    """``machines``: one column of weights each; families in order, then pairs of languages by family."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    biases: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def train(cls, x: np.ndarray, lang: Sequence[str], scale: float = 30.0) -> Model:
        lang = np.array(lang, object)
        languages = sorted(set(lang))
        families = sorted({family(a) for a in languages})
        of = np.array([family(a) for a in lang], object)
        jobs = [(of == f, np.ones(len(lang), bool)) for f in families] if len(families) > 1 else []
        pairs = [(a, b) for f in families for a, b in combinations([g for g in languages if family(g) == f], 2)]
        jobs += [(lang == a, (lang == a) | (lang == b)) for a, b in pairs]
        found = [svm(x[rows] * x.dtype.type(scale), np.where(positive[rows], 1, -1).astype(x.dtype)) for positive, rows in jobs]
        weights = np.stack([w.astype(float) * scale for w, _ in found], 1) if found else np.zeros((DIM, 0))
        return cls(languages, families, pairs, weights, np.array([b for _, b in found]))

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores from the machines' margins, one row a text."""
        n = len(margins)
        squash = lambda m: 1 / (1 + np.exp(-3 * m))
        k = len(self.families) if len(self.families) > 1 else 0
        sure = squash(margins[:, :k]) if k else np.ones((n, 1))
        sure = sure / np.maximum(sure.sum(1, keepdims=True), 1e-12)
        chosen = sure.argmax(1)
        lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            members = [a for a in self.languages if family(a) == name]
            votes = np.zeros((len(rows), len(members)))
            for p, (a, b) in enumerate(self.pairs):
                if a in members:
                    first = squash(margins[rows, k + p])
                    votes[:, members.index(a)] += first
                    votes[:, members.index(b)] += 1 - first
            votes = votes / (len(members) - 1) if len(members) > 1 else votes + 1
            best = votes.argmax(1)
            lang[rows] = np.array(members, object)[best]
            score[rows] = sure[rows, f] * votes[np.arange(len(rows)), best]
        return lang, score


class Scorer:
    """A model with the scores of the words its worker has seen."""

    _made: dict[str, Scorer] = {}

    def __init__(self, model: Model):
        self.model = model
        self._restart()

    @classmethod
    def of(cls, model: Model) -> Scorer:
        if model.key not in cls._made:
            cls._made.clear()  # one model at a time
            cls._made[model.key] = cls(model)
        return cls._made[model.key]

    def _restart(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, self.model.weights.shape[1] + 1))

    def _row(self, word: str) -> int:
        n = self.index[word] = len(self.index)
        if n >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if found := grams(word):
            self.table[n, :-1] = self.model.weights[found].mean(0)
            self.table[n, -1] = 1
        return n

    def predict(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if not self.model.languages:
            return lang, score
        at = 0
        while at < len(texts):
            sums, size, to = [], 0, at
            while to < len(texts) and size < CHARS_AT_ONCE:
                found = text_words(texts[to])
                get, row = self.index.get, self._row
                rows = [r if (r := get(w)) is not None else row(w) for w in found]
                sums.append(self.table[rows].sum(0) if rows else np.zeros(self.table.shape[1]))
                size += len(texts[to] or "")
                to += 1
            if len(self.index) > WORDS_KEPT:
                self._restart()
            total = np.stack(sums)
            known = np.flatnonzero(total[:, -1])
            if len(known):
                margins = total[known, :-1] / total[known, -1:] + self.model.biases
                lang[at + known], score[at + known] = self.model.decide(margins)
            at = to
        return lang, score


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows kept from training: the id's CRC-32 is divisible by ``folds``; rows without an id are too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, most_rows: int = 6000, most_languages: int = 500, seed: int = 5) -> Model:
    """Fit on rows that are not held out and have a label, about ``per_language`` of each language and ``most_rows`` in all at most.

    Labels beyond the ``most_languages`` commonest are not learnt.
    """
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = known.groupBy(lang_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang_col).limit(most_languages).collect()
    if not counts:
        return Model([], [], [], np.zeros((DIM, 0)), np.zeros(0))
    most = min(per_language, most_rows / len(counts))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r[lang_col], min(1.0, most / r["n"]))])
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = known.where(draw < F.coalesce(share[F.col(lang_col)], F.lit(0.0))).select(lang_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(a.as_py(), vector(t.as_py())) for a, t in zip(batch.column(0), batch.column(1), strict=True)]
            found = [(a, v.astype("<f4").tobytes()) for a, v in found if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([v for _, v in found], pa.binary())], ["lang", "v"])

    rows = sample.mapInArrow(run, "lang string, v binary").toArrow()
    if not rows.num_rows:
        return Model([], [], [], np.zeros((DIM, 0)), np.zeros(0))
    order = np.lexsort([np.array(rows["v"].to_pylist(), object), np.array(rows["lang"].to_pylist(), object)])  # tasks end in any order
    x = np.stack([np.frombuffer(v.as_py(), "<f4") for v in rows["v"]])[order]
    return Model.train(x, np.array(rows["lang"].to_pylist(), object)[order])


def predicted(model: Model, text: Column) -> Column:
    """Struct of ``lang`` and ``score`` for a text column."""

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer.of(model)
        for texts in batches:
            lang, score = scorer.predict(texts.tolist())
            yield pd.DataFrame({"lang": lang, "score": score})

    return run(text)


def digest(docs: DataFrame, model: Model) -> DataFrame:
    out = docs.select("doc_id", held_out().alias("held_out"), predicted(model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows whose text is in a language that the model knows, with at least that score; all if it knows none.

    A model of a single language has the score 1 for whatever has a letter.
    """
    if not model.languages:
        return docs
    out = docs.select(F.struct("*").alias("row"), predicted(model, F.col(text_col)).alias("p"))
    return out.where((F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= least_score)).select(*[F.col("row")[c].alias(c) for c in docs.columns])
