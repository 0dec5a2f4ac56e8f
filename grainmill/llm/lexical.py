"""Ranked lexical search: an index in shards, variable blocks with score bounds, and exact block-skipping search.

:func:`index` turns documents into posting lists, one for each term of a shard. A shard holds documents of about ``SHARD_TERMS`` terms and
is made by one task as it reads, without a shuffle. :func:`search` takes the lists of the terms asked for, and the global
statistics (documents, their lengths, documents of a term) from the index, and deals the lists out by shard. There

* each list's impacts (the score of a posting without the term's weight) are cut into blocks of variable length. Dynamic programming chooses the
  borders that minimise the sum of the bound's errors (a block's highest impact less that of each posting) and a fixed price a
  block, the mean error of a block of ``BLOCK`` postings, so that blocks are as many as even ones would make worthwhile. Lists run through it side by side;
* a document can only be among the best if the summed maxima of the blocks over it, its bound in the sense of a weak AND, reach the
  score of the k-th best so far. The borders of an item's blocks cut the shard into intervals with one bound each. Intervals are visited from the highest
  bound on, their documents are scored exactly, and all intervals whose bound lies below the threshold are skipped.

The best of the shards are merged by score and id. Scores are whole numbers throughout, so results are exact and do not depend on shards.

Items are taken in blocks of at most ``BLOCK_TERMS`` terms, or one item, which are the only thing sent to all tasks; each block is a job over the index. A
posting list is never longer than a shard, so frequent terms and hot sources meet in no one task, and only the terms asked for are shuffled.

Null texts, and texts without a term, count for nothing and are never found, nor are documents without an id, though these count in the statistics. Items that are null, have no id or no
known term give no rows. Several items with one id are searched apart, and equal ones once; documents that share an id are documents of their own. A text of
any length is taken whole, as a shard by itself if need be. Other columns are never read, so any names go. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill import scratch

#: A term is a run of these bytes of UTF-8: digits, letters and all that is not ASCII; capitals of ASCII count as small ones.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHARD_TERMS = 1 << 20
#: Postings of an even block, and of the longest.
BLOCK = 4
LONGEST = 64
#: Postings that go through the dynamic programme at once, and documents scored at once.
AT_ONCE = 1 << 15
SCORED = 256
BLOCK_TERMS = 1 << 20
POSTINGS = "shard long, term string, ids array<long>, counts array<int>"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split(b" ") if text else []


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """A written table of posting lists: ``shard``, ``term``, ``ids`` (places in the shard, ascending) and ``counts``.

    The row of a shard whose term is null lists the ids of its documents and their numbers of terms, which are negative for
    documents without an id.
    """

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, words, ends = TaskContext.get().partitionId() << 32, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.diff(ends, prepend=0)
            codes, names = pd.factorize(np.array(words, object))
            keys, counts = np.unique(codes.astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
            offsets = np.searchsorted(keys, np.arange(len(names) + 1) * len(ids)).astype(np.int32)
            lists = lambda values, kind, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
            head = (pa.array([None], pa.string()), lists([i or 0 for i in ids], pa.int64(), [0, len(ids)]), lists([int(-n if i is None else n) for i, n in zip(ids, lengths, strict=True)], pa.int32(), [0, len(ids)]))
            body = (pa.array(list(names), pa.binary()).cast(pa.string()), lists(keys % len(ids), pa.int64(), offsets), lists(counts, pa.int32(), offsets))
            for term, places, numbers in (head, body):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), shard), pa.int64()), term, places, numbers], names=["shard", "term", "ids", "counts"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = [w for w in terms(text.as_py()) if w]
                if own:
                    ids.append(i)
                    words += own
                    ends.append(len(words))
                if len(words) >= shard_terms:
                    yield from flush()
                    shard, ids, words, ends = shard + 1, [], [], []
        if ids:
            yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return scratch.materialize(rows.mapInArrow(invert, POSTINGS), "lexical-index")


def borders(lists: list[np.ndarray], block: int = BLOCK, longest: int = LONGEST) -> list[np.ndarray]:
    """For each list of impacts, the ends of its blocks: least sum of errors (a block's maximum less each of its impacts) and prices of blocks."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lists)
    order = sorted(range(len(lists)), key=lambda i: -len(lists[i]))
    while order:
        width = len(lists[order[0]])
        some, order = order[: max(1, AT_ONCE // max(1, width))], order[max(1, AT_ONCE // max(1, width)) :]
        values = np.zeros((len(some), width), np.int64)
        price, sizes = np.zeros(len(some), np.int64), np.array([len(lists[i]) for i in some])
        for row, i in enumerate(some):
            own = lists[i]
            values[row, : len(own)] = own
            starts = np.arange(0, len(own), block)
            price[row] = (np.maximum.reduceat(own, starts) * np.diff(np.append(starts, len(own)))).sum() - own.sum()
            price[row] = price[row] // len(starts) + 1
        # best[:, e]: least cost of the first e impacts; came[:, e]: length of the last block then.
        best, came = np.zeros((len(some), width + 1), np.int64), np.zeros((len(some), width + 1), np.int16)
        high, total = np.zeros((len(some), longest), np.int64), np.zeros((len(some), longest), np.int64)
        lengths = np.arange(1, longest + 1)
        for e in range(1, width + 1):
            live = int(np.searchsorted(-sizes, -e, side="right"))  # lists that reach so far; longer ones come first
            x, m = values[:live, e - 1 : e], min(e, longest)
            high[:live, 1:m] = high[:live, : m - 1]
            total[:live, 1:m] = total[:live, : m - 1]
            high[:live, 0] = total[:live, 0] = 0
            np.maximum(high[:live, :m], x, out=high[:live, :m])
            total[:live, :m] += x
            cost = high[:live, :m] * lengths[:m] - total[:live, :m] + best[:live, e - m : e][:, ::-1]
            pick = cost.argmin(1)
            best[:live, e], came[:live, e] = cost[np.arange(live), pick] + price[:live], pick + 1
        for row, i in enumerate(some):
            ends, e = [], len(lists[i])
            while e:
                ends.append(e)
                e -= int(came[row, e])
            out[i] = np.array(ends[::-1], np.int64)
    return out


class Shard:
    """Posting lists of one shard under variable blocks."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, lists: dict[str, tuple[np.ndarray, np.ndarray]], weights: dict[str, int]):
        """``norms`` are the documents' m; ``lists`` has places and counts by term."""
        self.ids, self.terms = ids, {}
        impacts = {t: (1_000_000_000 * c) // (1000 * c + 8 * norms[p]) for t, (p, c) in lists.items()}
        ends = borders(list(impacts.values()))
        for (t, (places, _)), end in zip(lists.items(), ends, strict=True):
            starts = np.append(0, end[:-1])
            self.terms[t] = (places, weights[t] * impacts[t], places[starts], places[end - 1] + 1, weights[t] * np.maximum.reduceat(impacts[t], starts))

    def best(self, asked: list[str], k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) with scores above 0, ties to smaller ids; and how many documents were scored."""
        own = [self.terms[t] for t in asked if t in self.terms]
        if not own:
            return [], 0
        firsts, pasts, bounds = (np.concatenate([o[x] for o in own]) for x in (2, 3, 4))
        at, where = np.unique(np.concatenate([firsts, pasts]), return_inverse=True)
        steps = np.zeros(len(at), np.int64)
        np.add.at(steps, where, np.concatenate([bounds, -bounds]))
        bound = np.cumsum(steps)[:-1]  # of the interval from a border to the next
        order = np.argsort(-bound, kind="stable")
        sizes = np.diff(at)[order]
        found, reach, done, i = [], 1, 0, 0
        while i < len(order) and bound[order[i]] >= reach:
            j = i + max(1, int(np.searchsorted(np.cumsum(sizes[i : i + SCORED]), SCORED)))
            j = min(j, i + int(np.searchsorted(-bound[order[i:j]], -reach, side="right")))
            places = np.sort(np.concatenate([np.arange(at[x], at[x + 1]) for x in order[i:j]]))
            scores = np.zeros(len(places), np.int64)
            for o in own:
                spot = np.minimum(np.searchsorted(o[0], places), len(o[0]) - 1)
                scores += np.where(o[0][spot] == places, o[1][spot], 0)
            done += len(places)
            found += [(int(s), int(d)) for s, d in zip(scores, self.ids[places], strict=True) if s >= reach]
            found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
            if len(found) == k:
                reach = max(reach, found[-1][0])
            i = j
        return found, done


def search(indexed: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", found_col: str = "doc_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``id_col``, ``rank`` (from 1), ``found_col`` and ``score`` of the ``k`` best documents of :func:`index` for each item."""
    spark = indexed.sparkSession
    own = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    total = indexed.where("term IS NULL").agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + F.abs(x))).alias("l")).first()
    n, length = total["n"] or 0, total["l"] or 0
    kind = items.schema[id_col].dataType
    out = [_search(indexed, block, n, length, k, kind) for block in _blocks(own, block_terms) if n]
    empty = spark.createDataFrame([], "item int, rank int, id long, score long").withColumn("item", F.col("item").cast(kind))
    return reduce(DataFrame.unionByName, out, empty).select(F.col("item").alias(id_col), "rank", F.col("id").alias(found_col), "score")


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple]]:
    """Items and their distinct terms, at most so many terms together unless one item has more."""
    rows, block, size = items.toLocalIterator(), [], 0
    for row in rows:
        own = sorted({w.decode("utf-8", "surrogatepass") for w in terms(row["text"]) if w})
        if block and size + len(own) > block_terms:
            yield block
            block, size = [], 0
        block, size = [*block, (row["item"], own)], size + len(own)
    if block:
        yield block


def _search(indexed: DataFrame, block: list[tuple], n: int, length: int, k: int, kind) -> DataFrame:
    spark = indexed.sparkSession
    vocabulary = sorted({t for _, own in block for t in own})
    asked = spark.createDataFrame([(t,) for t in vocabulary], "asked string")
    postings = indexed.join(F.broadcast(asked), F.col("term") == F.col("asked"))  # at most ``block_terms`` rows, or one item's
    frequency = postings.groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.col("df") + 1)))
    weights = {r["term"]: r["w"] for r in frequency.select("term", weight.alias("w")).collect()}
    sent = spark.sparkContext.broadcast((block, weights))
    parts = indexed.where("term IS NULL").unionByName(postings.drop("asked"))

    def visit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asked, weights = sent.value
        head = rows[rows["term"].isna()].iloc[0]
        ids, sizes = np.asarray(head["ids"], np.int64), np.asarray(head["counts"], np.int64)
        lists = {r.term: (np.asarray(r.ids, np.int64), np.asarray(r.counts, np.int64)) for r in rows[rows["term"].notna()].itertuples()}
        named = sizes > 0  # only documents with an id are found
        lists = {t: (p[named[p]], c[named[p]]) for t, (p, c) in lists.items() if named[p].any()}
        shard = Shard(ids, 10 + 90 * np.abs(sizes) * n // length, lists, weights)
        found = [(at, s, i) for at, (_, own) in enumerate(asked) for s, i in shard.best(own, k)[0]]
        return pd.DataFrame(found, columns=["at", "score", "id"])

    found = parts.groupBy("shard").applyInPandas(visit, "at int, score long, id long")
    first = Window.partitionBy("at").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(i for i, _ in block)), f"at int, item {kind.simpleString()}")
    return best.join(F.broadcast(names), "at").select("item", "rank", "id", "score")  # names are part of the block
