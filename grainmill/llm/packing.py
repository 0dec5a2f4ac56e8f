"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens: a longer one is cut into full pieces, the
first piece taking what is left over. For each sequence in turn the longest piece left is taken and a
bitset subset-sum over the lengths still available finds the fullest combination with it, which is then
removed. Only lengths matter for that, and there are at most ``capacity`` of them: Spark counts the pieces
by length, the plan is made from those counts, and a combination is taken as often as the counts allow.

A taken combination ends by using up some length below the number of times the combination needs it. For
a length L that number is at most capacity / L and falls each time, so the plan has at most
capacity * (1 + ln capacity) combinations (17,000 for 2048), each of at most 63 different lengths, however
many pieces there are. That bounded plan goes to the tasks; pieces find their sequence by their rank among
pieces of equal length, which windows over small buckets give.

Null texts are empty, a document of the end id alone. Repeated rows are packed once each. Ties among
pieces of equal length are broken by document id and piece. Columns of the documents but id and text are never read, and those of pieces
pass through under whatever name, but ``sequence_id`` and ``offset``, which are replaced. Very long texts are cut up within one task. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill import scratch
from grainmill.llm.token_store import text_slices
from grainmill.llm.tokens import Encoder

CAPACITY = 2048
#: Pieces in a bucket within which pieces of equal length are ranked.
BUCKET = 4096


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                flat, n = encoder.encode(texts)
                flat = np.insert(flat, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                head = np.repeat(n - (count - 1) * capacity, count)
                start = np.where(piece > 0, head + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head)
                where = np.repeat(np.cumsum(n) - n, count) + start
                data = memoryview(flat.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + b)]) for a, b in zip(where.tolist(), length.tolist(), strict=True)]
                columns = [
                    batch.column(0).slice(at, len(texts)).take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start.astype(np.int64)),
                    pa.array(length.astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:  # pieces of consecutive documents are consecutive in flat
                    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def fullest(counts: dict[int, int], capacity: int, order: list[int]) -> dict[int, int]:
    """The lengths, with multiplicity, whose sum comes nearest to ``capacity`` from below.

    ``counts`` has what is available, ``order`` its lengths from the longest down. Bit s of a bitset is set
    when sum s can be made; a length available m times enters as bundles of 1, 2, 4, ... of it.
    """
    if capacity <= 0:
        return {}
    mask, bits = (1 << (capacity + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, bundle, sums before
    goal = 1 << capacity
    for length in order:
        if length > capacity:
            continue
        left, bundle = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(bundle, left)
            steps.append((length, take, bits))
            bits |= bits << (length * take) & mask
            left -= take
            bundle *= 2
            if bits & goal:
                break
        if bits & goal:
            break
    best = bits.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + take
            best -= length * take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Combinations with the number of times each is taken; together they use up the counts."""
    counts = {n: c for n, c in counts.items() if c > 0}
    order = sorted(counts, reverse=True)
    out = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        used = fullest(counts, capacity - longest, [n for n in order if counts[n]])
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // c for n, c in used.items())
        for n, c in used.items():
            counts[n] -= times * c
        order = [n for n in order if counts[n]]
        out.append((times, used))
    return out


def _allotments(made: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: from which rank on, pieces a sequence, the first sequence, and the place in it."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for times, used in made:
        place = 0
        for length, per in sorted(used.items(), reverse=True):
            at = taken.get(length, 0)
            rows.setdefault(length, []).append((at, per, first, place))
            taken[length] = at + times * per
            place += length * per
        first += times
    return {n: tuple(np.array(r, np.int64).T) for n, r in rows.items()}


def pack(found: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (as from :func:`pieces`; extra columns are kept)."""
    found = scratch.materialize(found, "pieces")
    by_length = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = _allotments(plan(by_length, capacity))

    n_buckets = max(1, sum(by_length.values()) // BUCKET)
    bucket = F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(n_buckets))
    rows = found.select(F.struct("*").alias("row"), "length", bucket.alias("bucket"))
    sums = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.col("row")
    within = Window.partitionBy("length", "bucket").orderBy(own[id_col], own["piece"], own["ids_crc32"])
    ranked = rows.withColumn("n", F.row_number().over(within) - 1).join(sums, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("n"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, at = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for n in np.unique(size):
            here = size == n
            starts, per, first, where = places[int(n)]
            k = np.searchsorted(starts, at[here], side="right") - 1
            turn, slot = np.divmod(at[here] - starts[k], per[k])
            sequence[here], offset[here] = first[k] + turn, where[k] + slot * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = ranked.select("row", place("length", "rank").alias("place"))
    kept = [own[c].alias(c) for c in found.columns if c not in ("sequence_id", "offset")]
    return out.select(*kept, F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset"))


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves, ``sequence_id`` and ``ids``, from packed pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` tokens a sequence
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
