"""Token ids in directly addressable files.

An id is cut into chunks of ``CHUNK_BITS`` bits, lowest first. Level 0 holds the first chunk of every id;
level k holds the k-th chunk of the ids that have one, in order. A bitmap beside each level says which of
its entries continue on the next, and a directory holds the number of set bits before each block of the
bitmap. Entry i of a level that continues is entry rank(i) of the next, so any token is found by one rank
a level, without decoding its neighbours.

A file, all numbers little-endian::

    magic "GMDAC001"
    per level: chunks (uint8 each) | bitmap (bits, lowest first, padded to whole blocks) | directory (uint64 a block)
    documents: first token of each (uint64), with one more entry for the end
    footer: n_documents, n_tokens, n_levels, then per level its entries and offset, then the documents' offset,
            the footer's length (uint64 each), magic

Documents are dealt out by ranges of their id, each task sorts its range and writes files of bounded size,
and the files' totals are summed in order to give the tokens before each. Null texts are empty, with the
end id alone. Equal document ids stand in order of a hash of their texts; null ids come first. A very long text
is one document of one file. Other columns are never read, so any names go. An empty table gives no file and an empty result.
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
from grainmill.llm import files
from grainmill.llm.tokens import Encoder

MAGIC = b"GMDAC001"
CHUNK_BITS = 8
#: Bits of a bitmap counted by one entry of the directory.
BLOCK = 512
#: Tokens after which a task begins another file.
TOKENS_PER_FILE = 4_000_000
#: Texts of at most so many characters are encoded at once.
CHARS_AT_ONCE = 1 << 20


def _level(chunks: np.ndarray, more: np.ndarray) -> tuple[bytes, bytes, bytes]:
    padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, np.uint8)
    padded[: len(more)] = more
    counts = padded.reshape(-1, BLOCK).sum(1, dtype=np.uint64)
    directory = np.cumsum(counts, dtype=np.uint64) - counts
    return chunks.astype(np.uint8).tobytes(), np.packbits(padded, bitorder="little").tobytes(), directory.astype("<u8").tobytes()


def write_file(folder: str, ids: np.ndarray, firsts: np.ndarray) -> str:
    """Write the tokens ``ids`` of documents beginning at ``firsts`` (and the end); returns the file's URI."""
    out = files.Writer(folder, "tokens", ".dac")
    out.write(MAGIC)
    levels, rest = [], ids.astype(np.uint32)
    while True:
        above = rest >> CHUNK_BITS
        more = above > 0
        parts = _level(rest & ((1 << CHUNK_BITS) - 1), more)
        levels += [len(rest), out.size]
        for part in parts:
            out.write(part)
        if not more.any():
            break
        rest = above[more]
    at = out.write(firsts.astype("<u8").tobytes())
    footer = np.array([len(firsts) - 1, len(ids), len(levels) // 2, *levels, at], "<u8").tobytes()
    out.write(footer + np.array([len(footer)], "<u8").tobytes() + MAGIC)
    return out.close()


class TokenFile:
    """Random access to one file; only the levels' bytes that are asked for are touched."""

    def __init__(self, uri: str, whole: bool = False):
        self.file = files.open_input(uri)
        if whole:  # for one who reads all of it: a file has a bounded number of tokens
            with self.file as f:
                self.file = pa.BufferReader(f.read_buffer())
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        length = int(np.frombuffer(tail[:8], "<u8")[0])
        footer = np.frombuffer(self.file.read_at(length, size - 16 - length), "<u8").astype(np.int64)
        self.n_documents, self.n_tokens, n = (int(x) for x in footer[:3])
        self.levels = []
        for entries, at in footer[3 : 3 + 2 * n].reshape(-1, 2):
            blocks = -(-int(entries) // BLOCK)
            self.levels.append((int(entries), int(at), int(at) + int(entries), int(at) + int(entries) + blocks * BLOCK // 8))
        self.firsts = np.frombuffer(self.file.read_at(8 * (self.n_documents + 1), int(footer[3 + 2 * n])), "<u8").astype(np.int64)

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def _rank(self, level: int, i: int) -> int:
        """Entries before ``i`` that continue."""
        _, _, bitmap, directory = self.levels[level]
        block = i // BLOCK
        before = int(np.frombuffer(self.file.read_at(8, directory + 8 * block), "<u8")[0]) if i < self.levels[level][0] else -1
        if before < 0:  # just past the last entry
            return self._rank(level, i - 1) + self._bit(level, i - 1) if i else 0
        bits = np.unpackbits(np.frombuffer(self.file.read_at(BLOCK // 8, bitmap + block * BLOCK // 8), np.uint8), bitorder="little")
        return before + int(bits[: i - block * BLOCK].sum())

    def _bit(self, level: int, i: int) -> int:
        return self.file.read_at(1, self.levels[level][2] + i // 8)[0] >> (i % 8) & 1

    def token(self, i: int) -> int:
        """The i-th token of the file."""
        value = 0
        for level, (_, chunks, _, _) in enumerate(self.levels):
            value |= self.file.read_at(1, chunks + i)[0] << (CHUNK_BITS * level)
            if not self._bit(level, i):
                break
            i = self._rank(level, i)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Tokens from ``start`` up to ``end``: on each level a contiguous range, found by two ranks."""
        out = np.zeros(max(0, end - start), np.uint32)
        where = np.arange(len(out))
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            if start >= end:
                break
            out[where] |= np.frombuffer(self.file.read_at(end - start, chunks + start), np.uint8).astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            at = start // 8
            bits = np.unpackbits(np.frombuffer(self.file.read_at(-(-end // 8) - at, bitmap + at), np.uint8), bitorder="little")
            more = bits[start - 8 * at : end - 8 * at].astype(bool)
            first = self._rank(level, start) if more.any() else 0
            where = where[more]
            start, end = first, first + len(where)
        return out


def text_slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts, null as empty, of bounded size, each with the number of its first."""
    run, size, at = [], 0, 0
    for k, text in enumerate(texts):
        run.append(text.as_py() or "")
        size += len(run[-1])
        if size >= CHARS_AT_ONCE:
            yield at, run
            run, size, at = [], 0, k + 1
    if run:
        yield at, run


def write(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode the texts and write them in ascending order of ``id_col``.

    Returns the index, one row a document: ``id_col``, ``file``, ``file_no`` (in order of the documents)
    and ``doc_no`` within the file. The index is written too, so the files it names are those that count.
    """
    spark = docs.sparkSession
    folder = folder or scratch.new_path(spark, "token-files")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        ids, counts, keys, sizes = [], [], [], 0
        part, number = None, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, counts, keys, sizes, number
            n = np.concatenate(counts)
            uri = write_file(folder, np.concatenate(ids), np.concatenate([[0], np.cumsum(n)]))
            out = pa.RecordBatch.from_pydict(
                {
                    "key": pa.concat_arrays(keys),
                    "file": pa.array([uri] * len(n)),
                    "part": pa.array(np.full(len(n), part, np.int32)),
                    "number": pa.array(np.full(len(n), number, np.int32)),
                    "doc_no": pa.array(np.arange(len(n), dtype=np.int64)),
                }
            )
            ids, counts, keys, sizes, number = [], [], [], 0, number + 1
            return out

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for at, texts in text_slices(batch.column(1)):
                flat, n = encoder.encode(texts)
                flat = np.insert(flat, np.cumsum(n), end_id).astype(np.uint32)
                ids.append(flat)
                counts.append(n + 1)
                keys.append(batch.column(0).slice(at, len(texts)))
                sizes += len(flat)
                if sizes >= TOKENS_PER_FILE:
                    yield flush()
        if keys:
            yield flush()

    ordered = (
        docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(spark_partitions(docs), "key", "tie")
        .sortWithinPartitions("key", "tie", "text")
        .select("key", "text")
        .withColumn("part", F.spark_partition_id())
    )
    written = ordered.mapInArrow(run, f"key {kind}, file string, part int, number int, doc_no long")
    return scratch.materialize(written, "token-index").withColumnRenamed("key", id_col)


def spark_partitions(docs: DataFrame) -> int:
    """Partitions for a shuffle of whole texts: the session's setting, as for any other shuffle."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read every document of an index back from its file: ``id_col``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the tokens of all documents before it. One task reads a file, document by document.
    """
    kind = index.schema[id_col].dataType.simpleString()

    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_no")
        with TokenFile(rows["file"].iloc[0], whole=True) as f:
            spans = [(int(f.firsts[n]), int(f.firsts[n + 1])) for n in rows["doc_no"]]
            crc = [zlib.crc32(f.slice(a, b).astype("<u4").tobytes()) for a, b in spans]
        return pd.DataFrame(
            {"key": rows[id_col], "part": rows["part"], "number": rows["number"], "first": [a for a, _ in spans], "n_tokens": [b - a for a, b in spans], "ids_crc32": crc}
        )

    found = index.groupBy("file").applyInPandas(run, f"key {kind}, part int, number int, first long, n_tokens long, ids_crc32 long")
    found = scratch.materialize(found, "tokens-read")
    totals = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    # One row a file: a file holds millions of tokens, so this is far smaller than the table of documents.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(totals, ["part", "number"]).select(F.col("key").alias(id_col), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
