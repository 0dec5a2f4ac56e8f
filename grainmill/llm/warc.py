"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames with a seek table in a skippable
frame at its end: for each frame its compressed and its plain size. A frame groups records up to ``FRAME_BYTES`` of plain size, a larger record
is a frame of its own. The record index maps a record's id to its bundle, its frame, whose place in the file the seek table gives, and its offset and length
within the frame; so a record is read by decompressing one frame, and ordinary tools still decompress the whole bundle.

Of records with equal payloads of at least ``least`` bytes, that with the largest id is a response and the
others are revisits of it: they carry the HTTP head, whose Content-Length is that of the payload, but no
payload. Payloads are compared by SHA-1. Only ids and digests are grouped; the payloads themselves are
dealt out once, by id, so a payload that a third of all pages share burdens no single task.

Null payloads are empty, null URLs are left out of the record. Rows need distinct ids; rows without
an id are written as responses of their own, under a name that no id has. Very long payloads are held whole in one task. Columns other than those
named are never read, so any names go. An empty table gives no bundle and an empty result. Tasks
may run twice: each attempt writes files of its own names, and the index names those that count.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill import scratch
from grainmill.llm import files

BUNDLE_BYTES = 64 << 20
FRAME_BYTES = 256 << 10
LEVEL = 3
#: Fixed values of the seekable format: the skippable frame's and the seek table's magic numbers.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
NO_ID = "<urn:no-page>"
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit, which leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {NO_ID if record_id is None else f'<urn:page:{record_id}>'}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's fields, those of its HTTP head, and its payload."""

    def fields(raw: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:] if ": " in line)

    head, _, rest = data.partition(b"\r\n\r\n")
    own = fields(head)
    http, _, payload = rest[: int(own["Content-Length"])].partition(b"\r\n\r\n")
    return own, fields(http), payload


class BundleWriter:
    """Gathers records in frames, appends those, and the seek table on closing."""

    def __init__(self, folder: str):
        self.file = files.Writer(folder, "bundle", ".warc.zst")
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        self.pending = bytearray()

    def add(self, data: bytes) -> tuple[int, int]:
        """Returns the number of the record's frame and its offset there."""
        if self.pending and len(self.pending) + len(data) > FRAME_BYTES:
            self.cut()
        at = len(self.pending)
        self.pending += data
        return len(self.sizes), at

    def cut(self) -> None:
        """End the frame."""
        frame = self.compressor.compress(bytes(self.pending))
        self.file.write(frame)
        self.sizes.append((len(frame), len(self.pending)))
        self.pending = bytearray()

    def close(self) -> str:
        if self.pending:
            self.cut()
        table = np.array(self.sizes, "<u4").reshape(-1, 2).tobytes()
        foot = np.array([len(self.sizes)], "<u4").tobytes() + b"\0" + np.array([SEEKABLE], "<u4").tobytes()
        self.file.write(np.array([SKIPPABLE, len(table) + len(foot)], "<u4").tobytes() + table + foot)
        return self.file.close()


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, uri: str):
        self.file = files.open_input(uri)
        size = self.file.size()
        foot = self.file.read_at(9, size - 9)
        if int(np.frombuffer(foot[5:], "<u4")[0]) != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        n = int(np.frombuffer(foot[:4], "<u4")[0])
        self.sizes = np.frombuffer(self.file.read_at(8 * n, size - 9 - 8 * n), "<u4").reshape(-1, 2).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        self.decompressor = zstandard.ZstdDecompressor()

    def __enter__(self) -> BundleReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def frame(self, n: int) -> bytes:
        data = self.file.read_at(int(self.sizes[n, 0]), int(self.offsets[n]))
        return self.decompressor.decompress(data, max_output_size=int(self.sizes[n, 1]))


def originals(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """``id_col`` and ``refers_to`` of the pages that revisit another."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    found = pages.where(F.col(id_col).isNotNull() & (F.octet_length(payload) >= least)).select(id_col, F.sha1(F.encode(payload, "UTF-8")).alias("sha"))
    found = scratch.materialize(found, "payload-digests")
    groups = found.groupBy("sha").agg(F.max(id_col).alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return found.join(groups, "sha").where(F.col(id_col) != F.col("refers_to")).select(id_col, "refers_to")


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Write every page; returns the record index: ``id_col``, ``bundle``, ``frame``, and ``offset`` and ``length`` within the frame."""
    folder = folder or scratch.new_path(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, keys, places = None, [], []

        def flush() -> pa.RecordBatch:
            nonlocal out, keys, places
            uri = out.close()
            at = [pa.array(x, pa.int32()) for x in zip(*places, strict=True)]
            done = pa.RecordBatch.from_arrays([pa.array(keys, kinds), pa.array([uri] * len(keys)), *at], ["key", "bundle", "frame", "offset", "length"])
            out, keys, places = None, [], []
            return done

        for batch in batches:
            kinds = batch.schema.field(0).type
            for k in range(batch.num_rows):
                key, url, payload, refers_to = (batch.column(c)[k].as_py() for c in range(4))
                out = out or BundleWriter(folder)
                data = record(None if key is None else str(key), url, (payload or "").encode(), refers_to)
                places.append((*out.add(data), len(data)))
                keys.append(key)
                if out.file.size + len(out.pending) >= BUNDLE_BYTES:
                    yield flush()
        if out:
            yield flush()

    roles = originals(pages, id_col, payload_col, least).withColumnRenamed(id_col, "_of")
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    rows = rows.join(roles, F.col("key") == F.col("_of"), "left").select("key", "url", "payload", F.col("refers_to").cast("string"))
    written = rows.mapInArrow(run, f"key {kind}, bundle string, frame int, offset int, length int")
    return scratch.materialize(written, "warc-index").withColumnRenamed("key", id_col)


def read(index: DataFrame, id_col: str = "page_id") -> DataFrame:
    """What the archives say of each record of an index; one task reads a bundle, each frame once.

    Columns: ``id_col``, ``payload_bytes`` and ``payload_digest`` (a response's from its payload, a revisit's
    from its head), ``record_type``, ``refers_to``.
    """
    kind = index.schema[id_col].dataType.simpleString()

    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        with BundleReader(rows["bundle"].iloc[0]) as bundle:
            held, frame = -1, b""
            for n, at, length in rows.sort_values(["frame", "offset"])[["frame", "offset", "length"]].itertuples(index=False):
                if n != held:
                    held, frame = n, bundle.frame(n)
                own, http, payload = parse(frame[at : at + length])
                response = own["WARC-Type"] == "response"
                name = lambda field: None if own[field] == NO_ID else own[field].removeprefix("<urn:page:").removesuffix(">")
                out.append(
                    (
                        name("WARC-Record-ID"),
                        len(payload) if response else int(http["Content-Length"]),
                        digest32(payload) if response else own["WARC-Payload-Digest"].removeprefix("sha1:"),
                        own["WARC-Type"],
                        None if response else name("WARC-Refers-To"),
                    )
                )
        return pd.DataFrame(out, columns=["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    found = index.groupBy("bundle").applyInPandas(run, "key string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.select(F.col("key").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
