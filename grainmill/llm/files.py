"""Binary files in the folder that all executors share, by path or URI."""

from __future__ import annotations

import uuid

import pyarrow.fs


#: Schemes that Spark's file systems have other names for.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, mark, rest = uri.partition("://")
    return pyarrow.fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest)


class Writer:
    """A file that has its name only once it is whole.

    The name is new on each attempt, so a task that runs again, or twice at once, never meets the file of
    another attempt; readers learn names from the rows of the attempt that counted.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        self.uri = f"{folder.rstrip('/')}/{self.name}"
        self.fs, self.path = _filesystem(self.uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append; returns where the data begin."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.uri


def open_input(uri: str):
    """A seekable file."""
    fs, path = _filesystem(uri)
    return fs.open_input_file(path)
