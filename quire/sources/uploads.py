"""Files read piece by piece, hashed as they come, and given up at a limit.

Other than binaryFile, which reads a file whole before anything can be said of it, no more than the limit and one
piece of a file is ever read.  Files are dealt over the tasks by size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quire.shipping import ship

SCHEMA = "name string, size long, sha string, content binary, status int"
PIECE = 1 << 20
#: Bytes that one task should read.
SHARE = 64 << 20


def taken(stream: BinaryIO, most: int, piece: int = PIECE) -> tuple[int, str | None, bytes | None, int]:
    """size, sha, content, status of a stream: 202, or 413 without hash and content as soon as more than `most` bytes have come."""
    digest, held, size = hashlib.sha256(), [], 0
    while data := stream.read(piece):
        size += len(data)
        if size > most:
            return size, None, None, 413
        digest.update(data)
        held.append(data)
    return size, digest.hexdigest(), b"".join(held), 202


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Share(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("most", 100 << 20))

    def partitions(self) -> list[Share]:
        fs, at = _filesystem(self.path)
        found = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True)) if f.is_file and not any(p.startswith(".") for p in f.path[len(at) :].split("/"))]
        shares, held = [Share([])], 0
        for f in sorted(found, key=lambda f: f.path):
            cost = min(f.size or 0, self.most + PIECE)
            if held and held + cost > SHARE:
                shares.append(Share([]))
                held = 0
            shares[-1].names.append(f.path)
            held += cost
        return shares

    def read(self, partition: Share) -> Iterator[tuple]:
        fs, _ = _filesystem(self.path)
        for name in partition.names:
            with fs.open_input_stream(name, compression=None) as stream:
                yield (name, *taken(stream, self.most))


class Uploads(DataSource):
    """Files under a folder: option path, and most (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "quire_uploads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options))


def uploads(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """SCHEMA rows of all files under folder but those whose path has a part that begins with a dot."""
    ship(spark)
    spark.dataSource.register(Uploads)
    return spark.read.format("quire_uploads").options(path=folder, most=str(most)).load()
