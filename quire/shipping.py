"""Hands the package to the executors' Python workers through Spark, so that none needs it installed."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: add this package to the workers' path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    sources = sorted(p for p in root.rglob("*.py")) if root.is_dir() else []
    if sources:  # empty when the package itself runs from such an archive
        mark = hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest()[:12]
        target = Path(tempfile.mkdtemp(prefix="quire-ship-")) / f"quire-{mark}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sources:
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def give_back() -> None:
    """Return memory that this Python worker holds and doesn't use; workers live on from task to task, and so would it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: int = 8) -> Callable:
    """run, giving memory back now and then and at the end of the task."""

    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            for i, batch in enumerate(batches):
                if i % every == every - 1:
                    give_back()
                yield batch

        yield from run(counted())
        give_back()

    return tidied


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow with the package at hand on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)
