"""An event log as a streaming source: history and what is appended later, each event once, from any id on.

Ids are milliseconds and a number within them.  The log is a folder of Parquet files whose ids only grow from file to file;
an offset of the stream is the id of the last event it has given, so a stream goes on behind that id after a restart,
wherever it broke off, and a new one begins behind any id (`after`), before the last events (`last`), or at the beginning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from quire.shipping import ship

SCHEMA = "ms long, seq long, job long, type string, data string"
START = (-1, -1)


def after(stream_id: str) -> tuple[int, int]:
    ms, seq = stream_id.split("-")
    return int(ms), int(seq)


@dataclass
class Piece(InputPartition):
    """Events of one file behind `start` and up to `end`."""

    path: str
    start: tuple[int, int]
    end: tuple[int, int]


class Files:
    """The log's files with the least and the largest milliseconds of each, by their footers, which are read once."""

    def __init__(self, folder: str):
        self.fs, self.at = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
        self.known: dict[str, tuple[int, int, int]] = {}

    def spans(self) -> list[tuple[str, int, int, int]]:
        """path, least ms, largest ms, rows, in order."""
        listed = self.fs.get_file_info(pyarrow.fs.FileSelector(self.at, recursive=True, allow_not_found=True))
        for f in listed:
            name = f.base_name
            if f.is_file and name.endswith(".parquet") and name[0] not in "._" and f.path not in self.known:
                meta = pq.read_metadata(f.path, filesystem=self.fs)
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                stats = [g.column(meta.schema.names.index("ms")).statistics for g in groups]
                self.known[f.path] = (min(s.min for s in stats), max(s.max for s in stats), meta.num_rows) if stats else (0, -1, 0)
        return sorted(((p, *span) for p, span in self.known.items() if span[2]), key=lambda x: x[1:3])

    def ids(self, path: str) -> list[tuple[int, int]]:
        t = pq.read_table(path, columns=["ms", "seq"], filesystem=self.fs)
        return sorted(zip(t["ms"].to_pylist(), t["seq"].to_pylist(), strict=True))

    def newest(self) -> tuple[int, int]:
        spans = self.spans()
        if not spans:
            return START
        top = max(hi for _, _, hi, _ in spans)
        return max(self.ids(p)[-1] for p, _, hi, _ in spans if hi == top)

    def before_last(self, n: int) -> tuple[int, int]:
        """The id behind which the last n events stand."""
        held: list[tuple[int, int]] = []
        for path, *_ in reversed(self.spans()):
            held = self.ids(path) + held
            if len(held) > n:
                return held[-n - 1]
        return START


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.files = Files(options["path"])

    @staticmethod
    def _offset(at: tuple[int, int]) -> dict:
        return {"ms": at[0], "seq": at[1]}

    def initialOffset(self) -> dict:  # noqa: N802
        if "after" in self.options:
            return self._offset(after(self.options["after"]))
        return self._offset(self.files.before_last(int(self.options["last"])) if "last" in self.options else START)

    def latestOffset(self) -> dict:  # noqa: N802
        return self._offset(self.files.newest())

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        lo, hi = (start["ms"], start["seq"]), (end["ms"], end["seq"])
        return [Piece(p, lo, hi) for p, least, most, _ in self.files.spans() if most >= lo[0] and least <= hi[0]]

    def read(self, partition: Piece) -> Iterator[tuple]:
        file = pq.ParquetFile(self.files.fs.open_input_file(partition.path))
        for batch in file.iter_batches(batch_size=10_000, columns=["ms", "seq", "job", "type", "data"]):
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if partition.start < row[:2] <= partition.end:
                    yield row

    def commit(self, end: dict) -> None:
        pass


class EventLog(DataSource):
    """Streams a log folder: option path, and after ("ms-seq") or last (a number of events)."""

    @classmethod
    def name(cls) -> str:
        return "quire_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return Reader(dict(self.options))


def stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The log as a stream of SCHEMA rows."""
    ship(spark)
    spark.dataSource.register(EventLog)
    return spark.readStream.format("quire_log").options(path=folder, **options).load()


def append(events: DataFrame, folder: str, files: int = 4) -> None:
    """Add events (SCHEMA) to a log, in files of growing ids.  Their ids must come behind all that the log has."""
    events.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in SCHEMA.split(", ")]).repartitionByRange(files, "ms", "seq").sortWithinPartitions("ms", "seq").write.mode("append").parquet(folder)


def stream_ids(events: DataFrame) -> DataFrame:
    """ms and seq for events (id, ts, job, type): the number of an event within its millisecond, in order of id."""
    ms = F.unix_millis("ts")
    return events.withColumn("ms", ms).withColumn("seq", (F.row_number().over(Window.partitionBy("ms").orderBy("id")) - 1).cast("long"))


__all__ = ["EventLog", "Files", "append", "stream", "stream_ids"]
