"""The interaction log, or any Parquet table with a rising sequence number, as a data source with partitions by sequence.

spark.dataSource.register(LogSource)
spark.read.format("engrama_log").option("path", p).load()         # options: key (seq), rows (a partition's, about), pushdown
spark.readStream.format("engrama_log").option("path", p).load()   # the offset is the last sequence number read

Bounds of the sequence come from the files' statistics, so planning reads no rows. Filters
that compare the sequence narrow the range that is cut into partitions; they and filters on
other columns also go to the reader of the files, which skips row groups by statistics. That
is so with option pushdown=true (and spark.sql.python.filterPushdown.enabled), and then each
query needs a load() of its own: Spark keeps the filters that one query of a frame has pushed.
Without the option a frame can be used again and again, and Spark filters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

NAME = "engrama_log"
ROWS = 100_000


def _opened(path: str) -> ds.Dataset:
    if "://" in path:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(path)
        return ds.dataset(path, format="parquet", filesystem=fs)
    return ds.dataset(path.removeprefix("file:"), format="parquet")


def bounds(data: ds.Dataset, key: str) -> tuple[int, int] | None:
    """Least and greatest sequence number, from statistics of row groups; None without rows."""
    low = high = None
    for fragment in data.get_fragments():
        for group in fragment.row_groups:
            stats = (group.statistics or {}).get(key)
            if stats is None and group.num_rows:
                column = fragment.subset(row_group_ids=[group.id]).to_table(columns=[key])[key]
                stats = {"min": pa.compute.min(column).as_py(), "max": pa.compute.max(column).as_py()}
            if stats and stats["min"] is not None:
                low = stats["min"] if low is None else min(low, stats["min"])
                high = stats["max"] if high is None else max(high, stats["max"])
    return None if low is None else (low, high)


@dataclass
class Range(InputPartition):
    """Rows with low <= key <= high."""

    low: int
    high: int


_COMPARE = {EqualTo: lambda c, v: c == v, GreaterThan: lambda c, v: c > v, GreaterThanOrEqual: lambda c, v: c >= v, LessThan: lambda c, v: c < v, LessThanOrEqual: lambda c, v: c <= v, In: lambda c, v: c.isin(list(v))}


class _Reading:
    def __init__(self, options: dict, schema: StructType):
        self.path, self.key, self.rows = options["path"], options.get("key", "seq"), int(options.get("rows", ROWS))
        self.columns = schema.names
        self.filters: list[tuple[str, str, object]] = []

    def cut(self, low: int, high: int, n: int) -> list[Range]:
        """Ranges of the sequence for about `rows` rows each, of n rows that are spread over it."""
        parts = max(1, -(-n // self.rows))
        width = -(-(high - low + 1) // parts)
        return [Range(a, min(high, a + width - 1)) for a in range(low, high + 1, width)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        wanted = (ds.field(self.key) >= partition.low) & (ds.field(self.key) <= partition.high)
        by_name = {f.__name__: c for f, c in _COMPARE.items()}
        for kind, column, value in self.filters:
            wanted &= by_name[kind](ds.field(column), value)
        for batch in _opened(self.path).to_batches(columns=self.columns, filter=wanted):
            if batch.num_rows:
                yield batch


class LogReader(_Reading, DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.low = self.high = None
        self.push = str(options.get("pushdown", "false")).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        if not self.push:
            yield from filters
            return
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) not in _COMPARE or len(column) != 1 or column[0] not in self.columns:
                yield f  # Spark's to apply
                continue
            self.filters.append((type(f).__name__, column[0], list(f.value) if isinstance(f, In) else f.value))
            if column[0] == self.key and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                least = f.value + isinstance(f, GreaterThan)
                self.low = least if self.low is None else max(self.low, least)
            if column[0] == self.key and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                most = f.value - isinstance(f, LessThan)
                self.high = most if self.high is None else min(self.high, most)

    def partitions(self) -> Sequence[Range]:
        data = _opened(self.path)
        found = bounds(data, self.key)
        if found is None:
            return [Range(0, -1)]
        low, high = max(found[0], found[0] if self.low is None else self.low), min(found[1], found[1] if self.high is None else self.high)
        if low > high:
            return [Range(0, -1)]
        share = (high - low + 1) / (found[1] - found[0] + 1)
        return self.cut(low, high, max(1, round(share * data.count_rows())))


class LogStream(_Reading, DataSourceStreamReader):
    """Offsets are {"seq": the last one that was read}; rows that come with a smaller number later are not seen."""

    def initialOffset(self) -> dict:
        found = bounds(_opened(self.path), self.key)
        return {"seq": found[0] - 1 if found else -1}

    def latestOffset(self) -> dict:
        found = bounds(_opened(self.path), self.key)
        return {"seq": found[1] if found else -1}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        low, high = start["seq"] + 1, end["seq"]
        return self.cut(low, high, high - low + 1) if low <= high else [Range(0, -1)]

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return from_arrow_schema(_opened(self.options["path"]).schema, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options, schema)

    def streamReader(self, schema: StructType) -> LogStream:
        return LogStream(self.options, schema)
