"""Readers of event logs: files with a fixed schema, and a block-ranged source for batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RAW_LOG = (
    "network string, chain_id long, address string, topics array<string>, data string, block_number long, block_hash string, "
    "parent_hash string, block_timestamp timestamp, tx_hash string, tx_index long, log_index long, removed boolean"
)
#: Smallest share of a parallel scan, and its shares where the files do not call for more.
MIN_BLOCKS, MAX_WORKERS = 1000, 32


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_LOG).parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_LOG).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file with a header; fields that a row lacks are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)


def shares(start: int, end: int, workers: int = MAX_WORKERS) -> list[tuple[int, int]]:
    """A block range in parts that can be read side by side."""
    if end < start:
        return []
    n = end - start + 1
    step = max(MIN_BLOCKS, -(-n // max(1, workers)))
    return [(a, min(a + step - 1, end)) for a in range(start, end + 1, step)]


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class BlockTable(DataSource):
    """A source over Parquet files with a block column, dealt out by block range.

    Options: path, block (column name), start, end, distance (blocks to stay behind the head),
    workers. As a stream its offset is the next block, and it never runs past head - distance.
    The path is opened in the executors' Python, so it must be one that pyarrow opens.
    """

    @classmethod
    def name(cls) -> str:
        return "blocktable"

    def _file(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.options["path"])

    @property
    def block(self) -> str:
        return self.options.get("block", "block_number")

    def head(self) -> int:
        """The highest block, from the files' footers; a column without statistics is read file by file."""
        import pyarrow.compute as pc

        head = -1
        for part in self._file().get_fragments():
            at = part.physical_schema.get_field_index(self.block)
            for k in range(part.metadata.num_row_groups):
                known = part.metadata.row_group(k).column(at).statistics
                if known is not None and known.has_min_max:
                    head = max(head, int(known.max))
                elif len(column := part.subset(row_group_ids=[k]).to_table(columns=[self.block])[self.block]):
                    head = max(head, int(pc.max(column).as_py() or 0))
        return head

    def workers(self) -> int:
        """Shares of a scan: at least one for each row group of the files."""
        if "workers" in self.options:
            return int(self.options["workers"])
        return max(MAX_WORKERS, sum(p.metadata.num_row_groups for p in self._file().get_fragments()))

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._file().schema)

    def bounds(self) -> tuple[int, int]:
        end = self.head() - int(self.options.get("distance", 0))
        if "end" in self.options:
            end = min(end, int(self.options["end"]))
        return int(self.options.get("start", 0)), end

    def rows(self, part: _Range) -> Iterator:
        import pyarrow.dataset as ds

        names = self._file().schema.names
        at = ds.field(self.block)
        yield from self._file().to_batches(columns=names, filter=(at >= part.start) & (at <= part.end))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self)


class _Batch(DataSourceReader):
    def __init__(self, source: BlockTable):
        self.source = source

    def partitions(self):
        start, end = self.source.bounds()
        return [_Range(a, b) for a, b in shares(start, end, self.source.workers())] or [_Range(0, -1)]

    def read(self, partition):
        return self.source.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, source: BlockTable):
        self.source = source

    def initialOffset(self) -> dict:
        return {"block": self.source.bounds()[0]}

    def latestOffset(self) -> dict:
        start, end = self.source.bounds()
        return {"block": max(start, end + 1)}

    def partitions(self, start: dict, end: dict):
        return [_Range(a, b) for a, b in shares(start["block"], end["block"] - 1, self.source.workers())] or [_Range(0, -1)]

    def read(self, partition):
        return self.source.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockTable)
