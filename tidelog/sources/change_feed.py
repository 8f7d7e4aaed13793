"""A Python data source: the version log as a resumable feed whose offsets are addresses.

``spark.dataSource.register(ChangeFeed)``, then ``spark.readStream.format("tidelog_changes")``
with options ``path`` (Parquet log) and ``after`` (address, exclusive).  Each file
with addresses inside the offsets is a partition, its rows leave as Arrow batches; a footer is
opened once, when its file is new.  The path must be one that pyarrow reads; for other stores use
``tidelog.streaming.feeds.changes``, which needs only Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class FilePart(InputPartition):
    def __init__(self, path: str, after: int, upto: int):
        self.path, self.after, self.upto = path, after, upto


def _files(path: str) -> list[str]:
    import pyarrow.dataset as ds

    return ds.dataset(path.removeprefix("file://"), format="parquet").files


def _rows(part: FilePart) -> Iterator:
    """Arrow batches of a file's changes inside the offsets."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    rows = ds.dataset(part.path, format="parquet").scanner(columns=["key", "is_tombstone", "seq"], filter=(ds.field("seq") > part.after) & (ds.field("seq") <= part.upto))
    for batch in rows.to_batches():
        if batch.num_rows:
            kind = pc.if_else(batch.column(1), pa.scalar("delete"), pa.scalar("put"))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), kind, batch.column(2).cast(pa.int64())], names=["key", "kind", "seq"])


def _bounds(file: str) -> tuple[int, int] | None:
    """Least and greatest address of a file, from its footer's statistics where there are any."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(file).metadata
    at = meta.schema.names.index("seq")
    low = high = None
    for g in range(meta.num_row_groups):
        s = meta.row_group(g).column(at).statistics
        if s is not None and s.has_min_max:
            a, b = s.min, s.max
        elif meta.row_group(g).num_rows:
            both = pc.min_max(ds.dataset(file).to_table(columns=["seq"])["seq"]).as_py()
            a, b = both["min"], both["max"]
        else:
            continue
        low, high = a if low is None else min(low, a), b if high is None else max(high, b)
    return None if low is None else (low, high)


class _Files:
    """The log's files with their bounds; each footer is opened once, when the file is new."""

    def __init__(self, path: str):
        self.path, self.bounds = path, {}

    def refresh(self) -> None:
        now = _files(self.path)
        for f in now:
            if f not in self.bounds:
                self.bounds[f] = _bounds(f)
        for f in set(self.bounds) - set(now):
            del self.bounds[f]

    def last(self, after: int) -> int:
        self.refresh()
        return max([after, *(b[1] for b in self.bounds.values() if b)])

    def parts(self, after: int, upto: int) -> list[InputPartition]:
        """Partitions for the files that hold addresses in (after, upto]."""
        if not self.bounds:
            self.refresh()
        return [FilePart(f, after, upto) for f, b in sorted(self.bounds.items()) if b and b[1] > after and b[0] <= upto]


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.after = options["path"], int(options.get("after", 0))

    def partitions(self) -> list[InputPartition]:
        return _Files(self.path).parts(self.after, (1 << 63) - 1) or [FilePart("", 0, 0)]

    def read(self, part: InputPartition) -> Iterator:
        return _rows(part) if part.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files, self.after = _Files(options["path"]), int(options.get("after", 0))

    def initialOffset(self) -> dict:
        return {"seq": self.after}

    def latestOffset(self) -> dict:
        return {"seq": self.files.last(self.after)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.files.parts(start["seq"], end["seq"]) or [FilePart("", 0, 0)]

    def read(self, part: InputPartition) -> Iterator:
        return _rows(part) if part.path else iter(())

    def commit(self, end: dict) -> None:
        pass


class ChangeFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog_changes"

    def schema(self) -> str:
        return "key long, kind string, seq long"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
