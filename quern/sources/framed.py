"""Files of concatenated records: a Spark reader for any store, and a Python data source (read and write)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quern.shipping import ship

from .binary import RecordError, check


def split(data: bytes):
    """(offset, record) of every record in ``data``; RecordError if the last one is cut off."""
    at = 0
    while at < len(data):
        size = check(data[at : at + 8] + data[at + 8 :]) if at == 0 else _sized(data, at)
        yield at, data[at : at + size]
        at += size


def _sized(data: bytes, at: int) -> int:
    size = int.from_bytes(data[at + 3 : at + 8], "little")
    if len(data) - at < 8 or data[at + 2] != 14 or size < 8 or at + size > len(data):
        raise RecordError(f"no whole record at {at}")
    return size


def read_framed(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, record) of all files under ``path``, in any store that Spark reads; a task a file."""
    ship(spark)

    def kernel(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                found = list(split(content))
                yield pa.RecordBatch.from_pydict({"path": [name] * len(found), "offset": [a for a, _ in found], "record": [r for _, r in found]}, schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(kernel, "path string, offset long, record binary")


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


@dataclass
class _Written(WriterCommitMessage):
    path: str


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class RecordSource(DataSource):
    """``spark.read.format("quern_records").load(folder)`` and ``df.write.format(...).save(folder)``: column record."""

    @classmethod
    def name(cls) -> str:
        return "quern_records"

    def schema(self) -> str:
        return "record binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        store, base = _store(self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".records")]

    def read(self, partition):
        store, _ = _store(self.path)
        with store.open_input_stream(partition.path) as f:
            while head := f.read(8):
                if len(head) < 8 or head[2] != 14:
                    raise RecordError("no whole record")
                body = f.read(int.from_bytes(head[3:8], "little") - 8)
                yield (head + body,)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        name = f"{base}/{self.run}-{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(name) as f:
            for row in iterator:
                f.write(bytes(row[0]))
        return _Written(name)

    def commit(self, messages):
        from pyarrow import fs

        store, base = _store(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(base)):
                if f.path.endswith(".records"):
                    store.delete_file(f.path)
        for m in messages:
            if m is not None:
                store.move(m.path, m.path[:-4] + ".records")

    def abort(self, messages):
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RecordSource)
