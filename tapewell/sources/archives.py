"""Zip archives of vendor files as a Spark data source: one partition per member.

``spark.read.format("zip_members").schema("ticker string, oi string").load(path)`` reads the csv, json, jsonl and ndjson
members (also gzipped) of an archive or of all archives of a folder.  The driver reads the tables of contents only; every
member streams through a task of its own, which seeks to it in the archive.  Paths are local, or anything that
``pyarrow.fs`` resolves (``hdfs://``, ``s3://`` ...).
"""

from __future__ import annotations

import gzip
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.taskcontext import TaskContext

ROWS = 8192  # of a batch
LINES = (".json", ".jsonl", ".ndjson")


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; ``file:/x`` and plain paths are local."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    fs, root = resolve(path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [root]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(".zip"))


def kind_of(member: str) -> str | None:
    name = member.lower().removesuffix(".gz")
    return "csv" if name.endswith(".csv") else "lines" if name.endswith(LINES) else None


@dataclass
class Member(InputPartition):
    archive: str
    name: str


def _csv(stream, names: list[str]) -> Iterator[pa.RecordBatch]:
    try:
        reader = pacsv.open_csv(stream, convert_options=pacsv.ConvertOptions(
            include_columns=names, include_missing_columns=True, column_types={n: pa.string() for n in names}, strings_can_be_null=True, null_values=[""]))
    except pa.ArrowInvalid as e:
        if "Empty CSV" in str(e):
            return
        raise
    for batch in reader:
        yield pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in batch.columns], names)


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _lines(stream, names: list[str]) -> Iterator[pa.RecordBatch]:
    """JSON objects line by line; lines that are none are left out."""
    rows: list[list] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)

    for line in stream:
        try:
            record = json.loads(line)
        except ValueError:
            continue
        if isinstance(record, dict):
            rows.append([_text(record.get(n)) for n in names])
        if len(rows) == ROWS:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names = path, schema.names

    def partitions(self) -> list[Member]:
        fs, _ = resolve(self.path)
        out = []
        for archive in archives(self.path):
            with fs.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                out += [Member(archive, i.filename) for i in z.infolist() if not i.is_dir() and kind_of(i.filename)]
        return out

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no member at all
            return
        fs, _ = resolve(self.path)
        with fs.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as raw:
            stream = gzip.open(raw) if partition.name.lower().endswith(".gz") else raw
            yield from (_csv if kind_of(partition.name) == "csv" else _lines)(stream, self.names)


class ZipMembers(DataSource):
    """Text columns of the members, absent ones null; the schema has to be given."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if any(not isinstance(f.dataType, T.StringType) for f in schema.fields):
            raise ValueError("columns of zip members are read as strings")
        return _Reader(self.options["path"], schema)


def zip_members(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of all members below ``path``, every column as text."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").schema(", ".join(f"`{c}` string" for c in columns)).load(path)


def write_zip(df: DataFrame, path: str) -> int:
    """Each partition of ``df`` as one archive below ``path`` with a member per batch, csv and jsonl in turn; the rows
    written.  A repeated task replaces its archive."""
    fs, root = resolve(path)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own, base = resolve(path)
        target = f"{base}/part-{task.partitionId():05d}"
        part, rows = f"{target}.{task.taskAttemptId()}.tmp", 0
        with own.open_output_stream(part) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for k, batch in enumerate(batches):
                rows += batch.num_rows
                with z.open(f"{k:05d}.{'csv' if k % 2 == 0 else 'jsonl'}", "w") as m:
                    if k % 2 == 0:
                        pacsv.write_csv(batch, m)
                    else:
                        for row in batch.to_pylist():
                            m.write(json.dumps(row, default=str).encode() + b"\n")
        own.move(part, f"{target}.zip")
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    return df.mapInArrow(write, "rows long").groupBy().sum("rows").first()[0] or 0
