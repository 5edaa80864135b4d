"""Packed sequence files as a Spark data source.

A packed file holds one record after the other: the description's length as a little-endian 32-bit number, the
description, the sequence's length, the sequence and an @, which its length counts. Beside each file lies its index, the
offset of every record, so a file is read in as many tasks as it has ranges of records, and a record by its number alone.

`packed` writes each partition as one file in its order. Files get their names when the job commits, so what lost tasks
leave is never read. Records are numbered over all files in the order of their names; a filter on seq_no is pushed down
to the ranges of records that are read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from strandloom.sources.sequences import pack_record

SCHEMA = "seq_no long, description string, sequence string"
SUFFIX, INDEX = ".packed", ".offsets"
RECORDS_OF_A_TASK = 50_000
BATCH_BYTES = 8 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Part(InputPartition):
    path: str
    first_no: int  # of the file's first record
    start: int
    end: int


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str


@dataclass
class _Reader(DataSourceReader):
    options: dict
    low: int = 0
    high: int = 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            bounds = {EqualTo: (0, 1), GreaterThanOrEqual: (0, None), GreaterThan: (1, None), LessThanOrEqual: (None, 1), LessThan: (None, 0)}.get(type(f))
            if bounds is None or f.attribute != ("seq_no",) or not isinstance(f.value, int):
                yield f
                continue
            low, high = bounds
            self.low = self.low if low is None else max(self.low, f.value + low)
            self.high = self.high if high is None else min(self.high, f.value + high)

    def partitions(self) -> Sequence[InputPartition]:
        where, path = file_system(self.options["path"])
        step = int(self.options.get("recordsofatask", RECORDS_OF_A_TASK))
        sizes = {f.path: f.size for f in where.get_file_info(fs.FileSelector(path))}
        parts, first = [], 0
        for file in sorted(f for f in sizes if f.endswith(SUFFIX)):
            n = sizes[file.removesuffix(SUFFIX) + INDEX] // 8 - 1
            a, b = max(self.low - first, 0), min(self.high - first, n)
            parts += [_Part(file, first, at, min(at + step, b)) for at in range(a, b, step)]
            first += n
        return parts

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's, where there are no others
            return
        where, _ = file_system(self.options["path"])
        with where.open_input_file(partition.path.removesuffix(SUFFIX) + INDEX) as index:
            index.seek(8 * partition.start)
            offsets = np.frombuffer(index.read(8 * (partition.end - partition.start + 1)), "<i8")
        at = 0
        with where.open_input_file(partition.path) as source:
            while at < len(offsets) - 1:
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
                source.seek(int(offsets[at]))
                raw = source.read(int(offsets[upto] - offsets[at]))
                records = [_record(raw, int(o - offsets[at])) for o in offsets[at:upto]]
                numbers = pa.array(np.arange(at, upto) + partition.first_no + partition.start)
                yield pa.RecordBatch.from_arrays([numbers, *[pa.array(c, pa.string()) for c in zip(*records)]], names=["seq_no", "description", "sequence"])
                at = upto


def _record(raw: bytes, at: int) -> tuple[str, str]:
    (n,) = struct.unpack_from("<i", raw, at)
    (m,) = struct.unpack_from("<i", raw, at + 4 + n)
    start = at + 8 + n
    return raw[at + 4 : at + 4 + n].decode("latin-1"), raw[start : start + m - 1].decode("latin-1")


@dataclass
class _Writer(DataSourceArrowWriter):
    options: dict
    job: str = field(default_factory=lambda: uuid.uuid4().hex)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, path = file_system(self.options["path"])
        where.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"_{self.job}-{context.partitionId()}-{context.taskAttemptId()}"
        at = 0
        with where.open_output_stream(f"{path}/{name}") as out, where.open_output_stream(f"{path}/{name}{INDEX}") as index:
            for batch in iterator:
                for description, sequence in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    record = pack_record(description or "", sequence or "")
                    index.write(struct.pack("<q", at))
                    out.write(record)
                    at += len(record)
            index.write(struct.pack("<q", at))
        return _Written(context.partitionId(), name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, path = file_system(self.options["path"])
        where.create_dir(path, recursive=True)
        if any(f.path.endswith(SUFFIX) for f in where.get_file_info(fs.FileSelector(path))):
            self.abort(messages)
            raise ValueError(f"{path} holds packed files already")
        for message in filter(None, messages):
            to = f"{path}/part-{message.part:06d}"
            where.move(f"{path}/{message.name}{INDEX}", to + INDEX)  # a file is there once its index is
            where.move(f"{path}/{message.name}", to + SUFFIX)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, path = file_system(self.options["path"])
        for message in filter(None, messages):
            for name in (message.name, message.name + INDEX):
                if where.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
                    where.delete_file(f"{path}/{name}")


class Packed(DataSource):
    """Folders of packed files: rows written are (description, sequence), rows read SCHEMA; option recordsOfATask."""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in dict(self.options).items()})

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Packed)


def write_packed(sequences: DataFrame, folder: str, *, by_length: bool = True) -> None:
    """Writes sequences (seq_no, description, sequence), the longest first or by number, in files of ranges of that order.

    Null descriptions and sequences are empty. inverse_index() has the number of the record at each place.
    """
    register(sequences.sparkSession)
    length = F.length(F.coalesce("sequence", F.lit("")))
    order = [length.desc(), F.asc("seq_no")] if by_length else [F.asc("seq_no")]
    sequences.repartitionByRange(*order).sortWithinPartitions(*order).select("description", "sequence").write.format("packed").mode("append").save(folder)


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """(seq_no, description, sequence) of all records of a folder, numbered from 0."""
    register(spark)
    return spark.read.format("packed").load(folder)
