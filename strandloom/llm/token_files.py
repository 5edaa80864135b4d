"""Token ids in files of independent zstandard frames with a seek table.

A file holds the ids of its documents one after the other, little-endian, in frames that are compressed alone. A frame
is closed at the end of a document once the next would make it longer than it may be; a longer document goes on over
frames of its own. Then come two skippable frames, which any zstandard reader passes over: the index of the documents
(their ids and numbers of tokens), and the seek table in the public seekable format, with each frame's size,
its size when decompressed, and a checksum of its content, the low 32 bits of XXH64. So a reader of some documents
reads the two tables from the file's end, decompresses the frames that hold these documents and checks them alone.

`token_frames` is a Spark data source. Files are written under temporary names and get their own when the job commits,
so what lost tasks leave is never read. Readers deal files out by ranges of bytes; a frame, and the documents that
begin in it, belong to the range where it begins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strandloom.llm.vocabulary import encode_runs
from strandloom.session import Workspace

WORD_BPE = "word_bpe_49k"
DOCUMENT_END = 1
FRAME_TOKENS = 1 << 15
SPLIT_BYTES = 64 << 20
LEVEL = 3
SLICE_BYTES = 2 << 20
KNOWN_RUNS = 600_000
ENCODED_AT_ONCE = 16_384  # runs
SUFFIX = ".tokens.zst"
# fixed values of the public zstandard formats
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80  # in the descriptor: each entry has one
ENTRY = np.dtype([("size", "<u4"), ("length", "<u4"), ("checksum", "<u4")])
FOOTER = np.dtype([("frames", "<u4"), ("descriptor", "u1"), ("magic", "<u4")])
HEADER = np.dtype([("magic", "<u4"), ("size", "<u4")])
INDEX = np.dtype([("documents", "<u8"), ("width", "<u8")])


def checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


def _skippable(magic: int, content: bytes) -> bytes:
    return np.array((magic, len(content)), HEADER).tobytes() + content


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FrameWriter:
    """Writes documents to an open binary file."""

    def __init__(self, out, width: int = 4, frame_tokens: int = FRAME_TOKENS, level: int = LEVEL) -> None:
        self.out, self.frame_tokens, self.kind = out, frame_tokens, np.dtype(f"<u{width}")
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.waiting_tokens = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and (ids.min() < 0 or ids.max() > np.iinfo(self.kind).max):
            raise ValueError(f"ids of document {doc_id} don't fit in {self.kind.itemsize} bytes")
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        if self.waiting_tokens + len(ids) > self.frame_tokens:
            self._flush()
        for start in range(0, len(ids), self.frame_tokens):
            piece = ids[start : start + self.frame_tokens]
            self.waiting.append(piece.astype(self.kind))
            self.waiting_tokens += len(piece)
            if self.waiting_tokens == self.frame_tokens:
                self._flush()

    def _flush(self) -> None:
        if self.waiting:
            content = np.concatenate(self.waiting).tobytes()
            frame = self.compressor.compress(content)
            self.out.write(frame)
            self.frames.append((len(frame), len(content), checksum(content)))
            self.waiting, self.waiting_tokens = [], 0

    def finish(self) -> None:
        self._flush()
        known = np.array([i is not None for i in self.ids], np.uint8)
        parts = [np.array((len(self.ids), self.kind.itemsize), INDEX), np.array([i or 0 for i in self.ids], "<i8"), known, np.array(self.counts, "<u8")]
        index = self.compressor.compress(b"".join(p.tobytes() for p in parts))
        self.out.write(_skippable(INDEX_MAGIC, index + checksum(index).to_bytes(4, "little")))
        table = np.array(self.frames, ENTRY).tobytes() + np.array((len(self.frames), CHECKSUMS, SEEKABLE_MAGIC), FOOTER).tobytes()
        self.out.write(_skippable(TABLE_MAGIC, table))


class FrameFile:
    """Reads documents from an open binary file, by their places in it."""

    def __init__(self, source, size: int) -> None:
        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        footer = np.frombuffer(self._read(size - FOOTER.itemsize, FOOTER.itemsize), FOOTER)[0]
        if footer["magic"] != SEEKABLE_MAGIC or footer["descriptor"] != CHECKSUMS:
            raise ValueError("no seek table with checksums at the file's end")
        table = int(footer["frames"]) * ENTRY.itemsize
        start = size - FOOTER.itemsize - table
        self.frames = np.frombuffer(self._read(start, table), ENTRY)
        self.starts = np.concatenate(([0], np.cumsum(self.frames["size"], dtype=np.int64)))  # of frames in the file; the last is the index's
        at = int(self.starts[-1]) + HEADER.itemsize
        index = self._read(at, start - HEADER.itemsize - at)
        if checksum(index[:-4]) != int.from_bytes(index[-4:], "little"):
            raise ValueError("the index of documents is damaged")
        content = self.decompressor.decompress(index[:-4])
        n, width = (int(x) for x in np.frombuffer(content, INDEX, 1)[0])
        self.kind, at = np.dtype(f"<u{width}"), INDEX.itemsize
        self.ids = np.frombuffer(content, "<i8", n, at)
        self.known = np.frombuffer(content, np.uint8, n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(content, "<u8", n, at + 9 * n).astype(np.int64)
        self.doc_starts = np.cumsum(self.counts) - self.counts
        self.tokens = np.concatenate(([0], np.cumsum(self.frames["length"] // width, dtype=np.int64)))  # before each frame
        self._last: tuple[int, np.ndarray] | None = None

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, i: int) -> np.ndarray:
        """The ids of a frame, once its checksum holds."""
        if self._last is None or self._last[0] != i:
            size, length, given = (int(x) for x in self.frames[i])
            content = self.decompressor.decompress(self._read(int(self.starts[i]), size), max_output_size=length)
            if len(content) != length or checksum(content) != given:
                raise ValueError(f"frame {i} is damaged")
            self._last = i, np.frombuffer(content, self.kind)
        return self._last[1]

    def document(self, place: int) -> np.ndarray:
        """The ids of one document; only the frames that hold it are read."""
        at, end = int(self.doc_starts[place]), int(self.doc_starts[place] + self.counts[place])
        parts = []
        while at < end:
            i = int(np.searchsorted(self.tokens, at, "right")) - 1
            first, last = int(self.tokens[i]), int(self.tokens[i + 1])
            parts.append(self.frame(i)[at - first : min(end, last) - first])
            at = min(end, last)
        return np.concatenate(parts) if parts else np.zeros(0, self.kind)

    def beginning_in(self, start: int, end: int) -> range:
        """Places of the documents that begin in frames that begin in these bytes; without frames, all belong to the first byte."""
        if not len(self.frames):
            return range(len(self.ids) if start <= 0 < end else 0)
        first, last = np.searchsorted(self.starts[:-1], [start, end])
        frame = np.clip(np.searchsorted(self.tokens, self.doc_starts, "right") - 1, 0, len(self.frames) - 1)
        a, b = np.searchsorted(frame, [first, last])
        return range(int(a), int(b))


SCHEMA = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("place", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
])


@dataclass
class _Part(InputPartition):
    path: str
    size: int
    start: int
    end: int


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str


@dataclass
class _Reader(DataSourceReader):
    options: dict

    def partitions(self) -> Sequence[InputPartition]:
        where, path = file_system(self.options["path"])
        step = int(self.options.get("splitbytes", SPLIT_BYTES))
        files = sorted((f.path, f.size) for f in where.get_file_info(fs.FileSelector(path)) if f.path.endswith(SUFFIX))
        return [_Part(file, size, at, at + step) for file, size in files for at in range(0, size, step)]

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's, where there are no others
            return
        where, _ = file_system(self.options["path"])
        asked = self.options.get("ids")
        with where.open_input_file(partition.path) as source:
            found = FrameFile(source, partition.size)
            places = np.array(found.beginning_in(partition.start, partition.end), np.int64)
            if asked is not None:
                places = places[found.known[places] & np.isin(found.ids[places], np.array(asked.split(",") if asked else [], np.int64))]
            name = partition.path.rsplit("/", 1)[-1]
            at = 0
            while at < len(places):
                some = places[at : at + max(1, int(np.searchsorted(np.cumsum(found.counts[places[at : at + 4096]]), 1 << 20)))]  # bounded, however long documents are
                at += len(some)
                ids = [found.document(int(p)) for p in some]
                offsets = np.concatenate(([0], np.cumsum(found.counts[some]))).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(some)), pa.array(some), pa.array(found.doc_starts[some]), pa.array(found.ids[some], mask=~found.known[some]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ], names=SCHEMA.names)


@dataclass
class _Writer(DataSourceArrowWriter):
    options: dict
    overwrite: bool
    job: str = field(default_factory=lambda: uuid.uuid4().hex)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, path = file_system(self.options["path"])
        where.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"_{self.job}-{context.partitionId()}-{context.taskAttemptId()}"
        with where.open_output_stream(f"{path}/{name}") as out:
            writer = FrameWriter(out, int(self.options.get("width", 4)), int(self.options.get("frametokens", FRAME_TOKENS)))
            for batch in iterator:
                for ids, offsets, flat in self._lists(batch):
                    for i, doc_id in enumerate(ids):
                        writer.add(doc_id, flat[offsets[i] : offsets[i + 1]])
            writer.finish()
        return _Written(context.partitionId(), name)

    def _lists(self, batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """Document ids, and offsets and values of their tokens; texts are encoded slice by slice, here, so their ids cross to no other process."""
        if pa.types.is_list(batch.column(1).type):
            yield batch.column(0).to_pylist(), batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            return
        end = int(self.options["end"]) if self.options.get("end") else None
        for some in slices(batch):
            yield some.column(0).to_pylist(), *encode_column(some.column(1), self.options["vocabulary"], end)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, path = file_system(self.options["path"])
        where.create_dir(path, recursive=True)
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(path)):
                if f.path.endswith(SUFFIX):
                    where.delete_file(f.path)
        elif any(f.path.endswith(SUFFIX) for f in where.get_file_info(fs.FileSelector(path))):
            self.abort(messages)
            raise ValueError(f"{path} holds token files; write to another folder or with mode overwrite")
        for message in messages:
            if message is not None:
                where.move(f"{path}/{message.name}", f"{path}/part-{message.part:06d}{SUFFIX}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, path = file_system(self.options["path"])
        for message in messages:
            if message is not None and where.get_file_info(f"{path}/{message.name}").type != fs.FileType.NotFound:
                where.delete_file(f"{path}/{message.name}")


class TokenFrames(DataSource):
    """Reads and writes folders of token files.

    Written rows are (doc_id long, ids array<int>), each partition one file in its order; options `width` (bytes an id)
    and `frameTokens`. Or they are (doc_id long, text string): options `vocabulary` and `end`, the id after each text. Rows read are SCHEMA: `start` counts the ids before the document in its file; options `ids`
    (document ids, comma-separated: no other documents are decompressed) and `splitBytes`.
    """

    @classmethod
    def name(cls) -> str:
        return "token_frames"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer({k.lower(): v for k, v in dict(self.options).items()}, overwrite)


class RunTable:
    """Runs without white space and their ids, as flat arrays; it starts anew when it holds KNOWN_RUNS."""

    def __init__(self, vocabulary: str) -> None:
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.runs = pa.array([], pa.large_string())
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def places(self, runs: pa.Array) -> np.ndarray:
        """Where each of these distinct runs stands in the table; new ones are encoded and added."""
        if len(self.runs) > KNOWN_RUNS:
            self._clear()
        at = pc.index_in(runs, value_set=self.runs)
        unknown = at.is_null().to_numpy(zero_copy_only=False)
        out = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if unknown.any():
            new = runs.filter(pa.array(unknown))
            out[unknown] = len(self.runs) + np.arange(len(new))
            parts = [encode_runs(new.slice(i, ENCODED_AT_ONCE).to_pylist(), self.vocabulary) for i in range(0, len(new), ENCODED_AT_ONCE)]
            self.runs = pa.concat_arrays([self.runs, new])
            self.ids = np.concatenate([self.ids, *[ids for ids, _ in parts]])
            self.counts = np.concatenate([self.counts, *[counts for _, counts in parts]])
        return out


_table = lru_cache(maxsize=2)(RunTable)  # one for each worker process and vocabulary


def encode_column(texts: pa.Array, vocabulary: str = WORD_BPE, end: int | None = DOCUMENT_END) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of whole texts, null ones empty, each with the end id after its own.

    For vocabularies that drop white space: what a run between white space encodes to does not depend on what lies
    around it, so each distinct run is encoded once. A bounded number of runs is kept from batch to batch.
    """
    words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, table = words.flatten().dictionary_encode(), _table(vocabulary)
    of_run = table.places(flat.dictionary)
    ends = words.value_lengths().to_numpy(zero_copy_only=False).cumsum()
    order = np.insert(of_run[flat.indices.to_numpy(zero_copy_only=False)], ends, len(table.counts))  # the end id stands after each text
    counts = np.append(table.counts, end is not None)
    ids = np.append(table.ids, np.int32(0 if end is None else end))
    n, firsts = counts[order], np.cumsum(counts) - counts
    upto = np.cumsum(n)
    places = np.repeat(firsts[order] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)
    offsets = np.concatenate(([0], upto[ends + np.arange(len(ends))])) if len(ends) else np.zeros(1, np.int64)
    return offsets, ids[places]


def encoded(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE, end: int | None = DOCUMENT_END) -> DataFrame:
    """(id_col, ids) of every row in its place, without a shuffle."""
    schema = T.StructType([T.StructField(id_col, documents.select(id_col).schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                offsets, ids = encode_column(some.column(1), vocabulary, end)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([some.column(0), lists], names=schema.names)

    return documents.select(id_col, text_col).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded bytes of the second column's texts, a longer one alone."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        n = max(1, int(np.searchsorted(upto[at:], before + most, "right")))
        yield batch.slice(at, n)
        at += n


def write(documents: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE, end: int | None = DOCUMENT_END, width: int = 2) -> None:
    """Writes the ids of every whole text, null ones empty, to token files in ascending order of ids.

    Ids must be integers. Null ids come first; rows with one id go by their text's XXH64, repeated rows stay. Rows are
    dealt out by ranges of id and text, so however many have one id, no task takes them all. No rows give no documents.
    """
    spark = documents.sparkSession
    spark.dataSource.register(TokenFrames)
    named = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("_hash"), F.asc("_copy")]
    keyed = named.withColumns({"_hash": F.xxhash64("text"), "_copy": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = dealt.select("doc_id", "text").write.format("token_frames").option("width", width).option("vocabulary", vocabulary)
    (rows if end is None else rows.option("end", end)).mode("append").save(folder)


def read(spark: SparkSession, folder: str, ids: Sequence[int] | None = None) -> DataFrame:
    """(file, place, start, doc_id, ids) of all documents in a folder, or of those with the given ids alone."""
    spark.dataSource.register(TokenFrames)
    reader = spark.read.format("token_frames")
    return (reader if ids is None else reader.option("ids", ",".join(map(str, ids)))).load(folder)


def digest(found: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents that read() gives; start counts the ids of all before it, over all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            sums = [crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=["file", "start", "doc_id", "n_tokens", "ids_crc32"])

    rows = work.keep(found.select("file", "start", "doc_id", "ids").mapInArrow(run, "file string, start long, doc_id long, n_tokens long, ids_crc32 long"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    firsts = files.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    joined = rows.join(F.broadcast(firsts), "file")  # as many rows as files
    return joined.select("doc_id", (F.col("_first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
