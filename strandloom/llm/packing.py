"""Hierarchical multi-length packing of documents into training windows.

Each input partition is one stream. A document's tokens first fill whole windows of the longest tier; its
remainder is routed to the smallest tier that holds it. Every tier is packed from its longest pieces down, and
the gap that a piece leaves in its window is filled from shorter tiers: by the longest piece that fits, else by
a cut of the shortest one. What cannot fill a window is carried on. Only a partition's last tokens, fewer than
one window, are left; they go to tail windows at powers of two, so nothing is padded.

Packing is one pass without a shuffle: memory holds one Arrow batch, one document's ids and a bounded buffer of
remainders, and a lost task is repeated from its input split with the same result. Its pieces are written, windows of
each length are counted by partition, and running totals of these counts number them over all partitions. Windows
that follow each other in that numbering form step groups, which hold the same number of tokens all over: only the
last group of each window length may be short.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.vocabulary import BYTE_BPE, encode_text
from strandloom.session import cut_lineage

TIERS = (256, 512, 1024, 2048)
DOCUMENT_END = 1
STEP_TOKENS = 65_536
BUFFER_TOKENS = 1 << 20
_STREAM_BITS = 36
_STEP_BITS = 40


class _Packer:
    """Packs pieces (length, serial, doc, start, ids); emitted rows gather in self.rows."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, base: int) -> None:
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.sequences, self.steps, self.serial = base, base, 0
        self.pool: list[tuple] = []
        self.buffered = 0
        self.open_steps: dict[int, list[int]] = {}  # window length -> [step id, tokens so far], within this stream
        self.made: dict[int, int] = {}  # windows of each length so far
        self.rows: list[tuple] = []

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        top = self.tiers[-1]
        whole = len(ids) // top * top
        for start in range(0, whole, top):
            self._emit(top, [(top, 0, doc, start, ids[start : start + top])])
        if whole < len(ids):
            self._keep(doc, whole, ids[whole:].copy())

    def _keep(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        self.serial += 1
        insort(self.pool, (len(ids), self.serial, doc, start, ids), key=lambda piece: piece[:2])
        self.buffered += len(ids)

    def _take(self, at: int) -> tuple:
        piece = self.pool.pop(at)
        self.buffered -= piece[0]
        return piece

    def _cut(self, piece: tuple, n: int) -> tuple:
        """The first n tokens of a piece; the others go back."""
        _, serial, doc, start, ids = piece
        self._keep(doc, start + n, ids[n:])
        return (n, serial, doc, start, ids[:n])

    def drain(self) -> None:
        """Packs windows until the pieces left do not fill one more."""
        while self.pool:
            window = next(t for t in self.tiers if t >= self.pool[-1][0])
            pieces = [self._take(-1)]
            gap = window - pieces[0][0]
            while gap and self.pool:
                fits = bisect_right(self.pool, gap, key=lambda piece: piece[0])
                piece = self._take(fits - 1) if fits else self._cut(self._take(0), gap)
                pieces.append(piece)
                gap -= piece[0]
            if gap:
                for _, _, doc, start, ids in pieces:
                    self._keep(doc, start, ids)
                return
            self._emit(window, pieces)

    def finish(self) -> None:
        """Tail windows: the last tokens, longest power of two first."""
        self.drain()
        while self.pool:
            window = 1 << (self.buffered.bit_length() - 1)
            pieces, gap = [], window
            while gap:
                piece = self._take(-1)
                piece = piece if piece[0] <= gap else self._cut(piece, gap)
                pieces.append(piece)
                gap -= piece[0]
            self._emit(window, pieces)

    def _emit(self, window: int, pieces: list[tuple]) -> None:
        step = self.open_steps.setdefault(window, [0, self.step_tokens])
        if step[1] + window > self.step_tokens:
            step[:] = [self.steps, 0]
            self.steps += 1
        step[1] += window
        nth = self.made.get(window, 0)
        self.made[window] = nth + 1
        offset = 0
        for n, _, (doc_id, doc_tokens), start, ids in pieces:
            self.rows.append((doc_id, start, n, zlib.crc32(ids.tobytes()), doc_tokens, self.sequences, offset, window, step[0], nth))
            offset += n
        self.sequences += 1


def pack_stream(
    documents: Iterable[tuple[object, str | None]], stream: int = 0, *, tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS, vocabulary: str = BYTE_BPE, document_end: int = DOCUMENT_END,
) -> Iterator[tuple]:
    """Rows (doc_id, start, length, crc, doc tokens, sequence, offset, window, step, nth) of one stream of documents.

    step numbers the step groups that the stream would form alone, nth its windows of each length from 0.
    """
    packer = _Packer(tiers, step_tokens, stream << _STREAM_BITS)
    for doc_id, text in documents:
        ids = encode_text(text or "", vocabulary)
        ids.append(document_end)
        packer.add((doc_id, len(ids)), np.asarray(ids, dtype="<u4"))
        if packer.buffered >= BUFFER_TOKENS:
            packer.drain()
        if len(packer.rows) >= 4096:
            yield from packer.rows
            packer.rows = []
    packer.finish()
    yield from packer.rows


def pack(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS, vocabulary: str = BYTE_BPE, document_end: int = DOCUMENT_END,
) -> DataFrame:
    """Packs every document; one row per piece.

    A document's tokens are its text's ids and the end id, so a null or empty text still has one token; each
    token lies in exactly one piece. Ids may be null or repeated: rows are packed one by one. Texts of any length
    are packed whole. No rows give no pieces. Other columns are not carried, so their names cannot clash.

    A partition is one stream, so which documents share windows depends on how the input is partitioned; that each
    token lies in one piece, and that windows are full, does not.

    Returns id_col, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit integers),
    doc_tokens, sequence_id, offset (of the piece in its sequence), window (the sequence's length) and step_id.
    """
    pieces = cut_lineage(_pieces(documents, id_col, text_col, tiers, step_tokens, vocabulary, document_end))
    stream = F.shiftright("sequence_id", _STREAM_BITS)
    made = pieces.filter("offset = 0").groupBy(stream.alias("stream"), "window").agg(F.count("*").alias("n"))  # a few rows a partition
    before = Window.partitionBy("window").orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)
    first = made.select("stream", "window", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.withColumn("stream", stream).join(first, ["stream", "window"])
    group = F.floor((F.col("first") + F.col("nth")) * F.col("window") / max(step_tokens, max(tiers))).cast("long")
    step = F.shiftleft(F.col("window").cast("long"), _STEP_BITS) + group
    return numbered.select(*[c for c in pieces.columns if c not in ("window", "nth")], "window", step.alias("step_id"))


def _pieces(documents: DataFrame, id_col: str, text_col: str, tiers: tuple[int, ...], step_tokens: int, vocabulary: str, document_end: int) -> DataFrame:
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    source = documents.select(id_col, text_col)
    long = T.LongType()
    schema = T.StructType(
        [T.StructField(id_col, source.schema[0].dataType)]
        + [T.StructField(n, long) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("window", T.IntegerType()), T.StructField("nth", long)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                id_type[:] = [batch.schema.field(0).type]
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())

        def made(found: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type[0], *[pa.int64()] * 6, pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=schema.names)

        held: list[tuple] = []
        for row in pack_stream(
            rows(), TaskContext.get().partitionId(), tiers=tiers, step_tokens=step_tokens, vocabulary=vocabulary, document_end=document_end
        ):
            held.append((*row[:8], row[9]))
            if len(held) == 16_384:
                yield made(held)
                held = []
        if held:
            yield made(held)

    return source.mapInArrow(run, schema)
