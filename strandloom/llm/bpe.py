"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

A byte-level BPE splits text into words before it merges anything, so a word's ids never depend on its neighbours
and it is enough to encode each distinct word once:

1. Each input partition is cut into chunks of whole documents. A chunk is known by a hash of its content, numbers
   its distinct words in sorted order, and gives rows (word, chunk, number).
2. These are dealt out by word and sorted, so equal words meet and each is encoded once; the ids go back to every
   chunk that has the word, by its number there.
3. A chunk's documents, as sequences of word numbers, meet the ids of its words, which take the words' places.

Decoding goes block by block of some hundred rows: the distinct ids of a block are joined with the vocabulary's pieces,
and the pieces are put in the places of the ids. The pieces are as many as the vocabulary has, whatever the corpus, so
they are broadcast, and nothing is shuffled: a block's rows, its ids as they stand and then one for each distinct id,
keep their order through such a join. Their number is checked; a gap is an error, never a wrong text.

No table of all words is ever broadcast or held by one task.
Steps 1 and 3 both read the input; they agree on a chunk because its key is its content. Input whose rows come
in another order on each reading (for instance from an unsorted shuffle) should be written or checkpointed first;
otherwise the words of a chunk are missing, which raises an error and never gives wrong ids.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.vocabulary import BYTE_BPE, END_OF_TEXT, END_OF_TEXT_ID, encode_text, ranks, tokenizer

CHUNK_BYTES = 32 << 20
MAX_PIECES = 1 << 20
BLOCK_ROWS = 1024
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
_WORD = regex.compile(public_tokenizers.PATTERN)
_SPECIAL = re.compile(f"({re.escape(END_OF_TEXT)})")


def split_words(text: str) -> list[str]:
    """The words that the vocabulary's BPE encodes one by one; the end-of-text string is a word of its own."""
    if END_OF_TEXT not in text:
        return _WORD.findall(text)
    out: list[str] = []
    for part in _SPECIAL.split(text):
        out += [part] if part == END_OF_TEXT else _WORD.findall(part)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables (id, text) of about `limit` bytes of text; a longer document is a chunk of its own or ends one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for i in range(0, whole.num_rows, 64):
            part = whole.slice(i, 64)
            held.append(part)
            size += sum(len(x) for x in part.column(1).to_pylist() if x)
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _key(chunk: pa.Table) -> int:
    """A 63-bit hash of the chunk's ids and texts in order."""
    digest = xxhash.xxh3_64(seed=7)
    for name in chunk.column_names:
        for x in _values(chunk.column(name)):
            raw = b"\x00" if x is None else b"\x01" + str(x).encode()
            digest.update(len(raw).to_bytes(8, "little") + raw)
    return digest.intdigest() >> 1


def _values(column: pa.ChunkedArray) -> Iterator:
    """A column's values, of which a few hundred are Python objects at a time."""
    for i in range(0, len(column), 256):
        yield from column.slice(i, 256).to_pylist()


def _word_numbers(chunk: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """How many distinct words the chunk has, how many words each document, and all words as numbers among the sorted distinct ones."""
    seen: dict[str, int] = {}  # in the order in which they come
    places, sizes = array("i"), []
    for text in _values(chunk.column("text")):
        before = len(places)
        if text:
            places.extend([seen.setdefault(w, len(seen)) for w in split_words(text)])
        sizes.append(len(places) - before)
    number = np.empty(len(seen), np.int32)
    number[np.fromiter(map(seen.__getitem__, sorted(seen)), np.int64, len(seen))] = np.arange(len(seen), dtype=np.int32)
    return len(seen), np.array(sizes, np.int32), number[np.frombuffer(places, np.int32)] if places else np.empty(0, np.int32)


def _give_back() -> None:
    """Returns freed memory to the system: a worker holds a chunk at a time, and several workers share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed: the upper planes hold next to nothing."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T), "zstd", asbytes=True)


def _unpack_numbers(packed: bytes, total: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * total, "zstd"), np.uint8).reshape(4, total)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _encoded(
    documents: DataFrame, id_col: str, text_col: str, vocabulary: str, chunk_bytes: int, schema: T.StructType, make: Callable[[pa.Array, pa.ListArray], list[pa.Table]]
) -> DataFrame:
    """Rows that `make` builds from the ids and tokens of some hundred documents at a time."""
    source = documents.select(F.col(id_col), F.col(text_col))
    names = ["id", "text"]
    id_kind = source.schema[0].dataType
    id_type = np.dtype("<u2" if tokenizer(vocabulary).get_vocab_size() <= 1 << 16 else "<u4")
    kind = "H" if id_type.itemsize == 2 else "I"
    rows = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_kind)), T.StructField("sizes", T.ArrayType(T.IntegerType()))])
    rows = T.StructType([*rows, T.StructField("words", T.IntegerType()), T.StructField("numbers", T.BinaryType())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        return _chunks((b.rename_columns(names) for b in batches), chunk_bytes)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            distinct: set[str] = set()
            for text in _values(chunk.column("text")):
                if text:
                    distinct.update(split_words(text))
            key, ordered = _key(chunk), sorted(distinct)
            del distinct
            for i in range(0, len(ordered), 50_000):  # sorted words and their numbers compress well on the way
                part = ordered[i : i + 50_000]
                columns = [pa.array(part, pa.string()), pa.array(np.full(len(part), key)), pa.array(np.arange(i, i + len(part), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "chunk", "number"])
            del chunk, ordered
            _give_back()

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, bytes] | None = None  # a word's rows may go on in the next batch
        for batch in batches:
            words = batch.column(0).to_pylist()
            fresh = [w for i, w in enumerate(words) if (w != words[i - 1] if i else last is None or w != last[0])]
            ids_of = {w: array(kind, encode_text(w, vocabulary)).tobytes() for w in fresh}
            if last is not None:
                ids_of.setdefault(*last)
            ids = [ids_of[w] for w in words]
            if words:
                last = (words[-1], ids[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.binary())], names=["chunk", "number", "word_ids"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            key, doc_ids = _key(chunk), chunk.column("id").combine_chunks()
            words, sizes, flat = _word_numbers(chunk)
            del chunk
            one = pa.array([0, len(doc_ids)], pa.int32())
            columns = [pa.array([key]), pa.ListArray.from_arrays(one, doc_ids), pa.ListArray.from_arrays(one, pa.array(sizes))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([words], pa.int32()), pa.array([_pack_numbers(flat)], pa.binary())], names=rows.names)
            del flat, columns, doc_ids
            _give_back()

    def place(docs: pa.Table, words: pa.Table) -> pa.Table:
        numbers = words.column("number").to_numpy()
        given = words.column("word_ids").combine_chunks()
        bounds = np.frombuffer(given.buffers()[1], "<i4")[given.offset : given.offset + len(given) + 1].astype(np.int64) // id_type.itemsize if len(given) else np.zeros(1, np.int64)
        flat = np.frombuffer(given.buffers()[2] or b"", id_type) if len(given) else np.empty(0, id_type)
        size = docs.column("words")[0].as_py() if docs.num_rows else 0
        start, length = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        if len(numbers) and numbers.max() < size:
            start[numbers], length[numbers] = bounds[:-1], np.diff(bounds)
        if not docs.num_rows or (length < 0).any():
            raise RuntimeError("the input changed between two readings; checkpoint it before encoding")
        made = []
        for row in range(docs.num_rows):  # chunks of equal content share a key and their words
            sizes = docs.column("sizes")[row].values.to_numpy()
            doc_ids = docs.column("ids")[row].values
            at = _unpack_numbers(docs.column("numbers")[row].as_py(), int(sizes.sum()))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            for i in range(0, len(sizes), BLOCK_ROWS):
                inside = at[ends[i] : ends[min(i + BLOCK_ROWS, len(sizes))]]
                lengths = length[inside]
                before = np.concatenate(([0], np.cumsum(lengths)))
                ids = flat[np.repeat(start[inside] - before[:-1], lengths) + np.arange(before[-1])].astype(np.int32)
                offsets = before[ends[i : i + BLOCK_ROWS + 1] - ends[i]].astype(np.int32)
                made += make(doc_ids.slice(i, BLOCK_ROWS), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))
        _give_back()
        return pa.concat_tables(made)

    parts = 2 * max(source.rdd.getNumPartitions(), source.sparkSession.sparkContext.defaultParallelism)  # chunks lie apart
    dealt = source.mapInArrow(words_of, "word string, chunk long, number int").repartition("word").sortWithinPartitions("word")
    ids = dealt.mapInArrow(encode_words, "chunk long, number int, word_ids binary").repartition(parts, "chunk")
    docs = source.mapInArrow(numbered, rows).repartition(parts, "chunk")
    return docs.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(place, schema)


def encode(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id_col and ids (array of int) of every row's whole text, as tokenizers gives them with add_special_tokens=False.

    A null or empty text has no ids. Null and repeated ids are rows like others. No rows give none. Memory in a
    task is bounded by the chunk, or one document if that is longer. Other columns are not carried.
    """
    schema = T.StructType([T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    make = lambda ids, tokens: [pa.Table.from_arrays([ids, tokens], names=[id_col, "ids"])]
    return _encoded(documents, id_col, text_col, vocabulary, chunk_bytes, schema, make)


def pieces(spark: SparkSession, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(id, piece) of the whole vocabulary, special tokens included."""
    rows = [(i, bytearray(p)) for p, i in ranks(vocabulary).items()] + [(END_OF_TEXT_ID, bytearray(END_OF_TEXT.encode()))]
    return spark.createDataFrame(rows, "id int, piece binary")


def _lines_schema(id_kind: T.DataType) -> T.StructType:
    """By block a line with its rows' ids, their numbers of tokens, all tokens, and how many lines follow: one for each distinct token."""
    fields = [T.StructField("ids", T.ArrayType(id_kind)), T.StructField("sizes", T.ArrayType(T.IntegerType()))]
    return T.StructType([*fields, T.StructField("flat", T.BinaryType()), T.StructField("kinds", T.IntegerType()), T.StructField("token", T.IntegerType())])


def _block_lines(ids: pa.Array, tokens: pa.ListArray) -> list[pa.Table]:
    """The lines of a block."""
    flat = tokens.flatten().to_numpy(zero_copy_only=False).astype("<i4")
    kinds = np.flatnonzero(np.bincount(flat)) if len(flat) else flat
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int32())
    one = pa.array([0, len(ids)], pa.int32())
    head = [pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, sizes), pa.array([flat.tobytes()], pa.binary()), pa.array([len(kinds)], pa.int32()), pa.nulls(1, pa.int32())]
    follow = [pa.nulls(len(kinds), x.type) for x in head[:4]] + [pa.array(kinds, pa.int32())]
    names = ["ids", "sizes", "flat", "kinds", "token"]
    return [pa.Table.from_arrays(head, names=names), pa.Table.from_arrays(follow, names=names)]


def _lines(encoded: DataFrame, id_col: str, ids_col: str) -> DataFrame:
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                for table in _block_lines(batch.column(0).slice(i, BLOCK_ROWS), batch.column(1).slice(i, BLOCK_ROWS)):
                    yield from table.to_batches()

    return rows.mapInArrow(blocks, _lines_schema(rows.schema[0].dataType))


def _with_pieces(lines: DataFrame, id_to_piece: DataFrame) -> DataFrame:
    """Lines with the piece of each token."""
    if id_to_piece.count() > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    table = id_to_piece.select(F.col("id").cast("int").alias("token"), "piece")
    joined = lines.join(F.broadcast(table), "token", "left")  # as long as a vocabulary, see above
    return joined.select("ids", "sizes", "flat", "kinds", "token", "piece")


def _regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, bytes]]]]:
    """Ids of rows, and for each its tokens and the bytes of their pieces, from lines of _with_pieces()."""
    head: tuple | None = None  # ids, sizes, tokens and the number of lines that follow
    piece_of: dict[int, bytes] = {}
    for batch in batches:
        kinds = batch.column(3).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False)).tolist()
        for first, end in zip([0, *heads], [*heads, batch.num_rows]):
            if first in heads and end > first:
                head = (batch.column(0)[first].values, batch.column(1)[first].values.to_numpy(), np.frombuffer(batch.column(2)[first].as_py(), "<i4"), int(kinds[first]))
                piece_of, first = {}, first + 1
            if end > first:
                piece_of.update(zip(batch.column(4).slice(first, end - first).to_pylist(), batch.column(5).slice(first, end - first).to_pylist()))
            if head is not None and len(piece_of) == head[3]:
                ids, sizes, flat, _ = head
                if None in piece_of.values():
                    raise ValueError("an id has no piece")
                ends = np.cumsum(sizes)
                raw = [b"".join([piece_of[t] for t in flat[e - n : e].tolist()]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield ids, list(zip(np.split(flat, ends[:-1]), raw))
                head = None
            elif head is not None and end < batch.num_rows:
                raise RuntimeError("lines of a block are missing")
    if head is not None:
        raise RuntimeError("lines of a block are missing")


def decode(encoded: DataFrame, id_to_piece: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text of every row: its ids joined with their pieces, in order; bytes that are no UTF-8 become U+FFFD.

    Null ids give an empty text; an id beyond the vocabulary is an error.
    """
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _regrouped(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([raw.decode("utf-8", "replace") for _, raw in found], pa.string())], names=schema.names)

    return _with_pieces(_lines(encoded, id_col, ids_col), id_to_piece).mapInArrow(run, schema)


def digest(encoded: DataFrame, id_to_piece: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, n_tokens, and the SHA-256 of the ids as little-endian unsigned 32-bit integers and of the text that decode() gives."""
    return _digested(_lines(encoded, id_col, ids_col), id_to_piece, encoded.schema[id_col])


def _digested(lines: DataFrame, id_to_piece: DataFrame, id_field: T.StructField) -> DataFrame:
    schema = T.StructType([
        T.StructField(id_field.name, id_field.dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for ids, found in _regrouped(batches):
            columns = [ids, pa.array([len(t) for t, _ in found], pa.int64()), pa.array([sha(t.astype("<u4").tobytes()) for t, _ in found], pa.string())]
            columns.append(pa.array([sha(raw.decode("utf-8", "replace").encode()) for _, raw in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _with_pieces(lines, id_to_piece).mapInArrow(run, schema)


def round_trip(
    documents: DataFrame, id_to_piece: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Digests of encode() and decode() of its ids: id_col, n_tokens, ids_sha256 and decoded_sha256; null and empty texts have no tokens.

    As digest() of encode(), whose tasks here make the lines that are joined.
    """
    field = documents.schema[id_col]
    lines = _encoded(documents, id_col, text_col, vocabulary, chunk_bytes, _lines_schema(field.dataType), _block_lines)
    return _digested(lines, id_to_piece, field)
