"""Near-duplicate groups by SimHash fingerprints, with Golay-code fuzzy keys.

Fingerprints are cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two bits
agree on at least one whole segment, and differ in at most two bits of the next. Padded with zeros to 23 bits,
that next segment is decoded by the perfect binary Golay code, in which each word is within three bits of exactly
one codeword. A segment's keys are the codewords of the words within one bit of it, one to six of them. Segments
at distance two have a word between them that is within one bit of both, so they share its codeword. Key for
joining: which segment agrees, its bits, and a codeword index of the next one.

The third segment differs by two bits at most as well, so its codewords agree in the same way: keys that several
fingerprints share are refined by them, which leaves hardly any chance meetings however many fingerprints there are.

Fingerprints are made distinct first, so exact copies cost nothing. Near copies of one text may put very many of
them under a key, so a key's members are not paired. Two words are within two bits of each other exactly if some
third word, the middle, is within one bit of both. Each member lists the middles around it, and under every key
those with a common middle are linked to the least of them: verified links, in work linear in the key's members.
Components of the links then give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import jaccard
from strandloom.llm.groups import grouped, keep_least
from strandloom.session import cut_lineage

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and length
GOLAY_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint; 0 without words. Fewer words than a shingle make one shingle."""
    words = text.encode().lower().split() if text else None  # bytes: only A-Z and the six ASCII spaces count
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: n - 1]))
    stops = ends[min(shingle_words, len(words)) - 1 :] - 1
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(joined[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):  # bounded, however long the text
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id_col, fp as a signed long) of every row, without a shuffle."""
    source = documents.select(id_col, text_col)
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=schema.names)

    return source.mapInArrow(run, schema)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY_GENERATOR << (bit - 11), 0)
    return rest


def golay_errors() -> np.ndarray:
    """The error pattern of weight three or less for each of the 2048 remainders."""
    bits = 1 << np.arange(23)
    pairs = (bits[:, None] ^ bits[None, :])[np.triu_indices(23, 1)]
    triples = np.unique((pairs[:, None] ^ bits[None, :]).ravel())
    triples = triples[np.bitwise_count(triples) == 3]
    patterns = np.concatenate(([0], bits, pairs, triples))
    table = np.full(2048, -1)
    table[_syndromes(patterns)] = patterns
    return table


def golay_indices(words: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Index, the upper twelve bits, of the codeword nearest each 23-bit word."""
    return (words ^ errors[_syndromes(words)]) >> 11


def codewords(fps: np.ndarray, segment: int, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, codeword index) for all distinct codewords of the words within a bit of its segment."""
    first, length = SEGMENTS[segment]
    words = ((fps >> np.uint64(first)) & np.uint64((1 << length) - 1)).astype(np.int64)
    around = words[:, None] ^ np.concatenate(([0], 1 << np.arange(length)))
    index = np.sort(golay_indices(around, errors), axis=1)
    fresh = np.concatenate((np.ones((len(fps), 1), bool), index[:, 1:] != index[:, :-1]), axis=1)
    row, col = np.nonzero(fresh)
    return row, index[row, col]


def fuzzy_keys(fps: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for all its distinct keys: which segment agrees, its bits, a codeword of the next."""
    where, keys = [], []
    for i, (first, length) in enumerate(SEGMENTS):
        exact = ((fps >> np.uint64(first)) & np.uint64((1 << length) - 1)).astype(np.int64)
        row, index = codewords(fps, (i + 1) % len(SEGMENTS), errors)
        where.append(row)
        keys.append((i << 40) | (exact[row] << 12) | index)
    return np.concatenate(where), np.concatenate(keys)


def third_codewords(fps: np.ndarray, keys: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, codeword index) for the codewords of the segment that a fingerprint's key says nothing of."""
    where, found = [], []
    for i in range(len(SEGMENTS)):
        at = np.flatnonzero(keys >> 40 == i)
        row, index = codewords(fps[at], (i + 2) % len(SEGMENTS), errors)
        where.append(at[row])
        found.append(index)
    return np.concatenate(where), np.concatenate(found)


def _with_keys(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors = golay_errors()
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                found = batch.column(0).slice(i, 8192).to_numpy(zero_copy_only=False)
                row, key = fuzzy_keys(found.view(np.uint64), errors)
                yield pa.RecordBatch.from_arrays([pa.array(found[row]), pa.array(key)], names=["fp", "key"])

    return fps.select("fp").mapInArrow(run, "fp long, key long")


def _refined(keyed: DataFrame) -> DataFrame:
    """(fp, key, third) for each codeword of the segment left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors = golay_errors()
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                fp, key = (batch.column(c).slice(i, 8192).to_numpy(zero_copy_only=False) for c in range(2))
                row, third = third_codewords(fp.view(np.uint64), key, errors)
                yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(key[row]), pa.array(third.astype(np.int32))], names=["fp", "key", "third"])

    return keyed.select("fp", "key").mapInArrow(run, "fp long, key long, third int")


def _shared(keyed: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose key another row has too."""
    return keyed.join(keyed.groupBy(*by).count().filter("count > 1").select(*by), by)


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints fp such that the components are those of all pairs within two bits."""
    shared = _shared(cut_lineage(_with_keys(fps)), ["key"])
    fine = _shared(cut_lineage(_refined(shared)), ["key", "third"])
    # under a key its first segment agrees, so middles differ from a member in the other two alone
    first = F.element_at(F.array(*[F.lit(start) for start, _ in SEGMENTS]), (F.shiftright("key", 40) + 1).cast("int"))
    after = F.element_at(F.array(*[F.lit(start + length) for start, length in SEGMENTS]), (F.shiftright("key", 40) + 1).cast("int"))
    flipped = F.expr("transform(filter(sequence(0, 63), i -> i < first or i >= after), i -> fp ^ shiftleft(1L, i))")
    middles = fine.select("fp", "key", "third", first.alias("first"), after.alias("after")).select("fp", "key", "third", F.explode(F.concat(F.array("fp"), flipped)).alias("middle"))
    least = middles.groupBy("key", "third", "middle").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return middles.join(least, ["key", "third", "middle"]).filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id (the smallest id of the group) of every row.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Rows with a null id take
    part; a group of such rows alone has a null component_id. Repeated rows share a group. Texts of any length
    are hashed whole; no rows give none. Other columns are not carried.
    """
    found = cut_lineage(fingerprints(documents, id_col=id_col, text_col=text_col))
    of_fp = grouped(found, links(found.select("fp").distinct()), id_col)
    named = of_fp.groupBy("group").agg(F.min("least").alias("component_id"))
    by_fp = of_fp.join(named, "group").select("fp", "component_id")
    return found.join(by_fp, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """One row of every group, with all its columns: that with the smallest id, nulls last; repeats of it go too.

    Fingerprints link rows. With `similarity` the sets of their shingles do, at a Jaccard similarity of that or more:
    fingerprints link what they bring within two bits, once verified, and what 64 bits can't tell is found as in jaccard.
    """
    if similarity is not None:
        return jaccard.keep_one(documents, id_col=id_col, text_col=text_col, shingle_words=shingle_words, similarity=similarity, near=links)
    number_of = partial(fingerprint, shingle_words=shingle_words)
    found = cut_lineage(fingerprints(documents, id_col=id_col, text_col=text_col, shingle_words=shingle_words))
    return keep_least(documents, found, links(found.select("fp").distinct()), number_of, id_col=id_col, text_col=text_col)
