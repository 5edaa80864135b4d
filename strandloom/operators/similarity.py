"""All-on-all and query-against-database similarity joins by local-alignment score."""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.alignment import GAP, batch_scores, sw_align
from strandloom.functions.alphabet import Scores, encode, matrix32
from strandloom.session import cut_lineage, path_exists

LINKS = "query_seq long, target_seq long, score int"
BLOCK_RESIDUES = 200_000
MAX_QUERIES = 10_000


def _bucket(size: Column) -> Column:
    """Sequences of a bucket differ in length by a factor of the square root of two at most."""
    return F.ceil(F.log2(F.greatest(size, F.lit(1))) * 2).cast("int")


def padding_waste(sequences: DataFrame, seq_col: str = "sequence") -> DataFrame:
    """(bucket, n, residues, padded, waste): residues by bucket of like length, as they are and padded to the longest, and the share in percent that is padding."""
    size = F.length(F.coalesce(F.col(seq_col), F.lit("")))
    found = sequences.groupBy(_bucket(size).alias("bucket")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("residues"), F.max(size).alias("longest"))
    padded = (F.col("n") * F.col("longest")).cast("long")
    return found.select("bucket", "n", "residues", padded.alias("padded"), F.when(padded > 0, 100.0 * (padded - F.col("residues")) / padded).otherwise(0.0).alias("waste"))


def _blocked(sequences: DataFrame, id_col: str, seq_col: str, block_residues: int) -> tuple[DataFrame, int]:
    """(id, seq, block) and the number of blocks: sequences of like length, about block_residues in each block."""
    rows = sequences.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(seq_col), F.lit("")).alias("seq")).filter("id is not null")
    rows = rows.withColumn("size", F.length("seq")).withColumn("bucket", _bucket(F.col("size")))
    sizes = sorted(rows.groupBy("bucket").agg(F.sum("size").alias("n")).collect())  # some sixty rows at most
    first, parts, at = [], [], 0
    for r in sizes:
        n = max(1, -(-(r["n"] or 0) // block_residues))
        first += [F.lit(r["bucket"]), F.lit(at)]
        parts += [F.lit(r["bucket"]), F.lit(n)]
        at += n
    if not at:
        return rows.select("id", "seq", F.lit(0).alias("block")), 0
    block = F.create_map(*first)[F.col("bucket")] + F.pmod(F.xxhash64("id"), F.create_map(*parts)[F.col("bucket")]).cast("int")
    return rows.select("id", "seq", block.alias("block")), at


PACKED = "block int, ids binary, sizes binary, residues binary"


def _packed(rows: DataFrame) -> DataFrame:
    """Each block as one row of bytes - ids, lengths and residue codes - written so that it is made once."""

    def pack(table: pa.Table) -> pa.Table:
        found = [encode(s) for s in table.column("seq").to_pylist()]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        packed = [table.column("id").to_numpy().tobytes(), sizes.tobytes(), b"".join(f.tobytes() for f in found)]
        return pa.table({"block": table.column("block")[:1], **{n: pa.array([x], pa.binary()) for n, x in zip(("ids", "sizes", "residues"), packed)}})

    return cut_lineage(rows.groupBy("block").applyInArrow(pack, PACKED))


def _unpacked(block: pa.Table, names: tuple[str, str, str]) -> tuple[np.ndarray, list[np.ndarray]]:
    ids, sizes, residues = (block.column(n)[0].as_py() for n in names)
    ends = np.cumsum(np.frombuffer(sizes, np.int32))
    return np.frombuffer(ids, np.int64), np.split(np.frombuffer(residues, np.uint8), ends[:-1])


def _block_links(low: pa.Table, high: pa.Table, matrix: np.ndarray, gap: int, threshold: int, include_self: bool) -> pa.Table:
    """Links between the sequences of two blocks; within one block each pair counts once."""
    same = low.column("low")[0].as_py() == low.column("high")[0].as_py()
    query_ids, queries = _unpacked(low, ("ids", "sizes", "residues"))
    ids, targets = _unpacked(high, ("target_ids", "target_sizes", "target_residues"))
    worth = matrix.max(axis=1).clip(0)
    most = np.array([worth[t].sum() for t in targets])
    found: list[np.ndarray] = []
    for query, residues in zip(query_ids.tolist(), queries):
        wanted = np.minimum(most, worth[residues].sum()) >= threshold
        if same:
            wanted &= ids >= query if include_self else ids > query
        at = np.flatnonzero(wanted)
        scores = batch_scores(residues, [targets[i] for i in at], matrix, gap)
        hit = scores >= threshold
        others = ids[at[hit]]
        found.append(np.column_stack((np.minimum(others, query), np.maximum(others, query), scores[hit])))
    links = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return pa.table({"query_seq": links[:, 0].astype(np.int64), "target_seq": links[:, 1].astype(np.int64), "score": links[:, 2].astype(np.int32)})


def _met(blocks: DataFrame, pairs: DataFrame, weights: str | Scores, gap: int, threshold: int, include_self: bool) -> DataFrame:
    """Links of the given pairs of blocks (low, high); a task holds the two packed rows of a pair."""
    matrix = matrix32(weights)
    left = blocks.withColumnRenamed("block", "low").join(pairs, "low")
    # names of their own: columns that both sides of a cogroup share are lost when the links are joined with the sequences again
    right = blocks.select(F.col("block").alias("high"), *[F.col(c).alias(f"target_{c}") for c in ("ids", "sizes", "residues")]).join(pairs, "high")
    right = right.withColumnsRenamed({"low": "low_block", "high": "high_block"})

    def meet(low: pa.Table, high: pa.Table) -> pa.Table:
        return _block_links(low, high, matrix, gap, threshold, include_self)

    return left.groupBy("low", "high").cogroup(right.groupBy("low_block", "high_block")).applyInArrow(meet, LINKS)


def _block_pairs(blocks: DataFrame, count: int, wanted: Column | None = None) -> DataFrame:
    pairs = blocks.select(F.col("block").alias("low"), F.explode(F.sequence(F.col("block"), F.lit(count - 1))).alias("high"))
    return pairs if wanted is None else pairs.filter(wanted)


def similarity_join(
    sequences: DataFrame, threshold: int, *, id_col: str = "seq_no", seq_col: str = "sequence", weights: str | Scores = "PAM250", gap: int = GAP,
    include_self: bool = True, block_residues: int = BLOCK_RESIDUES,
) -> DataFrame:
    """Links (query_seq, target_seq, score) of every pair target >= query that scores at least the threshold.

    Sequences of like length form blocks, each packed into one row; each pair of blocks is one group, so work is dealt
    out by residues and no pair is seen twice. What travels is two packed blocks for work that takes their product.
    Scores stay in the kernel until they pass the threshold. A pair whose residues' best scores cannot add up to it
    is skipped, which loses nothing. Null sequences are empty and score 0.
    """
    rows, count = _blocked(sequences, id_col, seq_col, block_residues)
    if not count:
        return rows.sparkSession.createDataFrame([], LINKS)
    blocks = _packed(rows)
    return _met(blocks, _block_pairs(blocks, count), weights, gap, threshold, include_self)


def resumable_join(
    sequences: DataFrame, threshold: int, folder: str, *, waves: int = 16, stop_after: int | None = None, id_col: str = "seq_no", seq_col: str = "sequence",
    weights: str | Scores = "PAM250", gap: int = GAP, include_self: bool = True, block_residues: int = BLOCK_RESIDUES,
) -> DataFrame:
    """The links of similarity_join(), by way of a folder that keeps what is done.

    Pairs of blocks are done in waves, each written to a folder of its own. A run that stops - here after
    `stop_after` new waves - is taken up by calling again with the same sequences and parameters: waves that are
    written whole are not done again, one that was cut off is done anew and takes its own place. Returns the links so far.

    The folder records the parameters and a fingerprint of the sequences (their number and a sum of their hashes), and
    holds the packed blocks: a call with others is an error, and blocks are read again rather than packed again.
    """
    spark = sequences.sparkSession
    hashes = F.sum(F.xxhash64(F.col(id_col), F.coalesce(F.col(seq_col), F.lit(""))).cast("decimal(20,0)")).cast("string")
    sums = sequences.agg(F.count("*").alias("n"), hashes.alias("hashes")).first()
    run = {"threshold": threshold, "waves": waves, "gap": gap, "include_self": include_self, "block_residues": block_residues, "matrix": crc32(matrix32(weights).tobytes()), "sequences": [sums["n"], sums["hashes"]]}
    if path_exists(spark, f"{folder}/manifest/_SUCCESS"):
        recorded = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
        count = recorded.pop("blocks")
        if differing := sorted(name for name in run if run[name] != recorded.get(name)):
            raise ValueError(f"{folder} is of a run with other {', '.join(differing)}")
    else:
        rows, count = _blocked(sequences, id_col, seq_col, block_residues)
        if count:
            _packed(rows).write.mode("overwrite").parquet(f"{folder}/blocks")
        spark.createDataFrame([(json.dumps(run | {"blocks": count}),)], "said string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    if not count:
        return spark.createDataFrame([], LINKS)
    left = [w for w in range(waves) if not path_exists(spark, f"{folder}/wave={w}/_SUCCESS")]
    if left:
        blocks = spark.read.parquet(f"{folder}/blocks")
        for wave in left[:stop_after]:
            pairs = _block_pairs(blocks, count, F.pmod(F.xxhash64("low", "high"), F.lit(waves)) == wave)
            _met(blocks, pairs, weights, gap, threshold, include_self).write.mode("overwrite").parquet(f"{folder}/wave={wave}")
    return spark.read.schema(LINKS).parquet(*[f"{folder}/wave={w}" for w in range(waves) if w not in left or w in left[:stop_after]])


def query_against(
    queries: DataFrame, database: DataFrame, threshold: int, *, id_col: str = "seq_no", seq_col: str = "sequence", weights: str | Scores = "PAM250", gap: int = GAP
) -> DataFrame:
    """Links of a few queries with every sequence of a database; the queries, at most MAX_QUERIES, go to its partitions."""
    matrix = matrix32(weights)
    few = queries.select(F.col(id_col).cast("long"), F.coalesce(F.col(seq_col), F.lit(""))).limit(MAX_QUERIES + 1).collect()
    if len(few) > MAX_QUERIES:
        raise ValueError("too many queries to send to each partition: use similarity_join")
    given = [(q, encode(s)) for q, s in few]
    most = np.maximum(matrix.max(axis=1), 0).astype(np.int64)  # what a residue can add at best
    reach = [int(most[r].sum()) for _, r in given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            targets = [encode(s) for s in batch.column(1).to_pylist()]
            bound = np.array([most[t].sum() for t in targets])
            for (query, residues), highest in zip(given, reach):
                if highest < threshold:
                    continue  # it can't reach the threshold with any
                able = np.flatnonzero(bound >= threshold)
                scores = np.zeros(len(targets), np.int32)
                scores[able] = batch_scores(residues, [targets[i] for i in able], matrix, gap)
                hit = scores >= threshold
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), query, np.int64)), pa.array(ids[hit]), pa.array(scores[hit])], names=["query_seq", "target_seq", "score"])

    rows = database.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(seq_col), F.lit("")).alias("seq")).filter("id is not null")
    return rows.mapInArrow(run, LINKS)


def compared(
    pairs: DataFrame, sequences: DataFrame, *, a_col: str = "id_a", b_col: str = "id_b", id_col: str = "id", seq_col: str = "sequence", weights: str | Scores = "PAM250", gap: int = GAP
) -> DataFrame:
    """a_col, b_col and the alignment's fields of the sequences with these ids, for each pair that has both.

    Nothing aligned leaves the fields null. A sequence that many pairs have does not go to one task: pairs are dealt
    out anew before they are aligned.
    """
    side = lambda end, name: sequences.select(F.col(id_col).alias(end), F.col(seq_col).alias(name))
    both = pairs.select(a_col, b_col).join(side(a_col, "_a"), a_col).join(side(b_col, "_b"), b_col)
    return both.repartition(a_col, b_col).withColumn("_x", sw_align(weights, gap)("_a", "_b")).select(a_col, b_col, "_x.*")


def with_names(links: DataFrame, sequences: DataFrame, *, id_col: str = "seq_no", name_col: str = "name") -> DataFrame:
    """Links with name1 and name2 of both ends; ends without a record keep null names."""
    named = lambda end, name: sequences.select(F.col(id_col).alias(end), F.col(name_col).alias(name))
    return links.join(named("query_seq", "name1"), "query_seq", "left").join(named("target_seq", "name2"), "target_seq", "left")
