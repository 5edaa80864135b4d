"""Near-duplicate groups by the exact Jaccard similarity of word shingles, for SimHash near-dedup at such a similarity.

A document is the set of its distinct shingles, as 64-bit hashes; equal sets are made one first. Fingerprints come
first: sets whose SimHashes the Golay keys bring within two bits are verified and linked. But at a similarity of 0.8
fingerprints of 64 bits differ in ten bits in the middle, and no key of Golay codewords that tolerates ten is telling,
so a prefix filter looks for the rest. In any one order of all shingles, two sets as similar as asked share one of the
first n - ceil(similarity * n) + 1 of each of them, its prefix. The order puts shingles that a sample of documents
shares last, where prefixes hardly reach; the sample bears on the work alone. Chance phrases give most sets a shared
key, so prefixes are longer by a share of ceil(similarity * n): similar sets have as many more of them in common, and
a set with fewer keys that any other has goes no further. Only the whole sets of those that are left travel.

Pairs are not made of the sets that a fingerprint or a key, a shingle in a prefix, brings together. Sets with linked
fingerprints are a group, and each set goes to the groups of its two commonest keys that it shares; groups are cut into
blocks of bounded size. First a block drawn at random meets all blocks of its group, which links nearly all of a crowd
into one component. Then, in groups of several blocks, what still has another label than the commonest meets all blocks;
blocks of one and the same label don't meet. A task counts what two blocks have in common by a product of matrices, and
its links are a forest. At last, keys under which labels differ are gone through for pairs with different labels that no
group has compared; these are verified by their whole sets. So every pair that is similar enough is verified or lies in
one component already: components of the links are the groups. Before that, the parities of how many hashes a set has in
each of SKETCH_BITS bins are compared: two sets differ in as many hashes at least as in parities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.groups import keep_least
from strandloom.operators.components import connected_components
from strandloom.operators.ordering import placed
from strandloom.session import Workspace, drop_unused

SEED = 42
SHINGLE_WORDS = 5
SIMILARITY = 0.8
SAMPLED = 20_000  # documents at most, and
SAMPLED_SHARE = 0.05
LEAST_MARKS, MOST_MARKS = 1 << 22, 1 << 28  # bits
HOT = 100_000  # shingles put last
MORE = Fraction(1, 16)  # of the least a set has in common with a similar one: so many more keys
SLICE = 256
GROUPS_OF_A_SET = 2
BLOCK_COST, LEAST_COST = 1 << 18, 1 << 9  # hashes of a block, and what the smallest set counts as
MATRIX_COLUMNS = 4096
KEY_PARTS = 2  # keys are counted in so many turns, so that their shuffles don't lie on the disk all at once
SKETCH_BITS = 512


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes; none without words. Fewer words than a shingle make one shingle."""
    words = text.encode().lower().split() if text else None  # bytes: only A-Z and the six ASCII spaces count
    if not words:
        return np.array([], np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: max(0, len(words) - shingle_words)]))
    stops = ends[min(shingle_words, len(words)) - 1 :] - 1
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts)).view(np.int64))


def set_number(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit number of a text's set of shingles; equal sets have equal numbers."""
    return xxhash.xxh64_intdigest(shingles(text, shingle_words).tobytes(), SEED)


def needed(n: int, ratio: Fraction, more: Fraction = MORE) -> int:
    """How many keys of a prefix that is longer by needed - 1 a set of n hashes shares with any similar one.

    It rises no faster than the least number of hashes in common does, so this holds for the larger of two sets as well.
    """
    return 1 + -(-n * ratio.numerator // ratio.denominator) * more.numerator // more.denominator


def prefix(hashes: np.ndarray, ratio: Fraction, hot: np.ndarray, ranks: np.ndarray, more: int = 0) -> np.ndarray:
    """The first hashes of a set of which similar sets share one, and `more` after them; `hot` is sorted, and goes last by its ranks."""
    n = len(hashes)
    taken = n - -(-n * ratio.numerator // ratio.denominator) + 1 + more if n else 0
    rank = np.zeros(n, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
        rank = np.where(hot[at] == hashes, ranks[at], 0)
    return hashes[np.lexsort((hashes, rank))[:taken]]


def simhash_of(hashes: np.ndarray) -> int:
    """The unsigned SimHash of a set of hashes: a bit is 1 if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _text_hash(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(text.encode(), SEED) if text else 0


def _signed(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


def _sets(documents: DataFrame, text_col: str, shingle_words: int, marks: np.ndarray | None = None) -> DataFrame:
    """(fp, the set's number; hashes) of every row, or of those whose text may be among the marked."""
    given = None if marks is None else documents.sparkSession.sparkContext.broadcast(marks)

    def wanted(text: str | None) -> bool:
        number = _text_hash(text) % (len(given.value) << 6)
        return bool(given.value[number >> 6] >> (number & 63) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                texts = [t for t in batch.column(0).slice(i, SLICE).to_pylist() if given is None or wanted(t)]
                found = [shingles(t, shingle_words) for t in texts]
                fp = _signed([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found])
                yield pa.RecordBatch.from_arrays([fp, pa.array(found, pa.list_(pa.int64()))], names=["fp", "hashes"])

    return documents.select(text_col).mapInArrow(run, "fp long, hashes array<long>")


def _marks(numbers: DataFrame, column: str) -> np.ndarray:
    """A bit for each number's remainder; some sixteen bits a number, within bounds (32 MB at most)."""
    bits = min(MOST_MARKS, max(LEAST_MARKS, 1 << (16 * numbers.count()).bit_length()))
    word = F.shiftright(F.pmod(column, F.lit(bits)), 6).cast("int")
    table = numbers.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits")).toPandas()
    marks = np.zeros(bits >> 6, np.int64)
    marks[table["word"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64)
    return marks


def shared_shingles(documents: DataFrame, text_col: str, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks from 1 on, commonest last) of the commonest shingles of a sample; HOT at most."""
    sample = documents.sample(min(SAMPLED_SHARE, SAMPLED / max(1, documents.count())), seed=SEED)
    counted = _sets(sample, text_col, shingle_words).select(F.explode("hashes").alias("h")).groupBy("h").count().filter("count > 3")
    common = sorted((r["count"], r["h"]) for r in counted.orderBy(F.desc("count"), "h").limit(HOT).collect())
    hot = np.array([h for _, h in common], np.int64)
    order = np.argsort(hot)
    return hot[order], order + 1


def described(documents: DataFrame, ratio: Fraction, shingle_words: int, *, id_col: str, text_col: str) -> DataFrame:
    """(id_col, fp, text, size, sim, needed, prefix) of every row, without a shuffle: numbers of its set and of its text, and its set's SimHash."""
    source = documents.select(id_col, text_col)
    given = source.sparkSession.sparkContext.broadcast(shared_shingles(documents, text_col, shingle_words))
    fields = [T.StructField(n, T.LongType()) for n in ("fp", "text", "size", "sim", "needed")]
    schema = T.StructType([T.StructField("id", source.schema[0].dataType), *fields, T.StructField("prefix", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                texts = batch.column(1).to_pylist()
                found = [shingles(t, shingle_words) for t in texts]
                columns = [batch.column(0), _signed([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found]), _signed(list(map(_text_hash, texts)))]
                columns += [pa.array(map(len, found), pa.int64()), _signed(list(map(simhash_of, found)))]
                least = [needed(len(h), ratio) for h in found]
                columns += [pa.array(least, pa.int64()), pa.array([prefix(h, ratio, *given.value, n - 1) for h, n in zip(found, least)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def shared_keys(work: Workspace, described_sets: DataFrame) -> DataFrame:
    """(key, fp, n) of the sets that may be similar to another: keys of their prefixes without the further ones, and how many of the sets have each."""
    keyed = described_sets.select("fp", F.posexplode("prefix").alias("place", "key"), (F.size("prefix") - F.col("needed")).alias("last"))
    keyed = keyed.select("key", "fp", (F.col("place") <= F.col("last")).alias("own"))
    parts = []
    for k in range(KEY_PARTS):
        part = keyed.filter(F.pmod("key", F.lit(KEY_PARTS)) == k)
        several = part.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
        parts.append(work.keep(part.join(several, "key", "left_semi")))
        drop_unused(work.spark)
    shared = reduce(DataFrame.union, parts)
    counted = shared.groupBy("fp").agg(F.count("*").alias("_n")).join(described_sets.select("fp", "needed"), "fp")
    likely = shared.filter("own").drop("own").join(counted.filter("_n >= needed").select("fp"), "fp", "left_semi")
    left = work.keep(likely.select("key", "fp"))
    work.drop(*parts)
    drop_unused(work.spark)
    return work.keep(left.join(left.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"))


def _ordered(u: str, v: str) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _labelled(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """rows with fp and the `label` of its component so far."""
    labels = connected_components(linked).withColumnRenamed("node", "fp")
    return rows.join(labels, "fp", "left").withColumn("label", F.coalesce("component", "fp")).drop("component")


def _unsettled(rows: DataFrame) -> DataFrame:
    """Those rows (key, label) under whose key there are several labels, with the key's number of the label's rows."""
    labels = rows.groupBy("key", "label").agg(F.count("*").alias("_same"))
    several = labels.groupBy("key").agg(F.count("*").alias("_labels")).filter("_labels > 1").select("key")
    return rows.join(labels.join(several, "key", "left_semi"), ["key", "label"])


def _verified(pairs: DataFrame, whole: DataFrame, ratio: Fraction) -> DataFrame:
    """Those of the pairs (u, v) whose whole sets (fp, hashes) are as similar as asked."""
    a, b = (whole.select(F.col("fp").alias(end), F.col("hashes").alias(name)) for end, name in (("u", "a"), ("v", "b")))
    both = pairs.join(a, "u").join(b, "v").withColumn("common", F.size(F.array_intersect("a", "b")).cast("long"))
    union = F.size("a") + F.size("b") - F.col("common")
    return both.filter(F.col("common") * ratio.denominator >= union * ratio.numerator).select("u", "v")


def _block_pairs(work: Workspace, rows: DataFrame, order: list[Column], first_only: bool) -> tuple[DataFrame, DataFrame]:
    """rows (key, fp, label, cost, ...) dealt out to pairs of blocks of their key: each with key, a, b and side; and the blocks (key, block).

    With first_only a key's first block meets all; else all meet but those of one and the same label. A row goes to as
    many pairs as its block is in.
    """
    run = placed(work, rows, "key", order, {"_upto": F.col("cost")})
    cut = work.keep(run.withColumn("block", F.expr(f"(_upto - 1) div {BLOCK_COST}")).drop("place", "group_size", "_upto", "_part"))
    drop_unused(work.spark)
    blocks = work.keep(cut.groupBy("key", "block").agg(F.min("label").alias("low"), F.max("label").alias("high")))
    one, two = (blocks.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "low", "high")]) for side in "ab")
    meet = one.join(two, "key").filter("block_a <= block_b")
    meet = meet.filter("block_a = 0") if first_only else meet.filter("not (low_a = high_a and low_b = high_b and low_a = low_b)")
    meet = meet.select("key", F.col("block_a").alias("a"), F.col("block_b").alias("b"))
    sides = [meet.select("key", F.col("a").alias("block"), "a", "b", F.lit(0).alias("side")), meet.filter("a < b").select("key", F.col("b").alias("block"), "a", "b", F.lit(1).alias("side"))]
    return cut.join(sides[0].union(sides[1]), ["key", "block"]).drop("block"), blocks


def _column(column: pa.Array) -> Iterable:
    """A column's values; lists of numbers as views of the batch."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return map(lambda a, b: values[a:b], offsets[:-1], offsets[1:])


def _by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each pair of blocks, from sorted ones."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*map(_column, batch.columns)):
            if row[:3] != key and rows:
                yield rows
                rows = []
            key = row[:3]
            rows.append(dict(zip(batch.schema.names, row)))
    if rows:
        yield rows


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links that connect what those before don't."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    found = []
    for a, b in zip(u.tolist(), v.tolist()):
        if (x := root(a)) != (y := root(b)):
            parent[x] = y
            found.append((a, b))
    return found


def common_counts(sets: list[np.ndarray], split: int) -> np.ndarray:
    """How many hashes each of the first `split` sets shares with each of the others, or of themselves if there are none."""
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    column, of = np.unique(column[shared], return_inverse=True)[1], of[shared]
    n = int(column.max()) + 1 if len(column) else 0
    rest = slice(split, None) if split < len(sets) else slice(None)
    out = np.zeros((split, len(sets) - split if split < len(sets) else split), np.float32)
    ends = np.searchsorted(column, np.arange(0, n + MATRIX_COLUMNS, MATRIX_COLUMNS))
    for k in range(len(ends) - 1):
        some = slice(ends[k], ends[k + 1])
        matrix = np.zeros((len(sets), min(MATRIX_COLUMNS, n - k * MATRIX_COLUMNS)), np.float32)
        matrix[of[some], column[some] - k * MATRIX_COLUMNS] = 1
        out += matrix[:split] @ matrix[rest].T
    return out.astype(np.int64)


def _compared(dealt: DataFrame, ratio: Fraction) -> DataFrame:
    """Links (u, v) between sets of different labels of each pair of blocks; dealt has key, a, b, side, fp, label, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_pair(batches):
            split = sum(r["side"] == 0 for r in rows)
            fps, labels, sizes = (np.array([x(r) for r in rows]) for x in (lambda r: r["fp"], lambda r: r["label"], lambda r: len(r["hashes"])))
            rest = slice(split, None) if split < len(rows) else slice(None)
            common = common_counts([r["hashes"] for r in rows], split)
            union = sizes[:split, None] + sizes[None, rest] - common
            x, y = np.nonzero((common * ratio.denominator >= union * ratio.numerator) & (labels[:split, None] != labels[None, rest]))
            found = _forest(fps[:split][x], fps[rest][y])
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    source = dealt.select("key", "a", "b", "side", "fp", "label", "hashes").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side")
    return source.mapInArrow(run, "u long, v long").select(*_ordered("u", "v"))


def sketch(hashes: np.ndarray) -> bytes:
    """The parities of the numbers of hashes in SKETCH_BITS bins."""
    return np.packbits(np.bincount(hashes & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1).tobytes()


def _sketches(whole: DataFrame) -> DataFrame:
    """(fp, sketch) of whole sets (fp, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(sketch, _column(batch.column(1))), pa.binary())], names=["fp", "sketch"])

    return whole.select("fp", "hashes").mapInArrow(run, "fp long, sketch binary")


def _uncompared(dealt: DataFrame, ratio: Fraction) -> DataFrame:
    """Distinct pairs (u, v) of sets of different labels that no group has in common and whose sketches allow for so similar ones.

    dealt has key, a, b, side, fp, label, size, groups, sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_pair(batches):
            split = sum(r["side"] == 0 for r in rows)
            rest = slice(split, None) if split < len(rows) else slice(None)
            fps, labels, sizes = (np.array([r[c] for r in rows]) for c in ("fp", "label", "size"))
            groups = np.array([(list(r["groups"]) * GROUPS_OF_A_SET)[:GROUPS_OF_A_SET] for r in rows])
            parities = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint64).reshape(len(rows), -1)
            for i in range(split):
                wanted = (labels[rest] != labels[i]) & (np.maximum(sizes[rest], sizes[i]) * ratio.numerator <= np.minimum(sizes[rest], sizes[i]) * ratio.denominator)
                wanted &= ~(groups[rest][:, :, None] == groups[i][None, None, :]).any(axis=(1, 2))
                at = np.flatnonzero(wanted)
                differing = np.bitwise_count(parities[rest][at] ^ parities[i]).sum(axis=1, dtype=np.int64)
                most = (sizes[rest][at] + sizes[i]) * (ratio.denominator - ratio.numerator)
                other = fps[rest][at[differing * (ratio.denominator + ratio.numerator) <= most]]
                if len(other):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), fps[i])), pa.array(other)], names=["u", "v"])

    source = dealt.select("key", "a", "b", "side", "fp", "label", "size", "groups", "sketch").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side")
    return source.mapInArrow(run, "u long, v long").select(*_ordered("u", "v")).distinct()


def _near_groups(sets: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, fp): groups of sets that share a SimHash or whose SimHashes `near` links; each set in the least linked one, which is in it too."""
    linked = near(sets.select(F.col("sim").alias("fp")).distinct()).groupBy(F.col("u").alias("sim")).agg(F.min("v").alias("least"))
    own = sets.select("sim", "fp").join(linked, "sim", "left").select(F.coalesce("least", "sim").alias("key"), "fp")
    led = linked.select(F.col("least").alias("sim")).distinct().join(sets, "sim").groupBy(F.col("sim").alias("key")).agg(F.min("fp").alias("fp"))
    return own.union(led).distinct()


def links(
    work: Workspace, found: DataFrame, documents: DataFrame, ratio: Fraction, shingle_words: int = SHINGLE_WORDS, *, text_col: str = "text",
    near: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Links (u, v) between distinct sets such that the components are those of all pairs as similar as asked.

    found is what described() gives, as a table of `work`; it is removed once it is read.
    """
    spark = documents.sparkSession
    firsts = [F.first(c).alias(c) for c in ("size", "sim", "needed", "prefix")]
    described_sets = work.keep(found.filter("size > 0").groupBy("fp").agg(F.min("text").alias("text"), *firsts))
    work.drop(found)
    drop_unused(spark)
    shared = shared_keys(work, described_sets)
    sets = work.keep(described_sets.drop("prefix", "needed").join(shared.select("fp").distinct(), "fp", "left_semi"))
    work.drop(described_sets)
    drop_unused(spark)
    sizes = sets.select("fp", "size")
    commonest = Window.partitionBy("fp").orderBy(F.desc("n"), "key")  # a set's own keys
    members = shared.withColumn("_rank", F.row_number().over(commonest)).filter(f"_rank <= {GROUPS_OF_A_SET}").select("key", "fp")
    members = work.keep(members.join(sizes, "fp"))
    linked = spark.createDataFrame([], "u long, v long")
    groups = [] if near is None else [work.keep(_near_groups(sets, near).join(sizes, "fp"))]
    several = [g.join(g.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi") for g in groups]
    ends = work.keep(reduce(DataFrame.union, [g.select("fp") for g in (*several, members)]).distinct())
    marks = _marks(sets.join(ends, "fp", "left_semi"), "text")  # one text says what the set is
    whole = work.keep(_sets(documents, text_col, shingle_words, marks).join(ends, "fp", "left_semi").dropDuplicates(["fp"]))
    work.drop(ends)
    drop_unused(spark)

    cost = F.greatest("size", F.lit(LEAST_COST))
    at_random, by_label = [F.xxhash64("fp", "key"), F.asc("fp")], [F.desc("_same"), F.asc("label"), F.asc("fp")]
    for group in (*groups, members):
        rows = work.keep(_unsettled(_labelled(group, linked)).withColumn("cost", cost))
        dealt, blocks = _block_pairs(work, rows, at_random, True)
        linked = work.keep(linked.union(_compared(dealt.join(whole, "fp"), ratio)))
        drop_unused(spark)
    large = blocks.filter("block = 1").select("key")  # of one block, all have met
    if not large.isEmpty():
        rows = work.keep(_unsettled(_labelled(members.join(large, "key", "left_semi"), linked)).withColumn("cost", cost))
        linked = work.keep(linked.union(_compared(_block_pairs(work, rows, by_label, False)[0].join(whole, "fp"), ratio)))
        drop_unused(spark)
    rows = work.keep(_unsettled(_labelled(shared.select("key", "fp"), linked)).join(sizes, "fp").withColumn("cost", F.lit(LEAST_COST >> 3).cast("long")))
    if rows.isEmpty():
        return linked
    groups_of = members.groupBy("fp").agg(F.collect_list("key").alias("groups"))  # two at most
    told = work.keep(groups_of.join(_sketches(whole), "fp"))
    drop_unused(spark)
    rest = work.keep(_uncompared(_block_pairs(work, rows, by_label, False)[0].join(told, "fp"), ratio))
    drop_unused(spark)
    return work.keep(linked.union(_verified(rest, whole, ratio)))


def keep_one(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY,
    near: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row of every group, with all its columns: that with the smallest id, nulls last; repeats of it go too.

    Rows are linked if their shingles' Jaccard similarity is `similarity` or more. Null, empty and wordless texts
    are one group. Texts of any length are taken whole; no rows give none. `near` links SimHashes, see simhash.links.
    The result reads a few tables of ids in the shared folder, and the documents.
    """
    ratio = Fraction(str(similarity))
    if not 0 < ratio < 1:
        raise ValueError("the similarity must lie between 0 and 1")
    work = Workspace(documents.sparkSession, "jaccard")
    found = work.keep(described(documents, ratio, shingle_words, id_col=id_col, text_col=text_col))
    numbers = work.keep(found.select(F.col("id").alias(id_col), "fp"))
    linked = links(work, found, documents, ratio, shingle_words, text_col=text_col, near=near)
    work.drop_all_but(numbers, linked)
    drop_unused(work.spark)
    return keep_least(documents, numbers, linked, partial(set_number, shingle_words=shingle_words), id_col=id_col, text_col=text_col)
