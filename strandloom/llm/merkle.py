"""Merkle manifest of a dataset with incremental witnesses.

A tree has its leaves in order; every 16 consecutive nodes, the last ones fewer, become the digest of their joined
hex digests until one node is left. There is a tree for each source, and one over their roots.

A leaf's witness lists, level by level, the other nodes of its run. Nodes are appended one after the other: open runs
keep, besides their nodes, the leaves below that still wait for siblings, with the partial witnesses they have. The
node that completes a run extends the witnesses of all leaves under it, and the run's digest is appended to the level
above. A task appends the nodes of aligned blocks, 256 nodes or two levels each, and holds one block at a time. Roots
of blocks are the leaves of further appends, dealt out in blocks in the same way, and so on up to the root; then
witnesses go down again: those of the leaves of a block are extended by that of its root. So a source of any size
lies in as many tasks as it needs, and the tables shrink by 256 from one round to the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.operators.ordering import placed
from strandloom.session import Workspace

FAN = 16
BLOCK_LEVELS = 2
BLOCK = FAN**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST_BYTES = 32


def run_digest(run: list[bytes]) -> bytes:
    """The digest over a run's nodes, as hex text one after the other."""
    return hashlib.sha256("".join(d.hex() for d in run).encode()).digest()


class Appender:
    """Takes the nodes of one block in order; `witnesses` holds what each has so far.

    A witness is a list of (place in the run, the run's nodes), the lowest level first.
    """

    def __init__(self) -> None:
        self.open: list[list[tuple[bytes, range]]] = []  # by level: nodes of the open run and the leaves under each
        self.witnesses: list[list[tuple[int, list[bytes]]]] = []

    def append(self, node: bytes) -> None:
        self.witnesses.append([])
        self._push(0, node, range(len(self.witnesses) - 1, len(self.witnesses)))

    def _push(self, level: int, node: bytes, leaves: range) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, leaves))
        if len(self.open[level]) == FAN and level < BLOCK_LEVELS:
            self._complete(level)

    def _complete(self, level: int) -> None:
        members, self.open[level] = self.open[level], []
        run = [node for node, _ in members]
        for place, (_, leaves) in enumerate(members):
            for leaf in leaves:
                self.witnesses[leaf].append((place, run))
        self._push(level + 1, run_digest(run), range(members[0][1].start, members[-1][1].stop))

    def close(self, levels: int) -> bytes:
        """Completes the runs that are still open, up to the given level; returns the block's root."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[levels][0][0]


def levels_of(nodes: int) -> int:
    """Levels that a block takes in a tree that has so many nodes."""
    return 0 if nodes == 1 else 1 if nodes <= FAN else BLOCK_LEVELS


def packed(witness: list[tuple[int, list[bytes]]]) -> bytes:
    """A witness as bytes: for each level the place, the number of siblings and their digests."""
    return b"".join(bytes((place, len(run) - 1)) + b"".join(run[:place]) + b"".join(run[place + 1 :]) for place, run in witness)


def unpacked(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, siblings) for each level."""
    at = 0
    while at < len(witness):
        place, n = witness[at : at + 2]
        at += 2
        yield place, [witness[i : i + DIGEST_BYTES] for i in range(at, at + n * DIGEST_BYTES, DIGEST_BYTES)]
        at += n * DIGEST_BYTES


def folded(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for place, siblings in unpacked(witness):
        leaf = run_digest([*siblings[:place], leaf, *siblings[place:]])
    return leaf


def siblings_digest(witness: bytes) -> bytes:
    """The digest over all siblings, level by level."""
    return run_digest([sibling for _, siblings in unpacked(witness) for sibling in siblings])


def leaf_digest(columns: dict[str, Column], fields: tuple[str, ...] = FIELDS) -> Column:
    """SHA-256 over each field's byte count, a colon and its value; a dash for null."""
    said = [(c := columns[name].cast("string"), F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)))[1] for name in fields]
    return F.unhex(F.sha2(F.concat(*said), 256))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """((tree, block), rows) for each block of sorted rows."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = row["tree"], row["block"]
            if at != key and rows:
                yield key, rows
                rows = []
            key = at
            rows.append(row)
    if rows:
        yield key, rows


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


def _batches(rows: Iterator[dict], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    while some := list(islice(rows, 2048)):
        yield pa.RecordBatch.from_pylist(some, schema=arrow)


def _appended(rows: list[dict]) -> tuple[bytes, list[list[tuple[int, list[bytes]]]]]:
    """The root of a block's nodes and the witnesses they have below it."""
    appender = Appender()
    for row in rows:
        appender.append(row["digest"])
    return appender.close(levels_of(rows[0]["n"])), appender.witnesses


def block_roots(nodes: DataFrame) -> DataFrame:
    """(tree, idx, n, digest) of the level two above nodes (tree, idx, n, digest); n counts a tree's nodes on its level."""
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = ({"tree": tree, "idx": block, "n": -(-rows[0]["n"] // BLOCK), "digest": _appended(rows)[0]} for (tree, block), rows in _blocks(batches))
        return _batches(roots, schema)

    source = nodes.select("tree", F.expr(f"idx div {BLOCK}").alias("block"), "idx", "n", "digest")
    return _by_block(source).mapInArrow(run, schema)


def extended(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes with their `witness` and the tree's root `top`; above has (tree, idx, witness, top) of their blocks' roots.

    A block's root comes first among its rows, so its witness is at hand when those below are extended by it.
    """
    none = lambda kind: F.lit(None).cast(kind)
    carried = [f for f in nodes.schema if f.name not in ("tree", "idx", "n", "digest")]
    roots = above.select(
        "tree", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), none("long").alias("n"), none("binary").alias("digest"), "witness", "top", *[none(f.dataType).alias(f.name) for f in carried]
    )
    below = nodes.withColumns({"block": F.expr(f"idx div {BLOCK}"), "witness": none("binary"), "top": none("binary")})
    fields = [T.StructField(n, k) for n, k in (("tree", T.StringType()), ("idx", T.LongType()), ("n", T.LongType()), ("digest", T.BinaryType()), ("witness", T.BinaryType()), ("top", T.BinaryType()))]
    schema = T.StructType([*fields, *[T.StructField(f.name, f.dataType) for f in carried]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for _, (root, *members) in _blocks(batches):
                for row, witness in zip(members, _appended(members)[1]):
                    yield row | {"witness": packed(witness) + root["witness"], "top": root["top"]}

        return _batches(rows(), schema)

    return _by_block(roots.unionByName(below)).mapInArrow(run, schema)


def _levels(work: Workspace, nodes: DataFrame) -> list[DataFrame]:
    """Tables of the nodes, of their blocks' roots, of theirs and so on, until each tree has one node."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(work.keep(block_roots(levels[-1])))
        most = -(-most // BLOCK)
    return levels


def _down(work: Workspace, levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The first level's nodes with whole witnesses; top has (tree, idx = 0, witness, top) of each tree's root."""
    above = top
    for nodes in reversed(levels[1:-1]):
        above = work.keep(extended(nodes, above).select("tree", "idx", "witness", "top"))
    return extended(levels[0], above)


def manifest(
    documents: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, carried: dict[str, Column] | None = None,
    work: Workspace | None = None,
) -> DataFrame:
    """id_col, source_col, leaf, subroot, root (lowercase hex), witness (bytes, see unpacked) of every row, and the carried columns.

    fields go into a leaf's digest; a null one is told from an empty one. Trees take their source's rows by id, nulls
    first, ties by leaf; sources are in bytewise order, null first, and an empty one is not null. Repeated rows are
    leaves of their own. Texts of any length are hashed whole; no rows give none. Other columns are not carried.
    The result reads written tables of `work`.
    """
    carried = carried or {}
    work = work or Workspace(documents.sparkSession, "merkle")
    source = F.col(source_col).cast("string")
    named = {"tree": F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)), "digest": leaf_digest({f: F.col(f) for f in fields}, fields), "_id": F.col(id_col)}
    leaves = work.keep(documents.select(*[c.alias(name) for name, c in named.items()], *[c.alias(f"_carried_{name}") for name, c in carried.items()]))
    order = [F.asc_nulls_first("_id"), F.asc("digest"), F.asc("_copy")]
    numbered = placed(work, leaves.withColumn("_copy", F.monotonically_increasing_id()), "tree", order)
    kept = ["_id", *[f"_carried_{name}" for name in carried]]
    nodes = work.keep(numbered.select("tree", (F.col("place") - 1).alias("idx"), F.col("group_size").alias("n"), "digest", *kept))
    levels = _levels(work, nodes)

    subroots = levels[-1]
    forest = placed(work, subroots.select(F.lit("").alias("tree"), F.col("tree").alias("_source"), "digest"), "tree", [F.asc("_source")])
    upper = _levels(work, work.keep(forest.select("tree", (F.col("place") - 1).alias("idx"), F.col("group_size").alias("n"), "digest", "_source")))
    root = upper[-1].select("digest").first()
    root = None if root is None else bytes(root[0])
    start = upper[-1].select("tree", "idx", F.lit(b"").alias("witness"), F.col("digest").alias("top"))
    of_source = work.keep(_down(work, upper, start).select(F.col("_source").alias("tree"), F.lit(0).cast("long").alias("idx"), "witness", F.col("digest").alias("top")))

    hexed = lambda c: F.lower(F.hex(c))
    return _down(work, levels, of_source).select(
        F.col("_id").alias(id_col), F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias(source_col), hexed(F.col("digest")).alias("leaf"), hexed(F.col("top")).alias("subroot"),
        F.lit(None if root is None else root.hex()).cast("string").alias("root"), "witness", *[F.col(f"_carried_{name}").alias(name) for name in carried],
    )


def proofs(found: DataFrame, given: Column | None = None, *, id_col: str = "doc_id") -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256, folded_root and verified for each row of a manifest.

    The fold starts from `given`, a digest as bytes, where it is not null, and else from the leaf; it is verified if it
    ends in the manifest's root.
    """
    given = F.lit(None).cast("binary") if given is None else given
    source = found.select(F.col(id_col), "leaf", "subroot", "root", "witness", F.coalesce(given, F.unhex("leaf")).alias("given"))
    schema = T.StructType([*source.schema[:4], T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType()), T.StructField("verified", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            witness, start, roots = (batch.column(i).to_pylist() for i in (4, 5, 3))
            ends = [folded(s, w).hex() for s, w in zip(start, witness)]
            said = [pa.array([siblings_digest(w).hex() for w in witness], pa.string()), pa.array(ends, pa.string()), pa.array([a == b for a, b in zip(ends, roots)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *said], names=schema.names)

    return source.mapInArrow(run, schema)


SQL_LEVELS = 6


def oracle_sql(levels: int = SQL_LEVELS) -> str:
    """The registered query in DuckDB SQL, for sources of up to 16^levels rows and as many sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def tree(name: str) -> str:
        steps = []
        for k in range(levels):
            runs = f"SELECT tree, idx // {FAN} AS idx, n, list(d ORDER BY idx) AS run FROM {name}{k} GROUP BY tree, idx // {FAN}, n"
            steps.append(f"{name}_run{k} AS ({runs})")
            steps.append(f"{name}{k + 1} AS (SELECT tree, idx, (n + {FAN - 1}) // {FAN} AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d FROM {name}_run{k})")
        return ",\n".join(steps)

    def climb(name: str, start: str, tree: str, idx: str) -> str:
        steps = []
        for k in range(levels):
            spot = f"CAST(s.{idx} // {FAN**k} % {FAN} AS INT)"
            around = f"CASE WHEN r.n > 1 THEN array_to_string(list_concat(run[:{spot}], run[{spot} + 2:]), '') ELSE '' END"
            fold = f"CASE WHEN r.n > 1 THEN sha256(array_to_string(list_concat(run[:{spot}], [fold], run[{spot} + 2:]), '')) ELSE fold END"
            before = start if k == 0 else f"{name}_up{k - 1}"
            steps.append(f"{name}_up{k} AS (SELECT s.* REPLACE (proof || {around} AS proof, {fold} AS fold) FROM {before} s JOIN {name}_run{k} r ON r.tree = s.{tree} AND r.idx = s.{idx} // {FAN ** (k + 1)})")
        return ",\n".join(steps)

    return f"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) t(i))
), leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS source, {leaf("text")} AS leaf, {leaf(f"translate(text, '{upper}', '{lower}')")} AS altered,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS crc
  FROM documents, tab
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves
), leaf0 AS (SELECT source AS tree, idx, n, leaf AS d FROM placed),
{tree("leaf")},
sub0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, d, tree AS source FROM leaf{levels}),
{tree("sub")},
start AS (
  SELECT doc_id, leaf, source, p.idx, s.d AS subroot, '' AS forest, s.idx AS place, CASE WHEN crc % 5 = 0 THEN altered ELSE leaf END AS fold, '' AS proof
  FROM placed p JOIN sub0 s USING (source)
),
{climb("leaf", "start", "source", "idx")},
{climb("sub", f"leaf_up{levels - 1}", "forest", "place")}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified FROM sub_up{levels - 1}, (SELECT d FROM sub{levels})"""
