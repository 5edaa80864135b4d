"""The trie of conversations' prefixes, by SQL ROLLUP over positional columns of turn ids.

A turn's id is a digest of its role and text. A conversation becomes rows of eight positional columns, one row for
each block of eight turns, keyed by the node at which the block begins; a further block's rows are so told apart by
the node that the prior block leads to. One ROLLUP over the columns then aggregates the prefixes of all lengths of
all blocks together; grouping_id says how many columns a group fixes, and with the block the depth of its node.

A block's node is known without the blocks before it: each full block has a 128-bit digest of its turns and its
number, and a node's key is the sum of those on its path, a running sum over the conversation's blocks. So neither
long conversations nor crowds of equal ones need a round for each block, nor lie in one task.

Sums over subtrees come from a second ROLLUP, of what each member adds. A node belongs to its smallest member; on a
conversation's path the nodes it owns are the last ones. It saves the characters of the path before these, which it
shares with smaller ones, so a node's subtree saves the sum of its members' shares, but for its owner's and the part
above it. A leaf's owner adds one leaf to all nodes on its path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ordering import placed
from strandloom.session import Workspace

BLOCK_TURNS = 8
LIMBS = 4  # of 32 bits each, summed as longs
ENDS_CHUNK = 4096
_SLOTS = range(1, BLOCK_TURNS + 1)


def _digest(*parts: Column) -> Column:
    """128 bits of the SHA-256 of strings' UTF-8, as hex."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def ordered_turns(conversations: DataFrame, work: Workspace, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place from 1, turn_id, chars, _part) of every row; null roles and texts are empty, chars are the text's code points.

    Turns go by turn, null first, ties by role and turn_id; repeated rows are turns of their own. Rows without an id
    belong to no conversation and are left out.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    turn_id = _digest(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    kept = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("_turn"), role.alias("_role"), turn_id.alias("turn_id"), F.length(text).cast("long").alias("chars")
    )
    order = [F.asc_nulls_first("_turn"), F.asc("_role"), F.asc("turn_id"), F.asc("_copy")]
    copies = work.keep(kept).withColumn("_copy", F.monotonically_increasing_id())
    return placed(work, copies, "conv_id", order).select("conv_id", "place", "turn_id", "chars", "group_size", "_part")


def with_shared_heads(turns: DataFrame, work: Workspace, *, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, turn_id, chars) and (conv_id, n_turns) of conversations that begin as the first of their hundred.

    turns is what ordered_turns gives. Conversation c takes the first h turns of c - c % group, h = crc32(decimal c) %
    most, all if there are fewer and none if it is absent, and then its own turns after its first h.
    """
    turns = work.keep(turns)
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("place") < most)).groupBy(F.col("conv_id").alias("_first"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("place", "turn_id", "chars"))).alias("_head"))  # most - 1 turns at most
    sizes = turns.groupBy("conv_id").agg(F.max("group_size").alias("n_own"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("int")
    facts = sizes.withColumns({"h": h, "_first": F.col("conv_id") - F.col("conv_id") % group}).join(heads, "_first", "left")
    taken = F.slice(F.coalesce("_head", F.array().cast(heads.schema["_head"].dataType)), F.lit(1), F.col("h"))
    facts = work.keep(facts.select("conv_id", "n_own", "h", taken.alias("_head")))
    n_head = F.size("_head").cast("long")
    copied = facts.select("conv_id", F.explode("_head").alias("_t")).select("conv_id", "_t.place", "_t.turn_id", "_t.chars")
    # own rows meet their conversation's facts by part, so a long conversation's lie in as many tasks as before
    by_part = turns.select("conv_id", "_part").distinct().join(facts.select("conv_id", "h", n_head.alias("_n")), "conv_id")
    own = turns.join(by_part, ["conv_id", "_part"]).filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("_n")).alias("place"), "turn_id", "chars")
    n_turns = n_head + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))
    return copied.unionByName(own), facts.select("conv_id", n_turns.alias("n_turns"))


def _node_key(j: int) -> Column:
    """The key of the node after j of a block's columns; after none or all it is that of the neighbouring block."""
    if j in (0, BLOCK_TURNS):
        return F.concat(*[F.lpad(F.hex(f"{'p' if j == 0 else 'q'}{i}"), 8, "0") for i in range(LIMBS)])
    return _digest(*[F.col(f"p{i}").cast("string") for i in range(LIMBS)], *[F.concat(F.lit(" "), F.col(f"t{i}")) for i in range(1, j + 1)])


def _by_count(count: Column, of: list[Column]) -> Column:
    """of[count], of which only one is evaluated."""
    return reduce(lambda rest, i: F.when(count == i, of[i]).otherwise(rest), range(len(of) - 1), of[-1])


def _blocks(turns: DataFrame, conversations: DataFrame, work: Workspace) -> DataFrame:
    """A row for each block of each conversation: columns t1 to t8 and their running characters c1 to c8 (null beyond its end),
    m of them filled, c0 characters before, key limbs before (p) and after (q), and the depth that the conversation reaches in
    the block or beyond."""
    block = F.expr(f"(place - 1) div {BLOCK_TURNS}").alias("block")
    rows = turns.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(F.struct("place", "turn_id", "chars"))).alias("_turns"))
    none = conversations.filter("n_turns = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.array().cast(rows.schema["_turns"].dataType).alias("_turns"))
    rows = rows.unionByName(none)
    said = F.concat(F.col("block").cast("string"), *[F.concat(F.lit(" "), F.coalesce(F.get("_turns", F.lit(i))["turn_id"], F.lit(""))) for i in range(BLOCK_TURNS)])
    rows = rows.withColumns({"_said": _digest(said), "_chars": F.aggregate("_turns", F.lit(0).cast("long"), lambda a, x: a + x["chars"])})
    limbs = {f"q{i}": F.conv(F.substring("_said", 8 * i + 1, 8), 16, 10).cast("long") for i in range(LIMBS)}
    run = placed(work, rows.withColumns({f"_{name}": c for name, c in limbs.items()}), "conv_id", [F.asc("block")], {name: F.col(f"_{name}") for name in limbs} | {"_upto": F.col("_chars")})
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    chars = [F.get("_turns", F.lit(i))["chars"] for i in range(BLOCK_TURNS)]
    columns = {"c0": F.col("_upto") - F.col("_chars")}
    for i in _SLOTS:
        columns |= {f"t{i}": F.get("_turns", F.lit(i - 1))["turn_id"], f"c{i}": reduce(lambda a, b: a + b, chars[:i], columns["c0"])}
    columns |= {f"p{i}": low(F.col(f"q{i}") - F.col(f"_q{i}")) for i in range(LIMBS)} | {f"q{i}": low(F.col(f"q{i}")) for i in range(LIMBS)}
    more = (F.col("block") + 1 < F.col("group_size")).cast("long")
    m = F.size("_turns")
    columns |= {"m": m, "more": more, "reach": F.col("block") * BLOCK_TURNS + m + more, "chars": F.col("_chars")}
    return run.select("conv_id", "_part", "block", *[c.alias(name) for name, c in columns.items()])


def _rolled_up(rows: DataFrame, aggregates: str) -> DataFrame:
    """Every node with its columns, block, slots (columns fixed), n_convs, owner (smallest member), reach, characters c0 to c8, and the aggregates."""
    slots = ", ".join(f"t{i}" for i in _SLOTS)
    limbs = ", ".join(f"p{i}" for i in range(LIMBS))
    fixed = f"({BLOCK_TURNS} - bit_count(grouping_id()))"
    held = ", ".join([*[f"max(c{i}) AS c{i}" for i in range(BLOCK_TURNS + 1)], *[f"max(q{i}) AS q{i}" for i in range(LIMBS)]])
    # nodes are groups whose last column is filled; without columns only the root is new
    last = " ".join(f"WHEN {i} THEN t{i} IS NOT NULL" for i in _SLOTS)
    query = f"""
SELECT {limbs}, block, {slots}, {fixed} AS slots, count(*) AS n_convs, min(conv_id) AS owner, max(reach) AS reach, {held}, {aggregates}
FROM {{rows}} GROUP BY {limbs}, block, ROLLUP({slots}) HAVING CASE {fixed} WHEN 0 THEN block = 0 {last} END"""
    found = rows.sparkSession.sql(query, rows=rows)
    depth = F.col("block") * BLOCK_TURNS + F.col("slots")
    at = lambda shift: _by_count(F.col("slots"), [F.col(f"c{max(0, i - shift)}") for i in range(BLOCK_TURNS + 1)])
    return found.withColumns({"depth": depth, "above": at(1), "chars": at(0) - at(1)})


def trie(turns: DataFrame, conversations: DataFrame, work: Workspace) -> DataFrame:
    """One row for each node, long but the last: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    turns has (conv_id, place from 1 without gaps, turn_id, chars), conversations (conv_id, n_turns) of all, turnless ones
    too. n_leaves and saved_tokens are over the node's subtree, itself included: childless nodes, and each node's members
    but one times its last turn's characters. ends_sha256 is over the sorted decimal ids, comma-joined, of the members that
    end at the node. No conversations give no nodes; without turns there is the root alone.
    """
    rows = work.keep(_blocks(turns, conversations, work))
    leaf = (F.col("reach") == F.col("depth")).cast("long")
    first = _rolled_up(rows, "true AS kept").groupBy(F.col("owner").alias("conv_id")).agg(F.sum("chars").alias("owned"), F.max(leaf).alias("leaf"))
    totals = rows.groupBy("conv_id").agg(F.sum("chars").alias("total")).join(first, "conv_id", "left")
    facts = totals.select("conv_id", (F.col("total") - F.coalesce("owned", F.lit(0))).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    by_part = rows.select("conv_id", "_part").distinct().join(facts, "conv_id")
    second = _rolled_up(rows.join(by_part, ["conv_id", "_part"]), "sum(shared) AS all_shared, min_by(shared, conv_id) AS own_shared, sum(leaf) AS n_leaves")
    keys = [_node_key(i) for i in range(BLOCK_TURNS + 1)]
    saved = F.col("all_shared") - F.col("own_shared") - (F.col("n_convs") - 1) * F.col("above")
    nodes = work.keep(second.select(
        _by_count(F.col("slots"), keys).alias("key"), F.when(F.col("depth") > 0, _by_count(F.col("slots"), [keys[0], *keys[:-1]])).alias("parent"),
        F.col("owner").alias("conv_id"), "depth", "n_convs", "n_leaves", saved.alias("saved_tokens"),
    ))
    ends = _ends(rows.filter("more = 0").select(_by_count(F.col("m"), keys).alias("key"), "conv_id"))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(children, "key", "left").join(ends, "key", "left").join(parents, "parent", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def _ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest over each key's ids in ascending order.

    Ids are first joined in chunks of a fixed range of ids; a digest is one pass over a key's chunks, of which a task holds one at a time.
    """
    chunk = (F.col("conv_id") - F.pmod("conv_id", F.lit(ENDS_CHUNK))).alias("chunk")
    joined = members.groupBy("key", chunk).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            yield _pairs(done)
            done = []
        yield _pairs(done if key is None else [(key, digest.hexdigest())])

    def _pairs(done: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], names=["key", "ends_sha256"])

    return joined.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(run, "key string, ends_sha256 string")


def oracle_sql(group: int = 100, most: int = 6) -> str:
    """The registered query in DuckDB SQL: all prefixes as lists."""
    return f"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) t(i))
), given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS place FROM given
), convs AS (
  SELECT conv_id, conv_id - conv_id % {group} AS first,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % {most} AS h
  FROM (SELECT DISTINCT conv_id FROM given), tab
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.first AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1 AS own, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), lists AS (
  SELECT conv_id, coalesce(list(sha256(strlen(role) || ':' || role || text) ORDER BY own, place) FILTER (text IS NOT NULL), []) AS ids,
         coalesce(list(length(text) ORDER BY own, place) FILTER (text IS NOT NULL), []) AS chars
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
), members AS (
  SELECT conv_id, d, ids[:d] AS key, coalesce(chars[d], 0) AS chars, d = len(ids) AS ends FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM lists)
), nodes AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY key, d
), children AS (
  SELECT key[:d - 1] AS key, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), told AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key, d)
), subtrees AS (
  SELECT key[:a] AS key, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM told) GROUP BY key[:a], a
)
SELECT t.conv_id, t.d AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, t.ends_sha256
FROM told t JOIN subtrees s USING (key, d) LEFT JOIN nodes p ON p.d = t.d - 1 AND p.key = t.key[:t.d - 1]"""
