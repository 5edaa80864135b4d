"""Exact top-k inner products by a dual-tree search over cover trees.

A cover tree's node is a point of the data with the ball around it that covers the node's vectors. Its children are
chosen among these, the node's own point first, so that each lies farther from the others than the next level's
radius, the ball's radius over BASE, and every vector within that radius of a child. A ball whose vectors do not
gather around few such points is a leaf.

The upper part of the tree, for data and queries alike, is fitted on a bounded sample; the number of its nodes grows
with the data. Every vector belongs to the nearest one, which knows the count and the covering radii of its data and
of its queries. A node's data is packed into blocks and its queries into groups, both of bounded size, and within
blocks and groups the tree goes on.

No x in a ball (centre c, radius r) and q in a ball (centre d, radius s) have a product over
c.d + r|d| + s|c| + rs. A query group's worst k-th score so far bounds what it still needs:

1. Each query node meets the data nodes that promise most, enough of them to give its queries k scores.
2. A pair of a query node and a data node goes on only if its bound reaches the worst of these.
3. The blocks and groups of the pairs left meet. Node pairs of their trees are pruned in the same way, and the leaf
   pairs left are multiplied exactly.

Blocks that no pair is left of do not move. The k best of each block and query are merged by a window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.session import cut_lineage

SCALE = 1024
SAMPLE_ROWS = 16_384
BLOCK_ROWS = 16_384
GROUP_ROWS = 16_384
BASE = 1.3
LEAF, QUERY_LEAF = 256, 4
GATHERED, QUERY_GATHERED = 32, 2  # a ball goes on to children if they have so many points each
TILE = 2048
SLACK = 1e-9
LOWEST = -(2**63)
HIGHEST = 2**63 - 1


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x) with x = floor(scale * component) as longs; rows without an id or with a bad vector are left out."""
    good = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return given.filter(F.col("vec_id").isNotNull() & good).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Integer rows of `dim` columns, padded with zeros where a vector is shorter."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def farthest_first(points: np.ndarray, limit: int, within: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of at most `limit` centres, each the point farthest from those before, and each point's nearest centre and
    distance to it; no more are chosen once every point is within the given distance."""
    chosen, nearest = [0], np.zeros(len(points), int)
    distance = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < limit and distance.max() > within:
        new = int(distance.argmax())
        to_new = np.linalg.norm(points - points[new], axis=1)
        nearest[to_new < distance] = len(chosen)
        distance = np.minimum(distance, to_new)
        chosen.append(new)
    return np.array(chosen), nearest, distance


@dataclass
class Ball:
    centre: np.ndarray
    radius: float
    rows: np.ndarray  # positions in the matrix; children share them out
    children: list[Ball] = field(default_factory=list)


def cover_tree(points: np.ndarray, leaf: int = LEAF, gathered: int = GATHERED, base: float = BASE) -> Ball:
    """The cover tree of some points; a leaf has at most `leaf` points, or points that do not gather, on average `gathered` of them, around centres."""
    x = points.astype(float)
    root = Ball(x[0], float(np.linalg.norm(x - x[0], axis=1).max()), np.arange(len(x)))
    open_balls = [root]
    while open_balls:
        now = open_balls.pop()
        n = len(now.rows)
        if n <= leaf or now.radius == 0:
            continue
        inside = x[now.rows]
        own = np.flatnonzero((inside == now.centre).all(axis=1))[0]  # a node's point is among its vectors and its own first child
        order = np.concatenate(([own], np.delete(np.arange(n), own)))
        few = max(8, n // gathered)
        chosen, nearest, distance = farthest_first(inside[order], few, now.radius / base)
        if distance.max() > now.radius / base:
            continue
        for i, centre in enumerate(order[chosen]):
            at = nearest == i
            now.children.append(Ball(inside[centre], float(distance[at].max()), now.rows[order[at]]))
        open_balls += now.children
    return root


def bound(a: Ball, b: Ball) -> float:
    """No product between the balls is above this."""
    na, nb = float(np.linalg.norm(a.centre)), float(np.linalg.norm(b.centre))
    return float(a.centre @ b.centre) + a.radius * nb + b.radius * na + a.radius * b.radius + SLACK * (na + a.radius) * (nb + b.radius) + SLACK


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products, through floats where these hold every partial sum; what leaves 64 bits ends at their ends."""
    largest = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1)
    if largest < 2.0**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if largest < 2.0**62:
        return a @ b.T
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, LOWEST + 1, HIGHEST).astype(np.int64)


class Best:
    """The k best (score, smaller id first) of each of some queries, and how many products it took."""

    def __init__(self, query_ids: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.query_ids, self.k, self.worst = query_ids, k, floor.copy()
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.products = 0

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries (rows) with some vectors (columns)."""
        self.products += scores.size
        other = ids[None, :] != self.query_ids[rows][:, None]
        scores = np.where(other, scores, LOWEST)
        limit = self.worst[rows]
        if scores.shape[1] > self.k:
            limit = np.maximum(limit, np.partition(scores, -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero((scores >= limit[:, None]) & other)
        if not len(row):
            return
        query = np.concatenate((self.query, rows[row]))
        score = np.concatenate((self.score, scores[row, column]))
        found = np.concatenate((self.id, ids[column]))
        order = np.lexsort((found, ~score, query))  # ~score falls as the score rises, and cannot overflow
        query = query[order]
        first = np.concatenate(([True], query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        kept = place < self.k
        self.query, self.score, self.id = query[kept], score[order][kept], found[order][kept]
        last = place[kept] == self.k - 1
        self.worst[self.query[last]] = np.maximum(self.worst[self.query[last]], self.score[last])


def dual_tree(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """The k best data rows of each query among those that score floor[query] or more; a query's own id is no candidate."""
    best = Best(query_ids, k, floor)
    start = cover_tree(queries, QUERY_LEAF, QUERY_GATHERED), cover_tree(data)
    pairs = [(bound(*start), *start)]
    while pairs:
        limit, q, d = pairs.pop()
        if limit < float(best.worst[q.rows].min()):
            continue
        if q.children or d.children:
            split_q = bool(q.children) and (not d.children or q.radius >= d.radius)
            below = [(c, d) for c in q.children] if split_q else [(q, c) for c in d.children]
            pairs += sorted(((bound(*p), *p) for p in below), key=lambda p: p[0])  # the most promising pair is popped first
            continue
        for i in range(0, len(q.rows), TILE):
            for j in range(0, len(d.rows), TILE):
                rows, columns = q.rows[i : i + TILE], d.rows[j : j + TILE]
                best.offer(rows, products(queries[rows], data[columns]), data_ids[columns])
    return best


@dataclass
class _Upper:
    """The upper nodes' points; vectors go to the nearest."""

    points: np.ndarray

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node and distance of each vector."""
        square = (x**2).sum(1)[:, None] - 2 * x @ self.points.T + (self.points**2).sum(1)[None]
        node = square.argmin(axis=1)
        return node, np.linalg.norm(x - self.points[node], axis=1)


def _upper_nodes(total: int, block_rows: int) -> int:
    """About one node a block, and fewer for very many blocks, as the pairs of nodes grow with the square."""
    blocks = math.ceil(total / block_rows)
    return min(blocks, 64 + 16 * math.isqrt(blocks), 4096)


def search(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, scale: int = SCALE,
    sample_rows: int = SAMPLE_ROWS, centres: int | None = None, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by `every`, the k best other rows.

    Ties go to the smaller id. Rows with a null id, or a vector that is null or holds a null or non-finite
    component, take no part. Vectors of different lengths are padded with zeros; empty ones score 0. Rows that
    repeat a query's id are the query's own and ask once, with their least vector; other repeats are candidates
    each. Fewer than k candidates are all returned; no rows or no queries give none. Components and scores that
    leave 64 bits end at their ends. Other columns are not carried, so their names cannot clash. `centres` is the
    number of upper nodes; without it about one for each block of data.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = quantise(vectors, id_col, vector_col, scale)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
    if not size["n"]:
        return nothing
    dim = size["dim"]
    drawn = rows.select("x").filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < min(1.0, sample_rows / size["n"]) * 1_000_000).limit(2 * sample_rows).toArrow()
    sample = _matrix(drawn.column(0).combine_chunks() if drawn.num_rows else pa.array([[0] * dim], pa.list_(pa.int64())), dim).astype(float)
    wanted = _upper_nodes(size["n"], block_rows) if centres is None else centres
    upper = spark.sparkContext.broadcast(_Upper(sample[farthest_first(sample, wanted)[0]]))  # some thousand points at most

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = 0
        for batch in batches:
            node, radius = upper.value.place(_matrix(batch.column(1), dim).astype(float))
            spots = pa.array(np.arange(spot, spot + len(node)))
            spot += len(node)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int32()), pa.array(radius), spots], names=["vec_id", "x", "node", "radius", "spot"])

    # what is drawn by place in a partition holds once it is written
    placed = cut_lineage(rows.mapInArrow(assigned, "vec_id long, x array<long>, node int, radius double, spot long"))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    stats = placed.groupBy("node").agg(
        F.count("*").alias("n"), F.max("radius").alias("r"), F.sum(is_query.cast("long")).alias("nq"), F.max(F.when(is_query, F.col("radius"))).alias("rq")
    ).collect()  # a row for each upper node
    if not any(s["nq"] for s in stats):
        return nothing

    pieces = F.create_map(*[F.lit(v) for s in stats for v in (s["node"], math.ceil(s["n"] / block_rows))])
    groups = F.create_map(*[F.lit(v) for s in stats for v in (s["node"], max(1, math.ceil(s["nq"] / group_rows)))])
    # repeats of a row lie in different blocks too, so none is crowded
    block = F.pmod(F.xxhash64("vec_id", "spot"), pieces[F.col("node")]).cast("int")
    data = _packed(placed.select("node", block.alias("part"), "vec_id", "x"), dim)
    asked = placed.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("x", "node")).alias("least"))  # an id asks once
    asked = asked.select(F.col("least.node").alias("node"), F.pmod(F.xxhash64("vec_id"), groups[F.col("least.node")]).cast("int").alias("part"), "vec_id", F.col("least.x").alias("x"))
    queries = _packed(asked, dim)

    points = upper.value.points
    balls = {s["node"]: (Ball(points[s["node"]], s["r"], np.empty(0)), s["n"]) for s in stats}
    asking = {s["node"]: Ball(points[s["node"]], s["rq"], np.empty(0)) for s in stats if s["nq"]}
    near = []
    for q, ball in asking.items():
        seen = 0
        for d in sorted(balls, key=lambda d: (-float(ball.centre @ balls[d][0].centre), d)):
            near.append((q, d))
            seen += balls[d][1]
            if seen > k + 1:
                break
    first = cut_lineage(_meet(spark, data, queries, near, k, dim))
    reached = first.groupBy("node", "part", "query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(LOWEST).alias("floor"))
    worst = {r["node"]: r["w"] for r in reached.groupBy("node").agg(F.min("floor").alias("w")).collect()}
    done = set(near)
    left = [(q, d) for q, ball in asking.items() for d, (other, _) in balls.items() if (q, d) not in done and bound(ball, other) >= worst.get(q, LOWEST)]
    found = first
    if left:
        floors = reached.groupBy("node", "part").agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))  # of one group each
        found = found.union(_meet(spark, data, queries.join(floors, ["node", "part"], "left"), left, k, dim))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(rows: DataFrame, dim: int) -> DataFrame:
    """(node, part, ids, x): the rows of each part of a node as one row of bytes, written so that it is made once."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        x = _matrix(table.column("x").combine_chunks(), dim)
        small = x.astype(np.int32)
        blob = (small if (small == x).all() else x).tobytes()
        return pa.table({"node": table.column("node")[:1], "part": table.column("part")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([blob], pa.binary())})

    return cut_lineage(rows.groupBy("node", "part").applyInArrow(pack, "node int, part int, ids binary, x binary"))


def _unpacked(ids: bytes, x: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    kind = np.int64 if len(x) == 8 * dim * len(numbers) else np.int32
    return numbers, np.frombuffer(x, kind).reshape(len(numbers), dim).astype(np.int64)


def _meet(spark: SparkSession, data: DataFrame, queries: DataFrame, pairs: list[tuple[int, int]], k: int, dim: int) -> DataFrame:
    """(node, part, query_id, vec_id, score): the k best of each query, of the given node and part, over the data nodes paired with its node.

    What is paired are ids of blocks and groups; then each pair's block and group, one packed row each, meet in a task.
    """
    table = spark.createDataFrame(pairs, "query_node int, data_node int")
    blocks = data.select(F.col("node").alias("data_node"), F.col("part").alias("data_part"))
    groups = queries.select(F.col("node").alias("query_node"), F.col("part").alias("query_part"))
    met = table.join(blocks, "data_node").join(groups, "query_node")
    left = data.select(F.col("node").alias("data_node"), F.col("part").alias("data_part"), "ids", "x").join(met, ["data_node", "data_part"])
    floors = F.col("floors") if "floors" in queries.columns else F.lit(None).cast("array<struct<query_id: long, floor: long>>")
    right = queries.select(F.col("node").alias("query_node"), F.col("part").alias("query_part"), F.col("ids").alias("query_ids"), F.col("x").alias("q"), floors.alias("floors")).join(met, ["query_node", "query_part"])
    right = right.withColumnsRenamed({"data_node": "to_node", "data_part": "to_part", "query_node": "of_node", "query_part": "of_part"})

    def meet(block: pa.Table, group: pa.Table) -> pa.Table:
        data_ids, x = _unpacked(block.column("ids")[0].as_py(), block.column("x")[0].as_py(), dim)
        query_ids, q = _unpacked(group.column("query_ids")[0].as_py(), group.column("q")[0].as_py(), dim)
        floor = np.full(len(query_ids), LOWEST)
        known = group.column("floors").combine_chunks().flatten()
        if len(known):
            order = np.argsort(query_ids)
            floor[order[np.searchsorted(query_ids[order], known.field("query_id").to_numpy())]] = known.field("floor").to_numpy()
        best = dual_tree(q, query_ids, x, data_ids, k, floor)
        n = len(best.query)
        of = [pa.array(np.full(n, group.column(c)[0].as_py(), np.int32)) for c in ("of_node", "of_part")]
        return pa.Table.from_arrays([*of, pa.array(query_ids[best.query]), pa.array(best.id), pa.array(best.score)], names=["node", "part", "query_id", "vec_id", "score"])

    met_pairs = left.groupBy("data_node", "data_part", "query_node", "query_part").cogroup(right.groupBy("to_node", "to_part", "of_node", "of_part"))
    found = met_pairs.applyInArrow(meet, "node int, part int, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank")


def oracle_sql(k: int = 10, every: int = 100, scale: int = SCALE) -> str:
    """The registered query in DuckDB SQL, by brute force."""
    return f"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor({scale} * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.x, d.x) AS BIGINT) AS score
  FROM rows q JOIN rows d ON q.vec_id % {every} = 0 AND d.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= {k}"""
