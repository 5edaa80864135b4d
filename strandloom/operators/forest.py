"""Maximum spanning forests of links, and trees made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.components import connected_components
from strandloom.operators.ordering import numbered, placed
from strandloom.session import Workspace, cut_lineage

EDGES = "u long, v long, score long"


def _kruskal(edges: DataFrame) -> DataFrame:
    """Each partition's own forest: its edges from the best on, without those that close a cycle.

    An edge that closes a cycle of better ones in a part closes it in the whole, so nothing of the answer is lost.
    What is known of many nodes is forgotten from time to time, which bounds memory and only keeps more edges.
    """

    def run(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        for batch in batches:
            keep = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                keep.append(a != b)
                parent[a] = b
            if len(parent) > most:
                parent.clear()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return edges.sortWithinPartitions(F.desc("score"), "u", "v").mapInArrow(run, EDGES)


def _better() -> Column:
    """Edges in the total order score descending, then u, then v ascending: its maximum is the best edge."""
    return F.struct(F.col("score"), (-F.col("u")).alias("minus_u"), (-F.col("v")).alias("minus_v"))


def maximum_spanning_forest(links: DataFrame, *, u: str = "query_seq", v: str = "target_seq", score: str = "score", max_rounds: int = 64) -> DataFrame:
    """(u, v, score) with u < v: the spanning forest of greatest score under the order score descending, u, v.

    Links with a score under 0, self-links and null ends never enter; of repeated links the best counts. Partitions
    first drop what closes cycles within them. Then every component takes its best edge outwards, components merge,
    and edges between the same two components shrink to the best one, until none is left: at most log2(nodes)
    rounds, each a few partial aggregations and joins. Forests merge exactly: the forest of a union is the forest
    of the union of its parts' forests.
    """
    ends = links.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b"), F.col(score).cast("long").alias("score"))
    edges = ends.filter("a <> b and score >= 0").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.max("score").alias("score"))
    edges = cut_lineage(_kruskal(edges).withColumn("cu", F.col("u")).withColumn("cv", F.col("v")))
    nodes = connected_components(edges).agg(F.count("*").alias("n"), F.count_distinct("component").alias("c")).first()
    if edges.count() == nodes["n"] - nodes["c"]:
        return edges.select("u", "v", "score")  # what the partitions kept closes no cycle
    forest = links.sparkSession.createDataFrame([], EDGES)
    for _ in range(max_rounds):
        if edges.isEmpty():
            return forest
        sides = edges.select("cu", _better().alias("best")).union(edges.select("cv", _better()))
        best = sides.groupBy("cu").agg(F.max("best").alias("best"))
        # the best edge is known by its ends; what they belong to is on the edge itself
        chosen = best.select((-F.col("best.minus_u")).alias("u"), (-F.col("best.minus_v")).alias("v")).distinct()
        taken = cut_lineage(edges.join(chosen, ["u", "v"]))
        forest = forest.union(taken.select("u", "v", "score"))
        merged = cut_lineage(connected_components(taken, "cu", "cv"))
        to = lambda end: merged.select(F.col("node").alias(end), F.col("component").alias(f"{end}_to"))  # noqa: E731, B023
        left = edges.join(to("cu"), "cu", "left").join(to("cv"), "cv", "left")
        left = left.select("u", "v", "score", F.coalesce("cu_to", "cu").alias("x"), F.coalesce("cv_to", "cv").alias("y")).filter("x <> y")
        pair = left.groupBy(F.least("x", "y").alias("cu"), F.greatest("x", "y").alias("cv")).agg(F.max(_better()).alias("best"))
        edges = cut_lineage(pair.select((-F.col("best.minus_u")).alias("u"), (-F.col("best.minus_v")).alias("v"), F.col("best.score").alias("score"), "cu", "cv"))
    raise RuntimeError(f"edges are left after {max_rounds} rounds")


def _ranked(work: Workspace, arcs: DataFrame) -> DataFrame:
    """(u, v, to_end): how many arcs a list has from each on; arcs has (u, v, next_u, next_v), null at a list's end.

    List ranking by pointer doubling: each round every arc learns what the arc that it points to knows and points where
    that one does, so the rounds are the logarithm of the longest list. All that point to an arc are one, so no key is hot.
    """
    now = work.keep(arcs.withColumn("to_end", F.lit(1).cast("long")))
    while not now.filter("next_u is not null").isEmpty():
        ahead = now.select(F.col("u").alias("next_u"), F.col("v").alias("next_v"), F.col("to_end").alias("ahead"), F.col("next_u").alias("then_u"), F.col("next_v").alias("then_v"))
        moved = now.filter("next_u is not null").join(ahead, ["next_u", "next_v"])
        moved = moved.select("u", "v", F.col("then_u").alias("next_u"), F.col("then_v").alias("next_v"), (F.col("to_end") + F.col("ahead")).alias("to_end"))
        old, now = now, work.keep(moved.union(now.filter("next_u is null")))
        work.drop(old)
    return now.select("u", "v", "to_end")


def _euler_tour(work: Workspace, forest: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v, next_u, next_v): each edge in both directions, each followed by the next one of a walk around its tree from its root.

    The walk leaves a node by the neighbour after the one it came from, the last one's being the first; neighbours are
    numbered by ranges, so a node may have any number of them.
    """
    both = forest.select("u", "v").union(forest.select("v", "u"))
    beside = work.keep(placed(work, both, "u", [F.asc("v")]).select("u", "v", "place", "group_size").join(roots.select(F.col("node").alias("u"), F.lit(True).alias("is_root")), "u", "left"))
    onward = beside.select("u", F.col("v").alias("w"), "place")
    came = beside.select("u", F.col("v").alias("from"), (F.col("place") % F.col("group_size") + 1).alias("place"), (F.col("is_root").isNotNull() & (F.col("place") == F.col("group_size"))).alias("ends"))
    goes = came.join(onward, ["u", "place"])
    at = lambda c: F.when(~F.col("ends"), F.col(c))
    return goes.select(F.col("from").alias("u"), F.col("u").alias("v"), at("u").alias("next_u"), at("w").alias("next_v"))


def up_to_root(work: Workspace, tree: DataFrame, values: dict[str, tuple[Column, Callable[[Column, Column], Column]]]) -> DataFrame:
    """tree with, for each name, the values of all nodes from the root down to the node put together.

    values has a column and a way to put what lies above and what lies below together. Pointers to ancestors double,
    so the rounds are the logarithm of the depth; the join on a common ancestor may be skewed, which AQE splits.
    """
    start = tree.withColumns({f"_{name}": c for name, (c, _) in values.items()})
    now = work.keep(start.select("node", F.col("parent").alias("jump"), *[f"_{name}" for name in values]))
    while not now.filter("jump is not null").isEmpty():
        above = now.select(F.col("node").alias("jump"), F.col("jump").alias("then"), *[F.col(f"_{name}").alias(f"up_{name}") for name in values])
        moved = now.filter("jump is not null").join(above, "jump")
        moved = moved.select("node", F.col("then").alias("jump"), *[put(F.col(f"up_{name}"), F.col(f"_{name}")).alias(f"_{name}") for name, (_, put) in values.items()])
        old, now = now, work.keep(moved.union(now.filter("jump is null")))
        work.drop(old)
    return tree.join(now.select("node", *[F.col(f"_{name}").alias(name) for name in values]), "node")


def rooted(forest: DataFrame) -> DataFrame:
    """(node, parent, score, root, size): every tree hung on its least node; size counts a node and all below it.

    Roots have a null parent and score. By an Euler tour: an edge leads down where the walk takes it first, and what
    lies below is what the walk does until it comes back. Rounds grow with the logarithm of the nodes, whatever the depth.
    """
    work = Workspace(forest.sparkSession, "tree")
    edges = work.keep(forest.select("u", "v", "score"))
    members = work.keep(connected_components(edges))
    roots = work.keep(members.groupBy(F.col("component").alias("node")).agg(F.count("*").alias("size")))
    ranks = _ranked(work, _euler_tour(work, edges, roots))
    down, up = ranks.select("u", "v", F.col("to_end").alias("down")), ranks.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("to_end").alias("up"))
    hung = down.join(up, ["u", "v"]).filter("down > up").select(F.col("v").alias("node"), F.col("u").alias("parent"), ((F.col("down") - F.col("up") + 1) / 2).cast("long").alias("size"))
    scored = hung.withColumns({"a": F.least("node", "parent"), "b": F.greatest("node", "parent")}).join(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "score"), ["a", "b"])
    null = F.lit(None).cast("long")
    below = scored.join(members.withColumnRenamed("component", "root"), "node").select("node", "parent", "score", "root", "size")
    return work.result(below.unionByName(roots.select("node", null.alias("parent"), null.alias("score"), F.col("node").alias("root"), "size")))


def children(tree: DataFrame) -> DataFrame:
    """(parent, node, score, place): children of each parent, best score first."""
    work = Workspace(tree.sparkSession, "children")
    below = tree.filter("parent is not null").select("parent", "node", "score")
    return work.result(placed(work, below, "parent", [F.desc("score"), F.asc("node")]).select("parent", "node", "score", F.col("place").cast("int").alias("place")))


def descendants(tree: DataFrame) -> DataFrame:
    """(node, descendants): how many nodes hang below each."""
    return tree.select("node", (F.col("size") - 1).alias("descendants"))


def largest_root(tree: DataFrame) -> DataFrame:
    """The root with most descendants, of those with as many the least."""
    return descendants(tree.filter("parent is null")).orderBy(F.desc("descendants"), "node").limit(1)


def isolated(nodes: DataFrame, forest: DataFrame, id_col: str = "node") -> DataFrame:
    """Nodes on no edge of the forest."""
    ends = forest.select(F.col("u").alias(id_col)).union(forest.select(F.col("v").alias(id_col)))
    return nodes.join(ends, id_col, "left_anti")


def in_order(work: Workspace, tree: DataFrame) -> DataFrame:
    """tree with `last` (of its parent's children, best score first) and `skipped`: how many nodes a depth-first walk of the
    parent's children, best first, takes from the parent on to the node."""
    below = placed(work, tree.filter("parent is not null"), "parent", [F.desc("score"), F.asc("node")], {"_upto": F.col("size")})
    below = below.withColumns({"last": F.col("place") == F.col("group_size"), "skipped": F.col("_upto") - F.col("size") + 1})
    roots = tree.filter("parent is null").withColumns({"last": F.lit(False), "skipped": F.lit(0).cast("long")})
    return work.keep(below.select(roots.columns).union(roots))


PREFIX_COLUMNS = 40
TAIL_COLUMNS = 2 * PREFIX_COLUMNS + 3


def ascii_tree(tree: DataFrame, names: DataFrame | None = None, threshold: int = 0) -> DataFrame:
    """(component, sort_key, line): the trees as drawn lines; sort by component, then sort_key.

    The tree with most nodes is component 0, the others are numbered from 2 in the order of their roots. A child of a
    score under the threshold is a stub, and what hangs below it is left out. Of a long prefix, the part from the
    last multiple of PREFIX_COLUMNS on is shown behind that number. names has node, id, name and length.
    """
    work = Workspace(tree.sparkSession, "drawing")
    walked = in_order(work, tree)
    best = largest_root(tree).select(F.col("node").alias("best"))
    roots = tree.filter("parent is null").select("root")
    others = numbered(roots.join(best, roots["root"] == best["best"], "left_anti"), [F.asc("root")], rank="place").select("root", (F.col("place") + 1).alias("component"))
    weak = F.coalesce(F.col("score") < threshold, F.lit(False))  # under a stub nothing is drawn
    bar = F.when(F.col("parent").isNull(), F.lit("")).otherwise(F.when(F.col("last"), "   ").otherwise("\u2502  "))
    # only a stub shows a long prefix whole
    joined = (lambda up, own: F.concat(up, own)) if threshold > 0 else (lambda up, own: F.substring(F.concat(up, own), -TAIL_COLUMNS, TAIL_COLUMNS))
    added = lambda up, own: up + own
    found = up_to_root(work, walked, {
        "sort_key": (F.col("skipped"), added), "_depth": (F.lit(1), added), "_weak": (weak.cast("int"), added), "_bars": (bar, joined),
    })
    drawn = found.join(others, "root", "left").withColumn("component", F.coalesce("component", F.lit(0)))
    if threshold > 0:
        drawn = drawn.filter(F.col("_weak") - weak.cast("int") == 0)
    labelled = drawn.select("*", F.col("node").cast("string").alias("id"), F.lit("").alias("name"), F.lit(None).cast("long").alias("length")) if names is None else drawn.join(names, "node", "left")
    columns = F.greatest(F.col("_depth") - 2, F.lit(0)) * 3  # of the bars of what lies between the root and the node
    prefix = F.expr("substring(_bars, 1, length(_bars) - 3)")
    over = F.greatest(columns - PREFIX_COLUMNS, F.lit(0))
    start = over - over % PREFIX_COLUMNS
    tail = F.when(columns > start, F.substring(prefix, start - columns, columns - start)).otherwise("")
    shown = F.concat(start.cast("string"), F.lit(":"), tail)
    long, short = (F.when(F.col("last"), f"\u2514{bar} ").otherwise(f"\u251c{bar} ") for bar in ("\u2500\u2500", "\u2500"))
    said = F.concat(F.col("id"), F.lit(" Length:"), F.coalesce(F.col("length").cast("string"), F.lit("?")))
    root = F.concat(shown, said, F.lit(" [ROOT "), F.col("component").cast("string"), F.lit("] "), F.coalesce("name", F.lit("")), F.lit(" "))
    stub = F.concat(prefix, long, F.lit("[STUB: Node "), F.col("node").cast("string"), F.lit(", score "), F.col("score").cast("string"), F.lit(" < threshold]"))
    child = F.concat(shown, short, said, F.lit(" (s:"), F.col("score").cast("string"), F.lit(") "), F.coalesce("name", F.lit("")))
    line = F.when(F.col("parent").isNull(), root).when((F.lit(threshold) > 0) & (F.col("score") < threshold), stub).otherwise(child)
    return work.result(labelled.select("component", "sort_key", line.alias("line")))


def tree_report(tree: DataFrame, nodes: DataFrame, names: DataFrame, threshold: int = 0) -> DataFrame:
    """(line_no, line): the drawn trees under a head, and the nodes without a link under a line with their number.

    nodes has every node; names has node, id, name and length.
    """
    rule = "=" * 80
    drawn = numbered(ascii_tree(tree, names, threshold), [F.asc("component"), F.asc("sort_key")], rank="place").select((F.col("place") + 3).alias("line_no"), "line")
    root = largest_root(tree).select("node")
    links = tree.filter("parent is not null").agg(F.count("*").alias("links"))
    head = links.crossJoin(root).select(F.posexplode(F.array(F.format_string("Maximum Spanning Tree (root: node %d)", "node"), F.format_string("Total links: %d", "links"), F.lit(rule), F.lit(""))).alias("line_no", "line"))
    alone = isolated(nodes.select("node"), tree.select(F.col("node").alias("u"), F.col("node").alias("v"))).join(names, "node", "left")
    above = drawn.agg(F.coalesce(F.max("line_no"), F.lit(3)).alias("above"))
    count = alone.agg(F.count("*").alias("n")).filter("n > 0").crossJoin(above)  # one row each
    under = count.select("above", F.posexplode(F.array(F.lit(""), F.lit(rule), F.format_string("ISOLATED NODES (no connections): %d", "n"), F.lit("-" * 80))).alias("k", "line"))
    listed = numbered(alone.select("node", "name"), [F.asc("node")], rank="place").crossJoin(F.broadcast(above))
    listed = listed.select((F.col("above") + 4 + F.col("place")).alias("line_no"), F.concat(F.lit("Node "), F.col("node").cast("string"), F.lit(": "), F.coalesce("name", F.lit(""))).alias("line"))
    return head.select(F.col("line_no").cast("long"), "line").union(drawn).union(under.select((F.col("above") + 1 + F.col("k")).alias("line_no"), "line")).union(listed)


def to_json(tree: DataFrame) -> DataFrame:
    """(node, json): node, parent, score and children, best first, of each node as a JSON object."""
    place = F.struct((-F.col("score")).alias("minus"), F.col("node").alias("node"))
    below = tree.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_list(place)).alias("c"))
    below = below.select("node", F.transform("c", lambda s: s["node"]).alias("children"))
    record = F.struct("node", "parent", F.coalesce("score", F.lit(-1)).alias("score"), F.coalesce("children", F.array().cast("array<long>")).alias("children"))
    return tree.select("node", "parent", "score").join(below, "node", "left").select("node", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def report(tree: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(root, line_key, line): an indented line for each node, in depth-first order of line_key, the nodes from the root to it."""
    work = Workspace(tree.sparkSession, "report")
    tree = up_to_root(work, tree, {"path": (F.array("node"), lambda up, own: F.concat(up, own))})
    label = F.col("node").cast("string")
    if names is not None:
        tree = tree.join(names.select("node", "name"), "node", "left")
        label = F.concat_ws(" ", label, "name")
    depth = F.size("path") - 1
    mark = F.when(F.col("parent").isNull(), "").otherwise(F.concat(F.repeat(F.lit("   "), depth - 1), F.lit("+- ")))
    shown = F.when(F.col("parent").isNull(), label).otherwise(F.concat(label, F.lit(" ["), F.col("score").cast("string"), F.lit("]")))
    return work.result(tree.select("root", F.col("path").alias("line_key"), F.concat(mark, shown).alias("line")))
