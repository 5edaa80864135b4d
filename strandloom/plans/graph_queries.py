"""Forests, trees and components of graphs derived from orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import forest
from strandloom.operators.components import connected_components
from strandloom.session import scratch_folder, settled, table
from strandloom.streaming import jobs

STRONG = 80


def trade_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_seq, target_seq, score): line items traded between two nations, in both directions."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).filter("c_nationkey <> s_nationkey")
    a, b = F.least("c_nationkey", "s_nationkey").cast("long"), F.greatest("c_nationkey", "s_nationkey").cast("long")
    return lines.groupBy(a.alias("query_seq"), b.alias("target_seq")).agg(F.count("*").alias("score"))


TRADE_LINKS = """
links AS (
  SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS u, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS v, count(*) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL
)"""
# an edge is in the forest if its ends are not connected by better edges
TRADE_FOREST = f"""{TRADE_LINKS},
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, u, v) AS r FROM links),
ends AS (SELECT r, u AS x, v AS y FROM ranked UNION ALL SELECT r, v, u FROM ranked),
reach AS (
  SELECT r, u AS node FROM ranked
  UNION
  SELECT reach.r, ends.y FROM reach JOIN ends ON ends.x = reach.node AND ends.r < reach.r
),
forest AS (SELECT u, v, score FROM ranked WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.r = ranked.r AND reach.node = ranked.v))"""
TRADE_TREE = f"""{TRADE_FOREST},
sides AS (SELECT u AS x, v AS y, score FROM forest UNION ALL SELECT v, u, score FROM forest),
tree AS (
  SELECT node, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS BIGINT) AS score, [node] AS path FROM (SELECT min(u) AS node FROM forest)
  UNION ALL
  SELECT y, x, sides.score, list_append(path, y) FROM tree JOIN sides ON x = node WHERE y IS DISTINCT FROM parent
)"""


def forest_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.maximum_spanning_forest(trade_links(spark, sf_dir))


def trade_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.rooted(forest_nations(spark, sf_dir))


def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.children(trade_tree(spark, sf_dir)).select("parent", "node", "score", F.col("place").cast("long").alias("place"))


def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.descendants(trade_tree(spark, sf_dir))


def tree_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.largest_root(trade_tree(spark, sf_dir))


def tree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_name").alias("name"))
    out = forest.report(trade_tree(spark, sf_dir), names)
    return out.select("root", F.array_join(F.transform("line_key", lambda x: x.cast("string")), "/").alias("line_key"), "line")


def link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = trade_links(spark, sf_dir)
    return links.agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.max(F.greatest("query_seq", "target_seq")).alias("max_node"), F.max("score").alias("best"))


def supply_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, supplier, quantity) as links; suppliers are numbered from -1 down, apart from the parts."""
    lines = table(spark, sf_dir, "lineitem")
    ends = [F.col("l_partkey").alias("query_seq"), (-1 - F.col("l_suppkey")).alias("target_seq")]
    return lines.groupBy(*ends).agg(F.sum("l_quantity").cast("long").alias("score"))


SUPPLY_LINKS = "links AS (SELECT l_partkey AS u, -1 - l_suppkey AS v, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY ALL)"


def forest_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest of the whole part and supplier graph."""
    return forest.maximum_spanning_forest(supply_links(spark, sf_dir))


def supply_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of parts and suppliers linked by much quantity."""
    strong = supply_links(spark, sf_dir).filter(F.col("score") >= STRONG)
    return connected_components(strong, "query_seq", "target_seq")


SUPPLY_COMPONENTS = f"""WITH RECURSIVE {SUPPLY_LINKS},
strong AS (SELECT u, v FROM links WHERE score >= {STRONG} UNION ALL SELECT v, u FROM links WHERE score >= {STRONG}),
reach AS (SELECT DISTINCT u AS node, u AS seen FROM strong UNION SELECT reach.node, strong.v FROM reach JOIN strong ON strong.u = reach.seen)
SELECT node, min(seen) AS component FROM reach GROUP BY node"""


def isolated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without any strong link."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    strong = supply_links(spark, sf_dir).filter(F.col("score") >= STRONG)
    return forest.isolated(nodes, strong.select(F.col("query_seq").alias("u"), F.col("target_seq").alias("v")))


ISOLATED_PARTS = f"""WITH {SUPPLY_LINKS}
SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT u FROM links WHERE score >= {STRONG})"""


def forest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' forest again, kept over a stream of link files."""
    folder = scratch_folder(spark, "forest")
    links = trade_links(spark, sf_dir)
    links.repartition(3, "query_seq").write.parquet(f"{folder}/links")
    stream = spark.readStream.schema(links.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/links")
    query = jobs.forest_stream(stream, folder)
    query.awaitTermination()
    return settled(spark.read.parquet(f"{folder}/forest-{query.lastProgress['batchId']}"), folder)


def strong_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The forest's edges of average score or more, hung up, and a score that some of them lie under."""
    found = forest.maximum_spanning_forest(trade_links(spark, sf_dir))
    mean = found.agg(F.avg("score").alias("m"))  # one row
    strong = found.join(F.broadcast(mean), F.col("score") >= F.col("m")).select("u", "v", "score")
    return forest.rooted(strong), int(mean.first()["m"] or 0) + 2


def nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(key.alias("node"), F.col("n_name").alias("id"), F.format_string("in region %d", "n_regionkey").alias("name"), (key * 10).alias("length"))


def tree_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of strong trade as drawn lines, with stubs, further roots and nations without strong trade."""
    tree, threshold = strong_tree(spark, sf_dir)
    names = nation_names(spark, sf_dir)
    return forest.tree_report(tree, names, names, threshold)


_STRONG = f"""{TRADE_FOREST},
strong AS (SELECT * FROM forest WHERE score >= (SELECT avg(score) FROM forest)),
sides AS (SELECT u AS x, v AS y, score FROM strong UNION ALL SELECT v, u, score FROM strong),
reached AS (SELECT DISTINCT x AS node, x AS seen FROM sides UNION SELECT reached.node, y FROM reached JOIN sides ON x = seen),
roots AS (SELECT DISTINCT min(seen) OVER (PARTITION BY node) AS root FROM reached),
tree AS (
  SELECT root AS node, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS BIGINT) AS score, root FROM roots
  UNION ALL
  SELECT y, x, sides.score, root FROM tree JOIN sides ON x = node WHERE y IS DISTINCT FROM parent
),
placed AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, node) = count(*) OVER (PARTITION BY parent) AS last FROM tree WHERE parent IS NOT NULL),
sizes AS (SELECT root, count(*) AS n FROM tree GROUP BY root),
best AS (SELECT root FROM sizes ORDER BY n DESC, root LIMIT 1),
parts AS (SELECT root, 0 AS component FROM best UNION ALL SELECT root, row_number() OVER (ORDER BY root) + 1 FROM sizes WHERE root NOT IN (SELECT root FROM best))"""
_TREE_DRAWING = f"""WITH RECURSIVE {_STRONG},
cut AS (SELECT CAST(floor(avg(score)) AS BIGINT) + 2 AS least FROM forest),
drawn AS (
  SELECT root AS node, component, '' AS prefix, '' AS branch, [CAST(0 AS BIGINT), root] AS key, false AS stub,
         '0:' || n_name || ' Length:' || root * 10 || ' [ROOT ' || component || '] in region ' || n_regionkey || ' ' AS line
  FROM parts JOIN nation ON n_nationkey = root
  UNION ALL
  SELECT p.node, component, prefix || branch, CASE WHEN last THEN '   ' ELSE '│  ' END, list_concat(key, [-p.score, p.node]), p.score < least,
         CASE WHEN p.score < least THEN prefix || branch || CASE WHEN last THEN '└── ' ELSE '├── ' END || '[STUB: Node ' || p.node || ', score ' || p.score || ' < threshold]'
              ELSE (greatest(len(prefix || branch) - 40, 0) // 40 * 40) || ':' || substr(prefix || branch, greatest(len(prefix || branch) - 40, 0) // 40 * 40 + 1) || CASE WHEN last THEN '└─ ' ELSE '├─ ' END
                   || n_name || ' Length:' || p.node * 10 || ' (s:' || p.score || ') in region ' || n_regionkey END
  FROM drawn JOIN placed p ON p.parent = drawn.node JOIN nation ON n_nationkey = p.node, cut WHERE NOT stub
),
numbered AS (SELECT row_number() OVER (ORDER BY component, key) + 3 AS line_no, line FROM drawn),
alone AS (SELECT n_nationkey AS node, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT node FROM tree)),
top AS (SELECT coalesce(max(line_no), 3) AS above, (SELECT count(*) FROM alone) AS n FROM numbered)
SELECT CAST(k AS BIGINT) AS line_no, ['Maximum Spanning Tree (root: node ' || (SELECT root FROM best) || ')', 'Total links: ' || (SELECT count(*) FROM strong), repeat('=', 80), ''][k + 1] AS line FROM range(4) t(k)
UNION ALL SELECT * FROM numbered
UNION ALL SELECT above + 1 + k, ['', repeat('=', 80), 'ISOLATED NODES (no connections): ' || n, repeat('-', 80)][k + 1] FROM top, range(4) t(k) WHERE n > 0
UNION ALL SELECT above + 4 + row_number() OVER (ORDER BY node), 'Node ' || node || ': in region ' || n_regionkey FROM alone, top"""


def forest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trees of strong trade as a JSON object."""
    return forest.to_json(strong_tree(spark, sf_dir)[0])


_FOREST_JSON = f"""WITH RECURSIVE {_STRONG},
below AS (SELECT parent AS node, list(node ORDER BY score DESC, node) AS children FROM placed GROUP BY parent)
SELECT t.node, CAST(to_json({{'node': t.node, 'parent': parent, 'score': coalesce(score, -1), 'children': coalesce(children, CAST([] AS BIGINT[]))}}) AS VARCHAR) AS json FROM tree t LEFT JOIN below b ON b.node = t.node"""

QUERIES = {
    "tree_drawing": tree_drawing, "forest_json": forest_json,
    "forest_nations": forest_nations, "tree_children": tree_children, "tree_descendants": tree_descendants, "tree_root": tree_root, "tree_report": tree_report,
    "link_stats": link_stats, "forest_supply": forest_supply, "supply_components": supply_components, "isolated_parts": isolated_parts, "forest_stream": forest_stream,
}
_FOREST = f"WITH RECURSIVE {TRADE_FOREST} SELECT u, v, score FROM forest"
_DESCENDANTS = "SELECT node, count(*) - 1 AS descendants FROM (SELECT unnest(path) AS node FROM tree) GROUP BY node"
ORACLES = {
    "tree_drawing": _TREE_DRAWING, "forest_json": _FOREST_JSON,
    "forest_nations": _FOREST, "forest_stream": _FOREST,
    "tree_children": f"WITH RECURSIVE {TRADE_TREE} SELECT parent, node, score, row_number() OVER (PARTITION BY parent ORDER BY score DESC, node) AS place FROM tree WHERE parent IS NOT NULL",
    "tree_descendants": f"WITH RECURSIVE {TRADE_TREE} {_DESCENDANTS}",
    "tree_root": f"WITH RECURSIVE {TRADE_TREE}, sizes AS ({_DESCENDANTS}) SELECT * FROM sizes WHERE node IN (SELECT node FROM tree WHERE parent IS NULL) ORDER BY descendants DESC, node LIMIT 1",
    "tree_report": f"""WITH RECURSIVE {TRADE_TREE}
      SELECT path[1] AS root, array_to_string(path, '/') AS line_key,
             CASE WHEN parent IS NULL THEN node || ' ' || n_name ELSE repeat('   ', len(path) - 2) || '+- ' || node || ' ' || n_name || ' [' || score || ']' END AS line
      FROM tree JOIN nation ON n_nationkey = node""",
    "link_stats": f"WITH {TRADE_LINKS} SELECT count(*) AS n, CAST(sum(score) AS BIGINT) AS total, max(greatest(u, v)) AS max_node, max(score) AS best FROM links",
    "supply_components": SUPPLY_COMPONENTS, "isolated_parts": ISOLATED_PARTS,
}
