"""Taxonomy, geometry, format, integrity and streaming queries over orders, events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import formats, taxonomy
from strandloom.functions.taxonomy import HOUSEKEEPING
from strandloom.operators import geometry, integrity, patterns
from strandloom.session import scratch_folder, settled, table
from strandloom.sources.links import deduplicated, read_links
from strandloom.streaming import jobs

CUTOFF = 0.05
AMOUNT = 0.5
LAST = 10


def nation_lineages(spark: SparkSession, sf_dir: str, key: str, lineage: str) -> DataFrame:
    """Each nation's lineage: the world (0), its region (100 on) and itself (1000 on)."""
    nations = table(spark, sf_dir, "nation")
    ids = F.array(F.lit(0), F.col("n_regionkey") + 100, F.col("n_nationkey") + 1000)
    return nations.select(F.col("n_nationkey").alias(key), ids.alias(lineage))


def lineage_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traded parts by the class of customer's and supplier's nations: how many of each category, priority and reason."""
    t = lambda name: table(spark, sf_dir, name)
    text = F.concat_ws(" ", "p_name", F.when(F.col("p_size") < 10, "histone"))
    parts = t("part").select("p_partkey", taxonomy.is_housekeeping(text, F.col("p_type")).alias("dull"))
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    counted = lines.groupBy("c_nationkey", "s_nationkey", "dull").agg(F.count("*").alias("n"))  # before anything is said of a pair
    pairs = counted.join(nation_lineages(spark, sf_dir, "c_nationkey", "la"), "c_nationkey").join(nation_lineages(spark, sf_dir, "s_nationkey", "lb"), "s_nationkey")
    lca = taxonomy.common_ancestor(F.col("la"), F.col("lb"))
    rank = F.when(lca >= 1000, "species").when(lca >= 100, "phylum").when(lca == 0, "superkingdom")
    found = pairs.select(taxonomy.classify(rank, F.col("dull")).alias("c"), "n")
    return found.groupBy(F.col("c.category").alias("category"), F.col("c.priority").cast("long").alias("priority"), F.col("c.reason").alias("reason")).agg(F.sum("n").alias("n"))


LINEAGE_LCA = f"""
WITH lines AS (
  SELECT CASE WHEN n1.n_nationkey = n2.n_nationkey THEN 3 WHEN n1.n_regionkey = n2.n_regionkey THEN 2 ELSE 1 END AS depth,
         {' OR '.join(f"contains(lower(p_name || CASE WHEN p_size < 10 THEN ' histone' ELSE '' END || ' ' || p_type), '{w}')" for w in HOUSEKEEPING)} AS dull
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN nation n2 ON n2.n_nationkey = s_nationkey
)
SELECT CASE depth WHEN 1 THEN CASE WHEN dull THEN 'Deep Housekeeping' ELSE 'Deep Novelty' END WHEN 2 THEN CASE WHEN dull THEN 'Distant Homolog' ELSE 'High Value' END ELSE 'Close Relative' END AS category,
       CAST(CASE depth WHEN 1 THEN CASE WHEN dull THEN 4 ELSE 1 END WHEN 2 THEN CASE WHEN dull THEN 4 ELSE 2 END ELSE 5 END AS BIGINT) AS priority,
       CASE depth WHEN 1 THEN CASE WHEN dull THEN 'Deep divergence (superkingdom) but likely ortholog' ELSE 'Major Discovery: superkingdom separation, non-housekeeping' END
                  WHEN 2 THEN CASE WHEN dull THEN 'Common metabolic/structural gene' ELSE 'Inter-Phylum match (phylum)' END ELSE 'Likely paralog or recent speciation' END AS reason,
       count(*) AS n
FROM lines GROUP BY ALL"""


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as points: the first three components, with their label."""
    part = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", *part)


def near_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = geometry.near_pairs(vector_points(spark, sf_dir), CUTOFF, least_square=1e-6)
    return pairs.select("i", "j", F.round("distance_sq", 9).alias("distance_sq"))


NEAR_POINTS = f"""
WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
d AS (SELECT a.id AS i, b.id AS j, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) AS d FROM p a JOIN p b ON a.id < b.id)
SELECT i, j, round(d, 9) AS distance_sq FROM d WHERE d <= {CUTOFF} * CAST({CUTOFF} AS DOUBLE) AND d > 1e-6"""


def near_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds between near points whose smallest ring has five or six points."""
    return geometry.near_rings(vector_points(spark, sf_dir), CUTOFF, least_square=1e-6)


# steps from one end of a bond to the other without it; the fewest, and the bond, make its smallest ring
NEAR_RINGS = f"""
WITH RECURSIVE bonds AS (SELECT i, j FROM ({NEAR_POINTS})),
sides AS (SELECT i AS x, j AS y FROM bonds UNION ALL SELECT j, i FROM bonds),
walk AS (
  SELECT i, j, i AS here, 0 AS steps FROM bonds
  UNION
  SELECT walk.i, walk.j, y, steps + 1 FROM walk JOIN sides ON x = here WHERE steps < 5 AND here <> walk.j AND NOT (here = walk.i AND y = walk.j)
)
SELECT i, j, CAST(min(steps) + 1 AS INT) AS ring_size FROM walk WHERE here = j GROUP BY i, j HAVING min(steps) + 1 IN (5, 6)"""


def point_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda at: F.array(*[F.col("embedding")[at + i].cast("double") for i in range(3)])
    return table(spark, sf_dir, "embeddings").select("label", part(0).alias("a"), part(3).alias("b"))


def kabsch_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = geometry.superposition_sums(point_pairs(spark, sf_dir), ["label"])
    return sums.select("label", "n", *[F.round(c, 6).alias(c) for c in ("aa", "bb", "a0", "b0", "a0b0", "a1b2", "a2b1")])


KABSCH_SUMS = """
WITH p AS (SELECT label, list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[4:6], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)
SELECT label, count(*) AS n, round(sum(list_inner_product(a, a)), 6) AS aa, round(sum(list_inner_product(b, b)), 6) AS bb, round(sum(a[1]), 6) AS a0, round(sum(b[1]), 6) AS b0,
       round(sum(a[1] * b[1]), 6) AS a0b0, round(sum(a[2] * b[3]), 6) AS a1b2, round(sum(a[3] * b[2]), 6) AS a2b1
FROM p GROUP BY label"""


def kabsch_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The superposition of each label's point pairs, and the RMSD that applying it leaves."""
    pairs = point_pairs(spark, sf_dir)
    found = geometry.superpose(pairs, ["label"])
    moved = geometry.apply_transform(F.col("a"), F.col("transform"))
    square = sum(((moved[i] - F.col("b")[i]) * (moved[i] - F.col("b")[i]) for i in range(3)), F.lit(0.0))
    left = pairs.join(found, "label").groupBy("label").agg(F.round(F.sqrt(F.avg(square)), 6).alias("applied_rmsd"))
    return found.select("label", "n", F.round("transform.rmsd", 6).alias("rmsd")).join(left, "label")


def centred_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.scaled(vector_points(spark, sf_dir), ["label"], target=10.0)
    return found.select("label", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "radius", "factor")])


CENTRED_LABELS = """
WITH p AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY label),
r AS (SELECT p.label, cx, cy, cz, max(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) AS radius FROM p JOIN c ON p.label = c.label GROUP BY ALL)
SELECT label, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(radius, 6) AS radius, round(CASE WHEN radius > 0 THEN 10.0 / radius ELSE 1 END, 6) AS factor FROM r"""


def smooth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values smoothed along time."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return geometry.smoothed(events, ["user_id"], ["ts", "event_id"], ("value",), AMOUNT).select("event_id", F.round("smooth_value", 6).alias("smooth_value"))


SMOOTH_EVENTS = f"""
WITH n AS (SELECT event_id, value AS v, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT *, CASE WHEN (b - a) * (b - a) > 0 THEN least(greatest((v - a) * (b - a) / ((b - a) * (b - a)), 0), 1) ELSE 0 END AS t FROM n)
SELECT event_id, round(coalesce(v + {AMOUNT} * (a + t * (b - a) - v), v), 6) AS smooth_value FROM t"""


def integrity_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against what their line items say: line items that no order has, orders without any, and other states."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_linestatus").alias("status"))
    return integrity.zip_compare(orders, lines, "key", ["status"])


INTEGRITY_ZIP = """
WITH l AS (SELECT l_orderkey AS key, max(l_linestatus) AS status FROM lineitem GROUP BY ALL)
SELECT coalesce(o_orderkey, key) AS key,
       CASE WHEN key IS NULL THEN 'left only' WHEN o_orderkey IS NULL THEN 'right only' WHEN o_orderstatus IS DISTINCT FROM status THEN 'status differs' ELSE 'equal' END AS status
FROM orders FULL JOIN l ON o_orderkey = key"""


def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten events of each type."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    ranked = table(spark, sf_dir, "events").withColumn("place", F.row_number().over(w).cast("long"))
    return ranked.filter(F.col("place") <= LAST).select("event_type", "place", "event_id", "user_id")


LAST_EVENTS = f"""
SELECT event_type, place, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= {LAST}"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines."""
    prefix = F.when(F.col("event_type") == "click", "HIT: ").when(F.col("event_type") == "view", "STEP: ").when(F.col("event_type") == "error", "STATS: ").otherwise("")
    line = F.concat(prefix, F.col("user_id").cast("string"), F.lit(" "), "event_type")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq_no"), line.alias("line"))


LOG_LINES = """
lines AS (SELECT event_id AS seq_no, CASE event_type WHEN 'click' THEN 'hit' WHEN 'view' THEN 'step' WHEN 'error' THEN 'stats' ELSE 'other' END AS category,
          CASE event_type WHEN 'click' THEN 'HIT: ' WHEN 'view' THEN 'STEP: ' WHEN 'error' THEN 'STATS: ' ELSE '' END || user_id || ' ' || event_type AS line FROM events)"""


def log_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir)
    counts = lines.groupBy(formats.line_category(F.col("line")).alias("category")).agg(F.count("*").alias("n"))
    latest = jobs.last_by_category(lines, n=LAST)
    return counts.join(latest, "category").select("category", "n", F.array_join("lines", "|").alias("latest"))


LOG_CATEGORIES = f"""
WITH {LOG_LINES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq_no DESC) AS place FROM lines)
SELECT category, count(*) AS n, string_agg(line, '|' ORDER BY seq_no) FILTER (place <= {LAST}) AS latest FROM ranked GROUP BY category"""


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same last lines, kept over a stream of line files."""
    folder = scratch_folder(spark, "log")
    lines = log_lines(spark, sf_dir)
    lines.repartition(3, "seq_no").write.parquet(f"{folder}/lines")
    query = jobs.log_stream(spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/lines"), folder, n=LAST)
    query.awaitTermination()
    return settled(jobs.last_lines(spark, folder), folder)


LOG_STREAM = f"""WITH {LOG_LINES} SELECT category, seq_no, line FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq_no DESC) AS place FROM lines) WHERE place <= {LAST}"""


def stream_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts and sums by type over the stream of events; NaN and null values are skipped."""
    events = jobs.event_stream(spark, sf_dir)
    good = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    sums = events.groupBy("event_type").agg(F.count("*").alias("records"), F.count(good).alias("n"), F.sum(F.round(good * 100).cast("long")).alias("hundredths"))
    folder = scratch_folder(spark, "sums")
    return settled(jobs.run_available(sums, folder), folder)


STREAM_SUMS = """
SELECT event_type, count(*) AS records, count(value) FILTER (NOT isnan(value)) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (NOT isnan(value)) AS BIGINT) AS hundredths
FROM events GROUP BY event_type"""


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type over the stream so far. All windows are put out each time, so none is closed and no event is late."""
    events = jobs.event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    counts = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    folder = scratch_folder(spark, "windows")
    out = jobs.run_available(counts, folder)
    return settled(out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n"), folder)


WINDOWED_EVENTS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL"


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that end after twelve hours without an event."""
    sessions = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


EVENT_SESSIONS = """
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOURS, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session"""


def ship_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By priority, line items shipped within sixty days of their order."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    met = formats.overlaps(F.col("l_shipdate"), F.col("l_shipdate"), F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 60 days"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter(met).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


SHIP_OVERLAPS = """
SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAYS GROUP BY ALL"""


def scalar_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the formats of reports: numbers, durations, dates and split comments."""
    day = F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy"))
    parts = formats.comment_parts(F.regexp_replace("o_orderpriority", "-", ": "))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", formats.with_commas(F.col("o_orderkey") * 1009).alias("commas"), formats.duration(F.col("o_orderkey") * 61).alias("duration"),
        formats.iso_date(day).alias("day"), parts["type"].alias("type"), parts["text"].alias("text"),
    )


SCALAR_FORMATS = """
WITH o AS (SELECT *, o_orderkey * 61 AS s FROM orders)
SELECT o_orderkey, format('{:,}', o_orderkey * 1009) AS commas,
       CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' ELSE '' END || CASE WHEN s >= 3600 THEN (s // 3600 % 24) || 'h ' ELSE '' END
         || CASE WHEN s >= 60 THEN (s // 60 % 60) || 'm ' ELSE '' END || (s % 60) || 's' AS duration,
       strftime(o_orderdate, '%Y-%m-%d') AS day, split_part(o_orderpriority, '-', 1) AS type, substr(o_orderpriority, instr(o_orderpriority, '-') + 1) AS text
FROM o"""


def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as nested records with region and suppliers."""
    t = lambda name: table(spark, sf_dir, name)
    suppliers = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_name")).alias("suppliers"))
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(suppliers, "n_nationkey", "left")
    record = F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).alias("region"), F.coalesce("suppliers", F.array().cast("array<string>")).alias("suppliers"))
    return nations.select("n_nationkey", F.to_json(record).alias("json"))


RECORD_JSON = """
WITH s AS (SELECT s_nationkey, list(s_name ORDER BY s_name) AS suppliers FROM supplier GROUP BY ALL)
SELECT n_nationkey, CAST(to_json({'name': n_name, 'region': {'key': r_regionkey, 'name': r_name}, 'suppliers': coalesce(suppliers, [])}) AS VARCHAR) AS json
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN s ON s_nationkey = n_nationkey"""


def resumed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of parts and suppliers without repeats."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("query_seq"), F.col("l_suppkey").alias("target_seq"), F.lit(1).alias("score"))
    return deduplicated(links)


RESUMED_LINKS = "SELECT DISTINCT l_partkey AS query_seq, l_suppkey AS target_seq, 1 AS score FROM lineitem"


def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty customers, as a listing shows them."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(20)


FIRST_PAGE = "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20"

def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type over the stream, of the hours that are closed: a day before the last event seen, so later ones are dropped."""
    folder = scratch_folder(spark, "closed")
    events = jobs.event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    counts = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = jobs.append_available(counts, folder)
    return settled(out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n"), folder)


CLOSED_WINDOWS = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL"""


def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user over the stream, once they are closed."""
    folder = scratch_folder(spark, "sessions")
    events = jobs.event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    sessions = events.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    out = jobs.append_available(sessions, folder)
    return settled(out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"), folder)


CLOSED_SESSIONS = """
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOURS, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session
HAVING max(ts) + INTERVAL 12 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""


def flushed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by way of a stream that is flushed each second, stopped, and taken up again, read back from its files."""
    folder = scratch_folder(spark, "flush")
    lines = table(spark, sf_dir, "lineitem")
    links = lines.groupBy(F.col("l_partkey").alias("query_seq"), F.col("l_suppkey").alias("target_seq")).agg(F.count("*").cast("int").alias("score"))
    for part in range(2):
        links.filter(F.col("query_seq") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        query = jobs.flush_links(spark.readStream.schema(links.schema).parquet(f"{folder}/in"), folder, "1 second")
        query.processAllAvailable()
        query.stop()
    return settled(deduplicated(read_links(spark, f"{folder}/links")), folder)


FLUSHED_LINKS = "SELECT l_partkey AS query_seq, l_suppkey AS target_seq, CAST(count(*) AS INT) AS score FROM lineitem GROUP BY ALL"


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as species of their regions; the last region has a root of its own."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("long")
    roots = t("region").select((F.when(F.col("r_regionkey") == 4, 2).otherwise(1)).cast("long").alias("taxid"), none.alias("parent"), F.lit("root").alias("rank")).distinct()
    regions = t("region").select((F.col("r_regionkey") + 100).cast("long").alias("taxid"), F.when(F.col("r_regionkey") == 4, 2).otherwise(1).cast("long").alias("parent"), F.lit("phylum").alias("rank"))
    nations = t("nation").select((F.col("n_nationkey") + 1000).cast("long").alias("taxid"), (F.col("n_regionkey") + 100).cast("long").alias("parent"), F.lit("species").alias("rank"))
    return roots.union(regions).union(nations)


def taxonomy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers in pairs by the class of their taxa; some taxa are unknown, and some share no ancestor."""
    lines = taxonomy.lineages(taxa(spark, sf_dir))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_nationkey") + 1000).cast("long").alias("tb"), "s_name")
    n = suppliers.count()
    customers = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 50 == 7, 9999).otherwise(F.col("c_nationkey") + 1000).cast("long").alias("ta"), (F.col("c_custkey") % n).alias("key"), "c_mktsegment")
    pairs = customers.join(suppliers, "key")
    of = lambda end: lines.select(F.col("taxid").alias(f"t{end}"), F.col("lineage").alias(f"l{end}"))
    ranks = lines.agg(F.map_from_entries(F.collect_list(F.struct("taxid", "rank"))).alias("ranks"))  # of a taxonomy, which is small
    met = pairs.join(of("a"), "ta", "left").join(of("b"), "tb", "left").crossJoin(F.broadcast(ranks))
    dull = taxonomy.is_housekeeping(F.when(F.col("c_mktsegment") == "MACHINERY", "a kinase").otherwise("x"), F.col("s_name"))
    found = met.select(taxonomy.classify(taxonomy.ancestor_rank(F.col("la"), F.col("lb"), F.col("ranks")), dull).alias("c"))
    return found.groupBy(F.col("c.category").alias("category"), F.col("c.priority").cast("long").alias("priority"), F.col("c.reason").alias("reason")).agg(F.count("*").alias("n"))


TAXONOMY_PAIRS = """
WITH pairs AS (
  SELECT c_custkey % 50 = 7 AS unknown, c_mktsegment = 'MACHINERY' AS dull, n1.n_nationkey = n2.n_nationkey AS same, n1.n_regionkey = n2.n_regionkey AS near, (n1.n_regionkey = 4) = (n2.n_regionkey = 4) AS joined
  FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier) JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN nation n2 ON n2.n_nationkey = s_nationkey
), ranked AS (SELECT dull, CASE WHEN unknown THEN 'error' WHEN same THEN 'species' WHEN near THEN 'phylum' WHEN joined THEN 'root' ELSE 'no rank' END AS rank FROM pairs)
SELECT CASE rank WHEN 'error' THEN 'TaxID Error' WHEN 'species' THEN 'Close Relative' WHEN 'phylum' THEN CASE WHEN dull THEN 'Distant Homolog' ELSE 'High Value' END ELSE CASE WHEN dull THEN 'Deep Housekeeping' ELSE 'Deep Novelty' END END AS category,
       CAST(CASE rank WHEN 'error' THEN 5 WHEN 'species' THEN 5 WHEN 'phylum' THEN CASE WHEN dull THEN 4 ELSE 2 END ELSE CASE WHEN dull THEN 4 ELSE 1 END END AS BIGINT) AS priority,
       CASE rank WHEN 'error' THEN 'Invalid TaxID' WHEN 'species' THEN 'Likely paralog or recent speciation' WHEN 'phylum' THEN CASE WHEN dull THEN 'Common metabolic/structural gene' ELSE 'Inter-Phylum match (phylum)' END
                 ELSE CASE WHEN dull THEN 'Deep divergence (' || rank || ') but likely ortholog' ELSE 'Major Discovery: ' || rank || ' separation, non-housekeeping' END END AS reason, count(*) AS n
FROM ranked GROUP BY ALL"""


def taxon_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every taxon's rank and path from its root."""
    return taxonomy.lineages(taxa(spark, sf_dir)).select("taxid", "rank", F.array_join(F.transform("lineage", lambda x: x.cast("string")), "/").alias("lineage"))


TAXON_LINEAGES = """
WITH r AS (SELECT r_regionkey AS k, CASE WHEN r_regionkey = 4 THEN 2 ELSE 1 END AS root FROM region)
SELECT DISTINCT CAST(root AS BIGINT) AS taxid, 'root' AS rank, CAST(root AS VARCHAR) AS lineage FROM r
UNION ALL SELECT k + 100, 'phylum', root || '/' || (k + 100) FROM r UNION ALL SELECT n_nationkey + 1000, 'species', root || '/' || (k + 100) || '/' || (n_nationkey + 1000) FROM nation JOIN r ON k = n_regionkey"""


def vector_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of every vector, three components a point, beside the points turned by a quarter and moved."""
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1), lambda k: F.array(*[F.try_element_at("embedding", k * 3 + i + 1).cast("double") for i in range(3)]))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(points).alias("a"))
    return rows.withColumn("b", F.array(1 - F.col("a")[1], 2 + F.col("a")[0], 3 + F.col("a")[2]))


def superposition_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The superposition of every vector's points on the turned ones, as JSON objects."""
    found = geometry.superpose(vector_turns(spark, sf_dir), ["vec_id"])
    name = lambda end: F.concat(F.lit(end), F.col("vec_id").cast("string"))
    return found.select("vec_id", geometry.superposition_json(name("A"), name("B"), F.col("transform"), 5).alias("json"))


SUPERPOSITION_JSON = """
SELECT vec_id, CAST(to_json({'protein_A': 'A' || vec_id, 'protein_B': 'B' || vec_id, 'rmsd': CAST(0 AS DOUBLE), 'rotation_matrix': [[0.0::DOUBLE, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], 'translation_vector': [1.0::DOUBLE, 2.0, 3.0]}) AS VARCHAR) AS json
FROM embeddings"""


def interval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items of every order as intervals, laid out in two rows."""
    start = F.unix_date(F.col("l_shipdate").cast("date"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end")).alias("i"))
    laid = rows.groupBy("l_orderkey").agg(F.collect_list("i").alias("i"))  # the few of an order
    return laid.select("l_orderkey", F.array_join(F.transform(patterns.two_rows(F.col("i")), lambda x: x.cast("string")), "").alias("rows"))


INTERVAL_ROWS = """
WITH i AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS s, CAST(l_quantity AS INT) AS q FROM lineitem),
l AS (SELECT l_orderkey, list_sort(list({'s': s, 'e': CAST(s + q AS DOUBLE), 'e0': CAST(-1e30 AS DOUBLE), 'e1': CAST(-1e30 AS DOUBLE), 'rows': ''})) AS items FROM i GROUP BY l_orderkey),
r AS (SELECT l_orderkey, list_reduce(list_prepend({'s': CAST(0 AS BIGINT), 'e': CAST(0 AS DOUBLE), 'e0': CAST(-1e30 AS DOUBLE), 'e1': CAST(-1e30 AS DOUBLE), 'rows': ''}, items),
  lambda a, x: {'s': x.s, 'e': x.e, 'e0': CASE WHEN a.e0 <= a.e1 THEN x.e ELSE a.e0 END, 'e1': CASE WHEN a.e0 <= a.e1 THEN a.e1 ELSE x.e END, 'rows': a.rows || CASE WHEN a.e0 <= a.e1 THEN '0' ELSE '1' END}) AS z FROM l)
SELECT l_orderkey, z.rows AS rows FROM r"""

QUERIES = {
    "closed_windows": closed_windows, "closed_sessions": closed_sessions, "flushed_links": flushed_links, "taxonomy_pairs": taxonomy_pairs, "taxon_lineages": taxon_lineages,
    "superposition_json": superposition_json, "interval_rows": interval_rows,
    "lineage_lca": lineage_lca, "near_points": near_points, "near_rings": near_rings, "kabsch_sums": kabsch_sums, "kabsch_rmsd": kabsch_rmsd, "centred_labels": centred_labels,
    "smooth_events": smooth_events, "integrity_zip": integrity_zip, "last_events": last_events, "log_categories": log_categories, "log_stream": log_stream,
    "stream_sums": stream_sums, "windowed_events": windowed_events, "event_sessions": event_sessions, "ship_overlaps": ship_overlaps, "scalar_formats": scalar_formats,
    "record_json": record_json, "resumed_links": resumed_links, "first_page": first_page,
}
ORACLES = {
    "closed_windows": CLOSED_WINDOWS, "closed_sessions": CLOSED_SESSIONS, "flushed_links": FLUSHED_LINKS, "taxonomy_pairs": TAXONOMY_PAIRS, "taxon_lineages": TAXON_LINEAGES,
    "superposition_json": SUPERPOSITION_JSON, "interval_rows": INTERVAL_ROWS,
    "lineage_lca": LINEAGE_LCA, "near_points": NEAR_POINTS, "near_rings": NEAR_RINGS, "kabsch_sums": KABSCH_SUMS, "centred_labels": CENTRED_LABELS, "smooth_events": SMOOTH_EVENTS,
    "integrity_zip": INTEGRITY_ZIP, "last_events": LAST_EVENTS, "log_categories": LOG_CATEGORIES, "log_stream": LOG_STREAM, "stream_sums": STREAM_SUMS,
    "windowed_events": WINDOWED_EVENTS, "event_sessions": EVENT_SESSIONS, "ship_overlaps": SHIP_OVERLAPS, "scalar_formats": SCALAR_FORMATS,
    "record_json": RECORD_JSON, "resumed_links": RESUMED_LINKS, "first_page": FIRST_PAGE,
}
