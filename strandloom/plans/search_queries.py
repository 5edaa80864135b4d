"""Searches over whole passages and documents as sequences: joins, resumed runs, ranges, and what they still have to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import formats
from strandloom.functions.alphabet import letters_only, matrix32
from strandloom.operators import annotation, ordering, similarity
from strandloom.plans.annotation_queries import BRANDS, MUNGE_FILTER, explain_documents, munge_filter, part_records
from strandloom.plans.annotation_queries import PAIRS as EXPLAINED
from strandloom.plans.sequence_queries import PART_SEQUENCES, _local_scores, part_sequences
from strandloom.session import Workspace, scratch_folder, settled, table
from strandloom.sources.sequences import select_range

THRESHOLD = 110
#: Cells a second of the runs whose remaining time is said.
CELLS_PER_SECOND = 2_000_000


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's whole passages as sequences of some hundred letters."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("seq_no"), letters_only(F.col("text")).alias("sequence"))


PASSAGES = "seqs AS (SELECT item_id AS seq_no, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM benchmark)"


def long_scores(pairs: str, reach: int = 512) -> str:
    """DuckDB CTEs as _local_scores(), for longer sequences: what gaps leave of a row's cells is found by steps of 1, 2, 4, ... letters.

    Gaps of `reach` letters or more cost more than any score of such sequences.
    """
    matrix = "[" + ",".join(map(str, matrix32().ravel().tolist())) + "]"
    score = f"({matrix})[(ascii(substr(a, i + 1, 1)) & 31) * 32 + (ascii(substr(b, j, 1)) & 31) + 1]"
    row = f"SELECT q, t, a, b, i, best, list_transform(range(1, len(b) + 1), lambda j: greatest(0, (CASE WHEN j = 1 THEN 0 ELSE h[j - 1] END) + {score}, h[j] - 10)) AS e FROM dp WHERE i < len(a)"
    step = 1
    while step < reach:
        row = f"SELECT q, t, a, b, i, best, list_transform(range(1, len(e) + 1), lambda j: CASE WHEN j > {step} THEN greatest(e[j], e[j - {step}] - {10 * step}) ELSE e[j] END) AS e FROM ({row})"
        step *= 2
    return f"""
pairs AS ({pairs}),
dp AS (
  SELECT q, t, a, b, 0 AS i, list_transform(range(len(b)), lambda x: 0) AS h, 0 AS best FROM pairs
  UNION ALL
  SELECT q, t, a, b, i + 1, e, greatest(best, coalesce(list_max(e), 0)) FROM ({row})
),
scores AS (SELECT q AS query_seq, t AS target_seq, CAST(max(best) AS INT) AS score FROM dp GROUP BY q, t)"""


def sim_join_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of passages that score at least the threshold."""
    return similarity.similarity_join(passages(spark, sf_dir), THRESHOLD)


_ALL_PAIRS = "SELECT x.seq_no AS q, y.seq_no AS t, x.sequence AS a, y.sequence AS b FROM seqs x JOIN seqs y ON y.seq_no >= x.seq_no"
SIM_JOIN_PASSAGES = f"WITH RECURSIVE {PASSAGES}, {long_scores(_ALL_PAIRS)} SELECT * FROM scores WHERE score >= {THRESHOLD}"


def resumed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links from a run that stopped twice and was taken up again."""
    folder = scratch_folder(spark, "search")
    for stop in (2, 1, None):
        found = similarity.resumable_join(passages(spark, sf_dir), THRESHOLD, folder, waves=5, stop_after=stop, block_residues=2000)
    return settled(found, folder)


def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three part names, from the third on, against all part names."""
    seqs = part_sequences(spark, sf_dir)
    placed = ordering.numbered(seqs, [F.asc("seq_no")], rank="place").select((F.col("place") - 1).alias("seq_no"), F.col("seq_no").alias("id"), "sequence")
    return similarity.query_against(select_range(placed, 2, 3).drop("seq_no"), placed.drop("seq_no"), 30, id_col="id")


RANGE_SEARCH = f"""WITH RECURSIVE {PART_SEQUENCES}, chosen AS (SELECT * FROM seqs ORDER BY seq_no LIMIT 3 OFFSET 2),
{_local_scores("SELECT x.seq_no AS q, y.seq_no AS t, x.sequence AS a, y.sequence AS b FROM chosen x, seqs y")} SELECT * FROM scores WHERE score >= 30"""


def query_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first passage against every document's whole text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_no"), letters_only(F.coalesce("text", F.lit(""))).alias("sequence"))
    first = passages(spark, sf_dir).orderBy("seq_no").limit(1)
    return similarity.query_against(first, docs.repartition(spark.sparkContext.defaultParallelism), THRESHOLD)


def document_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments of the first passage with every whole document that it is linked to, by their ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), letters_only(F.coalesce("text", F.lit(""))).alias("sequence"))
    work = Workspace(spark, "alignments")
    pairs = work.keep(query_documents(spark, sf_dir).select(F.lit("passage").alias("id_a"), F.concat(F.lit("document "), F.col("target_seq").cast("string")).alias("id_b")))
    named = docs.select(F.concat(F.lit("document "), F.col("id").cast("string")).alias("id"), "sequence")
    first = passages(spark, sf_dir).orderBy("seq_no").limit(1).select(F.lit("passage").alias("id"), "sequence")
    return work.result(similarity.compared(pairs, named.union(first)))


def work_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part in the order of a run: residues and cells done with it in percent, cells left and the time they take."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.length("p_name").alias("length"))
    return ordering.work_estimates(parts, "p_partkey", "length", CELLS_PER_SECOND).select(
        "p_partkey", "length", F.round("residues_done", 6).alias("residues_done"), F.round("cells_done", 6).alias("cells_done"), F.col("cells_left").cast("long").alias("cells_left"), formats.duration(F.col("seconds_left")).alias("time_left")
    )


WORK_ESTIMATES = f"""
WITH lengths AS (SELECT p_partkey, len(p_name) AS length FROM part),
run AS (SELECT *, sum(length) OVER w AS upto, sum(length) OVER () AS total, length * (sum(length) OVER () - sum(length) OVER w + length) AS cells FROM lengths WINDOW w AS (ORDER BY length DESC, p_partkey ROWS UNBOUNDED PRECEDING)),
done AS (SELECT *, sum(cells) OVER () - sum(cells) OVER (ORDER BY length DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS rest FROM run),
s AS (SELECT *, CAST(floor(rest / {CELLS_PER_SECOND}) AS BIGINT) AS s FROM done)
SELECT p_partkey, length, round(100.0 * upto / total, 6) AS residues_done, round(100.0 * (1 - (1 - CAST(upto AS DOUBLE) / total) * (1 - CAST(upto AS DOUBLE) / total)), 6) AS cells_done, CAST(rest AS BIGINT) AS cells_left,
       CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' ELSE '' END || CASE WHEN s >= 3600 THEN (s // 3600 % 24) || 'h ' ELSE '' END
         || CASE WHEN s >= 60 THEN (s // 60 % 60) || 'm ' ELSE '' END || (s % 60) || 's' AS time_left
FROM s"""


def padding_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By block of sequences of like length: cells that padding to the longest adds, in percent of those computed."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_no"), letters_only(F.coalesce("text", F.lit(""))).alias("sequence"))
    return similarity.padding_waste(docs).select("bucket", "n", "residues", "padded", F.round("waste", 6).alias("waste"))


PADDING_WASTE = """
WITH s AS (SELECT len(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))) AS size FROM documents),
b AS (SELECT size, CAST(ceil(log2(greatest(size, 1)) * 2) AS INT) AS bucket FROM s)
SELECT bucket, count(*) AS n, CAST(sum(size) AS BIGINT) AS residues, CAST(count(*) * max(size) AS BIGINT) AS padded, round(CASE WHEN max(size) > 0 THEN 100.0 * (count(*) * max(size) - sum(size)) / (count(*) * max(size)) ELSE 0 END, 6) AS waste
FROM b GROUP BY bucket"""


def filter_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many part records the filter has seen and accepted, and the last ten accepted."""
    found, counters = annotation.watched_filter(part_records(spark, sf_dir), annotation.record_filter(BRANDS, require_go=True))
    work = Workspace(spark, "progress")
    accepted = work.keep(found.select("p_partkey", "description"))  # the one pass
    last = accepted.orderBy(F.desc("p_partkey")).limit(10).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%08d %s", "p_partkey", "description"))), "|").alias("last"))
    return work.result(last.select(F.lit(counters.get["seen"]).alias("seen"), F.lit(counters.get["accepted"]).alias("accepted"), "last"))


FILTER_PROGRESS = f"""WITH a AS ({MUNGE_FILTER})
SELECT (SELECT count(*) FROM part) AS seen, (SELECT count(*) FROM a) AS accepted,
       (SELECT string_agg(printf('%08d', p_partkey) || ' ' || description, '|' ORDER BY p_partkey) FROM (SELECT * FROM a ORDER BY p_partkey DESC LIMIT 10)) AS last"""


def reason_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By phase, how many pairs it explains and in percent of all; null for those that none does."""
    return annotation.phase_percentages(explain_documents(spark, sf_dir)).select("phase", "n", F.round("percent", 6).alias("percent"))


REASON_PERCENTAGES = f"WITH {EXPLAINED} SELECT phase, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM reasons), 6) AS percent FROM reasons GROUP BY phase"

QUERIES = {
    "sim_join_passages": sim_join_passages, "resumed_search": resumed_search, "range_search": range_search, "query_documents": query_documents, "document_alignments": document_alignments, "work_estimates": work_estimates,
    "padding_waste": padding_waste, "filter_progress": filter_progress, "reason_percentages": reason_percentages,
}
ORACLES = {
    "sim_join_passages": SIM_JOIN_PASSAGES, "resumed_search": SIM_JOIN_PASSAGES, "range_search": RANGE_SEARCH, "work_estimates": WORK_ESTIMATES, "padding_waste": PADDING_WASTE,
    "filter_progress": FILTER_PROGRESS, "reason_percentages": REASON_PERCENTAGES,
}
