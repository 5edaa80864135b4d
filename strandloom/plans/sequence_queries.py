"""Similarity, alignment, composition and pattern queries over part names and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import alignment, bias
from strandloom.functions.alphabet import CHEMICAL_ORDER, letters_only, matrix32
from strandloom.operators import integrity, ordering, patterns, similarity
from strandloom.session import Workspace, spread, table
from strandloom.sources.sequences import first_containing, subsequence

THRESHOLD = 30
PERIODS = (2, 3)


def part_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names as sequences (seq_no, name, sequence), numbered by their least part key."""
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("seq_no"))
    return parts.select("seq_no", "name", letters_only(F.col("name")).alias("sequence"))


PART_SEQUENCES = """
seqs AS (SELECT min(p_partkey) AS seq_no, p_name AS name, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS sequence FROM part GROUP BY p_name)"""


def _local_scores(pairs: str) -> str:
    """DuckDB CTEs: local scores (query_seq, target_seq, score) of a relation pairs(q, t, a, b), one step a residue of a."""
    matrix = "[" + ",".join(map(str, matrix32().ravel().tolist())) + "]"
    score = f"({matrix})[(ascii(substr(a, i + 1, 1)) & 31) * 32 + (ascii(substr(b, j, 1)) & 31) + 1]"
    reach = "list_transform(range(1, len(b) + 1), lambda j: greatest(0, (CASE WHEN j = 1 THEN 0 ELSE h[j - 1] END) + " + score + ", h[j] - 10))"
    row = "list_transform(range(1, len(e) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: e[k] - 10 * (j - k))))"
    return f"""
pairs AS ({pairs}),
dp AS (
  SELECT q, t, a, b, 0 AS i, list_transform(range(len(b)), lambda x: 0) AS h, 0 AS best FROM pairs
  UNION ALL
  SELECT q, t, a, b, i + 1, h2, greatest(best, coalesce(list_max(h2), 0)) FROM (
    SELECT q, t, a, b, i, best, {row} AS h2 FROM (SELECT q, t, a, b, i, best, {reach} AS e FROM dp WHERE i < len(a)) r
  ) s
),
scores AS (SELECT q AS query_seq, t AS target_seq, CAST(max(best) AS INT) AS score FROM dp GROUP BY q, t)"""


def sim_join_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similarity_join(part_sequences(spark, sf_dir), THRESHOLD)


_ALL_PAIRS = "SELECT x.seq_no AS q, y.seq_no AS t, x.sequence AS a, y.sequence AS b FROM seqs x JOIN seqs y ON y.seq_no >= x.seq_no"
SIM_JOIN_PARTS = f"WITH RECURSIVE {PART_SEQUENCES}, {_local_scores(_ALL_PAIRS)} SELECT * FROM scores WHERE score >= {THRESHOLD}"


def sim_query_vs_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part's name against the names of all parts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq_no"), letters_only(F.col("p_name")).alias("sequence"))
    return similarity.query_against(parts.orderBy("seq_no").limit(1), parts, THRESHOLD)


SIM_QUERY_VS_DB = f"""WITH RECURSIVE
seqs AS (SELECT p_partkey AS seq_no, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS sequence FROM part),
{_local_scores("SELECT x.seq_no AS q, y.seq_no AS t, x.sequence AS a, y.sequence AS b FROM seqs x JOIN seqs y ON x.seq_no = (SELECT min(seq_no) FROM seqs)")}
SELECT * FROM scores WHERE score >= {THRESHOLD}"""


def find_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between different names with both names and lengths, as in a find report."""
    seqs = part_sequences(spark, sf_dir)
    links = similarity.similarity_join(seqs, THRESHOLD, include_self=False)
    found = similarity.with_names(links, seqs)
    size = lambda c: F.length(letters_only(F.col(c))).cast("long")
    return found.select("query_seq", "target_seq", "score", "name1", "name2", size("name1").alias("len1"), size("name2").alias("len2"))


FIND_NAMES = f"""WITH RECURSIVE {PART_SEQUENCES}, {_local_scores(_ALL_PAIRS)}
SELECT query_seq, target_seq, score, x.name AS name1, y.name AS name2, len(x.sequence) AS len1, len(y.sequence) AS len2
FROM scores JOIN seqs x ON x.seq_no = query_seq JOIN seqs y ON y.seq_no = target_seq WHERE score >= {THRESHOLD} AND query_seq <> target_seq"""


def align_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments, identities and bias of all links between different part names."""
    seqs = part_sequences(spark, sf_dir)
    links = similarity.similarity_join(seqs, THRESHOLD, include_self=False)
    a, b = (seqs.select(F.col("seq_no").alias(end), F.col("sequence").alias(s)) for end, s in (("query_seq", "a"), ("target_seq", "b")))
    aligned = links.join(a, "query_seq").join(b, "target_seq").withColumn("x", alignment.sw_align()("a", "b"))
    top, bottom = F.col("x.aligned_a"), F.col("x.aligned_b")
    judged = bias.assess(top, bottom)
    return aligned.select(
        "query_seq", "target_seq", F.col("x.score").alias("score"), top.alias("aligned_a"), alignment.match_line(top, bottom).alias("match_line"), bottom.alias("aligned_b"),
        F.col("x.a_start").alias("a_start"), F.col("x.b_start").alias("b_start"), F.round(alignment.identity_percent(top, bottom), 6).alias("identity"),
        F.round(alignment.identity_percent(top, bottom, ungapped=True), 6).alias("ungapped_identity"),
        F.round(judged["goodness"], 6).alias("goodness"), judged["reason"].alias("reason"),
    )


def alignment_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the alignments of linked part names, in SQL: a lateral join with the table function."""
    alignment.register(spark)
    work = Workspace(spark, "columns")
    seqs = part_sequences(spark, sf_dir)
    links = work.keep(similarity.similarity_join(seqs, THRESHOLD, include_self=False))
    return work.result(spark.sql(
        """SELECT l.query_seq, l.target_seq, c.place, c.residue_a, c.residue_b, c.mark
           FROM {links} l JOIN {seqs} a ON a.seq_no = l.query_seq JOIN {seqs} b ON b.seq_no = l.target_seq, LATERAL align_columns(a.sequence, b.sequence) c""", links=links, seqs=seqs,
    ))


def identity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match line and identity of names of equal length as they stand, first with all others of its length."""
    names = part_sequences(spark, sf_dir).withColumn("n", F.length("sequence"))
    first = names.groupBy("n").agg(F.min(F.struct("seq_no", "sequence")).alias("f")).select("n", F.col("f.seq_no").alias("first_no"), F.col("f.sequence").alias("first"))
    pairs = names.join(first, "n").filter("seq_no <> first_no")
    a, b = F.col("first"), F.col("sequence")
    return pairs.select("first_no", "seq_no", alignment.match_line(a, b).alias("match_line"), F.round(alignment.identity_percent(a, b), 6).alias("identity"))


IDENTITY_NAMES = f"""WITH {PART_SEQUENCES},
firsts AS (SELECT len(sequence) AS n, arg_min(sequence, seq_no) AS first, min(seq_no) AS first_no FROM seqs GROUP BY ALL),
pairs AS (SELECT first_no, seq_no, first, sequence FROM seqs JOIN firsts ON len(sequence) = n AND seq_no <> first_no),
lines AS (SELECT first_no, seq_no, array_to_string(list_transform(range(1, len(first) + 1), lambda i: CASE WHEN first[i] = sequence[i] THEN '|' ELSE '.' END), '') AS match_line FROM pairs)
SELECT *, round(100.0 * len(replace(match_line, '.', '')) / len(match_line), 6) AS identity FROM lines"""


def bias_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters, entropy and commonest letter of every document's whole text; counted without taking texts apart."""
    counts = patterns.letter_counts(F.lower(F.coalesce("text", F.lit(""))))
    counted = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array(*[F.struct(n.cast("long").alias("n"), F.lit(c).alias("c")) for c, n in counts.items()]).alias("k"))
    total = F.aggregate("k", F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    present = F.filter("k", lambda s: s["n"] > 0)
    bits = bias.entropy(F.transform(present, lambda s: s["n"]), total)
    top = F.array_min(F.transform(present, lambda s: F.struct((-s["n"]).alias("minus"), s["c"].alias("c"))))
    out = counted.select("doc_id", total.alias("letters"), F.size(present).cast("long").alias("kinds"), F.round(bits, 6).alias("entropy"), top["c"].alias("top_letter"), (-top["minus"]).alias("top_count"))
    return out


BIAS_ENTROPY = """
WITH letters AS (
  SELECT doc_id, c, len(lower(text)) - len(replace(lower(text), c, '')) AS n FROM documents, (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS c)
), present AS (SELECT * FROM letters WHERE n > 0),
totals AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS letters, count(*) AS kinds FROM present GROUP BY doc_id),
found AS (
  SELECT p.doc_id, letters, kinds, round(0.0 - sum(n / letters * log2(n / letters)), 6) AS entropy, arg_min(c, (-n, c)) AS top_letter, max(n) AS top_count
  FROM present p JOIN totals t ON p.doc_id = t.doc_id GROUP BY ALL
)
SELECT d.doc_id, coalesce(letters, 0) AS letters, coalesce(kinds, 0) AS kinds, coalesce(entropy, 0.0) AS entropy, top_letter, top_count
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id"""


def length_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.length_ranks(table(spark, sf_dir, "documents"), "doc_id", F.length("text"))


LENGTH_RANK = """
SELECT doc_id, len(text) AS length, row_number() OVER (ORDER BY len(text) DESC NULLS LAST, doc_id) - 1 AS sorted_position FROM documents"""


def inverse_index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.is_permutation(length_rank(spark, sf_dir), "sorted_position")


INVERSE_INDEX_CHECK = f"""
SELECT count(*) = count(DISTINCT sorted_position) AND min(sorted_position) = 0 AND max(sorted_position) = count(*) - 1 AS is_permutation FROM ({LENGTH_RANK})"""


def work_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.length("p_name").alias("length"))
    return ordering.work_left(parts, "p_partkey", "length").withColumn("cells_left", F.col("cells_left").cast("long"))


WORK_LEFT = """
WITH lengths AS (SELECT p_partkey, len(p_name) AS length FROM part),
cells AS (SELECT *, length * sum(length) OVER (ORDER BY length DESC, p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cells FROM lengths)
SELECT p_partkey, length, CAST(sum(cells) OVER (ORDER BY length DESC, p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS cells_left FROM cells"""


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.length_stats(table(spark, sf_dir, "documents"), "text")


LENGTH_STATS = """
SELECT count(text) AS n, CAST(sum(len(text)) AS BIGINT) AS total, round(avg(len(text)), 6) AS mean,
       CAST(min(len(text)) AS INT) AS shortest, CAST(max(len(text)) AS INT) AS longest FROM documents"""


def sorted_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.out_of_order(table(spark, sf_dir, "documents"), ["source"], "doc_id", "n_chars")


SORTED_CHECK = """
SELECT source, CAST(coalesce(sum(CAST(up AS BIGINT)), 0) AS BIGINT) AS breaks FROM (
  SELECT source, n_chars > lag(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS up FROM documents
) GROUP BY source"""


def periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best exact period from each place of each distinct part name on."""
    seqs = part_sequences(spark, sf_dir)
    places = seqs.select("seq_no", "sequence", F.posexplode(F.split("sequence", "")).alias("place", "residue"))
    found = places.withColumn("p", patterns.period_at(F.col("sequence"), F.col("place"), PERIODS))
    return found.select("seq_no", "place", F.col("p.period").alias("period"), F.round("p.score", 6).alias("score"))


def _period_sql(periods=PERIODS) -> str:
    ctes = ["places AS (SELECT seq_no, sequence, unnest(range(len(sequence))) AS place FROM seqs)", "b0 AS (SELECT *, 0 AS period, CAST(0 AS DOUBLE) AS score FROM places)"]
    for n, p in enumerate(periods):
        tests = [(k, k + arm * p) for k in range(p) for arm in (1, 2)]
        hit = " + ".join(f"CASE WHEN place + {j} < len(sequence) AND sequence[place + {i + 1}] = sequence[place + {j + 1}] THEN 1.0 ELSE 0.0 END" for i, j in tests)
        all_ = " + ".join(f"CASE WHEN place + {j} < len(sequence) THEN 1 ELSE 0 END" for _, j in tests)
        ctes.append(f"s{n} AS (SELECT *, CASE WHEN ({all_}) > 0 THEN CAST({hit} AS DOUBLE) / ({all_}) ELSE 0 END AS new FROM b{n})")
        ctes.append(f"b{n + 1} AS (SELECT seq_no, sequence, place, CASE WHEN new > score * 1.1 THEN {p} ELSE period END AS period, CASE WHEN new > score * CAST(1.1 AS DOUBLE) THEN new ELSE score END AS score FROM s{n})")
    return f"WITH {PART_SEQUENCES}, {', '.join(ctes)} SELECT seq_no, CAST(place AS INT) AS place, CAST(period AS INT) AS period, round(score, 6) AS score FROM b{len(periods)}"


#: A repeat is shown where its score is at least this: for equal residues, and where like ones count in part.
EXACT_LEAST, CHEMICAL_LEAST = 0.5, 0.6


def repeat_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeat that begins at each place of each distinct part name, with its unit in canonical rotation."""
    seqs = part_sequences(spark, sf_dir)
    places = seqs.select("seq_no", "sequence", F.posexplode(F.split("sequence", "")).alias("place", "residue"))
    found = places.withColumn("p", patterns.period_at(F.col("sequence"), F.col("place"))).filter(F.col("p.score") >= EXACT_LEAST)
    unit = F.substring("sequence", F.col("place") + 1, F.col("p.period"))
    return found.select("seq_no", "place", F.col("p.period").alias("period"), F.round("p.score", 6).alias("score"), unit.alias("unit"), patterns.canonical_rotation(unit).alias("rotation"))


REPEAT_UNITS = f"""
WITH found AS (SELECT x.*, sequence FROM ({_period_sql(patterns.PERIODS)}) x JOIN (WITH {PART_SEQUENCES} SELECT * FROM seqs) s ON s.seq_no = x.seq_no WHERE score >= {EXACT_LEAST}),
units AS (SELECT seq_no, place, period, score, sequence[place + 1 : place + period] AS unit FROM found),
turned AS (SELECT *, unit[i + 1:] || unit[1:i] AS t FROM (SELECT *, unnest(range(len(unit))) AS i FROM units)),
keyed AS (SELECT *, list_transform(string_split(t, ''), lambda r: greatest(instr('{CHEMICAL_ORDER}', r) - 1, 0)) AS k FROM turned)
SELECT seq_no, place, period, score, unit, arg_min(t, (k, t)) AS rotation FROM keyed GROUP BY ALL"""


def chemical_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of like residues that begin at each place of each distinct part name."""
    seqs = part_sequences(spark, sf_dir)
    places = seqs.select("seq_no", "sequence", F.posexplode(F.split("sequence", "")).alias("place", "residue"))
    found = places.withColumn("p", patterns.period_at(F.col("sequence"), F.col("place"), chemical=True)).filter(F.col("p.score") >= CHEMICAL_LEAST)
    return found.select("seq_no", "place", F.col("p.period").alias("period"), F.round("p.score", 6).alias("score"))


def _chemical_sql() -> str:
    rank = lambda at: f"(instr('{CHEMICAL_ORDER}', sequence[{at}]))"
    ctes = ["places AS (SELECT seq_no, sequence, unnest(range(len(sequence))) AS place FROM seqs)", "b0 AS (SELECT *, 0 AS period, CAST(0 AS DOUBLE) AS score FROM places)"]
    for n, p in enumerate(patterns.PERIODS):
        hits, all_ = [], []
        for k in range(p):
            for arm in (1, 2):
                a, b = f"place + {k + 1}", f"place + {k + arm * p + 1}"
                far = f"CASE WHEN {rank(a)} = 0 OR {rank(b)} = 0 THEN 100 ELSE abs({rank(a)} - {rank(b)}) END"
                less = f"WHEN {far} <= 5 THEN 0.3" if arm == 1 else ""
                hits.append(f"CASE WHEN {b} > len(sequence) THEN 0.0 WHEN sequence[{a}] = sequence[{b}] THEN 1.0 WHEN {far} <= 3 THEN 0.7 {less} ELSE 0.0 END")
                all_.append(f"CASE WHEN {b} <= len(sequence) THEN 1 ELSE 0 END")
        ctes.append(f"s{n} AS (SELECT *, CASE WHEN ({' + '.join(all_)}) > 0 THEN CAST({' + '.join(hits)} AS DOUBLE) / ({' + '.join(all_)}) ELSE 0 END AS new FROM b{n})")
        ctes.append(f"b{n + 1} AS (SELECT seq_no, sequence, place, CASE WHEN new > score * CAST(1.1 AS DOUBLE) THEN {p} ELSE period END AS period, CASE WHEN new > score * CAST(1.1 AS DOUBLE) THEN new ELSE score END AS score FROM s{n})")
    return f"WITH {PART_SEQUENCES}, {', '.join(ctes)} SELECT seq_no, CAST(place AS INT) AS place, CAST(period AS INT) AS period, round(score, 6) AS score FROM b{len(patterns.PERIODS)} WHERE score >= {CHEMICAL_LEAST}"


def _alignments(pairs: str) -> str:
    """DuckDB CTEs: aligned(q, t, score, aligned_a, aligned_b, a_start, b_start) of a relation pairs(q, t, a, b), from whole score tables."""
    matrix = "[" + ",".join(map(str, matrix32().ravel().tolist())) + "]"
    letter = lambda s, at: f"(ascii(substr({s}, CAST({at} AS INT), 1)) & 31)"
    score = lambda i, j: f"({matrix})[{letter('a', i)} * 32 + {letter('b', j)} + 1]"
    reach = f"list_transform(range(1, len(b) + 1), lambda j: greatest(0, (CASE WHEN j = 1 THEN 0 ELSE h[j - 1] END) + {score('i + 1', 'j')}, h[j] - 10))"
    row = "list_transform(range(1, len(e) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: e[k] - 10 * (j - k))))"
    # a cell of the table with its border: rows and columns from 0 on
    cell = lambda i, j: f"CASE WHEN {i} = 0 OR {j} = 0 THEN 0 ELSE hs[CAST({i} AS INT)][CAST({j} AS INT)] END"
    return f"""
pairs AS ({pairs}),
dp AS (
  SELECT q, t, a, b, 0 AS i, list_transform(range(len(b)), lambda x: 0) AS h, CAST([] AS INT[][]) AS hs FROM pairs
  UNION ALL
  SELECT q, t, a, b, i + 1, h2, list_append(hs, h2) FROM (
    SELECT q, t, a, b, i, hs, {row} AS h2 FROM (SELECT q, t, a, b, i, hs, {reach} AS e FROM dp WHERE i < len(a)) r
  ) s
),
tables AS (SELECT q, t, a, b, hs, list_max(list_transform(hs, lambda r: list_max(r))) AS score FROM dp WHERE i = len(a)),
ends AS (
  SELECT *, list_position(list_transform(hs, lambda r: list_max(r)), score) AS i0 FROM tables WHERE score > 0
),
trace AS (
  SELECT q, t, a, b, hs, score, i0 AS i, list_position(hs[i0], score) AS j, '' AS top, '' AS bottom FROM ends
  UNION ALL
  SELECT q, t, a, b, hs, score, i - CASE WHEN step = 'left' THEN 0 ELSE 1 END, j - CASE WHEN step = 'up' THEN 0 ELSE 1 END,
         CASE WHEN step = 'left' THEN '-' ELSE substr(a, CAST(i AS INT), 1) END || top, CASE WHEN step = 'up' THEN '-' ELSE substr(b, CAST(j AS INT), 1) END || bottom
  FROM (
    SELECT *, CASE WHEN now = ({cell('(i - 1)', '(j - 1)')}) + {score('i', 'j')} THEN 'diagonal' WHEN now = ({cell('(i - 1)', 'j')}) - 10 THEN 'up' ELSE 'left' END AS step
    FROM (SELECT *, {cell('i', 'j')} AS now FROM trace) n WHERE now > 0
  )
),
aligned AS (SELECT q, t, score, top AS aligned_a, bottom AS aligned_b, i AS a_start, j AS b_start FROM trace WHERE ({cell('i', 'j')}) = 0)"""


def mosaic_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = part_sequences(spark, sf_dir)
    return seqs.select("seq_no", F.posexplode(patterns.mosaic(F.col("sequence"), 4)).alias("place", "residues"))


MOSAIC_WINDOW = f"""WITH {PART_SEQUENCES},
places AS (SELECT seq_no, sequence, unnest(range(len(sequence))) AS place FROM seqs),
taken AS (SELECT seq_no, place, k, sequence[k + 1] AS r FROM (SELECT *, unnest(range(greatest(place - 1, 0), least(place + 2, len(sequence)))) AS k FROM places))
SELECT seq_no, CAST(place AS INT) AS place, string_agg(r, '' ORDER BY CASE WHEN instr('{CHEMICAL_ORDER}', r) > 0 THEN instr('{CHEMICAL_ORDER}', r) ELSE 99 END, k) AS residues
FROM taken GROUP BY ALL"""


def canonical_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct part name's first four letters in their canonical rotation."""
    unit = F.substring("sequence", 1, 4)
    return part_sequences(spark, sf_dir).select("seq_no", unit.alias("unit"), patterns.canonical_rotation(unit).alias("rotation"))


CANONICAL_ROTATIONS = f"""WITH {PART_SEQUENCES},
units AS (SELECT seq_no, sequence[1:4] AS unit FROM seqs),
turned AS (SELECT seq_no, unit, unit[i + 1:] || unit[1:i] AS t FROM (SELECT *, unnest(range(len(unit))) AS i FROM units)),
keyed AS (SELECT seq_no, unit, t, list_transform(string_split(t, ''), lambda r: greatest(instr('{CHEMICAL_ORDER}', r) - 1, 0)) AS k FROM turned)
SELECT seq_no, unit, arg_min(t, (k, t)) AS rotation FROM keyed GROUP BY ALL"""


def lookup_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer whose name contains 77, with slices of the name."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq_no"), F.col("c_name").alias("id"))
    found = first_containing(people, "77")
    return found.select("seq_no", "id", subsequence(F.col("id"), 0, 8).alias("front"), subsequence(F.col("id"), -4, -1).alias("back"))


LOOKUP_SLICES = """
SELECT c_custkey AS seq_no, c_name AS id, c_name[1:8] AS front, c_name[len(c_name) - 3 : len(c_name) - 1] AS back
FROM customer WHERE contains(c_name, '77') ORDER BY c_custkey LIMIT 1"""

def align_parts_sql(bias_sql) -> str:
    """The oracle of align_parts; bias_sql is the SQL of bias assessments."""
    pairs = "SELECT x.seq_no AS q, y.seq_no AS t, x.sequence AS a, y.sequence AS b FROM seqs x JOIN seqs y ON y.seq_no > x.seq_no"
    columns = "range(1, len(aligned_a) + 1)"
    same = f"array_to_string(list_transform(list_filter({columns}, lambda i: aligned_a[i] = aligned_b[i]), lambda i: aligned_a[i]), '')"
    line = f"array_to_string(list_transform({columns}, lambda i: CASE WHEN aligned_a[i] = '-' OR aligned_b[i] = '-' THEN ' ' WHEN aligned_a[i] = aligned_b[i] THEN '|' ELSE '.' END), '')"
    bias = bias_sql(f"SELECT (q, t) AS key, {same} AS same FROM found").replace("pairs AS (", "judged_pairs AS (", 1).replace("FROM pairs", "FROM judged_pairs")
    return f"""WITH RECURSIVE {PART_SEQUENCES}, {_alignments(pairs)},
found AS (SELECT *, {line} AS match_line FROM aligned WHERE score >= {THRESHOLD}),
{bias}
SELECT q AS query_seq, t AS target_seq, CAST(score AS INT) AS score, aligned_a, match_line, aligned_b, CAST(a_start AS INT) AS a_start, CAST(b_start AS INT) AS b_start,
       round(100.0 * len(replace(replace(match_line, '.', ''), ' ', '')) / len(match_line), 6) AS identity,
       round(100.0 * len(replace(replace(match_line, '.', ''), ' ', '')) / len(replace(match_line, ' ', '')), 6) AS ungapped_identity, round(goodness, 6) AS goodness, reason
FROM found JOIN judged ON key = (q, t)"""


def _columns_sql() -> str:
    """The oracle of alignment_columns."""
    pairs = "SELECT x.seq_no AS q, y.seq_no AS t, x.sequence AS a, y.sequence AS b FROM seqs x JOIN seqs y ON y.seq_no > x.seq_no"
    mark = "CASE WHEN aligned_a[i] = '-' OR aligned_b[i] = '-' THEN ' ' WHEN aligned_a[i] = aligned_b[i] THEN '|' ELSE '.' END"
    return f"""WITH RECURSIVE {PART_SEQUENCES}, {_alignments(pairs)}
SELECT q AS query_seq, t AS target_seq, CAST(i AS INT) AS place, aligned_a[i] AS residue_a, aligned_b[i] AS residue_b, {mark} AS mark
FROM (SELECT *, unnest(range(1, len(aligned_a) + 1)) AS i FROM aligned WHERE score >= {THRESHOLD})"""


QUERIES = {
    "alignment_columns": alignment_columns,
    "repeat_units": repeat_units, "chemical_repeats": chemical_repeats,
    "sim_join_parts": sim_join_parts, "sim_query_vs_db": sim_query_vs_db, "find_names": find_names, "align_parts": align_parts, "identity_names": identity_names,
    "bias_entropy": bias_entropy, "length_rank": length_rank, "inverse_index_check": inverse_index_check, "work_left": work_left, "length_stats": length_stats,
    "sorted_check": sorted_check, "periodicity": periodicity, "mosaic_window": mosaic_window, "canonical_rotations": canonical_rotations, "lookup_slices": lookup_slices,
}
ORACLES = {
    "alignment_columns": _columns_sql(),
    "repeat_units": REPEAT_UNITS, "chemical_repeats": _chemical_sql(),
    "sim_join_parts": SIM_JOIN_PARTS, "sim_query_vs_db": SIM_QUERY_VS_DB, "find_names": FIND_NAMES, "identity_names": IDENTITY_NAMES, "bias_entropy": BIAS_ENTROPY,
    "length_rank": LENGTH_RANK, "inverse_index_check": INVERSE_INDEX_CHECK, "work_left": WORK_LEFT, "length_stats": LENGTH_STATS, "sorted_check": SORTED_CHECK,
    "periodicity": _period_sql(), "mosaic_window": MOSAIC_WINDOW, "canonical_rotations": CANONICAL_ROTATIONS, "lookup_slices": LOOKUP_SLICES,
}
