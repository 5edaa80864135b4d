import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions import formats, names, taxonomy
from strandloom.functions.alignment import ALIGNMENT, sw_align
from strandloom.operators import annotation
from strandloom.plans import annotation_queries


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("suffix", names.SUFFIXES)
def test_stems_need_more_than_eight_letters(spark, suffix):
    short, long = "abcdefgh" + suffix, "abcdefghi" + suffix
    got = [one(spark, names.simple_stem(F.col("w")), w=w) for w in (short, long)]
    assert one(spark, names.simple_stem(F.col("w")), w="abcdefghij" + "ases") == "abcdefghij"
    first = [next((w[: -len(s)] for s in names.SUFFIXES if len(w) > len(s) + 8 and w.endswith(s)), w) for w in (short, long)]
    assert got == first and got[1] != long


def test_tokens(spark):
    name = "Putative Phosphoglucomutase {ECO:1} 12345678 (Fragment) Transporters-like; Homo sapiens"
    assert one(spark, names.meaningful_tokens(F.col("n")), n=name) == ["phosphoglucomut", "transporter"]
    assert one(spark, names.meaningful_tokens(F.col("n")), n="") == []


def test_phases(spark):
    rows = [
        ("Alpha-toxin; X", "Beta-TOXIN; Y", 0, "toxins"), ("Uncharacterized a", "something", 0, "uncharacterized"), ("abc", "putative z", 0, "uncharacterized"),
        ("Same elevenX1", "same elevenX2", 0, "similar names"), ("Big phosphoglucomutase", "A phosphoglucomutases", 1, "phosphoglucomut"), ("one thing", "other name", None, None),
        ("toxin putative", "toxin b", 0, "toxins"),
    ]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(rows)], "i int, name1 string, name2 string")
    got = annotation.explain(frame).orderBy("i").collect()
    assert [(r["phase"], r["reason"]) for r in got] == [(p, r) for _, _, p, r in rows]
    assert [r["line"] for r in annotation.reason_lines(annotation.explain(frame)).collect()][0] == "toxins" + " " * 34 + " :      2"
    counts = {(r["phase"], r["reason"], r["level"]): r["n"] for r in annotation.reason_counts(annotation.explain(frame)).collect()}
    assert counts[None, None, 3] == len(rows) and counts[0, None, 1] == 5 and counts[0, "uncharacterized", 0] == 2


RECORD = "accession string, xrefs array<struct<db:string,id:string,props:array<string>>>, description string, comments array<string>, features array<struct<type:string,note:string>>"


def record(accession, xrefs=(), description="", comments=(), features=()):
    return (accession, [(d, i, list(p)) for d, i, *p in xrefs], description, list(comments), list(features))


CASES = [
    (record("A", [("Pfam", "PF1"), ("InterPro", "IPR9")]), record("B", [("Pfam", "PF1"), ("InterPro", "IPR9")]), "InterPro: IPR9"),
    (record("A", [("PANTHER", "PTHR00010:SF1")]), record("B", [("PANTHER", "PTHR00010:SF7")]), "Panther: PTHR00010"),
    (record("A", [("PANTHER", "PTHR00010")]), record("B", [("PANTHER", "PTHR00009:SF2")]), "Panther: PTHR00009/PTHR00010"),
    (record("A", description="RecName: Full=Glycolate oxidase; Short=GLOX {ECO:1};"), record("B", description="AltName: Full=Oxidase for glycolates;"), "Name: glycolate, oxidase"),
    (record("A", comments=["SIMILARITY: Belongs to the peptidase S8 family. {ECO:0000305}"]), record("B", comments=["SIMILARITY: belongs to the Peptidase S8 family."]), "-!- SIMILARITY: peptidase s8"),
    (record("A", description="Family: Kelch 2"), record("B", description="x family: kelch 2"), "Family: kelch 2"),
    (record("A", [("Pfam", "P1", "Kelch_1")]), record("B", [("SMART", "S1", "kelch.22")]), "Domain: kelch"),
    (record("A", features=[("DOMAIN", "Kelch thing")]), record("B", features=[("REPEAT", "kelch")]), "Domain: kelch"),
    (record("A", description="Full=abcd"), record("B", description="Full=abcd"), None),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_second_phase(spark, case):
    a, b, want = CASES[case]
    records = spark.createDataFrame([a, b], RECORD)
    finds = spark.createDataFrame([("A", "B", "first name", "second one"), ("A", "Z", "first name", "second one")], "id1 string, id2 string, name1 string, name2 string")
    got = {r["id2"]: (r["phase"], r["reason"]) for r in annotation.explain(finds, records).collect()}
    assert got == {"B": (2 if want else None, want), "Z": (None, None)}


def test_biased_survivors(spark):
    finds = spark.createDataFrame([("A", "B"), ("A", "C"), ("A", "Z")], "id1 string, id2 string")
    poor, rich = "K" * 30, "ACDEFGHIKLMNPQRSTVWY" * 2
    seqs = spark.createDataFrame([("A", poor + rich), ("B", poor), ("C", rich)], "accession string, sequence string")
    got = {r["id2"]: r["reason"] for r in annotation.split_biased(finds, seqs).collect()}
    assert got == {"B": "Compositional: K-Rich (100%)", "C": None, "Z": None}


def test_each_pair_of_sequences_is_aligned_once(spark, monkeypatch):
    """Twenty finds of three pairs of sequences; unknown ids and sequences without a match keep their rows."""
    calls = spark.sparkContext.accumulator(0)

    def counting_align():
        real = sw_align()

        @F.pandas_udf(ALIGNMENT)
        def udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            calls.add(len(a))
            return real.func(a, b)

        return udf

    monkeypatch.setattr(annotation, "sw_align", counting_align)
    poor, rich = "K" * 30, "ACDEFGHIKLMNPQRSTVWY" * 2
    seqs = [("A", poor + rich), ("W", "W"), ("E", ""), ("N", None), *[(f"B{i}", poor) for i in range(10)], *[(f"C{i}", rich) for i in range(8)]]
    finds = [("A", i) for i, _ in seqs[4:]] + [("W", "B0"), ("E", "A"), ("N", "A"), ("A", "Z"), ("A", "B0")]
    split = annotation.split_biased(spark.createDataFrame(finds, "id1 string, id2 string"), spark.createDataFrame(seqs, "accession string, sequence string"))
    got = [(r["id1"], r["id2"], r["goodness"], r["reason"]) for r in split.collect()]
    assert sorted((a, b) for a, b, _, _ in got) == sorted(finds) and calls.value == 4
    for a, b, goodness, reason in got:
        assert reason == ("Compositional: K-Rich (100%)" if a == "A" and b[0] == "B" else None)
        assert (goodness is None) == ("N" in (a, b) or b == "Z") and (a not in "WE" or goodness == 1.0)


def test_bias_phase_of_odd_names(spark, tmp_path):
    names_ = ["a cat", "7", "", None, "a cat", "ou", "w", "kkkkkkkkkkr"]
    spark.createDataFrame(list(enumerate(names_)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = sorted((r["id1"], r["id2"], r["goodness"], r["reason"]) for r in annotation_queries.bias_phase(spark, str(tmp_path)).collect())
    assert [r[:3] for r in got] == sorted(con.sql(f"SELECT id1, id2, goodness FROM ({annotation_queries.BIAS_PHASE})").fetchall()) and len(got) == 7


def test_first_steps(spark):
    cases = [([5, 1], [6], 5), ([6], [9, 5], 5), ([3, 7], [8, 4, 2], 2), ([1, 3], [1, 3], None), ([], [1], None), ([-1], [0], -1)]
    frame = spark.createDataFrame(cases, "a array<long>, b array<long>, want long").select(names.first_step(F.col("a"), F.col("b")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in frame.collect())


def test_panther_neighbours_of_odd_lines(spark, tmp_path):
    """Suppliers of five and six digits, null ones and null parts, missing parts, and parts at the ends of blocks."""
    ends = [(255, 7), (256, 7), (256, 8), (257, 9), (511, 3), (512, 2), (514, 2), (-1, 4), (0, 4), (0, 5), (-256, 6), (-257, 7)]
    lines = [(1, 99999), (1, 100000), (2, 100000), (2, 99999), (3, 100001), (10, None), (11, 5), (11, None), (12, None), (None, 5), *ends, *ends]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = [tuple(r) for r in annotation_queries.panther_neighbours(spark, str(tmp_path)).collect()]
    want = con.sql(f"SELECT l_partkey, common, sequential FROM ({annotation_queries.PANTHER_NEIGHBOURS})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and (1, "PTHR99999", "PTHR99999/PTHR100000") in got and (10, None, None) in got


def test_panther_neighbours_of_many_families(spark, tmp_path):
    """Two parts of 20,000 suppliers each, none of them shared: no work for each two of them."""
    spark.range(40_000).selectExpr("id % 2 as l_partkey", "id * 3 as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in annotation_queries.panther_neighbours(spark, str(tmp_path)).collect()] == [(0, None, None)]


def test_record_filter(spark):
    schema = "i int, data_class string, organism string, description string, xrefs array<struct<db:string>>"
    rows = [
        (0, "Reviewed", "Homo sapiens (Human)", "ok EC=1", []), (1, "Unreviewed", "Homo sapiens", "EC=1", []), (2, "Reviewed", "Mus musculus", "x", [("GO",)]),
        (3, "Reviewed", "Mus musculus", "Putative x", [("GO",)]), (4, "Reviewed", "Mus musculus", "putative x", [("Pfam",)]), (5, "Reviewed", "Mus musculus", "x (Fragment)", [("GO",)]), (6, "Reviewed", "Mus musculus", "x", [("PIR",)]),
    ]
    frame = spark.createDataFrame(rows, schema)
    kept = lambda **k: {r["i"] for r in frame.filter(annotation.record_filter(**k)).collect()}
    assert kept() == {0, 2, 4} and kept(organisms=["mouse"]) == {2, 4} and kept(require_go=True) == {2} and kept(require_ec=True) == {0} and kept(require_pfam=True) == {4}
    assert kept(no_fragments=False) == {0, 2, 4, 5} and kept(no_uncharacterized=False) == {0, 2, 3, 4} and kept(require_any_feature=False) == {0, 2, 4, 6}


@pytest.mark.parametrize(
    ("rank", "dull", "category", "priority"),
    [("no rank", False, "Deep Novelty", 1), ("superkingdom", True, "Deep Housekeeping", 4), ("phylum", False, "High Value", 2), ("kingdom", True, "Distant Homolog", 4), ("family", True, "Moderate Distance", 3), ("genus", False, "Close Relative", 5), ("never heard", False, "Deep Novelty", 1), (None, False, "TaxID Error", 5)],
)
def test_classes(spark, rank, dull, category, priority):
    r = spark.createDataFrame([(rank, dull)], "r string, d boolean").select(taxonomy.classify(F.col("r"), F.col("d")).alias("x")).first()["x"]
    assert (r["category"], r["priority"]) == (category, priority)


def test_lineages_and_words(spark):
    frame = spark.createDataFrame([([1, 2, 3], [1, 2, 4], "Beta-ACTIN", "x"), ([1], [2], "y", "z")], "a array<int>, b array<int>, c string, d string")
    got = frame.select(taxonomy.common_ancestor(F.col("a"), F.col("b")).alias("l"), taxonomy.is_housekeeping(F.col("c"), F.col("d")).alias("h")).collect()
    assert [(r["l"], r["h"]) for r in got] == [(2, True), (None, False)]


def test_formats(spark):
    assert one(spark, formats.iso_date(F.col("d")), d="05-JUL-2004") == "2004-07-05"
    for odd in ("05-JXX-2004", "99-JUL-2004", "x", ""):
        assert one(spark, formats.iso_date(F.col("d")), d=odd) == odd
    assert [one(spark, formats.duration(F.lit(s))) for s in (0, 59, 3600, 90061)] == ["0s", "59s", "1h 0m 0s", "1d 1h 1m 1s"]
    assert one(spark, formats.with_commas(F.lit(1234567))) == "1,234,567"
    assert [tuple(one(spark, formats.comment_parts(F.col("c")), c=c)) for c in ("FUNCTION: does: it", "plain")] == [("FUNCTION", "does: it"), ("UNKNOWN", "plain")]
    assert [one(spark, formats.line_category(F.col("c")), c=c) for c in ("HIT:1,2,3", "HITS", "STEP: x", "")] == ["hit", "other", "step", "other"]
    assert re.fullmatch(r"[a-z ]+", " ".join(names.STOPWORDS)) and len(names.STOPWORDS) == 39
