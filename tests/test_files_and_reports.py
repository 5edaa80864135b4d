import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from strandloom.functions import taxonomy
from strandloom.operators import forest, integrity, similarity
from strandloom.plans import format_queries
from strandloom.session import path_exists, remove_folder, scratch_folder
from strandloom.sources import links, sequences
from strandloom.streaming import jobs


def test_records_are_numbered_in_file_order(spark, tmp_path):
    for name, ids in (("b.fasta", "XYZ"), ("a.fasta", "QPO")):
        (tmp_path / name).write_text("".join(f">{c}\nAC\n" for c in ids))
    got = {r["id"]: r["seq_no"] for r in sequences.read_fasta(spark, str(tmp_path), numbers=True).collect()}
    assert got == {c: i for i, c in enumerate("QPOXYZ")}


def test_packed_blocks_are_the_packed_file(spark):
    rows = [(i, f"record {i}", "ACDEF" * (i * 7 % 11)) for i in range(40)]
    frame = spark.createDataFrame(rows, "seq_no long, description string, sequence string").repartition(3)
    blocks = sequences.pack(frame, residues=200).orderBy("block").collect()
    order = sorted(rows, key=lambda r: (-len(r[2]), r[0]))
    assert b"".join(bytes(b["content"]) for b in blocks) == b"".join(sequences.pack_record(d, s) for _, d, s in order) and len(blocks) > 3
    index = sorted((r["position"], r["seq_no"]) for r in sequences.inverse_index(frame).collect())
    assert index == [(k, r[0]) for k, r in enumerate(order)]
    assert sequences.unpack(sequences.pack(frame.limit(0))).count() == 0


@pytest.mark.parametrize(("name", "element"), [("N", "N"), ("CA", "C"), ("FE1", "FE"), ("CL", "CL"), ("1HB2", "H"), ("O5'", "O"), ("QX", "C"), ("", "C"), ("BR", "BR"), ("SG", "S")])
def test_elements(spark, name, element):
    assert spark.range(1).select(links.element_of(F.lit(name)).alias("e")).first()["e"] == element


def test_short_lines_and_blank_chains(spark, tmp_path):
    line = links.pdb_line(F.lit(1), F.lit("CA"), F.lit(" "), F.lit(7), F.lit("1.000"), F.lit("-2.500"), F.lit("3.250"))
    spark.range(1).select(line).union(spark.createDataFrame([("ATOM  cut",)], "v string")).write.text(f"{tmp_path}/pdb")
    assert [(r["chain"], r["res_seq"], r["y"]) for r in links.read_pdb(spark, f"{tmp_path}/pdb").collect()] == [("A", 7, -2.5)]


def test_finds_report_is_sorted_and_read_back(spark, tmp_path):
    finds = spark.createDataFrame([(f"A{i}", f"B{i}", 100 + i % 5, i, 2 * i, f"first {i}", f"second {i}; x") for i in range(60)], "id1 string, id2 string, score int, len1 int, len2 int, name1 string, name2 string")
    lines = [r["line"] for r in links.finds_report(finds).orderBy("line_no").collect()]
    assert lines[0] == "found 60 finds" and len(lines) == 181 and lines[1].startswith("A14-B14 s(104) Length: 14/28") and lines[2] == " first 14"
    links.write_lines(links.finds_report(finds), f"{tmp_path}/r")
    assert sorted(map(tuple, links.read_finds(spark, f"{tmp_path}/r").collect())) == sorted(map(tuple, finds.collect()))


def test_no_common_ancestor_is_no_rank(spark):
    taxa = spark.createDataFrame([(1, None, "root"), (2, 2, "root"), (10, 1, "phylum"), (11, 10, "species"), (12, 2, "species")], "taxid long, parent long, rank string")
    found = {r["taxid"]: r["lineage"] for r in taxonomy.lineages(taxa).collect()}
    assert found == {1: [1], 2: [2], 10: [1, 10], 11: [1, 10, 11], 12: [2, 12]}
    ranks = F.create_map(F.lit(1), F.lit("root"), F.lit(10), F.lit("phylum"))
    pairs = spark.createDataFrame([([1, 10, 11], [1, 10]), ([1, 10], [2, 12]), (None, [1])], "a array<int>, b array<int>")
    said = pairs.select(taxonomy.classify(taxonomy.ancestor_rank(F.col("a"), F.col("b"), ranks), F.lit(False)).alias("c")).select("c.category", "c.priority").collect()
    assert [tuple(r) for r in said] == [("High Value", 2), ("Deep Novelty", 1), ("TaxID Error", 5)]


def test_drawn_trees(spark):
    chain = [(i, i + 1, 100 - i) for i in range(20)]
    edges = [*chain, (0, 30, 5), (40, 41, 50), (50, 51, 60)]
    tree = forest.rooted(spark.createDataFrame(edges, "u long, v long, score long"))
    rows = forest.ascii_tree(tree, threshold=10).orderBy("component", "sort_key").collect()
    lines = [r["line"] for r in rows]
    assert lines[0] == "0:0 Length:? [ROOT 0]  " and lines[1] == "0:├─ 1 Length:? (s:100) "
    assert lines[20] == "0:" + "│  " + "   " * 18 + "└─ 20 Length:? (s:81) "
    assert "└── [STUB: Node 30, score 5 < threshold]" in lines
    assert [line for line in lines if "ROOT" in line][1:] == ["0:40 Length:? [ROOT 2]  ", "0:50 Length:? [ROOT 3]  "]
    deep = forest.ascii_tree(forest.rooted(spark.createDataFrame([(i, i + 1, 9) for i in range(40)], "u long, v long, score long"))).collect()
    assert max(int(r["line"].split(":")[0]) for r in deep) == 40  # prefixes of 117 columns are shown from 40 on


def test_finished_waves_are_not_done_again(spark):
    rows = [(i, "MKVLAC" * (3 + i % 4)) for i in range(30)]
    frame = spark.createDataFrame(rows, "seq_no long, sequence string")
    folder = scratch_folder(spark, "waves")
    first = similarity.resumable_join(frame, 40, folder, waves=4, stop_after=1, block_residues=100).count()
    stamp = sorted(r[0] for r in spark.read.parquet(f"{folder}/wave=0").select("_metadata.file_path").distinct().collect())
    whole = similarity.resumable_join(frame, 40, folder, waves=4, block_residues=100)
    assert first < whole.count() and sorted(map(tuple, whole.collect())) == sorted(map(tuple, similarity.similarity_join(frame, 40).collect()))
    assert sorted(r[0] for r in spark.read.parquet(f"{folder}/wave=0").select("_metadata.file_path").distinct().collect()) == stamp
    for other in ({"threshold": 41}, {"gap": 9}, {"sequences": frame.filter("seq_no > 0")}):
        given = {"sequences": frame, "threshold": 40, "gap": 10} | other
        with pytest.raises(ValueError, match=f"other {next(iter(other))}"):
            similarity.resumable_join(folder=folder, waves=4, block_residues=100, **given)
    remove_folder(spark, folder)
    assert not path_exists(spark, folder)


def test_late_rows_are_dropped_and_open_windows_wait(spark):
    folder = scratch_folder(spark, "late")
    at = lambda hour, day=1: datetime.datetime(2024, 1, day, hour)
    for rows in ([(at(1),), (at(1),), (at(0, 3),)], [(at(1),), (at(2, 5),)]):  # the second file brings a row of a window that is closed
        spark.createDataFrame(rows, "ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("ts timestamp").parquet(f"{folder}/in").withWatermark("ts", "1 day")
        out = jobs.append_available(stream.groupBy(F.window("ts", "1 hour").alias("w")).count(), folder)
    got = {(r["w"]["start"].day, r["w"]["start"].hour): r["count"] for r in out.collect()}
    assert got == {(1, 1): 2, (3, 0): 1}
    remove_folder(spark, folder)


def test_mismatches_stop_after_ten(spark):
    left = spark.createDataFrame([(i, str(i % 2)) for i in range(40)], "k long, v string")
    right = spark.createDataFrame([(i, "0") for i in range(38)], "k long, v string")
    assert [r["k"] for r in integrity.first_mismatches(integrity.zip_compare(left, right, "k", ["v"]), "k").collect()] == list(range(1, 20, 2))


def part_names(spark, folder, names):
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_matrix_scores_sends_no_pairs_to_the_driver(spark, tmp_path, monkeypatch):
    """Names are few bytes in a file, so the rows of their neighbouring letters look small enough to broadcast."""
    plans = []
    monkeypatch.setattr(format_queries, "settled", lambda df, folder: plans.append(df._jdf.queryExecution().executedPlan()) or df)
    got = format_queries.matrix_scores(spark, part_names(spark, tmp_path, ["cold plate", "ring"] * 50))
    sides = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "BroadcastExchange":
            sides.append(node.toString())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plans[0])
    assert len(sides) == 1 and "Generate" not in sides[0] and got.count() == 100


def test_matrix_scores_of_short_names(spark, tmp_path):
    """Names of one letter or none have no neighbouring letters, so no row."""
    folder = part_names(spark, tmp_path, ["a", "", None, "W w", "7", "WJ", "cat"])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    want = con.sql(format_queries.MATRIX_SCORES).fetchall()
    assert sorted(tuple(r) for r in format_queries.matrix_scores(spark, folder).collect()) == sorted(want) and {r[0] for r in want} == {3, 6}
