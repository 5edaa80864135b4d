import pytest
from pyspark.sql import functions as F

from strandloom.sources import links, sequences

FASTA = ">sp|P1|ONE_X First one OS=Homo sapiens\nMKV\nLLA\n>sp|P2|TWO_Y Second\nAAA\n>plain\n\n"
FLAT = """ID   ONE_HUMAN               Reviewed;          12 AA.
AC   P1; Q9;
DT   05-JUL-2004, integrated into UniProtKB/Swiss-Prot.
DT   01-JAN-1990, sequence version 2.
DT   24-JAN-2024, entry version 100.
DE   RecName: Full=Alpha protein {ECO:1};
DE            Short=AP;
OS   Homo sapiens (Human).
OC   Eukaryota; Metazoa; Chordata.
OX   NCBI_TaxID=9606;
CC   -!- FUNCTION: Does
CC       things.
CC   -!- SIMILARITY: Belongs to the alpha family.
CC   -----------------------------------------------------------------------
CC   Copyrighted
DR   GO; GO:0001; C:x; IEA:y.
DR   Pfam; PF00001; Kelch_1; 1.
PE   1: Evidence at protein level;
KW   Repeat; Signal.
FT   DOMAIN          2..9
FT                   /note="Kelch"
FT                   /id="D1"
FT   SITE            7
SQ   SEQUENCE   12 AA;  1 MW;  0 CRC64;
     MKVLLAAAAA KK
//
ID   TWO_MOUSE               Unreviewed;         3 AA.
AC   P2;
DE   SubName: Full=Putative (Fragment);
OS   Mus musculus.
SQ   SEQUENCE   3 AA;  1 MW;  0 CRC64;
     ACD
//
"""


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    return write


def test_fasta(spark, put, tmp_path):
    frame = sequences.read_fasta(spark, put("a.fasta", FASTA))
    rows = {r["id"]: r for r in frame.collect()}
    assert rows["sp|P1|ONE_X"]["sequence"] == "MKVLLA" and rows["sp|P1|ONE_X"]["accession"] == "P1" and rows["sp|P1|ONE_X"]["entry_name"] == "ONE_X"
    assert rows["sp|P1|ONE_X"]["description"] == "First one OS=Homo sapiens" and rows["sp|P2|TWO_Y"]["length"] == 3 and rows["plain"]["sequence"] == ""
    sequences.write_fasta(frame, str(tmp_path / "out"), width=4)
    assert {r["id"]: r["sequence"] for r in sequences.read_fasta(spark, str(tmp_path / "out")).collect()} == {k: r["sequence"] for k, r in rows.items()}
    numbered = sequences.number_records(frame)
    assert [r["id"] for r in numbered.orderBy("seq_no").collect()] == sorted(rows)
    assert sequences.first_containing(numbered, "P").first()["id"] == "sp|P1|ONE_X" and sequences.lookup(frame, "TWO_Y").first()["accession"] == "P2"
    cut = lambda a, b: spark.range(1).select(sequences.subsequence(F.lit("abcdef"), a, b).alias("x")).first()["x"]
    assert [cut(*s) for s in ((1, 3), (-3, -1), (0, 99), (4, 2), (-99, 2))] == ["abcdef"[a:b] for a, b in ((1, 3), (-3, -1), (0, 99), (4, 2), (-99, 2))]


def test_flatfile(spark, put):
    frame = sequences.read_flatfile(spark, put("a.dat", FLAT))
    one, two = frame.orderBy("accession").collect()
    assert (one["entry_name"], one["data_class"], one["accessions"], one["accession"]) == ("ONE_HUMAN", "Reviewed", ["P1", "Q9"], "P1")
    assert one["organism"] == "Homo sapiens (Human)" and one["taxonomy_id"] == [9606] and one["lineage"] == ["Eukaryota", "Metazoa", "Chordata"]
    assert one["comments"] == ["FUNCTION: Does things.", "SIMILARITY: Belongs to the alpha family."]
    assert [(x["db"], x["id"], x["props"]) for x in one["xrefs"]] == [("GO", "GO:0001", ["C:x", "IEA:y"]), ("Pfam", "PF00001", ["Kelch_1", "1"])]
    assert [tuple(f) for f in one["features"]] == [("DOMAIN", 2, 9, "Kelch", "D1"), ("SITE", 7, 7, None, None)]
    assert (one["created"], one["sequence_update"], one["annotation_update"]) == ("2004-07-05", "1990-01-01", "2024-01-24")
    assert one["protein_existence"] == 1 and one["sequence"] == "MKVLLAAAAAKK" and one["length"] == 12 and one["keywords"] == ["Repeat", "Signal"]
    assert (two["sequence"], two["comments"], two["xrefs"], two["created"]) == ("ACD", [], [], None)
    shown = lambda a, b: frame.filter("accession = 'P1'").select(sequences.feature_table(F.col("features"), F.lit(a), F.lit(b)).alias("t")).first()["t"]
    assert shown(0, 3).split("\n") == ["FT   Key             Location/Qualifiers", 'FT   DOMAIN          2..9 /note="Kelch"', "FT" + " " * 19 + '/id="D1"']
    assert shown(6, 6).count("\n") == 3 and shown(10, 11) == ""
    names = {r["id"]: r["name"] for r in sequences.summaries(frame).collect()}
    assert names == {"P1": "Alpha protein; Homo sapiens (Human)", "P2": "NAME MISSING"}
    assert '"db":"GO"' in sequences.to_json(frame).filter("accession = 'P1'").first()["json"]
    assert spark.createDataFrame([(FLAT,)], "t string").select(sequences.extract_remote_sequence(F.col("t")).alias("s")).first()["s"] == "MKVLLAAAAAKK"


def test_packed(spark, put):
    raw = sequences.pack_record("one", "MKV") + sequences.pack_record("", "")
    rows = sequences.read_packed(spark, put("a.bin", raw)).orderBy("seq_no").collect()
    assert [tuple(r) for r in rows] == [(0, "one", "MKV"), (1, "", "")]


def test_links(spark, put, tmp_path):
    frame = links.read_links(spark, put("l.csv", "query_seq,target_seq,score\n1,2,300\nx,2,3\n4,5\n1,2,300,7,9\n\n3,3,9\n"))
    assert sorted(tuple(r) for r in frame.collect()) == [(1, 2, 300), (1, 2, 300), (3, 3, 9)]
    assert links.deduplicated(frame).count() == 2
    links.write_links(frame, str(tmp_path / "out"))
    assert links.read_links(spark, str(tmp_path / "out")).count() == 3


def test_finds(spark, put):
    text = "found 2\n\nP1-Q2 s(299) Length: 577/926\n  Name one; X\n  Name two {E}; Y\n=====\nA0-B1 s(5) Length: 1/2\n a\n b\nTOTAL SKIPPED 3\nC1-D1 s(9) Length: 1/2\n"
    rows = links.read_finds(spark, put("f.txt", text)).collect()
    assert [tuple(r) for r in rows] == [("P1", "Q2", 299, 577, 926, "Name one; X", "Name two {E}; Y"), ("A0", "B1", 5, 1, 2, "a", "b")]
    assert "P1-Q2 s(299) Length: 577/926\n Name one; X\n Name two {E}; Y" in [r["text"] for r in links.find_text(links.read_finds(spark, put("g.txt", text))).collect()]


def test_structures(spark, put):
    line = lambda n, name, alt, chain, res, x: f"ATOM  {n:5d}  {name:<3s}{alt}ALA {chain}{res:4d}    {x:8.3f}{0:8.3f}{1:8.3f}  1.00  0.00"
    text = "HEADER\n" + "\n".join([line(1, "N", " ", "A", 1, 0.5), line(2, "CA", " ", "A", 1, 1.5), line(3, "CA", "B", "A", 2, 2.5), line(4, "CA", "A", "A", 2, 3.5), line(5, "CA", " ", "Z", 1, 9)]) + "\n"
    atoms = links.read_pdb(spark, put("a.pdb", text))
    assert [(r["serial"], r["name"], r["x"], r["z"], r["element"]) for r in atoms.orderBy("serial").limit(2).collect()] == [(1, "N", 0.5, 1.0, "N"), (2, "CA", 1.5, 1.0, "C")]
    assert sorted(r["serial"] for r in links.backbone(atoms).collect()) == [2, 4]
    assert [r["serial"] for r in links.atoms_at(atoms, spark.createDataFrame([(1,)], "index int")).collect()] == [4]
