import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import alignment, bias
from strandloom.functions.alphabet import MATRICES, encode, matrix32, parse_matrix

A = "MKLLVILLFSALALAAQKPGGAPTTSLIGNESRSDQPSTVAAA"
B = "MVTAQKPGGAPTTQLLGNESRSDQPSTVGGG"
RESIDUES = "ARNDCQEGHILKMFPSTWYVBZXJOU*"


def naive(a, b, matrix, gap=10):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(encode(a)):
        for j, y in enumerate(encode(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + matrix[x, y], h[i, j + 1] - gap, h[i + 1, j] - gap)
    return int(h.max())


def test_matrix():
    scores = MATRICES["PAM250"]
    order = "ARNDCQEGHILKMFPSTWYVBZX*"
    table = np.array([[scores[a, b] for b in order] for a in order])
    assert (table == table.T).all() and table.min() == -8 and table.max() == 17 and np.trace(table) == 124 and table.sum() == -932
    m = matrix32()
    assert m[ord("J") & 31, ord("A") & 31] == -8  # J and * share a place
    assert m[ord("U") & 31].sum() == 0
    assert parse_matrix("# c\n   A  R\nA  2 -2\nR -2  6\n") == {("A", "A"): 2, ("A", "R"): -2, ("R", "A"): -2, ("R", "R"): 6}


@settings(max_examples=60, deadline=None)
@given(st.text(RESIDUES, max_size=25), st.lists(st.text(RESIDUES, max_size=25), max_size=5))
def test_kernel_equals_dynamic_programming(query, targets):
    m = matrix32()
    assert alignment.batch_scores(encode(query), [encode(t) for t in targets], m).tolist() == [naive(query, t, m) for t in targets]


@settings(max_examples=60, deadline=None)
@given(st.text("ARNDCQ", max_size=20), st.text("ARNDCQ", max_size=20))
def test_traceback_adds_up(a, b):
    m = matrix32()
    found = alignment.align(a, b, m)
    if found is None:
        assert naive(a, b, m) == 0
        return
    score, top, bottom, a_start, a_end, b_start, b_end = found
    assert top.replace("-", "") == a[a_start : a_end + 1] and bottom.replace("-", "") == b[b_start : b_end + 1]
    assert score == naive(a, b, m) == sum(-10 if "-" in (x, y) else m[ord(x) & 31, ord(y) & 31] for x, y in zip(top, bottom))


def test_short_pair(spark):
    row = spark.createDataFrame([(A, B), ("", "A"), (None, None), ("W", "C")], "a string, b string").withColumn("x", alignment.sw_align()("a", "b")).collect()
    x = row[0]["x"]
    assert (x["score"], x["a_start"], x["b_start"]) == (98, 13, 1)
    assert x["aligned_a"] == "LAAQKPGGAPTTSLIGNESRSDQPSTVAAA" and x["aligned_b"] == "VTAQKPGGAPTTQLLGNESRSDQPSTVGGG"
    assert all(r["x"]["score"] is None for r in row[1:])


def test_bias_of_the_short_pair(spark):
    frame = spark.createDataFrame([("LAAQKPGGAPTTSLIGNESRSDQPSTVAAA", "VTAQKPGGAPTTQLLGNESRSDQPSTVGGG")], "a string, b string")
    r = frame.select(bias.assess(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert (r["num_matches"], r["unique_residues"], r["top_residue"], r["reason"], r["is_biased"]) == (23, 13, "P", "Diverse", False)
    assert r["entropy"] == pytest.approx(3.522712, abs=1e-6) and r["top_percentage"] == pytest.approx(13.0435, abs=1e-4) and r["goodness"] == pytest.approx(0.838539, abs=1e-6)


@pytest.mark.parametrize(
    ("a", "reason"),
    [("KKKKKKKARK", "K-Rich (80%)"), ("KKKKKAAAARR", "K-Biased (45%)"), ("KKKAAARRRCDE", "KA-Biased (75%)"), ("KKKAAAR", "K-Biased (43%)"), ("KKKKKRRR", "K-Rich (62%)"), ("ACDEFGHIKLMNPQRSTVWY", "Diverse")],
)
def test_bias_reasons(spark, a, reason):
    assert spark.createDataFrame([(a,)], "a string").select(bias.assess(F.col("a"), F.col("a"))["reason"].alias("r")).first()["r"] == reason


def test_no_matches(spark):
    r = spark.createDataFrame([("A-C", "RG-")], "a string, b string").select(bias.assess(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert (r["goodness"], r["reason"], r["num_matches"], r["entropy"]) == (1.0, "No-matches", 0, 0.0)


def test_lines_and_identity(spark):
    a, b = F.lit("AC-GT" * 20), F.lit("ACG-A" * 20)
    r = spark.range(1).select(
        alignment.match_line(a, b).alias("m"), alignment.identity_percent(a, b).alias("all"), alignment.identity_percent(a, b, ungapped=True).alias("open"),
        alignment.blocked_text(a, b, F.lit(0), F.lit(4)).alias("t"),
    ).first()
    assert r["m"] == "||  ." * 20 and r["all"] == 40.0 and round(r["open"], 3) == 66.667
    blocks = r["t"].split("\n\n")
    assert len(blocks) == 2 and blocks[0].startswith("     1  AC-GT") and blocks[1].split("\n")[2].startswith("    61  ")


def test_sql_functions(spark):
    alignment.register(spark)
    assert spark.sql(f"SELECT sw_score('{A}', '{B}') AS s").first()["s"] == 98


def test_scores_beyond_sixteen_bits():
    a, b = "W" * 2100, "W" * 2000 + "A" * 50
    scores = alignment.batch_scores(encode(a), [encode(b), encode("WW"), encode("")], matrix32())
    assert scores.tolist() == [17 * 2000, 34, 0]


def whole_table(a, b, matrix, gap=10):
    """align() by the whole table."""
    x, y = encode(a), encode(b)
    h = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        for j in range(len(y)):
            h[i + 1, j + 1] = max(0, h[i, j] + matrix[x[i], y[j]], h[i, j + 1] - gap, h[i + 1, j] - gap)
    if h.max() <= 0:
        return None
    i, j = end = np.unravel_index(h.argmax(), h.shape)
    top, bottom = "", ""
    while h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + matrix[x[i - 1], y[j - 1]]:
            i, j, top, bottom = i - 1, j - 1, a[i - 1] + top, b[j - 1] + bottom
        elif h[i, j] == h[i - 1, j] - gap:
            i, top, bottom = i - 1, a[i - 1] + top, "-" + bottom
        else:
            j, top, bottom = j - 1, "-" + top, b[j - 1] + bottom
    return int(h.max()), top, bottom, i, end[0] - 1, j, end[1] - 1


@settings(max_examples=60, deadline=None)
@given(st.text("ARNW", max_size=70), st.text("ARNW", max_size=70), st.sampled_from([1, 2, 3, 64]), st.sampled_from([1, 10]))
def test_rows_made_anew_give_the_same_alignment(a, b, rows, gap):
    """Ties among them, with few kept rows, so that segments are cut several times."""
    kept, alignment.KEPT_ROWS = alignment.KEPT_ROWS, rows if rows > 1 else 2
    try:
        assert alignment.align(a, b, matrix32(), gap) == whole_table(a, b, matrix32(), gap)
    finally:
        alignment.KEPT_ROWS = kept


def test_long_sequences_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    a = "".join(rng.choice(list("ARNDCQEGHILK"), 20_000))
    b = "".join(c for i, c in enumerate(a) if i % 97)
    tracemalloc.start()
    found = alignment.align(a, b, matrix32())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and found[1].replace("-", "") == a[found[3] : found[4] + 1] and found[2].replace("-", "") == b[found[5] : found[6] + 1]
    assert found[0] == sum(-10 if "-" in (x, y) else int(matrix32()[ord(x) & 31, ord(y) & 31]) for x, y in zip(*found[1:3]))


def test_comparison_by_ids(spark):
    from strandloom.operators.similarity import compared

    seqs = spark.createDataFrame([("P1", A), ("P2", B), ("P3", "")], "id string, sequence string")
    pairs = spark.createDataFrame([("P1", "P2"), ("P2", "P1"), ("P1", "P3"), ("P1", "P9")], "id_a string, id_b string")
    rows = {(r["id_a"], r["id_b"]): r for r in compared(pairs, seqs).collect()}
    assert set(rows) == {("P1", "P2"), ("P2", "P1"), ("P1", "P3")}
    assert rows["P1", "P2"]["score"] == rows["P2", "P1"]["score"] == 98 and rows["P1", "P2"]["a_start"] == 13 and rows["P1", "P3"]["score"] is None


def test_columns_in_sql(spark):
    alignment.register(spark)
    rows = spark.sql(f"SELECT * FROM align_columns('{A}', '{B}') ORDER BY place").collect()
    assert "".join(r["residue_a"] for r in rows) == "LAAQKPGGAPTTSLIGNESRSDQPSTVAAA" and rows[0]["place"] == 1 and rows[0]["mark"] == "."
    assert spark.sql(f"SELECT * FROM align_columns('{A}', NULL)").count() == 0
    assert spark.sql("SELECT identity_percent('AC-GT', 'ACG-A') AS p").first()["p"] == 40.0
