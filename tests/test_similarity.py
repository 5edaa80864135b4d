import random

import pytest

from strandloom.functions.alphabet import encode, matrix32
from strandloom.functions.alignment import batch_scores
from strandloom.operators import similarity


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(i, "".join(rng.choices("ARNDCQEGHILKMFPSTWYV", k=rng.choice([0, 5, 30, 90])))) for i in range(45)]
    return [*out, (100, None), (101, out[2][1][3:] + out[3][1])]


@pytest.mark.parametrize(("include_self", "residues"), [(True, 200_000), (False, 150)])
def test_join_is_all_pairs(spark, rows, include_self, residues):
    frame = spark.createDataFrame(rows, "seq_no long, sequence string")
    got = sorted(tuple(r) for r in similarity.similarity_join(frame, 40, include_self=include_self, block_residues=residues).collect())
    want = []
    for i, (q, a) in enumerate(rows):
        for t, b in rows[i if include_self else i + 1 :]:
            score = int(batch_scores(encode(a or ""), [encode(b or "")], matrix32())[0])
            if score >= 40:
                want.append((q, t, score))
    assert got == sorted(want)


def test_query_against_database(spark, rows):
    frame = spark.createDataFrame(rows, "seq_no long, sequence string")
    got = {tuple(r) for r in similarity.query_against(frame.filter("seq_no in (3, 5)"), frame, 30).collect()}
    both = {(min(q, t), max(q, t), s) for q, t, s in got}
    assert {(3, 3), (5, 5)} <= {(q, t) for q, t, _ in got}
    assert both == {tuple(r) for r in similarity.similarity_join(frame, 30).filter("query_seq in (3, 5) or target_seq in (3, 5)").collect()}


def test_no_sequences(spark):
    assert similarity.similarity_join(spark.createDataFrame([], "seq_no long, sequence string"), 1).count() == 0
