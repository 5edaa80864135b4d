import re
from collections import Counter
from math import comb

import pytest

from strandloom.llm import quality
from tests.llm.conftest import prose


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " \n\n", "a", "a b c", "a b c a b c", "x x x x", "a b c d a b c", "l\nl\n \n \nl", "é漢 \x1c \x85 \u2003y", "#$%&|<>* @", "a\r\nb\na\r\n", prose(1, 400), "A a B b\n" * 60]


@pytest.mark.parametrize("text", TEXTS)
def test_measure(text):
    assert quality.measure(text) == slow(text)


def test_bound_is_exact():
    for k, n, error in ((0, 20, 0.05), (3, 50, 0.01), (7, 30, 0.2)):
        p = quality.upper_bound(k, n, error)
        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - error) < 1e-6
    assert quality.upper_bound(5, 5, 0.05) == 1.0


def test_choice_stops_at_the_first_cutoff_that_fails():
    rejected = {name: [0] * 3 + [400] + [0] * (len(cuts) - 4) for name, cuts in quality.RULES.items()}
    model = quality.choose({"en": (5000, rejected), "xx": (10, {n: [0] * len(c) for n, c in quality.RULES.items()})}, 0.05, 0.05)
    assert model.cutoffs["en"] == {name: cuts[2] for name, cuts in quality.RULES.items()}
    assert "xx" not in model.cutoffs  # ten labels show nothing


def test_learned_rules(spark):
    good = [(i, prose(i, 60), "en") for i in range(1500)]
    bad = [(10_000 + i, " ".join(w + "###" for w in prose(i, 60).split()), "en") for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad] + [(0, 1, 0), (None, 1, 0), (99_999, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string").repartition(4)
    model = quality.fit(docs, labels)
    kept = {r["doc_id"] for r in quality.judge(docs, model).filter("kept").collect()}
    assert kept == {i for i, _, _ in good}
    assert {r["doc_id"] for r in quality.keep(docs, model).collect()} == kept


def test_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(odd_documents, labels)
    assert model.cutoffs == {}
    rows = quality.judge(odd_documents, model).collect()
    got = sorted((str(r["doc_id"]), *[r[c] for c in quality.COUNTS], r["base_failed"], r["kept"]) for r in rows)
    want = []
    for r in odd_documents.collect():
        m = slow(r["text"])
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want.append((str(r["doc_id"]), *m, failed, not failed))
    assert got == sorted(want)
    assert quality.judge(no_documents, model).count() == quality.keep(no_documents, model).count() == 0
    assert quality.keep(odd_documents, model).columns == odd_documents.columns
