import random
import re

import corpus_pipeline
import numpy as np
import pytest

from strandloom.llm import jaccard
from tests.llm.conftest import prose


def brute(documents):
    """Smallest id of each group, by comparing all pairs of sets of five words."""
    sets = []
    for i, text in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common, union = len(sets[a][1] & sets[b][1]), len(sets[a][1] | sets[b][1])
            if 5 * common >= 4 * union:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), (True, 0)), (i is None, i or 0))
    return sorted(str(None if null else i) for null, i in least.values())


def kept(frame):
    return sorted(str(r["doc_id"]) for r in frame.collect())


def changed(text, seed, share):
    rng = random.Random(seed)
    return " ".join("other" + str(rng.random()) if rng.random() < share else w for w in text.split())


def near_copies():
    rows = []
    for k in range(30):
        text = prose(k, 60 + 20 * k)
        rows += [(10 * k + j, changed(text, 10 * k + j, share), "en") for j, share in enumerate((0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05))]
    head = prose(99, 40)  # many texts share their first words, and each is its own
    return rows + [(1000 + k, head + " " + prose(200 + k, 50), "en") for k in range(60)] + [(1060, head, "en"), (1061, " ".join(head.split()[:-5]), "en")]


@pytest.mark.parametrize("hot", [100_000, 0])
def test_near_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = brute([r[:2] for r in rows])
    assert kept(jaccard.keep_one(docs)) == want and len(want) < len(rows) - 60


def test_near_dedup_stage_drops_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept(got) == brute(rows) and got.columns == docs.columns


def test_odd_documents(odd_documents, no_documents):
    got = jaccard.keep_one(odd_documents)
    assert kept(got) == brute([(r["doc_id"], r["text"]) for r in odd_documents.collect()])
    assert got.columns == odd_documents.columns and jaccard.keep_one(no_documents).count() == 0


def test_prefix_is_never_short():
    from fractions import Fraction

    none = np.array([], np.int64)
    for n in range(1, 40):
        assert len(jaccard.prefix(np.arange(n), Fraction(4, 5), none, none)) == n - -(-4 * n // 5) + 1
    assert len(jaccard.prefix(none, Fraction(4, 5), none, none)) == 0


def test_similar_sets_share_the_keys_needed():
    """Of pairs just similar enough, whatever differs: both sets find as many keys in the other's prefix as they need."""
    from fractions import Fraction

    rng, none, ratio = np.random.default_rng(4), np.array([], np.int64), Fraction(4, 5)
    for trial in range(3000):
        a = int(rng.integers(1, 200))
        b = int(rng.integers(-(-4 * a // 5), a + 1))
        common = -(-4 * (a + b) // 9)
        if common > b:
            continue
        values = rng.permutation(10_000)[: a + b - common]
        if trial % 2:  # what differs comes first in the order
            values = np.roll(np.sort(values), common)
        x, y = np.sort(values[:a]), np.sort(np.concatenate((values[:common], values[a:])))
        least = [jaccard.needed(len(s), ratio) for s in (x, y)]
        found = [jaccard.prefix(s, ratio, none, none, n - 1) for s, n in zip((x, y), least)]
        assert len(np.intersect1d(*found)) >= max(least)


def test_chance_phrases_do_not_travel(spark):
    """Texts that share a phrase or two with others, as most do, are set aside before whole sets move; near copies stay."""
    from fractions import Fraction

    phrases = [prose(5000 + k, 6) for k in range(40)]
    rows = [(k, " ".join((prose(k, 150), phrases[k % 40], prose(3000 + k, 150), phrases[(k + 7) % 40]))) for k in range(400)]
    rows += [(1000 + k, changed(rows[k][1], k, 0.005)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    work = jaccard.Workspace(spark, "test")
    found = work.keep(jaccard.described(docs, Fraction(4, 5), 5, id_col="doc_id", text_col="text"))
    left = {r["fp"] for r in jaccard.shared_keys(work, found).select("fp").collect()}
    ids = {r["id"] for r in found.collect() if r["fp"] in left}
    assert {k for k, _ in rows[400:]} | set(range(20)) == ids
    assert kept(jaccard.keep_one(docs)) == brute(rows)


def test_sketches_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(6)
    for n in (1, 5, 60, 700, 3000):
        values = rng.integers(-(1 << 62), 1 << 62, n + 40)
        for k in (0, 1, 7, 40):
            x, y = (np.frombuffer(jaccard.sketch(s), np.uint8) for s in (values[:n], values[k : n + k]))
            assert np.bitwise_count(x ^ y).sum() <= 2 * min(n, k)


def test_pairs_that_differ_too_much_are_not_made(spark):
    """Sets that share keys in plenty but are far from similar make no pairs for whole sets to be joined to."""
    from fractions import Fraction

    rng = np.random.default_rng(8)
    common, rows = rng.integers(0, 1 << 60, 60), []
    for k in range(50):
        sets = np.concatenate((common, rng.integers(0, 1 << 60, 90))) if k else common
        rows += [(1, 0, 0, 0, k, k, len(sets), [k], bytearray(jaccard.sketch(sets)))]
    rows += [(1, 0, 0, 0, 100, 100, 60, [100], bytearray(jaccard.sketch(common)))]
    dealt = spark.createDataFrame(rows, "key long, a long, b long, side int, fp long, label long, size long, groups array<long>, sketch binary")
    assert {tuple(r) for r in jaccard._uncompared(dealt, Fraction(4, 5)).collect()} == {(0, 100)}


def crowd(n, words, changes, seed):
    """Copies of one text, each with some words of its own: few of all pairs are similar enough."""
    rng = random.Random(seed)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(words)], []
    for i in range(n):
        text = list(base)
        for k in rng.sample(range(words), changes):
            text[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("block", [1 << 18, 1 << 14])
def test_crowds(spark, monkeypatch, block):
    """In one block, and in some ten; pairs are linked through few others, some not at all."""
    monkeypatch.setattr(jaccard, "BLOCK_COST", block)
    rows = crowd(300, 100, 2, 1) + [(1000 + i, t) for i, t in crowd(150, 80, 3, 2)]
    want = brute(rows)
    assert 100 < len(want) < 400
    assert kept(jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want


def test_pairs_that_share_no_group(spark, monkeypatch):
    """With one group for each set, what the groups leave is found by the keys of crowds."""
    monkeypatch.setattr(jaccard, "GROUPS_OF_A_SET", 1)
    rows = crowd(120, 60, 1, 3)
    assert kept(jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(9)]
    for split in (4, 9):
        rest = sets[split:] or sets
        found = jaccard.common_counts(sets, split).tolist()
        assert all(found[i][j] == len(set(a.tolist()) & set(b.tolist())) for i, a in enumerate(sets[:split]) for j, b in enumerate(rest) if a is not b)


@pytest.mark.parametrize("repeat", [False, True])
def test_clashing_names(spark, repeat):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words here")] + [(1, "a b c d e f g h")] * repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_kept_id", "_row_fp", "_kept_fp", "fp", "group", "least", "c0"):
        docs = docs.withColumn(name, docs.text)
    got = jaccard.keep_one(docs)
    assert got.columns == docs.columns and kept(got) == ["1", "3"]
