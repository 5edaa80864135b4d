import random
import re

import numpy as np
import xxhash

from strandloom.llm import simhash
from tests.llm.conftest import prose


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """Least member of each fingerprint's component, by comparing all pairs."""
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


def test_keys_meet_up_to_two_bits():
    rng, errors = random.Random(0), simhash.golay_errors()
    assert (errors >= 0).all() and np.bitwise_count(errors).max() == 3
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        where, keys = simhash.fuzzy_keys(np.array([a, b], np.uint64), errors)
        assert set(keys[where == 0]) & set(keys[where == 1])
        assert np.bincount(where).max() <= 18


def test_links_of_close_and_crowded_fingerprints(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for start in list(fps)[:20]:
        for _ in range(12):  # chains of near fingerprints
            start ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            fps.add(start)
    middle = rng.getrandbits(64)
    fps |= {middle ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}  # a crowd around one fingerprint
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    from strandloom.operators.components import connected_components

    for spread in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", spread)
        got = connected_components(simhash.links(frame)).collect()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        group = {r["node"] & (2**64 - 1): r["component"] for r in got}
        want = components(fps)
        mine = {f: group.get(f, f) for f in fps}
        assert len({(mine[f], want[f]) for f in fps}) == len(set(want.values())) == len(set(mine.values()))


def brute(documents):
    fps = [(i, slow_fingerprint(t)) for i, t in documents]
    of = components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    return sorted((str(i), f"{f:016x}", str(least.get(of[f]))) for i, f in fps)


def test_odd_documents(odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == brute([(r["doc_id"], r["text"]) for r in odd_documents.collect()])
    assert simhash.near_duplicates(no_documents).count() == 0


def test_fingerprints_of_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_one_of_each_group_stays(spark, odd_documents, no_documents):
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    groups = {r["component_id"] for r in simhash.near_duplicates(odd_documents).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(groups) and set(ids) == groups
    assert simhash.keep_one(no_documents).count() == 0
    plain = spark.createDataFrame([(i, prose(i % 7, 80), "en") for i in range(30)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(plain).collect()) == list(range(7))
