import hashlib
import math
import zlib
from collections import defaultdict

import pytest

from strandloom.llm import sharding


def place(key, weights):
    u = lambda i: (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return min(range(len(weights)), key=lambda i: (-math.log(u(i)) / weights[i], i))


def test_against_brute_force(odd_documents, no_documents):
    rows = sharding.shard(odd_documents).collect()
    given = odd_documents.collect()
    assert len(rows) == len(given)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in given)
    slots = defaultdict(list)
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (place(key, [1.0] * 24), place(key, [1.0] * 25))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(no_documents).count() == 0


def test_growth_weights_and_prefixes(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = sharding.shard(docs, prefix_digits=1).collect()
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows)
    assert 100 < sum(r["grown_shard"] == 24 for r in rows) < 400
    by_default = {(r["doc_id"], r["slot"]) for r in sharding.shard(docs).collect()}
    assert by_default == {(r["doc_id"], r["slot"]) for r in rows}
    heavy = sharding.shard(docs, weights=(1.0, 3.0)).filter("shard = 1").count()
    assert 4300 < heavy < 4700
    with pytest.raises(ValueError):
        sharding.rendezvous(docs.doc_id.cast("string"), (1.0, 0.0))


def test_hot_key(spark):
    docs = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "cast(id as string) as text")
    slots = defaultdict(list)
    for r in sharding.shard(docs).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
