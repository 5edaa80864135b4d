import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.llm import prefix_trie
from strandloom.session import Workspace

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(sequences):
    """Rows of the trie of {conv_id: [(role, text)]} by listing all prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(sequences):
        for d in range(len(sequences[c]) + 1):
            members[tuple(sequences[c][:d])].append(c)
        ends[tuple(sequences[c])].append(c)
    children = defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, of in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(of) - 1) * len(key[-1][1]) if key else 0
    return sorted(
        (of[0], len(key), members[key[:-1]][0] if key else None, len(of), children[key], leaves[key], saved[key], hashlib.sha256(",".join(map(str, ends[key])).encode()).hexdigest())
        for key, of in members.items()
    )


def plain_turns(rows):
    """{conv_id: [(role, text)]} in order."""
    found = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            found[conv_id].append((turn is not None, turn or 0, role, digest, text))
    return {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in found.items()}


def plain_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


def rows_of(found):
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


def spark_rows(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return frame.withColumns({n: F.lit("x") for n in ("place", "block", "t1", "_part", "turn_id", "key")})


def tried(spark, rows, rebuild):
    work = Workspace(spark, "trie")
    turns = prefix_trie.ordered_turns(spark_rows(spark, rows), work)
    if rebuild:
        return rows_of(prefix_trie.trie(*prefix_trie.with_shared_heads(turns, work), work))
    return rows_of(prefix_trie.trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")), work))


def crowd(seed):
    """Short conversations over few turns, so many prefixes are shared, with nulls, repeats and ties among them."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), 100, 117, 205, 100_000_000_123]:
        for turn in range(rng.choice([1, 1, 2, 3, 7, 8, 9, 16, 17])):
            rows.append((c, rng.choice([turn, turn, turn, None, 2]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "漢😀"])))
    return rows + [(None, 1, "user", "left out"), (None, None, None, None)]


@pytest.mark.parametrize("rebuild", [False, True])
def test_crowds(spark, rebuild):
    rows = crowd(1 + rebuild)
    turns = plain_turns(rows)
    assert tried(spark, rows, rebuild) == plain_trie(plain_rebuilt(turns) if rebuild else turns)


def test_long_and_equal_conversations(spark):
    long = [(c, t, "user", f"turn {t}" if t < 55 or c == 1 else f"own {c}") for c in (1, 2, 3, 5) for t in range(60)]
    equal = [(c, t, "user", "x" * t) for c in range(10, 30) for t in range(8)]
    rows = long + equal + [(31, t, "user", "x" * t) for t in range(9)] + [(32, 0, "user", "")]
    assert tried(spark, rows, False) == plain_trie(plain_turns(rows))


def test_turnless_and_no_conversations(spark):
    rows = [(107, 0, "user", "gone"), (119, 0, "user", "gone too"), (123, 0, "assistant", "?")]
    turns = plain_turns(rows)
    assert any(not x for x in plain_rebuilt(turns).values())
    assert tried(spark, rows, True) == plain_trie(plain_rebuilt(turns))
    only = [r for r in rows if not plain_rebuilt(turns)[r[0]]]
    assert tried(spark, only, True) == plain_trie(plain_rebuilt(plain_turns(only)))
    assert tried(spark, [], True) == []
