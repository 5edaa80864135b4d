import itertools
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.alphabet import CHEMICAL_ORDER
from strandloom.operators import geometry, integrity, ordering, patterns
from strandloom.session import shared_folder


def test_near_pairs(spark):
    rng = np.random.default_rng(0)
    points = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-5, 5, (120, 3)))] + [(500, 0.0, 0.0, 0.0), (501, 0.0, 0.0, 0.0), (502, 1.9, 0.0, 0.0)]
    got = sorted((r["i"], r["j"]) for r in geometry.near_pairs(spark.createDataFrame(points, "id long, x double, y double, z double")).collect())
    want = [(a[0], b[0]) for a, b in itertools.combinations(points, 2) if 0.01 < sum((x - y) ** 2 for x, y in zip(a[1:], b[1:])) <= 1.9**2]
    assert got == sorted(want)


def test_rings(spark):
    six = [(i, (i + 1) % 6) for i in range(6)]
    five = [(10 + i, 10 + (i + 1) % 5) for i in range(5)]
    other = [(5, 10), (20, 21), (21, 22), (22, 20), *[(30 + i, 30 + (i + 1) % 7) for i in range(7)]]
    bonds = [(min(b), max(b)) for b in six + five + other]
    got = {(r["i"], r["j"]): r["ring_size"] for r in geometry.ring_bonds(spark.createDataFrame(bonds, "i long, j long")).collect()}
    assert got == {(min(b), max(b)): 6 for b in six} | {(min(b), max(b)): 5 for b in five}


def rings_by_hand(points, cutoff, least_square):
    near = {i: {j for j, *q in points if least_square < sum((x - y) ** 2 for x, y in zip(p, q)) <= cutoff**2} for i, *p in points}
    out = set()
    for i, j in ((i, j) for i in near for j in near[i] if i < j and not near[i] & near[j]):
        front, seen = {i}, {i}
        for size in range(2, 7):
            front = set().union(*({k for k in near[a] if (a, k) != (i, j)} for a in front)) - seen
            seen |= front
            if j in front:
                out |= {(i, j, size)} if size > 4 else set()
                break
    return out


def test_near_rings_without_bonds_as_rows(spark, tmp_path):
    """A crowd of some 30,000 bonds beside rings of five, six and seven, copies of a point, and odd places."""
    rng = np.random.default_rng(4)
    crowd = rng.normal(scale=0.3, size=(250, 3))
    ring = lambda n, x: [(x + 0.8 / np.sin(np.pi / n) * np.cos(2 * np.pi * k / n), 0.8 / np.sin(np.pi / n) * np.sin(2 * np.pi * k / n), -7.0) for k in range(n)]
    places = [*crowd, *ring(5, -9.0), *ring(6, 0.0), *ring(7, 9.0), *ring(6, 20.0), ring(6, 20.0)[0], *rng.uniform(-2.5, 2.5, size=(60, 3)), *rng.uniform(30, 38, size=(120, 3))]
    points = [(int(i), *map(float, p)) for i, p in zip(rng.permutation(len(places)), places)]
    odd = [(9000, math.nan, 0.0, 0.0), (9001, math.inf, 0.0, 0.0), (9002, None, 0.0, 0.0), (None, 0.0, 0.0, 0.1), points[0]]
    frame = spark.createDataFrame(points + odd, "id long, x double, y double, z double")
    size = lambda: sum(f.stat().st_size for f in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if f.is_file())
    before = size()
    got = [tuple(r) for r in geometry.near_rings(frame).collect()]
    assert size() - before < 2_000_000
    want = rings_by_hand(points, 1.9, 0.01)
    assert len(got) == len(set(got)) and set(got) == want and {n for _, _, n in want} == {5, 6}


@pytest.mark.parametrize("cores", [1, 7])
def test_near_rings_of_cells_in_parts(spark, monkeypatch, cores):
    monkeypatch.setattr(geometry, "CORES_AT_ONCE", cores)
    monkeypatch.setattr(geometry, "PAIRS_AT_ONCE", 16)
    rng = np.random.default_rng(5)
    points = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 8, size=(150, 3)))]
    got = geometry.near_rings(spark.createDataFrame(points, "id long, x double, y double, z double")).collect()
    assert {tuple(r) for r in got} == rings_by_hand(points, 1.9, 0.01) != set()


def test_near_rings_of_an_id_with_two_places(spark):
    chain = [(k, 1.8 * k, 0.0, 0.0) for k in range(5)] + [(0, 1.8 * 5, 0.0, 0.0)]  # five ids, closed by the first one's other place
    got = geometry.near_rings(spark.createDataFrame(chain, "id long, x double, y double, z double")).collect()
    assert {tuple(r) for r in got} == {(0, 1, 5), (1, 2, 5), (2, 3, 5), (3, 4, 5), (0, 4, 5)}


def test_superposition(spark):
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    shift, a = np.array([1.0, -2.0, 3.0]), rng.normal(size=(20, 3))
    rows = [("g", x.tolist(), (turn @ x + shift).tolist()) for x in a] + [("h", x.tolist(), rng.normal(size=3).tolist()) for x in a]
    pairs = spark.createDataFrame(rows, "k string, a array<double>, b array<double>")
    found = geometry.superpose(pairs, ["k"])
    t = {r["k"]: r["transform"] for r in found.collect()}
    assert np.allclose(np.reshape(t["g"]["rotation"], (3, 3)), turn) and np.allclose(t["g"]["translation"], shift) and t["g"]["rmsd"] < 1e-6
    assert np.allclose(np.reshape(t["g"]["matrix"], (4, 4))[:3, 3], shift)
    moved = pairs.join(found, "k").select("k", "b", geometry.apply_transform(F.col("a"), F.col("transform")).alias("m")).filter("k = 'h'").collect()
    assert np.sqrt(np.mean([np.sum((np.array(r["m"]) - r["b"]) ** 2) for r in moved])) == pytest.approx(t["h"]["rmsd"])


def test_smoothing_and_scaling(spark):
    points = spark.createDataFrame([("c", i, float(i), float(i == 1), 0.0) for i in range(3)], "k string, n int, x double, y double, z double")
    got = geometry.smoothed(points, ["k"], ["n"]).orderBy("n").collect()
    assert [(r["smooth_x"], r["smooth_y"]) for r in got] == [(0.0, 0.0), (1.0, 0.5), (2.0, 0.0)]
    s = geometry.scaled(points.withColumn("y", F.lit(0.0)), ["k"], 5.0).first()
    assert (s["cx"], s["radius"], s["factor"]) == (1.0, 1.0, 5.0)


def period(seq, i, periods=patterns.PERIODS, chem=False):
    rank = {c: n for n, c in enumerate(CHEMICAL_ORDER)}
    gap = lambda a, b: abs(rank[a] - rank[b]) if a in rank and b in rank else 100
    best = (0, 0.0)
    for p in periods:
        got = []
        for k, arm in itertools.product(range(p), (1, 2)):
            if i + k + arm * p < len(seq):
                a, b = seq[i + k], seq[i + k + arm * p]
                got.append(1.0 if a == b else 0.7 if chem and gap(a, b) <= 3 else 0.3 if chem and arm == 1 and gap(a, b) <= 5 else 0.0)
        score = sum(got) / len(got) if got else 0
        if score > best[1] * 1.1:
            best = (p, score)
    return best


@pytest.mark.parametrize("chem", [False, True])
def test_periods(spark, chem):
    seqs = ["ABABABABAB", "GATGATGATC", "ACDEFGACDEFGACDEFG", "KXKRKKRK", "A", ""]
    frame = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", F.explode(F.sequence(F.lit(0), F.greatest(F.length("s") - 1, F.lit(0)))).alias("i"))
    for r in frame.select("s", "i", patterns.period_at(F.col("s"), F.col("i"), (2, 3, 6), chem).alias("p")).collect():
        p, score = period(r["s"], r["i"], (2, 3, 6), chem)
        assert r["p"]["period"] == p and r["p"]["score"] == pytest.approx(score)


def test_rotation_mosaic_and_rows(spark):
    rotate = lambda u: spark.createDataFrame([(u,)], "u string").select(patterns.canonical_rotation(F.col("u")).alias("r")).first()["r"]
    assert rotate("TGA") == "GAT" and rotate("PG") == "GP" and rotate("") == ""
    row = spark.createDataFrame([("PGAX", "")], "s string, e string").select(patterns.mosaic(F.col("s"), 3).alias("m"), patterns.mosaic(F.col("e"), 3).alias("e")).first()
    assert row["m"] == ["GP", "GAP", "GAX", "AX"] and row["e"] == []
    even = spark.createDataFrame([("PZXGBA",)], "s string").select(*[patterns.mosaic(F.col("s"), w).alias(f"w{w}") for w in (1, 2, 4, 5)]).first()
    assert even["w1"] == even["w2"] == list("PZXGBA") and even["w4"] == ["PZ", "PZX", "GZX", "GXB", "GAB", "AB"]
    assert even["w5"] == ["PZX", "GPZX", "GPZXB", "GAZXB", "GAXB", "GAB"]  # unknown ones stay in order
    spans = spark.createDataFrame([([(1, 5), (2, 3), (4, 9), (6, 7)],)], "v array<struct<start:int,end:int>>")
    assert spans.select(patterns.two_rows(F.col("v")).alias("r")).first()["r"] == [0, 1, 1, 0]


def test_numbering_and_sums(spark):
    rows = [(i, (i * 37) % 101) for i in range(101)]
    frame = spark.createDataFrame(rows, "id long, size long").repartition(5)
    got = {r["id"]: (r["rank"], r["total"]) for r in ordering.numbered(frame, [F.desc("size"), F.asc("id")], {"total": F.col("size")}).collect()}
    total = 0
    for n, (i, size) in enumerate(sorted(rows, key=lambda r: -r[1])):
        total += size
        assert got[i] == (n + 1, total)


def test_integrity(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "x")], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (5, "x")], "k int, v string")
    assert {r["k"]: r["status"] for r in integrity.zip_compare(left, right, "k", ["v"]).collect()} == {1: "equal", 2: "v differs", 3: "equal", 4: "left only", 5: "right only"}
    assert ordering.is_permutation(spark.range(5), "id").first()[0] is True
    assert ordering.is_permutation(spark.range(1, 5), "id").first()[0] is False
