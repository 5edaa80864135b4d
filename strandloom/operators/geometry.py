"""Points in space: near pairs, rings, superposition, smoothing and scaling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import cut_lineage

BOND_LENGTH = 1.9
CELL_FACTOR = 2.0 / 1.9
LEAST_SQUARE = 0.01
CELL = ("cx", "cy", "cz")
CORES_AT_ONCE = 4096
PAIRS_AT_ONCE = 1 << 20

TRANSFORM = T.StructType([
    T.StructField("rotation", T.ArrayType(T.DoubleType())), T.StructField("translation", T.ArrayType(T.DoubleType())),
    T.StructField("rmsd", T.DoubleType()), T.StructField("matrix", T.ArrayType(T.DoubleType())),
])


def near_pairs(points: DataFrame, cutoff: float = BOND_LENGTH, *, id_col: str = "id", least_square: float = LEAST_SQUARE, within: list[str] | None = None) -> DataFrame:
    """(i, j, distance_sq) for i < j with least_square < distance^2 <= cutoff^2, among points (id, x, y, z).

    Each point lies in a grid cell no smaller than the cutoff, and is sent to that and the 26 around it; equal cells
    meet. `within` names columns, such as a structure's id, that both points of a pair share.
    """
    within = within or []
    size = cutoff * CELL_FACTOR
    cell = [F.floor(F.col(c) / size).alias(f"c{c}") for c in "xyz"]
    placed = points.select(*within, F.col(id_col).alias("id"), "x", "y", "z", *cell)
    step = F.array(*map(F.lit, (-1, 0, 1)))
    around = placed
    for c in "xyz":
        around = around.withColumn("d", F.explode(step)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("d")).drop("d")
    other = around.select(*within, *[f"c{c}" for c in "xyz"], F.col("id").alias("j"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    pairs = placed.withColumnRenamed("id", "i").join(other, [*within, "cx", "cy", "cz"]).filter("i < j")
    square = sum(((F.col(f"{c}2") - F.col(c)) * (F.col(f"{c}2") - F.col(c)) for c in "xyz"), F.lit(0.0))
    return pairs.withColumn("distance_sq", square).filter((F.col("distance_sq") <= cutoff * cutoff) & (F.col("distance_sq") > least_square)).select(*within, "i", "j", "distance_sq")


def ring_bonds(bonds: DataFrame, sizes: tuple[int, ...] = (5, 6)) -> DataFrame:
    """(i, j, ring_size): bonds whose smallest ring has one of the sizes.

    From one end of each bond the neighbourhood grows step by step without using the bond, each atom once, until the
    other end is met; atoms have few bonds, so a frontier stays small.
    """
    both = cut_lineage(bonds.select("i", "j").union(bonds.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    step = both.select(F.col("i").alias("at"), F.col("j").alias("to"))
    front = bonds.select("i", "j", F.col("i").alias("at"))
    seen = front
    out = None
    for size in range(2, max(sizes) + 1):
        moved = front.join(step, "at").filter(~((F.col("at") == F.col("i")) & (F.col("to") == F.col("j"))))
        reached = moved.select("i", "j", F.col("to").alias("at")).distinct().join(seen, ["i", "j", "at"], "left_anti")
        reached = cut_lineage(reached)
        met = reached.filter(F.col("at") == F.col("j")).select("i", "j", F.lit(size).alias("ring_size"))
        out = met if out is None else out.union(met)
        front = reached.join(met.select("i", "j"), ["i", "j"], "left_anti")
        seen = cut_lineage(seen.union(reached))
    return out.filter(F.col("ring_size").isin(list(sizes)))


def near_rings(points: DataFrame, cutoff: float = BOND_LENGTH, *, id_col: str = "id", least_square: float = LEAST_SQUARE) -> DataFrame:
    """(i, j, ring_size): bonds between near points, as near_pairs has them, whose smallest ring has five or six points.

    In a crowd nearly every bond has a ring of three, and bonds grow with the square of its points; so bonds are not
    made into rows. Points of a cell meet those within a bond's length of it, and only bonds whose ends have no common
    neighbour leave the task. These then meet the points within three lengths, as far as a ring of six reaches.
    Points without an id or a finite place have no bonds. An id with several places has the bonds of all of them;
    where there is one, bonds are made and ring_bonds goes through them.
    """
    finite = [F.abs(c) < float("inf") for c in "xyz"]  # neither nulls nor NaN
    points = cut_lineage(points.select(F.col(id_col).alias("id"), "x", "y", "z").filter(F.col("id").isNotNull() & finite[0] & finite[1] & finite[2]).distinct())
    if not points.groupBy("id").count().filter("count > 1").isEmpty():
        return ring_bonds(near_pairs(points, cutoff, least_square=least_square).select("i", "j").distinct())
    length = cutoff * CELL_FACTOR
    kind = points.schema["id"].dataType.simpleString()

    def near(place: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Which of the places (3 x n, by x) are bonded to a point, the nearest first."""
        low, high = np.searchsorted(place[0], (point[0] - length, point[0] + length))
        square = _squares(point[:, None], place[:, low:high])[0]
        found = np.flatnonzero((square <= cutoff * cutoff) & (square > least_square))
        return found[np.argsort(square[found], kind="stable")] + low

    def bonded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        square = _squares(a, b)
        return (square <= cutoff * cutoff) & (square > least_square)

    def without_triangle(cores: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        ids, place = _by_x(around)
        out = []
        for i, point in zip(cores["id"].to_numpy(), cores[list("xyz")].to_numpy(float)):
            others = near(place, point)
            left, at, size = others[ids[others] > i], 0, 8
            while len(left) and at < len(others):  # a few of the nearest rule out most
                left = left[~bonded(place[:, left], place[:, others[at : at + size]]).any(axis=1)]
                at, size = at + size, max(8, min(4 * size, PAIRS_AT_ONCE // max(1, len(left))))
            out += [(i, *point, ids[j], *place[:, j]) for j in left]
        return pd.DataFrame(out, columns=["id", "x", "y", "z", "j", "x2", "y2", "z2"])

    def rings(cores: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        ids, place = _by_x(around)
        steps: dict[int, np.ndarray] = {}

        def onward(at: np.ndarray, end: object) -> np.ndarray:
            """Where a step from these leads, but for one end."""
            for k in at.tolist():
                if k not in steps:
                    steps[k] = near(place, place[:, k])
            to = np.unique(np.concatenate([steps[k] for k in at.tolist()]))
            return to[ids[to] != end]

        def meet(a: np.ndarray, b: np.ndarray) -> bool:
            size = max(1, PAIRS_AT_ONCE // max(1, len(b)))
            return any(bonded(place[:, a[k : k + size]], place[:, b]).any() for k in range(0, len(a), size))

        out = []
        for i, j, one, other in zip(cores["id"].to_numpy(), cores["j"].to_numpy(), cores[["x", "y", "z"]].to_numpy(float), cores[["x2", "y2", "z2"]].to_numpy(float)):
            a, b = near(place, one), near(place, other)
            a, b = a[ids[a] != j], b[ids[b] != i]
            if not len(a) or not len(b) or meet(a, b):  # no ring, or one of four
                continue
            a, b = onward(a, i), onward(b, j)
            if len(np.intersect1d(a, b, assume_unique=True)):
                out.append((i, j, 5))
            elif meet(a, b):
                out.append((i, j, 6))
        return pd.DataFrame(out, columns=["i", "j", "ring_size"])

    left = cut_lineage(_with_surroundings(points, points, 2 * length, length, without_triangle, f"id {kind}, x double, y double, z double, j {kind}, x2 double, y2 double, z2 double"))
    return _with_surroundings(left, points, 4 * length, 3 * length, rings, f"i {kind}, j {kind}, ring_size int")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances (n x m) of points a (3 x n) and b (3 x m), added in the order of SQL."""
    x, y, z = (b[k] - a[k][:, None] for k in range(3))
    return x * x + y * y + z * z


def _by_x(points: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and places (3 x n), sorted by x."""
    points = points.sort_values("x")
    return points["id"].to_numpy(), np.ascontiguousarray(points[list("xyz")].to_numpy(float).T)


def _with_surroundings(cores: DataFrame, points: DataFrame, side: float, reach: float, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What the kernel makes of the cores of each grid cell and the points up to `reach` from the cell.

    A cell of more than CORES_AT_ONCE cores is several groups, each with all points around it.
    """
    placed = cores.withColumns({f"c{c}": F.floor(F.col(c) / side) for c in "xyz"})
    parts = placed.groupBy(*CELL).agg(F.ceil(F.count("*") / CORES_AT_ONCE).cast("int").alias("parts"))
    mine = placed.join(parts, list(CELL)).withColumn("part", F.pmod(F.xxhash64(*cores.columns), "parts").cast("int")).drop("parts")
    around = points.select(*[F.col(c).alias(c) for c in points.columns])  # not the columns of the cores
    for c in "xyz":
        around = around.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))))
    around = around.join(parts, list(CELL)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys, n = [*CELL, "part"], int(cores.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: small rows, long work
    both = [df.repartition(n, *keys).groupBy(*keys) for df in (mine, around)]
    return both[0].cogroup(both[1]).applyInPandas(kernel, schema)


def superposition_sums(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """The sums over point pairs (arrays of three) that a superposition needs, by group."""
    p, q = [F.col(a)[i] for i in range(3)], [F.col(b)[i] for i in range(3)]
    sums = [F.count("*").alias("n"), F.sum(sum(x * x for x in p)).alias("aa"), F.sum(sum(x * x for x in q)).alias("bb")]
    sums += [F.sum(p[i]).alias(f"a{i}") for i in range(3)] + [F.sum(q[i]).alias(f"b{i}") for i in range(3)]
    sums += [F.sum(p[i] * q[j]).alias(f"a{i}b{j}") for i in range(3) for j in range(3)]
    return pairs.groupBy(*keys).agg(*sums)


def superpose(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, n and a transform struct for each group: the rotation and translation that best take a onto b.

    rotation (row by row) and translation act on columns: b ~ R a + t; matrix is the flat 4 x 4 form. Only eighteen
    sums of a group reach the 3 x 3 decomposition.
    """
    sums = superposition_sums(pairs, keys, a, b)
    names = [*[f"a{i}" for i in range(3)], *[f"b{i}" for i in range(3)], *[f"a{i}b{j}" for i in range(3) for j in range(3)]]

    @F.pandas_udf(TRANSFORM)
    def solve(n: pd.Series, aa: pd.Series, bb: pd.Series, sums: pd.DataFrame) -> pd.DataFrame:
        out = []
        for count, square_a, square_b, s in zip(n, aa, bb, sums[names].to_numpy(float)):
            mean_a, mean_b, cross = s[:3] / count, s[3:6] / count, s[6:].reshape(3, 3)
            cov = cross - count * np.outer(mean_a, mean_b)
            left, size, right = np.linalg.svd(cov)
            turn = np.diag([1.0, 1.0, np.sign(np.linalg.det(right.T @ left.T)) or 1.0])
            r = right.T @ turn @ left.T
            t = mean_b - r @ mean_a
            rest = (square_a - count * mean_a @ mean_a) + (square_b - count * mean_b @ mean_b) - 2 * (size * np.diag(turn)).sum()
            whole = np.eye(4)
            whole[:3, :3], whole[:3, 3] = r, t
            out.append((r.ravel().tolist(), t.tolist(), float(np.sqrt(max(rest, 0.0) / count)), whole.ravel().tolist()))
        return pd.DataFrame(out, columns=TRANSFORM.names)

    return sums.select(*keys, "n", solve("n", "aa", "bb", F.struct(*names)).alias("transform"))


def apply_transform(point: Column, transform: Column) -> Column:
    """R p + t of an array of three."""
    r, t = transform["rotation"], transform["translation"]
    return F.array(*[sum((r[3 * i + j] * point[j] for j in range(3)), t[i]) for i in range(3)])


def superposition_json(name_a: Column, name_b: Column, transform: Column, digits: int) -> Column:
    """A superposition as a JSON object of both names, RMSD, rotation matrix and translation vector, to that many digits."""
    whole = lambda x: F.round(x, digits) + F.lit(0.0)  # noqa: E731  no negative zeros
    r = transform["rotation"]
    matrix = F.array(*[F.array(*[whole(r[3 * i + j]) for j in range(3)]) for i in range(3)])
    return F.to_json(F.struct(
        name_a.alias("protein_A"), name_b.alias("protein_B"), whole(transform["rmsd"]).alias("rmsd"), matrix.alias("rotation_matrix"), F.transform(transform["translation"], whole).alias("translation_vector"),
    ))


def smoothed(points: DataFrame, keys: list[str], order: list[str], coords: tuple[str, ...] = ("x", "y", "z"), amount: float = 0.5) -> DataFrame:
    """points with each coordinate moved by `amount` towards its nearest place on the segment between its neighbours.

    First and last points of a chain stay.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after = {c: F.lag(c).over(w) for c in coords}, {c: F.lead(c).over(w) for c in coords}
    length = sum(((after[c] - before[c]) * (after[c] - before[c]) for c in coords), F.lit(0.0))
    along = sum(((F.col(c) - before[c]) * (after[c] - before[c]) for c in coords), F.lit(0.0))
    t = F.when(length > 0, F.least(F.greatest(along / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    new = {f"smooth_{c}": F.coalesce(F.col(c) + amount * (before[c] + t * (after[c] - before[c]) - F.col(c)), F.col(c)) for c in coords}
    return points.withColumns(new)


def scaled(points: DataFrame, keys: list[str], target: float = 1.0) -> DataFrame:
    """keys, centre (cx, cy, cz), radius, and the factor that brings the farthest point to `target` from the centre."""
    centre = points.groupBy(*keys).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    far = F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0)))
    out = points.join(centre, keys).groupBy(*keys, "cx", "cy", "cz").agg(F.max(far).alias("radius"))
    return out.withColumn("factor", F.when(F.col("radius") > 0, target / F.col("radius")).otherwise(1.0))
