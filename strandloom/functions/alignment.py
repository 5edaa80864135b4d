"""Local alignment with a linear gap penalty.

The row recurrence H[j] = max(0, diagonal + s, up - g, left - g) is swept a row at a time for a whole block of
targets. A run of left steps costs g each, so with G[j] = H[j] + g j the row is a running maximum: of
G'[j - 1] + s + g, G'[j] - g and g j, where G' is the row before. Targets lie side by side, so every step is a plain
vector operation, in 16 bits where no score can leave them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.alphabet import Scores, encode, matrix32

GAP = 10
BLOCK_CELLS = 1 << 17
KEPT_ROWS = 64

ALIGNMENT = T.StructType([
    T.StructField("score", T.IntegerType()), T.StructField("aligned_a", T.StringType()), T.StructField("aligned_b", T.StringType()),
    T.StructField("a_start", T.IntegerType()), T.StructField("a_end", T.IntegerType()),
    T.StructField("b_start", T.IntegerType()), T.StructField("b_end", T.IntegerType()),
])


def batch_scores(query: np.ndarray, targets: Sequence[np.ndarray], matrix: np.ndarray, gap: int = GAP) -> np.ndarray:
    """Best local score of the query with each target. Targets of like length share a padded block, so little is wasted."""
    out = np.zeros(len(targets), np.int32)
    if not len(query):
        return out
    sizes = np.fromiter(map(len, targets), np.int64, len(targets))
    order = np.argsort(-sizes, kind="stable")
    at, end = 0, int((sizes > 0).sum())
    while at < end:
        width = int(sizes[order[at]])
        block = order[at : min(end, at + max(1, BLOCK_CELLS // width))]
        out[block] = _block_scores(query, [targets[i] for i in block], width, matrix, gap)
        at += len(block)
    return out


def _block_scores(query: np.ndarray, targets: Sequence[np.ndarray], width: int, matrix: np.ndarray, gap: int) -> np.ndarray:
    most = (width + 1) * gap + min(len(query), width) * int(matrix.max()) + int(matrix.max()) + gap
    kind, never = (np.int16, -8000) if most < 30_000 and matrix.min() > -8000 else (np.int32, -(1 << 20))
    block = np.full((width, len(targets)), 32, np.uint8)  # column 32: padding that no path crosses
    for i, target in enumerate(targets):
        block[: len(target), i] = target
    wide = np.full((32, 33), never, kind)
    wide[:, :32] = matrix + gap
    scored = {int(r): wide[r][block] for r in np.unique(query)}
    steps = (np.arange(1, width + 1) * gap).astype(kind)[:, None]
    row, up = np.empty((width, len(targets)), kind), np.empty((width, len(targets)), kind)
    above = np.zeros((width + 1, len(targets)), kind)
    above[1:] = steps
    best = above[1:].copy()
    for residue in query.tolist():
        np.add(above[:-1], scored[residue], out=row)
        np.subtract(above[1:], kind(gap), out=up)
        np.maximum(row, up, out=row)
        np.maximum(row, steps, out=row)
        np.maximum.accumulate(row, axis=0, out=above[1:])
        np.maximum(best, above[1:], out=best)
    return (best - steps).max(axis=0)


def _rows(x: np.ndarray, y: np.ndarray, first: np.ndarray, matrix: np.ndarray, gap: int) -> Iterator[np.ndarray]:
    """The rows of the score table for the residues x, each after the one before; first is the row above them."""
    steps = np.arange(len(y), dtype=np.int32) * gap
    scored = {int(r): matrix[r][y] for r in np.unique(x)}
    above = first
    for residue in x.tolist():
        row = np.zeros(len(y) + 1, np.int32)
        cells = np.maximum(np.maximum(above[:-1] + scored[residue], above[1:] - gap), 0) + steps
        np.maximum.accumulate(cells, out=cells)
        row[1:] = cells - steps
        yield row
        above = row


def align(a: str, b: str, matrix: np.ndarray, gap: int = GAP) -> tuple | None:
    """(score, aligned_a, aligned_b, a_start, a_end, b_start, b_end), starts and ends 0-based and inclusive; None without a positive score.

    The end is the first best cell by rows. Going back, a diagonal step is preferred to a gap in b, that to a gap in a.
    Memory is linear in b: of the table some KEPT_ROWS rows are kept, and the way back makes the rows between two of
    them anew, in the same manner where there are many, and only up to the column where it stands.
    """
    x, y = encode(a), encode(b)
    if not len(x) or not len(y):
        return None
    best, end, kept = 0, (0, 0), [np.zeros(len(y) + 1, np.int32)]
    every = -(-len(x) // KEPT_ROWS)
    for n, row in enumerate(_rows(x, y, kept[0], matrix, gap), 1):
        if (most := int(row.max())) > best:
            best, end = most, (n, int(row.argmax()))
        if n % every == 0:
            kept.append(row)
    if best <= 0:
        return None
    i, j = end
    top: list[str] = []
    bottom: list[str] = []
    if every == 1:  # all rows are there
        i, j, _ = _walk(a, b, x, y, 0, i, j, kept, matrix, gap, top, bottom)
    else:
        for k in range((i - 1) // every, -1, -1):
            i, j, done = _back(a, b, x, y, k * every, i, j, kept[k], matrix, gap, top, bottom)
            kept.pop()
            if done:
                break
    return best, "".join(reversed(top)), "".join(reversed(bottom)), i, end[0] - 1, j, end[1] - 1


def _back(a: str, b: str, x: np.ndarray, y: np.ndarray, low: int, i: int, j: int, first: np.ndarray, matrix: np.ndarray, gap: int, top: list[str], bottom: list[str]) -> tuple[int, int, bool]:
    """Goes back from cell (i, j) to row `low`, which is `first`, or to a cell without a score; where it stands, and whether that is the start."""
    y, first = y[:j], first[: j + 1]
    if i - low > KEPT_ROWS:
        every = -(-(i - low) // KEPT_ROWS)
        kept = [first] + [row for n, row in enumerate(_rows(x[low:i], y, first, matrix, gap), 1) if n % every == 0]
        for k in range((i - low - 1) // every, -1, -1):
            i, j, done = _back(a, b, x, y, low + k * every, i, j, kept[k], matrix, gap, top, bottom)
            if done:
                return i, j, True
        return i, j, False
    return _walk(a, b, x, y, low, i, j, [first, *_rows(x[low:i], y, first, matrix, gap)], matrix, gap, top, bottom)


def _walk(a: str, b: str, x: np.ndarray, y: np.ndarray, low: int, i: int, j: int, h: Sequence[np.ndarray], matrix: np.ndarray, gap: int, top: list[str], bottom: list[str]) -> tuple[int, int, bool]:
    """_back with the rows from `low` on at hand."""
    while h[i - low][j] > 0:
        if i == low:
            return i, j, False
        now, above = int(h[i - low][j]), h[i - low - 1]
        if now == int(above[j - 1]) + int(matrix[x[i - 1], y[j - 1]]):
            i, j = i - 1, j - 1
            top.append(a[i])
            bottom.append(b[j])
        elif now == int(above[j]) - gap:
            i -= 1
            top.append(a[i])
            bottom.append("-")
        else:
            j -= 1
            top.append("-")
            bottom.append(b[j])
    return i, j, True


def sw_align(weights: str | Scores = "PAM250", gap: int = GAP):
    """A pandas UDF (a, b) -> ALIGNMENT struct, null where nothing aligns. For survivors of a score filter."""
    matrix = matrix32(weights)

    @F.pandas_udf(ALIGNMENT)
    def udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [align(x, y, matrix, gap) if x and y else None for x, y in zip(a, b)]
        return pd.DataFrame([f or (None,) * 7 for f in found], columns=ALIGNMENT.names).astype({n: "Int32" for n in ALIGNMENT.names if not n.startswith("aligned")})

    return udf


def sw_score(weights: str | Scores = "PAM250", gap: int = GAP):
    """A pandas UDF (a, b) -> best local score; 0 for null or empty sequences."""
    matrix = matrix32(weights)

    @F.pandas_udf(T.IntegerType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([int(batch_scores(encode(x), [encode(y)], matrix, gap)[0]) if x and y else 0 for x, y in zip(a, b)])

    return udf


class AlignColumns:
    """UDTF align_columns(a, b): a row (place from 1, residue_a, residue_b, mark) for each column of the alignment of two sequences; none if nothing aligns.

    A gap is '-'; mark is | for equal residues, . for different ones, a space at gaps.
    """

    def __init__(self) -> None:
        self.matrix = matrix32("PAM250")

    def eval(self, a: str, b: str) -> Iterator[tuple[int, str, str, str]]:
        found = align(a, b, self.matrix) if a and b else None
        for place, (x, y) in enumerate(zip(*found[1:3]) if found else (), 1):
            yield place, x, y, " " if "-" in (x, y) else "|" if x == y else "."


def register(spark: SparkSession) -> None:
    """SQL functions sw_score(a, b), sw_align(a, b), identity_percent(aligned_a, aligned_b), and the table function align_columns(a, b)."""
    spark.udf.register("sw_score", sw_score())
    spark.udf.register("sw_align", sw_align())
    spark.udtf.register("align_columns", F.udtf(AlignColumns, returnType="place int, residue_a string, residue_b string, mark string"))
    same = "size(filter(arrays_zip(split(a, ''), split(b, '')), z -> z['0'] = z['1'] AND z['0'] <> '-'))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION identity_percent(a STRING, b STRING) RETURNS DOUBLE RETURN try_divide(100.0D * {same}, length(a))")


def _columns(a: Column, b: Column) -> Column:
    return F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))


def match_line(a: Column, b: Column) -> Column:
    """Under each alignment column: | for equal residues, . for different ones, a space at gaps."""
    mark = lambda x, y: F.when((x == "-") | (y == "-"), " ").when(x == y, "|").otherwise(".")
    return F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), mark), "")


def identities(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Equal residues, alignment columns, and columns without a gap, of two aligned strings."""
    line = match_line(a, b)
    count = lambda mark: F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))
    return count("|"), F.length(a), F.length(a) - count(" ")


def identity_percent(a: Column, b: Column, ungapped: bool = False) -> Column:
    """Equal residues in percent of all alignment columns, or of those without a gap."""
    same, columns, open_columns = identities(a, b)
    return F.try_divide(100.0 * same, open_columns if ungapped else columns)


def blocked_text(a: Column, b: Column, a_start: Column, b_start: Column, width: int = 70) -> Column:
    """The alignment in rows of `width` columns with running 1-based positions."""
    line = match_line(a, b)
    residues = lambda s, upto: F.length(F.replace(F.substring(s, F.lit(1), upto), F.lit("-"), F.lit("")))

    def rows(k: Column) -> Column:
        at = k * width
        cut = lambda s: F.substring(s, at + 1, F.lit(width))
        number = lambda s, start: F.lpad((start + 1 + residues(s, at)).cast("string"), 6, " ")
        return F.concat_ws("\n", F.concat(number(a, a_start), F.lit("  "), cut(a)), F.concat(F.lit(" " * 8), cut(line)), F.concat(number(b, b_start), F.lit("  "), cut(b)))

    count = F.ceil(F.length(a) / width).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), rows), "\n\n")
