"""Residue alphabet: encoding, substitution matrices and chemical ranks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The Dayhoff PAM250 matrix, lower triangle in the order of its first column.
_PAM250 = """
A  2
R -2  6
N  0  0  2
D  0 -1  2  4
C -2 -4 -4 -5 12
Q  0  1  1  2 -5  4
E  0 -1  1  3 -5  2  4
G  1 -3  0  1 -3 -1  0  5
H -1  2  2  1 -3  3  1 -2  6
I -1 -2 -2 -2 -2 -2 -2 -3 -2  5
L -2 -3 -3 -4 -6 -2 -3 -4 -2  2  6
K -1  3  1  0 -5  1  0 -2  0 -2 -3  5
M -1  0 -2 -3 -5 -1 -2 -3 -2  2  4  0  6
F -3 -4 -3 -6 -4 -5 -5 -5 -2  1  2 -5  0  9
P  1  0  0 -1 -3  0 -1  0  0 -2 -3 -1 -2 -5  6
S  1  0  1  0  0 -1  0  1 -1 -1 -3  0 -2 -3  1  2
T  1 -1  0  0 -2 -1  0  0 -1  0 -2  0 -1 -3  0  1  3
W -6  2 -4 -7 -8 -5 -7 -7 -3 -5 -2 -3 -4  0 -6 -2 -5 17
Y -3 -4 -2 -4  0 -4 -4 -5  0 -1 -1 -4 -2  7 -5 -3 -3  0 10
V  0 -2 -2 -2 -2 -2 -2 -1 -2  4  2 -2  2 -1 -1 -1  0 -6 -2  4
B  0 -1  2  3 -4  1  3  0  1 -2 -3  1 -2 -4 -1  0  0 -5 -3 -2  3
Z  0  0  1  3 -5  3  3  0  2 -2 -3  0 -2 -5  0  0 -1 -6 -4 -2  2  3
X  0 -1  0 -1 -3 -1 -1 -1 -1 -1 -1 -1 -1 -2 -1  0  0 -4 -2 -1 -1 -1 -1
* -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8 -8  1
"""
# Fixed value: residues in chemical order.
CHEMICAL_ORDER = "GATSDEQNVLIKRMCFYWHP"

MAX_MATRICES = 1000

Scores = dict[tuple[str, str], int]


def parse_triangle(text: str) -> Scores:
    """Symmetric scores from rows of a residue and its scores with the residues so far."""
    rows = [line.split() for line in text.strip().splitlines()]
    residues = [row[0] for row in rows]
    out: Scores = {}
    for row in rows:
        for other, score in zip(residues, row[1:]):
            out[row[0], other] = out[other, row[0]] = int(score)
    return out


def parse_matrix(text: str) -> Scores:
    """Scores from the usual square text form: comment lines with #, a head line of residues, a row for each."""
    lines = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    return {(row[0], other): int(score) for row in lines[1:] for other, score in zip(lines[0], row[1:])}


MATRICES: dict[str, Scores] = {"PAM250": parse_triangle(_PAM250)}


def register_matrix(name: str, scores: Scores) -> None:
    """Makes a matrix known by name; further ones come from their text form through parse_matrix."""
    MATRICES[name] = scores


def read_matrices(spark: SparkSession, folder: str) -> dict[str, Scores]:
    """Matrices by name of the text files in a folder: each file's name without its ending; files are small, a few thousand bytes.

    More than MAX_MATRICES files are an error.
    """
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("name"), "value").limit(MAX_MATRICES + 1).collect()
    if len(files) > MAX_MATRICES:
        raise ValueError(f"{folder} holds more than {MAX_MATRICES} matrices")
    return {r["name"]: parse_matrix(r["value"]) for r in files}


def matrix_table(spark: SparkSession, names: Sequence[str] = ("PAM250",)) -> DataFrame:
    """(name, a, b, score) of the known matrices of those names."""
    return spark.createDataFrame([(n, a, b, score) for n in names for (a, b), score in MATRICES[n].items()], "name string, a string, b string, score int")


def square_text(scores: Scores) -> str:
    """The text form that parse_matrix reads."""
    residues = list(dict.fromkeys(a for a, _ in scores))
    return "\n".join(["   " + "  ".join(residues), *(f"{a} " + " ".join(f"{scores[a, b]:2d}" for b in residues) for a in residues)]) + "\n"


def matrix32(scores: str | Scores = "PAM250") -> np.ndarray:
    """32 x 32 scores indexed by character code & 31; pairs without a score have 0.

    Code & 31 puts `*` on J's place, so J scores as `*` does.
    """
    table = MATRICES[scores] if isinstance(scores, str) else scores
    out = np.zeros((32, 32), np.int32)
    for (a, b), score in table.items():
        out[ord(a) & 31, ord(b) & 31] = score
    return out


def encode(sequence: str) -> np.ndarray:
    """One residue index a character."""
    return np.frombuffer(sequence.encode("ascii", "replace"), np.uint8) & 31


def residue_index(column: Column) -> Column:
    """Residue index of a string's first character."""
    return F.ascii(column).bitwiseAND(31)


def letters_only(column: Column) -> Column:
    """A-Z of a string, upper-cased; a space would fall on the terminator's index."""
    return F.upper(F.regexp_replace(column, "[^A-Za-z]", ""))


def chemical_rank(residue: Column) -> Column:
    """Place in the chemical order, null for any other character."""
    place = F.instr(F.lit(CHEMICAL_ORDER), residue)
    return F.when((F.length(residue) == 1) & (place > 0), place - 1)


def chemical_distance(a: Column, b: Column) -> Column:
    """Difference of chemical ranks; 100 where either is unknown."""
    return F.coalesce(F.abs(chemical_rank(a) - chemical_rank(b)), F.lit(100))
