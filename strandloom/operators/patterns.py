"""Periods, windows and layouts along sequences, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.alphabet import CHEMICAL_ORDER, chemical_distance, chemical_rank

PERIODS = (2, 3, 4, 5, 6, 7)
PREFERENCE = 1.1


def canonical_rotation(unit: Column) -> Column:
    """The rotation of a repeat unit that is least in chemical order; unknown residues rank with the first."""
    rank = lambda r: F.coalesce(chemical_rank(r), F.lit(0))
    ranks = F.transform(F.split(unit, ""), rank)
    n = F.length(unit)

    def rotated(i: Column) -> Column:
        turned = F.concat(F.slice(ranks, i + 1, n), F.slice(ranks, F.lit(1), i))
        text = F.concat(F.substring(unit, i + 1, n), F.substring(unit, F.lit(1), i))
        return F.struct(turned.alias("ranks"), text.alias("text"))

    return F.when(n > 0, F.array_min(F.transform(F.sequence(F.lit(0), n - 1), rotated)).getField("text")).otherwise(unit)


def period_at(sequence: Column, index: Column, periods: Sequence[int] = PERIODS, chemical: bool = False) -> Column:
    """Struct (period, score) of the best period from 0-based `index` on, (0, 0.0) if none matches.

    Of a period's residues each is compared with those one and two periods on, as far as the sequence goes. Equal
    residues count 1; with `chemical`, like ones 0.7, and less like ones 0.3 in the first comparison. A longer period
    must beat a shorter one by a tenth.
    """
    at = lambda i: F.substring(sequence, i + 1, F.lit(1))
    n = F.length(sequence)
    scores = []
    for p in periods:
        matched, compared = F.lit(0.0), F.lit(0)
        for k in range(p):
            for arm in (1, 2):
                there = index + k + arm * p
                a, b = at(index + k), at(there)
                worth = F.when(a == b, 1.0)
                if chemical:
                    distance = chemical_distance(a, b)
                    worth = worth.when(distance <= 3, 0.7)
                    worth = worth.when(distance <= 5, 0.3) if arm == 1 else worth
                matched = matched + F.when(there < n, worth.otherwise(0.0)).otherwise(0.0)
                compared = compared + F.when(there < n, 1).otherwise(0)
        scores.append(F.struct(F.lit(p).alias("period"), F.coalesce(F.try_divide(matched, compared), F.lit(0.0)).alias("score")))
    none = F.struct(F.lit(0).alias("period"), F.lit(0.0).alias("score"))
    return F.aggregate(F.array(*scores), none, lambda best, s: F.when(s["score"] > best["score"] * PREFERENCE, s).otherwise(best))


def mosaic(sequence: Column, width: int) -> Column:
    """For each residue the residues of the window of `width` centred on it, in chemical order; unknown ones last, as they stand.

    A window reaches (width - 1) / 2 residues to either side, rounded down: an even width takes in one residue less.
    """
    reach = (width - 1) // 2
    n = F.length(sequence)
    rank = lambda r: F.coalesce(chemical_rank(r), F.lit(len(CHEMICAL_ORDER)))

    def window(i: Column) -> Column:
        start = F.greatest(i - reach, F.lit(0))
        text = F.substring(sequence, start + 1, F.least(i + reach + 1, n) - start)
        ranked = F.transform(F.split(text, ""), lambda r, k: F.struct(rank(r).alias("rank"), k.alias("place"), r.alias("residue")))
        return F.array_join(F.transform(F.array_sort(ranked), lambda s: s["residue"]), "")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), window)).otherwise(F.array().cast("array<string>"))


def two_rows(intervals: Column) -> Column:
    """Rows 0 and 1 for intervals (array of struct start, end): each, by start, goes where the last end is smaller."""
    begun = F.struct(F.array().cast("array<int>").alias("rows"), F.lit(None).cast("double").alias("end0"), F.lit(None).cast("double").alias("end1"))

    def put(state: Column, x: Column) -> Column:
        low = F.lit(float("-inf"))
        first = F.coalesce(state["end0"], low) <= F.coalesce(state["end1"], low)
        end = x["end"].cast("double")
        return F.struct(
            F.concat(state["rows"], F.array(F.when(first, 0).otherwise(1))).alias("rows"),
            F.when(first, end).otherwise(state["end0"]).alias("end0"), F.when(first, state["end1"]).otherwise(end).alias("end1"),
        )

    return F.aggregate(F.array_sort(intervals), begun, put)["rows"]


def letter_counts(text: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> dict[str, Column]:
    """How often each letter stands in a text, without taking the text apart."""
    return {c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in letters}
