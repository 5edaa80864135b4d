"""Compositional bias of alignments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIASED_UNDER = 0.5
PIPELINE_BIASED_UNDER = 0.7


def matches(aligned_a: Column, aligned_b: Column) -> Column:
    """The residues on which two aligned strings agree, in order."""
    same = F.zip_with(F.split(aligned_a, ""), F.split(aligned_b, ""), lambda x, y: F.when((x == y) & (x != "-"), x))
    return F.filter(same, lambda x: x.isNotNull())


def composition(residues: Column) -> Column:
    """Array of (n, residue), most frequent first; of those as frequent the first seen comes first."""
    kinds = F.array_distinct(residues)
    counted = F.transform(kinds, lambda k, i: F.struct((-F.size(F.filter(residues, lambda r: r == k))).alias("minus"), i.alias("seen"), k.alias("residue")))
    return F.transform(F.array_sort(counted), lambda s: F.struct((-s["minus"]).alias("n"), s["residue"].alias("residue")))


def entropy(counts: Column, total: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    return F.aggregate(counts, F.lit(0.0), lambda acc, n: acc - n / total * F.log2(n / total))


def assess(aligned_a: Column, aligned_b: Column) -> Column:
    """Struct of goodness, reason, is_biased, entropy, top_residue, top_percentage, num_matches and unique_residues."""
    ranked = composition(matches(aligned_a, aligned_b))
    counts = F.transform(ranked, lambda s: s["n"])
    total = F.aggregate(counts, F.lit(0), lambda acc, n: acc + n)
    kinds = F.size(ranked)
    bits = entropy(counts, total)
    top = F.try_element_at(counts, F.lit(1)) / total * 100
    residues = lambda n: F.array_join(F.transform(F.slice(ranked, 1, n), lambda s: s["residue"]), "")
    top3 = F.aggregate(F.slice(counts, 1, 3), F.lit(0), lambda acc, n: acc + n) / total * 100
    whole = lambda x: F.bround(x, 0).cast("int").cast("string")  # noqa: E731  halves go to even
    goodness = 0.45 * bits / 4.32 + 0.40 * (1 - F.pow(top / 100, F.lit(0.8))) + 0.15 * F.least(F.lit(1.0), kinds / F.sqrt(total) / 2)
    reason = (
        F.when(total == 0, "No-matches")
        .when(top >= 60, F.concat(residues(1), F.lit("-Rich ("), whole(top), F.lit("%)")))
        .when(top >= 40, F.concat(residues(1), F.lit("-Biased ("), whole(top), F.lit("%)")))
        .when(top3 >= 75, F.concat(residues(2), F.lit("-Biased ("), whole(top3), F.lit("%)")))
        .when(bits < 2.0, F.concat(F.lit("Low-complexity ("), residues(2), F.lit(")")))
        .otherwise("Diverse")
    )
    goodness = F.when(total == 0, 1.0).otherwise(goodness)
    return F.struct(
        goodness.alias("goodness"), reason.alias("reason"), (goodness < BIASED_UNDER).alias("is_biased"), F.when(total == 0, 0.0).otherwise(bits).alias("entropy"),
        residues(1).alias("top_residue"), F.when(total == 0, 0.0).otherwise(top).alias("top_percentage"), total.alias("num_matches"), kinds.alias("unique_residues"),
    )
