"""Lowest common ancestors and the classification of pairs by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut_lineage

# Words of everyday genes, and the level of each rank.
HOUSEKEEPING = (
    "ribosom", "histone", "ubiquitin", "actin", "tubulin", "chaperon", "heat shock", "polymerase", "kinase", "atpase",
    "elongation factor", "dehydrogenase", "synthase",
)
RANK_LEVELS = {
    "no rank": 0, "root": 1, "cellular organisms": 2, "superkingdom": 3, "kingdom": 4, "subkingdom": 4, "phylum": 5, "subphylum": 5,
    "superclass": 6, "class": 7, "subclass": 7, "infraclass": 7, "cohort": 8, "superorder": 8, "order": 9, "suborder": 9, "infraorder": 9,
    "parvorder": 9, "superfamily": 10, "family": 11, "subfamily": 11, "tribe": 12, "subtribe": 12, "genus": 13, "subgenus": 13,
    "species group": 14, "species subgroup": 14, "species": 15, "subspecies": 16, "varietas": 17, "forma": 18,
}


def common_ancestor(lineage_a: Column, lineage_b: Column) -> Column:
    """The deepest element of two lineages that run from the root down; null if they share none."""
    return F.try_element_at(F.array_intersect(lineage_a, lineage_b), F.lit(-1))


def ancestor_rank(lineage_a: Column, lineage_b: Column, rank_of: Column) -> Column:
    """The rank of the deepest common ancestor: `no rank` for two known lineages without any, null where a lineage is unknown.

    rank_of: map of taxon to rank.
    """
    shared = common_ancestor(lineage_a, lineage_b)
    known = lineage_a.isNotNull() & lineage_b.isNotNull()
    return F.when(known & shared.isNull(), "no rank").when(known, F.coalesce(F.try_element_at(rank_of, shared), F.lit("no rank")))


def lineages(taxa: DataFrame, max_steps: int = 16) -> DataFrame:
    """(taxid, rank, lineage): each taxon's path from its root down, of a table (taxid, parent, rank); roots have no parent or themselves.

    Paths double in length with each step, so a step is one join and there are as many as the logarithm of the depth.
    """
    up = F.when(F.col("parent") != F.col("taxid"), F.col("parent"))
    now = cut_lineage(taxa.select("taxid", "rank", F.array("taxid").alias("lineage"), up.alias("up")))
    for _ in range(max_steps):
        if now.filter("up is not null").isEmpty():
            return now.select("taxid", "rank", "lineage")
        above = now.select(F.col("taxid").alias("up"), F.col("lineage").alias("_above"), F.col("up").alias("_next"))
        longer = F.concat(F.coalesce("_above", F.array().cast("array<long>")), "lineage")
        now = cut_lineage(now.join(above, "up", "left").select("taxid", "rank", longer.alias("lineage"), F.col("_next").alias("up")))
    raise RuntimeError(f"paths are longer than {2**max_steps}")


def is_housekeeping(description_a: Column, description_b: Column) -> Column:
    text = F.lower(F.concat_ws(" ", description_a, description_b))
    return F.exists(F.array(*map(F.lit, HOUSEKEEPING)), lambda word: F.contains(text, word))


def rank_level(rank: Column) -> Column:
    levels = F.create_map(*[F.lit(x) for pair in RANK_LEVELS.items() for x in pair])
    return F.coalesce(levels[rank], F.lit(0))


def classify(rank: Column, housekeeping: Column) -> Column:
    """Struct of category, priority (1 most novel to 5) and reason for the common ancestor's rank."""
    level = rank_level(rank)
    said = lambda category, priority, reason: F.struct(F.lit(category).alias("category"), F.lit(priority).alias("priority"), reason.alias("reason"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(rank.isNull(), said("TaxID Error", 5, F.lit("Invalid TaxID")))
        .when((level <= 3) & housekeeping, said("Deep Housekeeping", 4, text("Deep divergence (", rank, ") but likely ortholog")))
        .when(level <= 3, said("Deep Novelty", 1, text("Major Discovery: ", rank, " separation, non-housekeeping")))
        .when((level <= 5) & housekeeping, said("Distant Homolog", 4, F.lit("Common metabolic/structural gene")))
        .when(level <= 5, said("High Value", 2, text("Inter-Phylum match (", rank, ")")))
        .when(level <= 11, said("Moderate Distance", 3, text("Same ", rank)))
        .otherwise(said("Close Relative", 5, F.lit("Likely paralog or recent speciation")))
    )
