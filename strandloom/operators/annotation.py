"""Filters over annotated records, and the cascade that explains pairs by their annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandloom.functions import bias, names
from strandloom.functions.alignment import sw_align
from strandloom.operators.ordering import numbered
from strandloom.session import cut_lineage

# Names of organisms, words of unknown proteins, and the databases whose ids are compared.
ORGANISMS = {
    "human": "Homo sapiens", "rat": "Rattus norvegicus", "ecoli": "Escherichia coli", "yeast": "Saccharomyces cerevisiae",
    "chicken": "Gallus gallus", "mouse": "Mus musculus",
}
UNKNOWN_WORDS = ("Uncharacterized", "Putative", "Predicted")
ID_DATABASES = (
    ("InterPro", "InterPro", False), ("PANTHER", "Panther", True), ("PRINTS", "PRINTS", False), ("Pfam", "Pfam", False),
    ("PROSITE", "PROSITE", False), ("SMART", "SMART", False), ("eggNOG", "eggNOG", False), ("OrthoDB", "OrthoDB", False),
)
PREFIX_LENGTH = 11


def record_filter(
    organisms: list[str] | None = None, *, require_go: bool = False, require_ec: bool = False, require_pfam: bool = False, no_fragments: bool = True,
    no_uncharacterized: bool = True, require_any_feature: bool = True,
) -> Column:
    """The predicate over data_class, organism, description and xrefs (array of struct with db)."""
    description = F.col("description")
    has_db = lambda db: F.exists("xrefs", lambda x: x["db"] == db)
    go, ec, pfam = has_db("GO"), F.contains(description, F.lit("EC=")), has_db("Pfam")
    tests = [F.col("data_class") == "Reviewed"]
    if organisms:
        known = [ORGANISMS.get(o, o).lower() for o in organisms]
        tests.append(F.exists(F.array(*map(F.lit, known)), lambda o: F.contains(F.lower("organism"), o)))
    if no_uncharacterized:
        tests += [~F.contains(description, F.lit(w)) for w in UNKNOWN_WORDS]
    tests += [go | ec | pfam] * require_any_feature + [go] * require_go + [ec] * require_ec + [pfam] * require_pfam
    if no_fragments:
        tests.append(~F.contains(description, F.lit("Fragment")))
    out = tests[0]
    for test in tests[1:]:
        out &= test
    return out


def watched_filter(records: DataFrame, condition: Column) -> tuple[DataFrame, Observation]:
    """The records that meet the condition, and counters `seen` and `accepted` of the pass that reads them.

    The counters are there once an action has read the result; they cost no scan of their own.
    """
    counters = Observation()
    counted = records.observe(counters, F.count(F.lit(1)).alias("seen"), F.count_if(F.coalesce(condition, F.lit(False))).alias("accepted"))
    return counted.filter(condition), counters


def phase0(name1: Column, name2: Column) -> Column:
    """toxins, uncharacterized or similar names, whichever holds first; else null."""
    return _phase0(F.lower(name1), F.lower(name2))


def _phase0(a: Column, b: Column) -> Column:
    either = lambda word: F.contains(a, F.lit(word)) | F.contains(b, F.lit(word))
    start = lambda x: F.substring(x, 1, PREFIX_LENGTH)
    return (
        F.when(F.contains(a, F.lit("toxin")) & F.contains(b, F.lit("toxin")), "toxins")
        .when(either("uncharacterized") | either("putative"), "uncharacterized")
        .when(start(a) == start(b), "similar names")
    )


def phase1(name1: Column, name2: Column) -> Column:
    """Stems that both names have, sorted and joined; null if none."""
    common = names.shared(names.meaningful_tokens(name1), names.meaningful_tokens(name2))
    return F.nullif(F.array_join(common, ", "), F.lit(""))


def phase2(r1: Column, r2: Column) -> Column:
    """The first that two records share: an id, successive PANTHER families, name terms, or similarity, family and domain terms.

    r1, r2: structs with xrefs, description, comments and features; a missing record explains nothing.
    """
    said = lambda prefix, x: F.concat(F.lit(prefix), x)  # noqa: E731  null without x
    checks = [said(f"{shown}: ", names.common_id(names.xref_ids(r1["xrefs"], db, strip), names.xref_ids(r2["xrefs"], db, strip))) for db, shown, strip in ID_DATABASES]
    panther = [names.xref_ids(r["xrefs"], "PANTHER", True) for r in (r1, r2)]
    checks.append(said("Panther: ", names.sequential_ids(*panther)))
    pooled = names.shared(names.all_name_terms(r1["description"]), names.all_name_terms(r2["description"]))
    size = F.aggregate(pooled, F.lit(0), lambda n, t: n + F.length(t))
    checks.append(said("Name: ", F.when(size >= names.NAME_TOTAL_CHARS, F.array_join(pooled, ", "))))
    for prefix, of in (
        ("-!- SIMILARITY: ", lambda r: names.similarity_terms(r["comments"])),
        ("Family: ", lambda r: names.family_terms(r["description"], r["comments"])),
        ("Domain: ", lambda r: names.domain_terms(r["xrefs"], r["features"])),
    ):
        checks.append(said(prefix, names.longest(F.array_intersect(of(r1), of(r2)))))
    return F.coalesce(*checks)


def explain(finds: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """finds with phase (0, 1, 2, null) and reason; the first phase that explains a pair names it.

    finds has name1 and name2, and with records (accession, xrefs, description, comments, features) id1 and id2.
    Records join from the left, so an unknown id only leaves its pair unexplained. What the names explain is told
    first, each in one pass over the lower-cased names, and only the pairs left are joined with their records.
    """
    zero, one = _phase0(F.col("_lower1"), F.col("_lower2")), phase1(F.col("name1"), F.col("name2"))
    named = finds.withColumns({f"_lower{i}": F.lower(f"name{i}") for i in "12"}).withColumn("_zero", zero)
    # the reason of phase 0 is tried first, so tokens are made for the other pairs alone
    told = named.withColumn("_reason", F.coalesce("_zero", one)).withColumn("phase", F.when(F.col("_zero").isNotNull(), 0).when(F.col("_reason").isNotNull(), 1))
    told = told.select(*finds.columns, "phase", F.col("_reason").alias("reason"))
    if records is None:
        return told
    told = cut_lineage(told)
    left = told.filter("phase is null").drop("phase", "reason")
    packed = F.struct("xrefs", "description", "comments", "features")
    for i in "12":
        left = left.join(records.select(F.col("accession").alias(f"id{i}"), packed.alias(f"_r{i}")), f"id{i}", "left")
    left = left.withColumn("reason", phase2(F.col("_r1"), F.col("_r2")))
    left = left.select(*finds.columns, F.when(F.col("reason").isNotNull(), 2).alias("phase"), "reason")
    return told.filter("phase is not null").union(left)


def split_biased(unexplained: DataFrame, sequences: DataFrame, threshold: float = bias.PIPELINE_BIASED_UNDER) -> DataFrame:
    """Unexplained pairs with goodness and, for those under the threshold, `Compositional: ...` as reason.

    Only what the cheap phases left is joined with its sequences (accession, sequence) and aligned. A pair of sequences
    is aligned once, however many finds have it: finds meet the digests of their sequences, and each two digests the
    sequences. Where nothing aligns there are no matches, with a goodness of 1; without a sequence it is null.
    Accessions and sequences are never broadcast: their files are far smaller than their rows.
    """
    told = sequences.select("accession", "sequence", F.unhex(F.sha2("sequence", 256)).alias("_digest"))
    texts = told.filter("_digest is not null").groupBy("_digest").agg(F.any_value("sequence").alias("_s"))
    out = unexplained
    for i in "12":
        out = out.join(told.select(F.col("accession").alias(f"id{i}"), F.col("_digest").alias(f"_d{i}")).hint("merge"), f"id{i}", "left")
    pairs = out.select("_d1", "_d2").filter("_d1 is not null and _d2 is not null").distinct()
    for i in "12":
        pairs = pairs.join(texts.select(F.col("_digest").alias(f"_d{i}"), F.col("_s").alias(f"_s{i}")).hint("merge"), f"_d{i}")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: small rows, long work
    pairs = pairs.repartition(n, "_d1", "_d2").withColumn("_aligned", sw_align()("_s1", "_s2"))
    judged = pairs.withColumn("_bias", F.when(F.col("_aligned.score").isNotNull(), bias.assess(F.col("_aligned.aligned_a"), F.col("_aligned.aligned_b"))))
    reason = F.when(F.col("_bias.goodness") < threshold, F.concat(F.lit("Compositional: "), F.col("_bias.reason")))
    judged = judged.select("_d1", "_d2", F.coalesce("_bias.goodness", F.lit(1.0)).alias("goodness"), reason.alias("reason"))
    kept = [c for c in unexplained.columns if c not in ("goodness", "reason")]
    return out.select(*kept, "_d1", "_d2").join(judged, ["_d1", "_d2"], "left").select(*kept, "goodness", "reason")


def reason_counts(explained: DataFrame) -> DataFrame:
    """(phase, reason, n) with totals for each phase and overall: phase and reason null where summed up."""
    return explained.rollup("phase", "reason").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def phase_percentages(explained: DataFrame) -> DataFrame:
    """(phase, n, percent): pairs that each phase explains, of all pairs; phase is null for those that none does."""
    counts = explained.groupBy("phase").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("phase", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def reasons_report(explained: DataFrame) -> DataFrame:
    """(line_no, line): the report of reasons, short ones first, with totals by phase and of the pairs kept."""
    lines = reason_lines(explained).select("reason", "n", "line")
    ranked = numbered(lines.withColumn("size", F.length("reason")), [F.asc("size"), F.asc("reason")], rank="place").select((F.col("place") + 2).alias("line_no"), "line")
    rule = "=" * 80
    said = lambda label, n: F.concat(F.lit(label), n.cast("string"))
    phases = [F.count_if(F.col("phase") == p).alias(f"n{p}") for p in range(3)]
    total = explained.agg(F.count_if(F.col("phase").isNull()).alias("kept"), F.count_if(F.col("phase").isNotNull()).alias("gone"), F.count_distinct("reason").alias("kinds"), *phases)
    after = F.array(F.lit(""), F.lit(rule), said("Total filtered: ", F.col("gone")), *[said(f"  phase {p}: ", F.col(f"n{p}")) for p in range(3)], said("Total kept: ", F.col("kept")))
    below = total.select("kinds", F.posexplode(after).alias("k", "line")).select((F.col("kinds") + 3 + F.col("k")).alias("line_no"), "line")
    head = F.array(F.lit("FILTERING REASONS (sorted by length - shortest first)"), F.lit(rule), F.lit(""))
    above = total.select(F.posexplode(head).alias("line_no", "line")).select(F.col("line_no").cast("long"), "line")
    return above.union(ranked).union(below)


def reason_lines(explained: DataFrame) -> DataFrame:
    """(reason, n, line): each reason's line of a report; reports list short reasons first, then by name."""
    counts = explained.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    padded = F.when(F.length("reason") < 40, F.rpad("reason", 40, " ")).otherwise(F.col("reason"))
    return counts.select("reason", "n", F.concat(padded, F.lit(" : "), F.lpad(F.col("n").cast("string"), 6, " ")).alias("line")).orderBy(F.length("reason"), "reason")
