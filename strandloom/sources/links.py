"""Link tables, find reports and structure files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.ordering import numbered
from strandloom.sources.sequences import FILE_PLACE, in_file_order


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(query_seq, target_seq, score) of CSV files with three or more columns; malformed rows and header lines go."""
    parts = F.split("value", ",")
    number = lambda i: F.when(F.trim(parts[i]).rlike(r"^-?\d+$"), F.trim(parts[i]).cast("long"))
    rows = spark.read.text(path).filter(F.size(parts) >= 3)
    return rows.select(number(0).alias("query_seq"), number(1).alias("target_seq"), number(2).cast("int").alias("score")).dropna()


def write_links(links: DataFrame, path: str) -> None:
    links.select("query_seq", "target_seq", "score").write.option("header", True).csv(path)


def deduplicated(links: DataFrame) -> DataFrame:
    """Links without the repeats that a resumed search leaves."""
    return links.dropDuplicates(["query_seq", "target_seq", "score"])


# Fixed value: the head line of a find.
FIND_HEAD = r"^\s*([A-Z0-9]+)-([A-Z0-9]+)\s+s\((\d+)\)\s+Length:\s+(\d+)/(\d+)"


def read_finds(spark: SparkSession, path: str) -> DataFrame:
    """(id1, id2, score, len1, len2, name1, name2) of find reports: a head line and two indented name lines each.

    Lines are numbered in file order, and a head meets the two lines after it by their numbers; all other lines go.
    """
    raw = spark.read.text(path).selectExpr("regexp_replace(value, '\\r', '') AS value", *FILE_PLACE)
    lines = in_file_order(raw, "line_no")
    heads = lines.filter(F.col("value").rlike(FIND_HEAD))
    name = lambda n: lines.filter(F.col("value").rlike(r"^[ \t]+\S")).select((F.col("line_no") - n).alias("line_no"), F.trim(F.regexp_replace("value", "^\t+", "")).alias(f"name{n}"))
    field = lambda i: F.regexp_extract("value", FIND_HEAD, i)
    blocks = heads.join(name(1), "line_no").join(name(2), "line_no")
    return blocks.select(
        field(1).alias("id1"), field(2).alias("id2"), field(3).cast("int").alias("score"), field(4).cast("int").alias("len1"), field(5).cast("int").alias("len2"), "name1", "name2"
    )


def finds_report(finds: DataFrame) -> DataFrame:
    """(line_no, line): the report of finds (id1, id2, score, len1, len2, name1, name2), best score first, under a line with their number."""
    ranked = numbered(finds, [F.desc("score"), F.asc("id1"), F.asc("id2")], rank="place")
    head = F.format_string("%s-%s s(%d) Length: %d/%d", "id1", "id2", "score", "len1", "len2")
    lines = ranked.select("place", F.posexplode(F.array(head, F.concat(F.lit(" "), "name1"), F.concat(F.lit(" "), "name2"))).alias("k", "line"))
    top = finds.agg(F.count("*").alias("n")).select(F.lit(0).cast("long").alias("line_no"), F.format_string("found %d finds", "n").alias("line"))
    return top.union(lines.select((F.col("place") * 3 - 2 + F.col("k")).alias("line_no"), "line"))


def _entries(finds: DataFrame, after: int, note: Column) -> DataFrame:
    """(line_no, line): three lines for each find, best score first, from line `after` on; note ends the first."""
    ranked = numbered(finds, [F.desc("score"), F.asc("id1"), F.asc("id2")], rank="place")
    head = F.concat(F.format_string("%s-%s s(%d) Length: %d/%d", "id1", "id2", "score", "len1", "len2"), note)
    lines = ranked.select("place", F.posexplode(F.array(head, F.concat(F.lit(" "), "name1"), F.concat(F.lit(" "), "name2"))).alias("k", "line"))
    return lines.select((F.col("place") * 3 - 3 + F.col("k") + after).alias("line_no"), "line")


def kept_report(finds: DataFrame, phases: Sequence[str]) -> DataFrame:
    """(line_no, line): the finds whose `phase` is null, under lines with their number and that of the finds each phase took."""
    counts = [F.count_if(F.col("phase") == name).alias(f"n{i}") for i, name in enumerate(phases)]
    total = finds.agg(F.count_if(F.col("phase").isNull()).alias("kept"), *counts)
    said = [F.format_string("Kept %d entries after filtering", "kept"), *[F.format_string(f"Filtered out %d entries ({name})", f"n{i}") for i, name in enumerate(phases)], F.lit("")]
    top = total.select(F.posexplode(F.array(*said)).alias("line_no", "line")).select(F.col("line_no").cast("long"), "line")
    return top.union(_entries(finds.filter("phase is null"), len(said), F.lit("")))


def biased_report(finds: DataFrame) -> DataFrame:
    """(line_no, line): finds with the `reason` for which their composition explains them, under a line with their number."""
    total = finds.agg(F.count("*").alias("n"))
    said = F.array(F.format_string("Composition-biased alignments: %d entries", "n"), F.lit(""))
    top = total.select(F.posexplode(said).alias("line_no", "line")).select(F.col("line_no").cast("long"), "line")
    return top.union(_entries(finds, 2, F.concat(F.lit(" ["), "reason", F.lit("]"))))


def write_lines(report: DataFrame, path: str) -> None:
    """A report (line_no, line) as text files whose names are in the order of their lines."""
    report.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.text(path)


def find_text(finds: DataFrame) -> DataFrame:
    """(score, text): each find as its three-line block."""
    head = F.format_string("%s-%s s(%d) Length: %d/%d", "id1", "id2", "score", "len1", "len2")
    return finds.select("score", F.concat(head, F.lit("\n "), "name1", F.lit("\n "), "name2").alias("text"))


# The elements that are told from atoms' names.
ELEMENTS = ("H", "C", "N", "O", "F", "P", "S", "CL", "CA", "FE", "BR", "I")


def element_of(atom_name: Column) -> Column:
    """An element guessed from an atom's name without digits and quotes: its first two letters, else its first, if these are one; else C.

    CA is taken for a carbon alpha, which every residue has, and not for calcium; a file that means calcium has to name it.
    """
    clean = F.upper(F.trim(F.regexp_replace(atom_name, "[0-9'\"]", "")))
    two, one = F.substring(clean, 1, 2), F.substring(clean, 1, 1)
    return F.when(two.isin(*ELEMENTS) & (two != "CA"), two).when(one.isin(*ELEMENTS), one).otherwise("C")


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """ATOM and HETATM records: kind, serial, name, alt_loc, res_name, chain, res_seq, x, y, z and element.

    Lines too short for coordinates are left out, a blank chain is A, and elements are guessed for lines that end before theirs.
    """
    cut = lambda start, end: F.trim(F.substring("value", start, end - start + 1))
    rows = spark.read.text(path).filter(F.col("value").rlike("^(ATOM|HETATM)") & (F.length("value") >= 54))
    fields = [cut(1, 6).alias("kind"), cut(7, 11).try_cast("int").alias("serial"), cut(13, 16).alias("name"), cut(17, 17).alias("alt_loc"), cut(18, 20).alias("res_name")]
    fields += [F.coalesce(F.nullif(cut(22, 22), F.lit("")), F.lit("A")).alias("chain"), cut(23, 26).try_cast("int").alias("res_seq")]
    fields += [cut(at, at + 7).try_cast("double").alias(c) for c, at in zip("xyz", (31, 39, 47))]
    return rows.select(*fields, F.when(F.length("value") >= 78, F.upper(cut(77, 78))).otherwise(element_of(cut(13, 16))).alias("element"))


def pdb_line(serial: Column, name: Column, chain: Column, res_seq: Column, x: Column, y: Column, z: Column, res_name: str = "GLY") -> Column:
    """An ATOM line; x, y and z are texts of at most eight characters."""
    right = lambda c, n: F.lpad(c.cast("string"), n, " ")
    return F.concat(F.lit("ATOM  "), right(serial, 5), F.lit(" "), F.rpad(name, 4, " "), F.lit(" " + res_name.ljust(3) + " "), F.rpad(chain, 1, " "), right(res_seq, 4), F.lit(" " * 4), right(x, 8), right(y, 8), right(z, 8))


def backbone(atoms: DataFrame) -> DataFrame:
    """CA atoms of the first location, of chains with two or more of them."""
    ca = atoms.filter((F.col("name") == "CA") & F.col("alt_loc").isin("", "A"))
    return ca.join(ca.groupBy("chain").count().filter("count >= 2").select("chain"), "chain", "left_semi")


def atoms_at(atoms: DataFrame, indices: DataFrame) -> DataFrame:
    """CA atoms at 0-based sequence indices (column index): residues are numbered from 1."""
    return indices.join(backbone(atoms), F.col("res_seq") == F.col("index") + 1)
