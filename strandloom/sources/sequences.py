"""FASTA, annotated flat files and packed binary sequences."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import names
from strandloom.functions.formats import iso_date, overlaps
from strandloom.operators.ordering import numbered


def read_fasta(spark: SparkSession, path: str, numbers: bool = False) -> DataFrame:
    """id, accession, entry_name, description, sequence and length of each record, split by Spark's own reader.

    With `numbers` also seq_no, the record's place in the files from 0 on.
    """
    place = FILE_PLACE if numbers else ()
    raw = spark.read.option("lineSep", "\n>").text(path).selectExpr("value", *place)
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    head = F.substring_index(text, "\n", 1)
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.substring(text, F.instr(text, "\n") + 1, F.length(text)), r"\s", "")).otherwise("")
    whole = F.substring_index(head, " ", 1)
    parts = F.split(whole, r"\|")
    at = [x.rsplit(" ", 1)[-1] for x in place]
    rows = raw.select(whole.alias("id"), parts.alias("p"), F.regexp_replace(head, r"^\S*\s*", "").alias("description"), body.alias("sequence"), *at).filter("id <> ''")
    part = lambda i: F.when(F.size("p") == 3, F.col("p")[i]).otherwise(F.col("id"))
    rows = rows.select("id", part(1).alias("accession"), part(2).alias("entry_name"), "description", "sequence", F.length("sequence").alias("length"), *at)
    return in_file_order(rows, "seq_no") if numbers else rows


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """Text files with a header and wrapped sequence for each row of id, description, sequence."""
    wrapped = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    sequences.select(F.concat(F.lit(">"), F.concat_ws(" ", "id", "description"), F.lit("\n"), wrapped)).write.text(path)


def read_flatfile(spark: SparkSession, path: str, numbers: bool = False) -> DataFrame:
    """Annotated records: entry_name, data_class, length, accessions, accession, description, organism, taxonomy_id, lineage,
    xrefs, comments, keywords, features, references, created, sequence_update and annotation_update with sequence_version and
    entry_version, protein_existence, molecular_weight, crc64 and sequence.
    """
    place = FILE_PLACE if numbers else ()
    at = [x.rsplit(" ", 1)[-1] for x in place]
    raw = spark.read.option("lineSep", "\n//").text(path).selectExpr("value", *place).select(F.split(F.regexp_replace(F.trim("value"), "\r", ""), "\n").alias("lines"), *at)
    raw = raw.select(F.filter("lines", lambda x: F.length(F.trim(x)) > 0).alias("lines"), *at).filter(F.size("lines") > 0)

    def of(code: str, from_: int = 6) -> Column:
        return F.transform(F.filter("lines", lambda x: x.startswith(f"{code} ")), lambda x: F.substring(x, F.lit(from_), F.length(x)))

    def joined(code: str) -> Column:
        return F.array_join(F.transform(of(code), lambda x: F.trim(x)), " ")

    listed = lambda text, mark=";": F.filter(F.transform(F.split(F.regexp_replace(text, r"\.$", ""), mark), lambda x: F.trim(x)), lambda x: x != "")
    xref = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"\.$", ""), ";"), lambda x: F.trim(x))
    comment = F.array_join(F.transform(of("CC"), lambda x: F.when(x.startswith("-!- "), F.concat(F.lit("\u0001"), F.substring(x, 5, 1 << 30))).otherwise(F.trim(x))), " ")
    comments = F.filter(F.transform(F.split(F.split(comment, " ?-----")[0], "\u0001"), lambda x: F.trim(x)), lambda x: x != "")
    feature_text = F.array_join(F.transform(of("FT"), lambda x: F.when(F.substring(x, 1, 1) != " ", F.concat(F.lit("\u0001"), x)).otherwise(F.trim(x))), " ")
    features = F.filter(F.split(feature_text, "\u0001"), lambda x: F.trim(x) != "")
    note = lambda x, name: F.nullif(F.regexp_extract(x, rf'/{name}="([^"]*)"', 1), F.lit(""))
    place = lambda x, i: F.nullif(F.regexp_extract(x, r"^\S+\s+[<?]?(\d+)(?:\.\.[>?]?(\d+))?", i), F.lit("")).cast("int")
    feature = lambda x: F.struct(
        F.regexp_extract(x, r"^(\S+)", 1).alias("type"), place(x, 1).alias("start"), F.coalesce(place(x, 2), place(x, 1)).alias("end"), note(x, "note").alias("note"), note(x, "id").alias("id")
    )
    dates = of("DT")
    date = lambda word: F.try_element_at(F.transform(F.filter(dates, lambda x: F.contains(x, F.lit(word))), lambda x: iso_date(F.substring(F.trim(x), 1, 11))), F.lit(1))
    version = lambda word: F.regexp_extract(F.array_join(dates, "\n"), rf"{word} version (\d+)", 1).try_cast("int")
    # a reference begins with its number; the lines after it are marked with their codes
    cited = F.transform(F.filter("lines", lambda x: x.rlike("^R[NPCXGATL] ")), lambda x: F.concat(F.when(x.startswith("RN "), "\u0001").otherwise("\u0002"), F.substring(x, 1, 2), F.trim(F.substring(x, 6, 1 << 30))))
    cited = F.filter(F.split(F.array_join(cited, ""), "\u0001"), lambda x: x != "")
    first = F.element_at("lines", 1)
    sq = F.array_join(of("SQ"), "")
    rows = raw.select(
        F.regexp_extract(first, r"^ID\s+(\S+)", 1).alias("entry_name"), F.regexp_extract(first, r"^ID\s+\S+\s+(\w+);", 1).alias("data_class"),
        listed(joined("AC")).alias("accessions"), joined("DE").alias("description"), F.regexp_replace(joined("OS"), r"\.$", "").alias("organism"),
        F.transform(F.regexp_extract_all(joined("OX"), F.lit(r"NCBI_TaxID=(\d+)"), F.lit(1)), lambda x: x.cast("int")).alias("taxonomy_id"),
        listed(joined("OC")).alias("lineage"), comments.alias("comments"),
        F.transform(F.transform(of("DR"), xref), lambda p: F.struct(p[0].alias("db"), p[1].alias("id"), F.slice(p, F.lit(3), F.size(p)).alias("props"))).alias("xrefs"),
        listed(joined("KW")).alias("keywords"), F.transform(features, feature).alias("features"),
        F.transform(cited, _reference).alias("references"),
        date("integrated").alias("created"), date("sequence version").alias("sequence_update"), date("entry version").alias("annotation_update"),
        version("sequence").alias("sequence_version"), version("entry").alias("entry_version"),
        F.regexp_extract(sq, r"(\d+) MW;", 1).try_cast("long").alias("molecular_weight"), F.nullif(F.regexp_extract(sq, r"(\w+) CRC64;", 1), F.lit("")).alias("crc64"),
        F.regexp_extract(joined("PE"), r"^(\d+)", 1).try_cast("int").alias("protein_existence"),
        F.regexp_replace(F.array_join(F.filter("lines", lambda x: x.startswith("     ")), ""), r"\s", "").alias("sequence"), *at,
    )
    rows = in_file_order(rows, "seq_no") if numbers else rows
    rows = rows.withColumn("accession", F.coalesce(F.try_element_at("accessions", F.lit(1)), F.col("entry_name")))
    return rows.withColumn("length", F.length("sequence"))


def _reference(text: Column) -> Column:
    """Struct of number, positions, authors, title, location and ids (array of struct db, id) of a reference's marked lines."""
    parts = F.split(text, "\u0002")
    said = lambda code: F.array_join(F.transform(F.filter(parts, lambda x: x.startswith(code)), lambda x: F.substring(x, 3, 1 << 30)), " ")
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r";\s*$", ""), '^"|"$', "")
    ids = F.filter(F.split(said("RX"), r";\s*"), lambda x: F.contains(x, F.lit("=")))
    return F.struct(
        F.regexp_extract(text, r"^RN\[(\d+)\]", 1).try_cast("int").alias("number"), said("RP").alias("positions"), plain(said("RA")).alias("authors"),
        plain(said("RT")).alias("title"), F.regexp_replace(said("RL"), r"\.$", "").alias("location"),
        F.transform(ids, lambda x: F.struct(F.substring_index(x, "=", 1).alias("db"), F.substring_index(x, "=", -1).alias("id"))).alias("ids"),
    )


def write_flatfile(records: DataFrame, path: str) -> None:
    """Text files with a row's record each: entry_name, data_class, accessions, description, organism, taxonomy_id, lineage,
    comments, xrefs, keywords, features (type, start, end, note, id), created, sequence_update, annotation_update and their
    versions, protein_existence, references, molecular_weight, crc64 and sequence, as read_flatfile has them.
    """
    line = lambda code, text: F.concat(F.lit(f"{code}   "), text)
    each = lambda rows, text: F.transform(F.coalesce(rows, F.array()), text)
    months = F.split(F.lit("JAN,FEB,MAR,APR,MAY,JUN,JUL,AUG,SEP,OCT,NOV,DEC"), ",")
    day = lambda c: F.concat_ws("-", F.substring(c, 9, 2), F.element_at(months, F.substring(c, 6, 2).cast("int")), F.substring(c, 1, 4))
    text = lambda n: F.col(n).cast("string")
    feature = lambda f: F.array_join(F.array(
        line("FT", F.concat(F.rpad(f["type"], 15, " "), F.lit(" "), f["start"].cast("string"), F.lit(".."), f["end"].cast("string"))),
        *[F.concat(F.lit("FT" + " " * 19), F.lit(f'/{q}="'), f[q], F.lit('"')) for q in ("note", "id")],
    ), "\n")
    cited = lambda r: F.array_join(F.array(
        line("RN", F.format_string("[%d]", r["number"])), line("RP", r["positions"]), line("RX", F.array_join(F.transform(r["ids"], lambda x: F.concat_ws("=", x["db"], x["id"])), "; ")),
        line("RA", F.concat(r["authors"], F.lit(";"))), line("RT", F.concat(F.lit('"'), r["title"], F.lit('";'))), line("RL", F.concat(r["location"], F.lit("."))),
    ), "\n")
    xref = lambda x: F.concat(F.concat_ws("; ", x["db"], x["id"], F.array_join(x["props"], "; ")), F.lit("."))
    parts = [
        F.array(F.format_string("ID   %-24s%s;%12d AA.", "entry_name", "data_class", F.length("sequence")), line("AC", F.concat(F.array_join("accessions", "; "), F.lit(";"))),
                line("DT", F.concat(day("created"), F.lit(", integrated into the collection."))), line("DT", F.concat(day("sequence_update"), F.lit(", sequence version "), text("sequence_version"), F.lit("."))),
                line("DT", F.concat(day("annotation_update"), F.lit(", entry version "), text("entry_version"), F.lit("."))), line("DE", F.col("description")), line("OS", F.concat("organism", F.lit("."))),
                line("OC", F.concat(F.array_join("lineage", "; "), F.lit("."))), line("OX", F.concat(F.lit("NCBI_TaxID="), F.array_join(F.transform("taxonomy_id", lambda t: t.cast("string")), ", "), F.lit(";")))),
        each(F.col("references"), cited), each(F.col("comments"), lambda c: line("CC", F.concat(F.lit("-!- "), c))), each(F.col("xrefs"), lambda x: line("DR", xref(x))),
        F.array(line("PE", F.concat(text("protein_existence"), F.lit(": Said;"))), line("KW", F.concat(F.array_join("keywords", "; "), F.lit(".")))), each(F.col("features"), feature),
        F.array(F.format_string("SQ   SEQUENCE%6d AA;%7d MW;  %s CRC64;", F.length("sequence"), "molecular_weight", "crc64"), F.concat(F.lit("     "), F.regexp_replace("sequence", "(.{60})(?=.)", "$1\n     ")), F.lit("//")),
    ]
    records.select(F.array_join(F.filter(F.concat(*parts), lambda x: x.isNotNull()), "\n")).write.text(path)


SHORT_NOTE = 50


def feature_table(features: Column, first: Column, last: Column) -> Column:
    """Features (array of struct type, start, end, note, id) that meet the residues first to last, 0-based, as FT lines.

    Starts and ends are 1-based. A note under SHORT_NOTE letters stands behind its place, other qualifiers on lines of
    their own; without a feature the text is empty.
    """
    met = F.filter(features, lambda f: overlaps(f["start"] - 1, f["end"] - 1, first, last))

    def lines(f: Column) -> Column:
        place = F.concat(F.lit("FT   "), F.rpad(f["type"], 15, " "), F.lit(" "), f["start"].cast("string"), F.lit(".."), f["end"].cast("string"))
        said = lambda name: F.concat(F.lit(f'/{name}="'), f[name], F.lit('"'))
        own_line = lambda text: F.concat(F.lit("\nFT" + " " * 19), text)
        note = F.when(F.length(f["note"]) < SHORT_NOTE, F.concat(F.lit(" "), said("note"))).otherwise(own_line(said("note")))
        return F.concat(place, F.coalesce(note, F.lit("")), F.coalesce(own_line(said("id")), F.lit("")))

    table = F.array_join(F.transform(met, lines), "\n")
    return F.when(F.size(met) > 0, F.concat(F.lit("FT   Key             Location/Qualifiers\n"), table)).otherwise("")


def summaries(records: DataFrame) -> DataFrame:
    """name, id, entry and length of annotated records."""
    return records.select(names.recommended_name(F.col("description"), F.col("organism")).alias("name"), F.col("accession").alias("id"), F.col("entry_name").alias("entry"), "length")


def to_json(records: DataFrame) -> DataFrame:
    """(accession, json): a whole record as nested JSON."""
    return records.select("accession", F.to_json(F.struct(*records.columns)).alias("json"))


def number_records(sequences: DataFrame, order: str = "id") -> DataFrame:
    """sequences with seq_no from 0 in the given order."""
    return numbered(sequences, [F.asc(order)], rank="seq_no").withColumn("seq_no", F.col("seq_no") - 1)


def in_file_order(raw: DataFrame, rank: str) -> DataFrame:
    """Rows of a file source, read with FILE_PLACE, numbered from 0 in the order of files by name and of places in them."""
    return numbered(raw, [F.asc("_file"), F.asc("_start"), F.asc("_row")], rank=rank).withColumn(rank, F.col(rank) - 1).drop("_file", "_start", "_row")


#: Where a row of a file source stands: rows of a split are read in order, and splits are known by file and start.
FILE_PLACE = ("_metadata.file_path AS _file", "_metadata.file_block_start AS _start", "monotonically_increasing_id() AS _row")


def at_index(sequences: DataFrame, index: int) -> DataFrame:
    """The record with a number."""
    return sequences.filter(F.col("seq_no") == index)


def id_at_or_containing(sequences: DataFrame, key: str | int) -> DataFrame:
    """The record with a number, or the first whose id contains a text."""
    return at_index(sequences, key) if isinstance(key, int) else first_containing(sequences, key)


def ids_in_order(sequences: DataFrame) -> DataFrame:
    """All ids by number."""
    return sequences.select("seq_no", "id").orderBy("seq_no")


def select_range(sequences: DataFrame, start_at: int = 0, num_seqs: int | None = None) -> DataFrame:
    """The records numbered from start_at on, num_seqs of them or all."""
    end = F.lit(True) if num_seqs is None else F.col("seq_no") < start_at + num_seqs
    return sequences.filter((F.col("seq_no") >= start_at) & end)


def lookup(sequences: DataFrame, key: str) -> DataFrame:
    """Records whose id, accession or entry name is the key."""
    return sequences.filter((F.col("id") == key) | (F.col("accession") == key) | (F.col("entry_name") == key))


def first_containing(sequences: DataFrame, text: str, id_col: str = "id", order: str = "seq_no") -> DataFrame:
    """The first record, by number, whose id contains a text."""
    return sequences.filter(F.contains(F.col(id_col), F.lit(text))).orderBy(order).limit(1)


def subsequence(sequence: Column, start: int, end: int) -> Column:
    """[start, end) with negative places counted from the end, as slices do."""
    n = F.length(sequence)
    at = lambda x: F.greatest(n + x, F.lit(0)) if x < 0 else F.least(F.lit(x), n)
    return F.substring(sequence, at(start) + 1, F.greatest(at(end) - at(start), F.lit(0)))


def extract_remote_sequence(text: Column) -> Column:
    """The sequence between the SQ line and // of a record's text."""
    return F.regexp_replace(F.regexp_extract(text, r"(?s)\nSQ[^\n]*\n(.*?)\n?//", 1), r"\s", "")


PACKED_RESIDUES = 64 << 20


def pack(sequences: DataFrame, *, by_length: bool = True, residues: int = PACKED_RESIDUES) -> DataFrame:
    """(block, first_no, content): sequences (seq_no, description, sequence) as blocks of packed records, about `residues` long each.

    by_length: longest first, else by number. The blocks one after the other are the packed file; inverse_index() has
    the number of the record at each place.
    """
    placed = inverse_index(sequences, by_length).select("position", "seq_no", "upto")
    rows = sequences.select("seq_no", "description", "sequence").join(placed, "seq_no").withColumn("block", F.floor((F.col("upto") - 1) / residues).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        content = b"".join(map(pack_record, table.column("description").to_pylist(), table.column("sequence").to_pylist()))
        return pa.table({"block": table.column("block")[:1], "first_no": table.column("position")[:1], "content": pa.array([content], pa.binary())})

    return rows.groupBy("block").applyInArrow(run, "block long, first_no long, content binary")


def inverse_index(sequences: DataFrame, by_length: bool = True) -> DataFrame:
    """(position, seq_no, length, upto): the record at each place of the packed order, and the residues up to and with it."""
    rows = sequences.select("seq_no", F.length("sequence").cast("long").alias("length"))
    order = [F.desc("length"), F.asc("seq_no")] if by_length else [F.asc("seq_no")]
    ranked = numbered(rows, order, {"upto": F.greatest("length", F.lit(1))}, rank="position")
    return ranked.select((F.col("position") - 1).alias("position"), "seq_no", "length", "upto")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(seq_no, description, sequence) of packed files: little-endian lengths before description and sequence, ended by @.

    A file is one task's work; write large collections as several files, which number their records by file.
    """
    return unpack(spark.read.format("binaryFile").load(path).select(F.lit(0).cast("long").alias("first_no"), "content"))


def unpack(blocks: DataFrame) -> DataFrame:
    """(seq_no, description, sequence) of packed blocks (first_no, content), numbered from each block's first_no on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, at = [], 0
                while at + 4 <= len(raw):
                    texts = []
                    for _ in range(2):
                        (n,) = struct.unpack_from("<i", raw, at)
                        texts.append(raw[at + 4 : at + 4 + n].decode("latin-1"))
                        at += 4 + n
                    rows.append((first + len(rows), texts[0], texts[1].rstrip("@")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["seq_no", "description", "sequence"])

    return blocks.select("first_no", "content").mapInArrow(run, "seq_no long, description string, sequence string")


def pack_record(description: str, sequence: str) -> bytes:
    """One record of a packed file."""
    body, end = description.encode("latin-1"), sequence.encode("latin-1") + b"@"
    return struct.pack("<i", len(body)) + body + struct.pack("<i", len(end)) + end
