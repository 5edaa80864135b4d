"""Queries over files in the formats of sequence work: written from the given tables, read back, looked up and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import alphabet, names
from strandloom.functions.alphabet import letters_only
from strandloom.operators import annotation, integrity
from strandloom.plans.annotation_queries import _tokens_sql
from strandloom.plans.sequence_queries import FIND_NAMES, find_names
from strandloom.session import Workspace, cut_lineage, scratch_folder, settled, spread, table
from strandloom.sources import links, packed, sequences

TITLE = "Seen again"


def document_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' whole texts as sequences, with ids of three parts."""
    entry = F.format_string("DOC%d_%s", "doc_id", F.upper(F.coalesce("lang", F.lit("xx"))))
    ident = F.concat_ws("|", F.lit("sp"), F.format_string("D%06d", "doc_id"), entry)
    return table(spark, sf_dir, "documents").select("doc_id", ident.alias("id"), F.coalesce("source", F.lit("")).alias("description"), letters_only(F.coalesce("text", F.lit(""))).alias("sequence"))


DOCUMENT_SEQUENCES = """
docs AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq_no, printf('sp|D%06d|DOC%d_%s', doc_id, doc_id, upper(coalesce(lang, 'xx'))) AS id, printf('D%06d', doc_id) AS accession,
         printf('DOC%d_%s', doc_id, upper(coalesce(lang, 'xx'))) AS entry_name, coalesce(source, '') AS description, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS sequence
  FROM documents
)"""


def document_fasta(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The documents' sequences by way of FASTA files, numbered as they stand in them."""
    rows = document_sequences(spark, sf_dir).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    sequences.write_fasta(rows, f"{folder}/fasta")
    return sequences.read_fasta(spark, f"{folder}/fasta", numbers=True)


def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the documents' FASTA files, with its place in them."""
    folder = scratch_folder(spark, "fasta")
    read = document_fasta(spark, sf_dir, folder)
    return settled(read.select("seq_no", "id", "accession", "entry_name", "description", F.col("length").cast("long").alias("length"), F.md5("sequence").alias("digest")), folder)


FASTA_RECORDS = f"WITH {DOCUMENT_SEQUENCES} SELECT seq_no, id, accession, entry_name, description, len(sequence) AS length, md5(sequence) AS digest FROM docs"


def fasta_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by accession, entry name, number, part of the id and range of numbers, each with a slice of its sequence."""
    folder = scratch_folder(spark, "fasta")
    read = document_fasta(spark, sf_dir, folder)
    found = {
        "accession": sequences.lookup(read, "D000005"), "number": sequences.id_at_or_containing(read, 3), "containing": sequences.id_at_or_containing(read, "|DOC7"),
        "range": sequences.select_range(read, 10, 5), "last": sequences.select_range(read, 190),
    }
    cut = sequences.subsequence(F.col("sequence"), 5, 25)
    out = [rows.select(F.lit(how).alias("how"), "seq_no", "id", cut.alias("part")) for how, rows in found.items()]
    whole = out[0]
    for rows in out[1:]:
        whole = whole.union(rows)
    return settled(whole, folder)


FASTA_LOOKUPS = f"""WITH {DOCUMENT_SEQUENCES}, found AS (
  SELECT 'accession' AS how, * FROM docs WHERE accession = 'D000005' UNION ALL SELECT 'number', * FROM docs WHERE seq_no = 3
  UNION ALL SELECT 'containing', * FROM docs WHERE seq_no = (SELECT min(seq_no) FROM docs WHERE contains(id, '|DOC7'))
  UNION ALL SELECT 'range', * FROM docs WHERE seq_no BETWEEN 10 AND 14 UNION ALL SELECT 'last', * FROM docs WHERE seq_no >= 190
) SELECT how, seq_no, id, sequence[6:25] AS part FROM found"""


def packed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' sequences packed longest first in blocks and unpacked again, with the number of the record at each place."""
    rows = document_sequences(spark, sf_dir)
    given = rows.select(F.col("doc_id").alias("seq_no"), F.col("id").alias("description"), "sequence")
    unpacked = sequences.unpack(sequences.pack(given, residues=1 << 20))
    index = sequences.inverse_index(given).select("position", F.col("seq_no").alias("original"))
    back = unpacked.join(index, unpacked["seq_no"] == index["position"])
    return back.select("position", "original", "description", F.length("sequence").cast("long").alias("length"), F.md5("sequence").alias("digest"))


PACKED_RECORDS = f"""WITH {DOCUMENT_SEQUENCES}
SELECT row_number() OVER (ORDER BY len(sequence) DESC, CAST(accession[2:] AS BIGINT)) - 1 AS position, CAST(accession[2:] AS BIGINT) AS original, id AS description, len(sequence) AS length, md5(sequence) AS digest
FROM docs"""


def packed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' sequences in packed files, longest first, read back in ranges of records, with the number of the record at each place."""
    rows = document_sequences(spark, sf_dir)
    given = rows.select(F.col("doc_id").alias("seq_no"), F.col("id").alias("description"), "sequence")
    work = Workspace(spark, "packed")
    packed.write_packed(given, f"{work.folder}/files")
    index = sequences.inverse_index(given).select("position", F.col("seq_no").alias("original"))
    read = packed.read_packed(spark, f"{work.folder}/files")
    back = read.join(index, read["seq_no"] == index["position"])
    return work.result(back.select("position", "original", "description", F.length("sequence").cast("long").alias("length"), F.md5("sequence").alias("digest")))


def first_last_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty longest and the twenty shortest sequences of the packed order."""
    rows = document_sequences(spark, sf_dir).select(F.col("doc_id").alias("seq_no"), "sequence")
    index = sequences.inverse_index(rows).select("position", "seq_no", "length")
    last = index.orderBy(F.desc("position")).limit(20).select(F.lit("last").alias("end"), "*")
    return index.orderBy("position").limit(20).select(F.lit("first").alias("end"), "*").union(last)


FIRST_LAST_LENGTHS = f"""WITH {DOCUMENT_SEQUENCES}, ranked AS (
  SELECT row_number() OVER (ORDER BY len(sequence) DESC, seq_no) - 1 AS position, CAST(accession[2:] AS BIGINT) AS seq_no, len(sequence) AS length FROM docs
) SELECT 'first' AS "end", * FROM ranked WHERE position < 20 UNION ALL SELECT 'last', * FROM ranked WHERE position >= (SELECT count(*) FROM ranked) - 20"""


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as full annotated records."""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda pattern, *cols: F.format_string(pattern, *cols)
    some = lambda *rows: F.filter(F.array(*rows), lambda x: x.isNotNull())
    xref = lambda db, ident, *props: F.struct(F.lit(db).alias("db"), ident.alias("id"), F.array(*props).alias("props"))
    kind = F.concat(F.lower("p_type"), F.lit("fold"))
    feature = lambda what, start, end, note, ident: F.struct(F.lit(what).alias("type"), start.alias("start"), end.alias("end"), note.alias("note"), ident.alias("id"))
    return table(spark, sf_dir, "part").select(
        key.alias("part"), text("P%d_BRAND", key).alias("entry_name"), F.when(size % 4 == 0, "Unreviewed").otherwise("Reviewed").alias("data_class"),
        F.array(text("P%06d", key), text("S%d", key)).alias("accessions"),
        F.concat(F.lit("RecName: Full="), "p_name", F.lit(" maker {ECO:0000305}; Short="), "p_name", F.lit(";"), F.when(size % 10 == 0, text(" Family: fam%d;", key % 3)).otherwise("")).alias("description"),
        F.concat("p_brand", F.lit(" (Sort)")).alias("organism"), F.array((size + 1000).cast("int")).alias("taxonomy_id"), F.array(F.lit("Things"), F.col("p_type")).alias("lineage"),
        some(F.concat(F.lit("FUNCTION: Makes "), "p_name", F.lit(".")), F.when(size % 6 == 0, F.concat(F.lit("SIMILARITY: Belongs to the "), kind, F.lit(" family.")))).alias("comments"),
        some(F.when(size % 3 == 0, xref("GO", text("GO:%07d", size), F.lit("C:x"))), F.when(size % 5 == 0, xref("InterPro", text("IPR%06d", key % 7), F.concat(kind, F.lit(".1")))),
             F.when(size % 7 == 0, xref("PANTHER", text("PTHR%05d:SF1", key % 9), F.lit("some")))).alias("xrefs"),
        F.array(F.lit("Repeat"), F.initcap("p_type")).alias("keywords"),
        F.array(feature("DOMAIN", (size % 5 + 1).cast("int"), (size % 5 + 4).cast("int"), F.concat(kind, F.lit(" part")), text("D%d", key)),
                feature("CHAIN", (size % 3 + 2).cast("int"), (size % 3 + 6).cast("int"), F.rpad(F.lit("long note"), 60, "x"), text("R%d", key))).alias("features"),
        F.lit("2001-02-03").alias("created"), F.lit("2004-07-05").alias("sequence_update"), F.lit("2024-12-24").alias("annotation_update"), (size % 3 + 1).cast("int").alias("sequence_version"),
        size.cast("int").alias("entry_version"), (size % 5 + 1).cast("int").alias("protein_existence"),
        F.array(F.struct(F.lit(1).alias("number"), F.lit("MADE.").alias("positions"), F.concat("p_brand", F.lit(" A., Other B.")).alias("authors"), F.lit(TITLE).alias("title"),
                         text("J. Parts %d:1-2(2001)", size).alias("location"), F.array(F.struct(F.lit("PubMed").alias("db"), key.cast("string").alias("id"))).alias("ids"))).alias("references"),
        (F.length("p_name") * 110).cast("long").alias("molecular_weight"), text("%016X", key).alias("crc64"), letters_only(F.col("p_name")).alias("sequence"),
    )


def part_records(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The parts' records by way of annotated flat files, numbered as they stand in them."""
    rows = part_entries(spark, sf_dir).repartitionByRange("part").sortWithinPartitions("part").drop("part")
    sequences.write_flatfile(rows, f"{folder}/flat")
    return sequences.read_flatfile(spark, f"{folder}/flat", numbers=True)


PART_ENTRIES = """
parts AS (
  SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS seq_no, p_partkey AS key, p_size AS size, p_name AS name, p_brand AS brand, p_type AS type, lower(p_type) || 'fold' AS kind,
         printf('P%06d', p_partkey) AS accession, printf('P%d_BRAND', p_partkey) AS entry_name, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS sequence,
         'RecName: Full=' || p_name || ' maker {ECO:0000305}; Short=' || p_name || ';' || CASE WHEN p_size % 10 = 0 THEN printf(' Family: fam%d;', p_partkey % 3) ELSE '' END AS description,
         p_brand || ' (Sort)' AS organism
  FROM part
)"""


def flatfile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every record of the parts' flat files."""
    folder = scratch_folder(spark, "flat")
    read = part_records(spark, sf_dir, folder)
    join = lambda c, f=lambda x: x.cast("string"): F.array_join(F.transform(c, f), "|").alias(c)
    ref = F.col("references")[0]
    out = read.select(
        "seq_no", "entry_name", "data_class", "accession", join("accessions"), "description", "organism", join("taxonomy_id"), join("lineage"), join("comments"),
        join("xrefs", lambda x: F.concat_ws(" ", x["db"], x["id"], F.array_join(x["props"], ","))), join("keywords"),
        join("features", lambda f: F.concat_ws(" ", f["type"], f["start"].cast("string"), f["end"].cast("string"), f["id"], F.length(f["note"]).cast("string"))),
        "created", "sequence_update", "annotation_update", F.col("sequence_version").cast("long").alias("sequence_version"), F.col("entry_version").cast("long").alias("entry_version"),
        F.col("protein_existence").cast("long").alias("protein_existence"), "molecular_weight", "crc64", F.col("length").cast("long").alias("length"), "sequence",
        F.concat_ws("|", ref["number"].cast("string"), ref["positions"], ref["authors"], ref["title"], ref["location"], ref["ids"][0]["db"], ref["ids"][0]["id"]).alias("reference"),
    )
    return settled(out, folder)


FLATFILE_RECORDS = f"""WITH {PART_ENTRIES}
SELECT seq_no, entry_name, CASE WHEN size % 4 = 0 THEN 'Unreviewed' ELSE 'Reviewed' END AS data_class, accession, accession || '|S' || key AS accessions, description, organism,
       CAST(size + 1000 AS VARCHAR) AS taxonomy_id, 'Things|' || type AS lineage,
       'FUNCTION: Makes ' || name || '.' || CASE WHEN size % 6 = 0 THEN '|SIMILARITY: Belongs to the ' || kind || ' family.' ELSE '' END AS comments,
       array_to_string(list_filter([CASE WHEN size % 3 = 0 THEN printf('GO GO:%07d C:x', size) END, CASE WHEN size % 5 = 0 THEN printf('InterPro IPR%06d %s.1', key % 7, kind) END,
         CASE WHEN size % 7 = 0 THEN printf('PANTHER PTHR%05d:SF1 some', key % 9) END], lambda x: x IS NOT NULL), '|') AS xrefs,
       'Repeat|' || upper(type[1]) || lower(type[2:]) AS keywords,
       printf('DOMAIN %d %d D%d %d|CHAIN %d %d R%d 60', size % 5 + 1, size % 5 + 4, key, len(kind) + 5, size % 3 + 2, size % 3 + 6, key) AS features,
       '2001-02-03' AS created, '2004-07-05' AS sequence_update, '2024-12-24' AS annotation_update, CAST(size % 3 + 1 AS BIGINT) AS sequence_version, CAST(size AS BIGINT) AS entry_version,
       CAST(size % 5 + 1 AS BIGINT) AS protein_existence, CAST(len(name) * 110 AS BIGINT) AS molecular_weight, printf('%016X', key) AS crc64, len(sequence) AS length, sequence,
       '1|MADE.|' || brand || ' A., Other B.|{TITLE}|J. Parts ' || size || ':1-2(2001)|PubMed|' || key AS reference
FROM parts"""


def record_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, id, entry and length of the parts' records, as listings show them."""
    folder = scratch_folder(spark, "flat")
    return settled(sequences.summaries(part_records(spark, sf_dir, folder)).select("name", "id", "entry", F.col("length").cast("long").alias("length")), folder)


RECORD_SUMMARIES = f"WITH {PART_ENTRIES} SELECT name || ' maker; ' || organism AS name, accession AS id, entry_name AS entry, len(sequence) AS length FROM parts"


def integrity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA and flat files of the parts compared record by record by place; some sequences and accessions differ, and the FASTA files end earlier."""
    folder = scratch_folder(spark, "zip")
    flat = part_records(spark, sf_dir, folder).select("seq_no", "accession", "sequence")
    entries = part_entries(spark, sf_dir)
    key = F.col("part")
    ident = F.concat_ws("|", F.lit("sp"), F.when(key % 89 == 5, F.format_string("Q%06d", key)).otherwise(F.col("accessions")[0]), "entry_name")
    changed = F.when(key % 97 == 3, F.concat("sequence", F.lit("A"))).otherwise(F.col("sequence"))
    rows = entries.filter(key < F.lit(entries.agg(F.max("part")).first()[0]) - 2).select(key, ident.alias("id"), F.lit("").alias("description"), changed.alias("sequence"))
    sequences.write_fasta(rows.repartitionByRange("part").sortWithinPartitions("part"), f"{folder}/fasta")
    fasta = sequences.read_fasta(spark, f"{folder}/fasta", numbers=True).select("seq_no", "accession", "sequence")
    return settled(integrity.zip_compare(fasta, flat, "seq_no", ["accession", "sequence"]), folder)


INTEGRITY_FILES = f"""WITH {PART_ENTRIES}
SELECT seq_no, CASE WHEN key >= (SELECT max(key) FROM parts) - 2 THEN 'right only' WHEN key % 89 = 5 THEN 'accession differs' WHEN key % 97 = 3 THEN 'sequence differs' ELSE 'equal' END AS status FROM parts"""


def integrity_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten places at which the files differ."""
    return integrity.first_mismatches(integrity_files(spark, sf_dir), "seq_no")


def links_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by way of CSV files among which lines are malformed, without the repeats that a second run leaves."""
    folder = scratch_folder(spark, "links")
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.groupBy(F.col("l_partkey").alias("query_seq"), F.col("l_suppkey").alias("target_seq")).agg(F.sum("l_quantity").cast("int").alias("score"))
    links.write_links(rows, f"{folder}/csv/run=1")
    links.write_links(rows.filter("query_seq % 3 = 0"), f"{folder}/csv/run=2")
    rows.select(F.concat_ws(",", F.lit("?"), "query_seq", "score").alias("line")).write.text(f"{folder}/csv/run=3")
    rows.select(F.concat_ws(",", "query_seq", "score").alias("line")).write.text(f"{folder}/csv/run=4")
    return settled(links.deduplicated(links.read_links(spark, f"{folder}/csv")), folder)


LINKS_FILES = "SELECT l_partkey AS query_seq, l_suppkey AS target_seq, CAST(sum(l_quantity) AS INT) AS score FROM lineitem GROUP BY ALL"


def name_finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between part names as finds."""
    ident = lambda c: F.format_string("P%d", c)
    return find_names(spark, sf_dir).select(ident("query_seq").alias("id1"), ident("target_seq").alias("id2"), "score", F.col("len1").cast("int").alias("len1"), F.col("len2").cast("int").alias("len2"), "name1", "name2")


_NAME_FINDS = f"finds AS (SELECT 'P' || query_seq AS id1, 'P' || target_seq AS id2, score, CAST(len1 AS INT) AS len1, CAST(len2 AS INT) AS len2, name1, name2 FROM ({FIND_NAMES}))"


def finds_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the finds, line by line."""
    return links.finds_report(name_finds(spark, sf_dir))


FINDS_REPORT = f"""WITH {_NAME_FINDS},
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id1, id2) AS place FROM finds)
SELECT 0 AS line_no, 'found ' || count(*) || ' finds' AS line FROM finds
UNION ALL SELECT place * 3 - 2 + k, [id1 || '-' || id2 || ' s(' || score || ') Length: ' || len1 || '/' || len2, ' ' || name1, ' ' || name2][k + 1] FROM ranked, range(3) t(k)"""


def finds_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finds read back from the files of their report."""
    folder = scratch_folder(spark, "finds")
    links.write_lines(finds_report(spark, sf_dir), f"{folder}/report")
    return settled(links.read_finds(spark, f"{folder}/report"), folder)


FINDS_READ = f"WITH {_NAME_FINDS} SELECT * FROM finds"

#: Names of a vector's atoms, in turn.
ATOM_NAMES = ("N", "CA", "C", "FE1", "1HB", "CL2", "'O5", "QX")


def vector_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a chain of points: its components three by three, as atoms with coordinates in thousandths."""
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1), lambda k: F.struct(k.alias("k"), *[F.try_element_at("embedding", k * 3 + i + 1).cast("double").alias(c) for i, c in enumerate("xyz")]))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(parts).alias("p"))
    milli = [F.floor(F.col(f"p.{c}") * 1000).cast("long").alias(c) for c in "xyz"]
    return rows.select("vec_id", F.col("p.k").alias("k"), F.element_at(F.array(*map(F.lit, ATOM_NAMES)), F.col("p.k") % len(ATOM_NAMES) + 1).alias("name"), *milli)


def _thousandths(c: Column) -> Column:
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(F.abs(c) / 1000).cast("string"), F.lit("."), F.lpad((F.abs(c) % 1000).cast("string"), 3, "0"))


def structure_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Atoms by way of PDB files: the vector's id is the serial number and its last digit the chain, blank for 0."""
    atoms = vector_atoms(spark, sf_dir)
    chain = F.when(F.col("vec_id") % 10 == 0, " ").otherwise((F.col("vec_id") % 10).cast("string"))
    lines = atoms.select(links.pdb_line(F.col("vec_id") % 100_000, F.col("name"), chain, F.col("k") + 1, *[_thousandths(F.col(c)) for c in "xyz"]).alias("line"))
    short = atoms.filter("k = 0").select(F.lit("ATOM    cut off").alias("line"))
    lines.union(short).write.text(f"{folder}/pdb")
    return links.read_pdb(spark, f"{folder}/pdb")


def structure_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By element and chain of all atoms read: how many, and the sums of their coordinates in thousandths."""
    folder = scratch_folder(spark, "pdb")
    read = structure_files(spark, sf_dir, folder)
    milli = [F.sum(F.round(F.col(c) * 1000).cast("long")).alias(f"sum_{c}") for c in "xyz"]
    return settled(read.groupBy("element", "chain", "name").agg(F.count("*").alias("n"), *milli), folder)


_ATOMS = f"""
atoms AS (
  SELECT vec_id, k, {list(ATOM_NAMES)}[k % {len(ATOM_NAMES)} + 1] AS name, CASE WHEN vec_id % 10 = 0 THEN 'A' ELSE CAST(vec_id % 10 AS VARCHAR) END AS chain,
         CAST(floor(CAST(embedding[3 * k + 1] AS DOUBLE) * 1000) AS BIGINT) AS x, CAST(floor(CAST(embedding[3 * k + 2] AS DOUBLE) * 1000) AS BIGINT) AS y, CAST(floor(CAST(embedding[3 * k + 3] AS DOUBLE) * 1000) AS BIGINT) AS z
  FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 3)) AS k FROM embeddings)
)""".replace("\"'O5\"", "'''O5'")
STRUCTURE_ATOMS = f"""WITH {_ATOMS}
SELECT CASE name WHEN 'FE1' THEN 'FE' WHEN 'CL2' THEN 'CL' WHEN '1HB' THEN 'H' WHEN 'N' THEN 'N' WHEN '''O5' THEN 'O' ELSE 'C' END AS element, chain, name,
       count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(z) AS BIGINT) AS sum_z
FROM atoms GROUP BY ALL"""


def structure_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alpha carbons at aligned places, of the files' chains."""
    folder = scratch_folder(spark, "pdb")
    places = spark.range(1, 21, 8).select(F.col("id").cast("int").alias("index"))
    found = links.atoms_at(structure_files(spark, sf_dir, folder), places)
    return settled(found.groupBy("chain", "index").agg(F.count("*").alias("n"), F.sum(F.round(F.col("x") * 1000).cast("long")).alias("sum_x")).withColumn("index", F.col("index").cast("long")), folder)


STRUCTURE_PLACES = f"""WITH {_ATOMS} SELECT chain, k AS index, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x FROM atoms WHERE name = 'CA' AND k % 8 = 1 GROUP BY ALL"""


def matrix_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What neighbouring letters of each part name score together under matrices read by name from files."""
    folder = scratch_folder(spark, "matrices")
    equal = {(a, b): 5 if a == b else -4 for a, _ in alphabet.MATRICES["PAM250"] for b, _ in alphabet.MATRICES["PAM250"]}
    texts = spark.createDataFrame([("EQUAL", alphabet.square_text(equal)), ("PAM250", alphabet.square_text(alphabet.MATRICES["PAM250"]))], "name string, value string")
    for name in ("EQUAL", "PAM250"):
        texts.filter(F.col("name") == name).select("value").coalesce(1).write.text(f"{folder}/{name}")
    for name in ("EQUAL", "PAM250"):
        read = alphabet.read_matrices(spark, f"{folder}/{name}")
        alphabet.register_matrix(f"{name} read", next(iter(read.values())))
    scores = alphabet.matrix_table(spark, ["EQUAL read", "PAM250 read"])  # some hundred rows
    names_ = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", letters_only(F.col("p_name")).alias("s"))
    places = F.when(F.length("s") > 1, F.sequence(F.lit(1), F.length("s") - 1))  # a sequence to 0 would count down
    pairs = names_.select("p_partkey", F.explode(F.transform(places, lambda i: F.struct(F.substring("s", i, F.lit(1)).alias("a"), F.substring("s", i + 1, F.lit(1)).alias("b")))).alias("p"))
    joined = pairs.select("p_partkey", "p.a", "p.b").join(F.broadcast(scores), ["a", "b"])  # else the pairs may be, estimated by the names that they come from
    out = joined.groupBy("p_partkey").agg(*[F.sum(F.when(F.col("name") == f"{n} read", F.col("score"))).cast("long").alias(n.lower()) for n in ("EQUAL", "PAM250")])
    return settled(out, folder)


_MATRIX = ", ".join(f"('{a}{b}', {s})" for (a, b), s in alphabet.MATRICES["PAM250"].items())
MATRIX_SCORES = f"""WITH s AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS s FROM part),
pairs AS (SELECT p_partkey, s[i : i + 1] AS ab FROM (SELECT p_partkey, s, unnest(range(1, len(s))) AS i FROM s)),
m AS (SELECT * FROM (VALUES {_MATRIX}) t(ab, score))
SELECT p_partkey, CAST(sum(CASE WHEN ab[1] = ab[2] THEN 5 ELSE -4 END) AS BIGINT) AS equal, CAST(sum(score) AS BIGINT) AS pam250 FROM pairs JOIN m USING (ab) GROUP BY p_partkey"""


def residue_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By part: the sums of its name's residue codes, and of the chemical distances of neighbouring letters."""
    s = letters_only(F.col("p_name"))
    letters = F.split(s, "")
    codes = F.aggregate(letters, F.lit(0).cast("long"), lambda n, c: n + alphabet.residue_index(c))
    steps = F.zip_with(letters, F.slice(letters, F.lit(2), F.greatest(F.size(letters) - 1, F.lit(0))), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), alphabet.chemical_distance(a, b)))
    far = F.aggregate(steps, F.lit(0).cast("long"), lambda n, d: n + F.coalesce(d, F.lit(0)))
    return table(spark, sf_dir, "part").select("p_partkey", codes.alias("codes"), far.alias("distance"))


_RANK = f"nullif(instr('{alphabet.CHEMICAL_ORDER}', c), 0)"
RESIDUE_CODES = f"""WITH s AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS s FROM part),
l AS (SELECT p_partkey, i, s[i] AS c FROM (SELECT p_partkey, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
d AS (SELECT p_partkey, ascii(c) & 31 AS code, CASE WHEN i > 1 THEN coalesce(abs({_RANK} - lag({_RANK}) OVER w), 100) ELSE 0 END AS d FROM l WINDOW w AS (PARTITION BY p_partkey ORDER BY i))
SELECT p_partkey, CAST(sum(code) AS BIGINT) AS codes, CAST(sum(d) AS BIGINT) AS distance FROM d GROUP BY p_partkey"""


def remote_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences taken out of the texts of records that come without their final line ends, as remote ones do."""
    text = F.concat(F.lit("ID   X\nSQ   SEQUENCE 1 AA;\n     "), F.regexp_replace("sequence", "(.{10})(?=.)", "$1 "), F.lit("\n//"))
    return part_entries(spark, sf_dir).select("part", sequences.extract_remote_sequence(text).alias("sequence"))


REMOTE_SEQUENCES = "SELECT p_partkey AS part, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS sequence FROM part"


def feature_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of each part's record that meet its first residues, as lines."""
    return part_entries(spark, sf_dir).select("part", sequences.feature_table(F.col("features"), F.lit(0), F.lit(2)).alias("lines"))


FEATURE_TABLES = f"""WITH {PART_ENTRIES}, lines AS (
  SELECT key AS part, 'FT   DOMAIN          ' || (size % 5 + 1) || '..' || (size % 5 + 4) || ' /note="' || kind || ' part"' || chr(10) || repeat(' ', 0) || 'FT' || repeat(' ', 19) || '/id="D' || key || '"' AS domain,
         'FT   CHAIN           ' || (size % 3 + 2) || '..' || (size % 3 + 6) || chr(10) || 'FT' || repeat(' ', 19) || '/note="' || rpad('long note', 60, 'x') || '"' || chr(10) || 'FT' || repeat(' ', 19) || '/id="R' || key || '"' AS chain,
         size % 5 <= 2 AS has_domain, size % 3 + 1 <= 2 AS has_chain FROM parts
)
SELECT part, CASE WHEN has_domain OR has_chain THEN 'FT   Key             Location/Qualifiers' || CASE WHEN has_domain THEN chr(10) || domain ELSE '' END || CASE WHEN has_chain THEN chr(10) || chain ELSE '' END ELSE '' END AS lines
FROM lines"""


def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled tokens of all names in each part's description."""
    return part_entries(spark, sf_dir).select("part", F.array_join(F.array_sort(names.all_name_terms(F.col("description"))), " ").alias("tokens"))


#: Tokens of four letters on, where annotation_queries takes eight.
def short_tokens_sql(text: str) -> str:
    return _tokens_sql(text).replace(f"len(w) >= {names.STEM_LENGTH})", f"len(w) >= {names.NAME_TOKEN_LENGTH})")


_POOLED = f"list_sort(list_distinct(list_concat({short_tokens_sql("name || ' maker'")}, {short_tokens_sql('name')})))"
NAME_TOKENS = f"WITH {PART_ENTRIES} SELECT key AS part, array_to_string({_POOLED}, ' ') AS tokens FROM parts"

def explain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts three keys apart, explained by their names or by their records of the flat files."""
    folder = scratch_folder(spark, "flat")
    records = cut_lineage(part_records(spark, sf_dir, folder).select("accession", "xrefs", "description", "comments", "features"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" maker")).alias("name"))
    ident = lambda c: F.format_string("P%06d", c)
    other = parts.select((F.col("p_partkey") - 3).alias("p_partkey"), F.col("name").alias("name2"))
    finds = parts.join(other, "p_partkey").select(ident("p_partkey").alias("id1"), ident(F.col("p_partkey") + 3).alias("id2"), F.col("name").alias("name1"), "name2")
    return settled(annotation.explain(finds, records).select("id1", "id2", F.col("phase").cast("string").alias("phase"), "reason"), folder)


_SHARED = f"list_sort(list_intersect({_POOLED.replace('name', 'a.name')}, {_POOLED.replace('name', 'b.name')}))"
_STEMS = f"""list_sort(list_distinct(list_intersect({_tokens_sql("a.name || ' maker'")}, {_tokens_sql("b.name || ' maker'")})))"""
EXPLAIN_RECORDS = f"""WITH {PART_ENTRIES}, said AS (
  SELECT a.accession AS id1, b.accession AS id2,
    CASE WHEN contains(a.name, 'toxin') AND contains(b.name, 'toxin') THEN 'toxins' WHEN lower(a.name || ' maker')[1:11] = lower(b.name || ' maker')[1:11] THEN 'similar names' END AS zero,
    nullif(array_to_string({_STEMS}, ', '), '') AS one,
    CASE WHEN a.size % 5 = 0 AND b.size % 5 = 0 AND a.key % 7 = b.key % 7 THEN printf('InterPro: IPR%06d', a.key % 7) WHEN a.size % 7 = 0 AND b.size % 7 = 0 AND a.key % 9 = b.key % 9 THEN printf('Panther: PTHR%05d', a.key % 9)
         WHEN a.size % 7 = 0 AND b.size % 7 = 0 AND abs(a.key % 9 - b.key % 9) = 1 THEN printf('Panther: PTHR%05d/PTHR%05d', least(a.key % 9, b.key % 9), greatest(a.key % 9, b.key % 9))
         WHEN list_sum(list_transform({_SHARED}, lambda x: len(x))) >= 10 THEN 'Name: ' || array_to_string({_SHARED}, ', ')
         WHEN a.size % 6 = 0 AND b.size % 6 = 0 AND a.kind = b.kind THEN '-!- SIMILARITY: ' || a.kind WHEN a.size % 10 = 0 AND b.size % 10 = 0 AND a.key % 3 = b.key % 3 THEN printf('Family: fam%d', a.key % 3)
         WHEN a.kind = b.kind THEN 'Domain: ' || a.kind END AS two
  FROM parts a JOIN parts b ON b.key = a.key + 3
) SELECT id1, id2, CASE WHEN zero IS NOT NULL THEN '0' WHEN one IS NOT NULL THEN '1' WHEN two IS NOT NULL THEN '2' END AS phase, coalesce(zero, one, two) AS reason FROM said"""

QUERIES = {
    "explain_records": explain_records,
    "fasta_records": fasta_records, "fasta_lookups": fasta_lookups, "packed_records": packed_records, "packed_files": packed_files, "first_last_lengths": first_last_lengths, "flatfile_records": flatfile_records,
    "record_summaries": record_summaries, "integrity_files": integrity_files, "integrity_mismatches": integrity_mismatches, "links_files": links_files, "finds_report": finds_report,
    "finds_read": finds_read, "structure_atoms": structure_atoms, "structure_places": structure_places, "matrix_scores": matrix_scores, "residue_codes": residue_codes,
    "remote_sequences": remote_sequences, "feature_tables": feature_tables, "name_tokens": name_tokens,
}
ORACLES = {
    "explain_records": EXPLAIN_RECORDS,
    "fasta_records": FASTA_RECORDS, "fasta_lookups": FASTA_LOOKUPS, "packed_records": PACKED_RECORDS, "packed_files": PACKED_RECORDS, "first_last_lengths": FIRST_LAST_LENGTHS, "flatfile_records": FLATFILE_RECORDS,
    "record_summaries": RECORD_SUMMARIES, "integrity_files": INTEGRITY_FILES, "integrity_mismatches": f"SELECT * FROM ({INTEGRITY_FILES}) WHERE status <> 'equal' ORDER BY seq_no LIMIT 10",
    "links_files": LINKS_FILES, "finds_report": FINDS_REPORT, "finds_read": FINDS_READ, "structure_atoms": STRUCTURE_ATOMS, "structure_places": STRUCTURE_PLACES, "matrix_scores": MATRIX_SCORES,
    "residue_codes": RESIDUE_CODES, "remote_sequences": REMOTE_SEQUENCES, "feature_tables": FEATURE_TABLES, "name_tokens": NAME_TOKENS,
}
