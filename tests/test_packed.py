import pytest

from strandloom.session import Workspace
from strandloom.sources import packed, sequences

ROWS = [(i, f"record {i}" if i % 5 else None, "ACDEFGHIK" * (i % 7) if i != 8 else None) for i in range(300)]


def test_written_and_read_in_ranges(spark):
    frame = spark.createDataFrame(ROWS, "seq_no long, description string, sequence string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder = f"{Workspace(spark, 'packed').folder}/files"
    packed.write_packed(frame, folder, by_length=False)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = packed.read_packed(spark, folder).collect()
    assert sorted((r["seq_no"], r["description"], r["sequence"]) for r in found) == [(i, d or "", s or "") for i, d, s in ROWS]
    small = spark.read.format("packed").option("recordsOfATask", 10).load(folder)
    assert small.rdd.getNumPartitions() >= 30 and small.count() == 300
    some = small.filter("seq_no >= 95 and seq_no < 105")
    assert [r["seq_no"] for r in some.orderBy("seq_no").collect()] == list(range(95, 105)) and some.rdd.getNumPartitions() <= 4
    assert small.filter("seq_no = 7").first()["description"] == "record 7" and small.filter("seq_no = 900").count() == 0
    assert small.filter("description = 'record 11' and seq_no > 10").first()["seq_no"] == 11
    with pytest.raises(Exception, match="holds packed files"):
        packed.write_packed(frame, folder)


def test_files_are_the_packed_form(spark):
    frame = spark.createDataFrame(ROWS[:20], "seq_no long, description string, sequence string").coalesce(1)
    folder = f"{Workspace(spark, 'packed').folder}/files"
    packed.write_packed(frame, folder)
    old = sequences.read_packed(spark, f"{folder}/*.packed").collect()
    assert sorted((r["seq_no"], r["description"], r["sequence"]) for r in old) == sorted(tuple(r) for r in packed.read_packed(spark, folder).collect())
    none = f"{Workspace(spark, 'packed').folder}/files"
    packed.write_packed(frame.limit(0), none)
    assert packed.read_packed(spark, none).count() == 0
