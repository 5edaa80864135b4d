from strandloom.session import Workspace
from strandloom.streaming import jobs


def lines(spark, folder):
    return spark.readStream.schema("seq_no long, line string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/lines")


def want(rows, n):
    by = {}
    for seq_no, line in sorted(set(rows)):
        by.setdefault({"HIT": "hit", "STE": "step"}.get(line[:3], "other"), []).append((seq_no, line))
    return sorted((c, *x) for c, found in by.items() for x in found[-n:])


def test_state_outlives_a_restart(spark):
    """Lines come in two runs of the stream, with repeats."""
    folder = Workspace(spark, "log").folder
    rows = [(i * 7 % 100, ("HIT: " if i % 3 else "x ") + str(i % 50)) for i in range(100)] + [(200, "STEP: a")]
    for part in (rows[:50], rows[40:]):
        spark.createDataFrame(part, "seq_no long, line string").repartition(2).write.mode("append").parquet(f"{folder}/lines")
        assert jobs.log_stream(lines(spark, folder), folder, n=4).awaitTermination(90)
    assert sorted(tuple(r) for r in jobs.last_lines(spark, folder).collect()) == want(rows, 4)


def test_idle_categories_go(spark):
    """A timer that has passed drops a category when the stream next looks; timers need a stream that keeps running."""
    folder = Workspace(spark, "log").folder
    spark.createDataFrame([(1, "HIT: a"), (2, "x b")], "seq_no long, line string").coalesce(1).write.mode("append").parquet(f"{folder}/lines")
    query = jobs.log_stream(lines(spark, folder), folder, n=4, idle_ms=1, trigger={"processingTime": "1 second"})
    for _ in range(40):
        if query.awaitTermination(1) or (query.lastProgress and not jobs.last_lines(spark, folder).count()):
            break
    query.stop()
    assert jobs.last_lines(spark, folder).count() == 0
