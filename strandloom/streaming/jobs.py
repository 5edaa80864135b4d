"""Streams of links kept as a forest, of log lines kept by category, and of running sums."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from strandloom.functions.formats import line_category
from strandloom.operators.forest import maximum_spanning_forest


def forest_stream(links: DataFrame, folder: str, *, u: str = "query_seq", v: str = "target_seq", score: str = "score") -> StreamingQuery:
    """Keeps the forest of all links so far in folder/forest-<batch>, taking each micro-batch in as it comes.

    The forest of old forest and batch is the forest of everything. A batch that is repeated after a failure reads
    the forest before it again and writes the same result, so replays do no harm.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"), F.col(score).cast("long").alias("score"))
        if number:
            new = new.union(spark.read.parquet(f"{folder}/forest-{number - 1}"))
        maximum_spanning_forest(new, u="u", v="v").write.mode("overwrite").parquet(f"{folder}/forest-{number}")

    return links.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def last_by_category(lines: DataFrame, line_col: str = "line", order_col: str = "seq_no", n: int = 10) -> DataFrame:
    """(category, lines): the last n lines of each category, newest last.

    Rank limits cut each partition to n lines a category before they meet, so no category is gathered whole.
    """
    w = Window.partitionBy("category").orderBy(F.desc(order_col))
    newest = lines.withColumn("category", line_category(F.col(line_col))).withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n)
    kept = newest.groupBy("category").agg(F.array_sort(F.collect_list(F.struct(F.col(order_col), F.col(line_col)))).alias("kept"))
    return kept.select("category", F.transform("kept", lambda s: s[line_col]).alias("lines"))


class LastLines(StatefulProcessor):
    """Keeps the last n lines of one category in list state; with `idle_ms` a timer drops the category once no line has come for so long."""

    def __init__(self, n: int, idle_ms: int | None) -> None:
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "seq_no long, line string")
        self.updates = handle.getValueState("updates", "updates long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found = {tuple(x) for x in self.kept.get()}
        for frame in rows:
            found |= set(zip(frame["seq_no"].tolist(), frame["line"].tolist()))
            found = set(sorted(found)[-self.n :])
        self.kept.put(sorted(found))
        yield self._said(key, sorted(found))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield self._said(key, [])

    def _said(self, key: tuple, lines: list[tuple[int, str]]) -> pd.DataFrame:
        updates = (self.updates.get()[0] if self.updates.exists() else 0) + 1
        self.updates.update((updates,))
        return pd.DataFrame({"category": [key[0]], "updates": [updates], "kept": [[{"seq_no": n, "line": x} for n, x in lines]]})

    def close(self) -> None: ...


def log_stream(
    lines: DataFrame, folder: str, line_col: str = "line", order_col: str = "seq_no", n: int = 10, idle_ms: int | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Keeps the last n lines of each category in the state store, and writes what changes to folder/changes; last_lines() reads it.

    A batch is first cut to n lines a category in the tasks that read it, so a category with most lines is no more in its
    task than others. State holds n lines a category; a batch that is repeated after a failure writes its folder again.
    The session's state store must be RocksDB, which this sets. trigger is that of writeStream, all that is there by default.
    """
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    named = lines.select(line_category(F.col(line_col)).alias("category"), F.col(order_col).cast("long").alias("seq_no"), F.col(line_col).alias("line"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop_duplicates().sort_values("seq_no").groupby("category", sort=False).tail(n)

    changes = named.mapInPandas(cut, named.schema).groupBy("category").transformWithStateInPandas(
        LastLines(n, idle_ms), "category string, updates long, kept array<struct<seq_no: long, line: string>>", "Update", "None" if idle_ms is None else "ProcessingTime"
    )

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    query = changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint")
    return query.trigger(**(trigger or {"availableNow": True})).start()


def last_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(category, seq_no, line) of what a log stream keeps now."""
    changes = spark.read.schema("category string, updates long, kept array<struct<seq_no: long, line: string>>").parquet(f"{folder}/changes/batch=*")
    newest = changes.groupBy("category").agg(F.max_by("kept", "updates").alias("kept"))  # n lines each
    return newest.select("category", F.explode("kept").alias("x")).select("category", "x.seq_no", "x.line")


def run_available(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now into a table of files and returns the table's last state."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state-{number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return stream.sparkSession.read.parquet(f"{folder}/state-{last}")


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of its files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def append_available(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there now in append mode and returns all it put out: rows that no later one can change."""
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def flush_links(links: DataFrame, folder: str, every: str = "60 seconds") -> StreamingQuery:
    """Appends links (query_seq, target_seq, score) to CSV files in folder/links, one flush each time `every` has passed.

    What is flushed is recorded in folder/checkpoint, so a run that was stopped goes on where its last flush ended.
    """
    rows = links.select("query_seq", "target_seq", "score")
    out = rows.writeStream.format("csv").option("header", True).option("checkpointLocation", f"{folder}/checkpoint")
    return out.trigger(processingTime=every).start(f"{folder}/links")
