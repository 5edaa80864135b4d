"""Session building, table reading and lineage cutting shared by the whole library."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "strandloom", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use; on a cluster spark-submit sets these."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df itself, or dealt out anew if it lies in fewer partitions than the session has cores, as a small file does.

    For work that costs far more than moving its rows; large tables have partitions enough and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where the session names none, a temporary one is set in local mode, as in tests; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandloom-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and go on from there; such a checkpoint outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_unused(spark: SparkSession) -> None:
    """Lets Spark remove the shuffles and checkpoints that nothing refers to any more, which it otherwise does at some later time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name within the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def settled(df: DataFrame, folder: str) -> DataFrame:
    """df cut from the files of a scratch folder, which is removed."""
    out = cut_lineage(df)
    remove_folder(df.sparkSession, folder)
    return out


class Workspace:
    """Written tables in one scratch folder of the shared one.

    A written table cuts lineage as a checkpoint does and outlives lost executors, but it can be removed as soon as
    its readers are done. What is neither dropped nor closed stays until clear_results(), as does what result() returns.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.made = spark, f"{results_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a written table."""
        self.made += 1
        return self._written(df, f"{self.folder}/{self.made}")

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *kept: DataFrame) -> None:
        """Removes tables that keep() returned."""
        for df in kept:
            for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
                remove_folder(self.spark, folder)

    def drop_all_but(self, *kept: DataFrame) -> None:
        """Removes all that keep() has written but these tables and what they are made of."""
        left = {file.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in kept for file in df.inputFiles()}
        for number in range(1, self.made + 1):
            if str(number) not in left:
                remove_folder(self.spark, f"{self.folder}/{number}")

    def close(self) -> None:
        """Removes all that keep() has written."""
        remove_folder(self.spark, self.folder)

    def result(self, df: DataFrame) -> DataFrame:
        """df as a written table of its own; all that keep() has written goes."""
        out = self._written(df, f"{results_folder(self.spark)}/{uuid.uuid4().hex}")
        self.close()
        return out


def results_folder(spark: SparkSession) -> str:
    """Where tables lie that queries have written; one folder for each application."""
    return f"{shared_folder(spark)}/results-{spark.sparkContext.applicationId}"


def clear_results(spark: SparkSession) -> None:
    """Removes the written tables of this application; their DataFrames can't be read any more."""
    remove_folder(spark, results_folder(spark))
