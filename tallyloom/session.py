"""Session construction and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyloom", cores: str | None = None) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("TL_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TL_DRIVER_MEM", "12g"))
        .config("tallyloom.text.partitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names in ``spark.checkpoint.dir``.

    Only a local session, where both are one process, may do without; it gets a scratch
    folder.  On a cluster a folder of one machine would lose what other machines write.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a step of a loop to the shared folder and go on from the written table.

    The table outlives lost executors, and its file sizes give the next round's joins
    real statistics: estimates carried through many self-joins would grow without end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """The versions of one table of a loop: each cut keeps the new one and the one before, and removes older files."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        self.held.append(cut_lineage(df))
        if len(self.held) > 2:
            remove(self.held.pop(0))
        return self.held[-1]


class Log:
    """A table that a loop adds rows to and reads as a whole at the end; the plan does not grow with the rounds."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema, self.parts = spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", None, 0

    def add(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` and return them as written."""
        self.schema = rows.schema
        part = f"{self.path}/part={self.parts}"
        rows.write.parquet(part)
        self.parts += 1
        return self.spark.read.schema(self.schema).parquet(part)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/part={i}" for i in range(self.parts)])

    def fold(self, merge, most: int = 32) -> None:
        """Once there are ``most`` parts, replace all by one: ``merge`` of the whole.  Parts handed out before must be used up."""
        if self.parts < most:
            return
        old = self.read()
        self.path, self.parts = f"{shared_folder(self.spark)}/log-{uuid.uuid4().hex}", 0
        self.add(merge(old))
        remove(old)


def remove(df: DataFrame) -> None:
    """Delete the files of a written step that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
