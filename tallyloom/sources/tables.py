"""Parquet table access by folder and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Tables whose rows are long texts: the work per row is large, the number of rows small.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder.

    Where the session names a number in ``tallyloom.text.partitions``, text tables are dealt
    to so many partitions: a local run over one small file would otherwise use one core.
    Unset, as on a cluster, they stay as the scan splits them.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    parts = spark.conf.get("tallyloom.text.partitions", None)
    return df.repartition(int(parts)) if parts and name in TEXT_TABLES else df
