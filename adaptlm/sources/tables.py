"""Tables: reading, checkpointing, incremental writing."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that are sent to every executor at most (a key, a term and a few numbers each).
MOST_SENT = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and executors are in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="adaptlm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the cluster's checkpoint folder (a temporary one where none is set, as in tests)."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def sent(rows: DataFrame, most: int | None = None) -> tuple[DataFrame, bool]:
    """rows cut from their lineage, so that they are made once, and whether they are within the bound and marked for broadcast; more of them are joined by a shuffle."""
    rows = checkpointed(rows)
    few = rows.count() <= (MOST_SENT if most is None else most)
    return (F.broadcast(rows) if few else rows), few


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Write df by the column's values; other values' rows in the table stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
