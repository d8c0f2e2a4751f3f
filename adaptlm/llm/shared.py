"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch between Spark and Python, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and executors are in this process."""
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="adaptlm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by rows and bytes (a smaller bound stays)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"-?\d+", spark.conf.get(key, None) or "")
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and about so many bytes of a text or binary column; a longer value is a part of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def tidy() -> None:
    """Give memory that a task has freed back to the system, as a worker process outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/adaptlm/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path made by new_path()."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes in this block are deleted at its end, but for kept ones, which go with the block around it, if any."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            drop_path(spark, path)
        release(spark)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and lost executors cost no more than the running stage.

    keep: what the caller returns still reads it (see scratch()).
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if len(_SCRATCH) > keep:
        _SCRATCH[-1 - keep].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _plain_scan(df: DataFrame) -> bool:
    """Whether the rows of df are rows of files, each at most once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation")


def keyed(df: DataFrame, *columns: str, key: str = "rid", name: str = "rows") -> DataFrame:
    """The named columns alone (clashing extra columns go) and a row key, struct<f: long, r: long>, so repeated ids and null ids stay apart.

    The key is a row's place: a 64-bit hash of its file's path and its number in that file, so it
    is the same in every scan, however files are cut into tasks. What is no plain scan of
    files with row numbers is written once, and the written table is scanned.
    """
    narrow = df.select(*(F.col(c) for c in columns))
    place = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    if _plain_scan(narrow):
        with contextlib.suppress(AnalysisException):  # a format without row numbers
            return narrow.select(*columns, place.alias(key))
    return written(narrow, name, keep=True).select(*columns, place.alias(key))


def release(spark: SparkSession) -> None:
    """Let the driver forget the shuffle files of plans that are done, so that their disk is free for the next step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of keys that are sent to every executor at most (a key and a few numbers each); more of them are joined by a shuffle.
MOST_SENT = 20_000


def sent(keys: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it is within the bound, else for a shuffle: Spark itself would send what is few bytes in files."""
    return F.broadcast(keys) if keys.count() <= MOST_SENT else keys.hint("merge")


#: Bytes of marks() that are sent to every executor at most; more of them are joined by a shuffle.
MOST_MARKS = 32 << 20
#: Rows of a file that are one row of marks.
MARKED_ROWS = 1 << 16


def _held_word(digit: str, k: Column) -> Column:
    return F.coalesce(F.try_element_at("_held", k)[digit], F.lit(0).cast("long"))


def marked(rows: DataFrame, keys: DataFrame, value: str, of_file: str | None = None) -> DataFrame:
    """rows (with rid as keyed() gives it) and what keys (rid, value: a whole number from 0 on) has for them, 0 where it has no such rid.

    keys is a written table of different rids. Its values are sent as bits, one for each row of their files and binary digit, so rows with texts stay
    where they are, and what is sent is about an eighth of a byte a row; beyond MOST_MARKS bytes the two are joined by a shuffle.
    of_file: a column of keys that is the same for all rows of a file; rows get it too (null where value is 0).
    """
    also = [of_file] if of_file else []
    digits = max(int(keys.agg(F.max(value)).first()[0] or 0).bit_length(), 1)
    bit = lambda i: F.bit_or(F.expr(f"shiftleft(shiftright(`{value}`, {i}) & 1L, int(rid.r & 63))")).alias(f"_{i}")
    word = [bit(i) for i in range(digits)]
    words = keys.where(F.col(value) > 0).groupBy(F.col("rid.f").alias("_f"), F.shiftright("rid.r", 6).alias("_w")).agg(*word, *(F.max(c).alias(c) for c in also))
    at = F.col("_w").bitwiseAND(MARKED_ROWS // 64 - 1)
    held = F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.struct(*(f"_{i}" for i in range(digits))).alias("v"))))
    chunks = words.groupBy("_f", F.shiftright("_w", (MARKED_ROWS // 64).bit_length() - 1).alias("_c")).agg(held.alias("_held"), F.max(at).alias("_last"), *(F.max(c).alias(c) for c in also))
    places = F.sequence(F.lit(0).cast("long"), F.col("_last"))
    dense = [F.transform(places, functools.partial(_held_word, f"_{i}")).alias(f"_{i}") for i in range(digits)]
    marks = written(chunks.select("_f", "_c", *dense, *also), "marks", keep=True)
    size = marks.agg(F.sum(F.size("_0") * (8 * digits) + 64)).first()[0] or 0
    if size > MOST_MARKS:
        return rows.join(keys.where(F.col(value) > 0).select("rid", value, *also).hint("merge"), "rid", "left").na.fill({value: 0})
    chunk = F.shiftright("rid.r", MARKED_ROWS.bit_length() - 1)
    found = rows.join(F.broadcast(marks), (F.col("rid.f") == F.col("_f")) & (chunk == F.col("_c")), "left")
    sums = " + ".join(f"shiftleft(coalesce(shiftright(get(_{i}, int(shiftright(rid.r, 6) & {MARKED_ROWS // 64 - 1})), int(rid.r & 63)) & 1L, 0L), {i})" for i in range(digits))
    return found.select(*(rows[c] for c in rows.columns), F.expr(sums).alias(value), *also)
