"""Token counts by a separator scan over flat token files.

A flat file is nothing but ids, document after document, each ended by a separator;
no index says where one begins. Files are cut to blocks that any task can read.
A block is searched for separators at once with numpy; it knows the lengths between
its own separators, and a prefix scan over the blocks of a file (sum of counts, largest
separator so far) gives the document that crosses its left edge and the number of its first one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adaptlm.llm.packing import encoder
from adaptlm.llm.shared import new_path, slices, tidy, written
from adaptlm.llm.warc import open_path

BLOCK_TOKENS = 1 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Flat token files of docs (doc_id, text) under path, one for each task; returns file, ordinal, doc_id of every document.

    The strings of special tokens in a text are ordinary text, so the separator occurs
    at ends alone. Null texts have no tokens. A rerun task writes its file anew and puts it in place when whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, True)
        end = np.asarray([end_id], encode.dtype).tobytes()
        name = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        fs, target = open_path(f"{path}/{name}")
        fs.create_dir(target.rpartition("/")[0], recursive=True)
        part, n = f"{target}.{uuid.uuid4().hex}.part", 0
        with fs.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for some in slices(batch, 1, 1000):
                    for text in some.column(1).to_pylist():
                        out.write(encode(text) + end)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * some.num_rows, pa.string()), pa.array(range(n, n + some.num_rows), pa.int64()), some.column(0)], names=["file", "ordinal", "doc_id"])
                    n += some.num_rows
        fs.move(part, target)
        encode.known.clear()
        tidy()

    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written(texts.mapInArrow(run, f"file string, ordinal long, doc_id {kind}"), "token-files")


def scan(spark: SparkSession, path: str, end_id: int, id_bytes: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """file (its place below the folder path), ordinal, n_tokens, ended of every document in the flat files (*.bin) in it and its sub-folders; separators are not counted.

    Tokens after a file's last separator are a document that is not ended. Two separators
    in a row end a document without tokens. Empty files and folders give no rows.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(path).select("path", (F.col("length") / id_bytes).cast("long").alias("tokens")).where("tokens > 0")
    blocks = files.select("path", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block))).alias("block"))
    blocks = blocks.select("path", "block", (F.col("block") * block).alias("start"), F.least(F.lit(block), F.col("tokens") - F.col("block") * block).alias("n"))
    blocks = written(blocks, "blocks").repartition(max(spark.sparkContext.defaultParallelism, 1) * 4, "path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number, start, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                fs, at = open_path(file)
                with fs.open_input_file(at) as f:
                    f.seek(start * id_bytes)
                    ids = np.frombuffer(f.read(n * id_bytes), f"<u{id_bytes}")
                ends = np.flatnonzero(ids == end_id) + start
                first, last = (int(ends[0]), int(ends[-1])) if len(ends) else (None, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.removeprefix(base)]), pa.array([number], pa.int64()), pa.array([start + n], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([np.diff(ends) - 1], pa.list_(pa.int64()))],
                    names=["file", "block", "stop", "ends", "first", "last", "inner"],
                )

    found = written(blocks.mapInArrow(run, "file string, block long, stop long, ends long, first long, last long, inner array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the scan itself is over one narrow row a block
    edges = found.select("file", "block", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("left"))
    joined = found.join(edges, ["file", "block"])
    lengths = F.concat(F.array(F.col("first") - F.col("left") - 1), F.col("inner"))
    whole = joined.where("ends > 0").select("file", "base", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    tail = found.groupBy("file").agg(F.sum("ends").alias("ordinal"), (F.max("stop") - 1 - F.coalesce(F.max("last"), F.lit(-1))).alias("n_tokens")).where("n_tokens > 0")
    return whole.unionByName(tail.withColumn("ended", F.lit(False)))


def token_counts(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens of every row of docs (doc_id, text): written as flat token files and counted by the scan.

    Null and empty texts have 0 tokens; repeated rows a row each; an empty table none; other columns are ignored.
    """
    spark = docs.sparkSession
    path = new_path(spark, "flat-tokens")
    names = write_tokens(docs, path, tokenizer_path, end_id)
    if not names.take(1):
        return names.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    counts = scan(spark, path, end_id, encoder(tokenizer_path, True).dtype.itemsize)
    return counts.where("ended").join(names, ["file", "ordinal"]).select("doc_id", "n_tokens")
