"""Vector code compression: product quantisation in whole numbers, exact on every machine.

The vectors become columnar NumPy blocks (a row of integers for each dimension), written once. Each round is one RDD
treeAggregate over the blocks: squared distances to a part's entries accumulate dimension by
dimension, np.add.at adds the parts to int64 tensors of sums and counts, and the tensors of the tasks merge through a
reduction tree. The driver holds the codebooks alone (parts x entries x width of a part).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adaptlm.llm.shared import scratch, sent, tidy, written

#: Rows of a block and bytes of its components, at most about.
BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20


def finite(e: Column) -> Column:
    """Whether an array is not null and holds neither nulls nor non-finite values."""
    return e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _whole(x: np.ndarray, scale: int, kind: type) -> np.ndarray:
    """floor(scale * x); as Python integers, however large, where kind is object."""
    if kind is np.int64:
        return np.floor(x.astype(float) * scale).astype(np.int64)
    flat = [math.floor(v * scale) if abs(v) < 2.0**60 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[part, vector] of x[dimension, vector]: the nearest entry of books[part, entry, place], the lower of equals, and its squared distance."""
    parts, entries, width = books.shape
    codes, errors = np.zeros((parts, x.shape[1]), np.int64), np.zeros((parts, x.shape[1]), x.dtype)
    for p in range(parts):
        far = np.zeros((entries, x.shape[1]), x.dtype)
        for k in range(width):
            step = x[p * width + k] - books[p, :, k, None]
            far += step * step
        codes[p] = far.argmin(0)
        errors[p] = np.take_along_axis(far, codes[p][None], 0)[0]
    return codes, errors


def tallied(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums[part, entry, place] and counts[part, entry] of the parts of x by their nearest entries."""
    parts, entries, width = books.shape
    sums, counts = np.zeros(books.shape, x.dtype), np.zeros((parts, entries), np.int64)
    codes, _ = assigned(x, books)
    for p in range(parts):
        np.add.at(sums[p], codes[p], x[p * width : (p + 1) * width].T)
        np.add.at(counts[p], codes[p], 1)
    return sums, counts


def books_sha256(books: np.ndarray) -> str:
    """SHA-256 of all components of the entries as decimal integers, in order of part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes array<int>, error) of the vectors (vec_id, embedding, label if there is one), and the codebooks [part, entry, place].

    A component becomes floor(scale * x). Vectors that are null or hold null or non-finite
    components are dropped; the zero vector and the empty one stay. Components that a vector lacks, compared
    with the longest and rounded up to a multiple of parts, are 0. The codebooks start as the parts of the first entries rows by vec_id (null ids
    last, equal ids by their components; fewer rows: fewer entries). Rows that repeat count each. An empty
    table gives no rows and codebooks without entries. Other columns are ignored. Where sums or distances could
    leave 63 bits, Python integers take over; an error that no long can hold is null.
    """
    with scratch(vectors.sparkSession):
        return _compressed(vectors, parts, entries, rounds, scale)


def _compressed(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> tuple[DataFrame, np.ndarray]:
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)
    narrow = "float" in kinds["embedding"]
    label = F.col("label") if "label" in kinds else F.lit(None).cast("int").alias("label")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label, F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("e"))
    rows = rows.where(finite(F.col("e")))
    n, width, top = rows.agg(F.count(F.lit(1)), F.max(F.size("e")), F.max(F.array_max(F.transform("e", lambda x: F.abs(x).cast("double"))))).first()
    schema = f"vec_id long, label {dict(rows.dtypes)['label']}, codes array<int>, error long"
    if not n:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    width = -(-width // parts) * parts
    most = (int(top or 0) + 1) * scale
    kind = np.int64 if n * most < 1 << 62 and max(width, 1) * (2 * most) ** 2 < 1 << 62 else object
    held = np.dtype("<f4" if narrow else "<f8")
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, width * held.itemsize)))

    def columnar(lists: pa.Array) -> np.ndarray:
        """[dimension, vector], lacking components 0."""
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(lists), width), held)
        out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return np.ascontiguousarray(out.T)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            one = np.array([0, len(t)], np.int32)
            columns = [pa.ListArray.from_arrays(one, t.column(i).combine_chunks()) for i in (0, 1)]
            x = columnar(pa.chunked_array(t.column(2)).combine_chunks())
            return pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes()], pa.binary())], names=["ids", "labels", "components"])

        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                waiting.append(b.slice(at, block_rows))
                if sum(w.num_rows for w in waiting) >= block_rows:
                    yield block()
        if waiting:
            yield block()
        tidy()

    # the blocks of one scan; their order and sizes do not matter, as integer sums are exact
    blocks = written(rows.mapInArrow(cut, f"ids array<long>, labels array<{dict(rows.dtypes)['label']}>, components binary"), "part-blocks")
    first = [r.e for r in rows.orderBy(F.asc_nulls_last("vec_id"), "e").limit(entries).select("e").collect()]
    start = _whole(columnar(pa.array(first, pa.list_(pa.from_numpy_dtype(held)))), scale, kind)
    books = np.ascontiguousarray(start.reshape(parts, width // parts, len(first)).transpose(0, 2, 1))

    def whole(components: bytes, rows_of: int) -> np.ndarray:
        return _whole(np.frombuffer(components, held).reshape(width, rows_of), scale, kind)

    parts_of_blocks = blocks.select(F.size("ids").alias("n"), "components").rdd
    for _ in range(rounds):
        now = books

        def add(total: tuple | None, block: tuple, now: np.ndarray = now) -> tuple:
            sums, counts = tallied(whole(bytes(block[1]), block[0]), now)
            return (sums, counts) if total is None else (total[0] + sums, total[1] + counts)

        def merge(a: tuple | None, b: tuple | None) -> tuple | None:
            return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

        sums, counts = parts_of_blocks.treeAggregate(None, add, merge, depth=2)
        used = counts > 0
        books = now.copy()
        books[used] = sums[used] // counts[used][:, None]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels = b.column(0).slice(i, 1).flatten(), b.column(1).slice(i, 1).flatten()
                codes, errors = assigned(whole(b.column(2)[i].as_py(), len(ids)), books)
                total = errors.sum(0)
                error = pa.array(total) if kind is np.int64 else pa.array([v if v < 1 << 63 else None for v in total.tolist()], pa.int64())
                lists = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * parts, codes.T.ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, labels, lists, error], names=["vec_id", "label", "codes", "error"])
        tidy()

    return written(blocks.mapInArrow(coded, schema), "codes", keep=True), books


def code_digests(vectors: DataFrame, **options: int) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (over equal labels, nulls together) and codebooks_sha256 of compressed().

    A label_error is null where an error of its label is, or where no long can hold it.
    """
    rows, books = compressed(vectors, **options)
    whole = F.count("error") == F.count(F.lit(1))
    sums = rows.groupBy("label").agg(F.when(whole, F.sum(F.col("error").cast("decimal(20,0)"))).alias("total"))
    sums = written(sums.select(F.col("label").alias("of"), F.expr("try_cast(total AS bigint)").alias("label_error")), "label-errors")
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    return rows.join(sent(sums), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"), "label")
