"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all, exact reranking.

A node splits at the median of its sample along the difference of two of its vectors
(scaled to length one). A query keeps one queue for all trees: the node that is least far on the
wrong side of its splits is opened next. That distance bounds what the node holds from below, so the queue stops where it
passes a part (slack) of the distance to the k-th nearest of the sample: near neighbours in sight close the search early,
vectors without structure keep it open, at every number of rows.
The distinct candidates of those leaves are ranked by the exact cosine of the original vectors.
The trees are fitted on a bounded sample; every row is indexed. Each vector lies in one block, with its leaf of every
tree; a block meets the queries in parts, so a task holds a block and a part of the queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adaptlm.llm.shared import scratch, slices, tidy, written

#: Vectors of a block and queries of a part, at most about.
BLOCK_ROWS, PART_ROWS = 32_768, 4096


class Forest:
    """Trees as flat arrays: nodes of a tree have a normal, a threshold and two children; a child below 0 is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, trees: int, leaf_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(sample, leaf_rows, rng) for _ in range(trees)]
        self.offsets = np.cumsum([0, *(t[3] for t in self.trees)])

    @staticmethod
    def _grow(x: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        normals, cuts, children, leaves = [], [], [], 0
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            split = None
            if len(rows) > leaf_rows:
                for _ in range(8):
                    a, b = rng.choice(len(rows), 2, replace=False)
                    w = x[rows[a]] - x[rows[b]]
                    if (size := np.linalg.norm(w)) > 1e-9:
                        p = x[rows] @ (w / size)
                        left = p <= np.median(p)
                        if 0 < left.sum() < len(rows):
                            split = (w / size, float(np.median(p)), left)
                            break
            if split is None:
                child, leaves = -1 - leaves, leaves + 1
            else:
                child = len(normals)
                normals.append(split[0]), cuts.append(split[1]), children.append([0, 0])
                todo += [(rows[split[2]], child, 0), (rows[~split[2]], child, 1)]
            if parent >= 0:
                children[parent][side] = child
        return np.array(normals).reshape(len(normals), x.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), leaves

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """[row, tree]: the leaf of each vector of length one, numbered through all trees."""
        out = np.empty((len(x), len(self.trees)), np.int64)
        for t, (normals, cuts, children, _) in enumerate(self.trees):
            if not len(cuts):
                out[:, t] = self.offsets[t]
                continue
            right = (x @ normals.T > cuts).astype(np.int64)
            at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            while (inner := at >= 0).any():
                at[inner] = children[at[inner], right[rows[inner], at[inner]]]
            out[:, t] = self.offsets[t] - 1 - at
        return out

    def opened(self, q: np.ndarray, bound: float) -> list[int]:
        """The leaves that the shared queue opens for a query of length one, nearest first, until all that is left is farther than bound."""
        queue, found = [], []
        margins = [normals @ q - cuts for normals, cuts, _, _ in self.trees]
        for t, tree in enumerate(self.trees):
            queue.append((-np.inf, t, 0 if len(tree[1]) else -1))
        heapq.heapify(queue)
        while queue and queue[0][0] <= bound:
            far, t, node = heapq.heappop(queue)
            if node < 0:
                found.append(int(self.offsets[t]) - 1 - node)
                continue
            m, (left, right) = margins[t][node], self.trees[t][2][node]
            heapq.heappush(queue, (max(far, m), t, int(left)))
            heapq.heappush(queue, (max(far, -m), t, int(right)))
        return found


def reach(sample: np.ndarray, q: np.ndarray, k: int) -> float:
    """The distance from a query of length one to the k-th nearest other row of the sample, without end if it has fewer."""
    if len(sample) <= k:
        return np.inf
    return float(np.sqrt(max(0.0, 2 - 2 * np.partition(sample @ q, len(sample) - 1 - k)[len(sample) - 1 - k])))


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of a column of packed vectors in double precision; components that a short one lacks are 0."""
    packed = column.to_pylist()
    if any(len(v) != width for v in packed):
        packed = [v.ljust(width, b"\0") for v in packed]
    return np.frombuffer(b"".join(packed), kind).astype(float).reshape(len(packed), width // np.dtype(kind).itemsize)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, trees: int = 24, slack: float = 0.045, leaf_rows: int = 64, sample_rows: int = 16_384, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, by cosine, for each row of vectors (vec_id, embedding) whose id is divisible by every.

    slack: leaves nearer than this part of the distance to the k-th nearest row of the sample are opened, which sets
    recall: 0.95 and more of vectors without any structure, at any number of rows. sample_rows
    bounds the sample that the trees are fitted on; leaf_rows is the most of it in a leaf (small samples: fewer). Vectors that are null, zero
    or hold null or non-finite components take no part, nor do null ids. Components that a vector
    lacks, compared with the longest, are 0. Equal
    vectors are indexed once with their k + 1 smallest ids; rows that repeat an id
    with its vector count once, and no candidate has the query's own id.
    Ties go to the smaller id. An empty table gives no rows; other columns are ignored.
    """
    with scratch(vectors.sparkSession):
        return _nearest(vectors, every, k, trees, slack, leaf_rows, sample_rows, seed)


def _nearest(vectors: DataFrame, every: int, k: int, trees: int, slack: float, leaf_rows: int, sample_rows: int, seed: int) -> DataFrame:
    spark = vectors.sparkSession
    kind = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"
    schema = "query_id long, rank int, vec_id long, score double"
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e).where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(np.array(x, kind) + 0).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["vec_id", "vec"])

    rows = written(rows.mapInArrow(packed, "vec_id long, vec binary"), "vectors")
    # many copies of one vector meet in two steps, each with k + 1 ids at most
    some = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    salted = rows.groupBy("vec", (F.xxhash64("vec_id") % 64).alias("salt")).agg(some.alias("ids"))
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    distinct = written(salted.groupBy("vec").agg(merged.alias("ids")), "distinct-vectors")
    n, width = distinct.agg(F.count(F.lit(1)), F.max(F.octet_length("vec"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    sample = pa.array([r.vec for r in distinct.orderBy(F.xxhash64("vec"), "vec").limit(sample_rows).select("vec").collect()], pa.binary())
    fitted = _unit(_matrix(sample, kind, width))
    forest = Forest(fitted, trees, max(8, min(leaf_rows, len(sample) // 64)), seed)
    leaves_in_all = int(forest.offsets[-1])
    blocks = max(1, -(-n // min(BLOCK_ROWS, max(1024, n // (4 * max(spark.sparkContext.defaultParallelism, 1))))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0, 2048):
                leaves = forest.leaves_of(_unit(_matrix(part.column(0), kind, width))).astype("<i4")
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x.tobytes() for x in leaves], pa.binary())], names=["vec", "ids", "block", "leaves"])
        tidy()

    block = F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("long").alias("block")
    index = written(distinct.select("vec", "ids", block).mapInArrow(placed, "vec binary, ids array<long>, block long, leaves binary"), "forest", keep=True)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, 64):
                opened = np.zeros((part.num_rows, leaves_in_all), bool)
                for i, q in enumerate(_unit(_matrix(part.column(1), kind, width))):
                    opened[i, forest.opened(q, slack * reach(fitted, q, k))] = True
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in np.packbits(opened, axis=1)], pa.binary())], names=["query_id", "vec", "opened"])
        tidy()

    asked = rows.where(F.col("vec_id") % every == 0).distinct().repartition(max(spark.sparkContext.defaultParallelism, 1), "vec_id")
    queries = written(asked.mapInArrow(routed, "query_id long, vec binary, opened binary"), "routed-queries", keep=True)
    parts = max(1, -(-queries.count() // PART_ROWS))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    entries = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def ranked(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            x = _matrix(right.column("vec").combine_chunks(), kind, width)
            sizes_x = np.sqrt((x * x).sum(1))
            ids = right.column("ids").to_pylist()
            leaves = np.frombuffer(b"".join(right.column("leaves").to_pylist()), "<i4").reshape(len(x), -1)
            for batch in left.to_batches(64):
                for qid, q, bits in zip(batch.column("query_id").to_pylist(), _matrix(batch.column("vec"), kind, width), batch.column("opened").to_pylist()):
                    opened = np.unpackbits(np.frombuffer(bits, np.uint8), count=leaves_in_all).view(bool)
                    candidates = np.flatnonzero(opened[leaves].any(1))
                    if not len(candidates):
                        continue
                    r = (x[candidates] @ q) / sizes_x[candidates]
                    near = np.argpartition(-r, k)[: k + 1] if len(r) > k + 1 else np.arange(len(r))
                    edge = r[near].min()
                    near = candidates[r >= edge - 1e-9 * abs(edge)]  # ties at the edge stay
                    score = (x[near] * q).sum(1) / (sizes_x[near] * np.sqrt((q * q).sum()))
                    best = sorted((-s, i) for s, j in zip(score.tolist(), near) for i in ids[j] if i != qid)[:k]
                    out[0].extend([qid] * len(best)), out[1].extend(i for _, i in best), out[2].extend(-s for s, _ in best)
        tidy()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    by = ("block", "part")
    found = queries.groupBy(*by).cogroup(entries.groupBy(*by)).applyInArrow(ranked, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
