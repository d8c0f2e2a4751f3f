"""Embedding whitening: covariance from aggregations of generated SQL sums, components from LAPACK.

The centred products of every pair of dimensions (the upper triangle) are summed by generated Spark SQL expressions, PAIRS in an aggregation; the
driver assembles the covariance (dimensions squared numbers) and decomposes it. Vectors are then
projected by generated expressions too, so no Python runs on the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adaptlm.llm.codes import finite
from adaptlm.llm.shared import release, scratch, written

#: Sums of one aggregation at most; a triangle with more pairs takes several, as the driver plans and compiles each sum
#: (2,080 sums of 64 dimensions in one took over 1.5 GB of the driver's memory).
PAIRS = 128


def balanced(terms: list[str], joined: str) -> str:
    """Terms joined two by two (joined has places for both), so that an expression of many is not deep."""
    while len(terms) > 1:
        terms = [joined.format(*terms[i : i + 2]) if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def covariance(rows: DataFrame, centred: list[str], n: int) -> np.ndarray:
    """Covariance (divisor n) of SQL expressions over rows that are centred already."""
    size = len(centred)
    columns = rows.selectExpr(*(f"{c} AS c{i}" for i, c in enumerate(centred)))
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    out = np.zeros((size, size))
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        sums = columns.selectExpr(f"array({', '.join(f'sum(c{i} * c{j})' for i, j in some)})").first()[0]
        for (i, j), s in zip(some, sums):
            out[i, j] = out[j, i] = s / n
        release(rows.sparkSession)  # plans of so many sums are large
    return out


def components_of(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit eigenvectors of a covariance as rows, by falling eigenvalue, their largest entry positive, and the eigenvalues; those lost in rounding are 0."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most].copy(), vectors.T[::-1][:most].copy()
    values[values <= len(v) * np.finfo(float).eps * max(values.max(initial=0), 0)] = 0
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    return vectors, values


def whitened(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector (vec_id, embedding) and component.

    An entry c becomes the long x = floor(scale * c) + shift. Vectors that are null, empty or hold null or non-finite
    entries are dropped, and so are those with an entry of scale * |c| from 2^52 on, which has no exact x. Entries that a vector lacks, compared
    with the longest, are 0. The fit list is each distinct x once: n, means and covariances are of it. Rows that repeat
    and null ids stay; an empty table gives no rows; other columns are ignored.
    A component without variance has whitened null and explained 0 (null where no dimension
    varies), and takes no part in identity_error (null where there is none). A deviation that no long can hold is null.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
    rows = rows.where(finite(F.col("e")) & (F.size("e") > 0) & F.forall("e", lambda c: F.abs(c * scale) < 2.0**52))
    width = rows.agg(F.max(F.size("e"))).first()[0]
    if not width:
        return spark.createDataFrame([], schema)
    x = F.transform("e", lambda c: F.floor(c * scale) + F.lit(shift).cast("long"))
    x = F.concat(x, F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("e")))
    flat = [F.col("x")[i].alias(f"x{i}") for i in range(width)]
    rows = rows.select("vec_id", x.alias("x"))
    with scratch(spark):
        fit = written(rows.select("x").distinct().select(*flat), "fit-list")  # copies meet before the shuffle
        n, *sums = fit.selectExpr("count(*)", *(f"sum(CAST(x{i} AS decimal(38, 0)))" for i in range(width))).first()
        base, rest = zip(*(divmod(int(s), n) for s in sums))
        centred = [f"(x{i} - {b}L - {r / n!r}D)" for i, (b, r) in enumerate(zip(base, rest))]
        v = covariance(fit, centred, n)
        axes, values = components_of(v, components)
        of = [balanced([f"c{i} * {w!r}D" for i, w in enumerate((a / np.sqrt(s)).tolist())], "({} + {})") if s else "CAST(NULL AS double)" for a, s in zip(axes, values)]
        alive = [k for k, s in enumerate(values) if s]
        error = None
        if alive:
            white = fit.selectExpr(*(f"{c} AS c{i}" for i, c in enumerate(centred))).selectExpr(*(f"{of[k]} AS w{k}" for k in alive))
            means = white.selectExpr(*(f"avg(w{k})" for k in alive)).first()
            error = float(np.abs(covariance(white, [f"(w{k} - {m!r}D)" for k, m in zip(alive, means)], n) - np.eye(len(alive))).max())
    trace = float(np.trace(v))
    # n * x - S in whole numbers, from the part of x that is left of the mean's whole part
    away = [f"try_subtract(try_multiply({n}L, x{i} - {b}L), {r}L) AS t{i}" for i, (b, r) in enumerate(zip(base, rest))]
    squares = balanced([f"try_multiply(t{i}, t{i})" for i in range(width)], "try_add({}, {})")
    out = rows.select("vec_id", *flat).selectExpr("vec_id", *(f"{c} AS c{i}" for i, c in enumerate(centred)), *away)
    out = out.selectExpr("vec_id", f"{squares} AS deviation", f"posexplode(array({', '.join(of)})) AS (at, whitened)")
    explained = F.element_at(F.array(*(F.lit(float(s / trace) if trace else None).cast("double") for s in values)), F.col("at") + 1)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
