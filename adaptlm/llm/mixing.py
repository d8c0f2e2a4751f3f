"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight, the score of the
quality model; the smallest keys of a source come first. A target of e whole source sizes and a rest is met by e
complete epochs, then by the documents in order of their keys until their prefix
sum reaches the rest; the document at the edge gives the words still wanted.
Rows are dealt to ranges of (source, key) of even numbers of rows, and prefix sums are taken in two steps, over
the ranges and inside each, so that no task holds a whole source. Only narrow rows are sorted; texts
join the rows that the mix takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adaptlm.llm.quality import AdditiveModel, features
from adaptlm.llm.shared import WORD, keyed, marked, scratch, sent, slices, tidy, written
from adaptlm.llm.words import text_bytes, word_bounds

#: Rows of a range, about.
RANGE_ROWS = 250_000
#: Sources whose sizes the driver takes at most.
MOST_SOURCES = 1_000_000
#: Fixed value: the weights that the sources take in turn.
CYCLE = (5.0, 2.0, 1.0)
#: The least quality weight, for scores near 0.
LEAST_WEIGHT = 0.01


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: float) -> dict[str | None, float]:
    """Words for each source: total by weight, none above most times its size, the excess reshared by weight."""
    out: dict[str | None, float] = {}
    free = dict(weights)
    while free:
        left, parts = total - sum(out.values()), sum(free.values())
        share = {s: left * w / parts if parts else 0.0 for s, w in free.items()}
        over = [s for s, x in share.items() if x > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            del free[s]
    return out


def in_turn(sources: list[str | None], cycle: tuple[float, ...] = CYCLE) -> dict[str | None, float]:
    """Weights that the sources take in turn, by code point, null last."""
    return {s: cycle[i % len(cycle)] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def measured(rows: DataFrame, model: AdditiveModel | None) -> DataFrame:
    """rid, doc_id, source, text_hash, size (words), weight (the quality score, at least LEAST_WEIGHT; 1 without a model) of rows rid, doc_id, source, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4):
                texts = part.column(4)
                size = np.diff(word_bounds(*text_bytes(texts))[2])
                weight = np.ones(len(size)) if model is None else np.maximum(model.score(features(texts)), LEAST_WEIGHT)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(size, pa.int64()), pa.array(weight)], names=["rid", "doc_id", "source", "text_hash", "size", "weight"])
        tidy()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = rows.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return narrow.mapInArrow(run, "rid struct<f:long,r:long>, doc_id long, source string, text_hash long, size long, weight double")


def mix(docs: DataFrame, model: AdditiveModel | None = None, weights: dict[str | None, float] | None = None, share: float = 1.0, most_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """Per row of docs (doc_id, text, source): rid, doc_id, source, size, source_size, target, epochs, rest, taken.

    model: scores a document's quality, its weight in the fractional selection; without one all weigh the same.
    weights: by default 5, 2, 1 in turn over the sources by code point, null last.
    taken = epochs * size + rest, where rest is size for a document of the fractional
    selection, less for the one at its edge, else 0. Null texts have size 0; repeated
    rows are documents each (equal keys are of equal rows, so reruns agree);
    sources of size 0 get nothing; an empty table gives no rows; other columns are ignored.
    """
    return _mix_rows(keyed(docs, "doc_id", "source", "text"), model, weights, share, most_epochs, seed)


def _mix_rows(rows: DataFrame, model: AdditiveModel | None = None, weights: dict[str | None, float] | None = None, share: float = 1.0, most_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """mix() of rows that have their key rid."""
    with scratch(rows.sparkSession):
        return _placed(rows, model, weights, share, most_epochs, seed)


def _placed(rows: DataFrame, model: AdditiveModel | None, weights: dict[str | None, float] | None, share: float, most_epochs: float, seed: int) -> DataFrame:
    spark = rows.sparkSession
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash")), 11).cast("double") + 0.5) / float(1 << 53)
    drawn = written(measured(rows, model).withColumn("es_key", -F.log(u) / F.col("weight")).drop("weight"), "mix")
    sums = drawn.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).limit(MOST_SOURCES + 1).collect()  # a row for each source
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = dict(sorted(((r.source, r.n) for r in sums), key=lambda x: (x[0] is None, x[0] or "")))
    by = weights if weights is not None else in_turn(list(sizes))
    goal = targets(sizes, {s: by.get(s, 0.0) for s in sizes}, share * sum(sizes.values()), most_epochs)
    plan = [(s, sizes[s], float(goal[s]), int(goal[s] // sizes[s]) if sizes[s] else 0) for s in sizes]
    plan = spark.createDataFrame([(*p, round(p[2]) - p[3] * p[1]) for p in plan], "p_source string, source_size long, target double, epochs long, rest_words long")
    order = ["es_key", "doc_id", "text_hash", "rid"]
    ranges = max(spark.sparkContext.defaultParallelism, -(-sum(r.rows for r in sums) // RANGE_ROWS))
    # the bounds of ranges come from a sample of the rows; the range of each row is written, not found anew
    ranged = written(drawn.repartitionByRange(ranges, "source", *order).withColumn("range", F.spark_partition_id()), "mix-ranged", keep=True)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = written(ranged.groupBy("source", "range").agg(F.sum("size").alias("n")), "mix-ranges", keep=True)
    base = per_range.select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(base, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range"))).join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    left = F.col("rest_words") - F.col("base") - F.col("before")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select("rid", "doc_id", "source", "size", "source_size", "target", "epochs", rest.alias("rest"), (F.col("epochs") * F.col("size") + rest).alias("taken"))


def mixed_documents(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars"), model: AdditiveModel | None = None, **options) -> DataFrame:
    """The rows of the mix: each document once an epoch, once more if the fractional selection takes it, cut after its last taken word at the edge.

    text and n_chars (its length) are those of the row; other columns are the document's. Documents without words, null texts among
    them, are in no mix; repeated rows are documents each; an empty table gives no rows; columns beside the given ones go.
    """
    rows = keyed(docs, *dict.fromkeys(("doc_id", "source", "text", *columns)))
    with scratch(docs.sparkSession):
        taken = written(_mix_rows(rows, model, **options).where("taken > 0").select("rid", "size", "epochs", "rest"), "mix-taken", keep=True)
    # names that no column of docs has; a source has one document at the edge at most
    whole = (F.col("epochs") + (F.col("rest") == F.col("size")).cast("long")).alias("_whole")
    edge = (F.col("rest") > 0) & (F.col("rest") < F.col("size"))
    cuts = written(taken.where(edge).select(F.col("rid").alias("_rid"), F.col("rest").alias("_rest")), "mix-edges", keep=True)
    m = marked(rows, taken.select("rid", whole), "_whole").join(sent(cuts), F.col("rid") == F.col("_rid"), "left")
    whole, parts = F.col("_whole").cast("int"), F.col("_rest").isNotNull()
    m = m.where((whole > 0) | parts)
    copies = m.withColumn("_copy", F.explode(F.sequence(F.lit(1), whole + parts.cast("int"))))
    # each word with the white space before it
    words, gaps = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.split("text", WORD, -1)
    n = F.col("_rest").cast("int")
    cut = F.array_join(F.zip_with(F.slice(gaps, 1, n), F.slice(words, 1, n), lambda a, b: F.concat(a, b)), "")
    text = F.when(F.col("_copy") <= whole, F.col("text")).otherwise(cut)
    return copies.withColumn("_text", text).select(*(F.length("_text").cast("long").alias(c) if c == "n_chars" else F.col("_text").alias(c) if c == "text" else F.col(c) for c in columns))
