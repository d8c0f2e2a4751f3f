"""Rankings and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adaptlm.functions.text import is_ascii
from adaptlm.operators.lm import with_background


def base_ranking(results: DataFrame, key: str) -> DataFrame:
    """key, pos from 1 to the largest position, gaps included."""
    return results.groupBy(key).agg(F.max("pos").alias("_m")).select(key, F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("pos"))


def rerank(base: DataFrame, viewed: DataFrame, scores: DataFrame, key: str, promote: int = 3, all_results: bool = False) -> DataFrame:
    """key, pos, rank: viewed results, then the best scored ones not viewed (at most promote), then the base ranking; first places count.

    With all_results the viewed ones are not put first and every score promotes.
    """
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 6)), "pos")
    ahead = scores if all_results else scores.join(viewed.select(key, "pos"), [key, "pos"], "left_anti")
    ahead = ahead.withColumn("_n", F.row_number().over(w))
    ahead = (ahead if all_results else ahead.where(F.col("_n") <= promote)).select(key, "pos", F.lit(1).alias("_part"), F.col("_n").cast("long").alias("_at"))
    parts = ahead.unionByName(base.select(key, "pos", F.lit(2).alias("_part"), F.col("pos").cast("long").alias("_at")))
    if not all_results:
        parts = parts.unionByName(viewed.select(key, "pos", F.lit(0).alias("_part"), F.col("seq").cast("long").alias("_at")))
    first = parts.groupBy(key, "pos").agg(F.min(F.struct("_part", "_at")).alias("_f"))
    return first.select(key, "pos", F.row_number().over(Window.partitionBy(key).orderBy("_f", "pos")).alias("rank"))


def own_scores(models: DataFrame, results: DataFrame, probs: DataFrame, default: DataFrame, key: str, prior: float) -> DataFrame:
    """key, pos, score of a search's own results by its model. models: key, term, prob; results: key, pos, term, tf. As kl_scores(), without those that share no term."""
    q = with_background(models.select(key, "term", F.col("prob").alias("_w")), probs, default, "_p")
    facts = q.groupBy(key).agg(F.sum("_w").alias("_qlen"), F.sum(F.col("_w") * F.ln("_p")).alias("_base"))
    size = results.groupBy(key, "pos").agg(F.sum("tf").alias("_dlen"))
    gain = q.join(results, [key, "term"]).groupBy(key, "pos").agg(F.sum(F.col("_w") * F.ln(1 + F.col("tf") / prior / F.col("_p"))).alias("_gain")).where("_gain > 0")
    score = (F.col("_gain") + F.col("_base")) / F.col("_qlen") + F.ln(F.lit(prior) / (F.col("_dlen") + prior))
    return gain.join(facts, key).join(size, [key, "pos"]).select(key, "pos", score.alias("score"))


def rerank_by_model(queries: DataFrame, results: DataFrame, viewed: DataFrame, models: DataFrame, adaptive: DataFrame, probs: DataFrame, default: DataFrame, key: str, text: str = "text", prior: float = 100.0, promote: int = 3, all_results: bool = False, despite: bool = False) -> DataFrame:
    """key, pos, rank: results ranked anew by each search's model.

    queries: key, text; results: key, pos, term, tf; viewed: key, pos, seq; models: key, term, prob; adaptive: key, adaptive.
    The base ranking stays where the query is not printable ASCII, the model is empty, or it is not adaptive (unless despite).
    """
    base = base_ranking(results, key)
    good = queries.where(is_ascii(F.col(text))).select(key).join(models.select(key).distinct(), key, "left_semi")
    if not despite:
        good = good.join(adaptive.where("adaptive").select(key), key, "left_semi")
    mine = lambda df: df.join(good, key, "left_semi")
    scores = own_scores(mine(models), mine(results), probs, default, key, prior)
    anew = rerank(mine(base), mine(viewed), scores, key, promote, all_results)
    return anew.unionByName(base.join(good, key, "left_anti").select(key, "pos", F.col("pos").cast("int").alias("rank")))


def page_request(engine: str, start: Column, count: Column) -> Column:
    """struct<start, count> that a source is asked for so that it covers count ranks from start on: whole tens, for aol a 10 or 20 whose start it divides, for boss at most 100."""
    low = F.floor(start / 10) * 10 + 1
    need = start + count - low
    if engine == "boss":
        size = F.when(need > 100, 100).otherwise(F.floor((need + 9) / 10) * 10)
    elif engine == "aol":
        size = F.when(need > 10, 20).otherwise(10)
        low = F.floor(low / size) * size + 1
    else:
        size = F.lit(10)
    return F.struct(low.cast("int").alias("start"), size.cast("int").alias("count"))


def covering_pages(first: Column, count: Column, size: int = 10, most: int = 100) -> Column:
    """array<struct<start, count>> of the pages asked for one after the other until the range is covered; at most most ranks are wanted."""
    wanted = F.least(count, F.lit(most))
    return F.transform(page_starts(first, wanted, size), lambda s: F.struct(s.alias("start"), F.lit(size).alias("count")))


class SourceRegistry:
    """Result sources by id, in the order in which they were added."""

    def __init__(self) -> None:
        self.sources: dict[str, Callable[..., DataFrame]] = {}

    def add(self, name: str, source: Callable[..., DataFrame]) -> None:
        self.sources[name] = source

    def get(self, name: str) -> Callable[..., DataFrame] | None:
        return self.sources.get(name)

    def names(self) -> list[str]:
        return list(self.sources)


def search_or_fetch(cached: DataFrame, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame], key: str = "search_id") -> DataFrame:
    """cached results (key, pos, ...) with what wanted (key, start, count) lacks: only searches whose range is not covered are fetched, new rows replace old ones."""
    ranks = wanted.select(key, F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("pos"))
    missing = ranks.join(cached.select(key, "pos"), [key, "pos"], "left_anti").select(key).distinct()
    return merged_pages(cached, fetch(wanted.join(missing, key, "left_semi")).select(*cached.columns), key, "pos")


def result_at(results: DataFrame, asked: DataFrame, key: str = "search_id") -> DataFrame:
    """asked (key, pos) with the result's columns, null where there is none."""
    return asked.join(results, [key, "pos"], "left")


def page(ranked: DataFrame, start: int, size: int = 10) -> DataFrame:
    """Rows whose rank is on the page that starts there."""
    return ranked.where(F.col("rank").between(start, start + size - 1))


def page_counters(total: Column, start: Column, size: int = 10) -> Column:
    """struct<first, last, next_start, prev_start>; no next or previous page gives null."""
    return F.struct(
        start.alias("first"),
        F.least(start + size - 1, total).alias("last"),
        F.when(start + size <= total, start + size).alias("next_start"),
        F.when(start > 1, F.greatest(start - size, F.lit(1))).alias("prev_start"),
    )


def aligned_start(start: Column, size: int = 10) -> Column:
    """The first rank of the page of that size that holds start."""
    return (F.floor((start - 1) / size) * size + 1).cast("int")


def page_starts(first: Column, count: Column, size: int = 10) -> Column:
    """The starts of all pages that cover count ranks from first on."""
    return F.sequence(aligned_start(first, size), aligned_start(first + count - 1, size), F.lit(size))


def covered(results: DataFrame, key: str, start: int, count: int) -> DataFrame:
    """key, complete: whether each rank from start on is there; a start below 1 never is."""
    n = F.count_distinct(F.when(F.col("pos").between(start, start + count - 1), F.col("pos")))
    return results.groupBy(key).agg(((n == count) & F.lit(start >= 1)).alias("complete"))


def merged_pages(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Both, the new row where both have a key."""
    return new.unionByName(old.join(new.select(*key).distinct(), list(key), "left_anti"))


def first_tier(short: DataFrame, long: DataFrame, key: str) -> DataFrame:
    """Rows of the short-term tier, and those of the long-term one whose key it has not, with their tier."""
    rest = long.join(short.select(key), key, "left_anti").select(*short.columns)
    return short.withColumn("tier", F.lit("short")).unionByName(rest.withColumn("tier", F.lit("long")))
