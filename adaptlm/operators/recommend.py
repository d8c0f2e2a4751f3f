"""Documents that match topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adaptlm.config import Settings
from adaptlm.operators.lm import mixture_cosines

DEFAULTS = Settings()


def recommend(doc_counts: DataFrame, topics: DataFrame, probs: DataFrame, default: DataFrame, doc: str, topic: str, s: Settings = DEFAULTS) -> DataFrame:
    """doc, topic, sim, recommended: each document's likest topic (ties: smallest) and whether it passes the limit.

    A document is its term counts (doc, term, tf) without what the background explains; topics: topic, term, prob.
    """
    counts = doc_counts.select(doc, "term", F.col("tf").cast("double").alias("f"))
    sims = mixture_cosines(counts, topics, probs, default, doc, topic, s.background_share, weight="prob")
    best = sims.groupBy(doc).agg(F.min(F.struct((-F.round("cosine", 6)).alias("s"), F.col(topic).alias("t"))).alias("b"))
    return best.select(doc, F.col("b.t").alias(topic), (-F.col("b.s")).alias("sim"), (-F.col("b.s") > s.recommend_similarity).alias("recommended"))
