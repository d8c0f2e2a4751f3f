"""Sessions as connected components of searches that are near in time and alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adaptlm.config import Settings
from adaptlm.sources.tables import checkpointed

DEFAULTS = Settings()


def min_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root: the smallest node of each component; nodes (node), edges (a, b).

    Each round a label jumps to the smallest one near it and to that one's own, so
    rounds grow with the logarithm of a path's length; rounds are checkpointed.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpointed(nodes.select("node").distinct().withColumn("root", F.col("node")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        hop = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("j"), F.col("root").alias("far"))
        fresh = checkpointed(hop.join(jump, hop["root"] == jump["j"], "left").select("node", "old", F.least("root", "far").alias("root")))
        moved = fresh.where("root <> old").limit(1).count()
        labels = fresh.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError("labels did not settle")


def near_pairs(searches: DataFrame, ts: str, gap_s: int = DEFAULTS.session_gap_s, ended: str | None = None) -> DataFrame:
    """a, b (a < b) of one user's searches at most gap_s apart, by time buckets; a forced end (column ended) between them parts two.

    Made before any likeness is looked at, so terms that all users share bring no pairs together.
    """
    r = searches.select("search_id", "user_id", F.col(ts).alias("_t"), (F.col(ended) if ended else F.lit(None)).alias("_e")).withColumn("_b", F.floor(F.col("_t") / max(gap_s, 1)))
    x = r.select("user_id", F.col("search_id").alias("a"), F.col("_t").alias("_ta"), "_e", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
    y = r.select("user_id", F.col("search_id").alias("b"), F.col("_t").alias("_tb"), "_b")
    low, high = F.least("_ta", "_tb"), F.greatest("_ta", "_tb")
    forced = F.coalesce((high > F.col("_e")) & (F.col("_e") > low), F.lit(False))
    return x.join(y, ["user_id", "_b"]).where((F.col("a") < F.col("b")) & (high - low <= gap_s) & ~forced).select("a", "b")


def pair_cosines(pairs: DataFrame, weights: DataFrame, key: str = "search_id", weight: str = "weight") -> DataFrame:
    """a, b, cosine of the given pairs that share a term. weights: key, term, weight."""
    w = weights.select(F.col(key).alias("_k"), "term", F.col(weight).alias("_w"))
    norm = w.groupBy("_k").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    left = pairs.join(w.select(F.col("_k").alias("a"), "term", F.col("_w").alias("_wa")), "a")
    dots = left.join(w.select(F.col("_k").alias("b"), "term", F.col("_w").alias("_wb")), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("_dot"))
    sized = dots.join(norm.select(F.col("_k").alias("a"), F.col("_n").alias("_na")), "a").join(norm.select(F.col("_k").alias("b"), F.col("_n").alias("_nb")), "b")
    return sized.where("_na > 0 and _nb > 0").select("a", "b", (F.col("_dot") / (F.col("_na") * F.col("_nb"))).alias("cosine"))


def assign_sessions(state: DataFrame, fresh: DataFrame, links: DataFrame) -> DataFrame:
    """The state after new searches: search_id, user_id, session_id, ts.

    state: the searches so far; fresh: new ones (search_id, user_id, ts), each a session of its own id at first; links: a, b of alike searches
    near in time. The sessions that a link joins become one, of the smallest id (as text), for all of their searches.
    """
    now = state.unionByName(fresh.select("search_id", "user_id", F.col("search_id").cast("string").alias("session_id"), "ts"))
    of = now.select(F.col("search_id").alias("_s"), "session_id")
    ends = links.join(of.withColumnsRenamed({"_s": "a", "session_id": "x"}), "a").join(of.withColumnsRenamed({"_s": "b", "session_id": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = min_labels(now.select(F.col("session_id").alias("node")), ends)
    return now.join(roots, now["session_id"] == roots["node"]).select("search_id", "user_id", F.col("root").alias("session_id"), "ts")


def session_view(sessions: DataFrame, time_based: DataFrame) -> DataFrame:
    """anchor, search_id, related: the searches of the anchor's session and those near it in time; related tells the former. sessions: search_id, session_id; time_based: anchor, search_id."""
    same = sessions.select(F.col("search_id").alias("anchor"), "session_id").join(sessions.select("search_id", "session_id"), "session_id").select("anchor", "search_id", F.lit(True).alias("related"))
    both = same.unionByName(time_based.select("anchor", "search_id", F.lit(False).alias("related")))
    return both.groupBy("anchor", "search_id").agg(F.max("related").alias("related"))
