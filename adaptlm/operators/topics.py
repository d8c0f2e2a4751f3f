"""Interest topics: average-link clusters of searches, their statistics and best terms."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adaptlm.config import Settings
from adaptlm.operators.lm import normalised
from adaptlm.operators.sessions import min_labels
from adaptlm.sources.tables import checkpointed

DEFAULTS = Settings()
#: Pairs of a group that one task clusters (about 200 bytes each in its heap and maps).
LOCAL_PAIRS = 500_000
#: Items and pairs that a task clusters, about; rows of a batch of its results, about.
TASK_ROWS, OUT_ROWS = 20_000, 10_000


def average_link(pairs: list[tuple[int, int, float]], items: list[int], stop: float = 0.1, least: float = 0.01, sizes: dict[int, int] | None = None) -> dict[int, int]:
    """item -> smallest item of its cluster.

    The likest two clusters merge while they reach stop (ties: smallest ids); the
    likeness to a merged cluster is the mean by size (an item counts as sizes says, else as one), missing ones count as 0 and those below least are dropped.
    """
    near: dict[int, dict[int, float]] = {i: {} for i in items}
    for a, b, s in pairs:
        near[a][b] = near[b][a] = s
    size, members, alive = {i: (sizes or {}).get(i, 1) for i in items}, {i: [i] for i in items}, set(items)
    heap = [(-s, min(a, b), max(a, b)) for a, b, s in pairs if s >= stop]
    heapq.heapify(heap)
    while heap:
        s, a, b = heapq.heappop(heap)
        if a not in alive or b not in alive or near[a].get(b) != -s:
            continue
        alive.discard(b)
        na, nb = size[a], size[b]
        merged = {}
        for c in (near[a].keys() | near[b].keys()) - {a, b}:
            v = (na * near[a].get(c, 0.0) + nb * near[b].get(c, 0.0)) / (na + nb)
            near[c].pop(a, None), near[c].pop(b, None)
            if v >= least:
                merged[c] = near[c][a] = v
                if v >= stop:
                    heapq.heappush(heap, (-v, min(a, c), max(a, c)))
        near[a], size[a] = merged, na + nb
        members[a] += members.pop(b)
        del near[b]
    return {i: min(m) for m in members.values() for i in m}


def _heap_clusters(pairs: DataFrame, items: DataFrame, group: str, stop: float, least: float) -> DataFrame:
    """group, item, cluster by average_link(), a group in one task.

    Rows are dealt to a number of tasks that grows with them, as few bytes may be much work; a task reads one group after another.
    """
    rows = items.select(group, F.col("item").alias("a"), F.lit(None).cast("long").alias("b"), F.col("size").alias("sim")).unionByName(pairs.select(group, "a", "b", "sim"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind = [group, "item", "cluster"], None
        out: tuple[list, list, list] = ([], [], [])
        now, linked, sizes = None, [], {}

        def settle() -> None:
            found = average_link(linked, sorted(sizes.keys() | {x for p in linked for x in p[:2]}), stop, least, sizes=sizes)
            out[0].extend([now] * len(found)), out[1].extend(found), out[2].extend(found.values())

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for g, a, b, s in zip(*(c.to_pylist() for c in batch.columns)):
                if g != now and (linked or sizes):
                    settle()
                    linked, sizes = [], {}
                    if len(out[0]) >= OUT_ROWS:
                        yield batch_of()
                        out = ([], [], [])
                now = g
                if b is None:
                    sizes[a] = int(s)
                else:
                    linked.append((a, b, s))
        if linked or sizes:
            settle()
            yield batch_of()

    return rows.repartition(tasks, group).sortWithinPartitions(group).mapInArrow(run, f"{group} {dict(items.dtypes)[group]}, item long, cluster long")


def _next_merges(edges: DataFrame, group: str, stop: float) -> DataFrame:
    """group, a, b, na, nb: the edges (group, a, b, sim, na, nb) that come before all others of their ends and of their ends' neighbours.

    An edge of at least stop comes before those of less sim and, of one sim, before those of larger ids. No two of these edges have ends
    that are neighbours, so merging them all at once is what merging one by one, the first first, would do here.
    """
    turn = F.when(F.col("sim") >= stop, F.struct((-F.col("sim")).alias("far"), "a", "b", "na", "nb"))
    ends = edges.select(group, F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("_e"), turn.alias("_turn")).select(group, "_e.x", "_e.y", "_turn")
    best = ends.groupBy(group, "x").agg(F.min("_turn").alias("_best")).where("_best IS NOT NULL")
    around = ends.select(group, "x", "y").join(best.withColumnRenamed("x", "y"), [group, "y"]).groupBy(group, "x").agg(F.min("_best").alias("_first"))
    both = around.where("x = _first.a OR x = _first.b").groupBy(group, "_first").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2")
    return both.select(group, "_first.a", "_first.b", "_first.na", "_first.nb")


def _merged_edges(edges: DataFrame, merges: DataFrame, group: str, least: float) -> DataFrame:
    """The edges after merges: the sim to a merged cluster is the mean by size, a missing edge counts as 0, and what is below least goes."""
    to = merges.select(group, F.explode(F.array(F.struct(F.col("a").alias("_old"), F.col("na").alias("_part")), F.struct(F.col("b").alias("_old"), F.col("nb").alias("_part")))).alias("_m"), F.col("a").alias("_new"), (F.col("na") + F.col("nb")).alias("_size")).select(group, "_m.*", "_new", "_size")
    end = lambda at: to.select(group, *(F.col(c).alias(f"{c}_{at}") for c in ("_old", "_part", "_new", "_size"))).withColumnRenamed(f"_old_{at}", at)
    moved = edges.join(end("a"), [group, "a"], "left").join(end("b"), [group, "b"], "left")
    same = moved.where("_new_a IS NULL AND _new_b IS NULL").select(*edges.columns)
    x, y = F.coalesce("_new_a", "a"), F.coalesce("_new_b", "b")
    # an edge has one end in a merge at most, but for the edges that are merged, whose ends become one
    touched = moved.where("_new_a IS NOT NULL OR _new_b IS NOT NULL").select(
        group, F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (F.col("sim") * F.coalesce("_part_a", "_part_b")).alias("_s"), F.coalesce("_size_a", "_size_b").alias("_n"),
        F.when(x <= y, F.coalesce("_size_a", "na")).otherwise(F.coalesce("_size_b", "nb")).alias("na"), F.when(x <= y, F.coalesce("_size_b", "nb")).otherwise(F.coalesce("_size_a", "na")).alias("nb"),
    ).where("a < b")
    means = touched.groupBy(group, "a", "b", "na", "nb").agg((F.sum("_s") / F.max("_n")).alias("sim")).where(F.col("sim") >= least)
    return same.unionByName(means.select(*edges.columns))


def clusters(pairs: DataFrame, items: DataFrame, group: str, stop: float = DEFAULTS.stop_similarity, least: float = 0.01, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """group, item, cluster as average_link() has them; items (group, item, and size if it is above one), pairs (group, a, b, sim), each pair once.

    A group with at most local_pairs pairs is one task's work. The pairs of larger ones stay a table: each round merges, in all
    groups at once, the pairs that come before everything near them, until few enough pairs are left for one task or none reaches stop. The
    clusters do not depend on local_pairs.
    """
    size = F.col("size").cast("double") if "size" in items.columns else F.lit(1.0)
    items = items.select(group, "item", size.alias("size"))
    of_item = items.select(group, F.col("item").alias("_i"), F.col("size").alias("_z"))
    # read more than once below
    edges = checkpointed(pairs.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim"))
    counts = edges.groupBy(group).agg(F.count(F.lit(1)).alias("_pairs")).where(F.col("_pairs") > local_pairs)
    large = checkpointed(counts.select(group))
    if not large.take(1):
        return _heap_clusters(edges, items, group, stop, least)
    found = _heap_clusters(edges.join(large, group, "left_anti"), items.join(large, group, "left_anti"), group, stop, least)
    wide = edges.join(large, group, "left_semi")
    for at in ("a", "b"):
        wide = wide.join(of_item.withColumnsRenamed({"_i": at, "_z": f"n{at}"}), [group, at], "left").na.fill({f"n{at}": 1.0})
    wide = checkpointed(wide.select(group, "a", "b", "sim", "na", "nb"))
    nodes = items.join(large, group, "left_semi").select(group, "item").unionByName(wide.select(group, F.col("a").alias("item"))).unionByName(wide.select(group, F.col("b").alias("item"))).distinct()
    joined = None
    while wide.groupBy(group).count().where(F.col("count") > local_pairs).take(1):
        merges = checkpointed(_next_merges(wide, group, stop))
        if not merges.take(1):
            break
        joined = merges if joined is None else joined.unionByName(merges)
        wide = checkpointed(_merged_edges(wide, merges, group, least))
    node = lambda c: F.struct(F.col(group).alias("g"), F.col(c).alias("i"))
    if joined is None:
        roots = nodes.select(group, "item", F.col("item").alias("root"))
        sizes = items.join(large, group, "left_semi")
    else:
        labels = min_labels(nodes.select(node("item").alias("node")), joined.select(node("a").alias("a"), node("b").alias("b")))
        roots = checkpointed(labels.select(F.col("node.g").alias(group), F.col("node.i").alias("item"), F.col("root.i").alias("root")))
        sizes = roots.join(items, [group, "item"], "left").groupBy(group, F.col("root").alias("item")).agg(F.sum(F.coalesce("size", F.lit(1.0))).alias("size"))
    # a group of which no pair reaches stop any more needs no task
    open_groups = wide.where(F.col("sim") >= stop).select(group).distinct()
    rest = _heap_clusters(wide.join(open_groups, group, "left_semi"), sizes.join(open_groups, group, "left_semi"), group, stop, least)
    late = roots.join(rest.select(group, F.col("item").alias("root"), F.col("cluster").alias("_late")), [group, "root"], "left")
    return found.unionByName(late.select(group, "item", F.coalesce("_late", "root").alias("cluster")))


def group_models(models: DataFrame, members: DataFrame, item: str, group: str, normal: bool = False) -> DataFrame:
    """group, term, prob: the sum of the models (item, term, prob) of its members (item, group), normalised if asked for."""
    summed = members.select(item, group).join(models, item).groupBy(group, "term").agg(F.sum("prob").alias("prob"))
    return normalised(summed, group, "prob") if normal else summed


def topic_groups(searches: DataFrame, by_session: bool = True, by_query: bool = True) -> DataFrame:
    """search_id, group: the smallest search that is joined to it by the same session or the same query of a user. searches: search_id, user_id, session_id, query."""
    edges = []
    for use, column in ((by_session, "session_id"), (by_query, "query")):
        if use:
            first = F.min("search_id").over(Window.partitionBy("user_id", column))
            edges.append(searches.where(F.col(column).isNotNull()).select(F.col("search_id").alias("a"), first.alias("b")))
    if not edges:
        return searches.select("search_id", F.col("search_id").alias("group"))
    found = min_labels(searches.select(F.col("search_id").alias("node")), functools.reduce(DataFrame.unionByName, edges))
    return found.select(F.col("node").alias("search_id"), F.col("root").alias("group"))


def build_topics(searches: DataFrame, models: DataFrame, s: Settings = DEFAULTS, by_session: bool = True, by_query: bool = True) -> tuple[DataFrame, DataFrame]:
    """Topics of users: (user_id, search_id, topic) and (topic, term, prob), topics named by their smallest search.

    Searches (search_id, user_id, session_id, query) of one session or one query are a group from the start; a group's model is the sum of its
    searches' models (search_id, term, prob). Groups of a user whose cosine is above min_cosine are clustered by average link; a group counts as
    many searches as it has. A topic's model is the normalised sum of its searches' models.
    """
    grouped = checkpointed(topic_groups(searches, by_session, by_query).join(searches.select("search_id", "user_id"), "search_id"))
    summed = checkpointed(group_models(models, grouped, "search_id", "group").join(grouped.select("group", "user_id").distinct(), "group"))
    norm = summed.groupBy("group").agg(F.sqrt(F.sum(F.col("prob") * F.col("prob"))).alias("_n"))
    x = summed.select("user_id", "term", F.col("group").alias("a"), F.col("prob").alias("_a"))
    y = summed.select("user_id", "term", F.col("group").alias("b"), F.col("prob").alias("_b"))
    dots = x.join(y, ["user_id", "term"]).where("a < b").groupBy("user_id", "a", "b").agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot"))
    sims = dots.join(norm.select(F.col("group").alias("a"), F.col("_n").alias("_na")), "a").join(norm.select(F.col("group").alias("b"), F.col("_n").alias("_nb")), "b")
    sims = sims.select("user_id", "a", "b", (F.col("_dot") / (F.col("_na") * F.col("_nb"))).alias("sim")).where(F.col("sim") > s.min_cosine)
    sizes = grouped.groupBy("user_id", "group").agg(F.count(F.lit(1)).alias("size"))
    found = clusters(sims, sizes.select("user_id", F.col("group").alias("item"), "size"), "user_id", s.stop_similarity)
    members = checkpointed(grouped.join(found.select(F.col("item").alias("group"), F.col("cluster").alias("topic")), "group").select("user_id", "search_id", "topic"))
    return members, group_models(models, members, "search_id", "topic", normal=True)


def nontrivial(stats: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Topics that enough sessions have."""
    return stats.where(F.col("sessions") >= s.topic_sessions)


def listed(stats: DataFrame, criterion: str, topic: str = "topic", user: str | None = None) -> DataFrame:
    """Topics with score and rank by a criterion, the highest first, ties by topic; ranks of each user's topics where the user column is named, else of all."""
    scored = stats.withColumn("score", sorting_score(F.lit(criterion)))
    order = [F.desc("score"), F.asc(topic)]
    if user:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(*order)))
    # a rank over all: the ranges of a sort are counted first, so no task holds more than one of them
    ranges = scored.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    ranges = checkpointed(ranges)
    before = ranges.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranges.join(before, "_p").withColumn("rank", (inside + F.col("_before")).cast("int")).drop("_p", "_before")


def counted(members: DataFrame, topic: str, what: str) -> DataFrame:
    """topic, what, n, rank: how often a topic has each session, query or clicked address, the most frequent first."""
    n = members.where(F.col(what).isNotNull()).groupBy(topic, what).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("n"), what)))


def topic_stats(members: DataFrame, topic: str) -> DataFrame:
    """sessions, total and distinct queries and clicks of each topic; members: topic, session_id, query, clicked_url (null without a click)."""
    return members.groupBy(topic).agg(
        F.count_distinct("session_id").alias("sessions"), F.count("query").alias("queries"), F.count_distinct("query").alias("unique_queries"),
        F.count("clicked_url").alias("clicks"), F.count_distinct("clicked_url").alias("unique_clicks"),
    )


def sorting_score(criterion: Column) -> Column:
    """The statistic that a criterion names; sessions by default."""
    return F.when(criterion == "query", F.col("queries")).when(criterion == "unique query", F.col("unique_queries")).when(criterion == "click", F.col("clicks")).when(criterion == "unique click", F.col("unique_clicks")).otherwise(F.col("sessions"))


def shown_terms(models: DataFrame, topic: str, most: int = 10, least: float = 0.01, mass: float = 0.9) -> DataFrame:
    """topic, place, term, shown: the best terms with three digits, and a row of dots where some were cut."""
    order = Window.partitionBy(topic).orderBy(F.desc("prob"), "term")
    before = F.coalesce(F.sum("prob").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    r = models.withColumns({"place": F.row_number().over(order), "_b": before, "_n": F.count(F.lit(1)).over(Window.partitionBy(topic))})
    kept = r.where((F.col("place") <= most) & (F.col("prob") >= least) & (F.col("_b") < mass))
    rows = kept.select(topic, "place", "term", F.format_string("%.3f", "prob").alias("shown"))
    cut = kept.groupBy(topic).agg(F.max("place").alias("place"), F.max("_n").alias("_n")).where("_n > place")
    return rows.unionByName(cut.select(topic, (F.col("place") + 1).alias("place"), F.lit("...").alias("term"), F.lit("").alias("shown")))
