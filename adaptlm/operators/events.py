"""User events: first occurrences, last writes, activity, neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str | Column) -> Column:
    """Whole seconds since the epoch of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def unique_first(events: DataFrame, key: str, item: str, *order: str) -> DataFrame:
    """key, item, seq: distinct items by their first occurrence."""
    first = events.groupBy(key, item).agg(F.min(F.struct(*order)).alias("_f"))
    return first.select(key, item, F.row_number().over(Window.partitionBy(key).orderBy("_f", item)).alias("seq"))


def last_write(events: DataFrame, key: list[str], value: str, *order: str) -> DataFrame:
    """key, value of the last event; an empty last value deletes."""
    return events.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value)).where(F.col(value) != "")


def last_start(events: DataFrame, key: str) -> DataFrame:
    """key, start_pos of the last view event."""
    return events.where("type = 'view'").groupBy(key).agg(F.max_by("start_pos", F.struct("ts", "event_id")).alias("start_pos"))


def expired(last_event: Column, now: Column, in_history: Column, limit_s: int = 1800) -> Column:
    """Whether a search is over: from history, or without events for the limit; an unknown one is not."""
    return F.when(last_event.isNull(), False).otherwise(in_history | (seconds(now) - seconds(last_event) >= limit_s))


def viewed_prefix(results: DataFrame, clicks: DataFrame, key: str) -> DataFrame:
    """Results at or above the lowest clicked rank."""
    lowest = clicks.groupBy(key).agg(F.max("pos").alias("_m"))
    return results.join(lowest, key).where("pos <= _m").drop("_m")


def linked(rows: DataFrame, user: str, item: str, *order: str) -> DataFrame:
    """rows with the item before and after in the user's order."""
    w = Window.partitionBy(user).orderBy(*order)
    return rows.withColumns({"prev": F.lag(item).over(w), "next": F.lead(item).over(w)})


def after_mark(events: DataFrame, saved: DataFrame, key: str, id_column: str = "event_id") -> DataFrame:
    """Events with an id above the largest saved one of their key."""
    mark = saved.groupBy(key).agg(F.max(id_column).alias("_m"))
    return events.join(mark, key, "left").where(F.col("_m").isNull() | (F.col(id_column) > F.col("_m"))).drop("_m")


def unsaved(results: DataFrame, viewed: DataFrame, saved: DataFrame, most: int = 10) -> DataFrame:
    """key columns search_id, pos of the first results and the viewed ones that are not saved."""
    wanted = results.where(F.col("pos") <= most).select("search_id", "pos").union(viewed.select("search_id", "pos")).distinct()
    return wanted.join(saved.select("search_id", "pos"), ["search_id", "pos"], "left_anti")


def anchored_neighbourhood(rows: DataFrame, user: str, item: str, ts: str, gap_s: int = 1800) -> DataFrame:
    """anchor, item: rows of the user whose time differs from the anchor's by the limit at most.

    Bucketed by the limit, so each row meets only those of its own and the two next buckets.
    """
    r = rows.select(user, F.col(item), seconds(ts).alias("_t")).withColumn("_b", F.floor(F.col("_t") / gap_s))
    a = r.select(user, F.col(item).alias("anchor"), F.col("_t").alias("_at"), F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
    return a.join(r, [user, "_b"]).where(F.abs(F.col("_t") - F.col("_at")) <= gap_s).select(user, "anchor", item)


def time_based_session(searches: DataFrame, user: str, item: str, created: str, last: str, ended: str | None = None, gap_s: int = 1800) -> DataFrame:
    """anchor, item: the searches around each one, as far as no gap lies between.

    Forward a search is in while it was created within gap_s of the anchor's last event. Backward one is
    in while its own last event is within gap_s of the anchor's creation; the first that is not ends the
    walk. A forced end (column ended) that lies between anchor and search ends it too. Pairs are made by time
    buckets, so a search meets only those whose activity touches its own.
    """
    place = F.row_number().over(Window.partitionBy(user).orderBy(created, item))
    r = searches.select(F.col(user).alias("_u"), F.col(item).alias("_i"), seconds(created).alias("_c"), F.greatest(seconds(last), seconds(created)).alias("_l"), (seconds(ended) if ended else F.lit(None).cast("long")).alias("_e"), place.alias("_n"))
    r = r.withColumn("_e", F.max("_e").over(Window.partitionBy("_u")))
    bucket = lambda t: F.floor(t / max(gap_s, 1))
    # a search reaches from its creation to its last event and the gap: who is created there may be joined to it
    early = r.select("_u", F.col("_i").alias("_i0"), F.col("_c").alias("_c0"), F.col("_l").alias("_l0"), F.col("_n").alias("_n0"), F.explode(F.sequence(bucket(F.col("_c")), bucket(F.col("_l") + gap_s))).alias("_b"))
    late = r.withColumn("_b", bucket(F.col("_c")))
    forced = F.coalesce((F.col("_c") > F.col("_e")) & (F.col("_e") > F.col("_c0")), F.lit(False))
    pairs = early.join(late, ["_u", "_b"]).where((F.col("_n") > F.col("_n0")) & (F.col("_c") - F.col("_l0") <= gap_s) & ~forced)
    forward = pairs.select(F.col("_u").alias(user), F.col("_i0").alias("anchor"), F.col("_i").alias(item))
    near = F.row_number().over(Window.partitionBy("_u", "_i").orderBy(F.desc("_n0")))
    backward = pairs.withColumn("_k", near).where(F.col("_n") - F.col("_n0") == F.col("_k")).select(F.col("_u").alias(user), F.col("_i").alias("anchor"), F.col("_i0").alias(item))
    own = r.select(F.col("_u").alias(user), F.col("_i").alias("anchor"), F.col("_i").alias(item))
    return own.unionByName(forward).unionByName(backward)


def known(rows: DataFrame, searches: DataFrame, key: str = "search_id") -> DataFrame:
    """Rows (events, models) of searches that exist."""
    return rows.join(searches.select(key), key, "left_semi")


def orphans(rows: DataFrame, searches: DataFrame, key: str = "search_id") -> DataFrame:
    """Rows that known() drops."""
    return rows.join(searches.select(key), key, "left_anti")


def with_results(clicks: DataFrame, results: DataFrame) -> DataFrame:
    """Clicks (search_id, pos) with url and title of the result at that place, null without one."""
    return clicks.join(results.select("search_id", "pos", "url", "title"), ["search_id", "pos"], "left")


def in_order(events: DataFrame, user: str, ts: str, *arrival: str) -> DataFrame:
    """Events with seq, their number in the user's order of time; equal times in order of arrival, so late ones stand after those."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(user).orderBy(ts, *arrival)))


def reverse_page(rows: DataFrame, user: str, ts: str, *order: str, start: int = 1, size: int = 10) -> DataFrame:
    """rank and the rows of a page of the user's rows, the latest first."""
    w = Window.partitionBy(user).orderBy(F.desc(ts), *(F.desc(c) for c in order))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank").between(start, start + size - 1))


def gap_runs(rows: DataFrame, user: str, ts: str, gap_s: int, *order: str) -> DataFrame:
    """rows with run: a number that rises after each gap above the limit; an equal gap joins."""
    w = Window.partitionBy(user).orderBy(ts, *order)
    far = F.coalesce(seconds(ts) - seconds(F.lag(ts).over(w)) > gap_s, F.lit(True))
    return rows.withColumn("_new", far.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def forced_runs(rows: DataFrame, marks: DataFrame, user: str, ts: str, gap_s: int, *order: str) -> DataFrame:
    """As gap_runs(), with a new run also at the first row after a forced end (marks: user, ended)."""
    w = Window.partitionBy(user).orderBy(ts, *order)
    r = rows.join(marks, user, "left").withColumn("_last", F.lag(ts).over(w))
    cut = F.col("_last").isNull() | (seconds(ts) - seconds(F.col("_last")) > gap_s) | F.coalesce((F.col(ts) > F.col("ended")) & (F.col("ended") > F.col("_last")), F.lit(False))
    return r.withColumn("_new", cut.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new", "_last", "ended")


def session_windows(events: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """user, first, last, n of windows that a gap above the given one ends; also on streams."""
    return events.groupBy(user, F.session_window(ts, gap)).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).drop("session_window")


def date_headers(rows: DataFrame, user: str, ts: str, *order: str) -> DataFrame:
    """rows with shown: the date where it differs from that of the row before, else null."""
    w = Window.partitionBy(user).orderBy(ts, *order)
    day = F.to_date(ts)
    return rows.withColumn("shown", F.when(~day.eqNullSafe(F.lag(day).over(w)), day))
