"""Windows over a user's rows in time, in two levels: a user with most of the rows is spread over many tasks.

The rows are sorted into ranges of (user, order); a window works inside a user's part of a range, and what it needs of the ranges before
or after comes from a table with a row for each user and range. Rows go to ranges once, in a written step. The order must tell a user's rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from adaptlm.operators.events import seconds
from adaptlm.sources.tables import checkpointed


def ranged(rows: DataFrame, user: str, *order: str, ranges: int | None = None) -> DataFrame:
    """rows with _range, which rises with (user, order); by default as many as Spark makes of them."""
    some = rows.repartitionByRange(user, *order) if ranges is None else rows.repartitionByRange(ranges, user, *order)
    return checkpointed(some.withColumn("_range", F.spark_partition_id()))


def _inside(user: str, order: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(user, "_range").orderBy(*order)


def _edges(rows: DataFrame, user: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """user, _range, _before, _after: the value of the user's last row of the ranges before and of the first of those after, as structs with value v."""
    ends = rows.groupBy(user, "_range").agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_first"), F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    w = Window.partitionBy(user).orderBy("_range")  # a row for each range that the user is in
    return ends.select(user, "_range", F.lag("_last").over(w).alias("_before"), F.lead("_first").over(w).alias("_after"))


def linked(rows: DataFrame, user: str, item: str, *order: str, ranges: int | None = None) -> DataFrame:
    """As events.linked(): rows with the item before and after in the user's order."""
    r = ranged(rows, user, *order, ranges=ranges)
    w, boxed = _inside(user, order), F.struct(F.col(item).alias("v"))
    r = r.join(_edges(r, user, item, order), [user, "_range"])
    return r.withColumns({"prev": F.coalesce(F.lag(boxed).over(w), "_before")["v"], "next": F.coalesce(F.lead(boxed).over(w), "_after")["v"]}).drop("_before", "_after", "_range")


def _numbered(rows: DataFrame, user: str, ts: str, order: tuple[str, ...], starts: Column, ranges: int | None) -> DataFrame:
    """rows with run, how many rows of the user up to each one start a run; starts sees the time of the user's row before as _last."""
    order = (ts, *order)
    r = ranged(rows, user, *order, ranges=ranges)
    w = _inside(user, order)
    r = r.join(_edges(r, user, ts, order).drop("_after"), [user, "_range"]).withColumn("_last", F.coalesce(F.lag(F.struct(F.col(ts).alias("v"))).over(w), "_before")["v"])
    r = r.withColumn("_new", starts.cast("long"))
    sums = r.groupBy(user, "_range").agg(F.sum("_new").alias("_sum"))
    before = Window.partitionBy(user).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(user, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    here = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return r.withColumn("run", here).join(sums, [user, "_range"]).withColumn("run", F.col("run") + F.col("_base")).drop("_new", "_base", "_last", "_before", "_range")


def gap_runs(rows: DataFrame, user: str, ts: str, gap_s: int, *order: str, ranges: int | None = None) -> DataFrame:
    """As events.gap_runs(): rows with run, a number that rises after each gap above the limit."""
    return _numbered(rows, user, ts, order, F.coalesce(seconds(ts) - seconds("_last") > gap_s, F.lit(True)), ranges)


def forced_runs(rows: DataFrame, marks: DataFrame, user: str, ts: str, gap_s: int, *order: str, ranges: int | None = None) -> DataFrame:
    """As events.forced_runs(): a new run also at the first row after a forced end (marks: user, ended, one a user)."""
    cut = F.coalesce((F.col(ts) > F.col("ended")) & (F.col("ended") > F.col("_last")), F.lit(False))
    return _numbered(rows.join(marks, user, "left"), user, ts, order, F.coalesce(seconds(ts) - seconds("_last") > gap_s, F.lit(True)) | cut, ranges).drop("ended")


def session_windows(rows: DataFrame, user: str, ts: str, gap_s: int, *order: str, ranges: int | None = None) -> DataFrame:
    """As events.session_windows() on a table: user, first, last, n of the runs; counted inside the ranges before anything is shuffled."""
    runs = gap_runs(rows, user, ts, gap_s, *order, ranges=ranges)
    return runs.groupBy(user, "run").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")
