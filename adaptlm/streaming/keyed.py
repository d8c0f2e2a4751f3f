"""Stateful streams by user: sessions as searches come in any order, and rows held until a user pauses.

Both are processors of transformWithState, so only the state of users with new rows or due timers is read and
written. They need the RocksDB state store (see rocksdb()).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from adaptlm.config import Settings
from adaptlm.operators.sessions import min_labels

DEFAULTS = Settings()


def rocksdb(spark: SparkSession) -> None:
    """Keep the state of the session's streams in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _cosine(a: dict[str, float], b: dict[str, float]) -> float:
    if len(a) > len(b):
        a, b = b, a
    size = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b.get(t, 0.0) for t, v in a.items()) / size if size else 0.0


class _Sessions(StatefulProcessor):
    """The state of a user: the searches that later ones may still join, the forced ends among them, and the time of the next clean-up."""

    def __init__(self, gap_s: int, least: float):
        self.gap_s, self.least = gap_s, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.searches = handle.getMapState("searches", "search_id long", "ts long, session string, terms map<string,double>")
        self.ends = handle.getMapState("ends", "ts long", "there boolean")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = {k[0]: list(v) for k, v in self.searches.iterator()}
        ends = [k[0] for k in self.ends.keys()]
        fresh = {}
        for r in rows:
            if r.search_id is None:
                ends.append(r.ts)
                self.ends.updateValue((r.ts,), (True,))
            elif r.search_id not in known and r.search_id not in fresh:
                fresh[r.search_id] = [r.ts, str(r.search_id), dict(r.terms or {})]
        changed = set(fresh)
        for i in sorted(fresh):
            ts, _, terms = fresh[i]
            near = [s for s in known.values() if abs(s[0] - ts) <= self.gap_s and not any(min(s[0], ts) < e < max(s[0], ts) for e in ends) and round(_cosine(terms, s[2]), 12) >= self.least]
            names = {s[1] for s in near} | {str(i)}
            root = min(names)
            known[i] = fresh[i]
            for j, s in known.items():
                if s[1] in names and s[1] != root:
                    s[1] = root
                    changed.add(j)
            yield Row(search_id=i, session_id=str(i), root=root)
            yield from (Row(search_id=None, session_id=n, root=root) for n in names - {root, str(i)})
        for j in changed:
            self.searches.updateValue((j,), tuple(known[j]))
        self._plan(known, ends)

    def _plan(self, known: dict, ends: list) -> None:
        """One timer: when the oldest search can be joined no more."""
        times = [s[0] for s in known.values()] + ends
        if not times:
            return
        due = (min(times) + self.gap_s) * 1000 + 1
        if self.due.exists():
            if self.due.get()[0] == due:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(due)
        self.due.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        limit = timerValues.getCurrentWatermarkInMs()
        known = {k[0]: list(v) for k, v in self.searches.iterator()}
        ends = [k[0] for k in self.ends.keys()]
        for i in [i for i, s in known.items() if (s[0] + self.gap_s) * 1000 < limit]:
            self.searches.removeKey((i,))
            del known[i]
        for e in [e for e in ends if (e + self.gap_s) * 1000 < limit]:
            self.ends.removeKey((e,))
            ends.remove(e)
        self.due.clear()
        self._plan(known, ends)
        return iter(())


def session_log(stream: DataFrame, gap_s: int = DEFAULTS.session_gap_s, least: float = DEFAULTS.session_similarity, lateness: str = "10 minutes") -> DataFrame:
    """search_id, session_id, root of a stream of searches (user_id, search_id, ts, terms map<string,double>), as they come.

    A search begins as a session of its own name (its id as text). It joins the sessions of its user's searches that are at most gap_s seconds
    before or after it, whose terms' cosine, to twelve digits, reaches least, and that no forced end (a row with search_id null and the time of the end) parts
    from it; then all of them are one session, of the smallest name. Each row says which session a session is part of from now on: a search's
    own, or (search_id null) an earlier one. sessions_of() reads them together. Rows may come in any order within the
    lateness; what is later than the watermark is dropped. A search that comes again changes nothing. Forced ends part only searches that come with them or later.
    """
    rows = stream.select("user_id", "search_id", "ts", "terms", F.timestamp_seconds("ts").alias("_at")).withWatermark("_at", lateness)
    return rows.groupBy("user_id").transformWithState(statefulProcessor=_Sessions(gap_s, least), outputStructType="search_id long, session_id string, root string", outputMode="Append", timeMode="EventTime")


def sessions_of(log: DataFrame) -> DataFrame:
    """search_id, session_id now of all searches in a log of session_log()."""
    names = log.select(F.col("session_id").alias("node")).unionByName(log.select(F.col("root").alias("node")))
    roots = min_labels(names, log.select(F.col("session_id").alias("a"), F.col("root").alias("b")))
    own = log.where("search_id IS NOT NULL").select("search_id", F.col("session_id").alias("node")).distinct()
    return own.join(roots, "node").select("search_id", F.col("root").alias("session_id"))


class _Pause(StatefulProcessor):
    """The state of a user: the rows that wait, as JSON, and the time when they go."""

    def __init__(self, delay_ms: int, columns: list[str]):
        self.delay_ms, self.columns = delay_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row string")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.waiting.appendList([(r["_row"],) for r in rows])
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        due = timerValues.getCurrentProcessingTimeInMs() + self.delay_ms
        self.handle.registerTimer(due)
        self.due.update((due,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows = [r[0] for r in self.waiting.get()]
        self.waiting.clear()
        self.due.clear()
        for i, r in enumerate(rows):
            yield Row(_key=key[0], _row=r, place=i, held=len(rows))


def flushed_when_idle(stream: DataFrame, key: str, delay_ms: int = 1000) -> DataFrame:
    """The rows of a stream, each once, held until no row of their key has come for the delay; with place in its flush and held, how many rows that has.

    The timer is one of processing time: each new row of a key puts it off.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(F.col(key).alias("_key"), F.to_json(F.struct(*stream.columns)).alias("_row"))
    out = rows.groupBy("_key").transformWithState(statefulProcessor=_Pause(delay_ms, stream.columns), outputStructType=f"_key {kind}, _row string, place int, held int", outputMode="Append", timeMode="ProcessingTime")
    return out.select(F.from_json("_row", stream.schema).alias("_r"), "place", "held").select("_r.*", "place", "held")
