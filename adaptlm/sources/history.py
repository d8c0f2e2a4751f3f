"""A user history as tables in a folder: searches, results, events, attributes and topics.

Rows are added in units, and a unit counts in all its tables or in none: what a unit has written is published by one manifest (see
Store). A job that is killed in between leaves the old state whole; one that is run again under the same name adds nothing; of two
writers of one unit the first counts. Nothing is rewritten in place: session ids and topics hold as the last unit says that names the search or user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adaptlm.functions.codecs import decode_event, decode_model, encode_model
from adaptlm.operators.events import expired, known, orphans
from adaptlm.sources.store import Store

#: Columns of the tables; attributes hold encoded models under the name model. A row of topic_users says that a unit replaces all topics of the user.
TABLES = {
    "searches": "search_id string, user_id string, session_id string, query string, ts timestamp_ntz",
    "results": "search_id string, pos int, title string, summary string, url string",
    "events": "event_id long, search_id string, user_id string, type string, value string, ts timestamp_ntz",
    "attributes": "search_id string, name string, value string",
    "topics": "topic_id long, name string, value string, user_id string",
    "topic_searches": "topic_id long, search_id string, weight double, user_id string",
    "topic_attrs": "topic_id long, name string, value string, user_id string",
    "topic_users": "user_id string",
}
OF_TOPICS = ("topics", "topic_searches", "topic_attrs")


class History:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def has(self, name: str) -> bool:
        """Whether a table is there."""
        return name in self.store.state()[1]["parts"]

    def create(self) -> None:
        """Make the tables that are not there, empty."""
        self.store.commit(lambda state, _: None if set(TABLES) <= set(state["parts"]) else state | {"parts": {n: [] for n in TABLES} | state["parts"]})

    def _at(self, name: str, state: dict | None = None) -> DataFrame:
        return self.store.table(name, TABLES[name], state)

    def table(self, name: str) -> DataFrame:
        """Rows of committed units at one version; searches with the session ids set last, topics as their users have them now."""
        state = self.store.state()[1]
        rows = self._at(name, state)
        if name in OF_TOPICS:
            now = self._at("topic_users", state).groupBy("user_id").agg(F.max("_turn").alias("_now"))
            return rows.join(now, "user_id").where("_turn = _now").select(*rows.drop("_turn").columns)
        if name != "searches":
            return rows.drop("_turn")
        ids = self._at("attributes", state).where("name = 'session'").groupBy("search_id").agg(F.max_by("value", "_turn").alias("_now"))
        return rows.join(ids, "search_id", "left").withColumn("session_id", F.coalesce("_now", "session_id")).select(*rows.drop("_turn").columns)

    def append(self, unit: str, **tables: DataFrame) -> bool:
        """Add rows to tables as one unit; false if the unit is there already."""
        return self.store.add(unit, **{name: rows.select(*(c.split()[0] for c in TABLES[name].split(", "))) for name, rows in tables.items()}) is not None

    def users(self) -> DataFrame:
        """user_id of all users."""
        return self.table("searches").select("user_id").distinct()

    def with_user(self, rows: DataFrame) -> DataFrame:
        """Rows (search_id) with the user of their search; rows of unknown searches go."""
        return rows.join(self.table("searches").select("search_id", "user_id"), "search_id")

    def models(self) -> tuple[DataFrame, DataFrame]:
        """(search_id, term, prob) of the saved models, and the rows whose search is unknown."""
        rows = self.table("attributes").where("name = 'model'")
        searches = self.table("searches")
        return decode_model(known(rows, searches), "search_id"), orphans(rows, searches)

    def events(self) -> tuple[DataFrame, DataFrame]:
        """Decoded events, and the rows whose search is unknown."""
        rows, searches = self.table("events"), self.table("searches")
        decoded = known(rows, searches).withColumn("_e", decode_event(F.col("type"), F.col("value")))
        return decoded.select("event_id", "search_id", "user_id", "type", "ts", "_e.*"), orphans(rows, searches)

    def save_models(self, unit: str, models: DataFrame, now, final: bool = False) -> None:
        """Append the models (search_id, term, prob) of expired searches (of all, if final) that have none saved yet."""
        last = self.table("searches").select("search_id", "ts").unionByName(self.table("events").select("search_id", "ts")).groupBy("search_id").agg(F.max("ts").alias("last"))
        done = self.table("attributes").where("name = 'model'").select("search_id")
        over = last.where(F.lit(final) | expired(F.col("last"), F.lit(now).cast("timestamp_ntz"), F.lit(False))).join(done, "search_id", "left_anti")
        rows = encode_model(models.join(over, "search_id", "left_semi"), "search_id").select("search_id", F.lit("model").alias("name"), "value")
        self.append(unit, attributes=rows)

    def set_sessions(self, unit: str, sessions: DataFrame) -> None:
        """Give searches (search_id, session_id) new session ids; the latest of all units holds."""
        changed = sessions.join(self.table("searches").select("search_id", F.col("session_id").alias("_old")), "search_id").where(~F.col("session_id").eqNullSafe(F.col("_old")))
        self.append(unit, attributes=changed.select("search_id", F.lit("session").alias("name"), F.col("session_id").alias("value")))

    def replace_topics(self, unit: str, topics: DataFrame, members: DataFrame, stats: DataFrame, users: DataFrame | None = None, attrs: DataFrame | None = None, least: int = 3) -> bool:
        """As one unit, put topics (topic_id, name, value, user_id), their searches (topic_id, search_id, weight, user_id) and their attributes (as topics) in place of all that their users had.

        Only topics with enough sessions (stats: topic_id, sessions) stay. users (user_id): whose topics are replaced, by default all that are named by
        a topic, trivial or not; one without a topic that stays has none afterwards.
        """
        users = topics.select("user_id").unionByName(members.select("user_id")) if users is None else users.select("user_id")
        good = stats.where(F.col("sessions") >= least).select("topic_id").distinct()
        tables = {"topics": topics, "topic_searches": members} | ({} if attrs is None else {"topic_attrs": attrs})
        return self.append(unit, topic_users=users.distinct(), **{name: rows.join(good, "topic_id", "left_semi").join(users.distinct(), "user_id", "left_semi") for name, rows in tables.items()})

    def topics(self, user: str) -> DataFrame:
        """topic_id, name, value, search_id, weight of a user's topics."""
        mine = lambda n: self.table(n).where(F.col("user_id") == user).drop("user_id")
        return mine("topics").join(mine("topic_searches"), "topic_id")

    def compact(self) -> None:
        """Write each table as one part; rows of topics that were replaced go."""
        state = self.store.state()[1]
        now = self._at("topic_users", state).groupBy("user_id").agg(F.max("_turn").alias("_now"))
        left = lambda name, rows: rows.join(now, "user_id").where("_turn = _now").drop("_now") if name in (*OF_TOPICS, "topic_users") else rows
        self.store.compact(TABLES, left)


def import_log(history: History, unit: str, searches: DataFrame, results: DataFrame, events: DataFrame, models: DataFrame) -> None:
    """Imported searches with their results, events and models (search_id, term, prob) as one unit."""
    attributes = encode_model(models, "search_id").select("search_id", F.lit("model").alias("name"), "value")
    history.append(unit, searches=searches, results=results, events=events, attributes=attributes)
