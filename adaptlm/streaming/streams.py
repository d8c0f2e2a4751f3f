"""Structured Streaming forms: deduplicated document streams, sessions, live recommendation, incremental saving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adaptlm.functions.text import document_text
from adaptlm.operators.events import session_windows
from adaptlm.operators.lm import term_counts
from adaptlm.operators.recommend import recommend
from adaptlm.operators.sessions import assign_sessions
from adaptlm.sources.connectors import DocumentProducer


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def unique_documents(stream: DataFrame, key: str = "doc_id", ts: str | None = None, lateness: str = "1 day") -> DataFrame:
    """The first row of each key; with a time column the state is bounded by the watermark."""
    return stream.dropDuplicates([key]) if ts is None else stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, user: str, ts: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of a stream; one is given out when the watermark passes its end."""

    return session_windows(stream.withWatermark(ts, lateness), user, ts, gap)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Hand each micro-batch to a function of (batch, number), such as a batch operator and a sink; offsets are kept in checkpoint."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append what is available to a Parquet table, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def recommendations(stream: DataFrame, topics: DataFrame, probs: DataFrame, default: DataFrame, path: str, checkpoint: str, title: str = "title", summary: str = "summary") -> StreamingQuery:
    """Append doc_id, topic, sim, recommended of a document stream (doc_id, title, summary) to a table. Each micro-batch runs the batch operator, as a document's model needs sorted terms; a batch that is run again writes its folder anew."""

    def each(batch: DataFrame, number: int) -> None:
        counts = term_counts(batch.select("doc_id", document_text(F.col(title), F.col(summary)).alias("text")), "doc_id")
        recommend(counts, topics, probs, default, "doc_id", "topic").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run_batches(stream, each, checkpoint)


def event_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append events as they come, however late, with the time of their arrival; readers order them by in_order(ts, arrived)."""
    return to_table(stream.withColumn("arrived", F.current_timestamp()), path, checkpoint)


def online_sessions(stream: DataFrame, state_path: str, links: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Keep the session of every search (search_id, user_id, ts) of a stream: state_path/<number> is the state after that micro-batch.

    links gives a, b of alike searches near in time, from the state so far and the new ones. A batch that is run again starts from the same state.
    """
    schema = "search_id long, user_id long, session_id string, ts long"

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(schema).parquet(f"{state_path}/{number - 1}") if number else spark.createDataFrame([], schema)
        fresh = batch.select("search_id", "user_id", "ts").dropDuplicates(["search_id"]).join(old.select("search_id"), "search_id", "left_anti")
        assign_sessions(old, fresh, links(old, fresh)).write.mode("overwrite").parquet(f"{state_path}/{number}")

    return run_batches(stream, each, checkpoint)


def expiring(stream: DataFrame, key: str, ts: str, limit: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """key and the time of its last event, given out when the watermark says that none came for the limit; a later event starts anew."""
    ended = stream.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, limit)).agg(F.max(ts).alias("last"))
    return ended.select(key, "last")


class IndexState:
    """Whether an index still holds: touched by new events, rebuilt on demand or by force."""

    def __init__(self, build: Callable[[], DataFrame]):
        self.build, self.outdated, self.index = build, True, None

    def touch(self) -> None:
        self.outdated = True

    def get(self, force: bool = False) -> DataFrame:
        if self.outdated or force or self.index is None:
            self.index, self.outdated = self.build(), False
        return self.index


class StreamRegistry:
    """Named streams, and the producers that some of them come from."""

    def __init__(self) -> None:
        self.streams: dict[str, DataFrame] = {}

    def add(self, name: str, stream: DataFrame) -> None:
        self.streams.setdefault(name, stream)

    def produce(self, spark: SparkSession, name: str, producer: type[DocumentProducer], **options: object) -> None:
        """Add the stream of a producer's documents; the producer becomes a data source of the session."""
        spark.dataSource.register(producer)
        self.add(name, spark.readStream.format(producer.name()).options(**{k: str(v) for k, v in options.items()}).load())

    def get(self, name: str) -> DataFrame | None:
        return self.streams.get(name)

    def names(self) -> list[str]:
        """All streams, in the order they were added."""
        return list(self.streams)
