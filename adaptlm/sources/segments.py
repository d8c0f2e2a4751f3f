"""An inverted index of a folder of Parquet files that grows with the folder: postings in segments, statistics as sums of deltas.

A refresh reads the files that are new or have changed and no others. Postings of files that went or changed are left out on
reading and their counts are taken off as negative deltas; a compaction drops them and merges small segments.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adaptlm.operators.lm import normalised, term_counts
from adaptlm.sources.store import Store
from adaptlm.sources.tables import shared_folder

#: Bytes of source files whose texts one task counts, about.
PART_BYTES = 4 << 20


def _file(path: Column, length: Column, changed: Column) -> Column:
    """The number of a file as it is now: another length or time is another file."""
    return F.xxhash64(F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/"), length, F.unix_micros(changed))


class InvertedIndex:
    """Term counts (key, term, tf) of the texts in a folder or file, kept in another folder."""

    def __init__(self, spark: SparkSession, source: str, folder: str, key: str = "doc_id", text: str = "text"):
        self.spark, self.source, self.key, self.text = spark, source, key, text
        self.store = Store(spark, folder)
        self.kind = dict(spark.read.parquet(source).dtypes)[key]
        self.schemas = {"postings": f"{key} {self.kind}, term string, tf long, file long, length long", "docs": f"{key} {self.kind}, file long, length long", "terms": "term string, count long", "files": "path string, file long", "gone": "file long"}

    def _files(self) -> DataFrame:
        """path, file of the source, listed by Spark; contents are not read."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.source)
        return found.select("path", "length", _file(F.col("path"), F.col("length"), F.col("modificationTime")).alias("file"))

    def refresh(self, few: int = 16) -> str:
        """Take in what has changed: "same", "built", or "changed". More than so many segments are merged."""
        mark = self._files().agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("file").cast("decimal(38,0)")).cast("string").alias("sum")).first()
        mark = {"n": mark["n"], "sum": mark["sum"]}
        number, state = self.store.state()
        if state.get("mark") == mark:
            return "same"
        listed, known = self._files(), self._alive("files", state)
        now = listed.drop("length")
        new = [r.path for r in now.join(known, "file", "left_anti").select("path").collect()] if number else None  # the names of what was added since
        lost = known.join(now, "file", "left_anti").select("file")
        parts: dict[str, DataFrame] = {}
        attempts = {}
        if new is None or new:
            whole = self.spark.read.parquet(self.source)
            rows = whole if new is None else self.spark.read.schema(whole.schema).parquet(*new)
            path = F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))")
            file = _file(path, F.col("_metadata.file_size"), F.col("_metadata.file_modification_time"))
            # texts are shuffled, which are smaller than their term counts; these are then made, and added up to lengths, where the text is
            size = listed.join(known, "file", "left_anti").agg(F.sum("length")).first()[0] or 0
            dealt = rows.select(F.struct(self.key, file.alias("file")).alias("_k"), self.text).repartition(max(self.spark.sparkContext.defaultParallelism, -(-size // PART_BYTES)), "_k")
            counts = term_counts(dealt, "_k", self.text).withColumn("length", F.sum("tf").over(Window.partitionBy("_k")))
            attempts["postings"] = self.store.write("postings", counts.select(f"_k.{self.key}", "term", "tf", "_k.file", "length"))
            fresh = self.store.table("postings", self.schemas["postings"], {"parts": {"postings": [[attempts["postings"], 0]]}})
            parts = {"terms": fresh.groupBy("term").agg(F.sum("tf").alias("count")), "docs": fresh.groupBy(self.key, "file").agg(F.sum("tf").alias("length")), "files": now.join(known, "file", "left_anti")}
        if number and lost.take(1):
            less = self._alive("postings", state).join(lost, "file", "left_semi").groupBy("term").agg((-F.sum("tf")).alias("count"))
            parts["terms"] = parts["terms"].unionByName(less) if "terms" in parts else less
            parts["gone"] = lost
        attempts |= {name: self.store.write(name, rows) for name, rows in parts.items()}
        for name, attempt in attempts.items():
            state["parts"].setdefault(name, []).append([attempt, number + 1])
        # whether a key is in several files, so that readers must add up
        state |= {"mark": mark, "overlap": mark["n"] > 1 and bool(self._alive("docs", state).groupBy(self.key).count().where("count > 1").take(1))}
        if self.store.commit(lambda _, turn: state if turn == number + 1 else None) is None:
            return self.refresh(few)  # another writer came first
        if len(state["parts"]["postings"]) > few:
            self.compact()
        return "changed" if number else "built"

    def _alive(self, table: str, state: dict) -> DataFrame:
        """The rows of a table without those of files that went after they were added."""
        rows = self.store.table(table, self.schemas[table], state)
        if not state["parts"].get("gone"):
            return rows.drop("_turn")
        gone = self.store.table("gone", self.schemas["gone"], state).groupBy("file").agg(F.max("_turn").alias("_went"))
        return rows.join(gone, "file", "left").where("_went IS NULL OR _turn > _went").select(*rows.drop("_turn").columns)

    def postings(self) -> DataFrame:
        """key, term, tf of the files as they were at the last refresh."""
        state = self.store.state()[1]
        rows = self._alive("postings", state).drop("file", "length")
        return rows.groupBy(self.key, "term").agg(F.sum("tf").alias("tf")) if state["overlap"] else rows

    def shares(self) -> DataFrame:
        """key, term, weight: the term's share of the key's tokens; not shuffled where no key is in several files."""
        state = self.store.state()[1]
        if state["overlap"]:
            return normalised(self.postings().withColumnRenamed("tf", "weight"), self.key)
        return self._alive("postings", state).select(self.key, "term", (F.col("tf") / F.col("length")).alias("weight"))

    def lengths(self) -> DataFrame:
        """key, length of the files as they were at the last refresh."""
        return self._alive("docs", self.store.state()[1]).groupBy(self.key).agg(F.sum("length").alias("length"))

    def terms(self, state: dict | None = None) -> DataFrame:
        """term, count: the sum of the deltas; terms that no file has any more are not there."""
        return self.store.table("terms", self.schemas["terms"], state).groupBy("term").agg(F.sum("count").alias("count")).where("count > 0")

    def compact(self) -> None:
        """Merge the segments into one without the rows of files that went."""
        number, state = self.store.state()
        whole = {name: self._alive(name, state) for name in ("postings", "docs", "files")} | {"terms": self.terms(state)}
        attempts = {name: self.store.write(name, rows) for name, rows in whole.items()}

        def change(old: dict, turn: int) -> dict | None:
            return None if turn != number + 1 else old | {"parts": {n: [[a, turn]] for n, a in attempts.items()}}

        self.store.commit(change)


_FOLDERS: dict[tuple[str, str, str, str], str] = {}


def index_of(spark: SparkSession, source: str, key: str = "doc_id", text: str = "text") -> InvertedIndex:
    """The refreshed index of a source in the session's shared folder. The folder goes with the session; the files are looked at in each call."""
    at = (spark.sparkContext.applicationId, source, key, text)
    if at not in _FOLDERS:
        path = f"{shared_folder(spark)}/adaptlm/index-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
        _FOLDERS[at] = path
    index = InvertedIndex(spark, source, _FOLDERS[at], key, text)
    index.refresh()
    return index


class HistoryIndex:
    """Models of searches (search_id, term, prob) in two tiers: long for expired searches, whose models stay as they were, short for the others, built anew at each refresh."""

    SCHEMA = "search_id string, term string, prob double"

    def __init__(self, spark: SparkSession, folder: str):
        self.store = Store(spark, folder)

    def refresh(self, models: DataFrame, expired: DataFrame) -> None:
        """Take in the models of now; searches in expired (search_id) that the long tier lacks move there, and both tiers change in one step."""
        models = models.select("search_id", "term", "prob")
        for _ in range(50):
            number, state = self.store.state()
            have = self.store.table("long", self.SCHEMA, state).select("search_id").distinct()
            over = expired.select("search_id").distinct()
            late = self.store.write("long", models.join(over, "search_id", "left_semi").join(have, "search_id", "left_anti"))
            soon = self.store.write("short", models.join(over, "search_id", "left_anti").join(have, "search_id", "left_anti"))

            def change(old: dict, turn: int, number: int = number, late: str = late, soon: str = soon) -> dict | None:
                if turn != number + 1:
                    return None
                old["parts"].setdefault("long", []).append([late, turn])
                old["parts"]["short"] = [[soon, turn]]
                return old

            if self.store.commit(change):
                return
        raise RuntimeError("other writers came first")

    def tier(self, name: str) -> DataFrame:
        """search_id, term, prob of the short or long tier."""
        return self.store.table(name, self.SCHEMA).drop("_turn")

    def models(self) -> DataFrame:
        """Both tiers at one version, with the tier."""
        state = self.store.state()[1]
        return self.store.table("short", self.SCHEMA, state).withColumn("tier", F.lit("short")).unionByName(self.store.table("long", self.SCHEMA, state).withColumn("tier", F.lit("long"))).drop("_turn")
