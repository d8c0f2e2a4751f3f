"""Quality rules with cross-document line frequency, in built-in DataFrame functions only.

A line of a document is normalised (lower case, digits to 0, white space runs to one
space, trimmed) and hashed; each document counts once for each of its hashes, so
the number of rows of a (host, hash) is the number of its distinct documents. Lines
in more documents of a host than its limit are removed, and a document that
loses too many of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adaptlm.llm.shared import WORD, keyed, written

#: White space and symbols of the rules.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def line_hash(line: Column) -> Column:
    """64-bit hash of a normalised line."""
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]", "0"), r"[\x20\x09-\x0D]+", " ")))


def base_metrics(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the per-text metrics; rows keep their columns. A null text counts as no words.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and
    line_hashes / line_words (distinct hashes of lines with a word; their words).
    Every intermediate array is a column of its own, so it is computed once a row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    no_spaces = F.translate(t, SPACES, "")
    df = rows.withColumns({
        "_words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
        "word_chars": F.length(no_spaces).cast("long"),
        "n_symbols": (F.length(no_spaces) - F.length(F.translate(no_spaces, SYMBOLS, ""))).cast("long"),
    })
    w = F.col("_words")
    hashes = F.when(
        F.size(w) > WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "_windows": hashes,
        "_line_ids": F.transform("_lines", line_hash),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_line_sizes": F.transform("_lines", lambda x: F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))),
    }).drop("_words", "_lines", text)
    # windows found twice or more, as sorted (hash, position) pairs; most texts have none
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_windows")
    s = F.col("_sorted")
    df = df.withColumn("_repeated", F.array_sort(F.transform(F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) & (j > 0) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))).drop("_sorted")
    r = F.col("_repeated")
    covered = F.aggregate(F.transform(r, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(r, j + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", covered).drop("_repeated")
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.withColumns({"line_hashes": F.col("_line_ids"), "line_words": F.col("_line_sizes")}).drop("_line_ids", "_line_sizes")


def quality_rules(docs: DataFrame, host: str = "source", min_docs: int = 20, share: float = 0.01, max_lost: float = 0.5) -> DataFrame:
    """Per row of docs (doc_id, text, host): the metrics, n_removed_lines, n_kept_words, removed_hashes, kept.

    A line goes where more than max(min_docs, share * documents of the host) documents
    of that host hold it. A document is rejected if it fails the base rules, if fewer
    than ten words stay or if more than max_lost of its words go. Null hosts are one host.
    Null texts have no words and are rejected; rows that repeat an id are one document, rows with a null id
    are documents each, and every row has its result; an empty table gives no rows; other columns are ignored.
    """
    rows = keyed(docs, *dict.fromkeys(("doc_id", "text", host))).select("rid", "doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    facts = written(base_metrics(rows), "rules")
    # a document is an id; rows with no id are documents each. Few ids repeat, so only their lines are made distinct one by one
    again = facts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    told = facts.select("doc_id", "host", "line_hashes").join(again, F.col("doc_id") == F.col("again"), "left")
    n_docs = F.count(F.when(F.col("again").isNull(), 1)) + F.count_distinct("again")
    limits = told.groupBy("host").agg(F.greatest(F.lit(min_docs), n_docs * share).alias("limit")).withColumnsRenamed({"host": "l_host"})
    each = told.select("host", "again", F.explode(F.array_distinct("line_hashes")).alias("hash"))
    once = each.where("again IS NULL").groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    more = each.where("again IS NOT NULL").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    common = once.unionByName(more).groupBy("host", "hash").agg(F.sum("n").alias("n")).where(F.col("n") > min_docs)
    common = common.join(limits, F.col("host").eqNullSafe(F.col("l_host"))).where(F.col("n") > F.col("limit")).select(F.col("host").alias("c_host"), F.col("hash").alias("c_hash"))
    lines = facts.select("rid", "host", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("x")).select("rid", "host", F.col("x.line_hashes").alias("hash"), F.col("x.line_words").alias("n"))
    lost = (
        lines.join(common, F.col("host").eqNullSafe(F.col("c_host")) & (F.col("hash") == F.col("c_hash")))
        .groupBy(F.col("rid").alias("l_rid"))
        .agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("n").alias("n_removed_words"), F.collect_set("hash").alias("removed_hashes"))
    )
    out = facts.drop("line_hashes", "line_words").join(lost, F.col("rid") == F.col("l_rid"), "left")
    gone = F.coalesce(F.col("n_removed_words"), F.lit(0))
    left = F.col("n_words") - gone
    return out.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce("n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"),
        left.alias("n_kept_words"),
        F.coalesce("removed_hashes", F.array().cast("array<bigint>")).alias("removed_hashes"),
        (~F.col("base_failed") & (left >= 10) & (gone <= F.lit(max_lost) * F.col("n_words"))).alias("kept"),
    )


def clean_text(text: Column, removed_hashes: Column) -> Column:
    """The text without the lines whose hashes are given."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed_hashes, line_hash(x))), "\n")
