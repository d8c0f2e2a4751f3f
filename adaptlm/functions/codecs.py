"""Encodings of names, events, models and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doc_name(search_id: Column, pos: Column) -> Column:
    return F.concat_ws("_", search_id, pos.cast("string"))


def parse_doc_name(name: Column) -> Column:
    """struct<search_id, pos>, cut at the first _; a position that is no number is 0."""
    at = F.instr(name, "_")
    head = F.when(at > 0, F.substr(name, F.lit(1), at - 1)).otherwise(name)
    tail = F.when(at > 0, F.substr(name, at + 1)).otherwise("")
    return F.struct(head.alias("search_id"), F.coalesce(tail.try_cast("int"), F.lit(0)).alias("pos"))


#: The parts of a kind's tab-separated value in order, with their types. Other kinds: pass a larger table of the same form.
EVENT_KINDS = {"click": (("pos", "int"), ("url", "string")), "rate": (("pos", "int"), ("rating", "string")), "view": (("view_id", "string"), ("start_pos", "int"), ("result_count", "int"))}


def encode_kinds(kind: Column, parts: dict[str, Column], kinds: dict[str, tuple] = EVENT_KINDS) -> Column:
    """The tab-separated value of an event; null for a kind that the table does not have."""
    out = F.lit(None).cast("string")
    for name, fields in kinds.items():
        out = F.when(kind == name, F.concat_ws("\t", *(parts[f].cast("string") for f, _ in fields))).otherwise(out)
    return out


def decode_kinds(kind: Column, value: Column, kinds: dict[str, tuple] = EVENT_KINDS) -> Column:
    """struct of all parts that the table names, in its order; null where the kind has no such part or it is damaged."""
    found: dict[str, Column] = {}
    for name, fields in kinds.items():
        for i, (field, form) in enumerate(fields):
            part = F.when(kind == name, F.get(F.split(value, "\t"), F.lit(i)).try_cast(form))
            found[field] = F.coalesce(found[field], part) if field in found else part
    return F.struct(*(c.alias(f) for f, c in found.items()))


def encode_event(kind: Column, pos: Column, url: Column, rating: Column, view_id: Column, start_pos: Column, count: Column) -> Column:
    """The tab-separated value of a click, rate or view event."""
    return encode_kinds(kind, {"pos": pos, "url": url, "rating": rating, "view_id": view_id, "start_pos": start_pos, "result_count": count})


def decode_event(kind: Column, value: Column) -> Column:
    """struct<pos, url, rating, view_id, start_pos, result_count> of a click, rate or view event, as decode_kinds()."""
    return decode_kinds(kind, value)


def encode_model(models: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """key, value: a line `term TAB prob` for each term, likeliest first, all lines ended."""
    line = F.concat(F.col("term"), F.lit("\t"), F.format_string(f"%.{digits}f", F.col("prob")), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("p"), F.col("term"), line.alias("line"))))
    return models.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "").alias("value"))


def decode_model(rows: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, term, prob of encoded models; a last line without its end and bad numbers are skipped."""
    lines = F.split(F.regexp_replace(F.col(value), r"[^\n]*\z", ""), "\n")
    each = rows.select(key, F.explode(F.filter(lines, lambda x: x != "")).alias("line"))
    return each.select(key, F.split_part("line", F.lit("\t"), F.lit(1)).alias("term"), F.split_part("line", F.lit("\t"), F.lit(2)).try_cast("double").alias("prob")).where("prob is not null")


def id_order(name: Column) -> Column:
    """A struct that orders ids `seconds.sequence` by their numbers and others by their text."""
    return F.struct(F.split_part(name, F.lit("."), F.lit(1)).try_cast("long").alias("seconds"), F.split_part(name, F.lit("."), F.lit(2)).try_cast("long").alias("sequence"), name.alias("name"))


def parse_rfc822(text: Column) -> Column:
    """Timestamp of `Sun, 06 Nov 1994 08:49:37 GMT`; null where it is none."""
    return F.try_to_timestamp(F.regexp_extract(text, r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d)", 1), F.lit("d MMM yyyy HH:mm:ss"))


def time_to_string(ts: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ts, form)


def string_to_time(text: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Null where the text has another form."""
    return F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")


def utc_to_local(ts: Column, zone: str) -> Column:
    """A UTC time as the wall clock of a zone shows it."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def date_label(ts: Column, today: Column) -> Column:
    """Today, Yesterday, or `Jan 05, 2024`."""
    return F.when(F.to_date(ts) == today, "Today").when(F.datediff(today, F.to_date(ts)) == 1, "Yesterday").otherwise(F.date_format(ts, "MMM dd, yyyy"))


def time_label(ts: Column) -> Column:
    """Hour of twelve, minute, AM or PM."""
    return F.date_format(ts, "hh:mm a")
