"""XML documents as a table of nodes, searched by intervals and changed by edits.

A node's pre is its number in document order, from 1, and last the largest number in its subtree, so what lies under a node, after it, or beside it
are comparisons of numbers, and a search from many nodes is one join. Edits are rows too; they give the text anew, which can be read into nodes again.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adaptlm.sources.tables import checkpointed

NODES = "pre int, last int, parent int, depth int, kind string, name string, value string, attrs map<string,string>"


def parsed(text: str | None) -> list[list]:
    """The nodes of one text, rows of NODES; none if it is not well formed. Kinds: element, text, cdata, other (comments, instructions, the declaration; value is what stands between the brackets)."""
    rows: list[list] = []
    path = [0]
    cdata = False

    def node(kind: str, name: str | None, value: str | None, attrs: dict | None) -> None:
        rows.append([len(rows) + 1, len(rows) + 1, path[-1], len(path), kind, name, value, attrs])

    def start(name: str, attrs: dict) -> None:
        node("element", name, None, attrs)
        path.append(len(rows))

    def end(_: str) -> None:
        rows[path.pop() - 1][1] = len(rows)

    def chars(value: str) -> None:
        kind = "cdata" if cdata else "text"
        if kind == "text" and rows and rows[-1][4] == "text" and rows[-1][2] == path[-1]:
            rows[-1][6] += value
        elif kind == "cdata" and rows and rows[-1][4] == "cdata" and rows[-1][1] == 0:
            rows[-1][6] += value
        elif kind == "text":
            node(kind, None, value, None)

    def cdata_start() -> None:
        nonlocal cdata
        cdata = True
        node("cdata", None, "", None)
        rows[-1][1] = 0  # open

    def cdata_end() -> None:
        nonlocal cdata
        cdata = False
        rows[-1][1] = len(rows)

    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, chars
    p.StartCdataSectionHandler, p.EndCdataSectionHandler = cdata_start, cdata_end
    p.CommentHandler = lambda value: node("other", None, f"!--{value}--", None)
    p.ProcessingInstructionHandler = lambda target, value: node("other", None, f"?{target} {value}?", None)
    p.XmlDeclHandler = lambda version, encoding, _: node("other", None, f'?xml version="{version}"' + (f' encoding="{encoding}"' if encoding else "") + "?", None)
    try:
        p.Parse((text or "").strip(" \t\n\r"), True)
    except expat.ExpatError:
        return []
    return rows


def nodes(texts: DataFrame, key: str, column: str = "xml") -> DataFrame:
    """key and NODES of each text; a text that is null or not well formed has none. They are written once, as searches and edits read them many times."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *(c.split()[0] for c in NODES.split(", "))]
        for f in frames:
            for k, text in zip(f[key], f[column]):
                found = parsed(text)
                if found:
                    yield pd.DataFrame([[k, *r] for r in found], columns=names)

    kind = dict(texts.dtypes)[key]
    return checkpointed(texts.select(key, F.col(column).cast("string").alias(column)).mapInPandas(run, f"{key} {kind}, {NODES}"))


def walked(start: DataFrame, tree: DataFrame, key: str, mode: str = "descend") -> DataFrame:
    """The nodes that a walk from each start (key, at, top: pre of the node it begins at and of the one it stays in) comes to, with at, top and step, their number on the walk.

    descend goes into every node; no-descend passes over what is under a node, also under the first; descend-first goes into the first
    and passes over what is under the others. A walk that has gone past all siblings goes on after the parent, unless that is top.
    """
    ends = tree.select(key, F.col("pre").alias("_pre"), F.col("last").alias("_last"))
    s = start.select(key, "at", "top").join(ends.withColumnsRenamed({"_pre": "at", "_last": "_at_last"}), [key, "at"]).join(ends.withColumnsRenamed({"_pre": "top", "_last": "_top_last"}), [key, "top"])
    over = tree.join(ends.select(key, F.col("_pre").alias("parent"), F.col("_last").alias("_parent_last")), [key, "parent"], "left")
    inside = (F.col("pre") <= F.col("_top_last")) & (F.col("pre") > F.col("top"))
    both = s.join(over, key).where(inside)
    # after the start and not under it, with a parent that holds the start
    beside = (F.col("pre") > F.col("_at_last")) & (F.col("parent") < F.col("at")) & (F.coalesce("_parent_last", F.lit(1 << 30)) >= F.col("at"))
    child = F.col("parent") == F.col("at")
    reached = {"descend": F.col("pre") > F.col("at"), "no-descend": beside & (F.col("at") != F.col("top")), "descend-first": child | beside & (F.col("at") != F.col("top"))}[mode]
    step = F.row_number().over(Window.partitionBy(key, "at", "top").orderBy("pre"))
    return both.where(reached).withColumn("step", step).select(key, "at", "top", "step", *(c.split()[0] for c in NODES.split(", ")))


def found(start: DataFrame, tree: DataFrame, key: str, name: str = "", attr: str = "", value: str = "", mode: str = "descend") -> DataFrame:
    """The first element on the walk from each start with the name, the attribute and the attribute's value; an empty one asks for nothing."""
    rows = walked(start, tree, key, mode).where(F.col("kind") == "element")
    if name:
        rows = rows.where(F.col("name") == name)
    if attr:
        held = F.try_element_at("attrs", F.lit(attr))
        rows = rows.where(held == value if value else held.isNotNull())
    first = Window.partitionBy(key, "at", "top").orderBy("step")
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def inner_text(start: DataFrame, tree: DataFrame, key: str) -> DataFrame:
    """key, at, text: the texts under each start (key, at), joined in order; empty where there is none."""
    ends = tree.select(key, F.col("pre").alias("at"), F.col("last").alias("_at_last"))
    own = start.select(key, "at").distinct().join(ends, [key, "at"])
    texts = tree.where("kind IN ('text', 'cdata')").select(key, "pre", "value")
    under = own.join(texts, key).where("pre > at AND pre <= _at_last").groupBy(key, "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), "").alias("text"))
    return own.select(key, "at").join(under, [key, "at"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def escaped(value: Column) -> Column:
    """Text for between tags or in an attribute."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def _tag(name: Column, attrs: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    return F.concat(F.lit("<"), name, F.coalesce(F.array_join(pairs, ""), F.lit("")), F.lit(">"))


#: Edits: where is the pre of a node, number orders the edits of one place; a and b are what the operation needs.
EDITS = "where int, number int, operation string, a string, b string"


def rebuilt(tree: DataFrame, key: str, edits: DataFrame | None = None) -> DataFrame:
    """key, xml: the documents written anew, after edits (key and EDITS).

    Operations: name (a: the new one), text (a), attribute (a: name, b: value; null removes it), remove (the node and what is under it), and
    before, after, first, last, which put XML (a) beside the node or under it as first or last. Of several changes of one name, text or attribute the last number
    holds; what is put at one place stands in the order of the numbers, and goes with a removed node if it is under it. Attributes stand by name.
    """
    rows = tree
    puts = None
    if edits is not None:
        e = edits.select(key, F.col("where").alias("pre"), "number", "operation", "a", "b")
        last = lambda op: e.where(F.col("operation") == op).groupBy(key, "pre").agg(F.max_by("a", "number").alias(f"_{op}"))
        attrs = e.where("operation = 'attribute'").groupBy(key, "pre", "a").agg(F.max_by(F.struct("b"), "number").alias("_b")).groupBy(key, "pre").agg(F.map_from_entries(F.collect_list(F.struct("a", F.col("_b.b")))).alias("_attrs"))
        rows = rows.join(last("name"), [key, "pre"], "left").join(last("text"), [key, "pre"], "left").join(attrs, [key, "pre"], "left")
        kept = F.map_filter("attrs", lambda k, _: ~F.coalesce(F.map_contains_key("_attrs", k), F.lit(False)))
        merged = F.when(F.col("_attrs").isNull(), F.col("attrs")).otherwise(F.map_concat(kept, F.map_filter("_attrs", lambda _, v: v.isNotNull())))
        rows = rows.withColumns({"name": F.coalesce("_name", "name"), "value": F.coalesce("_text", "value"), "attrs": merged}).drop("_name", "_text", "_attrs")
        cuts = e.where("operation = 'remove'").select(key, "pre").distinct().join(tree.select(key, "pre", "last"), [key, "pre"]).select(key, F.col("pre").alias("_from"), F.col("last").alias("_to"))
        gone = rows.join(cuts, key).where("pre BETWEEN _from AND _to").select(key, "pre").distinct()
        puts = e.where("operation IN ('before', 'after', 'first', 'last')").join(tree.select(key, "pre", "last", "depth"), [key, "pre"])
        # what is put beside a removed node stays, unless a node around it goes too
        lost = puts.join(cuts, key).where("pre > _from AND pre <= _to OR pre = _from AND operation IN ('first', 'last')").select(key, "pre", "number").distinct()
        puts = puts.join(lost, [key, "pre", "number"], "left_anti")
        rows = rows.join(gone, [key, "pre"], "left_anti")
    # places: a node's opening, what is put first under it, then, from the inside out, what is put last under it, its closing, what is put after it, and what is put before the next node
    place = lambda at, phase, inner, turn, number: F.struct(at.alias("at"), F.lit(phase).alias("phase"), inner.alias("inner"), F.lit(turn).alias("turn"), number.alias("number"))
    zero = F.lit(0)
    opening = F.when(F.col("kind") == "element", _tag(F.col("name"), F.col("attrs"))).when(F.col("kind") == "text", escaped(F.col("value"))).when(F.col("kind") == "cdata", F.concat(F.lit("<![CDATA["), F.col("value"), F.lit("]]>"))).otherwise(F.concat(F.lit("<"), F.col("value"), F.lit(">")))
    bits = rows.select(key, place(F.col("pre"), 0, zero, 0, zero).alias("p"), opening.alias("s")).unionByName(
        rows.where("kind = 'element'").select(key, place(F.col("last"), 2, -F.col("depth"), 1, zero).alias("p"), F.concat(F.lit("</"), F.col("name"), F.lit(">")).alias("s")))
    if puts is not None:
        for op, at, phase, inner, turn in (("first", F.col("pre"), 1, zero, 0), ("last", F.col("last"), 2, -F.col("depth"), 0), ("after", F.col("last"), 2, -F.col("depth"), 2), ("before", F.col("pre") - 1, 3, zero, 0)):
            bits = bits.unionByName(puts.where(F.col("operation") == op).select(key, place(at, phase, inner, turn, F.col("number")).alias("p"), F.col("a").alias("s")))
    return bits.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "s"))), lambda x: x["s"]), "").alias("xml"))
