"""Scans in ranges against the windows by user; XML node tables against a document object model."""

import datetime
import random
from xml.dom import minidom

import pytest
from pyspark.sql import functions as F

from adaptlm.operators import events, scans
from adaptlm.sources import xmltree


def _same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    return sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


@pytest.mark.parametrize("ranges", [7, 1])
def test_scans_are_the_windows(spark, ranges):
    r = random.Random(3)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, "hot" if r.random() < 0.9 else r.choice(["a", "b"]), t0 + datetime.timedelta(seconds=r.randint(0, 400_000)), r.choice([None, "x", "y"])) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz, item string").repartition(4)
    marks = spark.createDataFrame([("hot", t0 + datetime.timedelta(seconds=200_000))], "user_id string, ended timestamp_ntz")
    assert _same(scans.linked(df, "user_id", "item", "ts", "event_id", ranges=ranges), events.linked(df, "user_id", "item", "ts", "event_id"))
    assert _same(scans.gap_runs(df, "user_id", "ts", 1800, "event_id", ranges=ranges), events.gap_runs(df, "user_id", "ts", 1800, "event_id"))
    assert _same(scans.forced_runs(df, marks, "user_id", "ts", 1800, "event_id", ranges=ranges), events.forced_runs(df, marks, "user_id", "ts", 1800, "event_id"))
    assert _same(scans.session_windows(df, "user_id", "ts", 1800, "event_id", ranges=ranges), events.session_windows(df, "user_id", "ts"))
    if ranges > 1:
        assert scans.ranged(df.where("user_id = 'hot'"), "user_id", "ts", "event_id", ranges=ranges).select("_range").distinct().count() == ranges
    assert scans.session_windows(df.limit(0), "user_id", "ts", 1800, "event_id").count() == 0


FEEDS = [
    '<?xml version="1.0"?><rss v="2"><!-- c --><channel><item id="1"><guid>g &amp; h</guid><title>t<b>old</b>u</title></item><item id="2"><![CDATA[<raw> & ]]></item></channel><end/></rss>',
    "<a><b><c x='1'/><c x='2'>t</c></b><b/><d><c x='1' y='\"q\"&#10;z'>&lt;</c></d></a>", "<one/>", "<bad><x></bad>", None, "",
]


def _flat(text):
    """Nodes of a document in order, with their numbers."""
    out = []

    def visit(n, parent, depth):
        if n.nodeType == n.DOCUMENT_TYPE_NODE:
            return
        out.append([n, parent, depth, 0])
        me = len(out)
        for c in n.childNodes:
            visit(c, me, depth + 1)
        out[me - 1][3] = len(out)

    for n in minidom.parseString(text).childNodes:
        visit(n, 0, 1)
    return out


def _next(n, top, descend):
    if descend and n.firstChild:
        return n.firstChild
    while n is not None and n is not top:
        if n.nextSibling:
            return n.nextSibling
        n = n.parentNode
    return None


def test_nodes_and_walks(spark):
    tree = xmltree.nodes(spark.createDataFrame(list(enumerate(FEEDS)), "doc int, xml string"), "doc").cache()
    rows = {d: sorted((r for r in tree.collect() if r.doc == d), key=lambda r: r.pre) for d in range(6)}
    assert not rows[3] and not rows[4] and not rows[5]
    shift = {0: 1}  # the declaration is a node here
    start = []
    for d in range(3):
        flat = _flat(FEEDS[d])
        s = shift.get(d, 0)
        assert len(rows[d]) == len(flat) + s
        for r, (n, parent, depth, last) in zip(rows[d][s:], flat):
            assert (r.last, r.parent, r.depth) == (last + s, parent + s if parent else 0, depth)
            assert r.kind != "element" or (r.name == n.tagName and r.attrs == dict(n.attributes.items()))
            assert r.kind not in ("text", "cdata") or r.value == n.data
        start += [(d, at + s, top + s) for top in range(1, len(flat) + 1) for at in range(top, flat[top - 1][3] + 1)]
    starts = spark.createDataFrame(start, "doc int, at int, top int")
    for mode in ("descend", "no-descend", "descend-first"):
        got, first = {}, {}
        for r in xmltree.walked(starts, tree, "doc", mode).collect():
            got.setdefault((r.doc, r.at, r.top), []).append((r.step, r.pre))
        for r in xmltree.found(starts, tree, "doc", "c", "x", "1", mode).collect():
            first[(r.doc, r.at, r.top)] = r.pre
        for d, at, top in start:
            flat, s = _flat(FEEDS[d]), shift.get(d, 0)
            number = {id(f[0]): i + 1 + s for i, f in enumerate(flat)}
            stop = flat[top - s - 1][0]
            n, want = _next(flat[at - s - 1][0], stop, mode != "no-descend"), []
            while n is not None:
                want.append(number[id(n)])
                n = _next(n, stop, mode == "descend")
            assert [p for _, p in sorted(got.get((d, at, top), []))] == want, (mode, d, at, top)
            hits = [p for p in want if (f := flat[p - s - 1][0]).nodeType == 1 and f.tagName == "c" and f.getAttribute("x") == "1"]
            assert first.get((d, at, top)) == (hits[0] if hits else None)
    texts = {(r.doc, r.at): r.text for r in xmltree.inner_text(starts, tree, "doc").collect()}
    walk = lambda n: "".join(c.data if c.nodeType in (3, 4) else walk(c) for c in n.childNodes if c.nodeType != 8)
    for d in range(3):
        for i, (n, *_) in enumerate(_flat(FEEDS[d])):
            assert texts[(d, i + 1 + shift.get(d, 0))] == (walk(n) if n.nodeType == 1 else "")


def test_edits(spark):
    tree = xmltree.nodes(spark.createDataFrame([(i, f) for i, f in enumerate(FEEDS) if f], "doc int, xml string"), "doc").cache()
    again = xmltree.nodes(xmltree.rebuilt(tree, "doc"), "doc")
    assert _same(again, tree)  # a round trip
    at = {(r.doc, r.name, (r.attrs or {}).get("x") or (r.attrs or {}).get("id")): r.pre for r in tree.where("kind = 'element'").collect()}
    text = tree.where("doc = 0 AND value = 'old'").first().pre
    edits = [
        (0, at[0, "channel", None], 1, "first", "<f1/>", None), (0, at[0, "channel", None], 2, "first", "<f2/>", None), (0, at[0, "channel", None], 3, "last", "<l/>", None),
        (0, at[0, "channel", None], 4, "after", "<after>x</after>", None), (0, at[0, "item", "2"], 5, "before", "<mid/>", None), (0, at[0, "item", "2"], 6, "after", "<tail/>", None), (0, text, 7, "text", "n & <w>", None),
        (0, at[0, "item", "1"], 8, "attribute", "id", "a"), (0, at[0, "item", "1"], 9, "attribute", "id", "b"), (0, at[0, "item", "1"], 10, "attribute", "new", '"v"'), (0, at[0, "item", "2"], 11, "attribute", "id", None), (0, at[0, "rss", None], 12, "name", "feed", None),
        (0, at[0, "guid", None], 13, "remove", None, None), (0, at[0, "guid", None], 14, "before", "<gone-before/>", None), (0, at[0, "guid", None], 15, "first", "<under/>", None), (0, at[0, "end", None], 16, "last", "in", None),
    ]
    got = {r.doc: r.xml for r in xmltree.rebuilt(tree, "doc", spark.createDataFrame(edits, "doc int, where int, number int, operation string, a string, b string")).collect()}
    dom = minidom.parseString(FEEDS[0])
    one = lambda name, k=0: dom.getElementsByTagName(name)[k]
    made = lambda s: dom.importNode(minidom.parseString(s).documentElement, True)
    channel, first, second, guid = one("channel"), one("item"), one("item", 1), one("guid")
    channel.insertBefore(made("<f1/>"), channel.firstChild), channel.insertBefore(made("<f2/>"), channel.childNodes[1])
    second.parentNode.insertBefore(made("<mid/>"), second), channel.appendChild(made("<tail/>")), channel.appendChild(made("<l/>"))
    channel.parentNode.insertBefore(made("<after>x</after>"), channel.nextSibling)
    one("b").firstChild.data = "n & <w>"
    first.setAttribute("id", "b"), first.setAttribute("new", '"v"'), second.removeAttribute("id")
    guid.parentNode.insertBefore(made("<gone-before/>"), guid), guid.parentNode.removeChild(guid)
    one("end").appendChild(dom.createTextNode("in"))
    dom.documentElement.tagName = dom.documentElement.nodeName = "feed"
    assert [r[1:] for r in xmltree.parsed(got[0])[1:]] == [r[1:] for r in xmltree.parsed(dom.documentElement.toxml())] or [(r[0] - 1, *r[4:]) for r in xmltree.parsed(got[0])[1:]] == [(r[0], *r[4:]) for r in xmltree.parsed(dom.documentElement.toxml())]
    assert got[1] == '<a><b><c x="1"></c><c x="2">t</c></b><b></b><d><c x="1" y="&quot;q&quot;&#10;z">&lt;</c></d></a>' and got[2] == "<one></one>"
