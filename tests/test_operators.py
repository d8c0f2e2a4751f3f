"""Operators against brute force on small rows."""

import datetime
import math
import random

import pytest

from pyspark.sql import functions as F

from adaptlm.functions import codecs as C
from adaptlm.functions import text as T
from adaptlm.operators import events, lm, models, rank, sessions, topics
from adaptlm.sources.history import History, import_log
from adaptlm.sources.segments import HistoryIndex, InvertedIndex
from adaptlm.sources.store import Store
from adaptlm.sources.tables import append
from adaptlm.sources.texts import aol_entries, read_whole
from adaptlm.streaming import streams


def one(spark, f, *values):
    kinds = ["timestamp_ntz" if isinstance(v, datetime.datetime) else "string" for v in values]
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return row.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


def test_addresses(spark):
    parts = lambda u: tuple(one(spark, T.url_parts, u))
    assert parts("http://host") == ("http", "host", "", "", "", "")
    assert parts("host.org/path?a=1") == ("", "host.org", "", "/path", "a=1", "")
    assert parts("http://h:81/p#f") == ("http", "h", "81", "/p", "", "f") and set(parts("http://h/")) == {""}
    params = [tuple(x) for x in one(spark, T.query_params, "a%20b=c+d&&x=&y&%C3%A9=1%262")]
    assert params == [("a b", "c d"), ("x", ""), ("é", "1&2")]
    assert one(spark, T.query_params, "a=%zz") is None
    assert one(spark, lambda c: T.build_query(T.query_params(c)), "a%20b=c+d&%C3%A9=1%262") == "a+b=c+d&%C3%A9=1%262"
    assert one(spark, lambda c: T.rebuilt_url(T.url_parts(c), T.with_param(T.without_param(T.query_params(T.url_parts(c)["query"]), "n"), "k", F.lit("v w"))), "http://h:8/p?n=1&m=2#t") == "http://h:8/p?m=2&k=v+w#t"
    assert one(spark, lambda c: T.param(T.query_params(c), "a"), "a=1&b=2&a=3") == "3" and one(spark, lambda c: T.param(T.query_params(c), "z"), "a=1") is None


def test_templates_times_and_hits(spark):
    assert one(spark, T.attributes, ' a="1" b = "x &amp; y" a="2"') == {"a": "2", "b": "x & y"}
    assert one(spark, T.trimmed_template, "a\n  <template:if x>  \n${v}\n b\n</template:if>") == "a\n<template:if x>${v} b\n</template:if>"
    assert [one(spark, lambda c: T.template_test(k, c, F.lit("a")), v) for k, v in (("eq", "a"), ("neq", "a"), ("exist", None), ("nexist", None), ("empty", ""), ("empty", None), ("nempty", "x"))] == [True, False, False, True, True, True, True]
    t = datetime.datetime(2024, 7, 1, 12, 0, 5)
    assert one(spark, C.time_to_string, t) == "2024-07-01 12:00:05" and one(spark, C.string_to_time, "2024-07-01 12:00:05") == t and one(spark, C.string_to_time, "x") is None
    assert one(spark, lambda c: C.utc_to_local(c, "America/New_York"), t) == datetime.datetime(2024, 7, 1, 8, 0, 5)
    hit = one(spark, lambda *c: T.shown_result(*c), "t", "", "s", "<b>s</b>", "http://h/p/", "", "")
    assert tuple(hit) == ("t", "<b>s</b>", "http://h/p/", "h/p")
    assert one(spark, T.document_text, "a", None) == "a "


def test_aol_page(spark, tmp_path):
    page = '<span id="lowerLimit">11</span><span id="upperLimit">20</span> of <b>1,234</b>Did you mean: <a x>sprak</a>' + "".join(f'<li about="r{i}"><a class="t" href="http://h/{i}" property="f:title">T<b>{i}</b></a><p class="d" property="f:desc">S {i}</p><span property="f:durl">h/{i}</span><span class="mimetype">[PDF]</span></li>' for i in range(2)) + '<li about="r"><a href="" property="f:title"></a></li>'
    got = aol_entries(spark.createDataFrame([(1, page)], "page_id int, html string"), "page_id").orderBy("pos").collect()
    assert [(r.pos, r.title, r.url, r.summary, r.shown_url, r.mime_type, r.total, r.suggestion) for r in got] == [(11 + i, f"T{i}", f"http://h/{i}", f"S {i}", f"h/{i}", "PDF", 1234, "sprak") for i in range(2)]
    (tmp_path / "a.txt").write_text("x\ny")
    assert [r.content for r in read_whole(spark, f"file://{tmp_path}/a.txt").collect()] == ["x\ny"]


def test_pages_and_sources(spark):
    ask = lambda e, s, n: tuple(spark.range(1).select(rank.page_request(e, F.lit(s), F.lit(n)).alias("x")).first().x)
    assert ask("bing", 13, 5) == (11, 10) and ask("boss", 1, 250) == (1, 100) and ask("boss", 5, 12) == (1, 20) and ask("aol", 11, 15) == (1, 20) and ask("aol", 31, 3) == (31, 10)
    assert [tuple(x) for x in spark.range(1).select(rank.covering_pages(F.lit(5), F.lit(20)).alias("x")).first().x] == [(1, 10), (11, 10), (21, 10)]
    cached = spark.createDataFrame([("a", p, "old") for p in range(1, 6)] + [("b", 1, "old")], "search_id string, pos int, url string")
    wanted = spark.createDataFrame([("a", 1, 5), ("b", 1, 3)], "search_id string, start int, count int")
    asked = []

    def fetch(missing):
        asked.extend(r.search_id for r in missing.collect())
        return missing.select("search_id", F.explode(F.sequence("start", F.col("start") + 9)).alias("pos"), F.lit("new").alias("url"))

    got = rank.search_or_fetch(cached, wanted, fetch).collect()
    assert asked == ["b"] and sorted(r.pos for r in got if r.search_id == "b") == list(range(1, 11)) and {r.url for r in got if r.search_id == "b"} == {"new"} and {r.url for r in got if r.search_id == "a"} == {"old"}
    r = rank.SourceRegistry()
    r.add("x", fetch)
    assert r.names() == ["x"] and r.get("y") is None
    assert [x.url for x in rank.result_at(cached, wanted.select("search_id", F.lit(2).alias("pos"))).orderBy("search_id").collect()] == ["old", None]


def test_time_based_session(spark):
    r = random.Random(2)
    base = datetime.datetime(2024, 1, 1)
    rows, walk = [], []
    for u in range(6):
        t = 0
        for k in range(30):
            t += r.choice([60, 400, 1500, 1801, 4000])
            last = t + r.choice([0, 100, 3000])
            rows.append((u, u * 100 + k, t, last, 20_000 if u % 2 else None))
    for u, i, c, l, e in rows:
        mine = sorted(x for x in rows if x[0] == u)
        at = [x[1] for x in mine].index(i)
        walk.append((u, i, i))
        for _, j, c2, l2, _ in mine[at + 1 :]:
            if e is not None and c2 > e > c or c2 - l > 1800:
                break
            walk.append((u, i, j))
        for _, j, c2, l2, _ in reversed(mine[:at]):
            if e is not None and c > e > c2 or c - l2 > 1800:
                break
            walk.append((u, i, j))
    at = lambda s: None if s is None else base + datetime.timedelta(seconds=s)
    df = spark.createDataFrame([(u, i, at(c), at(l), at(e)) for u, i, c, l, e in rows], "user_id long, search_id long, created timestamp_ntz, last timestamp_ntz, ended timestamp_ntz")
    got = events.time_based_session(df, "user_id", "search_id", "created", "last", "ended").collect()
    assert sorted(map(tuple, got)) == sorted(walk)


def test_session_assignment_and_view(spark):
    state = spark.createDataFrame([(1, 9, "1", 0), (2, 9, "2", 10), (3, 9, "3", 20)], "search_id long, user_id long, session_id string, ts long")
    fresh = spark.createDataFrame([(4, 9, 30), (5, 8, 40)], "search_id long, user_id long, ts long")
    links = spark.createDataFrame([(4, 2), (4, 3)], "a long, b long")
    got = {r.search_id: r.session_id for r in sessions.assign_sessions(state, fresh, links).collect()}
    assert got == {1: "1", 2: "2", 3: "2", 4: "2", 5: "5"}
    view = sessions.session_view(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "search_id long, session_id string"), spark.createDataFrame([(1, 1), (1, 3)], "anchor long, search_id long"))
    assert {(r.anchor, r.search_id): r.related for r in view.collect()} == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 1): True, (2, 2): True, (3, 3): True}
    s = spark.createDataFrame([(i, 1, t, 1000) for i, t in enumerate([0, 900, 1799, 1801, 9000])], "search_id long, user_id long, ts long, ended long")
    assert sorted(map(tuple, sessions.near_pairs(s, "ts").collect())) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
    assert sorted(map(tuple, sessions.near_pairs(s, "ts", ended="ended").collect())) == [(0, 1), (2, 3)]
    w = spark.createDataFrame([(0, "x", 3.0), (0, "y", 4.0), (1, "x", 1.0), (2, "z", 1.0)], "search_id long, term string, weight double")
    assert [(r.a, r.b, round(r.cosine, 9)) for r in sessions.pair_cosines(sessions.near_pairs(s, "ts"), w).collect()] == [(0, 1, 0.6)]


def em(target, components, priors, steps=20):
    w, before = [1 / len(components)] * len(components), 0.0
    for k in range(steps):
        mix = [sum(a * c[t] for a, c in zip(w, components)) for t in range(len(target))]
        like = sum(n * math.log(m) for n, m in zip(target, mix) if m > 0)
        if k and abs(like - before) < abs(like + before) * 1e-6:
            break
        before = like
        g = [p + sum(n * a * c[t] / mix[t] for t, n in enumerate(target) if mix[t] > 0) for p, a, c in zip(priors, w, components)]
        w = [x / sum(g) for x in g]
    return w


def test_history_model(spark):
    query, pseudo = {"a": 0.7, "b": 0.3}, {"a": 0.5, "b": 0.2, "c": 0.3}
    past = {10: {"a": 0.2, "c": 0.8}, 11: {"z": 1.0}, 12: {"b": 0.5, "q": 0.5}}
    background = {"a": 0.1, "c": 0.05}
    table = lambda m, k: [(k, t, p) for t, p in m.items()]
    mk = lambda rows, key: spark.createDataFrame(rows, f"{key} long, term string, prob double")
    near = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "search_id long, other long")
    probs, default = spark.createDataFrame(list(background.items()), "term string, prob double"), spark.createDataFrame([(0.001,)], "default_prob double")
    both = table(query, 1) + table(query, 2), table(pseudo, 1) + table(pseudo, 2)
    got = models.history_model(mk(both[0], "search_id"), mk(both[1], "search_id"), near, mk([x for k, m in past.items() for x in table(m, k)], "other"), probs, default, "search_id", "other").collect()
    terms = sorted(pseudo)
    components = [[query.get(t, 0) for t in terms], [background.get(t, 0.001) for t in terms], *([past[k].get(t, 0) for t in terms] for k in (10, 11, 12))]
    w = em([pseudo[t] for t in terms], components, [0.1, 0.9, 0, 0, 0])
    want = {}
    for k, x in zip((10, 11, 12), w[2:]):
        for t, p in past[k].items():
            want[t] = want.get(t, 0) + x * p
    want = {t: p / sum(want.values()) for t, p in want.items() if p / sum(want.values()) >= 0.001}
    assert {r.search_id for r in got} == {1} and {r.term for r in got} == set(want)
    assert all(abs(r.prob - want[r.term]) < 1e-9 for r in got)
    flags = models.adaptive(spark.createDataFrame([(1,), (2,)], "search_id long"), near, "search_id").collect()
    assert {r.search_id: r.adaptive for r in flags} == {1: True, 2: False}


def test_rerank_by_model(spark):
    queries = spark.createDataFrame([(1, "plain"), (2, "naïve"), (3, "plain"), (4, "plain")], "q long, text string")
    results = spark.createDataFrame([(q, p, t, n) for q in (1, 2, 3, 4) for p, t, n in ((1, "x", 1), (2, "y", 3), (3, "y", 1), (3, "x", 1), (4, "z", 1), (5, "y", 9))], "q long, pos int, term string, tf long")
    viewed = spark.createDataFrame([(1, 4, 1), (3, 4, 1)], "q long, pos int, seq int")
    model = spark.createDataFrame([(q, "y", 1.0) for q in (1, 2, 3)], "q long, term string, prob double")
    flags = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "q long, adaptive boolean")
    probs, default = spark.createDataFrame([("y", 0.01)], "term string, prob double"), spark.createDataFrame([(0.001,)], "default_prob double")
    got = {}
    for r in rank.rerank_by_model(queries, results, viewed, model, flags, probs, default, "q", promote=2).collect():
        got.setdefault(r.q, {})[r["rank"]] = r.pos
    order = {q: [m[k] for k in sorted(m)] for q, m in got.items()}
    assert order == {1: [4, 5, 2, 1, 3], 2: [1, 2, 3, 4, 5], 3: [1, 2, 3, 4, 5], 4: [1, 2, 3, 4, 5]}
    size = {1: 1, 2: 3, 3: 2, 4: 1, 5: 9}
    scores = {r.pos: r.score for r in rank.own_scores(model.where("q = 1"), results, probs, default, "q", 100.0).collect()}
    assert all(abs(s - (math.log(1 + {2: 3, 3: 1, 5: 9}[p] / 100 / 0.01) + math.log(0.01) + math.log(100 / (size[p] + 100)))) < 1e-12 for p, s in scores.items()) and set(scores) == {2, 3, 5}
    everything = rank.rerank_by_model(queries, results, viewed, model, flags, probs, default, "q", all_results=True, despite=True).where("q = 3").orderBy("rank").collect()
    assert [r.pos for r in everything] == [5, 2, 3, 1, 4]


def test_built_topics(spark):
    searches = spark.createDataFrame([(1, 7, "s1", "a"), (2, 7, "s1", "b"), (3, 7, "s2", "a"), (4, 7, "s3", "c"), (5, 7, "s4", "d"), (6, 8, "s1", "a")], "search_id long, user_id long, session_id string, query string")
    prob = {1: {"x": 1.0}, 2: {"y": 1.0}, 3: {"x": 0.5, "z": 0.5}, 4: {"y": 0.9, "q": 0.1}, 5: {"w": 1.0}, 6: {"x": 1.0}}
    model = spark.createDataFrame([(i, t, p) for i, m in prob.items() for t, p in m.items()], "search_id long, term string, prob double")
    members, terms = topics.build_topics(searches, model)
    assert {r.search_id: r.topic for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}
    got = {(r.topic, r.term): r.prob for r in terms.collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {(1, "x"): 0.375, (1, "y"): 0.475, (1, "z"): 0.125, (1, "q"): 0.025, (5, "w"): 1.0, (6, "x"): 1.0}
    apart, _ = topics.build_topics(searches, model, by_session=False, by_query=False)
    assert {r.search_id: r.topic for r in apart.collect()} == {1: 1, 3: 1, 2: 2, 4: 2, 5: 5, 6: 6}
    stats = topics.topic_stats(members.join(searches, "search_id").select("topic", "session_id", "query", F.lit(None).cast("string").alias("clicked_url")), "topic")
    assert [(r.topic, r["rank"]) for r in topics.listed(stats, "query").orderBy("rank").collect()] == [(1, 1), (5, 2), (6, 3)]
    assert [r.topic for r in topics.nontrivial(stats).collect()] == [1]
    assert [(r.query, r.n) for r in topics.counted(members.join(searches.drop("user_id"), "search_id"), "topic", "query").where("topic = 1").orderBy("rank").collect()] == [("a", 2), ("b", 1), ("c", 1)]


def test_clusters_of_many_groups(spark, monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(topics, "TASK_ROWS", 400)
    monkeypatch.setattr(topics, "OUT_ROWS", 25)
    items = [(None if g == 7 else f"g{g}", 10 * g + i, r.randint(1, 3)) for g in range(600) for i in range(1 + g % 4)]
    pairs = [(x[0], x[1], y[1], round(r.random() * 0.4, 3)) for x in items for y in items[items.index(x) + 1 :][:3] if x[0] == y[0]]
    got = topics.clusters(spark.createDataFrame(pairs, "g string, a long, b long, sim double"), spark.createDataFrame(items, "g string, item long, size long"), "g").withColumn("task", F.spark_partition_id()).collect()
    want = {}
    for g in {x[0] for x in items}:
        mine = {x[1]: x[2] for x in items if x[0] == g}
        want |= {(g, i): c for i, c in topics.average_link([p[1:] for p in pairs if p[0] == g], sorted(mine), sizes=mine).items()}
    assert len(got) == len(items) and {(x.g, x.item): x.cluster for x in got} == want and any(c != i for (_, i), c in want.items())
    # few bytes are dealt to tasks by their rows, 400 a task here
    assert len({x.task for x in got}) == -(-(len(items) + len(pairs)) // 400) > 4 and len({(x.g, x.task) for x in got}) == 600


def test_memory_of_models(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "s long, term string, prob double")
    fresh = spark.createDataFrame([(1, "x", 1.0), (2, "y", 1.0), (3, "z", 1.0)], "s long, term string, prob double")
    ev = spark.createDataFrame([(1, "rate", 5), (2, "view", 9), (2, "click", 1)], "s long, type string, ts long")
    state = models.any_outdated(spark.createDataFrame([(1, 3), (2, 3)], "s long, ts long"), ev, "s", "click", "rate")
    assert {r.s: r.outdated for r in state.collect()} == {1: True, 2: False}
    assert {(r.s, r.term) for r in models.kept_models(old, fresh, state, "s").collect()} == {(1, "x"), (2, "b"), (3, "z")}


def test_history(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h")
    assert not h.has("searches")
    h.create()
    h.create()
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    searches = spark.createDataFrame([("1.1", "u", "1.1", "q", t(0)), ("2.2", "u", "2.2", "r", t(50)), ("3.3", "v", "3.3", "q", t(0))], "search_id string, user_id string, session_id string, query string, ts timestamp_ntz")
    results = spark.createDataFrame([("1.1", 1, "t", "s", "http://h")], "search_id string, pos int, title string, summary string, url string")
    ev = spark.createDataFrame([(1, "1.1", "u", "click", "1\thttp://h", t(1)), (2, "9.9", "u", "click", "1\tx", t(1))], "event_id long, search_id string, user_id string, type string, value string, ts timestamp_ntz")
    model = spark.createDataFrame([("1.1", "a", 0.25), ("1.1", "b", 0.75), ("8.8", "c", 1.0)], "search_id string, term string, prob double")
    import_log(h, "first", searches, results, ev, model.where("search_id <> '1.1'"))
    import_log(h, "first", searches, results, ev, model)  # again: nothing
    assert h.table("searches").count() == 3 and sorted(r.user_id for r in h.users().collect()) == ["u", "v"] and h.has("topics")
    decoded, lost = h.events()
    assert [(r.search_id, r.pos, r.url) for r in decoded.collect()] == [("1.1", 1, "http://h")] and [r.search_id for r in lost.collect()] == ["9.9"]
    h.save_models("m1", spark.createDataFrame([("1.1", "a", 0.25), ("1.1", "b", 0.75), ("2.2", "d", 1.0)], "search_id string, term string, prob double"), t(55))
    h.save_models("m2", spark.createDataFrame([("1.1", "z", 1.0)], "search_id string, term string, prob double"), t(59))
    saved, unknown = h.models()
    assert sorted((r.search_id, r.term, r.prob) for r in saved.collect()) == [("1.1", "a", 0.25), ("1.1", "b", 0.75)] and [r.search_id for r in unknown.collect()] == ["8.8"]
    h.set_sessions("s1", spark.createDataFrame([("2.2", "1.1"), ("3.3", "3.3")], "search_id string, session_id string"))
    h.set_sessions("s2", spark.createDataFrame([("2.2", "0.0")], "search_id string, session_id string"))
    assert {r.search_id: r.session_id for r in h.table("searches").collect()} == {"1.1": "1.1", "2.2": "0.0", "3.3": "3.3"}
    topic = lambda i, u: spark.createDataFrame([(i, "n", "v", u)], "topic_id long, name string, value string, user_id string")
    member = lambda i, u: spark.createDataFrame([(i, "1.1", 1.0, u)], "topic_id long, search_id string, weight double, user_id string")
    stats = spark.createDataFrame([(1, 3), (2, 3), (3, 2), (4, 5)], "topic_id long, sessions long")
    h.replace_topics("t1", topic(1, "u").union(topic(3, "u")).union(topic(2, "v")), member(1, "u").union(member(2, "v")), stats, attrs=topic(1, "u"))
    assert [r.topic_id for r in h.table("topic_attrs").collect()] == [1]
    h.replace_topics("t2", topic(4, "u"), member(4, "u"), stats)
    assert [r.topic_id for r in h.topics("u").collect()] == [4] and [r.topic_id for r in h.topics("v").collect()] == [2]
    h.compact()
    assert len(h.store.state()[1]["parts"]["attributes"]) == 1 and {r.search_id: r.session_id for r in h.table("searches").collect()}["2.2"] == "0.0"
    h.replace_topics("t3", topic(3, "u"), member(3, "u"), stats)  # a trivial topic alone
    assert h.topics("u").count() == 0 and [r.topic_id for r in h.topics("v").collect()] == [2] and h.table("topic_attrs").count() == 0
    # a run that is killed between tables leaves no trace, and of two writers of one unit one counts
    before, write = h.store.state(), h.store.write

    def killed(table, rows):
        if table == "results":
            raise KeyboardInterrupt
        return write(table, rows)

    h.store.write = killed
    with pytest.raises(KeyboardInterrupt):
        h.append("late", searches=searches, results=results)
    h.store.write = write
    assert h.store.state() == before and h.table("searches").count() == 3

    def overtaken(table, rows):
        h.store.write = write
        assert h.append("race", results=results)
        return write(table, rows)

    h.store.write = overtaken
    assert not h.append("race", results=results) and h.table("results").count() == 2
    assert not h.append("race", results=results) and h.store.vacuum() > 0 and h.table("results").count() == 2 and h.table("searches").count() == 3
    assert [(r.search_id, r.user_id) for r in h.with_user(spark.createDataFrame([("3.3",), ("x",)], "search_id string")).collect()] == [("3.3", "v")]
    clicks = decoded.select("search_id", "pos").union(spark.createDataFrame([("2.2", 7)], "search_id string, pos int"))
    assert {r.search_id: r.url for r in events.with_results(clicks, h.table("results")).collect()} == {"1.1": "http://h", "2.2": None}


def test_order_and_pages(spark):
    e = spark.createDataFrame([(1, "u", 5, 1), (2, "u", 3, 2), (3, "u", 5, 3), (4, "u", 5, 0)], "event_id long, user_id string, ts long, arrived long")
    assert {r.event_id: r.seq for r in events.in_order(e, "user_id", "ts", "arrived").collect()} == {2: 1, 4: 2, 1: 3, 3: 4}
    assert [(r.event_id, r["rank"]) for r in events.reverse_page(e, "user_id", "ts", "event_id", start=2, size=2).orderBy("rank").collect()] == [(3, 2), (1, 3)]
    texts = spark.createDataFrame([(1, "a b a"), (1, "z"), (2, "é x"), (3, "q")], "doc_id long, text string")
    assert sorted(map(tuple, lm.index(texts, "doc_id").collect())) == [(1, "a", 2), (1, "b", 1), (3, "q", 1)]


def test_live_streams(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "apple pie", "apple"), ("d2", "quantum", "state")], "doc_id string, title string, summary string")
    append(docs, str(tmp_path / "in"))
    topic = spark.createDataFrame([(1, "apple", 0.7), (1, "pie", 0.3)], "topic int, term string, prob double")
    probs, default = spark.createDataFrame([("apple", 0.001)], "term string, prob double"), spark.createDataFrame([(0.001,)], "default_prob double")
    streams.recommendations(streams.file_stream(spark, str(tmp_path / "in"), docs.schema), topic, probs, default, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [(r.doc_id, r.topic, r.recommended) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("d1", 1, True)]
    s = spark.createDataFrame([(1, 9, 0), (2, 9, 100)], "search_id long, user_id long, ts long")
    near = lambda old, fresh: sessions.near_pairs(old.select("search_id", "user_id", "ts").unionByName(fresh), "ts")
    for k, rows in enumerate((s, spark.createDataFrame([(3, 9, 1900), (4, 9, 9000)], "search_id long, user_id long, ts long"))):
        append(rows, str(tmp_path / "s"))
        streams.online_sessions(streams.file_stream(spark, str(tmp_path / "s"), s.schema), str(tmp_path / "state"), near, str(tmp_path / "c2")).awaitTermination()
    assert {r.search_id: r.session_id for r in spark.read.parquet(str(tmp_path / "state/1")).collect()} == {1: "1", 2: "1", 3: "1", 4: "4"}
    e = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (1, datetime.datetime(2024, 1, 1, 0, 10)), (2, datetime.datetime(2024, 1, 2))], "k long, ts timestamp")
    append(e, str(tmp_path / "e"))
    last = streams.expiring(streams.file_stream(spark, str(tmp_path / "e"), e.schema), "k", "ts")
    streams.to_table(last, str(tmp_path / "x"), str(tmp_path / "c3")).awaitTermination()
    append(e.where("k = 2"), str(tmp_path / "e"))
    streams.to_table(last, str(tmp_path / "x"), str(tmp_path / "c3")).awaitTermination()
    assert [(r.k, r.last) for r in spark.read.parquet(str(tmp_path / "x")).collect()] == [(1, datetime.datetime(2024, 1, 1, 0, 10))]
    streams.event_log(streams.file_stream(spark, str(tmp_path / "e"), e.schema), str(tmp_path / "log"), str(tmp_path / "c4")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).where("arrived is not null").count() == 4
    built = []
    state = streams.IndexState(lambda: built.append(1) or len(built))
    assert [state.get(), state.get(), (state.touch(), state.get())[1], state.get(True)] == [1, 1, 2, 3]


def _same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_index_grows_with_its_folder(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    source = tmp_path / "docs é+"
    put = lambda rows, name: rows.coalesce(1).write.mode("overwrite").parquet(f"file://{source}/{name}")
    put(docs.where("doc_id % 4 = 0"), "a")
    index = InvertedIndex(spark, f"file://{source}/*", f"file://{tmp_path}/index")

    def holds():
        now = spark.read.parquet(f"file://{source}/*")
        counts = lm.term_counts(now, "doc_id")
        return _same(index.postings(), counts) and _same(index.terms(), counts.groupBy("term").agg(F.sum("tf").alias("count"))) and _same(index.lengths(), lm.lengths(counts, "doc_id"))

    assert index.refresh() == "built" and index.refresh() == "same" and holds()
    put(docs.where("doc_id % 4 = 1"), "b")
    read = []
    table = index.store.write
    index.store.write = lambda name, rows: read.append(rows.count()) or table(name, rows) if name == "postings" else table(name, rows)
    assert index.refresh() == "changed" and holds()
    assert read == [lm.term_counts(docs.where("doc_id % 4 = 1"), "doc_id").count()]  # the new file alone
    put(docs.where("doc_id % 4 = 2"), "a")  # in place of the first
    assert index.refresh() == "changed" and holds()
    put(docs.where("doc_id % 4 = 2"), "c")  # the same documents once more
    assert index.refresh() == "changed" and holds()
    put(docs.where("doc_id % 4 = 3"), "a")
    assert index.refresh(few=1) == "changed" and holds() and len(index.store.state()[1]["parts"]["postings"]) == 1
    assert index.refresh() == "same"


def test_history_tiers(spark, tmp_path):
    index = HistoryIndex(spark, f"file://{tmp_path}/tiers")
    models = lambda *rows: spark.createDataFrame(rows, "search_id string, term string, prob double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "search_id string")
    index.refresh(models(("1", "a", 1.0), ("2", "b", 1.0)), ids())
    index.refresh(models(("1", "c", 1.0), ("2", "d", 1.0)), ids("1"))
    assert sorted((r.search_id, r.term, r.tier) for r in index.models().collect()) == [("1", "c", "long"), ("2", "d", "short")]
    index.refresh(models(("1", "x", 1.0), ("2", "e", 1.0), ("3", "f", 1.0)), ids("1"))  # what is in the long tier stays as it was
    assert sorted((r.search_id, r.term, r.tier) for r in index.models().collect()) == [("1", "c", "long"), ("2", "e", "short"), ("3", "f", "short")]
    index.refresh(models(), ids("2"))
    assert [r.search_id for r in index.tier("long").collect()] == ["1"] and index.tier("short").count() == 0


@pytest.mark.parametrize("local_pairs", [0, 40])
def test_clusters_by_rounds_are_those_of_one_heap(spark, local_pairs):
    r = random.Random(1)
    pairs, items = [], []
    for g, share in enumerate((0.1, 0.3)):
        ids = [g * 100 + i for i in range(16)]
        items += [(g, i, r.choice([1, 1, 2, 3])) for i in ids]
        pairs += [(g, a, b, max(0.01, round(r.random(), r.choice([1, 6])) * r.choice([0.05, 1]))) for a in ids for b in ids if a < b and r.random() < share]
    got = topics.clusters(spark.createDataFrame(pairs, "user long, a long, b long, sim double"), spark.createDataFrame(items, "user long, item long, size long"), "user", local_pairs=local_pairs)
    want = []
    for g in range(2):
        sizes = {i: n for u, i, n in items if u == g}
        want += [(g, i, c) for i, c in topics.average_link([p[1:] for p in pairs if p[0] == g], list(sizes), sizes=sizes).items()]
    assert sorted(map(tuple, got.select("user", "item", "cluster").collect())) == sorted(want)


def test_models_are_built_once(spark, tmp_path):
    s = lambda rows, schema: spark.createDataFrame(rows, schema)
    docs = s([(1, "apple", 3), (1, "pie", 1), (2, "apple", 1), (2, "phone", 4), (3, "pear", 2)], "doc_id long, term string, tf long")
    probs, default = lm.collection_probs(docs)
    evidence = models.Evidence(
        s([(1, "apple pie"), (2, "phone"), (3, "pear")], "search_id long, text string"),
        s([(1, 1, True), (1, 2, False), (2, 2, False), (3, 3, True)], "search_id long, doc_id long, clicked boolean"), s([(2, 2, "Y")], "search_id long, doc_id long, rating string"),
        s([(1, 3)], "search_id long, other_id long"), s([(2, 1, 0.5)], "search_id long, other_id long, cosine double"), s([(1, "apple", 1.0), (3, "pear", 0.5), (3, "pie", 0.5)], "other_id long, term string, prob double"), docs, probs, default,
    )
    registry = models.default_registry(Store(spark, f"file://{tmp_path}/models"))
    assert registry.names() == ["query", "pseudo", "explicit", "single-search", "session", "long-term-history"]
    asked = []
    for name, (builder, kinds) in list(registry.builders.items()):
        registry.add(name, lambda e, name=name, builder=builder: asked.append((name, sorted(r.search_id for r in e.queries.collect()))) or builder(e), *kinds)
    none = s([], "search_id long, type string, ts timestamp_ntz")
    keys, t = s([(1,), (2,), (3,)], "search_id long"), lambda m: datetime.datetime(2024, 1, 1, 0, m)
    first = {n: sorted(map(tuple, registry.build(n, keys, evidence, none, t(1)).collect())) for n in registry.names()}
    assert [a[0] for a in asked] == registry.names() and all(a[1] == [1, 2, 3] for a in asked)
    assert first["query"] == [(1, "apple", 0.5), (1, "pie", 0.5), (2, "phone", 1.0), (3, "pear", 1.0)] and {r[0] for r in first["explicit"]} == {2} and all(first.values())
    assert {n: sorted(map(tuple, registry.build(n, keys, evidence, none, t(2)).collect())) for n in registry.names()} == first and len(asked) == 6
    clicked = s([(1, "click", t(3)), (2, "view", t(0))], "search_id long, type string, ts timestamp_ntz")
    assert sorted(map(tuple, registry.build("single-search", keys, evidence, clicked, t(4)).collect())) == first["single-search"] and asked[6:] == [("single-search", [1])]
    registry.build("single-search", keys, evidence, clicked, t(5)), registry.build("pseudo", keys, evidence, clicked, t(5))
    assert len(asked) == 7


def test_ranks_over_all(spark):
    rows = [(i, i % 3, (i * 7) % 11) for i in range(60)]
    stats = spark.createDataFrame(rows, "topic long, user long, sessions long").withColumns({c: F.lit(0) for c in ("queries", "unique_queries", "clicks", "unique_clicks")})
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    assert {r.topic: r["rank"] for r in topics.listed(stats.repartition(5), "session").collect()} == want
    mine = {r.topic: r["rank"] for r in topics.listed(stats, "session", user="user").collect()}
    assert all(mine[t] == 1 + sum(want[x] < want[t] for x, u, _ in rows if u == user) for t, user, _ in rows)


def test_index_shuffles_texts_and_knows_shares(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    put = lambda rows, name: rows.coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/docs/{name}")
    put(docs.where("doc_id % 4 = 0").unionByName(docs.where("doc_id < 9")), "a")
    index = InvertedIndex(spark, f"file://{tmp_path}/docs/*", f"file://{tmp_path}/index")
    plans, write = [], index.store.write
    index.store.write = lambda name, rows: plans.append((name, rows._jdf.queryExecution().executedPlan().toString())) or write(name, rows)
    index.refresh()
    assert [plan.count("Exchange") for name, plan in plans if name == "postings"] == [1]  # of the texts
    wanted = lambda rows: lm.normalised(lm.term_counts(rows, "doc_id").withColumnRenamed("tf", "weight"), "doc_id")
    assert "Exchange hashpartitioning" not in index.shares()._jdf.queryExecution().executedPlan().toString()
    assert _same(index.shares(), wanted(spark.read.parquet(f"file://{tmp_path}/docs/*")))
    put(docs.where("doc_id % 8 < 3"), "b")  # some of the keys again
    index.refresh()
    assert _same(index.shares(), wanted(spark.read.parquet(f"file://{tmp_path}/docs/*")))


def test_rows_of_keys_that_one_side_has_alone_stay(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (None, "y", 1.0)], "k long, term string, weight double")
    b = spark.createDataFrame([(1, "x", 0.25), (1, "z", 0.5), (2, "x", 1.0), (None, "y", 0.5), (None, "w", 0.5)], "k long, term string, weight double")
    once = lm.interpolated(a, b, "k", 0.5, b_once=True)
    exchanged = [x for x in once._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert _same(once, lm.interpolated(a, b, "k", 0.5))
    assert len(exchanged) == 1 and once.count() == 5


@pytest.mark.parametrize("most", [0, 3, 100])
def test_background_of_all_and_cosines_in_place(spark, monkeypatch, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    counts = lm.term_counts(docs, "doc_id")
    probs, default = lm.collection_probs(counts)
    rows = counts.select("doc_id", "term", F.col("tf").cast("double").alias("f")).unionByName(spark.createDataFrame([(1, "unheardof", 2.0)], "doc_id long, term string, f double"))
    assert lm.commonest(probs, most=most).count() <= most
    assert _same(lm.with_background_of_all(rows, probs, default, most=most), lm.with_background(rows, probs, default))
    topics = counts.withColumn("topic", F.concat(F.lit("t"), F.col("doc_id") % 7)).groupBy("topic", "term").agg(F.sum("tf").alias("w"))
    topics = topics.unionByName(spark.createDataFrame([("alone", "unheardof", 3), ("far", "nowhere", 1)], "topic string, term string, w long"))
    model = lm.mixture(lm.with_background(rows, probs, default), "doc_id").where("prob > 0")
    plans = []
    monkeypatch.setattr(lm, "cosines", lambda *x, f=lm.cosines: plans.append(x) or f(*x))
    six = lambda x: x.select("doc_id", "topic", F.round("cosine", 6).alias("cosine"))
    wanted = six(lm.cosines(model, topics.withColumnRenamed("w", "prob"), "doc_id", "topic", "prob"))
    assert _same(six(lm.mixture_cosines(rows, topics, probs, default, "doc_id", "topic", weight="w", most=most)), wanted) and wanted.count() > 300
    assert len(plans) == 1  # only that of what is wanted: products of terms are no rows
    monkeypatch.setattr(lm, "MOST_ARRAY", 3)  # more topics than an array takes
    assert _same(six(lm.mixture_cosines(rows, topics, probs, default, "doc_id", "topic", weight="w", most=most)), wanted)
