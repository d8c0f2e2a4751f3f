"""Worked cases of the functions and operators."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from adaptlm.config import read_settings, settings_from
from adaptlm.functions import codecs as C
from adaptlm.functions import text as T
from adaptlm.functions.porter import stem
from adaptlm.operators import em, events, lm, models, rank, sessions, topics
from adaptlm.sources import texts as S


def one(spark, expr, value=""):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens, "Hi-foo_b1 éa2 x") == ["Hi", "foo", "b1", "éa2", "x"]
    assert one(spark, T.plain_tokens, "Hi-foo_b1 éa2 x") == ["Hi", "foo", "b1", "x"]
    assert one(spark, T.tokens, "") == []


def test_keywords(spark):
    k = one(spark, T.keywords, '+spark -flink site:apache.org "big data" sql')
    assert [x.flag for x in k] == ["INCLUDE", "EXCLUDE", "SITE", "NONE", "NONE"] and k[3].words == ["big", "data"]
    assert one(spark, lambda c: T.query_text(T.keywords(c)), '+spark -flink site:apache.org "big data" sql') == "spark big data sql"
    assert len(one(spark, T.keywords, '-"a b"')) == 2


@pytest.mark.parametrize(("word", "want"), [x.split(">") for x in "hopping>hop tanned>tan falling>fall hissing>hiss fizzed>fizz filing>file happy>happi sky>sky relational>relat conditional>condit rational>ration probate>probat rate>rate cease>ceas controll>control roll>roll languages>languag ies>i caresses>caress ponies>poni agreed>agre plastered>plaster motoring>motor sized>size digitizer>digit triplicate>triplic adoption>adopt is>is Be>be".split()])
def test_stem(word, want):
    assert stem(word) == want


def test_markup(spark):
    assert one(spark, T.strip_html, "<b>x</b> > y") == "x  y" and one(spark, T.strip_html, "a<b") == "a"
    assert one(spark, T.display_url, "http://www.example.edu/") == "www.example.edu"
    assert one(spark, T.display_url, "https://example.com/" + "x" * 60) == ("example.com/" + "x" * 60)[:50] + "..."
    assert one(spark, T.unquote, "&amp;lt; &gt;&quot;&apos;") == "&lt; >\"'" and one(spark, T.quote, "<&>") == "&lt;&amp;&gt;"
    assert one(spark, T.bold_as_strong, "<i><b>x</b></i>") == "<strong>x</strong>"
    assert one(spark, T.media_type, "a/b.css") == "text/css" and one(spark, T.media_type, "a/b") == "application/octet-stream"
    assert one(spark, T.cookies, "a=1; b=2; a=3") == {"a": "3", "b": "2"}
    assert one(spark, T.count_value, "1,234") == 1234 and one(spark, T.count_value, "x") is None
    assert one(spark, T.sql_literal, "a'b\\") == "a''b\\\\"


def test_urls(spark):
    p = one(spark, T.url_parts, "http://www.x.com:80/a/b?n=1&m=2#t")
    assert tuple(p) == ("http", "www.x.com", "80", "/a/b", "n=1&m=2", "t")
    assert tuple(one(spark, T.url_parts, "/search?x=1"))[3:5] == ("/search", "x=1")
    assert set(one(spark, T.url_parts, "http://h/")) == {""} == set(one(spark, T.url_parts, "/?q=1"))
    assert [tuple(x) for x in one(spark, T.query_params, "a=1&b=&c")] == [("a", "1"), ("b", "")]
    assert one(spark, lambda c: T.build_query(T.query_params(c)), "a=1&b=2") == "a=1&b=2"
    assert one(spark, T.url_encode, "a b*~é") == "a+b%2A~%C3%A9" and one(spark, T.url_decode, "%zz") is None


def test_codecs(spark):
    assert tuple(one(spark, C.parse_doc_name, "12.3_x")) == ("12.3", 0) and tuple(one(spark, C.parse_doc_name, "12.3_4")) == ("12.3", 4)
    assert str(one(spark, C.parse_rfc822, "Sun, 06 Nov 1994 08:49:37 GMT")) == "1994-11-06 08:49:37" and one(spark, C.parse_rfc822, "x") is None
    m = spark.createDataFrame([("s", "a\t0.500\nb\tx\nc\t0.25")], "k string, value string")
    assert [(r.term, r.prob) for r in C.decode_model(m, "k").collect()] == [("a", 0.5)]
    e = spark.createDataFrame([("click", "2\thttp://e/"), ("rate", "3\tY"), ("view", "base\t1\t10"), ("click", "x\tu")], "kind string, value string").select(C.decode_event(F.col("kind"), F.col("value")).alias("x"))
    assert [tuple(r.x) for r in e.collect()] == [(2, "http://e/", None, None, None, None), (3, None, "Y", None, None, None), (None, None, None, "base", 1, 10), (None, "u", None, None, None, None)]


def test_settings():
    s = settings_from(read_settings("em_iterations = 7 # x\r\n# y\nmin_cosine=0.5\nother = 1"))
    assert s.em_iterations == 7 and s.min_cosine == 0.5


def test_truncate(spark):
    m = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.3), (1, "c", 0.15), (1, "d", 0.05), (2, "a", 0.9), (2, "b", 0.0995), (2, "c", 0.0005)], "k int, term string, prob double")
    assert sorted(r.term for r in lm.truncated(m, "k", "prob", 10, 0.01, 0.9).where("k = 1").collect()) == ["a", "b", "c"]
    assert sorted(r.term for r in lm.truncated(m, "k").where("k = 2").collect()) == ["a", "b"]


def test_kl_scores(spark):
    q = spark.createDataFrame([(1, "spark", 1.0), (1, "sql", 1.0)], "q int, term string, weight double")
    d = spark.createDataFrame([(1, "spark", 2), (1, "sql", 1), (2, "spark", 1), (2, "stream", 3), (3, "stream", 1)], "d int, term string, tf int")
    bg, default = spark.createDataFrame([("spark", 0.01), ("sql", 0.02)], "term string, prob double"), spark.createDataFrame([(0.001,)], "default_prob double")
    got = {r.d: round(r.score, 6) for r in lm.kl_scores(q, d, bg, default, "q", "d", 100.0).collect()}
    assert got == {1: -3.536117, 2: -3.951244}


@pytest.mark.parametrize(("p3", "want"), [(0.06, [0.438245, 0.208164, 0.205409, 0.148182]), (0.3, [0.540950, 0.276633, 0.0, 0.182417])])
def test_mixture(spark, p3, want):
    rows = spark.createDataFrame([(1, "a", 3.0, 0.001), (1, "b", 2.0, 0.01), (1, "c", 5.0, p3), (1, "d", 1.0, 0.0001)], "k int, term string, f double, p double")
    assert [round(r.prob, 6) for r in lm.mixture(rows, "k").orderBy("term").collect()] == want


def test_cosine(spark):
    a = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.4)], "x int, term string, weight double")
    b = spark.createDataFrame([(2, "b", 0.5), (2, "c", 0.5)], "y int, term string, weight double")
    assert round(lm.cosines(a, b, "x", "y").first().cosine, 6) == 0.392232
    assert lm.cosines(a, b.limit(0), "x", "y").count() == 0
    assert spark.range(1).select(lm.dense_cosine(F.array().cast("array<double>"), F.array(F.lit(1.0))).alias("c")).first().c == 0


def test_em(spark):
    rows = spark.createDataFrame([(1, [0.5, 0.3, 0.2], [[0.7, 0.3, 0.0], [0.01, 0.01, 0.02], [0.2, 0.3, 0.5]], [0.1, 0.9, 0.0])], "k int, target array<double>, components array<array<double>>, priors array<double>")
    r = em.mixing_weights(rows, "k").first()
    assert [round(w, 6) for w in r.weights] == [0.370511, 0.468681, 0.160808] and r.steps == 16


def test_average_link():
    sims = [(0, 1, 0.9), (1, 2, 0.4), (0, 2, 0.2), (3, 4, 0.15), (2, 3, 0.05)]
    assert topics.average_link(sims, [0, 1, 2, 3, 4, 5]) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_runs(spark):
    t = spark.createDataFrame([(1, 1, 0), (1, 2, 1800), (1, 3, 3601)], "u int, e int, s int").select("u", "e", F.expr("timestampadd(SECOND, s, timestamp_ntz '2024-01-01 00:00:00')").alias("ts"))
    assert [r.run for r in events.gap_runs(t, "u", "ts", 1800, "e").orderBy("e").collect()] == [1, 1, 2]
    marks = spark.sql("SELECT 1 AS u, timestamp_ntz '2024-01-01 00:10:00' AS ended")
    assert [r.run for r in events.forced_runs(t, marks, "u", "ts", 1800, "e").orderBy("e").collect()] == [1, 2, 3]
    assert events.time_based_session(t, "u", "e", "ts", "ts").where("anchor = 1").count() == 2


def test_rerank(spark):
    base = spark.range(1, 7).select(F.lit(1).alias("k"), F.col("id").alias("pos"))
    viewed = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "k int, pos long, seq int")
    scores = spark.createDataFrame([(1, 5, 4.0), (1, 2, 3.0), (1, 4, 2.0), (1, 6, 1.0)], "k int, pos long, score double")
    order = lambda df: [r.pos for r in df.orderBy("rank").collect()]
    assert order(rank.rerank(base, viewed, scores, "k", promote=1)) == [1, 2, 5, 3, 4, 6]
    assert order(rank.rerank(base, viewed, scores, "k", all_results=True)) == [5, 2, 4, 6, 1, 3]


def test_pages(spark):
    c = spark.createDataFrame([(25, 1), (25, 21)], "n int, s int").select(rank.page_counters(F.col("n"), F.col("s")).alias("c")).collect()
    assert [tuple(r.c) for r in c] == [(1, 10, 11, None), (21, 25, None, 11)]
    assert spark.range(1).select(rank.page_starts(F.lit(8), F.lit(5)).alias("x")).first().x == [1, 11]
    have = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "k int, pos int")
    assert not rank.covered(have, "k", 1, 4).first().complete and rank.covered(have, "k", 1, 2).first().complete and not rank.covered(have, "k", 0, 1).first().complete
    assert [r.pos for r in rank.base_ranking(have, "k").orderBy("pos").collect()] == [1, 2, 3, 4]


def test_ratings(spark):
    e = spark.createDataFrame([(1, 1, "Y", 1), (1, 1, "N", 2), (1, 1, "", 3), (1, 2, "Y", 1), (1, 2, "N", 2)], "s int, pos int, rating string, ts int")
    assert [(r.pos, r.rating) for r in events.last_write(e, ["s", "pos"], "rating", "ts").collect()] == [(2, "N")]


def test_neighbour_cap(spark):
    n = 12
    session = spark.createDataFrame([("x", f"s{i}") for i in range(n)], "k string, o string")
    scores = spark.createDataFrame([("x", f"h{i}", 0.9 - i / 10) for i in range(5)], "k string, o string, cosine double")
    clicked = spark.createDataFrame([(f"s{i}",) for i in range(n)] + [(f"h{i}",) for i in range(5)], "k string")
    assert models.neighbours(scores, session, clicked, "k", "o").count() == 13


def test_components(spark):
    nodes = spark.range(12).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 4), (7, 7)] + [(8, 9), (9, 10)], "a long, b long")
    got = {r.node: r.root for r in sessions.min_labels(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 8, 10: 8, 11: 11}


def test_readers(spark, tmp_path):
    (tmp_path / "log").write_text("# c\n\n100\tquery\tspark streaming\n130\tclick\t2\n200\tquery\tx\n")
    log = S.imported_searches(S.read_search_log(spark, str(tmp_path / "log")), "u").orderBy("ts").collect()
    assert [(r.kind, r.query, r.pos, r.search_id) for r in log] == [("query", "spark streaming", None, "100.1"), ("click", None, 2, "100.1"), ("query", "x", None, "200.2")]
    # the order of lines holds, not that of seconds: a click in the second of a later query goes to the query before it
    (tmp_path / "log2").write_text("5\tclick\t1\n100\tquery\ta\n200\tclick\t1\n200\tquery\tb\n201\tclick\t2\n300\tquery\tno page\n301\tclick\t9\n")
    log = S.read_search_log(spark, str(tmp_path / "log2"))
    got = S.imported_searches(log, "u").orderBy("file", "block", "line").collect()
    assert [(r.ts, r.kind, r.search_id) for r in got] == [(100, "query", "100.1"), (200, "click", "100.1"), (200, "query", "200.2"), (201, "click", "200.2"), (300, "query", "300.3"), (301, "click", "300.3")]
    results = spark.createDataFrame([(100, 1, "http://a"), (200, 1, "http://b"), (200, 2, "http://c")], "ts long, pos int, url string")
    got = S.imported_searches(log, "u", results).orderBy("file", "block", "line").collect()
    assert [(r.ts, r.search_id, r.url) for r in got] == [(100, "100.1", None), (200, "100.1", "http://a"), (200, "200.2", None), (201, "200.2", "http://c"), (301, "200.2", "")]
    lines = [f"{10 * i}\tquery\tq{i}" if i % 7 == 0 else f"{10 * i}\tclick\t{i}" for i in range(4000)]
    for part in range(2):
        (tmp_path / f"many{part}").write_text("\n".join(lines[part * 2000 : part * 2000 + 2000]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # files in many blocks
    try:
        log = S.read_search_log(spark, str(tmp_path / "many*"))
        got = S.imported_searches(log, "u").collect()
        assert log.rdd.getNumPartitions() > 10 and len({r.block for r in got}) > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.ts: r.search_id for r in got} == {10 * i: f"{10 * (i - i % 7)}.{i // 7 + 1}" for i in range(4000)}
    (tmp_path / "bad").write_text("100\tother\n")
    with pytest.raises(Exception, match="bad log line"):
        S.read_search_log(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "stats").write_text("3\t10\nlanguag\t4\nx\t5\ny\t1\n")
    probs, default = S.read_collection_stats(spark, str(tmp_path / "stats"))
    assert {r.term: round(r.prob, 6) for r in probs.collect()} == {"languag": round(5 / 13, 6), "x": round(6 / 13, 6), "y": round(2 / 13, 6)} and round(default.first().default_prob, 6) == round(1 / 13, 6)
    feed = spark.createDataFrame([("<rss><channel><item><guid>g</guid><title>t</title><description>&lt;b&gt;x&lt;/b&gt; y</description><link>l</link><pubDate>Sun, 06 Nov 1994 08:49:37 GMT</pubDate></item><item><guid></guid><title>no</title></item></channel></rss>",)], "xml string")
    assert [(r.doc_id, r.summary, str(r.date)) for r in S.feed_items(feed).collect()] == [("g", "x y", "1994-11-06 08:49:37")]
    answer = spark.createDataFrame([('<r><resultset_web totalhits="9" start="10"><result><title>A</title><abstract>B</abstract><url>u</url><clickurl>c</clickurl></result></resultset_web></r>',)], "xml string")
    assert [tuple(r) for r in S.web_results(answer).collect()] == [(11, "A", "B", "u", "c")]
    item = lambda attrs, title, rest="": f'<li class="sa_wr"><h3><a {attrs}>{title}</a></h3>{rest}</li>'
    html = '<span class="x" id="count">11-20 of 1,234 results</span>Including results for <a href="s">sp<b>ar</b>k</a><ol>' + item('class="t" href="http://x/?a&amp;b"', "T <b>i</b>", "<p>S &amp; s</p><cite>x</cite>") + item('class="u"', "no address") + item('href="http://y/" onmousedown="z"', "U") + item('href="http://z/"', "") + "</ol>"
    page = spark.createDataFrame([(1, html), (2, item('href="h"', "t")), (3, "nothing"), (4, None)], "page_id int, html string")
    assert sorted(tuple(r) for r in S.result_entries(page, "page_id").collect()) == [
        (1, 11, "T i", "http://x/?a&b", "S & s", "x", "", 1234, "spark"), (1, 12, "U", "http://y/", "", "", "", 1234, "spark"), (2, 0, "t", "h", "", "", "", None, ""),
    ]


def test_scores_do_not_shuffle_pairs(spark):
    q = spark.createDataFrame([(k, f"t{k * i % 7}", 1 + i % 3) for k in range(9) for i in range(4)], "q long, term string, weight long").groupBy("q", "term").agg(F.sum("weight").alias("weight"))
    d = spark.createDataFrame([(k, f"t{i}", 1 + k % 3) for k in range(40) for i in range(k % 8)] + [(None, "t1", 1)], "d long, term string, tf long")
    bg, default = lm.collection_probs(d)
    few = lm.kl_scores(q, d, bg, default, "q", "d", 100.0)
    assert not re.search(r"hashpartitioning\((q#\w+, d#|d#\w+, q#)", few._jdf.queryExecution().executedPlan().toString())
    many = lm.kl_scores(q, d, bg, default, "q", "d", 100.0, most_sent=0)
    rows = lambda df: sorted((r.q, r.d, round(r.score, 9)) for r in df.collect())
    assert len(rows(few)) > 50 and rows(few) == rows(many) == rows(lm.kl_scores(q, d, bg, default, "q", "d", 100.0, d_lengths=lm.lengths(d, "d")))


def test_pair_cosines_by_blocks(spark):
    t = spark.createDataFrame([(k, f"t{k * i % 11}") for k in range(1, 40) for i in range(k % 7)], "k long, term string").groupBy("k", "term").agg(F.count(F.lit(1)).alias("weight"))
    rows = lambda df: sorted((r.a, r.b, round(r.cosine, 9)) for r in df.collect())
    want = rows(lm.cosines(t, t.withColumnRenamed("k", "l"), "k", "l").where("k < l").selectExpr("k AS a", "l AS b", "cosine"))
    split = lm.pair_cosines(t, "k", block=5)
    assert len(want) > 100 and rows(split) == want == rows(lm.pair_cosines(t, "k"))
    assert not re.search(r"hashpartitioning\((_i#\w+, _j#\w+, k1#|k1#|k2#)", split._jdf.queryExecution().executedPlan().toString())


def test_vectors_are_shuffled_and_not_their_terms(spark):
    t = spark.createDataFrame([(f"k{k}", f"t{k * i % 11}", float(i % 3 - 1)) for k in range(1, 30) for i in range(1, 6)], "k string, term string, weight double").groupBy("k", "term").agg(F.max("weight").alias("weight"))
    t = t.unionByName(spark.createDataFrame([(f"k{k}", "own", 2.0) for k in range(1, 30)], "k string, term string, weight double"))
    rows = lambda df: sorted((r.a, r.b, round(r.cosine, 9) + 0.0) for r in df.collect())
    want = rows(lm.cosines(t, t.withColumnRenamed("k", "l"), "k", "l").where("k < l").selectExpr("k AS a", "l AS b", "cosine"))
    split = lm.pair_cosines(t, "k", block=4)
    assert len(want) == 29 * 14 and rows(split) == want
    assert not re.search(r"keys=\[_?i#\w+, _?j#\w+, term#", split._jdf.queryExecution().executedPlan().toString())
    assert lm.pair_cosines(t.limit(0), "k").count() == 0


def test_common_and_rare_terms_give_the_same_products(monkeypatch):
    rng = np.random.default_rng(4)
    side = lambda n: (n, np.repeat(np.arange(n), 6), rng.integers(0, 40, n * 6) ** 2 // 40, rng.integers(1, 5, n * 6).astype(float))
    x, y = side(23), side(17)
    whole = lambda e: np.bincount(e[1] * 40 + e[2], e[3], e[0] * 40).reshape(e[0], 40)
    for dense, columns, products in ((0, 512, 9), (10**9, 3, 9), (20, 3, 10**6), (20, 512, 7)):
        monkeypatch.setattr(lm, "DENSE", dense), monkeypatch.setattr(lm, "COLUMNS", columns), monkeypatch.setattr(lm, "PRODUCTS", products)
        assert (lm._dots(x, y, 40) == whole(x) @ whole(y).T).all()



def test_pairs_of_a_group_alone(spark):
    t = spark.createDataFrame([(k // 8, k, f"t{k * i % 11}", i) for k in range(1, 40) for i in range(1, 5)], "g long, k long, term string, weight long").groupBy("g", "k", "term").agg(F.sum("weight").alias("weight"))
    every = lm.pair_cosines(t, "k", block=5).where("a DIV 8 = b DIV 8")
    rows = lambda df: sorted((r.a, r.b, round(r.cosine, 9)) for r in df.collect())
    own = lm.pair_cosines_within(t, "g", "k")
    assert rows(own) == rows(every) and len(rows(own)) > 50 and own.where("g <> a DIV 8 OR g <> b DIV 8").count() == 0



def test_likest_are_the_first_of_all_pairs(spark):
    t = spark.createDataFrame([(k, f"t{k * i % 9 if k % 4 else i}") for k in range(1, 60) for i in range(k % 4 + 2)], "k long, term string").groupBy("k", "term").agg(F.count(F.lit(1)).alias("weight"))
    ends = F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("other")), F.struct(F.col("b").alias("k"), F.col("a").alias("other")))
    every = lm.pair_cosines(t, "k").select(F.explode(ends).alias("e"), F.round("cosine", 6).alias("cosine")).select("e.*", "cosine").where("cosine >= 0.3")
    first = lambda df: sorted(map(tuple, df.withColumn("n", F.expr("row_number() OVER (PARTITION BY k ORDER BY cosine DESC, other)")).where("n <= 3").collect()))
    few = lm.likest(t, "k", "other", 3, 0.3, block=7)
    assert first(few) == first(every) and len(first(few)) > 100 and few.count() < every.count()
    assert first(lm.likest(t, "k", "other", 3, 0.3)) == first(every)


def test_millionths_are_those_of_round(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.random(3000), (rng.integers(0, 10**6, 3000) + 0.5) / 1e6, [0.0, 1.0, 0.0000005, 0.9999995, 2 / 3]])
    want = [r.x for r in spark.createDataFrame([(float(x),) for x in v], "v double").select(F.round("v", 6).alias("x")).collect()]
    assert (lm._millionths(v) / 1e6).tolist() == want
