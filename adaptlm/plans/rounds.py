"""Queries that write what they make of the tables and read it again: index, history, log, pages, feeds, trees, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adaptlm.operators import lm, scans, topics
from adaptlm.plans.catalog import DOCS, TURNS, _turns, query
from adaptlm.sources import texts, xmltree
from adaptlm.sources.history import History
from adaptlm.sources.segments import InvertedIndex
from adaptlm.sources.tables import shared_folder, table
from adaptlm.streaming import keyed, streams


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, gone with the session."""
    path = f"{shared_folder(spark)}/adaptlm/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


# --- scans in ranges ---

_RUNS = """WITH l AS (SELECT user_id, ts, event_id, lag(ts) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, ts, event_id, sum(CASE WHEN last IS NULL OR epoch_us(ts) // 1000000 - epoch_us(last) // 1000000 > 1800 {more} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l)"""


@query("SELECT event_id, user_id, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def ranged_links(spark: SparkSession, d: str) -> DataFrame:
    return scans.linked(table(spark, d, "events"), "user_id", "event_id", "ts", "event_id").select("event_id", "user_id", "prev", "next")


@query(f"{_RUNS.format(more='')} SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run")
def ranged_sessions(spark: SparkSession, d: str) -> DataFrame:
    return scans.session_windows(table(spark, d, "events"), "user_id", "ts", 1800, "event_id")


@query(f"{_RUNS.format(more=chr(79) + 'R (ts > TIMESTAMP ' + chr(39) + '2024-01-10 12:00:00' + chr(39) + ' AND last < TIMESTAMP ' + chr(39) + '2024-01-10 12:00:00' + chr(39) + ')')} SELECT event_id, run::BIGINT AS run FROM r")
def ranged_forced_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    marks = e.select("user_id").distinct().withColumn("ended", F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"))
    return scans.forced_runs(e, marks, "user_id", "ts", 1800, "event_id").select("event_id", "run")


# --- an index that grows ---


@query(f"WITH {DOCS} SELECT term, count(*) AS docs, sum(tf)::BIGINT AS tokens FROM d GROUP BY 1")
def grown_index(spark: SparkSession, d: str) -> DataFrame:
    """An index built on the documents of two languages, grown by the others, with one file replaced in between."""
    docs, source = table(spark, d, "documents").select("doc_id", "text", "lang"), _folder(spark, "documents")
    first = F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))
    docs.where(first).write.parquet(f"{source}/part=1")
    docs.where(first).limit(1).write.parquet(f"{source}/part=2")
    index = InvertedIndex(spark, f"{source}/*", _folder(spark, "grown"))
    index.refresh()
    docs.where(~first).write.mode("overwrite").parquet(f"{source}/part=2")
    index.refresh()
    return index.postings().groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("tokens")).join(index.terms().select("term"), "term")


# --- a history ---


def _history(spark: SparkSession, d: str) -> History:
    """The turns of users as searches (a conversation is a user), with the events of the event table that have a turn's number."""
    h = History(spark, _folder(spark, "history"))
    turns = _turns(spark, d)
    at = F.timestamp_seconds("ts").cast("timestamp_ntz")
    searches = turns.select(F.col("search_id").cast("string"), F.col("user_id").cast("string"), F.col("search_id").cast("string").alias("session_id"), F.col("text").alias("query"), at.alias("ts"))
    half = F.col("search_id").cast("long") % 2 == 0
    h.append("even", searches=searches.where(half))
    h.append("odd", searches=searches.where(~half))
    h.append("even", searches=searches)  # is there already
    return h


@query("""WITH s AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, text FROM conversations WHERE role = 'user')
SELECT id::VARCHAR AS search_id, conv_id::VARCHAR AS user_id, CASE WHEN turn >= 4 THEN (conv_id * 1000)::VARCHAR WHEN turn >= 2 THEN 'b' ELSE id::VARCHAR END AS session_id, text AS query, to_timestamp(turn * 600)::TIMESTAMP AS ts FROM s""")
def history_searches(spark: SparkSession, d: str) -> DataFrame:
    """Searches of a history of two units, with session ids set twice."""
    h = _history(spark, d)
    s = h.table("searches").select("search_id", "user_id")
    turn = F.col("search_id").cast("long") % 1000
    h.set_sessions("s1", s.where(turn >= 2).select("search_id", F.lit("b").alias("session_id")))
    h.set_sessions("s2", s.where(turn >= 4).select("search_id", (F.floor(F.col("search_id").cast("long") / 1000) * 1000).cast("string").alias("session_id")))
    return h.table("searches")


@query(f"WITH {TURNS}, n AS (SELECT search_id, term, tf / sum(tf) OVER (PARTITION BY search_id) AS prob FROM t), a AS (SELECT max(turn) AS top FROM conversations WHERE role = 'user') SELECT search_id::VARCHAR AS search_id, term, round(prob, 3) + 0.0 AS prob FROM n, a WHERE (top - search_id % 1000) * 600 >= 1800")
def history_models(spark: SparkSession, d: str) -> DataFrame:
    """The models that are saved of expired searches, by the encoded text of a model, which has three digits; what is saved twice stays as it was."""
    h = _history(spark, d)
    m = lm.normalised(lm.term_counts(_turns(spark, d), "search_id").select(F.col("search_id").cast("string").alias("search_id"), "term", F.col("tf").alias("prob")), "search_id", "prob")
    now = h.table("searches").agg(F.max("ts")).first()[0]
    h.save_models("m1", m, now)
    h.save_models("m2", m.withColumn("prob", F.lit(1.0)), now)
    return h.models()[0].select("search_id", "term", (F.round("prob", 3) + F.lit(0.0)).alias("prob"))


@query("""WITH s AS (SELECT conv_id, count(*) AS n, min(conv_id * 1000 + turn) AS first FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT first AS topic_id, conv_id::VARCHAR AS user_id, CASE WHEN conv_id % 3 = 0 THEN 'second' ELSE 'first' END AS value, n AS searches FROM s WHERE n >= 2 AND conv_id % 3 <> 1""")
def history_topics(spark: SparkSession, d: str) -> DataFrame:
    """A topic for each user with two searches or more; then some users get it anew, and others a topic too small to stay."""
    h = _history(spark, d)
    s = h.table("searches").select("search_id", "user_id", F.col("search_id").cast("long").alias("n"))
    per = s.groupBy("user_id").agg(F.min("n").alias("topic_id"), F.count(F.lit(1)).alias("sessions"))
    made = lambda rows, value: rows.select("topic_id", F.lit("round").alias("name"), F.lit(value).alias("value"), "user_id")
    members = lambda rows: s.join(rows.select("user_id", "topic_id"), "user_id").select("topic_id", "search_id", F.lit(1.0).alias("weight"), "user_id")
    h.replace_topics("t1", made(per, "first"), members(per), per, least=2)
    third = per.where(F.col("user_id").cast("long") % 3 == 0)
    h.replace_topics("t2", made(third, "second"), members(third), third, least=2)
    gone = per.where(F.col("user_id").cast("long") % 3 == 1)
    h.replace_topics("t3", made(gone, "third"), members(gone), gone.withColumn("sessions", F.lit(1)), least=2)
    h.compact()
    return h.table("topics").join(h.table("topic_searches"), ["topic_id", "user_id"]).groupBy("topic_id", "user_id", "value").agg(F.count(F.lit(1)).alias("searches"))


# --- logs, pages, feeds, trees ---


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, event_id % 4 = 0 AS q FROM events WHERE user_id % 20 = 3),
n AS (SELECT *, sum(q::INT) OVER w AS n, last_value(CASE WHEN q THEN s END IGNORE NULLS) OVER w AS began FROM e WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT s AS ts, CASE WHEN q THEN 'query' ELSE 'click' END AS kind, CASE WHEN q THEN 'event ' || event_id END AS query, CASE WHEN NOT q THEN (event_id % 10 + 1)::INT END AS pos, began || '.' || n AS search_id FROM n WHERE began IS NOT NULL""")
def imported_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of some users' events, written as lines by their ids and read again: their order, not that of time, says whose a click is."""
    e = table(spark, d, "events").where("user_id % 20 = 3").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    line = F.concat_ws("\t", F.col("s").cast("string"), F.when(F.col("event_id") % 4 == 0, F.lit("query")).otherwise("click"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("event "), "event_id")).otherwise((F.col("event_id") % 10 + 1).cast("string")))
    folder = _folder(spark, "log")
    e.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(folder)
    return texts.imported_searches(texts.read_search_log(spark, folder), "u").select("ts", "kind", "query", "pos", "search_id")


def _one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[^A-Za-z0-9]+", " "))


_PAGES = r"""WITH x AS (SELECT doc_id, trim(regexp_replace(left(text, 60), '[^A-Za-z0-9]+', ' ', 'g')) AS t FROM documents),
y AS (SELECT doc_id // 10 AS page, doc_id % 10 AS i, doc_id, t FROM x WHERE t <> '' AND doc_id % 7 <> 0)
SELECT page, ((page % 5) * 10 + 1 + row_number() OVER (PARTITION BY page ORDER BY i) - 1)::INT AS pos, t AS title, 'http://h/' || doc_id || '?a&b' AS url, 'about <' || doc_id || '>' AS summary, 'h/' || doc_id AS shown_url, {mime} AS mime_type, (1000 + page)::BIGINT AS total, {spell} AS suggestion FROM y"""


def _paged(spark: SparkSession, d: str, item: list, head: list) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 10).alias("page"), _one_line(F.substring("text", 1, 60)).alias("t"))
    url = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("http://h/"), F.col("doc_id"), F.lit("?a&amp;b")))
    part = {"url": url, "title": F.col("t"), "id": F.col("doc_id").cast("string"), "summary": F.concat(F.lit("about &lt;"), F.col("doc_id"), F.lit("&gt;"))}
    rows = x.where("page IS NOT NULL").select("page", "doc_id", F.concat(*(part[p] if p in part else F.lit(p) for p in item)).alias("s"))
    whole = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("s", F.lit("")).alias("s")))), lambda r: r["s"]), "\n").alias("items"))
    facts = {"start": (F.col("page") % 5 * 10 + 1).cast("string"), "total": F.format_number(F.col("page") + 1000, 0)}
    return whole.select("page", F.concat(*(facts[h] if h in facts else F.lit(h) for h in head), "items").alias("html"))


@query(_PAGES.format(mime="''", spell="'spark'"))
def parsed_result_pages(spark: SparkSession, d: str) -> DataFrame:
    """Result pages made of the documents, read: items without address take no rank."""
    pages = _paged(spark, d, ['<li class="sa_wr"><h3><a class="t" href="', "url", '" id="', "id", '">', "title", "</a></h3><p>", "summary", "</p><cite>h/", "id", "</cite></li>"], ['<span class="c" id="count">', "start", "-99 of ", "total", ' results</span>Including results for <a href="/s">sp<b>ar</b>k</a>'])
    return texts.result_entries(pages, "page")


@query(_PAGES.format(mime="'PDF'", spell="'spark'"))
def parsed_aol_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = _paged(spark, d, ['<li about="r', "id", '"><a href="', "url", '" property="f:title">', "title", '</a><p property="f:desc">', "summary", '</p><span property="f:durl">h/', "id", '</span><span class="mimetype">[PDF]</span></li>'], ['<span id="lowerLimit">', "start", '</span><span id="upperLimit">99</span> of <b>', "total", '</b>Did you mean: <a href="/s">spark</a>'])
    return texts.aol_entries(pages, "page")


_CLEAN = r"regexp_replace({c}, '[\x00-\x08\x0B-\x1F\x{{FFFE}}\x{{FFFF}}]', ' ', 'g')"


def _clean(c: str) -> Column:
    """Characters that XML has none of become spaces."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]", " ")


@query(f"""WITH c AS (SELECT conv_id, turn, role, {_CLEAN.format(c='text')} AS t FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS j FROM c)
SELECT conv_id, count(*) AS turns, coalesce(max(CASE WHEN role = 'user' AND j = 1 THEN turn END), -1)::INT AS first_user, coalesce(string_agg(t, '' ORDER BY turn), '') AS text FROM n GROUP BY 1""")
def conversation_trees(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as XML, read into nodes, changed (a note under each root, then removed from the text again), and searched."""
    turn = F.concat(F.lit('<turn n="'), F.col("turn"), F.lit('" role="'), F.col("role"), F.lit('">'), xmltree.escaped(F.coalesce(_clean("text"), F.lit(""))), F.lit("</turn>"))
    xml = table(spark, d, "conversations").select("conv_id", "turn", turn.alias("s")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]), "").alias("s"))
    tree = xmltree.nodes(xml.select("conv_id", F.concat(F.lit("<conv>"), "s", F.lit("</conv>")).alias("xml")), "conv_id")
    edits = tree.where("parent = 0").select("conv_id", F.col("pre").alias("where"), F.explode(F.array(F.struct(F.lit(1).alias("number"), F.lit("first").alias("operation"), F.lit("<note>x</note>").alias("a")), F.struct(F.lit(2).alias("number"), F.lit("attribute").alias("operation"), F.lit("id").alias("a")))).alias("e"))
    tree = xmltree.nodes(xmltree.rebuilt(tree, "conv_id", edits.select("conv_id", "where", "e.*", F.when(F.col("e.number") == 2, F.col("conv_id").cast("string")).alias("b"))), "conv_id")
    note = tree.where("name = 'note'").select("conv_id", F.col("pre").alias("where"), F.lit(1).alias("number"), F.lit("remove").alias("operation"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    tree = xmltree.nodes(xmltree.rebuilt(tree, "conv_id", note), "conv_id")
    tree = tree.join(tree.where("parent = 0 AND attrs['id'] = CAST(conv_id AS string)").select("conv_id"), "conv_id", "left_semi")
    roots = tree.where("parent = 0").select("conv_id", F.col("pre").alias("at"), F.col("pre").alias("top"))
    first = xmltree.found(roots, tree, "conv_id", "turn", "role", "user").select("conv_id", F.expr("int(attrs['n'])").alias("first_user"))
    turns = xmltree.walked(roots, tree, "conv_id", "descend-first").where("kind = 'element'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    text = xmltree.inner_text(roots, tree, "conv_id").select("conv_id", "text")
    return turns.join(text, "conv_id").join(first, "conv_id", "left").select("conv_id", "turns", F.coalesce("first_user", F.lit(-1)).alias("first_user"), "text")


@query(f"""WITH x AS (SELECT doc_id, {_CLEAN.format(c='text')} AS t FROM documents) SELECT 'd' || doc_id AS doc_id, 'http://x/' || doc_id AS url, md5(trim(t, ' ' || chr(9) || chr(10))) AS summary, (TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * doc_id) AS date FROM x WHERE NOT regexp_matches(t, '<[A-Za-z/!]') AND trim(t, ' ' || chr(9) || chr(10)) <> ''""")
def feed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Feeds of twenty documents each, read into documents; summaries by their digest."""
    x = table(spark, d, "documents").select("doc_id", _clean("text").alias("t")).where("doc_id IS NOT NULL AND t IS NOT NULL")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    item = F.concat(F.lit("<item><guid>d"), F.col("doc_id"), F.lit("</guid><title>t</title><description>"), xmltree.escaped(F.col("t")), F.lit("</description><link>http://x/"), F.col("doc_id"), F.lit("</link><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    feeds = x.groupBy(F.floor(F.col("doc_id") / 20).alias("feed")).agg(F.array_join(F.collect_list(item), "").alias("s")).select(F.concat(F.lit("<rss><channel>"), "s", F.lit("</channel></rss>")).alias("xml"))
    plain = x.where(~F.col("t").rlike("<[A-Za-z/!]")).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"))
    rows = texts.feed_items(feeds).join(plain, "doc_id", "left_semi").withColumn("s", F.regexp_replace("summary", r"^[ \t\n]+|[ \t\n]+$", "")).where("s <> ''")
    return rows.select("doc_id", "url", F.md5("s").alias("summary"), F.col("date").cast("timestamp_ntz").alias("date"))


# --- streams ---


@query("SELECT doc_id, lang FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id, lang")
def streamed_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream of two files that share rows, each document once."""
    docs, folder = table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", "lang"), _folder(spark, "stream")
    docs.write.parquet(f"{folder}/in")
    docs.where("doc_id % 3 = 0").write.mode("append").parquet(f"{folder}/in")
    streams.to_table(streams.unique_documents(streams.file_stream(spark, f"{folder}/in", docs.schema)), f"{folder}/out", f"{folder}/c").awaitTermination()
    return spark.read.schema(docs.schema).parquet(f"{folder}/out")


@query(f"""WITH RECURSIVE {TURNS}, tn AS (SELECT search_id, sqrt(sum(tf * tf)) AS n FROM t GROUP BY 1),
e AS (SELECT a.search_id AS a, b.search_id AS b FROM t a JOIN t b ON a.term = b.term AND a.search_id < b.search_id AND a.search_id // 1000 = b.search_id // 1000 JOIN tn x ON x.search_id = a.search_id JOIN tn y ON y.search_id = b.search_id WHERE abs(a.search_id - b.search_id) * 600 <= 1800 GROUP BY 1, 2 HAVING round(sum(a.tf * b.tf) / any_value(x.n * y.n), 12) >= 0.05),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT conv_id * 1000 + turn AS node, conv_id * 1000 + turn AS other FROM conversations WHERE role = 'user' UNION SELECT r.node, u.b FROM reach r JOIN u ON r.other = u.a)
SELECT node AS search_id, min(other::VARCHAR) AS session_id FROM reach GROUP BY 1""")
def streamed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the turns as they come in a stream of three batches, each user's in any order."""
    turns, folder = _turns(spark, d), _folder(spark, "sessions")
    terms = lm.term_counts(turns, "search_id").groupBy("search_id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("tf").cast("double")))).alias("terms"))
    rows = turns.select("user_id", "search_id", (F.col("ts").cast("long") + 86400).alias("ts")).join(terms, "search_id", "left").select("user_id", "search_id", "ts", "terms")
    keyed.rocksdb(spark)
    stream = None
    for k in range(3):
        rows.where(F.pmod(F.xxhash64("search_id"), F.lit(3)) == k).write.mode("append").parquet(f"{folder}/in")
        stream = stream or keyed.session_log(streams.file_stream(spark, f"{folder}/in", rows.schema), 1800, 0.05, "2 days")
        streams.to_table(stream, f"{folder}/out", f"{folder}/c").awaitTermination()
    return keyed.sessions_of(spark.read.parquet(f"{folder}/out"))


@query("SELECT user_id, topic, (row_number() OVER (PARTITION BY user_id ORDER BY n DESC, topic))::INT AS rank FROM (SELECT user_id, event_type AS topic, count(*) AS n FROM events GROUP BY 1, 2)")
def user_topic_ranks(spark: SparkSession, d: str) -> DataFrame:
    stats = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("queries")).withColumns({c: F.lit(0) for c in ("sessions", "unique_queries", "clicks", "unique_clicks")})
    return topics.listed(stats, "query", user="user_id").select("user_id", "topic", "rank")
