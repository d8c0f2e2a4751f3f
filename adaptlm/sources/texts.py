"""Readers of text formats: collection statistics, search logs, result pages, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adaptlm.functions.codecs import parse_rfc822
from adaptlm.functions.text import is_html, plain_text, strip_html


def read_collection_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(term, prob) and one row (default_prob) of a file: a line `unique TAB total`, then lines `term TAB count`."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    head = lines.where((F.size("p") == 2) & F.get("p", F.lit(0)).rlike(r"^\d+$") & F.get("p", F.lit(1)).rlike(r"^\d+$")).limit(1)
    head = head.select(F.get("p", F.lit(0)).cast("long").alias("unique"), F.get("p", F.lit(1)).cast("long").alias("total"))
    rows = lines.where((F.size("p") == 2) & ~F.get("p", F.lit(0)).rlike(r"^\d+$")).select(F.get("p", F.lit(0)).alias("term"), F.get("p", F.lit(1)).try_cast("long").alias("count")).where("count is not null")
    probs = rows.crossJoin(F.broadcast(head)).select("term", ((F.col("count") + 1) / (F.col("total") + F.col("unique"))).alias("prob"))  # head is one row
    return probs, head.select((1 / (F.col("total") + F.col("unique"))).alias("default_prob"))


def commonest_terms(counts: DataFrame, most: int) -> DataFrame:
    """term, count of the most frequent terms, by term; ties at the edge by term."""
    return counts.orderBy(F.desc("count"), "term").limit(most).orderBy("term")


#: Fixed value: a line of a search log.
LOG_LINE = r"^(\d+)\t(?:query\t(.*)|click\t(\d+))$"


def read_search_log(spark: SparkSession, path: str) -> DataFrame:
    """ts (seconds), kind (query or click), query, pos of each line, and its place as file, block, line; blank lines and # comments are skipped.

    A line of another form fails the job. A click belongs to the query on the lines before it.
    """
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))  # a block is read by one task, in order
    lines = spark.read.text(path).select("value", *place).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    good = F.col("value").rlike(LOG_LINE)
    lines = lines.withColumn("value", F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad log line: "), F.col("value"))).cast("string")))
    clicked = F.regexp_extract("value", LOG_LINE, 3)
    return lines.select(
        F.regexp_extract("value", LOG_LINE, 1).cast("long").alias("ts"), F.when(clicked == "", "query").otherwise("click").alias("kind"),
        F.when(clicked == "", F.regexp_extract("value", LOG_LINE, 2)).alias("query"), F.when(clicked != "", clicked.cast("int")).alias("pos"), "file", "block", "line",
    )


def imported_searches(log: DataFrame, user: str, results: DataFrame | None = None) -> DataFrame:
    """The log of one user, in the order of its lines (files by path), with search_id: `<seconds of the query>.<its number>`, the same for its clicks; clicks before any query go.

    results (ts, pos, url): the results of the saved pages, by the second of their query. With them, a query without a page is
    skipped, so its clicks go to the query before it, and a click has the url of its rank, empty if there is none. Lines are numbered within
    their block of a file; what a block starts with comes from a row for each block.
    """
    log = log.withColumn("user_id", F.lit(user))
    if results is not None:
        log = log.join(results.select("ts", F.lit(True).alias("_page")).distinct(), "ts", "left").where("kind = 'click' OR _page").drop("_page")
    asked = F.col("kind") == "query"
    blocks = log.groupBy("user_id", "file", "block").agg(F.count_if(asked).alias("_n"), F.max_by(F.when(asked, F.col("ts")), F.when(asked, F.col("line"))).alias("_began"))
    before = Window.partitionBy("user_id").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("user_id", "file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.last("_began", ignorenulls=True).over(before).alias("_began0"))
    here = Window.partitionBy("user_id", "file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, began = F.sum(asked.cast("int")).over(here), F.last(F.when(asked, F.col("ts")), ignorenulls=True).over(here)
    rows = log.withColumns({"_n": n, "_began": began}).join(blocks, ["user_id", "file", "block"])
    rows = rows.withColumns({"_n": F.col("_n") + F.col("_n0"), "_began": F.coalesce("_began", "_began0")}).where("_began IS NOT NULL")
    rows = rows.withColumn("search_id", F.concat_ws(".", F.col("_began").cast("string"), F.col("_n").cast("string"))).drop("_n", "_n0", "_began0")
    if results is None:
        return rows.drop("_began")
    of = results.select(F.col("ts").alias("_began"), "pos", F.col("url").alias("_url")).groupBy("_began", "pos").agg(F.first("_url").alias("_url"))
    return rows.join(of, ["_began", "pos"], "left").withColumn("url", F.when(~asked, F.coalesce("_url", F.lit("")))).drop("_began", "_url")


def links(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key, pos, url, title of the links of pages, by their place; those without address or text are left out."""
    pattern = r"""<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>"""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("_i", "_a"))
    out = found.select(key, (F.col("_i") + 1).alias("pos"), F.regexp_extract("_a", pattern, 1).alias("url"), plain_text(F.regexp_extract("_a", pattern, 2)).alias("title"))
    return out.where((F.col("url") != "") & (F.col("title") != ""))


#: The forms of two services' result pages.
PAGES = {
    "bing": {
        "item": r'(?s)<li class="sa_wr">.*?</li>', "link": r'(?s)<h3><a [^>]*?href="([^">]*)"[^>]*>(.*?)</a>', "summary": r"(?s)<p>(.*?)</p>", "shown": r"(?s)<cite>(.*?)</cite>", "mime": r"(?!)()",
        "start": r'(?s)<span [^>]*?id="count">(\d+).*? of [\d,]+ results</span>', "total": r'(?s)<span [^>]*?id="count">\d+.*? of ([\d,]+) results</span>', "spelling": r"(?s)Including results for.*?<a [^>]*>(.*?)</a>",
    },
    "aol": {
        "item": r'(?s)<li about="r.*?</li>', "link": r'(?s)<a [^>]*href="([^>"]+)"[^>]* property="f:title"[^>]*>(.+?)</a>', "summary": r'(?s)<p [^>]*property="f:desc"[^>]*>(.*?)</p>',
        "shown": r'<span [^>]*property="f:durl"[^>]*>([^<]+?)</span>', "mime": r'<span class="mimetype">\[(.+?)\]</span>',
        "start": r'<span id="lowerLimit">(\d+)</span>', "total": r'(?s)<span id="upperLimit">.*?</span>.*?<b>([\d,]+)</b>', "spelling": r"(?s)Did you mean:.*?<a [^>]*>(.+?)</a>",
    },
}


def page_entries(pages: DataFrame, key: str, form: str, column: str = "html") -> DataFrame:
    """key, pos, title, url, summary, shown_url, mime_type, total, suggestion of the items of result pages of a form.

    Ranks go on from the page's first one (0 where it names none); items without address or title take none. What a page lacks is empty, its total null.
    """
    page, of = F.col(column), PAGES[form]
    start = F.coalesce(F.regexp_extract(page, of["start"], 1).try_cast("int"), F.lit(0))
    facts = (start.alias("_start"), F.replace(F.regexp_extract(page, of["total"], 1), F.lit(","), F.lit("")).try_cast("long").alias("total"), plain_text(F.regexp_extract(page, of["spelling"], 1)).alias("suggestion"))
    part = lambda x, name, group=1: plain_text(F.regexp_extract(x, of[name], group))
    item = lambda x: F.struct(part(x, "link").alias("url"), part(x, "link", 2).alias("title"), part(x, "summary").alias("summary"), part(x, "shown").alias("shown_url"), part(x, "mime").alias("mime_type"))
    good = F.filter(F.transform(F.regexp_extract_all(page, F.lit(of["item"]), F.lit(0)), item), lambda r: (r["url"] != "") & (r["title"] != ""))
    return pages.select(key, *facts, F.posexplode(good).alias("_i", "_r")).select(key, (F.col("_start") + F.col("_i")).alias("pos"), "_r.title", "_r.url", "_r.summary", "_r.shown_url", "_r.mime_type", "total", "suggestion")


def result_entries(pages: DataFrame, key: str, column: str = "html") -> DataFrame:
    """page_entries() of pages whose items are of the class sa_wr."""
    return page_entries(pages, key, "bing", column)


def aol_entries(pages: DataFrame, key: str, column: str = "html") -> DataFrame:
    """page_entries() of pages whose items are about r and a number."""
    return page_entries(pages, key, "aol", column)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path, content of files, each as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def feed_items(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """doc_id, title, summary, url, date of a feed's items with a guid; markup in a description is stripped."""
    schema = "channel struct<item:array<struct<guid:string,title:string,description:string,link:string,pubDate:string>>>"
    each = feeds.select(F.explode(F.from_xml(F.col(column), schema)["channel"]["item"]).alias("i")).select("i.*")
    text = F.col("description")
    return each.where(F.coalesce(F.trim("guid"), F.lit("")) != "").select(F.col("guid").alias("doc_id"), "title", F.when(is_html(text), strip_html(text)).otherwise(text).alias("summary"), F.col("link").alias("url"), parse_rfc822(F.col("pubDate")).alias("date"))


def web_results(answers: DataFrame, column: str = "xml") -> DataFrame:
    """pos, title, summary, url, click_url of an XML answer (resultset_web, counted from its start, or ResultSet)."""
    first = F.coalesce(F.xpath_int(F.col(column), F.lit("//resultset_web/@start")) + 1, F.lit(1))
    old = F.xpath_int(F.col(column), F.lit("/ResultSet/@firstResultPosition"))

    def parts(a: str, b: str):
        return F.concat(F.xpath(F.col(column), F.lit(f"//resultset_web/result/{a}/text()")), F.xpath(F.col(column), F.lit(f"/ResultSet/Result/{b}/text()")))

    rows = answers.select(F.when(old > 0, old).otherwise(first).alias("_s"), F.posexplode(F.arrays_zip(parts("title", "Title").alias("title"), parts("abstract", "Summary").alias("summary"), parts("url", "Url").alias("url"), parts("clickurl", "ClickUrl").alias("click_url"))).alias("_i", "_r"))
    return rows.select((F.col("_s") + F.col("_i")).alias("pos"), "_r.title", "_r.summary", "_r.url", "_r.click_url")
