"""Queries over the driver's tables, one for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adaptlm.functions import codecs as C
from adaptlm.functions import text as T
from adaptlm.functions.porter import stemmed
from adaptlm.operators import em, events, lm, models, rank, recommend, sessions, topics
from adaptlm.sources import texts
from adaptlm.sources.segments import index_of
from adaptlm.sources.tables import sent, table
from adaptlm.sources.texts import links

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    """Six digits, without a negative zero: what is compared does not hang on the order of additions."""
    return F.round(c, 6) + F.lit(0.0)


# --- SQL parts ---

TOKENS = r"regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10FFFF}]+')"
PLAIN = r"regexp_matches(term, '^[\x20-\x7F]*$')"


def _tf(name: str, tab: str, key: str) -> str:
    return f"{name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({TOKENS}) AS term FROM {tab}) WHERE {PLAIN} GROUP BY {key}, term)"


DOCS = _tf("d", "documents", "doc_id")
ITEMS = _tf("q", "benchmark", "item_id")
TURNS = _tf("t", "(SELECT conv_id * 1000 + turn AS search_id, text FROM conversations WHERE role = 'user')", "search_id")
BACK = """bgc AS (SELECT term, sum(tf)::DOUBLE AS c FROM d GROUP BY term), tot AS (SELECT sum(c) AS total, count(*)::DOUBLE AS uniq FROM bgc),
bg AS (SELECT term, (c + 1) / (total + uniq) AS p FROM bgc, tot), dflt AS (SELECT 1 / (total + uniq) AS p0 FROM tot)"""
KL = f"""qp AS (SELECT q.item_id, q.term, q.tf AS w, coalesce(bg.p, p0) AS p FROM q LEFT JOIN bg USING (term), dflt),
qf AS (SELECT item_id, sum(w) AS qlen, sum(w * ln(p)) AS base FROM qp GROUP BY 1), dl AS (SELECT doc_id, sum(tf) AS dlen FROM d GROUP BY 1),
ov AS (SELECT item_id, doc_id, sum(w * ln(1 + tf / 100.0 / p)) AS gain FROM qp JOIN d USING (term) GROUP BY 1, 2),
sc AS (SELECT item_id, doc_id, (gain + base) / qlen + ln(100.0 / (dlen + 100.0)) AS score FROM ov JOIN qf USING (item_id) JOIN dl USING (doc_id) WHERE gain > 0),
hits AS (SELECT item_id, doc_id, round(score, 6) + 0.0 AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS pos FROM sc QUALIFY pos <= 10)"""


def _mix(source: str, key: str) -> str:
    """Mixture over rows key, term, f, p."""
    return f"""mx1 AS (SELECT *, p / f AS r FROM {source} WHERE f > 0),
mx2 AS (SELECT *, sum(f) OVER w AS cf, sum(p) OVER w AS cp FROM mx1 WINDOW w AS (PARTITION BY {key} ORDER BY r, term ROWS UNBOUNDED PRECEDING)),
mx3 AS (SELECT *, max(CASE WHEN (1 - 0.9) / 0.9 + cp <= cf * r THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY r, term ROWS UNBOUNDED PRECEDING) AS stop FROM mx2),
mx4 AS (SELECT {key}, sum(f) / (1 + sum(p) / ((1 - 0.9) / 0.9)) AS lam FROM mx3 WHERE stop = 0 GROUP BY 1),
mix AS (SELECT m.{key}, m.term, CASE WHEN stop = 0 THEN f / lam - p / ((1 - 0.9) / 0.9) ELSE 0 END AS prob FROM mx3 m JOIN mx4 USING ({key}))"""


def _cut(source: str, key: str, most: int = 20, least: float = 0.001, mass: float = 1.0, digits: int = 6) -> str:
    return f"""(SELECT {key}, term, round(prob, {digits}) + 0.0 AS prob FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(prob, 12) DESC, term) AS rk,
coalesce(sum(prob) OVER (PARTITION BY {key} ORDER BY round(prob, 12) DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source}) WHERE rk <= {most} AND prob >= {least} AND before < {mass})"""


# --- Spark parts ---


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Term counts of the documents, from an index that takes in what has changed."""
    return index_of(spark, f"{d}/documents.parquet").postings()


def _background(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return lm.term_probs(index_of(spark, f"{d}/documents.parquet").terms())


def _items(spark: SparkSession, d: str) -> DataFrame:
    return lm.term_counts(table(spark, d, "benchmark"), "item_id")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """User turns as searches: search_id, user_id (the conversation), text, ts (a turn is ten minutes)."""
    c = table(spark, d, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("search_id"), F.col("conv_id").alias("user_id"), "text", (F.col("turn") * 600).alias("ts"))


def _hits(spark: SparkSession, d: str, most: int = 10) -> DataFrame:
    """The best documents of each item; made once, however often they are read."""
    index = index_of(spark, f"{d}/documents.parquet")
    probs, default = lm.term_probs(index.terms())
    scores = lm.kl_scores(_items(spark, d).withColumnRenamed("tf", "weight"), index.postings(), probs, default, "item_id", "doc_id", 100.0, d_lengths=index.lengths())
    return sent(lm.top(scores, "item_id", "doc_id", most).select("item_id", "doc_id", r6("score").alias("score"), F.col("rank").alias("pos")))[0]


def _clicked_hits(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("clicked"))
    hits = _hits(spark, d)
    good = good.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    return sent(hits.join(good, "doc_id", "left").withColumn("clicked", F.coalesce("clicked", F.lit(False))))[0]


def _events(spark: SparkSession, d: str) -> DataFrame:
    """events with item: the number in props."""
    return table(spark, d, "events").withColumn("item", F.get_json_object("props", "$.k").cast("long"))


ITEM = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


# --- text ---


@query(f"WITH {DOCS} SELECT * FROM d")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d)


@query(r"SELECT item_id, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n_words, len(regexp_extract_all(text, '\"[^\"]*\"?|[^ \t\n\r]+')) AS n_tokens FROM benchmark")
def whitespace_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"), F.size(T.words(F.col("text"), True)).cast("long").alias("n_tokens"))


_MARKED = "CASE item_id % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN 'site:' ELSE '' END || text"


@query(rf"""WITH w AS (SELECT item_id, regexp_extract_all({_MARKED}, '[^ \t\n\r]+') AS ws FROM benchmark), f AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'INCLUDE' WHEN 1 THEN 'EXCLUDE' WHEN 2 THEN 'SITE' ELSE 'NONE' END AS first_flag, len(ws) AS n_keywords,
CASE item_id % 4 WHEN 0 THEN array_to_string(list_concat([substr(ws[1], 2)], ws[2:]), ' ') WHEN 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[2:], ' ') END AS query_text FROM w) SELECT * FROM f""")
def keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "benchmark").select("item_id", T.keywords(F.expr(_MARKED)).alias("k"))
    return k.select("item_id", F.get("k", F.lit(0))["flag"].alias("first_flag"), F.size("k").cast("long").alias("n_keywords"), T.query_text(F.col("k")).alias("query_text"))


#: Words and stems that the algorithm's publication gives as examples.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


@query("WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}', '{x}')" for i, (w, x) in enumerate(zip(STEMS[::2], STEMS[1::2]))) + f") v(i, term, stem)) SELECT term, stem, count(*) AS docs FROM documents JOIN v ON doc_id % {len(STEMS) // 2} = i GROUP BY 1, 2")
def porter_stems(spark: SparkSession, d: str) -> DataFrame:
    """The published examples, dealt to the documents by their ids, and how many documents have each."""
    word = F.element_at(F.array(*map(F.lit, STEMS[::2])), (F.col("doc_id") % (len(STEMS) // 2) + 1).cast("int"))
    terms = table(spark, d, "documents").where("doc_id IS NOT NULL").groupBy(word.alias("term")).agg(F.count(F.lit(1)).alias("docs"))
    return stemmed(terms.withColumn("stem", F.col("term")), "stem").select("term", "stem", "docs")


@query()
def porter_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = _docs(spark, d).select("term").distinct()
    return stemmed(terms.withColumn("stem", F.col("term")), "stem").select("term", "stem")


@query(rf"SELECT doc_id, regexp_matches(text, '^[\x20-\x7F]*$') AS ascii, contains(text, '</') AS html, len(text) > 0 AS filled FROM documents")
def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.is_ascii(t).alias("ascii"), T.is_html(t).alias("html"), (F.length(t) > 0).alias("filled"))


@query(r"SELECT page_id, md5(regexp_replace(html, '<[^>]*>?|>', '', 'g')) AS digest, contains(html, '</') AS is_html FROM pages")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("digest"), T.is_html(F.col("html")).alias("is_html"))


@query("""WITH u AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN repeat('/long', 12) ELSE '' END AS url FROM pages), r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE url END AS rest FROM u),
s AS (SELECT page_id, CASE WHEN rest LIKE '%/' THEN substr(rest, 1, length(rest) - 1) ELSE rest END AS short FROM r) SELECT page_id, CASE WHEN length(short) > 50 THEN substr(short, 1, 50) || '...' ELSE short END AS shown FROM s""")
def display_url(spark: SparkSession, d: str) -> DataFrame:
    url = F.expr("url || CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN repeat('/long', 12) ELSE '' END")
    return table(spark, d, "pages").select("page_id", T.display_url(url).alias("shown"))


@query(r"""SELECT page_id, md5(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&apos;', ''''), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS plain,
md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '>', '&gt;'), '<', '&lt;'), '"', '&quot;'), '''', '&apos;')) AS quoted, md5(regexp_replace(html, '</?wbr>', '', 'g')) AS joined FROM pages""")
def unformat_markup(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.md5(T.plain_text(h)).alias("plain"), F.md5(T.quote(h)).alias("quoted"), F.md5(T.without_breaks(h)).alias("joined"))




_ADDRESS = "CASE page_id % 4 WHEN 0 THEN 'http://h' || page_id WHEN 1 THEN 'h.org:8' || page_id || '/p' WHEN 2 THEN url || '?n=' || page_id ELSE url || '?n=' || page_id || '&m=2#t' END"


@query(f"WITH u AS (SELECT page_id, {_ADDRESS} AS u FROM pages) SELECT page_id, " + ", ".join(f"regexp_extract(u, '{T.URL}', {i}) AS {n}" for i, n in enumerate(("scheme", "host", "port", "path", "query", "fragment"), 1)) + " FROM u")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.url_parts(F.expr(_ADDRESS)).alias("u")).select("page_id", "u.*")


@query("SELECT page_id, i AS pos, CASE i WHEN 1 THEN 'a n' ELSE 'm' END AS name, CASE i WHEN 1 THEN '+' || page_id ELSE 'x&=é y' END AS value, 'a+n=%2B' || page_id || '&m=x%26%3D%C3%A9+y' AS rebuilt FROM pages, (VALUES (1), (2)) x(i)")
def query_params(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("a%20n=%2B"), F.col("page_id").cast("string"), F.lit("&m=x%26%3D%C3%A9%20y&=lost&lost"))
    p = table(spark, d, "pages").select("page_id", T.query_params(q).alias("q"))
    return p.select("page_id", F.posexplode("q").alias("i", "p"), T.build_query(F.col("q")).alias("rebuilt")).select("page_id", (F.col("i") + 1).alias("pos"), "p.name", "p.value", "rebuilt")


@query("SELECT item_id, replace(url_encode(text), '%20', '+') AS encoded, text AS decoded FROM benchmark")
def url_encode(spark: SparkSession, d: str) -> DataFrame:
    e = T.url_encode(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", e.alias("encoded"), T.url_decode(e).alias("decoded"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>')) AS a, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>'), 1) AS pos FROM pages)
SELECT page_id, pos::INT AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS url, regexp_extract(a, '<a [^>]*>(.*?)</a>', 1) AS title FROM a WHERE regexp_extract(a, '<a [^>]*>(.*?)</a>', 1) <> ''""")
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    return links(table(spark, d, "pages"))


# --- language models ---


@query(f"WITH {DOCS}, {BACK} SELECT term, c::BIGINT AS count, round(p, 12) AS prob FROM bg JOIN bgc USING (term)")
def collection_probs(spark: SparkSession, d: str) -> DataFrame:
    return _background(spark, d)[0].select("term", "count", F.round("prob", 12).alias("prob"))


@query(f"WITH {DOCS} SELECT doc_id, sum(tf)::BIGINT AS length, count(*) AS terms FROM d GROUP BY 1")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("doc_id").agg(F.sum("tf").alias("length"), F.count(F.lit(1)).alias("terms"))


@query(f"WITH {DOCS} SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT term) AS terms, sum(tf)::BIGINT AS tokens FROM d")
def doc_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("term").alias("terms"), F.sum("tf").alias("tokens"))


@query(f"WITH {ITEMS}, n AS (SELECT item_id, term, tf / sum(tf) OVER (PARTITION BY item_id) AS prob FROM q) SELECT * FROM {_cut('n', 'item_id')}")
def query_mle_model(spark: SparkSession, d: str) -> DataFrame:
    return models.query_model(table(spark, d, "benchmark"), "item_id").withColumn("prob", r6("prob"))


@query(f"WITH {DOCS}, n AS (SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) AS prob FROM d) SELECT 'wide' AS preset, * FROM {_cut('n', 'doc_id')} UNION ALL SELECT 'short', * FROM {_cut('n', 'doc_id', 10, 0.01, 0.9)}")
def truncate_model(spark: SparkSession, d: str) -> DataFrame:
    n = lm.normalised(_docs(spark, d).withColumnRenamed("tf", "prob"), "doc_id", "prob")
    wide, short = lm.truncated(n, "doc_id"), lm.truncated(n, "doc_id", most=10, least=0.01, mass=0.9)
    return wide.select(F.lit("wide").alias("preset"), "doc_id", "term", r6("prob").alias("prob")).unionByName(short.select(F.lit("short").alias("preset"), "doc_id", "term", r6("prob").alias("prob")))


@query(f"WITH {DOCS} SELECT doc_id, term, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS weight FROM d")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = lm.normalised(_docs(spark, d).withColumnRenamed("tf", "weight"), "doc_id", squared=True)
    return n.select("doc_id", "term", r6("weight").alias("weight"))


@query(f"WITH {ITEMS}, {DOCS}, a AS (SELECT item_id AS k, term, tf / sum(tf) OVER (PARTITION BY item_id) AS w FROM q), b AS (SELECT doc_id AS k, term, tf / sum(tf) OVER (PARTITION BY doc_id) AS w FROM d) SELECT k, term, round(sum(w), 6) AS weight FROM (SELECT k, term, 0.7::DOUBLE * w AS w FROM a UNION ALL SELECT k, term, (1 - 0.7::DOUBLE) * w FROM b) GROUP BY 1, 2")
def interpolate(spark: SparkSession, d: str) -> DataFrame:
    a = lm.normalised(_items(spark, d).select(F.col("item_id").alias("k"), "term", F.col("tf").alias("weight")), "k")
    b = index_of(spark, f"{d}/documents.parquet").shares().withColumnRenamed("doc_id", "k")
    return lm.interpolated(a, b, "k", 0.7, b_once=True).select("k", "term", r6("weight").alias("weight"))


@query(f"WITH {DOCS}, {BACK}, fp AS (SELECT doc_id, term, tf::DOUBLE AS f, p FROM d JOIN bg USING (term)), {_mix('fp', 'doc_id')} SELECT doc_id, term, round(prob, 6) + 0.0 AS prob FROM mix")
def mixture_model(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    probs, default = _background(spark, d)
    rows = lm.with_background_of_all(docs.select("doc_id", "term", F.col("tf").cast("double").alias("f")), probs, default)
    return lm.mixture(rows, "doc_id").select("doc_id", "term", r6("prob").alias("prob"))


@query(f"WITH {DOCS}, {ITEMS}, {BACK}, {KL} SELECT item_id, doc_id, score, pos::INT AS pos FROM hits")
def kl_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


_CLICKS = "cl AS (SELECT h.item_id, h.doc_id, h.pos, coalesce(l.quality = 1, false) AS clicked FROM hits h LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality = 1) l USING (doc_id))"


def _weighted(clicked: str, pseudo: bool) -> str:
    keep = "" if pseudo else " WHERE item_id IN (SELECT item_id FROM cl WHERE clicked)"
    return f"wc AS (SELECT item_id, term, sum(f) AS f FROM (SELECT item_id, term, tf::DOUBLE AS f FROM q UNION ALL SELECT item_id, term, tf * (CASE WHEN clicked THEN {clicked} ELSE 0.01 END) FROM (SELECT * FROM cl{keep}) JOIN d USING (doc_id)) GROUP BY 1, 2 HAVING sum(f) > 0)"


_FP = "fp AS (SELECT item_id, term, f, coalesce(p, p0) AS p FROM wc LEFT JOIN bg USING (term), dflt)"
_HEAD = f"WITH {DOCS}, {ITEMS}, {BACK}, {KL}, {_CLICKS}"


def _feedback_counts(spark: SparkSession, d: str, hits: DataFrame | None = None, **options) -> DataFrame:
    return models.weighted_counts(table(spark, d, "benchmark"), _clicked_hits(spark, d) if hits is None else hits, _docs(spark, d), "item_id", "doc_id", **options)


def _feedback(spark: SparkSession, d: str, **options) -> DataFrame:
    probs, default = _background(spark, d)
    return models.mixture_model(_feedback_counts(spark, d, **options), probs, default, "item_id").select("item_id", "term", r6("prob").alias("prob"))


@query(f"{_HEAD}, {_weighted('0.0', True)}, {_FP}, {_mix('fp', 'item_id')}, pos_only AS (SELECT * FROM mix WHERE prob > 0) SELECT * FROM {_cut('pos_only', 'item_id')}")
def pseudo_feedback_model(spark: SparkSession, d: str) -> DataFrame:
    return _feedback(spark, d, clicked=0.0, pseudo=True)


@query(f"{_HEAD}, {_weighted('1.0', False)}, {_FP}, {_mix('fp', 'item_id')}, pos_only AS (SELECT * FROM mix WHERE prob > 0) SELECT * FROM {_cut('pos_only', 'item_id')}")
def click_feedback_model(spark: SparkSession, d: str) -> DataFrame:
    return _feedback(spark, d)


@query(f"{_HEAD}, wc AS (SELECT item_id, term, sum(tf)::DOUBLE AS f FROM cl JOIN d USING (doc_id) WHERE clicked GROUP BY 1, 2), {_FP}, {_mix('fp', 'item_id')}, pos_only AS (SELECT * FROM mix WHERE prob > 0) SELECT * FROM {_cut('pos_only', 'item_id')}")
def explicit_feedback_model(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    probs, default = _background(spark, d)
    ratings = _clicked_hits(spark, d).select("item_id", "doc_id", F.when(F.col("clicked"), "Y").otherwise("N").alias("rating"))
    return models.feedback_model(ratings, docs, probs, default, "item_id", "doc_id").select("item_id", "term", r6("prob").alias("prob"))


@query(f"{_HEAD}, {_weighted('1.0', False)}, n AS (SELECT item_id, term, f / sum(f) OVER (PARTITION BY item_id) AS prob FROM wc) SELECT * FROM {_cut('n', 'item_id')}")
def rocchio_model(spark: SparkSession, d: str) -> DataFrame:
    return models.rocchio_model(_feedback_counts(spark, d), "item_id").withColumn("prob", r6("prob"))


_OWN = f"""{_weighted('1.0', False)}, {_FP}, {_mix('fp', 'item_id')}, pos_only AS (SELECT * FROM mix WHERE prob > 0), good AS (SELECT item_id FROM benchmark WHERE regexp_matches(text, '^[\\x20-\\x7F]*$') AND item_id IN (SELECT item_id FROM cl WHERE clicked)),
mdl AS (SELECT m.*, coalesce(p, p0) AS p FROM {_cut('pos_only', 'item_id')} m LEFT JOIN bg USING (term), dflt WHERE item_id IN (SELECT item_id FROM good)), mf AS (SELECT item_id, sum(prob) AS mlen, sum(prob * ln(p)) AS mbase FROM mdl GROUP BY 1),
og AS (SELECT h.item_id, h.pos, h.doc_id, sum(m.prob * ln(1 + d.tf / 100.0 / m.p)) AS gain FROM hits h JOIN d USING (doc_id) JOIN mdl m ON m.item_id = h.item_id AND m.term = d.term GROUP BY 1, 2, 3),
os AS (SELECT item_id, pos, (gain + mbase) / mlen + ln(100.0 / (dlen + 100.0)) AS score FROM og JOIN mf USING (item_id) JOIN dl USING (doc_id) WHERE gain > 0)"""


@query(f"""{_HEAD}, {_OWN}, viewed AS (SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS seq FROM cl WHERE clicked AND item_id IN (SELECT item_id FROM good)),
ahead AS (SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, pos) AS seq FROM os WHERE (item_id, pos) NOT IN (SELECT (item_id, pos) FROM viewed) QUALIFY seq <= 3),
parts AS (SELECT item_id, pos, 0 AS part, seq FROM viewed UNION ALL SELECT item_id, pos, 1, seq FROM ahead UNION ALL SELECT item_id, pos, 2, pos FROM hits),
firsts AS (SELECT item_id, pos, min(part * 1000 + seq) AS o FROM parts GROUP BY 1, 2) SELECT item_id, pos::INT AS pos, (row_number() OVER (PARTITION BY item_id ORDER BY o))::INT AS rank FROM firsts""")
def rerank_merge(spark: SparkSession, d: str) -> DataFrame:
    hits, docs, items = _clicked_hits(spark, d), _docs(spark, d), table(spark, d, "benchmark")
    probs, default = _background(spark, d)
    clicked = hits.where("clicked")
    viewed = clicked.withColumn("seq", F.row_number().over(Window.partitionBy("item_id").orderBy("pos")))
    flags = models.adaptive(items.select("item_id"), clicked, "item_id")
    results = hits.join(docs, "doc_id").select("item_id", "pos", "term", "tf")
    return rank.rerank_by_model(items, results, viewed, _feedback(spark, d, hits=hits), flags, probs, default, "item_id")


@query(f"WITH {ITEMS}, {TURNS}, tn AS (SELECT search_id, sqrt(sum(tf * tf)) AS n FROM t GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM q GROUP BY 1), dots AS (SELECT search_id, item_id, sum(t.tf * q.tf) AS dot FROM t JOIN q USING (term) GROUP BY 1, 2) SELECT search_id, item_id, round(dot / (tn.n * qn.n), 6) AS cosine FROM dots JOIN tn USING (search_id) JOIN qn USING (item_id)")
def cosine_sparse(spark: SparkSession, d: str) -> DataFrame:
    a = lm.term_counts(_turns(spark, d), "search_id").withColumnRenamed("tf", "weight")
    return lm.cosines(a, _items(spark, d).withColumnRenamed("tf", "weight"), "search_id", "item_id").select("search_id", "item_id", r6("cosine").alias("cosine"))




@query("WITH e AS (SELECT vec_id, label, embedding, first_value(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS head FROM embeddings) SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], head::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(head::DOUBLE[], head::DOUBLE[])), 6) + 0.0 AS cosine FROM e")
def cosine_dense(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    head = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return e.join(head, "label").select("vec_id", "label", r6(lm.dense_cosine(F.col("embedding"), F.col("head"))).alias("cosine"))


# --- events ---


@query(f"SELECT user_id, {ITEM} AS item, (row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)))::INT AS seq FROM events GROUP BY user_id, {ITEM}")
def unique_first_order(spark: SparkSession, d: str) -> DataFrame:
    return events.unique_first(_events(spark, d), "user_id", "item", "event_id")


_RATED = "CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'purchase' THEN 'Y' ELSE 'N' END"


@query(f"SELECT user_id, {ITEM} AS item, arg_max({_RATED}, event_id) AS rating FROM events GROUP BY ALL HAVING arg_max({_RATED}, event_id) <> ''")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return events.last_write(_events(spark, d).withColumn("rating", F.expr(_RATED)), ["user_id", "item"], "rating", "event_id")


@query("WITH m AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, last, epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(last) >= 1800 AS expired FROM m")
def last_event_time(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return m.select("user_id", "last", events.expired(F.col("last"), now, F.lit(False)).alias("expired"))


@query("SELECT event_id, user_id, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def prev_next_search(spark: SparkSession, d: str) -> DataFrame:
    return events.linked(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "event_id", "ts", "event_id").drop("ts")


@query("WITH s AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-15' GROUP BY 1) SELECT event_id, e.user_id FROM events e LEFT JOIN s USING (user_id) WHERE m IS NULL OR event_id > m")
def high_water_mark(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    saved = e.where("event_id % 2 = 0 AND ts < timestamp_ntz '2024-01-15'")
    return events.after_mark(e, saved, "user_id").select("event_id", "user_id")


@query(f"{_HEAD}, low AS (SELECT item_id, max(pos) AS m FROM cl WHERE clicked GROUP BY 1) SELECT item_id, doc_id, pos::INT AS pos FROM cl JOIN low USING (item_id) WHERE pos <= m")
def viewed_prefix(spark: SparkSession, d: str) -> DataFrame:
    h = _clicked_hits(spark, d)
    return events.viewed_prefix(h, h.where("clicked"), "item_id").select("item_id", "doc_id", "pos")


@query(f"{_HEAD} SELECT item_id AS search_id, pos::INT AS pos FROM cl WHERE (pos <= 5 OR clicked) AND NOT (pos % 3 = 0)")
def unsaved_results(spark: SparkSession, d: str) -> DataFrame:
    h = _clicked_hits(spark, d).select(F.col("item_id").alias("search_id"), "pos", "clicked")
    return events.unsaved(h, h.where("clicked"), h.where("pos % 3 = 0"), 5)


def _session_sql(gap: str) -> str:
    return f"WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL {gap} THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run"


@query(_session_sql("'30 minutes'"))
def session_window_30m(spark: SparkSession, d: str) -> DataFrame:
    return events.session_windows(table(spark, d, "events"), "user_id", "ts")


@query(_session_sql("'8 hours'"))
def session_window_8h(spark: SparkSession, d: str) -> DataFrame:
    return events.session_windows(table(spark, d, "events"), "user_id", "ts", "8 hours")


@query("""WITH m AS (SELECT user_id, TIMESTAMP '2024-01-10 12:00:00' AS ended FROM events GROUP BY 1), g AS (SELECT e.*, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) // 1000000 - epoch_us(lag(ts) OVER w) // 1000000 > 43200 OR (ts > ended AND ended > lag(ts) OVER w) THEN 1 ELSE 0 END AS new FROM events e JOIN m USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM g""")
def forced_session_split(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    marks = e.select("user_id").distinct().withColumn("ended", F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"))
    return events.forced_runs(e, marks, "user_id", "ts", 43_200, "event_id").select("event_id", "user_id", "run")


@query("SELECT a.user_id, a.event_id AS anchor, b.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) // 1000000 - epoch_us(b.ts) // 1000000) <= 7200")
def time_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return events.anchored_neighbourhood(table(spark, d, "events"), "user_id", "event_id", "ts", 7200)


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'view' ELSE 'rate' END AS kind, user_id FROM events) SELECT event_id, kind, CASE kind WHEN 'click' THEN user_id || chr(9) || 'http://h/' || event_id WHEN 'rate' THEN user_id || chr(9) || 'Y' ELSE 'base' || chr(9) || user_id || chr(9) || '10' END AS value,
CASE WHEN kind <> 'view' THEN user_id END::INT AS pos, CASE WHEN kind = 'view' THEN user_id END::INT AS start_pos FROM e""")
def event_codec(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("kind", F.expr("CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'view' ELSE 'rate' END"))
    value = C.encode_event(F.col("kind"), F.col("user_id"), F.concat(F.lit("http://h/"), F.col("event_id").cast("string")), F.lit("Y"), F.lit("base"), F.col("user_id"), F.lit(10))
    e = e.withColumn("value", value).withColumn("x", C.decode_event(F.col("kind"), F.col("value")))
    return e.select("event_id", "kind", "value", "x.pos", "x.start_pos")


@query(f"WITH {ITEMS}, n AS (SELECT item_id, term, tf / sum(tf) OVER (PARTITION BY item_id) AS prob FROM q) SELECT item_id, term, prob FROM {_cut('n', 'item_id', digits=3)}")
def model_codec(spark: SparkSession, d: str) -> DataFrame:
    m = models.query_model(table(spark, d, "benchmark"), "item_id")
    return C.decode_model(C.encode_model(m, "item_id"), "item_id").select("item_id", "term", "prob")


@query("SELECT event_id, CASE WHEN ts::DATE = DATE '2024-01-20' THEN 'Today' WHEN ts::DATE = DATE '2024-01-19' THEN 'Yesterday' ELSE strftime(ts, '%b %d, %Y') END AS day, strftime(ts, '%I:%M %p') AS clock FROM events")
def date_labels(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", C.date_label(ts, F.to_date(F.lit("2024-01-20"))).alias("day"), C.time_label(ts).alias("clock"))


@query("SELECT event_id, (floor((user_id % 97) / 10) * 10 + 1)::INT AS start, least(floor((user_id % 97) / 10) * 10 + 10, 95)::INT AS last, CASE WHEN floor((user_id % 97) / 10) * 10 + 11 <= 95 THEN floor((user_id % 97) / 10) * 10 + 11 END::INT AS next_start, CASE WHEN floor((user_id % 97) / 10) > 0 THEN floor((user_id % 97) / 10) * 10 - 9 END::INT AS prev_start FROM events")
def paging_counters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", rank.aligned_start((F.col("user_id") % 97 + 1).cast("int")).alias("start"))
    c = rank.page_counters(F.lit(95), F.col("start"))
    return e.select("event_id", "start", c["last"].cast("int").alias("last"), c["next_start"].cast("int").alias("next_start"), c["prev_start"].cast("int").alias("prev_start"))


@query(f"{_HEAD} SELECT item_id, doc_id, pos::INT AS rank FROM hits WHERE pos BETWEEN 4 AND 6")
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return rank.page(_hits(spark, d).withColumnRenamed("pos", "rank"), 4, 3).select("item_id", "doc_id", "rank")


# --- sessions and topics ---

_PAIRS = "tn AS (SELECT search_id, sqrt(sum(tf * tf)) AS n FROM t GROUP BY 1), sim AS (SELECT a.search_id AS a, b.search_id AS b, round(sum(a.tf * b.tf) / any_value(x.n * y.n), 6) AS cosine FROM t a JOIN t b ON a.term = b.term AND a.search_id < b.search_id JOIN tn x ON x.search_id = a.search_id JOIN tn y ON y.search_id = b.search_id GROUP BY 1, 2)"


def _similar(spark: SparkSession, d: str) -> DataFrame:
    t = lm.term_counts(_turns(spark, d), "search_id").withColumnRenamed("tf", "weight")
    return lm.pair_cosines(t, "search_id").withColumn("cosine", r6("cosine"))


def _session_links(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    weights = lm.term_counts(turns, "search_id").withColumnRenamed("tf", "weight")
    return sessions.pair_cosines(sessions.near_pairs(turns, "ts"), weights).where(r6("cosine") >= 0.05).select("a", "b")


@query(f"WITH {TURNS}, {_PAIRS} SELECT * FROM sim")
def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d)


@query(f"WITH {TURNS}, {_PAIRS} SELECT a, b FROM sim WHERE a // 1000 = b // 1000 AND abs(a % 1000 - b % 1000) * 600 <= 1800 AND cosine >= 0.05")
def session_range_join(spark: SparkSession, d: str) -> DataFrame:
    return _session_links(spark, d)


@query(f"""WITH RECURSIVE {TURNS}, {_PAIRS}, e AS (SELECT a, b FROM sim WHERE a // 1000 = b // 1000 AND abs(a % 1000 - b % 1000) * 600 <= 1800 AND cosine >= 0.05), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT conv_id * 1000 + turn AS node, conv_id * 1000 + turn AS other FROM conversations WHERE role = 'user' UNION SELECT r.node, u.b FROM reach r JOIN u ON r.other = u.a) SELECT node, min(other) AS root FROM reach GROUP BY 1""")
def session_components(spark: SparkSession, d: str) -> DataFrame:
    nodes = _turns(spark, d).select(F.col("search_id").alias("node"))
    return sessions.min_labels(nodes, _session_links(spark, d))


@query(f"WITH {DOCS}, {BACK}, {TURNS}, qt AS (SELECT t.search_id, t.term, t.tf AS w, coalesce(bg.p, p0) AS p FROM t LEFT JOIN bg USING (term), dflt), qf AS (SELECT search_id, sum(w) AS qlen, sum(w * ln(p)) AS base FROM qt GROUP BY 1), {ITEMS}, m AS (SELECT item_id, term, tf / sum(tf) OVER (PARTITION BY item_id) AS prob FROM q), ml AS (SELECT item_id, sum(prob) AS len FROM m GROUP BY 1), ov AS (SELECT search_id, item_id, sum(w * ln(1 + prob / 1.0 / p)) AS gain FROM qt JOIN m USING (term) GROUP BY 1, 2) SELECT search_id, item_id, round((gain + base) / qlen + ln(1.0 / (len + 1.0)), 5) + 0.0 AS score FROM ov JOIN qf USING (search_id) JOIN ml USING (item_id) WHERE gain > 0")
def history_search(spark: SparkSession, d: str) -> DataFrame:
    probs, default = _background(spark, d)
    m = lm.normalised(_items(spark, d).withColumnRenamed("tf", "prob"), "item_id", "prob")
    q = lm.term_counts(_turns(spark, d), "search_id").withColumnRenamed("tf", "weight")
    s = lm.kl_scores(q, m, probs, default, "search_id", "item_id", 1.0, d_weight="prob")
    return s.select("search_id", "item_id", (F.round("score", 5) + F.lit(0.0)).alias("score"))


_LINKED = """g AS (SELECT a // 1000 AS user_id, a, b, cosine AS sim FROM sim WHERE cosine > 0.01 AND a // 1000 = b // 1000),
r AS (SELECT * FROM (SELECT search_id // 1000 AS user_id, 0 AS step, search_id AS a, search_id AS b, NULL::DOUBLE AS sim, 1.0::DOUBLE AS na, 1.0::DOUBLE AS nb FROM turns UNION ALL SELECT user_id, 0, a, b, sim, 1.0, 1.0 FROM g)
UNION ALL SELECT user_id, step, a, b, sim, na, nb FROM (
SELECT user_id, step + 1 AS step, CASE WHEN sim IS NULL THEN a ELSE least(x, y) END AS a, CASE WHEN sim IS NULL THEN y ELSE greatest(x, y) END AS b, sum(CASE WHEN sim IS NULL THEN NULL WHEN part > 0 THEN sim * part / (k.na + k.nb) ELSE sim END) AS sim, bool_or(sim IS NULL) AS node,
CASE WHEN x <= y THEN nx ELSE ny END AS na, CASE WHEN x <= y THEN ny ELSE nx END AS nb FROM (
SELECT *, CASE WHEN a = k.b THEN k.a ELSE a END AS x, CASE WHEN b = k.b THEN k.a ELSE b END AS y, CASE WHEN a IN (k.a, k.b) THEN k.na + k.nb ELSE na END AS nx, CASE WHEN b IN (k.a, k.b) THEN k.na + k.nb ELSE nb END AS ny, CASE WHEN a IN (k.a, k.b) THEN na WHEN b IN (k.a, k.b) THEN nb ELSE 0 END AS part
FROM (SELECT *, min(CASE WHEN sim >= 0.1 THEN {'far': -sim, 'a': a, 'b': b, 'na': na, 'nb': nb} END) OVER (PARTITION BY user_id) AS k FROM r) WHERE k IS NOT NULL)
WHERE sim IS NULL OR x <> y GROUP BY user_id, step, k, CASE WHEN sim IS NULL THEN a ELSE least(x, y) END, CASE WHEN sim IS NULL THEN y ELSE greatest(x, y) END, CASE WHEN x <= y THEN nx ELSE ny END, CASE WHEN x <= y THEN ny ELSE nx END, sim IS NULL)
WHERE node OR sim >= 0.01)"""


@query(f"WITH RECURSIVE {TURNS}, {_PAIRS}, turns AS (SELECT conv_id * 1000 + turn AS search_id FROM conversations WHERE role = 'user'), {_LINKED} SELECT user_id, a AS item, arg_max(b, step) AS cluster FROM r WHERE sim IS NULL GROUP BY 1, 2")
def agglomerative_clusters(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    t = lm.term_counts(turns, "search_id").select((F.col("search_id") / 1000).cast("long").alias("user_id"), "search_id", "term", F.col("tf").alias("weight"))
    sims = lm.pair_cosines_within(t, "user_id", "search_id").select("user_id", "a", "b", r6("cosine").alias("sim")).where("sim > 0.01")
    return topics.clusters(sims, turns.select("user_id", F.col("search_id").alias("item")), "user_id")


def _em_rows(spark: SparkSession, d: str) -> DataFrame:
    """For each item: its terms' counts; components: its best hit, its second hit, the background."""
    docs = _docs(spark, d)
    probs, default = _background(spark, d)
    q = lm.with_background(_items(spark, d), probs, default)
    hits = _hits(spark, d, 2)
    p = lm.normalised(docs.join(sent(hits.select("doc_id").distinct())[0], "doc_id", "left_semi").withColumnRenamed("tf", "prob"), "doc_id", "prob")
    for k in (1, 2):
        hit = hits.where(F.col("pos") == k).select("item_id", "doc_id").join(p, "doc_id").select("item_id", "term", F.col("prob").alias(f"c{k}"))
        q = q.join(hit, ["item_id", "term"], "left").na.fill({f"c{k}": 0.0})
    rows = q.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("term", F.col("tf").cast("double").alias("tf"), "c1", "c2", "p"))).alias("x"))
    return rows.select("item_id", F.col("x.tf").alias("target"), F.array("x.c1", "x.c2", "x.p").alias("components"), F.array(F.lit(0.1), F.lit(0.0), F.lit(0.9)).alias("priors"))


_EM = f"""WITH RECURSIVE {DOCS}, {ITEMS}, {BACK}, {KL}, dp AS (SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) AS prob FROM d),
rows AS (SELECT q.item_id, q.term, q.tf::DOUBLE AS n, coalesce(x.prob, 0) AS c1, coalesce(y.prob, 0) AS c2, coalesce(bg.p, p0) AS c3 FROM q LEFT JOIN bg USING (term) CROSS JOIN dflt
LEFT JOIN (SELECT h.item_id, dp.term, dp.prob FROM hits h JOIN dp USING (doc_id) WHERE pos = 1) x ON x.item_id = q.item_id AND x.term = q.term LEFT JOIN (SELECT h.item_id, dp.term, dp.prob FROM hits h JOIN dp USING (doc_id) WHERE pos = 2) y ON y.item_id = q.item_id AND y.term = q.term),
em AS (SELECT item_id, 1.0::DOUBLE / 3 AS w1, 1.0::DOUBLE / 3 AS w2, 1.0::DOUBLE / 3 AS w3, 0.0::DOUBLE AS likelihood, 0 AS steps, false AS done FROM (SELECT DISTINCT item_id FROM rows)
UNION ALL SELECT item_id, CASE WHEN stop THEN w1 ELSE g1 / (g1 + g2 + g3) END, CASE WHEN stop THEN w2 ELSE g2 / (g1 + g2 + g3) END, CASE WHEN stop THEN w3 ELSE g3 / (g1 + g2 + g3) END, here, steps + CASE WHEN stop THEN 0 ELSE 1 END, stop
FROM (SELECT *, steps >= 20 OR (steps > 1 AND abs(here - likelihood) < abs(here + likelihood) * 1e-6) AS stop FROM (SELECT e.item_id, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, any_value(likelihood) AS likelihood, any_value(steps) AS steps,
sum(CASE WHEN w1 * c1 + w2 * c2 + w3 * c3 > 0 THEN n * ln(w1 * c1 + w2 * c2 + w3 * c3) ELSE 0 END) AS here, 0.1 + sum(CASE WHEN w1 * c1 + w2 * c2 + w3 * c3 > 0 THEN n * w1 * c1 / (w1 * c1 + w2 * c2 + w3 * c3) ELSE 0 END) AS g1,
0.0 + sum(CASE WHEN w1 * c1 + w2 * c2 + w3 * c3 > 0 THEN n * w2 * c2 / (w1 * c1 + w2 * c2 + w3 * c3) ELSE 0 END) AS g2, 0.9 + sum(CASE WHEN w1 * c1 + w2 * c2 + w3 * c3 > 0 THEN n * w3 * c3 / (w1 * c1 + w2 * c2 + w3 * c3) ELSE 0 END) AS g3
FROM em e JOIN rows USING (item_id) WHERE NOT done GROUP BY 1))),
ends AS (SELECT * FROM em WHERE done) SELECT item_id, (i - 1)::INT AS component, round(CASE i WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END, 6) + 0.0 AS weight, steps FROM ends, (VALUES (1), (2), (3)) v(i)"""


@query(_EM)
def em_mixing_weights(spark: SparkSession, d: str) -> DataFrame:
    w = em.mixing_weights(_em_rows(spark, d), "item_id")
    return w.select("item_id", F.posexplode("weights").alias("component", "weight"), "steps").withColumn("weight", r6("weight"))


@query()
def long_term_model(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's model with the one that EM makes of its neighbours' models: turns of its conversation, then alike ones of others."""
    turns, docs = _turns(spark, d), _docs(spark, d)
    probs, default = _background(spark, d)
    own = lm.truncated(lm.normalised(lm.term_counts(turns, "search_id").withColumnRenamed("tf", "prob"), "search_id", "prob"), "search_id")
    same = turns.select("search_id", "user_id").join(turns.select(F.col("search_id").alias("other"), "user_id"), "user_id").select("search_id", "other")
    most = (turns.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0) + models.DEFAULTS.max_neighbours
    both = lm.likest(lm.term_counts(turns, "search_id").withColumnRenamed("tf", "weight"), "search_id", "other", most, models.DEFAULTS.min_cosine)
    near = models.neighbours(both, same, None, "search_id", "other")
    long = models.history_model(own, own, near, own.withColumnRenamed("search_id", "other"), probs, default, "search_id", "other")
    clicks = turns.select("search_id", F.lit(1).alias("n"))
    return models.combined_model(long, own, clicks, "search_id").withColumn("prob", r6("prob"))


@query(f"WITH {TURNS}, n AS (SELECT search_id, term, tf / sum(tf) OVER (PARTITION BY search_id) AS prob FROM t), g AS (SELECT search_id // 1000 AS user_id, term, sum(prob) AS prob FROM n GROUP BY 1, 2) SELECT user_id, term, round(prob, 6) AS prob, round(prob / sum(prob) OVER (PARTITION BY user_id), 6) AS share FROM g")
def group_models(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    m = lm.normalised(lm.term_counts(turns, "search_id").withColumnRenamed("tf", "prob"), "search_id", "prob")
    plain, share = (topics.group_models(m, turns, "search_id", "user_id", normal) for normal in (False, True))
    return plain.select("user_id", "term", r6("prob").alias("prob")).join(share.select("user_id", "term", r6("prob").alias("share")), ["user_id", "term"])


@query()
def built_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics of conversations: turns of one session or one text are joined, their summed models clustered, each topic's model its searches'."""
    turns = _turns(spark, d)
    found = sessions.min_labels(turns.select(F.col("search_id").alias("node")), _session_links(spark, d))
    searches = turns.join(found.select(F.col("node").alias("search_id"), F.col("root").cast("string").alias("session_id")), "search_id").withColumnRenamed("text", "query")
    m = lm.normalised(lm.term_counts(turns, "search_id").withColumnRenamed("tf", "prob"), "search_id", "prob")
    members, terms = topics.build_topics(searches, m)
    return members.join(terms.groupBy("topic").agg(F.count(F.lit(1)).alias("terms")), "topic")


@query("SELECT topic, criterion, CASE criterion WHEN 'click' THEN clicks WHEN 'query' THEN queries ELSE sessions END AS score, (row_number() OVER (PARTITION BY criterion ORDER BY CASE criterion WHEN 'click' THEN clicks WHEN 'query' THEN queries ELSE sessions END DESC, topic))::INT AS rank FROM (SELECT user_id % 20 AS topic, count(DISTINCT user_id) AS sessions, count(event_type) AS queries, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 3), (VALUES ('click'), ('query'), ('session')) c(criterion)")
def listed_topics(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").select((F.col("user_id") % 20).alias("topic"), F.col("user_id").alias("session_id"), F.col("event_type").alias("query"), F.when(F.col("event_type") == "click", F.col("props")).alias("clicked_url"))
    stats = topics.nontrivial(topics.topic_stats(m, "topic"))
    each = [topics.listed(stats, c).select("topic", F.lit(c).alias("criterion"), "score", "rank") for c in ("click", "query", "session")]
    return each[0].unionByName(each[1]).unionByName(each[2])


_ACTIVE = "ts + INTERVAL 1 SECOND * (event_id % 4 * 1200)"


@query(f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS c, epoch_us({_ACTIVE}) // 1000000 AS l, epoch_us(TIMESTAMP '2024-01-10 12:00:00') // 1000000 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT a.user_id, a.event_id AS x, b.event_id AS y, a.n AS na, b.n AS nb FROM e a JOIN e b ON a.user_id = b.user_id AND b.n > a.n AND b.c - a.l <= 1800 AND NOT (b.c > a.f AND a.f > a.c)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, y ORDER BY na DESC) AS k FROM p)
SELECT user_id, event_id AS anchor, event_id FROM e UNION ALL SELECT user_id, x, y FROM p UNION ALL SELECT user_id, y, x FROM k WHERE nb - na = k""")
def time_based_session(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumns({"last": F.expr("ts + make_dt_interval(0, 0, 0, event_id % 4 * 1200)"), "ended": F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")})
    return events.time_based_session(e, "user_id", "event_id", "ts", "last", "ended")


@query(f"SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))::INT AS rank FROM events QUALIFY rank BETWEEN 11 AND 20")
def reverse_history_page(spark: SparkSession, d: str) -> DataFrame:
    return events.reverse_page(table(spark, d, "events"), "user_id", "ts", "event_id", start=11).select("event_id", "user_id", "rank")


@query("SELECT l.doc_id, d.doc_id IS NOT NULL AS known FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') d ON l.doc_id = d.doc_id")
def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    rows, docs = table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").where("lang = 'en'")
    return events.known(rows, docs, "doc_id").withColumn("known", F.lit(True)).unionByName(events.orphans(rows, docs, "doc_id").withColumn("known", F.lit(False)))


@query(f"{_HEAD} SELECT b.item_id, count(CASE WHEN clicked THEN 1 END) > 0 AS adaptive FROM benchmark b LEFT JOIN cl USING (item_id) GROUP BY 1")
def adaptive_models(spark: SparkSession, d: str) -> DataFrame:
    return models.adaptive(table(spark, d, "benchmark").select("item_id"), _clicked_hits(spark, d).where("clicked"), "item_id")


@query("""WITH a AS (SELECT event_id, (user_id % 97 + 1) AS s, (event_id % 130 + 1) AS n FROM events), b AS (SELECT *, s // 10 * 10 + 1 AS low, s + n - (s // 10 * 10 + 1) AS need FROM a)
SELECT event_id, low::INT AS bing_start, low::INT AS boss_start, CASE WHEN need > 100 THEN 100 ELSE (need + 9) // 10 * 10 END::INT AS boss_count, (low // (CASE WHEN need > 10 THEN 20 ELSE 10 END) * (CASE WHEN need > 10 THEN 20 ELSE 10 END) + 1)::INT AS aol_start, (CASE WHEN need > 10 THEN 20 ELSE 10 END)::INT AS aol_count FROM b""")
def page_requests(spark: SparkSession, d: str) -> DataFrame:
    s, n = F.col("user_id") % 97 + 1, F.col("event_id") % 130 + 1
    e = table(spark, d, "events").select("event_id", *(rank.page_request(k, s, n).alias(k) for k in ("bing", "boss", "aol")))
    return e.select("event_id", F.col("bing.start").alias("bing_start"), F.col("boss.start").alias("boss_start"), F.col("boss.count").alias("boss_count"), F.col("aol.start").alias("aol_start"), F.col("aol.count").alias("aol_count"))


@query("WITH m AS (SELECT user_id % 20 AS topic, user_id AS session_id, event_type AS query, CASE WHEN event_type = 'click' THEN props END AS url FROM events), s AS (SELECT topic, count(DISTINCT session_id) AS sessions, count(query) AS queries, count(DISTINCT query) AS unique_queries, count(url) AS clicks, count(DISTINCT url) AS unique_clicks FROM m GROUP BY 1) SELECT *, clicks AS score FROM s WHERE sessions >= 3")
def topic_stats(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").select((F.col("user_id") % 20).alias("topic"), F.col("user_id").alias("session_id"), F.col("event_type").alias("query"), F.when(F.col("event_type") == "click", F.col("props")).alias("clicked_url"))
    s = topics.topic_stats(m, "topic").where("sessions >= 3")
    return s.withColumn("score", topics.sorting_score(F.lit("click")))


@query(f"""WITH {DOCS}, {BACK}, fp AS (SELECT doc_id, term, tf::DOUBLE AS f, p FROM d JOIN bg USING (term)), {_mix('fp', 'doc_id')}, dm AS (SELECT * FROM mix WHERE prob > 0),
tc AS (SELECT source, term, sum(tf)::DOUBLE AS prob FROM d JOIN documents USING (doc_id) GROUP BY 1, 2), dn AS (SELECT doc_id, sum(prob * prob) AS n FROM dm GROUP BY 1), sn AS (SELECT source, sum(prob * prob) AS n FROM tc GROUP BY 1),
dots AS (SELECT doc_id, tc.source, sum(dm.prob * tc.prob) AS dot FROM dm JOIN tc USING (term) GROUP BY 1, 2), sims AS (SELECT doc_id, source, round(dot / sqrt(dn.n * sn.n), 6) AS sim FROM dots JOIN dn USING (doc_id) JOIN sn USING (source))
SELECT doc_id, source, sim, sim > 0.2 AS recommended FROM sims QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, source) = 1""")
def recommend_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    probs, default = _background(spark, d)
    by_source = docs.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "term").agg(F.sum("tf").cast("double").alias("prob"))
    return recommend.recommend(docs, by_source, probs, default, "doc_id", "source")


@query(f"""WITH {DOCS}, tc AS (SELECT source, term, sum(tf)::DOUBLE AS c FROM d JOIN documents USING (doc_id) GROUP BY 1, 2), n AS (SELECT source, term, c / sum(c) OVER (PARTITION BY source) AS prob FROM tc),
r AS (SELECT *, row_number() OVER w AS place, coalesce(sum(prob) OVER (PARTITION BY source ORDER BY prob DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER (PARTITION BY source) AS n FROM n WINDOW w AS (PARTITION BY source ORDER BY prob DESC, term)),
k AS (SELECT * FROM r WHERE place <= 10 AND prob >= 0.01 AND before < 0.9) SELECT source, place::INT AS place, term FROM k UNION ALL SELECT source, (max(place) + 1)::INT, '...' FROM k GROUP BY source HAVING max(n) > max(place)""")
def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    counts = _docs(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "term").agg(F.sum("tf").cast("double").alias("prob"))
    return topics.shown_terms(lm.normalised(counts, "source", "prob"), "source").select("source", "place", "term")


@query("SELECT event_id, user_id, CASE WHEN ts::DATE IS DISTINCT FROM lag(ts::DATE) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN ts::DATE END AS shown FROM events")
def date_headers(spark: SparkSession, d: str) -> DataFrame:
    return events.date_headers(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "shown")


@query("SELECT item_id, 'http://www.bing.com/search?q=' || replace(url_encode(text), '%20', '+') || '&first=' || (item_id % 5 * 10 + 1) AS bing, 'http://search.aol.com/aol/search?q=' || replace(url_encode(text), '%20', '+') || '&page=' || (item_id % 5 + 1) || '&count_override=10' AS aol, 'http://other/?q=' || replace(url_encode(text), '%20', '+') AS link FROM benchmark")
def result_page_urls(spark: SparkSession, d: str) -> DataFrame:
    start, t = (F.col("item_id") % 5 * 10 + 1).cast("int"), F.col("text")
    return table(spark, d, "benchmark").select("item_id", T.result_page_url("bing", t, start).alias("bing"), T.result_page_url("aol", t, start).alias("aol"), T.search_link("http://other/?q=", t).alias("link"))


@query(f"{_HEAD}, known AS (SELECT * FROM hits WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT item_id, count(DISTINCT CASE WHEN pos BETWEEN 2 AND 6 THEN pos END) = 5 AS complete FROM known GROUP BY 1")
def complete_ranges(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "labels").select("doc_id")
    return rank.covered(_hits(spark, d).join(labelled, "doc_id", "left_semi"), "item_id", 2, 5)


@query(f"WITH old AS (SELECT user_id, {ITEM} AS item, min(event_id) AS event_id FROM events GROUP BY ALL), new AS (SELECT user_id, {ITEM} AS item, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT user_id, item, coalesce(new.event_id, old.event_id) AS event_id FROM old LEFT JOIN new USING (user_id, item)")
def merged_pages(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    old, new = e.groupBy("user_id", "item").agg(F.min("event_id").alias("event_id")), e.where("event_type = 'click'").groupBy("user_id", "item").agg(F.max("event_id").alias("event_id"))
    return rank.merged_pages(old, new, "user_id", "item")


@query("WITH m AS (SELECT user_id, TIMESTAMP '2024-01-20 00:00:00' AS ts FROM events GROUP BY 1), l AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'click' GROUP BY 1) SELECT user_id, coalesce(last > ts, false) AS outdated FROM m LEFT JOIN l USING (user_id)")
def outdated_models(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_type", "type")
    m = e.select("user_id").distinct().withColumn("ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return models.outdated(m, e, "user_id", "click").select("user_id", "outdated")


@query(f"WITH {DOCS} SELECT term, sum(tf)::BIGINT AS count FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500")
def commonest_terms(spark: SparkSession, d: str) -> DataFrame:
    return texts.commonest_terms(index_of(spark, f"{d}/documents.parquet").terms(), 500)


@query(f"SELECT user_id, min(event_id::VARCHAR) AS first_id, max(event_id::VARCHAR) AS last_id, last({ITEM} ORDER BY ts, event_id) FILTER (event_type = 'view') AS last_view FROM events GROUP BY 1")
def first_last_ids(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("id", F.col("event_id").cast("string"))
    ids = e.groupBy("user_id").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    views = events.last_start(e.withColumnsRenamed({"event_type": "type", "item": "start_pos"}), "user_id").withColumnRenamed("start_pos", "last_view")
    return ids.join(views, "user_id", "left")


@query("SELECT event_id, user_id, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 'short' ELSE 'long' END AS tier FROM events")
def two_tier_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The short tier is what is recent, the long one everything."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return rank.first_tier(e.where("ts >= timestamp_ntz '2024-01-15'").drop("ts"), e.drop("ts"), "event_id")


@query("SELECT c.conv_id, c.turn, e.is_expired AS keep FROM conversations c JOIN (SELECT conv_id, max(turn) < 5 AS is_expired FROM conversations GROUP BY 1) e USING (conv_id) WHERE c.role = 'user'")
def history_split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.where("role = 'user'").join(c.groupBy("conv_id").agg((F.max("turn") < 5).alias("keep")), "conv_id").select("conv_id", "turn", "keep")


# --- beyond: relational checks on the star schema ---


@query("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def star_left_joins(spark: SparkSession, d: str) -> DataFrame:
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("n_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def star_semi_except(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")
    return c.subtract(o.where("o_orderpriority LIKE '1%'").select("o_custkey"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def star_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, (row_number() OVER w)::INT AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY rn <= 3")
def star_top3(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).where("rn <= 3")
