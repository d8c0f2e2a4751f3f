"""Text, markup and URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"
ASCII = r"^[\x20-\x7F]*$"


def tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits or of any other non-ASCII characters."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_ascii(text: Column) -> Column:
    """Whether all characters are printable ASCII (127 passes, so does the empty text)."""
    return text.rlike(ASCII)


def plain_tokens(text: Column) -> Column:
    """tokens() without those that hold a non-ASCII character."""
    return F.filter(tokens(text), is_ascii)


def words(text: Column, phrases: bool = False) -> Column:
    """Runs without blanks; with phrases, a quote at the start of a token opens one that ends at the next quote or the end."""
    if not phrases:
        return F.regexp_extract_all(text, F.lit(r"[^ \t\n\r]+"), F.lit(0))
    return F.transform(F.regexp_extract_all(text, F.lit(r'"[^"]*"?|[^ \t\n\r]+'), F.lit(0)), lambda t: t)


def keywords(text: Column) -> Column:
    """array<struct<flag, words>>: - excludes, + includes, site: restricts; a quoted phrase is one keyword of several words."""

    def parse(t: Column) -> Column:
        quoted = t.startswith('"')
        body = F.when(quoted, F.regexp_replace(t, '^"|"$', "")).when(t.startswith("site:"), F.substr(t, F.lit(6))).when(t.startswith("-") | t.startswith("+"), F.substr(t, F.lit(2))).otherwise(t)
        flag = F.when(quoted, "NONE").when(t.startswith("-"), "EXCLUDE").when(t.startswith("+"), "INCLUDE").when(t.startswith("site:"), "SITE").otherwise("NONE")
        return F.struct(flag.alias("flag"), words(body).alias("words"))

    return F.filter(F.transform(words(text, phrases=True), parse), lambda k: F.size(k["words"]) > 0)


def query_text(parsed: Column) -> Column:
    """The words of plain and included keywords, joined by blanks."""
    used = F.filter(parsed, lambda k: k["flag"].isin("NONE", "INCLUDE"))
    return F.array_join(F.flatten(F.transform(used, lambda k: k["words"])), " ")


def is_html(text: Column) -> Column:
    """Whether the text holds an end tag."""
    return text.contains("</")


def strip_html(text: Column) -> Column:
    """Without tags; a stray > goes too, and an open < takes the rest."""
    return F.regexp_replace(text, "<[^>]*>?|>", "")


def display_url(url: Column, most: int = 50) -> Column:
    """Without scheme; longer than most characters (a last slash not counted): the first of them and three dots."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(url)
    short = F.when(rest.endswith("/"), F.substr(rest, F.lit(1), F.length(rest) - 1)).otherwise(rest)
    return F.when(F.length(short) > most, F.concat(F.substr(short, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(short)


#: Characters and their entities, & first when quoting.
ENTITIES = (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ('"', "&quot;"), ("'", "&apos;"))


def quote(text: Column) -> Column:
    """Markup characters as entities."""
    for char, entity in ENTITIES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def unquote(text: Column) -> Column:
    """Entities as characters; &amp; is decoded last."""
    for char, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def bold_as_strong(text: Column) -> Column:
    """Result markup: b becomes strong, all other tags go."""
    kept = F.regexp_replace(F.regexp_replace(text, "<b>", "\x01"), "</b>", "\x02")
    return F.replace(F.replace(F.regexp_replace(kept, "<[^>]*>", ""), F.lit("\x01"), F.lit("<strong>")), F.lit("\x02"), F.lit("</strong>"))


def without_breaks(text: Column) -> Column:
    """Result markup without word-break tags."""
    return F.regexp_replace(text, "</?wbr>", "")


def plain_text(text: Column) -> Column:
    """Result markup without tags and with decoded entities."""
    return unquote(F.regexp_replace(text, "<[^>]*>", ""))


def url_encode(text: Column) -> Column:
    """Percent encoding that keeps letters, digits and -_.~ and writes a blank as +."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_decode(text: Column) -> Column:
    """The decoded text; null for a damaged one."""
    return F.try_url_decode(text)



def url_parts(url: Column) -> Column:
    """struct<scheme, host, port, path, query, fragment>; what is missing is empty. A path of / alone, or a query without a path, empties all."""
    names = ("scheme", "host", "port", "path", "query", "fragment")
    return F.struct(*(F.regexp_extract(url, URL, i).alias(n) for i, n in enumerate(names, 1)))


#: Fixed value: the form of an address.
URL = r"^(?:(?:([^:/]+)://)?([^:/]+)(?::(\d+))?)?(?:(/[^?#]+)(?:\?([^#]+))?(?:#(.*))?)?$"


def query_params(query: Column) -> Column:
    """array<struct<name, value>> of a query string, in order, decoded; parts without a name or without = are left out, null where one is damaged."""
    found = F.regexp_extract_all(query, F.lit(r"[^=&]+=[^=&]*"), F.lit(0))
    pairs = F.transform(found, lambda p: F.struct(url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("name"), url_decode(F.split_part(p, F.lit("="), F.lit(2))).alias("value")))
    return F.when(~F.exists(pairs, lambda p: p["name"].isNull() | p["value"].isNull()), pairs)


def build_query(params: Column) -> Column:
    """The query string that query_params() reads as these, encoded."""
    return F.array_join(F.transform(params, lambda p: F.concat(url_encode(p["name"]), F.lit("="), url_encode(p["value"]))), "&")


def param(params: Column, name: str) -> Column:
    """The value of the last parameter of this name, null without one."""
    return F.get(F.filter(params, lambda p: p["name"] == name), F.size(F.filter(params, lambda p: p["name"] == name)) - 1)["value"]


def without_param(params: Column, name: str) -> Column:
    return F.filter(params, lambda p: p["name"] != name)


def with_param(params: Column, name: str, value: Column) -> Column:
    """The parameters with one of this name, at the end."""
    return F.concat(without_param(params, name), F.array(F.struct(F.lit(name).alias("name"), value.alias("value"))))


def rebuilt_url(parts: Column, params: Column) -> Column:
    """The address of url_parts() with these parameters in place of its query."""
    some = lambda before, x: F.when(x != "", F.concat(F.lit(before), x)).otherwise("")
    scheme = F.when(parts["scheme"] != "", F.concat(parts["scheme"], F.lit("://"))).otherwise("")
    return F.concat(scheme, parts["host"], some(":", parts["port"]), parts["path"], some("?", build_query(params)), some("#", parts["fragment"]))


def attributes(text: Column) -> Column:
    """map<name, value> of the attributes in a tag's text, with decoded entities; the last of equal names wins."""
    form = r'\s+(\w+)\s*=\s*"([^"]*?)"'
    found = F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda a: F.struct(F.regexp_extract(a, form, 1).alias("k"), unquote(F.regexp_extract(a, form, 2)).alias("v")))
    return F.aggregate(found, F.create_map().cast("map<string,string>"), lambda m, kv: F.map_concat(F.map_filter(m, lambda k, v: k != kv["k"]), F.map_from_arrays(F.array(kv["k"]), F.array(kv["v"]))))


def trimmed_template(text: Column) -> Column:
    """A template whose lines of nothing but one tag or placeholder lose the white space around it and their line end."""
    body = F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    return F.regexp_replace(body, r"(?m)^[ \t]*(</?template:\w+[^>\n]*?>|\$\{\w+\})[ \t]*\n", "$1")


def template_test(kind: str, value: Column, other: Column | None = None) -> Column:
    """A template's tests: eq, neq, exist, nexist, empty, nempty."""
    empty = F.coalesce(F.length(value) == 0, F.lit(True))
    return {"eq": lambda: value.eqNullSafe(other), "neq": lambda: ~value.eqNullSafe(other), "exist": value.isNotNull, "nexist": value.isNull, "empty": lambda: empty, "nempty": lambda: ~empty}[kind]()


def shown_result(title: Column, formatted_title: Column, summary: Column, formatted_summary: Column, url: Column, shown_url: Column, formatted_url: Column) -> Column:
    """struct<title, summary, url, shown_url> of a hit: the formatted parts where there are any, the address shortened where none is given."""
    first = lambda *c: F.coalesce(*(F.when(x != "", x) for x in c), F.lit(""))
    return F.struct(first(formatted_title, title).alias("title"), first(formatted_summary, summary).alias("summary"), url.alias("url"), first(formatted_url, shown_url, display_url(url)).alias("shown_url"))


def document_text(title: Column, summary: Column) -> Column:
    """The text of a document that is indexed."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))


#: File endings and their media types.
MEDIA_TYPES = {"css": "text/css", "gif": "image/gif", "htm": "text/html", "html": "text/html", "ico": "image/x-icon", "jpg": "image/jpeg", "jpeg": "image/jpeg", "js": "application/javascript", "png": "image/png", "swf": "application/x-shockwave-flash", "txt": "text/plain", "xml": "text/xml"}


def media_type(path: Column) -> Column:
    """By the ending of a path, else application/octet-stream."""
    table = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.coalesce(F.element_at(table, F.regexp_extract(path, r"\.([^./]*)$", 1)), F.lit("application/octet-stream"))


def cookies(header: Column) -> Column:
    """map<name, value> of a Cookie header; the last of equal names wins."""
    found = F.transform(F.regexp_extract_all(header, F.lit(r"([^=;\s]+)=([^;]*)"), F.lit(0)), lambda c: F.struct(F.split_part(c, F.lit("="), F.lit(1)), F.substr(c, F.instr(c, "=") + 1)))
    return F.aggregate(found, F.create_map().cast("map<string,string>"), lambda m, kv: F.map_concat(F.map_filter(m, lambda k, v: k != kv["col1"]), F.map_from_arrays(F.array(kv["col1"]), F.array(kv["col2"]))))


def count_value(text: Column) -> Column:
    """A number written with thousands commas; null where it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("long")


def sql_literal(text: Column) -> Column:
    """Text with quotes and backslashes doubled; prefer bound arguments."""
    return F.regexp_replace(text, r"(['\"\\])", "$1$1")


#: Result-page addresses of search services by name, with the text and start (or page number) to fill in.
RESULT_PAGES = {"bing": "http://www.bing.com/search?q=%s&first=%d", "aol": "http://search.aol.com/aol/search?q=%s&page=%d&count_override=%d", "boss": "http://boss.yahooapis.com/ysearch/web/v1/%s?start=%d&count=%d&format=xml"}


def result_page_url(engine: str, text: Column, start: Column, size: int = 10) -> Column:
    """The address of the result page that begins at start: by rank, by page number and its size for aol, by the rank from 0 and the count for boss."""
    if engine == "boss":
        return F.format_string(RESULT_PAGES[engine], url_encode(text), start - 1, F.lit(size))
    if engine == "aol":
        return F.format_string(RESULT_PAGES[engine], url_encode(text), F.floor((start - 1) / size).cast("int") + 1, F.lit(size))
    return F.format_string(RESULT_PAGES[engine], url_encode(text), start)


def search_link(prefix: str, text: Column) -> Column:
    """A link to another service's results."""
    return F.concat(F.lit(prefix), url_encode(text))
