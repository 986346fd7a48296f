"""Tabular extraction from fetched HTML pages (the parsing half of a scraper).

One pass over a page reads its markup as a browser does: comments, scripts and
styles go, a ``>`` inside a quoted value ends no tag, attributes are read name by
name.  What is left is cut into arrays: anchors, rows and cells (whose end tags
may be left out), and the opening and closing of boxes, which a fold follows by
their depth.  All facts of a page lie in its row, and a whole page record is one
narrow projection without an exchange.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgraph.functions.text import strip_ws

# Fixed values (the site's markup and the record layout).
DETAIL_PREFIX = "/details"
PAGINATION_CLASS = "search__body__pagination__arrow"
DISABLED_CLASS = "is-disabled"
DOWNLOAD_CLASS = "detail__header__button"
HEADER_CLASS = "detail__header__column"
TABLE_LABELS = ("Organisatie", "Opleiding")

# the rest of a tag after its name: quoted values whole
_REST = r"""(?:[^>"']+|"[^"]*"|'[^']*')*+>"""
_TAG = r"(?:<{name}\b" + _REST + r"|<{name}\b[^>]*>)"  # the second: a quote that nobody closes
_MARKUP = (r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)|(</?[a-z]" + _REST + ")")
_ATTRIBUTE = r"""(?s)([^\s=>"'/][^\s=>/]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""


def _tag(name: str) -> str:
    return _TAG.replace("{name}", name)


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _named() -> dict[str, str]:
    """Every named character of the HTML standard, from the standard library."""
    return {name[:-1]: char for name, char in html5.items() if name.endswith(";")}


def unescape(col):
    """Character references decoded, each once and in one pass: the text is cut
    at its references and every piece is looked at by itself."""
    c = _c(col)
    refs = F.regexp_extract_all(c, F.lit(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"), 1)
    between = F.split(c, r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", -1)
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in _named().items())), F.lit("\x01"), F.lit("\x02"))

    def decoded(r):
        code = F.when(r.rlike("^#[xX]"), F.conv(F.substr(r, F.lit(3)), 16, 10)).when(r.startswith("#"), F.substr(r, F.lit(2))).cast("long")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        number = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        name = F.try_element_at(table, r)
        return F.when(valid, number).when(code.isNotNull(), F.lit("\ufffd")).otherwise(F.coalesce(name, F.concat(F.lit("&"), r, F.lit(";"))))

    chars = F.concat(F.transform(refs, decoded), F.array(F.lit("")))
    # a text without a reference, nearly all of them, is left alone
    return F.when(F.size(refs) > 0, F.array_join(F.zip_with(between, chars, lambda x, y: F.concat(x, y)), "")).otherwise(c)


def text_of(col):
    """Text content of an HTML fragment: tags removed, entities decoded."""
    return unescape(F.regexp_replace(_c(col), r"(?i)</?[a-z]" + _REST + r"|<[^>]*>", ""))


def markup(col):
    """The page without comments, scripts and styles; tags stay as they are."""
    return F.regexp_replace(_c(col), _MARKUP, "$2")


def attr(tag, name: str):
    """Value of the first attribute of that name of a tag, NULL when absent."""
    inside = F.regexp_replace(_c(tag), r"(?s)^<[^\s/>]+|/?>$", "")
    names = F.transform(F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), 1), F.lower)
    value = F.get(F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), 2), F.array_position(names, name).cast("int") - 1)
    return F.when(F.array_contains(names, name), unescape(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")))


def anchors(html_col: str = "html", clean: bool = False):
    """Array of (href, class) of a page's anchors, in page order; ``clean``: the
    column went through ``markup`` already (here and below)."""
    tags = F.regexp_extract_all(_c(html_col) if clean else markup(html_col), F.lit("(?i)" + _tag("a")), 0)
    return F.transform(tags, lambda t: F.struct(attr(t, "href").alias("href"), attr(t, "class").alias("class")))


def _of_class(cls: str):
    return lambda a: F.array_contains(F.split(F.coalesce(a["class"], F.lit("")), r"\s+"), cls)


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, class) of the anchors that carry an href (I1), pos from 0."""
    linked = F.filter(anchors(), lambda a: a["href"].isNotNull())
    return pages.select("page_id", F.posexplode(linked).alias("pos", "a")).select("page_id", "pos", "a.href", "a.class")


def filter_links(links: DataFrame, prefix: str = DETAIL_PREFIX) -> DataFrame:
    return links.filter(F.col("href").startswith(prefix))


def next_page(pages: DataFrame, cls: str = PAGINATION_CLASS) -> DataFrame:
    """(page_id, next_href): the second anchor of ``cls``; NULL when it is
    disabled, missing, or has no href."""
    second = F.get(F.filter(anchors(), _of_class(cls)), F.lit(1))
    row = pages.select("page_id", second.alias("a"))
    return row.select("page_id", F.when(~_of_class(DISABLED_CLASS)(F.col("a")), F.col("a.href")).alias("next_href"))


def download_link(html_col: str = "html", cls: str = DOWNLOAD_CLASS, base: str = "", clean: bool = False):
    """Absolute address of the first anchor of ``cls``, NULL when there is none or it has no href."""
    return F.concat(F.lit(base), F.get(F.filter(anchors(html_col, clean), _of_class(cls)), F.lit(0))["href"])


def page_title(html_col: str = "html", container: str = HEADER_CLASS, clean: bool = False):
    """h1 text inside the first box of the header class -- NULL when that holds
    none -- or the first h1 of a page without such a box; spaces -> _.

    Boxes nest: the fold counts how deep in the header box an event lies."""
    head = r"<h1\b[^>]*>.*?(?:</h1\s*>|(?=<(?:h[1-6]|div|p|table|ul|ol|section|article)\b)|\z)"
    events = F.regexp_extract_all(_c(html_col) if clean else markup(html_col), F.lit(f"(?is){_tag('div')}|</div\\s*>|{head}"), 0)
    state = "struct<depth:int,met:boolean,inside:string,first:string>"

    def follow(acc, e):
        opens, closes, h1 = e.rlike("(?i)^<div"), e.rlike("(?i)^</div"), e.rlike("(?i)^<h1")
        within = acc["depth"] > 0
        starts = opens & ~acc["met"] & F.array_contains(F.split(F.coalesce(attr(e, "class"), F.lit("")), r"\s+"), container)
        depth = acc["depth"] + F.when(starts | (opens & within), 1).when(closes & within, -1).otherwise(0)
        return F.struct(depth.alias("depth"), (acc["met"] | starts).alias("met"),
                        F.coalesce(acc["inside"], F.when(h1 & within, e)).alias("inside"), F.coalesce(acc["first"], F.when(h1, e)).alias("first")).cast(state)

    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("met"), none.alias("inside"), none.alias("first")).cast(state)
    raw = F.aggregate(events, start, follow, lambda acc: F.when(acc["met"], acc["inside"]).otherwise(acc["first"]))
    return F.replace(text_of(raw), F.lit(" "), F.lit("_"))


def table_rows(html_col: str = "html", clean: bool = False):
    """Array of (label, value), the first two cells of each table row that has
    as many, as stripped text.  A row ends at the next row, its end tag or the end
    of its table; a cell at the next cell, its end tag or the end of the row."""
    parts = F.split(_c(html_col) if clean else markup(html_col), "(?i)" + _tag("tr"), -1)
    inner = F.transform(F.slice(parts, 2, F.size(parts)), lambda r: F.regexp_extract(r, r"(?is)^(.*?)(?:</?(?:tr|table|tbody|thead|tfoot)\b|\z)", 1))

    def cells(row):
        cut = F.split(row, "(?i)" + _tag("td"), -1)
        return F.transform(F.slice(cut, 2, F.size(cut)), lambda c: F.regexp_extract(c, r"(?is)^(.*?)(?:</?t[dh]\b|\z)", 1))

    return F.transform(F.filter(F.transform(inner, cells), lambda c: F.size(c) >= 2),
                       lambda c: F.struct(strip_ws(text_of(c[0])).alias("label"), strip_ws(text_of(c[1])).alias("value")))


def attributes(labels=TABLE_LABELS, html_col: str = "html", clean: bool = False):
    """One column per label: the value of the last row that carries it."""
    rows = table_rows(html_col, clean)

    def last(label):
        return F.try_element_at(F.filter(rows, lambda r: r["label"] == label), F.lit(-1))["value"].alias(label.lower())

    return [last(label) for label in labels]


def table_attributes(pages: DataFrame, labels=TABLE_LABELS) -> DataFrame:
    """(page_id, <label lower-cased>...)."""
    return pages.select("page_id", *attributes(labels))


def page_records(pages: DataFrame, base: str = "", labels=TABLE_LABELS) -> DataFrame:
    """(page_id, download_url, title, organisatie, opleiding)."""
    m = pages.select("page_id", markup("html").alias("html"))
    return m.select("page_id", download_link(base=base, clean=True).alias("download_url"), page_title(clean=True).alias("title"), *attributes(labels, clean=True))


def target_path(records: DataFrame) -> DataFrame:
    """+ path: ``organisatie/opleiding/<title>.pdf``, spaces -> _; without
    either part there is no sub-directory.  The file name replaces the text after
    the title's last dot (a name starting with its only dot keeps it)."""
    t = F.col("title")
    stem = F.when(t.rlike(r"^[^.].*\.[^.]*$") | t.rlike(r"^\..*\.[^.]*$"), F.regexp_extract(t, r"^(.*)\.[^.]*$", 1)).otherwise(t)
    folder = F.concat(F.replace(F.col("organisatie"), F.lit(" "), F.lit("_")), F.lit("/"),
                      F.replace(F.col("opleiding"), F.lit(" "), F.lit("_")), F.lit("/"))
    return records.withColumn("path", F.concat(F.coalesce(folder, F.lit("")), stem, F.lit(".pdf")))


def pending_downloads(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Records whose target path is not yet present (anti join); a record
    without a path has nothing to download."""
    return records.filter(F.col("path").isNotNull()).join(existing.select("path"), "path", "left_anti")


def limit_records(records: DataFrame, n: int = 1000) -> DataFrame:
    """At most n records in discovery order (a distributed top-n)."""
    return records.orderBy("page_id").limit(int(n))
