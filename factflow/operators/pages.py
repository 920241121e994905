"""What a raw HTML page holds: one pass with the standard parser gives its parts, one row a page.

Parsing is Python; what is chosen among the parts (meta fields, question-answer pairs, the
author) is DataFrame work on the arrays that come back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factflow.functions import jsonld
from factflow.functions.text import clean_author, normalize, staged
from factflow.functions.urls import host, host_excluded, registrable_domain, resolve

# Elements without main text, elements without an end tag.
DROPPED = {"script", "style", "noscript", "nav", "header", "footer", "form", "svg", "iframe", "aside"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
# Where an author is named, in order of trust.
AUTHOR_META = (("property", "article:author"), ("property", "og:article:author"), ("name", "author"), ("property", "author"))
BYLINE_CLASSES = {"author", "byline", "post-author", "article-author", "entry-author", "author-name", "writer"}
# Fixed value: how a text line names its author.
LEAD = re.compile(r"\b(?:By|Written by|Author)\b[:\s]+([A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){0,3})")

SCHEMA = (
    "page_id long, title string, h1s array<string>, h2s array<string>, meta array<struct<attr:string,key:string,content:string>>, canonical string, lead string, "
    "body string, told struct<bylines:array<string>,documents:array<string>>, visible array<struct<question:string,answer:string,source:string>>"
)
COLUMNS = ["page_id", "title", "h1s", "h2s", "meta", "canonical", "lead", "body", "told", "visible"]
_SPACES = re.compile(r"\s+")
STEP = 128  # pages whose parts are held at once


def squeeze(text: str) -> str:
    return _SPACES.sub(" ", text).strip()


class _Node:
    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict) -> None:
        self.tag, self.attrs, self.parts = tag, attrs, []

    def walk(self) -> Iterator[_Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(p for p in reversed(node.parts) if isinstance(p, _Node))

    def text(self, dropped: frozenset | set = frozenset()) -> str:
        out, todo = [], [self]
        while todo:
            p = todo.pop()
            if isinstance(p, str):
                out.append(p)
            elif p.tag not in dropped:
                todo.extend(reversed(p.parts))
        return squeeze("".join(out))


# Elements whose start ends an open paragraph, and what an end tag is not looked for behind.
BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SCOPES = {"table", "td", "th", "caption", "template", "object"}
# Elements that end an open one of their kind, and where the search for it stops.
_ROWS = {"tbody", "thead", "tfoot"}
ENDED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dl"} | SCOPES), "dt": ({"dt", "dd"}, {"dl", "ul", "ol"} | SCOPES), "dd": ({"dt", "dd"}, {"dl", "ul", "ol"} | SCOPES),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"} | _ROWS), **dict.fromkeys(_ROWS, (_ROWS | {"tr"}, {"table"})),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}


class _Tree(HTMLParser):
    """Optional end tags are understood, other unclosed elements end with their parent; a stray end tag is ignored.

    A block ends an open paragraph; an item, term, meaning, option, cell or row ends the one
    before it, in its own list, selection or table.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def _end(self, tags: set[str], stops: set[str]) -> None:
        """Ends the innermost open element of ``tags`` with all it holds, unless one of ``stops`` is further in; of several kinds the outermost in reach."""
        found = 0
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in stops and self.open[k].tag not in tags:
                break
            if self.open[k].tag in tags:
                found = k
                if len(tags) == 1 or tags <= {"dt", "dd"} or tags <= {"td", "th"}:
                    break
        if found:
            del self.open[found:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end({"p"}, SCOPES | {"button"})
        if tag in ENDED:
            self._end(*ENDED[tag])
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """A slash ends nothing but elements that have no end tag anyway."""
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        table = tag in SCOPES or tag in _ROWS or tag == "tr"
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break
            if not table and self.open[k].tag in SCOPES:
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def _is_byline(node: _Node) -> bool:
    kind = node.attrs.get("class", "")
    return node.attrs.get("rel") == "author" or node.attrs.get("itemprop") == "author" or bool(BYLINE_CLASSES & set(kind.split())) or "author" in kind or "byline" in kind


def page(html: str) -> tuple:
    """The parts of a page, in the order of ``SCHEMA``."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    every = list(tree.root.walk())
    by: dict[str, list[_Node]] = {}
    for node in every:
        by.setdefault(node.tag, []).append(node)

    main = next((by[t][0] for t in ("main", "article") if by.get(t)), None)
    if main is None:
        blocks = [(len(n.text(DROPPED)), -k, n) for k, n in enumerate(every) if n.tag in ("div", "section")]
        size, _, block = max(blocks, default=(0, 0, None), key=lambda b: b[:2])
        main = block if size else by.get("body", [tree.root])[0]
    documents = ["".join(p for p in script.parts if isinstance(p, str)) for script in by.get("script", ()) if script.attrs.get("type", "").lower() == "application/ld+json"]
    pairs = []
    for d in by.get("details", ()):
        summary = next((n for n in d.walk() if n.tag == "summary"), None)
        if summary is not None:
            pairs.append((summary.text(), d.text({"summary"}), "visible"))
    for d in by.get("dl", ()):
        terms, meanings = ([n.text() for n in d.walk() if n.tag == t] for t in ("dt", "dd"))
        pairs += [(q, a, "visible") for q, a in zip(terms, meanings, strict=False)]
    meta = [(a, m.attrs[a].lower(), m.attrs.get("content", "")) for m in by.get("meta", ()) for a in ("name", "property") if a in m.attrs]
    said = next((by[t][0] for t in ("article", "main") if by.get(t)), None)
    lead = LEAD.search(said.text()) if said is not None else None
    title = by["title"][0].text() if by.get("title") else None
    heads = [[x for n in by.get(t, ()) if (x := n.text())] for t in ("h1", "h2")]
    canonical = next((n.attrs.get("href") or None for n in by.get("link", ()) if n.attrs.get("rel", "").lower() == "canonical"), None)
    told = {"bylines": [n.text() for n in every if _is_byline(n)], "documents": documents}
    return title or None, *heads, meta, canonical, lead[1] if lead else None, main.text(DROPPED), told, pairs


def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parts of pages (page_id, html), a few pages at a time, however large a batch is."""
    for b in batches:
        for k in range(0, len(b), STEP):
            some = b.iloc[k : k + STEP]
            yield pd.DataFrame([(i, *page(h)) for i, h in zip(some["page_id"], some["html"], strict=True)], columns=COLUMNS)


def parts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a page with what the parser found, and what its JSON-LD says; a null page has no parts.

    JSON-LD is read as variant values. Keys that an object has twice are allowed in the
    session from then on (the last counts), for parsers of pages do so.
    """
    pages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    found = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInPandas(parsed, SCHEMA)
    found = staged(found, read=F.expr("filter(transform(told.documents, d -> named_struct('d', d, 'v', try_parse_json(d))), d -> d.v IS NOT NULL)"))
    found = staged(found, things=F.expr(jsonld.THINGS))
    found = staged(found, names=F.struct(F.expr(jsonld.AUTHORS).alias("data"), F.col("told.bylines").alias("bylines")), asked=F.expr(jsonld.PAIRS))
    bare = lambda text: normalize(F.regexp_replace(text, "<[^>]+>", " "))
    pairs = F.transform("asked", lambda p: F.struct(bare(p["question"]).alias("question"), bare(p["answer"]).alias("answer"), F.lit("jsonld").alias("source")))
    found = staged(found, pairs=F.concat(pairs, "visible"))
    return found.drop("read", "things", "asked", "told", "visible")


def links(pages: DataFrame, excluded: Sequence[str] = (), heed_base: bool = False, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, link): the different pages of its own domain that each page links to, none on an excluded host.

    Every ``href`` of an ``a`` element counts, read relative to the page's URL, or with
    ``heed_base`` to the page's ``base`` element; fragments are dropped. The parser gives
    the attributes, resolution is Column work.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, u, h in zip(b["page_id"], b["url"], b["html"], strict=True):
                tree = _Tree()
                tree.feed(h or "")
                tree.close()
                every = list(tree.root.walk())
                base = next((n.attrs["href"] for n in every if n.tag == "base" and n.attrs.get("href")), "")
                rows.append((i, u, base, [n.attrs["href"] for n in every if n.tag == "a" and n.attrs.get("href")]))
            yield pd.DataFrame(rows, columns=["page_id", "url", "base", "hrefs"])

    kind = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = own.mapInPandas(run, f"page_id {kind}, url string, base string, hrefs array<string>")
    at = F.when(F.col("base") != "", resolve(F.col("url"), F.col("base"))).otherwise(F.col("url")) if heed_base else F.col("url")
    rows = found.select("page_id", "url", at.alias("at"), F.explode("hrefs").alias("href"))
    rows = rows.select("page_id", "url", resolve(F.col("at"), F.col("href")).alias("link"))
    rows = staged(rows, _host=host(F.col("link")), _own=host(F.col("url")))
    rows = rows.where((registrable_domain(F.col("_host")) == registrable_domain(F.col("_own"))) & ~host_excluded(F.col("_host"), excluded))
    return rows.select("page_id", "url", "link").distinct()


def _content(attr: str | None, key: str) -> Column:
    """The content of the first meta element of that name or property."""
    found = F.filter("meta", lambda m: (m["key"] == key) & (m["attr"] == attr if attr else F.lit(True)))
    return F.when(F.size(found) > 0, F.get(found, F.lit(0))["content"])


def _unique(names: Column) -> Column:
    """Without later repeats in any case."""
    return F.filter(names, lambda x, k: ~F.exists(F.slice(names, F.lit(1), k), lambda y: F.lower(y) == F.lower(x)))


def _clean(names: Column) -> Column:
    return F.filter(F.transform(names, clean_author), lambda x: x.isNotNull())


def author() -> Column:
    """The author by the first source that yields a name: article data, meta elements (links skipped), bylines, a line that begins with By."""
    written = F.filter(F.transform("names.data", _clean), lambda a: F.size(a) > 0)
    named = F.array(*[clean_author(_content(a, k)) for a, k in AUTHOR_META])
    named = F.filter(named, lambda x: x.isNotNull() & ~F.lower(x).rlike("^(?:https?:/)?/"))
    return F.coalesce(F.array_join(_unique(F.get(written, F.lit(0))), "; "), F.get(named, F.lit(0)), F.get(_clean(F.col("names.bylines")), F.lit(0)), clean_author(F.col("lead")))


def faqs() -> Column:
    """Question-answer pairs with both sides; of those of one source that ask the same, in any case, the first."""
    whole = F.filter("pairs", lambda p: (p["question"] != "") & (p["answer"] != ""))
    return F.filter(whole, lambda p, k: ~F.exists(F.slice(whole, F.lit(1), k), lambda q: (q["source"] == p["source"]) & (F.lower(q["question"]) == F.lower(p["question"]))))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a page with all fields; a null page has none of them."""
    found = parts(pages, id_col, html_col)
    field = {n: F.nullif(normalize(_content(None, k)), F.lit("")).alias(n) for n, k in (("meta_description", "description"), ("meta_robots", "robots"))}
    return found.select("page_id", "title", "h1s", "h2s", field["meta_description"], "canonical", field["meta_robots"], "body", author().alias("author"), faqs().alias("faqs"))
