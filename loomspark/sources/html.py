"""Records out of web pages. Simple facts are regular expressions; nested ones go through one parser pass per page."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, collapse_ws, strip_marks, trim_ws

#: Elements without an end tag, elements without text of their own, elements that break a line.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "template", "noscript"}
BREAKS = {"address", "article", "aside", "blockquote", "br", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul"}


def title(c) -> Column:
    """The text of the title element; null if there is none."""
    return F.nullif(collapse_ws(F.regexp_extract(col(c), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def language(c) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"""(?is)<html[^>]*\slang=["']?([A-Za-z-]+)""", 1), F.lit(""))


def links(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"""(?is)<a\s[^>]*href=["']([^"']*)["']"""), 1)


def meta(c, name: str) -> Column:
    """A meta element's content by property or name."""
    return F.nullif(F.regexp_extract(col(c), rf"""(?is)<meta[^>]*(?:property|name)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1), F.lit(""))


def canonical_url(c) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col(c), r"""(?is)<link[^>]*rel=["']canonical["'][^>]*href=["']([^"']*)["']""", 1), F.lit("")), meta(c, "og:url"))


def visible_text(c) -> Column:
    """Text between tags, without scripts, styles and comments, white space collapsed; entities stay as written."""
    bare = F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return collapse_ws(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))


def breadcrumbs(c) -> Column:
    """(name, url) of the items of a page's JSON-LD breadcrumb list."""
    body = F.regexp_extract(col(c), r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", 1)
    found = F.from_json(body, "itemListElement array<struct<position: int, name: string, item: string>>")["itemListElement"]
    return F.transform(F.array_sort(found), lambda x: F.struct(x["name"].alias("name"), x["item"].alias("url")))


def title_and_poet(c) -> Column:
    """Title and poet out of a page title 'title - poet - site'; fewer parts give null for the missing ones."""
    parts = F.transform(F.split(col(c), "-"), trim_ws)
    return F.struct(F.get(parts, F.lit(0)).alias("title"), F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).alias("poet"))


#: What an element ends when it begins, if that is still open in its own block.
ENDS = {x: {x} for x in ("p", "li", "option", "tr")} | dict.fromkeys(("dt", "dd"), {"dt", "dd"}) | dict.fromkeys(("td", "th"), {"td", "th"}) | dict.fromkeys(HEADINGS := ("h1", "h2", "h3", "h4", "h5", "h6"), set(HEADINGS))
#: Blocks that such an end doesn't leave.
BLOCKS = {"article", "aside", "body", "div", "footer", "form", "header", "main", "nav", "ol", "section", "table", "td", "th", "ul"}


class _Break(str):
    """A line break that an element makes, as against one in the text."""


BREAK = _Break("\n")


class Span:
    """Where an element's text lies among the page's pieces."""

    __slots__ = ("begin", "end", "extra")

    def __init__(self, begin: int, extra: str | None = None):
        self.begin, self.end, self.extra = begin, None, extra


class Events(HTMLParser):
    """What a record needs, by one pass over a page's tags and texts.

    Every text is kept once, in `pieces`; an element that is looked for is a pair of places in
    it. Open elements are a stack with a count by tag, so an end tag that closes nothing costs
    nothing, and unclosed elements, in any number, cost what they hold.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.open: list[tuple[str, list[Span], tuple[str, ...]]] = []
        self.count: Counter = Counter()  # open elements by tag, and by what they are looked for as
        self.found: dict[str, list[Span]] = defaultdict(list)
        self.facts: dict[str, list] = defaultdict(list)
        self.data: list[str] | None = None  # of a JSON-LD script
        self.last_of: dict[str, list[Span]] = {}  # links and headings hold none of their kind: the next ends the last

    def kinds(self, tag: str, have: dict) -> list[str]:
        """As what this element is looked for."""
        classes = (have.get("class") or "").split()
        out = [tag] if tag in ("title", "h3", "h4", "span") else []
        if tag == "div":
            out += [c for c in ("tips", "pmContainer", "poet-description") if c in classes]
        out += [c for c in ("breadcrumb", "country") if c in classes]
        if tag == "textarea" and have.get("id") == "post_content":
            out.append("post_content")
        if tag == "a":
            out += [f"{c} a" for c in ("tips", "breadcrumb") if self.count[f".{c}"]]
        return out

    def handle_starttag(self, tag, attrs):
        have = dict(attrs)
        for other in ENDS.get(tag, ()):
            if self.count[other]:
                self.implied(ENDS[tag])
                break
        if tag == "link" and have.get("rel") == "canonical":
            self.facts["canonical"].append(have.get("href"))
        elif tag == "meta" and have.get("property") == "og:url":
            self.facts["og:url"].append(have.get("content"))
        elif tag == "script" and have.get("type") == "application/ld+json":
            self.data = []
        if not self.count["silent"] and tag in BREAKS:
            self.pieces.append(BREAK)
        if tag in VOID:
            return
        kinds = self.kinds(tag, have)
        spans = [Span(len(self.pieces), have.get("href")) for _ in kinds]
        for kind, span in zip(kinds, spans, strict=True):
            self.found[kind].append(span)
        if tag == "a" or tag in HEADINGS:
            for span in self.last_of.get(tag, ()):
                span.end = len(self.pieces) if span.end is None else span.end
            self.last_of[tag] = spans
        marks = (*(f".{k}" for k in kinds if k in ("tips", "breadcrumb")), *(["silent"] if tag in SILENT else []))
        self.open.append((tag, spans, marks))
        self.count[tag] += 1
        self.count.update(marks)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close_one()

    def close_one(self):
        tag, spans, marks = self.open.pop()
        self.count[tag] -= 1
        self.count.subtract(marks)
        for span in spans:
            span.end = len(self.pieces) if span.end is None else span.end
        if tag == "script" and self.data is not None:
            self.facts["json"].append("".join(self.data))
            self.data = None
        if tag in BREAKS and not self.count["silent"]:
            self.pieces.append(BREAK)

    def implied(self, ends: set[str]):
        """Close the innermost of these elements with all in it, unless a block lies between."""
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            if tag in ends:
                while len(self.open) > k:
                    self.close_one()
                return
            if tag in BLOCKS:
                return

    def handle_endtag(self, tag):
        if self.count[tag]:
            while self.open[-1][0] != tag:
                self.close_one()
            self.close_one()

    def handle_data(self, data):
        if self.data is not None:
            self.data.append(data)
        if not self.count["silent"]:
            self.pieces.append(data)

    def finish(self):
        self.close()
        while self.open:
            self.close_one()

    def line(self, span: Span) -> str:
        """An element's text on one line."""
        return " ".join("".join(x for x in self.pieces[span.begin : span.end] if x is not BREAK).split())

    def lines(self, span: Span) -> str:
        return "\n".join(x for x in (" ".join(p.split()) for p in "".join(self.pieces[span.begin : span.end]).split("\n")) if x)

    def last(self, span: Span) -> str:
        """The last characters of an element's text that aren't blank; only the end of it is looked at."""
        for k in range(span.end - 1, span.begin - 1, -1):
            if text := self.pieces[k].strip():
                return text
        return ""


def poem_of(page: Events) -> str | None:
    """A poem's body, whichever of the known page layouts holds it."""
    for kind in ("post_content", "pmContainer"):
        if page.found[kind]:
            return page.lines(page.found[kind][0])
    halves = [page.line(h) for h in page.found["h3"]]
    if halves:
        halves += [""] * (len(halves) % 2)
        return "\n".join(f"{a}\t{b}" for a, b in zip(halves[::2], halves[1::2], strict=True))
    return page.lines(page.found["h4"][0]) if page.found["h4"] else None


def crumbs_of(page: Events) -> list[tuple[str | None, str | None]]:
    """(name, url) of the page's breadcrumbs: of its JSON-LD lists, else of its links."""
    out = []
    for text in page.facts["json"]:
        try:
            found = json.loads(text)
        except (ValueError, RecursionError):
            continue
        for item in found.get("itemListElement", []) if isinstance(found, dict) else []:
            at = item.get("item")
            out.append((item.get("name") or (at.get("name") if isinstance(at, dict) else None), at.get("@id") if isinstance(at, dict) else at))
    return out or [(page.line(a), a.extra) for a in page.found["breadcrumb a"]]


def record_of(html: str | None) -> dict:
    """All fields of a scraped page, however its elements are closed; what a page lacks is None."""
    page = Events()
    page.feed(html or "")
    page.finish()
    first = lambda kind: page.line(page.found[kind][0]) if page.found[kind] else None
    name, crumbs = first("title"), crumbs_of(page)
    parts = [p.strip() for p in (name or "").split("-")]
    english = next((s for s in page.found["span"] if page.last(s).endswith("@")), None)
    country = first("country")
    return {
        "title": crumbs[2][0] if len(crumbs) > 2 else parts[0] or None,
        "poem_url": next(iter(page.facts["canonical"] or page.facts["og:url"]), None),
        "poet_page_url": next((u for _, u in crumbs if u and "cat-poet" in u), None),
        "poet": parts[1] if len(parts) >= 3 else None,
        "era": crumbs[0][0] if crumbs else None,
        "country": None if country is None else " ".join(country.replace("\u200f", "").split()),
        "poet_description": first("poet-description"),
        "poet_english_id": None if english is None else "".join(x for x in page.pieces[english.begin : english.end] if x is not BREAK).strip(),
        "poem": poem_of(page),
        "tags": [page.line(a) for a in page.found["tips a"]],
        "text": page.lines(Span(0)),
    }


RECORD = "title string, poem_url string, poet_page_url string, poet string, era string, country string, poet_description string, poet_english_id string, poem string, tags array<string>, text string"


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One record per page, by one parser pass in Arrow batches; poem_no_diacritics is derived from poem.

    Keep columns whose names a record has are replaced by the record's.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]
    kept = [k for k in keep if k not in names]
    schema = ", ".join([*(f"`{k}` {dict(df.dtypes)[k]}" for k in kept), RECORD])

    def run(parts):
        for part in parts:
            found = pd.DataFrame([record_of(h) for h in part["_html"]], columns=names, index=part.index)
            yield pd.concat([part[kept], found], axis=1)

    return df.select(*kept, F.col(html).alias("_html")).mapInPandas(run, schema).withColumn("poem_no_diacritics", strip_marks("poem", wide=True))


def checked(records: DataFrame, files: int | None = None) -> DataFrame:
    """records, once they are found sound: a text that holds a null byte or a tag, or a count that isn't the files', is an error."""
    names = [n for n, t in records.dtypes if t == "string" and n != "html"]
    bad = records.agg(F.count("*").alias("rows"), *(F.count(F.when(F.col(n).rlike(r"\x00|<[a-zA-Z/][^>]*>"), 1)).alias(n) for n in names if n in ("title", "poet", "era", "country"))).first().asDict()
    rows = bad.pop("rows")
    wrong = {n: k for n, k in bad.items() if k}
    if wrong:
        raise ValueError(f"records with mark-up in a field: {wrong}")
    if files is not None and rows != files:
        raise ValueError(f"{files} files but {rows} records")
    return records


def profile(c) -> Column:
    """(name, description) of a profile's text: its first non-blank line and the rest."""
    own = F.filter(F.transform(F.split(col(c), "\n"), trim_ws), lambda x: x != "")
    return F.struct(F.get(own, F.lit(0)).alias("name"), F.array_join(F.slice(own, 2, F.greatest(F.size(own), F.lit(1))), "\n").alias("description"))
