"""Listing pages and API payloads: blocks by selectors, embedded page data, posts with comments, reviews, questions and answers, search results.

All parsers give rows (or structs) of one shape: native_id, text, url, author, created, and what the source adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.scoring import content_id, short_hash
from corpusloom.functions.text import for_fingerprint, rating
from corpusloom.operators import ordered
from corpusloom.sources.tables import bounded_batches

# Elements that have no end tag, and bodies that stand for a removed post.
VOID = "area base br col embed hr img input link meta source track wbr".split()
DELETED = ["[deleted]", "[removed]"]
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[[\w-]+\])*)$")


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def text(self) -> str:
        return re.sub(r"\s+", " ", "".join(p if isinstance(p, str) else f" {p.text()} " for p in self.parts)).strip()

    def below(self) -> Iterable[_Node]:
        for p in self.parts:
            if isinstance(p, _Node):
                yield p
                yield from p.below()

    def fits(self, simple: str) -> bool:
        found = _SIMPLE.match(simple)
        if not found or (found[1] and found[1].lower() != self.tag):
            return False
        classes = self.attrs.get("class", "").split()
        for mark in re.findall(r"[.#\[][\w-]+", found[2]):
            name = mark[1:]
            if not {".": name in classes, "#": self.attrs.get("id") == name, "[": name in self.attrs}[mark[0]]:
                return False
        return True

    def select(self, selector: str) -> list[_Node]:
        """Descendants that fit a selector of tags, classes, ids and attribute names, with blanks for descent."""
        *above, last = selector.split()
        return [n for n in self.below() if n.fits(last) and n._under(above, self)]

    def _under(self, above: list[str], top: _Node) -> bool:
        node = self.parent
        for simple in reversed(above):
            while node is not None and node is not top and not node.fits(simple):
                node = node.parent
            if node is None or node is top:
                return False
            node = node.parent
        return True


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = _Node("", {}, None)
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node
        self.silent += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style") and self.silent > 0
        node = self.at
        while node is not self.top and node.tag != tag:
            node = node.parent
        if node is not self.top:  # an end tag without its start is passed over
            self.at = node.parent

    def handle_data(self, data):
        if not self.silent:
            self.at.parts.append(data)


def read_html(html: str) -> _Node:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.top


def _first(node: _Node, selectors: list[str], attr: str | None = None) -> str | None:
    for s in selectors:
        for hit in node.select(s):
            value = hit.attrs.get(attr) if attr else hit.text()
            if value:
                return value
    return None


_BLOCK = "page string, pos int, own array<string>, links array<string>, body string, title string, author string, moment string, date string, rating_text string"


def block_parts(pages: DataFrame, items: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """Raw parts of the blocks of listing pages (``url``, ``html``), a row each: the values of its id attributes, its links in order, field texts.

    The first of the ``items`` selectors with any hit gives a page's blocks. ``fields``: selectors for body, title, author, date and rating, of
    which the first with text stands; ``moment`` is the time element's machine-readable value. Null pages give no rows. A worker holds a batch of
    pages of 2 MB (or one larger page) and one page's tree.
    """
    bounded_batches(pages.sparkSession)

    def parse(frames):
        for pdf in frames:
            rows = []
            for url, html in zip(pdf["url"], pdf["html"], strict=True):
                top = read_html(html) if html else None
                blocks = next((hit for s in items if (hit := top.select(s))), []) if top else []
                for pos, block in enumerate(blocks):
                    texts = [_first(block, fields.get(name, [])) for name in ("body", "title", "author")]
                    ids = [block.attrs[a] for a in ("id", "data-id") if a in block.attrs]
                    links = [a.attrs["href"] for a in block.select("a[href]")]
                    rows.append((url, pos, ids, links, *texts, _first(block, ["time"], "datetime"), _first(block, fields.get("date", [])), _first(block, fields.get("rating", []))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCK.split(", ")])

    return pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(parse, _BLOCK)


def html_blocks(pages: DataFrame, items: list[str], fields: dict[str, list[str]], *, own_id: str = r"^c*(\d+)c*$", link_id: str = r"-(\d{6,})(?:$|[/?#])", hint_id: str = r"#\w*-?(\d{5,})") -> DataFrame:
    """(page, native_id, url, text, author, created, title, rating) of the blocks of listing pages; blocks without a body are passed over.

    A block is named by what its own id attributes hold (``own_id``), else by its permalink (``link_id``), else by a hint in a link
    (``hint_id``), else by the hash of its body's words (null where it has none). Its address is the permalink where that names it, else the page with the name as a fragment,
    else the page. A title stands before a body that does not hold it. All of it is expressions over the parts that ``block_parts`` reads.
    """
    b = block_parts(pages, items, fields).where("body is not null")
    found = lambda column, form: F.get(F.filter(F.transform(column, lambda x: F.regexp_extract(x, form, 1)), lambda x: x != ""), F.lit(0))
    page, link = F.coalesce("page", F.lit("")), F.get(F.filter("links", lambda x: x.rlike(link_id)), F.lit(0))
    named = b.select("*", found(F.col("own"), own_id).alias("by_own"), found(F.col("links"), link_id).alias("by_link"), found(F.col("links"), hint_id).alias("by_hint"), link.alias("permalink"))
    fragment = F.concat(F.substring_index(page, "#", 1), F.lit("#c"), F.coalesce("by_own", "by_hint"))
    joined = _joined(page, F.when(F.col("by_own").isNull(), F.col("permalink")))
    named = named.withColumn("words", for_fingerprint(F.when(F.coalesce("by_own", "by_link", "by_hint").isNull(), F.col("body"))))
    text = F.when(F.contains("body", "title"), F.col("body")).otherwise(F.concat("title", F.lit("\n\n"), "body"))
    return named.select(
        "page", F.coalesce("by_own", "by_link", "by_hint", F.when(F.col("words") != "", short_hash(F.col("words")))).alias("native_id"),
        F.coalesce(joined, fragment, page).alias("url"), F.coalesce(text, F.col("body")).alias("text"), "author", F.coalesce("moment", "date").alias("created"), "title", rating(F.col("rating_text")).alias("rating"),
    )


@F.pandas_udf(StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", h) if h else None for b, h in zip(base, href, strict=True)], dtype=object)


def page_data_reviews(pages: DataFrame, *, element: str = "__NEXT_DATA__", path: str = "$.props.pageProps.reviews") -> DataFrame:
    """Reviews of the JSON that a page's script element holds; pages without it and reviews without text give nothing."""
    raw = F.regexp_extract("html", rf'(?is)<script[^>]*id="{element}"[^>]*>(.*?)</script>', 1)
    kind = "array<struct<id:string,title:string,text:string,rating:string,consumer:struct<displayName:string>,dates:struct<publishedDate:string>>>"
    r = pages.select("url", F.explode(F.from_json(F.get_json_object(raw, path), kind)).alias("r")).where("coalesce(r.text, '') <> ''")
    text = F.when(F.coalesce("r.title", F.lit("")) != "", F.concat_ws("\n\n", "r.title", "r.text")).otherwise(F.col("r.text"))
    return r.select(F.when(F.col("r.id").isNotNull(), F.col("r.id")).otherwise(content_id(F.col("r.text"))).alias("native_id"), text.alias("text"), "url", F.col("r.consumer.displayName").alias("author"), F.col("r.dates.publishedDate").alias("created"), F.col("r.rating").try_cast("double").alias("rating"))


def posts_with_comments(posts: DataFrame) -> DataFrame:
    """Posts (id, title, body, author, created, comments: array of id, body, author, created, parent_id) and their comments, a row each.

    A removed body leaves the title; removed comments and empty texts go.
    """
    gone = lambda c: F.trim(c).isin(DELETED)
    body = F.when(F.coalesce(gone(F.col("body")), F.lit(False)), "").otherwise(F.coalesce("body", F.lit("")))
    own = posts.select(F.col("id").alias("native_id"), F.trim(F.when(body != "", F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), body)).otherwise(F.col("title"))).alias("text"), "author", "created", F.lit(None).cast("string").alias("parent_id"))
    c = posts.select(F.explode("comments").alias("c")).where(~F.coalesce(gone(F.col("c.body")), F.lit(True)))
    return own.unionByName(c.select(F.col("c.id").alias("native_id"), F.col("c.body").alias("text"), "c.author", "c.created", "c.parent_id")).where("coalesce(trim(text), '') <> ''")


def search_results(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(video_id, title, channel, published) of search payloads; other kinds of hits have no video id and go."""
    kind = "struct<items:array<struct<id:struct<videoId:string>,snippet:struct<title:string,channelTitle:string,publishedAt:string>>>>"
    v = payloads.select(F.explode(F.from_json(column, kind)["items"]).alias("v"))
    return v.where("v.id.videoId is not null").select(F.col("v.id.videoId").alias("video_id"), F.col("v.snippet.title").alias("title"), F.col("v.snippet.channelTitle").alias("channel"), F.col("v.snippet.publishedAt").alias("published"))


def first_term(hits: DataFrame, *, key: str = "video_id", order: str = "term_pos") -> DataFrame:
    """Each key once, from the term that comes first."""
    rest = [c for c in hits.columns if c != key]
    return hits.groupBy(key).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("m")).select(key, *[f"m.{c}" for c in rest])


def app_reviews(rows: DataFrame, *, brand: str) -> DataFrame:
    """Store rows (review_id, content, user, at, score, app_id); rows without id or text go, ``own_brand`` says whose app it is."""
    return rows.where("review_id is not null and coalesce(trim(content), '') <> ''").select(F.col("review_id").alias("native_id"), F.col("content").alias("text"), F.col("user").alias("author"), F.col("at").alias("created"), F.col("score").alias("rating"), F.contains(F.lower("app_id"), F.lit(brand.lower())).alias("own_brand"))


def api_reviews(payloads: DataFrame, column: str = "payload", *, lists: tuple[str, ...] = ("reviews", "items", "results", "data")) -> DataFrame:
    """Reviews of payloads of several shapes: the first list under one of ``lists``, and in it the first field that holds something."""
    return _entries(payloads, column, lists).select(_pick("reviewId", "id").alias("native_id"), _pick("reviewText", "text", "comment", "body").alias("text"), _pick("author", "userName", "name").alias("author"), _pick("createdAt", "date", "created").alias("created"), _pick("rating", "stars").try_cast("double").alias("rating")).where("coalesce(trim(text), '') <> ''")


def api_questions(payloads: DataFrame, column: str = "payload", *, lists: tuple[str, ...] = ("questions", "qna", "items", "data")) -> DataFrame:
    """Questions with their answers as an array; answers may be texts or objects with a text."""
    raw = F.coalesce(F.get_json_object("e", "$.answers"), F.lit("[]"))
    texts = F.transform(F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>")), lambda a: F.coalesce(F.get_json_object(a, "$.text"), F.get_json_object(a, "$.answer"), a))
    return _entries(payloads, column, lists).select(_pick("questionId", "id").alias("native_id"), _pick("question", "questionText", "text").alias("text"), F.filter(texts, lambda a: F.trim(a) != "").alias("answers")).where("coalesce(trim(text), '') <> ''")


def _entries(payloads: DataFrame, column: str, lists: tuple[str, ...]) -> DataFrame:
    found = [F.from_json(F.get_json_object(column, f"$.{above}{name}"), "array<string>") for above in ("", "data.", "result.") for name in lists]
    return payloads.select(F.explode(F.coalesce(*found)).alias("e"))


def _pick(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object("e", f"$.{n}"), F.lit("")) for n in names])


def question_block(body: Column) -> Column:
    """question and answers of a block whose lines begin with Q: and A: (or whose first line ends in a question mark); null without a question."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"(?i)^(?:q(?:uestion)?|a(?:ns(?:wer)?)?)\s*[:.)-]\s*", ""))
    asks = F.get(lines, F.lit(0)).rlike(r"(?i)^q(?:uestion)?\s*[:.)-]|\?\s*$")
    return F.when(asks, F.struct(F.get(bare, F.lit(0)).alias("question"), F.slice(bare, F.lit(2), F.greatest(F.size(bare) - 1, F.lit(0))).alias("answers")))


def absolute_url(base: str):
    """A function of a link column: links joined to ``base``; null and empty ones are null."""

    @F.pandas_udf("string")
    def joined(hrefs: pd.Series) -> pd.Series:
        return hrefs.map(lambda h: urljoin(base, h) if h else None)

    return joined


def slug(url: Column) -> Column:
    """The last part of a URL's path as a name: lower case, other characters as hyphens; the host where there is no path."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(last), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def first_text(raw: Column, keys: tuple[str, ...] = ("text", "body", "content", "review", "comment")) -> Column:
    """The first of ``keys`` in a JSON object that holds more than blanks."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(raw, f"$.{k}")), F.lit("")) for k in keys])


def read_appendix(lines: DataFrame, *, stop: str = "# Pipeline run log") -> DataFrame:
    """(pos, theme, source, doc_id, url, text) of an appendix's lines (pos, line): ``## theme`` heads, then ``- **source** [`id`](url): text``.

    Lines of another form keep their text alone; nothing is read from the line ``stop`` on. Headings are carried by scans, so a file of any length is
    shared by tasks.
    """
    line = F.trim("line")
    heading = F.when(line.startswith("## "), F.trim(F.substring(line, 4, 1 << 20)))
    rows = ordered.carried(lines.withColumn("line", line), {"theme": heading, "over": F.when(line.startswith(stop), True)}, by=[], order=["pos"])
    rows = rows.where("over is null and theme is not null and line like '- %'")
    form = r"^- \*\*([^*]+)\*\* (?:\[`([^`]+)`\]\(([^)]*)\)|`([^`]+)`): (.*)$"
    part = lambda i: F.nullif(F.regexp_extract("line", form, i), F.lit(""))
    return rows.select("pos", "theme", part(1).alias("source"), F.coalesce(part(2), part(4)).alias("doc_id"), part(3).alias("url"), F.coalesce(part(5), F.trim(F.substring("line", 3, 1 << 20))).alias("text"))
