"""Main text of web pages: chrome by markup and by recurrence over a site's pages goes, the article stays."""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import durable, slices

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What follows a tag's name, up to its end: a quote counts after "=" only.  Possessive, so it never goes back.
REST = re.compile(r"""((?:[^"'<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(>)?""")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.IGNORECASE)
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|_")

# What elements are, by the HTML standard: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of the value, up to the nearest of the scope's elements.
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
SCOPE = frozenset("html body article aside main section div ul ol dl table tbody thead tfoot select nav header footer form blockquote figure".split())
CLOSES_P = BLOCKS - {"option", "optgroup", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}

RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.IGNORECASE) for t in RAW}
CHROME_TAGS = frozenset("head nav footer aside form button select input menu dialog svg canvas object embed audio video map datalist label".split()) | RAW
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Whole class names and ids, in lower case with hyphens, that mean something around an article wherever they are.
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising ad-banner ad-slot sponsored sponsored-content promo sidebar site-sidebar widget widget-area "
    "cookie-banner cookie-bar cookie-consent cookie-notice gdpr consent-banner popup modal overlay newsletter newsletter-signup subscribe-box "
    "nav navbar navigation site-nav main-nav menu main-menu breadcrumb breadcrumbs footer site-footer page-footer masthead site-header "
    "comments comment-list comment-section comments-area respond disqus-thread share share-bar share-buttons sharing social social-links social-share "
    "related-posts related-articles related-links recommended-posts recommendations pagination pager toolbar skip-link".split()
)
#: More of them, where no article or main element says what the text is.
OUTER_NAMES = CHROME_NAMES | frozenset(
    "banner comment consent cookie cookies legal login notice notices notification promotion recommended related replies reply search signup sponsor subscribe subscription header".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside an article element these hold its prose and are never taken for a template: what many articles quote
#: is theirs.
PROSE = HEADINGS | frozenset("p blockquote pre figcaption caption td th li dt dd".split())
KEEP_WHOLE = frozenset("html body main article".split())

#: "Many pages" of a host: this share of its different pages, but at least and at most so many.
MIN_PAGES, MIN_SHARE, ENOUGH_PAGES = 5, 0.05, 50
#: Templates up to this number go to every worker as 8 bytes each; more are joined by a shuffle.
BROADCAST_TEMPLATES = 500_000


class Node(NamedTuple):
    """An element: its children are nodes and text pieces in page order."""

    tag: str
    names: frozenset[str]
    role: str
    hidden: bool
    children: list


def parse(page: str) -> Node:
    """A forgiving element tree: unknown end tags are ignored, open elements end with their parents.

    One pass: the open elements of each name are known by their depths, so nothing is searched in the stack.
    A tag whose quotes don't close ends at the next ">"; one that the page's end cuts off is dropped with what
    follows, as is an unclosed comment."""
    root = Node("#root", frozenset(), "", False, [])
    stack, at, n = [root], 0, len(page)
    depths: dict[str, list[int]] = {}  # of the open elements of each name
    scopes: list[int] = [0]

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            depths[tag].pop()
            if tag in SCOPE:
                scopes.pop()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].children.append(page[at:])
            break
        after = page[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            opening, closing = ("<!--", "-->") if page.startswith("<!--", lt) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", lt) else ("<!", ">")
            if lt > at:
                stack[-1].children.append(page[at:lt])
            end = page.find(closing, lt + len(opening))
            at = n if end < 0 else end + len(closing)
            continue
        ending = after == "/"
        m = NAME.match(page, lt + 1 + ending)
        if m is None:  # no tag: the sign is text
            stack[-1].children.append(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            stack[-1].children.append(page[at:lt])
        rest = REST.match(page, m.end())
        if rest[2]:
            attributes, at = rest[1], rest.end()
        else:
            gt = page.find(">", m.end())
            if gt < 0:
                break
            attributes, at = page[m.end() : gt], gt + 1
        name = m[0].lower()
        if ending:
            if depths.get(name):
                close_to(depths[name][-1])
            continue
        if name in CLOSES_P and (d := depths.get("p")) and d[-1] > scopes[-1]:
            close_to(d[-1])
        if name in IMPLIED_END:
            bottom = scopes[-1]
            above = [d[k] for t in IMPLIED_END[name] if (d := depths.get(t)) and (k := bisect_right(d, bottom)) < len(d)]
            if above:
                close_to(min(above))
        names, role, hidden = (), "", False
        if attributes:
            found = set()
            for key, value in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id"):
                    found.update(HUMP.sub("-", w).lower() for w in value.split())
                elif key == "role":
                    role = value.lower()
                elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                    hidden = True
                elif key == "itemprop" and value == "articleBody":
                    found.add("article-body")
            names = found
        node = Node(name, frozenset(names), role, hidden, [])
        stack[-1].children.append(node)
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not attributes.endswith("/"):
            depths.setdefault(name, []).append(len(stack))
            if name in SCOPE:
                scopes.append(len(stack))
            stack.append(node)
    return root


def is_chrome(node: Node, in_main: bool) -> bool:
    """Whether markup alone says that the element isn't main text.  Inside an article only tags, roles and
    names that can mean nothing else count."""
    if node.tag in CHROME_TAGS or node.hidden or node.role in CHROME_ROLES:
        return True
    if node.tag in KEEP_WHOLE:
        return node.tag == "article" and not node.names.isdisjoint({"comment", "comments", "reply"})
    if in_main:
        return not node.names.isdisjoint(CHROME_NAMES)
    return node.tag == "header" or not node.names.isdisjoint(OUTER_NAMES)


def is_main(node: Node) -> bool:
    return node.tag == "main" or node.role == "main"


def is_article(node: Node) -> bool:
    return node.tag == "article" or node.role == "article" or "article-body" in node.names


def squeeze(text: str) -> str:
    """Character references decoded, white space as one space, trimmed."""
    return " ".join(entities.unescape(text).split())


def subtree_keys(root: Node, host: str) -> tuple[np.ndarray, dict[int, int]]:
    """(keys, by node id): a 64-bit key of host and subtree for every element that could be a template:
    blocks with text, but not the page's frame and not prose inside an article element."""
    by: dict[int, int] = {}

    def walk(root: Node) -> None:
        # Digests come bottom-up without recursion, for trees of any depth.
        order, todo = [], [(root, False)]
        while todo:
            node, in_article = todo.pop()
            order.append((node, in_article))
            inside = in_article or is_article(node)
            todo.extend((c, inside) for c in node.children if not isinstance(c, str))
        digest: dict[int, bytes] = {}
        texts: dict[int, bool] = {}
        for node, in_article in reversed(order):
            h = hashlib.blake2b(f"{node.tag} {' '.join(sorted(node.names))}".encode(), digest_size=16)
            some = False
            for c in node.children:
                if isinstance(c, str):
                    t = squeeze(c)
                    some |= bool(t)
                    h.update(b"\0t" + t.encode("utf-8", "replace"))
                else:
                    some |= texts[id(c)]
                    h.update(b"\0n" + digest[id(c)])
            digest[id(node)], texts[id(node)] = h.digest(), some
            if some and node.tag in BLOCKS and node.tag not in KEEP_WHOLE and not (in_article and node.tag in PROSE):
                by[id(node)] = int.from_bytes(hashlib.blake2b(host.encode("utf-8", "replace") + b"\0" + digest[id(node)], digest_size=8).digest(), "little")

    walk(root)
    return np.unique(np.fromiter(by.values(), np.uint64, len(by))), by


def extract(page: str | None, host: str = "", templates=frozenset(), tally: dict | None = None) -> str:
    """The main text of a page: blocks joined by two line ends.

    Subtrees whose key is in ``templates`` go first, with all below them, then elements that are chrome by tag,
    role, class or id.  Text counts inside main elements; where these have none, inside articles; where these
    have none either, in the whole body.  In an article's own header only headings count.  A null or empty page
    has an empty text.  ``tally`` counts subtrees removed as templates.
    """
    if not page:
        return ""
    root = parse(page)
    by = subtree_keys(root, host)[1] if templates else {}
    if tally is not None:
        tally["templates"] = sum(k in templates for k in by.values())

    def blocks(region) -> list[str]:
        out: list[str] = []
        line: list[str] = []

        def end() -> None:
            if line and (text := squeeze("".join(line))):
                out.append(text)
            line.clear()

        todo: list = [(root, region is None, False, False)]
        while todo:
            item = todo.pop()
            if item is None:
                end()
                continue
            node, counts, in_main, heading_only = item
            if isinstance(node, str):
                if counts and not heading_only:
                    line.append(node)
                continue
            if by.get(id(node)) in templates or is_chrome(node, in_main):
                if node.tag in BLOCKS:
                    end()
                continue
            if region is not None and region(node):
                counts = True
            in_main = in_main or is_main(node) or is_article(node)
            if in_main and (node.tag == "header" or "header" in node.names):
                heading_only = True
            elif node.tag in HEADINGS:
                heading_only = False
            if node.tag == "br":
                line.append(" ")
            if node.tag in BLOCKS:
                end()
                todo.append(None)
            todo.extend((c, counts, in_main, heading_only) for c in reversed(node.children))
        end()
        return out

    return "\n\n".join(blocks(is_main) or blocks(is_article) or blocks(None))


def host_of(url: str | None) -> str:
    """What stands between "://" and the next "/", "?" or "#", lower-cased; empty without."""
    _, sep, rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower() if sep else ""


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        hosts, pages, keys = [], [], []
        for url, page in zip(b.column("url"), b.column("html"), strict=True):
            host, text = host_of(url.as_py()), page.as_py() or ""
            hosts.append(host)
            pages.append(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest())
            keys.append(subtree_keys(parse(text), host)[0].view(np.int64) if host else np.zeros(0, np.int64))
        yield pa.record_batch([pa.array(hosts), pa.array(pages, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["host", "page", "keys"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough: int = ENOUGH_PAGES) -> DataFrame:
    """(host, key): subtrees standing in at least ``min_share`` of a host's different pages, where fewer than
    ``min_pages`` are never enough and ``enough`` always are, however large the host.  Pages of equal html count
    once, so copies of one page make no template of it."""
    rows = pages.select("url", "html").mapInArrow(_key_rows, "host string, page binary, keys array<bigint>")
    rows = durable(rows.where("host <> ''").groupBy("host", "page").agg(F.first("keys").alias("keys")))
    per_host = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = rows.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return counted.join(per_host, "host").where(F.col("n") >= F.least(F.col("pages") * min_share, F.lit(float(enough)))).select("host", "key").distinct()


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_templates: int = BROADCAST_TEMPLATES) -> DataFrame:
    """(page_id, url, text) of every page (page_id, url, html); the text is empty where there is none.

    A first pass over the pages hashes their subtrees, Spark counts them per host, a second pass extracts.
    Templates reach the second pass as a broadcast array of 8 bytes each while there are at most
    ``broadcast_templates``, and beyond by a join of each page's own keys.  Null html or url counts as empty;
    pages without a host have no templates.  Rows keep their number, repeated ones too; other columns are
    ignored.
    """
    spark = pages.sparkSession
    templates = durable(site_templates(pages, min_pages, min_share))
    few = templates.count() <= broadcast_templates
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"

    def rows(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = []
            for i in range(b.num_rows):
                url = b.column("url")[i].as_py()
                texts.append(extract(b.column("html")[i].as_py(), host_of(url), of(b, i)))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    if few:
        shared = spark.sparkContext.broadcast(np.array([r["key"] for r in templates.select("key").toLocalIterator()], np.int64).view(np.uint64))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = frozenset(shared.value.tolist())
            return rows(batches, lambda b, i: known)

        return pages.select("page_id", "url", "html").mapInArrow(local, schema)
    return _by_join(pages, templates.select("key"), rows, schema)


def _by_join(pages: DataFrame, known: DataFrame, rows, schema: str) -> DataFrame:
    """Extraction where the templates are too many to broadcast: each page's own keys meet the templates
    and come back to the page under its digest."""
    found = pages.select("url", "html").mapInArrow(_key_rows, "host string, page binary, keys array<bigint>")
    own = found.groupBy("host", "page").agg(F.first("keys").alias("keys")).select("host", "page", F.explode("keys").alias("key"))
    hit = own.join(known, "key").groupBy("host", "page").agg(F.collect_set("key").alias("hit"))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            digests = [hashlib.blake2b((t.as_py() or "").encode("utf-8", "replace"), digest_size=16).digest() for t in b.column("html")]
            hosts = [host_of(u.as_py()) for u in b.column("url")]
            yield pa.record_batch([*b.columns, pa.array(hosts), pa.array(digests, pa.binary())], names=["page_id", "url", "html", "host", "page"])

    kind = schema.split(",")[0]
    marked = pages.select("page_id", "url", "html").mapInArrow(identify, f"{kind}, url string, html string, host string, page binary")
    marked = marked.join(hit, ["host", "page"], "left").select("page_id", "url", "html", "hit")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(b, i):
            return frozenset(k & 0xFFFFFFFFFFFFFFFF for k in b.column("hit")[i].as_py() or ())

        return rows(batches, of)

    return marked.mapInArrow(local, schema)
