"""Operator 4: main text of web pages by site template removal.

Workers parse each page into its elements, hash every element's subtree (tag, attributes, children, text) and give the
page's text blocks, each with the hashes of the elements around it. Spark counts on how many pages of a host each subtree
recurs; blocks inside subtrees that recur on many pages of their host are deleted. Besides, elements that are by name,
role or class no article text go: menus, headers, footers, sidebars, notices, adverts, forms, scripts, reader comments.
An element that holds ``main`` or
half of the page's remaining text doesn't go by a class word, nor a form that holds an article. Where a page has an ``article`` or ``main`` element outside of
what goes, only text inside one counts. Paragraphs, headings and the like inside
an article are its text, and never a template, however often they recur.

Cases: null and empty pages have an empty text; a page without a host belongs to the host ``""``; unclosed elements end
with their parent; pages of equal text count as one and give a result each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, saved, table

#: A subtree is a template's if it recurs on so many pages of its host, pages of equal text counting as one.
MIN_PAGES = 5
#: Up to so many templates (a host and a hash each) are broadcast; beyond, they are joined.
FEW_TEMPLATES = 50_000
WHOLE = "script style noscript template iframe svg textarea title".split()
#: An attribute's value may hold ``>`` inside quotes; quotes elsewhere mean nothing. Possessive, so no position is read twice.
QUOTED, PLAIN = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>", "[^>]*+>"


def token(attributes: str) -> re.Pattern[str]:
    ends = "|".join(rf"{n}\b{attributes}.*?(?:</{n}\s*+>|\Z)" for n in WHOLE)
    return re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(?:{ends})|</?[a-zA-Z]{attributes}", re.DOTALL | re.IGNORECASE)


TOKEN, LOOSE, OPENS = token(QUOTED), token(PLAIN), re.compile("<[/!?]?[a-zA-Z!?\\[-]")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
#: Elements that are blocks of text or hold such.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is no article text.
DROPPED = frozenset("aside button dialog footer head menu nav search select".split())
#: These go likewise, unless they hold an article or half of the page's text: some sites wrap whole pages in a form.
FORMS = frozenset(["form", "fieldset"])
OUTSIDE = frozenset(["header"])
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr tbody thead tfoot table ul ol dl figure figcaption caption".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsored|promo|promotion|banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|comments?|comment-list|replies|disqus|respond|cookies?|consent|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|footer|masthead|toolbar|widget|pagination|pager)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Class words that say what an element has, not what it is.
HAS = re.compile(r"(?:^|\s)(?:has|with|without|no|is|js)[-_]\S+", re.IGNORECASE)
#: As in browsers, elements nested deeper than this are read as if their parent ended.
DEPTH = 512
#: An open element of the key ends where one of the values begins.
ENDS = {"p": BLOCKS - {"html", "head", "body"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "tr": frozenset(["tr", "tbody", "tfoot", "thead"])} | {f"h{i}": frozenset(f"h{j}" for j in range(1, 7)) for i in range(1, 7)}
SCOPES = frozenset(["ul", "ol", "dl", "table"])
SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("blocks", "chars", "dropped", "flow", "keeps", "main", "marked", "name", "parent", "parts", "tag", "within")

    def __init__(self, name: str, tag: str, parent: Element | None):
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(tag)} if len(tag) > len(name) + 2 else {}
        article = name in ("article", "main") or found.get("role") == "main"
        self.name, self.tag, self.parts, self.blocks, self.parent, self.chars = name, tag, [], [], parent, 0
        self.within = article or (parent is not None and parent.within)
        words = HAS.sub(" ", f"{found.get('class', '')} {found.get('id', '')}")
        self.marked = name in FORMS or (name not in ("html", "body") and bool(words.strip() and DROPPED_WORDS.search(words)))
        gone = name in DROPPED or (name in OUTSIDE and not self.within) or found.get("role") in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
        self.dropped = gone or (parent is not None and parent.dropped)
        self.keeps = article and not self.dropped
        self.main = self.keeps and name != "article"
        self.flow = self.within and name in FLOW

    def goes(self, total: int) -> bool:
        """The element or one around it goes by a class word or as a form, of a page with so many characters outside of what is
        dropped."""
        e = self
        while e is not None and not (e.marked and not e.main and not (e.keeps and e.name in FORMS) and 2 * e.chars < total):
            e = e.parent
        return e is not None


def tags(page: str) -> Iterator[tuple[int, int]]:
    """Where markup begins and ends, in time linear in the page: a tag whose quotes don't end within the page ends at its
    first ``>``, as do all after it; one without any ``>`` takes the rest of the page."""
    at, pattern = 0, TOKEN
    while (at := page.find("<", at)) >= 0:
        m = pattern.match(page, at)
        if m is None and pattern is TOKEN and OPENS.match(page, at):
            pattern = LOOSE
            m = pattern.match(page, at)
        if m:
            yield m.span()
            at = m.end()
        elif OPENS.match(page, at) and page.find(">", at) < 0:
            yield at, len(page)
            return
        else:
            at += 1


def blocks_of(page: str) -> list[tuple[str, list[int]]]:
    """Text blocks of a page in order, each with the hashes of the subtrees around it that may be a template's."""
    root = Element("html", "", None)
    stack, buffer, made, articles = [root], [], [], []
    open_, deeper = Counter(), Counter()

    def flush() -> None:
        raw = "".join(buffer)
        buffer.clear()
        text = SPACE.sub(" ", unescape(raw)).strip()
        if text:
            top = stack[-1]
            top.parts.append(text)
            if not top.dropped:
                made.append((text, top, hashes := []))
                top.chars += len(text)
                for e in stack:
                    e.blocks.append(hashes)

    def close() -> None:
        e = stack.pop()
        open_[e.name] -= 1
        stack[-1].chars += e.chars
        content = "\x00".join([e.tag, *e.parts])
        digest = hashlib.blake2b(content.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        stack[-1].parts.append(digest.hex())
        stack[-1].keeps |= e.keeps
        stack[-1].main |= e.main
        if not e.keeps and not e.flow:
            value = int.from_bytes(digest, "little", signed=True)
            for hashes in e.blocks:
                hashes.append(value)

    at = 0
    for begin, end in tags(page):
        if begin > at:
            buffer.append(page[at:begin])
        at, tag = end, page[begin:end]
        if tag.startswith("<![CDATA["):
            buffer.append(tag[9:-3].replace("&", "&amp;"))
            continue
        named = NAME.match(tag)
        if not named:
            continue
        name = named[1].lower()
        if name in WHOLE:
            continue
        if name not in BLOCKS:
            if name == "br":
                buffer.append(" ")
            elif name in ("img", "input", "wbr"):
                pass
            continue
        flush()
        if tag[1] == "/":
            if deeper[name]:
                deeper[name] -= 1
            elif open_[name]:
                while stack[-1].name != name:
                    close()
                close()
            continue
        if name in ("html", "body"):
            continue
        for i in range(len(stack) - 1, 0, -1):
            if name in ENDS.get(stack[i].name, ()):
                while len(stack) > i:
                    close()
                break
            if stack[i].name in SCOPES or stack[i].name not in ENDS:
                break
        if name != "hr" and len(stack) >= DEPTH:
            deeper[name] += not tag.endswith("/>")
        elif name != "hr":
            open_[name] += 1
            stack.append(Element(name, tag, stack[-1]))
            if stack[-1].keeps:
                articles.append(stack[-1])
            if tag.endswith("/>"):
                close()
    if at < len(page):
        buffer.append(page[at:])
    flush()
    while len(stack) > 1:
        close()
    only = any(not e.goes(root.chars) for e in articles)
    return [(text, hashes) for text, e, hashes in made if (e.within or not only) and not e.goes(root.chars)]


PARSED = "key bigint, page_id bigint, url string, host string, blocks array<struct<text:string,around:array<bigint>>>"
BLOCK_TYPE = pa.list_(pa.struct([("text", pa.string()), ("around", pa.list_(pa.int64()))]))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def parse(pages: DataFrame) -> DataFrame:
    """Blocks of every page (page_id, url, html)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [[{"text": t, "around": h} for t, h in blocks_of(p or "")] for p in batch.column("html").to_pylist()]
        hosts = [host_of(u) for u in batch.column("url").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.string()), pa.array(made, BLOCK_TYPE)], ["key", "page_id", "url", "host", "blocks"])

    return map_arrow(pages.select(F.xxhash64("page_id", "url", "html").alias("key"), "page_id", "url", "html"), run, PARSED, rows=256)


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Subtrees (host, hash) that recur on many pages of their host."""
    content = F.xxhash64("blocks.text").alias("content")
    hashes = parsed.select("host", content, F.explode(F.array_distinct(F.flatten("blocks.around"))).alias("hash")).distinct()
    return hashes.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select("host", "hash")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    parsed = saved(parse(pages), "html-parsed")
    found = saved(templates(parsed, min_pages), "html-templates")
    none = F.expr("cast(array() as array<bigint>)")
    if found.limit(FEW_TEMPLATES + 1).count() <= FEW_TEMPLATES:
        by_host = F.broadcast(found.groupBy("host").agg(F.collect_set("hash").alias("all")))
        cut = parsed.join(by_host, "host", "left").withColumn("cut", F.array_intersect(F.flatten("blocks.around"), F.coalesce("all", none)))
    else:
        held = parsed.select("host", "key", F.explode(F.array_distinct(F.flatten("blocks.around"))).alias("hash")).distinct()
        cut = parsed.join(held.join(found, ["host", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("cut")), "key", "left")
    kept = F.filter("blocks", lambda b: ~F.arrays_overlap(b["around"], F.coalesce("cut", none)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return cut.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
