"""Main text of web pages by template deduction with equivalence classes of tokens.

A token is a tag at its path of open elements, or a whole text at such a path. Over all pages of a host, each token has
an occurrence vector (how often it occurs on each page), kept as a sum of hashes of (page, count), so any host, however
large, is reduced in Spark before it is shuffled. Tokens with equal vectors form an equivalence class; a class is valid
when it occurs on enough pages and has two tokens or more. Valid classes nest along the paths; together they are the
host's template. What lies between template tokens are slots.

Pages count once by their text: copies of a page do not make their own text a template. The article is the deepest template
element that holds most of the host's slot text once a page. An article mark (<article>, articleBody) only supports or checks
it: the article is widened to the mark around it, and narrowed to marks below it that hold most of its slot text; template
texts (the same on most pages) are left out but inside such a mark. Where a page has no template article (few pages, another
layout), the marks are read, else the main element, else the body.

Left out as no article text are elements by their tag (``ASIDE_TAGS``), and those that have a word of ``ASIDE_WORDS`` as a
whole token of class, id or role, if blocks of that tag and words recur on the host; a host with too few pages to tell goes
by the words. Never left out by words are html, body, main, an article and what holds the article.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space. Null and
empty html has an empty text. Pages without a host form a group of their own. Repeated rows are each answered; empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import map_rows, table

SUPPORT = 0.5          # share of a host's pages on which a template token occurs
LEAST_PAGES = 3        # and at least so many pages
SLOT_SHARE = 0.6       # share of the host's slot text below the deduced article element
BROADCAST_HOSTS = 5_000

# Names of HTML.
RAW = ("script", "style", "noscript", "template", "iframe", "title", "textarea", "svg")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s",
          "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "mi", "mn", "mo", "mrow", "msub",
          "msup", "mtext"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1",
            "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_OWN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"},
              "option": {"select"}}
ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "label", "object",
              "input", *RAW}
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
               "banner", "cookie", "cookies", "consent", "notice", "notices", "alert", "sidebar", "widget", "menu", "nav", "navbar",
               "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "comment", "comments", "reply",
               "replies", "disqus", "respond", "related", "share", "sharing", "social", "newsletter", "subscribe", "popup", "modal",
               "login", "search", "complementary", "contentinfo", "form", "user-comments", "comment-list", "comments-area", "comments-section",
               "comment-form", "related-posts", "related-articles", "site-header", "site-footer", "site-nav", "social-share",
               "share-buttons", "cookie-banner", "cookie-notice", "cookie-consent", "search-form", "login-form", "newsletter-signup",
               "ad-banner", "ad-container", "ad-slot", "adsbygoogle"}
NEVER_ASIDE = {"html", "body", "main", "article"}

# A name ends at white space, a slash or the end of its tag; only after an equals sign does a quote open a value.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(" + "|".join([*RAW, "xmp"]) + r")(?=[\s/>])[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))"
                   r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Element:
    __slots__ = ("tag", "path", "above", "depth", "named", "mark", "never", "aside", "marked", "chars")

    def __init__(self, tag: str, names: str, above: "Element | None"):
        words = set(names.split())
        self.tag, self.above = tag, above
        self.depth = above.depth + 1 if above else 1
        self.path = xxhash.xxh3_64_intdigest(f"{above.path if above else 0}/{tag}.{names}") >> 1
        self.mark = tag == "article" or "articlebody" in words
        words &= ASIDE_WORDS
        # The same for all blocks of that tag and words, wherever they stand.
        self.named = (xxhash.xxh3_64_intdigest(f"{tag} {' '.join(sorted(words))}", 5) >> 1
                      if words and not self.mark and tag not in NEVER_ASIDE else 0)
        self.never = bool(above and above.never) or tag in ASIDE_TAGS   # by tag
        self.aside, self.chars = self.never, 0
        self.marked = above.marked if above and above.marked else self if self.mark and not self.never else None

    def up(self) -> "Iterator[Element]":
        at = self
        while at is not None:
            yield at
            at = at.above


ROOT = Element("", "", None)


def walk(page: str) -> Iterator[tuple[str, Element, str]]:
    """("open", element, tag), ("close", innermost open element, tag) and ("text", …, raw text) in page order."""
    stack = [ROOT]

    def close(tag: str, within: set[str] | None = None) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return
            if within and stack[i].tag in within:
                return

    for m in TOKEN.finditer(page):
        raw, end, tag = m.group(1), m.group(2), m.group(3)
        if raw is not None:
            if raw.lower() == "xmp":  # shown as it is written
                inner = re.sub(r"</xmp\s*>\Z", "", m.group(0).partition(">")[2], flags=re.I)
                yield "open", stack[-1], "xmp"
                yield "text", stack[-1], html.escape(inner, quote=False)
                yield "close", stack[-1], "xmp"
            continue
        if tag is None:
            if not m.group(0).startswith("<") or m.group(0) == "<":
                yield "text", stack[-1], m.group(0)
            continue
        tag = tag.lower()
        if end:
            close(tag)
            yield "close", stack[-1], tag
            continue
        if tag in CLOSES_P:
            close("p", {"table", "td", "button", "article", "div", "section", "body"})
        if tag in CLOSES_OWN:
            close(tag, CLOSES_OWN[tag])
        names = " ".join(sorted({(a or b or c).lower() for _, a, b, c in ATTRIBUTE.findall(m.group(4))})) if m.group(4) else ""
        element = Element(tag, names, stack[-1])
        stack.append(element)
        yield "open", element, tag
        if tag in VOID or m.group(4).endswith("/"):
            stack.pop()


def text_token(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text, path & 0xFFFFFFFF) >> 1


def events_of(page: str | None, recurring: set[int] | None = None) -> list[tuple[str, Element, str]]:
    """The page in order, its elements judged: named blocks are asides if they are ``recurring`` or nothing is known of that."""
    events = list(walk(page or ""))
    elements = list({id(e): e for kind, e, tag in events if kind == "open" and tag != "xmp"}.values())
    named = [e for e in elements if e.named and not e.never and (recurring is None or e.named in recurring)]
    if not named:
        return events
    judge(elements, named)
    marks = [e for e in elements if e.marked is e]
    texts = [(e, len(" ".join(value.split()))) for kind, e, value in events if kind == "text" and not e.never]
    if any(not e.aside for e in marks) or not marks and any(n and not e.aside for e, n in texts):
        return events
    # The article would go with a block around it.
    for e, n in texts:
        for at in e.up():
            if at is not ROOT:
                at.chars += n
    if marks:
        holders = set(max(marks, key=lambda e: e.chars).up())
    else:
        holders = {e for e in elements if e.chars >= SLOT_SHARE * sum(n for _, n in texts)}
    judge(elements, [e for e in named if e not in holders])
    return events


def judge(elements: list[Element], named: list[Element]) -> None:
    named = set(named)
    for e in elements:  # in page order, so those above come first
        e.aside = e.never or e.above.aside or e in named


def page_tokens(page: str | None) -> tuple[int, list[tuple[int, int, int, int]]]:
    """A hash of the page's text and (token, occurrences, slot text below in characters, depth) of its tokens.

    The depth is 0 for a text and -1 for a kind of named block.
    """
    seen, below, depth, content = Counter(), Counter(), {}, xxhash.xxh3_64()
    for kind, top, value in events_of(page):
        if kind == "open" and value != "xmp":
            seen[top.path] += 1
            depth[top.path] = top.depth
            if top.named:
                seen[top.named] += 1
                depth[top.named] = -1
        elif kind == "text":
            text = " ".join(value.split())
            if text:
                seen[text_token(top.path, text)] += 1
                if not top.aside:
                    content.update(f"{text}\n".encode("utf-8", "surrogatepass"))
                    for path in {e.path for e in top.up()}:
                        below[path] += len(text)
    seen[0] = 1  # counts the host's pages
    return content.intdigest() >> 1, [(t, n, below.get(t, 0), depth.get(t, 0)) for t, n in sorted(seen.items())]


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, n_pages, v1 and v2 (the occurrence vector), n_times, n_chars (slot text below), depth.

    Pages of one text count as one page.
    """

    def run(batch: dict) -> dict:
        found = [page_tokens(page) for page in batch["html"]]
        return {"host": batch["host"], "content": [c for c, _ in found], "tokens": [t for _, t in found]}

    rows = map_rows(pages.select("host", "html"), run,
                    "host string, content long, tokens array<struct<token:long,times:int,chars:long,depth:int>>")
    once = rows.groupBy("host", "content").agg(F.min("tokens").alias("tokens"))
    each = once.select("host", "content", F.explode("tokens").alias("t")).select("host", "content", "t.*").withColumn(
        "h", F.shiftrightunsigned(F.xxhash64("content", "times"), 1))
    low = F.lit((1 << 31) - 1).cast("long")
    return each.groupBy("host", "token").agg(
        F.count("*").alias("n_pages"), F.sum(F.col("h").bitwiseAND(low)).alias("v1"),
        F.sum(F.shiftright("h", 31)).alias("v2"), F.sum("times").alias("n_times"), F.sum("chars").alias("n_chars"),
        F.max("depth").alias("depth"))


def templates(pages: DataFrame) -> DataFrame:
    """host, texts (template text tokens), root (path of the deduced article element, or null) and recurring (kinds of named
    blocks that recur on the host; null if the host has too few pages to tell).

    Each row holds template tokens only, which are those of one page at most; it does not grow with the host.
    """
    counts = occurrences(pages)
    hosts = counts.where("token = 0").select("host", F.col("n_pages").alias("all_pages"))
    known = counts.where("token <> 0").join(hosts.where(F.col("all_pages") >= LEAST_PAGES), "host").where(
        F.col("n_pages") >= LEAST_PAGES)
    frequent = known.where((F.col("depth") >= 0) & (F.col("n_pages") >= SUPPORT * F.col("all_pages")))
    classes = frequent.groupBy("host", "n_pages", "v1", "v2").agg(
        F.count("*").alias("size"),
        F.collect_list(F.when(F.col("depth") == 0, F.col("token"))).alias("texts"),
        F.collect_list(F.when((F.col("depth") > 0) & (F.col("n_times") == F.col("n_pages")),
                              F.struct("depth", "n_chars", "token"))).alias("elements")).where("size > 1")
    host = classes.groupBy("host").agg(F.flatten(F.collect_list("texts")).alias("texts"),
                                       F.flatten(F.collect_list("elements")).alias("elements"))
    most = F.array_max(F.transform("elements", lambda e: e["n_chars"]))
    fit = F.filter("elements", lambda e: (e["n_chars"] > 0) & (e["n_chars"] >= SLOT_SHARE * F.col("most")))
    blocks = known.where("depth = -1").groupBy("host").agg(F.collect_list("token").alias("blocks"))
    deduced = host.withColumn("most", most).withColumn("root", F.array_max(fit)["token"]).select("host", "texts", "root")
    return (hosts.where(F.col("all_pages") >= LEAST_PAGES).join(blocks, "host", "left").join(deduced, "host", "left")
            .select("host", "texts", "root", F.coalesce("blocks", F.array().cast("array<bigint>")).alias("recurring")))


def main_text(page: str | None, texts: list[int] | None = None, root: int | None = None,
              recurring: list[int] | None = None) -> str:
    """The text of the slots of the article of one page."""
    if not page:
        return ""
    events = events_of(page, None if recurring is None else set(recurring))
    known = set(texts or ())
    slots, sizes = set(), []  # places of the slots' texts; (element, characters)
    for i, (kind, top, value) in enumerate(events):
        if kind == "text" and not top.aside:
            text = " ".join(value.split())
            if top.marked or text_token(top.path, text) not in known:
                slots.add(i)
                sizes.append((top, len(text)))
    for article in articles(sizes, root):
        out = []
        for i, (kind, top, value) in enumerate(events):
            if kind != "text":
                out.append("" if value in INLINE else " ")
            elif i in slots and any(e in article for e in top.up()):
                out.append(value)
        text = " ".join(html.unescape("".join(out)).split())
        if text:
            return text
    return ""


def articles(slots: list[tuple[Element, int]], root: int | None) -> Iterator[set[Element]]:
    """What may be the article, best first: the elements below which slots are read."""
    roots = {e for top, _ in slots for e in top.up() if root and e.path == root}
    if roots:
        inside = [(top, n) for top, n in slots if any(e in roots for e in top.up())]
        marks = {top.marked for top, _ in inside if top.marked}
        below = {m for m in marks if any(e in roots for e in m.up())}
        if below and sum(n for top, n in inside if top.marked in below) >= SLOT_SHARE * sum(n for _, n in inside):
            yield below
        yield roots | marks
    yield {top.marked for top, _ in slots if top.marked}
    yield {e for top, _ in slots for e in top.up() if e.tag == "main"}
    yield {ROOT}


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    deduced = templates(rows)
    few = rows.select("host").distinct().limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(deduced) if few else deduced, "host", "left")
    return map_rows(joined.select("page_id", "url", "html", "texts", "root", "recurring"), lambda b: {
        "page_id": b["page_id"], "url": b["url"],
        "text": [main_text(*x) for x in zip(b["html"], b["texts"], b["root"], b["recurring"])]}, "page_id long, url string, text string")


def op5_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extracted(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))
