"""Main text of HTML pages, with removal of site templates.

Pages are read into elements. Elements that are never main text go by their tag, role, class or id. What a site repeats goes by counting:
the subtree of every block element is hashed, Spark counts the different pages of each host that hold the hash, and subtrees that recur
on many pages of their host are deleted. If a page marks articles (or else a main part, by tag or role), only these are read.

Names: a class or id token drops its element if one of its words is in PAGE_PARTS or EXTRAS (`comment-list`, `site-footer`). It does not
if a word says that it tells a state of a wrapper (`no-sidebar`, `has-social`), or if it names the head of a text
(`entry-header`). An element that such a name drops is spared after all if it holds the main part, or a headline (`header` alone), or, where only words
of PAGE_PARTS drop it, an article or more than half of the page's text; what EXTRAS name is not spared for its size or for articles (cards of related
texts) in it.

Counting: pages of a host with equal html count once, so copies of a page make no template. A subtree is a template if it
is on LEAST_PAGES different pages of its host and on a share of them: SHARE outside of articles, ARTICLE_SHARE inside, where a site
repeats little. Outside of articles a subtree of which at least half is in links (a menu) needs no share.

Nulls: a null html is an empty page without text, a null url has an empty host. Repeated rows are read each. Broken markup is
read as browsers do in outline: unclosed elements end with their parent, stray end tags are skipped. The time of a page grows with its
length, however deep its elements are nested. An empty table gives an empty table. Extra columns pass
through; input columns named like the results are replaced, any other name is free.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.llm.shared import bounded_batches, hash64, stash
from kpiscope.llm.urls import parts

LEAST_PAGES, SHARE, ARTICLE_SHARE = 10, 0.2, 0.5
WORD, HIDDEN = re.compile("[a-z]+"), re.compile(r"display\s*:\s*none")

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture"}
#: Never main text.
DROPPED_TAGS = {"head", "title", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "iframe", "svg", "canvas", "button", "select", "option", "input", "textarea", "dialog", "menu", "object", "embed", "applet", "audio", "video", "map", "noembed", "noframes", "xmp", "math"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
#: Words of class and id names: parts of a page's frame, and what is put beside or into a text.
PAGE_PARTS = {
    "sidebar", "sidenav", "nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "header", "footer", "masthead", "topbar", "toolbar", "copyright",
    "widget", "widgets", "pagination", "pager", "search", "searchform", "skip", "banner", "social", "modal", "overlay", "promo", "notice", "notices", "login", "signup",
}
EXTRAS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbox", "sponsor", "sponsored", "promotion", "cookie", "cookies", "consent", "gdpr", "popup", "newsletter", "subscribe", "subscription", "paywall",
    "comment", "comments", "commentlist", "disqus", "respond", "replies", "share", "sharing", "sharebar", "related", "recommended", "recommendations",
}
#: Words before or beside them that tell a wrapper's state, and those of a text whose head is meant.
STATES = {"no", "not", "with", "without", "has", "have", "hide", "show", "enable", "enabled", "disable", "disabled", "open", "closed", "supports", "result", "results", "layout"}
TEXT_HEADS = {"entry", "post", "article", "content", "story", "news", "title", "section", "chapter", "page"}
#: What ends an open paragraph, and siblings that end each other.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dt", "dd"}
#: Kinds of open elements, each with the tags of which one opens it and the tags that shut it off; and the kinds that a tag ends.
OPENS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "body": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
SHUTS = {"p": {"table", "td", "th", "button", "object"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "body": {"table"}, "option": {"select"}}
ENDS = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "tbody": "body", "option": "option"}
NESTING = {t for tags in (*OPENS.values(), *SHUTS.values()) for t in tags}
WHOLE = {"html", "body", "article", "main"}


class Element:
    """An element with what its place says: whether it is dropped, the region it is in, the block around it, and the open elements above it by kind."""

    __slots__ = ("tag", "parent", "drop", "inside", "digest", "hash", "at", "hard", "soft", "block", "open", "dropper", "extra", "held", "dead", "link", "chars", "linked")

    def __init__(self, tag: str, parent: Element | None, attributes: str, at: int = -1, spared: frozenset[int] = frozenset()):
        self.tag, self.parent, self.at = tag, parent, at
        named = [(n.lower(), v.strip("\"'").lower()) for n, v in ATTRIBUTE.findall(attributes)] if attributes and not attributes.isspace() else []
        around = parent.inside if parent else ""
        self.inside = "article" if tag == "article" or around == "article" else "main" if tag == "main" or around == "main" or ("role", "main") in named else ""
        self.hard = bool(parent and parent.hard) or unwanted(tag, named, self.inside)
        self.soft = "" if self.hard or at in spared else named_part(tag, named, self.inside)
        self.drop = bool(parent and parent.drop) or self.hard or bool(self.soft)
        self.extra = self.soft == "extra" or bool(parent and parent.extra)
        self.dropper = self if self.soft else parent.dropper if parent else None
        self.digest = None if tag in INLINE or self.drop else xxhash.xxh64(tag)
        self.block = self if self.digest is not None else None if self.drop or parent is None else parent.block
        self.link = tag == "a" or bool(parent and parent.link)
        self.hash = self.held = self.chars = self.linked = 0
        self.dead = None
        self.open = parent.open if parent else {}
        if tag in NESTING:
            self.open = dict(self.open)
            for kind, tags in OPENS.items():
                if tag in SHUTS[kind]:
                    self.open.pop(kind, None)
                if tag in tags:
                    self.open[kind] = self


def unwanted(tag: str, named: list[tuple[str, str]], inside: str) -> bool:
    if tag in DROPPED_TAGS or tag == "header" and not inside:
        return True
    for name, value in named:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True
        if name == "role" and value in DROPPED_ROLES:
            return True
    return False


def named_part(tag: str, named: list[tuple[str, str]], inside: str) -> str:
    """`extra` or `part` if a class or id says that the element is never main text, `head` if it is just called header; else nothing."""
    found = ""
    for name, value in named:
        if name not in ("class", "id") or tag in WHOLE and not (name == "class" and "comment" in value):
            continue
        for token in value.split():
            words = set(WORD.findall(token))
            if not (words & PAGE_PARTS or words & EXTRAS) or words & STATES:
                continue
            if words & EXTRAS:
                return "extra"
            if words & PAGE_PARTS == {"header"} and (inside or words & TEXT_HEADS):
                continue
            found = "head" if words == {"header"} and found != "part" else "part"
    return found


def read(page: str, spared: frozenset[int] = frozenset()) -> tuple[list[tuple[Element, str]], list[Element]]:
    """Texts with the element they stand in, in page order, and all block elements; dropped parts are left out.

    A text of "" with a block element marks where a block starts or ends.
    """
    root = Element("", None, "")
    here, texts, blocks, at = root, [], [], 0
    n_open: dict[str, int] = {}
    soft: list[Element] = []
    found: set[int] = set()
    chars = 0

    def close(upto: Element) -> None:
        nonlocal here
        while True:
            done, here = here, here.parent
            n_open[done.tag] -= 1
            if done.digest is not None:
                texts.append((done, ""))
                done.hash = done.digest.intdigest()
                blocks.append(done)
                up = here.block
                if up is not None:
                    up.digest.update(done.hash.to_bytes(8, "little"))
                    up.chars += done.chars
                    up.linked += done.linked
            if done is upto:
                return

    def spare(node: Element | None) -> None:
        while node is not None and node.at not in found:
            found.add(node.at)
            node = node.parent.dropper

    for m in iter(lambda: TOKEN.match(page, at), None):
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                if here.hard:
                    continue
                text = entities.unescape(m[0])
                plain = " ".join(text.split())
                chars += len(plain)
                if here.drop:
                    here.dropper.held += len(plain)
                    continue
                texts.append((here, text))
                up = here.block
                if up is not None and plain:
                    up.digest.update(plain.encode("utf-8", "surrogatepass"))
                    up.chars += len(plain)
                    up.linked += len(plain) if here.link else 0
            continue
        tag = tag.lower()
        if m[1]:
            if n_open.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                close(node)
            continue
        for kind in (ENDS.get(tag), "p" if tag in ENDS_P else None):
            while kind and (node := here.open.get(kind)) is not None:
                close(node)
        if tag in VOID:
            if tag in ("br", "hr") and not here.drop:
                texts.append((here, " "))
            continue
        node = Element(tag, here, m[3], m.start(), spared)
        if node.drop and not node.hard:
            if node.soft:
                soft.append(node)
            if not node.soft and (tag == "main" or tag == "article" and not node.extra):
                spare(here.dropper)
            elif tag == "h1" and here.dropper is not None and here.dropper.soft == "head":
                spare(here.dropper)
        if node.digest is not None:
            texts.append((node, ""))
        if m[3].endswith("/") and tag not in INLINE and tag in ("svg", "math", "path"):
            continue
        n_open[tag] = n_open.get(tag, 0) + 1
        here = node
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    if here is not root:
        top = here
        while top.parent is not root:
            top = top.parent
        close(top)
    for node in reversed(soft):  # inner ones first
        outer = node.parent.dropper
        if outer is not None:
            outer.held += node.held
        if node.soft != "extra" and 2 * node.held > chars and node.at not in found:
            found.add(node.at)
    return read(page, spared | found) if found - spared else (texts, blocks)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def hashes(page: str) -> dict[int, bool]:
    """Hashes of the block subtrees of a page, those of whole pages and articles excepted; whether half of the text is in links."""
    return {signed(b.hash): 2 * b.linked >= b.chars > 0 for b in read(page)[1] if b.tag and b.tag not in WHOLE}


def alive(node: Element, gone: set[Element]) -> bool:
    """Whether neither the element nor one around it is gone; the answer is kept on all elements that were passed."""
    passed, up = [], node
    while up is not None and up.dead is None and up not in gone:
        passed.append(up)
        up = up.parent
    dead = up is not None and (up.dead or up in gone)
    for one in passed:
        one.dead = dead
    return not dead


def main_text(page: str, often: set[int], some: set[int]) -> str:
    """The page's text without subtrees in `some`, in articles without those in `often`."""
    texts, blocks = read(page)
    gone = {b for b in blocks if b.tag and b.tag not in WHOLE and signed(b.hash) in (often if b.inside == "article" else some)}
    for region in ("article", "main", ""):
        if region == "" or any(t and not t.isspace() and node.inside == region for node, t in texts):
            break
    out = []
    for node, t in texts:
        if node.inside != region and region:
            continue
        if not t:
            out.append(" ")
        elif not gone or alive(node, gone):
            out.append(t)
    return " ".join("".join(out).split())


def _located(pages: DataFrame) -> DataFrame:
    return parts(pages.select("url", F.coalesce("html", F.lit("")).alias("html"))).select(hash64(F.col("host")).alias("host"), F.xxhash64("html").alias("page"), "html")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """host (hashed), often and some: hashes of the subtrees that recur on a share of the host's different pages."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, page, found, links = [], [], [], []
            for h, p, text in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                own = hashes(text)
                own[0] = False  # counts the pages themselves
                host += [h] * len(own)
                page += [p] * len(own)
                found += own
                links += own.values()
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (host, page, found)), pa.array(links, pa.bool_())], names=["host", "page", "subtree", "links"])

    rows = _located(pages).mapInArrow(run, "host long, page long, subtree long, links boolean").distinct()
    counts = rows.groupBy("host", "subtree").agg(F.countDistinct("page").alias("n"), F.max("links").alias("links")).filter(F.col("n") >= least_pages)
    counts = stash(counts, "subtrees")
    total = counts.filter("subtree = 0").select("host", F.col("n").alias("pages"))
    part = F.col("n") / F.col("pages")
    is_some = (part >= share) | F.col("links")
    found = counts.filter("subtree <> 0").join(total, "host").filter(is_some | (part >= article_share))
    often, some = (F.collect_list(F.when(least, F.col("subtree"))) for least in (part >= article_share, is_some))
    return stash(found.groupBy("host").agg(often.alias("often"), some.alias("some")), "templates")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """Add text and n_chars to every page."""
    known = templates(pages, least_pages, share, article_share)
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    rows = parts(pages.select("url", F.col("html").alias("page"), F.struct(*kept).alias("row"))).select("row", "page", hash64(F.col("host")).alias("host"))
    rows = rows.join(known, "host", "left")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple[set, set]] = {}
        for batch in batches:
            texts = []
            for host, often, some, page in zip(*(batch.column(c) for c in ("host", "often", "some", "page")), strict=True):
                key = host.as_py()
                if key not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[key] = set(often.as_py() or ()), set(some.as_py() or ())
                texts.append(main_text(page.as_py() or "", *sets[key]))
            cols = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cols], names=schema.names)

    return rows.mapInArrow(run, schema).select("row.*", "text", "n_chars")
