"""Main text of web pages by consensus of each host's pages.

Every page scores its containers by the running text below them; the generalised tag-class paths of the containers get
votes, summed per host in Spark; each page is then extracted again from the containers on its host's winning path, or
from its own best container if it has none there.

Left out wherever they stand: navigation, page headers, footers, sidebars, forms, scripts, styles, adverts, notices and
reader comments, told by element, role, and names in class and id. A name counts by its head noun: the last word that does not merely say what kind of
box or where it is (``ad-box``, ``sidebar-left``), so ``related-work`` or ``reply-to-critics`` say nothing, nor do states such as ``has-sidebar`` or ``comments-open``, nor names of paragraphs,
headings and other elements that hold text themselves. An element that holds most of a page's running text stays, unless its name is comments.

Beside the chosen container its siblings count if they are articles' prose too: of the same kind of path, or with sentences of their own and few links. So a lead
or a second part in a container of its own stays. Character references are decoded, white space within a block becomes one space, blocks are joined by one space.

Null or empty html gives an empty text; a null url counts as a host of its own (''). Rows that repeat are extracted each.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

#: Up to this many hosts the winning paths (each a 64-bit hash) are broadcast; more are joined.
BROADCAST_HOSTS = 20_000
#: An element with more than this share of a page's running text is no side matter, whatever its class says.
MOST_OF_PAGE = 0.6

# HTML elements by role, and words that mark what is no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav footer aside form button select option input dialog menu svg canvas object audio video head map datalist fieldset".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "header masthead footer colophon sidebar aside comment comments commentlist disqus respond reply replies notice notices alert cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager toolbar skip disclaimer hidden".split()
)

COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words of names that only say what sort of box something is, or where.
BOXES = frozenset("box boxes body wrap wrapper container area list lists item items inner outer block blocks section slot unit bar panel left right top bottom middle center main wide narrow buttons button links link text posts row col column desktop mobile v article articles story stories news message messages thread threads title heading form content contents group grid card cards feed entry entries primary secondary tools icons strip image images".split())
#: Elements that may be side matter by name; others hold text themselves.
NAMED = frozenset("div section table tbody tr td ul ol dl header article details figure center".split())
#: A sibling of the chosen container belongs to it with this many characters of sentences that are not links, at least four times as many as of links.
SIBLING = 80
STATES = frozenset("has with no not without is open opened closed enabled disabled on off".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?…]['\"”’»)]*$|[。！？]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCES = frozenset("ul ol dl table article section div main body td aside nav form".split())


def side_matter(tag: str, names: str, in_article: bool) -> str | None:
    """What words of class and id say of an element: ``comments``, ``side`` (menus, adverts and the like) or nothing."""
    if tag not in NAMED:
        return None
    out = None
    for token in names.split():
        words = [w.lower() for w in _PART.findall(token)]
        if not words or words[0] in STATES or words[-1] in STATES:
            continue
        while len(words) > 1 and words[-1] in BOXES:
            words.pop()
        head = words[-1]
        if head in COMMENTS and (tag != "article" or len(words) == 1):
            return "comments"
        if tag != "article" and head in MARKS and not (in_article and head == "header"):
            out = "side"
    return out


def path_key(path: str) -> int:
    """A container's whole path as a signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(path.encode()) - 2**63


class Page:
    """The blocks of a page, each with its text and the containers around it; ``paths[c]`` is a container's generalised path."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, tuple[int, ...], bool, int]] = []  # text, containers from outside in, dropped, characters of links
        self.paths: list[str] = []
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.sides: list[tuple[int, ...]] = []  # of each block, the elements around it that may be side matter
        self._parse(html)
        self._judge()

    def _judge(self) -> None:
        """Blocks in side matter are dropped, but for elements that hold most of the page's running text."""
        held: dict[int, float] = {}
        whole = 0.0
        for (text, _, dropped, links), sides in zip(self.blocks, self.sides):
            if not dropped:
                worth = max(0.0, len(text) - 2.0 * links)
                whole += worth
                for e in sides:
                    held[e] = held.get(e, 0.0) + worth
        keep = {e for e, x in held.items() if x > MOST_OF_PAGE * whole}
        self.blocks = [(t, a, d or any(e not in keep for e in sides), n) for (t, a, d, n), sides in zip(self.blocks, self.sides)]

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, bool, int, tuple[int, ...]]] = []  # tag, dropped, its container or -1, elements that may be side matter
        elements = 0
        around: list[int] = []
        buffer: list[str] = []
        links = 0
        in_link = 0

        def flush():
            nonlocal links
            if buffer:
                text = " ".join(unescape("".join(buffer)).split())
                if text:
                    self.blocks.append((text, tuple(around), bool(stack and stack[-1][1]), links))
                    self.sides.append(stack[-1][3] if stack else ())
                buffer.clear()
            links = 0

        def pop():
            nonlocal in_link
            tag, _, container, _ = stack[-1]
            if tag not in INLINE:
                flush()
            stack.pop()
            in_link -= tag == "a"
            if container >= 0:
                around.pop()

        def push(tag: str, attributes: str):
            nonlocal in_link, elements
            if tag not in INLINE:
                flush()
            in_article, sides = any(x[0] in ("article", "main") for x in stack), stack[-1][3] if stack else ()
            dropped = (stack[-1][1] if stack else False) or tag in DROPPED
            name = tag
            if attributes.strip():
                found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
                side = side_matter(tag, f"{found.get('class') or ''} {found.get('id') or ''}", in_article)
                if side == "side":
                    elements += 1
                    sides = (*sides, elements)
                bare = {k.lower() for k in _ATTRIBUTE.sub(" ", attributes).replace("/", " ").split()}
                dropped = dropped or side == "comments" or (found.get("role") or "").lower() in ROLES or bool(_HIDDEN.search(found.get("style") or "")) or found.get("aria-hidden") == "true" or "hidden" in bare or found.get("hidden", "until-found") != "until-found"
                if found.get("class"):
                    name += "." + re.sub(r"\d+", "0", found["class"].split()[0] if found["class"].split() else "")
            dropped = dropped or (tag == "header" and not in_article)
            container = -1
            if tag in CONTAINERS:
                container = len(self.paths)
                self.paths.append((self.paths[around[-1]] + "/" if around else "") + name)
                self.tags.append(tag)
                self.parents.append(around[-1] if around else -1)
                around.append(container)
            stack.append((tag, dropped, container, sides))
            in_link += tag == "a"

        def close_until(tags: set):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in tags:
                    while len(stack) > i:
                        pop()
                    return
                if stack[i][0] in _FENCES:
                    return

        at = 0
        while True:
            m = _TOKEN.search(html, at)
            text = html[at : m.start() if m else len(html)]
            if text:
                buffer.append(text)
                links += len(text) if in_link else 0
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if any(x[0] == tag for x in stack):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                elif tag == "p":
                    flush()
                continue
            attributes = m[3] or m[6] or ""
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(html, at)
                if end:
                    at = end.start()
                    closing = _TOKEN.match(html, at)
                    at = closing.end() if closing else end.end()
                elif tag in ("script", "style"):
                    break
                continue
            if tag in VOID:
                if tag == "br":
                    buffer.append(" ")
                elif tag not in INLINE:
                    flush()
                continue
            if tag not in INLINE:
                close_until({"p"})
            if tag in _CLOSES:
                close_until(_CLOSES[tag])
            push(tag, attributes)
            if attributes.endswith("/") and tag not in CONTAINERS and tag in INLINE:
                pop()
        flush()

    def scores(self) -> dict[int, float]:
        """A container's score: the running text below it, less for every level between, more for elements made for it."""
        out: dict[int, float] = {}
        for text, around, dropped, links in self.blocks:
            if not dropped:
                worth = max(0.0, len(text) - 2.0 * links)
                for c in reversed(around):
                    out[c] = out.get(c, 0.0) + worth
                    worth *= 0.7
        return {c: s * (1.5 if self.tags[c] in ("article", "main") else 1.0) for c, s in out.items() if s > 0}

    def votes(self) -> dict[int, float]:
        """Shares of the page's one vote by path."""
        by_path: dict[int, float] = {}
        for c, s in self.scores().items():
            key = path_key(self.paths[c])
            by_path[key] = by_path.get(key, 0.0) + s
        whole = sum(by_path.values())
        return {k: v / whole for k, v in by_path.items()}

    def text(self, path: int | None) -> str:
        """The text below the containers on this path, or below the page's best container."""
        chosen = {c for c, p in enumerate(self.paths) if path is not None and path_key(p) == path}
        if not any(not dropped and not chosen.isdisjoint(around) for _, around, dropped, _ in self.blocks):
            scores = self.scores()
            if not scores:
                return " ".join(t for t, around, dropped, _ in self.blocks if not dropped and not around)
            chosen = {max(scores, key=lambda c: (scores[c], -c))}
        chosen |= self._siblings(chosen)
        return " ".join(t for t, around, dropped, _ in self.blocks if not dropped and not chosen.isdisjoint(around))

    def _siblings(self, chosen: set[int]) -> set[int]:
        """Containers next to the chosen ones, within the same parent, that hold prose of their own."""
        prose: dict[int, int] = {}
        linked: dict[int, int] = {}
        beside = {self.parents[c] for c in chosen} - {-1}
        for text, around, dropped, links in self.blocks:
            if dropped or not chosen.isdisjoint(around):
                continue
            for parent, c in zip(around, around[1:]):
                if parent in beside:
                    linked[c] = linked.get(c, 0) + links
                    if _SENTENCE.search(text):
                        prose[c] = prose.get(c, 0) + len(text) - links
        return {c for c, n in prose.items() if n >= SIBLING and n >= 4 * linked[c]}


def host_of(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))


def vote(pages: DataFrame) -> DataFrame:
    """host, path (hash): the path with most votes for each host; ties go to the smallest hash."""

    def ballots(batches):
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(host, path, share) for path, share in Page(html).votes().items()]
            host, path, share = zip(*rows) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.int64()), pa.array([round(s * 1e6) for s in share], pa.int64())], names=["host", "path", "votes"])

    cast = pages.where("html is not null").select(host_of(F.col("url")).alias("host"), "html").mapInArrow(ballots, "host string, path long, votes long")
    counted = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("order"), "path")).alias("best")).select("host", "best.path")


def extract_text(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    winners = Scratch(pages.sparkSession, "html").table(vote(pages), "winners")
    if winners.count() <= broadcast_hosts:
        winners = F.broadcast(winners)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(winners, "host", "left").select("page_id", "url", "html", "path")

    def extract(batches):
        for batch in batches:
            text = [Page(html).text(path) if html else "" for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
