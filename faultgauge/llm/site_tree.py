"""Main text of web pages by a site style tree.

Pages of one host are merged into one tree of element paths. For each path, over all pages of the host that have
it, two entropies tell how much varies: that of what the branch says, and that of how it is laid out (the tags
it holds). A branch that says the same on page after page matters little and is taken out of every page. Tags
and names that state a part's role (menus, adverts, forms ..., or the article) settle its importance beforehand.

The tree is never gathered in one place: it is a table of counts by host, path and content, summed up before
each shuffle, and a page is joined only with the paths that it has itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from faultgauge.llm.common import bounded_batches, slices, written

CONTENT_SHARE = 0.9  # of importance; the rest is for layout
THRESHOLD = 0.5  # branches below are removed
SMALL_TREE = 50_000  # unimportant branches that a task may hold
MIN_PAGES = 8  # fewer pages of a host say nothing about a branch

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never main text.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frameset head header iframe input map menu "
    "nav noscript object optgroup option script select style svg template textarea title video".split()
)
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words in a class or id that name such a part.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner banners breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pagination paywall popup promo promos promotion related reply "
    "replies respond search share sharing sidebar signup skyscraper social sponsor sponsored sponsors subscribe toolbar widget "
    "widgets".split()
)
MAIN = frozenset(("article", "main"))
#: An opening tag ends these open elements, as far as no element of the second set lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(script|style|textarea|title|noscript|iframe|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.I | re.S,
)
#: Behind the last ``>`` no tag ends any more; what would be one is text, and is not looked at to the end of the page again.
TAIL = re.compile(r"(?:<!--|<[!?/]).*|[^<]+|<|((((?!))))", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z0-9]+")


class Element:
    __slots__ = ("tag", "path", "fixed", "gone", "inside", "said", "held")

    def __init__(self, tag: str, path: int, fixed: int):
        self.tag, self.path = tag, path
        self.fixed = fixed  # -1: dropped, 1: in the article, 0: its entropy decides
        self.gone = self.inside = False
        self.said: list[str] = []  # digests of texts and branches
        self.held: list[str] = []  # tags of its children


def opened(tag: str, attributes: str, parent: Element, unimportant: frozenset[int]) -> Element:
    names, roles = [], []
    if attributes:
        for kind, *values in ATTRIBUTE.findall(attributes):
            (roles if kind.lower() == "role" else names).append("".join(values).lower())
    words = set(WORDS.findall(" ".join(names)))
    inside = parent.fixed == 1
    if parent.fixed == -1 or words & DROPPED_NAMES or DROPPED_ROLES.intersection(roles):
        fixed = -1
    elif tag in DROPPED and not (tag == "header" and inside):
        fixed = -1
    elif tag in MAIN or "main" in roles:
        fixed = 1
    else:
        # what the site itself has named within the article is judged like anything else
        fixed = 1 if inside and not names else 0
    label = ".".join([tag, *sorted(words)])
    e = Element(tag, xxhash.xxh3_64_intdigest(f"{parent.path}/{label}") - 2**63, fixed)
    e.gone = parent.gone or fixed == -1 or (fixed == 0 and tag not in INLINE and e.path in unimportant)
    e.inside = inside or parent.inside or fixed == 1
    return e


def tokens(html: str) -> Iterator[re.Match]:
    last, at = html.rfind(">"), 0
    while at < len(html):
        m = (TOKEN if at <= last else TAIL).match(html, at)
        yield m
        at = m.end()


def walk(html: str, unimportant: frozenset[int] = frozenset()) -> tuple[list[tuple[Element, str]], dict[int, list[tuple[int, int]]]]:
    """Blocks of a page in their order, and what each element path says and holds.

    A block is the element it stands in and its text. A path is the digest of tags and names from the root on.
    A signature is a pair of digests of content and layout; a path has one for each of its elements.
    """
    root = Element("", 0, 0)
    stack = [root]
    open_: Counter[str] = Counter()  # elements on the stack by tag
    blocks, signatures = [], {}
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                stack[-1].said.append(text)
                blocks.append((stack[-1], text))

    def close() -> None:
        e = stack.pop()
        open_[e.tag] -= 1
        content = xxhash.xxh3_64_intdigest("\n".join(e.said).encode()) - 2**63
        layout = xxhash.xxh3_64_intdigest(" ".join(e.held).encode()) - 2**63
        signatures.setdefault(e.path, []).append((content, layout))
        if e.said:
            stack[-1].said.append(str(content))

    for m in tokens(html):
        tag = m[3]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                parts.append(unescape(token) if "&" in token else token)
            elif m[1]:
                parts.append(" ")
            continue
        tag = tag.lower()
        block = tag not in INLINE
        if m[2]:
            if open_[tag]:
                if block or stack[-1].fixed == -1:
                    flush()
                # an inline end tag does not close the block around it
                last = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
                if block or all(e.tag in INLINE for e in stack[last:]):
                    while len(stack) > last:
                        close()
            elif tag == "br":
                parts.append(" ")
            continue
        if not block and tag in VOID:
            parts.append(" " if tag == "br" else "")
            continue
        if tag in ("html", "body") and open_[tag]:
            continue
        if block:
            flush()
            if open_["p"] and tag not in ("body", "html"):
                last = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p")
                if all(e.tag in INLINE for e in stack[last + 1 :]):
                    while len(stack) > last:
                        close()
            if tag in CLOSES:
                ended, limits = CLOSES[tag]
                at = len(stack) - 1
                while at and stack[at].tag not in limits and stack[at].tag not in ended:
                    at -= 1
                if at and stack[at].tag in ended:
                    while len(stack) > at:
                        close()
        e = opened(tag, m[4], stack[-1], unimportant)
        if not block and e.fixed == -1 and stack[-1].fixed != -1:
            flush()
        if block and (not stack[-1].held or stack[-1].held[-1] != tag):
            stack[-1].held.append(tag)
        if tag in VOID:
            continue
        stack.append(e)
        open_[tag] += 1
    flush()
    while len(stack) > 1:
        close()
    return blocks, signatures


def host(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


def main_text(html: str, unimportant: frozenset[int]) -> str:
    """Blocks that no dropped or unimportant branch holds; of a page with an article, only those in it."""
    kept = [(e.inside, text) for e, text in walk(html, unimportant)[0] if not e.gone]
    if any(inside for inside, _ in kept):
        kept = [b for b in kept if b[0]]
    return "\n\n".join(text for _, text in kept)


NODE = pa.schema([("host", pa.string()), ("path", pa.int64()), ("page", pa.int64()), ("content", pa.int64()), ("layout", pa.int64())])


def nodes(pages: DataFrame) -> DataFrame:
    """A row for each element path of each page: ``host, path, page, content, layout``; ``page`` is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 4 << 20):
            rows = []
            for page, url, html in zip(*[c.to_pylist() for c in part.columns]):
                name = host(url)
                for path, found in walk(html)[1].items():
                    content, layout = found[0] if len(found) == 1 else (
                        xxhash.xxh3_64_intdigest(repr([f[i] for f in found])) - 2**63 for i in (0, 1)
                    )
                    rows.append((name, path, page, content, layout))
            columns = list(zip(*rows)) or [[]] * len(NODE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE)], schema=NODE)

    return pages.select("page", "url", "html").mapInArrow(run, "host string, path long, page long, content long, layout long")


def importance(once: DataFrame) -> DataFrame:
    """``host, path, pages, importance`` of the merged tree, from one row for each host, path and page.

    Entropies are divided by the logarithm of the number of pages, so they lie between 0 and 1. A path of a
    single page has importance 1.
    """

    def entropy(value: str) -> DataFrame:
        counts = once.groupBy("host", "path", value).agg(F.count("*").alias("c"))
        sums = counts.groupBy("host", "path").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
        share = F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)
        return sums.select("host", "path", F.col("n").alias("pages"), share.alias(value))

    return entropy("content").join(entropy("layout").drop("pages"), ["host", "path"]).select(
        "host", "path", "pages",
        (F.lit(CONTENT_SHARE) * F.col("content") + F.lit(1 - CONTENT_SHARE) * F.col("layout")).alias("importance"),
    )


def extract(pages: DataFrame, small: int = SMALL_TREE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Blocks are joined by an empty line, white space in a block is one space. A null or empty html gives an
    empty text, as does a page without main text; repeated rows give repeated rows; pages without a readable
    host form one site of their own. An empty table gives no rows.

    Up to ``small`` unimportant branches of all sites together are sent to every task; beyond that each page
    is joined with those that it has itself. Results are the same.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("page", F.xxhash64("url", "html"))
    # equal pages count once
    once = nodes(rows).groupBy("host", "path", "page").agg(F.first("content").alias("content"), F.first("layout").alias("layout"))
    once = written(once, "site-nodes")
    minor = importance(once).filter((F.col("pages") >= MIN_PAGES) & (F.col("importance") < THRESHOLD))
    minor = written(minor.select("host", "path"), "site-minor")
    sites: dict[str, set[int]] | None = None
    if minor.count() <= small:
        sites = {}
        for r in minor.collect():
            sites.setdefault(r["host"], set()).add(r["path"])
        joined = rows.select("page_id", "url", "html")
    else:
        # no more of them for a page than it has elements
        own = once.join(minor, ["host", "path"], "left_semi").groupBy("page").agg(F.collect_set("path").alias("minor"))
        joined = rows.join(own, "page", "left").select("page_id", "url", "html", "minor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 4 << 20):
            urls, htmls = part.column(1).to_pylist(), part.column(2).to_pylist()
            minors = part.column(3).to_pylist() if sites is None else [sites.get(host(u)) for u in urls]
            texts = [main_text(h, frozenset(m or ())) for h, m in zip(htmls, minors)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
