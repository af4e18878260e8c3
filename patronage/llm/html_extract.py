"""Main text of web pages by template deduction from equivalence classes.

A token is a tag together with its path of enclosing tags, or a word together with the path of its element. Tokens that
occur on the same pages of a host form an equivalence class. Words of large, frequent classes that occur equally often on
each of their pages are the template's; a block made of such words only is dropped. What remains are the slots, and all
are kept: those inside the host's article or main elements if its template has any, else those of the whole page.

Occurrence vectors are never gathered: a vector's fingerprint is a sum over pages. Pages are dealt to chunks of their host,
and a chunk sends one row for each token that may reach the host's support.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from patronage.llm.textops import U, as_long, mix, small_batches
from patronage.llm.url_filter import host_and_path
from patronage.session import pin

# Element names by their part in a page, and words in class and id names of parts that are not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title".split())
CLUTTER = frozenset("nav header footer aside form button select dialog menu head script style noscript template iframe svg textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " canvas object math annotation mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
MAIN = frozenset(("article", "main"))
HEADLINE = frozenset(("header",))
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)),
    "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
}
CLUTTER_NAME = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer"
    " sidebar aside widget cookie cookies consent notice notices popup modal newsletter subscribe signup login share sharing social related recommended"
    " comment comments disqus replies respond pagination pager".split()
)
CLUTTER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE | re.ASCII) for name in RAW}


@dataclass
class Node:
    """An open element: its path, whether it or an enclosing one is clutter, whether it is a link.

    ``named`` elements are clutter by a word only, unless they hold most of the page's text; ``inside`` ones are below an
    article or main element, where a header is the article's own headline; ``text`` and ``main`` count
    the characters below an element, and those also below an article or main element.
    """

    name: str
    path: str
    clutter: bool
    link: bool
    above: Node | None = None
    named: bool = False
    inside: bool = False
    text: int = 0
    main: int = 0


@dataclass
class Page:
    """A page read once from front to back: pieces of text with their element, and how often each path occurs."""

    pieces: list[tuple[Node, str]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    clutter: set[str] = field(default_factory=set)


#: Characters of a host's pages that one task folds at a time.
CHUNK_CHARS = 8 << 20
#: Tokens of single pages that wait to be folded.
PENDING_TOKENS = 1 << 18
#: A block boundary among the pieces.
BREAK = "\x00"


def _named_clutter(attributes: str, inside: bool) -> tuple[str, bool]:
    # a value stands in double quotes, single quotes or none
    found = {m[0].lower(): (m[1] or m[2] or m[3]).lower() for m in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    label = " ".join(found.get(k, "") for k in ("class", "id")).strip()
    words = set(label.split()) - (HEADLINE if inside else set())
    return label, not CLUTTER_NAME.isdisjoint(words) or found.get("role", "") in CLUTTER_ROLE or "hidden" in attributes.split() or found.get("aria-hidden") == "true"


def read_page(source: str) -> Page:
    """Tags in order on a stack: what a tag closes by itself is closed, an end tag without its start is passed over."""
    page = Page()
    root = Node("", "", False, False)
    stack, at, nodes = [root], 0, []
    while match := _TOKEN.match(source, at):
        at, token, name = match.end(), match[0], match[2]
        if name is None:
            if token[0] != "<" or token == "<":
                page.pieces.append((stack[-1], token))
            continue
        name = name.lower()
        if match[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
            if name not in INLINE:
                page.pieces.append((stack[-1], BREAK))
            continue
        if name not in INLINE:
            page.pieces.append((stack[-1], BREAK))
        # an open inline element or a paragraph ends where an element begins that it cannot hold
        for depth in range(len(stack) - 1, 0, -1):
            if name in CLOSED_BY.get(stack[depth].name, ()):
                del stack[depth:]
                break
            if stack[depth].name not in INLINE:
                break
        above = stack[-1]
        inside = above.inside or above.name in MAIN
        label, odd = _named_clutter(match[3], inside)
        path = f"{above.path}>{name}" + (f".{label}" if label else "")
        clutter = name in CLUTTER and not (inside and name in HEADLINE)
        node = Node(name, path, above.clutter or clutter, above.link or name == "a", above, odd and name not in ("html", "body"), inside)
        nodes.append(node)
        page.counts[path] = page.counts.get(path, 0) + 1
        if name in RAW:
            end = _RAW_END[name].search(source, at)
            at = len(source) if end is None else (source.find(">", end.end()) + 1 or len(source))
        elif name not in VOID and not match[3].endswith("/"):
            stack.append(node)
    _mark_clutter(page, root, nodes)
    return page


def _mark_clutter(page: Page, root: Node, nodes: list[Node]) -> None:
    """Named elements become clutter with all below them, but not one with most text outside links of the page or its article."""
    if any(node.named for node in nodes):
        for node, text in page.pieces:
            if text != BREAK and not node.clutter and not node.link and (n := len(text.strip())):
                below, main, at = [], False, node
                while at is not None:
                    below.append(at)
                    main = main or at.name in MAIN
                    at = at.above
                for at in below:
                    at.text += n
                    at.main += n * main
    for node in nodes:
        most = node.main * 2 > root.main if root.main else node.text * 2 > root.text
        node.clutter = node.clutter or node.above.clutter or (node.named and not most)
        if node.clutter:
            page.clutter.add(node.path)


def _inside(path: str, slot: str) -> bool:
    return not slot or path == slot or path.startswith(slot + ">")


def token(path: str, word: str = "") -> int:
    """The key of a tag's path, or of a word in the element of that path."""
    return xxhash.xxh3_64_intdigest(f"{path}\x00{word}")


def blocks(page: Page, slots: str | list[str], template: frozenset[int] = frozenset()) -> str:
    """The text below any of ``slots`` without clutter and blocks of ``template`` words only.

    One line per block, white space as single spaces, no empty lines.
    """
    slots = [slots] if isinstance(slots, str) else slots
    out, current = [], []
    for node, text in [*page.pieces, (None, BREAK)]:
        if text == BREAK:
            line = _SPACE.sub(" ", html.unescape("".join(t for _, t in current))).strip()
            if line and not (template and all(token(path, word) in template for path, t in current for word in t.split())):
                out.append(line)
            current = []
        elif not node.clutter and any(_inside(node.path, slot) for slot in slots):
            current.append((node.path, text))
    return "\n".join(out)


def slot_sizes(page: Page) -> dict[str, tuple[int, int]]:
    """Characters of text, and of text in links, below the page and each block element that occurs once and is not clutter."""
    out: dict[str, list[int]] = {}
    for node, text in page.pieces:
        if text != BREAK and not node.clutter and (n := len(text.strip())):
            path = node.path
            while True:
                inline = path.rpartition(">")[2].partition(".")[0] in INLINE
                if not path or (page.counts.get(path) == 1 and not inline):
                    sizes = out.setdefault(path, [0, 0])
                    sizes[0] += n
                    sizes[1] += n * node.link
                if not path:
                    break
                path = path.rpartition(">")[0]
    return {k: (v[0], v[1]) for k, v in out.items()}


def _rank(path: str, text: int, links: int) -> tuple:
    """An article or main element first, then what has most text outside links, then the inner of two with the same."""
    last = path.rpartition(">")[2].partition(".")[0]
    return (last in MAIN, text - 2 * links, path.count(">"), path)


def own_slot(page: Page) -> str:
    """The main slot of a page judged alone; the whole page if nothing else holds nearly all of its text."""
    sizes = slot_sizes(page)
    best = max(sizes, key=lambda p: _rank(p, *sizes[p]), default="")
    return best if best and sizes[best][0] * 2 >= max(s[0] for s in sizes.values()) else ""


class HostTokens:
    """The tokens of pages of one host, a row each: on how many pages, their fingerprint, least and most a page, text below."""

    def __init__(self) -> None:
        self.index: dict[tuple[str, str], int] = {}  # (path, word), no word for a tag
        self.sizes: dict[int, list[int]] = {}
        self.sums = [np.zeros(0, dtype=np.int64) for _ in range(5)]  # n, v1, v2, least, most
        self.pages, self.pending = 0, ([], [], [], [])

    def add(self, page: Page, key: int) -> None:
        index, (at, counts, keys, lengths) = self.index, self.pending
        words = Counter((node.path, w) for node, text in page.pieces if text != BREAK and not node.clutter for w in text.split())
        tags = [(path, n) for path, n in page.counts.items() if path not in page.clutter]
        before, own = len(at), slot_sizes(page)
        for path, n in tags:
            at.append(index.setdefault((path, ""), len(index)))
            counts.append(n)
            if path in own:
                size = self.sizes.setdefault(at[-1], [0, 0])
                size[0] += own[path][0]
                size[1] += own[path][1]
        at += [index.setdefault(word, len(index)) for word in words]
        counts += words.values()
        keys.append(key)
        lengths.append(len(at) - before)
        self.pages += 1
        if len(at) >= PENDING_TOKENS:
            self._fold()

    def _fold(self) -> None:
        at, counts, keys, lengths = (np.array(c, dtype=np.int64) for c in self.pending)
        more = len(self.index) - len(self.sums[0])
        starts = (0, 0, 0, np.iinfo(np.int64).max, 0)
        self.sums = [np.append(c, np.full(more, start, dtype=np.int64)) for c, start in zip(self.sums, starts, strict=True)]
        n, v1, v2, least, most = self.sums
        mark = np.repeat(mix(keys.view(U)), lengths)
        np.add.at(n, at, 1)
        np.add.at(v1, at, (mark & U(0xFFFFFFFF)).view(np.int64))
        np.add.at(v2, at, (mark >> U(32)).view(np.int64))
        np.minimum.at(least, at, counts)
        np.maximum.at(most, at, counts)
        self.pending = ([], [], [], [])

    def rows(self, host: str, least_pages: float) -> pa.RecordBatch:
        """The tokens on at least so many of the pages."""
        self._fold()
        kept = np.flatnonzero(self.sums[0] >= least_pages)
        names = list(self.index)
        keys, sizes = [names[i] for i in kept.tolist()], [self.sizes.get(i, (0, 0)) for i in kept.tolist()]
        columns = [
            pa.array([host] * len(keys), pa.string()), as_long(np.array([token(*k) for k in keys], dtype=U)),
            pa.array([None if word else path for path, word in keys], pa.string()), *(pa.array(c[kept]) for c in self.sums),
            *(pa.array([s[i] for s in sizes], pa.int64()) for i in (0, 1)), pa.array([self.pages] * len(keys), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["host", "token", "path", "n", "v1", "v2", "least", "most", "text", "links", "seen"])


def page_tokens(pages: DataFrame, share: float, support: float, least_pages: int) -> DataFrame:
    """(host, token, path, n, v1, v2, least, most, text, links, seen): tokens of the pages, by chunk of a host, words without a path.

    ``pages`` has (host, html, page, chunk, chunks). Equal pages meet in a chunk and count once; ``seen`` is the number of the
    chunk's pages. Tokens below the ``share`` of these pages stay behind, or below the support if the host is one chunk.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = last = found = None

        def result() -> Iterator[pa.RecordBatch]:
            if found is not None:
                yield found.rows(group[0], max(least_pages, support * found.pages) if group[2] == 1 else share * found.pages)

        for batch in small_batches(batches, "html"):
            columns = (batch.column(c).to_pylist() for c in ("host", "chunk", "chunks", "page", "html"))
            for host, chunk, chunks, key, source in zip(*columns, strict=True):
                if (host, chunk, chunks) != group:
                    yield from result()
                    group, last, found = (host, chunk, chunks), None, HostTokens()
                if key != last:
                    found.add(read_page(source), key)
                    last = key
        yield from result()

    longs = ", ".join(f"{c} long" for c in ("n", "v1", "v2", "least", "most", "text", "links", "seen"))
    dealt = pages.select("host", "chunk", "chunks", "page", "html").repartition("host", "chunk").sortWithinPartitions("host", "chunk", "page")
    return dealt.mapInArrow(read, f"host string, token long, path string, {longs}")


def token_vectors(pages: DataFrame, support: float, least_pages: int, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(host, token, path, n, v1, v2, least, most, text, links, pages): the tokens with the support of the host's pages.

    A host's pages are dealt by their key to chunks of about ``chunk_chars``. A token with the support has at least half that
    share in some chunk, so each chunk sends only those. Where a token that may reach the support was left behind in
    another chunk, its host is read again and nothing is left behind, so no count is an estimate.
    """
    sizes = pages.select("host", "page", F.length("html").alias("chars")).distinct().groupBy("host")
    hosts = pin(sizes.agg(F.count(F.lit(1)).alias("pages"), F.greatest(F.lit(1), F.ceil(F.sum("chars") / chunk_chars)).cast("long").alias("chunks")))
    # one row per chunk_chars of pages at most
    large = F.broadcast(hosts.where("chunks > 1").select("host", "chunks"))
    rows = pages.join(large, "host", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod("page", "chunks"))

    def vectors(rows: DataFrame, share: float) -> DataFrame:
        summed = page_tokens(rows, share, support, least_pages).groupBy("host", "token", "path").agg(
            *(F.sum(c).alias(c) for c in ("n", "v1", "v2", "text", "links", "seen")), F.min("least").alias("least"), F.max("most").alias("most")
        ).join(hosts, "host")
        left = (F.col("pages") - F.col("seen")) * share
        return summed.where((F.col("n") + left >= F.col("pages") * support) & (F.col("n") + left >= least_pages))

    found = pin(vectors(rows, support / 2))
    unsure = found.where("seen < pages").select("host").distinct()
    if not unsure.isEmpty():
        again = pin(vectors(rows.join(F.broadcast(unsure), "host", "left_semi"), 0.0))
        found = found.join(unsure, "host", "left_anti").unionByName(again)
    return found


def templates(pages: DataFrame, support: float = 0.5, least_pages: int = 3, least_tokens: int = 3, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(host, slots, words): the article and main elements and the words of each host's template, from (host, html, page).

    Tokens that occur on the same pages are a class. A class is valid if it has ``least_tokens`` and at least ``support`` of the
    host's pages and ``least_pages``. Words belong to the template if their class is valid and their number is the same on
    each page of it; a main slot needs no class of that size, but occurs once a page. Equal pages count as one.
    """
    members = F.collect_list(F.struct("token", "path", "least", "most", "text", "links"))
    classes = (
        token_vectors(pages, support, least_pages, chunk_chars)
        .groupBy("host", "v1", "v2").agg(members.alias("members"))
        .select("host", (F.size("members") >= least_tokens).alias("valid"), F.explode("members").alias("m"))
        .select("host", "valid", "m.*")
    )
    main = F.regexp_extract("path", r"([^>.]*)(?:\.[^>]*)?$", 1).isin(*sorted(MAIN))
    return classes.groupBy("host").agg(
        F.collect_list(F.when(main & (F.col("most") == 1) & (F.col("text") > 2 * F.col("links")), F.col("path"))).alias("slots"),
        F.collect_list(F.when(F.col("path").isNull() & F.col("valid") & (F.col("least") == F.col("most")), F.col("token"))).alias("words"),
    )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of (page_id, url, html, ...).

    The text is all that the host's template leaves, inside its main slots if the page has one. A page whose host has no
    template is judged alone. A null or empty page, or one with no text outside clutter, has an empty text. Urls without a
    host form one host; repeated rows give repeated rows.
    """
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = pin(templates(rows.select("host", "html", F.xxhash64("html").alias("page"))))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = []
            for source, slots, words in zip(*(batch.column(c).to_pylist() for c in ("html", "slots", "words")), strict=True):
                page = read_page(source)
                if slots is None:
                    texts.append(blocks(page, own_slot(page)))
                else:
                    texts.append(blocks(page, [s for s in slots if s in page.counts] or "", frozenset(w & (1 << 64) - 1 for w in words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = rows.join(found, "host", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "slots", "words")
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
