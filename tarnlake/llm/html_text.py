"""Main text of web pages by site style trees.

The distinct DOMs of one host are merged by path (tag, first class), all branches with text, menus and notices included: a node of the
merged tree has, over the pages that show it, a distribution of presentations (the sequence of its children's signatures) and one of
contents (the text below it).  Its importance is the mean of the two entropies, each divided by the log of the number of pages: near 0
for a branch that looks and reads the same on every page, near 1 for one that never repeats.  The entropy of contents is
smoothed by PRIOR further pages with contents of their own, so that a few pages say little and many say much, without a switch between.

Branches of low importance are removed from each page.  What entropy can't tell, as adverts and reader comments differ from page to page and
a host may have one page only, tags, roles and class names decide.  Of what is left, the articles are the text; without any, the main
element, then the body.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, written

#: A branch goes if its importance is below LOW; an element that holds running text, such as a paragraph, if it is below LOW_TEXT.
LOW, LOW_TEXT, PRIOR = 0.4, 0.15, 3
#: Up to so many hosts and nodes the branches to remove are broadcast; beyond it they are joined on (host, salt).
BROADCAST_NODES, SALTS = 200_000, 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"br", "option", "body", "html"}
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table td th div section article main nav aside header footer form body html".split())
NOISE_TAGS = frozenset("nav footer aside form button select dialog menu head object audio video canvas".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote li dd dt td th tr tbody figure figcaption address details summary".split())
#: The tree never removes these, nor what holds an article.
WHOLE = frozenset("html body main article".split())
#: A class or id calls an element noise if it is made of these words, with or without words of PARTS: "ad", "site-menu", not "with-sidebar".
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsor promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert"
    " sidebar side menu nav navbar navigation breadcrumb breadcrumbs share sharing social comment comments disqus reply replies related recommended footer foot masthead topbar subscribe"
    " subscription newsletter signup popup modal overlay login search pagination pager widget toolbar copyright disclaimer paywall skip tags".split()
)
TALK_WORDS = frozenset("comment comments disqus reply replies related recommended recommendations".split())
PARTS = frozenset(
    "box list bar block area section wrap wrapper container inner outer panel links link items item group slot unit form button buttons body content title header head left right top"
    " bottom primary secondary site page main global post entry article user reader thread respond module region row col main js id new latest the of to and number count".split()
)
PAGE_HEADERS = frozenset("header site-header main-header global-header top-header".split())
#: A quote counts only after "=", so an apostrophe in a value doesn't swallow text; a tag that the page's end cuts short is dropped.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Every attribute in order, so that no word of a value is taken for a name.
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[^\W\d_]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_END_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


@dataclass
class Node:
    tag: str
    path: int  # the hash of the signatures from the root down
    talk: bool  # discussions and teasers: an article in there is theirs
    noise: bool  # tag, role or class of it or of one above say so
    article: bool
    main: bool
    children: list[str] = field(default_factory=list)
    holds: bool = False  # an article or main element


@dataclass
class Block:
    text: str
    node: Node
    above: tuple[Node, ...]
    linked: int


def _called(name: str, words: frozenset[str]) -> bool:
    """Whether a class name or id is made of words (one at least) and PARTS."""
    found = _WORDS.findall(name)
    return any(w in words for w in found) and all(w in words or w in PARTS for w in found)


def _told(tag: str, raw: str) -> tuple[str, bool, bool]:
    """The signature of a start tag, whether its tag or attributes call it noise, and whether they call it a discussion or teaser."""
    noise, talk, label = tag in NOISE_TAGS, tag == "aside", ""
    if len(raw) > len(tag) + 2:
        for name, value in _ATTR.findall(raw, len(tag) + 1):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                names = [] if name == "id" and tag in HEADINGS else value.split()
                talk = talk or any(_called(n, TALK_WORDS) for n in names)
                noise = noise or any(_called(n, NOISE_WORDS) for n in names)
                if name == "class" and names:
                    label = "." + names[0]
            elif name == "role":
                noise = noise or value in NOISE_ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                noise = True
    if tag in WHOLE:
        noise = tag == "article" and talk  # a comment may be an article; layout classes of the whole say nothing
    return tag + label, noise, talk


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order, white space made single, with the elements above them."""
    root = Node("", 0, False, False, False, False)
    stack, out = [root], []
    pieces: list[str] = []
    links = 0
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, stack[-1], tuple(stack[1:]), linked))
            pieces.clear()
        linked = 0

    def close(names: tuple[str, ...], stop: frozenset[str]) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return True
            if stack[i].tag in stop:
                return False
        return False

    page = page or ""
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        raw = m[0]
        if raw[0] != "<" or raw == "<":
            pieces.append(raw)
            if links:
                linked += len(raw)
            continue
        if raw[1] in "!?":
            continue
        tag = _NAME.match(raw)[1].lower()
        if raw[1] == "/":
            if tag in BLOCK:
                flush()
                if any(n.tag == tag for n in stack):
                    close((tag,), frozenset())
            elif tag == "a":
                links = max(0, links - 1)
            continue
        if tag in RAW:
            end = _END_RAW[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag not in BLOCK:
            if tag == "a":
                links = 1
            if tag in NOISE_TAGS and tag not in VOID and tag != "head":
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else at
            continue
        flush()
        if tag in VOID:
            continue
        if tag in ENDS_P:
            close(("p",), SCOPE)
            if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1].tag):
                stack.pop()
        if tag in SIBLINGS:
            close(SIBLINGS[tag], SCOPE - {"td", "th"} if tag == "tr" else SCOPE - set(SIBLINGS[tag]))
        if tag in ("body", "html") and any(n.tag == tag for n in stack):
            continue
        signature, noise, talk = _told(tag, raw)
        whole = tag in ("article", "main") and not noise
        if whole:
            # an article isn't part of a menu or an advert: those were left open, unless they hold discussions or teasers
            while len(stack) > 1 and stack[-1].noise and not stack[-1].talk:
                stack.pop()
        above = stack[-1]
        if not any(n.article for n in stack) and (tag == "header" or signature.partition(".")[2] in PAGE_HEADERS):
            noise = noise or tag not in WHOLE
        noise = above.noise or noise
        if whole and not noise:
            for n in stack:
                n.holds = True
        node = Node(tag, _hash(f"{above.path}/{signature}"), above.talk or talk, noise, above.article or (tag == "article" and not noise), above.main or tag == "main" or 'role="main"' in raw)
        above.children.append(signature)
        stack.append(node)
    flush()
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def style_nodes(page: str | None) -> list[tuple[int, bool, int, int, int]]:
    """(path, running, presentation, content, page) of a page's elements that hold text, one a path: hashes, page being that of all their
    blocks, and whether the element is one of RUNNING."""
    whole = xxhash.xxh3_64()
    content: dict[int, int] = {}
    shape: dict[int, dict[int, Node]] = {}
    for b in blocks(page):
        h = _hash(b.text)
        whole.update(f"{b.node.path},{h};")
        for n in b.above:
            content[n.path] = (content.get(n.path, 7) * 0x100000001B3 + h) & ((1 << 63) - 1)
            shape.setdefault(n.path, {})[id(n)] = n
    presentation = lambda nodes: _hash(";".join(",".join(n.children) for n in nodes))
    digest = whole.intdigest() >> 1
    return [(p, next(iter(shape[p].values())).tag in RUNNING, presentation(shape[p].values()), c, digest) for p, c in content.items()]


def main_text(page: str | None, low: frozenset[int] | set[int] = frozenset()) -> str:
    """The article of a page; low holds the hashes of the host's paths of low importance.

    A page of which those leave nothing is read by its tags and classes alone."""
    all_ = [b for b in blocks(page) if not b.node.noise]
    kept = [b for b in all_ if not any(n.path in low and n.tag not in WHOLE and not n.holds for n in b.above)] or all_
    for wanted in (lambda b: b.node.article, lambda b: b.node.main):
        if chosen := [b for b in kept if wanted(b)]:
            return " ".join(b.text for b in chosen)
    return " ".join(b.text for b in kept if not (b.node.tag == "li" and b.linked >= len(b.text)))


def host_of(url: str | None) -> str:
    """The lower-cased host of a URL, '' if it has none."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "path", "running", "presentation", "content", "page"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        rows = [(host_of(u.as_py()), *n) for u, h in zip(batch.column("url"), batch.column("html")) for n in style_nodes(h.as_py())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def importance(pages: DataFrame) -> DataFrame:
    """The site style tree: host, path, running, pages, importance, of every node with text of every host.

    Pages of a host with the same blocks are one page: copies tell nothing about what its pages share."""
    nodes = pages.mapInArrow(_node_batches, "host string, path bigint, running boolean, presentation bigint, content bigint, page bigint")
    nodes = nodes.groupBy("host", "page", "path").agg(F.first("running").alias("running"), F.min("presentation").alias("presentation"), F.min("content").alias("content"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("presentation").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("k")
    counted = nodes.select("host", "path", "running", kinds).groupBy("host", "path", "running", "k.kind", "k.value").agg(F.count(F.lit(1)).alias("c"))
    summed = counted.groupBy("host", "path", "running", "kind").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    # the further pages have contents of their own: each adds 1 to the pages and nothing to the sum of c log c
    n = F.col("pages") + F.when(F.col("kind") == 1, F.lit(PRIOR)).otherwise(F.lit(0))
    entropy = F.when(n < 2, F.lit(1.0)).otherwise((F.log(n) - F.col("clogc") / n) / F.log(n))
    return summed.select("host", "path", "running", "pages", entropy.alias("h")).groupBy("host", "path", "running").agg(F.max("pages").alias("pages"), F.avg("h").alias("importance"))


def _host_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("host", pa.array([host_of(u.as_py()) for u in batch.column("url")], pa.string()))


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, frozenset[int]] = {}
    for batch in batches:
        texts = []
        for page, low in zip(batch.column("html"), batch.column("low").to_pylist()):
            key = tuple(low or ())
            if key not in held:
                held.clear() if len(held) > 1000 else None
                held[key] = frozenset(key)
            texts.append(main_text(page.as_py(), held[key]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    A null or empty html gives the empty text; a null url or one without a host is of the host ''.  Whole pages are read.
    Copies of a page count as one page of their host and give equal texts; an empty table gives no rows; other columns are not read.
    """
    rows = own_columns(pages, id=id_col, url=url_col, html=html_col)
    bound = F.when(F.col("running"), F.lit(LOW_TEXT)).otherwise(F.lit(LOW))
    low = importance(rows.select("url", "html")).where((F.col("importance") < bound) & (F.col("host") != ""))
    low = written(low.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("low")), "branches")
    size = low.agg(F.coalesce(F.sum(F.size("low") + 1), F.lit(0))).first()[0]
    schema = "page_id bigint, url string, text string, n_chars bigint"
    hosted = rows.select(F.col("id").cast("bigint").alias("id"), "url", "html").mapInArrow(_host_batches, "id bigint, url string, html string, host string")
    if size <= BROADCAST_NODES:
        joined = hosted.join(F.broadcast(low), "host", "left")
    else:
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hosted.withColumn("salt", F.pmod(F.xxhash64("id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("id", "url", "html", "low").mapInArrow(_text_batches, schema)
