"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A classifier, trained on the corpus by counts, gives each block a cost for either label; blocks that
stand together, or under one parent, are tied by smoothness edges. The minimum cut between content and boilerplate, found by maximum
flow, is the cheapest labelling of the whole page.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Pages, at most, that the block classifier is trained on; those with the smallest hash of their id.
TRAINING_PAGES = 3000
#: Largest weight of a mark of the markup and of a look of the block, in nats, and the smoothness of neighbours and of siblings.
LARGEST = 6.0
LARGEST_LOOK = 2.0
NEIGHBOUR = 0.8
SIBLING = 0.4
APART = 0.2
CONTENT, BOILERPLATE = 1, 0

# Element names by their role, and words in class, id and role that mark boilerplate.
BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|textarea|select|button|title"
#: Of these, elements that hold nothing but text up to their end tag or the end of the page, and those that a slash closes.
RAW_TAGS = frozenset("script style textarea title".split())
SLASHED_TAGS = frozenset("svg math".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Boilerplate elements that end, if they are not closed, where an article opens.
REPAIRED_TAGS = frozenset("nav aside header footer form".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset("""
nav navbar navigation menu submenu header masthead footer sidebar side aside ad ads adv advert adverts advertisement adsense banner promo promotion sponsor sponsored
cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus reply replies respond discussion related recommended
share sharing social subscribe subscription teaser teasers newsletter signup signin login search breadcrumb breadcrumbs pagination pager widget toolbar tags tagcloud
copyright legal disclaimer skip complementary contentinfo
""".split())

#: Of these, words that also name parts of an article; beside a content word, or inside an article, they mark nothing.
AMBIGUOUS_WORDS = frozenset("header masthead side sidebar skip search tags share sharing social legal notice notices banner widget submenu menu nav discussion".split())
CONTENT_WORDS = frozenset("content article story entry post main body text page wrapper container layout".split())

#: Of a class or id, words after one of these say what the element has beside it, not what it is.
BESIDE_WORDS = frozenset("has with no without".split())

# A quote opens a value only right after the equals sign; any other value ends at white space or the end of the tag.
_ATTRS = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<silent>{SILENT_TAGS})(?=[\s/>])(?P<silent_attrs>{_ATTRS})>"""
    rf"""|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>{_ATTRS})>|<[!?/][^>]*>|<[a-zA-Z][^<>]*(?:>|\Z)""",
    re.S | re.I)
_SLASH_OF_VALUE = re.compile(r"""=\s*[^\s"'>][^\s>]*/$""")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = re.compile(r"[.!?…。:;,\"'”»)]\W*$")


def _ends(html: str, name: str) -> dict[int, int]:
    """Where each element of a name that has an end tag starts, and where that tag ends. An end tag belongs to the last open one."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(rf"""<(/?){name}(?=[\s/>])({_ATTRS})>""", html, re.I):
        if not m[1]:
            if name not in SLASHED_TAGS or not m[2].endswith("/"):
                opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def _silent_end(html: str, m: re.Match, ends: dict[str, dict[int, int]]) -> int:
    """Where an element without text ends. One that is not closed is its tag only, unless nothing but its end tag could end it."""
    name = m["silent"].lower()
    if name in SLASHED_TAGS and m["silent_attrs"].endswith("/"):
        return m.end()
    if name in RAW_TAGS:
        end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, m.end())
        return end.end() if end else len(html)
    if name not in ends:
        ends[name] = _ends(html, name)
    return ends[name].get(m.start(), m.end())


class Block:
    """One run of text between block tags, with what the classifier looks at."""

    __slots__ = ("text", "tag", "parent", "state", "linked", "body", "marks")

    def __init__(self, text: str, tag: str, parent: int, state: str, linked: int, body: int = 0, marks: tuple[int, ...] = ()):
        self.text, self.tag, self.parent, self.state, self.linked, self.body, self.marks = text, tag, parent, state, linked, body, marks

    def runs(self) -> bool:
        """Whether it looks like running text: ten words or more, few of them in links."""
        return self.text.count(" ") >= 9 and self.linked <= 0.25 * len(self.text)

    def traits(self) -> tuple[str, ...]:
        words = self.text.count(" ") + 1
        share = self.linked / max(1, len(self.text))
        return (
            "state=" + self.state,
            "tag=" + (self.tag if self.tag in ("p", "li", "td", "blockquote", "pre") else "h" if self.tag[0] == "h" and self.tag[1:].isdigit() else "other"),
            f"words={0 if words < 3 else 1 if words < 10 else 2 if words < 40 else 3}",
            f"links={0 if share == 0 else 1 if share <= 0.25 else 2 if share <= 0.6 else 3}",
            f"ends={bool(_ENDS.search(self.text))}",
        )


def _role(name: str, attrs: str, within: str) -> str | None:
    """What an element says about its content: 'marked' as boilerplate, 'body' of the article, or nothing."""
    if attrs and name not in ("body", "html", "main"):
        words: set[str] = set()
        for m in _MARKS.finditer(attrs):
            for token in (m[1] or m[2] or m[3] or "").split():
                own = [w.lower() for w in _WORD.findall(token)]
                words.update(own[:next((i for i, w in enumerate(own) if w in BESIDE_WORDS), len(own))])
        found = words & BOILERPLATE_WORDS
        if found and (words & CONTENT_WORDS or within == "body" and found <= {"header", "masthead"}):
            found -= AMBIGUOUS_WORDS
        if found:
            return "marked"
    if name in CONTENT_TAGS:
        return "body"
    if name in BOILERPLATE_TAGS or name == "header" and within != "body":
        return "marked"
    return None


@dataclass
class Parsed:
    """The blocks of a page and what stands in it: whether an article or main is outside marked elements (None: there is none at all), the elements
    that open a body as (name, the body around it), and of the marked elements those that are plain forms or hold a page heading."""

    blocks: list[Block]
    outside: bool | None
    bodies: dict[int, tuple[str, int]]
    plain_forms: set[int]
    headed: set[int]


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order. Scripts, styles, comments and form fields have no text. An element that is not closed ends
    with its parent, and a boilerplate element also where an article opens. An article inside a marked element is marked too if the page
    has another article or main outside such elements; else it is the page's article. A marked element around the page loses its mark, and of
    several articles, short ones full of links and those beside the main element are outside."""
    page = _blocks(html, True)
    if page.outside is False:
        page = _blocks(html, False)
    if page.outside is None and (wrappers := _wrappers(page)):
        page = _blocks(html, True, wrappers)
    _settle_bodies(page)
    return page.blocks


def _wrappers(page: Parsed) -> frozenset[int]:
    """Marked elements that stand around the page's text: forms without a marking name and elements with a page heading that hold more than half of the running
    text, when next to nothing stands outside marked elements."""
    running = sum(len(b.text) for b in page.blocks if b.runs())
    plain = sum(len(b.text) for b in page.blocks if b.state == "plain")
    held: dict[int, int] = {}
    for b in page.blocks:
        if b.runs():
            for e in b.marks:
                held[e] = held.get(e, 0) + len(b.text)
    return frozenset(e for e, n in held.items() if e in page.plain_forms | page.headed and 2 * n > running and plain <= 0.1 * n)


def _settle_bodies(page: Parsed) -> None:
    """Decide between several articles. Beside a main element only a longer article counts; of sibling articles, those with less than a quarter of the
    longest one's text are teasers if a fifth of it is links or nothing holds them."""
    if not page.bodies:
        return
    size, linked = dict.fromkeys(page.bodies, 0), dict.fromkeys(page.bodies, 0)
    for b in page.blocks:
        if b.body and b.state == "body":
            size[b.body] += len(b.text)
            linked[b.body] += b.linked
    for e in sorted(page.bodies, reverse=True):  # inner elements have higher numbers
        around = page.bodies[e][1]
        if around:
            size[around] += size[e]
            linked[around] += linked[e]
    siblings: dict[int, list[int]] = {}
    for e, (_, around) in page.bodies.items():
        siblings.setdefault(around, []).append(e)
    out: set[int] = set()
    for around, own in siblings.items():
        longest = max(size[e] for e in own)
        mains = [size[e] for e in own if page.bodies[e][0] == "main"]
        for e in own:
            if page.bodies[e][0] == "main":
                continue
            short = 4 * size[e] < longest and (not around or 5 * linked[e] >= size[e])
            if short or mains and size[e] <= max(mains):
                out.add(e)
    for e in sorted(page.bodies):
        if page.bodies[e][1] in out:
            out.add(e)
    for b in page.blocks:
        if b.body in out and b.state == "body":
            b.state = "outside"


def _blocks(html: str, inherit: bool, wrappers: frozenset[int] = frozenset()) -> Parsed:
    """Parse a page. With ``inherit``, articles inside marked elements are marked, and only marked elements without an end tag end where an
    article opens. The elements with the numbers of ``wrappers`` have no mark."""
    bodies: dict[int, tuple[str, int]] = {}
    plain_forms: set[int] = set()
    headed: set[int] = set()
    inside: dict[int, tuple[int, tuple[int, ...]]] = {0: (0, ())}  # the body and the marks around each open element
    out: list[Block] = []
    outside: bool | None = None
    stack: list[tuple[str, int, str, int]] = [("", 0, "plain", 0)]  # name, number, state, place in the page
    number, at, links, linked = 0, 0, 0, 0
    pieces: list[str] = []
    seen_body = False

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                holder = next((s for s in reversed(stack) if s[0] in BLOCK_TAGS), stack[0])
                place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] is holder), 0)
                out.append(Block(text, holder[0] or "other", stack[max(0, place - 1)][1], holder[2], min(linked, len(text)), *inside[holder[1]]))
                if holder[0] == "h1":
                    headed.update(inside[holder[1]][1])
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if links:
                linked += len(text)

    ends: dict[str, dict[int, int]] = {}

    def closed(name: str, number: int, state: str, place: int) -> bool:
        if name not in ends:
            ends[name] = _ends(html, name)
        return place in ends[name]

    while m := _TOKEN.search(html, at):
        add(html[at:m.start()])
        at = _silent_end(html, m, ends) if m["silent"] else m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if name in BLOCK_TAGS:
                flush()
            if name == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name == "br":
            add("\n")
            continue
        if name in BLOCK_TAGS:
            flush()
            links = 0
            if name in CONTENT_TAGS:
                open_at = next((i for i in range(1, len(stack)) if stack[i][2] == "marked" and stack[i][0] in REPAIRED_TAGS and not (inherit and closed(*stack[i]))), None)
                if open_at is not None:
                    del stack[open_at:]
            if stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li":
                stack.pop()
            else:
                held = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BLOCK_TAGS), 0)
                if held and stack[held][0] == "p":
                    del stack[held:]
        if name in VOID_TAGS or m["attrs"].endswith("/") and not _SLASH_OF_VALUE.search(m["attrs"]) and not closed(name, 0, "", m.start()):
            continue
        number += 1
        within = stack[-1][2]
        role = _role(name, m["attrs"], within)
        if role == "marked" and number in wrappers:
            role = None
        if role == "marked" and name == "form" and _role("div", m["attrs"], within) is None:
            plain_forms.add(number)
        state = role or within
        if role == "body" and within == "marked":
            state = "marked" if inherit else "body"
        if role == "body":
            outside = outside or within != "marked"
        seen_body |= state == "body"
        body, marks = inside[stack[-1][1]]
        if role == "body" and state == "body":
            bodies[number] = name, body
            body = number
        # Only the outermost marks are kept: a wrapper is one of them, and deep nests stay small.
        inside[number] = body, (*marks, number) if role == "marked" and len(marks) < 4 else marks
        stack.append((name, number, state, m.start()))
        if name == "a":
            links += 1
    add(html[at:])
    flush()
    if seen_body:
        for b in out:
            if b.state == "plain":
                b.state = "outside"
    return Parsed(out, outside, bodies, plain_forms, headed)


def weak_label(block: Block) -> int | None:
    """What the markup alone says: content inside an article, boilerplate in marked elements or outside the page's article."""
    return {"body": CONTENT, "marked": BOILERPLATE, "outside": BOILERPLATE}.get(block.state)


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are content. ``gain[i]`` is how much cheaper content is than boilerplate for node i, below zero if dearer; an edge costs its
    weight if its ends differ. Content is what the source still reaches when the flow is largest.

    A node whose gain exceeds all its edges has its label in every cheapest labelling; it is fixed, and its edges become gains of its neighbours, until
    no such node is left. The rest goes through the flow, a connected part at a time."""
    n = len(gain)
    gain = list(gain)
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        room[a][b] = room[a].get(b, 0.0) + w
        room[b][a] = room[b].get(a, 0.0) + w
    tied = [sum(r.values()) for r in room]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(gain[i]) <= tied[i] + 1e-9:
            continue
        label[i] = gain[i] > 0
        for j, w in room[i].items():
            if label[j] is None:
                gain[j] += w if label[i] else -w
                tied[j] -= w
                del room[j][i]
                queue.append(j)
    for start in range(n):
        if label[start] is None:
            part, seen = [start], {start}
            for i in part:
                for j in room[i]:
                    if j not in seen and label[j] is None:
                        seen.add(j)
                        part.append(j)
            reached = _largest_flow(part, gain, room)
            for i in part:
                label[i] = i in reached
    return [bool(x) for x in label]


def _largest_flow(part: list[int], gain: list[float], room: list[dict[int, float]]) -> dict[int, int]:
    """Saturate the flow of one part by level graphs and blocking flows; returns what the source reaches at the end, with its level. The source's
    capacity is a positive gain, the sink's a negative one. ``room`` is used up."""
    supply, demand = {i: max(0.0, gain[i]) for i in part}, {i: max(0.0, -gain[i]) for i in part}
    while True:
        level = {i: 0 for i in part if supply[i] > 1e-9}
        sources, queue, open_end = list(level), deque(level), False
        while queue:
            i = queue.popleft()
            open_end = open_end or demand[i] > 1e-9
            for j, w in room[i].items():
                if w > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not open_end:
            return level
        arcs = {i: list(room[i]) for i in level}
        for s in sources:
            path = [s]
            while path and supply[s] > 1e-9:
                i = path[-1]
                if demand[i] > 1e-9:
                    flow = min(supply[s], demand[i], *(room[a][b] for a, b in zip(path, path[1:])))
                    supply[s] -= flow
                    demand[i] -= flow
                    for a, b in zip(path, path[1:]):
                        room[a][b] -= flow
                        room[b][a] += flow
                    path = [s]
                    continue
                while arcs[i] and not (room[i][arcs[i][-1]] > 1e-9 and level.get(arcs[i][-1]) == level[i] + 1):
                    arcs[i].pop()
                if arcs[i]:
                    path.append(arcs[i][-1])
                else:
                    path.pop()
                    if path:
                        arcs[path[-1]].pop()


def label_blocks(page: list[Block], weights: dict[str, float]) -> list[bool]:
    """Which blocks of a page are content."""
    bias = weights.get("", 0.0)
    gain = [bias + sum(weights.get(t, 0.0) for t in b.traits()) for b in page]
    # A block without any evidence leans to content: text is kept in doubt.
    gain = [g if abs(g) > 1e-6 else 1e-3 for g in gain]
    edges, last = [], {}
    for i, b in enumerate(page):
        if i:
            edges.append((i - 1, i, NEIGHBOUR if page[i - 1].parent == b.parent else APART))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    label = min_cut(gain, edges)
    # A page always has a main text if it has any text that nothing marks.
    return label if any(label) else [b.state == "plain" for b in page]


def _id_column(pages: DataFrame) -> F.Column:
    return F.col("page_id").cast("long").alias("page_id")


def train(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> dict[str, float]:
    """Weight of each trait: the log ratio of its share among content blocks and among boilerplate blocks, for blocks of at most
    ``training_pages`` pages whose markup tells. Empty without such blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            counts: dict[tuple[str, int], int] = {}
            for html in batch.column("html").to_pylist():
                for b in blocks(html or ""):
                    label = weak_label(b)
                    if label is not None:
                        for t in ("", *b.traits()):
                            counts[t, label] = counts.get((t, label), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["trait", "label", "n"])

    ids = pages.select(_id_column(pages)).filter("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(training_pages).distinct()
    sample = pages.select(_id_column(pages), "html").join(F.broadcast(ids), "page_id", "left_semi")  # at most training_pages ids
    rows = sample.select("html").mapInArrow(run, "trait string, label int, n long").groupBy("trait", "label").agg(F.sum("n").alias("n")).collect()
    n = {(r.trait, r.label): r.n for r in rows}
    good, bad = n.get(("", CONTENT), 0), n.get(("", BOILERPLATE), 0)
    if not good or not bad:
        return {}
    # Additive smoothing; the mix of labels itself is left out, as it says more about the markup than about a block.
    share = {t: math.log((n.get((t, CONTENT), 0) + 1) / (good + 2)) - math.log((n.get((t, BOILERPLATE), 0) + 1) / (bad + 2)) for t, _ in n if t}
    most = {t: LARGEST if t.startswith("state=") else LARGEST_LOOK for t in share}
    return {t: max(-most[t], min(most[t], w)) for t, w in share.items()}


#: Weights for pages of which none tells its article: the markup's own marks and the look of running text.
PLAIN_WEIGHTS = {"state=body": 6.0, "state=marked": -6.0, "state=outside": -4.0, "words=3": 2.0, "words=2": 1.0, "words=0": -0.5, "links=3": -3.0, "links=2": -1.0, "ends=True": 0.5, "tag=p": 1.0, "tag=li": -0.5}


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_blocks, n_content) for every row of ``pages`` (page_id, url, html).

    The text has the content blocks in page order, joined by one line feed; white space inside a block is one space and character
    references are decoded. A null or empty page has an empty text. Repeated rows come back as often as they came.
    """
    weights = PLAIN_WEIGHTS | (train(pages) if weights is None else weights)
    # Marks of the markup must outweigh all looks of a block, whatever the sample held.
    weights |= {"state=marked": min(weights["state=marked"], -LARGEST) * 2, "state=body": max(weights["state=body"], LARGEST) * 2}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts, total, kept = [], [], []
            for html in batch.column("html").to_pylist():
                page = blocks(html or "")
                label = label_blocks(page, weights)
                texts.append("\n".join(b.text for b, content in zip(page, label) if content))
                total.append(len(page))
                kept.append(sum(label))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(kept, pa.int64())],
                ["page_id", "url", "text", "n_blocks", "n_content"])

    return small_batches(pages).select(_id_column(pages), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_blocks long, n_content long")
