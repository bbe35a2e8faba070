"""Article text from web pages, byline removal, display blocks, enrichment decision."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config, rules
from ..functions import scalars as S

col = F.col
#: Pages are parsed in slices of about this many bytes, so a task's objects follow its longest page, not its batch.
SLICE_BYTES = 2 << 20
_BLOCKS = {"h2", "h3", "h4", "h5", "h6", "p", "blockquote"}
_CONTAINERS = {"article", "main"}
_HIDDEN = {"script", "style", "noscript", "template"}
_ASIDE = {"nav", "footer", "aside"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Blocks(HTMLParser):
    """Collects (container, tag, text) of block elements. An element that is not closed ends with its parent, and
    navigation also where a container opens. Container 0 is the page itself."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, list[str]]] = []
        self.stack: list[tuple[str, int, list[str] | None]] = [("", 0, None)]
        self.containers = 0
        self.byline: list[str] = []
        self.in_byline = ""

    def _silent(self) -> bool:
        return any(tag in _HIDDEN or tag in _ASIDE for tag, _, _ in self.stack)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        container = self.stack[-1][1]
        if tag in _CONTAINERS:
            aside = next((i for i, s in enumerate(self.stack) if s[0] in _ASIDE), None)
            if aside is not None:
                del self.stack[aside:]
            self.containers += 1
            container = self.containers
        if tag == "p":  # a new paragraph ends the last, with what is still open in it
            paragraph = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == "p"), None)
            if paragraph is not None:
                del self.stack[paragraph:]
        text: list[str] | None = None
        if tag in _BLOCKS and not self._silent():
            text = []
            self.found.append((container, tag, text))
        self.stack.append((tag, container, text))
        marks = dict(attrs)
        if marks.get("rel") == "author" or "byline" in (marks.get("class") or "") or "author" in (marks.get("itemprop") or ""):
            self.in_byline = self.in_byline or tag

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == tag), None)
        if at is not None:
            del self.stack[at:]
        if tag == self.in_byline:
            self.in_byline = ""

    def handle_data(self, data: str) -> None:
        if self._silent():
            return
        for _, _, text in self.stack:
            if text is not None:
                text.append(data)
        if self.in_byline:
            self.byline.append(data)


def _page_blocks(html: str | None) -> tuple[str, list[tuple[str, str]]]:
    """Byline and blocks of the article or main element with most text, else of the page."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    size: dict[int, int] = {}
    for container, _, text in parser.found:
        size[container] = size.get(container, 0) + sum(map(len, text))
    named = [c for c in size if c]
    best = max(named, key=lambda c: (size[c], -c)) if named else 0
    blocks = [(tag, "".join(text).strip()) for container, tag, text in parser.found if container == best]
    return " ".join("".join(parser.byline).split()), [(t, x) for t, x in blocks if x]


def _slices(batch: pa.RecordBatch, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each slice holds about ``limit`` bytes of html, one page at least."""
    size = pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(size) - size) // (limit or SLICE_BYTES), prepend=-1)).tolist()
    for begin, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(begin, end - begin)


def _pages_with_blocks(pages: DataFrame, id_col: str) -> DataFrame:
    """(page_id, byline, blocks): one row per page, the blocks as an array of text in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                parsed = [_page_blocks(html.as_py()) for html in part.column("html")]
                yield pa.RecordBatch.from_arrays([
                    part.column(id_col), pa.array([byline for byline, _ in parsed], pa.string()),
                    pa.array([[t for t, _ in blocks] for _, blocks in parsed], pa.list_(pa.string())),
                    pa.array([[x for _, x in blocks] for _, blocks in parsed], pa.list_(pa.string()))], [id_col, "byline", "tags", "texts"])

    raw = pages.select(id_col, "html").mapInArrow(run, f"{id_col} long, byline string, tags array<string>, texts array<string>")
    marked = F.zip_with("tags", "texts", lambda tag, text: F.struct(
        tag.alias("tag"), F.concat(F.when(tag.startswith("h"), rules.HEADING_MARK).otherwise(""), S.repair_text(text)).alias("block")))
    return raw.select(id_col, "byline", marked.alias("blocks"))


def page_blocks(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, byline, pos, tag, block): h2-h6, p and blockquote in document order."""
    rows = _pages_with_blocks(pages, id_col).select(id_col, "byline", F.posexplode("blocks").alias("pos", "b"))
    return rows.select(id_col, "byline", col("pos").cast("long").alias("pos"), "b.tag", "b.block")


def page_texts(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, byline, text, status): blocks joined by blank lines, leading bylines removed,
    text below 50 characters dropped. One scan, no shuffle."""
    joined = _pages_with_blocks(pages, id_col).select(id_col, "byline", F.array_join("blocks.block", "\n\n").alias("text"))
    clean = strip_bylines(joined, "text", "byline")
    text = F.when(F.length("text") >= 50, col("text"))
    return clean.select(id_col, "byline", text.alias("text"), S.scrape_class(text).alias("status"))


def strip_bylines(df: DataFrame, text: str, byline: str, most: int = 3) -> DataFrame:
    """Remove up to ``most`` blocks that repeat the byline or, after one of these, carry its metadata; undone
    when more than 60 % of the text would go."""
    name = F.lower(S.trim_ws(F.coalesce(col(byline), F.lit(""))))
    start = F.struct(F.lit(0).alias("gone"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, block: Column) -> Column:
        bare = S.trim_ws(block)
        low = F.lower(bare)
        mostly_name = (F.length(name) > 0.5 * F.length(bare)) | (F.length(bare) < F.length(name) + 40)
        part_of_name = (F.length(bare) < F.length(name)) & F.contains(name, low)
        metadata = (state["gone"] > 0) & (F.length(bare) < 80) & ~bare.endswith(".") & bare.rlike("(?i)" + rules.BYLINE_META)
        drop = (state["gone"] < most) & (F.when(F.contains(low, name), mostly_name).otherwise(part_of_name) | metadata)
        kept = F.when(drop | (bare == ""), state["kept"]).otherwise(F.array_append(state["kept"], block))
        return F.struct((state["gone"] + F.when((bare != "") & drop, 1).otherwise(0)).alias("gone"), kept.alias("kept"))

    shorter = F.array_join(F.aggregate(F.split(text, "\n\n", -1), start, step, lambda s: s["kept"]), "\n\n")
    stripped = F.when(F.length(shorter) < 0.4 * F.length(text), col(text)).otherwise(shorter)
    return df.withColumn(text, F.when((F.length(name) < 2) | F.coalesce(col(text) == "", F.lit(True)), col(text)).otherwise(stripped))


# ---- display ----------------------------------------------------------------------------

def is_byline_block(block: Column, source: Column) -> Column:
    bare = S.trim_ws(block)
    hit = bare.rlike(rules.any_of(rules.BYLINE_BLOCKS))
    named = F.coalesce((source != "") & F.contains(F.lower(bare), F.lower(source)), F.lit(False))
    return (bare != "") & (F.length(bare) <= 150) & (hit | named)


def display_blocks(df: DataFrame, id_col: str, text: str, source: str, limit: int = 4) -> DataFrame:
    """(id, pos, kind, block): paragraphs and headings for display, without the first
    ``limit`` byline-like blocks. One pass over each text, no shuffle."""
    start = F.struct(F.lit(0).alias("seen"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, block: Column) -> Column:
        seen = state["seen"] + is_byline_block(block, col("_source")).cast("int")
        skip = (S.trim_ws(block) == "") | ((seen > state["seen"]) & (seen <= limit))
        return F.struct(seen.alias("seen"), F.when(skip, state["kept"]).otherwise(F.array_append(state["kept"], block)).alias("kept"))

    blocks = df.select(id_col, col(source).alias("_source"), F.split(text, r"\n\n+", -1).alias("_all"))
    kept = blocks.select(id_col, F.posexplode(F.aggregate("_all", start, step, lambda s: s["kept"])).alias("pos", "block"))
    return kept.select(id_col, col("pos").cast("long").alias("pos"), block_kind(col("block")).alias("kind"), block_text(col("block")).alias("block"))


def block_kind(block: Column) -> Column:
    return F.when(S.trim_ws(block).startswith(rules.HEADING_MARK), "heading").otherwise("paragraph")


def block_text(block: Column) -> Column:
    bare = S.trim_ws(block)
    n = len(rules.HEADING_MARK)
    return F.when(bare.startswith(rules.HEADING_MARK), S.trim_ws(F.substring(bare, F.lit(n + 1), F.length(bare)))).otherwise(bare)


# ---- enrichment -------------------------------------------------------------------------

def lookup_text(articles: DataFrame, candidates: DataFrame, similarity: float = config.TITLE_LOOKUP_SIMILARITY,
                minimum: int = config.THIN_CHARS) -> DataFrame:
    """(id, lookup_text): text of the first candidate (article_id, pos, title, text) with a
    similar title and enough text. Articles of the source itself are not looked up."""
    pairs = candidates.select(col("article_id").alias("id"), "pos", col("title").alias("c_title"), col("text").alias("c_text")).join(
        articles.filter(~col("source_api").eqNullSafe("worldnews")).select("id", "title"), "id")
    good = pairs.filter((F.length("c_text") >= minimum) & (S.trigram_similarity(col("c_title"), col("title")) > similarity))
    return good.groupBy("id").agg(F.min_by("c_text", "pos").alias("lookup_text"))


def enrich(articles: DataFrame, scraped: DataFrame, lookups: DataFrame, minimum: int = config.THIN_CHARS) -> DataFrame:
    """Articles with the decided ``full_text`` and ``scrape_status``. ``scraped`` is (id,
    scraped_text, scraped_status); a missing scrape counts as failed."""
    rows = articles.join(scraped, "id", "left").join(lookups, "id", "left")
    status = F.coalesce("scraped_status", F.lit("failed"))
    own = (col("source_api") == "worldnews") & (F.length("content") >= minimum)
    own = F.coalesce(own, F.lit(False))
    looked = status.isin("failed", "thin") & F.coalesce(F.length("lookup_text") >= minimum, F.lit(False))
    return rows.withColumns({
        "full_text": F.when(own, col("content")).when(looked, col("lookup_text"))
        .when(status.isin("full", "thin"), col("scraped_text")).otherwise(col("full_text")),
        "scrape_status": F.when(own, "lookup").when(looked, "lookup").otherwise(status),
    }).drop("scraped_text", "scraped_status", "lookup_text")
