"""Landed source pages (JSON) to the unified article record.

A page table has (page_id long, raw string); :func:`read_landed` makes one from a folder of
files. Everything after the scan is built-in expressions over an explicit schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config, schemas
from ..functions import scalars as S
from ..operators import filters, numbering
from ..session import cut

col = F.col
POSITIONS = 1_000_000  # room for the records of one page in a sequence number
SOURCE_ERROR = "source_api string, place string, error string"
STREAM_PAGES = 9_000_000_000_000  # page numbers that leave this room in a long
#: By default the JSON reader takes a page with one text over 20 million characters for a broken one.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file. Pages are numbered from 0 in the order of the first number in the file name, then of the
    whole path, so that every file has a number of its own. The paths are numbered from the file listing, range by range;
    no file is read for it."""
    return _files(spark, path).join(_numbered_files(spark, path), "path").select("page_id", "raw")


def _files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(path, raw): the text of every file."""
    return spark.read.options(**options).text(path, wholetext=True).select(col("_metadata.file_path").alias("path"), col("value").alias("raw"))


def _numbered_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_id) from the file listing."""
    listed = spark.read.format("binaryFile").load(path).select(col("_metadata.file_path").alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    number = F.regexp_replace(F.regexp_extract(name, r"(\d+)", 1), "^0+", "")
    return numbering.ordered_number(listed, [F.length(number), number, col("path")], "no").select("path", (col("no") - 1).alias("page_id"))


def read_tolerant(spark: SparkSession, source: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of a folder of files in which some may be truncated, unreadable, gone since they were listed, or not JSON
    with the source's list. Pages are those of :func:`read_landed`, with the same numbers, but for the files that cannot be read. Errors
    (source_api, place, error) has a row for each file that gives no records because of a fault; a folder that cannot be listed is one error.
    Files of no bytes are not listed by Spark: they have no number and are no error.

    A file that fails inside a task is left out by the scan, so what is missing against the listing are the files with faults. Both
    come from one stored reading: what the errors say is what the pages lack."""
    try:
        readable = _files(spark, path, ignoreCorruptFiles="true", ignoreMissingFiles="true")
        files = cut(_numbered_files(spark, path).join(readable, "path", "left"))
    except Exception as error:  # whatever keeps the folder from being read must not stop the other sources
        return spark.createDataFrame([], "page_id long, raw string"), _error_rows(spark, [(source, path, _reason(error))])
    schema = schemas.PAGES[source]
    found = F.from_json("raw", schema, ANY_LENGTH)[schema.fields[0].name]
    fault = F.when(col("raw").isNull(), F.lit("unreadable")).when(found.isNull(), F.lit("no list of records"))
    errors = files.select(F.lit(source).alias("source_api"), col("path").alias("place"), fault.alias("error")).filter("error IS NOT NULL")
    return files.filter("raw IS NOT NULL").select("page_id", "raw"), errors


def _reason(error: Exception) -> str:
    return (str(error).strip().splitlines() or [""])[0] or type(error).__name__


def _error_rows(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, SOURCE_ERROR)


def _parsed(pages: DataFrame, source: str) -> DataFrame:
    schema = schemas.PAGES[source]
    page = F.from_json("raw", schema, ANY_LENGTH)
    return pages.select("page_id", "raw", page[schema.fields[0].name].alias("found"))


def records(pages: DataFrame, source: str) -> DataFrame:
    """One row per record of the pages: ``r`` (struct) and ``seq`` (order of arrival). Pages without a readable
    list give no rows; :func:`corrupt_pages` returns them. A page with more records than a sequence number has
    room for is an error."""
    room = F.when(col("pos") < POSITIONS, col("pos")).otherwise(F.raise_error(F.lit("a page has too many records")).cast("int"))
    return _parsed(pages, source).select("page_id", F.posexplode("found").alias("pos", "r")).select(
        (col("page_id") * POSITIONS + room).alias("seq"), "r")


def corrupt_pages(pages: DataFrame, source: str) -> DataFrame:
    """(source_api, page_id, raw): pages whose text is not JSON with the source's list."""
    return _parsed(pages, source).filter("found IS NULL").select(F.lit(source).alias("source_api"), "page_id", "raw")


def _unified(df: DataFrame, source: str, as_of: Column, **fields: Column) -> DataFrame:
    """Fill the article schema from the given columns, nulls elsewhere, and add the hashes."""
    df = df.select("seq", *[c.alias(n) for n, c in fields.items()])
    df = df.filter(filters.has_required(col("url"), col("title")))
    known = set(fields) | {"source_api", "fetched_at"}
    columns = []
    for f in schemas.ARTICLE.fields:
        if f.name.endswith("_hash"):
            continue
        if f.name == "source_api":
            c = F.lit(source)
        elif f.name == "fetched_at":
            c = as_of
        elif f.name not in known and isinstance(f.dataType, T.ArrayType):
            c = F.array()
        else:
            c = col(f.name) if f.name in known else F.lit(None)
        columns.append(c.cast(f.dataType).alias(f.name))
    plain = df.select("seq", *columns)
    return plain.select(
        "*", S.title_hash(col("title")).alias("title_hash"), S.url_hash(col("url")).alias("normalized_url_hash"),
        S.domain_title_hash(col("source_domain"), col("title")).alias("domain_title_hash"),
    )


def _joined(values: Column, sep: str) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, sep))


def worldnews(pages: DataFrame, as_of: Column) -> DataFrame:
    r = records(pages, "worldnews")
    g = lambda n: col(f"r.{n}")
    text = S.strip_boilerplate(g("text"))
    domain = S.extract_domain(g("url"))
    published = F.coalesce(g("publishDate"), g("publish_date"))
    return _unified(
        r, "worldnews", as_of, external_id=g("id"), url=g("url"), title=g("title"), description=g("summary"),
        content=F.when(g("text") == "", g("text")).when(F.length(text) >= 20, text), image_url=g("image"),
        author=F.get(g("authors"), F.lit(0)), source_name=S.blank_to_null(domain), source_domain=domain,
        published_at=S.parse_utc(published, as_of), api_category=g("category"), api_sentiment=g("sentiment"),
        api_language=F.coalesce(g("language"), F.lit("en")),
        api_country=F.lower(F.coalesce(g("sourceCountry"), g("source_country"))),
    )


def thenewsapi_records(pages: DataFrame) -> DataFrame:
    return records(pages, "thenewsapi")


def thenewsapi(pages: DataFrame, as_of: Column) -> DataFrame:
    r = thenewsapi_records(pages).filter(~filters.low_relevance(col("r.relevance_score")))
    g = lambda n: col(f"r.{n}")
    domain = F.coalesce(S.blank_to_null(g("source")), S.extract_domain(g("url")))
    categories = _joined(g("categories"), ", ")
    return _unified(
        r, "thenewsapi", as_of, external_id=g("uuid"), url=g("url"), title=g("title"),
        content=S.blank_to_null(S.trim_ws(g("description"))), image_url=g("image_url"),
        source_name=S.blank_to_null(domain), source_domain=domain, published_at=S.parse_iso(g("published_at"), as_of),
        api_category=categories, api_iptc_category=categories, api_language=g("language"),
        api_country=F.lower(g("locale")), api_keywords=S.split_keywords(g("keywords")),
        api_relevance_score=g("relevance_score"),
    )


def newsdata(pages: DataFrame, as_of: Column) -> DataFrame:
    r = records(pages, "newsdata").filter(~filters.low_authority(col("r.source_priority")))
    g = lambda n: col(f"r.{n}")
    domain = F.coalesce(S.host(g("source_url")), S.extract_domain(g("link")))
    rows = _unified(
        r, "newsdata", as_of, external_id=g("article_id"), url=g("link"), title=g("title"),
        content=S.gated_to_null(g("description")), image_url=S.gated_to_null(g("image_url")),
        author=F.get(g("creator"), F.lit(0)),
        source_name=F.coalesce(S.blank_to_null(g("source_name")), S.blank_to_null(domain)), source_domain=domain,
        published_at=S.parse_zoned(g("pubDate"), g("pubDateTZ"), as_of), api_category=_joined(g("category"), ", "),
        api_language=F.coalesce(g("language"), F.lit("en")), api_country=F.lower(_joined(g("country"), ",")),
        api_keywords=S.clean_keywords(g("keywords")), api_source_priority=g("source_priority"),
        api_duplicate_flag=g("duplicate"),
    )
    return rows.filter(filters.newsdata_guard(col("published_at"), col("content"), as_of))


def webzio(pages: DataFrame, as_of: Column) -> DataFrame:
    r = records(pages, "webzio")
    g = lambda n: col(f"r.{n}")
    url = F.coalesce(g("url"), g("thread.site_full"))
    domain = F.coalesce(g("thread.site"), S.extract_domain(url))
    categories = _joined(g("categories"), ", ")
    return _unified(
        r, "webzio", as_of, url=url, title=g("title"), description=S.blank_to_null(g("text")),
        image_url=F.coalesce(g("main_image"), g("thread.main_image")),
        author=F.coalesce(g("author"), g("thread.author")), source_name=S.blank_to_null(domain), source_domain=domain,
        published_at=F.try_to_timestamp(g("published")), api_category=categories, api_iptc_category=categories,
        api_sentiment=S.sentiment_value(g("sentiment")), api_language=g("language"), api_country=g("thread.country"),
        api_keywords=F.coalesce(g("categories"), F.array().cast("array<string>")),
        api_entities=S.flatten_entities(g("entities")), api_domain_rank=g("thread.domain_rank"),
        api_performance=g("thread.performance_score"), api_social=g("thread.social"),
    )


NORMALISERS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "worldnews": worldnews,
    "webzio": webzio,
    "thenewsapi": thenewsapi,
    "newsdata": newsdata,
}


def first_per_url(articles: DataFrame) -> DataFrame:
    """Within a source: the first record of each normalised url."""
    marked = numbering.mark_first(
        articles.withColumn("_row", F.concat_ws(":", "source_api", "seq")),
        ["source_api", "normalized_url_hash"], ["seq"], "_row", "first_of_url", store=True)
    return marked.drop("_row")


def concat_sources(by_source: dict[str, DataFrame], order: tuple[str, ...] = config.SOURCES, store: bool = True) -> DataFrame:
    """All sources in their fixed priority order with a dense ``batch_seq``; the order decides
    which copy of an article survives. The rows are read twice, so they are stored first unless they already are."""
    parts = [by_source[s].withColumn("source_rank", F.lit(i)) for i, s in enumerate(order) if s in by_source]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return numbering.dense_number(every, "seq", "batch_seq", ["source_rank"], width=100 * POSITIONS, store=store)


def tolerant(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]], schema: T.StructType) -> dict[str, DataFrame]:
    """Call each loader; a source that fails contributes no rows."""
    out = {}
    for name, load in loaders.items():
        try:
            frame = load()
            frame.schema  # noqa: B018 - analysis errors surface here
        except Exception as error:  # any failing source must not stop the others
            print(f"source {name} failed: {error}")
            frame = spark.createDataFrame([], schema)
        out[name] = frame
    return out


def isolated(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]], schema: T.StructType) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows by source, errors): each loader is run to the end and stored on its own, so a source that fails while its rows are
    read stops no other. It contributes no rows, not some of them, and one row of errors (source_api, place null, error)."""
    out, errors = {}, []
    for name, load in loaders.items():
        try:
            out[name] = cut(load())
        except Exception as error:  # any failing source must not stop the others
            errors.append((name, None, _reason(error)))
            out[name] = spark.createDataFrame([], schema)
    return out, _error_rows(spark, errors)


def fetch_stats(pages: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Per source: raw records, normalised rows, duplicate urls, rejected by score or priority, corrupt pages.

    Pages are counted while they are parsed, and rows by url hash, so nothing but hashes and counts is shuffled and nothing is stored."""
    parts = []
    for name, frame in pages.items():
        gate = (
            (lambda r: filters.low_relevance(r["relevance_score"])) if name == "thenewsapi"
            else (lambda r: filters.low_authority(r["source_priority"])) if name == "newsdata" else (lambda r: F.lit(False))
        )
        found = col("found")
        parts.append(_parsed(frame, name).select(
            F.lit(name).alias("source_api"), F.greatest(F.size(found), F.lit(0)).cast("long").alias("raw"),
            F.greatest(F.size(F.filter(found, gate)), F.lit(0)).cast("long").alias("rejected"), found.isNull().cast("long").alias("corrupt"),
            F.lit(0).cast("long").alias("urls"), F.lit(0).cast("long").alias("rows")))
        urls = NORMALISERS[name](frame, as_of).groupBy("source_api", "normalized_url_hash").agg(F.count(F.lit(1)).alias("rows"))
        none = [F.lit(0).cast("long").alias(n) for n in ("raw", "rejected", "corrupt")]
        parts.append(urls.select("source_api", *none, F.lit(1).cast("long").alias("urls"), "rows"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("source_api").agg(
        F.sum("raw").alias("raw_count"), F.sum("urls").alias("normalized_count"), (F.sum("rows") - F.sum("urls")).alias("duplicate_urls"),
        F.sum("rejected").alias("rejected_count"), F.sum("corrupt").alias("corrupt_pages")).filter("raw_count > 0 OR corrupt_pages > 0")
