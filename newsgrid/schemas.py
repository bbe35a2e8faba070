"""Explicit schemas: the unified article record, the landed source pages, the state tables."""

from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


ENTITY = _struct(name=_S, type=_S, sentiment=_D)

ARTICLE = _struct(
    external_id=_S, source_api=_S, url=_S, title=_S, description=_S, content=_S, image_url=_S,
    author=_S, source_name=_S, source_domain=_S, published_at=_TS, fetched_at=_TS,
    api_category=_S, api_iptc_category=_S, api_sentiment=_D, api_language=_S, api_country=_S,
    api_keywords=T.ArrayType(_S), api_entities=T.ArrayType(ENTITY), api_source_priority=_L,
    api_relevance_score=_D, api_domain_rank=_L, api_performance=_D, api_social=_S,
    api_duplicate_flag=_B, title_hash=_S, normalized_url_hash=_S, domain_title_hash=_S,
)

# One landed page per source: a JSON object that holds a list of records.
WORLDNEWS_PAGE = _struct(
    news=T.ArrayType(_struct(
        id=_S, url=_S, title=_S, text=_S, summary=_S, image=_S, publishDate=_S, publish_date=_S,
        sentiment=_D, authors=T.ArrayType(_S), sourceCountry=_S, source_country=_S, category=_S,
        language=_S,
    ))
)
THENEWSAPI_PAGE = _struct(
    data=T.ArrayType(_struct(
        uuid=_S, url=_S, title=_S, description=_S, snippet=_S, keywords=_S, image_url=_S,
        language=_S, published_at=_S, source=_S, categories=T.ArrayType(_S), relevance_score=_D,
        locale=_S,
    ))
)
NEWSDATA_PAGE = _struct(
    results=T.ArrayType(_struct(
        article_id=_S, link=_S, title=_S, description=_S, content=_S, pubDate=_S, pubDateTZ=_S,
        image_url=_S, source_url=_S, source_name=_S, source_priority=_L, creator=T.ArrayType(_S),
        country=T.ArrayType(_S), category=T.ArrayType(_S), keywords=T.ArrayType(_S), language=_S,
        duplicate=_B,
    ))
)
WEBZIO_PAGE = _struct(
    posts=T.ArrayType(_struct(
        url=_S, title=_S, text=_S, published=_S, author=_S, language=_S, sentiment=_S,
        main_image=_S, categories=T.ArrayType(_S),
        entities=T.ArrayType(_struct(name=_S, type=_S, sentiment=_S)),
        thread=_struct(
            site=_S, site_full=_S, country=_S, main_image=_S, author=_S, domain_rank=_L,
            performance_score=_D,
            social=_S,  # any object, kept as its JSON text
        ),
    ))
)
PAGES = {
    "worldnews": WORLDNEWS_PAGE,
    "thenewsapi": THENEWSAPI_PAGE,
    "newsdata": NEWSDATA_PAGE,
    "webzio": WEBZIO_PAGE,
}

NEWSAPI_RECORD = _struct(
    url=_S, title=_S, description=_S, content=_S, publishedAt=_S, source_name=_S
)

REJECTION = _struct(
    url=_S, title=_S, source_api=_S, source_domain=_S, rejection_stage=_S, rejection_rule=_S,
    llm_tier=_S, llm_category=_S, llm_reason=_S, context_len=_L, created_at=_TS,
)

CLASSIFICATION = T.ArrayType(_struct(tier=_S, category=_S, reason=_S))
