"""Thresholds used by the operators. Every function takes them as default arguments."""

STALENESS_HOURS = 30
TITLE_MIN_CHARS = 15
UPPERCASE_SHARE = 0.85
NON_LATIN_SHARE = 0.30
NON_LATIN_MIN_CHARS = 10
TEXT_MIN_BY_SOURCE = {"worldnews": 80, "newsdata": 200, "webzio": 60, "thenewsapi": 50}
RELEVANCE_MIN = 25.0
SOURCE_PRIORITY_MAX = 10000
NEWSDATA_TEXT_FLOOR = 200

TITLE_DUP_SIMILARITY = 0.7
TITLE_LOOKUP_SIMILARITY = 0.75
DEDUP_LOOKBACK_DAYS = 7

STORY_MATCH_SCORE = 0.75
STORY_LINK_SIMILARITY = 0.80
STORY_ANCHOR_SIMILARITY = 0.70
STORY_WINDOW_DAYS = 14
RECENT_VECTORS = 10
MATCH_EMBEDDING_WEIGHT = 0.65
MATCH_KEYWORD_WEIGHT = 0.35
MATCH_KEYWORDS = 8

TIMELINE_DAYS = 14
TIMELINE_DUP_SIMILARITY = 0.85
TIMELINE_PER_DAY = 2
TIMELINE_CANDIDATES_PER_DAY = 4

BRIEF_SLOTS = 14
BRIEF_PER_CATEGORY = 4
BRIEF_PER_REGION = 8
FEED_HOURS = 48
FEED_LIMIT = 30
FEED_LIMIT_MAX = 50

COOLDOWN_HOURS = 48
COOLDOWN_FAILURES = 5
THIN_CHARS = 200

CLASSIFY_BATCH = 5
EMBED_BATCH = 100
ENRICH_BATCH = 5
EMBED_CHARS = 2000
SUMMARY_BATCH = 100  # summaries of a story in one request
CHAT_CURRENT_CHARS = 2500
CHAT_SHARED_CHARS = 3500
CHAT_HISTORY = 10

PRIORITY_SCALE = 15000
RETENTION_DAYS = 30

SOURCES = ("worldnews", "webzio", "thenewsapi", "newsdata")  # priority order of a batch
TIERS = ("A", "B", "C", "D")
ACCEPTED_TIERS = ("A", "B")
CATEGORIES = ("economics", "policy", "science", "accountability", "business", "none")
FEED_CATEGORIES = ("economics", "policy", "science", "accountability", "business")
# Weights of categories and tiers.
CATEGORY_WEIGHT = {
    "economics": 1.0,
    "policy": 1.0,
    "science": 0.8,
    "accountability": 0.8,
    "business": 0.6,
    "none": 0.2,
}
CATEGORY_WEIGHT_DEFAULT = 0.5
TIER_BONUS = {"A": 0.15, "B": 0.0}
