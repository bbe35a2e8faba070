"""Word lists and patterns that decide the results of the quality rules.

They are data. Every rule function accepts another list in their place. The regular
expressions use no look-around and no back references, so that Java and RE2 agree on them.
"""

# Scripts counted as non-Latin (first and last code point).
NON_LATIN_RANGES = [
    (0x0370, 0x03FF),
    (0x0530, 0x058F),
    (0x0900, 0x097F),
    (0x0980, 0x09FF),
    (0x0A00, 0x0A7F),
    (0x0A80, 0x0AFF),
    (0x0B00, 0x0B7F),
    (0x0B80, 0x0BFF),
    (0x0C00, 0x0C7F),
    (0x0C80, 0x0CFF),
    (0x0D00, 0x0D7F),
    (0x0E00, 0x0E7F),
    (0x0E80, 0x0EFF),
    (0x1000, 0x109F),
    (0x10A0, 0x10FF),
    (0x1100, 0x11FF),
    (0x3040, 0x309F),
    (0x30A0, 0x30FF),
    (0x4E00, 0x9FFF),
    (0xAC00, 0xD7AF),
    (0x0600, 0x06FF),
    (0x0750, 0x077F),
    (0xFB50, 0xFDFF),
    (0x0590, 0x05FF),
    (0x0400, 0x04FF),
    (0x0500, 0x052F),
]

# Domains whose articles are rejected, by kind.
BLOCKED_DOMAINS = {
    "pr_wire": [
        "globenewswire.com", "prnewswire.com", "businesswire.com", "accesswire.com",
        "einpresswire.com", "newswire.com", "prweb.com", "prmediaNow.com",
    ],
    "sports": [
        "espn.com", "espncricinfo.com", "bleacherreport.com", "skysports.com",
        "sportskeeda.com", "sportsbible.com", "cbssports.com", "foxsports.com",
        "nbcsports.com", "cricbuzz.com", "goal.com", "transfermarkt.com",
        "sportsstar.thehindu.com", "sports.ndtv.com",
    ],
    "entertainment": [
        "tmz.com", "eonline.com", "perezhilton.com", "buzzfeed.com", "koreaboo.com",
        "hollywoodreporter.com", "deadline.com", "variety.com", "ew.com", "people.com",
        "usmagazine.com", "popsugar.com", "bollywoodlife.com", "pinkvilla.com",
        "filmibeat.com", "desimartini.com",
    ],
    "tabloid": [
        "dailystar.co.uk", "thesun.co.uk", "dailymail.co.uk", "tmz.com", "okmagazine.com",
    ],
    "partisan": [
        "gellerreport.com", "breitbart.com", "infowars.com", "naturalnews.com",
        "zerohedge.com", "thegatewaypundit.com", "newsmax.com",
    ],
    "content_farm": [
        "dailypolitical.com", "watchlistnews.com", "baseballnewssource.com", "zolmax.com",
        "editorialge.com", "newsbreak.com", "msn.com",
    ],
    "lifestyle": [
        "foodnetwork.com", "allrecipes.com", "bonappetit.com", "travelandleisure.com",
        "lonelyplanet.com", "vogue.com", "cosmopolitan.com", "refinery29.com", "self.com",
        "byrdie.com",
    ],
    "market_research": [
        "marketsandmarkets.com", "mordorintelligence.com", "grandviewresearch.com",
        "fortunebusinessinsights.com", "verifiedmarketresearch.com",
        "researchandmarkets.com", "alliedmarketresearch.com",
        "databridgemarketresearch.com", "coherentmarketinsights.com",
        "precedenceresearch.com", "expertmarketresearch.com",
    ],
    "gambling": [
        "oddschecker.com", "betfair.com", "draftkings.com", "fanduel.com", "bet365.com",
    ],
}

# Domains that mark an article as Indian.
INDIA_DOMAINS = [
    "thehindu.com",
    "indianexpress.com",
    "hindustantimes.com",
    "timesofindia.indiatimes.com",
    "ndtv.com",
    "theprint.in",
    "scroll.in",
]
INDIA_COUNTRIES = ["IN", "india"]

# Url path patterns (case-insensitive).
URL_PATH_PATTERNS = [
    r"/sports?/",
    r"/cricket/",
    r"/football/",
    r"/soccer/",
    r"/tennis/",
    r"/nba/",
    r"/nfl/",
    r"/ipl/",
    r"/formula-?1/",
    r"/premier-league/",
    r"/entertainment/",
    r"/celebrity/",
    r"/gossip/",
    r"/movies?/",
    r"/tv-?shows?/",
    r"/bollywood/",
    r"/hollywood/",
    r"/music/",
    r"/lifestyle/",
    r"/fashion/",
    r"/beauty/",
    r"/food(?:-and-drink)?/",
    r"/recipes?/",
    r"/travel/",
    r"/shopping/",
    r"/wellness/",
    r"/fitness/",
    r"/style/",
    r"/dining/",
    r"/horoscope",
    r"/astrology",
    r"/puzzles?/",
    r"/crossword",
    r"/sudoku",
    r"/games?/",
    r"/obituar",
    r"/comics?/",
    r"/photo-?galler",
    r"/slideshows?/",
]

# Title patterns as (pattern, second pattern that must match or None,
# second pattern that must not match or None). Case-insensitive.
TITLE_PATTERNS = [
    (
        r"\b\d+\s*[-–—]\s*\d+\b",
        r"\b(?:win|won|beat|defeat|draw|wicket|goal|set|match|runs?|points?|score|innings|quarter|half-?time|over|boundary)\b",
        None,
    ),
    (
        r"\bvs\.?\s",
        None,
        r"\b(?:court|case|ruling|verdict|lawsuit|appeal|trial|plaintiff|defendant)\b",
    ),
    (r"\b(?:matchday|gameweek|round \d+|leg \d+|semi-?final|quarter-?final|group stage)\b", None, None),
    (r"^\d+\s+(?:best|worst|top|amazing|incredible|surprising|shocking|ways|things|reasons|tips|tricks|secrets|hacks|facts|signs|rules)\b", None, None),
    (r"\b(?:you won'?t believe|jaw.?dropping|mind.?blowing|will blow your mind|left speechless|internet is losing)\b", None, None),
    (r"\b(?:claps? back|slams?|destroys?|absolutely (?:destroyed|crushed)|epic fail|goes viral|breaks the internet|sparked? outrage|twitter reacts|social media (?:erupts|reacts))\b", None, None),
    (r"\?{2,}|!{3,}", None, None),
    (r"^(?:live|watch|stream)\s*(?:updates?|blog|score|stream|now|video|coverage)\b", None, None),
    (r"\b(?:horoscope|zodiac|sun sign|moon sign|daily forecast|weekly forecast)\b", None, None),
    (r"\b(?:wordle|connections|crossword|sudoku|quordle|nyt connections)\b.*\b(?:answer|hint|clue|solution|today)\b", None, None),
    (r"^(?:weather|forecast|temperature)\b.*\b(?:today|tonight|tomorrow|this week|weekend)\b", None, None),
    (
        r"\b(?:obituary|dies at age|passed away|rip )\b",
        None,
        r"\b(?:president|prime minister|ceo|founder|nobel|supreme court)\b",
    ),
    (r"\b(?:coupon|promo code|discount code|flash sale|deal of the day|price drop|save \d+%|buy now|order now|best deals?)\b", None, None),
    (r"^(?:review|hands-on|unboxing|first look)\s*:", None, None),
]

# Text patterns of templated content. Case-insensitive.
TEMPLATE_PATTERNS = [
    r"(?:global|worldwide)\s+.{3,50}\s+market\s+(?:size|share|growth|report|forecast|analysis|research|outlook|trends?)\b",
    r"market\s+(?:to reach|worth|valued at|expected to|projected to|estimated at)\s+\$?\s*[\d.]+\s*(?:billion|million|trillion|bn|mn)",
    r"\b(?:CAGR|compound annual growth)\s+(?:of\s+)?[\d.]+\s*%",
    r"^(?:press release|media release|for immediate release)\s*[:\-–]",
    r"\b(?:announces?|launched?|unveil|introduces?)\s+(?:new|latest|innovative|revolutionary|cutting.?edge|state.?of.?the.?art|next.?gen)\s+",
    r"^Short Interest in .+\(.+\)",
    r"^(?:analyst|broker)\s+.+\s+(?:price target|rating|upgrade|downgrade)",
    r"\b(?:penny stock|hot stock|stock pick|stock alert|buy alert)\b",
    r"^(?:today'?s|daily|weekly|morning|evening)\s+(?:brief|briefing|digest|roundup|round-up|wrap|recap|summary|newsletter)\b",
    r"^(?:what happened|what to know|what to watch|what's trending|trending now|top stories)\s+(?:today|this (?:week|morning|evening))\b",
    r"\b(?:betting odds|spread|over.?under|point spread|money.?line|parlay|handicap|odds comparison)\b",
    r"\b(?:fantasy (?:football|cricket|baseball|basketball|premier league)|dream ?11|fpl|fantasy lineup|captain pick)\b",
    r"\b(?:fans react|twitter reacts|internet reacts|netizens|went viral|breaking the internet|memes?\s+(?:flood|pour|go viral))\b",
]

# First words of boilerplate lines. Case-insensitive.
BOILERPLATE_PATTERNS = [
    r"^also read\b",
    r"^subscribe\b",
    r"^read more\b",
    r"^sign up\b",
    r"^download our app\b",
    r"^follow us\b",
    r"^click here\b",
    r"^share this\b",
    r"^related articles?\b",
    r"^©",
    r"^all rights reserved\b",
]

# Markers of fields the source withholds, and of id-like keywords.
GATED_MARKER = "ONLY AVAILABLE IN"
KEYWORD_NOISE = r"^(usn:|vguid:|2026:newsml|I/)"
KEYWORD_MAX_CHARS = 60

# Words that mark a byline block, for the text job and for display.
BYLINE_META = r"(ago$|hour|minute|published|updated|correspondent|reporter|editor|analyst|staff)"
BYLINE_BLOCKS = [
    r"^by\s+\w+",
    r"reporter|correspondent|editor|analyst|writer|staff writer",
    r"\d+\s+(hour|minute|day|week|month|year)s?\s+ago",
    r"\d{1,2}\s+(january|february|march|april|may|june|july|august|september|october|november|december)",
]
HEADING_MARK = "###HEADING:###"

# Texts of the classification request, in the order of its lines.
REQUEST_HEAD = ("Classify these ", " articles:\n\n")
REQUEST_LINES = {
    "title": "Title: ",
    "description": "Description: ",
    "content": "Content (excerpt): ",
    "source": "Source: ",
    "published": "Published: ",
}
UNKNOWN_VALUE = "unknown"
SIGNAL_FRAME = ("API Signals: { ", " }")
SIGNAL_LABELS = {
    "iptc": "IPTC Category: ",
    "entities": "Entities: ",
    "sentiment": "Sentiment: ",
    "relevance": "API Relevance Score: ",
    "authority": "Source Authority Rank: ",
    "keywords": "Keywords: ",
    "category": "API Category: ",
    "country": "Country: ",
}
SHORT_SNIPPET = ("Short API snippet only (", " chars) — apply Rule 13 before assigning Tier A")

# Headings of the chat context.
CONTEXT_CURRENT = 'CONTEXT — Current Article (what the user is reading): "'
CONTEXT_OTHER = ("CONTEXT — Timeline Article ", ': "')
CONTEXT_DATE = ('" (', ")\n")

# Names of a run's counters, in the order of the log.
RUN_COUNTERS = (
    "articles_fetched", "articles_filtered", "articles_deduped", "articles_classified", "articles_stored",
    "stories_matched", "stories_created", "articles_summarized", "brief_id",
)


def any_of(patterns: list[str]) -> str:
    """One case-insensitive alternation of several patterns."""
    return "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def blocked_domains() -> list[str]:
    """Lower-cased distinct domains of all kinds."""
    return sorted({d.lower() for group in BLOCKED_DOMAINS.values() for d in group})
