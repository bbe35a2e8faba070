"""SQL snippets of the checking engine for the scalar functions."""

from .. import rules
from .views import AS_OF_SQL

AS_OF = AS_OF_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def host(x: str) -> str:
    return rf"regexp_replace(lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '')"


def is_url(x: str) -> str:
    return rf"regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:\s]+[^\s]*$')"


def norm_url(x: str) -> str:
    return (
        rf"CASE WHEN {is_url(x)} THEN 'https://' || {host(x)} || "
        rf"regexp_replace(regexp_extract({x}, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') ELSE lower({x}) END"
    )


def norm_title(x: str) -> str:
    return rf"regexp_replace(regexp_replace({trim(f'lower({x})')}, '\s+', ' ', 'g'), '[^a-z0-9\s]', '', 'g')"


def url_hash(x: str) -> str:
    return f"sha256({norm_url(x)})"


def title_hash(x: str) -> str:
    return f"sha256({norm_title(x)})"


def domain_title_hash(d: str, t: str) -> str:
    return f"sha256(lower({d}) || ':' || substr({norm_title(t)}, 1, 50))"


def hashes(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return (
        f"{title_hash(p + 'title')} AS title_hash, {url_hash(p + 'url')} AS normalized_url_hash, "
        f"{domain_title_hash(p + 'source_domain', p + 'title')} AS domain_title_hash"
    )


def grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - 1, 1)), lambda i: substr(lower({x}), i, 3)))"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"({inter})::DOUBLE / nullif(len({a}) + len({b}) - {inter}, 0)"


def r(x: str) -> str:
    return f"round({x}, 9) + 0.0"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


def bullet_list(x: str) -> str:
    lines = f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda l: {trim('l')}), lambda l: l <> '')"
    return rf"list_filter(list_transform({lines}, lambda l: regexp_replace(l, '^[•\-*]\s*', '')), lambda l: l <> '')"


def bullets(x: str) -> str:
    """Bullet list joined by a bar."""
    return f"array_to_string({bullet_list(x)}, '|')"


def time_ago(x: str, now: str = AS_OF) -> str:
    m = f"CAST(floor((epoch_us({now}) - epoch_us({x})) / 60000000.0) AS BIGINT)"
    return (
        f"CASE WHEN {x} IS NULL THEN '' WHEN {m} < 1 THEN 'Just now' WHEN {m} < 60 THEN {m} || 'm ago' "
        f"WHEN {m} // 60 < 24 THEN ({m} // 60) || 'h ago' ELSE ({m} // 60 // 24) || 'd ago' END"
    )


def any_match(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({x}, {q(rules.any_of(patterns))})"


def boilerplate(x: str) -> str:
    keep = f"({trim('l')} = '' OR NOT {any_match(trim('l'), rules.BOILERPLATE_PATTERNS)})"
    joined = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: {keep}), chr(10))"
    return trim(rf"regexp_replace({joined}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def source_quality(p: str, floor_at: int, clamp: bool = False) -> str:
    body = f"1 - log10({p}) / log10(15000)"
    if clamp:
        body = f"greatest(0.0, {body})"
    return f"CASE WHEN {p} <= {floor_at} THEN 1.0::DOUBLE ELSE {body} END"


def category_weight(c: str) -> str:
    return (
        f"CASE coalesce({c}, 'none') WHEN 'economics' THEN 1.0::DOUBLE WHEN 'policy' THEN 1.0::DOUBLE WHEN 'science' THEN 0.8::DOUBLE "
        f"WHEN 'accountability' THEN 0.8::DOUBLE WHEN 'business' THEN 0.6::DOUBLE WHEN 'none' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END"
    )


def hours(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 3600000000.0::DOUBLE)"


def hours_step(x: str) -> str:
    return f"CASE WHEN {x} < 2 THEN 0.5::DOUBLE WHEN {x} < 8 THEN 1.0::DOUBLE WHEN {x} < 16 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END"


def context_len(p: str = "") -> str:
    return f"(coalesce(length({p}description), 0) + coalesce(length({p}content), 0))::BIGINT"


def foreign_script() -> str:
    text = "(coalesce(title, '') || ' ' || coalesce(description, ''))"
    letters = rf"regexp_replace({text}, '[\s\d\p{{P}}\p{{S}}]', '', 'g')"
    ranges = "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in rules.NON_LATIN_RANGES)
    foreign = f"(length({letters}) - length(regexp_replace({letters}, '[{ranges}]', '', 'g')))"
    return f"(length({letters}) >= 10 AND coalesce({foreign}::DOUBLE / nullif(length({letters}), 0) > 0.30, false))"


def foreign_language() -> str:
    return "coalesce(lower(api_language) NOT IN ('en', 'english'), false)"


def stale() -> str:
    return f"(published_at < {AS_OF} - INTERVAL 30 HOUR)"


def content_min() -> str:
    letters = "regexp_replace(title, '[^a-zA-Z]', '', 'g')"
    upper = "regexp_replace(title, '[^A-Z]', '', 'g')"
    floor = "CASE source_api WHEN 'worldnews' THEN 80 WHEN 'newsdata' THEN 200 WHEN 'webzio' THEN 60 WHEN 'thenewsapi' THEN 50 ELSE 0 END"
    return (
        f"(title IS NULL OR length(title) < 15 OR coalesce(length({upper})::DOUBLE / nullif(length({letters}), 0) > 0.85, false)"
        f" OR coalesce(length(coalesce(content, description)) < {floor}, false))"
    )


def blocked() -> str:
    return "coalesce(source_domain IN (" + ", ".join(q(d) for d in rules.blocked_domains()) + "), false)"


def bad_path() -> str:
    return any_match("url", rules.URL_PATH_PATTERNS)


def bad_title() -> str:
    tests = []
    for p, also, unless in rules.TITLE_PATTERNS:
        test = f"regexp_matches(title, {q('(?i)' + p)})"
        if also:
            test += f" AND regexp_matches(title, {q('(?i)' + also)})"
        if unless:
            test += f" AND NOT regexp_matches(title, {q('(?i)' + unless)})"
        tests.append(f"({test})")
    return "coalesce(" + " OR ".join(tests) + ", false)"


def templated() -> str:
    return f"coalesce({any_match('coalesce(content, description)', rules.TEMPLATE_PATTERNS)}, false)"


def rule() -> str:
    return (
        f"CASE WHEN {foreign_language()} THEN 'language' WHEN {foreign_script()} THEN 'language' WHEN {stale()} THEN 'staleness' "
        f"WHEN {content_min()} THEN 'content_min' WHEN {blocked()} THEN 'domain_blocklist' WHEN {bad_path()} THEN 'url_path' "
        f"WHEN {bad_title()} THEN 'title_pattern' WHEN {templated()} THEN 'template' END"
    )


def india(country: str, domain: str) -> str:
    hit = " OR ".join(f"contains(coalesce({domain}, ''), {q(d)})" for d in rules.INDIA_DOMAINS)
    return f"(coalesce({country} IN ('IN', 'india'), false) OR {hit})"
