"""Duplicate removal: source flag, batch url, exact match with stored rows, fuzzy titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..session import cut, drop_cut
from . import keyfilter, numbering, titlegrid

col = F.col
FRONT = 4
SALTS = 32
SPLIT_ROWS = 2000
#: Trigrams of a key at most, and rows that share a key before it gets another trigram.
SIGNATURE_DEPTH = 3
GROUP_LIMIT = 64
#: Keys of two trigrams a row on average above which rows meet in a grid instead.
KEYS_PER_ROW = 64
HASH_KEY = ["kind", "hash"]


# ---- exact layers -----------------------------------------------------------------------

def hash_pairs(df: DataFrame, *keep: str) -> DataFrame:
    """One row per (kind, hash) so that "any of three hashes equal" becomes one equi join."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("kind"), col(c).alias("hash"))
        for i, c in enumerate(["normalized_url_hash", "domain_title_hash", "title_hash"])
    ])
    return df.select(*keep, F.inline(pairs)).filter(col("hash").isNotNull())


def stored_matches(batch: DataFrame, stored: DataFrame, as_of: Column, row_id: str,
                   days: int = config.DEDUP_LOOKBACK_DAYS, filters: DataFrame | None = None) -> DataFrame:
    """Ids of batch rows that equal a recent stored row in url, domain+title or title.

    ``filters`` (:func:`hash_filters` of all stored rows) leaves only those hashes of the batch that may be stored. The history then meets these few,
    which Spark broadcasts if they are small enough, and only what equals one of them is shuffled."""
    since = as_of - F.expr(f"INTERVAL {days} DAYS")
    pairs = hash_pairs(batch, row_id)
    if filters is not None:
        pairs = cut(keyfilter.suspects(pairs, filters.filter(col("day") >= F.to_date(since)), HASH_KEY))
    recent = stored.filter(col("published_at") > since)
    known = stored_suspects(recent, pairs) if filters is not None else hash_pairs(recent).distinct()
    return pairs.join(known, HASH_KEY, "left_semi").select(row_id).distinct()


def stored_suspects(recent: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, hash) of the stored rows that are among ``pairs``."""
    return hash_pairs(recent).join(pairs.select(*HASH_KEY).distinct(), HASH_KEY, "left_semi").distinct()


def hash_filters(filters: DataFrame, articles: DataFrame) -> DataFrame:
    """Filters of the published days that ``articles`` touches, with the articles' hashes added."""
    return keyfilter.added(filters, hash_pairs(articles.withColumn("day", F.to_date("published_at")), "day"), HASH_KEY)


def mark_batch_url(df: DataFrame, row_id: str = "batch_seq") -> DataFrame:
    """``first_of_url``: the first row of the batch with this normalised url."""
    return numbering.mark_first(df, ["normalized_url_hash"], [], row_id, "first_of_url")


# ---- fuzzy titles -----------------------------------------------------------------------

def prefix_tokens(rows: DataFrame, threshold: float, shared: int = SIGNATURE_DEPTH) -> DataFrame:
    """Rare-first prefixes of trigram sets: (rid, n, prefix).

    Two sets with Jaccard above ``threshold`` share at least ``shared`` tokens among the first
    n - ceil(threshold * n) + shared tokens of each, in any one global order, if that many must be common at all. Rare tokens first
    keeps the groups that share a token small."""
    tokens = rows.select("rid", F.explode("grams").alias("token"))
    # Counts are copied to a fixed number of salts, so that the rows of a frequent trigram do not meet to learn its count.
    salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")
    freq = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ordered = (  # the copies are more than their size on disk tells, so they must not be broadcast
        tokens.withColumn("salt", salt).join(freq.hint("merge"), ["token", "salt"])
        .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("t"))
    )
    n = F.size("t")
    length = F.least(n, (n - _at_least(n, threshold) + shared).cast("int"))
    return ordered.select("rid", n.alias("n"), F.slice(col("t.token"), F.lit(1), length).alias("prefix"))


def signatures(rows: DataFrame, threshold: float, depth: int = SIGNATURE_DEPTH, limit: int = GROUP_LIMIT, prefixes: DataFrame | None = None) -> DataFrame:
    """(rid, n, token): keys of which any two sets with Jaccard above ``threshold`` share one.

    A key is one rare trigram as long as few rows have it; the rows of a larger group are told apart by the next trigram of their
    prefixes, down to ``depth`` trigrams. Two similar sets share their ``depth`` first common trigrams in that order, so they meet on the way
    down, at the latest in the last group. So the rows a row meets do not grow with the number of unrelated rows. Sets so small that fewer
    trigrams need be common have keys of one trigram of their own, which never meet the others."""
    few = int(depth / threshold)  # with more trigrams than this, at least depth of them are common
    pre = cut(prefix_tokens(rows, threshold, depth)) if prefixes is None else prefixes
    place = F.posexplode("prefix").alias("pos", "gram")
    short = pre.filter(col("n") <= few).select("rid", "n", F.explode("prefix").alias("gram")).select("rid", "n", F.xxhash64(F.lit("short"), "gram").alias("token"))
    keys = pre.filter(_at_least(col("n"), threshold) >= depth).select("rid", "n", "prefix", place).select("rid", "n", "prefix", "pos", F.xxhash64("gram").alias("token"))
    out = [short]
    for level in range(depth):
        if level == depth - 1:
            out.append(keys.select("rid", "n", "token"))
            break
        keys = cut(keys)
        crowded = keys.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter(col("size") > limit)
        marks = cut(crowded.select("token", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
        salted = keys.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
        marks = marks.hint("merge")
        out.append(salted.join(marks, ["token", "salt"], "left_anti").select("rid", "n", "token"))
        deeper = salted.join(marks, ["token", "salt"], "left_semi")
        rest = F.slice("prefix", col("pos") + 2, F.greatest(F.size("prefix") - col("pos") - 1, F.lit(0)))
        keys = deeper.select("rid", "n", "prefix", "token", (col("pos") + 1).alias("from"), F.posexplode(rest).alias("k", "gram")).select(
            "rid", "n", "prefix", (col("from") + col("k")).alias("pos"), F.xxhash64("token", "gram").alias("token"))
    return reduce(DataFrame.unionByName, out)


def dense(prefixes: DataFrame, limit: int) -> bool:
    """Would the rows get more than KEYS_PER_ROW keys of two trigrams, because most trigrams of their prefixes are crowded?"""
    places = prefixes.select(F.size("prefix").alias("m"), F.posexplode("prefix").alias("pos", "gram"))
    count = F.count(F.lit(1))
    keys = places.groupBy("gram").agg(F.when(count > limit, F.sum(col("m") - col("pos") - 1)).otherwise(0).alias("keys")).agg(F.sum("keys")).first()[0]
    return (keys or 0) > KEYS_PER_ROW * prefixes.count()


def _at_least(n: Column, threshold: float) -> Column:
    """Smallest overlap that a set of size n can have with a similar one."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9))


def _pairs(members: DataFrame, few: DataFrame, sizes: DataFrame, threshold: float, few_is_lower: bool) -> DataFrame:
    """Candidate pairs (lo, hi) of rows with a common key: ``members`` against
    the rows of ``few`` on the given side. Groups larger than ``SPLIT_ROWS`` are split over
    salts."""
    parts = F.ceil(col("size") / SPLIT_ROWS)
    left = members.join(sizes, "token").withColumn("salt", F.pmod(F.xxhash64("rid"), parts))
    right = (
        few.join(sizes, "token").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .select("token", "salt", col("rid").alias("rid2"), col("n").alias("n2"))
    )
    order = (col("rid2") < col("rid")) if few_is_lower else (col("rid") < col("rid2"))
    lo, hi = ("rid2", "rid") if few_is_lower else ("rid", "rid2")
    return (
        left.join(right, ["token", "salt"])
        .filter(order & (F.least("n", "n2") >= _at_least(F.greatest("n", "n2"), threshold)))
        .select(col(lo).alias("lo"), col(hi).alias("hi")).distinct()
    )


def _verify(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    return (
        pairs.join(rows.select(col("rid").alias("lo"), col("grams").alias("g1")).hint("merge"), "lo")
        .join(rows.select(col("rid").alias("hi"), col("grams").alias("g2")).hint("merge"), "hi")
        .filter(S.set_similarity(col("g1"), col("g2")) > threshold)
        .select("lo", "hi")
    )


def _front(tokens: DataFrame, front: int) -> DataFrame:
    """The first ``front`` rows of every token group, ranked in two steps through
    sub-groups so that no large group is sorted in one task."""
    sub = tokens.withColumn("sub", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    first = numbering.top_per_key(sub, ["token", "sub"], [col("rid")], front, "r")
    return numbering.top_per_key(first, ["token"], [col("rid")], front, "r").drop("sub", "r")


def settle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Greedy survivors over known edges: a row is dropped when a smaller neighbour is kept,
    and kept when all smaller neighbours are dropped. ``nodes`` is (rid, complete); only
    complete rows know all of their smaller neighbours and may be kept. Returns (rid, state)
    with state kept, dropped or open."""
    state = nodes.select("rid", "complete", F.lit("open").alias("state"))
    open_count, previous = None, None
    while True:
        # Edges of few hubs and states of few values are many times their size on disk, so neither side may be broadcast.
        below = edges.join(state.select(col("rid").alias("lo"), col("state").alias("lo_state")).hint("merge"), "lo")
        seen = below.groupBy(col("hi").alias("rid")).agg(
            F.bool_or(col("lo_state") == "kept").alias("hit"),
            F.bool_or(col("lo_state") == "open").alias("wait"),
        )
        nxt = cut(state.join(seen, "rid", "left").select(
            "rid", "complete",
            F.when(col("state") != "open", col("state"))
            .when(col("hit"), "dropped")
            .when(col("complete") & ~F.coalesce(col("wait"), F.lit(False)), "kept")
            .otherwise("open").alias("state"),
        ))
        drop_cut(previous)
        previous = state = nxt
        left = state.filter(col("state") == "open").count()
        if left == 0 or left == open_count:
            return state.select("rid", "state")
        open_count = left


def fuzzy_survivors(titles: DataFrame, row_id: str = "batch_seq", title: str = "title",
                    threshold: float = config.TITLE_DUP_SIMILARITY, front: int = FRONT,
                    split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Ids that survive the rule "an earlier survivor with trigram similarity above the
    threshold removes the later row". Exact for any size and skew. Where most trigrams are crowded, the keys of a row would
    multiply, and the rows meet in a grid of blocks (:mod:`.titlegrid`); else, without all pairs:

    1. Titles equal apart from case collapse to their first row: whatever decides the first
       one drops the others.
    2. In key groups of more than ``split_rows`` rows every row is compared with the first few rows.
       A row similar to one of them is shadowed; all others are leaders. A huge group of near
       copies leaves a handful of leaders.
    3. Leaders alone are compared with all lower rows of their key groups, so they know
       all that can remove them, and :func:`settle` decides them.
    4. Newly kept leaders are compared with the rows still open. Rows that stay open (their
       shadow was itself dropped) go through the next round.
    """
    base = titles.select(col(row_id).cast("long").alias("rid"), F.lower(col(title)).alias("low"))
    short = base.filter(col("low").isNull() | (F.length("low") < 3)).select("rid")
    firsts = base.filter(F.length("low") >= 3).groupBy("low").agg(F.min("rid").alias("rid"))
    rows = cut(firsts.select("rid", S.packed_trigrams(col("low")).alias("grams")))
    limit = min(GROUP_LIMIT, split_rows)
    prefixes = cut(prefix_tokens(rows, threshold))
    if dense(prefixes, limit):
        return short.unionByName(titlegrid.survivors(rows, threshold)).select(col("rid").alias(row_id))
    tokens = cut(signatures(rows, threshold, limit=limit, prefixes=prefixes))
    kept = short
    while True:
        sizes = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter(col("size") > 1))
        hot = sizes.filter(col("size") > split_rows)
        shadows = None
        if not hot.isEmpty():
            crowd = tokens.join(hot.select("token"), "token", "left_semi")
            shadows = cut(_verify(_pairs(crowd, _front(crowd, front), hot, threshold, True), rows, threshold))
        nodes, leaders = rows.select("rid", F.lit(True).alias("complete")), tokens
        if shadows is not None:
            shadowed = shadows.select(col("hi").alias("rid")).distinct()
            leaders = tokens.join(shadowed, "rid", "left_anti")
            nodes = rows.select("rid").join(shadowed.withColumn("complete", F.lit(False)), "rid", "left").select(
                "rid", F.coalesce("complete", F.lit(True)).alias("complete"))
        known = _verify(_pairs(tokens, leaders, sizes, threshold, False), rows, threshold)
        state = settle(nodes, cut(known if shadows is None else known.unionByName(shadows)))
        done = state.filter(col("state") == "kept").select("rid")
        kept = kept.unionByName(done)
        open_rows = state.filter(col("state") == "open").select("rid")
        if shadows is None or open_rows.isEmpty():
            return kept.select(col("rid").alias(row_id))
        open_tokens = cut(tokens.join(open_rows, "rid", "left_semi"))
        hits = _verify(_pairs(open_tokens, tokens.join(done, "rid", "left_semi"), sizes, threshold, True), rows, threshold)
        open_rows = cut(open_rows.join(hits.select(col("hi").alias("rid")), "rid", "left_anti"))
        rows = cut(rows.join(open_rows, "rid", "left_semi"))
        tokens = cut(open_tokens.join(open_rows, "rid", "left_semi"))


# ---- the chain --------------------------------------------------------------------------

def deduplicate(batch: DataFrame, stored: DataFrame, as_of: Column, row_id: str = "batch_seq",
                split_rows: int = SPLIT_ROWS, filters: DataFrame | None = None) -> DataFrame:
    """Adds ``rule`` (null for unique rows). Each layer sees only survivors of the earlier
    ones: source flag, batch url, exact match with stored rows, fuzzy titles."""
    light = cut(batch.select(
        row_id, "title", "normalized_url_hash", "domain_title_hash", "title_hash",
        F.coalesce("api_duplicate_flag", F.lit(False)).alias("flagged"),
    ))
    live = light.filter(~col("flagged"))
    marked = mark_batch_url(live, row_id)
    live = cut(marked.filter("first_of_url").drop("first_of_url"))
    exact = cut(stored_matches(live, stored, as_of, row_id, filters=filters))
    live = live.join(exact, row_id, "left_anti")
    alive = fuzzy_survivors(live, row_id, split_rows=split_rows)
    rules = (
        light.filter("flagged").select(row_id, F.lit("dedup_newsdata_flag").alias("rule"))
        .unionByName(marked.filter(~col("first_of_url")).select(row_id, F.lit("dedup_batch_url").alias("rule")))
        .unionByName(exact.select(row_id, F.lit("dedup_exact").alias("rule")))
        .unionByName(live.join(alive, row_id, "left_anti").select(row_id, F.lit("dedup_fuzzy").alias("rule")))
    )
    return batch.join(cut(rules), row_id, "left")


def article_hashes(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "title_hash": S.title_hash(col("title")),
        "normalized_url_hash": S.url_hash(col("url")),
        "domain_title_hash": S.domain_title_hash(col("source_domain"), col("title")),
    })


def evictions(articles: DataFrame) -> DataFrame:
    """Inside a story keep one article per source name and one per url, best importance
    first. Both passes read the same snapshot. Returns (id, by_source, by_url) of evicted rows."""
    rank = F.coalesce("importance_score", F.lit(0.0))
    snapshot = articles.filter(col("story_id").isNotNull()).select(
        "id", "story_id", "source_name", "normalized_url_hash", (-rank).alias("low_score")
    )
    best = numbering.mark_first(snapshot, ["story_id", "source_name"], ["low_score"], "id", "best_of_source", store=True)
    best = numbering.mark_first(best, ["story_id", "normalized_url_hash"], ["low_score"], "id", "best_of_url", store=True)
    return best.select(
        "id", "story_id",
        (~col("best_of_source")).alias("by_source"),
        (~col("best_of_url") & col("normalized_url_hash").isNotNull()).alias("by_url"),
    ).filter(col("by_source") | col("by_url"))
