"""Vector similarity on Spark: blocked products, linked components, greedy story matching
and clustering with the results of the article-by-article loop.

Article and story meet through their keywords where both have some: too few common ones cannot reach
the score, so an equi join on keywords gives all candidates and no vectors are compared without need. Vectors alone decide where
keywords are missing and in clustering; chunks of them meet only where the angles to their pivots allow a similar pair
(:mod:`.vectorgrid`). Tasks emit only best matches or spanning-forest edges, never all similar pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..session import cut, drop_cut
from . import numbering
from .vectorgrid import chunk_pairs
from .vectorgrid import unit_rows as _unit

col = F.col
BLOCK_ROWS = 8000
PRODUCT_ROWS = 1000
CHUNK_ROWS = 2000
STATE_PART = 500
SPLIT_ROWS = 2000
SALTS = 16


# ---- numpy helpers used inside tasks ------------------------------------------------------

def _reaches(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, computed in slices to keep the product small."""
    out = np.empty((len(a), len(b)), bool)
    for i in range(0, len(a), PRODUCT_ROWS):
        np.greater_equal(a[i:i + PRODUCT_ROWS] @ b.T, threshold, out=out[i:i + PRODUCT_ROWS])
    return out


def _forest(adj: np.ndarray) -> Iterator[tuple[list[int], list[int]]]:
    """Components of a bipartite boolean matrix as (row indexes, column indexes)."""
    rows_left = np.ones(adj.shape[0], bool)
    cols_left = np.ones(adj.shape[1], bool)
    for start in range(adj.shape[0]):
        if not rows_left[start]:
            continue
        rows, cols = [], []
        frontier = np.array([start])
        rows_left[start] = False
        while frontier.size:
            rows.extend(frontier.tolist())
            new_cols = np.flatnonzero(adj[frontier].any(axis=0) & cols_left)
            cols_left[new_cols] = False
            cols.extend(new_cols.tolist())
            frontier = np.flatnonzero(adj[:, new_cols].any(axis=1) & rows_left) if new_cols.size else new_cols
            rows_left[frontier] = False
        if cols:
            yield rows, cols


# ---- components ---------------------------------------------------------------------------

def linked_edges(rows: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): edges whose components are those of the graph that links nodes with a pair of vectors at or above ``threshold``.

    ``rows`` is (node, story, free, embedding); several vectors for a node are allowed. Two stories are not compared, nor two nodes of which
    none is free. Equal vectors of articles are one point, the others hang on it."""
    rows = rows.select(col("node").cast("string").alias("node"), "story", "free", "embedding")
    articles = rows.filter("NOT story AND free")
    firsts = articles.groupBy("embedding").agg(F.min("node").alias("node"))
    points = cut(firsts.select("node", F.lit(False).alias("story"), F.lit(True).alias("free"), "embedding").unionByName(rows.filter("story OR NOT free")))
    # A zero vector is similar to nothing, not even to its copies.
    copies = articles.filter(F.exists("embedding", lambda x: x != 0)).join(firsts.withColumnRenamed("node", "first"), "embedding").filter("node <> first").select(
        col("first").alias("a"), col("node").alias("b"))

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        left, right = pdf[pdf["chunk"] == p], pdf[pdf["chunk"] == q]
        out: list[tuple[str, str]] = []
        if len(left) and len(right):
            adj = _reaches(_unit(left["embedding"]), _unit(right["embedding"]), threshold)
            adj &= ~np.logical_and.outer(left["story"].to_numpy(), right["story"].to_numpy())
            adj &= np.logical_or.outer(left["free"].to_numpy(), right["free"].to_numpy())
            ln, rn = left["node"].to_numpy(), right["node"].to_numpy()
            for i, j in _forest(adj):
                names = sorted({*ln[i], *rn[j]})
                out.extend((names[0], other) for other in names[1:])
        return pd.DataFrame(out, columns=["a", "b"])

    return chunk_pairs(points, threshold, block_rows).groupBy("p", "q").applyInPandas(links, "a string, b string").unionByName(copies).distinct()


def linked_components(rows: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, component) of the graph of :func:`linked_edges`, for rows (node, embedding) that are all compared."""
    nodes = rows.select(col("node").cast("string").alias("node"), F.lit(False).alias("story"), F.lit(True).alias("free"), "embedding")
    return connected_components(nodes.select("node").distinct(), linked_edges(nodes, threshold, block_rows))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node name as component: minimum labels over the
    edges plus pointer jumping, so long chains need a logarithmic number of rounds."""
    both = cut(edges.select("a", "b").unionByName(edges.select(col("b").alias("a"), col("a").alias("b"))))
    labels = cut(nodes.select("node", col("node").alias("component")))
    while True:
        near = (
            both.join(labels.select(col("node").alias("b"), "component"), "b")
            .groupBy(col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node", "left").select(
            "node", col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component")
        )
        jump = labels.select(col("node").alias("component"), col("component").alias("up"))
        nxt = cut(lower.join(jump, "component").select("node", "old", F.least("component", "up").alias("component")))
        changed = not nxt.filter(col("old") != col("component")).isEmpty()
        drop_cut(labels)
        labels = nxt.select("node", "component")
        if not changed:
            return labels


# ---- article x story ----------------------------------------------------------------------

def story_windows(stories: DataFrame, articles: DataFrame, as_of: Column,
                  days: int = config.STORY_WINDOW_DAYS, recent: int = config.RECENT_VECTORS) -> DataFrame:
    """(story_id, keywords, vectors): active, recent stories with a centroid, each with its
    newest article vectors, the centroid in front when there are fewer than ten."""
    live = stories.filter(
        col("centroid").isNotNull() & (col("status") == "active")
        & (col("last_updated_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    ).select(col("id").alias("story_id"), "centroid", F.coalesce("keyword_set", F.array().cast("array<string>")).alias("keywords"))
    newest = recent_vectors(articles, recent)
    lists = newest.groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("rank", "embedding"))).alias("l"))
    vectors = F.coalesce(col("l.embedding"), F.array().cast("array<array<double>>"))
    return live.join(lists, "story_id", "left").select(
        "story_id", "keywords",
        F.when(F.size(vectors) < recent, F.concat(F.array("centroid"), vectors)).otherwise(vectors).alias("vectors"),
    )


def recent_vectors(articles: DataFrame, recent: int = config.RECENT_VECTORS) -> DataFrame:
    """The newest embedded articles per story, newest first (rank from 1)."""
    embedded = articles.filter(col("story_id").isNotNull() & col("embedding").isNotNull())
    return numbering.top_per_key(
        embedded.select("id", "story_id", "published_at", "embedding"), ["story_id"],
        [col("published_at").desc(), col("id")], recent,
    )


def _keyword_part(kws: pd.Series, story_kws: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Overlap score of every article with every story, and where it does not apply."""
    where: dict[str, list[int]] = {}
    for j, ks in enumerate(story_kws):
        for k in set(ks if ks is not None else ()):
            where.setdefault(k, []).append(j)
    hits = np.zeros((len(kws), len(story_kws)))
    for i, ks in enumerate(kws):
        for k in list(ks if ks is not None else ())[: config.MATCH_KEYWORDS]:
            if k in where:
                hits[i, where[k]] += 1
    none = np.outer([ks is None or len(ks) == 0 for ks in kws], np.ones(len(story_kws), bool))
    none |= np.array([ks is None or len(ks) == 0 for ks in story_kws], bool)
    return np.minimum(hits / 4.0, 1.0), none


def _combine(sim: np.ndarray, kw: np.ndarray, none: np.ndarray) -> np.ndarray:
    return np.where(none, sim, sim * config.MATCH_EMBEDDING_WEIGHT + kw * config.MATCH_KEYWORD_WEIGHT)


def _window_scores(articles: pd.DataFrame, stories: pd.DataFrame) -> np.ndarray:
    """Score of every article against every story in its given window."""
    sizes = [len(v) for v in stories["vectors"]]
    flat = _unit([v for vs in stories["vectors"] for v in vs])
    sims = np.zeros((len(articles), len(stories)))
    if flat.size and len(articles):
        product = _unit(articles["embedding"]) @ flat.T
        starts = np.cumsum([0, *sizes[:-1]])
        full = np.flatnonzero(sizes)
        sims[:, full] = np.maximum.reduceat(product, starts[full], axis=1)
    kw, none = _keyword_part(articles["keywords"], stories["keywords"])
    return _combine(sims, kw, none)


def _has_words(keywords: str = "keywords") -> Column:
    return F.coalesce(F.size(keywords) > 0, F.lit(False))


def least_hits(threshold: float) -> int:
    """So many common keywords at least has a pair that reaches the score, if both sides have keywords and their vectors agree fully."""
    short = (threshold - config.MATCH_EMBEDDING_WEIGHT) / config.MATCH_KEYWORD_WEIGHT
    return max(0, math.ceil(4 * short - 1e-9))


def keyword_candidates(articles: DataFrame, windows: DataFrame, threshold: float = config.STORY_MATCH_SCORE, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(id, story_id, hits): all pairs with keywords on both sides that share enough of them for the score, with the number of the
    article's keywords that are the story's.

    ``articles`` is (id, keywords), ``windows`` (story_id, keywords). An article's keywords are ordered by the number of stories they stand for, and the
    most frequent ones, of which a pair could share all and still fail, are not joined on. A keyword of many articles is split over salts."""
    least = max(1, least_hits(threshold))
    said = articles.select("id", F.posexplode(F.slice("keywords", 1, config.MATCH_KEYWORDS)).alias("pos", "word")).filter(col("word").isNotNull())
    meant = windows.select("story_id", F.explode(F.array_distinct("keywords")).alias("word")).filter(col("word").isNotNull())
    stories = meant.groupBy("word").agg(F.count(F.lit(1)).alias("stories"))
    readers = said.groupBy("word").agg(F.count(F.lit(1)).alias("readers"))
    # The table of words is copied to a fixed number of salts, so that a frequent word's rows do not meet to learn its counts.
    sizes = cut(stories.join(readers, "word").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    known = said.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int")).join(sizes, ["word", "salt"]).drop("salt")
    order = W.partitionBy("id").orderBy("stories", "word", "pos")
    rare = known.withColumn("place", F.row_number().over(order)).withColumn("of", F.count(F.lit(1)).over(W.partitionBy("id"))).filter(col("place") <= col("of") - (least - 1))
    parts = F.ceil(col("readers") / split_rows)
    left = rare.withColumn("part", F.pmod(F.xxhash64("id"), parts)).select("id", "word", "part")
    right = meant.join(sizes.filter("salt = 0").select("word", "readers"), "word").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select("story_id", "word", "part")
    pairs = left.join(right, ["word", "part"]).select("id", "story_id").distinct()
    both = pairs.join(articles.select("id", F.slice("keywords", 1, config.MATCH_KEYWORDS).alias("said")), "id").join(windows.select("story_id", col("keywords").alias("meant")), "story_id")
    return both.select("id", "story_id", F.size(F.filter("said", lambda k: F.array_contains("meant", k))).alias("hits")).filter(col("hits") >= least)


def _needed(hits: Column, threshold: float) -> Column:
    """The cosine that a pair with so many common keywords needs."""
    return (threshold - config.MATCH_KEYWORD_WEIGHT * F.least(hits / 4.0, F.lit(1.0))) / config.MATCH_EMBEDDING_WEIGHT


def match_snapshot(articles: DataFrame, windows: DataFrame, threshold: float = config.STORY_MATCH_SCORE,
                   block_rows: int = CHUNK_ROWS) -> DataFrame:
    """(id, story_id, score): best story of every article against the story windows as they
    stand, at or above the threshold; ties go to the lower story id.

    ``articles`` is (id, embedding, keywords). Pairs with keywords on both sides come from the keyword join, the others from the
    vector grid. Tasks emit one row for each article and story or chunk at most."""
    embedded = cut(articles.filter(col("embedding").isNotNull()).select("id", "embedding", "keywords"))
    windows = cut(windows)
    pairs = keyword_candidates(embedded, windows, threshold, block_rows)
    placed = pairs.join(embedded.select("id", "embedding"), "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    seen = windows.filter(_has_words()).select(col("story_id").alias("of"), "vectors", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("to_part"))

    def by_words(a: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if a.empty or s.empty or len(s["vectors"].iloc[0]) == 0:
            return pd.DataFrame({"id": [], "story_id": [], "score": []})
        sim = (_unit(a["embedding"]) @ _unit(s["vectors"].iloc[0]).T).max(axis=1)
        score = sim * config.MATCH_EMBEDDING_WEIGHT + np.minimum(a["hits"].to_numpy() / 4.0, 1.0) * config.MATCH_KEYWORD_WEIGHT
        out = pd.DataFrame({"id": a["id"].to_numpy(), "story_id": a["story_id"].to_numpy(), "score": score})
        return out[out["score"] >= threshold]

    matched = placed.groupBy("story_id", "part").cogroup(seen.groupBy("of", "to_part")).applyInPandas(by_words, "id long, story_id long, score double")

    points = embedded.select("id", F.lit(False).alias("story"), (~_has_words()).alias("free"), "embedding").unionByName(
        windows.select(col("story_id").alias("id"), F.lit(True).alias("story"), (~_has_words()).alias("free"), F.explode("vectors").alias("embedding")))
    free_articles, free_stories = (not embedded.filter(~_has_words()).isEmpty()), (not windows.filter(~_has_words()).isEmpty())

    def by_vectors(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        a, s = pdf[~pdf["story"]], pdf[pdf["story"]].sort_values("id", ignore_index=True)
        if a.empty or s.empty:
            return pd.DataFrame({"id": [], "story_id": [], "score": []})
        score = _unit(a["embedding"]) @ _unit(s["embedding"]).T
        score[~np.logical_or.outer(a["free"].to_numpy(), s["free"].to_numpy())] = -2.0
        if p != q:  # rows of one chunk meet in its own pair
            score[np.equal.outer(a["chunk"].to_numpy(), s["chunk"].to_numpy())] = -2.0
        j = score.argmax(axis=1)
        out = pd.DataFrame({"id": a["id"].to_numpy(), "story_id": s["id"].to_numpy()[j], "score": score[np.arange(len(a)), j]})
        return out[out["score"] >= threshold]

    if free_articles or free_stories:
        if not free_stories:
            points = points.filter("story OR free")
        elif not free_articles:
            points = points.filter("NOT story OR free")
        cells = chunk_pairs(points, threshold, block_rows).groupBy("p", "q").applyInPandas(by_vectors, "id long, story_id long, score double")
        matched = matched.unionByName(cells)
    return matched.groupBy("id").agg(F.max(F.struct("score", (-col("story_id")).alias("neg"))).alias("m")).select(
        "id", (-col("m.neg")).alias("story_id"), col("m.score").alias("score")
    )


def reachable_pairs(articles: DataFrame, windows: DataFrame, loose: DataFrame, threshold: float = config.STORY_MATCH_SCORE, split_rows: int = CHUNK_ROWS) -> DataFrame:
    """(id, story_id): the keyword candidates that the article-by-article loop could accept: the article is near enough to a vector of the story's window,
    or to an earlier article that is reachable in it. ``loose`` are ids of articles that count as reachable in all of their candidates.

    Each round compares what was reached last with the candidates of the same stories that are still open; a pair of articles is compared once for a story
    at most, and there are as many rounds as the longest chain."""
    pairs = keyword_candidates(articles, windows, threshold)
    waiting = cut(pairs.withColumn("need", _needed(col("hits"), threshold) - 1e-9).join(articles.select("id", "embedding"), "id").select("id", "story_id", "need", "embedding"))
    start = windows.filter(_has_words()).select("story_id", F.lit(None).cast("long").alias("by"), F.explode("vectors").alias("embedding"))
    free = waiting.join(loose.select("id").distinct(), "id", "left_semi")
    reached = [free.select("id", "story_id")]
    front = start.unionByName(free.select("story_id", col("id").alias("by"), "embedding"))
    waiting = waiting.join(reached[0], ["id", "story_id"], "left_anti")

    def near(w: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if w.empty or f.empty:
            return w[["id", "story_id"]].iloc[:0]
        sim = _unit(w["embedding"]) @ _unit(f["embedding"]).T
        earlier = f["by"].isna().to_numpy()[None, :] | (f["by"].fillna(0).to_numpy()[None, :] < w["id"].to_numpy()[:, None])
        return w.loc[((sim >= w["need"].to_numpy()[:, None]) & earlier).any(axis=1), ["id", "story_id"]]

    while True:
        # Both sides of a story are cut into parts of bounded size; every two parts meet.
        open_parts = waiting.groupBy("story_id").agg(F.ceil(F.count(F.lit(1)) / split_rows).alias("w_parts"))
        front_parts = front.groupBy("story_id").agg(F.ceil(F.count(F.lit(1)) / split_rows).alias("f_parts"))
        sizes = open_parts.join(front_parts, "story_id")

        def parted(df: DataFrame, own: str, other: str, key: Column) -> DataFrame:
            mine = F.pmod(key, col(own))
            copies = df.join(sizes, "story_id").withColumn(own[0], mine).withColumn(other[0], F.explode(F.sequence(F.lit(0).cast("long"), col(other) - 1)))
            return copies.drop("w_parts", "f_parts")

        w = parted(waiting, "w_parts", "f_parts", F.xxhash64("id"))
        f = parted(front, "f_parts", "w_parts", F.xxhash64("by", "embedding")).select(col("story_id").alias("of"), col("w").alias("to_w"), col("f").alias("to_f"), "by", "embedding")
        met = w.groupBy("story_id", "w", "f").cogroup(f.groupBy("of", "to_w", "to_f")).applyInPandas(near, "id long, story_id long")
        fresh = cut(met.distinct())
        if fresh.isEmpty():
            drop_cut(fresh)
            return reduce(DataFrame.unionByName, reached)
        reached.append(fresh)
        front = cut(waiting.join(fresh, ["id", "story_id"], "left_semi").select("story_id", col("id").alias("by"), "embedding"))
        waiting = cut(waiting.join(fresh, ["id", "story_id"], "left_anti"))


# ---- greedy loops, component by component ---------------------------------------------------

def _steps(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """(component, range, step): consecutive id ranges of a component, gathered into steps of
    at most twice ``chunk_rows`` rows. Almost all components need one step."""
    ranged = rows.groupBy("component", F.floor(col("id") / chunk_rows).alias("range")).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("component").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    return ranged.withColumn("step", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / chunk_rows).cast("int")).drop("n")


def _relevant(state: DataFrame, chunk: DataFrame, hit, keys: str) -> DataFrame:
    """Rows of the state that some row of the chunk can reach. The state of a component is
    cut into parts of bounded size, the chunk is sent to each part."""
    placed = state.withColumn("part", F.pmod(F.xxhash64("owner"), F.greatest(F.lit(1), F.ceil(col("owners") / STATE_PART))))
    parts = placed.select(col("component").alias("of"), col("part").alias("to_part")).distinct()
    sent = chunk.join(parts, col("component") == col("of")).drop("of")

    def keep(s: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if s.empty or c.empty:
            return s[["component", "owner"]].iloc[:0]
        return s.loc[hit(c, s), ["component", "owner"]]

    found = placed.groupBy("component", "part").cogroup(sent.groupBy("component", "to_part")).applyInPandas(keep, keys)
    return state.join(found, ["component", "owner"], "left_semi")


def _run_steps(rows: DataFrame, state: DataFrame | None, chunk_rows: int, hit, loop, state_schema: str) -> DataFrame:
    """Run the greedy ``loop`` over every component, chunk by chunk in id order, carrying the
    state of each component as rows. A task never holds more than one chunk plus the state
    its rows can reach. Returns (id, owner, score) for rows that got an owner."""
    rows = cut(rows)
    steps = cut(_steps(rows, chunk_rows))
    last = steps.agg(F.max("step")).first()[0]
    if last is None:
        return rows.select("id", F.lit(None).cast("long").alias("owner"), F.lit(None).cast("double").alias("score")).limit(0)
    placed = cut(rows.withColumn("range", F.floor(col("id") / chunk_rows)).join(steps, ["component", "range"]).drop("range"))
    if state is None:
        state = rows.sparkSession.createDataFrame([], state_schema)
    result = None
    out_schema = f"kind string, id long, score double, {state_schema}"
    for step in range(last + 1):
        chunk = placed.filter(col("step") == step).drop("step")
        sized = state.join(state.groupBy("component").agg(F.count(F.lit(1)).alias("owners")), "component")
        reach = _relevant(sized, chunk, hit, "component string, owner long").drop("owners")
        done = cut(chunk.groupBy("component").cogroup(reach.groupBy("component")).applyInPandas(loop, out_schema))
        found = done.filter("kind = 'row'").select("id", "owner", "score")
        result = found if result is None else result.unionByName(found)
        if step < last:
            fresh = done.filter("kind = 'state'").drop("kind", "id", "score")
            waiting = placed.filter(col("step") > step).select("component").distinct()
            state = cut(
                state.join(fresh, ["component", "owner"], "left_anti").unionByName(fresh)
                .join(waiting, "component", "left_semi")
            )
    return result


_MATCH_COLS = ["component", "owner", "keywords", "vectors"]
_MATCH_STATE = "component string, owner long, keywords array<string>, vectors array<array<double>>"


def match_sequential(articles: DataFrame, windows: DataFrame, threshold: float = config.STORY_MATCH_SCORE,
                     block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(id, story_id, score) of the article-by-article loop: every accepted article enters the
    window of its story (the oldest entry leaves above ten), so later articles see it.

    Pairs with keywords on both sides come from the keyword join, as far as a chain of near articles leads to the story. Where keywords are
    missing, vectors link articles and stories. Components of that graph are independent of each other."""
    reach = (threshold - config.MATCH_KEYWORD_WEIGHT) / config.MATCH_EMBEDDING_WEIGHT
    embedded = cut(articles.filter(col("embedding").isNotNull()).select("id", "embedding", "keywords"))
    windows = cut(windows)
    free_stories, free_articles = (not windows.filter(~_has_words()).isEmpty()), (not embedded.filter(~_has_words()).isEmpty())
    spark = articles.sparkSession
    edges = spark.createDataFrame([], "a string, b string")
    if free_stories or free_articles:
        # A story without keywords can take any article, so any two articles may meet in its window.
        nodes = embedded.select(F.concat(F.lit("a"), col("id")).alias("node"), F.lit(False).alias("story"), (F.lit(free_stories) | ~_has_words()).alias("free"), "embedding").unionByName(
            windows.select(F.concat(F.lit("s"), col("story_id")).alias("node"), F.lit(True).alias("story"), (~_has_words()).alias("free"), F.explode("vectors").alias("embedding")))
        edges = cut(linked_edges(nodes, reach - 1e-9, block_rows))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).filter(F.col("node").startswith("a"))
    loose = ends.select(F.substring("node", 2, 30).cast("long").alias("id")).distinct()
    pairs = reachable_pairs(embedded, windows, loose, threshold, chunk_rows)
    edges = edges.unionByName(pairs.select(F.concat(F.lit("a"), col("id")).alias("a"), F.concat(F.lit("s"), col("story_id")).alias("b")))
    names = embedded.select(F.concat(F.lit("a"), col("id")).alias("node")).unionByName(windows.select(F.concat(F.lit("s"), col("story_id")).alias("node")))
    component = connected_components(names.distinct(), edges)
    state = windows.withColumn("node", F.concat(F.lit("s"), col("story_id"))).join(component, "node").select(
        "component", col("story_id").alias("owner"), "keywords", "vectors"
    )
    rows = embedded.withColumn("node", F.concat(F.lit("a"), col("id"))).join(component, "node").drop("node")
    with_story = state.select("component").distinct()
    rows = rows.join(with_story, "component", "left_semi")

    def hit(c: pd.DataFrame, s: pd.DataFrame) -> np.ndarray:
        return (_window_scores(c, s) >= threshold).any(axis=0)

    def loop(c: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        c, s = c.sort_values("id", ignore_index=True), s.sort_values("owner", ignore_index=True)
        if c.empty or s.empty:
            return _result([], [], _MATCH_COLS)
        flat = [v for vs in s["vectors"] for v in vs]
        pool = _unit([*flat, *c["embedding"]])
        gram = pool[len(flat):] @ pool.T
        ends = np.cumsum([len(v) for v in s["vectors"]])
        wins = [list(range(e - len(v), e)) for e, v in zip(ends, s["vectors"])]
        table = np.full((len(s), config.RECENT_VECTORS), -1)
        for j, w in enumerate(wins):
            table[j, : len(w)] = w
        kw, none = _keyword_part(c["keywords"], s["keywords"])
        found, touched = [], set()
        for i in range(len(c)):
            sims = np.where(table >= 0, gram[i][table], -np.inf).max(axis=1)
            sims = np.where(np.isneginf(sims), 0.0, sims)
            score = _combine(sims, kw[i], none[i])
            j = int(score.argmax())
            if score[j] >= threshold:
                found.append((int(c["id"][i]), int(s["owner"][j]), float(score[j])))
                wins[j] = [*wins[j], len(flat) + i][-config.RECENT_VECTORS:]
                table[j] = -1
                table[j, : len(wins[j])] = wins[j]
                touched.add(j)
        raw = [*flat, *c["embedding"]]
        component_name = c["component"].iloc[0]
        fresh = [
            (component_name, int(s["owner"][j]), s["keywords"][j], [raw[k] for k in wins[j]]) for j in sorted(touched)
        ]
        return _result(found, fresh, _MATCH_COLS)

    owners = _run_steps(rows, state, chunk_rows, hit, loop, _MATCH_STATE)
    return owners.select("id", col("owner").alias("story_id"), "score")


_CLUSTER_COLS = ["component", "owner", "seed", "vectors"]
_CLUSTER_STATE = "component string, owner long, seed array<double>, vectors array<array<double>>"


def cluster_articles(articles: DataFrame, link: float = config.STORY_LINK_SIMILARITY,
                     anchor: float = config.STORY_ANCHOR_SIMILARITY, window: int = config.RECENT_VECTORS,
                     block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(id, seed_id) of the greedy clustering in id order: an article joins the cluster with
    the most similar of its last ten members, if that similarity reaches ``link`` and the
    similarity to the first member reaches ``anchor``; otherwise it seeds a cluster.

    A join needs a link, so clusters never cross the components of the link graph."""
    embedded = cut(articles.filter(col("embedding").isNotNull()).select("id", "embedding"))
    component = linked_components(embedded.select(col("id").cast("string").alias("node"), "embedding"), link - 1e-9, block_rows)
    rows = embedded.withColumn("node", col("id").cast("string")).join(component, "node").drop("node")

    def hit(c: pd.DataFrame, s: pd.DataFrame) -> np.ndarray:
        unit = _unit(c["embedding"])
        near = unit @ _unit(s["seed"]).T >= anchor
        flat = _unit([v for vs in s["vectors"] for v in vs])
        starts = np.cumsum([0, *[len(v) for v in s["vectors"]][:-1]])
        return (near & (np.maximum.reduceat(unit @ flat.T, starts, axis=1) >= link)).any(axis=0)

    def loop(c: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if c.empty:
            return _result([], [], _CLUSTER_COLS)
        c, s = c.sort_values("id", ignore_index=True), s.sort_values("owner", ignore_index=True)
        flat = [*s["seed"], *[v for vs in s["vectors"] for v in vs]]
        raw = [*flat, *c["embedding"]]
        pool = _unit(raw)
        gram = pool[len(flat):] @ pool.T
        owner, seeds = [int(o) for o in s["owner"]], list(range(len(s)))
        table = np.full((len(s) + len(c), window), -1)
        wins, k = [], len(s)
        for j, vs in enumerate(s["vectors"]):
            wins.append(list(range(k, k + len(vs))))
            table[j, : len(vs)] = wins[j]
            k += len(vs)
        found, touched = [], set()
        for i in range(len(c)):
            m = len(owner)
            best = -1
            if m:
                t = table[:m]
                sims = np.where(t >= 0, gram[i][t], -np.inf).max(axis=1)
                sims = np.where((gram[i][seeds] >= anchor) & (sims >= link), sims, -np.inf)
                best = int(sims.argmax()) if np.isfinite(sims).any() else -1
            if best < 0:
                best = m
                owner.append(int(c["id"][i]))
                seeds.append(len(flat) + i)
                wins.append([])
            wins[best] = [*wins[best], len(flat) + i][-window:]
            table[best] = -1
            table[best, : len(wins[best])] = wins[best]
            touched.add(best)
            found.append((int(c["id"][i]), owner[best], None))
        name = c["component"].iloc[0]
        fresh = [(name, owner[j], raw[seeds[j]], [raw[k] for k in wins[j]]) for j in sorted(touched)]
        return _result(found, fresh, _CLUSTER_COLS)

    owners = _run_steps(rows, None, chunk_rows, hit, loop, _CLUSTER_STATE)
    return owners.select("id", col("owner").alias("seed_id"))


def _result(found: list, fresh: list, state_cols: list[str]) -> pd.DataFrame:
    """Assignments and changed state rows in the one output shape of a greedy loop."""
    names = ["kind", "id", "score", *state_cols]
    records = [{"kind": "row", "id": i, "owner": o, "score": x} for i, o, x in found]
    records += [{"kind": "state", **dict(zip(state_cols, row))} for row in fresh]
    out = pd.DataFrame({n: pd.Series([r.get(n) for r in records], dtype=object) for n in names})
    return out.astype({"id": "Int64", "owner": "Int64", "score": "float64"})
