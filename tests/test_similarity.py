"""Story matching and clustering against the article-by-article loops."""

import numpy as np
import pytest

from newsgrid.operators import similarity, vectorgrid


def vectors(seed, n, topics, dim=16, noise=0.55):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(topics, dim))
    return {int(i): centres[rng.integers(topics)] + noise * rng.normal(size=dim) for i in range(n)}


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n else v


def cluster_loop(vs):
    u = {i: unit(v) for i, v in vs.items()}
    clusters, out = [], {}
    for i in sorted(u):
        best, top = None, -9.0
        for c, (seed, members) in enumerate(clusters):
            if u[i] @ u[seed] < 0.7:
                continue
            for m in members[-10:]:
                s = u[i] @ u[m]
                if s >= 0.8 and s > top:
                    best, top = c, s
        if best is None:
            clusters.append((i, [i]))
            out[i] = i
        else:
            clusters[best][1].append(i)
            out[i] = clusters[best][0]
    return out


def match_loop(articles, windows, update):
    wins = {s: [unit(np.array(v)) for v in vs] for s, _, vs in windows}
    kws = {s: k for s, k, _ in windows}
    out = {}
    for i, v, kw in sorted(articles, key=lambda a: a[0]):
        best, top = None, -9.0
        for s in sorted(wins):
            e = max((unit(np.array(v)) @ x for x in wins[s][-10:]), default=0.0)
            score = e if not kw or not kws[s] else 0.65 * e + 0.35 * min(sum(k in kws[s] for k in kw[:8]) / 4, 1)
            if score > top:
                best, top = s, score
        if top >= 0.75:
            out[i] = best
            if update:
                wins[best] = [*wins[best], unit(np.array(v))][-10:]
    return out


@pytest.mark.parametrize("seed,block,chunk", [(1, 2000, 2000), (2, 25, 10), (3, 40, 7)])
def test_clusters_equal_loop(spark, seed, block, chunk):
    vs = vectors(seed, 160, 4)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vs.items()], "id long, embedding array<double>")
    got = {r.id: r.seed_id for r in similarity.cluster_articles(df, block_rows=block, chunk_rows=chunk).collect()}
    expected = cluster_loop(vs)
    assert got == expected
    assert len(set(expected.values())) > 4


def match_input(spark, seed):
    vs = vectors(seed, 130, 5)
    words = [f"k{j}" for j in range(9)]
    arts = [(i, [float(x) for x in v], [words[(i + j) % 9] for j in range(i % 4)]) for i, v in vs.items() if i >= 12]
    wins = [(s, words[s % 9:s % 9 + 3] if s % 3 else [], [[float(x) for x in vs[s]]] * (1 + s % 2)) for s in range(12)]
    a = spark.createDataFrame(arts, "id long, embedding array<double>, keywords array<string>")
    w = spark.createDataFrame(wins, "story_id long, keywords array<string>, vectors array<array<double>>")
    return arts, wins, a, w


def worded(spark, seed, words_of_articles, words_of_stories):
    """Articles and stories of which the given shares have keywords; chains of articles lead away from the stories."""
    rng = np.random.default_rng(seed)
    vs = vectors(seed, 150, 6, noise=0.75)
    vocabulary = [f"k{j}" for j in range(12)]

    def words(share, most):
        return [str(x) for x in rng.choice(vocabulary, rng.integers(1, most))] if rng.random() < share else []

    arts = [(i, [float(x) for x in v], words(words_of_articles, 11)) for i, v in vs.items() if i >= 15]
    wins = [(s, words(words_of_stories, 9), [[float(x) for x in vs[s]]] * (1 + s % 2)) for s in range(15)]
    return arts, wins, spark.createDataFrame(arts, "id long, embedding array<double>, keywords array<string>"), spark.createDataFrame(
        wins, "story_id long, keywords array<string>, vectors array<array<double>>")


@pytest.mark.parametrize("seed,articles,stories,chunk", [(11, 1.0, 1.0, 9), (12, 0.7, 1.0, 2000), (13, 1.0, 0.6, 15), (14, 0.0, 0.5, 2000)])
def test_matches_with_and_without_keywords(spark, seed, articles, stories, chunk):
    arts, wins, a, w = worded(spark, seed, articles, stories)
    got = {r.id: r.story_id for r in similarity.match_sequential(a, w, block_rows=25, chunk_rows=chunk).collect()}
    assert got == match_loop(arts, wins, True) and got
    got = {r.id: r.story_id for r in similarity.match_snapshot(a, w, block_rows=25).collect()}
    assert got == match_loop(arts, wins, False) and got


def test_keyword_candidates_are_exact_and_few(spark):
    """Unrelated articles and stories with frequent words do not become candidates; only pairs with two common keywords do."""
    arts, wins, a, w = worded(spark, 21, 1.0, 1.0)
    counts = {}
    for i, _, kw in arts:
        for s, meant, _ in wins:
            hits = sum(k in meant for k in kw[:8])
            if hits >= 2:
                counts[i, s] = hits
    for split in (7, 2000):
        assert {(r.id, r.story_id): r.hits for r in similarity.keyword_candidates(a, w, split_rows=split).collect()} == counts
    many = spark.range(4000).selectExpr("id", "array('news', concat('a', id)) AS keywords")
    stories = spark.range(500).selectExpr("id AS story_id", "array('news', concat('a', 8 * id), concat('b', id)) AS keywords")
    assert similarity.keyword_candidates(many, stories).count() == 500  # 'news' alone would give two million
    assert similarity.least_hits(0.75) == 2 and similarity.least_hits(0.65) == 0


def test_reachable_pairs_follow_chains(spark):
    """An article far from the story is reached over an earlier article, and not over a later one."""
    def at(degrees):
        return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]

    kw = ["x", "y", "z"]
    a = spark.createDataFrame([(1, at(30), kw), (2, at(60), kw), (3, at(120), kw), (4, at(91), kw), (5, at(60), ["x"])], "id long, embedding array<double>, keywords array<string>")
    w = spark.createDataFrame([(7, kw, [at(0)])], "story_id long, keywords array<string>, vectors array<array<double>>")
    nobody = a.select("id").limit(0)
    for split in (1, 2000):
        assert sorted(r.id for r in similarity.reachable_pairs(a, w, nobody, split_rows=split).collect()) == [1, 2, 4]


@pytest.mark.parametrize("seed,cosine,chunk", [(1, 0.8, 20), (2, 0.6, 37), (3, 0.95, 11)])
def test_chunk_pairs_keep_every_similar_pair(spark, seed, cosine, chunk):
    vs = vectors(seed, 300, 12, dim=24, noise=0.25)
    vs |= {300 + i: vs[0] for i in range(60)}  # a group of copies larger than a chunk
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vs.items()] + [(999, [0.0] * 24)], "id long, embedding array<double>").repartition(4)
    rows = vectorgrid.chunk_pairs(df, cosine, chunk).collect()
    cells, chunk_of = {}, {}
    for r in rows:
        cells.setdefault((r.p, r.q), set()).add(r.id)
        chunk_of[r.id] = r.chunk
    u = {i: unit(v) for i, v in vs.items()}
    for i in u:
        for j in u:
            if i <= j and u[i] @ u[j] >= cosine:
                key = tuple(sorted((chunk_of[i], chunk_of[j])))
                assert {i, j} <= cells[key]
    chunks = len(set(chunk_of.values()))
    copies = len(rows) / len(u)
    assert 999 not in chunk_of and chunks > len(u) / chunk
    if cosine > 0.7:
        assert copies < chunks / 2, (copies, chunks)


def test_pruning_needs_an_acute_angle(spark):
    with pytest.raises(ValueError):
        vectorgrid.chunk_pairs(spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>"), 0.0, 10)


@pytest.mark.parametrize("seed,block", [(1, 2000), (2, 30)])
def test_snapshot_match(spark, seed, block):
    arts, wins, a, w = match_input(spark, seed)
    got = {r.id: r.story_id for r in similarity.match_snapshot(a, w, block_rows=block).collect()}
    assert got == match_loop(arts, wins, False)


@pytest.mark.parametrize("seed,block,chunk", [(1, 2000, 2000), (2, 30, 9)])
def test_sequential_match(spark, seed, block, chunk):
    arts, wins, a, w = match_input(spark, seed)
    got = {r.id: r.story_id for r in similarity.match_sequential(a, w, block_rows=block, chunk_rows=chunk).collect()}
    expected = match_loop(arts, wins, True)
    assert got == expected and got


def test_no_stories_and_no_articles(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0], ["x"])], "id long, embedding array<double>, keywords array<string>")
    w = spark.createDataFrame([], "story_id long, keywords array<string>, vectors array<array<double>>")
    assert similarity.match_sequential(a, w).count() == 0
    assert similarity.match_snapshot(a, w).count() == 0
    assert similarity.cluster_articles(a.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(60)], "node string")
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(59) if i != 29], "a string, b string")
    got = {r.node: r.component for r in similarity.connected_components(nodes, edges).collect()}
    assert set(got.values()) == {"000", "030"} and got["059"] == "030"
