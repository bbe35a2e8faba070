"""Page text extraction, bylines, responses, feeds, landed files."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from newsgrid import schemas
from newsgrid.functions import scalars as S
from newsgrid.operators import modelio, textjobs
from newsgrid.plans.views import as_of
from newsgrid.session import cut_counted
from newsgrid.sources import feeds, landed
from newsgrid.streaming import ingest

col = F.col

HTML = """<html><body><nav><p>menu</p></nav><article><h1>Title</h1><span class="byline">Jane Doe</span><p>Jane Doe</p>
<p>Published 2 hours ago</p><h2>Part one</h2><p>First <b>paragraph</b> with enough words to be kept as text.<p>Second paragraph, not closed
<blockquote>A quote.</blockquote><script>var x = "<p>no</p>";</script></article><footer><p>end</p></footer></body></html>"""


def test_page_text(spark):
    pages = spark.createDataFrame([(1, HTML), (2, "<p>short</p>"), (3, None)], "page_id long, html string")
    rows = {r.page_id: r for r in textjobs.page_texts(pages).collect()}
    assert rows[1].text == ("###HEADING:###Part one\n\nFirst paragraph with enough words to be kept as text.\n\n"
                            "Second paragraph, not closed A quote.\n\nA quote.")
    assert (rows[1].byline, rows[1].status) == ("Jane Doe", "thin")
    assert rows[2].text is None and rows[2].status == "failed"
    assert rows[3].text is None and rows[3].status == "failed"


def test_bylines_are_kept_when_too_much_would_go(spark):
    df = spark.createDataFrame([("Jane Doe\n\nx",), ("Jane Doe\n\n" + "long text " * 10,)], "t string").withColumn("b", F.lit("Jane Doe"))
    got = {r.t for r in textjobs.strip_bylines(df, "t", "b").collect()}
    assert got == {"Jane Doe\n\nx", "long text " * 10}


def test_responses(spark):
    good = [{"tier": "A", "category": "policy", "reason": "r" * 300}, {"tier": "Z", "category": "x"}]
    rows = [(1, 2, json.dumps(good)), (2, 2, "```json\n" + json.dumps(good) + "\n```"), (3, 3, json.dumps(good)), (4, 1, "no json"), (5, 1, None), (6, 1, "{}")]
    out = modelio.parse_classification(spark.createDataFrame(rows, "batch_id long, n long, response string")).collect()
    by = {(r.batch_id, r.pos): r for r in out}
    for b in (1, 2):
        assert (by[b, 0].llm_tier, by[b, 0].llm_category, len(by[b, 0].llm_reason)) == ("A", "policy", 200)
        assert (by[b, 1].llm_tier, by[b, 1].llm_category, by[b, 1].llm_reason) == ("C", "none", "no_reason")
    assert {by[3, i].llm_reason for i in range(3)} == {"llm_count_mismatch"}
    assert by[4, 0].llm_reason == by[5, 0].llm_reason == "llm_parse_error"
    assert by[6, 0].llm_reason == "llm_count_mismatch"
    assert {r.filter_status for r in out} == {"accepted", "rejected"}


def test_failed_batches_fall_back(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(6)], "id long, text string").coalesce(1)
    got = {r.id: r.output for r in modelio.score_batches(df, model, "text", "id", "string", fallback="?", size=2).collect()}
    assert got == {0: "T0", 1: "T1", 2: "T2", 3: "?", 4: "T4", 5: "T5"}


def test_unreadable_answers_are_asked_for_once_more(spark):
    df = spark.createDataFrame([(1, "good"), (2, "odd")], "id long, text string").coalesce(1)

    def model(texts, seen=[]):  # noqa: B006 - counts the calls of one task
        seen.extend(texts)
        return ["[]" if t == "good" or seen.count(t) > 1 else "no json" for t in texts]

    got = {r.id: r.output for r in modelio.score_batches(df, model, "text", "id", "string", fallback="?", readable=modelio.is_json).collect()}
    assert got == {1: "[]", 2: "[]"}
    failed = spark.createDataFrame([(1, 2, modelio.SERVER_ERROR)], "batch_id long, n int, response string")
    assert {r.llm_reason for r in modelio.parse_classification(failed).collect()} == {"llm_server_error"}


def test_feeds(spark):
    rss = "<rss><channel>" + "".join(
        f"<item><title>T{i}</title><link>https://x.com/{i}</link><description>&lt;b&gt;B{i}&lt;/b&gt;</description></item>" for i in range(31)) + "</channel></rss>"
    atom = '<feed><entry><title type="html">A</title><link href="https://y.com/1"/><updated>2024-01-14T10:00:00Z</updated></entry></feed>'
    single = "<rss><channel><item><title>S</title><link>https://z.com/1</link><pubDate>Sun, 14 Jan 2024 09:30:00 GMT</pubDate></item></channel></rss>"
    frame = spark.createDataFrame([(0, rss), (1, atom), (2, single)], "feed_seq long, xml string")
    items = feeds.feed_items(frame, as_of()).collect()
    assert sum(r.feed_seq == 0 for r in items) == 31
    assert feeds.feed_items(frame, as_of(), feeds.FEED_LIMITS["items_per_feed"]).filter("feed_seq = 0").count() == 30
    first = next(r for r in items if r.feed_seq == 0 and r.item_seq == 0)
    assert (first.title, first.url, first.body, str(first.published_at)) == ("T0", "https://x.com/0", "B0", "2024-01-15 00:00:00")
    entry = next(r for r in items if r.feed_seq == 1)
    assert (entry.title, entry.url, str(entry.published_at)) == ("A", "https://y.com/1", "2024-01-14 10:00:00")
    assert str(next(r for r in items if r.feed_seq == 2).published_at) == "2024-01-14 09:30:00"


def test_landed_files(spark, tmp_path):
    (tmp_path / "page-7.json").write_text(json.dumps({"news": [{"url": "https://a.com/1", "title": "One"}, {"url": "", "title": "x"}]}))
    (tmp_path / "page-8.json").write_text("{broken")
    rows = landed.worldnews(landed.read_landed(spark, str(tmp_path)), as_of()).collect()
    assert [(r.seq, r.url, r.source_domain, str(r.published_at)) for r in rows] == [(0, "https://a.com/1", "a.com", "2024-01-15 00:00:00")]
    broken = landed.corrupt_pages(landed.read_landed(spark, str(tmp_path)), "worldnews").collect()
    assert [(r.source_api, r.page_id, r.raw) for r in broken] == [("worldnews", 1, "{broken")]
    stats = landed.fetch_stats({"worldnews": landed.read_landed(spark, str(tmp_path))}, as_of()).collect()
    assert [(s.raw_count, s.normalized_count, s.corrupt_pages) for s in stats] == [(2, 1, 1)]


@pytest.mark.parametrize("names", [
    ["20240115_a.json", "20240115_b.json"], ["a.json", "b.json"], ["20240115123045.json", "20240115123046.json"], ["page-10.json", "page-9.json"]])
def test_every_landed_file_has_its_own_page(spark, tmp_path, names):
    for i, name in enumerate(names):
        (tmp_path / name).write_text(json.dumps({"news": [{"url": f"https://a.com/{i}", "title": f"Title {i}", "text": "t" * 30}]}))
    pages = landed.read_landed(spark, str(tmp_path))
    assert sorted(r.page_id for r in pages.collect()) == [0, 1]
    rows = landed.first_per_url(landed.worldnews(pages, as_of())).orderBy("seq").collect()
    assert [r.url[-1] for r in rows] == (["1", "0"] if names[0] == "page-10.json" else ["0", "1"])
    streamed = ingest.landed_stream(spark, str(tmp_path))
    query = streamed.writeStream.format("memory").queryName("pages_" + names[0].split(".")[0].replace("-", "_")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table(query.name).select("page_id").distinct().count() == 2


def test_any_social_object_is_kept(spark):
    page = {"posts": [{"url": "https://a.com/1", "title": "T", "thread": {"site": "a.com", "social": {"facebook": {"likes": 3, "note": "x"}, "share": 0.5}}}]}
    row = landed.webzio(spark.createDataFrame([(0, json.dumps(page))], "page_id long, raw string"), as_of()).first()
    assert json.loads(row.api_social) == {"facebook": {"likes": 3, "note": "x"}, "share": 0.5}


def test_zones(spark):
    zones = [(z,) for z in [*S.KNOWN_ZONES, "Foo/Bar", "", "utc+1x"]] + [(None,)]
    rows = spark.createDataFrame(zones, "zone string").select("zone", S.parse_zoned(F.lit("2024-01-10 12:00:00"), col("zone"), as_of()).cast("string").alias("t")).collect()
    by = {r.zone: r.t for r in rows}
    assert by["Foo/Bar"] == by[""] == by[None] == by["utc+1x"] == by["UTC"] == "2024-01-10 12:00:00"
    assert by["America/Argentina/Buenos_Aires"] == "2024-01-10 15:00:00" and by["Etc/GMT+5"] == by["EST"] == "2024-01-10 17:00:00"


def test_page_text_in_forms_and_after_open_navigation():
    blocks = lambda html: [t for _, t in textjobs._page_blocks(html)[1]]
    assert blocks("<form><p>Inside a form.</p></form>") == ["Inside a form."]
    assert blocks("<nav><p>Menu</p><article><p>Text.</p></article>") == ["Text."]
    assert blocks("<div><aside><p>Side</div><p>After.</p>") == ["After."]
    assert blocks("<article><p>Teaser</p></article><article><p>The long story text.</p><p>More.</p></article>") == ["The long story text.", "More."]


def test_unreadable_source_gives_no_rows(spark):
    def broken():
        return spark.read.schema(schemas.WEBZIO_PAGE).json("/no/such/path")

    got = landed.tolerant(spark, {"webzio": broken}, schemas.ARTICLE)
    assert got["webzio"].count() == 0 and got["webzio"].schema == schemas.ARTICLE


def test_summaries_of_a_large_story_go_through_a_tree(spark):
    """No request holds more than the batch size; the result equals the same tree made by a loop."""
    size = 4

    def model(texts):
        out = []
        for t in texts:
            parts = (t or "").split("\n\n")
            if len(parts) > size:
                raise ValueError("a request is too large")
            out.append(f"<{len(parts)}:{parts[0][:9]}.{parts[-1][-9:]}>")
        return out

    stories = {1: range(100, 190), 2: range(0, 4), 3: [500], 4: range(600, 605), 5: range(700, 717)}
    rows = [(s, i, f"text {i}") for s, ids in stories.items() for i in ids] + [(None, 999, "nobody")]

    def tree(texts):
        while len(texts) > 1:
            groups = [texts[k:k + size] for k in range(0, len(texts), size)]
            texts = [g[0] if len(g) == 1 else model(["\n\n".join(g)])[0] for g in groups]
        return texts[0]

    df = spark.createDataFrame(rows, "story_id long, id long, text string").repartition(6)
    got = {r.story_id: r.summary for r in modelio.two_level_summary(df, model, size).collect()}
    assert got == {s: tree([model([f"text {i}"])[0] for i in ids]) for s, ids in stories.items()}
    assert modelio.two_level_summary(df.limit(0), model, size).collect() == []


def test_a_story_of_many_articles_is_spread(spark):
    df = spark.range(20_000).selectExpr("IF(id < 15000, 1, id) AS story_id", "id", "concat('t', id) AS text")
    made = modelio.two_level_summary(df, lambda texts: [str(max(len(t.split("\n\n")) for t in [x])) for x in texts])
    rows = {r.story_id: r.summary for r in made.collect()}
    assert len(rows) == 5001 and rows[1] == "2"  # 150 batches of 100, then two, then one


def _page_files(folder):
    """Two good pages, one cut off in its compressed bytes, one without the list, one that is not JSON, an empty one."""
    page = lambda i: json.dumps({"news": [{"url": f"https://a.com/{i}", "title": f"Title {i}", "text": "t" * 30}]}).encode()
    (folder / "page-1.json").write_bytes(page(1))
    (folder / "page-2.json.gz").write_bytes(gzip.compress(page(2) + random.Random(1).randbytes(5000))[:-2000])
    (folder / "page-3.json").write_bytes(b'{"items": []}')
    (folder / "page-4.json").write_bytes(b"no json")
    (folder / "page-5.json").write_bytes(b"")
    (folder / "page-6.json").write_bytes(page(6))


def test_files_with_faults_become_errors(spark, tmp_path):
    _page_files(tmp_path)
    with pytest.raises(Exception):
        landed.read_landed(spark, str(tmp_path)).collect()
    pages, errors = landed.read_tolerant(spark, "worldnews", str(tmp_path))
    rows = landed.worldnews(pages, as_of()).collect()
    assert sorted((r.url, r.seq // landed.POSITIONS) for r in rows) == [("https://a.com/1", 0), ("https://a.com/6", 4)]
    got = {r.place.rsplit("/", 1)[1]: (r.source_api, r.error) for r in errors.collect()}
    none = ("worldnews", "no list of records")
    assert got == {"page-2.json.gz": ("worldnews", "unreadable"), "page-3.json": none, "page-4.json": none}
    pages, errors = landed.read_tolerant(spark, "webzio", str(tmp_path / "missing"))
    assert pages.count() == 0 and [(r.source_api, r.place) for r in errors.collect()] == [("webzio", str(tmp_path / "missing"))]


def test_a_source_that_fails_while_it_is_read_stops_no_other(spark):
    good = spark.range(3).select(col("id").alias("seq"))
    bad = good.select(F.when(col("seq") < 2, col("seq")).otherwise(F.raise_error(F.lit("lost"))).alias("seq"))
    rows, errors = landed.isolated(spark, {"one": lambda: good, "two": lambda: bad, "three": lambda: good.select("none")}, good.schema)
    assert {n: f.count() for n, f in rows.items()} == {"one": 3, "two": 0, "three": 0}
    assert sorted((r.source_api, r.place) for r in errors.collect()) == [("three", None), ("two", None)]


def test_rows_are_counted_while_they_are_written(spark):
    for n in (0, 7):
        rows, seen = cut_counted(spark.range(n), rows=F.count(F.lit(1)), even=F.count_if(col("id") % 2 == 0))
        assert seen == {"rows": n, "even": (n + 1) // 2} and rows.count() == n
    none, seen = cut_counted(spark.createDataFrame([], "id long").filter("id > 3"), rows=F.count(F.lit(1)))
    assert seen == {"rows": 0} and none.columns == ["id"]
