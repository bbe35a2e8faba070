"""Golden cases of rules and scalar functions."""

import pytest
from pyspark.sql import functions as F

from newsgrid.functions import scalars as S
from newsgrid.functions import vectors as V
from newsgrid.operators import filters, modelio

TITLES = {
    "India 3-1 Pakistan": False,
    "India beat Pakistan 3-1": True,
    "India vs Australia": True,
    "State vs Smith: court hears the case": False,
    "10 best restaurants in town": True,
    "2 killed in accident": False,
    "LIVE updates: the debate": True,
    "Watch now: the speech": True,
    "Nobel winner passed away": False,
    "Local singer passed away": True,
    "Will this change everything??": True,
    "Review: a new phone": True,
    "Extreme weather causes damage": False,
    "Weather: rain tomorrow": True,
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("title,rejected", TITLES.items())
def test_title_patterns(spark, title, rejected):
    assert one(spark, filters.rejected_title(F.lit(title))) is rejected


@pytest.mark.parametrize("text,hit", [
    ("Global widget repair market size worth a lot", True), ("Government announces new tax policy", True),
    ("Government announces a tax policy", False), ("Short Interest in Acme (NYSE) rises", True), ("Netizens were amused", True),
])
def test_templates(spark, text, hit):
    assert one(spark, filters.templated_text(F.lit(None).cast("string"), F.lit(text))) is hit


@pytest.mark.parametrize("url,expected", [
    ("HTTPS://WWW.Example.com/a/b//?q=1#z", "https://example.com/a/b"),
    ("http://example.com", "https://example.com"),
    ("Not A Url", "not a url"),
])
def test_normalize_url(spark, url, expected):
    assert one(spark, S.normalize_url(F.lit(url))) == expected


def test_title_functions(spark):
    assert one(spark, S.normalize_title(F.lit("  The  Big\tStory: 5% up! "))) == "the big story 5 up"
    assert one(spark, S.trigram_similarity(F.lit("ab"), F.lit("ab"))) is None
    assert one(spark, S.trigram_similarity(F.lit("abcd"), F.lit("ABCE"))) == pytest.approx(1 / 3)
    assert one(spark, F.size(S.packed_trigrams(F.lit("aaaa")))) == 1
    assert one(spark, F.size(S.packed_trigrams(F.lit("ab")))) == 0


def test_script_rule(spark):
    assert one(spark, filters.foreign_script(F.lit("Новости дня сегодня"), F.lit(None).cast("string"))) is True
    assert one(spark, filters.foreign_script(F.lit("Да!"), F.lit(None).cast("string"))) is False
    assert one(spark, filters.foreign_script(F.lit("Señor niño está aquí hoy"), F.lit(None).cast("string"))) is False


def test_vectors(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.cosine(a, a)) == pytest.approx(1.0)
    assert one(spark, V.cosine(a, zero)) == 0.0
    with pytest.raises(Exception, match="differ in length"):
        one(spark, V.cosine(a, F.array(F.lit(1.0))))
    assert one(spark, V.max_similarity(a, F.array().cast("array<array<double>>"))) == 0.0
    kws = F.array(F.lit("x"), F.lit("x"), F.lit("y"))
    assert one(spark, V.keyword_score(kws, F.array(F.lit("x")))) == 0.5


def test_text_functions(spark):
    assert one(spark, S.parse_bullets(F.lit("• one\n\n - two\n*\nthree"))) == ["one", "two", "three"]
    assert one(spark, S.repair_text(F.lit("two  hours\nagoRachel Murphy,BBC"))) == "two hours ago Rachel Murphy, BBC"
    assert one(spark, S.strip_boilerplate(F.lit("Also read: x\nbody\n\n\n\n© y\nalsoran"))) == "body\n\nalsoran"
    assert one(spark, modelio.clean_title(F.lit(' "A title" '))) == "A title"
    assert one(spark, modelio.unfence(F.lit("```json\n[1]\n```"))) == "[1]"
    assert one(spark, S.strip_null_chars(F.lit("a\u0000b"))) == "ab"


def test_trigrams_of_wide_characters_and_long_titles(spark):
    """Packed and plain trigrams tell the same texts apart, and long titles take time that is linear in their length."""
    texts = ["a\U0001f600b\U0001f601", "a\U0001f600b\U0001f602", "\U0001f600\U0001f600\U0001f600\U0001f600", "x\ny\nz\n", "ÄÖÜß", "ab", "", None, "word " * 20_000]
    df = spark.createDataFrame([(t, u) for t in texts for u in texts[:5]], "t string, u string")
    got = df.select(S.trigram_similarity(F.col("t"), F.col("u")).alias("p"), S.set_similarity(S.trigrams(F.col("t")), S.trigrams(F.col("u"))).alias("q"), F.length("t").alias("n"))
    short = got.filter("n IS NULL OR n < 1000").collect()
    assert [r.p for r in short] == [r.q for r in short] and {1.0, 0.0} < {r.p for r in short}
    assert len(got.select("p").collect()) == len(texts) * 5
