"""Model input and output: request text, response parsing, batch scoring with a user function."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config, rules, schemas
from ..functions import scalars as S
from ..session import cut, drop_cut
from . import filters, numbering

col = F.col
SALTS = 16
SERVER_ERROR = "llm_server_error"  # stands for the answer of a request that failed


# ---- classification ---------------------------------------------------------------------

def _number_text(c: Column) -> Column:
    """Plain number text: no trailing ``.0`` on whole numbers."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def _framed(frame: tuple[str, str], value: Column) -> Column:
    return F.concat(F.lit(frame[0]), value, F.lit(frame[1]))


def signal_line() -> Column:
    """Optional source signals of an article in one line; empty when there are none."""
    entities = F.array_join(
        F.transform(F.slice("api_entities", 1, 5), lambda e: F.concat(e["name"], F.lit(" ("), e["type"], F.lit(")"))), ", ")
    iptc = S.blank_to_null(col("api_iptc_category"))
    total = S.context_len(col("description"), col("content"))
    signals = {
        "iptc": iptc,
        "entities": F.when(F.size("api_entities") > 0, entities),
        "sentiment": _number_text(col("api_sentiment")),
        "relevance": _number_text(col("api_relevance_score")),
        "authority": col("api_source_priority").cast("string"),
        "keywords": F.when(F.size("api_keywords") > 0, F.array_join(F.slice("api_keywords", 1, 8), ", ")),
        "category": F.when(iptc.isNull(), S.blank_to_null(col("api_category"))),
        "country": S.blank_to_null(col("api_country")),
    }
    short = F.when(total < 200, _framed(rules.SHORT_SNIPPET, total.cast("string")))
    parts = F.concat_ws(" | ", *[_labelled(label, signals[name]) for name, label in rules.SIGNAL_LABELS.items()], short)
    return F.when(parts != "", _framed(rules.SIGNAL_FRAME, parts)).otherwise("")


def article_block(number: Column) -> Column:
    unknown = F.lit(rules.UNKNOWN_VALUE)
    lines = {
        "title": col("title"),
        "description": S.blank_to_null(F.substring("description", 1, 500)),
        "content": S.blank_to_null(F.substring("content", 1, 1000)),
        "source": F.coalesce(S.blank_to_null(col("source_domain")), unknown),
        "published": F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), unknown),
    }
    labelled = [_labelled(label, lines[name]) for name, label in rules.REQUEST_LINES.items()]
    return F.concat_ws("\n", _framed(("[", "]"), number.cast("string")), *labelled, S.blank_to_null(signal_line()))


def classify_requests(articles: DataFrame, id_col: str = "id", size: int = config.CLASSIFY_BATCH) -> DataFrame:
    """(batch_id, n, request): numbered article blocks, five per request."""
    batched = numbering.batch_number(articles, id_col, size, store=True)
    blocks = batched.select("batch_id", "pos", article_block(col("pos") + 1).alias("block"))
    grouped = blocks.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("l"))
    return grouped.select(
        "batch_id", "n",
        F.concat(_framed(rules.REQUEST_HEAD, col("n").cast("string")), F.array_join("l.block", "\n\n")).alias("request"))


def unfence(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\n?", ""), r"\n?```$", "")


def is_json(answer: object) -> bool:
    """Can the answer be read, with or without its fence?"""
    try:
        json.loads(re.sub(r"^```(?:json)?\n?|\n?```$", "", str(answer)))
        return True
    except ValueError:
        return False


def parse_classification(batches: DataFrame) -> DataFrame:
    """(batch_id, pos, llm_tier, llm_category, llm_reason, filter_status) for batches of
    (batch_id, n, response). A failed call gives ``llm_server_error``, a response that is not a JSON array ``llm_parse_error``, one
    of the wrong length ``llm_count_mismatch``; both reject the whole batch as tier C."""
    text = unfence(col("response"))
    results = F.from_json(text, schemas.CLASSIFICATION)
    readable = F.try_parse_json(text).isNotNull()
    failure = F.when(col("response") == SERVER_ERROR, "llm_server_error").when(~F.coalesce(readable, F.lit(False)), "llm_parse_error").when(
        ~F.coalesce(F.json_array_length(text) == col("n"), F.lit(False)), "llm_count_mismatch")
    rows = batches.select("batch_id", failure.alias("failure"), results.alias("results"),
                          F.explode(F.sequence(F.lit(0), (col("n") - 1).cast("int"))).alias("pos"))
    r = F.when(col("failure").isNull(), F.get("results", col("pos")))
    tier = F.when(r["tier"].isin(*config.TIERS), r["tier"]).otherwise("C")
    return rows.select(
        "batch_id", col("pos").cast("long").alias("pos"), tier.alias("llm_tier"),
        F.when(r["category"].isin(*config.CATEGORIES), r["category"]).otherwise("none").alias("llm_category"),
        F.coalesce("failure", F.substring(r["reason"], 1, 200), F.lit("no_reason")).alias("llm_reason"),
        filters.filter_status(tier).alias("filter_status"),
    )


def merge_results(batched: DataFrame, results: DataFrame) -> DataFrame:
    return batched.join(results, ["batch_id", "pos"])


# ---- batch scoring ----------------------------------------------------------------------

def score_batches(df: DataFrame, model: Callable[[list[str]], list], text: str, id_col: str, out_type: str,
                  fallback=None, size: int = config.EMBED_BATCH, readable: Callable[[object], bool] | None = None) -> DataFrame:
    """(id, output): ``model`` maps a list of texts to a list of results, called per batch
    inside the tasks. A batch that raises or answers in the wrong length is asked again text by text; a text that
    fails alone gives ``fallback``, the others go on. A result that ``readable`` refuses is asked for once more."""

    def ask(texts: list[str]) -> list:
        try:
            got = list(model(texts))
            if len(got) != len(texts):
                raise ValueError("wrong number of results")
            return got
        except Exception as error:  # a failed batch must not stop the job
            print(f"batch failed: {error}")
            return [fallback] if len(texts) == 1 else [x for t in texts for x in ask([t])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), size):
                part = pdf.iloc[start:start + size]
                texts = part["text"].tolist()
                got = ask(texts)
                if readable is not None:
                    got = [g if g == fallback or readable(g) else ask([t])[0] for g, t in zip(got, texts)]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "output": pd.Series(got, dtype=object).to_numpy()})

    rows = df.select(col(id_col).alias("id"), col(text).alias("text"))
    return rows.mapInPandas(run, f"id long, output {out_type}").withColumnRenamed("id", id_col)


def embed_missing(articles: DataFrame, model: Callable[[list[str]], list], size: int = config.EMBED_BATCH) -> DataFrame:
    """(id, embedding) for articles without one."""
    todo = articles.filter(col("embedding").isNull()).select(
        "id", S.embedding_input(col("title"), col("full_text"), col("content"), col("description")).alias("text"))
    return score_batches(todo, model, "text", "id", "array<double>", size=size).withColumnRenamed("output", "embedding")


# ---- summaries and titles ---------------------------------------------------------------

def summary_requests(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, request) for ids that have a usable text."""
    text = S.best_text(col("full_text"), col("content"), col("description"))
    rows = articles.join(ids.select("id"), "id", "left_semi").select("id", "title", text.alias("text")).filter(col("text").isNotNull())
    return rows.select("id", F.concat(F.lit("Title: "), "title", F.lit("\n\n"), "text").alias("request"))


def title_context(articles: DataFrame, limit: int = 10) -> DataFrame:
    """(story_id, context): numbered titles with short descriptions of the best articles."""
    rows = articles.filter(col("story_id").isNotNull() & (col("filter_status") == "accepted"))
    top = numbering.top_per_key(rows, ["story_id"], [col("importance_score").desc_nulls_last(), col("published_at").desc(), col("id")], limit)
    desc = F.concat(F.lit(" — "), S.trim_ws(F.substring(S.blank_to_null(col("description")), 1, 150)))
    line = F.concat(col("rank").cast("string"), F.lit(". "), "title", F.coalesce(desc, F.lit("")))
    return top.select("story_id", "rank", line.alias("line")).groupBy("story_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("l")).select("story_id", F.array_join("l.line", "\n").alias("context"))


def clean_title(raw: Column) -> Column:
    bare = F.regexp_replace(S.trim_ws(raw), "^[\"'“”‘’]+|[\"'“”‘’]+$", "")
    return S.blank_to_null(S.trim_ws(bare))


def story_titles(stories: DataFrame, produced: DataFrame) -> DataFrame:
    """(id, title): the existing non-blank title, else the cleaned produced one."""
    made = produced.select("id", col("title").alias("_made"))
    return stories.join(made, "id", "left").select(
        "id", F.coalesce(S.blank_to_null(S.trim_ws(col("title"))), clean_title(col("_made"))).alias("title"))


def title_from_summary(summary: Column) -> Column:
    first = F.get(F.split(summary, "\n"), F.lit(0))
    return F.substring(F.regexp_replace(first, r"^[•\-*]\s*", ""), 1, 500)


def two_level_summary(articles: DataFrame, model: Callable[[list[str]], list], size: int = config.SUMMARY_BATCH) -> DataFrame:
    """(story_id, summary, title): articles (story_id, id, text) are summarised one by one, then their summaries by story, in id order; a story
    of one article keeps that summary. Rows without a story take no part.

    A request holds ``size`` summaries at most. The summaries of a larger story are summarised in batches, and those again, until one is
    left, so a story that holds a third of all articles is spread over as many rows as any other articles; a batch of one keeps its text."""
    single = score_batches(articles, model, "text", "id", "string")
    rows = cut(articles.filter(col("story_id").isNotNull()).select("id", "story_id").join(single, "id").select("story_id", "id", col("output").alias("text")))
    finished = []
    while True:
        placed = cut(numbering.ordered_number(rows.select("story_id", "id"), [col("story_id"), col("id")], "no"))
        # The start of a story is copied to a fixed number of salts, so that the rows of a large one do not meet to learn it.
        starts = placed.groupBy("story_id").agg(F.min("no").alias("start"), F.count(F.lit(1)).alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        batched = placed.withColumn("salt", F.pmod("no", F.lit(SALTS)).cast("int")).join(starts, ["story_id", "salt"]).select(
            "story_id", "id", "no", "n", F.floor((col("no") - col("start")) / size).alias("batch"))
        groups = cut(rows.join(batched, ["story_id", "id"]).groupBy("story_id", "n", "batch").agg(
            F.count(F.lit(1)).alias("here"), F.min("no").alias("id"), F.sort_array(F.collect_list(F.struct("no", "text"))).alias("l"),
        ).select("story_id", "n", "id", "here", F.array_join("l.text", "\n\n").alias("text")))
        many = score_batches(groups.filter(col("here") > 1), model, "text", "id", "string")
        said = cut(groups.join(many, "id", "left").select("story_id", "n", "id", F.when(col("here") == 1, col("text")).otherwise(col("output")).alias("text")))
        drop_cut(placed)
        drop_cut(groups)
        finished.append(said.filter(col("n") <= size).select("story_id", col("text").alias("summary")))
        rows = said.filter(col("n") > size).select("story_id", "id", "text")
        if rows.isEmpty():
            done = reduce(DataFrame.unionByName, finished)
            return done.select("story_id", "summary", title_from_summary(col("summary")).alias("title"))
