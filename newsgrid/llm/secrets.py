"""Secrets in texts, told from copied examples by who owns them.

Candidates are found by patterns with built-in functions only. Their hashes are counted over distinct repositories and owners of the
whole corpus: a value that many owners share, or that stands in many repositories whoever owns them, is a copied example; one of few owners
and few repositories that looks random may be live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# The kinds in the order in which equal starts are listed, each with its pattern, the group that
# holds the value, and the least length of that value. The look-ahead only spares the alternatives at other letters.
KINDS: list[tuple[str, str, int, int]] = [
    ("assign", r"""(?=[PpSsTtAa])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # Runs are maximal either way, so the least length can stand in the pattern.
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("prefixed", r"(?=[gxsAe])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{24,}|AIza[A-Za-z0-9_-]{35,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,})", 0, 12),
]
BASE = 3
#: Matches of a text that are gathered at once.
BLOCK = 256
#: Owners and repositories from which on a value is a copied example, either of them, and distinct characters from which on it looks random.
#: One owner may hold a live value in a few places, so more repositories than owners are needed.
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 10
RANDOM_CHARS = 8
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|xxxx|1234567|your[_-]?"


ROW = "array<struct<start: long, kind: int, end: long, value: string>>"
HELD = ROW.replace(">>", ", owners: long, repositories: long>>")
PARTS = "array<struct<before: int, whole: int, value: string>>"


def _parts(text: Column, number: int) -> Column:
    """The matches of one kind, leftmost and not overlapping: code points of the text before each since the last one, code points of the
    match, and its value. Most texts have none and are read once."""
    _, pattern, group, _ = KINDS[number]
    p = F.lit(pattern)
    before = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x))
    # There is one piece of text more than matches; the zip is cut to the matches.
    parts = F.slice(F.arrays_zip(before.alias("before"), whole.alias("whole"), F.regexp_extract_all(text, p, F.lit(group)).alias("value")), F.lit(1), F.size(whole))
    return F.when(text.rlike(pattern), parts.cast(PARTS)).otherwise(F.array().cast(PARTS))


def _find(parts: Column, number: int) -> Column:
    """Array of (start, kind, end, value) of the matches whose value is long enough; places count code points from 0."""
    least = KINDS[number][3]
    none = F.array().cast(ROW)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["before"]
        end = (start + x["whole"]).cast("long")
        hit = F.struct(start.cast("long").alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(state["found"], F.array(hit))).otherwise(state["found"]).cast(ROW).alias("found"))

    def block(state: Column, no: Column) -> Column:
        """The matches of one block, gathered apart, so that the long list is copied once a block and not once a match."""
        inner = F.aggregate(F.slice(parts, no * BLOCK + 1, F.lit(BLOCK)), F.struct(state["at"].alias("at"), none.alias("found")), step)
        return F.struct(inner["at"].alias("at"), F.concat(state["found"], inner["found"]).cast(ROW).alias("found"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))
    return F.when(F.size(parts) > 0, F.aggregate(blocks, zero, block, lambda state: state["found"])).otherwise(none)


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def candidates(docs: DataFrame, names: list[Column]) -> DataFrame:
    """The columns ``names`` of ``docs`` and ``found``: all matches by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(*names, *[_parts(text, i).alias(f"_parts{i}") for i in range(len(KINDS))])
    found = F.concat(*[_find(F.col(f"_parts{i}"), i) for i in range(len(KINDS))])
    return parts.select(*[c for c in parts.columns if not c.startswith("_parts")], F.array_sort(found).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) from rows (hash, owner, repository): distinct owners and repositories of each value."""
    return found.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """(doc_id, found, n_live, n_copied) for every row of ``docs`` (doc_id, text and the columns that name owner and repository).

    ``found`` lists (start, kind, end, value, owners, repositories), the last two being the distinct ones of the value in all of ``docs``. ``n_copied``
    counts its values that at least ``copied_owners`` owners or ``copied_repositories`` repositories hold or that name themselves an example, ``n_live``
    the others that look random. A null text is empty; a missing owner or repository is not counted as one, so values without an owner
    are judged by their repositories alone. Repeated rows come back as often as they came; an empty table gives no rows.
    """
    names = [F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository")]
    rows = cut(candidates(docs, names).withColumn("row", F.monotonically_increasing_id()))
    single = rows.select("row", "owner", "repository", F.posexplode("found").alias("place", "x")).select(
        "row", "owner", "repository", "place", F.col("x.value").alias("value"), F.sha2(F.col("x.value"), 256).alias("hash"))
    owned = ownership(single)
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories) | F.col("value").rlike(PLACEHOLDER)
    random = F.size(F.array_distinct(F.split("value", ""))) >= RANDOM_CHARS
    judged = single.join(owned, "hash").groupBy("row").agg(
        F.sum((~copied & random).cast("long")).alias("n_live"), F.sum(copied.cast("long")).alias("n_copied"),
        F.array_sort(F.collect_list(F.struct("place", "owners", "repositories"))).alias("held"))
    # Every match has its counts, in the order of the matches.
    found = F.transform(F.arrays_zip("found", "held"), lambda x: F.struct(*[x["found"][n].alias(n) for n in ("start", "kind", "end", "value")], *[x["held"][n].alias(n) for n in ("owners", "repositories")]))
    return rows.join(judged, "row", "left").select(
        "doc_id", F.when(F.col("held").isNotNull(), found).otherwise(F.array().cast(HELD)).alias("found"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))


def counted(found: DataFrame) -> DataFrame:
    """The result of :func:`scan` with counts for each base kind and the lists of spans."""
    base = F.filter("found", lambda x: x["kind"] < BASE)
    of_kind = F.transform("found", lambda x: x["kind"])
    number = [F.size(F.filter(of_kind, lambda k: k == kind)).cast("long").alias(f"n_{KINDS[kind][0]}") for kind in range(BASE)]
    return found.select("doc_id", *number, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "n_live", "n_copied")
