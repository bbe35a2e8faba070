"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments of 16 bits. A code within distance m*(r+1)-1 of a query, for m segments, agrees with it up to r bits in some
segment. The search radius inside the segments grows step by step; a query is finished when its k-th verified distance is within what
the radius covers for certain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop_cut

SEGMENT = 16
WORD = 64


def binary_code(vector: Column) -> Column:
    """One bit for each dimension, set if positive, as an array of 64-bit words. Null for a null or empty vector."""
    words = F.ceil(F.size(vector) / WORD).cast("int")
    zero = F.lit(0).cast("long")

    def word(w: Column) -> Column:
        part = F.slice(vector, w * WORD + 1, F.lit(WORD))
        return F.aggregate(F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero)), zero, lambda a, b: a.bitwiseOR(b))

    return F.when(F.size(vector) > 0, F.transform(F.sequence(F.lit(0), words - 1), word))


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dims, code) of all rows with an id and a vector; a repeated id with an equal vector counts once."""
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dims"), binary_code(F.col(vector_col)).alias("code")).filter(
        F.col("id").isNotNull() & F.col("code").isNotNull())


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _keys(code: Column, dims: Column) -> Column:
    """Array with one number for each segment of a code, made of the dimensions, the segment's place and its value."""
    def one(no: Column) -> Column:
        word = F.element_at(code, F.floor(no / (WORD // SEGMENT)).cast("int") + 1)
        value = F.call_function("shiftright", word, F.pmod(no, F.lit(WORD // SEGMENT)) * SEGMENT).bitwiseAND(F.lit(0xFFFF))
        return (dims.cast("long") * (1 << 32) + no * (1 << 16) + value).cast("long")

    return F.transform(F.sequence(F.lit(0), F.ceil(dims / SEGMENT).cast("int") - 1), one)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, neighbour_id, distance, rank): for every row of ``queries`` the ``k`` rows of ``vectors`` with the least Hamming distance,
    itself left out, ties by the smaller id.

    Only vectors of equally many dimensions are compared. Rows without an id or a vector take no part; a table with fewer than k others gives
    all of them. Equal codes are one entry of the index with their k+1 smallest ids, which is all that an answer can need of them, so
    a code that a third of all rows share costs no more than another. An id stands for one vector: of several the index holds each.
    """
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(codes(vectors, id_col, vector_col).distinct())
    asked = codes(queries, id_col, vector_col).select(F.col("id").alias("query_id"), "dims", "code").distinct()
    held = rows.withColumn("no", F.row_number().over(W.partitionBy("dims", "code").orderBy("id"))).filter(F.col("no") <= k + 1)
    entries = cut(held.groupBy("dims", "code").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("entry", F.monotonically_increasing_id()))
    index = cut(entries.select("entry", F.explode(_keys(F.col("code"), F.col("dims"))).alias("key")))
    size = rows.groupBy("dims").agg((F.count(F.lit(1)) - 1).alias("others"))
    open_queries = cut(asked.join(size, "dims").filter("others > 0").withColumn("wanted", F.least(F.lit(k), "others")).withColumn("query", F.monotonically_increasing_id()))
    best, answers = None, []
    for radius in range(SEGMENT + 1):
        if open_queries.isEmpty():
            break
        flips = F.filter(F.sequence(F.lit(0), F.lit(0xFFFF)), lambda x: F.bit_count(x) == radius)
        probes = open_queries.repartition(tasks, "query").select("query", F.explode(_keys(F.col("code"), F.col("dims"))).alias("key")).select(
            "query", F.explode(flips).alias("flip"), "key").select("query", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
        # The probes are listed on the way, so their number is not in any estimate: they are never broadcast.
        met = probes.hint("merge").join(index, "key").select("query", "entry").distinct()
        near = met.join(entries.select("entry", F.col("code").alias("other"), F.col("ids")[0].alias("least")), "entry").join(open_queries.select("query", "code"), "query").select(
            "query", "entry", "least", distance(F.col("code"), F.col("other")).alias("distance"))
        if best is not None:
            near = near.unionByName(best).distinct()
        # Of k+1 entries in this order each holds an id before any of a later entry, and one of them at most is the query itself.
        first = F.row_number().over(W.partitionBy("query").orderBy("distance", "least"))
        fresh = cut(near.withColumn("no", first).filter(F.col("no") <= k + 1).drop("no"))
        drop_cut(best)
        best = fresh
        named = best.join(entries.select("entry", "ids"), "entry").join(open_queries.select("query", "query_id", "dims", "wanted"), "query")
        ranked = named.select("query", "query_id", "dims", "wanted", "distance", F.explode("ids").alias("neighbour_id")).filter("neighbour_id <> query_id").withColumn(
            "rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbour_id"))).filter(F.col("rank") <= k)
        state = cut(ranked)
        covered = F.ceil(F.col("dims") / SEGMENT) * (radius + 1) - 1
        closed = cut(state.groupBy("query", "dims", "wanted").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("furthest")).filter(
            (F.col("n") >= F.col("wanted")) & ((F.col("furthest") <= covered) | F.lit(radius == SEGMENT))).select("query"))
        answers.append(state.join(closed, "query", "left_semi").select("query_id", "neighbour_id", "distance", "rank"))
        open_queries = cut(open_queries.join(closed, "query", "left_anti"))
        best = cut(best.join(closed, "query", "left_anti"))
    if not answers:
        return rows.filter("false").select(F.col("id").alias("query_id"), F.col("id").alias("neighbour_id"), F.lit(0).alias("distance"), F.lit(0).alias("rank"))
    return reduce(DataFrame.unionByName, answers)
