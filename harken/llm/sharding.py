"""Sharding (operator 4): a keyed Feistel permutation of global row numbers gives every row its shard and slot.

Rows are numbered 0..n-1 in one order that the rows alone decide: by a hash bucket of key, size and checksum, then inside the bucket by
these. Equal rows are one counted row until they get their numbers, which come from a window over the bucket and the buckets' offsets
from one small table of counts, so no task sees more than a bucket. The permutation maps [0, a) x [0, b) onto itself with
a * b >= n; a position beyond the last row walks on along its cycle until it is inside (cycle walking). Position p lies in
shard p mod k at slot p div k, so the rows per shard differ by one at most and the slots have no gap. Anyone who knows n,
the seed and a row's number can compute its place without the data.

Edge cases: a null text has size 1 and the checksum of the empty text; null or repeated keys are ordinary rows (rows that
agree in key, size and checksum may swap their places, which no reader can tell); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

#: Rows are numbered inside hash buckets, at least BUCKETS and then as many as hold about BUCKET_ROWS each; the table of the buckets'
#: counts is broadcast, and has never more than MOST_BUCKETS rows.
BUCKETS, BUCKET_ROWS, MOST_BUCKETS = 4096, 100_000, 1 << 20
#: Numbers of equal rows that are made at once.
RUN = 100_000
ROUNDS = 6
#: Steps of cycle walking. Fewer than sqrt(n) of the a * b positions lie outside, so the odds of 64 in a row
#: are below n ** -32; should it happen, the query fails rather than give a wrong place.
WALK = 64


def permuted(number: Column, n: Column, seed: int) -> Column:
    """The keyed permutation of 0..n-1, as an expression. One round adds a hash of one half to the other half."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def turn(acc: Column, i: Column) -> Column:
        left, right = acc["l"], acc["r"]
        new_l = F.when(i % 2 == 0, (left + F.pmod(F.xxhash64(F.lit(seed), i, right), a)) % a).otherwise(left)
        new_r = F.when(i % 2 == 1, (right + F.pmod(F.xxhash64(F.lit(seed), i, left), b)) % b).otherwise(right)
        return F.struct(new_l.alias("l"), new_r.alias("r"))

    def cipher(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: acc["l"] * b + acc["r"])

    outside = F.lit(-1).cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        F.struct(outside.alias("done"), number.alias("at")),
        lambda acc, i: F.when(acc["done"] >= 0, acc).otherwise(
            F.aggregate(F.array(cipher(acc["at"])), acc, lambda _, y: F.struct(F.when(y < n, y).otherwise(outside).alias("done"), y.alias("at")))
        ),
        lambda acc: acc["done"],
    )
    return F.when(walked >= 0, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def numbered(rows: DataFrame, cols: list[str]) -> DataFrame:
    """``cols`` of each row with ``row_number`` (from 0) and ``n_rows``, in an order that the rows alone decide.

    Rows that are equal in all of ``cols`` are counted before anything is shuffled by them and told apart only at the end, so neither a
    null nor an often repeated row is a hot key.
    """
    kinds = written(rows.sparkSession, rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")), "row-kinds")
    buckets = min(MOST_BUCKETS, max(BUCKETS, kinds.count() // BUCKET_ROWS))
    kinds = kinds.withColumn("_bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int"))
    counts = kinds.groupBy("_bucket").agg(F.sum("_n").alias("_all"))
    every = Window.partitionBy(F.lit(0))  # of the at most MOST_BUCKETS rows of counts
    offsets = counts.select(
        "_bucket",
        (F.sum("_all").over(every.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_all")).alias("_offset"),
        F.sum("_all").over(every).alias("n_rows"),
    )
    inside = Window.partitionBy("_bucket").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    out = kinds.withColumn("_at", F.sum("_n").over(inside) - F.col("_n")).join(F.broadcast(offsets), "_bucket")
    # the numbers of equal rows in runs, which many tasks share where there are more than one
    out = out.select(*cols, "n_rows", (F.col("_offset") + F.col("_at")).alias("_from"), "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))).alias("_run"))
    out = out.withColumns({"_from": F.col("_from") + F.col("_run") * RUN, "_n": F.least(F.lit(RUN), F.col("_n") - F.col("_run") * RUN)})
    if kinds.where(F.col("_n") > RUN).limit(1).count():
        out = out.repartition("_from")
    return out.select(*cols, "n_rows", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_n") - 1)).alias("row_number"))


def shard(docs: DataFrame, shards: int = 8, seed: int = 20240131, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, row_number, shard, slot."""
    rows = docs.select(
        F.col(key),
        (F.octet_length(text_of(text_col)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_of(text_col), "UTF-8")).alias("text_crc32"),
    )
    rows = numbered(rows, [key, "size", "text_crc32"])
    rows = rows.withColumn("_place", permuted(F.col("row_number"), F.col("n_rows"), seed))
    return rows.select(
        key,
        "size",
        "text_crc32",
        "row_number",
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
    )
