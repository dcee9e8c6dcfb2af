"""Mixing sources to target weights (operator 9): exact block quotas, split among output shards by a tree.

Each source's documents are dealt by hash into blocks of about BLOCK_ROWS. A source whose target is t times its size
gives every block floor(t) times; the rest comes from its blocks in a keyed random order, and from the one block that does not fit whole,
documents in a keyed random order as long as they fit. So the quota of every source in blocks is exact. A tree
splits the quotas among the output shards: at each node the left half draws its blocks without replacement from the node's, a
multivariate-hypergeometric draw, down to single shards. Each source's block draws, in random order, then fill the shards'
quotas one after another, so that the draws are disjoint, and a shard is shuffled locally: every copy has a keyed place in it.

Sources are a distributed table: targets come from a few sums over it, however many there are. The tree runs on the driver, over one
row per source, or over GROUPS groups of sources where there are more; a group's draws in random order fill its quotas as a source's do,
which is again a draw without replacement. Tables that grow with the sources are broadcast up to FEW rows only. What is ordered within a source,
a group or a shard is ordered in hash buckets of about RUN rows, so that a source with a third of all rows is no hot task. Blocks get larger
with the corpus where their number would go beyond what the hypergeometric generator accepts (DRAWS).

Edge cases: a null text has size 0; a null source is a source, the last; a source of size 0 has the target 0; rows equal in
id and text are taken together or not at all, and may swap their places in a shard; an empty table gives an empty table; input columns
named like a result are replaced.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, nested, restore, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
#: A source is taken this many times at most.
MOST = 3
#: Documents of a block, on average, and the output shards.
BLOCK_ROWS, SHARDS = 128, 16
#: Rows of a table of sources that are broadcast at most, rows of the tree's table, rows that are ordered at once, about.
FEW, GROUPS, RUN = 100_000, 4096, 100_000
#: Block draws of all sources, about; numpy's generator takes less than 10**9.
DRAWS = 300_000_000


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Per group, how many of its blocks each shard gets. Shard totals differ by one at most at every node."""
    out = [[0] * shards for _ in quotas]

    def node(held: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            for s, q in enumerate(held):
                out[s][lo] = int(q)
            return
        mid = (lo + hi) // 2
        draw = int(held.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(held, draw, method="marginals") if draw else np.zeros_like(held)
        node(left, lo, mid)
        node(held - left, mid, hi)

    if quotas:
        node(np.array(quotas, dtype=np.int64), 0, shards)
    return out


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """At most GROUPS rows as a table to broadcast, without Python on the executors."""
    held = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r"))
    return F.broadcast(held.select("r.*"))


def _order(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _bits(rows: int) -> int:
    """Bits of a hash that deal so many rows into buckets of about RUN."""
    return (rows // RUN).bit_length()


def _before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, bits: int) -> DataFrame:
    """Adds the sum of ``value`` over the rows of equal keys that stand before each row; the first column of the order is a hash.

    With ``bits``, rows are ordered inside buckets by the hash's first bits, to which the buckets' sums before them are added.
    """
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    if not bits:
        return df.withColumn(name, total(value, Window.partitionBy(*keys).orderBy(*order)))
    df = df.withColumn("_bucket", F.shiftright(F.col(order[0]), 64 - bits))
    sums = df.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, "_bucket", total(F.col("_sum"), Window.partitionBy(*keys).orderBy("_bucket")).alias("_offset"))
    df = df.withColumn("_inside", total(value, Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    df = df.join(sums, [*keys, "_bucket"])
    return df.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_bucket", "_offset", "_inside")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """From rows (source, size): one row per source, source, size, n (rows) and k, its place by code point, null last."""
    spark = sizes.sparkSession
    per = written(spark, sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-per-source")
    order = [F.col("source").isNull(), F.col("source")]
    per = per.repartitionByRange(per.count() // RUN + 1, *order).withColumn("part", F.spark_partition_id())
    per = written(spark, per, "mix-ranges")  # so that the ranges stay as they are
    counts = per.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select("part", (F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("c")).alias("offset"))  # a row per RUN sources
    at = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return per.withColumn("at", at).join(F.broadcast(offsets), "part").select("source", "size", "n", (F.col("offset") + F.col("at")).alias("k"))


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target: shares of all sizes by weight; a source above ``most`` times its size stops there, and the excess is shared again.

    The share that one unit of weight gets only grows from round to round, so a source that stops stays so, and each round is two sums.
    """
    n = len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % n + 1).cast("int")))
    size, weight = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    left, total, unit, held = float(size), weight, 0.0, (0, 0.0)
    over = lambda: F.col("weight") * unit > most * F.col("size")
    while total > 0:
        unit = max(unit, left / total)
        now = tuple(sources.where(over()).agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first())
        if now == held:
            break
        held = now
        left, total = float(size - most * held[0]), weight - held[1]
    share = F.lit(left) * F.col("weight") / F.lit(total) if total > 0 else F.lit(0.0)
    return sources.withColumn("target", F.when(over(), (most * F.col("size")).cast("double")).otherwise(share)).drop("weight")


def _drawn(spark: SparkSession, sizes: DataFrame, seed: int, shards: int, weights: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """From rows (source, size, h): the table of sources, and of blocks with what is drawn from each.

    Sources: source, k, source_size, target, whole, rest, blocks. Blocks: k, block, whole (times that all of it is taken), more (whether it is
    taken once more), picks (hashes of the rows taken once more of the others), shards (of each draw).
    """
    sources = with_targets(numbered_sources(sizes), weights)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int")
    n_rows = sizes.count()
    block_rows = max(BLOCK_ROWS, n_rows * MOST // DRAWS + 1)
    sources = sources.select("source", "k", F.col("size").alias("source_size"), "target", whole.alias("whole"), F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("long").alias("blocks"))
    sources = written(spark, sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    n_sources, widest = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    few = F.broadcast if n_sources <= FEW else lambda df: df
    groups = min(n_sources, GROUPS)
    group = F.col("k") if n_sources <= GROUPS else F.pmod(_order(seed, "k"), F.lit(GROUPS))

    dealt = sizes.join(few(sources.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
    dealt = dealt.select("k", F.pmod("h", "blocks").alias("block"), "h", "size")
    blocks = dealt.groupBy("k", "block").agg(F.sum("size").alias("words")).join(few(sources.select("k", "whole", "rest")), "k")
    blocks = _before(blocks.withColumn("o", _order(seed, "k", "block")), ["k"], ["o", "block"], F.col("words"), "before", _bits(widest))
    blocks = blocks.withColumn("more", (F.col("rest") > 0) & (F.col("before") + F.col("words") <= F.col("rest")))
    blocks = blocks.withColumn("left", F.when(~F.col("more") & (F.col("before") < F.col("rest")), F.col("rest") - F.col("before")))
    blocks = written(spark, blocks.drop("before", "rest", "o"), "mix-blocks")

    # the block that does not fit whole: its rows in random order, each taken if it still fits
    edge = few(blocks.where("left is not null").select("k", "block", "left"))  # one block a source at most
    near = dealt.join(edge, ["k", "block"]).groupBy("k", "block", "left", "h").agg(F.sum("size").alias("size"))
    near = near.groupBy("k", "block", "left").agg(F.array_sort(F.collect_list(F.struct(_order(seed, "h").alias("o"), "h", "size"))).alias("rows"))
    empty = F.struct(F.col("left").alias("left"), F.array().cast("array<bigint>").alias("picks"))
    taken = F.aggregate(
        "rows",
        empty,
        lambda acc, r: F.when(r["size"] <= acc["left"], F.struct((acc["left"] - r["size"]).alias("left"), F.array_append(acc["picks"], r["h"]).alias("picks"))).otherwise(acc),
    )
    blocks = blocks.join(few(near.select("k", "block", taken["picks"].alias("picks"))), ["k", "block"], "left")

    # draws of whole and partial blocks, put in random order, fill the shards' quotas
    times = F.col("whole") + (F.col("more") | F.col("left").isNotNull()).cast("int")
    blocks = blocks.withColumn("times", times).withColumn("g", group)
    quotas = {r["g"]: int(r["q"]) for r in blocks.groupBy("g").agg(F.sum("times").alias("q")).collect()}  # GROUPS rows at most
    shares = split_quotas([quotas.get(g, 0) for g in range(groups)], shards, seed)
    ends = _local(spark, [{"g": g, "ends": np.cumsum(s).tolist()} for g, s in enumerate(shares)], "g bigint, ends array<bigint>")
    draws = blocks.where("times > 0").select("g", "k", "block", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))
    draws = draws.withColumn("o", _order(seed, "epoch", "block", "k"))
    draws = _before(draws, ["g"], ["o", "k", "block", "epoch"], F.lit(1), "rank", _bits(max(quotas.values(), default=0))).join(ends, "g")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")
    draws = draws.select("k", "block", F.struct("epoch", shard).alias("d")).groupBy("k", "block").agg(F.array_sort(F.collect_list("d")).alias("draws"))
    blocks = blocks.join(draws, ["k", "block"], "left")
    return sources, written(spark, blocks.select("k", "block", "whole", "more", "picks", F.coalesce(F.col("draws.shard"), F.array().cast("array<int>")).alias("shards")), "mix-draws")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7919, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``docs`` with size, source_size, target, copies, taken and mix_shards (the shard of each copy)."""
    spark = docs.sparkSession
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    h = F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col))
    sizes = written(spark, docs.select(F.col(source_col).cast("string").alias("source"), size.alias("size"), h.alias("h")), "mix-sizes")
    sources, blocks = _drawn(spark, sizes, seed, shards, weights)
    few = F.broadcast if sources.limit(FEW + 1).count() <= FEW else lambda df: df
    df = docs.select(nested(docs).alias("row"), F.col(source_col).cast("string").alias("_source"), size.alias("size"), h.alias("h"))
    df = df.join(few(sources.select("k", F.col("source").alias("_s"), "source_size", "target", "blocks")), F.col("_source").eqNullSafe(F.col("_s")))
    df = df.withColumn("block", F.pmod("h", "blocks")).join(blocks, ["k", "block"])
    once = F.col("more") | F.coalesce(F.array_contains("picks", F.col("h")), F.lit(False))
    df = df.withColumn("copies", F.col("whole") + once.cast("int"))
    return restore(
        df,
        docs,
        "row",
        {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("copies"), "taken": F.col("size") * F.col("copies"), "mix_shards": F.slice("shards", 1, F.col("copies"))},
    )


def mixed(docs: DataFrame, places: bool = True, id_col: str = "doc_id", text_col: str = "text", seed: int = 7919, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with copy, mix_shard and, if asked for, mix_place, its keyed place there.

    Places run from 0 without a gap. Whoever deals the rows anew, as a later sharding does, needs none, and saves their shuffle.
    """
    df = mix(docs, id_col=id_col, text_col=text_col, seed=seed, **options)
    df = df.withColumn("_each", F.explode(F.transform("mix_shards", lambda s, i: F.struct(s.alias("s"), i.alias("i")))))
    df = df.drop("mix_shards").withColumn("mix_shard", F.col("_each.s")).withColumn("copy", F.col("_each.i")).drop("_each")
    if not places:
        return df
    largest = df.groupBy("mix_shard").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    df = df.withColumn("_o", F.xxhash64(F.lit(seed), "mix_shard", "copy", F.col(id_col), text_of(text_col)))
    return _before(df, ["mix_shard"], ["_o", "copy"], F.lit(1), "mix_place", _bits(largest)).drop("_o")
