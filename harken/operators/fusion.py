"""Lists from proposals: statements to require or to avoid and uncertain spans, fused log-linearly over a session's pool.

A statement speaks for each item of the pool that it matches: what is required by its gain over items that it does not match, what is to be avoided by its loss against them. A span is one
mixture of its meanings; meanings that no item of the pool matches abstain. Items that nothing matches share one value, zero; items that match what is to be avoided fall behind them.

What a wording says is found once for a pool, not for a session. Sessions meet it in blocks of one pool, where sums are arrays, and only lists leave the block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harken.operators import dialogue as dlg
from harken.operators import evidence as ev
from harken.operators import intent
from harken.operators.category import Pools
from harken.sources.stages import staged

KEY = ["text", "attribute", "value"]
#: Sessions of one pool that are ranked together; what their wordings say goes to each such block once.
BLOCK = 10_000


def statements(proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From validated proposals: (session_id, text, attribute, value, polarity, turn, strength, confidence) of what is stated, and the meanings (session_id, turn, span, text, attribute,
    value, confidence, polarity) of spans that no later statement settles. Proposals of a group of several in one turn are one span."""
    own = Window.partitionBy("session_id", "turn", "group")
    df = proposals.withColumn("_unsure", (F.col("group") != "") & (F.count(F.lit(1)).over(own) > 1)).withColumn("text", F.col("value"))
    held = df.where("not _unsure and value <> ''").where(F.col("op").isin("add", "replace"))
    held = held.groupBy("session_id", *KEY, "polarity").agg(F.min("turn").alias("turn"), F.min("strength").alias("strength"), F.max("confidence").alias("confidence"))  # hard before soft
    spans = df.where("_unsure").withColumn("polarity", F.min_by("polarity", "ord").over(own)).where("value <> ''").withColumnRenamed("group", "span")
    spans = spans.groupBy("session_id", "turn", "span", *KEY, "polarity").agg(F.max("confidence").alias("confidence"))
    later = held.select("session_id", "attribute", "value", F.col("turn").alias("said"))
    settled = spans.join(later, ["session_id", "attribute", "value"]).where("said > turn").select("session_id", "turn", "span").distinct()
    return held, spans.join(settled, ["session_id", "turn", "span"], "left_anti")


def matched(stated: DataFrame, index: DataFrame, item_pairs: DataFrame) -> DataFrame:
    """(category, text, attribute, value) to (.., parent_asin, s, soft): the best match of any kind, and the best that is not a card's own wording; null if there is none."""
    key = ["category", *KEY]
    texts = stated.select("category", "text").distinct()
    of = index.select("parent_asin", "category")
    rows = [
        stated.join(ev.exact(texts, index, "category"), ["category", "text"]).select(*key, "parent_asin", F.lit(1.0).alias("s"), F.lit(None).cast("double").alias("soft")),
        stated.join(ev.overlap(texts, index, "category"), ["category", "text"]).withColumn("s", F.col("share") * ev.LEXICAL_GAIN / ev.EXACT_GAIN).select(*key, "parent_asin", "s", F.col("s").alias("soft")),
        stated.join(item_pairs.join(of, "parent_asin"), ["category", "attribute", "value"]).withColumn("s", F.lit(ev.ATTRIBUTE_GAIN / ev.EXACT_GAIN)).select(*key, "parent_asin", "s", F.col("s").alias("soft")),
    ]
    return reduce(DataFrame.unionByName, rows).groupBy(*key, "parent_asin").agg(F.max("s").alias("s"), F.max("soft").alias("soft"))


def aged(turn: Column, at_turn: int, strength: Column) -> Column:
    return F.pow(F.lit(dlg.DECAY), F.greatest(F.lit(0), F.lit(at_turn) - turn)) * F.when(strength == "soft", dlg.SOFT).otherwise(1.0)


def spoken(found: DataFrame) -> DataFrame:
    """What a match says for an item: (category, text, attribute, value, parent_asin, polarity, unsure, gain). Of a sure statement the evidence, of a meaning of a span what it adds to the
    probability of no match."""
    sides = F.explode(F.array(*[F.struct(F.lit(p).alias("polarity"), F.lit(u).alias("unsure")) for p in ("require", "avoid") for u in (False, True)]))
    avoid = F.col("polarity") == "avoid"
    none = F.when(avoid, F.exp(ev.bounded(F.lit(1.0)))).otherwise(F.exp(ev.bounded(F.lit(0.0))))
    some = F.when(avoid, F.exp(ev.bounded(1 - F.col("soft")))).otherwise(F.exp(ev.bounded(F.col("soft"))))
    gain = F.when(F.col("unsure"), some - none).otherwise(intent.gain(F.col("s"), F.col("polarity")))
    rows = found.select("*", sides.alias("x")).select(*found.columns, "x.*").withColumn("gain", gain)
    return rows.where("gain is not null").select("category", *KEY, "parent_asin", "polarity", "unsure", "gain")


def listed_block(said: pa.Table, told: pa.Table, top: int) -> pa.Table:
    """(session_id, rank, parent_asin, e): the head of the pool for each session of a block, by evidence, ties by place in the pool.

    ``said`` has a row for each statement (weight) and each meaning of a span (span, weight of the span, confidence), and one without a key for a session that nothing is held of; ``told`` what
    a key says for which places of the pool, and in rows without a key the items at these places.
    """
    places: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    names: list[tuple[np.ndarray, pa.Array]] = []
    told_keys = zip(told["told_key"].to_pylist(), told["told_polarity"].to_pylist(), told["told_unsure"].to_pylist(), strict=True)
    for at, key in enumerate(told_keys):
        where = told["told_places"][at].values.to_numpy()
        if key[0] is None:
            names.append((where, told["told_names"][at].values))
        else:
            places[key] = where, told["told_gains"][at].values.to_numpy()
    n = sum(len(where) for where, _ in names)
    item = pa.concat_arrays([x for _, x in names]).take(pa.array(np.argsort(np.concatenate([where for where, _ in names]), kind="stable")))
    none = {"require": max(ev.L_MIN, np.exp(-ev.EXACT_GAIN)), "avoid": 1.0}
    columns = [said[c].to_pylist() for c in ("session_id", "key", "polarity", "span", "weight", "confidence")]
    rows: dict = {}
    for session, *row in zip(*columns, strict=True):
        rows.setdefault(session, []).append(tuple(row))
    size, heads, values = min(n, top), [], []
    known: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}  # many sessions hold the same
    for mine in map(tuple, rows.values()):
        if mine in known:
            heads.append(known[mine][0])
            values.append(known[mine][1])
            continue
        e, spans = np.zeros(n), {}
        for key, polarity, span, weight, confidence in mine:
            match = places.get((key, polarity, span is not None))
            if match is None:
                continue
            where, gains = match
            if span is None:
                e[where] += weight * gains
            else:
                spans.setdefault(span, (polarity, weight, []))[2].append((confidence, where, gains))
        for polarity, weight, meanings in spans.values():
            lift = np.zeros(n)
            for confidence, where, gains in meanings:
                lift[where] += confidence * gains
            here = np.flatnonzero(lift)
            chance = none[polarity] + lift[here] / sum(confidence for confidence, _, _ in meanings)
            e[here] += weight * (np.log(np.maximum(intent.FLOOR, chance)) - np.log(max(intent.FLOOR, none[polarity])))
        e = np.rint(e * 1e9).astype(np.int64)
        order = np.arange(n) - e * n
        order = np.sort(np.partition(order, size - 1)[:size] if n > size else order) % n
        known[mine] = order, e[order] / 1e9
        heads.append(order)
        values.append(known[mine][1])
    sessions = pa.array(np.repeat(np.arange(len(rows)), size))
    ranks = pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(rows)))
    out = [pa.array(list(rows), said.schema.field("session_id").type).take(sessions), ranks, item.take(pa.array(np.concatenate(heads))), pa.array(np.concatenate(values))]
    return pa.Table.from_arrays(out, ["session_id", "rank", "parent_asin", "e"])


def lists(held: DataFrame, spans: DataFrame, openers: DataFrame, pools: Pools, index: DataFrame, item_pairs: DataFrame, at_turn: int, top: int = 10) -> DataFrame:
    """(session_id, rank, parent_asin, e): the head of each session's pool by the evidence of all that is held at a turn, ties by place in the pool.

    ``openers`` has (session_id, opener) of the sessions that are asked for; statements meet items within the categories of their own pools, once for all sessions that share a pool.
    """
    name = F.to_json(F.struct(*KEY)).alias("key")
    nothing = lambda t: F.lit(None).cast(t)
    sure = aged(F.col("turn"), at_turn, F.col("strength")) * F.col("confidence")
    sure = held.where(F.col("turn") <= at_turn).select("session_id", *KEY, name, "polarity", nothing("string").alias("span"), sure.alias("weight"), F.col("confidence").cast("double").alias("confidence"))
    span = F.concat_ws(" ", "turn", "span", "polarity").alias("span")
    unsure = aged(F.col("turn"), at_turn, F.lit("soft"))
    unsure = spans.where(F.col("turn") <= at_turn).select("session_id", *KEY, name, "polarity", span, unsure.alias("weight"), F.col("confidence").cast("double").alias("confidence"))
    mine = openers.join(pools.of.select("opener", "pool"), "opener").select("session_id", "pool")
    counts = F.broadcast(mine.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n")))  # a row for each pool
    mine = mine.join(counts, "pool").select("session_id", "pool", F.pmod(F.xxhash64("session_id"), F.col("n")).cast("int").alias("block"))
    # sessions that nothing is held of have a row without a key
    said = staged(mine.join(sure.unionByName(unsure), "session_id", "left"), "said")

    near = index.join(pools.items.select("parent_asin").distinct(), "parent_asin", "left_semi")
    asked = said.where("key is not null").select("pool", *KEY).distinct()
    found = matched(asked.join(pools.categories(), "pool").select("category", *KEY).distinct(), near, item_pairs)
    row = F.sort_array(F.collect_list(F.struct("pool_pos", "gain")))  # a pool's cap of items at most
    listed = spoken(found).join(pools.items, ["category", "parent_asin"]).groupBy("pool", name, "polarity", "unsure").agg(row.alias("x"))
    listed = listed.select("pool", "key", "polarity", "unsure", F.col("x.pool_pos").alias("places"), F.col("x.gain").alias("gains"), nothing("array<string>").alias("names"))
    wanted = said.where("key is not null").select("pool", "block", "key", "polarity", F.col("span").isNotNull().alias("unsure")).distinct()
    told = wanted.join(listed, ["pool", "key", "polarity", "unsure"])
    names = pools.items.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("pool_pos", "parent_asin"))).alias("x"))
    empty = [nothing(t).alias(c) for c, t in (("key", "string"), ("polarity", "string"), ("unsure", "boolean"))]
    names = names.select("pool", *empty, F.col("x.pool_pos").alias("places"), nothing("array<double>").alias("gains"), F.col("x.parent_asin").alias("names"))
    told = told.unionByName(said.select("pool", "block").distinct().join(names, "pool"))
    told = told.select(*[F.col(c).alias(f"told_{c}") for c in ("pool", "block", "key", "polarity", "unsure", "places", "gains", "names")])
    schema = f"session_id {openers.schema['session_id'].dataType.simpleString()}, rank int, parent_asin string, e double"
    said = said.select("pool", "block", "session_id", "key", "polarity", "span", "weight", "confidence")
    return said.groupBy("pool", "block").cogroup(told.groupBy("told_pool", "told_block")).applyInArrow(lambda a, b: listed_block(a, b, top), schema)
