"""Evidence: which items a constraint speaks for. Sparse: only matching pairs are rows; all others share one constant.

``also`` names columns that texts and items must agree in, such as a category; they are join keys and stay in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harken.functions import blocks
from harken.functions import text as tx
from harken.operators.category import Pools
from harken.sources.stages import staged

EXACT_GAIN, ATTRIBUTE_GAIN, LEXICAL_GAIN, FLOOR, L_MIN = 3.2, 1.5, 0.9, 0.34, 0.02
K1, B = 1.5, 0.75
#: Documents of a block, queries that a task scores them for, and what the rounding of a strength may change.
DOCS, QUERIES, SLACK = 4_096, 4_096, 2e-6


def bounded(strength: Column, gain: float = EXACT_GAIN) -> Column:
    return F.log(F.greatest(F.lit(L_MIN), F.exp(gain * (strength - 1))))


def exact(texts: DataFrame, index: DataFrame, *also: str) -> DataFrame:
    """(text, parent_asin) of items whose card holds the text."""
    return texts.join(index.select("parent_asin", *also, F.explode("card").alias("text")).distinct(), ["text", *also])


def attribute(pairs: DataFrame, item_pairs: DataFrame) -> DataFrame:
    """(attribute, value, parent_asin) of items with the pair."""
    return pairs.join(item_pairs, ["attribute", "value"])


def rarest_first(sets: DataFrame, counts: DataFrame, how: str = "left") -> DataFrame:
    """``sets`` with the distinct tokens of ``words`` as strings in one order for all sets: the rarest by ``counts`` (token, n) first, so that few sets share a first token.

    With ``how`` "inner", tokens that ``counts`` lacks go, and sets that have no others.
    """
    key = [c for c in sets.columns if c != "words"]
    each = sets.select(*key, F.explode("words").alias("token")).join(counts, "token", how)
    return each.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))), lambda x: x["token"]).alias("words"))


def token_counts(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("words").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def shared_tokens(left: DataFrame, right: DataFrame, also: tuple[str, ...], least: Column, left_prefix: Column, right_prefix: Column, sizes: Column) -> DataFrame:
    """Columns of ``left`` (a, also, x) and ``right`` (b, also, y) and ``k``, for pairs whose token arrays x and y may share ``least`` tokens or more, by prefix filter.

    Both arrays are in one order, so pairs that share enough share a token of both prefixes. ``sizes`` excludes lengths that cannot do, the place of the
    token bounds how many can follow, and a pair is kept at its first shared token alone, so no pair is formed twice and none is deduplicated. What is left is counted exactly.
    """
    first = left.select("a", *also, "x", F.posexplode(F.slice("x", F.lit(1), left_prefix)).alias("i", "token"))
    second = right.select("b", *also, "y", F.posexplode(F.slice("y", F.lit(1), right_prefix)).alias("j", "token"))
    follow = F.least(F.size("x") - F.col("i"), F.size("y") - F.col("j"))
    pairs = first.join(second, ["token", *also]).where(sizes & (follow >= least))
    both = F.array_intersect("x", "y")
    pairs = pairs.select("a", "b", *also, "x", "y", "token", both.alias("both")).where((F.get("both", F.lit(0)) == F.col("token")) & (F.size("both") >= least))
    return pairs.select("a", "b", *also, F.size("x").alias("n"), F.size("y").alias("m"), F.size("both").alias("k"))


def at_least(share: float, n: Column) -> Column:
    """The least whole number that is ``share`` of n or more; rounding never excludes one."""
    return F.greatest(F.lit(1), F.ceil(share * n - 1e-9).cast("int"))


def token_sets(strings: DataFrame, name: str, *also: str) -> DataFrame:
    """Distinct strings that have tokens, with them."""
    return strings.select(F.col(name).alias("a"), *also).distinct().withColumn("words", tx.tokens(F.col("a"))).where(F.size("words") > 0)


def overlap_pairs(texts: DataFrame, index: DataFrame, *also: str, floor: float = FLOOR) -> DataFrame:
    """(a, b, n, k): the text, the item, the size of the text's token set, and how many tokens they share.

    Of an item's tokens only those that some text has are shuffled, as no other can be shared.
    """
    have = index.select("parent_asin", *also, tx.tokens(F.concat_ws(" ", F.array_join("spec", " "), "title")).alias("words"))
    said = token_sets(texts, "text", *also)
    counts = staged(said.select(F.explode("words").alias("token")).distinct().join(token_counts(have), "token"), "token-counts")
    left = rarest_first(said, counts).withColumnRenamed("words", "x")
    right = rarest_first(have, counts, "inner").select(F.col("parent_asin").alias("b"), *also, F.col("words").alias("y"))
    # an item's tokens have no bound of their own; the last of them cannot begin a match of two or more
    need = at_least(floor, F.size("x"))
    return shared_tokens(left, right, also, need, F.size("x") - need + 1, F.size("y"), F.lit(True)).drop("m")


def overlap(texts: DataFrame, index: DataFrame, *also: str, floor: float = FLOOR) -> DataFrame:
    """(text, parent_asin, share): the share of the text's tokens that the item has, from the floor on."""
    df = overlap_pairs(texts, index, *also, floor=floor).select(F.col("a").alias("text"), *also, F.col("b").alias("parent_asin"), (F.col("k") / F.col("n")).alias("share"))
    return df.where(F.col("share") >= floor)


def similar_strings(texts: DataFrame, strings: DataFrame, *also: str, floor: float = FLOOR) -> DataFrame:
    """(a, b, jaccard): texts and strings (both named ``text``) whose token sets have a Jaccard similarity from the floor on."""
    have = token_sets(strings, "text", *also)
    counts = token_counts(have)
    left = rarest_first(token_sets(texts, "text", *also), counts).withColumnRenamed("words", "x")
    right = rarest_first(have, counts).select(F.col("a").alias("b"), *also, F.col("words").alias("y"))
    n, m = F.size("x"), F.size("y")
    least = at_least(floor / (1 + floor), n + m)
    alike = (m >= at_least(floor, n)) & (n >= at_least(floor, m))
    df = shared_tokens(left, right, also, least, n - at_least(floor, n) + 1, m - at_least(floor, m) + 1, alike)
    return df.select("a", "b", *also, (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("jaccard")).where(F.col("jaccard") >= floor)


def softcard(texts: DataFrame, index: DataFrame, *also: str, floor: float = FLOOR) -> DataFrame:
    """(text, parent_asin, best): the best Jaccard similarity with a card string, from the floor on, exact matches left out.

    Texts meet distinct strings; items only those of their strings that are similar.
    """
    cards = index.select("parent_asin", *also, F.explode("card").alias("b")).distinct()
    found = similar_strings(texts, cards.select(F.col("b").alias("text"), *also), *also, floor=floor).withColumnRenamed("a", "text")
    best = found.join(cards, ["b", *also]).groupBy("text", *also, "parent_asin").agg(F.max("jaccard").alias("best"), F.max((F.col("b") == F.col("text")).cast("int")).alias("same"))
    return best.where("same = 0").drop("same")


def bm25_parts(docs: DataFrame, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
    """(term, doc_id, part): what a term of a document (doc_id, text) adds to a query's score, and (term, idf)."""
    bags = docs.select("doc_id", tx.terms(F.coalesce("text", F.lit(""))).alias("bag"))
    sizes = bags.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.greatest(F.size("bag"), F.lit(1))).alias("avg_len"))  # one row
    tf = bags.select("doc_id", F.greatest(F.size("bag"), F.lit(1)).alias("len"), F.explode("bag").alias("term")).groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(sizes))
    idf = idf.select("term", "avg_len", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return tf.join(idf, "term").select("term", "doc_id", part.alias("part")), idf.select("term", "idf")


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, len, term, tf) of documents (doc_id, text), and a row without a term for each; a document's terms are counted where it is read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bag = batch.columns
            lens, said = pc.list_value_length(bag).to_numpy(), bag.flatten().dictionary_encode()
            key, tf = np.unique(pc.list_parent_indices(bag).to_numpy() * max(1, len(said.dictionary)) + said.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(key, max(1, len(said.dictionary)))
            row = np.concatenate([np.arange(len(ids)), row])
            term = pa.concat_arrays([pa.nulls(len(ids), pa.string()), said.dictionary.cast(pa.string()).take(pa.array(code))])
            tf = np.concatenate([np.zeros(len(ids), np.int64), tf])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(np.maximum(lens, 1)[row], pa.int32()), term, pa.array(tf, pa.int32())], ["doc_id", "len", "term", "tf"])

    bags = docs.select(F.col("doc_id").cast("long"), tx.terms(F.coalesce("text", F.lit(""))).alias("bag"))
    return bags.mapInArrow(count, "doc_id long, len int, term string, tf int")


def strengths_in_block(queries: pa.Table, parts: pa.Table, top: int | None) -> pa.Table:
    """(query_id, doc_id, strength), not rounded, of a block's documents that share a term with a query: all, or those that may be among the ``top`` best."""
    docs, row = np.unique(parts["doc_id"].to_numpy(), return_inverse=True)
    of = blocks.by_term(parts["term_id"], row, parts["part"].to_numpy())
    ceiling = queries["ceiling"].to_numpy()
    found = ((at, rows, np.minimum(1.0, score / ceiling[at])) for at, rows, score in blocks.summed(queries["terms"].to_pylist(), of, len(docs)))
    if top is not None:
        found = ((at, *blocks.best(rows, score, top, SLACK)) for at, rows, score in found)
    at, hit, score = blocks.gathered(found)
    return pa.Table.from_arrays([queries["query_id"].take(pa.array(at)), pa.array(docs[hit], pa.int64()), pa.array(score)], ["query_id", "doc_id", "strength"])


def bm25(docs: DataFrame, queries: DataFrame, top: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, strength): Okapi BM25 over (doc_id, text), as a share of the query's ceiling, of every document with a positive score.

    A document's texts are read once, and only its counts of the queries' terms go to its block, where whole scores are added up. With ``top``, a block leaves out what cannot be among
    the best of a query, by strength, then doc_id. Each doc_id is one document.
    """
    want = staged(queries.select("query_id", F.explode(tx.terms(F.coalesce("text", F.lit("")))).alias("term")).distinct(), "query-terms")
    terms = staged(want.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms")
    tf = counted(docs).join(terms, "term", "left").where("term is null or term_id is not null")
    tf = staged(tf.select("doc_id", "len", "term_id", "tf"), "term-counts")
    sizes = tf.where("term_id is null").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))  # one row
    idf = tf.where("term_id is not null").groupBy("term_id").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(sizes))
    idf = staged(idf.select("term_id", "avg_len", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "idf")
    asked = want.join(terms, "term").join(idf, "term_id").groupBy("query_id").agg(F.sort_array(F.collect_list("term_id")).alias("terms"), F.sum("idf").alias("ceiling"))
    asked = staged(asked, "queries")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    parts = tf.join(idf, "term_id").select("doc_id", "term_id", part.alias("part"))
    n_blocks, n_chunks = (-(-n // most) or 1 for n, most in ((sizes.first()["n_docs"], DOCS), (asked.count(), QUERIES)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("*", dealt("query_id", n_chunks).alias("chunk")).select("*", every(n_blocks).alias("block"))
    parts = parts.select("*", dealt("doc_id", n_blocks).alias("block")).select("*", every(n_chunks).alias("chunk"))
    kind = asked.schema["query_id"].dataType.simpleString()
    found = asked.groupBy("block", "chunk").cogroup(parts.groupBy("block", "chunk")).applyInArrow(lambda q, p: strengths_in_block(q, p, top), f"query_id {kind}, doc_id long, strength double")
    return found.withColumn("strength", F.round("strength", 6))


def bm25_top(docs: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """The report of the ``top`` best documents of each query, with rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("strength"), "doc_id")
    return bm25(docs, queries, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def hits_in(asked: DataFrame, items: DataFrame, index: DataFrame) -> DataFrame:
    """(pool, text, parent_asin, pool_pos): the items of a pool whose card holds a text that is asked for there. Only items of pools are looked at."""
    cards = items.join(index.select("parent_asin", F.explode(F.array_distinct("card")).alias("text")), "parent_asin")
    return cards.join(asked, ["pool", "text"]).select("pool", "text", "parent_asin", "pool_pos")


def ranked(states: DataFrame, pools: Pools, index: DataFrame, top: int = 10) -> DataFrame:
    """(opener, text, rank, parent_asin, p): the head of each pool after one constraint, stable on the pool's order.

    A pool and a text decide the list, so it is made once for all openers that share both. All matches have one value and all others another, so the first
    ``top`` of each by place are enough, and the sum over the pool is a count.
    """
    named = states.join(pools.of, "opener")
    asked = named.select("pool", "text", "n_pool").distinct()
    hits = hits_in(asked.select("pool", "text"), pools.items, index)
    counts = asked.join(hits.groupBy("pool", "text").agg(F.count(F.lit(1)).alias("h")), ["pool", "text"], "left").withColumn("h", F.coalesce("h", F.lit(0)))
    near = Window.partitionBy("pool", "text").orderBy("pool_pos")
    best = hits.withColumn("at", F.row_number().over(near)).where(F.col("at") <= top).select("pool", "text", "parent_asin", "pool_pos", F.lit(1).alias("hit"))
    # an item that does not match and is not among the first 2 * top has top better ones
    head = asked.join(pools.items.where(F.col("pool_pos") < 2 * top), "pool").select("pool", "text", "parent_asin", "pool_pos", F.lit(0).alias("hit"))
    rows = best.unionByName(head.join(best.select("pool", "text", "parent_asin"), ["pool", "text", "parent_asin"], "left_anti"))
    low = F.exp(bounded(F.lit(0.0)))
    z = F.col("h") + (F.col("n_pool") - F.col("h")) * low
    rows = rows.join(counts.select("pool", "text", z.alias("z")), ["pool", "text"])
    rows = rows.withColumn("p", F.round(F.when(F.col("hit") == 1, F.lit(1.0)).otherwise(low) / F.col("z"), 9))
    order = Window.partitionBy("pool", "text").orderBy(F.desc("p"), "pool_pos")
    lists = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return named.join(lists, ["pool", "text"]).select("opener", "text", "rank", "parent_asin", "p")


def entropy(states: DataFrame, pools: Pools, index: DataFrame) -> DataFrame:
    """(opener, text, n, entropy): normalised Shannon entropy of each pool after one constraint, computed once for a pool and a text."""
    named = states.join(pools.of, "opener")
    hits = hits_in(named.select("pool", "text").distinct(), pools.items, index).groupBy("pool", "text").agg(F.count(F.lit(1)).alias("h"))
    sums = named.join(hits, ["pool", "text"], "left").select("opener", "text", F.col("n_pool").alias("n"), F.coalesce("h", F.lit(0)).alias("h"))
    low = F.exp(bounded(F.lit(0.0)))
    z = F.col("h") + (F.col("n") - F.col("h")) * low
    part = lambda k, e: F.when(k > 0, -k * (e / z) * F.log(e / z)).otherwise(0.0)
    total = part(F.col("h"), F.lit(1.0)) + part(F.col("n") - F.col("h"), low)
    return sums.select("opener", "text", "n", F.round(F.when(F.col("n") > 1, total / F.log("n")).otherwise(0.0), 6).alias("entropy"))
