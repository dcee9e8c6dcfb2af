"""Category retrieval: which categories an opener speaks of, and the pool of items they hold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harken.functions.numbering import placed
from harken.functions.text import stems

TEMPERATURE, TAU, CAP, QUOTE_BONUS, PRIOR, NO_OVERLAP = 2.0, 0.85, 8000, 3.0, 0.25, -30.0
#: Places of the catalog that are numbered at once.
RUN = 1_000_000


def stats(index: DataFrame) -> DataFrame:
    """One row per category: items, place in code-point order, log prior, stems. The windows run over categories, not items."""
    every = Window.partitionBy(F.lit(0))
    df = index.groupBy("category").agg(F.count(F.lit(1)).alias("n_items"))
    return df.select(
        "category",
        "n_items",
        (F.row_number().over(every.orderBy("category")) - 1).alias("cat_idx"),
        F.log(F.col("n_items") / F.sum("n_items").over(every)).alias("log_prior"),
        F.count(F.lit(1)).over(every).alias("n_categories"),
        stems(F.col("category")).alias("stems"),
    )


def term_weights(categories: DataFrame) -> DataFrame:
    """(term, idf) of the categories' stems."""
    each = categories.select("n_categories", F.explode("stems").alias("term"))
    return each.groupBy("term").agg(F.log(F.max("n_categories") / F.count(F.lit(1))).alias("idf"))


def scores(openers: DataFrame, categories: DataFrame) -> DataFrame:
    """(opener, category, score) of categories that share a stem with the opener."""
    said = openers.select("opener", F.explode(stems(F.col("opener"))).alias("term"))
    terms = categories.select("category", F.size("stems").alias("n_stems"), F.explode("stems").alias("term")).join(term_weights(categories), "term")
    shared = said.join(terms, "term").groupBy("opener", "category").agg(F.sum("idf").alias("w"), F.count(F.lit(1)).alias("n"), F.max("n_stems").alias("n_stems"))
    quoted = F.contains(F.lower("opener"), F.lower("category"))
    return shared.select("opener", "category", (F.col("w") * F.col("n") / F.col("n_stems") + F.when(quoted, QUOTE_BONUS * F.col("w")).otherwise(0.0)).alias("score"))


def posterior(openers: DataFrame, categories: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """(opener, category, p) over all categories; those that share nothing keep their small mass.

    Every opener has a row for every category, as that is what is asked for; pools need heads() only.
    """
    df = openers.crossJoin(categories).join(scores(openers, categories), ["opener", "category"], "left")
    df = df.withColumn("logit", F.coalesce("score", F.lit(NO_OVERLAP)) / temperature + PRIOR * F.col("log_prior"))
    own = Window.partitionBy("opener")
    df = df.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(own)))
    return df.select("opener", "category", "cat_idx", "n_items", F.round(F.col("e") / F.sum("e").over(own), 12).alias("p"))


def heads(openers: DataFrame, categories: DataFrame, temperature: float = TEMPERATURE, tau: float = TAU, cap: int = CAP) -> DataFrame:
    """The rows of posterior() that a pool can reach: categories that share a stem and, where their mass and items are not enough, the head of the others.

    The others of an opener differ in their prior alone, so their mass is that of all categories less that of the sharing ones. They follow
    all that share, in the order of the prior, and categories with twice ``cap`` items are enough of them, as sharing ones hold less than ``cap``.
    """
    base = F.exp(F.lit(NO_OVERLAP / temperature) + PRIOR * F.col("log_prior"))
    columns = categories.select("category", "cat_idx", "n_items", "log_prior", base.alias("base"))
    whole = categories.agg(F.sum(base).alias("whole"))  # one row
    said = scores(openers, categories).join(columns, "category").withColumn("logit", F.col("score") / temperature + PRIOR * F.col("log_prior"))
    sums = said.groupBy("opener").agg(F.max("logit").alias("top"), F.sum("base").alias("own"), F.sum("n_items").alias("items"))
    mass = said.join(sums.select("opener", "top"), "opener").groupBy("opener").agg(F.sum(F.exp(F.col("logit") - F.col("top"))).alias("e"))
    openers = openers.select("opener").join(sums, "opener", "left").join(mass, "opener", "left").crossJoin(F.broadcast(whole))
    top = F.coalesce("top", F.lit(NO_OVERLAP / temperature))
    rest = F.greatest(F.lit(0.0), F.col("whole") - F.coalesce("own", F.lit(0.0))) * F.exp(-top)
    openers = openers.select("opener", top.alias("top"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("e", F.lit(0.0)).alias("e"), (F.coalesce("e", F.lit(0.0)) + rest).alias("z"))
    share = F.round(F.exp(F.col("logit") - F.col("top")) / F.col("z"), 12)
    near = said.join(openers.select("opener", "top", "z"), "opener").select("opener", "category", "cat_idx", "n_items", share.alias("p"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("log_prior"), "cat_idx").rowsBetween(Window.unboundedPreceding, -1)  # over categories
    first = columns.withColumn("before", F.coalesce(F.sum("n_items").over(order), F.lit(0))).where(F.col("before") < 2 * cap)
    open_ = openers.where((F.round(F.col("e") / F.col("z"), 9) < tau) & (F.col("items") < cap)).select("opener", "top", "z")
    far = open_.crossJoin(F.broadcast(first.select("category", "cat_idx", "n_items", F.log("base").alias("logit"))))  # 2 * cap rows at most
    far = far.select("opener", "category", "cat_idx", "n_items", share.alias("p")).join(near.select("opener", "category"), ["opener", "category"], "left_anti")
    return near.unionByName(far)


def pool_categories(post: DataFrame, tau: float = TAU, cap: int = CAP) -> DataFrame:
    """Categories in order of mass, as long as what stands before them is below tau and the cap."""
    order = Window.partitionBy("opener").orderBy(F.desc("p"), "cat_idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = post.withColumn("cat_rank", F.row_number().over(order) - 1)
    df = df.withColumn("mass", F.coalesce(F.sum("p").over(before), F.lit(0.0))).withColumn("items_before", F.coalesce(F.sum("n_items").over(before), F.lit(0)))
    return df.where((F.round("mass", 9) < tau) & (F.col("items_before") < cap))


def placed_items(index: DataFrame, cap: int = CAP) -> DataFrame:
    """(category, parent_asin, at): the first ``cap`` items of each category, numbered in runs of the catalog."""
    return placed(index.select("category", "cat_pos", "parent_asin"), ["category"], F.floor(F.col("cat_pos") / RUN), ["cat_pos"], "at", cap).select("category", "parent_asin", "at")


def pool(post: DataFrame, index: DataFrame, tau: float = TAU, cap: int = CAP) -> DataFrame:
    """(opener, parent_asin, pool_pos): every opener's items, as a report; what is computed from pools takes them from pools()."""
    df = pool_categories(post, tau, cap).join(placed_items(index, cap), "category")
    return df.withColumn("pool_pos", F.col("items_before") + F.col("at")).where(F.col("pool_pos") < cap).select("opener", "parent_asin", "pool_pos")


@dataclass(frozen=True)
class Pools:
    """Pools, each once, however many openers have it: ``of`` is (opener, pool, n_pool), ``items`` (pool, category, parent_asin, pool_pos)."""

    of: DataFrame
    items: DataFrame

    def each(self) -> DataFrame:
        """(opener, parent_asin, pool_pos), as pool() gives it."""
        return self.of.join(self.items, "pool").select("opener", "parent_asin", "pool_pos")

    def categories(self) -> DataFrame:
        return self.items.select("pool", "category").distinct()


def pools(post: DataFrame, index: DataFrame, keep: Callable[[DataFrame, str], DataFrame], tau: float = TAU, cap: int = CAP) -> Pools:
    """The pools of openers. A pool is named by its categories and their places, as nothing else of an opener decides its items; ``keep`` stages both tables."""
    spans = F.sort_array(F.collect_list(F.struct("items_before", "category", "n_items")))
    each = pool_categories(post, tau, cap).groupBy("opener").agg(spans.alias("spans"))
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + F.least(x["n_items"], cap - x["items_before"]))
    of = keep(each.select("opener", F.md5(F.to_json("spans")).alias("pool"), size.alias("n_pool"), "spans"), "pools-of")
    once = of.groupBy("pool").agg(F.first("spans").alias("spans")).select("pool", F.explode("spans").alias("x")).select("pool", "x.category", "x.items_before")
    items = once.join(placed_items(index, cap), "category").withColumn("pool_pos", F.col("items_before") + F.col("at")).where(F.col("pool_pos") < cap)
    return Pools(of.drop("spans"), keep(items.select("pool", "category", "parent_asin", "pool_pos"), "pool-items"))
