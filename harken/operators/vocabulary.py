"""The catalog's own vocabulary: concepts per attribute, their labels, support, and which label or category a phrase means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harken.functions import text as tx
from harken.operators import category as ctg

# Spellings that mean another value of the attribute, and fragments that mean none.
ALIASES = {
    "material": {"polyster": "polyester", "polyesther": "polyester", "cotten": "cotton", "pleather": "leather"},
    "feature": {"comfy": "comfortable", "waterproofed": "waterproof"},
    "size": {"x large": "xl", "extra large": "xl", "xlarge": "xl", "x small": "xs", "extra small": "xs", "xsmall": "xs"},
    "use_case": {"washer safe": "machine wash", "machine washable": "machine wash", "wash by hand": "hand wash", "hand washable": "hand wash", "from abroad": "imported", "shipped from abroad": "imported"},
}
AMBIGUOUS = ("poly", "reg", "syn", "art")
HYPOTHESES, SURE, CLEAR = 12, 0.75, 3.0


def folded(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"[^a-z0-9%$]+", " "))


def alias_of(attribute: Column, key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for a, m in ALIASES.items() for k, v in m.items() for x in (f"{a}={k}", v)])
    return F.coalesce(F.try_element_at(table, F.concat_ws("=", attribute, key)), key)


def with_concepts(pairs: DataFrame) -> DataFrame:
    """(attribute, value) to (attribute, value, concept), each distinct pair once.

    The concept is the value's own reading for the attribute if there is one, folded, aliases resolved.
    """
    readings = pairs.select("attribute", "value").distinct().select("attribute", "value", F.posexplode_outer(tx.pairs(F.col("value"))).alias("at", "p"))
    own = F.min_by("p.value", F.when(F.col("p.attribute") == F.col("attribute"), F.col("at")))
    df = readings.groupBy("attribute", "value").agg(own.alias("own"))
    df = df.withColumn("key", alias_of(F.col("attribute"), folded(F.coalesce(F.when(F.col("own") != "", F.col("own")), "value"))))
    plain = F.trim(F.replace(F.replace("key", F.lit("made entirely of ")), F.lit("entirely ")))
    return df.select("attribute", "value", F.when((F.col("attribute") == "material") & F.contains("key", F.lit("entirely")), plain).otherwise(F.col("key")).alias("concept"))


def concepts(index: DataFrame) -> DataFrame:
    """(attribute, concept, label, parent_asin, cat_pos): every reading of every card string; each distinct string is read once."""
    cards = index.select("parent_asin", "cat_pos", F.explode("card").alias("label"))
    read = cards.select("label").distinct().select("label", F.explode(tx.pairs(F.col("label"))).alias("p")).select("label", "p.*")
    read = read.join(with_concepts(read), ["attribute", "value"])
    return cards.join(read, "label").select("attribute", "concept", "label", "parent_asin", "cat_pos")


def representatives(found: DataFrame) -> DataFrame:
    """(attribute, concept, label, n_labels, support): the literal spelling first, then the most frequent, the shortest, the last by code point."""
    key = ["attribute", "concept"]
    labels = found.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n"))
    best = labels.groupBy(*key).agg(F.max_by("label", F.struct(folded(F.col("label")) == F.col("concept"), "n", -F.length("label"), "label")).alias("label"), F.count(F.lit(1)).alias("n_labels"))
    return best.join(found.groupBy(*key).agg(F.countDistinct("parent_asin").alias("support")), key)


def canonical(phrases: DataFrame, found: DataFrame) -> DataFrame:
    """(attribute, phrase) to (attribute, phrase, label): the catalog's spelling, or null.

    A label that reads the same once folded (the most frequent, then the first of the catalog), else the representative of
    the concept that the phrase or its alias names; fragments that could mean several things get none.
    """
    labels = found.groupBy("attribute", "label").agg(F.count(F.lit(1)).alias("n"), F.min("cat_pos").alias("at"))
    literal = labels.groupBy("attribute", folded(F.col("label")).alias("key")).agg(F.max_by("label", F.struct("n", -F.col("at"), "label")).alias("literal"))
    meant = representatives(found).select("attribute", F.col("concept").alias("meaning"), F.col("label").alias("meant"))
    df = phrases.withColumn("key", folded(F.col("phrase"))).withColumn("meaning", alias_of(F.col("attribute"), F.col("key")))
    df = df.join(literal, ["attribute", "key"], "left").join(meant, ["attribute", "meaning"], "left")
    return df.select("attribute", "phrase", F.coalesce("literal", F.when(~F.col("key").isin(*AMBIGUOUS), F.col("meant"))).alias("label"))


def bitmaps(members: DataFrame, *key: str) -> DataFrame:
    """(key, item) to (key, bucket, bits): item numbers as bits, 32,768 to a bucket, combined before they are shuffled."""
    at = members.select(*key, F.bitmap_bucket_number("item").alias("bucket"), F.bitmap_bit_position("item").alias("bit"))
    return at.groupBy(*key, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def joint_support(asked: DataFrame, found: DataFrame, pool: DataFrame, *key: str) -> DataFrame:
    """(opener, key, attribute, concept) to (opener, key, n_items): items of the opener's pool that have every concept of the key's rows.

    Sets of items are bitmaps in buckets of item numbers; a conjunction is their AND, bucket by bucket, and a bucket that one of them lacks is empty. A row
    of the shuffle is a bucket, never an item of a pool. ``found`` is concepts(), whose cat_pos numbers the items.
    """
    items = found.select("parent_asin", F.col("cat_pos").alias("item")).distinct()
    pools = bitmaps(pool.join(items, "parent_asin").select("opener", "item"), "opener")
    sets = bitmaps(found.select("attribute", "concept", F.col("cat_pos").alias("item")), "attribute", "concept")
    asked = asked.select("opener", *key, F.col("attribute").alias("a"), F.col("concept").alias("c")).distinct()
    keys = asked.groupBy("opener", *key).agg((F.count(F.lit(1)) + 1).alias("n"))
    rows = asked.join(sets, (F.col("a") == F.col("attribute")) & (F.col("c") == F.col("concept"))).select("opener", *key, "bucket", "bits")
    rows = rows.unionByName(keys.select("opener", *key).join(pools, "opener").select("opener", *key, "bucket", "bits"))
    both = rows.groupBy("opener", *key, "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("of"))
    both = both.join(keys, ["opener", *key]).where(F.col("of") == F.col("n")).groupBy("opener", *key).agg(F.sum(F.bitmap_count("bits")).alias("n_items"))
    return keys.drop("n").join(both, ["opener", *key], "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def support(asked: DataFrame, found: DataFrame, pools: ctg.Pools) -> DataFrame:
    """(opener, attribute, concept) to the number of items of the opener's pool that have the concept, counted once for all openers of a pool."""
    named = asked.join(pools.of, "opener").select("opener", "pool", "attribute", "concept")
    once = named.select(F.col("pool").alias("opener"), "attribute", "concept", F.col("attribute").alias("of_a"), F.col("concept").alias("of_c")).distinct()
    counts = joint_support(once, found, pools.items.select(F.col("pool").alias("opener"), "parent_asin"), "of_a", "of_c")
    counts = counts.select(F.col("opener").alias("pool"), F.col("of_a").alias("attribute"), F.col("of_c").alias("concept"), "n_items")
    return named.join(counts, ["pool", "attribute", "concept"]).select("opener", "attribute", "concept", "n_items")


def category_hypotheses(phrases: DataFrame, categories: DataFrame, temperature: float = ctg.TEMPERATURE) -> DataFrame:
    """(phrase) to (phrase, rank, category, p): the named category alone, else the best that share a stem, renormalised.

    Phrases without a shared stem have no rows. Only sharing pairs are formed: the mass of all others cancels.
    """
    said = phrases.where(F.trim("phrase") != "").select(F.col("phrase").alias("opener")).distinct()
    names = categories.groupBy(F.lower("category").alias("low")).agg(F.min("category").alias("exact"))
    df = ctg.scores(said, categories).join(categories.select("category", "cat_idx", "log_prior"), "category")
    df = df.withColumn("logit", F.round(F.col("score") / temperature + ctg.PRIOR * F.col("log_prior"), 9))
    order = Window.partitionBy("opener").orderBy(F.desc("logit"), "cat_idx")
    df = df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HYPOTHESES)
    own = Window.partitionBy("opener")
    df = df.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(own))).withColumn("p", F.col("e") / F.sum("e").over(own))
    exact = said.join(names, F.lower(F.trim("opener")) == F.col("low")).select(F.col("opener").alias("phrase"), F.lit(1).alias("rank"), F.col("exact").alias("category"), F.lit(1.0).alias("p"))
    other = df.select(F.col("opener").alias("phrase"), "rank", "category", "p").join(exact.select("phrase"), "phrase", "left_anti")
    return exact.unionByName(other)


def category_of_phrase(hypotheses: DataFrame) -> DataFrame:
    """(phrase, category): the first hypothesis if it is sure, alone or clear of the second, else null."""
    p = lambda k: F.max(F.when(F.col("rank") == k, F.col("p")))
    df = hypotheses.groupBy("phrase").agg(p(1).alias("p1"), p(2).alias("p2"), F.max(F.when(F.col("rank") == 1, F.col("category"))).alias("category"))
    good = (F.round("p1", 9) >= SURE) | F.col("p2").isNull() | (F.round("p1", 9) >= F.round(CLEAR * F.col("p2"), 9))
    return df.select("phrase", F.when(good, F.col("category")).alias("category"))
