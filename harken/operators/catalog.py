"""Catalog operators: cards, categories, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harken.functions import text as tx

NO_CATEGORY = ("clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry")


def coarse_category(categories: Column) -> Column:
    parts = F.flatten(F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.transform(F.split(c, ","), lambda p: F.trim(p))))
    parts = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*NO_CATEGORY))
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    return F.when(F.size(parts) > 0, F.array_join(last, " ")).otherwise("clothing item")


#: What an item's features are made of, in one form whatever the source; columns that a source lacks are null.
ITEM = {
    "parent_asin": "string",
    "cat_pos": "bigint",
    "title": "string",
    "features": "array<string>",
    "description": "array<string>",
    "price": "string",
    "categories": "array<string>",
    "rating_number": "double",
    "store": "string",
}


def said(values: Column) -> Column:
    """The strings of an array that say something."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))


def prepared(catalog: DataFrame) -> DataFrame:
    """Items of a catalog, from JSON lines (details is a map) or a view (details is an array of pairs), in one form: details as ordered pairs.

    Rows without an id go. The catalog's order, ``cat_pos``, comes with the source.
    """
    kinds = {f.name: f.dataType.typeName() for f in catalog.schema.fields}
    cols = [(F.col(c) if c in kinds else F.lit(None)).cast(t).alias(c) for c, t in ITEM.items()]
    pair = "array<struct<key:string,value:string>>"
    details = F.lit(None).cast(pair)
    if "details" in kinds:
        details = F.map_entries("details").cast(pair) if kinds["details"] == "map" else F.col("details").cast(pair)
    details = F.filter(F.coalesce(details, F.array().cast(pair)), lambda d: d["value"].isNotNull() & ~d["value"].isin("", "[]"))
    return catalog.select(*cols, details.alias("details")).where(F.col("parent_asin").isNotNull() & (F.col("parent_asin") != ""))


def flattened_details() -> Column:
    return F.transform("details", lambda d: F.concat(d["key"], F.lit(": "), d["value"]))


def searchable() -> Column:
    pairs = F.transform("details", lambda d: F.concat(d["key"], F.lit(" "), d["value"]))
    return F.concat_ws(" ", "title", "features", pairs, "description", "categories", "store")


def card(words: Column) -> Column:
    """The ordered strings that an item's intent card is taken from; ``words`` is its searchable text."""
    word = lambda pattern: F.lower(F.regexp_extract(words, pattern, 1))
    found = F.concat(said(F.col("features")), flattened_details())
    found = F.when(word(tx.MATERIAL) != "", F.concat(F.array(word(tx.MATERIAL)), found)).otherwise(found)
    color = F.array(F.concat(F.lit("color: "), word(tx.COLOR)))
    found = F.when(word(tx.COLOR) != "", F.concat(F.slice(found, 1, 1), color, F.slice(found, F.lit(2), F.greatest(F.size(found), F.lit(1))))).otherwise(found)
    found = F.when(F.coalesce(F.col("price"), F.lit("")) != "", F.concat(found, F.array(F.concat(F.lit("budget around $"), F.col("price"))))).otherwise(found)
    clean = F.array_distinct(F.filter(F.transform(found, lambda s: tx.clean_constraint(s)), lambda s: s.isNotNull() & (s != "")))
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("title")).otherwise(F.lit("product"))
    return F.when(F.size(clean) > 0, clean).otherwise(F.array(tx.clean_constraint(title)))


def item_index(catalog: DataFrame) -> DataFrame:
    """Every feature that ranking needs, one row per item, of any catalog that prepared() takes."""
    # a generator of one row keeps what it makes from being written out again wherever it is named
    # a small file or shuffle would be one task; the patterns take time for every item
    df = prepared(catalog).repartition(int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")), "parent_asin")
    df = df.select("*", F.explode(F.array(searchable())).alias("words"))
    df = df.select("*", F.explode(F.array(card(F.col("words")))).alias("strings"))
    df = df.withColumn("hard", F.slice("strings", 1, 2)).withColumn("soft", F.when(F.size("strings") > 2, F.slice("strings", 3, 2)).otherwise(F.slice("strings", 1, 1)))
    features = said(F.col("features"))
    title, store = (F.coalesce(c, F.lit("")) for c in ("title", "store"))
    return df.select(
        "parent_asin",
        "cat_pos",
        title.alias("title"),
        "store",
        "features",
        F.coalesce("rating_number", F.lit(0.0)).alias("rating_number"),
        F.log1p(F.coalesce("rating_number", F.lit(0.0))).alias("log_pop"),
        coarse_category(F.col("categories")).alias("category"),
        "hard",
        "soft",
        F.concat("hard", "soft").alias("card"),
        F.concat(features, flattened_details()).alias("spec"),
        F.concat_ws(" ", title, store, said(F.col("categories")), F.slice(features, 1, 8)).alias("lexical_text"),
    )


def popularity(index: DataFrame, n: int = 50) -> DataFrame:
    return index.orderBy(F.desc("log_pop"), "cat_pos").limit(n)


def item_pairs(index: DataFrame) -> DataFrame:
    """(parent_asin, attribute, value), distinct, over an item's whole specification; each distinct string is read once."""
    each = index.select("parent_asin", F.explode("spec").alias("s"))
    read = each.select("s").distinct().select("s", F.explode(tx.pairs(F.col("s"))).alias("p")).select("s", "p.*")
    return each.join(read, "s").select("parent_asin", "attribute", "value").distinct()
