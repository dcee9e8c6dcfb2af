"""The weighted-field baseline: full-text retrieval over the catalog's fields, without state.

What a term adds to an item's score does not depend on the query, so items are dealt to blocks, and every block adds up whole scores of all queries that ask for different terms and
keeps its best of each. A query's terms are added in the same order everywhere, so that equal scores are equal to the last bit. Only these best leave a block; no pair of a query and an item is shuffled.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harken.functions import blocks
from harken.operators import catalog as cat
from harken.sources.stages import staged

# The stop list, the fields and their weights, the terms of a query, the ranking function's constants.
STOPWORDS = "a an and are as at be but by for from i in is it me my of on or please some that the this to want with would you looking".split()
FIELDS = {"title": 6.0, "categories": 4.0, "features": 2.5, "details": 2.5, "store": 1.5, "description": 1.0}
MOST_TERMS, K1, B, LEAST_IDF = 40, 1.2, 0.75, 1e-6
#: Items of a block, bags that a task ranks them for, and what the rounding of a score may change.
ITEMS, BAGS, SLACK = 16_384, 4_096, 2e-9


@lru_cache(maxsize=1)
def bare_letters() -> tuple[str, str]:
    """Every letter of the basic plane that canonical decomposition splits into one letter and marks, and that letter, by Unicode's own tables."""
    split = ((c, [x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")]) for c in map(chr, range(0xC0, 0xD800)) if c.isalpha())
    found = [(c, d[0]) for c, d in split if len(d) == 1 and d[0] != c]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def query_terms(text: Column) -> Column:
    """Terms of a query in order, with repeats: runs of letters and digits, of two or more, that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def field_tokens(text: Column) -> Column:
    """Tokens of a field: lower case, letters without their marks, runs of letters and digits of any script."""
    marked, plain = bare_letters()
    return F.regexp_extract_all(F.regexp_replace(F.translate(F.lower(text), marked, plain), r"\p{M}+", ""), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def postings(catalog: DataFrame, want: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the terms in ``want`` (term): (term, parent_asin, cat_pos, weight, len) with the weighted count over all fields, (term, df), and one row of (n, avg_len)."""
    df = cat.prepared(catalog)
    text = {"details": F.concat_ws(" ", F.transform("details", lambda d: F.concat_ws(" ", d["key"], d["value"])))}
    sets = {f: field_tokens(F.coalesce(text.get(f, F.concat_ws(" ", f)), F.lit(""))) for f in FIELDS}
    df = df.select("parent_asin", "cat_pos", *[t.alias(f) for f, t in sets.items()]).withColumn("len", sum((F.size(f) for f in FIELDS), F.lit(0)))
    each = F.concat(*[F.transform(f, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))) for f, w in FIELDS.items()])  # noqa: B023
    df = staged(df.select("parent_asin", "cat_pos", "len", each.alias("tokens")), "item-tokens")
    counts = df.select(F.explode(F.array_distinct(F.transform("tokens", lambda x: x["term"]))).alias("term")).join(want, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = df.select("parent_asin", "cat_pos", "len", F.explode("tokens").alias("x")).select("parent_asin", "cat_pos", "len", "x.*").join(want, "term", "left_semi")
    rows = rows.groupBy("term", "parent_asin", "cat_pos", "len").agg(F.sum("w").alias("weight"))
    return rows, counts, df.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))


def impacts(rows: DataFrame, counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(term, parent_asin, cat_pos, part): what each term adds to an item's score, whatever the query."""
    idf = counts.crossJoin(F.broadcast(sizes))  # sizes is one row
    idf = idf.select("term", "avg_len", F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    w = F.col("weight")
    part = F.col("idf") * w * (K1 + 1) / (w + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return rows.join(staged(idf, "idf"), "term").select("term", "parent_asin", "cat_pos", part.alias("part"))


def best_of_block(bags: pa.Table, parts: pa.Table, top: int) -> pa.Table:
    """(bag, parent_asin, cat_pos, score): of each bag, the items of a block that may be among its ``top`` best, these included, by whole scores."""
    places, first, row = np.unique(parts["cat_pos"].to_numpy(), return_index=True, return_inverse=True)
    of = blocks.by_term(parts["term"], row, parts["part"].to_numpy())
    sums = blocks.summed(bags["terms"].to_pylist(), of, len(places))
    bag, hit, score = blocks.gathered((at, *blocks.best(rows, score, top, SLACK)) for at, rows, score in sums)
    names = parts["parent_asin"].take(pa.array(first[hit]))
    return pa.Table.from_arrays([bags["bag"].take(pa.array(bag)), names, pa.array(places[hit], pa.int64()), pa.array(score)], ["bag", "parent_asin", "cat_pos", "score"])


def search(queries: DataFrame, catalog: DataFrame, top: int = 10) -> DataFrame:
    """(query) to (query, rank, parent_asin, score): the best items for the first distinct terms of each query, ties in the catalog's order.

    Queries of the same terms are one search. Terms that no item has do not count; a query without others has no rows.
    """
    want = queries.select("query").distinct().select("query", F.explode(F.slice(F.array_distinct(query_terms(F.col("query"))), 1, MOST_TERMS)).alias("term"))
    want = staged(want, "query-terms")
    parts = staged(impacts(*postings(catalog, staged(want.select("term").distinct(), "terms"))), "impacts")
    bounds = parts.groupBy("term").agg(F.max("part").alias("most"))
    known = want.join(bounds, "term").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("most", "term")), asc=False).alias("terms"))
    known = known.withColumn("terms", F.transform("terms", lambda t: t["term"])).withColumn("bag", F.array_join("terms", " "))
    known = staged(known, "queries")
    bags = staged(known.select("bag", "terms").dropDuplicates(["bag"]), "bags")
    n_blocks, n_chunks = (-(-n // most) or 1 for n, most in ((parts.agg(F.countDistinct("cat_pos")).first()[0], ITEMS), (bags.count(), BAGS)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = bags.select("*", dealt("bag", n_chunks).alias("chunk")).select("*", every(n_blocks).alias("block"))
    parts = parts.select("*", dealt("cat_pos", n_blocks).alias("block")).select("*", every(n_chunks).alias("chunk"))
    found = asked.groupBy("block", "chunk").cogroup(parts.groupBy("block", "chunk")).applyInArrow(lambda a, b: best_of_block(a, b, top), "bag string, parent_asin string, cat_pos long, score double")
    order = Window.partitionBy("bag").orderBy(F.desc(F.round("score", 9)), "cat_pos")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return known.select("query", "bag").join(found, "bag").select("query", "rank", "parent_asin", "score")
