"""Benchmark decontamination (operator 7): winnowing.

Each window of ten words holds six 5-grams; its fingerprint is the least of their hashes. Equal windows have equal
fingerprints, so a document that shares ten words in a row with an item shares the fingerprint of that window, whatever
surrounds it: no shared span of ten words can be missed. Neighbouring windows mostly have the same one, so a text has about two
fingerprints for seven words. An item of fewer than ten words is one window, and the hash of its words its fingerprint.

1. The benchmark becomes a table of (window, fingerprint, item); it is never collected.
2. Each text's distinct fingerprints are joined with the benchmark's; texts that share some are the candidates.
3. Candidates' windows with a shared fingerprint are extended to their words and joined with the benchmark's windows by those words, so a
   hit is exact. Hits are gathered per distinct text, then joined back to all documents.

The benchmark's side of a join is broadcast only if it has been counted and has at most BROADCAST rows; beyond that the joins shuffle
fingerprints and windows, and adaptive execution splits hot ones. Texts are told apart by 128 bits of hash.

Edge cases: a null or empty text has no words, no hits, and is clean; an item without words has no window; items of equal id
count once; an item without an id is one item, the last; repeated documents are judged alike, one by one; an empty benchmark leaves
all clean; an empty corpus gives an empty table; input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nested, restore, text_of, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of ASCII digits, lower-case ASCII letters and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window, and of the grams whose least hash is its fingerprint.
WINDOW, GRAM = 10, 5
#: Rows of the benchmark that are broadcast at most, of about 100 bytes.
BROADCAST = 200_000


def folded_words(text: Column) -> Column:
    """Words after lower-casing A-Z only. lower() does that to pure ASCII; other texts take the slower way."""
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _gram(i: Column, k: int, seed: int) -> Column:
    """Hash of the k words from place i on."""
    return F.xxhash64(F.lit(seed), *[F.get(F.col("hashes"), i + j) for j in range(k)])


def _places(length: int) -> Column:
    return F.when(F.col("n") >= length, F.sequence(F.lit(0), F.col("n") - length)).otherwise(F.array().cast("array<int>"))


def _hashed(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` with the words of t, their number and their hashes."""
    df = df.select(*keep, folded_words(F.col("t")).alias("w"))
    return df.select(*keep, "w", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"))


def _fingerprinted(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds fp<m> for each length of windows: the fingerprint of the window at each place."""
    for m in lengths:
        if m < WINDOW:
            df = df.withColumn(f"fp{m}", F.transform(_places(m), lambda i: _gram(i, m, m)))  # noqa: B023
        else:
            df = df.withColumn("grams", F.transform(_places(GRAM), lambda i: _gram(i, GRAM, 0)))
            least = lambda i: F.least(*[F.get(F.col("grams"), i + j) for j in range(WINDOW - GRAM + 1)])
            df = df.withColumn(f"fp{m}", F.transform(_places(m), least))
    return df


def _said(i: Column, m: int) -> Column:
    """The m words from place i on, joined by blanks, which no word holds."""
    return F.concat_ws(" ", *[F.get(F.col("w"), i + j) for j in range(m)])


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """The table (said, fp, item), distinct, and the lengths of its windows, ten at most."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), text_of(text_col).alias("t"))
    df = _hashed(items, "item")
    lengths = sorted(r["m"] for r in df.where("n > 0").select(F.least("n", F.lit(WINDOW)).alias("m")).distinct().collect())
    nothing = F.array().cast("array<struct<said:string,fp:bigint>>")
    df = _fingerprinted(df, lengths)
    of = {m: F.transform(f"fp{m}", lambda x, i: F.struct(_said(i, m).alias("said"), x.alias("fp"))) for m in lengths}  # noqa: B023
    found = nothing
    for m in lengths:
        found = F.when(F.col("n") >= m if m == WINDOW else F.col("n") == m, of[m]).otherwise(found)
    rows = df.select("item", F.explode_outer(found).alias("x")).where("x is not null").select("x.said", "x.fp", "item").distinct()
    return written(benchmark.sparkSession, rows, "benchmark-windows"), lengths


def _checked(side: DataFrame, most: int) -> DataFrame:
    """``side`` as the side to broadcast if it has at most ``most`` rows."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def _small(found: DataFrame, most: int) -> DataFrame:
    """``found`` as the side to broadcast if it has at most ``most`` rows with forty places or items each on average, so that a text with many copies is no hot key."""
    n, held = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("places") + F.size("items")), F.lit(0))).first()
    return F.broadcast(found) if n <= most and held <= 40 * most else found


def hits(texts: DataFrame, benchmark: DataFrame, item_col: str = "item_id", broadcast: int = BROADCAST) -> DataFrame:
    """From rows (k1, k2, t): one row per distinct text with hits: k1, k2, places of hit words, ascending, and items, sorted."""
    spark, key = texts.sparkSession, ["k1", "k2"]
    windows, lengths = benchmark_windows(benchmark, item_col)
    prints = windows.select("fp").distinct()
    own = _fingerprinted(_hashed(texts, *key), lengths)
    every = F.array_distinct(F.concat(F.array().cast("array<bigint>"), *[F.col(f"fp{m}") for m in lengths]))
    own = own.select(*key, F.explode_outer(every).alias("fp"))  # explode() would infer a filter that computes all of it again
    met = own.join(_checked(prints, broadcast), "fp").groupBy(*key).agg(F.collect_set("fp").alias("met"))
    met = written(spark, met, "benchmark-candidates")

    # of equal texts one is looked at again: they meet before they are shuffled, where the candidates can be broadcast
    again = texts.join(_checked(met, broadcast), key).groupBy(*key).agg(F.first("t").alias("t"), F.first("met").alias("met"))
    found = _fingerprinted(_hashed(again, *key, "met"), lengths)
    nothing = F.array().cast("array<struct<i:int,m:int,said:string>>")
    spans = []
    for m in lengths:
        at = F.filter(F.transform(f"fp{m}", lambda x, i: F.when(F.array_contains("met", x), i)), lambda i: i.isNotNull())
        spans.append(F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(m).alias("m"), _said(i, m).alias("said"))))  # noqa: B023
    found = found.select(*key, F.explode_outer(F.concat(nothing, *spans)).alias("x")).select(*key, "x.i", "x.m", "x.said")
    found = found.join(_checked(windows.select("said", "item"), broadcast), "said")
    found = found.groupBy(*key).agg(F.collect_set(F.struct("i", "m")).alias("spans"), F.collect_set(F.struct("item")).alias("items"))
    places = F.flatten(F.transform("spans", lambda x: F.sequence(x["i"], x["i"] + x["m"] - 1)))
    items = F.array_sort(F.transform("items", lambda x: x["item"]))
    return written(spark, found.select(*key, F.array_sort(F.array_distinct(places)).alias("places"), items.alias("items")), "benchmark-hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` with n_words, hit_words (their places, ascending), items (ids as strings, sorted) and contaminated."""
    t, key = text_of(text_col), ["k1", "k2"]
    k1, k2 = F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")
    found = hits(docs.select(k1, k2, t.alias("t")), benchmark, item_col, broadcast)
    df = docs.select(nested(docs).alias("row"), k1, k2, F.regexp_count(t, F.lit(RAW_WORD)).cast("long").alias("n")).join(_small(found, broadcast), key, "left")
    places = F.coalesce("places", F.array().cast("array<int>"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return restore(df, docs, "row", {"n_words": F.col("n"), "hit_words": places, "items": items, "contaminated": F.col("places").isNotNull()})
