"""Source divergence audit (operator 11): how far the sources of a language differ in the terms they use, and by which terms.

A byte-level tokenizer counts the terms: a table of 256 entries says which bytes belong to a term, term boundaries are where its value
changes along the concatenated UTF-8 buffers of a batch, xxhash groups the slices between them, and every slice is compared byte by byte with
the first of its group, so that two terms with one hash stay apart. Counts are summed by language, source and term in Spark. The kept terms of a
language lie in buckets by hash; a task holds one bucket as a sparse matrix, a row for each source, and gives each pair of sources what the bucket
adds to its divergence: the stored entries by one ``reduceat`` over the rows, what is stored in neither by sorted prefix sums. Nothing is dense but one row of
one bucket. Probabilities are integers in units of 1 / SCALE, rounded down, so every sum is exact and free of order.

Edge cases: null text, language and source count as empty strings; a source without terms has every kept term at the prior; a
language without kept terms has pairs of value 0 and no terms; a language of one source has no pairs; repeated rows are documents of their own; equal values are
ranked by the item's bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Units of a probability, what is added to each count, documents a kept term is in, terms that are reported of a source.
SCALE, PRIOR, MIN_DOCS, TOP = 10**9, 5, 30, 50
#: Slices that are hashed and compared at once; entries of a bucket, on average; sources whose pairs one task forms.
SLICES, ENTRIES, SOURCES = 1 << 18, 1 << 16, 256

#: Bytes of a term: letters and all of a character beyond ASCII. Only A to Z have a lower case.
TERM = np.zeros(256, dtype=bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def boundaries(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text of every term in ``raw``, where text i is raw[bounds[i]:bounds[i + 1]]."""
    if not len(raw):
        return (np.zeros(0, dtype=np.int64),) * 3
    inside = TERM[raw]
    first, last = np.ones(len(raw) + 1, dtype=bool), np.ones(len(raw) + 1, dtype=bool)
    first[1:-1] = ~inside[:-1]
    last[:-2] = ~inside[1:]
    first[bounds[:-1]] = True
    last[bounds[1:] - 1] = True
    starts, ends = np.flatnonzero(inside & first[:-1]), np.flatnonzero(inside & last[:-1]) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


class Terms:
    """Distinct terms by number, in the order of their first slice."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}

    def number(self, term: bytes) -> int:
        return self.numbers.setdefault(term, len(self.numbers))

    def codes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each slice's term: grouped by hash, then verified against the first slice of the group."""
        held, out = raw.tobytes(), []
        for lo in range(0, len(starts), SLICES):
            s, e = starts[lo : lo + SLICES], ends[lo : lo + SLICES]
            hashes = np.fromiter((digest(held[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)), dtype=np.uint64, count=len(s))
            _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
            known = np.array([self.number(held[s[i] : e[i]]) for i in first.tolist()], dtype=np.int64)
            out.append(known[group])
            for i in np.flatnonzero(differ(raw, s, e, first[group])).tolist():
                out[-1][i] = self.number(held[s[i] : e[i]])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


digest = xxhash.xxh3_64_intdigest


def differ(raw: np.ndarray, s: np.ndarray, e: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whether slice i has other bytes than slice like[i]."""
    n, out = e - s, (e - s) != (e - s)[like]
    same = np.flatnonzero(~out & (like != np.arange(len(s))))
    if len(same):
        sizes = n[same]
        offsets = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum()))
        unequal = raw[step + np.repeat(s[same] - offsets, sizes)] != raw[step + np.repeat(s[like[same]] - offsets, sizes)]
        out[same] = np.logical_or.reduceat(unequal, offsets)
    return out


def batch_counts(langs: list[str], sources: list[str], texts: pa.Array) -> tuple[list, list, list, np.ndarray, np.ndarray]:
    """Language, source, term, occurrences and documents of what a batch holds; each language and source once more without a term."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = LOWER[np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    starts, ends, text = boundaries(raw, bounds - bounds[0])
    terms, groups = Terms(), {}
    group = np.array([groups.setdefault(k, len(groups)) for k in zip(langs, sources, strict=True)], dtype=np.int64)
    codes, v = terms.codes(raw, starts, ends), max(1, len(terms.numbers))
    pairs, n = np.unique(text * v + codes, return_counts=True)
    keys, at = np.unique(group[pairs // v] * v + pairs % v, return_inverse=True) if len(pairs) else (pairs, pairs)
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, at, n)
    names, spelt = list(groups), [t.decode("utf-8", "replace") for t in terms.numbers]
    of, more = [names[g] for g in (keys // v).tolist()] + names, [None] * len(names)
    zeros = np.zeros(len(names), dtype=np.int64)
    return [k[0] for k in of], [k[1] for k in of], [spelt[t] for t in (keys % v).tolist()] + more, np.concatenate([total, zeros]), np.concatenate([np.bincount(at, minlength=len(keys)).astype(np.int64), zeros])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, n_docs; one row with a null term for each language and source that occurs."""
    bounded_batches(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source, term, n, n_docs = batch_counts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
            cols = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.string()), pa.array(n), pa.array(n_docs)]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "n_docs"])

    rows = read.mapInArrow(count, "lang string, source string, term string, n long, n_docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: Column, total: Column, scale: int, prior: int, v: Column) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * v)), exactly; null where nothing is kept."""
    above = F.lit(scale).cast("decimal(13,0)") * (n + prior).cast("decimal(18,0)")
    below = (total + F.lit(prior) * v).cast("decimal(18,0)")
    return F.when(v > 0, 1 + F.call_function("div", above, below))


def matrix_sums(term: np.ndarray, row: np.ndarray, p: np.ndarray, base: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j), lo <= i < hi, i < j, of rows of a sparse matrix, and the sum of their absolute differences over all columns.

    Entries are (row, term) with value p; what is not stored in row i has the value base[i].
    """
    n, k = len(base), int(term.max()) + 1 if len(term) else 0
    order = np.lexsort((term, row))
    col, data, own = term[order], p[order], row[order]
    ptr = np.searchsorted(own, np.arange(n + 1))
    filled = np.flatnonzero(np.diff(ptr))
    out = []
    for i in range(lo, min(hi, n)):
        dense = np.full(k, base[i])
        dense[col[ptr[i] : ptr[i + 1]]] = data[ptr[i] : ptr[i + 1]]
        # every column as if row j held nothing but its base: by the sorted row i and its prefix sums
        ranked = np.sort(dense)
        below = np.concatenate([[0], np.cumsum(ranked)])
        at = np.searchsorted(ranked, base)
        sums = base * at - below[at] + (below[-1] - below[at]) - base * (k - at)
        if len(filled):  # what the stored entries change
            there = dense[col]
            sums[filled] += np.add.reduceat(np.abs(data - there) - np.abs(base[own] - there), ptr[filled])
        out.append(sums[i + 1 :])
    counts = [len(x) for x in out]
    first = np.repeat(np.arange(lo, lo + len(out)), counts)
    second = np.concatenate([np.arange(i + 1, n) for i in range(lo, lo + len(out))]) if out else first
    return first, second, np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _pair_sums(entries: pa.Table, sources: pa.Table, most: int) -> pa.Table:
    """The sums of one bucket for pairs whose first source is in a block of ``most``."""
    sources = sources.sort_by("place")
    names, base = sources.column("source"), sources.column("base").to_numpy()
    term = pc.dictionary_encode(entries.column("term")).combine_chunks()
    codes = term.indices.to_numpy() if len(term) else np.zeros(0, dtype=np.int64)
    lo = int(sources.column("block")[0].as_py()) * most
    i, j, value = matrix_sums(codes.astype(np.int64), entries.column("place").to_numpy(), entries.column("p").to_numpy(), base, lo, lo + most)
    names = names.combine_chunks()
    lang = pa.repeat(sources.column("lang")[0], len(i))
    return pa.table([lang, names.take(pa.array(i)), names.take(pa.array(j)), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, prior: int = PRIOR, scale: int = SCALE, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", entries_of: int = ENTRIES, sources_of: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has each other source of the language, part ``term`` the ``top`` terms that the source uses more than its language.

    A bucket has ``entries_of`` counts on average; a task forms the pairs of ``sources_of`` sources with all others.
    """
    spark = docs.sparkSession
    each = Window.partitionBy("lang", "term")
    counts = term_counts(docs, text_col, lang_col, source_col)
    counts = counts.withColumns({"in_docs": F.sum("n_docs").over(each), "lang_n": F.sum("n").over(each), "once": (F.row_number().over(each.orderBy("source")) == 1).cast("long")})
    counts = written(spark, counts.where(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).drop("n_docs", "in_docs"), "terms")

    # a row for each source of each language, with what a share needs; places number the sources of a language
    real = F.col("term").isNotNull()
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(real, F.col("once")).otherwise(0)).alias("v"), F.sum(real.cast("long")).alias("n_rows"))
    of = Window.partitionBy("lang")
    groups = groups.withColumns({k: F.sum(c).over(of) for k, c in (("lang_total", "total"), ("v", "v"), ("lang_rows", "n_rows"))} | {"place": F.row_number().over(of.orderBy("source")) - 1, "n_sources": F.count(F.lit(1)).over(of)})
    groups = groups.select(
        "lang", "source", "total", "lang_total", "v", "place",
        F.coalesce(share(F.lit(0), F.col("total"), scale, prior, F.col("v")), F.lit(0)).alias("base"),
        F.greatest(F.ceil(F.col("lang_rows") / entries_of), F.lit(1)).cast("int").alias("n_buckets"),
        F.ceil(F.col("n_sources") / sources_of).cast("int").alias("n_blocks"),
    )
    groups = written(spark, groups, "groups")

    entries = counts.where(real).join(groups, ["lang", "source"])
    entries = entries.withColumns({"p": share(F.col("n"), F.col("total"), scale, prior, F.col("v")), "q": share(F.col("lang_n"), F.col("lang_total"), scale, prior, F.col("v"))})
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = entries.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = entries.select("lang", "term", "place", "p", F.pmod(F.xxhash64("term"), F.col("n_buckets")).cast("int").alias("bucket"), upto("n_blocks").alias("block"))
    right = groups.select("lang", "source", "place", "base", "n_blocks", upto("n_buckets").alias("bucket")).select("*", upto("n_blocks").alias("block")).drop("n_blocks")
    right, keys = right.toDF(*right.columns), ("lang", "bucket", "block")  # columns of its own, as both sides come from one table
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda x, y: _pair_sums(x, y, sources_of), "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", both.alias("b"), "value").select("lang", "b.source", "b.item", "value").withColumn("rank", F.row_number().over(ranked))

    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return pairs.select(*columns("pair")).unionByName(terms.select(*columns("term")))
