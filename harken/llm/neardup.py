"""Near-duplicates (operator 6): improved consistent weighted sampling over TF-IDF shingles.

1. Every text becomes the multiset of its five-word shingles, as 64-bit hashes (words are lower-cased runs of letters,
   digits and anything beyond ASCII; a text of fewer words is one shingle).
2. A sketch (one counter per bucket of hashes) counts in how many documents shingles occur; every document counts. A shingle's weight is
   tf * (1 + DAMPING * idf): idf is 1 for shingles in less than COMMON of the documents, and falls with the logarithm of their share to 0 for those
   in all. What rare shingles add to a counter is a fixed share of the documents, far below COMMON, and taken off, so idf means the same at
   every size. The damping keeps what a group of thousands of near copies shares from losing its weight to what sets single copies apart.
3. Improved consistent weighted sampling draws BANDS * ROWS samples per text; two texts agree in a sample with the
   probability of their weighted Jaccard similarity. Samples are banded; texts that agree in a band meet in a bucket.
4. In a bucket, texts are compared with one leader, the text that meets the most others over all its buckets, hence the most central
   one: n - 1 comparisons in a bucket of n texts, which join the bulk of a group of copies.
5. Buckets that still hold several classes are compared whole: their texts are dealt into blocks and every two blocks meet, so that each
   pair of texts that shares a bucket is in one class or has been compared. Only blocks of one and the same class do not meet. There is no
   bound on rounds, partners or candidates.
6. A comparison computes the weighted Jaccard similarity over both whole texts, under the TF-IDF weights and under tf alone, and
   links at THRESHOLD under either. Linked texts form classes (connected components, by large-star and small-star); the second step links classes.

Equal texts are one node from the start and are never compared. Only the sketch (fixed size) reaches the driver. Texts go to blocks by their
size, so that a block's bytes are bounded but for a single long text.

Edge cases: a null text is a class of its own; texts without words are linked only if they are equal; repeated rows share a class; a null id is the
least; an empty table gives an empty table; near_duplicates() reads no columns other than id and text, deduplicated() keeps them as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, nested, restore, strips, written

SHINGLE, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 meets in at least one band with probability 1 - (1 - 0.8**4) ** 14 = 0.9994.
BANDS, ROWS = 14, 4
#: Counters of the document-frequency sketch: 2**16 longs, whatever the corpus. With 300 shingles a document, those that are rare add 0.5 %
#: of the documents to a counter.
SKETCH_BITS = 16
#: The share of documents from which a shingle is common, and the most that idf adds to a weight.
COMMON, DAMPING = 0.01, 0.25
#: Texts of a block, about, the bytes that count as one text more, and shingles that are compared at once.
BLOCK, TEXT_BYTES, BLOCK_SHINGLES = 128, 4096, 1 << 20
#: Shingles whose samples are drawn at once.
STRIP = 1 << 14

U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    """Each byte's lower-case value, 0 for bytes that end a word."""
    t = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.isdigit() or c.islower():
            t[b] = b
        elif c.isupper():
            t[b] = b + 32
    return t


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for p in (base, inverse):
        a = np.full(n, p, dtype=U64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Distinct shingles of each text: (text's place, hash, times) and a 128-bit key of each text's words (None for null).

    Texts of equal words have equal keys; a text without words has the key of the text itself.
    """
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    low = _byte_table()[data]
    solid = np.concatenate([[0], (low != 0).astype(np.int8), [0]])
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum((low.astype(U64) + U64(1)) * up[: len(data)], dtype=U64)])
    word = _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
    lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    first = np.cumsum(lens) - lens
    bounds = np.searchsorted(start, np.concatenate([first, [len(data)]]))
    count = np.diff(bounds)
    keys: list[bytes | None] = []
    for i, x in enumerate(texts):
        body = word[bounds[i] : bounds[i + 1]].tobytes() if count[i] else b"\0" + raw[i]
        keys.append(None if x is None else hashlib.blake2b(body, digest_size=16).digest())
    doc = np.repeat(np.arange(len(raw)), count)
    # the hash of up to five words from each word on; a window that leaves the text counts only if it is the text's first
    place = np.arange(len(word)) - bounds[doc]
    left = count[doc] - place
    h = np.zeros(len(word), dtype=U64)
    for k in range(SHINGLE):
        ahead = np.zeros(len(word), dtype=U64)
        if len(word) > k:
            ahead[: len(word) - k] = word[k:]
        h = np.where(left > k, (h ^ ahead) * U64(0xD6E8FEB86659FD93) + U64(k + 1), h)
    full = (left >= SHINGLE) | (place == 0)
    doc, h = doc[full], _mixed(h[full])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.concatenate([at, [len(h)]])), keys


def sketch(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Document frequencies by bucket of shingles, over all documents, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << SKETCH_BITS, dtype=np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in strips(texts):
                _, h, _, _ = shingles(texts[lo:hi])
                total += np.bincount((h >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
            n += len(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], ["bucket", "n"])

    rows = docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def weights_of(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """The factor 1 + DAMPING * idf of each bucket. The load that a bucket has by chance, the median, is taken off first."""
    share = np.maximum(COMMON, (counts - np.median(counts)) / max(n_docs, 1))
    return (1 + DAMPING * np.clip(np.log(share) / np.log(COMMON), 0, 1)).astype(np.float32)


@dataclass(frozen=True)
class Weights:
    """What tasks need to weigh shingles: a table of fixed size."""

    factor: np.ndarray

    def of(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf.astype(np.float32) * self.factor[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)]


@lru_cache(maxsize=1)
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the gamma distribution of shape 2 at 2**16 places, and their logarithms."""
    x = np.concatenate([np.geomspace(1e-6, 1e-2, 20_000), np.linspace(1e-2, 40, 400_000)[1:]])
    cdf = -np.expm1(-x) - x * np.exp(-x)
    cdf[: np.searchsorted(x, 1e-3)] = x[: np.searchsorted(x, 1e-3)] ** 2 / 2  # where the difference loses its digits
    q = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), cdf, x)
    return q.astype(np.float32), np.log(q).astype(np.float32)


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, count: int) -> np.ndarray:
    """``count`` consistent weighted samples of each text, as 32-bit marks; texts without shingles have zeros.

    For a shingle of weight w: r, c ~ Gamma(2, 1), b ~ U(0, 1), all from the hash of shingle and sample;
    t = floor(ln w / r + b), ln y = r (t - b), and the least ln c - ln y - r of the text wins. The sample is (shingle, t).
    """
    gamma, log_gamma = _gamma()
    best = np.full((count, n_docs), np.iinfo(np.uint64).max, dtype=U64)
    for lo in range(0, len(h), STRIP):
        d, hh, lw = doc[lo : lo + STRIP], h[lo : lo + STRIP], np.log(weight[lo : lo + STRIP])
        starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        who = d[starts]
        for s in range(count):
            x = _mixed(hh + U64((s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            part = x.view(np.uint16).reshape(-1, 4)
            r, b = gamma[part[:, 0]], part[:, 2] * np.float32(1 / 65536)
            t = np.floor(lw / r + b)
            a = log_gamma[part[:, 1]] - r * (t - b) - r
            bits = a.view(np.uint32)
            bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))  # as unsigned, in the order of a
            mark = (x >> U64(32)).astype(np.uint32) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
            low = np.minimum.reduceat((bits.astype(U64) << U64(32)) | mark, starts)
            best[s, who] = np.minimum(best[s, who], low)
    return (best & U64(0xFFFFFFFF)).astype(np.uint32)


def bands_of(marks: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(bands, texts): one 64-bit hash per band of ``rows`` marks."""
    out = np.empty((bands, marks.shape[1]), dtype=U64)
    for b in range(bands):
        x = np.full(marks.shape[1], b + 1, dtype=U64)
        for m in marks[b * rows : (b + 1) * rows]:
            x = _mixed(x * U64(0x9E3779B97F4A7C15) + m)
        out[b] = x
    return out


def _text_hash(text_col: str) -> list[Column]:
    """What tells rows of one id apart, the same on every reading."""
    return [F.xxhash64(F.col(text_col)).alias("h1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("h2")]


def signatures(docs: DataFrame, weights: Weights, id_col: str, text_col: str) -> DataFrame:
    """One row per row: id, key (16 bytes, null for a null text), size (bytes), bands (empty for a text without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}  # the bands of texts seen, as copies often follow one another
        for batch, lo, hi in ((b, *x) for b in batches for x in strips(b.column(1).to_pylist())):
            texts = batch.column(1)[lo:hi].to_pylist()
            doc, h, tf, keys = shingles(texts)
            there = np.bincount(doc, minlength=len(texts)) > 0
            first: dict[bytes, int] = {}
            for i, k in enumerate(keys):
                if k is not None and there[i] and k not in known:
                    first.setdefault(k, i)
            own = np.array(sorted(first.values()), dtype=np.int64)
            place = np.full(len(texts), -1)
            place[own] = np.arange(len(own))
            use = place[doc] >= 0
            marks = samples(place[doc[use]], h[use], weights.of(h[use], tf[use]), len(own), BANDS * ROWS)
            table = bands_of(marks, BANDS, ROWS).T.view(np.int64)
            if len(known) > 20_000:
                known.clear()
            fresh = {k: table[place[i]] for k, i in first.items()}
            bands = [fresh.get(k, known.get(k)) if k is not None and there[i] else None for i, k in enumerate(keys)]
            known.update(fresh)
            flat = [x for x in bands if x is not None]
            offsets = np.concatenate([[0], np.cumsum([0 if x is None else BANDS for x in bands])]).astype(np.int32)
            values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int64)
            size = pc.fill_null(pc.binary_length(batch.column(1)[lo:hi]), 0).cast(pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(keys, pa.binary()), size, lists, *[c[lo:hi] for c in batch.columns[2:]]], ["id", "key", "size", "bands", "h1", "h2"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, *_text_hash(text_col)).mapInArrow(sign, f"id {kind}, key binary, size bigint, bands array<bigint>, h1 bigint, h2 bigint")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: Weights) -> float:
    """The greater of the weighted Jaccard similarities under TF-IDF and under tf weights; a, b: (sorted hashes, times)."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j])
    plain = least.sum() / max(1, a[1].sum() + b[1].sum() - least.sum())
    low, wa, wb = weights.of(shared, least).sum(), weights.of(*a).sum(), weights.of(*b).sum()
    return float(max(plain, low / max(1e-9, wa + wb - low)))


def _sets(keys: list[bytes], texts: list[str]) -> dict[bytes, tuple[np.ndarray, np.ndarray]]:
    """Shingles by key, of the texts that have that key."""
    doc, h, tf, own = shingles(texts)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return {k: (h[cut[i] : cut[i + 1]], tf[cut[i] : cut[i + 1]]) for i, k in enumerate(keys) if own[i] == k}


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): label is the least node of its component.

    Alternates large-star and small-star until every node hangs on one root; every step is a minimum per node, combined before the
    shuffle, and a join, so that a node with very many edges is no hot task.
    """
    now = written(spark, edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    end = lambda node, up, down: F.struct(F.col(node).alias("node"), F.lit(up).alias("up"), F.lit(down).alias("down"))

    def loose() -> bool:
        """Whether a node hangs on two, or on one that hangs on another."""
        ends = now.select(F.explode(F.array(end("a", 1, 0), end("b", 0, 1))).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        return bool(ends.where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).head(1))

    while loose():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = written(spark, small.where("a <> b").distinct(), "components")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _units(size: Column) -> Column:
    """What a text counts in a block."""
    return 1 + F.floor(size / TEXT_BYTES)


def _parts(units: Column) -> Column:
    return F.ceil(units / BLOCK).cast("int")


def _stars(met: DataFrame) -> DataFrame:
    """(spot, side, key, class): the leader of each bucket, side 0, and texts that share a bucket with it, side 1, in blocks.

    What is aggregated by band is written before it is joined back, so that each join reads plain exchanges and a hot bucket can be split.
    """
    spark = met.sparkSession
    lead = written(spark, met.groupBy("band").agg(F.max_by("key", F.struct("popular", "key")).alias("leader")), "leaders")
    pairs = written(spark, met.join(lead, "band").where("key <> leader").groupBy("leader", "key").agg(F.max("size").alias("size")), "pairs")
    parts = pairs.groupBy("leader").agg(_parts(F.sum(_units(F.col("size")))).alias("parts"))
    parts = written(spark, parts, "leader-parts")
    spot = lambda part: F.concat_ws(":", F.hex("leader"), part.cast("string")).alias("spot")
    members = pairs.join(parts, "leader").select(spot(F.pmod(F.xxhash64("key"), F.col("parts"))), F.lit(1).alias("side"), "key", F.col("key").alias("class"))
    leaders = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return members.unionByName(leaders.select(spot(F.col("part")), F.lit(0).alias("side"), F.col("leader").alias("key"), F.col("leader").alias("class")))


def _blocks(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(spot, side, key, class): the texts of each two blocks of a bucket that have to meet, one spot for each two blocks.

    Buckets of two texts are left out: one of them led the other. A class of a block's size or more in a bucket has blocks of its own, which
    do not meet each other; other classes share blocks. A block of side 0 meets that of side 1; where there is no side 1, itself.
    """
    spark = met.sparkSession
    rows = met.join(classes.select(F.col("node").alias("key"), F.col("label").alias("class")), "key", "left")
    rows = rows.select("band", "key", _units(F.col("size")).alias("units"), F.coalesce("class", "key").alias("class"))
    rows = written(spark, rows, "classed-buckets")
    mixed = rows.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2")
    rows = written(spark, rows.join(written(spark, mixed.select("band"), "mixed"), "band"), "open-buckets")
    sizes = rows.groupBy("band", "class").agg(F.sum("units").alias("n"))
    large = F.when(F.col("n") >= BLOCK, F.struct("class", _parts(F.col("n")).alias("parts")))
    plan = sizes.groupBy("band").agg(F.collect_list(large).alias("large"), _parts(F.coalesce(F.sum(F.when(F.col("n") < BLOCK, F.col("n"))), F.lit(0))).alias("rest"))
    rows = rows.join(written(spark, plan, "block-plan"), "band")
    block = lambda of, salt: F.struct(of.cast("binary").alias("of"), salt.cast("int").alias("salt"))
    each = lambda n, of: F.transform(F.sequence(F.lit(1), n), lambda i: block(of, i - 1))
    shared = F.when(F.col("rest") > 0, each(F.col("rest"), F.lit(None))).otherwise(F.array().cast("array<struct<of:binary,salt:int>>"))
    rows = rows.withColumn("blocks", F.concat(shared, F.flatten(F.transform("large", lambda c: each(c["parts"], c["class"])))))
    rows = rows.withColumn("mine", F.get(F.filter("large", lambda c: c["class"] == F.col("class")), F.lit(0)))
    rows = rows.withColumn("own", block(F.col("mine")["class"], F.pmod(F.xxhash64("key"), F.coalesce(F.col("mine")["parts"], F.col("rest")))))
    meets = lambda b: F.col("own.of").isNull() | b["of"].isNull() | (F.col("own.of") != b["of"])
    rows = rows.withColumn("other", F.explode(F.filter("blocks", meets)))
    rows = rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    spot = F.concat_ws(":", "band", F.hex("x.of"), "x.salt", F.hex("y.of"), "y.salt")
    return rows.select(spot.alias("spot"), F.when(F.col("own").eqNullSafe(F.col("x")), 0).otherwise(1).alias("side"), "key", "class")


def _alike(one: list[tuple], two: list[tuple], weights: Weights, least: float) -> np.ndarray:
    """(i, j) rows of the texts of ``one`` and ``two`` whose similarity may be ``least`` or more, all at once: shared weight by matrix products.

    A shingle that occurs t times is t elements, so that the weight of shared elements is that of the least times.
    """
    both = [*one, *two]
    sizes = [int(tf.sum()) for _, tf in both]
    who = np.repeat(np.arange(len(both)), sizes)
    times = np.concatenate([tf for _, tf in both])
    level = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
    h = np.repeat(np.concatenate([h for h, _ in both]), times)
    weight = weights.of(h, np.ones(len(h)))
    total = np.bincount(who, weight, len(both))
    element = h ^ _mixed(level.astype(U64) * U64(0x9E3779B97F4A7C15))
    shared = np.zeros((2, len(one), len(two)))
    part = element % U64(len(h) // BLOCK_SHINGLES + 1)
    for p in range(len(h) // BLOCK_SHINGLES + 1):
        at = np.flatnonzero(part == p)
        _, place, n = np.unique(element[at], return_inverse=True, return_counts=True)
        at, place = at[n[place] > 1], place[n[place] > 1]  # others are in one text only
        order = np.argsort(place, kind="stable")
        at, place = at[order], place[order]
        place = np.cumsum(np.concatenate([[0], place[1:] != place[:-1]])) if len(place) else place
        for lo in range(0, int(place[-1]) + 1 if len(place) else 0, STRIP // 2):
            i, j = np.searchsorted(place, [lo, lo + STRIP // 2])
            table = np.zeros((len(both), int(place[j - 1]) - lo + 1), dtype=np.float32)
            table[who[at[i:j]], place[i:j] - lo] = 1
            factor = np.zeros(table.shape[1], dtype=np.float32)
            factor[place[i:j] - lo] = weight[at[i:j]]
            shared[0] += table[: len(one)] @ table[len(one) :].T
            shared[1] += (table[: len(one)] * factor) @ table[len(one) :].T
    best = np.zeros(shared.shape[1:])
    for s, t in zip(shared, (np.array(sizes, dtype=float), total), strict=True):
        best = np.maximum(best, s / np.maximum(1e-9, t[: len(one), None] + t[None, len(one) :] - s))
    return np.argwhere(best >= least)


def _linked(spots: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """From the rows of _stars or _blocks: (a, b, x, y), keys of similar texts and their different classes, as many as join all classes that they join."""

    def meet(rows: list[tuple]) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
        sides = [[r for r in rows if r[1] == s] for s in (0, 1)]
        one, two = sides[0], sides[1] or sides[0]
        if not one or len({r[3] for r in rows}) < 2:
            return
        texts = {r[2]: r[4] for r in rows}
        keys, sets = list(texts), {}
        for lo, hi in strips(list(texts.values())):
            sets |= _sets(keys[lo:hi], [texts[k] for k in keys[lo:hi]])
        one, two = ([r for r in side if r[2] in sets] for side in (one, two))
        top: dict[bytes, bytes] = {}

        def find(c: bytes) -> bytes:
            while top.get(c, c) != c:
                top[c] = c = top.get(top[c], top[c])
            return c

        if not one or not two:
            return
        for i, j in _alike([sets[r[2]] for r in one], [sets[r[2]] for r in two], weights, threshold - 1e-3).tolist():
            a, b = one[i], two[j]
            if (x := find(a[3])) != (y := find(b[3])) and similarity(sets[a[2]], sets[b[2]], weights) >= threshold:
                top[x] = y
                a, b = (a, b) if a[2] > b[2] else (b, a)
                yield a[2], b[2], a[3], b[3]

    names = ["a", "b", "x", "y"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found, rows = [], list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for r in rows:
                if held and held[0][0] != r[0]:
                    found += meet(held)
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in range(4)], names)
        found = list(meet(held))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in range(4)], names)

    rows = spots.join(texts, "key").select("spot", "side", "key", "class", "text").repartition("spot").sortWithinPartitions("spot")
    return rows.mapInArrow(verify, "a binary, b binary, x binary, y binary").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Tables in shared storage: of rows, id, key, h1, h2; of keys, key, label (the class), least (id and hashes of the class's first row), n_joins."""
    spark = docs.sparkSession
    bounded_batches(spark)
    weights = Weights(weights_of(*sketch(docs, text_col)))
    signed = written(spark, signatures(docs, weights, id_col, text_col), "signatures")
    nodes = signed.where("key is not null").groupBy("key").agg(F.min(F.struct("id", "h1", "h2")).alias("least"), F.max("size").alias("size"), F.first("bands").alias("bands"))
    nodes = written(spark, nodes, "nodes")
    buckets = nodes.select("key", "size", F.explode("bands").alias("band"))
    shared = written(spark, buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-buckets")
    met = buckets.join(shared, "band")
    popular = written(spark, met.groupBy("key").agg(F.sum("n").alias("popular")), "popular")
    met = written(spark, met.select("band", "key", "size").join(popular, "key"), "met")
    # one text for each key; equal texts are combined before they are shuffled
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), *_text_hash(text_col)).groupBy("h1", "h2").agg(F.first("text").alias("text"))
    mine = nodes.join(popular, "key").select("key", "least.h1", "least.h2").hint("merge")  # grows with the corpus: never broadcast
    texts = written(spark, texts.join(mine, ["h1", "h2"]).select("key", "text"), "candidate-texts")

    stars = written(spark, _linked(_stars(met), texts, weights, threshold), "links")
    classes = written(spark, components(spark, stars), "classes")
    rest = written(spark, _linked(_blocks(met, classes), texts, weights, threshold), "links")
    joined = components(spark, rest.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("joined"))

    ends = stars.unionByName(rest).select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_joins"))
    table = nodes.select("key", "least").join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    table = table.join(written(spark, joined, "joined-classes"), "label", "left").withColumn("label", F.coalesce("joined", "label"))
    table = written(spark, table.join(ends, "key", "left").select("key", "label", "least", F.coalesce("n_joins", F.lit(0)).cast("long").alias("n_joins")), "classes")
    first = written(spark, table.groupBy("label").agg(F.min("least").alias("first")), "firsts")
    return signed.select("id", "key", "h1", "h2"), written(spark, table.join(first, "label").select("key", "label", F.col("first").alias("least"), "n_joins"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, key, class_id (the least id of the class) and n_joins (links of its text that were needed to join its class)."""
    rows, table = _classes(docs, id_col, text_col, threshold)
    out = rows.join(table.select("key", F.col("least.id").alias("first"), "n_joins"), "key", "left")
    alone = F.col("key").isNull()
    return out.select(F.col("id").alias(id_col), "key", F.when(alone, F.col("id")).otherwise(F.col("first")).alias("class_id"), F.coalesce("n_joins", F.lit(0)).cast("long").alias("n_joins"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: one with the class's least id and, of these, the least text by hash. Null texts all stay.

    Rows are told apart by id and text; of rows that agree in both, one stays.
    """
    _, table = _classes(docs, id_col, text_col, threshold)
    place = ["h1", "h2", "h3"]
    kept = table.select("least.h1", "least.h2", F.xxhash64("least.id").alias("h3")).distinct()
    df = docs.where(F.col(text_col).isNotNull()).select(nested(docs).alias("row"), *_text_hash(text_col), F.xxhash64(F.col(id_col)).alias("h3"))
    df = df.join(kept, place, "left_semi").dropDuplicates(place)
    return restore(df, docs, "row", {}).unionByName(docs.where(F.col(text_col).isNull()))
