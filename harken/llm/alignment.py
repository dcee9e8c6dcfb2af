"""Cross-tokenizer alignment (operator 12): which tokens of two vocabularies cover the same bytes, and which pairs do so across documents.

A byte-level vocabulary A and a piece vocabulary B both spell a blank and the text. The union of both arrays of token ends cuts the bytes into
elementary intervals; ``searchsorted`` gives each interval the token of A and of B that owns it, so each interval is one overlap and no pair of tokens
has two. An end that is in both arrays closes a group; all pairs of a group, its product, expand by repetition of offsets. No piece goes on past a blank in either vocabulary, so a text of
single blanks is aligned chunk by chunk and each distinct chunk of a batch once, all of them as one run of bytes. Other texts are aligned whole.

In Spark, a document keeps its distinct pairs and how often each occurs. How many documents hold a pair is a sum over exploded pairs, combined before the
shuffle. Pairs of frequent counts, a table of counted size, are broadcast back; only rows of the rest are shuffled by pair, none of which is in many documents.

Edge cases: null and empty texts, and texts that a vocabulary doesn't spell byte by byte (such as those with U+2581, the pieces' sign for a blank), have no tokens: counts 0 and an empty digest;
special strings are plain text; repeated rows are documents of their own; ids may be null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import chunked
from .common import bounded_batches, strips, written
from .tokenfile import Encoder

#: Pairs that are broadcast at most; characters that a worker aligns at once, which is what bounds its memory.
HEAD, CHARS = 1_000_000, 1 << 21
#: The pieces' sign for a blank.
BLANK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it is printable, else the next free character from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Spelling:
    """Bytes of every token of a vocabulary: token i is data[ptr[i]:ptr[i + 1]]."""

    data: np.ndarray
    ptr: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Spelling:
        return Spelling(np.frombuffer(b"".join(tokens), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens], dtype=np.int64)]))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.ptr[ids + 1] - self.ptr[ids]

    def spells(self, ids: np.ndarray, n: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each part's tokens, n of them, spell its bytes, sizes[i] of ``raw``."""
        own = self.sizes(ids)
        out = np.diff(np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(n)])]) == sizes
        tokens, bytes_ = np.repeat(out, n), np.repeat(out, sizes)
        unequal = np.flatnonzero(self.data[ranges(self.ptr[ids[tokens]], own[tokens])] != raw[bytes_])
        out[np.repeat(np.arange(len(sizes)), sizes)[bytes_][unequal]] = False
        return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for sizes[i] numbers, one i after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


@dataclass
class Overlaps:
    """Two runs of token ends over the same bytes. Interval k belongs to tokens a[k] and b[k]; group g ends with tokens last_a[g] and last_b[g]."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    @staticmethod
    def of(ends_a: np.ndarray, ends_b: np.ndarray) -> Overlaps:
        ends = np.union1d(ends_a, ends_b)
        a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared = (ends_a[a] == ends) & (ends_b[b] == ends)
        return Overlaps(a, b, a[shared], b[shared])

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens of A and B in each group, group after group."""
        n_a, n_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)
        a = np.repeat(np.arange(int(n_a.sum())), np.repeat(n_b, n_a))
        return a, ranges(np.repeat(self.last_b - n_b + 1, n_a), np.repeat(n_b, n_a))


class Aligner:
    def __init__(self, path_a: str | None, path_b: str | None):
        import sentencepiece

        if path_a is None or path_b is None:
            import public_tokenizers

            path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.first = Encoder(path_a)
        self.first.library.encode_special_tokens, self.first.special = True, []
        alphabet, names = byte_alphabet(), self.first.library.get_vocab()
        spelt = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in names.items()}
        self.spell_a = Spelling.of([spelt.get(i, b"") for i in range(max(spelt) + 1)])
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.spell_b = Spelling.of([bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])
        self.by_chunk = not any(BLANK in p.lstrip(BLANK) for p in pieces)

    def ids_a(self, led: list[str], whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one part after another, and how many each has."""
        runs = self.first.led(led)
        ids = np.concatenate(runs) if runs else np.zeros(0, dtype=self.first.dtype)
        starts = np.flatnonzero(self.first.leads[ids])
        if len(starts) != len(led):
            raise ValueError("the vocabulary joins chunks over blanks")
        own = self.first.raw(whole)
        return np.concatenate([ids, *own]).astype(np.int64), np.concatenate([np.diff(np.append(starts, len(ids))), np.array([len(x) for x in own], dtype=np.int64)])

    def ids_b(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = [np.zeros(0, dtype=np.int64)], []
        for lo, hi in strips(parts):
            got = self.second.encode([t[1:] for t in parts[lo:hi]], num_threads=1)
            ids.append(np.fromiter(chain.from_iterable(got), dtype=np.int64))
            n += map(len, got)
        return np.concatenate(ids), np.array(n, dtype=np.int64)

    def align(self, texts: pa.Array, products: bool = False) -> Aligned:
        texts, blank, none = pc.fill_null(texts.cast(pa.large_string()), ""), *(pa.scalar(x, pa.large_string()) for x in (" ", ""))
        texts = pc.binary_join_element_wise(blank, texts, none)
        if self.by_chunk:
            c = chunked(texts, [])
            rows, bounds, codes, led, at = c.rows, c.bounds, c.codes, c.chunks[: c.n_led], c.whole
        else:
            rows, bounds, codes, led, at = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64), [], np.arange(len(texts))
        whole = texts.take(pa.array(at)).to_pylist()
        spans: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
        for i, lo, hi in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            spans[i] = codes[lo + 1 : hi]  # before the first blank there is nothing
        for k, i in enumerate(at.tolist()):
            spans[i] = np.array([len(led) + k])
        parts = led + whole
        said = [p.encode() for p in parts]
        raw, sizes = np.frombuffer(b"".join(said), dtype=np.uint8), np.array([len(x) for x in said], dtype=np.int64)
        (a, n_a), (b, n_b) = self.ids_a(led, whole), self.ids_b(parts)
        good = self.spell_a.spells(a, n_a, raw, sizes) & self.spell_b.spells(b, n_b, raw, sizes)
        return Aligned.of(a[np.repeat(good, n_a)], n_a * good, b[np.repeat(good, n_b)], n_b * good, good, spans, self, products)


@dataclass
class Aligned:
    """Texts of a batch as runs of parts (spans); each part's tokens, links and groups. A text with a part that is not spelt has none."""

    spans: list[np.ndarray]
    n_a: np.ndarray
    n_b: np.ndarray
    groups: list[str]
    n_groups: np.ndarray
    pairs: np.ndarray  #: links, part after part
    ptr: np.ndarray

    @staticmethod
    def of(ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, good: np.ndarray, spans: list[np.ndarray], by: Aligner, products: bool) -> Aligned:
        found = Overlaps.of(np.cumsum(by.spell_a.sizes(ids_a)), np.cumsum(by.spell_b.sizes(ids_b))) if len(ids_a) else Overlaps(*[np.zeros(0, dtype=np.int64)] * 4)
        part, ends = np.repeat(np.arange(len(n_a)), n_a), np.arange(len(n_a) + 1)
        x, y = found.products() if products else (found.a, found.b)
        group_ptr = np.searchsorted(part[found.last_a], ends)
        say_a, say_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        to_a, to_b = (found.last_a + 1).tolist(), (found.last_b + 1).tolist()
        said = [",".join(say_a[a0:a1]) + "|" + ",".join(say_b[b0:b1]) for a0, a1, b0, b1 in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)]
        cuts = group_ptr.tolist()
        spans = [s if good[s].all() else s[:0] for s in spans]
        return Aligned(
            spans, n_a, n_b, [";".join(said[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)], np.diff(group_ptr),
            (ids_a[x] << 32) + ids_b[y], np.searchsorted(part[x], ends),
        )

    def sums(self, of: np.ndarray) -> np.ndarray:
        return np.array([int(of[s].sum()) for s in self.spans], dtype=np.int64)

    def texts(self) -> list[str]:
        return [";".join([self.groups[k] for k in s.tolist()]) for s in self.spans]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets by text, then each text's distinct pairs and how often each occurs."""
        m = max(1, len(self.n_a))
        text = np.repeat(np.arange(len(self.spans)), [len(s) for s in self.spans])
        used, times = np.unique(text * m + np.concatenate([np.zeros(0, dtype=np.int64), *self.spans]), return_counts=True)
        sizes = np.diff(self.ptr)[used % m]
        values, code = np.unique(self.pairs, return_inverse=True)
        v = max(1, len(values))
        keys, at = np.unique(np.repeat(used // m, sizes) * v + code[ranges(self.ptr[used % m], sizes)], return_inverse=True)
        return np.searchsorted(keys // v, np.arange(len(self.spans) + 1)), values[keys % v] if len(keys) else keys, np.bincount(at, np.repeat(times, sizes), len(keys)).astype(np.int64)


@lru_cache(maxsize=2)
def aligner(path_a: str | None, path_b: str | None) -> Aligner:
    """One per worker. Without paths, the public vocabularies of this machine."""
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", groups: bool = False, products: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct links of each row (pair, the id of A in the upper, that of B in the lower 32 bits) with how often each occurs.

    ``groups`` adds the groups themselves as text, ``a1,a2|b1;a3|b2``; ``products`` takes all pairs of each group in place of those that overlap.
    """
    docs = docs.select(id_col, text_col)
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + ["groups"] * groups

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(path_a, path_b)
        for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in strips(b.column(1).to_pylist(), CHARS)):
            got = by.align(batch.column(1), products)
            said = got.texts()
            offsets, pairs, times = got.distinct()
            offsets = pa.array(offsets, pa.int32())
            cols = [batch.column(0), *[pa.array(got.sums(x)) for x in (got.n_a, got.n_b, got.n_groups, np.diff(got.ptr))]]
            cols += [pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said])]
            cols += [pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(said)] * groups, names)

    return docs.mapInArrow(align, f"`{id_col}` {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>" + ", groups string" * groups)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n_docs, best: how many rows hold the pair, and whether no pair of the same id of A is in more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    most = F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "n_docs", (F.col("n_docs") == most).alias("best"))


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``aligned``, and how well its links agree with the corpus: n_best links are the most usual of their id of A, ties included; count_sum adds the documents of each link's pair."""
    spark = docs.sparkSession
    rows = aligned(docs, path_a, path_b, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    rows = written(spark, rows, "aligned")
    counts = written(spark, pair_counts(rows), "pairs")

    # the largest counts that fit are broadcast: those above a power of two
    power = F.floor(F.log2("n_docs"))
    sizes = {r["power"]: r["n"] for r in counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
    least, held = max(sizes, default=0) + 1, 0
    while sizes and least > min(sizes) and held + sizes.get(least - 1, 0) <= head:
        least -= 1
        held += sizes.get(least, 0)
    links = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("_row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    of_head = F.broadcast(counts.where(power >= least))
    found = links.join(of_head, "pair")
    if held < sum(sizes.values()):
        found = found.unionByName(links.join(of_head, "pair", "left_anti").join(counts.where(power < least).hint("merge"), "pair"))
    sums = found.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    out = rows.select(id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_row").join(sums, "_row", "left").drop("_row")
    return out.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n_best", "count_sum")})
