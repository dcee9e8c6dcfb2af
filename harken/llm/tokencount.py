"""Token counts (operator 2): prefix dynamic programming over byte-level BPE.

For a piece of text that the pre-tokenizer keeps together, the BPE encoding of every prefix ends in exactly one token t
such that the encoding of the rest ends in a token u with BPE(u + t) = [u, t]. So ``count[p] = count[p - len(t)] + 1``
gives the exact count at every prefix in one pass, and what a cut at p would cost, or how much text fits a budget, is
read off the table without encoding anything again. Pieces repeat, so each worker keeps their tables in bounded memory.

The table of a text is int32 per code point: entry p is the count of the text's first p code points, exactly as
encoding that prefix alone would give it (cuts inside white space runs, contractions and special strings included).

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows get a row each; an empty table gives an empty
table; special strings inside texts are one token each, the library's default; input columns other than id and text are not
read, so none can clash.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .chunks import chunked
from .common import bounded_batches

#: Fixed value: how the byte-level pre-tokenizer splits a text.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Contractions of three characters; their two-character prefixes split before the letter.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
#: Entries that each worker's caches hold at most before they start anew, and the longest chunk they keep.
CACHE, CACHE_CHARS = 500_000, 64


def byte_alphabet() -> dict[str, int]:
    """The vocabulary file's character for each byte: printable ones stand for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(counts: list[int] | bytes | np.ndarray) -> bytes | np.ndarray:
    """Counts in one byte each where they all fit, else in four: 64 code points can take 256 bytes, and as many tokens."""
    return bytes(counts) if max(counts, default=0) < 256 else np.array(counts, dtype=np.int32)


class PrefixCounter:
    """Exact token counts of all prefixes, for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        of = byte_alphabet()
        raw = lambda s: bytes(of[c] for c in s)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        marks = set(self.special)
        self.vocab = {raw(s) for s in spec["model"]["vocab"] if s not in marks}
        self.ranks = {tuple(map(raw, m if isinstance(m, list) else m.split(" "))): i for i, m in enumerate(spec["model"]["merges"])}
        self.tails = {t[i:] for t in self.vocab for i in range(len(t))}
        self.pieces = regex.compile(PIECES)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.good: dict[tuple[bytes, bytes], bool] = {}
        self.tables: dict[str, bytes | np.ndarray] = {}
        self.states: dict[bytes, tuple[list[bytes], list[int]]] = {}
        self.chunks: dict[str, bytes | np.ndarray] = {}

    def merge(self, text: bytes) -> list[bytes]:
        """Plain BPE of a short byte string."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, u: bytes, t: bytes) -> bool:
        """Whether t can stand after u (or first, where u is empty) in an encoding."""
        if (ok := self.good.get((u, t))) is None:
            if len(self.good) > CACHE:
                self.good.clear()
            ok = self.good[u, t] = self.merge(u + t) == ([u, t] if u else [t])
        return ok

    def piece(self, text: str) -> list[int]:
        """Counts at each code point of one piece: entry i is the count of its first i + 1 code points."""
        b = text.encode("utf-8", "surrogatepass")
        n, tails, vocab, good, states = len(b), self.tails, self.vocab, self.good, self.states
        last, count, known = [b""], [0], n - 1 if n <= CACHE_CHARS else 0
        while known > 0:  # the longest prefix that another piece began with
            if (state := states.get(b[:known])) is not None:
                last, count = state[0][: known + 1], state[1][: known + 1]
                break
            known -= 1
        for p in range(known + 1, n + 1):
            k = p - 1
            while k >= 0 and b[k:p] in tails:
                k -= 1
            for k in range(k + 1, p):  # the longest token first
                if (t := b[k:p]) in vocab and (ok if (ok := good.get((last[k], t))) is not None else self.follows(last[k], t)):
                    last.append(t)
                    count.append(count[k] + 1)
                    break
        if n <= CACHE_CHARS:
            if len(states) > CACHE:
                states.clear()
            state = (last, count)
            for p in range(known + 1, n + 1):
                states[b[:p]] = state
        if n == len(text):
            out = count[1:]
        else:
            out = [c for c, x in zip(count[1:], b[1:] + b"a", strict=True) if x & 0xC0 != 0x80]
        if text in LONG_CONTRACTIONS:
            out[1] = 2
        return out

    def counts(self, piece: str) -> list[int] | bytes | np.ndarray:
        """As piece(), remembered for short pieces."""
        c = self.tables.get(piece)
        if c is None:
            c = self.piece(piece)
            if len(piece) <= CACHE_CHARS:
                if len(self.tables) > CACHE:
                    self.tables.clear()
                c = self.tables[piece] = packed(c)
        return c

    def plain(self, text: str) -> np.ndarray:
        """Counts at each code point of a text without special strings."""
        parts, base, run = [], 0, None
        for piece in self.pieces.findall(text):
            c = self.counts(piece)
            part = np.frombuffer(c, dtype=np.uint8).astype(np.int32) if isinstance(c, bytes) else np.array(c, dtype=np.int32)
            part += int(base)
            if piece[0].isspace() and run is not None:  # the run of white space up to here, were it cut here
                part[0] = run[0] + self.counts(run[1] + piece[0])[-1]
            run = (base, piece) if piece.isspace() else None
            parts.append(part)
            base += c[-1]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def chunk(self, text: str) -> bytes | np.ndarray:
        """As plain(), of a short text, packed and remembered."""
        if (known := self.chunks.get(text)) is not None:
            return known
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        pieces = self.pieces.findall(text)
        if len(pieces) == 1:
            c = packed(self.counts(pieces[0]))
        elif not any(map(str.isspace, pieces)):
            out, base = [], 0
            for piece in pieces:
                own = self.counts(piece)
                out += [x + base for x in own] if base else own
                base = int(out[-1])
            c = packed(out)
        else:
            c = packed(self.plain(text).tolist())
        self.chunks[text] = c
        return c

    def table(self, text: str) -> np.ndarray:
        """Entry p is the exact token count of the first p code points, for p from 0 to the text's length."""
        base, parts, before = 0, [np.zeros(1, dtype=np.int32)], ""
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:  # as long as it is not whole, it is ordinary text after what stands before it
                open_ = self.plain(before + part[:-1])[len(before) :] + (base - (int(self.plain(before)[-1]) if before else 0))
                parts += [open_.astype(np.int32), np.array([base + 1], dtype=np.int32)]
                base, before = base + 1, ""
            elif part:
                c = self.plain(part)
                parts.append(c + base)
                base, before = base + int(c[-1]), part
        return np.concatenate(parts)

    def answers(self, texts: pa.Array, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text its count and the most code points whose prefix has at most ``budget`` tokens.

        Chunks' tables are made once per distinct chunk. A text's table is theirs, each raised by what stands before it; counts at the ends of
        chunks only grow, so the longest prefix within the budget ends in the first chunk that goes beyond it.
        """
        c = chunked(texts, self.special)
        tables = [self.chunk(x) if len(x) <= CACHE_CHARS else self.plain(x) for x in c.chunks]
        total = np.fromiter((int(t[-1]) if len(t) else 0 for t in tables), dtype=np.int64, count=len(tables))
        chars = np.fromiter(map(len, c.chunks), dtype=np.int64, count=len(tables))
        ends = np.concatenate([[0], np.cumsum(total[c.codes])])
        at = np.concatenate([[0], np.cumsum(chars[c.codes])])
        n_tokens, fits = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for i, lo, hi in zip(c.rows.tolist(), c.bounds[:-1].tolist(), c.bounds[1:].tolist(), strict=True):
            n_tokens[i] = ends[hi] - ends[lo]
            if n_tokens[i] <= budget:
                fits[i] = at[hi] - at[lo]
            else:
                k = int(np.searchsorted(ends[lo : hi + 1], ends[lo] + budget, side="right")) - 1 + lo  # chunk k goes beyond
                left = budget - int(ends[k] - ends[lo])
                inside = [p + 1 for p, x in enumerate(tables[c.codes[k]]) if x <= left]
                fits[i] = at[k] - at[lo] + (inside[-1] if inside else 0)
        for i, text in zip(c.whole.tolist(), texts.take(pa.array(c.whole)).to_pylist(), strict=True):
            table = self.table(text or "")
            n_tokens[i], fits[i] = table[-1], cut(table, budget)
        return n_tokens, fits


@lru_cache(maxsize=2)
def counter(path: str | None) -> PrefixCounter:
    """One per worker. Without a path, the public byte-level vocabulary of this machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return PrefixCounter(path)


def cut(table: np.ndarray, budget: int) -> int:
    """The most code points whose prefix has at most ``budget`` tokens."""
    return int(np.flatnonzero(table <= budget)[-1])


def token_counts(docs: DataFrame, limit: int = 512, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", tables: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit, fit_chars and, if asked for, the table itself.

    fit_chars is the longest prefix, in code points, of at most ``limit`` tokens. ``prefix_counts`` is the table, as
    little-endian int32 from prefix 0 on.
    """
    docs = docs.select(id_col, text_col)
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the caches are millions of small objects without cycles; walking them costs a third of the time
        dp = counter(tokenizer)
        for batch in batches:
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            blobs = [dp.table(x or "").astype("<i4").tobytes() for x in batch.column(1).to_pylist()] if tables else []
            n_tokens, fits = dp.answers(batch.column(1), limit)
            cols = [batch.column(0), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(fits)]
            names = [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if tables:
                cols, names = [*cols, pa.array(blobs, pa.binary())], [*names, "prefix_counts"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_counts binary" * tables
    return docs.mapInArrow(count, schema)
