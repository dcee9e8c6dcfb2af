"""Texts as chunks from blank to blank, each distinct chunk of a batch once.

The byte-level pre-tokenizer never joins what stands before a blank to what follows it, unless other white space is next to
the blank. So most texts' tokens are those of their chunks, one after another, and a batch has far fewer distinct chunks
than chunks. Texts with white space beside a blank, a blank at their end or a special string are left whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: All characters that Unicode or the library may count as white space.
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
LOOSE = f"{SPACES} | {SPACES}| $"


@dataclass
class Chunks:
    """``chunks`` are distinct; row i of ``rows`` (places in the batch) is codes[bounds[i]:bounds[i + 1]]. ``whole``: other places.

    The first ``n_led`` chunks begin with a blank.
    """

    rows: np.ndarray
    bounds: np.ndarray
    codes: np.ndarray
    chunks: list[str]
    n_led: int
    whole: np.ndarray


def chunked(texts: pa.Array, special: list[str]) -> Chunks:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    loose = pc.match_substring_regex(texts, LOOSE)
    for s in special:
        loose = pc.or_(loose, pc.match_substring(texts, s))
    loose = loose.to_numpy(zero_copy_only=False).astype(bool)
    rows, whole = np.flatnonzero(~loose), np.flatnonzero(loose)
    lists = pc.split_pattern(texts.take(pa.array(rows)), " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    bounds = bounds - bounds[0] if len(bounds) else np.zeros(1, dtype=np.int64)
    first = np.zeros(len(flat), dtype=bool)
    first[bounds[:-1]] = True
    led = pc.dictionary_encode(flat.filter(pa.array(~first)))
    own = pc.dictionary_encode(flat.filter(pa.array(first)))
    codes = np.empty(len(flat), dtype=np.int64)
    codes[~first] = led.indices.to_numpy()
    codes[first] = own.indices.to_numpy() + len(led.dictionary)
    chunks = [" " + w for w in led.dictionary.to_pylist()] + own.dictionary.to_pylist()
    return Chunks(rows, bounds, codes, chunks, len(led.dictionary), whole)

