"""Plain versions of the operators' contracts, to test against."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import xxhash


def quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    inside = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "base_failed": len(words) < 10 or 100 * len(inside) > 20 * len(words),
    }


def kept_by_rules(text, stop_words):
    """The verdict of the quality rules: the base, then word length, symbols, repeated lines, stop words."""
    m, words = quality(text), re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = max(1, len(words))
    stop = sum(w.rstrip(".,;:!?").lower() in stop_words for w in words)
    return not m["base_failed"] and 1.5 <= m["word_chars"] / n <= 25 and m["n_symbols"] / n <= 0.3 and m["n_dup_lines"] <= 0.5 * max(1, len(lines)) and stop / n >= 0.005


def one_of_each_class(rows):
    """rows: (id, text). The ids of one row of each class of texts 0.8 alike or equal, over all pairs: that of the least id."""
    bags, parent = [shingle_counts(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or jaccard(bags[i], bags[j]) >= 0.8:
                parent[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), k), k)
    return set(least.values())


def secrets(text):
    t = text or ""
    found = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found += [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    kinds = ("assign", "access", "hex")
    said = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))
    return [sum(k == i for _, k, _ in found) for i in range(3)] + [hashlib.sha256(said.encode()).hexdigest()]


def folded(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination(text, items):
    """items: (id, text). Returns n_words, n_hit, n_items, sha, contaminated."""
    windows: dict[tuple, set] = {}
    for k, t in items:
        w = folded(t)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(k))
    w, hit, of = folded(text), set(), set()
    for m in {len(x) for x in windows}:
        for i in range(len(w) - m + 1):
            if (x := tuple(w[i : i + m])) in windows:
                hit |= set(range(i, i + m))
                of |= windows[x]
    return len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)


def size_and_crc(text):
    b = (text or "").encode()
    return len(b) + 1, zlib.crc32(b)


def permuted(number, n, seed, rounds=6):
    """The place of a row number: a Feistel cipher over [0, a) x [0, b), walked on until it is below n."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    while True:
        left, right = divmod(number, b)
        for i in range(rounds):
            if i % 2 == 0:
                left = (left + hashed((seed, 4), (i, 4), (right, 8)) % a) % a
            else:
                right = (right + hashed((seed, 4), (i, 4), (left, 8)) % b) % b
        number = left * b + right
        if number < n:
            return number


def hashed(*values, seed=42):
    """The engine's 64-bit hash of integers of four or eight bytes (as (value, bytes)) and strings, one after another, signed."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if v[1] == 4 else "<q", v[0]), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def targets(sizes, weights=(5, 2, 1), most=3):
    weights = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else left * weights[i] / total
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    return out


def mixed_copies(rows, seed, block_rows):
    """rows: (id, text, source). By id: size, source_size, copies, target."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = [sum(size[i] for i, _, s in rows if s == name) for name in sources]
    out = {}
    for k, (name, n, want) in enumerate(zip(sources, total, targets(total), strict=True)):
        own = [(i, hashed((seed, 4), (i, 8), t or "")) for i, t, s in rows if s == name]
        n_blocks = max(1, -(-len(own) // block_rows))
        blocks = {}
        for i, h in own:
            blocks.setdefault(h % n_blocks, []).append((hashed((seed, 4), (h, 8)), h, i))
        whole = math.floor(want / n) if n else 0
        rest, once, left = want - whole * n, set(), None
        for _, b in sorted((hashed((seed, 4), (k, 8), (b, 8)), b) for b in blocks):
            words = sum(size[i] for *_, i in blocks[b])
            if left is None and rest > 0 and words <= rest:
                once |= {i for *_, i in blocks[b]}
                rest -= words
            elif left is None and rest > 0:
                left = rest
                for _, _, i in sorted(blocks[b]):
                    if size[i] <= left:
                        once.add(i)
                        left -= size[i]
        out |= {i: (size[i], n, whole + (i in once), want) for i, _ in own}
    return out


def url_posteriors(rows, asked):
    """Alpha and beta of each host asked for, by the operator's definition, for names of known suffixes."""
    def parts(h):
        labels = h.split(".")
        n = 2 if labels[-2:] == ["co", "uk"] else 1
        return ".".join(labels[-n:]), ".".join(labels[-n - 1 :]), h

    total = (sum(b for _, b in rows) + 1) / (len(rows) + 2)
    post, strength = [], []
    for level in range(3):
        counts = {}
        for h, b in rows:
            c = counts.setdefault(parts(h)[level], [0, 0, parts(h)])
            c[0], c[1] = c[0] + 1, c[1] + b
        mean = lambda p: total if level == 0 else post[level - 1][p[level - 1]][0] / sum(post[level - 1][p[level - 1]])  # noqa: B023, E731
        seen = sum(n * (b / n - mean(p)) ** 2 for n, b, p in counts.values())
        var = sum(mean(p) * (1 - mean(p)) for _, _, p in counts.values())
        slope = sum(mean(p) * (1 - mean(p)) * (n - 1) for n, _, p in counts.values())
        s = 1 / max(1 / 1001, min(0.5, (seen - var) / slope if slope else 0.5)) - 1
        strength.append(s)
        post.append({k: (b + s * mean(p), n - b + s * (1 - mean(p))) for k, (n, b, p) in counts.items()})
    out = {}
    for h in asked:
        m, spread = total, 0.0
        for level, name in enumerate(parts(h)):
            rho = spread + (1 - spread) / (strength[level] + 1)
            a, b = post[level].get(name, (m * (1 / rho - 1), (1 - m) * (1 / rho - 1)))
            m, spread = a / (a + b), 1 / (a + b + 1)
        out[h] = (a, b)
    return out


def beta_quantile(a, b, q, steps=200_000):
    """By summing the density over the unit interval's middles, for a, b above one or near it."""
    top = [(a - 1) * math.log((i + 0.5) / steps) + (b - 1) * math.log(1 - (i + 0.5) / steps) for i in range(steps)]
    peak = max(top)
    weight = [math.exp(x - peak) for x in top]
    want, held = q * sum(weight), 0.0
    for i, w in enumerate(weight):
        held += w
        if held >= want:
            return (i + 0.5) / steps


def shingle_counts(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def terms(texts):
    """Occurrences of each term, and texts with it."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    found = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)) for t in texts]
    n, d = Counter(w for f in found for w in f), Counter(w for f in found for w in set(f))
    return {w: (n[w], d[w]) for w in n}


def divergence(rows, min_docs, top):
    rows = [(t or "", k or "", s or "") for t, k, s in rows]
    out = []
    for lang in {k for _, k, _ in rows}:
        texts = [t for t, k, _ in rows if k == lang]
        kept = {w: n for w, (n, d) in terms(texts).items() if d >= min_docs}
        sources = {s for _, k, s in rows if k == lang}
        counts = {s: {w: n for w, (n, _) in terms([t for t, k, z in rows if (k, z) == (lang, s)]).items() if w in kept} for s in sources}

        def share(n, total, v=len(kept)):
            return 1 + 10**9 * (n + 5) // (total + 5 * v)

        p = {s: {w: share(c.get(w, 0), sum(c.values())) for w in kept} for s, c in counts.items()}
        q = {w: share(n, sum(kept.values())) for w, n in kept.items()}
        for s in sources:
            pairs = [(z, sum(abs(p[s][w] - p[z][w]) for w in kept)) for z in sources if z != s]
            more = [(w, p[s][w] - q[w]) for w in kept if counts[s].get(w) and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", more, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def _bytes_of_byte_level():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 1024))
    return {chr(b) if b in plain else chr(next(free)): b for b in range(256)}


def alignment(docs):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, by walking along both token lists."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, rows, held = _bytes_of_byte_level(), [], Counter()

    def spans(ids, spell):
        out, at = [], 0
        for k in ids:
            out.append((at, at + len(spell(k)), k))
            at = out[-1][1]
        return out

    def spell_a(k):
        return bytes(letters[c] for c in first.id_to_token(k))

    def spell_b(k):
        piece = second.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(k) else piece.replace("▁", " ").encode()

    for i, text in docs:
        text = text or ""
        raw = (" " + text).encode()
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        if not text or any(b"".join(map(f, ids)) != raw for f, ids in ((spell_a, a), (spell_b, b))):
            rows.append((i, 0, 0, [], []))
            continue
        sa, sb = spans(a, spell_a), spans(b, spell_b)
        links, at = [], 0
        for lo, hi, k in sa:
            while sb[at][1] <= lo:
                at += 1
            links += [(k, sb[j][2]) for j in range(at, next((j for j in range(at, len(sb)) if sb[j][0] >= hi), len(sb)))]
        groups, shared, sides = [], {x[1] for x in sa} & {x[1] for x in sb}, [[[]], [[]]]
        for side, parts in zip((sa, sb), sides, strict=True):
            for _, end, k in side:
                parts[-1].append(str(k))
                parts += [[]] if end in shared else []
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides, strict=True)][:-1]
        rows.append((i, len(a), len(b), groups, links))
        held.update(set(links))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(i, na, nb, len(g), len(x), sum(held[k] == most[k[0]] for k in x), sum(held[k] for k in x), digest(";".join(g))) for i, na, nb, g, x in rows]
