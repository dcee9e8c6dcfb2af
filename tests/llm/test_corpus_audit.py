"""Source divergence, cross-tokenizer alignment and the quality classifier against plain versions."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harken.llm import alignment, divergence, qualityrank, queries

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, _row int"
#: Bytes that change what a byte-level tokenizer sees: cases, other scripts, controls, the pieces' blank, byte names, special strings.
PARTS = ["the", "The", "THE", "é", "É", "日本", "🙂", " ", "  ", "\n", "\t", "x1y", "a-b", "▁", "<0x41>", "<|endoftext|>", "<s>", "\x00", "ﬁ", "é", "don't", "2024", " ", " ", "ß", "."]


def hard_rows(n=160, seed=3):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice(PARTS) + r.choice(["", " ", " "]) for _ in range(r.randrange(30))), r.choice(["en", "en", "EN", "", None]), r.choice(["a", "a", "a", "b", None, "", "é"])) for i in range(n)]
    rows += [(n, None, "en", "a"), (None, "", "xx", "only"), (1, "same the row", "en", "b"), (1, "same the row", "en", "b"), (n + 1, "the " * 3000 + "x" * 4000, "en", "c"), (n + 2, "!!!", "yy", "p"), (n + 3, "", "yy", "q")]
    return [(i, t, k, s, 0, "clash", 1) for i, t, k, s in rows]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


def test_divergence_against_plain(hard):
    rows = [(t, k, s) for _, t, k, s, *_ in hard_rows()]
    for min_docs, top in ((3, 2), (30, 50), (10**6, 50)):
        got = divergence.audit(hard, min_docs=min_docs, top=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == brute.divergence(rows, min_docs, top)
    assert divergence.audit(hard.where("false")).count() == 0


def test_divergence_in_small_blocks(hard):
    """Few entries to a bucket and few sources to a task give the same sums."""
    rows = [(t, k, s) for _, t, k, s, *_ in hard_rows()]
    got = divergence.audit(hard, min_docs=3, top=2, entries_of=4, sources_of=2)
    assert sorted(map(tuple, got.collect())) == brute.divergence(rows, 3, 2)


def test_sums_of_a_sparse_matrix():
    rng = np.random.default_rng(1)
    n, k = 7, 40
    dense = rng.integers(5, 50, (n, k))
    base = rng.integers(5, 10, n)
    stored = rng.random((n, k)) < 0.3
    dense = np.where(stored, dense, base[:, None])
    row, term = np.nonzero(stored | (np.arange(n)[:, None] == 0))  # every column occurs
    want = {(i, j): int(np.abs(dense[i] - dense[j]).sum()) for i in range(n) for j in range(i + 1, n)}
    got = {}
    for lo in range(0, n, 3):
        got |= {(int(i), int(j)): int(v) for i, j, v in zip(*divergence.matrix_sums(term, row, dense[row, term], base, lo, lo + 3), strict=True)}
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), max_size=6))
def test_terms_of_a_batch(texts):
    got = divergence.batch_counts(["x"] * len(texts), ["y"] * len(texts), pa.array(texts, pa.string()))
    want = brute.terms(texts)
    assert {t: (int(n), int(d)) for t, n, d in zip(*got[2:], strict=True) if t is not None} == want


def test_terms_with_one_hash_stay_apart(monkeypatch):
    texts = ["aa ab aa B b abc é è", "AB é x"]
    monkeypatch.setattr(divergence, "digest", lambda raw: len(raw) % 2)
    monkeypatch.setattr(divergence, "SLICES", 3)
    got = divergence.batch_counts(["x"] * 2, ["y"] * 2, pa.array(texts))
    assert {t: (int(n), int(d)) for t, n, d in zip(*got[2:], strict=True) if t is not None} == brute.terms(texts)


def test_alignment_against_plain(spark, hard):
    rows = [(i, t) for i, t, *_ in hard_rows()]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = sorted(map(str, brute.alignment(rows)))
    for head in (10**6, 40, 0):  # all pairs broadcast, some, none
        got = alignment.alignment(hard, head=head)
        assert sorted(got.columns) == sorted(columns)
        assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want
    assert alignment.alignment(hard.where("false")).count() == 0
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = queries.QUERIES["op12_token_alignment"](spark, DIR).select(*columns)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, brute.alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])))


def test_alignment_products_and_groups(spark):
    """Products are all pairs of each group; groups are told in order."""
    docs = spark.createDataFrame([(1, "日本語 unbelievable ünïcode"), (2, "plain words")], "doc_id long, text string")
    for r in alignment.aligned(docs, groups=True, products=True).collect():
        groups = [[list(map(int, side.split(","))) for side in g.split("|")] for g in r.groups.split(";")]
        want = {}
        for a, b in groups:
            for x in a:
                for y in b:
                    want[(x << 32) + y] = want.get((x << 32) + y, 0) + 1
        assert dict(zip(r.pairs, r.times, strict=True)) == want and r.n_links == sum(want.values()) and r.n_groups == len(groups)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_alignment_of_any_text(text):
    (want,) = brute.alignment([(0, text)])
    by = alignment.aligner(None, None)
    got = by.align(pa.array([text, None]))
    assert (got.sums(got.n_a)[0], got.sums(got.n_b)[0], got.sums(got.n_groups)[0], got.sums(np.diff(got.ptr))[0]) == want[1:5]
    assert brute.digest(got.texts()[0]) == want[7] and got.texts()[1] == ""


def auc(score, good):
    rank = {s: 0.0 for s in score}
    for s in sorted(set(score)):
        rank[s] = sum(x < s for x in score) + (sum(x == s for x in score) + 1) / 2
    n = sum(good)
    return (sum(rank[s] for s, g in zip(score, good, strict=True) if g) - n * (n + 1) / 2) / (n * (len(good) - n))


def test_quality_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    out = queries.QUERIES["op13_quality_classifier"](spark, d)
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 500 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good = [r.quality == 1 for r in rows]
    assert auc([r.score for r in rows], good) > 0.99
    assert sum(r.predicted == 1 for r, g in zip(rows, good, strict=True) if g) >= 0.99 * sum(good)
    assert sum(r.predicted == 0 for r, g in zip(rows, good, strict=True) if not g) >= 0.95 * (len(good) - sum(good))


def test_quality_classifier_edges(spark, hard):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(None, 1, 0), (3, None, 0), (999, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = qualityrank.quality_scores(hard, labels)
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(hard_rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (None, 160)}) == 1  # empty and null texts are alike
    none, one = labels.where("false"), labels.where("quality = 1")
    assert {r.score for r in qualityrank.quality_scores(hard, none).collect()} == {0.5}
    assert {r.score for r in qualityrank.quality_scores(hard, one).collect()} == {1.0}
    assert qualityrank.quality_scores(hard.where("false"), labels).count() == 0


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    turned = labels.withColumn("quality", (1 - labels.quality))
    mixed = labels.where(~qualityrank.held_out("doc_id")).unionByName(turned.where(qualityrank.held_out("doc_id")))
    by = lambda rows: sorted((r.doc_id, r.score) for r in rows.collect())
    assert by(qualityrank.quality_scores(docs, labels)) == by(qualityrank.quality_scores(docs, mixed))


def test_preferences_are_learned():
    """Strengths drawn from known weights: the fit ranks unseen rows as they do."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, len(qualityrank.MEASURES)))
    strength = x[:, 0] - 2 * x[:, 3]
    good = rng.random(4000) < 1 / (1 + np.exp(-strength))
    model = qualityrank.fitted(x[:2000], good[:2000], float((~good[:2000]).mean()), pairs=20_000)
    s = model.scores(x[2000:], 0.3)
    assert np.corrcoef(np.argsort(np.argsort(s)), np.argsort(np.argsort(strength[2000:])))[0, 1] > 0.95
    assert abs((s < 0.3).mean() - (~good).mean()) < 0.05  # the threshold cuts as many as are bad


def test_every_labelled_row_teaches(spark):
    """Each row of both labels is in a preference, and the cut is the quantile of all rows, not of some."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(23_000, len(qualityrank.MEASURES)))
    good = rng.random(len(x)) < 0.9  # more than 20,000 good ones
    known = spark.createDataFrame([(i, bool(g), r) for i, (g, r) in enumerate(zip(good, x.tolist(), strict=True))], "_id long, _good boolean, measures array<double>")
    met = qualityrank.preferences(known, int(good.sum()), int((~good).sum()), 30_000)
    assert met.count() >= 30_000
    for label, want in (("good", good), ("bad", ~good)):
        assert {r[0] for r in met.select(f"{label}").distinct().selectExpr(f"{label}[0]").collect()} == set(x[want, 0].tolist())
    model = qualityrank.Ranking(x.mean(axis=0), x.std(axis=0), np.linspace(-1, 1, 2 * x.shape[1]), 0.0)
    s = np.sort(model.strengths(x))
    n = int((~good).sum())
    assert qualityrank.strength_at(known.select("measures"), model, n) == (s[n - 1] + s[n]) / 2
