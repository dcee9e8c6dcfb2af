"""Quality classifier (operator 13): Bradley-Terry scores learned from preferences between labelled documents, cut at a quantile of the scores.

A text's strength is a linear function of measures of the text alone: lengths, classes of bytes, repeated words, word triples and lines, each standardised, and its
square. Of a document labelled good and one labelled bad the first is preferred; the probability of that is the logistic function of the difference of
their strengths, so the weights are a logistic regression on differences of features without intercept. The strength at the quantile that
corresponds to the share of bad labels becomes the threshold: scores are logistic in the strength, shifted so that the threshold has the score
``CUT``. Every labelled row that is not held out takes part in means, spreads, preferences and quantile; every text is measured whole, once, and scored by tasks that hold one small batch each.

Rows of each label are numbered in the order of their ids' hashes. The k-th preference of a round is that of good row k over bad row k + round, numbers beyond a label's rows beginning again, so
each round uses every row of both labels. Newton's steps are sums over all preferences, formed by tasks; a task sends one gradient and one matrix to the driver. The quantile is
found by counts within ever narrower bounds and is exact. Means, spreads and weights are rounded, so that the order of sums does not show.

Edge cases: a null text is an empty one, and an empty one has all measures 0 and is scored like any other; without both labels there is no preference, and all scores are the share
of good labels (one half if there are none); null labels and labels of absent documents teach nothing; a document labelled twice teaches twice; repeated rows are scored alike;
an empty table gives no rows; ids may be null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harken.functions.numbering import placed

from .common import bounded_batches, text_of, written

#: Preferences, at least, in as many rounds as that takes; the penalty of a weight's square; the seed of draws from rows in memory.
PAIRS, RIDGE, SEED = 100_000, 1e-3, 13
#: Bounds that strengths are counted between at once; labelled rows that are numbered together, about.
BINS, RUN = 1024, 100_000
#: The score from which a text counts as good.
CUT = 0.3
#: Labels of these ids are held out: crc32 of the id as text, by remainder.
FOLDS = 5
#: Standard deviations beyond which a measure counts no further.
BOUND = 5.0

MEASURES = (
    "log_words", "word_bytes", "upper", "digits", "beyond_ascii", "symbols", "marks", "stops", "distinct_words", "top_word", "repeated_words",
    "repeated_pairs", "distinct_triples", "repeated_lines", "breaks", "symbol_words", "short",
)
_SYMBOLS, _STOPS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8), np.frombuffer(b".,;:", dtype=np.uint8)


def measures(text: str) -> list[float]:
    """Of a whole text, in the order of MEASURES."""
    words = text.split()
    if not words:
        return [0.0] * len(MEASURES)
    n = len(words)
    h = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    size, upper, lower = int(h.sum()), int(h[65:91].sum()), int(h[97:123].sum())
    numbers: dict[str, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=n)
    marked = np.fromiter((not w[-1].isalnum() and w[-1] not in ".,;:" for w in numbers), dtype=bool, count=len(numbers))
    triples = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:]
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)), size / n / 10, upper / max(1, upper + lower), 10 * int(h[48:58].sum()) / size, int(h[128:].sum()) / size,
        int(h[_SYMBOLS].sum()) / n, int(h[33] + h[63]) / n, int(h[_STOPS].sum()) / n, len(numbers) / n, int(np.bincount(codes.astype(np.int64)).max()) / n, float(np.mean(codes[1:] == codes[:-1])) if n > 1 else 0.0,
        float(np.mean(codes[2:] == codes[:-2])) if n > 2 else 0.0, len(np.unique(triples)) / max(1, n - 2), 1 - len(set(lines)) / len(lines), 10 * int(h[10]) / n, float(marked[codes.astype(np.int64)].mean()), float(n < 10),
    ]


@dataclass
class Ranking:
    """Weights of standardised measures and of their squares; ``cut`` is the strength of the threshold."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def features(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.spread, -BOUND, BOUND)
        return np.hstack([z, z * z])

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        """A row's does not depend on the rows beside it."""
        return (self.features(rows) * self.weights).sum(axis=1)

    def scores(self, rows: np.ndarray, threshold: float) -> np.ndarray:
        strength = self.strengths(rows) - self.cut + np.log(threshold / (1 - threshold))
        return 1 / (1 + np.exp(-np.clip(strength, -30, 30)))


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, ridge: float) -> np.ndarray:
    """The weights; ``sums`` gives the mean gradient and the mean matrix of all preferences at given weights."""
    w = np.zeros(size)
    for _ in range(50):
        gradient, curve = sums(w)
        step = np.linalg.solve(curve + ridge * np.eye(size), gradient - ridge * w)
        w = w + step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def slopes(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and matrix of preferences by the differences of their features, summed."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of the preference that was not stated
    return d.T @ p, (d * (p * (1 - p))[:, None]).T @ d


def fitted(rows: np.ndarray, good: np.ndarray, bad_share: float, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = SEED) -> Ranking:
    """learned() in memory, on drawn preferences. The cut is the ``bad_share`` quantile of all rows' strengths, each label weighted by its share."""
    model = Ranking(rows.mean(axis=0), rows.std(axis=0) + 1e-6, np.zeros(0), 0.0)
    x, draw = model.features(rows), np.random.default_rng(seed)
    d = x[draw.choice(np.flatnonzero(good), pairs)] - x[draw.choice(np.flatnonzero(~good), pairs)]
    w = newton(lambda w: tuple(s / pairs for s in slopes(d, w)), d.shape[1], ridge)
    strength = x @ w
    order = np.argsort(strength, kind="stable")
    mass = np.cumsum(np.where(good, (1 - bad_share) / good.sum(), bad_share / (~good).sum())[order])
    k = min(int(np.searchsorted(mass, bad_share)), len(order) - 2)
    return Ranking(model.mean, model.spread, w, float(strength[order[k]] + strength[order[k + 1]]) / 2)


def measured(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """``keep`` and the measures of each text as an array."""
    bounded_batches(docs.sparkSession)
    read = docs.select(*keep, text.alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != "_text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, pa.list_(pa.float64()))], [*keep, "measures"])

    return read.mapInArrow(measure, f"{schema}, measures array<double>")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def totals(df: DataFrame, part: Callable[..., np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part``, an array of ``size`` numbers, over batches of the columns of ``df``, arrays of measures; a row a task comes to the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += part(*map(matrix, batch.columns))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["x"])

    return np.sum([r["x"] for r in df.mapInArrow(summed, "x array<double>").collect()] or [np.zeros(size)], axis=0)


def preferences(known: DataFrame, n_good: int, n_bad: int, pairs: int = PAIRS) -> DataFrame:
    """(good, bad): the measures of both rows of each preference. Every round uses every row of both labels; where rows are few, rounds end when all pairs are formed."""
    long = lambda n: F.lit(n).cast("bigint")
    longest = max(n_good, n_bad)
    rounds = min(n_bad, -(-pairs // longest))
    rows = known.withColumn("_h", F.xxhash64("_id"))
    run = F.floor((F.col("_h") / 2.0**64 + 0.5) * (1 + (n_good + n_bad) // RUN))
    rows = placed(rows, ["_good"], run, ["_h", "_id", "measures"], "_k")
    rows = rows.select("_good", "measures", F.col("_k").cast("bigint").alias("_k"), F.explode(F.sequence(long(0), long(rounds - 1))).alias("_round"))
    # the shorter label begins again until the longer one ends
    again = lambda at, n: F.explode(F.when(at < longest, F.sequence(at, long(longest - 1), long(n)))).alias("_p")
    good = rows.where("_good").select(F.col("measures").alias("good"), "_round", again(F.col("_k"), n_good))
    bad = rows.where("not _good").select(F.col("measures").alias("bad"), "_round", again(F.pmod(F.col("_k") - F.col("_round"), long(n_bad)), n_bad))
    return good.join(bad, ["_round", "_p"]).select("good", "bad")


def strength_at(rows: DataFrame, model: Ranking, rank: int) -> float:
    """Midway between the strengths of ``rank``, from 1, and of the next one, over all rows. Bounds close in on both until no number lies between them."""
    top = float(np.abs(model.weights).sum()) * BOUND * BOUND + 1.0  # no strength lies beyond
    bounds = [(-top, top), (-top, top)]
    while any(np.nextafter(low, high) < high for low, high in bounds):
        edges = np.unique(np.concatenate([np.linspace(low, high, BINS + 1) for low, high in bounds]))
        upto = np.cumsum(totals(rows, lambda x: np.bincount(np.searchsorted(edges, model.strengths(x)), minlength=len(edges) + 1), len(edges) + 1))  # noqa: B023
        at = [int(np.searchsorted(upto, r)) for r in (rank, rank + 1)]
        bounds = [(float(edges[i - 1]), float(edges[i])) for i in at]
    return (bounds[0][1] + bounds[1][1]) / 2


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", pairs: int = PAIRS, ridge: float = RIDGE) -> Ranking | float:
    """The ranking learned from all rows of ``docs``, measured (_id, measures), whose labels are not held out, or the share of good labels if there is no preference."""
    told = labels.select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).alias("_good")).where("_id is not null and _good is not null").where(~held_out("_id"))
    known = written(docs.sparkSession, docs.join(told, "_id").select("_id", "_good", "measures"), "labelled")
    n = {r["_good"]: r["n"] for r in known.groupBy("_good").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    if len(n) < 2:
        return float(n.get(True, 0)) / sum(n.values()) if n else 0.5
    k, rows, size = len(MEASURES), known.select("measures"), n[True] + n[False]
    mean = np.round(totals(rows, lambda x: x.sum(axis=0), k) / size, 12)
    spread = np.round(np.sqrt(totals(rows, lambda x: ((x - mean) ** 2).sum(axis=0), k) / size), 12) + 1e-6
    model = Ranking(mean, spread, np.zeros(0), 0.0)
    preferred = written(docs.sparkSession, preferences(known, n[True], n[False], pairs), "preferences")
    n_pairs = preferred.count()

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = totals(preferred, lambda good, bad: np.concatenate([x.ravel() for x in slopes(model.features(good) - model.features(bad), w)]), 2 * k * (2 * k + 1)) / n_pairs
        return s[: 2 * k], s[2 * k :].reshape(2 * k, 2 * k)

    model = Ranking(mean, spread, np.round(newton(sums, 2 * k, ridge), 9), 0.0)
    return Ranking(mean, spread, model.weights, strength_at(rows, model, n[False]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = CUT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score from 0 to 1, predicted (1 from ``threshold`` on)."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    rows = written(docs.sparkSession, measured(rows, F.col("_t"), "_id"), "measured")
    model = learned(rows, labels, id_col, label_col)
    id_type = rows.schema["_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.full(len(batch), model) if isinstance(model, float) else model.scores(matrix(batch.column(1)), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["_id", "score"])

    out = rows.select("_id", "measures").mapInArrow(score, f"_id {id_type}, score double")
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
