"""Quality rules (operator 1): one table of thresholds, compiled into one projection.

Every measure is a built-in expression over the text of the row itself, so the operator needs no shuffle and no
user function; each row's cost is linear in its text but for one sort of its windows, which happens only in texts that
repeat a window at all.

Edge cases: a null text counts as empty, an empty or blank text has zero words and fails the base rule; repeated rows
are judged alike, one by one; an empty table gives an empty table; an input column named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SOLID, nested, restore, sealed, text_of, words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is it that for on with as was be by are at this from or an not but have "
    "le la les de des du et un une que qui en est dans pour pas par sur au ce il ne se plus avec "
    "der die das und von zu mit ist im den nicht ein eine sich auf dem des es für auch als an er "
    "el los las y que un una del se por con para no su al lo como es en"
).split()

#: Words of the window that the repetition rule looks at.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``low <= measure <= high``; a side that is None does not bind."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The base rules decide ``base_failed``; the rest are the method's own verdict.
BASE_RULES = (
    Rule("too_few_words", "n_words", low=10),
    Rule("repeated_windows", "repeat_percent", high=20),
)
METHOD_RULES = (
    Rule("word_length", "mean_word_chars", low=1.5, high=25.0),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("stop_words", "stop_word_ratio", low=0.005),
)


def _same(a: Column, b: Column) -> Column:
    """Whether two places of windows hold equal windows: by hash, then word by word."""
    equal = (a["h"] == b["h"]) & (F.slice(F.col("w"), a["i"] + 1, WINDOW) == F.slice(F.col("w"), b["i"] + 1, WINDOW))
    return F.coalesce(equal, F.lit(False))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` in the struct ``row`` beside its measures in the struct ``m``."""
    df = docs.select(nested(docs).alias("row"), text_of(text_col).alias("t"))
    df = df.select(
        "row",
        "t",
        words(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(SOLID)).alias("lines"),
    )
    df = df.select(
        "row",
        "t",
        "w",
        "lines",
        F.size("w").alias("n"),
        F.when(
            F.size("w") > WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)])),
        ).alias("hashes"),
    )
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = df.select("*", F.when(again, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ranked"))
    near = lambda k: F.get(F.col("ranked"), k)
    df = df.select("row", "t", "w", "lines", "n", F.filter("ranked", lambda x, k: _same(x, near(k - 1)) | _same(x, near(k + 1))).alias("twice"))
    inside = F.array_distinct(F.flatten(F.transform("twice", lambda x: F.sequence(x["i"], x["i"] + (WINDOW - 1)))))
    stop = F.filter(F.col("w"), lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(STOP_WORDS))
    return sealed(
        df,
        "row",
        "m",
        F.struct(
            F.col("n").cast("long").alias("n_words"),
            F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
            F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("twice").isNotNull(), F.size(inside)).otherwise(0).cast("long").alias("n_repeat_words"),
            F.size(stop).cast("long").alias("n_stop_words"),
        ),
    )


def _ratios(m: str) -> dict[str, Column]:
    c = F.col(m)
    n = F.greatest(c["n_words"], F.lit(1))
    return {
        "n_words": c["n_words"],
        "repeat_percent": 100 * c["n_repeat_words"] / n,
        "mean_word_chars": c["word_chars"] / n,
        "symbols_per_word": c["n_symbols"] / n,
        "dup_line_ratio": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
        "stop_word_ratio": c["n_stop_words"] / n,
    }


def _broken(rule: Rule, of: dict[str, Column]) -> Column:
    out = F.lit(False)
    if rule.low is not None:
        out = out | (of[rule.measure] < rule.low)
    if rule.high is not None:
        out = out | (of[rule.measure] > rule.high)
    return out


def quality(docs: DataFrame, text_col: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """``docs`` with its measures, ``base_failed``, ``failed_rules`` (names, comma-joined) and ``kept``."""
    df, of = measured(docs, text_col), _ratios("m")
    failed = F.concat_ws(",", *[F.when(_broken(r, of), F.lit(r.name)) for r in (*base, *rules)])
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | _broken(r, of)
    m = F.col("m")
    return restore(
        df,
        docs,
        "row",
        {k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": base_failed, "kept": failed == "", "failed_rules": failed},
    )
