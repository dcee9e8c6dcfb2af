"""Decisions about a turn, wherever they come from: what of them may be acted on, and what they make of a session, turn by turn.

A decision says how a message is to be read (kind), by which way (route), and names a category and an attribute. All of it is checked against the message and fixed lists; a session's
route, whether its preference was overridden, and its counts are windows over its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harken.operators import intent, replies

# Kinds of messages, and ways to read them.
KINDS = ("buying", "browsing", "override_open", "reply", "override", "no_preference", "null_ask", "unknown")
ROUTES = ("deterministic", "hybrid")
MESSAGE_CHARS = 1500


def clean(value: Column, limit: int = intent.TEXT_CHARS) -> Column:
    folded = F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")
    return F.substring(F.btrim(folded, F.lit(" .;,\t\n")), 1, limit)


def decided(decisions: DataFrame) -> DataFrame:
    """(.., message, route, normalized, kind, category, attribute, n_operations) with all that was decided in a form that may be acted on.

    An unknown kind or attribute counts as none, and so does a category that the message does not hold. Without a known route, a message that was understood in part is
    read both ways, another by the templates alone. Null is an empty string.
    """
    low = lambda c: F.lower(clean(F.col(c)))
    kind = F.when(low("kind").isin(*KINDS), low("kind")).otherwise("unknown")
    category, message = clean(F.col("category")), F.coalesce("message", F.lit(""))
    attribute = F.when(low("attribute").isin(*intent.ATTRIBUTES), low("attribute")).otherwise("")
    some = (kind != "unknown") | (F.coalesce("n_operations", F.lit(0)) > 0)
    normalized = clean(F.col("normalized"), MESSAGE_CHARS)
    new = {
        "kind": kind,
        "category": F.when(F.contains(F.lower(message), F.lower(category)), category).otherwise(""),
        "attribute": attribute,
        "route": F.when(low("route").isin(*ROUTES), low("route")).when(some, "hybrid").otherwise("deterministic"),
        "normalized": F.when(normalized != "", normalized).otherwise(message),
    }
    return decisions.select(*[new[c].alias(c) if c in new else F.col(c) for c in decisions.columns])


def processed(turns: DataFrame) -> DataFrame:
    """Decided turns (session_id, turn, kind, route, category, attribute, texts: what is required in the turn) with session_route, override_seen, restored (the template's sentence, or null), and how
    many turns so far were restored and understood."""
    upto = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    leads = F.when(kind.isin("buying", "browsing"), kind).when(kind.isin("override", "override_open"), "override")
    restored = replies.rendered(kind, F.col("category"), F.col("attribute"), F.array_distinct("texts"))
    df = turns.withColumn("restored", restored)
    return df.withColumns(
        {
            "session_route": F.coalesce(F.last(leads, ignorenulls=True).over(upto), F.lit("browsing")),
            "override_seen": F.max(kind == "override").over(upto),
            "n_restored": F.count("restored").over(upto),
            "n_understood": F.count(F.when(kind != "unknown", 1)).over(upto),
        }
    )
