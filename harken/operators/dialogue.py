"""Dialogue operators: the customer's side of a session in closed form, and the reading of it into constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harken.functions import text as tx

TURNS = 10
DECAY, SOFT, DEMOTED = 0.9, 0.70, 0.35
# The sentences of a session.
OPENER = r"(?s)^I'm looking for (.+?)(, but I'm still exploring\.|\. .*)?$"
KEY_REQUIREMENT = r"(?s)^\. A key requirement is: (.+?)\.?$"
REPLY = r"(?s)^For that, what matters is: (.+?)\.?$"
OVERRIDE = r"(?s)^Actually, ignore my earlier preference\. What I need is: (.+?)\.?$"
NULL_ASK = r"^Those options are not quite right yet"
NO_PREFERENCE = r"^I don't have (?:an additional preference|a preference) for ([a-z_]+)"


def sessions(samples: DataFrame, index: DataFrame) -> DataFrame:
    """Samples (target_pos) with their target's category and card."""
    target = index.select(F.col("cat_pos").alias("target_pos"), "parent_asin", "category", "hard", "soft", "card")
    return completed(samples.join(target, "target_pos"))


def labelled_sessions(labels: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of a JSON-lines set of sessions, hidden fields made from the target's product where the set omits them.

    A supplied card and behaviour count where both are there. The turn of a derived override is 3 or 4, by a hash of sample and scenario: the
    published draw comes from a seeded generator of another language and is an input wherever it matters. A free-form opener replaces the first message.
    """
    supplied = F.col("intent_card").isNotNull() & F.col("behavior").isNotNull()
    nothing = F.array().cast("array<string>")
    change = F.when(supplied, F.col("behavior.override"))
    drawn = (3 + F.pmod(F.xxhash64("sample_id", "scenario_type"), F.lit(2))).cast("int")
    target = index.select("parent_asin", "category", F.col("hard").alias("_hard"), F.col("soft").alias("_soft"))
    df = labels.withColumn("parent_asin", F.col("ground_truth.parent_asin")).join(target, "parent_asin", "left")
    df = df.withColumn("hard", F.when(supplied, F.coalesce("intent_card.hard_constraints", nothing)).otherwise(F.coalesce("_hard", nothing)))
    df = df.withColumn("soft", F.when(supplied, F.coalesce("intent_card.soft_preferences", nothing)).otherwise(F.coalesce("_soft", nothing)))
    df = df.select(
        "sample_id",
        "scenario_type",
        F.when(F.col("scenario_type") == "intent_override", F.coalesce(change["turn"], F.when(supplied, F.lit(3)).otherwise(drawn))).alias("override_turn"),
        "parent_asin",
        F.coalesce("category", F.lit("clothing item")).alias("category"),
        "hard",
        "soft",
        F.concat("hard", "soft").alias("card"),
        change["old_value"].alias("old_value"),
        change["new_value"].alias("new_value"),
        change["message"].alias("override_message"),
        F.col("free_form.initial_message").alias("free_opener"),
    )
    return completed(df)


def completed(sessions: DataFrame) -> DataFrame:
    """Adds what the set may state and the card otherwise gives: old_value, new_value, override_message, and free_opener, which may be null."""
    own = lambda c: F.col(c) if c in sessions.columns else F.lit(None).cast("string")
    df = sessions.withColumn("old_value", F.coalesce(own("old_value"), F.try_element_at("soft", F.lit(-1)), F.lit("I prefer a different style.")))
    df = df.withColumn("new_value", F.coalesce(own("new_value"), F.get("hard", F.lit(0)), F.lit("Please prioritize the target requirements.")))
    message = F.concat(F.lit("Actually, ignore my earlier preference. What I need is: "), F.col("new_value"), F.lit("."))
    return df.withColumn("override_message", F.coalesce(own("override_message"), message)).withColumn("free_opener", own("free_opener"))


def initial_message() -> Column:
    start = F.concat(F.lit("I'm looking for "), F.col("category"))
    message = (
        F.when((F.col("scenario_type") == "buying") & (F.size("hard") > 0), F.concat(start, F.lit(". A key requirement is: "), F.get("hard", F.lit(0)), F.lit(".")))
        .when(F.col("scenario_type") == "intent_override", F.concat(start, F.lit(". "), F.col("old_value")))
        .otherwise(F.concat(start, F.lit(", but I'm still exploring.")))
    )
    return F.coalesce(F.col("free_opener"), message)


def transcripts(sessions: DataFrame, asked: str = "other") -> DataFrame:
    """(sample_id, turn, message) of all ten turns of sessions from completed(): one fold per session over turns, no list is played.

    A reply discloses the first two open strings of the card that fit the attribute asked for; an override discloses its own string.
    """
    df = sessions if "new_value" in sessions.columns else completed(sessions)
    known = F.when((F.col("scenario_type") == "buying") & (F.size("hard") > 0), F.slice("hard", 1, 1)).otherwise(F.array().cast("array<string>"))
    df = df.select(
        "sample_id",
        "card",
        "new_value",
        "override_message",
        initial_message().alias("opener"),
        known.alias("known"),
        F.when(F.col("scenario_type") == "intent_override", F.col("override_turn")).otherwise(F.lit(0)).alias("here"),
        F.when(F.col("scenario_type") == "boundary", F.lit(2)).otherwise(F.lit(0)).alias("away"),
    )
    if asked != "other":
        df = df.withColumn("card", F.filter("card", lambda v: tx.classify(v) == asked))

    def step(acc: Column, turn: Column) -> Column:
        rest = F.slice(F.filter("card", lambda v: ~F.array_contains(acc["known"], v)), 1, 2)
        told = F.when(F.size(rest) > 0, F.concat(F.lit("For that, what matters is: "), F.array_join(rest, "; "), F.lit("."))).otherwise(F.lit(f"I don't have an additional preference for {asked}."))
        here, away = turn == F.col("here"), turn == F.col("away")
        message = F.when(here, F.col("override_message")).when(away, F.lit(f"I don't have a preference for {asked}; please use your judgment.")).otherwise(told)
        new = F.when(here, F.array("new_value")).when(away, F.array().cast("array<string>")).otherwise(rest)
        return F.struct(F.concat(acc["known"], new).alias("known"), F.array_append(acc["messages"], message).alias("messages"))

    start = F.struct("known", F.array("opener").alias("messages"))
    said = F.aggregate(F.sequence(F.lit(2), F.lit(TURNS)), start, step, lambda acc: acc["messages"])
    return df.select("sample_id", F.posexplode(said).alias("turn", "message")).withColumn("turn", F.col("turn") + 1)


def parsed(messages: DataFrame, message: str = "message") -> DataFrame:
    """Adds kind, category, route and texts (constraint strings, in order)."""
    m = F.trim(F.col(message))
    tail = F.regexp_extract(m, OPENER, 2)
    key = F.regexp_extract(tail, KEY_REQUIREMENT, 1)
    kind = (
        F.when(m.rlike(NULL_ASK), "null_ask").when(m.rlike(OPENER), "opener").when(m.rlike(OVERRIDE), "override").when(m.rlike(REPLY), "reply").when(m.rlike(NO_PREFERENCE), "no_preference").otherwise("other")
    )
    df = messages.withColumn("kind", kind)
    exploring = F.contains(tail, F.lit("still exploring"))
    opener = F.when(key != "", F.array(key)).when((tail == "") | exploring, F.array().cast("array<string>")).otherwise(F.array(F.regexp_replace(tail, r"^\. ", "")))
    route = F.when(F.col("kind") == "opener", F.when(key != "", "buying").when((tail == "") | exploring, "browsing").otherwise("override"))
    texts = (
        F.when(F.col("kind") == "opener", opener)
        .when(F.col("kind") == "override", F.array(F.regexp_extract(m, OVERRIDE, 1)))
        .when(F.col("kind") == "reply", F.split(F.regexp_extract(m, REPLY, 1), "; "))
        .otherwise(F.array().cast("array<string>"))
    )
    texts = F.filter(F.transform(texts, lambda t: F.rtrim(F.trim(t), F.lit("."))), lambda t: t != "")
    category = F.when(F.col("kind") == "opener", F.regexp_extract(m, OPENER, 1))
    return df.withColumn("category", category).withColumn("route", route).withColumn("texts", texts)


def constraints(read: DataFrame, erase: str = "demote") -> DataFrame:
    """(sample_id, turn, part, reading, text, attribute, value): readings of all texts less what was said before.

    A first reading stays if its text is new to the session; a further one if no earlier row has its attribute and value. Where an override
    deletes (``erase``), a text of the first turn that is said again after it is new again.
    """
    each = read.select("sample_id", "turn", F.posexplode_outer("texts").alias("part", "text")).where("text is not null")
    readings = each.select("text").distinct().select("text", F.posexplode_outer(tx.pairs(F.col("text"))).alias("reading", "p")).where("p is not null")
    each = each.join(readings.select("text", "reading", "p.attribute", "p.value"), "text")  # each distinct text is read once
    order = ["turn", "part", "reading"]
    by_text = ["sample_id", F.col("reading") == 0, "text"]
    by_value = Window.partitionBy("sample_id", "attribute", "value").orderBy(*order)
    df = each.withColumn("_v", F.row_number().over(by_value))
    if erase == "delete":
        df = df.join(overrides(read), "sample_id", "left").withColumn("_late", F.coalesce(F.col("turn") >= F.col("demoted_turn"), F.lit(False)))
        df = df.withColumn("_t", F.row_number().over(Window.partitionBy(*by_text, "_late").orderBy(*order)))
        first = F.min("turn").over(Window.partitionBy(*by_text))
        df = df.withColumn("_t", F.when(F.col("_late") & (first > 1) & (first < F.col("demoted_turn")), F.lit(2)).otherwise(F.col("_t")))
    else:
        df = df.withColumn("_t", F.row_number().over(Window.partitionBy(*by_text).orderBy(*order)))
    return df.where(F.when(F.col("reading") == 0, F.col("_t") == 1).otherwise(F.col("_v") == 1)).select("sample_id", "turn", "part", "reading", "text", "attribute", "value")


def overrides(read: DataFrame) -> DataFrame:
    return read.where("kind = 'override'").groupBy("sample_id").agg(F.min("turn").alias("demoted_turn"))


def retired(erase: str = "demote") -> float:
    """What is left of a constraint's weight once an override retires it: some of it, nothing, or all."""
    return {"demote": DEMOTED, "delete": 0.0, "keep": 1.0}[erase]


def weights(held: DataFrame, read: DataFrame, erase: str = "demote") -> DataFrame:
    """The weight of every constraint at every turn from its own on: decay, and what an override does to the first turn's.

    Rows may have confidence and strength (hard or soft); a soft one weighs SOFT of a hard one. A deleted one has no row from the override on.
    How many sessions share a conversation, n_sessions, stays if rows have it.
    """
    df = held.join(overrides(read), "sample_id", "left").select("*", F.explode(F.sequence("turn", F.lit(TURNS))).alias("at_turn"))
    demoted = (F.col("turn") <= 1) & (F.coalesce("demoted_turn", F.lit(99)) <= F.col("at_turn"))
    weight = F.pow(F.lit(DECAY), F.col("at_turn") - F.col("turn")) * F.when(demoted, retired(erase)).otherwise(1.0)
    if "strength" in held.columns:
        weight = weight * F.when(F.col("strength") == "soft", SOFT).otherwise(1.0)
    if "confidence" in held.columns:
        weight = weight * F.col("confidence")
    df = df.where(~demoted) if erase == "delete" else df
    also = [c for c in ("n_sessions",) if c in held.columns]
    return df.select("sample_id", "at_turn", "turn", "part", "reading", "text", "attribute", "value", weight.alias("weight"), *also)


def stalls(read: DataFrame, held: DataFrame) -> DataFrame:
    """(sample_id, turn, gained, stalls): rows gained in a turn, and turns in a row without any; the first turn never stalls."""
    gained = held.groupBy("sample_id", "turn").agg(F.count(F.lit(1)).alias("gained"))
    df = read.select("sample_id", "turn").join(gained, ["sample_id", "turn"], "left").withColumn("gained", F.coalesce("gained", F.lit(0)))
    upto = Window.partitionBy("sample_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("gained") > 0, F.col("turn"))).over(upto)
    return df.select("sample_id", "turn", "gained", (F.col("turn") - F.coalesce(last, F.lit(1))).alias("stalls"))
