"""What a session says and shows: the reply's sentence, templates written back from what was understood, the state as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each question asks, and the entropy below which the first item is offered alone.
QUESTIONS = {
    "category": "What exact type of product are you looking for?",
    "material": "Do you have a preferred material or any material you want to avoid?",
    "color": "Do you have a preferred color or pattern?",
    "size": "What size, dimensions, or fit do you need?",
    "style": "What style, cut, or level of formality do you prefer?",
    "brand": "Is there a brand you prefer or want to avoid?",
    "budget": "What budget range would you like me to stay within?",
    "feature": "What must-have feature or compatibility requirement matters most?",
    "use_case": "What occasion, activity, environment, or season is this for?",
    "other": "What other requirement matters most to your decision?",
}
HOLD, SURE, CLOSEST = "Understood — let me narrow this down.", "I think this is the one.", "Here are the closest matches so far."
SURE_ENTROPY = 0.55


def sentence(depth: Column, entropy: Column, question: Column) -> Column:
    """The reply: silence, certainty or closeness, then the question."""
    lead = F.when(depth == 0, HOLD).when(entropy < SURE_ENTROPY, SURE).otherwise(CLOSEST)
    asked = None
    for name, said in QUESTIONS.items():
        asked = F.when(question == name, said) if asked is None else asked.when(question == name, said)
    return F.concat_ws(" ", lead, asked.otherwise(QUESTIONS["other"]))


def rendered(kind: Column, category: Column, attribute: Column, texts: Column) -> Column:
    """The template that says what was understood, null where nothing does. ``kind``: buying, browsing, override_open, reply, override, no_preference, null_ask."""
    some, blob = F.size(F.array_distinct(texts)) > 0, F.array_join(F.array_distinct(texts), "; ")
    named = F.coalesce(category, F.lit("")) != ""
    start = F.concat(F.lit("I'm looking for "), category)
    return (
        F.when((kind == "buying") & named & some, F.concat(start, F.lit(". A key requirement is: "), F.get(texts, F.lit(0)), F.lit(".")))
        .when((kind == "browsing") & named, F.concat(start, F.lit(", but I'm still exploring.")))
        .when((kind == "override_open") & named & some, F.concat(start, F.lit(". "), blob))
        .when((kind == "reply") & some, F.concat(F.lit("For that, what matters is: "), blob, F.lit(".")))
        .when((kind == "override") & some, F.concat(F.lit("Actually, ignore my earlier preference. What I need is: "), blob, F.lit(".")))
        .when((kind == "no_preference") & (F.coalesce(attribute, F.lit("")) != ""), F.concat(F.lit("I don't have an additional preference for "), attribute, F.lit(".")))
        .when(kind == "null_ask", F.lit("Those options are not quite right yet. Ask me about one specific attribute."))
    )


def state_json(held: DataFrame, read: DataFrame, turn: int) -> DataFrame:
    """(sample_id, state): each session's state at a turn as JSON: turn, category, the last four messages, what is held, in order."""
    upto = read.where(F.col("turn") <= turn)
    last = F.slice(F.sort_array(F.collect_list(F.struct("turn", "message"))), -4, 4)
    told = upto.groupBy("sample_id").agg(F.max("category").alias("category"), F.when(F.count(F.lit(1)) > 4, last).otherwise(F.sort_array(F.collect_list(F.struct("turn", "message")))).alias("said"))
    order = F.struct("turn", "part", "reading", "attribute", "value")
    active = held.where(F.col("turn") <= turn).groupBy("sample_id").agg(F.sort_array(F.collect_list(order)).alias("active"))
    active = active.select("sample_id", F.transform("active", lambda x: F.struct(x["attribute"].alias("attribute"), x["value"].alias("value"), x["turn"].alias("turn"))).alias("active"))
    nothing = F.array().cast("array<struct<attribute:string,value:string,turn:int>>")
    df = told.join(active, "sample_id", "left")
    state = F.struct(F.lit(turn).alias("turn"), "category", F.col("said.message").alias("recent_messages"), F.coalesce("active", nothing).alias("active"))
    return df.select("sample_id", F.to_json(state).alias("state"))
