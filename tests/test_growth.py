"""What queries of item strings and proposals do once, and not for every item or line again."""

import contextlib
import io
import random
import re

from pyspark.sql import functions as F

from harken.operators import catalog as cat
from harken.operators import evidence as ev
from harken.operators import intent
from harken.plans import extended
from harken.plans import queries as q
from harken.sources import views

DIR = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_strings_are_read_once(spark):
    """Patterns run over distinct strings of specifications, not over those of every item."""
    plan = optimized(cat.item_pairs(q._index(spark, DIR)))
    assert "regexp" in plan
    assert "Aggregate [s" in plan[plan.index("regexp") :]
    items = spark.createDataFrame([("A", ["Material: Cotton", "zip closure"]), ("B", ["zip closure", "zip closure"]), ("C", [])], "parent_asin string, spec array<string>")
    got = {tuple(r) for r in cat.item_pairs(items).collect()}
    assert got == {("A", "material", "cotton"), ("A", "feature", "zip closure"), ("B", "feature", "zip closure")}


def test_matches_are_made_once_for_mixtures(spark):
    """A span's mass and its items come from one table of matches; items' texts are not in the plan of what follows."""
    assert "regexp" not in optimized(extended.ambiguity_mixtures(spark, DIR))


def test_overlap_forms_only_what_texts_ask_for(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(12)]
    bag = lambda n: rng.sample(words, n)
    items = {f"P{i}": bag(rng.randint(1, 9)) for i in range(60)}
    texts = [" ".join(bag(rng.randint(1, 4))) for _ in range(9)] + ["unheard", "word1 unheard unheard2"]
    index = spark.createDataFrame([(k, v, "") for k, v in items.items()], "parent_asin string, spec array<string>, title string")
    asked = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.text, r.parent_asin): round(r.share, 9) for r in ev.overlap(asked, index).collect()}
    share = lambda t, ws: len(set(t.split()) & set(ws)) / len(set(t.split()))
    assert got == {(t, k): round(share(t, ws), 9) for t in texts for k, ws in items.items() if share(t, ws) >= ev.FLOOR}
    plan = optimized(ev.overlap_pairs(asked.where("text = 'unheard'"), index))
    assert "LeftOuter" not in plan.split("AS y#")[1]  # an item's tokens that no text has are not kept


def test_proposals_are_read_once_for_candidates(spark):
    """Phrases are staged: lines are numbered, cleaned and judged once."""
    phrases = intent.validated(views.proposals(spark, DIR)).select("attribute", F.col("value").alias("phrase"))
    assert "l_orderkey" in optimized(phrases)
    assert "l_orderkey" not in optimized(extended.vocabulary_candidates(spark, DIR))


def test_validation_is_compiled(spark):
    """The JVM compiles no method of more than 8,000 bytes; such a one took most of the time of validation."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan has no code before it runs
    try:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            intent.validated(views.proposals(spark, DIR)).select("attribute", "value").explain(mode="codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000
