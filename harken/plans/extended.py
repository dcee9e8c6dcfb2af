"""Further queries over the star-schema tables: prose, proposals, the baseline, replies, experiments, JSON-lines sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harken.cli import outcomes
from harken.functions import rewording
from harken.functions import text as tx
from harken.operators import baseline, fusion, intent, replies, routing, transactions
from harken.operators import belief as bf
from harken.operators import catalog as cat
from harken.operators import dialogue as dlg
from harken.operators import evidence as ev
from harken.operators import experiments as ex
from harken.operators import scoring as sc
from harken.operators import vocabulary as voc
from harken.plans.queries import Query, _concepts, _conversations, _ended, _index, _item_pairs, _openers, _once, _per_session, _played, _pool, _sessions, _shipped, _states, _texts
from harken.sources import views
from harken.sources.registry import Settings
from harken.sources.stages import kept, staged, staged_path

#: Spans that may mean several things: span, text, attribute, value, confidence, polarity.
SPANS = (
    ("poly", "polyester", "material", "polyester", 0.6, "require"),
    ("poly", "spandex", "material", "spandex", 0.4, "require"),
    ("co", "cotton", "material", "cotton", 0.7, "require"),
    ("co", "color: black", "color", "black", 0.2, "require"),
    ("co", "corduroy jacket", "feature", "corduroy jacket", 0.1, "require"),
    ("stiff", "leather", "material", "leather", 0.5, "avoid"),
    ("stiff", "zip closure", "feature", "zip closure", 0.5, "avoid"),
)
CONFIGS = {"published": {}, "patient": {"v_continue": 0.95}, "hasty": {"stall_decay_clean": 0.4, "turn_cost": 0.2}, "early": {"deadline": 2}, "no_exclude": {"exclude_shipped": False}}


def prose_readings(s: SparkSession, d: str) -> DataFrame:
    return intent.prose_readings(views.utterances(s, d)).select("sample_id", "turn", "part", "reading", "text", "attribute", "value")


def tiered_constraints(s: SparkSession, d: str) -> DataFrame:
    return intent.tiered_constraints(dlg.parsed(views.utterances(s, d)))


def _weighed(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of conversations with n_sessions, before they are spread over turns, so that the rows of all turns are not shuffled."""
    return rows.join(sessions.groupBy(F.col("conv").alias("sample_id")).agg(F.count(F.lit(1)).alias("n_sessions")), "sample_id")


def slot_ages(s: SparkSession, d: str) -> DataFrame:
    sessions, _, held = _conversations(s, d)
    ages = intent.slot_ages(_weighed(sessions, held.select("sample_id", "attribute", "turn")), "n_sessions")
    return ages.groupBy("attribute", "at_turn", "age").agg(F.sum("n_sessions").alias("n_sessions"))


def override_modes(s: SparkSession, d: str) -> DataFrame:
    """What is live of the first turn's constraints, by how an override retires them."""
    sessions, read, held = _conversations(s, d)
    n, out = F.col("n_sessions"), None
    for erase in ("demote", "delete", "keep"):
        mine = dlg.constraints(read, erase) if erase == "delete" else held  # only deleting changes what is held
        live = dlg.weights(_weighed(sessions, mine), read, erase).groupBy("at_turn").agg(F.sum(n).alias("n_live"), F.round(F.sum(n * F.col("weight")), 6).alias("weight"))
        live = live.select(F.lit(erase).alias("erase"), "at_turn", "n_live", "weight")
        out = live if out is None else out.unionByName(live)
    return out


def baseline_terms(s: SparkSession, d: str) -> DataFrame:
    t = baseline.query_terms(F.coalesce("text", F.lit("")))
    return views.table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.md5(F.array_join(t, " ")).alias("digest"))


def field_search(s: SparkSession, d: str) -> DataFrame:
    found = baseline.search(_openers(s, d).select(F.col("opener").alias("query")), views.catalog(s, d, rated=False))
    return found.select("query", F.col("rank").cast("long").alias("rank"), "parent_asin", F.round("score", 6).alias("score"))


def reply_sentences(s: SparkSession, d: str) -> DataFrame:
    states = staged(_states(s, d), "states")
    route = dlg.parsed(states.select("opener").distinct(), "opener").select("opener", "route")
    df = ev.entropy(states, _pool(s, d), _index(s, d)).join(route, "opener")
    return df.select("opener", "text", replies.sentence(F.when(F.col("route") == "override", 0).otherwise(1), F.col("entropy"), F.lit("other")).alias("message"))


def rendered_templates(s: SparkSession, d: str) -> DataFrame:
    sessions, read, _ = _conversations(s, d)
    kind = F.when(F.col("kind") != "opener", F.col("kind")).when(F.col("route") == "override", "override_open").otherwise(F.col("route"))
    said = replies.rendered(kind, F.col("category"), F.lit("other"), F.col("texts"))
    df = read.select(F.col("sample_id").alias("conv"), kind.alias("kind"), F.coalesce((said == F.col("message")).cast("long"), F.lit(0)).alias("same"))
    return df.join(sessions.select("conv"), "conv").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("n_same"))


def state_json(s: SparkSession, d: str) -> DataFrame:
    sessions, read, held = _conversations(s, d)
    return _per_session(sessions, replies.state_json(held, read, 4))


def validated_proposals(s: SparkSession, d: str) -> DataFrame:
    df = intent.validated(views.proposals(s, d))
    return df.select("session_id", "turn", "ord", "op", "attribute", "value", "evidence", "polarity", "strength", F.round("confidence", 6).alias("confidence"), F.col("group").alias("span_group"))


def vocabulary_candidates(s: SparkSession, d: str) -> DataFrame:
    phrases = intent.validated(views.proposals(s, d)).select("attribute", F.col("value").alias("phrase"))
    found = intent.vocabulary_candidates(phrases, _concepts(s, d))
    return found.select("attribute", "phrase", F.col("rank").cast("long").alias("rank"), "concept", "label", F.round("score", 6).alias("score"), "support")


def _resolved(s: SparkSession, d: str) -> DataFrame:
    """Proposals with what they mean, meanings that the session's pool supports first."""
    found = _concepts(s, d)

    def supports(asked: DataFrame) -> DataFrame:
        openers = _sessions(s, d).select(F.col("sample_id").alias("session_id"), dlg.initial_message().alias("opener"))
        asked = staged(asked.join(openers, "session_id"), "asked-concepts")
        return asked.join(voc.support(asked.drop("session_id").distinct(), found, _pool(s, d)), ["opener", "attribute", "concept"]).drop("opener")

    return kept(s, d, "resolved", lambda: transactions.resolved(staged(intent.validated(views.proposals(s, d)).drop("message"), "proposals"), found, supports))


def applied_proposals(s: SparkSession, d: str) -> DataFrame:
    return transactions.applied(_resolved(s, d))


def ambiguity_mixtures(s: SparkSession, d: str) -> DataFrame:
    names = ("span", "text", "attribute", "value", "confidence", "polarity")
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in SPANS])
    index = _index(s, d)
    found = intent.mixtures(s.range(1).select(F.explode(rows).alias("r")).select("r.*"), index, _item_pairs(s, d))
    return found.groupBy("span").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum("gain"), 4).alias("total"))


def fused_lists(s: SparkSession, d: str) -> DataFrame:
    """The lists of the third turn of every session that something was proposed in: what is to be required, to be avoided, and uncertain."""
    read = intent.validated(views.proposals(s, d)).select("session_id", "turn", "ord", "op", "attribute", "value", "polarity", "strength", "confidence", "group")
    held, spans = fusion.statements(staged(read, "proposals"))
    held, spans = staged(held, "statements"), staged(spans, "spans")
    told = held.select("session_id").unionByName(spans.select("session_id")).distinct()
    openers = _sessions(s, d).select(F.col("sample_id").alias("session_id"), dlg.initial_message().alias("opener")).join(told, "session_id")
    found = fusion.lists(held, spans, staged(openers, "session-openers"), _pool(s, d), _index(s, d), _item_pairs(s, d), 3)
    return found.select("session_id", F.col("rank").cast("long").alias("rank"), "parent_asin", F.round("e", 5).alias("evidence"))


def routed_turns(s: SparkSession, d: str) -> DataFrame:
    """What decisions make of every session, turn by turn."""
    df = routing.processed(routing.decided(views.decisions(s, d).withColumn("n_operations", F.size("texts"))))
    long = lambda c: F.col(c).cast("long").alias(c)
    return df.select("session_id", long("turn"), "kind", "route", "category", "attribute", "normalized", "restored", "session_route", "override_seen", long("n_restored"), long("n_understood"))


def polarity_gains(s: SparkSession, d: str) -> DataFrame:
    index = _index(s, d)
    said = _texts(s, d).select("text", F.explode_outer(tx.pairs(F.col("text"))).alias("p")).where("p is not null").select("text", "p.*")
    found = intent.matches(staged(said, "readings"), index, _item_pairs(s, d))
    require, avoid = (F.round(F.sum(intent.gain(F.col("s"), F.lit(p))), 3).alias(p) for p in ("require", "avoid"))
    return found.groupBy("text", "attribute", "value").agg(F.count(F.lit(1)).alias("n_items"), require, avoid)


def known_curve(s: SparkSession, d: str) -> DataFrame:
    return ex.known_curve(_ended(s, d)).select(F.col("k").cast("long").alias("k"), F.col("turn").cast("long").alias("turn"), "share")


def shipped_curve(s: SparkSession, d: str) -> DataFrame:
    return sc.early_hits(bf.results(*_shipped(s, d)))


def stopping_bound(s: SparkSession, d: str) -> DataFrame:
    return ex.stopping_bound(_ended(s, d))


def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return ex.nearest_rank(views.table(s, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


def token_usage(s: SparkSession, d: str) -> DataFrame:
    line = views.table(s, d, "lineitem")
    return ex.token_usage(line.select((F.col("l_quantity") - 10).cast("long").alias("prompt_tokens"), (F.col("l_suppkey") % 7 - 1).cast("long").alias("completion_tokens")))


def freeform_coverage(s: SparkSession, d: str) -> DataFrame:
    return ex.coverage(views.labelled(s, d, _index(s, d))).select(F.round("share", 6).alias("share"))


def config_depths(s: SparkSession, d: str) -> DataFrame:
    sessions, read, held = _conversations(s, d)
    plan = bf.policy(read, dlg.stalls(read, held), F.broadcast(ex.configurations(s, CONFIGS))).withColumnRenamed("sample_id", "conv")
    n = sessions.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    return plan.join(n, "conv").groupBy("config", "turn", "depth", "proven").agg(F.sum("n").alias("n_sessions"))


def config_sweep(s: SparkSession, d: str) -> DataFrame:
    results = ex.sweep(staged(_played(s, d, bf.outcomes, CONFIGS), "outcomes"), CONFIGS)
    return sc.metrics(results.withColumn("scenario_type", F.col("config"))).where("scenario_type <> 'all'").withColumnRenamed("scenario_type", "config")


def stress_rewrite(s: SparkSession, d: str) -> DataFrame:
    said = staged(dlg.transcripts(_once(s, d)).select("message").distinct(), "messages").withColumn("said", F.col("message"))
    out = None
    for level in (1, 2, 3):
        rows = rewording.rewritten(said, level).select(F.lit(level).alias("level"), F.col("said").alias("message"), F.col("message").alias("reworded"))
        out = rows if out is None else out.unionByName(rows)
    return out


def stressed_metrics(s: SparkSession, d: str) -> DataFrame:
    """The score at each level of rewording, and their mean."""
    out, sessions, once = None, _conversations(s, d)[0], _once(s, d)
    for level in sorted(rewording.LEVELS.values()):
        rows = _ended(s, d) if not level else bf.ended(outcomes(_index(s, d), sessions, once, Settings(), level))
        rows = sc.metrics(rows).where("scenario_type = 'all'").select(F.lit("published").alias("config"), F.lit(level).alias("level"), "score")
        out = rows if out is None else out.unionByName(rows)
    levels = staged(out, "level-scores")
    return levels.unionByName(ex.objectives(levels).select("config", F.lit(None).cast("int").alias("level"), F.col("objective").alias("score")))


#: Changes of a policy that are played together, in the order of names.
BOTH = {"no_exclude": {"exclude_shipped": False}, "published": {}}


def _both(s: SparkSession, d: str) -> DataFrame:
    """How sessions end with and without leaving out what was proven wrong; ranking does not depend on it."""
    return kept(s, d, "both-outcomes", lambda: _played(s, d, bf.outcomes, BOTH))


def ablated_metrics(s: SparkSession, d: str) -> DataFrame:
    """The score as published and under every named ablation, over all sessions."""
    out = None
    for name, change in {"published": {}, **ex.ABLATIONS}.items():
        if set(change) <= set(ex.POLICY):
            rows = bf.ended(_both(s, d), list(BOTH).index(name))
        else:
            rows = bf.ended(staged(_played(s, d, bf.outcomes, {name: {k: v for k, v in change.items() if k in ex.POLICY}}, Settings(**change)), "outcomes"))
        rows = sc.metrics(rows).where("scenario_type = 'all'").select(F.lit(name).alias("config"), "sample_count", "hit_rate", "mrr", "mttc", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def paired_interval(s: SparkSession, d: str) -> DataFrame:
    """The interval of what leaving out proven items gains."""
    return ex.interval_row(s, ex.paired_kinds(ex.paired(_both(s, d), list(BOTH).index("no_exclude"), list(BOTH).index("published"))), ["low", "mean", "high"])


def jsonl_catalog(s: SparkSession, d: str) -> DataFrame:
    """The catalog written as JSON lines, a file for each range of its order, read back in the order of files, indexed."""
    path, items = staged_path(s, "catalog-jsonl"), views.catalog(s, d)
    views.write_jsonl(items.orderBy("cat_pos").withColumn("details", F.map_from_entries("details")).drop("cat_pos"), path)
    index = cat.item_index(views.read_catalog(s, path))
    return index.select("parent_asin", F.array_join("hard", " | ").alias("hard"), F.array_join("soft", " | ").alias("soft"), F.array_join("spec", " | ").alias("spec"), "lexical_text", "category", (F.col("cat_pos") + 1).alias("place"))


def jsonl_transcripts(s: SparkSession, d: str) -> DataFrame:
    """Sessions written as JSON lines with cards, behaviour and openers, read back, and what their customers say."""
    path, index = staged_path(s, "sessions-jsonl"), _index(s, d)
    views.write_jsonl(views.labelled(s, d, index), path)
    return dlg.transcripts(dlg.labelled_sessions(views.read_jsonl(s, path, views.SESSIONS), index))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        prose_readings, tiered_constraints, slot_ages, override_modes, baseline_terms, field_search, reply_sentences, rendered_templates, state_json, validated_proposals,
        vocabulary_candidates, applied_proposals, ambiguity_mixtures, fused_lists, routed_turns, polarity_gains, known_curve, shipped_curve, stopping_bound, latency_percentiles, token_usage, freeform_coverage,
        config_depths, config_sweep, stress_rewrite, stressed_metrics, ablated_metrics, paired_interval, jsonl_catalog, jsonl_transcripts,
    )
}
