"""Sessions from JSON lines, state in batches and streams, proposals, settings, the model tier around a fake transport."""

import json
import random

import pytest
from pyspark.sql import functions as F

CATALOG = [
    {"parent_asin": "A", "title": "Blue running shoe", "features": ["cotton"], "details": {"department": "womens"}, "description": ["walking shoe"], "categories": ["Clothing", "Shoes"], "store": "Example", "average_rating": 4.2, "rating_number": 10, "price": 49.0},
    {"parent_asin": "B", "title": "Black winter boot", "features": ["leather"], "details": {"department": "womens"}, "description": ["winter boot"], "categories": ["Clothing", "Boots"], "store": "Example", "average_rating": 4.4, "rating_number": 12, "price": 89.0},
    {"title": "no id"},
    {"parent_asin": "C", "title": "Plain hat", "features": None, "description": ["a red hat of wool"], "categories": None, "details": {"Fit": "", "Care": "hand wash"}},
    {"parent_asin": "D", "title": None},
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("sets")
    (root / "catalog.jsonl").write_text("".join(json.dumps(r) + "\n\n" for r in CATALOG))
    samples = [{"sample_id": f"s{i}", "scenario_type": s, "user_profile": {"summary": "x"}, "ground_truth": {"parent_asin": a}} for i, (s, a) in enumerate([("buying", "A"), ("browsing", "B"), ("intent_override", "C"), ("boundary", "A")])]
    samples.append(samples[1] | {"sample_id": "s4", "free_form": {"initial_message": "any black boots made of leather?"}})
    (root / "sessions.jsonl").write_text("".join(json.dumps(r) + "\n" for r in samples))
    return root


def test_catalog_of_json_lines(spark, files):
    from harken.operators.catalog import item_index, item_pairs
    from harken.sources.views import read_catalog

    index = item_index(read_catalog(spark, f"file://{files}/catalog.jsonl"))
    rows = {r.parent_asin: r for r in index.orderBy("cat_pos").collect()}
    assert list(rows) == ["A", "B", "C", "D"] and [r.cat_pos for r in rows.values()] == [0, 1, 2, 3]
    assert rows["A"].card == ["cotton", "color: blue", "department: womens", "budget around $49.0"] and rows["A"].category == "Shoes"
    assert rows["C"].card == ["wool", "color: red", "Care: hand wash"] + [] and rows["C"].spec == ["Care: hand wash"] and rows["C"].category == "clothing item"
    assert rows["D"].card == ["product", "product"] and rows["D"].log_pop == 0
    assert {(r.attribute, r.value) for r in item_pairs(index).where("parent_asin = 'C'").collect()} == {("use_case", "hand wash")}


def test_sessions_of_json_lines_are_played(spark, files):
    """Hidden fields are made from the products where the set omits them; every target is found."""
    from harken import cli

    report = cli.main(["--catalog", f"file://{files}/catalog.jsonl", "--sessions", f"file://{files}/sessions.jsonl", "--bootstrap", "--out", f"file://{files}/runs"])
    run = report["runs"][0]
    assert run["sample_count"] == 5 and run["hit_rate"] == 1.0 and run["free_form"] == 0.2 and run["interval"][0] <= run["score"] <= run["interval"][1]
    assert spark.read.json(f"file://{files}/runs").count() == 1


def test_supplied_cards_and_openers_count(spark, files):
    from harken.operators import dialogue as dlg
    from harken.operators.catalog import item_index
    from harken.sources.views import SESSIONS, read_catalog

    card = {"target_category": "x", "hard_constraints": ["own one", "own two"], "soft_preferences": ["own three"]}
    change = {"turn": 4, "old_value": "old", "new_value": "new", "message": "Actually, ignore my earlier preference. What I need is: new."}
    labels = [("a", "intent_override", card, {"scenario_type": "intent_override", "override": change}, None), ("b", "buying", card, {"scenario_type": "buying", "override": None}, {"initial_message": "hello there"})]
    rows = spark.read.schema(SESSIONS).json(spark.sparkContext.parallelize([json.dumps({"sample_id": i, "scenario_type": s, "ground_truth": {"parent_asin": "A"}, "intent_card": c, "behavior": b, "free_form": f}) for i, s, c, b, f in labels]))
    said = {}
    for r in dlg.transcripts(dlg.labelled_sessions(rows, item_index(read_catalog(spark, f"file://{files}/catalog.jsonl")))).orderBy("sample_id", "turn").collect():
        said.setdefault(r.sample_id, []).append(r.message)
    assert said["a"][:5] == ["I'm looking for Shoes. old", "For that, what matters is: own one; own two.", "For that, what matters is: own three.", change["message"], "I don't have an additional preference for other."]
    assert said["b"][:3] == ["hello there", "For that, what matters is: own two; own three.", "I don't have an additional preference for other."]


MESSAGES = [
    "I'm looking for Shoes. A key requirement is: 100% cotton.", "something in cotton; size 9. made of wool please", "For that, what matters is: color: red; Department: womens.", "For that, what matters is: 100% cotton; made of silk.",
    "Actually, ignore my earlier preference. What I need is: color: red.", "I don't have an additional preference for other.", "I want red. and blue too; hm", "red", "good for hiking use; material: wool", "nice", "", "cotton; wool; $20",
]


def one_by_one(turns, readings):
    """What a session holds after its messages, rule by rule."""
    held = []
    for turn, (kind, parts) in enumerate(turns, 1):
        for part, text in parts:
            for at, (a, v) in enumerate(readings[text]):
                same_pair = any((h[2], h[3]) == (a, v) for h in held)
                if kind == "other":
                    if (a, v) != ("feature", text.lower()) and not same_pair:
                        held.append((turn, text, a, v))
                elif not any(h[1] == text for h in held) if at == 0 else not same_pair:
                    held.append((turn, text, a, v))
    return held


@pytest.fixture(scope="module")
def dialogues(spark):
    rng = random.Random(9)
    rows = [(s, t, rng.choice(MESSAGES)) for s in range(60) for t in range(1, 11)]
    return spark.createDataFrame(rows, "sample_id long, turn int, message string")


def test_tiers_against_one_by_one(spark, dialogues):
    from harken.functions import text as tx
    from harken.operators import dialogue as dlg
    from harken.operators import intent

    read = dlg.parsed(dialogues)
    got = {}
    for r in intent.tiered_constraints(read).collect():
        got.setdefault(r.sample_id, set()).add((r.turn, r.text, r.attribute, r.value))
    prose = {}
    for r in dialogues.where("true").select("message").distinct().collect():
        chunks = [c.strip() for c in __import__("re").split("[;.]", r.message)]
        prose[r.message] = [(i, c) for i, c in enumerate(chunks) if len(c) >= 3]
    sessions = {}
    for r in read.orderBy("sample_id", "turn").collect():
        sessions.setdefault(r.sample_id, []).append((r.kind, prose[r.message] if r.kind == "other" else list(enumerate(r.texts))))
    texts = {t for turns in sessions.values() for _, parts in turns for _, t in parts}
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.pairs(F.col("text")).alias("p"))
    readings = {r.text: [(p.attribute, p.value) for p in r.p] for r in df.collect()}
    assert got == {s: set(one_by_one(turns, readings)) for s, turns in sessions.items() if one_by_one(turns, readings)}


def streamed(spark, folder, parts, silence=30 * 60 * 1000, name="held"):
    """The rows that a stream over ``parts`` (files, one a batch) gives; the query is stopped and started again after each of them."""
    import time

    from harken.streaming.sessions import held_constraints

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for part in parts:
        if part is None:
            time.sleep(silence / 1000 + 0.3)
        else:
            part.coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
        stream = spark.readStream.schema("sample_id string, turn int, message string").parquet(f"file://{folder}/in")
        query = held_constraints(stream, silence).writeStream.format("parquet").option("path", f"file://{folder}/out").outputMode("append").option("checkpointLocation", f"file://{folder}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"file://{folder}/out")


COLS = ["sample_id", "turn", "part", "reading", "text", "attribute", "value", "tier"]


def test_streamed_sessions_hold_what_batches_hold(spark, dialogues, tmp_path):
    """Keys are strings, messages arrive in three files, turns out of order, and the query starts again from its checkpoint after each."""
    from harken.operators import dialogue as dlg
    from harken.operators import intent

    said = dialogues.select(F.concat(F.lit("s-"), F.col("sample_id")).alias("sample_id"), F.col("turn").cast("int").alias("turn"), "message")
    got = streamed(spark, tmp_path, [said.where(F.pmod(F.xxhash64("sample_id", "turn"), F.lit(3)) == k) for k in range(3)])
    want = intent.tiered_constraints(dlg.parsed(said)).select(*COLS).collect()
    assert sorted(map(tuple, got.select(*COLS).collect())) == sorted(map(tuple, want))


def test_silent_sessions_end(spark, tmp_path):
    """A session without its last turns, and one with a gap, end by their timer: what waits is taken in, the state goes, and a message that comes later begins anew."""
    rows = [("a", 1, "I'm looking for Shoes. A key requirement is: cotton."), ("a", 2, "For that, what matters is: black."), ("b", 1, "I'm looking for Hats."), ("b", 3, "For that, what matters is: wool; red.")]
    df = spark.createDataFrame(rows, "sample_id string, turn int, message string")
    other = spark.createDataFrame([("c", 1, "For that, what matters is: silk.")], df.schema)
    again = spark.createDataFrame([("a", 1, "For that, what matters is: cotton.")], df.schema)
    got = streamed(spark, tmp_path, [df, None, other, None, again], silence=1000)
    found = sorted((r.sample_id, r.turn, r.text) for r in got.where("reading = 0").collect())
    assert found == [("a", 1, "cotton"), ("a", 1, "cotton"), ("a", 2, "black"), ("b", 3, "red"), ("b", 3, "wool"), ("c", 1, "silk")]


def proposal(session, turn, ord_, op, value="cotton", canonical=True, attribute="material", group="", alternatives=(), **more):
    named = value if canonical is True else canonical
    row = {"session_id": session, "turn": turn, "ord": ord_, "op": op, "attribute": attribute, "value": value, "evidence": value, "polarity": "require", "strength": "hard", "confidence": 0.9, "group": group, "canonical": named, "resolved": named, "own_value": value, "alternatives": [(v, attribute, v, c) for v, c in alternatives]} | more
    return tuple(row[c] for c in RESOLVED)


RESOLVED = ["session_id", "turn", "ord", "op", "attribute", "value", "evidence", "polarity", "strength", "confidence", "group", "canonical", "resolved", "own_value", "alternatives"]
RESOLVED_SCHEMA = "session_id string, turn int, ord int, op string, attribute string, value string, evidence string, polarity string, strength string, confidence double, `group` string, canonical string, resolved string, own_value string, alternatives array<struct<text:string,attribute:string,value:string,confidence:double>>"


def one_after_another(rows, erase):
    """What a session holds, told by going through its proposals: (value, turn, demoted, alive, ended_turn, confidence, tier) and (evidence, turn, alive, ended_turn)."""
    held, open_ = [], []

    def over(turn, attribute, value=None):
        for s in open_:
            if s["end"] is None and any(o[1] == attribute and value in (None, o[2]) for o in s["options"]):
                s["end"] = turn

    def doubt(turn, evidence, options):
        if options and not any(s["end"] is None and (s["text"].lower(), [o[1:3] for o in s["options"]]) == (evidence.lower(), [o[1:3] for o in options]) for s in open_):
            open_.append({"text": evidence, "options": options, "turn": turn, "end": None})

    rows = [dict(zip(RESOLVED, r, strict=True)) for r in rows]
    for turn in sorted({r["turn"] for r in rows}):
        now = sorted((r for r in rows if r["turn"] == turn), key=lambda r: r["ord"])
        groups = {}
        for r in now:
            if r["group"]:
                groups.setdefault(r["group"], []).append(r)
        unsure = {g: rs for g, rs in groups.items() if len(rs) > 1}
        for rs in unsure.values():
            doubt(turn, rs[0]["evidence"], [o for r in rs for o in ([(r["canonical"], r["attribute"], r["resolved"], r["confidence"])] if r["canonical"] else []) + r["alternatives"]][:6])
        for r in now:
            if r["group"] in unsure:
                continue
            live = [h for h in held if h["alive"]]
            meant = [h for h in live if h["attribute"] == r["attribute"] and (r["value"] in (h["value"], h["text"], h["source"]) or r["own_value"] == h["value"])]
            gone = meant if r["op"] == "remove" else [h for h in live if h["attribute"] == r["attribute"] and h["turn"] < turn] if r["op"] == "replace" and r["canonical"] else []
            for h in gone:
                h["demoted"], h["alive"], h["end"] = erase == "demote", erase == "demote", turn
            if r["op"] == "confirm":
                for h in meant:
                    h["confidence"] = max(h["confidence"], r["confidence"])
                    if r["canonical"]:
                        h["source"], h["text"], h["tier"] = r["evidence"], r["canonical"], "canonical"
                    elif "confirmed" not in h["tier"]:
                        h["tier"] += "+confirmed"
            elif r["op"] == "remove" or r["op"] == "replace" and r["canonical"]:
                over(turn, r["attribute"])
            if r["op"] in ("add", "replace") and not r["canonical"]:
                doubt(turn, r["evidence"], r["alternatives"])
            elif r["op"] in ("add", "replace") and not any(h["alive"] and h["polarity"] == r["polarity"] and (h["text"] == r["canonical"] or (h["attribute"], h["value"]) == (r["attribute"], r["resolved"])) for h in held):
                held.append({"attribute": r["attribute"], "value": r["resolved"], "text": r["canonical"], "source": r["evidence"], "polarity": r["polarity"], "turn": turn, "confidence": r["confidence"], "tier": "canonical", "demoted": False, "alive": True, "end": None})
                over(turn, r["attribute"], r["resolved"])
    facts = sorted((h["value"], h["turn"], h["demoted"], h["alive"], h["end"], h["confidence"], h["tier"]) for h in held)
    return facts, sorted((s["text"], s["turn"], s["end"] is None, s["end"]) for s in open_)


def test_proposals_as_a_history(spark):
    """Random sessions, and one told by hand, against going through them one proposal after another."""
    from harken.operators import transactions

    hand = [
        proposal("hand", 1, 1, "add"), proposal("hand", 1, 2, "add", "poly", None, alternatives=[("polyester", 0.5), ("spandex", 0.4)]), proposal("hand", 1, 3, "add", "poly", None, alternatives=[("polyester", 0.5), ("spandex", 0.4)]),
        proposal("hand", 2, 1, "add", "polyester"), proposal("hand", 3, 1, "replace", "wool"), proposal("hand", 4, 1, "replace", "unknown", None), proposal("hand", 5, 1, "add", "silk", group="g"),
        proposal("hand", 5, 2, "add", "rayon", group="g", confidence=0.3), proposal("hand", 6, 1, "confirm", "wool", None, confidence=1.0), proposal("hand", 6, 2, "no_preference", "", None),
    ]
    r = __import__("random").Random(4)
    sessions = {"hand": hand}
    for k in range(120):
        rows, values = [], ["cotton", "wool", "silk", "red"]
        for turn in range(1, r.randrange(2, 6)):
            for ord_ in range(1, r.randrange(1, 6)):
                op, value = r.choice(["add", "add", "add", "replace", "remove", "confirm", "no_preference"]), r.choice(values)
                known = r.random() < 0.75
                rows.append(proposal(f"r{k}", turn, ord_, op, value, True if known else None, group=r.choice(["", "", "", "g"]), alternatives=() if known else tuple((v, 0.4) for v in r.sample(values, 2)), polarity=r.choice(["require", "require", "avoid"]), confidence=r.choice([0.6, 0.8, 1.0])))
        sessions[f"r{k}"] = rows
    df = spark.createDataFrame([x for rows in sessions.values() for x in rows], RESOLVED_SCHEMA)
    for erase in ("demote", "delete"):
        got = {}
        for x in transactions.applied(df, erase).collect():
            facts, spans = got.setdefault(x.session_id, ([], []))
            if x.kind == "span":
                spans.append((x.text, x.turn, x.alive, x.ended_turn))
            else:
                facts.append((x.value, x.turn, x.demoted, x.alive, x.ended_turn, x.confidence, x.tier))
        for name, rows in sessions.items():
            facts, spans = got.get(name, ([], []))
            assert (sorted(facts, key=str), sorted(spans, key=str)) == tuple(sorted(x, key=str) for x in one_after_another(rows, erase)), (erase, rows)
    of = {x.session_id: x for x in transactions.flags(df).collect()}
    assert (of["hand"].override_seen, of["hand"].route, of["hand"].asked) == (True, "override", ["material"])
    mixture = transactions.applied(df.where("session_id = 'hand'")).where("kind = 'span' and turn = 5").first().alternatives
    assert [round(o.confidence, 2) for o in mixture] == [0.75, 0.25]


def test_rewording(spark):
    from harken.functions.rewording import SENTENCES, reworded

    said = ["I'm looking for Men's Shoes, but I'm still exploring.", "I'm looking for Shoes. A key requirement is: Material: alloy.", "For that, what matters is: Color: red; 100% cotton.", "I don't have a preference for size; please use your judgment.", "other words", None]
    df = spark.createDataFrame([(x,) for x in said], "m string").select("m", *[reworded(F.col("m"), k).alias(f"l{k}") for k in range(4)])
    rows = {r.m: r for r in df.collect()}
    assert all(r.l0 == m for m, r in rows.items()) and rows["other words"].l3 == "other words" and rows[None].l2 is None
    assert all(r[f"l{k}"] != m for m, r in rows.items() if m not in ("other words", None) for k in (1, 2, 3))
    assert rows[said[2]].l1 in {f.replace("#", "Color: red; 100% cotton") for f in SENTENCES["reply"]}
    assert "100%" not in rows[said[2]].l2 and "cotton" in rows[said[2]].l2 and rows[said[0]].l1 != rows[said[1]].l1


def test_registry(spark, tmp_path):
    from harken.sources.registry import SessionSets, Settings, content_hash, manifest, read_env, verify

    s = Settings.parsed("no_exact, bm25_gain=2,deadline=4,exclude_shipped=False,lexical")
    assert (s.exact, s.bm25_gain, s.deadline, s.exclude_shipped, s.lexical) == (False, 2.0, 4, False, True)
    for bad in ("no_such", "x=1"):
        with pytest.raises(KeyError):
            Settings.parsed(bad)
    with pytest.raises(PermissionError):
        SessionSets("f").guard("f/public.jsonl")
    with pytest.raises(KeyError):
        SessionSets("f").report(spark, "train")
    (tmp_path / "a").write_text("1")
    held = manifest(str(tmp_path), ["a"])
    verify(str(tmp_path), held)
    with pytest.raises(RuntimeError):
        verify(str(tmp_path), held | {"gone": "0"})
    (tmp_path / "env").write_text("# x\nHARKEN_TEST_KEY=v\n")
    assert read_env(str(tmp_path / "env")) == {"HARKEN_TEST_KEY": "v"}
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    assert content_hash(df) == content_hash(df.repartition(7).select("x", "id")) != content_hash(df.where("id > 0"))


def test_model_tier_sends_each_request_once(spark, tmp_path):
    from harken.operators import model_tier as mt

    def transport(path, body):
        if body["q"] == "bad":
            raise mt.Refused(429)
        return {"choices": [{"message": {"content": f"said: {{\"constraints\": [{{\"attribute\": \"Color\", \"value\": \"{body['q']}\"}}]}} [2, 1]"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}

    requests = spark.createDataFrame([("/c", json.dumps({"q": q})) for q in ("red", "red", "blue", "bad")], "path string, body string")
    cache = f"file://{tmp_path}/cache"
    first, calls = mt.answered(requests, cache, transport, wait=0.0)
    assert calls.count() == 3 and calls.where("failed").count() == 1 and first.where("answer is null").count() == 1
    again, calls2 = mt.answered(requests, cache, None)
    assert calls2.count() == 0 and again.where("answer is not null").count() == 3
    r = mt.report(calls, first).first()
    assert (r.calls, r.failures, r.prompt_tokens, r.completion_tokens) == (3, 1, 6, 4) and r.latency_p95 is not None
    assert {tuple(p) for x in mt.extracted(again).collect() for p in x.pairs} == {("color", "red"), ("color", "blue")}
    both = mt.reranked(again.withColumn("candidates", F.array(F.lit("x"), F.lit("y")))).where("answer is not null").first()
    assert both.ranked == ["y", "x"]


def test_resampling_and_percentiles(spark):
    from harken.operators import experiments as ex

    rows = [(i, True, 1 + i % 3, 1.0 / (1 + i % 2)) for i in range(200)]
    schema = "sample_id long, hit boolean, first_hit_turn int, reciprocal_rank double"
    before = spark.createDataFrame(rows, schema)
    better = before.withColumn("reciprocal_rank", F.lit(1.0))
    low, mean, high = ex.paired_bootstrap(before, better)
    assert low <= mean <= high and abs(mean - 0.3 * 0.25) < 1e-4 and ex.confirmed(before, better) and not ex.confirmed(better, before)
    values = spark.createDataFrame([("a", float(v)) for v in range(10)] + [("b", 7.5)], "k string, v double")
    assert {r.k: (r.p50, r.p95) for r in ex.nearest_rank(values, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()} == {"a": (5.0, 9.0), "b": (7.5, 7.5)}
    tried = [{"config": {"x": 0.5}, "objective": 1.0}]
    assert ex.proposals(tried, {"x": (0, 1)}, 4, 0) == ex.proposals(tried, {"x": (0, 1)}, 4, 0) and all(0 <= c["x"] <= 1 for c in ex.proposals(tried, {"x": (0, 1)}, 4, 0))
    found = ex.search(lambda configs: [-abs(c["x"] - 0.3) for c in configs], {"x": (0.0, 1.0)}, rounds=6, batch=8)
    assert len(found) == 48 and abs(found[0]["config"]["x"] - 0.3) < 0.05
    with pytest.raises(KeyError):
        ex.configurations(spark, {"a": {"nothing": 1}})
    assert ex.objectives(spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.5)], "config string, level int, score double")).first().objective == 0.75


def test_vocabulary_candidates(spark):
    from harken.operators import intent

    found = spark.createDataFrame([("material", c, c, f"p{i}", i) for i, c in enumerate(["polyester", "poly blend", "cotton", "wool"])], "attribute string, concept string, label string, parent_asin string, cat_pos long")
    phrases = spark.createDataFrame([("material", p) for p in ("polyster", "poly", "coton", "tin", "")], "attribute string, phrase string")
    got = {}
    for r in intent.vocabulary_candidates(phrases, found).orderBy("phrase", "rank").collect():
        got.setdefault(r.phrase, []).append((r.concept, round(r.score, 3)))
    assert got["polyster"][0] == ("polyester", 10.0) and got["poly"][0] == ("poly blend", round(3 * 0.5 + 2 * 1.0 + 2 * 4 / 14, 3))
    assert got["coton"] == [("cotton", round(2 * 5 / 11, 3))] and "tin" not in got and "" not in got


def test_sweep_of_the_published_policy_is_the_played_score(spark):
    from harken.plans import extended, queries

    folder = "/root/testdata/sf0.001"
    swept = extended.QUERIES["config_sweep"](spark, folder).where("config = 'published'").first()
    played = queries.QUERIES["played_metrics"](spark, folder).where("scenario_type = 'all'").first()
    assert (swept.sample_count, swept.hit_rate, swept.mrr, swept.mttc) == (played.sample_count, played.hit_rate, played.mrr, played.mttc)


def test_joint_support_by_bitmaps(spark):
    """Counts of conjunctions against plain sets, over items in several buckets, with a concept that no item of the pool has."""
    from harken.operators import vocabulary as voc

    r = __import__("random").Random(6)
    items = [f"p{i}" for i in range(300)]
    number = {x: i * 997 for i, x in enumerate(items)}  # nine buckets
    has = {c: set(r.sample(items, n)) for c, n in (("cotton", 150), ("black", 90), ("wool", 40), ("none", 0))}
    pools = {"o1": set(items[:200]), "o2": set(r.sample(items, 60))}
    found = spark.createDataFrame([("feature", c, c, x, number[x]) for c, xs in has.items() for x in xs] + [("other", "any", "any", x, number[x]) for x in items], "attribute string, concept string, label string, parent_asin string, cat_pos long")
    pool = spark.createDataFrame([(o, x, i) for o, xs in pools.items() for i, x in enumerate(sorted(xs))], "opener string, parent_asin string, pool_pos long")
    sets = {"a": ["cotton"], "b": ["cotton", "black"], "c": ["cotton", "black", "wool"], "d": ["cotton", "none"]}
    asked = spark.createDataFrame([(o, k, "feature", c) for o in pools for k, cs in sets.items() for c in cs], "opener string, k string, attribute string, concept string")
    got = {(x.opener, x.k): x.n_items for x in voc.joint_support(asked, found, pool, "k").collect()}
    assert got == {(o, k): len(xs.intersection(*[has[c] for c in cs])) for o, xs in pools.items() for k, cs in sets.items()}


def test_runs_are_published_once(spark, tmp_path):
    """A job whose task fails leaves nothing to read; its repetition publishes all rows, a further one none."""
    from harken.sources.runs import read_runs, write_run

    path, schema = f"file://{tmp_path}/runs", "id long, word string"
    rows = spark.range(0, 100, 1, 4).select("id", F.concat(F.lit("w"), F.col("id")).alias("word"))
    write_run(rows.where("id < 3"), path, "first")
    failing = rows.withColumn("word", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("word")))
    with pytest.raises(Exception, match="lost"):
        write_run(failing, path, "second")
    assert read_runs(spark, path, schema).count() == 3
    for _ in range(2):
        write_run(rows, path, "second")
        got = read_runs(spark, path, schema).collect()
        assert sorted((r.run, r.id, r.word) for r in got) == sorted([("first", i, f"w{i}") for i in range(3)] + [("second", i, f"w{i}") for i in range(100)])
    with pytest.raises(Exception, match="appended"):
        write_run(rows, path, "../x")
