"""Lists of sessions ranked in blocks of one pool against plain sums over its items."""

import math
import random

import pyarrow as pa

from harken.operators import fusion

DIR = "/root/testdata/sf0.001"
SAID = pa.schema([("session_id", pa.int64()), ("key", pa.string()), ("polarity", pa.string()), ("span", pa.string()), ("weight", pa.float64()), ("confidence", pa.float64())])
TOLD = pa.schema([("told_key", pa.string()), ("told_polarity", pa.string()), ("told_unsure", pa.bool_()), ("told_places", pa.list_(pa.int64())), ("told_gains", pa.list_(pa.float64())), ("told_names", pa.list_(pa.string()))])


def table(rows, schema):
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema)


def test_block_against_plain_sums():
    rng = random.Random(7)
    n, keys = 60, [(k, p) for k in "abc" for p in ("require", "avoid")]
    sure = {kp: {i: rng.choice([-2.0, 0.5, 1.5]) for i in range(n) if rng.random() < 0.3} for kp in keys}
    lifts = {kp: {i: rng.choice([0.1, 0.4]) * (1 if kp[1] == "require" else -1) for i in range(n) if rng.random() < 0.3} for kp in keys if kp[0] != "c"}  # nothing matches c
    said = []
    for s in range(40):
        said += [(s, k, p, None, rng.choice([0.5, 0.9]), 0.9) for k, p in keys if rng.random() < 0.3]
        for span in ("1 g", "2 g"):
            p = rng.choice(["require", "avoid"])
            said += [(s, k, p, f"{span} {p}", 0.63, rng.choice([0.2, 0.7])) for k in "abc" if rng.random() < 0.5]
    said += [(99, None, None, None, None, None)]
    told = [(k, p, u, list(g), list(g.values()), None) for u, of in ((False, sure), (True, lifts)) for (k, p), g in of.items()]
    told += [(None, None, None, list(range(n)), None, [f"P{i}" for i in range(n)])]
    got = {}
    for r in fusion.listed_block(table(said, SAID), table(told, TOLD), 10).to_pylist():
        got.setdefault(r["session_id"], []).append((r["rank"], r["parent_asin"], r["e"]))
    assert set(got) == {r[0] for r in said}
    for s, rows in got.items():
        e, spans = [0.0] * n, {}
        for _, k, p, span, w, c in (r for r in said if r[0] == s and r[1]):
            if span is None:
                e = [x + w * sure[k, p].get(i, 0.0) for i, x in enumerate(e)]
            elif (k, p) in lifts:
                spans.setdefault((span, p), []).append((c, lifts[k, p], w))
        for (_, p), meanings in spans.items():
            none = 1.0 if p == "avoid" else math.exp(-3.2)
            for i in range(n):
                lift = sum(c * g.get(i, 0.0) for c, g, _ in meanings) / sum(c for c, _, _ in meanings)
                e[i] += meanings[0][2] * (math.log(max(1e-12, none + lift)) - math.log(none))
        order = sorted(range(n), key=lambda i: (-round(e[i], 9), i))[:10]
        assert [(rank, name) for rank, name, _ in rows] == [(at, f"P{i}") for at, i in enumerate(order, 1)]
        assert all(abs(x - e[i]) < 2e-9 for (_, _, x), i in zip(rows, order, strict=True))


def test_no_row_of_a_session_and_an_item(spark, monkeypatch):
    """No table that is staged has more rows than sessions hold things, and neither do pools go to sessions."""
    from harken.plans import extended, queries

    staged = {}
    real = fusion.staged
    monkeypatch.setattr(fusion, "staged", lambda df, name: staged.setdefault(name, real(df, name)))
    n = extended.fused_lists(spark, DIR).count()
    sessions = staged["said"].select("session_id").distinct().count()
    assert n <= 10 * sessions and staged["said"].count() < 10 * sessions < queries._pool(spark, DIR).items.count() * sessions


def test_proposals_are_numbered_before_their_words_are_made(spark):
    """Words made of an order line are not shuffled with it."""
    from harken.sources import views

    plan = views.proposals(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "I would like" in plan.split("Window ")[0] and "I would like" not in plan.split("Window ")[1]


def test_messages_are_not_carried_once_proposals_are_validated(spark):
    from harken.plans import extended

    assert "message" not in extended._resolved(spark, DIR).columns
