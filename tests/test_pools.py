"""Pools that are made once for all openers that share them, and blocks of conversations ranked against plain sums."""

import random

import numpy as np
import pyarrow as pa

from harken.operators import belief as bf
from harken.plans import queries as q

DIR = "/root/testdata/sf0.001"


def test_openers_share_pools(spark):
    """A pool is a table's rows once, not once for each opener; spelled out it is the report's."""
    pools = q._pool(spark, DIR)
    assert pools.of.select("pool").distinct().count() < pools.of.count()
    assert pools.items.count() < q.category_pool(spark, DIR).count()
    assert sorted(map(tuple, pools.each().collect())) == sorted((r.opener, r.parent_asin, r.pool_pos) for r in q.category_pool(spark, DIR).collect())


def test_block_against_plain_sums():
    rng = random.Random(3)
    n, keys = 130, ["a", "b", "c"]
    names = [f"P{i}" for i in range(n)]
    gains = {k: {i: rng.choice([0.5, 1.0, 2.5]) for i in range(n) if rng.random() < 0.4} for k in keys}
    held = {f"s{j}": {k: [rng.choice([0.0, 0.9, 1.0]) for _ in range(10)] for k in keys if rng.random() < 0.7} for j in range(20)} | {"empty": {}}
    said = [(s, k, False, w, None) for s, ks in held.items() for k, w in ks.items()] + [(s, None, None, None, None) for s in held]
    told = [(False, k, list(g), list(g.values()), None) for k, g in gains.items()] + [(None, None, list(range(n)), None, names)]
    types = [pa.string(), pa.string(), pa.bool_(), pa.list_(pa.float64()), pa.float64()], [pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.string())]
    heads = (["sample_id", "key", "lexical", "weights", "idf"], ["told_lexical", "told_key", "told_places", "told_gains", "told_names"])
    table = lambda rows, at: pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[at], strict=True)], heads[at])
    got = bf.ranked_block(table(said, 0), table(told, 1), 0.0).to_pylist()
    assert {r["sample_id"] for r in got} == set(held)
    for r in got:
        for t in range(10):
            e = [sum(w[t] * gains[k].get(i, 0.0) for k, w in held[r["sample_id"]].items()) for i in range(n)]
            want = sorted(range(n), key=lambda i: (-round(e[i], 9), i))[: 10 * (t + 1)]
            assert [r["items"][i] for i in r["heads"][t]] == [names[i] for i in want]


def test_lists_leave_out_what_was_proven_wrong():
    order = [list(range(min(10 * t, 12))) for t in range(1, 11)]
    lists = list(bf.shown(order, 12, [10, 3, 0, *[10] * 7], [False] * 9 + [True], [True, False, True, *[True] * 7]))
    assert [x for x, _ in lists[:3]] == [list(range(10)), [10, 11], []]
    assert lists[3][0] == [10, 11] and lists[4][0] == list(range(10))  # what leaves nothing is not left out
    assert np.array_equal(lists[9][1], list(range(10)))


def test_sessions_are_counted_before_turns_are_spread(spark):
    """No join or window comes after rows are spread over turns, so that only sums are shuffled from there."""
    from harken.plans import extended

    for query, spread in ((extended.slot_ages, 1), (extended.override_modes, 3)):
        plan = query(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
        after = [part for part in plan.split("Aggregate [at_turn")[1:]] or [part for part in plan.split("Aggregate [attribute")[1:]]
        assert len(after) >= spread and all("Join" not in part.split("Generate explode(sequence")[0] for part in after[:spread])
