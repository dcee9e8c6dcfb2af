"""The weighted-field search: blocks of items against plain sums, and what leaves them."""

import random

import pyarrow as pa

from harken.operators import baseline
from harken.operators import evidence as ev

DIR = "/root/testdata/sf0.001"


def test_block_against_plain_sums():
    """Scores that are equal, or that only rounding makes equal, are ranked by place; few and many hits alike."""
    rng = random.Random(5)
    n, terms = 300, [f"t{i}" for i in range(8)]
    part = {t: {i: rng.choice([0.5, 0.5 + 2e-10, 1.25]) for i in rng.sample(range(n), 12 if at % 2 else 200)} for at, t in enumerate(terms)}
    rows = [(t, f"P{i}", i, x) for t, xs in part.items() for i, x in xs.items()]
    rng.shuffle(rows)
    bags = [rng.sample(terms, rng.randint(1, 4)) for _ in range(40)] + [["t1"], ["unknown"]]
    parts = pa.table(dict(zip(["term", "parent_asin", "cat_pos", "part"], zip(*rows, strict=True), strict=True)))
    got = baseline.best_of_block(pa.table({"bag": [str(i) for i in range(len(bags))], "terms": bags}), parts, 10).to_pylist()
    assert len(got) < 60 * len(bags)
    for at, bag in enumerate(bags):
        score = {}
        for t in bag:
            for i, x in part.get(t, {}).items():
                score[i] = score.get(i, 0.0) + x
        want = sorted(score, key=lambda i: (-round(score[i], 9), i))[:10]
        mine = {r["cat_pos"]: r for r in got if r["bag"] == str(at)}
        assert sorted(mine, key=lambda i: (-round(mine[i]["score"], 9), i))[:10] == want
        assert all(mine[i]["parent_asin"] == f"P{i}" and mine[i]["score"] == score[i] for i in want)


def test_equal_items_do_not_leave_their_block():
    """However many items have one score, only the first by place are candidates."""
    parts = pa.table({"term": ["a"] * 5000, "parent_asin": [f"P{i}" for i in range(5000)], "cat_pos": list(range(5000)), "part": [1.0] * 5000})
    got = baseline.best_of_block(pa.table({"bag": ["a"], "terms": [["a"]]}), parts, 10)
    assert got["cat_pos"].to_pylist() == list(range(10))


def test_many_blocks_find_what_one_finds(spark, monkeypatch):
    from harken.plans import extended

    one = sorted(map(tuple, extended.field_search(spark, DIR).collect()))
    monkeypatch.setattr(baseline, "ITEMS", 30)
    monkeypatch.setattr(baseline, "BAGS", 40)
    assert sorted(map(tuple, extended.field_search(spark, DIR).collect())) == one


def test_documents_in_blocks(spark, monkeypatch):
    """Strengths of one block are those of many, strengths cut at 1 tie by doc_id, and the report takes no row of a document and a term through a shuffle by term."""
    from harken.plans import queries

    one = [sorted(map(tuple, q(spark, DIR).collect())) for q in (queries.bm25_scores, queries.bm25_all_scores)]
    monkeypatch.setattr(ev, "DOCS", 100)
    monkeypatch.setattr(ev, "QUERIES", 15)
    assert [sorted(map(tuple, q(spark, DIR).collect())) for q in (queries.bm25_scores, queries.bm25_all_scores)] == one
    docs = spark.createDataFrame([(i, "cotton " * (2 + i % 3)) for i in range(40)] + [(i, "boots") for i in range(40, 400)] + [(400, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cotton"), (2, "unknown"), (3, None)], "query_id long, text string")
    assert [(r.query_id, r.rank, r.doc_id, r.strength) for r in ev.bm25_top(docs, asked).orderBy("rank").collect()] == [(1, i + 1, i, 1.0) for i in range(10)]


def test_no_row_of_a_document_and_a_query_is_shuffled(spark):
    from harken.plans import queries

    plan = queries.bm25_all_scores(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and plan.index("FlatMapCoGroupsInArrow") < plan.index("Exchange")
