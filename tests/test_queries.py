"""Every query against its SQL on an independent engine."""

import duckdb
import pytest

from harken.plans import extended, extended_oracle, oracle, queries

ORACLE, QUERIES = oracle.ORACLE | extended_oracle.ORACLE, queries.QUERIES | extended.QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem documents benchmark labels conversations events".split()


def rows(found):
    return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, name):
    want = db.sql(ORACLE[name])
    got = QUERIES[name](spark, DIR)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert rows(got.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_card_positions(spark):
    from pyspark.sql import functions as F

    from harken.operators.catalog import coarse_category
    from harken.operators.scoring import metrics

    got = spark.range(1).select(coarse_category(F.array(F.lit("Clothing, Shoes & Jewelry"))).alias("a"), coarse_category(F.lit(None).cast("array<string>")).alias("b")).first()
    assert (got.a, got.b) == ("Shoes & Jewelry", "clothing item")
    results = spark.createDataFrame([("s", True, 2, 0.5), ("s", False, None, 0.0)], "scenario_type string, hit boolean, first_hit_turn int, reciprocal_rank double")
    r = metrics(results).where("scenario_type = 'all'").first()
    assert (r.sample_count, r.hit_rate, r.mrr, r.mttc) == (2, 0.5, 0.25, 6.5)


def test_terms_and_tokens(spark):
    from pyspark.sql import functions as F

    from harken.functions.text import terms, tokens

    r = spark.range(1).select(terms(F.lit("100% Cotton cotton cotton XL fit")).alias("a"), tokens(F.lit("100% Cotton cotton cotton XL fit")).alias("b")).first()
    assert "100%" in r.a and "xl" in r.a and r.a.count("cotton") == 3
    assert "100%" not in r.b and "xl" not in r.b


def test_transcript_against_a_played_session(spark):
    """The closed form of the ten turns against playing them one by one."""
    from harken.operators.dialogue import transcripts

    cards = {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"], 4: ["a", "b", "c", "d"]}
    data, want = [], {}
    for i, (n, scenario, turn) in enumerate((n, s, t) for n in cards for s in ("buying", "browsing", "intent_override", "boundary") for t in (3, 4)):
        c = cards[n]
        hard, soft = c[:2], c[2:4] or c[:1]
        data.append((i, scenario, turn, "cat", hard, soft, hard + soft))
        known, said = [], []
        for t in range(1, 11):
            if t == 1:
                if scenario == "buying":
                    known.append(hard[0])
                    said.append(f"I'm looking for cat. A key requirement is: {hard[0]}.")
                else:
                    said.append(f"I'm looking for cat. {soft[-1]}" if scenario == "intent_override" else "I'm looking for cat, but I'm still exploring.")
            elif scenario == "intent_override" and t == turn:
                known.append(hard[0])
                said.append(f"Actually, ignore my earlier preference. What I need is: {hard[0]}.")
            elif scenario == "boundary" and t == 2:
                said.append("I don't have a preference for other; please use your judgment.")
            else:
                open_ = [v for v in hard + soft if v not in known][:2]
                known += open_
                said.append("For that, what matters is: " + "; ".join(open_) + "." if open_ else "I don't have an additional preference for other.")
        want[i] = said
    df = spark.createDataFrame(data, "sample_id long, scenario_type string, override_turn int, category string, hard array<string>, soft array<string>, card array<string>")
    got = {}
    for r in transcripts(df).orderBy("sample_id", "turn").collect():
        got.setdefault(r.sample_id, []).append(r.message)
    assert got == want


def test_jsonl_round_trip(spark, tmp_path):
    from harken.sources.views import CATALOG, append_registry, read_jsonl, write_jsonl

    (tmp_path / "in.jsonl").write_text('{"parent_asin": "A", "details": {"Zeta": "1", "Alpha": 2}, "price": 9.5}\n\n{"title": "no id"}\n')
    rows = read_jsonl(spark, f"file://{tmp_path}/in.jsonl", CATALOG)
    got = rows.selectExpr("parent_asin", "transform(map_entries(details), e -> e.key || e.value) as d", "price").collect()
    assert [(r.parent_asin, r.d, r.price) for r in got] == [("A", ["Zeta1", "Alpha2"], "9.5")]
    write_jsonl(rows, f"file://{tmp_path}/out")
    append_registry(rows, f"file://{tmp_path}/out")
    assert read_jsonl(spark, f"file://{tmp_path}/out", CATALOG).count() == 2


def test_bm25_scores_every_match(spark):
    """Twelve documents match the query: all have a score, and only the report stops at ten."""
    from harken.operators import evidence as ev

    docs = spark.createDataFrame([(i, "cotton shirt" + " filler" * i) for i in range(12)] + [(12, "leather boots")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cotton")], "query_id long, text string")
    got = ev.bm25(docs, asked).collect()
    assert sorted(r.doc_id for r in got) == list(range(12)) and all(0 < r.strength <= 1 for r in got)
    assert ev.bm25_top(docs, asked).count() == 10


def test_bootstrap_of_the_score(spark):
    """The interval of the score against resampling sessions one by one."""
    import random

    from harken.operators.experiments import bootstrap_score

    rng = random.Random(2)
    data = [(True, t, 1.0 / rng.randint(1, 10)) if (t := rng.randint(1, 14)) <= 10 else (False, None, 0.0) for _ in range(60)]
    low, high = bootstrap_score(spark.createDataFrame(data, "hit boolean, first_hit_turn int, reciprocal_rank double"))
    scores = []
    for _ in range(1000):
        pick = [rng.choice(data) for _ in data]
        hit, mrr, mttc = (sum(x) / len(data) for x in zip(*((h, r, 11 if t is None else t) for h, t, r in pick), strict=True))
        scores.append(0.5 * hit + 0.3 * mrr + 0.2 * max(0.0, min(1.0, (11 - mttc) / 10)))
    scores.sort()
    assert abs(low - scores[25]) < 0.02 and abs(high - scores[975]) < 0.02
    assert bootstrap_score(spark.createDataFrame([(True, 1, 0.5)], "hit boolean, first_hit_turn int, reciprocal_rank double")) == (0.85, 0.85)
