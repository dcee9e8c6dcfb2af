"""Pages whose parts mislead, texts that are repeated thousands of times, and hosts that their labels condemn."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from harken.llm import decontam, htmltext, queries, sharding

WORDS = "stone river market winter garden letter captain morning window forest silver question harbour evening music winter paper".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(r):
    """A page without an article element, and its text: a form around everything, a titled header in a post, paragraphs of links, references."""
    body = [sentence(r, r.randrange(12, 40)) for _ in range(r.randrange(3, 9))]
    html = [f"<p>{x}</p>" for x in body]
    text = list(body)
    if r.random() < 0.5:  # a paragraph that is nearly all links
        at = r.randrange(1, len(html))
        a, b = sentence(r, 5)[:-1], sentence(r, 6)[:-1]
        html.insert(at, f"<p><a href='/x'>{a}</a> and <a href='/y'>{b}</a>.</p>")
        text.insert(at, f"{a} and {b}.")
    refs = r.random() < 0.5
    if refs:
        items = [sentence(r, 6)[:-1] for _ in range(r.randrange(2, 6))]
        html.append("<h2>References</h2><ol>" + "".join(f"<li><a href='/r{i}'>{x}</a></li>" for i, x in enumerate(items)) + "</ol>")
        text += ["References", *items]
    title, lead = sentence(r, 4)[:-1], sentence(r, 9)
    head = r.random() < 0.5
    if head:
        tag = r.choice(["div class='header'", "header"])
        html.insert(0, f"<{tag}><h1>{title}</h1><p>{lead}</p></{tag.split()[0]}>")
        text[:0] = [title, lead]
    inner = "".join(html)
    inner = f"<div class='{'post' if head else r.choice(['text', 'post', 'content'])}'>{inner}</div>"
    menu = "<ul class='menu'>" + "".join(f"<li><a href='/m{i}'>{w}</a></li>" for i, w in enumerate(WORDS[:6])) + "</ul>"
    foot = "<div class='footer'><a href='/a'>Imprint</a> <a href='/b'>Privacy</a> All rights reserved</div>"
    whole = f"<div class='site-header'><a href='/'>Home</a></div>{menu}{inner}{foot}"
    if r.random() < 0.4:
        whole = f"<form action='/' method='post'><input type='hidden' name='state' value='x'>{whole}</form>"
    return f"<html><body>{whole}</body></html>", "\n".join(text)


def test_misleading_layouts(spark):
    r = random.Random(8)
    pages = [page(r) for _ in range(300)]
    rows = spark.createDataFrame([(i, "http://x/", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in htmltext.extract(rows).collect()}
    wrong = [i for i, (_, text) in enumerate(pages) if got[i] != text]
    assert not wrong, (len(wrong), pages[wrong[0]], got[wrong[0]])


def test_four_layouts():
    long = " ".join(f"Sentence {i} of the article has some words, and a few more." for i in range(14))
    intro = "Some introduction text of thirty five characters."
    assert htmltext.main_text(f"<body><p>{intro}</p><form><p>{long}</p></form></body>") == f"{intro}\n{long}"
    assert htmltext.main_text(f"<body><div class='post'><div class='header'><h1>Title</h1><p>Lead</p></div><p>{long}</p></div></body>") == f"Title\nLead\n{long}"
    links = "<p><a href='/a'>See this link in text</a> and <a href='/b'>that other one</a>.</p>"
    assert htmltext.main_text(f"<body><div><p>{long}</p>{links}<p>{long}</p></div></body>") == f"{long}\nSee this link in text and that other one.\n{long}"
    refs = "<ul><li><a href='/a'>First work</a></li><li><a href='/b'>Second work</a></li></ul>"
    assert htmltext.main_text(f"<body><div><p>{long}</p>{refs}</div></body>") == f"{long}\nFirst work\nSecond work"
    # what looks alike and is no text: a form for comments, a menu before the text, links of the page after it
    form = f"<form class='comment-form'><p>{long} {long}</p></form>"
    assert htmltext.main_text(f"<body><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul><div><p>{long}</p></div>{form}{refs}</body>") == long


def test_decontamination_of_a_text_with_thousands_of_copies(spark):
    item = " ".join(WORDS[:12])
    leak, clean = f"before it {item} and after it", "nothing of the kind is said in here at all today"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, clean).otherwise(leak).alias("text"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for broadcast in (0, decontam.BROADCAST):
        rows = decontam.decontaminate(docs, bench, broadcast=broadcast).collect()
        assert len(rows) == 3000
        want = {t: brute.contamination(t, [(1, item)]) for t in (leak, clean)}
        assert all((r.contaminated, r.n_words) == (want[r.text][-1], want[r.text][0]) for r in rows)


@pytest.mark.parametrize("run", [7, 100_000])
def test_sharding_of_one_row_that_is_repeated_often(spark, run, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", run)
    docs = spark.range(1000).select(F.when(F.col("id") < 990, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shard(docs).collect()
    assert sorted(r.row_number for r in rows) == list(range(1000))
    assert sorted((r.shard, r.slot) for r in rows) == sorted((p % 8, p // 8) for p in range(1000))


def test_url_filter_decides_where_labels_do(spark, tmp_path):
    """The query itself, on hosts of which one is bad throughout, one good and one unknown."""
    pages = [(i, f"https://{h}/p{i}") for i, h in enumerate(["bad.example.org"] * 60 + ["good.example.info"] * 60 + ["other.example.info"] * 3 + ["www.bad.example.net"] * 2)]
    spark.createDataFrame([(i, u, "") for i, u in pages], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(i, int("good" in u), 0) for i, u in pages if i < 120]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.host: (r.rule, r.verdict) for r in queries.QUERIES["op10_url_filter"](spark, str(tmp_path)).collect()}
    assert got["bad.example.org"] == (None, "block") and got["good.example.info"] == (None, "allow") and got["other.example.info"] == (None, "allow") and got["www.bad.example.net"] == ("net/", "block")
