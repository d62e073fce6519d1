from __future__ import annotations

import html
import random
import re
import time

import numpy as np
import pytest

from basketlens.llm import extraction as x
from basketlens.llm.dom import features, nodes_of, parse

PAGES = "page_id long, url string, html string, text string, n_chars int"


@pytest.fixture(scope="module")
def forest(spark):
    return x.fit(spark)


def made(spark, *pages):
    return spark.createDataFrame([(i, f"u{i}", p, "t", 1) for i, p in enumerate(pages)], PAGES)


def expected(page):
    """Article of the test pages by their own layout: headline and paragraphs between the article tags."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", inside)
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "\n", b))).strip() for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_articles_of_the_pages(spark, forest):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in x.extract(pages, forest=forest).collect()}
    rows = pages.collect()
    right = [got[r.page_id].text == expected(r.html) for r in rows]
    assert np.mean(right) == 1.0
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_other_layouts(spark, forest):
    """Made pages of another seed: most words of the article, few of the rest."""
    rng = random.Random(99)
    kept = left = kept_all = left_all = 0
    pages = [x.training_page(rng) for _ in range(60)]
    marked = [re.sub("[\x01\x02]", "", p) for p in pages]
    for page, text in zip(pages, (r.text for r in sorted(x.extract(made(spark, *marked), forest=forest).collect()))):
        blocks = text.split("\n\n")
        for node in nodes_of(parse(page)):
            if node.tag == "#text":
                plain = re.sub("[\x01\x02]", "", node.text).strip()
                hit = plain in blocks
                if x.KEPT in node.text:
                    kept += hit * len(plain)
                    kept_all += len(plain)
                else:
                    left += hit * len(plain)
                    left_all += len(plain)
    assert kept / kept_all > 0.93 and left / left_all < 0.07


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(0)
    for _ in range(60):
        nodes = nodes_of(parse("<div><p>a</p><div><p>b</p>c</div></div><p>d</p>"))
        features(nodes)
        p = rng.random(len(nodes))
        score = lambda labels: sum(np.log(q if k else 1 - q) for k, q in zip(labels, p))
        best = -np.inf
        for code in range(1 << (len(nodes) - 1)):
            labels = [True, *((code >> i) & 1 == 1 for i in range(len(nodes) - 1))]
            if all(labels[n.parent.at] or not k for n, k in zip(nodes[1:], labels[1:])):
                best = max(best, score(labels))
        got = x.decoded(nodes, p)
        assert all(got[n.parent.at] or not k for n, k in zip(nodes[1:], got[1:]))
        assert score(got) == pytest.approx(best)


def test_odd_pages(spark, forest):
    deep = "<div>" * 3000 + "<p>" + "Some words of a story. " * 30 + "</p>"
    pages = [None, "", "no markup at all, only some words.", "<<<>>> <p", "<!-- open", "<script>var x = '</p>'", deep,
             "<p>&lt;b&gt; &amp; &eacute;&#233; &nosuch; x</p>" * 20]
    df = made(spark, *pages).union(made(spark, "<p>x</p>")).union(
        spark.createDataFrame([(None, None, None, None, None)], PAGES)
    )
    got = x.extract(df, forest=forest).collect()
    assert len(got) == len(pages) + 2
    by_id = {r.page_id: r for r in got if r.page_id}
    assert by_id[1].text == "" and by_id[5].text == "" and by_id[4].text == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert x.extract(made(spark).where("false"), forest=forest).collect() == [] if pages else True


def test_blocks_spaces_and_references():
    leaves = [n.text for n in nodes_of(parse("<p><b>one&nbsp; two<br>three<p>four\n\n five</p><ul><li>a<li>b</ul>tail &amp; end"))]
    assert [t for t in leaves if t] == ["one two three", "four five", "a", "b", "tail & end"]


def test_every_article_of_larger_tables_is_whole(spark, forest):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r.text for r in x.extract(pages, forest=forest).collect()}
    wrong = [r.page_id for r in pages.collect() if got[r.page_id] != expected(r.html)]
    assert len(got) == 2500 and wrong == []


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<", "<!", "<!--", "<div>", "<svg>", "<object>", "<button>", "</p>", "<ul><li>", "<td>", "<h1><p>", "<script>"])
def test_a_megabyte_of_broken_markup_is_read_once(piece):
    page = "<p>start</p>" + piece * (1_000_000 // len(piece))
    began = time.process_time()
    nodes = nodes_of(parse(page))
    assert time.process_time() - began < 2 and any(n.text.startswith("start") for n in nodes)


def test_broken_tags():
    def texts(page):
        return [n.text for n in nodes_of(parse(page)) if n.text]

    assert texts("<p>a</p><p title='x>y'>b</p>") == ["a", "b"]
    assert texts("<p>a<p title='x>b</p>c") == ["a", "b", "c"]  # the quote never ends
    assert texts("<p>a</p> 1 < 2 <b") == ["a", "1 < 2 <b"]
    assert texts("<p>a<object>b</p>c") == ["ab", "c"]
    assert texts("<p>a<object>b</object>c</p>") == ["ac"]
    assert texts("<p>a<!x><?y>b<!-- > -->c") == ["abc"]
