"""HTML extraction by held-out accuracy on generated pages, on the tables' articles, and on odd markup."""

import random
import re

import pytest
from brookline.llm import html_extract as hx
from brookline.llm.html_tree import blocks, read

from .hand_pages import PAGES


def all_text(html):
    nodes = read(html)
    return blocks(nodes, [True] * len(nodes))


def test_held_out_pages():
    r, exact = random.Random(4321), 0
    for _ in range(100):
        page = hx.training_page(r)
        nodes = read(page)
        want = blocks(nodes, ["keep" in x.tokens for x in nodes])
        exact += hx.extract([page.replace(' data-component="keep"', "")], hx.model())[0] == want
    assert exact >= 95


def test_pages_written_by_hand():
    got = hx.extract([html for _, html, _ in PAGES], hx.model())
    assert {name: text for (name, _, _), text in zip(PAGES, got, strict=True)} == {name: want for name, _, want in PAGES}


def test_hidden_elements_have_no_text():
    for attribute in ("hidden", "hidden=''", 'class="x" hidden', 'aria-hidden="true"', "style='color: red; display:none'"):
        assert all_text(f"<div>a<p {attribute}>b<b>c</b></p>f <i {attribute}>e</i>g</div>") == "a\n\nf g"
    assert all_text('<p class="hidden-gem">a</p><p data-hidden="1">b</p>') == "a\n\nb"


def test_articles_of_the_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in hx.extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for p in rows:
        assert got[p.page_id].text == all_text(re.search(r"<article>(.*?)</article>", p.html, re.S)[1])
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_decoding_never_keeps_below_a_dropped_node():
    r = random.Random(1)
    for _ in range(50):
        nodes = read(hx.training_page(r))
        kept = hx.decode(nodes, hx.np.array([r.gauss(0, 3) for _ in nodes]))
        place = {id(x): i for i, x in enumerate(nodes)}
        assert all(kept[place[id(x.parent)]] for x, k in zip(nodes, kept, strict=True) if k and x.parent)


def test_decoding_is_the_best_labelling():
    import itertools

    nodes = read("<div><p>a</p><ul><li>b</li><li>c</li></ul></div><p>d</p>")
    logit = hx.np.array([1.0, -0.6, 0.9, -2.0, 1.5, 1.2, -0.1])
    place = {id(x): i for i, x in enumerate(nodes)}

    def value(lab):
        return sum(-hx.np.log1p(hx.np.exp(-z if k else z)) for z, k in zip(logit, lab, strict=True))

    legal = [lab for lab in itertools.product([True, False], repeat=len(nodes)) if lab[0] and all(lab[place[id(x.parent)]] for x, k in zip(nodes, lab, strict=True) if k and x.parent)]
    assert value(hx.decode(nodes, logit)) == pytest.approx(max(map(value, legal)))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a &amp; b &#233;&nbsp;&lt;c&gt;<p>two<br>lines", "a & b é <c>\n\ntwo lines"),
        ("<script>var t='<p>no</p>';</script><style>p{}</style>x<!-- <p>no</p> -->y", "xy"),
        ("<ul><li>one<li>two</ul>tail", "one\n\ntwo\n\ntail"),
        ("a < b and <b>c</i></b> d</p>e", "a < b and c d\n\ne"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
        ("<div", ""),
        ("<p title='a>b'>x</p><textarea><p>no</textarea><select><option>no</select>z", "x\n\nz"),
        ("<a href=x>in <b>line</b></a> text <!-- open", "in line text"),
        ("<p>The <label>name</label> is <output>42</output> of <map>all</map> <meter>5</meter></p>", "The name is 42 of all 5"),
    ],
)
def test_markup(html, want):
    assert all_text(html) == want


def test_odd_rows(spark):
    long = "<html><body><article>" + "<p>Some words, in a row, to be kept here.</p>" * 5000 + "</article></body></html>"
    deep = "<div>" * 2000 + "x" + "</div>" * 2000
    rows = [(1, "u", None, 3), (2, None, "", 3), (None, "u", "<p>Hi</p>", 3), (4, "u", long, 3), (4, "u", long, 3), (5, "u", deep, 3)]
    got = hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got) and all(r.text == "" for r in got if r.page_id in (1, 2))
    assert [r.text.count("kept") for r in got if r.page_id == 4] == [5000, 5000]
    assert hx.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_bare_pages_and_unclosed_quotes():
    bare = "<body><div><div><p>A plain page, without names; one paragraph of text.</p><p>And another paragraph of it.</p></div></div></body>"
    broken = '<article><p>Broken <a href="x>link</a> text and more after it.</p><p>And the rest of it, in words.</p></article>'
    assert hx.extract([bare, broken], hx.model()) == [
        "A plain page, without names; one paragraph of text.\n\nAnd another paragraph of it.",
        "Broken link text and more after it.\n\nAnd the rest of it, in words.",
    ]


def test_paragraphs_as_divs_and_headers_within_articles():
    first, second = "First long paragraph of the page, which says a good deal about rivers and their banks.", "Second long paragraph, which is also the main text, and goes on about the hills beyond them."
    divs = f'<body><div id="c1"><div>{first}</div><div>{second}</div></div>{{}}</body>'
    framed = f"<article><header><h1>Rivers</h1><p>By A. Author</p></header><p>{first}</p><p>{second}</p><footer>Tags: a, b</footer></article>"
    want = first + "\n\n" + second
    assert hx.extract([divs.format(""), divs.format("<footer>All rights reserved</footer>"), framed], hx.model()) == [want] * 3


def test_an_advert_among_many_paragraphs_goes():
    paragraphs = "".join(f"<p>Paragraph {i} tells of the river, the hills, and all who live there.</p>" for i in range(200))
    advert = '<aside class="advert"><p>Buy now, cheap.</p></aside>'
    for n in (20, 64, 65, 200):
        cut = paragraphs.split("</p>")[:n]
        html = "<body><article>" + "</p>".join(cut[: n // 2]) + "</p>" + advert + "</p>".join(cut[n // 2 :]) + "</p></article></body>"
        text = hx.extract([html], hx.model())[0]
        assert "Buy now" not in text and text.count("tells of the river") == n
