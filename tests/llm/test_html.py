from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm import html_template
from tabloom.llm.html_blocks import read

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


@pytest.fixture
def make_pages(spark):
    return lambda rows: spark.createDataFrame(rows, PAGES)


def kept(html):
    return html_template.main_blocks(html)[0]


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("", []),
        ("just words", ["just words"]),
        ("<p>a &amp;amp; b&nbsp; c\n d<br>e</p>", ["a &amp; b c d e"]),
        ("<p><b>One<br><p>Two <i>th</i>ree<p>Four", ["One", "Two three", "Four"]),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", ["x", "y", "1", "2", "3"]),
        ("<script>var t='</p><p>no';</script><style>p{}</style>yes<!-- <p>no</p> --><noscript>no</noscript>", ["yes"]),
        ("<nav>n</nav><header>h</header><article><header><h1>T</h1></header><p>a</p><footer>f</footer></article><aside>s</aside><p>out</p>", ["T", "a"]),
        ("<main><p>a</p><div class='ad-slot'>x</div><div id='cookie_notice'>y</div><div class=comments><p>z</p></div><form>q</form><p>b</p></main>", ["a", "b"]),
        ("<body class='has-sidebar'><div class='no-sidebar'><p>a</p></div><div role=navigation>n</div><div hidden>h</div><div style='display: none'>d</div></body>", ["a"]),
        ("<div><a href=x>menu</a> <a href=y>more</a></div><div>text with <a href=z>a link</a></div>", ["text with a link"]),
        ("<article><p>a</p></article><article class='comment'><p>b</p></article>", ["a"]),
        ('<p title="a > b">x</p><p title="open>y</p>', ["x", "y"]),
        ("<title>t</title><textarea><p>no</textarea>a</div></p>b", ["a", "b"]),
        ("<p>a<", ["a<"]),
        ("a < b && c > d", ["a < b && c > d"]),
    ],
)
def test_blocks(html, blocks):
    assert kept(html) == blocks


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("<article class='post tag-search category-promotion'><p>a</p></article>", ["a"]),
        ("<article class='promo-story'><p>a</p></article>", ["a"]),
        ("<div class='content-with-sidebar'><article><p>a</p></article></div>", ["a"]),
        ("<div class='content-with-sidebar'><p>a</p></div>", ["a"]),
        ("<div class='discussion'><article><p>a</p><div class=ad>x</div></article></div><p>out</p>", ["a"]),
        ("<div id='sidebar-layout'><main><p>a</p></main><p>s</p></div>", ["a"]),
        ("<article><p>a</p></article><div class=related><article><p>b</p></article></div>", ["a"]),
        ("<article><p>a</p></article><section id=comments><article class=comment-body><p>b</p></article></section>", ["a"]),
        ("<div class='left-sidebar'>x</div><div class='post-comments'>y</div><p>a</p>", ["a"]),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>", ["let x=1 be"]),
        ("<p>a</p><object data=x><p>b</p><video src=y><p>c</p><svg><p>d", ["a", "b", "c", "d"]),
        ("<p>a</p><video>no</video><p>b</p><style>p{}<p>c", ["a", "b"]),
    ],
)
def test_words_and_raw_elements_leave_the_article(html, blocks):
    assert kept(html) == blocks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a'>", "</div>", "<b>", "text ", "&lt;", "<li", "<!--", "-->", '"', "'", "<script>", "</script>", "<br/>", ">", "é"]), max_size=25))
def test_any_markup_is_read(parts):
    blocks, tags = read("".join(parts))
    assert all(b.text == " ".join(b.text.split()) and b.text for b in blocks)


def test_very_long_and_deep_pages_are_read():
    assert len(kept("<p>" + "word " * 200_000)[0]) == 999_999
    assert kept("<div>" * 3000 + "x") == ["x"]
    assert kept("<p>" + "\"'" * 20_000) == ["\"'" * 20_000]


def page(i, body, host="www.a.example"):
    frame = f"<html><body><div class='top'>Site name</div><div class='c1'>Latest from us</div><div class='x7'>{body}</div><div class='c2'>All rights {{}} kept</div></body></html>"
    return (i, f"https://{host}/p/{i}", frame.replace("{}", "are"))


def test_template_blocks_of_a_host_go(make_pages):
    bodies = [f"<p>Story {i} begins.</p><p>It goes on {i * 7}.</p>" + "<p>Shared words.</p>" * (i % 2) for i in range(8)]
    rows = [page(i, b) for i, b in enumerate(bodies)]
    rows += [page(100 + i, b, "few.example") for i, b in enumerate(bodies[:3])]
    found = {r.page_id: r for r in html_template.extract_text(make_pages(rows)).collect()}
    for i in range(8):
        expected = [f"Story {i} begins.", f"It goes on {i * 7}.", *["Shared words."] * (i % 2)]
        got = found[i].text.split("\n\n")
        assert [b for b in got if b != "Shared words."] == expected[:2]
        assert found[i].n_chars == len(found[i].text) and found[i].template_blocks >= 3
        assert i > 2 or found[100 + i].text.split("\n\n") == expected


LONG = "A sentence of the story, as long as stories are, goes on. "


def test_slots_tell_menus_adverts_and_articles_without_any_mark(make_pages):
    def one(i):
        menu = "".join(f"<a href=/{j}>topic {j * i}</a> " for j in range(9))
        item = "".join(f"<li><a href=/x{j}>Read story {i * j} of many</a></li>" for j in range(i % 4))
        return (
            f"<div class=k1>{menu}</div><div class=k2>Buy number {i} today only.</div><div class=k3><h1>Title {i}</h1>{f'<p>{LONG * (1 + i % 3)}{i}</p>' * 3}"
            f"<ul>{item}</ul></div><div class=k4>Contact us, all rights are kept.</div>"
        )

    rows = [(i, f"https://u.example/{i}", one(i)) for i in range(5)]
    for r in html_template.extract_text(make_pages(rows)).collect():
        paragraph = " ".join((LONG * (1 + r.page_id % 3) + str(r.page_id)).split())
        assert r.text.split("\n\n") == [f"Title {r.page_id}", *[paragraph] * 3]
        assert r.template_blocks == 3 + r.page_id % 4 and r.markup_blocks == 0


def test_two_pages_make_a_template(make_pages):
    rows = [(i, "https://two.example/", f"<div class=a>Name of the site</div><div class=b><p>Own words {i}.</p></div>") for i in range(2)]
    assert sorted(r.text for r in html_template.extract_text(make_pages(rows)).collect()) == ["Own words 0.", "Own words 1."]


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("<div class='promo-story'><p>The story.</p></div>", ["The story."]),
        ("<div id='market-share'><p>Shares fell.</p></div>", ["Shares fell."]),
        (f"<div class=x1><a href=a>Home</a> <a href=b>More</a></div><div class=x2><p>{LONG * 4}</p></div><div class=x3>All rights kept.</div>", [" ".join((LONG * 4).split())]),
        (f"<div class=x1><p>{LONG}</p></div><div class=x2><p>{LONG * 4}</p></div>", [" ".join(LONG.split()), " ".join((LONG * 4).split())]),
        (f"<div class=body><p>{LONG}</p><div class=comments><p>first!</p></div></div>", [" ".join(LONG.split())]),
    ],
)
def test_single_pages_are_read_by_their_own_slots(html, blocks):
    assert kept(html) == blocks


def test_a_page_unlike_its_host_is_read_by_itself(make_pages):
    rows = [page(i, f"<p>Story {i} begins.</p>") for i in range(8)] + [(99, "https://www.a.example/x", "<section><p>Only here.</p></section>")]
    found = {r.page_id: r.text for r in html_template.extract_text(make_pages(rows)).collect()}
    assert found[99] == "Only here." and found[3] == "Story 3 begins."


def brute_classes(pages):
    """Tokens by their counts on every page, for tokens on half of the pages, where a class has a tag."""
    counts = []
    for html in pages:
        blocks, tags = read(html)
        counts.append(Counter([0, *[t.path for t in tags], *[html_template._text_token(b) for b in blocks]]))
    vectors = {}
    texts = {html_template._text_token(b) for html in pages for b in read(html)[0]}
    for token in set().union(*counts):
        vector = tuple(c[token] for c in counts)
        if 2 * sum(n > 0 for n in vector) >= len(pages):
            vectors.setdefault(vector, set()).add(token)
    return {frozenset(c) for c in vectors.values() if c - texts}


def test_classes_equal_explicit_occurrence_vectors(make_pages):
    import random

    rnd = random.Random(6)
    parts = ["<p>a</p>", "<p>b</p>", "<div class=q><i>t</i></div>", "<ul><li>x<li>y</ul>", "<h2>h</h2>", "<hr>", "<div class=r><p>a</p></div>"]
    for host in range(4):
        pages = [f"<main>{''.join(rnd.choice(parts) for _ in range(rnd.randrange(1, 7)))}</main><p>{i} own</p><b>site</b>" + f"<article>{i}</article>" for i in range(rnd.randrange(1, 9))]
        rows = [(i, f"https://c{host}.example/", h) for i, h in enumerate(pages)]
        classes = {}
        for t in html_template.templates(make_pages(rows)).collect():
            classes.setdefault((t.support, t.vector), set()).add(t.token)
        assert {frozenset(c) for c in classes.values()} == brute_classes(pages)


def test_copies_of_one_page_are_not_a_template(make_pages):
    rows = [(i, f"https://b.example/{i}", "<article><p>The whole story.</p></article>") for i in range(9)]
    assert {r.text for r in html_template.extract_text(make_pages(rows)).collect()} == {"The whole story."}


def test_near_copies_within_a_host_keep_their_article(make_pages):
    rows = [page(i, f"<article><p>Common paragraph one.</p><p>Common two.</p><p>Own {i}.</p></article>") for i in range(6)]
    rows += [page(10 + i, f"<article><p>Another {i} story.</p></article>") for i in range(4)]
    found = {r.page_id: r.text for r in html_template.extract_text(make_pages(rows)).collect()}
    assert found[2] == "Common paragraph one.\n\nCommon two.\n\nOwn 2." and found[11] == "Another 1 story."


def test_near_copies_that_fill_a_host_keep_their_article(make_pages):
    story = "<article><p>The whole story.</p><p>Its end.</p></article>"
    rows = [(i, f"https://n.example/{i}", f"<title>{i}</title><nav>menu {i}</nav><div class=ad>advert {i}</div>{story}") for i in range(6)]
    plain = "<div><p>Plain story.</p><p>Its end.</p></div>"
    rows += [(10 + i, f"https://p.example/{i}", f"<title>{i}</title><nav>menu {i}</nav><div class=ad>advert {i}</div>{plain}") for i in range(6)]
    found = {r.page_id: r.text for r in html_template.extract_text(make_pages(rows)).collect()}
    assert {found[i] for i in range(6)} == {"The whole story.\n\nIts end."}
    assert {found[10 + i] for i in range(6)} == {"Plain story.\n\nIts end."}


def test_a_paragraph_that_all_articles_share_is_kept(make_pages):
    rows = [page(i, f"<article><p>We tested this.</p><p>Own {i}.</p></article>") for i in range(6)]
    found = {r.page_id: r.text for r in html_template.extract_text(make_pages(rows)).collect()}
    assert all(found[i] == f"We tested this.\n\nOwn {i}." for i in range(6))


def test_repeated_rows_and_copies_count_once(make_pages):
    rows = [page(i, f"<div id=post-{i}><p>Story {i}.</p></div>") for i in range(5)]
    copies = [page(50 + i, "<div id=post-9><p>Story nine.</p></div>") for i in range(8)]
    found = html_template.extract_text(make_pages([*rows, *[rows[0]] * 7, *copies])).collect()
    assert Counter(r.text for r in found) == Counter({"Story 0.": 8, "Story nine.": 8, **{f"Story {i}.": 1 for i in range(1, 5)}})


def test_templates_hold_nested_classes(make_pages):
    rows = [page(i, f"<p>{i}</p>" * (1 + i % 3)) for i in range(9)]
    tokens = html_template.templates(make_pages(rows)).collect()
    whole = [t for t in tokens if t.whole]
    by_token = {t.token: t for t in tokens}
    assert {t.support for t in whole} == {9} and sum(t.is_text for t in whole) == 3
    assert all(t.parent in (-1, 0) or t.parent in by_token for t in tokens)  # each class lies within another
    assert len({t.vector for t in tokens}) == 2  # once on every page, and the varying paragraphs


def test_sent_and_joined_templates_agree(make_pages, monkeypatch):
    rows = [page(i, f"<p>Story {i}.</p>", f"h{i % 2}.example") for i in range(12)]
    first = html_template.extract_text(make_pages(rows)).collect()
    monkeypatch.setattr(html_template, "SENT_TOKENS", 0)
    assert Counter(map(tuple, first)) == Counter(map(tuple, html_template.extract_text(make_pages(rows)).collect()))


def test_odd_rows(make_pages):
    rows = [(None, None, None), (1, "not an address", ""), (1, "not an address", ""), (2, None, "<p>x</p>")]
    pages = make_pages(rows).withColumns({"text": F.lit("old"), "host": F.lit(1)})
    found = html_template.extract_text(pages).select("page_id", "url", "text", "n_chars").collect()
    assert Counter(map(tuple, found)) == Counter([(None, None, "", 0), (1, "not an address", "", 0), (1, "not an address", "", 0), (2, None, "x", 1)])
    assert html_template.extract_text(pages.limit(0)).count() == 0


def test_hosts(spark):
    urls = ["https://A.b:80/x", "http://u@c/d?e=f", "x", None, "http://[::1]/", "ftp://h#q"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(html_template.host_of(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["a.b", "c", "", "", "[", "h"]
