import json

import pytest

from ledgerline.llm import html_wrappers as hw

HEAD = "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a='</p><p>no</p>';</script></head><body>"
NAV = '<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>'


def article(i):
    return f"<article><h1>Title {i}</h1><p><b>First {i} &lt;b&gt;<br>line\n  two</p><p>Second <i>par</i>t {i}.</p></article>"


def article_text(i):
    return f"Title {i} First {i} <b> line two Second part {i}."


def pages_with_article(n):
    extra = ['<div class="ad">Buy {i}</div>', "<aside>Side {i}</aside>", '<div id="cookie-notice">Cookies</div>',
             '<form><label>Mail</label><button>Send</button></form>', '<section class="comments"><p>Reader {i}</p></section>',
             '<div role="search">Find</div>', "<!-- hidden <p>x</p> -->", '<p hidden>no</p>', '<div style="display: none">no</div>']
    found = []
    for i in range(n):
        more = "".join(x.format(i=i) for k, x in enumerate(extra) if (i >> (k % 4)) & 1)
        found.append((f"http://h.example/{i}", f"{HEAD}<header><p>Site</p></header>{NAV}{more}{article(i)}"
                      f"<footer>&copy; h {i}</footer>" + ("</body></html>" if i % 2 else ""), article_text(i)))
    return found


def pages_without_article(n):
    return [(f"http://d.example/{i}", f"{HEAD}<div class=top><div>Home</div></div><div class=page><div class=menu>Go</div>"
             f"<div class=body><h2>Head {i}</h2><p>{'Long prose ' * 20}{i}</p><ul><li>One {i}</li><li>Two {i}</li></ul></div></div>"
             "<div class=low><p>All rights reserved</p></div></body>",
             f"Head {i} {('Long prose ' * 20)}{i} One {i} Two {i}") for i in range(n)]


def extracted(spark, pages, **more):
    rows = [(i, url, page) for i, (url, page, *_) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r.page_id: r for r in hw.extract(frame).collect()}
    assert len(found) == len(rows)
    assert all(r.n_chars == len(r.text) for r in found.values())
    return [found[i].text for i in range(len(rows))]


def test_articles(spark):
    pages = pages_with_article(40)
    assert extracted(spark, pages) == [text for *_, text in pages]


def test_single_page_of_a_host(spark):
    pages = pages_with_article(1)
    assert extracted(spark, pages) == [pages[0][2]]


def test_hosts_without_articles(spark):
    pages = pages_without_article(12)
    assert extracted(spark, pages) == [text for *_, text in pages]


def test_layouts_of_one_host(spark):
    """Pages with an article, with main, with a post's div and with plain divs; cards of other pages in articles."""
    card = "<article><h3>Card</h3></article>"
    kinds = [lambda i: (article(i), article_text(i)),
             lambda i: (f"<main><p>{'Body ' * 30}{i}</p></main>", f"{'Body ' * 30}{i}"),
             lambda i: (f"<main><p>{'Body ' * 30}{i}</p></main><div class=x>{card}</div>", f"{'Body ' * 30}{i}"),
             lambda i: (f"<main><p>{'Body ' * 30}{i}</p>{card}</main>", f"{'Body ' * 30}{i} Card"),
             lambda i: (f'<div class="post-content"><p>Post {i} {"text " * 20}</p></div>', f"Post {i} {'text ' * 19}text"),
             lambda i: (f"<div class=page><p>Plain {i} {'text ' * 20}</p></div>", f"Plain {i} {'text ' * 19}text")]
    made = [kinds[i % 6](i) for i in range(60)]
    pages = [(f"http://k.example/{i}", f"{HEAD}{NAV}<div class=top>Top</div>{page}<footer>f</footer>") for i, (page, _) in enumerate(made)]
    assert extracted(spark, pages) == [text for _, text in made]


def test_odd_addresses_are_hosts_of_their_own(spark):
    made = [(f"{NAV}{article(i)}", article_text(i)) if i % 2 else (f"<div><p>Plain {i} text</p></div>", f"Plain {i} text")
            for i in range(20)]
    assert extracted(spark, [((None, "?")[i % 3 == 0], page) for i, (page, _) in enumerate(made)]) == [text for _, text in made]


def test_near_copies_without_articles(spark):
    body = "<h2>Same head</h2>" + "".join(f"<p>{'Same prose ' * 10}{k}</p>" for k in range(4))
    pages = [(f"http://c.example/{i}", f"{HEAD}{NAV}<div class=date>May {i}</div><div><div>{body}</div></div>"
              "<div class=low><p>All rights reserved</p></div>") for i in range(12)]
    want = "Same head " + " ".join(f"{'Same prose ' * 10}{k}" for k in range(4))
    assert extracted(spark, pages) == [f"May {i} {want}" for i in range(12)]


@pytest.mark.parametrize(("page", "text"), [
    ('<svg class="i"/><article>t</article>', "t"), ("<p>x <svg /></p><article>a<svg/>b</article><svg><text>no</text></svg>", "a b"),
    ("<article><svg><path d='M0'/><text>no</text></svg>a <svg><title>no</title></svg>b</article>", "a b"),
    ("<article>a<svg><foreignObject><p>no</p></foreignObject></svg>b</article>", "a b"),
    ("<svg><path><article>t<p>u</article>", "t u"), ("<article>a <svg><style/><path/></svg>b</article>", "a b"),
    ("<article>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b <math/> c</article>", "a x=2 b c"),
    ("<article>a <object data=x>in <b>it</b></object> b<object>c</article>", "a in it b c"),
    ("<select><option>no<option>no<article>t</article>", "t"),
    ("<article>a <select><option>no</option>no</select> b</article>", "a b"), ("<iframe src=x><article>t</article>", "t"),
    ("<article>a<iframe>no</iframe> b</article>", "a b"), ("<noscript><template><article>t</article>", "t"),
    ("<article>a<textarea>no<p>no", "a"), ("<article>a<select><svg/><p>b</article>", "a b"),
])
def test_embedded_elements(spark, page, text):
    assert extracted(spark, [("http://e.example/", page)]) == [text]


@pytest.mark.parametrize(("page", "text"), [
    ('<body class="no-sidebar menu"><article>t</article>', "t"), ('<html id=social><body><div><p>t</p></div>', "t"),
    ('<div id="wrapper" class="has-sidebar"><article>t</article></div>', "t"),
    ('<div class="has-sidebar"><p>t</p></div>', "t"), ('<div class="widget"><article>t</article></div>', "t"),
    ('<div class="social"><div><p>t</p></div></div>', "t"),
    ('<article class="comments-open">t</article>', "t"), ('<main class="comments">t</main>', "t"),
    ('<article>a<section id="discussion"><p>b</p></section><h2 id="related-work">c</h2><p class="notice">d</p></article>', "a b c d"),
    ('<article><h2 id="discussion">c</h2><section class="related"><p>d</p></section></article>', "c d"),
    # Furniture stays out.
    ('<article>a<div class="share">s</div><ul class="social"><li>x</ul><section class="comments"><p>r</p></section></article>', "a"),
    ('<article>a</article><div id="comments"><article class="comment">r</article><article>r</article></div>', "a"),
    ('<div class="cookie-notice">c</div><div class="nav-menu"><p>m</p></div><div><p>t</p></div>', "t"),
    ('<div class="ad">c</div><article></article>', ""),
])
def test_names_of_elements(spark, page, text):
    assert extracted(spark, [("http://n.example/", page)]) == [text]


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain & simple", "plain & simple"), ("<p>a<p>b", "a b"), ("<article>x</div>y</article>z", "x y"),
    ("<article><p>a&nbsp;&#228;&#x41;&unknown; b</article>", "a äA&unknown; b"), ("<article>a<script>x", "a"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"), ("<article>1 < 2 and <3</article>", "1 < 2 and <3"),
    ("<article>in<b>li</b>ne <span>x</span></article>", "inline x"), ("<main><nav>m</nav><p>t</p></main>", "t"),
    ("<article><header><h1>H</h1></header><p>t</p><footer>f</footer></article>", "H t"), ("<ARTICLE CLASS='a'>T</ARTICLE>", "T"),
    ("<article>a<!-- b", "a"), ("<article>a<p title='x>y'>b</article>", "a b"),
])
def test_odd_pages(spark, page, text):
    assert extracted(spark, [("http://o.example/", page)]) == [text]


def test_long_page(spark):
    body = "<p>word &amp; word</p>" * 20_000
    assert extracted(spark, [("http://l.example/", f"<article>{body}</article>")]) == [" ".join(["word & word"] * 20_000)]


def test_wrapper_is_a_regular_expression_without_unions():
    shapes = [hw.shape_of(page) for _, page, _ in pages_with_article(16)]
    wrapper = shapes[0]
    for shape in shapes[1:]:
        wrapper = hw.align(wrapper, shape)
    text = hw.expression(wrapper)
    assert "(<p>#</p>)+" in text and "(<aside->#</aside->)?" in text and "<ul>(<li>#</li>)+</ul>" in text
    assert "|" not in text
    # The order of aligning does not change which slots hold main text.
    other = shapes[-1]
    for shape in shapes[-2::-1]:
        other = hw.align(other, shape)
    assert hw.main_slots(other) == hw.main_slots(wrapper)
    assert hw.main_slots(json.loads(json.dumps(wrapper))) == hw.main_slots(wrapper)


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, None, None, 1), (1, "x", "<article>a</article>", 1), (1, "x", "<article>a</article>", 1)],
                                  "page_id long, url string, html string, text int")
    found = sorted((r.page_id or 0, r.text, r.n_chars) for r in hw.extract(frame).collect())
    assert found == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert hw.extract(frame.limit(0)).collect() == []


KEPT_OUT = ["comments-area", "comments-section", "user-comments", "comment-list", "ad-slot", "advertisement-box", "site-notice",
            "related-posts"]


def test_comments_and_adverts_by_compound_names(spark):
    pages = [(f"http://c{i}.example/", page.format(name)) for i, (page, name) in enumerate(
        (page, name) for name in KEPT_OUT for page in (
            '<article><p>t</p><div class="{}"><p>r</p></div></article>', '<article><p>t</p></article><div id="{}"><p>r</p></div>',
            '<article><p>t</p><div class="x"><ul class="{}"><li>r</li></ul></div></article>'))]
    assert extracted(spark, pages) == ["t"] * len(pages)
    assert not any(map(hw.is_template_name, ["no-sidebar", "has-sidebar", "with-sidebar", "sidebar-open", "comments-open",
                                             "related-work", "site", "post-list", "page", "user-area"]))


def test_elements_nested_very_deeply(spark):
    n = 100_000
    pages = [("http://d1.example/", "<article><p>a</p>" + "<div>" * n + "deep<nav>menu</nav><p>end"),
             ("http://d2.example/", "<article>" + "<div>" * n + "deep" + "</div>" * n + "<p>t</p></article>out"),
             ("http://d3.example/", "<nav>" + "<div>x" * 2_000 + "</nav><article>t</article>"),
             ("http://d3.example/", "<article>" + "<div>x" * 2_000 + "</article>")]
    assert extracted(spark, pages) == ["a deep end", "deep t", "t", " ".join(["x"] * 2_000)]


def test_many_alternating_children(spark):
    n = 25_000
    parts = [f"<h2>{i}</h2><p>{i}</p>" for i in range(n)]
    pages = [("http://a.example/", "<article>" + "".join(parts[k:]) + "</article>") for k in (0, 3)]
    assert extracted(spark, pages) == [" ".join(f"{i} {i}" for i in range(k, n)) for k in (0, 3)]


def test_longest_common_sequence(monkeypatch):
    import random

    draw = random.Random(6)
    for size in (1, 5, 30, 90):
        for kinds in (1, 2, 4, 30):
            left, right = ([f"k{draw.randrange(kinds)}" for _ in range(draw.randint(0, size))] for _ in range(2))
            by_table = hw._common_by_table(left, right, 0, len(left), 0, len(right))
            monkeypatch.setattr(hw, "TABLE_CELLS", 6)
            by_bits = hw.common(left, right)
            monkeypatch.undo()
            for found in (by_table, by_bits):
                assert all(left[a] == right[b] for a, b in found)
                assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
            assert len(by_bits) == len(by_table) and hw.common(left, right) == by_table
