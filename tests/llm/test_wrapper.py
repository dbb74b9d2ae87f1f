"""Main text of pages against hand-written expectations, and what the host's votes add to it."""

import pytest
from pyspark.sql import functions as F

from loomspark.llm import wrapper

WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty knoll larch maple north ocean pearl quartz river stone thorn umber vale willow xenon yarrow zephyr".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * (seed % 5 + 1) + i * i) % 26] for i in range(n))


def extract(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string, text string, host int")
    return {r.page_id: r.text for r in wrapper.extract(df, keep={"page_id": F.col("page_id")}).collect()}


def test_votes_choose_where_nothing_is_named(spark):
    # plain containers only: a constant box inside the content, a constant box of prose before and after it
    page = "<html><body><div><div><p>Welcome to our site, the best of all sites there are.</p></div><div>{extra}<h2>Head {i}</h2><p>{a}</p><div><p>Read this again every day, it is always here.</p></div><ul><li>{b}<li>end {i}</ul></div><div><p>All of this is told by us since long ago.</p></div></div></body></html>"
    rows = [("http://plain.example/%d" % i, page.format(i=i, a=prose(i, 60), b=prose(i + 50, 9), extra="<div><p>Note of the day for all readers of this.</p></div>" if i % 3 == 0 else "")) for i in range(9)]
    got = extract(spark, rows)
    for i in range(9):
        assert got[i] == f"Head {i}\n{prose(i, 60)}\n{prose(i + 50, 9)}\nend {i}"
        assert "Read this again" in wrapper.main_text(rows[i][1])  # nothing else says that it is template


def test_several_templates_of_a_host(spark):
    a = "<body><div class=x1><ul><li><a href=/>home</a></ul></div><div class=x2><h1>A {i}</h1><p>{t}</p><div class=x3>Printed on recycled paper only.</div></div></body>"
    b = "<body><table><tr><td><p>Fixed words at the left of the page</p></td><td><h1>B {i}</h1><p>{t}</p></td></tr></table></body>"
    rows = [("http://two.example/", (a if i % 3 else b).format(i=i, t=prose(i, 40))) for i in range(15)]
    got = extract(spark, rows)
    for i in range(15):
        assert got[i] == f"{'A' if i % 3 else 'B'} {i}\n{prose(i, 40)}"


def test_copies_keep_their_article(spark):
    page = f"<body><nav>menu</nav><article><h1>T</h1><div class=body><p>{prose(1, 50)}</p></div></article><footer>foot {{}}</footer></body>"
    plain = f"<body><div class=top><p>Site</p></div><div class=body><h1>T</h1><p>{prose(2, 50)}</p></div><div class=ad>{{}}</div></body>"
    rows = [("http://copies.example/", page.format("same"))] * 4 + [("http://near.example/", page.format(i)) for i in range(6)] + [("http://nearplain.example/", plain.format(i)) for i in range(6)]
    got = extract(spark, rows)
    assert {got[i] for i in range(10)} == {f"T\n{prose(1, 50)}"}
    assert all(f"T\n{prose(2, 50)}" in got[i] for i in range(10, 16))


def test_names_are_whole_words_and_math_stays(spark):
    page = "<body><div class='menu'><a href=a>a</a></div><div class='content has-sidebar'><div class='post-header'><h1>T{0}</h1></div><section class='legal'><p>L{0}</p></section><section id='side-effects'><h2 id='related-work'>R{0}</h2><p>x <math><mi>m</mi></math> &amp; &eacute;</p></section><div class='comment-list'><p>reader {0}</p></div><div class='cookie-notice'>c{0}</div></div><div id='sidebar'><p>side {0} text</p></div></body>"
    got = extract(spark, [("http://h.example/%d" % i, page.format(i)) for i in range(2)] + [(None, page.format(7))])
    for i, n in ((0, 0), (1, 1), (2, 7)):
        assert got[i] == f"T{n}\nL{n}\nR{n}\nx m & é"


def test_content_after_very_many_menu_nodes(spark):
    menu = "".join(f"<div class='m{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}'><span>entry {k}</span><p>p</p></div>" for k in range(900))
    page = "<body><div class=wrap>" + menu + "</div><div class=story><h1>S {0}</h1><p>{1}</p></div></body>"
    got = extract(spark, [("http://many.example/%d" % i, page.format(i, prose(i, 30))) for i in range(5)])
    assert [got[i] for i in range(5)] == [f"S {i}\n{prose(i, 30)}" for i in range(5)]


def test_edges(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(None, None), ("u", ""), ("http://x.example/", "plain <b>text</b>"), ("http://x.example/", deep), ("http://x.example/", "<p>" * 20000 + "end"), ("http://x.example/", "<script>var a='<p>no</p>'</script><style>p{}</style>yes<br>no &lt; <!-- gone --> a<b>b</b>"), ("http://x.example/", "<ul><li>one<li>two</ul> " + "long " * 50000)]
    rows += [rows[2]]
    got = extract(spark, rows)
    assert got == {0: "", 1: "", 2: "plain text", 3: "deep", 4: "end", 5: "yes no < ab", 6: "one\ntwo\n" + " ".join(["long"] * 50000), 7: "plain text"}
    assert wrapper.extract(spark.createDataFrame([], "url string, html string")).count() == 0


def test_numbered_containers_are_told_apart(spark):
    columns = "<body><div class='row'><div class='col-md-3'><p>Menu of the shop</p><p>All of our brands</p></div><div class='col-md-9'><h1>C {i}</h1><p>{t}</p></div></div></body>"
    parts = "<body><div class=x1><p>The head of every page here</p></div><div class=x2><p>{t}</p><p>tail {i}</p></div><div class=x3><p>Made by hand in the north</p></div></body>"
    rows = "<body><div class=row><p>Top of all pages</p></div><div class=row><p>{t}</p></div><div class=row><p>Foot of all pages</p></div></body>"
    posts = "<body><div id='post-{n}'><p>{t}</p></div><div id='box-{n}'><p>Same box below each post of ours</p></div></body>"
    pages = [(f"http://{h}.example/{i}", p.format(i=i, t=prose(i, 40), n=1000 + 37 * i)) for h, p in (("columns", columns), ("parts", parts), ("rows", rows), ("posts", posts)) for i in range(7)]
    got = extract(spark, pages)
    for i in range(7):
        assert got[i] == f"C {i}\n{prose(i, 40)}"
        assert got[7 + i] == f"{prose(i, 40)}\ntail {i}"
        assert got[14 + i] == prose(i, 40)
        assert got[21 + i] == prose(i, 40)

    fixed = f"<body><div class=y1><p>{prose(77, 90)}</p></div><div class=y2><p>{{t}}</p></div></body>"
    pages = [(f"http://fixed.example/{i}", fixed.format(t=prose(i, 40))) for i in range(7)]
    assert extract(spark, pages) == {i: prose(i, 40) for i in range(7)}
    assert all(prose(77, 90) in wrapper.main_text(html) for _, html in pages)  # without votes nothing tells it


def test_very_many_siblings_are_aligned(spark):
    page = "<body>" + "<div><p>Words that stand on all the pages</p></div>" * 150 + "{extra}<div><h1>S {i}</h1><p>{t}</p></div>" + "<div><p>Words that stand below on all of them</p></div>" * 150 + "</body>"
    rows = [("http://siblings.example/%d" % i, page.format(i=i, t=prose(i, 60), extra="<div><table><tr><td><p>today</p></td></tr></table></div>" * (i % 2))) for i in range(6)]
    got = extract(spark, rows)
    for i in range(6):
        text = got[i].split("\n")
        assert f"S {i}" in text and prose(i, 60) in text and "Words that stand on all the pages" not in text


def test_long_rows_are_aligned_as_short_ones():
    import random

    r = random.Random(9)
    kinds = [wrapper.Node(k, [wrapper.Node(c, [], []) for c in "xy"[: i % 3]], []) for i, k in enumerate("aabbcc")]
    for _ in range(40):
        xs, ys = ([r.choice(kinds) for _ in range(r.randint(0, 40))] for _ in range(2))
        score = lambda a, b: a.size if a.shape == b.shape else (a.label == b.label)
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + score(x, y))
        pairs = wrapper._aligned(xs, ys, score)
        assert sum(score(x, y) for x, y in pairs) == best[-1][-1]
        ids = [[id(n) for n in row] for row in (xs, ys)]
        assert wrapper.match(wrapper.Node("r", xs, []), wrapper.Node("r", ys, []))[0] >= best[-1][-1] + 1 and len(ids[0]) == len(xs)


def test_pages_of_several_articles(spark):
    page = "<body><nav>menu</nav><main><article><h2>A {0}</h2><p>{1}</p></article><article><h2>B {0}</h2><p>{2}</p></article></main><footer>foot</footer></body>"
    got = extract(spark, [("http://two.example/%d" % i, page.format(i, prose(i, 30), prose(i + 9, 20))) for i in range(4)])
    assert [got[i] for i in range(4)] == [f"A {i}\n{prose(i, 30)}\nB {i}\n{prose(i + 9, 20)}" for i in range(4)]


def test_simple_tree_matching_equals_brute_force():
    import random

    def grow(r, n):
        return wrapper.Node(r.choice("ab"), [grow(r, n - 1) for _ in range(r.randint(0, 3))] if n else [], [])

    def best(a, b):  # all ways to pair kids in order
        if a[0] != b.label:
            return 0

        def pair(i, j):
            if i == len(a[1]) or j == len(b.kids):
                return 0
            return max(pair(i + 1, j), pair(i, j + 1), best(a[1][i], b.kids[j]) + pair(i + 1, j + 1))

        return 1 + pair(0, 0)

    r = random.Random(4)
    for _ in range(150):
        a, b = wrapper.skeleton(grow(r, 3)), grow(r, 3)
        score, pairs = wrapper.match(a, b)
        assert score == best(a, b) == len(pairs)


@pytest.mark.parametrize("token,said", [("cookie-notice", 2), ("has-sidebar", 0), ("post-header", 0), ("site-header", 2), ("ad-300x250", 2), ("adBanner", 2), ("side-effects", 0), ("legal", 0), ("related-work", 0), ("related", 1), ("comments-area", 2), ("main-content", 0)])
def test_names(token, said):
    assert wrapper.judge_name(token) == said
