"""Main text of pages: by markup, by the neighbouring page, and against plain alignment."""

import random

import pytest

from tagspark.llm.html_text import ARTICLE, MAIN, OPEN, blocks, extract, nearest, place_of, shared_lines

SCHEMA = "page_id long, url string, html string, text int, n_chars string, key string"


def lines(page):
    return [x for x, _ in blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a  b\n c</p><p>d", ["a b c", "d"]),
        ("<p>x &amp; y &#233;&nbsp;z &am; &copy 5 < 6</p>", ["x & y é z &am; © 5 < 6"]),
        ("<p><b>bold<br><p>next<i>in</i>line", ["bold", "nextinline"]),
        ("<nav><ul><li>menu</ul></nav><p>text<footer>foot</footer><aside>side</aside>", ["text"]),
        ('<script>var t="</p><p>no";</script><style>p{}</style><p>yes<noscript>no</noscript>', ["yes"]),
        ("<!-- <p>no --><p>yes<!doctype x><?php no ?>", ["yes"]),
        ('<div class="cookie-banner"><p>no</div><div id=main-text><p>yes</div><div class="AdSlot">no</div>', ["yes"]),
        ("<form>no<input value='<p>'></form><p hidden>no</p><p style='display: none'>no</p>yes", ["yes"]),
        ("<header>site</header><article><header><h1>title</h1></header><p>body<div class=comments>no</div></article>", ["title", "body"]),
        ("<ul><li>one<li class=ad>no<li>two</ul>", ["one", "two"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<p class=ad>no<p>yes", ["yes"]),
        ("a <b", ["a"]),
        ("<div title=\"a > b\">x</div><a href='", ["x"]),
        ("", []),
        ("no markup", ["no markup"]),
    ],
)
def test_blocks(page, want):
    assert lines(page) == want


def test_kinds():
    found = dict(blocks("<p>out</p><main><p>in</p><article><p>art</p></article><article class='comment'>no</article></main>"))
    assert found == {"out": OPEN, "in": MAIN, "art": ARTICLE}
    assert blocks("<div role=main>x</div>") == [("x", MAIN)]


def test_long_and_hostile_pages_take_linear_time():
    assert len(lines("<p>word" * 200_000)) == 200_000
    for part in ("<a \"", "<!--", "<div class=x>", "</p", "&amp", "<<", "<script>", "<a b='"):
        blocks(part * 100_000)


def test_alignment_against_plain_table():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randrange(14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        for cells in (1 << 28, 6):
            got = shared_lines(a, b, cells)
            rest = iter(b)
            assert len(got) == table[-1][-1] and got == sorted(set(got)) and all(any(y == a[i] for y in rest) for i in got)


def test_nearest_and_places():
    assert place_of("HTTPS://Www.X.org:80/a/b?c#d") == ("www.x.org", "/a/b")
    assert place_of(None) == place_of("http://[x") == ("", "")
    assert nearest("/a/b", {"path": "/a"}["path"], "/a/bc") == 1 and nearest("/a", "/b", "/c") == 0 and nearest("/a", None, None) == -1


def page(*lines):
    return "".join(f"<div>{x}</div>" for x in lines)


def test_pages_of_a_host_lose_their_shared_lines(spark):
    rows = [
        (1, "http://h.org/a/1", page("Home | About", "first story", "Follow us")),
        (2, "http://h.org/a/2", page("Home | About", "second story", "Follow us")),
        (3, "http://h.org/b/9?x=1", page("Home | About", "third story")),
        (4, "http://h.org/b/9?x=2", page("Home | About", "third story")),  # the same page again
        (5, "http://lonely.org/", page("Home | About", "only page")),
        (6, None, page("Home | About", "no url")),
        (7, "http://h.org/c", "<article><p>Home | About</p><p>Follow us</p></article>" + page("Home | About")),
        (8, "http://h.org/d", None), (9, "http://h.org/e", ""), (9, "http://h.org/e", ""),
        (10, "http://g.org/x", page("Home | About", "same")), (11, "http://g.org/y", page("Home | About", "same")),
        (12, "http://bad[", page("x")),
    ]
    df = spark.createDataFrame([(*r, 0, "own", "k") for r in rows], SCHEMA).repartition(4)
    out = extract(df)
    assert out.columns == ["page_id", "url", "key", "text", "n_chars"]
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == len(rows) and all(r.key == "k" and r.n_chars == len(r.text) for r in out.collect())
    assert got == {
        1: "first story", 2: "second story", 3: "third story", 4: "third story", 5: "Home | About\nonly page", 6: "Home | About\nno url",
        7: "Home | About\nFollow us", 8: "", 9: "", 10: "Home | About\nsame", 11: "Home | About\nsame", 12: "x",
    }
    assert extract(df.limit(0)).count() == 0


def test_neighbours_across_buckets(spark):
    """Every page of a long host has a neighbour, at the edges of tasks and buckets too."""
    rows = [(i, f"http://h.org/{i:05}", page("menu", f"story {i}", "end")) for i in range(400)]
    df = spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA).repartition(6)
    assert {r.page_id: r.text for r in extract(df).collect()} == {i: f"story {i}" for i in range(400)}
