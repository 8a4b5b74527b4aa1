"""Main text of pages: markup, differencing, order and edge cases."""

import random
import re

from askgrid.llm import html_text


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    chosen = random.Random(2)
    for _ in range(500):
        a = [chosen.choice("abcd") for _ in range(chosen.randint(0, 12))]
        b = [chosen.choice("abce") for _ in range(chosen.randint(0, 12))]
        shared = sorted(html_text.common_lines(a, b))
        assert len(shared) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in shared)


def test_markup():
    source = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head>"
        "<body><header><h1>Site</h1></header><nav><ul><li>n</ul></nav><!-- <p>c</p> -->"
        "<main><header><h1>A &amp; B&nbsp;c</h1></header><p>x  <b>y</b>z<br>w<p>&lt;q&gt; &am"
        "<div class='cookie-notice'>no<div>no</div></div><aside>no</aside><form>no</form>"
        "<section id=comments><p>no</p></section><ul><li>1<li>2</ul><button>no</button></main>"
        "<footer>f</footer><a hre"
    )
    assert [t for _, t in html_text.page_lines(source)] == ["A & B c", "x yz w", "<q> &am", "1", "2"]


def test_attributes_are_read_by_name_and_classes_as_a_whole():
    source = (
        "<article><p>a</p><p title='a hidden gem'>b</p><p class='share-price'>c</p><p data-role=menu data-hidden>d"
        "<p alt=\"class='ad'\">e<p class='ad-hoc'>f<p>g<div class='ad'>no</div><div class='x cookie-notice'>no</div>"
        "<div id=site-comments>no</div><p hidden>no</p><p style='display: none'>no</p><p role=search>no</p></article>"
    )
    source = source.replace("<p hidden>no</p>", "<div hidden>no</div>")
    assert html_text.page_lines(source) == [(1, "a"), (1, "b"), (2, "c"), (1, "d"), (1, "e"), (2, "f"), (1, "g")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").selectExpr(
        "*", "'x' as host", "'y' as path", "'z' as lines", "'t' as text"
    )


def test_lines_that_the_neighbour_has_go(spark):
    page = "<body><p>Menu of the site<p>{}<p>All rights reserved</body>"
    rows = [(i, f"http://h/a/{i}", page.format(f"Own words {i}")) for i in range(40)]
    rows += [(100, "http://other/a", page.format("Alone"))]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages(spark, rows)).collect()}
    assert all(got[i] == f"Own words {i}" for i in range(40))
    assert got[100] == "Menu of the site\nAlone\nAll rights reserved"  # no other page of its host


def test_lines_in_doubt_go_if_the_neighbour_has_them(spark):
    page = "<article><p>Own {0}<div class='share-hint'>Tell your friends</div><p class='share-price'>{0} dollars</p><p>Same</article>"
    rows = [(i, f"http://h/a/{i}", page.format(i)) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages(spark, rows)).collect()}
    assert got == {i: f"Own {i}\n{i} dollars\nSame" for i in range(30)}
    alone = html_text.extract_text(pages(spark, [(1, "http://h/a", page.format(1))])).first()["text"]
    assert alone == "Own 1\nTell your friends\n1 dollars\nSame"


def test_copies_keep_their_text(spark):
    rows = [(i, "http://h/a", "<p>one<p>two") for i in range(3)]
    assert {r["text"] for r in html_text.extract_text(pages(spark, rows)).collect()} == {"one\ntwo"}


def test_copies_are_compared_with_the_nearest_page_that_differs(spark):
    """Copies of a page in one range and over several: their menu goes all the same."""
    page = "<p>Menu of the site</p><p>{}</p><p>All rights reserved</p>"
    rows = [(i, f"http://h/a/{i // 2:03}", page.format("Copied words")) for i in range(1, 399)]
    rows += [(0, "http://h/a/000", page.format("First words")), (399, "http://h/b", page.format("Last words"))]
    rows += [(400, "http://other/", page.format("Alone")), (401, "http://other/", page.format("Alone"))]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages(spark, rows)).collect()}
    assert {got[i] for i in range(1, 399)} == {"Copied words"}
    assert (got[0], got[399]) == ("First words", "Last words")
    assert got[400] == got[401] == "Menu of the site\nAlone\nAll rights reserved"  # nothing there to compare with


def test_differencing_comes_before_the_check_by_markup(spark):
    """Furniture takes part in the alignment, so its words are not taken for the same words of the text."""
    source = "<nav><p>Sport<p>More</nav><p>{}<p>Sport<p>{}<footer>f {}</footer>"
    lines = html_text.page_lines(source.format(1, 2, 3), furniture=True)
    assert lines == [(3, "Sport"), (3, "More"), (0, "1"), (0, "Sport"), (0, "2"), (3, "f 3")]
    other = "<nav><p>Sport<p>More</nav><p>Other"
    rows = [(1, "http://h/1", source.format(1, 2, 3)), (2, "http://h/2", other)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages(spark, rows)).collect()}
    assert got == {1: "1\nSport\n2", 2: "Other"}
    article = [f"{zone}{line}" for zone, line in html_text.page_lines("<nav>n</nav><article><p>a<p class='share-x'>b", True)]
    assert html_text.checked(article, {0, 1, 2}) == ["1a"]
    assert html_text.checked(article, {1}) == ["1a", "2b"]


def test_nulls_long_and_empty(spark):
    long = "<article>" + "<p>a b</p>" * 20000 + "</article>"
    rows = [(None, None, None), (1, "no scheme", ""), (2, "http://h/", long), (2, "http://h/", long)]
    got = [(r["page_id"], r["url"], r["n_chars"]) for r in html_text.extract_text(pages(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(
        [(None, None, 0), (1, "no scheme", 0), *[(2, "http://h/", 20000 * 4 - 1)] * 2], key=str
    )
    assert html_text.extract_text(pages(spark, [])).count() == 0


def test_query_against_the_pages_own_articles(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["page_id"]: r["text"] for r in html_text.op2_html_text(spark, folder).collect()}
    import html

    for row in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", row["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[row["page_id"]] == "\n".join(b for b in blocks if b)


def test_neighbours_across_ranges(spark):
    """Pages without an article, a few per range: each is compared as if all were sorted in one list."""
    def page(i):
        return f"<body><p>Site {i // 50} menu</p><p>Part {i % 7}</p><p>Own text {i}</p><p>Site {i // 50} foot</p></body>"

    rows = [(i, f"http://h{i // 50}.org/a/{i % 5}/p{i:03}", page(i)) for i in range(200)]
    rows += [(900, None, "<p>No host</p>"), (901, "", "<p>No host</p><p>either</p>"), (None, "http://z.org/", None)]
    lines = [((i, u), *(("", "") if not u else tuple(u[7:].split("/", 1))), html_text._pack(html_text.page_lines(h or ""))) for i, u, h in rows]
    lines = [(k, host, f"/{path}" if host else "", packed) for k, host, path, packed in lines]
    lines.sort(key=lambda p: (p[1], p[2], p[0][0] is not None, p[0][0] or 0, p[3]))
    near = zip(lines, [None, *lines[:-1]], [*lines[1:], None], strict=True)
    expected = [(*p[0], html_text._text(p, before, after)) for p, before, after in near]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING"))
    got = [(r["page_id"], r["url"], r["text"]) for r in got.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum("menu" not in t for _, _, t in got) > 150
