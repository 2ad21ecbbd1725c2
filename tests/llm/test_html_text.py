import time
from html.parser import HTMLParser

import pytest

from weirflow.llm.html_text import extract, report, text_of

CASES = [
    ("", ""),
    ("plain &amp; <b>bold</b>text", "plain & boldtext"),
    ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
    ("<div>a</div><div>b<br>c<br><br>d</div>", "a\nb\nc\n\nd"),
    ("x<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no --> y", "x y"),
    ("<head><title>T</title></head><body>b", "b"),
    ("<p hidden>a</p><p style='display: none'>b</p><div style='visibility:hidden'>c<b style='visibility:visible'>d</b></div><input type=hidden value=x>e", "d\ne"),
    ("<ul><li>a<li>b<ul><li>c<li>d</ul><li>e</ul>f", "- a\n- b\n  - c\n  - d\n- e\n\nf"),
    ("<ol start=9><li>a</li><li>b<p>more</p></li><li value=3>c</ol>", "9. a\n10. b\n\n    more\n\n3. c"),
    ("<table><tr><th>name<th>n<tr><td>apple<td>1<tr><td>fig<td>22</table>z", "name   n\napple  1\nfig    22\n\nz"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td rowspan=2>d<td>e<td>f<tr><td>g<td>h</table>", "ab     c\nd   e  f\n    g  h"),
    ("<table><caption>cap</caption><tr><td>a<br>b<td>c</table>", "cap\na  c\nb"),
    ("<table><tr><td><table><tr><td>i<td>j</table><td>k</table>", "i  j  k"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n  b\nc\n  d"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("a </b></p> b <img alt='pic'> <svg><text>q</text></svg>", "a b pic"),
    ("<a href='x>y'>l</a> < 3 <", "l < 3 <"),
    ("<select><option>a<option>b</select>c<blockquote>q</blockquote>", "c\n\n  q"),
]


@pytest.mark.parametrize("piece", ["<a x", "<a x ", '<a x="', "<a x='b ", "</a ", "<a b=c "])
@pytest.mark.parametrize("end", ["", "y=\">"])
def test_tags_that_never_end_take_time_in_proportion(piece, end):
    began = time.monotonic()
    assert text_of("<p>seen " + piece * 100_000 + end)[1].startswith("seen")
    assert time.monotonic() - began < 20


def test_a_tag_that_the_page_ends_in_is_dropped():
    assert text_of("a <b>c</b> <i title='d e> f")[1] == "a c f"
    assert text_of("a <b>c</b> <i title=d")[1] == "a c"
    assert text_of("a < b <1 c</")[1] == "a < b <1 c</"


@pytest.mark.parametrize(("source", "want"), CASES)
def test_layout(source, want):
    assert text_of(source)[1] == want


class Naive(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")
        self.words.append(" ") if tag not in ("b", "a") else None

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")
        self.words.append(" ") if tag not in ("b", "a") else None

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_all_visible_words_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = report(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        naive = Naive()
        naive.feed(source[r.page_id])
        naive.close()
        got = [w for line in r.text.split("\n") for w in line.removeprefix("- ").split()]
        assert got == "".join(naive.words).split()
        assert r.title and "<" not in r.title


def test_hard_rows(spark):
    deep, wide = "<div>" * 50_000 + "x", "<p>word " * 50_000
    assert text_of(deep)[1] == "x" and text_of(wide)[1].count("word") == 50_000
    assert len(text_of("<table>" + "<tr><td>a<td>b" * 5_000 + "<tr><td>" + "c" * 200_000 + "</table>")[1]) < 500_000
    pages = spark.createDataFrame([(1, None, "t", 1), (2, "", "t", 2), (2, "<p>a", "t", 3), (2, "<p>a", "t", 3)], "page_id long, html string, text string, _made int")
    rows = extract(pages.drop("_made")).collect()
    assert sorted((r.page_id, r.text) for r in rows) == [(1, ""), (2, ""), (2, "a"), (2, "a")]
    assert report(pages.select("page_id", "html", "text").withColumnRenamed("text", "url").limit(0)).count() == 0


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<table><tbody><form><tr><td>a</table>", "a"),
        ("<table><tbody><td>a<td>b</table>", "a  b"),
        ("<table><td>a<td>b<tr><td>c</table>d", "a  b\nc\n\nd"),
        ("<table><tr>loose<td>a</td>more</tr>end</table>", "loosemoreend\n\na"),
        ("<table><tbody><div>x<tr><td>a<td>b</table>", "x\n\na  b"),
        ("<table hidden><tr>shown<td>not</table>", "shown"),
        ("<table><tr><form><td>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr><td>a<table></tr><td>b</table>c<td>d</table>", "a  d\nb\nc"),
        ("<table><template><tr><td>no</template><tr><td>a</table>", "a"),
        ("<table><tr><td>a<tr><table><td>b</table>", "a\n\nb"),
        ("<a title=it's>Bob</a> one two don't <b>x", "Bob one two don't x"),
        ('<a title="x>y" b=c="d>e</a><p hidden=">">f</p><i alt = \'>\'>g', "eg"),
        ("<a \">h</a> i\" <p/hidden>j", 'h i"'),
    ],
)
def test_nothing_lost_in_tables_and_at_quotes(source, want):
    assert text_of(source)[1] == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>.", "so x=2."),
        ("a <textarea>b &amp; c\nd  e</textarea> f", "a b & c\nd  e f"),
        ("<object data=x><p>instead</object>z", "instead\n\nz"),
        ("<div>" * 300 + "a<div hidden>b</div><p style='display:none'>c</p>d" + "</div>" * 300, "ad"),
        ("<div hidden>" + "<b>" * 300 + "<div>x</div>y" + "</b>" * 300 + "</div>z", "z"),
        ("<b>" * 300 + "<div hidden><i>n</i>o</div>" + "</b>" * 300 + "<ul><li>p</ul>", "- p"),
        ("<table><tr><td>" * 400 + "x", "x"),
    ],
)
def test_visible_at_any_depth(source, want):
    assert text_of(source)[1] == want


def test_deep_pages_take_little():
    lists = text_of("<ul><li>x" * 3_000)[1].split("\n")
    assert len(lists) == 3_000 and max(map(len, lists)) < 100
    assert text_of("<div>" * 20_000 + "</b>" * 20_000 + "<p>x" * 20_000)[1].count("x") == 20_000


@pytest.mark.parametrize("seed", range(20))
def test_stretches_of_covered_columns(seed):
    """Against a column by column account; where cells overlap, the upper one counts."""
    import random

    from weirflow.llm.html_text import Covered

    rng, covered, until = random.Random(seed), Covered(), {}
    for row in range(60):
        covered.reach(row)
        until = {c: r for c, r in until.items() if r > row}
        at, lasting = 0, []
        for _ in range(rng.randrange(6)):
            found = covered.free(at)
            while at in until:
                at += 1
            assert found == at
            wide, high = rng.randrange(1, 9), rng.randrange(1, 9)
            if high > 1:
                lasting.append((at, at + wide, row + high))
            at += wide
        for start, end, last in lasting:
            covered.cover(start, end, last)
            for c in range(start, end):
                until.setdefault(c, last)
        assert [c for s, e in zip(covered.starts, covered.ends, strict=True) for c in range(s, e)] == sorted(until)


def test_no_row_is_pushed():
    """One long cell is wrapped in its column, however many rows there are and whatever came before."""
    for rows in (3, 2000):
        lines = text_of("<table>" + "<tr><td>a<td>right" * rows + "<tr><td>" + "word " * 400 + "<td>right</table>")[1].split("\n")
        assert {line.index("right") for line in lines if "right" in line} == {42}
        assert sum(line.count("word") for line in lines) == 400 and max(map(len, lines)) <= 47


def test_long_words_stay_whole():
    word = "x" * 100
    text = text_of(f"<table><tr><td>a {word} b<td>one<br>two<br>three<tr><td>c<td>d</table>")[1]
    assert text == "a" + " " * 41 + "one\n" + word + "\nb" + " " * 41 + "two\n" + " " * 42 + "three\nc" + " " * 41 + "d"


def test_many_and_wide_spans():
    assert text_of("<table><tr>" + "<td colspan=1000>x" * 15_000)[1].split() == ["x"] * 15_000
    assert text_of("<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 8_000)[1].split() == ["x"] * 8_000
    assert len(text_of("<table>" + "<tr><td rowspan=65534>a<td rowspan=2>b" * 5_000)[1]) < 6_000_000


def test_blanks_in_styles():
    assert text_of('<p style="display:\tnone">a</p><p style="visibility :\nhidden">b</p>c')[1] == "c"
