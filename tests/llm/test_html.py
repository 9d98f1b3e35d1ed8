"""Main text of pages."""

import html
import math
import re
import time

import duckdb
import pytest

import samples
from tuneprep.llm.html import blocks_of, extract, main_text, path_ratios, path_scores

LINE = "This is a sentence of the story, with marks. "
LONG, MIDDLE, SHORT = (LINE * 20).strip(), (LINE * 7).strip(), (LINE * 2).strip()

CASES = [
    ("<body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One,  two.<p>Three<br>four."
     "</article><footer>c 2020</footer>", "A & B One, two. Three four."),
    ("<body class='has-sidebar'><div class=menu><ul><li><a>Home<li><a>More</ul></div><div class=story>"
     "<h1>Title</h1><p>First text, with marks.</p><p>Second text, it has more.</p>"
     "<div class='comments'><p>I like it, really.</p></div></div>"
     "<div id='cookie-notice'>We use cookies, sorry.</div>", "Title First text, with marks. "
     "Second text, it has more."),
    ("<main><p>Text &#233;&nbsp;x, y.</p><form>Name <input name=a></form><aside>Side, note.</aside>"
     "<script>if (a<b) document.write('<p>no, no.</p>')</script></main>", "Text é x, y."),
    ("<p>a<b>b</b>c<script>1</script>d, e.</p><!-- <p>no, no.</p> --><p hidden>no, no.</p>", "abcd, e."),
    ("just text, no tags", "just text, no tags"), ("", ""), (None, ""), ("<p></p><div>", ""),
    ("<article><p>x &lt;b&gt; y</p><p>unclosed <i>tags, here", "x <b> y unclosed tags, here"),
    ("<a title=\"1 > 0\">link, text.</a><p>Long enough text, with marks.</p>",
     "Long enough text, with marks."),
    (f"<body><div id=content><h1>T</h1><p>{LONG}</p><p>{SHORT}</p></div><div class=x><p>Short teaser</p>",
     f"T {LONG} {SHORT}"),
    (f"<body><div><h1>T</h1><section><p>{LONG}</p><p>{MIDDLE}</p></section><section><p>{SHORT}</p>"
     "</section></div>", f"T {LONG} {MIDDLE} {SHORT}"),
    (f"<body><article><p>{LONG}</p></article><article><p>{MIDDLE}</p></article>", f"{LONG} {MIDDLE}"),
    (f"<body><article><p>{SHORT}</p></article><div class=story><h1>T</h1>" + f"<p>{MIDDLE}</p>" * 5
     + "</div>", " ".join(["T"] + [MIDDLE] * 5)),
    (f"<body><h1>T</h1><p>{LONG}</p><ul><li>one thing</li><li>two things</li></ul><p>{MIDDLE}</p>",
     f"T {LONG} one thing two things {MIDDLE}"),
    (f"<body><h1>T</h1><article><p>{LONG}</p></article><div><a href=x>more</a></div>", f"T {LONG}"),
    (f"<article><h1>T</h1><p>{LONG}</p><section class='related work'><h2>Related work</h2><p>{LONG}</p>"
     "</section></article>", f"T {LONG} Related work {LONG}"),
    (f"<body><div class=c><p>{LONG}</p><p class=alert>{MIDDLE}</p><p>{LONG}</p></div>",
     f"{LONG} {MIDDLE} {LONG}"),
    (f"<body><div class='nav-open has sidebar'><p>{LONG}</p><p>{MIDDLE}</p></div>", f"{LONG} {MIDDLE}"),
    (f"<body><div><ul><li><a>Home</a><li><a>More</a></ul></div><div><p>{LONG}</p><p>{MIDDLE}</p></div>",
     f"{LONG} {MIDDLE}"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert main_text(page) == text


def test_path_scores():
    """The ratios of every path, summed up one block at a time."""
    rows = duckdb.sql(f"SELECT html FROM read_parquet('{samples.DATA}/pages.parquet')").fetchall()
    for (page,) in rows + [(p,) for p, _ in CASES if p]:
        found, _ = blocks_of(page)
        if not found:
            continue
        size, marks, number = {}, {}, {}
        for node, text, linked in found:
            p = node.path
            size[p] = size.get(p, 0) + max(len(text) - linked, 0)
            marks[p] = marks.get(p, 0) + sum(c in ".,;:!?，。；：！？、…" for c in text)
            number[p] = number.get(p, 0) + 1
        fused = []
        for i in range(len(found)):
            near = [(math.exp(-0.5 * (j - i) ** 2), found[j][0].path)
                    for j in range(max(i - 2, 0), min(i + 3, len(found)))]
            total = sum(w for w, _ in near)
            fused.append(math.sqrt(sum(w * size[p] / number[p] for w, p in near) / total
                                   * (0.1 + sum(w * marks[p] / number[p] for w, p in near) / total)))
        want = {}
        for p in size:
            mine = [(len(t) * (0.5 if n.weak else 1), len(t), f)
                    for (n, t, _), f in zip(found, fused) if n.path == p]
            want[p] = sum(w * f for w, _, f in mine) / sum(k for _, k, _ in mine)
        scores, deviation = path_scores(found, path_ratios(found), 2)
        assert scores == pytest.approx(want)
        mean = sum(fused) / len(fused)
        assert deviation == pytest.approx(math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)))


@pytest.mark.parametrize("page", [
    "<b>" * 20_000 + "x", "<div>a, b. " * 10_000, "<p class=ad>a" * 20_000, "<span></i>" * 10_000,
    "<b>" * 20_000 + "<p>x</p>" * 5_000, "<div class=ad>x" * 10_000, "<ul><li>x" * 10_000])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 3


def test_paths_decide_without_article_tags():
    rows = duckdb.sql(f"SELECT html FROM read_parquet('{samples.DATA}/pages.parquet')").fetchall()
    for (page,) in rows:
        plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert main_text(plain) == main_text(page) != ""


def test_pages(spark):
    rows = duckdb.sql(f"SELECT page_id, url, html FROM read_parquet('{samples.DATA}/pages.parquet')"
                      ).fetchall()
    want = {}
    for key, url, page in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|$)", page, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "")
                                      .replace("</b>", "")).split())
        want[key] = (url, text, len(text))
    rows += [(-1, None, None), (None, "u", ""), (-2, "u", "<" * 50_000 + "<p>a" * 20_000), rows[0]]
    df = spark.createDataFrame([(*r, "n", 3) for r in rows],
                               "page_id bigint, url string, html string, text string, n_chars int")
    got = extract(df).collect()
    assert len(got) == len(rows)
    found = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in got}
    assert {k: found[k] for k in want} == want
    assert found[-1] == (None, "", 0) and found[None] == ("u", "", 0)
    assert extract(df.limit(0)).count() == 0
