import pytest

from locuskit.llm.rendering import render, rendered

CASES = [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div> b  c</div>", "a\nb c"),
    ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol><li>a<li>b</ol>c", "1. a\n2. b\n\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<table><tr><td>a<td>bb<tr><th>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><td>x<td><table><td>y<td>z</table></table>t", "x  y z\n\nt"),
    ("<p hidden>a</p><p style='color:red; display : none'>b</p><p>c", "c"),
    ("<head><title>t</title><style>p{}</style></head><body>x<script>var t='</p>';</script>", "x"),
    ("<pre>a  b\n  c</pre>", "a  b\n  c"), ("x<!-- y -->z", "xz"), ("<b>a</b> <i>b</i>", "a b"), ("</p></div>a<", "a<"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"), ("<p>a<ul><li>b</ul>", "a\n\n- b"), ("<p>a<b>x<p>c", "ax\n\nc"),
    ("<div>" * 20_000 + "deep", "deep"), ("<b>" * 20_000 + "deep<p>q", "deep\n\nq"),
    ("<table><tr><td>x" + "<b>" * 70 + "<td>y<tr><td>p<td>q</table>", "x  y\np  q"),
    ("<table><tr><td>" + "a" * 60 + "<td>b<tr><td>c<td>d</table>", "a" * 60 + "  b\nc" + " " * 61 + "d"),
    ("<table><tr><td>" + "a" * 300 + "<td>b<tr><td>c<td>d</table>", "a" * 300 + "\nb\nc\nd"),
    ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f</table>", "a  b  c\n   d  e\nf"),
    ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>", "a     b\nc  d  e"),
    ("<table><tr><td colspan=99999999>a<td>b<tr><td rowspan=0>c<td>d<tr><td>e</table>", "a     b\nc  d\n   e"),
    ("<ol start=5><li>a<li value=9>b<li>c</ol>", "5. a\n9. b\n10. c"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<p style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</p>d", "b\n\nd"),
    ("<details><summary>s</summary>t</details><details open><summary>u</summary>v</details>", "s\nu\nv"),
    ("<style>.x, p#y{display:none} @media print{div{display:none}} a b{display:none}</style><p class='w x'>a<p id=y>b<div id=y>c</div>", "c"),
    ("<style>.v{visibility:hidden}</style><p class=v>a<i style='visibility:visible'>b</i>", "b"),
    ("<ul><li><div>" + "<b>" * 3000 + "<li>a" * 3000, "-\n" + "\n".join(["- a"] * 3000)),
    ("<table>" * 300 + "<td>q", "q"), ("word " * 50_000, ("word " * 50_000).strip())]


@pytest.mark.parametrize("html,text", CASES)
def test_render(html, text):
    assert render(html) == text


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = rendered(pages).collect()
    assert len(rows) == pages.count() and all(r["rendered_text"] and "<p" not in r["rendered_text"] for r in rows)
    hard = spark.createDataFrame([(1, None, "<p>a", "x"), (1, None, "<p>a", "x"), (None, "u", None, None)],
                                 "page_id int, url string, html string, rendered_text string")
    assert sorted((str(r[0]), r["rendered_text"]) for r in rendered(hard).collect()) == [("1", "a"), ("1", "a"), ("None", "")]
    assert rendered(hard.limit(0)).count() == 0
