"""Page parsing by hand-written cases, and extraction of planted articles."""

import pytest

from corpusloom.llm import html_extract, queries


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<html><head><title>T</title><body><p>One &amp; two</p><p>three", ["One & two", "three"]),
        ("<head><meta charset=x><p>One</p>", ["One"]),
        ("<head><title>T</title></head><p>One</p>", ["One"]),
        ('<p>a<svg class="i" width="3"/>b</p><p>c</p>', ["ab", "c"]),
        ("<p>a<svg><path d='x'/><text>no</text></svg> b</p>", ["a b"]),
        ('<p title="a > b">x</p><p data-x=\'1>2\'>y</p>', ["x", "y"]),
        ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
        ("<script>var a = '<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", ["yes"]),
        ("<p>a<br>b\n\t c</p>", ["a b c"]),
        ("<ul><li>a<li>b</ul>", ["a", "b"]),
        ('<p class="x>unclosed', ["unclosed"]),
        ("", []),
        ("plain", ["plain"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in html_extract.blocks(page)] == texts


def test_long_pages_parse_in_linear_time():
    assert len(html_extract.blocks("<p a=\"b>" * 20000)) == 0
    assert len(html_extract.blocks("<p>x</p>" * 20000)) == 20000


def test_extraction(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = queries.op10_html(spark, sf)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    network = html_extract.train(pages)
    prose = [b.text for r in pages.limit(40).collect() for b in html_extract.blocks(r["html"]) if b.size > 150][:24]
    made = []
    for i in range(4):
        body = prose[6 * i : 6 * i + 6]
        head = "<head><title>x</title>" + ("" if i % 2 else "</head>")
        made.append((i, f"<html>{head}<body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article>" + "".join(f"<p data-a='1>0'>{t}</p>" for t in body) + "</article><aside><p>Related stories</p></aside><footer><p>&copy; 2024 all rights reserved</p></footer></body></html>", "\n\n".join(body)))
    made += [(10, None, ""), (11, "", ""), (12, "<html><body></body></html>", "")]
    df = spark.createDataFrame([(i, f"http://x/{i}", h, "clash") for i, h, _ in made], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df, network).collect()}
    assert got == {i: t for i, _, t in made}
    assert html_extract.extract(df.limit(0), html_extract.train(df.limit(0))).count() == 0
