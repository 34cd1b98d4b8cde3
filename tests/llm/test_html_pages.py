"""Hand-written page forms, filled with four texts each, against their true
main texts. Outlines and texts are not those of training; common tags and class
words (comments, sidebar, newsletter) occur in both."""

from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import html_extract

# what begins with a bar is the main text of the page, line by line
FORMS = {
    "encyclopedia": """<div id="mw-page-base"></div><div id="siteSub"><a href="/">Main page</a> <a href="/r">Random</a></div>
        <div class="mw-parser-output">|<h1>{t}</h1>|<p>{a}</p>|<h2>Early years</h2>|<p>{b}</p><ul>|<li>{s}</li>|<li>{u}</li></ul>|<p>{c}</p></div>
        <footer id="footer"><ul><li><a href="/p">Privacy policy</a></li><li><a href="/d">Disclaimers</a></li></ul></footer>""",
    "news": """<header class="site-head"><nav><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
        <article itemprop="articleBody">|<h1>{t}</h1><figure><img src="x.jpg">|<figcaption>{s}</figcaption></figure>|<p>{a}</p><aside class="newsletter"><p>Sign up for our letter</p></aside>|<p>{b}</p>|<p>{c}</p></article>
        <section class="comments"><h3>2 comments</h3><p>I liked this one a lot</p></section><footer><p>&copy; 2023 The Paper</p></footer>""",
    "plain article": "<article>|<p>{a}</p>|<p>{b}</p>|<p>{c}</p></article>",
    "plain body": "|<h1>{t}</h1>|<p>{a}</p>|<p>{b}</p><hr>|<p>{c}</p>",
    "old table": """<table width=100%><tr><td class="navcol"><a href=a.htm>Home</a><br><a href=b.htm>Links</a></td></tr></table>
        <table width=600><tr><td><font face=arial>|<h2>{t}</h2>|<p>{a}|<p>{b}|<p>{c}</font></td></tr></table>""",
    "blog": """<div class="masthead"><h2><a href="/">My blog</a></h2></div><div class="post hentry">|<h2>{t}</h2>|<p>{a}</p>|<blockquote>{s}</blockquote>|<p>{b}</p>|<pre>{u}</pre>|<p>{c}</p></div>
        <div class="sidebar"><h3>Archives</h3><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div>""",
    "manual": """<nav class="toc"><ol><li><a href="#1">Install</a></li><li><a href="#2">Use</a></li></ol></nav><main id="doc">|<h1>{t}</h1>|<p>{a}</p><ol>|<li>{s}</li>|<li>{u}</li></ol>|<h2>Use</h2>|<p>{b}</p><dl>|<dt>{t}</dt>|<dd>{c}</dd></dl></main>""",
    "cookie wall": """<div class="cookie consent"><p>We use cookies to give you the best experience on our site.</p><button>Accept</button></div>
        <div role="main"><div>|<h1>{t}</h1>|<p>{a}</p>|<p>{s}</p>|<p>{b}</p></div></div><div class="related"><h4>More stories</h4><ul><li><a href="/x">Another one</a></li></ul></div>""",
    "data page": """<nav><a href="/">Start</a></nav><main>|<h1>{t}</h1>|<p>{a}</p><table><tr>|<th>{u}</th>|<th>{s}</th></tr><tr>|<td>1850</td>|<td>12 boats</td></tr></table>|<p>{b}</p></main><footer>Contact us</footer>""",
    "late notice": """<div class="wrap"><section>|<h1>{t}</h1>|<p>{a}</p>|<p>{b}</p>|<p>{c}</p></section></div><form class="search"><input name=q></form><div class="banner"><p>Subscribe now and save half the price</p></div>""",
}
TEXTS = [
    {"t": "The mill by the water", "s": "It turned until the frost came", "u": "Two stones and a wheel", "a": "The mill stood where the stream leaves the wood, and for a hundred years its wheel turned from the first thaw until the frost. People came from three villages with their corn, and nobody remembers a day when the door was shut.", "b": "When the road was built the carts went elsewhere. The miller kept the stones sharp all the same, and sold flour to those who still walked down the path.", "c": "Today a family lives there; the wheel is gone, but at night one can hear the water under the floor."},
    {"t": "How to repair a bicycle tyre", "s": "Lift the edge with two levers", "u": "Find the hole under water", "a": "Turn the bicycle over so that it rests on saddle and handlebar, open the brake and take the wheel out of the frame. Let all the air out before you begin, or the tyre will not come off its rim.", "b": "Dry the tube, roughen the place around the hole, and spread a thin layer of glue on it. Wait five minutes. Press the patch on as hard as you can.", "c": "Pump a little air into the tube before you put it back, so that it does not fold."},
    {"t": "Otters return", "s": "Tracks were seen in March", "u": "Count of young animals", "a": "After forty years without a sighting, otters have come back to the lower valley. Volunteers found tracks in the mud below the bridge in March, and a camera that was set up there has since shown an adult with two young.", "b": "The water is cleaner than it was, says the biologist who leads the count, and fish have followed. She asks walkers to keep dogs on the lead near the banks in spring.", "c": "A second count will take place in autumn. Everyone who wants to help can write to the office."},
    {"t": "Soup of roasted pumpkin", "s": "Half a kilo of pumpkin", "u": "One onion and some salt", "a": "Cut the pumpkin into slices, take the seeds out and roast the slices in a hot oven until their edges turn brown. This takes about half an hour and gives the soup most of its taste.", "b": "Meanwhile fry the onion slowly in butter, add water and salt, and let it boil. Scrape the pumpkin from its skin into the pot and stir until nothing is left of the pieces.", "c": "Serve it with bread and a spoon of cream; it is even better on the next day."},
]


def made(form: str, text: dict) -> tuple[str, str]:
    filled = form.format(**text)
    truth = []
    for part in filled.split("|")[1:]:
        inner = html_extract.blocks(part)
        truth.append(inner[0].text)
    return f"<!doctype html><html><head><title>{text['t']} - site</title></head><body>{filled.replace('|', '')}</body></html>", "\n\n".join(truth)


@pytest.fixture(scope="module")
def network(spark):
    return html_extract.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("name", list(FORMS))
def test_hand_written_pages(spark, network, name):
    scores = []
    for text in TEXTS:
        page, want = made(FORMS[name], text)
        parsed = html_extract.blocks(page)
        got = "\n\n".join(b.text for b, y in zip(parsed, network.predict(html_extract.features([parsed]))[0]) if y)
        a, b = Counter(got.split()), Counter(want.split())
        both = (a & b).total()
        scores.append(2 * both / (a.total() + b.total()))
    assert min(scores) >= 0.9, scores


def test_whole_page_is_one_sequence(network):
    page = "<html><body><nav><a href=/>x</a></nav><article>" + "".join(f"<p>{TEXTS[i % 4]['a']}</p>" for i in range(3000)) + "</article><footer>&copy; x</footer></body></html>"
    parsed = html_extract.blocks(page)
    got = network.predict(html_extract.features([parsed, parsed[:40]]))
    assert got[0].sum() == 3000 and not got[0][0] and not got[0][-1] and len(got[1]) == 40


def test_null_ids_and_repeats(spark, network):
    page, want = made(FORMS["plain article"], TEXTS[0])
    rows = [(None, "u", page), (1, None, page), (1, None, page), (2, "u", None)]
    got = [tuple(r) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), network).collect()]
    assert sorted(got, key=str) == sorted([(None, "u", want, len(want)), (1, None, want, len(want)), (1, None, want, len(want)), (2, "u", "", 0)], key=str)


def test_composed_labels():
    x, y = html_extract.composed(["one two three. four five six seven eight nine"] * 3, ["menu item"], np.random.default_rng(1))
    assert len(x) == len(y) and all(html_extract.MARK not in b.text for b in x)
