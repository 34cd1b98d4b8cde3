"""Main text of web pages: a bidirectional LSTM labels every leaf block.

A page becomes its sequence of leaf blocks (text between block-level tags).
A block's vector has its hashed tag path (names, classes and ids of the open
elements), its hashed words and a few densities; the recurrent network reads
the whole sequence in both directions, so every block is judged with the
context of the document. Scripts, styles, comments and the head are markup and
never blocks.

The network is trained here on two sorts of pages. ``sample`` pages of the table,
in the order of a hash of page_id and of at most ``MOST_TRAIN`` characters each,
are labelled by their containers (article, main; nav, header, footer, aside,
form, and class words such as ``ad``, ``menu``, ``comment``). ``composed`` pages
are put together from pieces of their texts, with the labels known: articles of
one to many parts (paragraphs long and short, headings, lists, quotations,
preformatted text, tables, figures, bare text) in all sorts of shells or in none,
with and without menus, notices, forms, sidebars and comments around and inside
them, and with class words often left out, so that context decides where tags
don't. All blocks of a page are read in one sequence, however long it is.

Edge cases: null, empty and text-free pages give empty text; unclosed and stray
tags are tolerated (an end tag closes up to its element, if that is open); an
unended comment or tag is dropped as markup; null and repeated page_ids are rows
like any other; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words

MOST_TRAIN = 60_000
STEPS = 1 << 17  # blocks, padding included, that are labelled at a time (a longer page comes alone)
MARK = "\ue000"  # begins the blocks of a composed page that belong to its article
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that an opening tag of the same kind, or a block, ends (a head
#: without an end tag by the first block that can't be in one).
SELF_CLOSING = {"p": BLOCK_TAGS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": BLOCK_TAGS - {"head", "html", "title", "noscript"}}
HOLDS = frozenset("article aside body blockquote div dl fieldset footer form header html main nav ol section table td th ul".split())
HIDDEN = frozenset("head script style noscript template svg iframe select button textarea".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|template|noscript|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(svg)\b(?:[^>]*[^/>])?>.*?(?:</svg\s*>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*(?:>|\Z)|[^<]+|<""",
    re.S | re.I,
)
NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Containers and class words that label training blocks.
GOOD = frozenset("article main".split())
BAD = frozenset("nav header footer aside form menu dialog".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
BAD_WORDS = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie copyright footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo related search share sidebar social sponsor sponsored subscribe toolbar widget".split())

PATHS, WORDS, DENSE, HIDDEN_UNITS = 64, 32, 16, 20
WIDTH = PATHS + WORDS + DENSE


class Block:
    __slots__ = ("text", "path", "linked", "size")

    def __init__(self, text, path, linked, size):
        self.text, self.path, self.linked, self.size = text, path, linked, size


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: text with references decoded and white space
    squeezed, tag path (features of the open elements), share of link text."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    hidden = 0

    def close():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                path = tuple(x for _, features in stack for x in features)
                out.append(Block(text, path, min(1.0, linked / max(1, len(text))), len(text)))
            parts.clear()
        linked = 0

    def pop(upto: int):
        nonlocal hidden
        while len(stack) > upto:
            name, _ = stack.pop()
            hidden -= name in HIDDEN

    for match in TOKEN.finditer(page):
        token = match.group()
        if token[0] != "<" or token == "<":
            if not hidden:
                parts.append(token)
                if any(name == "a" for name, _ in stack[-4:]):
                    linked += len(token.strip())
            continue
        named = NAME.match(token)
        skipped = match.group(1) or match.group(2)
        if skipped or named is None:
            if not token.startswith("<!") and skipped:
                parts.append(" ")
            continue
        name = named.group(1).lower()
        if token[1] == "/":
            if name in BLOCK_TAGS:
                close()
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == name:
                    pop(at)
                    break
                if stack[at][0] in HOLDS and name not in HOLDS:
                    break
            continue
        if name in BLOCK_TAGS:
            close()
            for at in range(len(stack) - 1, -1, -1):
                open_name = stack[at][0]
                if name in SELF_CLOSING.get(open_name, ()):
                    pop(at)
                    break
                if open_name in HOLDS:
                    break
        elif name == "br":
            parts.append(" ")
        if name in VOID or token.endswith("/>"):
            continue
        words = [w for groups in ATTRIBUTE.findall(token) for w in re.findall(r"[a-z]+", "".join(groups).lower())]
        stack.append((name, (f"<{name}", *[f".{w}" for w in words])))
        hidden += name in HIDDEN
    close()
    return out


def _bucket(feature: str, size: int, known: dict[str, int] = {}) -> int:
    if len(known) > 100_000:
        known.clear()
    if feature not in known:
        known[feature] = zlib.crc32(feature.encode())
    return known[feature] % size


def features(pages: list[list[Block]]) -> list[np.ndarray]:
    """One matrix (blocks x WIDTH) for each page."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), WIDTH), np.float32)
    if flat:
        for i, b in enumerate(flat):
            for x in set(b.path):
                out[i, _bucket(x, PATHS)] = 1
        for at in range(0, len(flat), 2000):
            words = Words([b.text.encode() for b in flat[at : at + 2000]])
            bucket = (words.key >> np.uint64(40)).astype(np.int64) % WORDS
            size = min(2000, len(flat) - at)
            count = np.bincount(words.doc * WORDS + bucket, minlength=size * WORDS).reshape(size, WORDS)
            out[at : at + size, PATHS : PATHS + WORDS] = count / np.maximum(1, words.count)[:, None] ** 0.5 * 0.3
        at = PATHS + WORDS
        length = np.array([b.size for b in flat], float)
        out[:, at] = np.log1p(length) / 8
        out[:, at + 1] = [b.linked for b in flat]
        out[:, at + 2] = [sum(map(b.text.count, ".,!?;")) / b.size for b in flat]
        out[:, at + 3] = length < 25
        out[:, at + 4] = length > 120
        out[:, at + 5] = [b.path[-1:] == ("<p",) for b in flat]
        out[:, at + 6] = ["\xa9" in b.text for b in flat]
        out[:, at + 7] = [min(1.0, len(b.path) / 10) for b in flat]
        names = [{x[1:] for x in b.path if x[0] == "<"} for b in flat]
        out[:, at + 12] = [bool(x & GOOD) for x in names]
        out[:, at + 13] = [bool(x & BAD) for x in names]
        out[:, at + 14] = [any(x[0] == "." and x[1:] in BAD_WORDS for x in b.path) for b in flat]
        out[:, at + 15] = [any(x[0] == "." and x[1:] in GOOD_WORDS for x in b.path) for b in flat]
        k = 0
        for page in pages:
            n = len(page)
            place = np.arange(n) / max(1, n)
            out[k : k + n, at + 8], out[k : k + n, at + 9] = place, np.arange(n) < 3
            out[k : k + n, at + 10] = np.arange(n) >= n - 2
            out[k : k + n, at + 11] = 1
            k += n
    cut = np.cumsum([0] + [len(p) for p in pages])
    return [out[a:b] for a, b in zip(cut[:-1], cut[1:])]


def weak_labels(page: list[Block]) -> np.ndarray:
    """1 for blocks inside article or main and inside nothing unwanted."""
    out = []
    for b in page:
        names = {x[1:] for x in b.path if x[0] == "<"}
        words = {x[1:] for x in b.path if x[0] == "."}
        out.append(bool(names & GOOD) and not names & BAD and not words & BAD_WORDS)
    return np.array(out, np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Bidirectional LSTM with a logistic output for every block."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        h = HIDDEN_UNITS
        self.p = {}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, 0.15, (WIDTH, 4 * h))
            self.p["U" + d] = rng.normal(0, 0.15, (h, 4 * h))
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["V"] = rng.normal(0, 0.15, 2 * h)
        self.p["v"] = np.zeros(1)

    def _pass(self, x, mask, d, learning=True):
        """Hidden states (T x B x h) and what the way back needs when learning."""
        t, b, _ = x.shape
        h = HIDDEN_UNITS
        wide = x @ self.p["W" + d] + self.p["c" + d]
        state, cell = np.zeros((b, h)), np.zeros((b, h))
        states = np.zeros((t, b, h))
        kept = []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = wide[k] + state @ self.p["U" + d]
            i, f, o = (_sigmoid(z[:, j * h : (j + 1) * h]) for j in range(3))
            g = np.tanh(z[:, 3 * h :])
            m = mask[k][:, None]
            new = f * cell + i * g
            th = np.tanh(new)
            if learning:
                kept.append((k, i, f, o, g, cell, th, state, m))
            state, cell = m * (o * th) + (1 - m) * state, m * new + (1 - m) * cell
            states[k] = state
        return states, kept

    def forward(self, x, mask, learning=True):
        f, kf = self._pass(x, mask, "f", learning)
        b, kb = self._pass(x, mask, "b", learning)
        both = np.concatenate([f, b], 2)
        return _sigmoid(both @ self.p["V"] + self.p["v"]), both, kf, kb

    def gradient(self, x, mask, y):
        out, both, kf, kb = self.forward(x, mask)
        h = HIDDEN_UNITS
        d = (out - y) * mask / mask.sum()
        g = {"V": np.einsum("tb,tbh->h", d, both), "v": np.array([d.sum()])}
        back = d[:, :, None] * self.p["V"]
        for way, kept in (("f", kf), ("b", kb)):
            part = back[:, :, :h] if way == "f" else back[:, :, h:]
            gw, gu, gc = (np.zeros_like(self.p[n + way]) for n in "WUc")
            ds, dc = np.zeros(part.shape[1:]), np.zeros(part.shape[1:])
            for k, i, f, o, c, cell, th, state, m in reversed(kept):
                ds = ds + part[k]
                do, dn = m * ds * th, m * (ds * o * (1 - th**2)) + m * dc
                dz = np.concatenate([dn * c * i * (1 - i), dn * cell * f * (1 - f), do * o * (1 - o), dn * i * (1 - c**2)], 1)
                gw += x[k].T @ dz
                gu += state.T @ dz
                gc += dz.sum(0)
                ds = dz @ self.p["U" + way].T + (1 - m) * ds
                dc = dn * f + (1 - m) * dc
            g["W" + way], g["U" + way], g["c" + way] = gw, gu, gc
        loss = -(mask * (y * np.log(out + 1e-9) + (1 - y) * np.log(1 - out + 1e-9))).sum() / mask.sum()
        return loss, g

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int, batch: int = 24, rate: float = 0.01, seed: int = 5):
        rng = np.random.default_rng(seed)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            by = np.argsort([len(p) + rng.random() * 8 for p in pages], kind="stable")
            groups = [by[a : a + batch] for a in range(0, len(by), batch)]
            for k in rng.permutation(len(groups)):
                x, mask = padded([pages[i] for i in groups[k]])
                y = np.zeros(mask.shape)
                for j, i in enumerate(groups[k]):
                    y[: len(labels[i]), j] = labels[i]
                _, g = self.gradient(x, mask, y)
                step += 1
                norm = np.sqrt(sum((v**2).sum() for v in g.values()))
                for name, v in g.items():
                    v = v * min(1.0, 5 / (norm + 1e-9))
                    m[name][0] = 0.9 * m[name][0] + 0.1 * v
                    m[name][1] = 0.99 * m[name][1] + 0.01 * v**2
                    self.p[name] = self.p[name] - rate * (m[name][0] / (1 - 0.9**step)) / (np.sqrt(m[name][1] / (1 - 0.99**step)) + 1e-8)
        return self

    def predict(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block belongs to the main text."""
        out = [np.zeros(len(p), bool) for p in pages]
        by = [i for i in np.argsort([len(p) for p in pages], kind="stable").tolist() if len(pages[i])]
        while by:
            n = 1
            while n < min(len(by), 128) and (n + 1) * len(pages[by[-1]]) <= STEPS:
                n += 1
            part, by = by[-n:], by[:-n]
            x, mask = padded([pages[i] for i in part])
            y = self.forward(x, mask, False)[0]
            for j, i in enumerate(part):
                out[i] = y[: len(pages[i]), j] > 0.5
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in pages)
    x, mask = np.zeros((t, len(pages), WIDTH), np.float32), np.zeros((t, len(pages)))
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


SHELLS = (
    [("<article>", "</article>")] * 5
    + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div role="main">', "</div>"), ("<section>", "</section>"), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("", "")]
    + [(f'<div class="{c}">', "</div>") for c in ("content", "post", "entry content", "story", "text", "page", "main", "article body", "x wide", "col left")]
    + [(f'<div id="{c}"><div class="row">', "</div></div>") for c in ("content", "main", "wrap", "post")]
    + [("<table><tr><td>", "</td></tr></table>"), ("<center><table><tr><td><font>", "</font></td></tr></table></center>")]
)
AROUND = {
    "menu": ("<nav>{}</nav>", "<header><nav>{}</nav></header>", '<div class="menu">{}</div>', '<div class="header navbar">{}</div>', '<div id="nav">{}</div>', "<div>{}</div>"),
    "notice": ('<div class="cookie">{}</div>', '<div class="notice">{}</div>', '<div class="banner">{}</div>', '<div class="newsletter">{}</div>', '<dialog class="popup">{}</dialog>', '<div class="consent modal">{}</div>', '<div class="ad">{}</div>', '<div class="advert sponsored">{}</div>', "<form>{}</form>", '<form class="subscribe">{}</form>', '<div class="promo">{}</div>'),
    "side": ("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div class="widget">{}</div>', '<section class="related">{}</section>', '<div id="sidebar">{}</div>', '<div class="share social">{}</div>'),
    "talk": ('<section class="comments">{}</section>', '<div class="comment">{}</div>', '<div id="comments">{}</div>', '<ol class="commentlist">{}</ol>', '<div class="comments area">{}</div>'),
    "end": ("<footer>{}</footer>", '<div class="footer">{}</div>', '<footer class="site">{}</footer>', '<div id="footer">{}</div>', '<div class="copyright">{}</div>'),
}


def composed(prose: list[str], other: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A made page, parsed as any page, and the labels of its blocks."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p

    def words(low, high, source=None):
        n, text = int(rng.integers(low, high + 1)), pick(source or prose).split()
        while len(text) < n:
            text = text + pick(source or prose).split()
        at = int(rng.integers(0, len(text) - n + 1))
        return entities.escape(" ".join(text[at : at + n]))

    good = lambda low, high: MARK + words(low, high)
    row = lambda tag, n, low, high: "".join(f"<{tag}>{good(low, high)}</{tag}>" for _ in range(n))

    def part(kind):
        few = int(rng.integers(2, 6))
        if kind == "p":
            return f"<p>{good(*pick(((20, 120), (20, 120), (5, 30), (1, 8))))}</p>"
        if kind == "head":
            return row(pick(("h2", "h3", "h4")), 1, 1, 9)
        if kind == "list":
            tag = pick(("ul", "ol"))
            return f"<{tag}>{row('li', few, 1, 25)}</{tag}>"
        if kind == "quote":
            return f"<blockquote>{row('p', 1, 5, 60)}</blockquote>" if chance(0.6) else row("blockquote", 1, 5, 60)
        if kind == "table":
            return f"<table>{''.join(f'<tr>{row("td", 2, 1, 12)}</tr>' for _ in range(few))}</table>"
        if kind == "figure":
            return f'<figure><img src="x"><figcaption>{good(2, 20)}</figcaption></figure>'
        if kind == "terms":
            return f"<dl>{''.join(row('dt', 1, 1, 4) + row('dd', 1, 3, 25) for _ in range(few))}</dl>"
        return row({"pre": "pre", "div": "div", "section": "section"}[kind], 1, 5, 80)

    kinds = ["p"] * 10 + ["head", "head", "list", "list", "quote", "pre", "table", "figure", "div", "terms"]
    links = lambda n: "".join(f'<li><a href="/x">{words(1, 4, other)}</a></li>' for _ in range(n))

    def around(kind):
        some = int(rng.integers(1, 6))
        if kind == "menu":
            return pick(AROUND[kind]).format(f"<ul>{links(some + 1)}</ul>" if chance(0.8) else "".join(f'<a href="/">{words(1, 3, other)}</a> ' for _ in range(some)))
        if kind == "side" and chance(0.5):
            return pick(AROUND[kind]).format(f"<h3>{words(1, 4, other)}</h3><ul>{links(some)}</ul>")
        if kind == "end":
            return pick(AROUND[kind]).format(pick((f"<p>&copy; 2024 {words(1, 12, other)}</p>", f"&copy; {words(1, 6, other)}", f"<ul>{links(some)}</ul><p>{words(3, 20, other)}</p>")))
        tag = pick(("p", "div", "li")) if kind == "talk" else pick(("p", "p", "div", "span"))
        source = prose if kind == "talk" or chance(0.5) else other
        return pick(AROUND[kind]).format("".join(f"<{tag}>{words(2, 60 if kind == 'talk' else 25, source)}</{tag}>" for _ in range(min(some, 3))))

    parts = [part(pick(kinds)) for _ in range(int(rng.integers(1, pick((3, 8, 14)))))]
    if chance(0.2):
        parts = [f"<p>{good(*pick(((30, 120), (60, 200))))}</p>" for _ in range(int(rng.integers(1, 5)))]
    if chance(0.55):
        parts.insert(0, f"<h1>{good(1, 12)}</h1>" if chance(0.8) else f"<header><h1>{good(1, 12)}</h1></header>")
    if chance(0.3):
        parts.insert(int(rng.integers(0, len(parts) + 1)), around(pick(("notice", "side", "notice"))))
    if chance(0.2):
        parts.append(around(pick(("talk", "side"))))
    shell = pick(SHELLS)
    page = [shell[0], *parts, shell[1]]
    bare = chance(0.2)  # nothing but the article
    for kind, p, before in (("notice", 0.3, True), ("menu", 0.6, True), ("side", 0.3, False), ("talk", 0.35, False), ("notice", 0.25, False), ("end", 0.6, False)):
        if not bare and chance(p):
            page = [around(kind), *page] if before else [*page, around(kind)]
    body = "".join(page)
    if chance(0.2):
        body = f'<div class="{pick(("wrap", "page", "container", "site"))}">{body}</div>'
    found = blocks(f"<html><head><title>{words(1, 6)}</title></head><body>{body}</body></html>")
    label = np.array([b.text.startswith(MARK) for b in found], np.float32)
    return [Block(b.text.replace(MARK, ""), b.path, b.linked, len(b.text.replace(MARK, ""))) for b in found], label


def train(pages: DataFrame, sample: int = 300, made: int = 1200, epochs: int = 6) -> Network:
    """Fit on a bounded sample of pages and ``made`` composed ones."""
    fit = pages.where(F.col("html").isNotNull() & (F.length("html") <= MOST_TRAIN)).select("page_id", "html")
    order = [F.xxhash64("page_id"), "page_id"]
    # ids first, so that no task sends pages that aren't chosen
    ids = pages.sparkSession.createDataFrame(fit.select("page_id").orderBy(*order).limit(sample).collect(), fit.select("page_id").schema).distinct()
    some = fit.join(F.broadcast(ids), fit.page_id.eqNullSafe(ids.page_id), "left_semi").orderBy(*order, "html").limit(sample).collect()
    parsed = [x for x in (blocks(r["html"]) for r in some) if x]
    network = Network()
    if not parsed:
        return network
    labels = [weak_labels(page) for page in parsed]
    flat = [(b.text, y) for page, label in zip(parsed, labels) for b, y in zip(page, label)]
    prose = [t for t, y in flat if y and len(t) > 80][:5000] or [t for t, _ in flat][:5000]
    other = [t for t, y in flat if not y][:5000] or prose
    rng = np.random.default_rng(17)
    examples = [composed(prose, other, rng) for _ in range(made)]
    xs, ys = [*parsed, *[x for x, _ in examples if x]], [*labels, *[y for x, y in examples if x]]
    return network.fit(features(xs), ys, epochs)


def extract(pages: DataFrame, network: Network) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            html = batch.column("html").to_pylist()
            at = 0
            while at < len(html):
                end, size = at, 0
                while end < len(html) and (end == at or size + len(html[end] or "") <= 1 << 20):
                    size += len(html[end] or "")
                    end += 1
                parsed = [blocks(h or "") for h in html[at:end]]
                chosen = shared.value.predict(features(parsed))
                text = ["\n\n".join([b.text for b, y in zip(page, good) if y]) for page, good in zip(parsed, chosen)]
                part = batch.slice(at, end - at)
                yield pa.record_batch([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])
                at = end

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
