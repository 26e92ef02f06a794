"""Main text of web pages: a recurrent labeller reads a page's blocks and keeps the article's.

A page is cut into leaf blocks, each with its tag path. A bidirectional LSTM reads the
blocks' vectors (hashed path names, hashed words, a few measures) in page order and labels
each block with the whole page as context. It is trained here: on a bounded sample of the
pages whose markup names their article, and on made layouts of the same blocks, in which
menus, notices, forms, comments and the like stand in changing markup.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import prepare

#: The most pages (and characters of one) that the labeller is trained on, and made layouts.
TRAIN_PAGES, TRAIN_CHARS, LAYOUTS = 160, 100_000, 720
PATH, WORDS, MEASURES, HIDDEN = 128, 32, 10, 24
#: Blocks of a page from which it is labelled by itself, a run of blocks at a time.
LONG = 8192
WIDTH = PATH + 48 + WORDS + MEASURES

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)>|<[!?/][^>]*>""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
#: Elements that hold no text of the page, and elements that begin and end a block.
SKIPPED = frozenset("script style template noscript iframe object svg select textarea title head button canvas audio video".split())
BLOCKS = frozenset("""html body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot
tr td th caption blockquote pre form fieldset figure figcaption address details summary hr center dialog menu search label""".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements that an opening tag of the key closes.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class Path:
    """Names from a page's root to an element: linked to the parent's, with what features and marks need of them all, so depth costs no more."""

    __slots__ = ("parent", "names", "slots", "tail", "body", "aside", "form")

    def __init__(self, parent: Path | None = None, names: tuple[str, ...] = ()):
        self.parent, self.names = parent, names
        # bits of the hashed names, last three names, article or main among the names; names beside it (since the last such), a form
        self.slots, self.tail, self.body, self.aside, self.form = (parent.slots, parent.tail, parent.body, parent.aside, parent.form) if parent else (0, (), False, False, False)
        for n in names:
            self.slots |= 1 << _slot(n, PATH, 1)
            if n in ("article", "main"):
                self.body, self.aside = True, False
            self.aside = self.aside or n.removeprefix(".") in ASIDE
            self.form = self.form or n == "form"
        self.tail = (*self.tail, *names[-3:])[-3:]

    def __iter__(self):
        links, at = [], self
        while at is not None:
            links.append(at.names)
            at = at.parent
        return (n for names in reversed(links) for n in names)

    def __getitem__(self, at):
        return tuple(self)[at]

    def __eq__(self, other):
        return tuple(self) == tuple(other)

    __hash__ = None


def leaf_blocks(html: str) -> list[tuple[Path, str, float]]:
    """A page's leaf blocks in order: path names, text (references decoded, white space as one space), share in links.

    Broken markup is read as browsers do in the main: unknown and unclosed tags are let be, an
    unclosed comment or script runs to the end.
    """
    out: list[tuple[Path, str, float]] = []
    root = Path()
    stack: list[tuple[str, Path]] = []
    held: list[str] = []
    linked, in_link, pos = 0, 0, 0

    def close_block():
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((stack[-1][1] if stack else root, text, min(1.0, linked / len(text))))
            held.clear()
            linked = 0

    while True:
        m = _TOKEN.search(html, pos)
        data = html[pos : m.start() if m else len(html)]
        if data:
            held.append(data)
            if in_link:
                linked += len(data)
        if not m:
            break
        pos = m.end()
        if not m[2]:
            continue
        name, end = m[2].lower(), bool(m[1])
        if name in SKIPPED:
            if not end and not m[3].endswith("/"):
                closing = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, pos)
                if name == "head":  # an unclosed head ends where the body begins
                    closing = closing or re.compile(r"(?=<body\b)", re.I).search(html, pos)
                if closing:
                    pos = closing.end()
                elif name in ("script", "style"):
                    break
            if name not in ("button", "svg"):
                held.append(" ")
        elif name in BLOCKS:
            close_block()
            if end:
                if any(x[0] == name for x in stack):
                    while stack.pop()[0] != name:
                        pass
                in_link = 0
            elif name not in VOID:
                if shut := _CLOSES.get(name):
                    while stack and stack[-1][0] in shut:
                        stack.pop()
                names = _PART.findall(" ".join(x for g in _NAMES.findall(m[3]) for x in g).lower()) if m[3] else []
                stack.append((name, Path(stack[-1][1] if stack else root, (name, *("." + n for n in names)))))
        elif name == "a":
            in_link = 0 if end else 1
        elif name == "br":
            held.append(" ")
    close_block()
    return out


_slots: dict[tuple[str, int, int], int] = {}


def _slot(word: str, size: int, salt: int) -> int:
    known = _slots.get((word, size, salt))
    if known is None:
        if len(_slots) > 200_000:
            _slots.clear()
        known = _slots[word, size, salt] = zlib.crc32(word.encode("utf-8", "replace"), salt) % size
    return known


def block_vectors(blocks: list[tuple[Path | tuple[str, ...], str, float]], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row for each block: path names, the last element's names, words, measures; ``first`` blocks of ``total`` stand before them."""
    total = total or len(blocks)
    x = np.zeros((len(blocks), WIDTH), np.float32)
    for i, (path, text, links) in enumerate(blocks):
        row = x[i]
        path = path if isinstance(path, Path) else Path(None, path)
        row[:PATH] = np.unpackbits(np.frombuffer(path.slots.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")
        for name in path.tail:
            row[PATH + _slot(name, 48, 2)] = 1
        words = text.lower().split()
        at = PATH + 48
        row[at : at + WORDS] = np.bincount([_slot(w, WORDS, 3) for w in words], minlength=WORDS) / len(words)
        n = len(text)
        row[at + WORDS :] = (min(1.0, np.log1p(n) / 8), min(1.0, np.log1p(len(words)) / 6), links, min(1.0, n / len(words) / 12),
                             (text.count(",") + text.count(".")) / len(words), text[-1] in ".!?", "©" in text or "·" in text, text[0].isupper(),
                             (first + i) / total, 1 / total)
    return x


class BiLstm:
    """Two LSTMs, one in page order and one against it, and a logistic output on both states."""

    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)
        scale = 1 / np.sqrt(HIDDEN)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = random.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p["U" + d] = random.normal(0, scale, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember, at first
            self.p["c" + d] = bias
        self.p["o"] = random.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    def _direction(self, x, on, d, train=True, state=None):
        """States of one direction, what the gradients need of each step (when training), and the last state."""
        steps, rows = x.shape[:2]
        h, c = state or (np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32))
        u, z0, keep = self.p["U" + d], x @ self.p["W" + d] + self.p["c" + d], []
        states = np.zeros((steps, rows, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z0[t] + h @ u
            g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, n = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            live = on[t][:, None]
            c_new = np.where(live, f * c + i * n, c)
            tanh = np.tanh(c_new)
            h_new = np.where(live, o * tanh, h)
            if train:
                keep.append((t, i, f, o, n, c, tanh, h))
            h, c = h_new, c_new
            states[t] = h
        return states, keep, (h, c)

    def logits(self, x, on, train=False):
        """Logit of each block of padded pages (steps, pages, WIDTH)."""
        (hf, kf, _), (hb, kb, _) = self._direction(x, on, "f", train), self._direction(x, on, "b", train)
        both = np.concatenate([hf, hb], 2)
        z = both @ self.p["o"] + self.p["ob"][0]
        return (z, both, kf, kb) if train else z

    def gradients(self, x, on, y):
        z, both, kf, kb = self.logits(x, on, True)
        dz = np.where(on, 1 / (1 + np.exp(-z)) - y, 0).astype(np.float32) / on.sum()
        g = {"o": np.einsum("tb,tbh->h", dz, both), "ob": np.array([dz.sum()], np.float32)}
        for d, keep, part in (("f", kf, slice(0, HIDDEN)), ("b", kb, slice(HIDDEN, 2 * HIDDEN))):
            u, gz = self.p["U" + d], np.zeros((*on.shape, 4 * HIDDEN), np.float32)
            gu = np.zeros_like(u)
            dh, dc = np.zeros_like(keep[0][7]), np.zeros_like(keep[0][7])
            for t, i, f, o, n, c, tanh, h in reversed(keep):
                live = on[t][:, None]
                dh = dh + dz[t][:, None] * self.p["o"][part]
                do, dct = np.where(live, dh * tanh, 0), np.where(live, dh * o * (1 - tanh**2), 0) + dc
                step = np.concatenate([dct * n * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - n**2)], 1) * live
                gz[t] = step
                gu += h.T @ step
                dh = np.where(live, step @ u.T, dh)
                dc = np.where(live, dct * f, dc)
            g["U" + d], g["c" + d] = gu, gz.sum((0, 1))
            g["W" + d] = np.tensordot(x, gz, ((0, 1), (0, 1)))
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 14, seed: int = 3) -> BiLstm:
        """Adam over batches of pages of like length."""
        random = np.random.default_rng(seed)
        pages = sorted(pages, key=lambda p: len(p[1]))
        batches = [_padded([p[0] for p in pages[a : a + 32]], [p[1] for p in pages[a : a + 32]]) for a in range(0, len(pages), 32)]
        m, v, step = {k: 0 for k in self.p}, {k: 0 for k in self.p}, 0
        for _ in range(rounds if pages else 0):
            for b in random.permutation(len(batches)):
                step += 1
                for k, g in self.gradients(*batches[b]).items():
                    g = np.clip(g, -1, 1)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and b - a < 256 and len(pages[order[b]]) * (b - a + 1) <= 8192:
                b += 1
            x, on, _ = _padded([pages[i] for i in order[a:b]])
            z = self.logits(x, on)
            for k, i in enumerate(order[a:b]):
                out[i] = z[: len(pages[i]), k] > 0
            a = b
        return out


    def label_long(self, blocks: list[tuple[Path, str, float]], step: int = 4096) -> np.ndarray:
        """As ``label`` for one page of any length: a run of blocks at a time is made into vectors, forwards and then backwards."""
        n = len(blocks)
        z = np.full(n, self.p["ob"][0], np.float32)
        starts = range(0, n, step)
        for d, part, order in (("f", slice(0, HIDDEN), starts), ("b", slice(HIDDEN, 2 * HIDDEN), reversed(starts))):
            state = None
            for a in order:
                x = block_vectors(blocks[a : a + step], a, n)[:, None]
                h, _, state = self._direction(x, np.ones(x.shape[:2], bool), d, False, state)
                z[a : a + step] += h[:, 0] @ self.p["o"][part]
        return z > 0


def _padded(xs, ys=None):
    steps = max(len(x) for x in xs)
    x, on, y = np.zeros((steps, len(xs), WIDTH), np.float32), np.zeros((steps, len(xs)), bool), np.zeros((steps, len(xs)), np.float32)
    for k, rows in enumerate(xs):
        x[: len(rows), k], on[: len(rows), k] = rows, True
        if ys is not None:
            y[: len(rows), k] = ys[k]
    return x, on, y


#: Names that mark parts that are no article, and names that mark an article's.
ASIDE = frozenset("""nav menu header footer aside sidebar ad ads advert banner promo sponsor sponsored cookie consent notice alert popup modal form search login
signup subscribe newsletter comment comments reply respond disqus related share social breadcrumb breadcrumbs pagination copyright widget tags""".split())
BODY = frozenset("article main content post entry story text".split())


def marked(path: Path | tuple[str, ...]) -> bool | None:
    """Whether a path's names say article (True) or something beside it (False); None if they say neither."""
    path = path if isinstance(path, Path) else Path(None, path)
    if not path.body:
        return False if path.aside else None
    return not path.aside and not path.form


def _own_names(random) -> list[str]:
    """Own names of a site's parts: syllables that say nothing."""
    return ["." + "".join(_SYLLABLES[int(random.integers(len(_SYLLABLES)))] for _ in range(int(random.integers(2, 4)))) for _ in range(6)]


def _other_words(random, texts: list[str], links: list[str]) -> tuple[list[str], list[str]]:
    """A page's sentences and links: the given ones, or others (of made words, or of words of the parts beside articles),
    so that the labeller trusts markup, measures and neighbours more than the words that it happens to be trained with."""
    kind = random.random()
    if kind < 0.4:
        return texts, links
    if kind < 0.7:
        pool = ["".join(_SYLLABLES[k] for k in random.integers(len(_SYLLABLES), size=random.integers(1, 4))) for _ in range(60)]
    else:
        pool = [w.strip(".,!?©·").lower() or "a" for own in _TEXTS.values() for t in own for w in t.split()]

    def said(a, b, end):
        return (" ".join(pool[k] for k in random.integers(len(pool), size=random.integers(a, b))) + end).capitalize()

    return [said(4, 60, pick_end) for pick_end in [".", ".", ".", "?", ""] * 8], [said(1, 4, "") for _ in range(12)]


_SYLLABLES = "ka lo mi ru te sa ve no bu dri fel gor hin jas".split()
#: Texts of parts that are no article, as pages have them.
_TEXTS = {
    "notice": ["We use cookies to improve this site.", "Accept all", "This site uses cookies, by going on you agree.", "Notice: terms have changed.",
               "By using this website you accept our privacy policy and cookies.", "Please allow notifications.", "We value your privacy. Manage your choices or accept.", "Got it"],
    "form": ["Subscribe to our newsletter", "Your email address", "Search this site", "Log in", "Send", "Leave a reply", "Sign up for free", "Name", "Submit"],
    "ad": ["Advertisement", "Sponsored", "Buy now and save", "Special offer for you", "Ad", "Limited time offer, shop today!"],
    "footer": ["© 2024 All rights reserved.", "Terms of use · Privacy policy", "Contact us", "Copyright 2021 by the publisher. All rights reserved.", "© The site and its authors"],
    "comments": ["3 comments", "Reply", "Posted by a reader", "Report", "Great post, thanks for sharing!", "I disagree with this.", "anna says:", "12 replies", "Like", "user42 wrote on Monday", "Thanks, this helped me a lot.", "2 hours ago"],
}


def made_layouts(texts: list[str], links: list[str], n: int, seed: int = 9):
    """Pages of made markup around given sentences: (blocks, whether each is main text).

    Articles hold all kinds of blocks: headings, paragraphs, lists, definitions, tables, code,
    figures, quotations. Beside and within them stand the parts that are no article, under names
    that tell and (comments, notices) under names that tell nothing.
    """
    random = np.random.default_rng(seed)
    pick = lambda xs: xs[int(random.integers(len(xs)))]
    texts, links = texts or ["some words of an article, as they come."], links or ["home", "about"]
    wrap = {"nav": [("nav", "ul", "li"), ("div", ".menu", "ul", "li"), ("header", "nav", "ul", "li"), ("div", ".nav", "ul", "li"), ("ul", ".breadcrumb", "li")],
            "header": [("header",), ("div", ".header"), ("header", "div"), ("div", ".site", ".header", "p"), ("header", "p")],
            "ad": [("div", ".ad"), ("div", ".ads"), ("aside", ".advert"), ("div", ".banner"), ("div", ".promo", "p"), ("div", ".sponsored", "p")],
            "notice": [("div", ".cookie", ".notice"), ("div", ".consent", "p"), ("div", ".alert"), ("section", ".notice", "p"), ("div", ".popup", "p"), ("div", ".cookie", ".banner", "p")],
            "sidebar": [("aside", "ul", "li"), ("div", ".sidebar", "ul", "li"), ("aside", "p"), ("div", ".sidebar", "p"), ("div", ".related", "ul", "li"), ("aside", "div", ".widget", "p")],
            "form": [("form",), ("form", "p"), ("div", ".newsletter", "form"), ("section", ".subscribe", "form", "p"), ("form", "label")],
            "comments": [("section", ".comments", "p"), ("div", ".comments", "div", ".comment", "p"), ("div", ".comment", "p"), ("ol", ".comments", "li", ".comment", "p"),
                         ("section", ".comments", "article", ".comment", "p"), ("div", ".respond", "p")],
            "footer": [("footer",), ("footer", "p"), ("div", ".footer"), ("div", ".copyright"), ("footer", "ul", "li")]}
    hold = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("div", ".entry", ".content"), ("div", ".article", ".body"), ("section", ".story"), ("div", ".main", "article"), ("div", ".text"), ("div",), ()]

    def beside(kind, top, names):
        path, out = top + pick(wrap[kind]), []
        hidden = kind in ("comments", "notice") and random.random() < 0.5
        if hidden:  # under names that tell nothing: a part of its own, of likewise named items
            path = top + pick([("div", pick(names)), ("section", pick(names)), ("div", pick(names), "div", pick(names))]) + pick([("p",), ("div", pick(names)), ("div", pick(names), "p"), ()])
        short = kind == "nav" or "li" in path
        for _ in range(int(random.integers(2, 8)) if short or kind == "comments" else int(random.integers(1, 4))):
            if short and kind != "comments":
                out.append((path, pick(links), float(random.random() < 0.85)))
            else:
                own = kind in _TEXTS and random.random() < (0.75 if hidden else 0.5)
                out.append((path, pick(_TEXTS[kind]) if own else pick(texts)[: int(random.integers(20, 200)) if hidden else None], 0.0))
        return out

    def passage(inner):
        """Some blocks of an article of one kind."""
        words = lambda a, b: pick(texts)[: int(random.integers(a, b))].strip() or "words"
        many = lambda a, b: range(int(random.integers(a, b)))
        kind = random.random()
        if kind < 0.62:
            return [(inner + ("p",), pick(texts) if random.random() < 0.85 else words(8, 60), 0.0 if random.random() < 0.9 else 0.3)]
        if kind < 0.70:
            return [(inner + (pick(["h2", "h2", "h3", "h4"]),), words(8, 60), 0.0)]
        if kind < 0.78:
            return [(inner + (pick(["ul", "ul", "ol"]), "li"), words(10, 120), 0.0 if random.random() < 0.9 else 0.5) for _ in many(2, 7)]
        if kind < 0.87:
            rows = pick([("table", "tr"), ("table", "tbody", "tr"), ("figure", "table", "tr"), ("div", ".table", "table", "tr")])
            head = [(inner + (*rows, "th"), words(3, 20), 0.0) for _ in many(0, 4)]
            caption = [(inner + ("table", "caption"), words(10, 60), 0.0)] if random.random() < 0.3 else []
            return caption + head + [(inner + (*rows, "td"), pick([words(2, 30), str(int(random.integers(1, 9999)))]), 0.0) for _ in many(2, 13)]
        if kind < 0.91:
            return [(inner + pick([("pre",), ("pre", ".code"), ("div", ".highlight", "pre")]), pick(["x = f(1)", "for i in items: print(i)", "git commit -m a", words(20, 200)]), 0.0)]
        if kind < 0.95:
            return [(inner + pick([("figure", "figcaption"), ("figure", ".image", "figcaption"), ("div", ".caption")]), words(10, 90), 0.0)]
        if kind < 0.98:
            return [(inner + pick([("blockquote", "p"), ("blockquote",)]), words(20, 300), 0.0)]
        return [(inner + ("dl", k), words(5, 80), 0.0) for _ in many(1, 4) for k in ("dt", "dd")]

    given = texts, links
    for _ in range(n):
        texts, links = _other_words(random, *given)
        names = _own_names(random)
        top = pick([("html", "body"), ("body",), ("html", "body", "div"), ("html", "body", "div", ".wrapper"), ("html", "body", "div", ".page"), ("html", "body", "div", pick(names))])
        before = [k for k in ("notice", "header", "nav", "ad", "form", "sidebar") if random.random() < (0.8 if k == "nav" else 0.35)]
        after = [k for k in ("ad", "comments", "form", "sidebar", "footer", "notice") if random.random() < (0.8 if k == "footer" else 0.35)]
        blocks, y = [], []
        for k in before:
            new = beside(k, top, names)
            blocks, y = blocks + new, y + [0] * len(new)
        inner = top + pick(hold) + (pick([(), (), (), ("div", pick(names))]))
        main = [[(inner + (pick(["h1", "h1", "h2"]),), pick(links) if random.random() < 0.3 else pick(texts)[:70], 0.0)]] if random.random() < 0.9 else []
        main += [passage(inner) for _ in range(int(random.integers(1, 11)))]
        within = {int(random.integers(1, len(main) + 1)) for _ in range(int(random.random() < 0.45) + int(random.random() < 0.15))}
        for i, own in enumerate(main, 1):
            blocks, y = blocks + own, y + [1] * len(own)
            if i in within:
                new = beside(pick(["ad", "form", "sidebar", "notice", "notice"]), inner, names)
                blocks, y = blocks + new, y + [0] * len(new)
        if random.random() < 0.2:  # a line of rights at the article's end
            blocks, y = [*blocks, (inner + pick([("p",), ("div", ".copyright"), ("small",), ("p", pick(names))]), pick(_TEXTS["footer"][:1] + _TEXTS["footer"][3:]), 0.0)], [*y, 0]
        for k in after:
            new = beside(k, inner if k == "comments" and random.random() < 0.4 else top, names)
            blocks, y = blocks + new, y + [0] * len(new)
        yield blocks, np.array(y, np.float32)


def fit(pages: DataFrame, html_col: str = "html") -> BiLstm:
    """A labeller for these pages.

    Trains on the ``TRAIN_PAGES`` different pages of at most ``TRAIN_CHARS`` characters with the smallest hashes:
    those whose markup names an article (``marked``), and ``LAYOUTS`` made layouts of their
    sentences. An empty table still gives a labeller, from layouts alone.
    """
    h = F.col(f"`{html_col}`")
    own = pages.select(h.cast("string").alias("html"), F.xxhash64(h.cast("string")).alias("h")).where(F.length("html").between(1, TRAIN_CHARS))
    # the least hashes first, so that tasks send numbers to the driver and no pages but the chosen ones
    least = own.select("h").distinct().orderBy("h").limit(TRAIN_PAGES).collect()
    rows = sorted(own.where(F.col("h") <= least[-1].h).dropDuplicates(["h"]).collect(), key=lambda r: r.h) if least else []
    real, texts, links = [], [], []
    for row in rows:
        blocks = leaf_blocks(row.html)
        y = [marked(b[0]) for b in blocks]
        if any(y):
            real.append((block_vectors(blocks), np.array([bool(v) for v in y], np.float32)))
        texts += [b[1][:600] for b, v in zip(blocks, y, strict=True) if v]
        links += [b[1] for b in blocks if b[2] > 0.5 and len(b[1]) < 60]
    made = [(block_vectors(b), y) for b, y in made_layouts(texts[:2000], links[:500], LAYOUTS)]
    return BiLstm().train(real + made)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_blocks`` (kept) for each page, from its whole HTML.

    The main text's blocks are joined by newlines in page order. Null and empty pages, and pages
    without main text, give an empty text; a page of very many blocks is labelled a run of blocks at
    a time, with the whole page as context. One row out per row in, repeated ones included, an empty
    table gives an empty one; other columns are not read.
    """
    spark = pages.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(fit(pages, html_col))

    def extracted(batches):
        model = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                blocks = [leaf_blocks(h or "") for h in part.column(2).to_pylist()]
                keep = model.label([block_vectors(b) if len(b) <= LONG else np.zeros((0, WIDTH), np.float32) for b in blocks])
                keep = [k if len(b) <= LONG else model.label_long(b) for k, b in zip(keep, blocks, strict=True)]
                chosen = [[b[1] for b, k in zip(own, ks, strict=True) if k] for own, ks in zip(blocks, keep, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(["\n".join(c) for c in chosen], pa.string()), pa.array([len(c) for c in chosen], pa.int32())], ["id", "url", "text", "n_blocks"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string"))
    return rows.mapInArrow(extracted, f"id {kind}, url string, text string, n_blocks int").withColumnsRenamed({"id": id_col, "url": url_col})
