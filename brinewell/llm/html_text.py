"""Main text of HTML pages by a recurrent block labeller.

A page is read into its sequence of leaf blocks. Each block is a vector of its
tag path (tags, classes, ids and roles of its ancestors, hashed), its words
(hashed) and a few measures. A bidirectional LSTM in numpy reads the whole
sequence, so that every block is classified in the context of the document.
It is trained by backpropagation through time on pages that this module
generates from common layouts, whose blocks' roles are known.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no markup, those of them that run to the end of the page when unclosed,
#: elements that are dropped with their markup; then those that start blocks, and that close an open one of their kind.
RAW = ("script", "style", "textarea", "iframe", "noembed")
TO_END = ("script", "style", "textarea")
DROPPED = ("template", "svg", "select")
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SIBLINGS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
#: A last attribute value without quotes, to which a slash before the > belongs.
_BARE_SLASH = re.compile(r"=\s*[^\s\"'=>]*/\Z")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PIECE = re.compile(r"[A-Za-z]+")

PATH_DIMS, WORD_DIMS = 128, 32
DIMS = PATH_DIMS + WORD_DIMS + 8
HIDDEN, STEPS, BATCH, RATE = 12, 160, 24, 0.02
#: Blocks whose vectors are in memory at a time when pages are read.
LANES = 20_000


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _empty(attrs: str) -> bool:
    """Whether a start tag ends in />."""
    return attrs.endswith("/") and not _BARE_SLASH.search(attrs)


def _tokens(page: str) -> list[tuple[int, int, str, bool, str]]:
    """Start, end, lower-case tag (none for comments and raw elements), whether it is an end tag, attributes."""
    out, at, unclosed = [], 0, set()
    while m := _TOKEN.search(page, at):
        at, tag, end = m.end(), (m["tag"] or "").lower(), bool(m["end"])
        if tag in RAW and not end and tag not in unclosed and (tag in TO_END or not _empty(m["attrs"])):
            close = _CLOSING[tag].search(page, at)
            if close or tag in TO_END:
                at, tag = close.end() if close else len(page), ""
            else:
                unclosed.add(tag)
        out.append((m.start(), at, tag, end, m["attrs"] or ""))
    return out


def _dropped(tokens: list[tuple[int, int, str, bool, str]]) -> dict[int, tuple[int, int]]:
    """For each token that opens a dropped element: the token and the character at which the page goes on.

    An element without an end is not dropped. As in HTML, a block ends an open
    svg outside of its foreignObject; a block or another select ends a select.
    """
    out: dict[int, tuple[int, int]] = {}
    opened: dict[str, list[int]] = {t: [] for t in DROPPED}
    islands = 0
    for i, (start, stop, tag, end, attrs) in enumerate(tokens):
        if end:
            if tag == "foreignobject":
                islands = max(0, islands - 1)
            elif opened.get(tag):
                out[opened[tag].pop()] = i + 1, stop
                islands *= bool(opened["svg"])
            continue
        if tag in BLOCKS or tag == "select":
            ended = []
            if tag not in ("title", "select") and not islands:
                ended.append("svg")
            if tag not in ("hr", "button", "div", "legend", "label"):
                ended.append("select")
            for t in ended:
                out |= {k: (i, start) for k in opened[t]}
                opened[t].clear()
        if tag in DROPPED and not (tag == "svg" and _empty(attrs)):
            opened[tag].append(i)
        elif tag == "foreignobject" and opened["svg"] and not _empty(attrs):
            islands += 1
    return out


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: tag path, text with white space collapsed, characters inside links."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append(Block(tuple(x for _, names in stack for x in names), whole, linked))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece)
            text.append(piece)
            linked += len(piece) * bool(anchors)

    tokens = _tokens(page)
    dropped = _dropped(tokens) if any(t[2] in DROPPED for t in tokens) else {}
    at = resume = 0
    for i, (start, stop, tag, end, attrs) in enumerate(tokens):
        if i < resume:
            continue
        add(page[at:start])
        at = stop
        if i in dropped:
            resume, at = dropped[i]
            continue
        if tag not in BLOCKS:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                anchors = max(0, anchors - 1) if end else 1
            continue
        flush()
        anchors = 0
        if end:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        bounds = BOUNDS.get(tag, ("body", "div", "article", "section"))
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in bounds:
                break
            if stack[k][0] in SIBLINGS.get(tag, ()):
                del stack[k:]
                break
        if tag != "hr":
            names = [tag, *(f"={w.lower()}" for a in _ATTR.finditer(attrs) for w in _PIECE.findall(a[2] or a[3] or a[4] or ""))]
            stack.append((tag, tuple(names)))
    add(page[at:])
    flush()
    return out


def _slot(name: str, dims: int) -> tuple[int, float]:
    h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
    return h % dims, 1.0 if h & 0x10000 else -1.0


_CACHE: dict[str, tuple[int, float]] = {}


def features(page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """One vector for each block of the page, or of a part of it."""
    part = page[first:last]
    x = np.zeros((len(part), DIMS), np.float32)
    for i, b in enumerate(part, first):
        row = x[i - first]
        for name in (*b.path, "leaf:" + (next((t for t in reversed(b.path) if t[0] != "="), ""))):
            k = _CACHE.get(name) or _CACHE.setdefault(name, _slot(name, PATH_DIMS)) if len(_CACHE) < 100_000 else _slot(name, PATH_DIMS)
            row[k[0]] += k[1]
        words = b.text.lower().split()
        for w in words:
            h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            row[PATH_DIMS + h % WORD_DIMS] += 1.0 if h & 0x10000 else -1.0
        hashed = row[PATH_DIMS : PATH_DIMS + WORD_DIMS]
        hashed /= 4.0 * max(1.0, float(np.sqrt((hashed * hashed).sum())))  # a word that fills its block is no stronger than others
        n = len(b.text)
        row[-8:] = (np.log1p(n) / 8, b.linked / max(1, n), b.text.count(".") / max(1, len(words)), b.text[-1] in ".!?", sum(map(str.isdigit, b.text)) / max(1, n), i / len(page), 1.0 / (1 + i), min(1.0, len(page) / 50))
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * z)


class Labeller:
    """A bidirectional LSTM with one output, the odds that a block is main text."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.hidden = hidden
        self.p = {"v": small(2 * hidden), "c": np.zeros(1, np.float32)}
        for d in "01":
            self.p |= {"w" + d: small(DIMS, 4 * hidden), "u" + d: small(hidden, 4 * hidden), "b" + d: np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)}

    def _forward(self, x: np.ndarray, d: str, keep: list | None = None, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """States (T, B, H) and the last ones; padding is at the end of x (T, B, DIMS) and reads as zero vectors."""
        steps, n, _ = x.shape
        k = self.hidden
        z = (x.reshape(-1, DIMS) @ self.p["w" + d] + self.p["b" + d]).reshape(steps, n, 4 * k)
        h, c = state or (np.zeros((n, k), np.float32), np.zeros((n, k), np.float32))
        out = np.empty((steps, n, k), np.float32)
        for t in range(steps) if d == "0" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.p["u" + d]
            i, f, o, g = _sigmoid(a[:, :k]), _sigmoid(a[:, k : 2 * k]), _sigmoid(a[:, 2 * k : 3 * k]), np.tanh(a[:, 3 * k :])
            if keep is not None:
                keep.append((t, i, f, o, g, c, h))
            c = f * c + i * g
            h = o * np.tanh(c)
            out[t] = h
            if keep is not None:
                keep[-1] += (c,)
        return out, (h, c)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds (T, B)."""
        return self._forward(x, "0")[0] @ self.p["v"][: self.hidden] + self._forward(x, "1")[0] @ self.p["v"][self.hidden :] + self.p["c"]

    def gradients(self, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        k = self.hidden
        kept: dict[str, list] = {"0": [], "1": []}
        states = [self._forward(x, d, kept[d])[0] for d in "01"]
        z = states[0] @ self.p["v"][:k] + states[1] @ self.p["v"][k:] + self.p["c"]
        prob = _sigmoid(z)
        total = max(1.0, float(used.sum()))
        loss = float(-(used * np.log(np.where(y > 0, prob, 1 - prob) + 1e-9)).sum() / total)
        dz = ((prob - y) * used / total).astype(np.float32)
        g = {n: np.zeros_like(v) for n, v in self.p.items()}
        g["c"][0] = dz.sum()
        for d in "01":
            own = self.p["v"][:k] if d == "0" else self.p["v"][k:]
            g["v"][slice(0, k) if d == "0" else slice(k, 2 * k)] = np.einsum("tb,tbk->k", dz, states[int(d)])
            dh = np.zeros(states[0].shape[1:], np.float32)
            dc = np.zeros_like(dh)
            da = np.zeros((*dz.shape, 4 * k), np.float32)
            for t, i, f, o, cand, before, h, c in reversed(kept[d]):
                dh = dh + dz[t][:, None] * own
                tc = np.tanh(c)
                dc = dc + dh * o * (1 - tc * tc)
                da[t] = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)], 1)
                g["u" + d] += h.T @ da[t]
                dh, dc = da[t] @ self.p["u" + d].T, dc * f
            flat = da.reshape(-1, 4 * k)
            g["w" + d], g["b" + d] = x.reshape(-1, DIMS).T @ flat, flat.sum(0)
        return loss, g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 1) -> float:
        rng = np.random.default_rng(seed)
        m, s = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2))
        loss = 0.0
        for step in range(1, steps + 1):
            x, y, used = _lanes([pages[i] for i in rng.integers(0, len(pages), BATCH)])
            loss, g = self.gradients(x, y, used)
            norm = float(np.sqrt(sum(float((v**2).sum()) for v in g.values())))
            for n, v in g.items():
                v = v * min(1.0, 5.0 / max(norm, 1e-9))
                m[n], s[n] = 0.9 * m[n] + 0.1 * v, 0.99 * s[n] + 0.01 * v * v
                self.p[n] = (self.p[n] - RATE * (1.2 - step / steps) * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


def _lanes(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in pages)
    x, y, used = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, (a, b) in enumerate(pages):
        x[: len(a), k], y[: len(a), k], used[: len(a), k] = a, b, 1
    return x, y, used


def made_pages(count: int, seed: int = 0) -> Iterator[tuple[str, dict[str, bool]]]:
    """Pages of common layouts, and for each block's text whether it is main text."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    many = lambda a, b: range(int(rng.integers(a, b + 1)))
    syllables = [c + v for c in "bcdfgklmnprstvz" for v in "aeiou"] + ["th", "on", "er", "é", "ü", "ñ", "ß", "ain"]

    for _ in range(count):
        role: dict[str, bool] = {}

        def words(a: int, b: int) -> str:
            return " ".join("".join(pick(*syllables) for _ in many(1, 4)) for _ in many(a, b))

        def say(main: bool, a: int, b: int, stop: str = ".", lead: str = "") -> str:
            sentences = [words(3, 14).capitalize() + stop for _ in many(1, max(1, b // 9))]
            text = (lead + (" ".join(sentences) if b > 14 else words(a, b))).strip()
            role[text] = main
            return html.escape(text, quote=False)

        def menu() -> str:
            items = [f'<li><a href="/{k}">{say(False, 1, 3)}</a></li>' for k in many(2, 8)]
            return "<ul>" + "".join(items) + "</ul>" if rng.random() < 0.8 else "".join(re.sub("</?li>", "", x) for x in items)

        def advert() -> str:
            name = pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")
            return f"<{(t := pick('div', 'div', 'aside', 'section'))} {pick('class', 'class', 'id')}=\"{name}\">{say(False, 2, pick(8, 8, 40))}</{t}>"

        def notice() -> str:
            name = pick("cookie", "cookie-notice", "consent", "notice", "alert", "newsletter", "subscribe", "popup", "gdpr")
            return f"<div {pick('class', 'id')}=\"{name}\"><p>{say(False, 3, pick(12, 30))}</p>{pick('', '<button>' + say(False, 1, 2) + '</button>')}</div>"

        def side() -> str:
            tag = pick("aside", "aside", "div", "section")
            name = "" if tag == "aside" and rng.random() < 0.6 else f' class="{pick("sidebar", "side", "widget", "related", "recommended", "share", "social")}"'
            body = pick(menu(), f"<h3>{say(False, 1, 4)}</h3><p>{say(False, 3, 40)}</p>", f"<p>{say(False, 3, 30)}</p>")
            return f"<{tag}{name}>{body}</{tag}>"

        def form() -> str:
            return f"<form action=\"/s\"><label>{say(False, 1, 3)}</label><input name=\"q\"><button>{say(False, 1, 2)}</button></form>"

        def comments() -> str:
            name = pick("comments", "comment-list", "discussion", "responses", "replies")
            each = "".join(f'<{(t := pick("div", "li", "article"))} class="{pick("comment", "comment", "reply")}"><p>{say(False, 4, 50)}</p></{t}>' for _ in many(1, 5))
            tag = pick("section", "div")
            return f"<{tag} {pick('id', 'class')}=\"{name}\">{pick('', '<h3>' + say(False, 1, 3) + '</h3>')}{each}</{tag}>"

        def body() -> str:
            out = [f"<{(h := pick('h1', 'h1', 'h2'))}>{say(True, 2, 14)}</{h}>"] if rng.random() < 0.85 else []
            for _ in many(1, 9):
                kind = rng.random()
                if kind < 0.72:
                    out.append(f"<p>{pick('', '', '<b>')}{say(True, 1, pick(8, 30, 90, 200))}{pick('</p>', '</p>', '</p>', '<br>')}")
                elif kind < 0.8:
                    out.append(f"<h2>{say(True, 1, 6)}</h2>")
                elif kind < 0.87:
                    out.append("<ul>" + "".join(f"<li>{say(True, 2, 20)}</li>" for _ in many(1, 5)) + "</ul>")
                elif kind < 0.92:
                    out.append(f"<blockquote>{pick('<p>', '')}{say(True, 4, 40)}</blockquote>")
                elif kind < 0.95:
                    out.append(f"<pre>{say(True, 2, 20)}</pre>")
                elif kind < 0.97:
                    out.append("<table>" + "".join(f"<tr><td>{say(True, 1, 4)}</td><td>{say(True, 1, 4)}</td></tr>" for _ in many(1, 4)) + "</table>")
                else:
                    out.append(pick(advert, side, form)())
            return "".join(out)

        head = f"<html lang=\"{pick('en', 'de', 'fr')}\"><head><title>{say(False, 2, 10)}</title><style>p{{}}</style></head><body>"
        page = ["<!DOCTYPE html>", head]
        maybe = lambda p, f: page.append(f()) if rng.random() < p else None
        if rng.random() < 0.12:  # a bare fragment
            shell = pick("<article>", "<main>", "<div>", "")
            yield shell + body(), role
            continue
        maybe(0.2, notice)
        if rng.random() < 0.5:
            page.append(f"<{(t := pick('header', 'header', 'div'))}{'' if t == 'header' else pick(' class=\"header\"', ' id=\"masthead\"', ' class=\"topbar\"')}>{pick('', '<p>' + say(False, 1, 6) + '</p>')}{menu()}</{t}>")
        if rng.random() < 0.8:
            page.append(f"<nav>{menu()}</nav>" if rng.random() < 0.7 else f"<div class=\"{pick('menu', 'navbar', 'breadcrumb', 'nav')}\">{menu()}</div>")
        maybe(0.35, advert)
        maybe(0.15, form)
        maybe(0.25, side)
        shell = pick("<article>", "<article>", "<article>", "<main>", "<main><article>", '<div class="content">', '<div id="content">', '<section class="post">', '<div class="article-body">', "<div>", "")
        page += [shell, body(), "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", shell)))]
        maybe(0.25, side)
        maybe(0.3, comments)
        maybe(0.15, advert)
        maybe(0.1, notice)
        if rng.random() < 0.85:
            lead = pick("", "© ", "© ")
            page.append(f"<footer>{pick('', menu())}{say(False, 2, pick(10, 30), lead=lead)}</footer>" if rng.random() < 0.75 else f"<div class=\"{pick('footer', 'copyright', 'bottom')}\"><p>{say(False, 2, 20, lead=lead)}</p></div>")
        whole = "".join(page) + "</body></html>"
        yield whole if rng.random() < 0.9 else whole[: int(len(whole) * rng.uniform(0.5, 1))], role


@functools.lru_cache(maxsize=4)
def trained(pages: int = 500, seed: int = 0) -> Labeller:
    """A labeller fitted to generated pages; the same for the same arguments, and fitted once."""
    rows = []
    for page, role in made_pages(pages, seed):
        own = blocks(page)
        if own:
            rows.append((features(own), np.array([role.get(b.text, False) for b in own], np.float32)))
    net = Labeller(seed=seed)
    net.train(rows)
    return net


def long_odds(net: Labeller, page: list[Block]) -> np.ndarray:
    """Log odds of a page's blocks with the vectors of LANES blocks in memory at a time; states are carried from part to part."""
    out = np.full(len(page), net.p["c"][0], np.float32)
    k = net.hidden
    for d, v in (("0", net.p["v"][:k]), ("1", net.p["v"][k:])):
        state = None
        starts = range(0, len(page), LANES)
        for at in starts if d == "0" else reversed(starts):
            part = features(page, at, at + LANES)[:, None]
            states = net._forward(part, d, state=state)
            state = states[1]
            out[at : at + LANES] += (states[0] @ v)[:, 0]
    return out


def main_texts(net: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page: its main blocks, joined by line feeds."""
    read = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(read) if b), key=lambda i: len(read[i]))
    at = 0
    while at < len(order):
        group: list[int] = []
        while at < len(order) and (not group or (len(group) + 1) * len(read[order[at]]) <= LANES):
            group.append(order[at])
            at += 1
        odds = net.odds(_lanes([(features(read[i]), 0) for i in group])[0]) if len(read[group[0]]) <= LANES else long_odds(net, read[group[0]])[:, None]
        for k, i in enumerate(group):
            out[i] = "\n".join(b.text for b, z in zip(read[i], odds[:, k], strict=False) if z > 0)
    return out


def extract(pages: DataFrame, net: Labeller | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars``, one row per row of ``pages``.

    Blocks are parsed from whole pages; character references are decoded, white
    space inside a block becomes one space, main blocks are joined by one line
    feed. Null or markup-free empty pages give an empty text. Repeated rows each
    give their row; an empty table gives none. Columns not in ``keep`` are not read.
    """
    model = pages.sparkSession.sparkContext.broadcast(net or trained())
    rows = pages.select(F.col(html_col).cast("string").alias("html__"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = main_texts(model.value, [p or "" for p in batch.column(0).to_pylist()])
                own = [batch.column(k) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[1:], "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{fields}, text string, n_chars long")
