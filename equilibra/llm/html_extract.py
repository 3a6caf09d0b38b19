"""Main text of web pages by a linear-chain CRF over leaf blocks.

A page is read once into leaf blocks: runs of text between block-level tags.
Scripts, styles, titles, templates, frames, form fields' texts (textarea, option),
comments and other markup never become text; formulas, drawings and fall-back
texts (noscript, object) do, as inline elements.  Each block has
features of its ancestors (tags, and words of class, id and role), of its
parent tag, its place and its text (length, link share, punctuation, marks).
A linear-chain conditional random field with two labels (article or not)
scores a page's block sequence; Viterbi decoding gives the best labelling, and
the text of the article blocks, joined by single spaces, is the result.

The model is trained on labelled pages: at most ``SAMPLE`` pages of smallest id hash,
as they are (labels from article and main elements) and with their texts
set in the labelled layouts of ``page_layouts`` (labels from the layout).
It is a few thousand numbers.  Extraction is one pass without a shuffle; a page
is held by one task.

Defined results: a null, empty or text-free page gives an empty text; broken
markup is read as far as it goes (an unclosed comment, script, style, textarea
or title ends the page); repeated rows give equal texts; other columns pass through untouched.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilibra.llm.common import add_columns, hashed_sample, once
from equilibra.llm.page_layouts import LAYOUTS

SAMPLE = 400       # pages used for fitting (the bound of the sample)
PER_PAGE = 2       # layouts that each sampled page's texts are set in
EPOCHS = 80

_TAG = re.compile(r"<!--(.*?)-->|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")

# fixed values: HTML elements by kind
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span "
                   "strike strong sub sup time tt u var wbr br input noscript object param embed "
                   "svg g defs symbol use path rect circle ellipse line polyline polygon text tspan textpath desc marker "
                   "mask pattern clippath lineargradient radialgradient stop filter image switch foreignobject "
                   "math mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup "
                   "munder mover munderover mmultiscripts mprescripts none mtable mtr mtd menclose semantics annotation "
                   "annotation-xml maction".split())
SPACED = frozenset("br text mtr mtd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
UNSEEN = frozenset("template iframe".split())   # dropped up to their end tag; without one only the tag is
MENU = frozenset("select datalist optgroup option".split())
CLOSES = {"li": "li", "p": "p", "tr": "tr", "td": "td", "th": "th", "dt": "dt", "dd": "dd"}
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW | UNSEEN}
_NEXT = re.compile(r"</?[a-zA-Z]")


@dataclass
class Block:
    text: str
    features: list[str]
    main: bool = False      # only known where labels are read


@dataclass
class _Open:
    tag: str
    above: frozenset[str]


@dataclass
class _Run:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    main: bool = False


def blocks(page: str | None, semantic: bool = False, marks: bool = False) -> list[Block]:
    """Leaf blocks of a page in order, with features; ``semantic`` labels blocks inside article or main
    elements, ``marks`` those between the marks of a labelled layout.  A page's own comments mean nothing."""
    page = page or ""
    out: list[Block] = []
    stack = [_Open("html", frozenset())]
    run, links, marked, pos, n = _Run(), 0, False, 0, len(page)
    open_ended: set[str] = set()

    def flush() -> None:
        nonlocal run
        text = " ".join(html.unescape("".join(run.parts)).split()) if run.parts else ""
        if text:
            main = run.main
            if semantic:
                above = stack[-1].above
                main = bool(above & {"t:article", "t:main"}) and not above & {"t:nav", "t:aside", "t:footer", "t:form"}
            out.append(Block(text, _features(text, run.linked, stack), main))
        run = _Run()

    def add(piece: str) -> None:
        if piece:
            run.parts.append(piece)
            run.main = marked
            if links:
                run.linked += len(piece.strip())

    while pos < n:
        m = _TAG.search(page, pos)
        if not m:
            tail = page[pos:]
            cut = tail.find("<!--")
            add(tail if cut < 0 else tail[:cut])
            break
        add(page[pos:m.start()])
        pos = m.end()
        if m[1] is not None:
            mark = m[1].strip()
            if marks and mark in ("main", "/main"):
                flush()
                marked = mark == "main"
            continue
        name, slash, attrs = (m[3], m[2], m[4]) if m[3] else (m[6], m[5], m[7])
        if not name:
            continue
        tag = name.lower()
        if tag in RAW or tag in UNSEEN:
            if not slash and not attrs.endswith("/") and tag not in open_ended:
                end = _ENDS[tag].search(page, pos)
                if end:
                    pos = end.end()
                elif tag in RAW:
                    pos = n
                else:
                    open_ended.add(tag)
            run.parts.append(" ")
            continue
        if tag in MENU:
            if tag == "option" and not slash:   # its end tag may be left out: its text ends at any tag
                end = _NEXT.search(page, pos)
                pos = end.start() if end else n
            run.parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if slash else 1
            elif tag in SPACED:
                run.parts.append(" ")
            continue
        flush()
        links = 0
        if slash:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
        elif tag not in VOID and not attrs.endswith("/"):
            if stack[-1].tag == "p" or CLOSES.get(tag) == stack[-1].tag != "html":
                stack.pop()
            stack.append(_Open(tag, stack[-1].above | _tokens(tag, attrs)))
    flush()
    for i, b in enumerate(out):
        b.features += _place(i, len(out))
        if i:
            b.features.append("prev-" + out[i - 1].features[0])
    return out


def _tokens(tag: str, attrs: str) -> frozenset[str]:
    got = {f"t:{tag}"}
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            got.update(f"c:{w}" for w in _WORDS.findall((m[2] or m[3] or m[4] or "").lower()))
    return frozenset(got)


def _features(text: str, linked: int, stack: list[_Open]) -> list[str]:
    words = text.count(" ") + 1
    share = min(1.0, linked / max(1, len(text)))
    long = next(i for i, most in enumerate((1, 3, 6, 12, 25, 60, 1 << 60)) if words <= most)
    out = [f"n:{long}", f"p:{stack[-1].tag}", f"l:{min(3, int(share * 3.99))}", "bias"]
    out += sorted(stack[-1].above)
    if text[-1] in ".!?…:\"»”":
        out.append("x:end")
    if "©" in text or "(c)" in text:
        out.append("x:copyright")
    if any(c in text for c in "|·»›"):
        out.append("x:bar")
    if text.isupper():
        out.append("x:caps")
    return out


def _place(i: int, n: int) -> list[str]:
    return ["first"] * (i == 0) + ["last"] * (i == n - 1) + [f"at:{min(3, 4 * i // n)}"]


# ---- the linear-chain CRF: labels 0 (other) and 1 (article); label 0 has emission 0 ----

@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    moves: tuple[float, ...]   # transitions 00 01 10 11, then the start score of label 1


def _chain(emit: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences: P(label 1) per place, expected moves, expected start."""
    pages, most = emit.shape
    node = np.stack([np.zeros_like(emit), emit], axis=2)
    t = moves[:4].reshape(2, 2)
    alpha = np.zeros((pages, most, 2))
    alpha[:, 0] = node[:, 0] + np.array([0.0, moves[4]])
    for j in range(1, most):
        alpha[:, j] = node[:, j] + np.logaddexp.reduce(alpha[:, j - 1, :, None] + t, axis=1)
    beta = np.zeros((pages, most, 2))
    for j in range(most - 2, -1, -1):
        after = np.logaddexp.reduce(t[None] + (node[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2)
        beta[:, j] = np.where((j + 1 < sizes)[:, None], after, 0.0)
    z = np.logaddexp.reduce(alpha[np.arange(pages), sizes - 1], axis=1)
    p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
    inside = np.arange(most)[None, :] < sizes[:, None]
    p1 = np.where(inside, p1, 0.0)
    pair = np.zeros((2, 2))
    for j in range(most - 1):
        e = alpha[:, j, :, None] + t + (node[:, j + 1] + beta[:, j + 1])[:, None, :] - z[:, None, None]
        pair += np.exp(np.where((j + 1 < sizes)[:, None, None], e, -np.inf)).sum(axis=0)
    return p1, pair.ravel(), p1[:, 0].sum()


def fit(pages: list[list[Block]], epochs: int = EPOCHS, l2: float = 0.02) -> Model | None:
    """Maximum-likelihood training by Adam on whole-batch gradients."""
    pages = [p for p in pages if p]
    if not pages:
        return None
    names: dict[str, int] = {}
    for p in pages:
        for b in p:
            for f in b.features:
                names.setdefault(f, len(names))
    sizes = np.array([len(p) for p in pages])
    most = int(sizes.max())
    flat = [b for p in pages for b in p]
    ids = np.concatenate([[names[f] for f in b.features] for b in flat])
    starts = np.concatenate([[0], np.cumsum([len(b.features) for b in flat])[:-1]])
    owner = np.repeat(np.arange(len(flat)), [len(b.features) for b in flat])
    rows = np.repeat(np.arange(len(pages)), sizes)
    cols = np.concatenate([np.arange(s) for s in sizes])
    gold = np.array([b.main for b in flat], dtype=float)
    y = np.zeros((len(pages), most), dtype=int)
    y[rows, cols] = gold
    gold_moves = np.zeros(4)
    for p in pages:
        for a, b in zip(p, p[1:]):
            gold_moves[2 * a.main + b.main] += 1
    gold_start = y[:, 0].sum()
    theta = np.zeros(len(names) + 5)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        emit = np.zeros((len(pages), most))
        emit[rows, cols] = np.add.reduceat(theta[ids], starts)
        p1, moves, start = _chain(emit, theta[-5:], sizes)
        grad = np.zeros_like(theta)
        grad[:-5] = np.bincount(ids, weights=(gold - p1[rows, cols])[owner], minlength=len(names))
        grad[-5:-1] = gold_moves - moves
        grad[-1] = gold_start - start
        grad = grad / len(pages) - l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta += 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in names.items()}, tuple(float(x) for x in theta[-5:]))


def viterbi(emit: list[float], moves: tuple[float, ...]) -> list[int]:
    """The best label sequence."""
    t00, t01, t10, t11, start = moves
    a0, a1, back = 0.0, emit[0] + start, []
    for e in emit[1:]:
        f0, f1 = a1 + t10 > a0 + t00, a1 + t11 > a0 + t01
        back.append((f0, f1))
        a0, a1 = (a1 + t10 if f0 else a0 + t00), (a1 + t11 if f1 else a0 + t01) + e
    y = int(a1 > a0)
    out = [y]
    for b in reversed(back):
        y = int(b[y])
        out.append(y)
    return out[::-1]


def extract(page: str | None, model: Model) -> str:
    """The main text of a page."""
    found = blocks(page)
    if not found:
        return ""
    w = model.weights
    labels = viterbi([sum(w.get(f, 0.0) for f in b.features) for b in found], model.moves)
    return " ".join(b.text for b, y in zip(found, labels) if y)


def labelled(page: str, seed: int, per_page: int = PER_PAGE) -> list[list[Block]]:
    """A sampled page as it is and its texts in labelled layouts."""
    own = blocks(page, semantic=True)
    out = [own] if any(b.main for b in own) and any(not b.main for b in own) else []
    rnd = random.Random(seed)
    paragraphs = [html.escape(b.text) for b in own if len(b.text) > 20] or ["text of a paragraph, as pages have it."]
    words = " ".join(b.text for b in own).split() or ["text"]

    def short() -> str:
        at = rnd.randrange(len(words))
        return html.escape(" ".join(words[at:at + rnd.randrange(1, 5)]))

    def sentence() -> str:
        at = rnd.randrange(len(words))
        return html.escape(" ".join(words[at:at + rnd.randrange(4, 40)])) + rnd.choice([".", ".", "", "!"])

    def fill(m: re.Match) -> str:
        slot = m[1]
        if slot == "p":
            return "".join(f"<p>{rnd.choice(paragraphs) if rnd.random() < 0.8 else short()}</p>" for _ in range(rnd.randrange(1, 7)))
        if slot == "li":
            return "".join(f"<li>{sentence()}</li>" for _ in range(rnd.randrange(2, 6)))
        if slot == "links":
            return "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(rnd.randrange(2, 8)))
        if slot == "inline":
            return " ".join(f'<a href="/{i}">{short()}</a>' for i in range(rnd.randrange(2, 6)))
        return sentence() if slot == "t" else short()

    for layout in rnd.sample(LAYOUTS, min(per_page, len(LAYOUTS))):
        out.append(blocks(re.sub(r"\{(h|p|li|links|inline|s|t)\}", fill, layout.replace("{{", "{").replace("}}", "}")), marks=True))
    return out


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Model | None:
    """Fit on a bounded sample of pages (the driver holds ``sample`` pages)."""
    known = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).where(
        F.col("html").isNotNull() & F.col("page_id").isNotNull())
    ids = hashed_sample(known.select("page_id").distinct(), "page_id", sample, 1)  # ids first: no task sends pages
    rows = (known.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
            .orderBy("page_id").collect())
    texts = [r.html for r in rows] or [""]
    return fit([p for i, h in enumerate(texts) for p in labelled(h, i)])


def main_text(df: DataFrame, model: Model, html_col: str = "html", out: str = "text") -> DataFrame:
    """Append the main text of every page's whole html."""
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.moves))  # a few thousand numbers

    def run(rows: list) -> list[list[str]]:
        here = Model(*sent.value)
        return [[extract(h, here) for h in rows]]

    return add_columns(df, html_col, f"`{out}` string", run)
