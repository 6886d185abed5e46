"""HTML main-text extraction by a recurrent block labeller.

A page becomes its sequence of text blocks; each block has a hashed tag path
(tags, classes and ids of its ancestors), hashed words and a few measures.  A
bidirectional LSTM, written and trained here in numpy, reads the whole sequence
and labels every block main text or not.

It is trained on a bounded sample of pages of the corpus that have an article
element (if none has, of all pages, with what is in no boilerplate element): blocks in it that no element for navigation, asides or forms holds are
main text; class names play no part in that.  Each page is learnt a second time
with boilerplate of many makes set among its blocks (``_varied``), under usual
and under made-up class names and at any depth, and with class names put on its
article, so that the labeller goes by whole paths, words and neighbours.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dom import PageParser
from .session import bounded_batches, sampled

PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 160, 32, 5, 16
#: Pages that the fit sees at most, those with the least hash of their id.
SAMPLE = 300
#: Blocks of a training sequence, and sequences that the fit sees at most; labelling always reads whole pages.
TRAIN_BLOCKS, SEQUENCES = 120, 1500
STEPS = 260

# Fixed values of HTML: elements that end a block, hold no text, are never shown, or are closed by a sibling.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = set("script style noscript template head title iframe svg math object canvas audio video".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What closing by a sibling may not reach across.
FENCE = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "aside", "main", "body", "td", "th", "blockquote", "nav", "footer", "header", "form"}
#: Fixed values of HTML: elements that hold no main text even in an article.
BOILERPLATE_TAGS = set("nav footer header aside form button select textarea menu dialog".split())
#: Usual class names of boilerplate, put on what is set into training pages.
USUAL_NAMES = (
    "ad advert advertisement banner sponsored promo sidebar widget menu nav breadcrumb masthead comment comments reply replies discussion "
    "cookie-notice consent notice alert popup subscribe newsletter signup login share social related recommended search pagination"
).split()
#: Attribute that labels elements of training pages.
_LABEL = "data-pagewarrant-label"
_WORD = re.compile(r"[A-Za-z]+")


class Block:
    __slots__ = ("path", "parts", "linked", "text")

    def __init__(self, path):
        self.path, self.parts, self.linked, self.text = path, [], 0, ""


class Path(NamedTuple):
    """An open element and all that it lies in, whatever the depth: set path slots as bits; in training, the label."""

    tag: str = ""
    slots: int = 0
    label: int = -1

    def inner(self, tag: str, words: list[str], label: str | None) -> Path:
        slots = self.slots | 1 << _slot(tag, PATH_DIMS)
        own = tag if tag in ("html", "body", "main", "article") else ""
        for w in words:
            slots |= 1 << _slot(f"{own}.{w}", PATH_DIMS)
        now = self.label
        if now and (label == "0" or tag in BOILERPLATE_TAGS):
            now = 0
        elif now and (label == "1" or tag in ("article", "main")):
            now = 1
        return Path(tag, slots, now)


class _Reader(PageParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Path] = []
        self.blocks: list[Block] = []
        self.now: Block | None = None
        self.hidden = self.links = 0

    def _end_block(self):
        if self.now is not None:
            text = " ".join("".join(self.now.parts).split())
            if text:
                self.now.text = text
                self.now.parts = []
                self.blocks.append(self.now)
            self.now = None

    def _pop(self, k: int):
        for tag, *_ in self.open[k:]:
            self.hidden -= tag in HIDDEN_TAGS
            self.links -= tag == "a"
            if tag in BLOCK:
                self._end_block()
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._end_block()
        if tag in ("br", "img", "input", "hr") and self.now is not None:
            self.now.parts.append(" ")
        if tag in VOID:
            return
        if tag == "body":  # an unclosed head ends here
            for k, path in enumerate(self.open):
                if path.tag == "head":
                    self._pop(k)
                    break
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k].tag
            if name in CLOSES.get(tag, ()) or (name == "p" and tag in BLOCK):
                self._pop(k)
                break
            if name in FENCE:
                break
        names = " ".join(v for a, v in attrs if a in ("class", "id", "role") and v)
        self.open.append((self.open[-1] if self.open else Path()).inner(tag, _WORD.findall(names.lower()), next((v for a, v in attrs if a == _LABEL), None)))
        self.hidden += tag in HIDDEN_TAGS
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self._pop(k)
                return
        if tag in BLOCK:
            self._end_block()

    def handle_data(self, data):
        if self.hidden:
            return
        if self.now is None:
            self.now = Block(self.open[-1] if self.open else Path())
        self.now.parts.append(data)
        if self.links:
            self.now.linked += len(data.strip())


def read_blocks(html: str | None) -> list[Block]:
    """The visible text blocks of a page in order; inline elements don't end a block, white space is one space."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._pop(0)
    reader._end_block()
    return reader.blocks


@lru_cache(maxsize=50_000)
def _slot(text: str, dims: int) -> int:
    return zlib.crc32(text.encode()) % dims


@lru_cache(maxsize=5_000)
def _path_vector(slots: int, tag: str) -> np.ndarray:
    row = np.unpackbits(np.frombuffer(slots.to_bytes(PATH_DIMS // 8, "little"), np.uint8), bitorder="little").astype(float)
    if tag:
        row[_slot("/" + tag, PATH_DIMS)] = 1
    return row


def block_vectors(blocks: list[Block]) -> np.ndarray:
    """A row per block: hashed path, shares of all its hashed words, measures."""
    out = np.zeros((len(blocks), PATH_DIMS + WORD_DIMS + MEASURES))
    for k, b in enumerate(blocks):
        row, n, words = out[k], len(b.text), b.text.split()
        row[:PATH_DIMS] = _path_vector(b.path.slots, b.path.tag)
        # very long words are not cached
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount([(_slot if len(w) <= 64 else _slot.__wrapped__)(w, WORD_DIMS) for w in words], minlength=WORD_DIMS) / len(words)
        row[-MEASURES:] = (min(1, math.log1p(n) / 8), min(1.0, b.linked / n), b.text[-1] in ".!?…", min(1, n / 600), k / max(1, len(blocks) - 1))
    return out


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiLSTM:
    """Two LSTMs over a padded batch of sequences and a logistic output of both states."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.15, (inputs + hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p["c" + d] = bias
        self.p["o"] = rng.normal(0, 0.2, 2 * hidden)
        self.p["ob"] = np.zeros(1)

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        n, steps, inputs = x.shape
        own = self.p["w" + d][inputs:]
        from_x = x @ self.p["w" + d][:inputs] + self.p["c" + d]  # all blocks at once; only the state goes step by step
        h, c = np.zeros((n, self.hidden)), np.zeros((n, self.hidden))
        states, tape = np.zeros((n, steps, self.hidden)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = from_x[:, t] + h @ own
            gates, g, m = _sigmoid(z[:, : 3 * self.hidden]), np.tanh(z[:, 3 * self.hidden :]), mask[:, t, None]
            i, f, o = np.split(gates, 3, 1)
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                tape.append((t, h, i, f, o, g, c, tanh, m))
            c, h = np.where(m, new, c), np.where(m, o * tanh, h)
            states[:, t] = h
        return states, tape

    def score(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._pass(d, x, mask, False)[0] for d in "fb"], 2)
        return _sigmoid(both @ self.p["o"] + self.p["ob"])

    def gradients(self, x, mask, y):
        got = {d: self._pass(d, x, mask, True) for d in "fb"}
        both = np.concatenate([got[d][0] for d in "fb"], 2)
        error = (_sigmoid(both @ self.p["o"] + self.p["ob"]) - y) * mask / mask.sum()
        grads = {"o": np.einsum("nt,nth->h", error, both), "ob": np.array([error.sum()])}
        d_both = error[:, :, None] * self.p["o"]
        for k, d in enumerate("fb"):
            d_states = d_both[:, :, k * self.hidden : (k + 1) * self.hidden]
            own = self.p["w" + d][x.shape[2] :]
            every, g_own = np.zeros((*x.shape[:2], 4 * self.hidden)), np.zeros_like(own)
            dh, dc = np.zeros((len(x), self.hidden)), np.zeros((len(x), self.hidden))
            for t, before, i, f, o, g, c, tanh, m in reversed(got[d][1]):
                dh = dh + d_states[:, t]
                do, dn = dh * tanh * m, dh * o * (1 - tanh**2) * m + dc * m
                dz = every[:, t] = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), do * o * (1 - o), dn * i * (1 - g**2)], 1)
                g_own += before.T @ dz
                dh, dc = np.where(m, dz @ own.T, dh), np.where(m, dn * f, dc)
            flat = every.reshape(-1, 4 * self.hidden)
            grads["w" + d], grads["c" + d] = np.concatenate([x.reshape(-1, x.shape[2]).T @ flat, g_own]), flat.sum(0)
        return grads

    def fit(self, sequences, labels, steps: int = STEPS, rate: float = 0.02, batch: int = 48, seed: int = 0):
        rng = np.random.default_rng(seed)
        by_length = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            # neighbours by length, so that little is padding
            at = int(rng.integers(max(1, len(sequences) - batch + 1)))
            pick = by_length[at : at + batch]
            x, mask = padded([sequences[i] for i in pick])
            y = np.zeros(mask.shape)
            for r, i in enumerate(pick):
                y[r, : len(labels[i])] = labels[i]
            for k, g in self.gradients(x, mask, y).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        return self


def padded(sequences):
    n = max((len(s) for s in sequences), default=0)
    x, mask = np.zeros((len(sequences), n, sequences[0].shape[1])), np.zeros((len(sequences), n), bool)
    for r, s in enumerate(sequences):
        x[r, : len(s)], mask[r, : len(s)] = s, True
    return x, mask


def _boilerplate(rng, borrow) -> str:
    """An element that is no main text, in borrowed words: of a usual name, or of a made-up one and a telling make."""
    made_up = rng.random() < 0.4
    name = "".join(chr(97 + int(k)) for k in rng.integers(0, 26, 7)) if made_up else USUAL_NAMES[int(rng.integers(len(USUAL_NAMES)))]
    link = lambda n: f'<a href="/{rng.integers(99)}">{borrow(n)}</a>'
    makes = [
        lambda: f"<ul>{''.join(f'<li>{link(2)}</li>' for _ in range(int(rng.integers(2, 8))))}</ul>",
        lambda: "".join(f'<div class="{name}-item"><a href="/u">{borrow(2)}</a> <time>{borrow(2)}</time><p>{borrow(40)}</p><a href="#r">{borrow(1)}</a></div>' for _ in range(int(rng.integers(1, 6)))),
        lambda: "<ol>" + "".join(f"<li><b>{borrow(2)}</b><p>{borrow(30)}</p><button>{borrow(1)}</button></li>" for _ in range(int(rng.integers(1, 6)))) + "</ol>",
        lambda: f"<p>{borrow(25)}</p><button>{borrow(2)}</button>",
        lambda: f'<form action="/s"><label>{borrow(3)}</label><input name="q"><button>{borrow(1)}</button></form>',
        lambda: f"<h3>{borrow(3)}</h3><p>{link(6)}</p><p>{link(6)}</p>",
        lambda: f"<p>{borrow(40)}</p>",
        lambda: borrow(12),
    ]
    body = makes[int(rng.integers(6 if made_up else len(makes)))]()
    tag = "aside" if rng.random() < 0.15 else ("div", "section", "ul" if body.startswith("<li") else "div", "p" if "<" not in body else "div")[int(rng.integers(4))]
    deep = int(rng.integers(0, 12)) if rng.random() < 0.3 else 0
    kind = "id" if rng.random() < 0.2 else "class"
    return f'<{tag} {kind}="{name}" {_LABEL}="0">{"<div>" * deep}{body}{"</div>" * deep}</{tag}>'


def _varied(html: str, rng) -> str:
    """The page with boilerplate set between and inside its elements, and names on its article; labels stay with elements."""
    words = re.sub(r"<[^>]*>", " ", html).replace("<", " ").split() or ["x"]

    def borrow(n: int) -> str:
        at = int(rng.integers(len(words)))
        return " ".join(words[at : at + int(rng.integers(1, n + 1))])

    for _ in range(int(rng.integers(2, 6))):
        places = [m.end() for m in re.finditer(r"</(?:p|nav|div|article|h1|ul|section)>|<body>|<article>", html)] or [len(html)]
        at = places[int(rng.integers(len(places)))]
        html = html[:at] + _boilerplate(rng, borrow) + html[at:]
    names = " ".join(USUAL_NAMES[int(k)] if rng.random() < 0.5 else f"n{k}" for k in rng.integers(len(USUAL_NAMES), size=2))
    fate = rng.random()
    if fate < 0.25:
        tag = "main" if fate < 0.12 else "div"
        html = re.sub(r"<article\b", f'<{tag} {_LABEL}="1"', html).replace("</article>", f"</{tag}>")
    elif fate < 0.6:
        html = re.sub(r"<article\b(?![^>]*\bclass)", f'<article class="{names}"', html)
    return html


_EXAMPLE = "part long, n int, x binary, y binary"


def _examples(articles: bool):
    """Sequences of block vectors and labels, of each page and its varied copy; longer pages give several.

    Blocks in an article are main text; without ``articles``, those in no boilerplate element.
    """

    def examples(batches):
        for batch in batches:
            rows = []
            for html in batch.column("_k_html").to_pylist():
                seed = zlib.crc32(html.encode("utf-8", "surrogatepass"))
                for copy, page in enumerate((html, _varied(html, np.random.default_rng(seed)))):
                    blocks = read_blocks(page)
                    main = np.array([b.path.label == 1 if articles else b.path.label != 0 for b in blocks], np.int8)
                    if not main.any():
                        continue
                    x = block_vectors(blocks).astype(np.float32)
                    for a in range(0, len(main), TRAIN_BLOCKS):
                        y = main[a : a + TRAIN_BLOCKS]
                        rows.append((zlib.crc32(f"{seed} {copy} {a}".encode()), len(y), x[a : a + TRAIN_BLOCKS].tobytes(), y.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["part", "n", "x", "y"])

    return examples


def train(examples, seed: int = 0) -> BiLSTM:
    """A labeller from rows ``n, x, y``; without any, all blocks are main text."""
    width = PATH_DIMS + WORD_DIMS + MEASURES
    model = BiLSTM(width, seed=seed)
    if not examples:
        model.p["ob"][:] = 30
        return model
    sequences = [np.frombuffer(r["x"], np.float32).reshape(r["n"], width) for r in examples]
    return model.fit(sequences, [np.frombuffer(r["y"], np.int8) for r in examples])


def _extract(model: BiLSTM):
    def extract(batches):
        for batch in batches:
            pages = batch.column("_k_html").to_pylist()
            texts: list[str] = [""] * len(pages)
            blocks = [read_blocks(p) for p in pages]
            order = sorted((i for i in range(len(pages)) if blocks[i]), key=lambda i: len(blocks[i]))
            at = 0
            while at < len(order):  # pages of like length together, within a bounded grid
                end = at + 1
                while end < len(order) and (end - at + 1) * len(blocks[order[end]]) <= 4000:
                    end += 1
                part = order[at:end]
                scores = model.score(*padded([block_vectors(blocks[i]) for i in part]))
                for r, i in enumerate(part):
                    texts[i] = "\n".join(b.text for b, s in zip(blocks[i], scores[r]) if s >= 0.5)
                at = end
            names = [n for n in batch.schema.names if n != "_k_html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "_k_main"])

    return extract


def extract_main(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """One row per page: ``_k_id, _k_row`` (struct of the other columns), ``_k_main``: main blocks joined by newlines.

    Null or empty html, and pages without main text, give an empty text.
    Character references are decoded; malformed markup is read as far as it
    goes, also after unknown declarations.  Pages are read whole whatever their
    length or depth; blocks that score exactly one half are main text.  Repeated
    rows and null ids are pages like others; an empty table gives no rows; other
    columns of any name come back in ``_k_row``.
    """
    bounded_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c != html_col]
    own = pages.select(F.col(f"`{id_col}`").alias("_k_id"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_k_row"), F.col(f"`{html_col}`").alias("_k_html"))
    key = F.xxhash64("_k_html")  # equal pages are learnt from once, and ids play no part

    def sample_of(told: DataFrame, articles: bool) -> list:
        keys = sampled(told.select(key.alias("_k_key")).distinct(), sample, "_k_key")
        picked = told.withColumn("_k_key", key).join(F.broadcast(keys), "_k_key").groupBy("_k_key").agg(F.min("_k_html").alias("_k_html"))
        return picked.select("_k_html").mapInArrow(_examples(articles), _EXAMPLE).orderBy("part", "x").limit(SEQUENCES).collect()

    examples = sample_of(own.where(F.lower("_k_html").rlike("<(article|main)\\b")), True) or sample_of(own.where("_k_html is not null"), False)
    return own.mapInArrow(_extract(train(examples)), own.drop("_k_html").schema.add("_k_main", "string"))
