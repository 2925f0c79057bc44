"""Toxicity by a linear-chain conditional random field over words.

Each word is toxic or not. What speaks for it are its form, its first and last letters, its length and case, and the forms
of the words before and after it; a two-state chain joins the words. Documents are labelled, words aren't: the tags of
words are latent. A clean document has no toxic word, a toxic one at least one, and the field is fitted by the likelihood
of that, in which forward-backward marginals under the label stand in for the tags. What is tied to the label by itself
(by a G-test over the documents of the sample) begins with some weight, all else with none.

Forward-backward marginals give the offending offsets; the largest and the sum of the marginals of a document, through a
logistic curve fitted on documents of the sample that the field wasn't fitted on, give its score.

Fitting uses a bounded sample: up to `SAMPLE` documents of each label, none above `SAMPLE_CHARS` characters, those with
the lowest hash of their key; of each up to `WINDOWS` windows of `WINDOW` words from anywhere in its text, first those
with a word that is tied to the label, then by hash. Scoring reads every whole text, a batch of texts at once.

Null and empty texts get the score of a text without known words. Rows without a label, or with labels other than 0 and
1, don't train; with no labelled rows of either kind every score is the prior. A key with both labels counts as toxic.
Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.batches import map_batches, slices
from . import common

SAMPLE, SAMPLE_CHARS = 2500, 50_000
#: Windows of a document that train, and their words.
WINDOWS, WINDOW = 6, 24
#: Lengths of the beginnings of words that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: What begins with a weight: documents that have it, its G for each labelled document up to a limit, and its share of toxic ones.
LEAST_TOXIC, LEAST_G, LEAST_SHARE = 3, 30.0, 0.97
#: Documents that a feature must be in, steps of fitting, and weights below which a feature goes.
LEAST_DOCUMENTS, ROUNDS, LEAST_WEIGHT = 3, 120, 0.02
#: Of the squares of features' weights.
PENALTY = 2e-4
#: Words whose weights a worker keeps in each of two generations, up to this many characters each.
KEPT_WORDS, KEPT_CHARS = 60_000, 48
THRESHOLD = 0.7
#: Words of a block in the products of the chain's matrices.
BLOCK = 32

_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    words: dict[str, float]  # features of whole words: weights of the toxic state
    begins: dict[str, float]  # and of beginnings
    bias: float
    step: tuple[tuple[float, float], tuple[float, float]]  # log potentials of going from state to state
    start: tuple[float, float]
    curve: tuple[float, float, float]  # constant, largest marginal, log of the sum of marginals
    shapes: dict[str, float] = {}  # of last letters, length and case
    before: dict[str, float] = {}  # of the word before
    after: dict[str, float] = {}  # and after


def features(word: str) -> list[tuple[str, int]]:
    """(form, 0) of the whole word and (beginning, 1) of each beginning that is shorter than it or the same."""
    return [(word, 0), *((word[:n], 1) for n in BEGINNINGS if len(word) >= n)]


def shape(word: str) -> tuple[str, str, str]:
    """Last letters, length and case of a word."""
    case = "x" if word.islower() else "X" if word.isupper() and len(word) > 1 else "Xx" if word[:1].isupper() and word[1:].islower() else "xX"
    return f"end {word[-3:].lower()}", f"size {min(len(word), 15)}", f"case {case}"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def unlike(texts: list[str], sketches: int = 8) -> list[int]:
    """Numbers of texts of which no earlier one is a near copy: copies would tie all their rare words to a label."""
    seen: dict[tuple[int, int], int] = {}
    out = []
    for i, text in enumerate(texts):
        codes = np.array([zlib.crc32(w.encode()) for w in set(words_of(text))] or [0], dtype=np.uint64)
        sketch = [(k, int(((codes * np.uint64(2 * k + 1) * np.uint64(2654435761)) % np.uint64(4294967291)).min())) for k in range(sketches)]
        if max(Counter(seen[x] for x in sketch if x in seen).values(), default=0) < sketches // 2:
            out.append(i)
            for x in sketch:
                seen.setdefault(x, i)
    return out


def _codes(text: str) -> np.ndarray:
    """Numbers of the different features of a text, as 64 bits each: all of a sample must fit in the driver."""
    return np.fromiter({hash(f) for w in set(words_of(text)) for f in features(w)}, dtype=np.int64)


def tied(texts: list[str], labels: list[int]) -> set[tuple[str, int]]:
    """Features tied to label 1, by G and by their share of toxic documents (as if both labels were as frequent)."""
    found = [np.unique(np.concatenate([_codes(t) for t, y in zip(texts, labels, strict=True) if y == k]), return_counts=True) for k in (0, 1)]
    (code0, count0), (code1, a) = found
    code1, a = code1[a >= LEAST_TOXIC], a[a >= LEAST_TOXIC].astype(np.float64)
    at = np.minimum(np.searchsorted(code0, code1), len(code0) - 1)
    b = np.where(code0[at] == code1, count0[at], 0).astype(np.float64) if len(code0) else np.zeros(len(a))
    n1, n0 = float(sum(labels)), float(len(labels) - sum(labels))
    n, g = n1 + n0, np.zeros(len(a))
    for seen, part, total in ((a, a + b, n1), (b, a + b, n0), (n1 - a, n - a - b, n1), (n0 - b, n - a - b, n0)):
        g += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1) * n / np.maximum(part * total, 1)), 0)
    least = min(LEAST_G, n1)  # few labels can't tie anything as surely as many
    chosen = set(code1[(g >= least) & (a / n1 >= LEAST_SHARE * (a / n1 + b / n0))].tolist())
    return {f for t, y in zip(texts, labels, strict=True) if y for w in set(words_of(t)) for f in features(w) if hash(f) in chosen}


def _chain(unary: np.ndarray, step: np.ndarray, start: np.ndarray):
    """Log-sum, node and edge marginals of sequences (n, length, 2)."""
    n, length, _ = unary.shape
    a, b = np.empty_like(unary), np.zeros_like(unary)
    a[:, 0] = unary[:, 0] + start
    for t in range(1, length):
        a[:, t] = np.logaddexp(a[:, t - 1, :1] + step[0], a[:, t - 1, 1:] + step[1]) + unary[:, t]
    for t in range(length - 2, -1, -1):
        x = unary[:, t + 1] + b[:, t + 1]
        b[:, t] = np.logaddexp(x[:, :1] + step[:, 0], x[:, 1:] + step[:, 1])
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    node = np.exp(a + b - z[:, None, None])
    edge = np.exp(a[:, :-1, :, None] + step + (unary + b)[:, 1:, None, :] - z[:, None, None, None])
    return z, node, edge


class Windows(NamedTuple):
    """Windows of words: features of each word (windows, words, slots; 0 is none), and the document of each window."""

    slots: np.ndarray
    document: np.ndarray
    toxic: np.ndarray  # by document


def _slots(words: list[str], i: int) -> list[tuple[str, str]]:
    """The features of a word in its text, by kind."""
    low = words[i].lower()
    out = [("words", low), *(("begins", f) for f, k in features(low) if k), *(("shapes", x) for x in shape(words[i]))]
    if i:
        out.append(("before", words[i - 1].lower()))
    if i + 1 < len(words):
        out.append(("after", words[i + 1].lower()))
    return out


def _windows(texts: list[str], labels: list[int], seeds: set[tuple[str, int]]) -> tuple[Windows, list[tuple[str, str]]]:
    """Windows of texts, and the features that are numbered in them from 1. Features are counted by hash, to hold few names."""
    rows: list[tuple[int, list[str], int]] = []
    held: Counter = Counter()
    for d, text in enumerate(texts):
        words = _WORD.findall(text)
        rank = []
        for at in range(0, len(words), WINDOW):
            known = any(f in seeds for w in words[at : at + WINDOW] for f in features(w.lower()))
            rank.append((not known, zlib.crc32(f"{at} {words[at]} {len(words)}".encode()), at))
        seen: set[int] = set()
        for *_, at in sorted(rank)[:WINDOWS]:
            begin = max(0, at - 1)  # with the words beside the window
            part = words[begin : at + WINDOW + 1]
            rows.append((d, part, at - begin))
            seen.update(hash(f) for i in range(at - begin, min(at - begin + WINDOW, len(part))) for f in _slots(part, i))
        held.update(seen)
    least = min(LEAST_DOCUMENTS, 1 + sum(labels) // 4)
    often = {h for h, n in held.items() if n >= least}
    del held
    number: dict[tuple[str, str], int] = {}
    slots = np.zeros((len(rows), WINDOW, 6 + len(BEGINNINGS)), dtype=np.int32)
    for r, (_, part, head) in enumerate(rows):
        for i in range(head, min(head + WINDOW, len(part))):
            kept = [number.setdefault(f, len(number) + 1) for f in _slots(part, i) if hash(f) in often]
            slots[r, i - head, : len(kept)] = kept
    return Windows(slots, np.array([d for d, *_ in rows], dtype=np.int64), np.array(labels, dtype=bool)), list(number)


def _fit_chain(data: Windows, weights: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, steps and start by gradient ascent (Adam) on the penalised likelihood of documents' labels.

    With p0 the probability that no word is toxic, a clean document has likelihood p0 and a toxic one 1 - p0. Under its
    label a clean document has no toxic word; in a toxic one all that isn't free of them is 1 / (1 - p0) as probable.
    Windows that are shorter than others end in words without features, which count as words.
    """
    n, size, documents = len(data.slots), len(weights), len(data.toxic)
    theta = np.concatenate([weights, [-3.0, 0.5, -0.5, -0.5, 0.5, 0.5, -0.5]])
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    flat, toxic = data.slots.reshape(-1), data.toxic[data.document]
    for k in range(1, rounds + 1):
        w, bias, step, start = theta[:size], theta[size], theta[size + 1 : size + 5].reshape(2, 2), theta[size + 5 :]
        unary = np.zeros((n, WINDOW, 2))
        unary[:, :, 1] = bias + w[data.slots].sum(axis=2)
        z, node, edge = _chain(unary, step, start)
        free = np.bincount(data.document, start[0] + (WINDOW - 1) * step[0, 0] - z, documents)  # log p0
        p0 = np.exp(np.minimum(free, 0.0))[data.document]
        more = np.where(toxic, 1 / np.maximum(1 - p0, 1e-6), 0.0)  # how much more probable anything toxic is
        none = np.where(toxic, -p0 * more, 1.0)  # and what nothing toxic adds to that
        off = (more - 1)[:, None] * node[:, :, 1]
        moved = np.einsum("n,nij->ij", more - 1, edge.sum(axis=1))
        moved[0, 0] += (none * (WINDOW - 1)).sum()
        began = ((more - 1)[:, None] * node[:, 0]).sum(axis=0)
        began[0] += none.sum()
        grad = np.concatenate([np.bincount(flat, np.repeat(off.reshape(-1), data.slots.shape[2]), size), [off.sum()], moved.ravel(), began]) / documents
        grad[0] = 0.0
        grad[:size] -= PENALTY * w
        grad[size:] -= 1e-4 * theta[size:]
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta = theta + 0.08 * (moment / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-6)
        theta[0] = 0.0
    return theta[:size], float(theta[size]), theta[size + 1 : size + 5].reshape(2, 2), theta[size + 5 :]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients by Newton steps with a small penalty."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta)), x.T @ (weight * (y - p)) - 1e-2 * beta)
    return beta


def fit(texts: list[str], labels: list[int], prior: float) -> Model:
    """A model of whole texts and their labels (0 or 1). prior: share of label 1 among all labelled rows."""
    base = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    none = Model({}, {}, -5.0, ((0.0, 0.0), (0.0, 0.0)), (0.0, 0.0), (base, 0.0, 0.0))
    own = unlike(texts)
    texts, labels = [texts[i] for i in own], [labels[i] for i in own]
    if not 0 < sum(labels) < len(labels):
        return none
    apart = [zlib.crc32(t.encode(errors="replace")) % 4 == 0 for t in texts]  # these give the curve
    if len({(a, y) for a, y in zip(apart, labels, strict=True)}) < 4 or sum(y for a, y in zip(apart, labels, strict=True) if a) < 10:
        apart = None
    part = [i for i in range(len(texts)) if not (apart and apart[i])]
    given, marks = [texts[i] for i in part], [labels[i] for i in part]
    seeds = tied(given, marks)
    data, names = _windows(given, marks, seeds)
    kinds = {"words": 0, "begins": 1}
    weights = np.array([0.0, *(2.0 if (f, kinds.get(kind, 2)) in seeds else 0.0 for kind, f in names)])
    w, bias, step, start = _fit_chain(data, weights)
    by_kind: dict[str, dict[str, float]] = {k: {} for k in ("words", "begins", "shapes", "before", "after")}
    for (kind, f), x in zip(names, w[1:].tolist(), strict=True):
        if abs(x) >= LEAST_WEIGHT:
            by_kind[kind][f] = x
    model = Model(bias=bias, step=tuple(map(tuple, step.tolist())), start=tuple(start.tolist()), curve=none.curve, **by_kind)
    scored = [i for i in range(len(texts)) if apart is None or apart[i]]
    x = Tagger(model).summaries([texts[i] for i in scored])
    y = np.array([labels[i] for i in scored], dtype=float)
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    return model._replace(curve=tuple(_logistic(x, y, weight).tolist()))


def posteriors(odds: np.ndarray, sizes: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of the toxic state of each word of texts one after the other, none of them empty.

    odds are the words' log potentials of that state. Words are dealt in blocks, whose matrices are multiplied for all
    blocks at once; from block to block go vectors, for all texts at once; and inside blocks again vectors.
    """
    blocks = -(-sizes // BLOCK)
    begin = np.cumsum(blocks) - blocks
    n = int(blocks.sum())
    place = np.repeat(begin * BLOCK - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(odds))
    e, real = np.ones(n * BLOCK), np.zeros(n * BLOCK, bool)
    e[place], real[place] = np.exp(np.clip(odds, -30, 30)), True
    e, real = (np.ascontiguousarray(x.reshape(n, BLOCK).T) for x in (e, real))
    first = np.zeros(n, bool)
    first[begin] = True
    (a, b), (c, d) = np.exp(step - step.max())

    def onward(x, y, t):
        """A vector before a word to one after it."""
        head = first if t == 0 else False
        u, v = np.where(head, x, x * a + y * c), np.where(head, y, x * b + y * d) * e[t]
        u, v = np.where(real[t], u, x), np.where(real[t], v, y)
        return u / (u + v), v / (u + v)

    def raw(x, y, t):
        head = first if t == 0 else False
        u, v = np.where(head, x, x * a + y * c), np.where(head, y, x * b + y * d) * e[t]
        return np.where(real[t], u, x), np.where(real[t], v, y)

    one, two = (np.ones(n), np.zeros(n)), (np.zeros(n), np.ones(n))  # rows of the product of a block's matrices
    for t in range(BLOCK):
        one, two = raw(*one, t), raw(*two, t)
        scale = one[0] + one[1] + two[0] + two[1]
        one, two = (one[0] / scale, one[1] / scale), (two[0] / scale, two[1] / scale)
    order = np.argsort(-blocks, kind="stable")
    ranked, begin = blocks[order], begin[order]
    s = np.exp(start - start.max())
    x, y = np.full(len(sizes), s[0]), np.full(len(sizes), s[1])
    into, out = np.zeros((2, n)), np.zeros((2, n))
    for j in range(int(ranked[0]) if len(ranked) else 0):
        m = int(np.searchsorted(-ranked, -j, side="left"))  # texts with more than j blocks
        i, x, y = begin[:m] + j, x[:m], y[:m]
        into[0, i], into[1, i] = x, y
        x, y = x * one[0][i] + y * two[0][i], x * one[1][i] + y * two[1][i]
        x, y = x / (x + y), y / (x + y)
    x, y = np.ones(len(sizes)), np.ones(len(sizes))
    for j in range(int(ranked[0]) - 1 if len(ranked) else -1, -1, -1):
        m = int(np.searchsorted(-ranked, -j, side="left"))
        i = begin[:m] + j
        out[0, i], out[1, i] = x[:m], y[:m]
        u, v = one[0][i] * x[:m] + one[1][i] * y[:m], two[0][i] * x[:m] + two[1][i] * y[:m]
        x[:m], y[:m] = u / (u + v), v / (u + v)
    ahead, p = np.zeros((BLOCK, 2, n)), np.zeros((BLOCK, n))
    x, y = into
    for t in range(BLOCK):
        x, y = onward(x, y, t)
        ahead[t] = x, y
    x, y = out
    for t in range(BLOCK - 1, -1, -1):
        u, v = ahead[t, 0] * x, ahead[t, 1] * y
        p[t] = v / (u + v)
        w = y * e[t]
        u, v = np.where(real[t], a * x + b * w, x), np.where(real[t], c * x + d * w, y)
        x, y = u / (u + v), v / (u + v)
    return p.T.reshape(-1)[place]


class Tagger:
    def __init__(self, model: Model):
        self.model = model
        self._step, self._start = np.array(model.step), np.array(model.start)
        #: Weights of a word for itself, as the one before and as the one after; and whether its form or beginning is known.
        self._young: dict[str, tuple[float, float, float, bool]] = {}
        self._old: dict[str, tuple[float, float, float, bool]] = {}
        self._equal: dict[tuple, tuple[float, float, float, bool]] = {}

    def _weigh(self, word: str) -> tuple[float, float, float, bool]:
        if (found := self._young.get(word) or self._old.get(word)) is None:
            m, low = self.model, word.lower()
            forms = [x for f, k in features(low) if (x := (m.begins if k else m.words).get(f)) is not None]
            shapes = sum(m.shapes.get(x, 0.0) for x in shape(word)) if m.shapes else 0.0
            found = sum(forms) + shapes, m.before.get(low, 0.0), m.after.get(low, 0.0), bool(forms)
            found = self._equal.setdefault(found, found)  # most words weigh alike
        if len(word) <= KEPT_CHARS:
            if len(self._young) >= KEPT_WORDS:
                self._old, self._young, self._equal = self._young, {}, {}
            self._young[word] = found
        return found

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of texts: the probability of the toxic state, whether form or beginning is known; and words of each text."""
        words = [_WORD.findall(t) for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        total = int(sizes.sum())
        if not total:
            return np.zeros(0), np.zeros(0, bool), sizes
        young, weigh = self._young.get, self._weigh
        found = np.array([young(w) or weigh(w) for w in chain.from_iterable(words)], dtype=np.float64)
        odds, full = self.model.bias + found[:, 0], sizes[sizes > 0]
        head, last = np.cumsum(full) - full, np.cumsum(full) - 1
        inner = np.ones(total, bool)
        inner[head] = False
        at = np.flatnonzero(inner)
        odds[at] += found[at - 1, 1]
        inner[:] = True
        inner[last] = False
        at = np.flatnonzero(inner)
        odds[at] += found[at + 1, 2]
        return posteriors(odds, full, self._step, self._start), found[:, 3] > 0, sizes

    def marginals(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability of the toxic state) of each word whose form or beginning is known."""
        p, known, _ = self.batch([text])
        return [(*m.span(), float(x)) for m, x, k in zip(_WORD.finditer(text), p, known, strict=True) if k]

    @staticmethod
    def summary(marginals: list[tuple[int, int, float]]) -> tuple[float, float, float]:
        p = [x for *_, x in marginals]
        return 1.0, max(p, default=0.0), math.log1p(sum(p))

    def score(self, marginals: list[tuple[int, int, float]]) -> float:
        z = sum(a * b for a, b in zip(self.model.curve, self.summary(marginals), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def summaries(self, texts: list[str]) -> np.ndarray:
        """As summary, of each text."""
        return self._summaries(*self.batch(texts))

    @staticmethod
    def _summaries(p: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sizes), 3))
        out[:, 0] = 1.0
        if full := np.flatnonzero(sizes).tolist():
            begin = (np.cumsum(sizes) - sizes)[full]
            own = np.where(known, p, 0.0)
            out[full, 1], out[full, 2] = np.maximum.reduceat(own, begin), np.log1p(np.add.reduceat(own, begin))
        return out

    def judge(self, texts: list[str]) -> tuple[list[float], list[list[dict]]]:
        """Score of each text, and its words that are toxic with probability of a half or more."""
        p, known, sizes = self.batch(texts)
        z = self._summaries(p, known, sizes) @ np.array(self.model.curve)
        scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        spans: list[list[dict]] = [[] for _ in texts]
        begin = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(known & (p >= 0.5))
        for i in np.unique(np.searchsorted(begin + sizes, hit, side="right")).tolist():
            part = p[begin[i] : begin[i] + sizes[i]], known[begin[i] : begin[i] + sizes[i]]
            spans[i] = [{"start": m.start(), "end": m.end(), "p": float(x)} for m, x, k in zip(_WORD.finditer(texts[i]), *part, strict=True) if k and x >= 0.5]
        return scores.tolist(), spans


@lru_cache(maxsize=1)
def _tagger(fields: tuple) -> Tagger:
    return Tagger(Model(*(dict(f) if isinstance(f, frozenset) else f for f in fields)))


def held_out(key: Column) -> Column:
    """Whether a key's CRC-32 (of its text) leaves 1 when divided by 3: such rows never train."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on labelled rows that aren't held out. The ids of the sample are bounded by `sample`, so they are broadcast."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    usable = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where(F.length("t") <= SAMPLE_CHARS)
    once = usable.join(ids, "k").groupBy("k", "y").agg(F.min("t").alias("t"))  # a key may have many rows
    rows = sorted((str(r["k"]), r["t"], r["y"]) for r in once.collect())
    return fit([t for _, t, _ in rows], [y for *_, y in rows], counts.get(1, 0) / max(1, sum(counts.values())))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, score, and spans: array of (start, end, p) of words that are toxic with probability p of a half or more."""
    args = tuple(frozenset(f.items()) if isinstance(f, dict) else f for f in model)
    return common.map_texts(df, lambda texts: _tagger(args).judge(texts), "score double, spans array<struct<start: int, `end`: int, p: double>>", key, text)


def clean(df: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of df whose text scores below the threshold, with all their columns: each row is judged by itself, whatever its key."""
    args = tuple(frozenset(f.items()) if isinstance(f, dict) else f for f in model)
    at = df.columns.index(text)

    def run(batches):
        for b in slices(batches, at):
            scores, _ = _tagger(args).judge([t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return map_batches(df, run, df.schema)
