"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import whole
from accordant.llm.training import labelled_texts

TRAIN_DOCS = 50_000  # labelled documents whose features the model is fitted on, at most about so many
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 150, 80, 0.1, 3
NAMES = [
    "words", "word_length", "longest_word", "upper", "digits", "punctuation", "marks", "bars", "not_ascii", "spaces",
    "distinct_words", "top_word", "repeated_next", "distinct_bigrams", "repeated_lines", "line_words", "short_words",
    "ends", "capital_words", "symbols",
]
_UPPER, _DIGIT = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[0-9]")
_PUNCT, _SYMBOL = re.compile(r"[^\w\s]"), re.compile(r"[#$%&*@^~<>{}\[\]\\/_=+|]")
_CAPITAL = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")


def text_features(text: str) -> list[float]:
    """Shares and lengths of a whole text, in the order of ``NAMES``; all zero for an empty one."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    lengths = [len(w) for w in words]
    return [
        math.log1p(n), sum(lengths) / n, float(min(max(lengths), 1000)), len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars, len(_PUNCT.findall(text)) / n, text.count("!") / n, text.count("|") / n,
        1 - len(text.encode("ascii", "ignore")) / chars, (chars - sum(lengths)) / chars, len(counts) / n,
        max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(pairs) / max(1, n - 1),
        1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), sum(x <= 3 for x in lengths) / n,
        sum(w[-1] in ".!?" for w in words) / n, len(_CAPITAL.findall(text)) / n, len(_SYMBOL.findall(text)) / n,
    ]


@dataclass
class AdditiveModel:
    """Look-up tables: one per feature over its bins, one per pair of features over a coarser grid."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: additions of bins, a column at a time."""
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """Values per bin of a shallow tree that splits the bins where the loss falls most."""
    parts = [(0, len(g))]
    gain_of = lambda a, b: a * a / (b + ridge)
    while len(parts) < leaves:
        best = (1e-6, 0, 0)
        for k, (lo, hi) in enumerate(parts):
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            if hi - lo > 1:
                gain = gain_of(cg[:-1], ch[:-1]) + gain_of(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain_of(cg[-1], ch[-1])
                at = int(np.argmax(gain))
                best = max(best, (float(gain[at]), k, lo + at + 1))
        if not best[2]:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Values per cell of a tree that cuts a grid once along each axis, where the loss falls most."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    corner = lambda c: [c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]]
    out = np.zeros_like(g)
    if min(g.shape) < 2:
        return out
    gain = sum(a * a / (b + ridge) for a, b in zip(corner(cg), corner(ch)))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    for rows in (slice(None, i + 1), slice(i + 1, None)):
        for cols in (slice(None, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return out


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting: each round adds one small shallow tree per feature, then per chosen pair."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
        return AdditiveModel(math.log(p / (1 - p)))
    n, k = x.shape
    p0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    m = AdditiveModel(math.log(p0 / (1 - p0)), [_cuts(x[:, j], BINS) for j in range(k)])
    binned = [np.searchsorted(m.edges[j], x[:, j], side="right") for j in range(k)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    total = np.full(n, m.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = slopes()
            size = len(m.tables[j])
            step = RATE * _tree(np.bincount(binned[j], g, size), np.bincount(binned[j], h, size), LEAVES)
            m.tables[j] += step
            total += step[binned[j]]
    m.coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(k)]
    grid = [np.searchsorted(m.coarse[j], x[:, j], side="right") for j in range(k)]
    size = [len(c) + 1 for c in m.coarse]

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(grid[i] * size[j] + grid[j], v, size[i] * size[j]).reshape(size[i], size[j])

    g, h = slopes()
    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            sg, sh = sums(i, j, g), sums(i, j, h)
            gains.append((float((_grid_tree(sg, sh) * sg).sum()), i, j))
    chosen = [(i, j) for gain, i, j in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:PAIRS] if gain > 1e-6]
    tables = [np.zeros((size[i], size[j])) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in zip(tables, chosen):
            g, h = slopes()
            step = RATE * _grid_tree(sums(i, j, g), sums(i, j, h))
            t += step
            total += step[grid[i], grid[j]]
    m.pairs = [(i, j, t) for (i, j), t in zip(chosen, tables)]
    return m


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> AdditiveModel:
    """Fit on the features of a bounded labelled sample (``TRAIN_DOCS``), which alone come to the driver.

    Without labels, or with one kind only, the model is a constant.
    """
    train = labelled_texts(docs, labels, label, TRAIN_DOCS, key, text)
    schema = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.float64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = pa.array([text_features(t.as_py()) for t in b.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([xs, b.column("label")], schema=schema)

    got = train.mapInArrow(measure, "x array<double>, y double").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    y = (got.column("y").to_numpy() >= 0.5).astype(float)
    order = np.lexsort((*x.T, y))  # the same model whatever the order of partitions
    return fit_additive(x[order], y[order])


def quality(model: AdditiveModel, text: str = "text"):
    """A column with the probability of label 1 for the whole text; a null text is empty.

    Empty texts have all features zero and are scored like any other; repeated rows are scored one
    by one, and only the text column is read.
    """

    def judge(texts: pa.Array) -> pa.Array:
        x = np.array([text_features(t.as_py()) for t in texts], float).reshape(-1, len(NAMES))
        return pa.array(model.score(x), pa.float64())

    return F.arrow_udf(judge, "double")(whole(text))
