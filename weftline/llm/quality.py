"""Quality rules: document statistics, a rule base, and gradient-boosted trees on top.

The trees are trained on a bounded sample of labelled documents (``MAX_LABELLED`` rows, the first in
the order of a hash of doc_id), flattened into numpy node arrays and evaluated for a whole slice of
documents at a time. Features named in ``MONOTONE`` may move the score in one direction only.

Defined results: a null text is an empty one (no words, fails the base); a document without a label
is scored all the same; labels with a null are left out; without both classes among the labels the
verdict is that of the base alone; ties, repeated rows and extra columns change nothing, as each row
is judged by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, SPACES, map_slices, utf8

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: A document is rejected where the estimated probability of good quality is below this.
KEEP_FROM = 0.25
#: Bound of the labelled sample that the trees are trained on.
MAX_LABELLED = 6000

FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "line_words", "distinct_share")
#: More of these never raises the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}

_rng = np.random.default_rng(8)
_COEF = _rng.integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?|=_~^{}[]"


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of width words that occur at least twice in the list."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n) + np.uint64(1)
    m = n - width + 1
    code *= np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    keys = np.zeros(m, np.uint64)
    for j in range(width):
        keys += code[j : j + m] * _COEF[j]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, np.int64)
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, starts, 1)
    np.add.at(twice, starts + width, -1)
    return int((np.cumsum(twice[:n]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], the FEATURES) of a whole text."""
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    bare = raw.translate(None, SPACES)
    chars = len(text or "") - (len(raw) - len(bare))
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = dups = 0
    for line in raw.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            dups += line in seen
            seen.add(line)
    repeats = repeat_words(words)
    some = max(1, chars)
    share = lambda kind: (len(bare) - len(bare.translate(None, kind))) / some
    return [n, chars, symbols, dups, repeats], [
        float(np.log1p(n)), chars / max(1, n), symbols / some, dups / max(1, lines), repeats / max(1, n),
        share(_UPPER), share(_DIGITS), share(_MARKS), n / max(1, lines), len(set(words)) / max(1, n),
    ]


def base_failed(counts: list[int]) -> bool:
    n, _, _, _, repeats = counts
    return n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n


@dataclass
class Forest:
    """All trees in one set of node arrays; feature -1 marks a leaf. root[i] is the first node of tree i."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.root:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, down, at)
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, penalty: float = 1.0, monotone: dict[str, int] | None = None) -> Forest:
    """Second-order boosting of the logistic loss on binned features.

    A split on a constrained feature is taken only if its two leaf values have the asked order, and
    its children inherit the middle of the two as a bound, so the whole tree keeps the direction."""
    signs = np.array([(MONOTONE if monotone is None else monotone).get(f, 0) for f in FEATURES[: x.shape[1]]] + [0] * max(0, x.shape[1] - len(FEATURES)))
    if len(x) == 0 or y.min() == y.max():
        none = np.zeros(0, np.int64)
        return Forest(none, none.astype(float), none, none, none.astype(float), none, 50.0, 0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(prior / (1 - prior)))
    score = np.full(len(x), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + penalty), lo, hi))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        me, gs, hs = len(nodes), g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, 0, 0, rate * leaf(gs, hs, lo, hi)])
        best = (1e-6, -1, 0, 0.0)
        for f in range(x.shape[1] if level < depth and len(rows) >= 20 else 0):
            k = len(edges[f])
            if not k:
                continue
            gl, hl = (np.cumsum(np.bincount(code[rows, f], v[rows], k + 1))[:-1] for v in (g, h))
            gr, hr = gs - gl, hs - hl
            wl, wr = (np.clip(-a / (b + penalty), lo, hi) for a, b in ((gl, hl), (gr, hr)))
            gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - gs**2 / (hs + penalty)
            gain[(hl < 1) | (hr < 1) | (signs[f] * (wr - wl) < 0)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at, float(wl[at] + wr[at]) / 2)
        if best[1] >= 0:
            _, f, at, mid = best
            goes = code[rows, f] <= at
            bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[int(signs[f])]
            nodes[me][:2] = [f, float(edges[f][at])]
            nodes[me][2] = grow(rows[goes], g, h, level + 1, *bounds[0])
            nodes[me][3] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        first = len(nodes)
        roots.append(grow(np.arange(len(x)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        part = np.array(nodes[first:])
        tree = Forest(part[:, 0].astype(int), part[:, 1], part[:, 2].astype(int) - first, part[:, 3].astype(int) - first, part[:, 4], np.zeros(1, int), 0.0, depth)
        score = score + tree.margin(x)
    flat = np.array(nodes)
    return Forest(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots), base, depth)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Forest:
    """Trains on at most ``most`` labelled documents. The sample of labels is taken first, so that only
    its documents, never more than that bound, are measured and brought to the driver."""
    chosen = (
        labels.filter("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    taken = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def rows(got: dict[str, list]) -> dict[str, list]:
        return {"x": [statistics(t)[1] for t in got["text"]], "quality": got["quality"], "doc_id": got["doc_id"]}

    # A repeated doc_id counts once, so the bound holds; the first by its features.
    one = map_slices(taken, rows, "doc_id long, quality int, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("quality"))
    got = one.orderBy("doc_id").collect()
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    return train(x, np.array([r["quality"] for r in got], float))


def verdicts(model: Forest, texts: list[str | None]) -> tuple[list[list[int]], list[bool], list[bool], list[float]]:
    measured = [statistics(t) for t in texts]
    failed = [base_failed(c) for c, _ in measured]
    p = model.probability(np.array([f for _, f in measured], float).reshape(len(texts), len(FEATURES)))
    return [c for c, _ in measured], failed, [bool(not b and q >= KEEP_FROM) for b, q in zip(failed, p)], p.tolist()


def assess(docs: DataFrame, model: Forest) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and p_good of every row of docs."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        counts, failed, kept, p = verdicts(model, got["text"])
        n = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), map(list, zip(*counts))))
        return {"doc_id": got["doc_id"], **n, "base_failed": failed, "kept": kept, "p_good": p}

    return map_slices(docs.select("doc_id", "text"), rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double")


def keep(docs: DataFrame, model: Forest) -> DataFrame:
    """The rows of docs, all columns as they are, that the rules and the trees keep."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield part.filter(pa.array(verdicts(model, part.column(at).to_pylist())[2], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
