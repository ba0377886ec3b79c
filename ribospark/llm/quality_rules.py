"""Quality rules: document statistics judged by gradient-boosted trees.

``document_stats`` turns a text into a row of statistics. ``BoostedTrees`` fits
second-order boosted trees (logistic loss, histogram splits) on the driver from a bounded
sample of labelled documents; chosen features are monotone: a split that would let the
score rise with them is refused, and child values are held to the bounds that their
ancestors set. The fitted ensemble is flattened into node arrays (feature, threshold,
left, right, value) and scored level by level over whole batches.

Base rule: a document with under ``min_words`` words, or with more than half of its words
in repeated 3-word windows, fails without asking the trees.

Sample bound: about ``max_labelled`` labelled documents, those whose hashed id falls under
a threshold that their number gives; labels are learned from, never used when judging. Without labels of both classes no
trees are fitted and the base rule alone decides.

Defined results: a null text has no words (and fails); repeated rows give repeated
results; of a doc_id with several labels their mean counts (over a half is good), of several
texts with one id the least is learned from; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.llm.common import WORD, hash_limit, map_batches

_SYMBOLS = list(b"#*$%&|<>")
_SPACES = list(b"\x20\x09\x0a\x0b\x0c\x0d")
_PUNCTUATION = [x for x in range(33, 127) if not chr(x).isalnum()]
#: Features of the trees, and the direction in which the score may move with each (0: free).
FEATURES = (("log_words", 0), ("mean_word", 0), ("symbol_rate", -1), ("dup_line_rate", -1), ("repeat_rate", -1), ("upper_rate", 0), ("digit_rate", 0), ("punct_rate", 0), ("bang_rate", -1), ("pipe_rate", -1), ("words_per_line", 0), ("short_word_rate", 0), ("distinct_rate", 0))


@dataclass(frozen=True)
class Stats:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: tuple[float, ...]


def repeated_window_words(words: list[str], size: int = 3) -> int:
    """How many words stand in windows of ``size`` words that occur more than once in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key = codes[:n]
    for k in range(1, size):
        key = key * len(ids) + codes[k : k + n]
        if len(ids) ** (min(k + 2, size)) >= 2**62 or k == size - 1:  # renumbered before a key could overflow
            key = np.unique(key, return_inverse=True)[1]
    often = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + n] |= often
    return int(covered.sum())


def document_stats(text: str | None) -> Stats:
    """The counts of a whole text and the features of the trees."""
    text = text or ""
    words = WORD.findall(text)
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
    n, chars = len(words), len(text) - int(count[_SPACES].sum())
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line and WORD.search(line):
            lines += 1
            dups += line in seen
            seen.add(line)
    symbols = int(count[_SYMBOLS].sum())
    repeats = repeated_window_words(words)
    short = int((np.fromiter(map(len, words), np.int64, n) < 4).sum())
    w, c = max(n, 1), max(chars, 1)
    features = (
        float(np.log1p(n)), chars / w, symbols / c, dups / max(lines, 1), repeats / w, float(count[65:91].sum() / c), float(count[48:58].sum() / c),
        float(count[_PUNCTUATION].sum() / c), float(count[33] / c), float(count[124] / c), n / max(lines, 1), short / w, len(set(words)) / w,
    )
    return Stats(n, chars, symbols, dups, repeats, features)


class BoostedTrees:
    """Boosted regression trees on the logistic loss, flattened into node arrays."""

    def __init__(self, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, min_rows: int = 20, monotone: tuple[int, ...] = ()):
        self.n_trees, self.depth, self.rate, self.bins, self.l2, self.min_rows, self.monotone = n_trees, depth, rate, bins, l2, min_rows, monotone

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)], axis=1)  # bin b: value <= edges[b]
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self.roots: list[int] = []
        margin = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            self.roots.append(len(self.nodes))
            self._grow(binned, edges, p - y, p * (1 - p), np.arange(len(y)), 0, -np.inf, np.inf, margin)
        cols = list(zip(*self.nodes))
        self.feature, self.left, self.right = (np.array(cols[i], np.int32) for i in (0, 2, 3))
        self.threshold, self.value = np.array(cols[1]), np.array(cols[4])
        return self

    def _grow(self, binned, edges, g, h, rows, level, low, high, margin) -> int:
        at = len(self.nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + self.l2), low, high))
        self.nodes.append((-1, 0.0, at, at, value * self.rate))
        best = None
        if level < self.depth and len(rows) >= 2 * self.min_rows:
            for f, e in enumerate(edges):
                if len(e) == 0:
                    continue
                b = binned[rows, f]
                gl, hl, nl = (np.bincount(b, w, len(e) + 1).cumsum()[:-1] for w in (g[rows], h[rows], None))
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + self.l2), low, high), np.clip(-gr / (hr + self.l2), low, high)
                gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - total_g**2 / (total_h + self.l2)
                bad = (nl < self.min_rows) | (len(rows) - nl < self.min_rows)
                if self.monotone and self.monotone[f]:
                    bad |= (vr - vl) * self.monotone[f] < 0
                gain[bad] = -np.inf
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k, vl[k], vr[k])
        if best is None:
            margin[rows] += value * self.rate
            return at
        _, f, k, vl, vr = best
        bounds_l, bounds_r, middle, way = (low, high), (low, high), (vl + vr) / 2, self.monotone[f] if self.monotone else 0
        if way > 0:
            bounds_l, bounds_r = (low, middle), (middle, high)
        elif way < 0:
            bounds_l, bounds_r = (middle, high), (low, middle)
        goes = binned[rows, f] <= k
        left = self._grow(binned, edges, g, h, rows[goes], level + 1, *bounds_l, margin)
        right = self._grow(binned, edges, g, h, rows[~goes], level + 1, *bounds_r, margin)
        self.nodes[at] = (f, float(edges[f][k]), left, right, 0.0)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: all rows walk all trees at once, one level at a time."""
        at = np.repeat(np.array(self.roots, np.int32)[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            at = np.where(f < 0, at, np.where(x[row, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at]))
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


_STATS_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _stats_columns(stats: list[Stats]) -> dict:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return {k: [getattr(s, k) for s in stats] for k in names}


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 8_000) -> BoostedTrees | None:
    """Trees fitted on a hash sample of about ``max_labelled`` labelled documents."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).filter("_id is not null and _y is not null")
    known = known.groupBy("_id").agg(F.avg("_y").alias("_y"))
    picked = known.filter(F.xxhash64("_id") <= hash_limit(max_labelled / max(1, known.count())))
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(picked), "_id")
    sample = sample.groupBy("_id").agg(F.min(F.struct("_text", "_y")).alias("m")).select("m._text", "m._y")  # one text of each id

    def rows(batches: Iterator[dict]):
        for b in batches:
            yield {"y": b["_y"], "x": [list(document_stats(t).features) for t in b["_text"].to_pylist()]}

    found = map_batches(sample, rows, "y double, x array<double>").collect()
    y = np.array([float(r["y"] > 0.5) for r in found])
    if len(y) == 0 or y.min() == y.max():
        return None
    x = np.array([r["x"] for r in found])
    order = np.lexsort([*x.T, y])  # the fit doesn't depend on the order of arrival
    return BoostedTrees(monotone=tuple(m for _, m in FEATURES)).fit(x[order], y[order])


def judge_quality(docs: DataFrame, model: BoostedTrees | None, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, least: float = 0.5) -> DataFrame:
    """Statistics, base rule and verdict of every document; ``quality`` is the trees' probability."""

    def rows(batches: Iterator[dict]):
        for b in batches:
            ids, texts = b[id_col], b["_text"]
            for at in range(0, len(ids), 500):
                stats = [document_stats(t) for t in texts[at : at + 500].to_pylist()]
                failed = [s.n_words < min_words or 100 * s.n_repeat_words > 50 * s.n_words for s in stats]
                quality = model.predict(np.array([s.features for s in stats])) if model else np.ones(len(stats))
                yield {id_col: ids[at : at + 500], **_stats_columns(stats), "base_failed": failed, "kept": [not f and q >= least for f, q in zip(failed, quality.tolist())], "quality": quality}

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return map_batches(kept, rows, f"{id_col} long, {_STATS_DDL}, base_failed boolean, kept boolean, quality double")
