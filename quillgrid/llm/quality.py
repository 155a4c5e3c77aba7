"""Quality classifier: a generalised additive model with pairwise interactions (Lou et al. 2013; Nori et al. 2019).

Numeric features of the whole text are cut into quantile bins. Boosting goes
round the features: each step fits a shallow tree to one feature's residual
histogram and adds its leaves, shrunk, to that feature's lookup table; after
the single features, the pairs that lower the loss most get tables of their
own in the same way. A score is the sigmoid of an intercept and one table
entry a feature and pair: vectorised bin additions.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the
smallest id digests, ties by label and then by features; scoring covers every
row and reads every text whole, however long. Null and empty texts have all
features 0 and a score like any other. Repeated rows and ids count each on
their own. With no labels, or only one class, scores are the class's share
(0.5 without labels). An empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import materialise, release
from quillgrid.llm.kernels import ALNUM, NONSPACE, LOWER_BYTES, text_slices, word_hashes, word_spans

SAMPLE = 30_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, RATE, PAIRS, LEAST = 200, 60, 0.1, 6, 20

FEATURES = (
    "log_words", "mean_word", "long_word_share", "upper_share", "digit_share", "mark_share", "space_share", "line_share", "high_byte_share",
    "distinct_word_share", "distinct_line_share", "upper_word_share", "mark_word_share", "stop_end_share", "pipe_share", "mean_line",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_LOWER_WORD = ALNUM & ~_DIGIT
_MARK = NONSPACE & ~_HIGH & ~ALNUM[LOWER_BYTES]
_LINE = np.ones(256, bool)
_LINE[10] = False


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, features) of a slice; every entry is finite."""
    n = len(offs) - 1
    sums = lambda at: at[offs[1:]] - at[offs[:-1]]
    count = lambda member: sums(np.concatenate([[0], np.cumsum(member[data])]))
    size = np.maximum(np.diff(offs), 1).astype(float)
    starts, ends, first = word_spans(data, offs, NONSPACE)
    n_words = np.diff(first)
    words = np.maximum(n_words, 1).astype(float)
    by_word = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
    length = ends - starts
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    marks = np.concatenate([[0], np.cumsum(_MARK[data])])
    lines_a, lines_b, line_first = word_spans(data, offs, _LINE)
    n_lines = np.maximum(np.diff(line_first), 1).astype(float)

    def distinct(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = word_hashes(data, a, b)
        owner = np.repeat(np.arange(n), np.diff(at))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
        return np.bincount(owner[new], minlength=n)

    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    return np.column_stack([
        np.log1p(n_words), by_word(length) / words, by_word(length > 20) / words, count(_UPPER) / size, count(_DIGIT) / size, count(_MARK) / size, count(~NONSPACE) / size,
        n_lines / words, count(_HIGH) / size, distinct(starts, ends, first) / words, distinct(lines_a, lines_b, line_first) / n_lines,
        by_word(upper[ends] - upper[starts] > 0.6 * length) / words, by_word(marks[ends] - marks[starts] >= 2) / words, by_word((last == 46) | (last == 33) | (last == 63)) / words,
        by_word((length == 1) & (last == 124)) / words, np.log1p(np.diff(offs) / n_lines),
    ])


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)  #: bin borders by feature
    intercept: float = 0.0
    tables: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            z += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[_coarse(b[:, i]), _coarse(b[:, j])]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _coarse(b: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // BINS


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values by bin of a depth-limited tree on one feature's histogram of gradients."""
    G, H, N = np.cumsum(g), np.cumsum(h), np.cumsum(n)
    if depth and len(g) > 1:
        left = _gain(G[:-1], H[:-1]) + _gain(G[-1] - G[:-1], H[-1] - H[:-1])
        left[(N[:-1] < LEAST) | (N[-1] - N[:-1] < LEAST)] = -1
        at = int(np.argmax(left))
        if left[at] > _gain(G[-1], H[-1]) + 1e-9:
            cut = at + 1
            return np.concatenate([_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)])
    return np.full(len(g), G[-1] / (H[-1] + 1.0))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Four leaves of the best cross cut of a pair's histogram, and its gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = -1.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            gs = (G[i, j], G[i, -1] - G[i, j], G[-1, j] - G[i, j], G[-1, -1] - G[i, -1] - G[-1, j] + G[i, j])
            hs = (H[i, j], H[i, -1] - H[i, j], H[-1, j] - H[i, j], H[-1, -1] - H[i, -1] - H[-1, j] + H[i, j])
            gain = sum(a * a / (b + 1.0) for a, b in zip(gs, hs, strict=True))
            if gain > best:
                leaf = [a / (b + 1.0) for a, b in zip(gs, hs, strict=True)]
                out = np.empty_like(g)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
                best = gain
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on the logistic loss; the same rows give the same model."""
    if not len(y):
        return Model()
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    if y.min() == y.max():
        return Model(intercept=float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    m = Model(edges, float(np.log(share / (1 - share))), np.zeros((x.shape[1], BINS)))
    b = m.bins(x)
    z = np.full(len(y), m.intercept)
    for _ in range(ROUNDS):
        for j in range(x.shape[1]):
            p = 1 / (1 + np.exp(-z))
            g, h, n = (np.bincount(b[:, j], w, minlength=BINS) for w in (y - p, p * (1 - p), None))
            step = RATE * _tree(g, h, n, 2)
            m.tables[j] += step
            z += step[b[:, j]]
    p = 1 / (1 + np.exp(-z))
    c = _coarse(b)
    cell = lambda i, j: c[:, i] * PAIR_BINS + c[:, j]
    grid = lambda i, j, w: np.bincount(cell(i, j), w, minlength=PAIR_BINS**2).reshape(PAIR_BINS, -1)
    gains = [(-_pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1], i, j) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])]
    m.pairs = [(i, j) for _, i, j in sorted(gains)[:PAIRS]]
    m.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(m.pairs, m.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0]
            table += step
            z += step[c[:, i], c[:, j]]
    return m


def _digest(doc_id):
    return F.xxhash64(doc_id.cast("string"), F.lit("sample"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the ``sample`` labelled rows of smallest id digest. ``labels`` has doc_id and quality; null labels are not learned."""
    marked = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_y"))
    chosen = marked.orderBy(_digest(F.col("_id")), "_y").limit(sample)  # bounded by the parameter, hence fit to be broadcast
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_slices(batch, "text"):
                found = features(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(list(found), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # Written once by all executors, then read; repeated doc_ids may multiply rows, so the bound holds once more.
    learned = materialise(rows.mapInArrow(work, "doc_id long, y double, x array<double>"))
    got = sorted((r["doc_id"], r["y"], *r["x"]) for r in learned.orderBy(_digest(F.col("doc_id")), "doc_id", "y", "x").limit(sample).collect())
    release(learned)
    if not got:
        return Model()
    held = np.array([r[1:] for r in got])
    return fit(held[:, 1:], held[:, 0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sent.value.score(features(data, offs)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")
