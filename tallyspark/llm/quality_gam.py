"""Operator 9, quality classifier: a generalised additive model with pairwise
interactions.

Each text gets a few dozen counts and ratios, computed over its whole length.
Cyclic boosting visits one feature after the other and adds a shallow tree on
that feature's bins to its lookup table; then the pairs of features that
explain most of what is left get tables over two features in the same way.
A score is the logistic of a sum of table entries, found for a batch by array
indexing.

The model is fitted on the driver from the features of at most ``SAMPLE``
labelled documents (those with the smallest hash of their id), never from
documents whose crc32(id as text) mod 3 is 1.  Labels, language, source and
id are no inputs of a score.  Labels other than 0 and 1 are ignored; several
labels of one document count as their mean; a null id is never learned from.
A null or empty text is scored like any other, with all features 0.  Without
both labels to learn from, the score is the share of label 1 (0.5 without
labels).  Of several texts of one id the one with the least features is
learned from.  Rows pass one by one, with all their columns; an empty table
gives an empty one.  A result column whose name the input has gets a trailing
underscore.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WordHasher, free, text_slices

SAMPLE = 20_000  # most labelled documents that a fit reads
BINS = 32
ROUNDS = 300
PAIRS = 8
PAIR_ROUNDS = 100
RATE = 0.1
SMOOTH = 5.0     # added to every leaf's weight

# Classes of bytes.
_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
            "space": b" \t\r\v\f", "line": b"\n", "stop": b".,;:?'\"()-", "bang": b"!", "bar": b"|"}
_NAMES = [*_CLASSES, "symbol", "high"]
FEATURES = [*(f"share_{x}" for x in _NAMES), "log_bytes", "log_words", "word_bytes", "distinct", "top_word", "repeats",
            "alternations", "lines_per_word", "symbols_per_word", "bangs_per_word", "upper_share", "stops_per_word",
            "pair_repeats", "once", "variety", "bars_per_word"]


class Features:
    """Feature rows of concatenated texts."""

    def __init__(self) -> None:
        self.words = WordHasher()
        self.kind = np.full(256, len(_NAMES) - 2, np.int64)
        for i, members in enumerate(_CLASSES.values()):
            self.kind[np.frombuffer(members, np.uint8)] = i
        self.kind[128:] = len(_NAMES) - 1

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        k, n = len(_NAMES), len(offs) - 1
        counts = np.zeros((n, k))
        if n == 1:
            for a in range(0, len(data), 1 << 20):  # a long text, in pieces
                counts[0] += np.bincount(self.kind[data[a:a + (1 << 20)]], minlength=k)
        elif len(data):
            text = np.repeat(np.arange(n) * k, np.diff(offs))
            counts = np.bincount(text + self.kind[data], minlength=n * k).reshape(n, k).astype(float)
        words, at = self.words(data, offs)
        out = np.zeros((n, len(FEATURES)))
        size = np.maximum(np.diff(offs), 1)[:, None]
        out[:, :k] = counts / size
        for i in range(n):
            w = words[at[i]:at[i + 1]]
            m = len(w)
            if not m:
                continue
            _, times = np.unique(w, return_counts=True)
            c = dict(zip(_NAMES, counts[i]))
            ink = offs[i + 1] - offs[i] - c["space"] - c["line"]
            out[i, k:] = (np.log1p(offs[i + 1] - offs[i]), np.log1p(m), ink / m, len(times) / m, times.max() / m,
                          np.count_nonzero(w[1:] == w[:-1]) / m, np.count_nonzero(w[2:] == w[:-2]) / m, c["line"] / m,
                          c["symbol"] / m, c["bang"] / m, c["upper"] / max(1.0, c["upper"] + c["lower"]), c["stop"] / m,
                          (m - len(np.unique(w[1:] * np.uint64(3) + w[:-1]))) / m if m > 1 else 0.0,
                          (times == 1).sum() / m, len(times) / np.sqrt(m), c["bar"] / m)
        return out


# --- the model ----------------------------------------------------------------

@dataclass
class Model:
    prior: float
    edges: list = field(default_factory=list)    # per feature, the upper ends of its bins but the last
    tables: list = field(default_factory=list)   # per feature, an additive term per bin
    pairs: list = field(default_factory=list)    # (feature, feature, table over both features' bins)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        z, b = np.full(len(x), self.prior), self.bins(x)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for f, g, t in self.pairs:
            z += t[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-z))


def _gain(g, h):
    return g * g / (h + SMOOTH)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value per bin of a tree of at most 2**depth leaves over gradient
    and weight histograms, each split the best of its node."""
    total = _gain(g.sum(), h.sum())
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - total
        cut = int(np.argmax(gains))
        if gains[cut] > 1e-9:
            return np.concatenate([_tree(g[:cut + 1], h[:cut + 1], depth - 1), _tree(g[cut + 1:], h[cut + 1:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + SMOOTH))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree that cuts a pair's histogram once along each axis: gain, leaf values per cell."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = [(X[:-1, :-1], X[:-1, -1:] - X[:-1, :-1], X[-1:, :-1] - X[:-1, :-1], X[-1, -1] - X[:-1, -1:] - X[-1:, :-1] + X[:-1, :-1]) for X in (G, H)]
    gains = sum(_gain(a, b) for a, b in zip(*parts)) - _gain(G[-1, -1], H[-1, -1])
    if not gains.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    leaf = [float(a[i, j] / (b[i, j] + SMOOTH)) for a, b in zip(*parts)]
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = leaf
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on features ``x`` and labels ``y`` (0 to 1)."""
    if not len(y):
        return Model(0.0)
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Model(float(np.log(p / (1 - p))))
    if y.min() == y.max():
        return model
    for f in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower"))
        model.edges.append(cuts[cuts < x[:, f].max()])
        model.tables.append(np.zeros(len(model.edges[-1]) + 1))
    b, z = model.bins(x), np.full(len(y), model.prior)

    def state():
        q = 1 / (1 + np.exp(-z))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for f, t in enumerate(model.tables):
            if len(t) > 1:
                r, w = state()
                step = RATE * _tree(np.bincount(b[:, f], r, len(t)), np.bincount(b[:, f], w, len(t)))
                t += step
                z += step[b[:, f]]

    def grid(f, g, r, w):
        shape = len(model.tables[f]), len(model.tables[g])
        cell = b[:, f] * shape[1] + b[:, g]
        return [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (r, w)]

    r, w = state()
    found = sorted(((_quadrants(*grid(f, g, r, w))[0], f, g) for f in range(x.shape[1]) for g in range(f)), reverse=True)
    model.pairs = [(f, g, np.zeros((len(model.tables[f]), len(model.tables[g])))) for gain, f, g in found[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for f, g, t in model.pairs:
            step = RATE * _quadrants(*grid(f, g, *state()))[1]
            t += step
            z += step[b[:, f], b[:, g]]
    return model


# --- on Spark -----------------------------------------------------------------

def _featured(docs: DataFrame, text_col: str, out: str, model=None) -> DataFrame:
    """``docs`` with its features as array ``out``, or with the model's score."""
    at, kind = docs.columns.index(text_col), T.DoubleType() if model is not None else T.ArrayType(T.DoubleType())

    def run(batches):
        features = Features()
        for batch in batches:
            rows = [features(data, offs) for _, _, data, offs in text_slices(batch.column(at))]
            rows = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
            new = pa.array(model.score(rows)) if model is not None else pa.array(list(rows), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, kind)]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE) -> Model:
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("y in (0, 1) and id is not null")
             .where(~held_out("id")).groupBy("id").agg(F.avg("y").alias("y")))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = _featured(texts, "text", "x").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("id").toArrow()
    if not rows.num_rows:
        return Model(0.0)
    x = np.stack(rows.column("x").to_numpy())
    return fit(x, rows.column("y").to_numpy())


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "_score") -> DataFrame:
    """``docs`` with the model's score, 0 to 1, as column ``out``."""
    return _featured(docs, text_col, free(docs, out), model)  # a model is under 100 KB
