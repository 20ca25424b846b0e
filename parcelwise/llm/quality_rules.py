"""Quality rules by gradient-boosted trees over document statistics.

Base statistics are exact counts over every whole text. On their ratios a gradient-boosted tree model is trained (here,
in numpy, on TRAIN_ROWS labelled rows at most, chosen by a hash of doc_id), with monotonic constraints: more symbols,
repeated lines or repeated words never raise the score. The trees are flattened into node arrays and a batch of
documents walks them level by level.

A null or empty text has no words and fails the base rules. Repeated rows get equal results. An empty table gives an
empty result; without labels of both kinds the base rules alone decide. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import map_batches, text_of, texts_utf8

TRAIN_ROWS, TREES, DEPTH, RATE, BINS, LAMBDA, MIN_ROWS = 6000, 60, 3, 0.2, 48, 5.0, 10
#: Kept if the model's score is this much at least.
KEEP_SCORE = 0.5
SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Model features, and how the score may follow each: -1 never rises, 0 free.
FEATURES = {"log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "lines_per_word": 0, "stops_per_word": 0, "upper_share": 0, "digits_per_word": 0}


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one text (UTF-8)."""
    words = text.split()
    n = len(words)
    chars = np.frombuffer(text, np.uint8)
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    word_chars = int(np.count_nonzero(~space & ((chars & 0xC0) != 0x80)))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    repeated = 0
    if n >= 4:
        pairs = ids[:-1] * len(numbers) + ids[1:]
        if len(numbers) < 1 << 20:
            triples = pairs[:-1] * len(numbers) + ids[2:]
        else:  # the product would not fit: rank the pairs first
            triples = np.unique(pairs[:-1], return_inverse=True)[1] * len(numbers) + ids[2:]
        _, inverse, times = np.unique(triples, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeated = int(np.count_nonzero(covered))
    counts = [n, word_chars, symbols, dup_lines, repeated]
    per = max(n, 1)
    stops = text.count(b".") + text.count(b"!") + text.count(b"?")
    upper = np.count_nonzero((chars >= 65) & (chars <= 90))
    digits = np.count_nonzero((chars >= 48) & (chars <= 57))
    return counts, [np.log1p(n), word_chars / per, symbols / per, dup_lines / max(len(lines), 1), repeated / per, len(numbers) / per, len(lines) / per, stops / per, upper / max(len(chars), 1), digits / per]


@dataclass
class Trees:
    """Node arrays of all trees, one row a tree: a node's feature (-1: a leaf), threshold (left if at most), children and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the kept class for each row of features."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in zip(self.feature, self.threshold, self.left, self.right, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                split = feature[at]
                inner = split >= 0
                goes_left = x[rows, np.where(inner, split, 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            margin += value[at]
        return 1 / (1 + np.exp(-margin))


def boost(x: np.ndarray, y: np.ndarray, monotone: list[int]) -> Trees:
    """Logistic boosting with second-order gains; a node's value lies within bounds that its constrained ancestors set."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin, size, grown = np.full(len(y), base), 2 ** (DEPTH + 1) - 1, []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for node in range(size):
            if node not in bounds:
                continue
            mine, (low, high) = at == node, bounds[node]
            g0, h0 = g[mine].sum(), h[mine].sum()
            value[node] = RATE * np.clip(g0 / (h0 + LAMBDA), low, high)
            if 2 * node + 2 >= size or np.count_nonzero(mine) < 2 * MIN_ROWS:
                continue
            best = (1e-6, None)
            for f, cut in enumerate(cuts):
                b = binned[mine, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(cut) + 1))[:-1] for w in (g[mine], h[mine], np.ones(len(b))))
                vl, vr = np.clip(gl / (hl + LAMBDA), low, high), np.clip((g0 - gl) / (h0 - hl + LAMBDA), low, high)
                gain = gl * vl - (hl + LAMBDA) * vl**2 / 2 + (g0 - gl) * vr - (h0 - hl + LAMBDA) * vr**2 / 2 - g0**2 / (h0 + LAMBDA) / 2
                fine = (nl >= MIN_ROWS) & (len(b) - nl >= MIN_ROWS) & ((vr - vl) * monotone[f] >= 0)
                gain = np.where(fine, gain, -np.inf)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (f, k, vl[k], vr[k]))
            if best[1] is None:
                continue
            f, k, vl, vr = best[1]
            feature[node], threshold[node] = f, cuts[f][k]
            middle = (vl + vr) / 2
            bounds[2 * node + 1] = (low, middle) if monotone[f] > 0 else (middle, high) if monotone[f] < 0 else (low, high)
            bounds[2 * node + 2] = (middle, high) if monotone[f] > 0 else (low, middle) if monotone[f] < 0 else (low, high)
            at = np.where(mine, np.where(binned[:, f] <= k, 2 * node + 1, 2 * node + 2), at)
        margin = margin + value[at]
        grown.append((feature, threshold, value))
    nodes = np.arange(size)
    children = [np.tile(np.minimum(2 * nodes + k, size - 1), (TREES, 1)) for k in (1, 2)]
    return Trees(np.array([t[0] for t in grown]), np.array([t[1] for t in grown]), *children, np.array([t[2] for t in grown]), base)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns named in more, COUNTS and features (array in the order of FEATURES)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [statistics(x) for x in texts_utf8(batch)]
        counts = [pa.array([c[k] for c, _ in both], pa.int64()) for k in range(len(COUNTS))]
        return pa.RecordBatch.from_arrays([batch.column("id"), *[batch.column(m) for m in more], *counts, pa.array([f for _, f in both], pa.list_(pa.float64()))], ["id", *more, *COUNTS, "features"])

    types = dict(docs.dtypes)
    kept = "".join(f"{m} {types[m]}, " for m in more)
    given = docs.select(F.col(id_col).alias("id"), *more, text_of(text_col).alias("text"))
    return map_batches(given, run, f"id {types[id_col]}, {kept}" + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees | None:
    """A model of label_col (1: keep) from TRAIN_ROWS labelled rows at most; None if they do not show both kinds."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(TRAIN_ROWS)
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = measured(given, "id", "text", ("label",)).select("id", "label", "features").orderBy(F.xxhash64("id"), "id").limit(2 * TRAIN_ROWS).collect()
    y = np.array([r["label"] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return boost(np.array([r["features"] for r in rows]), y, list(FEATURES.values()))


def apply(docs: DataFrame, model: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, COUNTS, base_failed, kept, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [statistics(x) for x in texts_utf8(batch)]
        counts = np.array([c for c, _ in both], np.int64)
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        score = np.ones(len(both)) if shared.value is None else shared.value.score(np.array([f for _, f in both]))
        kept = ~failed & (score >= KEEP_SCORE)
        return pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(kept), pa.array(score)], ["id", *COUNTS, "base_failed", "kept", "score"])

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return map_batches(given, run, schema).withColumnRenamed("id", id_col)
