"""Quality classification by hierarchical empirical Bayes.

A document classifier (logistic regression on the presence of informative words and on document statistics) gives each
document its evidence. The sites' own records come from grouped aggregation of that evidence: a host's posterior is its
mean shrunk towards the global one, a path's (a part of a host) is its mean shrunk towards its host's, each with a prior
strength estimated by the method of moments from the spread between groups. A document's own share is left out of its
site's record. The final log odds add the site's deviation from the global prior to the document's evidence, so sparse
sites change little.

Only the classifier is fitted on a sample: TRAIN_ROWS labelled rows at most, chosen by a hash of doc_id; all site
statistics cover all documents. A null or empty text has evidence from its statistics alone; a null host or path is a
group of its own; repeated rows count each time. Without labels of both kinds the evidence is 0 for all. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import map_batches, stored, text_of, texts_utf8
from parcelwise.llm.quality_rules import statistics

#: Bound of the training sample; hash cells of words; words that the classifier uses; bounds of log odds; scale of summed probabilities.
TRAIN_ROWS, CELLS, WORDS, CLIP, SCALE = 5000, 1 << 18, 512, 12.0, 1_000_000
#: Words of a document that are hashed in one go.
_WORD = re.compile(rb"[^\x00-\x26\x28-\x40\x5b-\x60\x7b-\x7f]+")


def word_cells(text: bytes) -> np.ndarray:
    """Cells of the distinct words (letters in lower case, any other UTF-8)."""
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(x) % CELLS for x in set(_WORD.findall(text.lower()))), np.int32))


@dataclass
class Model:
    cells: np.ndarray  # sorted
    weights: np.ndarray  # of the cells
    centre: np.ndarray  # of the statistics
    spread: np.ndarray
    slopes: np.ndarray
    bias: float

    def log_odds(self, cells: np.ndarray, features: list[float]) -> float:
        at = np.searchsorted(self.cells, cells)
        at[at == len(self.cells)] = 0
        hit = self.cells[at] == cells if len(self.cells) else np.zeros(len(cells), bool)
        z = np.clip((np.array(features) - self.centre) / self.spread, -4, 4)
        return float(np.clip(self.weights[at[hit]].sum() + z @ self.slopes + self.bias, -CLIP, CLIP))


def learn(cells: list[np.ndarray], features: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression by gradient descent with momentum; the words are those of largest likelihood ratio statistic."""
    n, positive = len(y), y.sum()
    flat = np.concatenate(cells) if len(cells) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(n), [len(c) for c in cells])
    df, df1 = np.bincount(flat, minlength=CELLS), np.bincount(flat, y[row], CELLS)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)

    ratio = 2 * (part(df1, df * positive / n) + part(df - df1, df * (1 - positive / n)) + part(positive - df1, (n - df) * positive / n) + part(n - positive - df + df1, (n - df) * (1 - positive / n)))
    ratio[df < 5] = 0
    best = np.sort(np.argsort(-ratio, kind="stable")[:WORDS])
    best = best[ratio[best] > 12].astype(np.int32)
    at = np.searchsorted(best, flat)
    at[at == len(best)] = 0
    hit = best[at] == flat if len(best) else np.zeros(len(flat), bool)
    x_row, x_col = row[hit], at[hit]
    centre, spread = features.mean(0), features.std(0) + 1e-9
    z = np.clip((features - centre) / spread, -4, 4)
    w, s, b = np.zeros(len(best)), np.zeros(z.shape[1]), 0.0
    vw, vs, vb = np.zeros_like(w), np.zeros_like(s), 0.0
    for _ in range(400):
        m = np.bincount(x_row, w[x_col], n) + z @ s + b
        error = (y - 1 / (1 + np.exp(-np.clip(m, -30, 30)))) / n
        gw = np.bincount(x_col, error[x_row], len(w)) - 1e-4 * w
        gs, gb = z.T @ error - 1e-4 * s, error.sum()
        vw, vs, vb = 0.9 * vw + gw, 0.9 * vs + gs, 0.9 * vb + gb
        w, s, b = w + 3.0 * vw, s + 0.3 * vs, b + 0.3 * vb
    return Model(best, w, centre, spread, s, float(b))


def fit(docs: DataFrame, labels: DataFrame, good: Column, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of the condition good on labels; None if the sample does not show both kinds."""
    chosen = labels.select(F.col(id_col).alias("id"), good.cast("int").alias("label")).dropna().orderBy(F.xxhash64("id"), "id", "label").limit(TRAIN_ROWS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_utf8(batch)
        cells = pa.array([word_cells(x) for x in texts], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), cells, pa.array([statistics(x)[1] for x in texts], pa.list_(pa.float64()))], ["id", "label", "cells", "features"])

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = map_batches(given, run, f"id {dict(docs.dtypes)[id_col]}, label int, cells array<int>, features array<double>").orderBy(F.xxhash64("id"), "id").limit(2 * TRAIN_ROWS).collect()
    y = np.array([r["label"] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return learn([np.array(r["cells"], np.int32) for r in rows], np.array([r["features"] for r in rows]), y)


def evidence(docs: DataFrame, model: Model | None, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, host, path, evidence (log odds), units (the probability in parts of SCALE: whole numbers add up alike in any order)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        odds = np.array([0.0 if m is None else m.log_odds(word_cells(x), statistics(x)[1]) for x in texts_utf8(batch)])
        units = np.rint(SCALE / (1 + np.exp(-odds))).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), pa.array(odds), pa.array(units)], ["id", "host", "path", "evidence", "units"])

    given = docs.select(F.col(id_col).alias("id"), F.coalesce(host.cast("string"), F.lit("\0")).alias("host"), F.coalesce(path.cast("string"), F.lit("\0")).alias("path"), text_of(text_col).alias("text"))
    return map_batches(given, run, f"id {dict(docs.dtypes)[id_col]}, host string, path string, evidence double, units long")


def _strength(groups: DataFrame, mean: float, within: float) -> float:
    """Prior strength, in documents: the variance within groups over the variance between their means (method of moments)."""
    deviation = F.col("p") / F.col("n") - mean
    r = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.sum(F.col("n") * deviation * deviation).alias("s")).first()
    if not r["n"] or r["k"] < 2:
        return 1e6
    between = (r["s"] - (r["k"] - 1) * within) / max(r["n"] - r["n2"] / r["n"], 1e-9)
    return float(min(max(within / between, 1.0), 1e6)) if between > 0 else 1e6


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-5), F.least(p, F.lit(1 - 1e-5)))
    return F.log(q / (1 - q))


def posterior(scores: DataFrame) -> DataFrame:
    """scores (as of evidence()) with host_quality, path_quality (posteriors without the document itself), quality and kept."""
    total = scores.agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("p"), F.sum((F.col("units") / SCALE) ** 2).alias("p2")).first()
    n = total["n"] or 1
    mean = (total["p"] or 0) / SCALE / n
    within = max((total["p2"] or 0.0) / n - mean * mean, 1e-6)
    sums = [F.count(F.lit(1)).alias("n"), (F.sum("units") / SCALE).alias("p")]
    hosts, paths = scores.groupBy("host").agg(*sums), scores.groupBy("host", "path").agg(*sums)
    host_strength, path_strength = _strength(hosts, mean, within), _strength(paths, mean, within)
    own = F.col("units") / SCALE
    joined = scores.join(hosts.withColumnsRenamed({"n": "host_n", "p": "host_p"}), "host").join(paths.withColumnsRenamed({"n": "path_n", "p": "path_p"}), ["host", "path"])
    joined = joined.withColumn("host_quality", (F.col("host_p") - own + host_strength * mean) / (F.col("host_n") - 1 + host_strength))
    joined = joined.withColumn("path_quality", (F.col("path_p") - own + path_strength * F.col("host_quality")) / (F.col("path_n") - 1 + path_strength))
    odds = F.col("evidence") + _logit(F.col("path_quality")) - float(np.log(max(mean, 1e-5) / max(1 - mean, 1e-5)))
    joined = joined.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return joined.select("id", "evidence", "host_quality", "path_quality", "quality", (F.col("quality") >= 0.5).alias("kept"))


def classify(docs: DataFrame, model: Model | None, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, evidence, host_quality, path_quality, quality, kept for every row of docs."""
    scores, _ = stored(evidence(docs, model, host, path, id_col, text_col))
    return posterior(scores).withColumnRenamed("id", id_col)
