"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: how many n-grams (of n = 2 to 4 UTF-8 bytes, ASCII in
lower case, hashed to FEATURES cells) both have, over the root of the product of their own numbers. LANDMARKS texts of
the training sample span a Nyström approximation; one-versus-rest kernel ridge regression is solved on its features.
Landmarks, whitening and weights fold into one matrix, so a batch of texts is scored by one product of its presence
matrix. Every whole text is scored; only the fit uses a sample, chosen by a hash of doc_id: of each language TRAIN_PER_LANG texts at
most, and fewer (LEAST_PER_LANG at least) where there are so many languages that these would exceed TRAIN_ROWS.

A null text or one without a letter is "und" with score 0, and so is everything if nothing can be learned (an empty
table, or no labelled row). keep_identified judges by two measures whose least values are calibrated on held-out labelled
texts, all of them: the gap between the two best margins, and how much of a text's n-grams the landmarks hold. Repeated rows get equal results; ties between languages go to the first in order. Only
doc_id, text and lang are read, and doc_id and lang only to choose and label training rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import map_batches, map_rows, text_of, texts_utf8

FEATURES = 1 << 16
#: Bounds of the training sample, and of the Nyström landmarks among it; ridge penalty; documents scored at once.
TRAIN_PER_LANG, LEAST_PER_LANG, TRAIN_ROWS, LANDMARKS, RIDGE, ROWS_AT_ONCE = 400, 8, 8000, 256, 1e-3, 64
#: Fewer held-out texts than LEAST_HELD_OUT tell no threshold of keep_identified; share of them that may fall below each; steps of 1 in which they are counted, up to MOST.
LEAST_HELD_OUT, MISSED, STEPS, MOST = 100, 0.001, 10_000, 2
#: Features that the fit unpacks at once.
FEATURES_AT_ONCE = 1 << 10


def presence(texts: list[bytes]) -> np.ndarray:
    """0/1 for each text and feature."""
    out = np.zeros((len(texts), FEATURES), np.uint8)
    for row, text in zip(out, texts):
        a = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
        grams = a
        for n in range(1, 4):
            if len(a) <= n:
                break
            grams = (grams[:-1] << np.uint32(8)) | a[n:]
            row[((grams ^ np.uint32(n * 0x1BD1E995)) * np.uint32(0x9E3779B1)) >> np.uint32(16)] = 1
    return out


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix (FEATURES x languages) that scores presence rows. Held-out rows take no part."""
    return train(docs, id_col, text_col, lang_col)[:2]


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray, dict[str, int]]:
    """What fit() returns, the features (0/1) that any landmark holds, and the number of rows of each language."""
    named = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    named = named.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    sizes = named.groupBy("lang").count().collect()
    if not sizes:
        return [], np.zeros((FEATURES, 0), np.float32), np.zeros(FEATURES, np.float32), {}
    langs = sorted(r["lang"] for r in sizes)
    each = min(TRAIN_PER_LANG, max(LEAST_PER_LANG, TRAIN_ROWS // len(langs)))
    # a hash of the id below a share of its range takes about twice the wanted rows of each language; the rest is cut exactly
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 2 * each / r["count"]))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = named.filter(F.col("lang").isin(langs)).withColumn("drawn", drawn).filter(F.col("drawn") < share)
    most = 3 * each * len(langs)
    first: dict[str, list[float]] = {lang: [] for lang in langs}
    for row in chosen.select("lang", "drawn").orderBy("drawn").limit(most).collect():
        first[row["lang"]].append(row["drawn"])
    # so that bits come to the driver only of rows that are taken, but for those that share an id
    cut = F.element_at(F.create_map(*[F.lit(x) for lang, drawn in first.items() for x in (lang, drawn[each - 1] if len(drawn) >= each else 1.0)]), F.col("lang"))
    chosen = chosen.filter(F.col("drawn") <= cut)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = []
        texts = texts_utf8(batch)
        for k in range(0, len(texts), ROWS_AT_ONCE):
            bits += [x.tobytes() for x in np.packbits(presence(texts[k : k + ROWS_AT_ONCE]), axis=1)]
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("drawn"), pa.array(bits, pa.binary())], ["lang", "drawn", "bits"])

    rows = map_batches(chosen.select("text", "lang", "drawn"), run, "lang string, drawn double, bits binary").orderBy("drawn", "lang", "bits").limit(most).collect()
    taken: dict[str, list[bytes]] = {lang: [] for lang in langs}
    for row in rows:
        if len(taken[row["lang"]]) < each:
            taken[row["lang"]].append(row["bits"])
    del rows
    langs = [lang for lang in langs if taken[lang]]
    bits = [np.frombuffer(x, np.uint8) for lang in langs for x in taken[lang]]
    y = np.repeat(np.arange(len(langs)), [len(taken[lang]) for lang in langs])

    # texts in common features are counted a few features at a time: the driver holds bits, not numbers
    packed = np.array(bits)
    marks = np.linspace(0, len(bits) - 1, min(LANDMARKS, len(bits))).astype(int)
    step = FEATURES_AT_ONCE // 8
    unpacked = lambda rows, k: np.unpackbits(rows[:, k : k + step], axis=1).astype(np.float32)
    common, size = np.zeros((len(bits), len(marks)), np.float32), np.zeros(len(bits), np.float32)
    for k in range(0, FEATURES // 8, step):
        x = unpacked(packed, k)
        common += x @ x[marks].T
        size += x.sum(1)
    root = np.sqrt(np.maximum(size, 1))
    kernel = common / root[:, None] / root[marks]
    values, vectors = np.linalg.eigh(kernel[marks].astype(np.float64))
    large = values > 1e-6 * values.max() if values.max() > 0 else np.zeros(len(values), bool)
    whiten = vectors[:, large] / np.sqrt(values[large])
    features = kernel @ whiten
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weights = np.linalg.solve(features.T @ features + RIDGE * len(bits) * np.eye(features.shape[1]), features.T @ target)
    landmarks, folded = packed[marks], (whiten @ weights / root[marks][:, None]).astype(np.float32)
    matrix = np.concatenate([unpacked(landmarks, k).T @ folded for k in range(0, FEATURES // 8, step)])
    known = np.unpackbits(np.bitwise_or.reduce(landmarks, axis=0)).astype(np.float32)
    return langs, matrix, known, {r["lang"]: r["count"] for r in sizes}


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score: half of one plus the best margin, within 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text")), _scorer(shared, ["id", "held_out"]), f"id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def _scorer(shared, kept: list[str]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, matrix = shared.value
        texts, found, scores = texts_utf8(batch), [], []
        for k in range(0, len(texts), ROWS_AT_ONCE):
            part = texts[k : k + ROWS_AT_ONCE]
            if not langs:
                found += ["und"] * len(part)
                scores += [0.0] * len(part)
                continue
            x = presence(part).astype(np.float32)
            margins = (x @ matrix) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
            best = margins.argmax(1)
            score = np.clip((margins[np.arange(len(part)), best] + 1) / 2, 0, 1)
            for text, b, s in zip(part, best, score):
                letters = has_letter(text)
                found.append(langs[b] if letters else "und")
                scores.append(float(s) if letters else 0.0)
        return pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return run


def measures(texts: list[bytes], matrix: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Of each text: the gap between its two best margins (infinite for a single language), and the share of its features that are known; both -1 without a letter."""
    out, columns = [np.zeros((0, 2))], np.column_stack([matrix, known])
    for k in range(0, len(texts), ROWS_AT_ONCE):
        x = presence(texts[k : k + ROWS_AT_ONCE]).astype(np.float32)
        size = np.maximum(x.sum(1), 1)
        products = x @ columns
        margins = np.sort(products[:, :-1] / np.sqrt(size)[:, None], axis=1)
        gap = margins[:, -1] - margins[:, -2] if margins.shape[1] > 1 else np.full(len(x), np.inf)
        out.append(np.where([[has_letter(t)] for t in texts[k : k + ROWS_AT_ONCE]], np.column_stack([gap, products[:, -1] / size]), -1.0))
    return np.concatenate(out)


def in_steps(found: np.ndarray) -> np.ndarray:
    return np.floor(np.minimum(found, MOST) * STEPS).astype(np.int64)


def calibrated(docs: DataFrame, shared, sizes: dict[str, int], id_col: str, text_col: str, lang_col: str) -> np.ndarray:
    """The least gap and share, in steps: MISSED of all held-out labelled texts lie below each. Both 0 where there are too few such texts. The driver gets the numbers of texts at each step."""
    held = docs.filter(held_out(id_col) & F.col(lang_col).cast("string").isin(list(sizes)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in in_steps(measures(texts_utf8(batch), *shared.value)).T], ["gap", "share"])

    steps = map_batches(held.select(text_of(text_col).alias("text")), run, "gap long, share long").filter("share >= 0")
    counts = steps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(c).alias("step")) for k, c in enumerate(("gap", "share"))])).alias("x")).groupBy("x.measure", "x.step").count()
    found = np.array(sorted(tuple(r) for r in counts.collect()), np.int64).reshape(-1, 3)
    least = np.zeros(2, np.int64)
    for k in range(2):
        _, step, texts = found[found[:, 0] == k].T
        if texts.sum() >= LEAST_HELD_OUT:
            least[k] = step[np.searchsorted(np.cumsum(texts), int((texts.sum() - 1) * MISSED), "right")]
    return least


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is told as surely as that of held-out labelled texts."""
    langs, matrix, known, sizes = train(docs, id_col, text_col, lang_col)
    if not langs:
        return docs.filter(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast((matrix, known))
    least = calibrated(docs, shared, sizes, id_col, text_col, lang_col)

    of_text = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array((in_steps(measures(texts_utf8(batch, f"_{of_text}"), *shared.value)) >= least).all(1), pa.bool_()))

    return map_rows(docs, run, docs.schema)
