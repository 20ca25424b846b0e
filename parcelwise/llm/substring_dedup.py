"""Removal of passages that repeat across documents.

Lines are cut into units: after a word whose hash is 0 modulo ANCHOR, and at each line end. Whole lines or paragraphs would miss
passages copied into the middle of a line; these cuts depend on the words alone, so a copied passage is cut at the same words
wherever it stands, and only its first and last partial units are not told. A unit alone is short and soon stands somewhere
by chance, so sequences decide: from each unit on, and back from each unit, the fewest units in a row that hold MIN_WORDS
words. A sequence is known by a 64-bit digest of its words (ASCII lower case, punctuation off the ends). Digests are grouped
globally; the occurrence of least rank (doc_id, then place) is the one to keep. A sequence that occurs earlier as a whole is
removed; every removed word lies in one. Both directions are needed: together they cover each unit of any longer run.

A line or paragraph of MIN_WORDS words or more that is a copy as a whole is thus removed as a whole, as lines end units.

Digests of all documents are written once, aggregated to the repeated ones with their least doc_id, and then joined to the sequences
of larger doc_id; both steps are safe for hot sequences (partial aggregation, a join that AQE can split). What goes to one task is at
most one document's own.

A null text stays null, an empty one empty. Rows that share doc_id count as one document; a null doc_id ranks last. A
document of MIN_WORDS words or more that is a whole copy loses its text and stays as a row; a shorter one is left as it is. An
empty table gives an empty one. All columns of the input are returned, whatever their names, but for one of the name of spans_col, which the
spans replace; own ones carry the prefix ``_substring_dedup_``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import HashedWords, cut_lineage, map_batches, map_rows, quoted, remove, stored, text_of, texts_utf8, without_column, worker_cache

ANCHOR, MIN_WORDS = 5, 16
LAST = (1 << 63) - 1
P = "_substring_dedup_"
#: Odd, so that it has an inverse modulo 2 to the 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _normal(word: bytes) -> bytes:
    return word.lower().strip(b".,;:!?\"'()[]|-")


def units(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word; of each unit: number of words, offset of its start and of its end (bytes)."""
    chars = np.frombuffer(text, np.uint8)
    word = ~((chars == 32) | ((chars >= 9) & (chars <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    hashes = np.fromiter(map(worker_cache(_normal, lambda: HashedWords(_normal)).__getitem__, text.split()), np.uint64, n)
    cut = hashes % np.uint64(ANCHOR) == 0
    line = np.searchsorted(np.flatnonzero(chars == 10), starts)
    cut[:-1] |= line[1:] != line[:-1]
    first = np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1])
    sizes = np.diff(np.concatenate([first, [n]]))
    return hashes, sizes, starts[first], ends[first + sizes - 1]


def _powers(n: int, base: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2 to the 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def sequences(hashes: np.ndarray, sizes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sequence, by its place: digest (int64), its first unit, and the one after its last."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    count = len(sizes)
    stop = np.searchsorted(total, total[:-1] + min_words)
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    ahead, back = stop <= count, start >= 0
    pairs = np.unique(np.concatenate([np.arange(count)[ahead] * (count + 1) + stop[ahead], start[back] * (count + 1) + np.arange(1, count + 1)[back]]))
    start, stop = pairs // (count + 1), pairs % (count + 1)
    # a polynomial in _BASE, from sums up to each word; its inverse moves each sequence to the same place
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(len(hashes), _BASE))])
    digest = (sums[total[stop]] - sums[total[start]]) * _powers(len(hashes) + 1, _INVERSE)[total[start]]
    return digest.view(np.int64), start, stop


def removed_spans(text: bytes, earlier: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Offsets (bytes) of the runs to remove; earlier: digests that an earlier document has."""
    hashes, sizes, starts, ends = units(text)
    digest, start, stop = sequences(hashes, sizes, min_words)
    if not len(digest):
        return []
    own = np.ones(len(digest), bool)
    own[np.unique(digest, return_index=True)[1]] = False
    again = np.isin(digest, earlier) | own
    depth = np.cumsum(np.bincount(start[again], minlength=len(sizes) + 1) - np.bincount(stop[again], minlength=len(sizes) + 1))
    steps = np.flatnonzero(np.diff(np.concatenate([[0], (depth > 0).view(np.int8)])))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(steps[::2], steps[1::2])]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left; where words on both sides of a gap would touch, the white space before the gap parts them."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
        while at < len(text) and text[at] in b" \t" and (not out[-1] or out[-1][-1] in b" \t\n"):
            at += 1
    out.append(text[at:])
    return b"".join(out)


def repeated_sequences(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc, earlier (array of digests): the sequences of each document that occur in a document of less rank."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(sequences(*units(x)[:2], min_words)[0]) for x in texts_utf8(batch)]
        doc = np.repeat(batch.column("doc").to_numpy(zero_copy_only=False), [len(x) for x in found])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(doc, pa.int64())], ["digest", "doc"])

    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc")
    here, here_path = stored(map_batches(docs.select(rank, text_of(text_col).alias("text")), run, "digest long, doc long"))
    firsts = here.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows"))
    firsts, firsts_path = stored(firsts.filter(F.col("rows") > 1).select("digest", "first"))
    later = here.join(firsts, "digest").filter(F.col("doc") > F.col("first"))
    found = cut_lineage(later.groupBy("doc").agg(F.collect_set("digest").alias("earlier")))
    for path in (here_path, firsts_path):
        remove(docs.sparkSession, path)
    return found


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """docs with text_col rewritten; with spans_col, a further column lists what was removed: start and end as offsets in bytes of the UTF-8 text before."""
    docs = docs.select(*[quoted(c) for c in without_column(docs.columns, spans_col)])
    repeats = repeated_sequences(docs, min_words, id_col, text_col)
    repeats = repeats.select(F.col("doc").alias(P + "doc"), F.col("earlier").alias(P + "earlier"))
    joined = docs.join(repeats, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)) == F.col(P + "doc"), "left").drop(P + "doc")
    of_text = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans = [], []
        for text, earlier in zip(batch.column(of_text).cast(pa.binary()).to_pylist(), batch.columns[-1]):
            known = np.zeros(0, np.int64) if not earlier.is_valid else earlier.values.to_numpy()
            gone = removed_spans(text, known, min_words) if text else []
            texts.append(without(text, gone) if gone else text)
            spans.append([{"start": a, "end": b} for a, b in gone])
        columns = batch.columns[:-1]
        columns[of_text] = pa.array(texts, pa.binary()).cast(pa.string())
        if spans_col:
            columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
        return pa.RecordBatch.from_arrays(columns, [f"_{k}" for k in range(len(columns))])

    out = docs.schema if not spans_col else docs.withColumn(spans_col, F.lit(None).cast("array<struct<start: long, end: long>>")).schema
    return map_rows(joined, run, out)
