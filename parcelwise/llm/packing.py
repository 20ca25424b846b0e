"""Packing of documents into training windows by lexical retrieval.

Documents are encoded once, and each gets a sketch of its terms: term weights summed into buckets, and these projected on a few random directions. A tree of halvings, fitted on
a bounded sample of sketches, gives each document a place in a lexical order. Ids are shuffled to tasks by ranges of that order, which hold equal parts of the sample; a place that fills several ranges
(copies of one text, say) is spread over them by a hash. Tasks sort their rows; consecutive documents form a shard, whose size is bounded by documents and by tokens.
A shard builds a BM25 inverted index over token ids; a seed document (the first unused one) opens a window and the index returns its unused neighbours, best
first, which fill the window greedily. The piece that no longer fits is cut and its rest opens the next window, which
also carries an open window from shard to shard, so nothing is padded within a task. The last window of a
task is cut at powers of two, where no padding is due either. Memory is that of a shard, or of the longest document.

A null or empty text is its end token alone. Repeated rows are packed once each; ties in score go to the earlier row of the order.
An empty table gives no pieces. Only the named columns are read. sequence_id holds the partition number in its upper
bits; ranges, places and the order within a task depend on the rows alone, so a task that runs again gives the same pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelwise.llm.common import forget_caches, map_batches, slices, text_of, texts_utf8, worker_cache

#: Documents and tokens of one shard of the index; words whose ids a worker keeps.
SHARD_DOCS, SHARD_TOKENS, KEPT_WORDS = 1024, 1_500_000, 300_000
#: Documents that the lexical order is fitted on; halvings of the sample, down to so few documents; buckets, classes of rarity and directions of a sketch.
FIT_DOCS, DEPTH, LEAF_DOCS, BUCKETS, CLASSES, DIRECTIONS = 2048, 12, 16, 512, 8, 64
#: BM25's usual parameters.
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """white-space separated chunk (bytes, ASCII in lower case) -> its token ids (unsigned 32-bit, little-endian).

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks in a row. A chunk
    of printable ASCII and Latin letters is what its pieces (by the tokenizer's own pattern) are; they go to the tokenizer's model
    one by one and are kept. Any other chunk goes through the whole tokenizer.
    """

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(content)
        self.model = self.tokenizer.model
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = regex.compile(json.loads(content)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # the byte-level alphabet: a byte that prints in Latin-1 is itself, the others follow from 256 on in order
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.shown = [chr(256 + hidden.index(b) if b in hidden else b) for b in range(256)]

    def _piece(self, piece: str) -> bytes:
        name = piece if piece.isascii() else "".join(map(self.shown.__getitem__, piece.encode()))
        return array("I", [x.id for x in self.model.tokenize(name)]).tobytes()

    def _ids(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters
            return self._piece(chunk.decode())
        text = chunk.decode().lower()
        if text[-1] in ".," and text[:-1].isalpha():
            return self[chunk[:-1]] + self[chunk[-1:]]
        if not text.isprintable() or max(text) >= "\u0250":
            return array("I", self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
        if text.isalpha():  # precomposed, so normal forms change nothing
            return self._piece(text)
        return b"".join(self[x.encode()] if x.isalpha() else self._piece(x) for x in self.pieces(text))

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk[-1] in b".," and chunk[:-1].isalpha():  # put together each time, so that the words kept are other words
            return self[chunk[:-1]] + self[chunk[-1:]]
        ids = self._ids(chunk)
        if len(chunk) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[chunk] = ids
        return ids


def encode_ids(words: WordIds, text: bytes, end_id: int) -> np.ndarray:
    """ids of the text and the end token; a text that holds a special token's name goes whole through the tokenizer, which tells it."""
    if any(x in text for x in words.special):
        ids = np.array(words.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
    else:
        ids = b"".join(map(words.__getitem__, text.lower().split()))
    return np.frombuffer(ids + np.uint32(end_id).tobytes(), dtype="<u4")


class Index:
    """BM25 inverted index of one shard."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        lengths = np.array([len(x) for x in docs])
        terms, of = np.concatenate(docs), np.repeat(np.arange(len(docs), dtype=np.uint64), lengths)
        bits = int(terms.max()).bit_length()
        keys = (of << np.uint64(bits)) | terms
        keys, counts = np.unique(keys.astype(np.uint32) if bits + len(docs).bit_length() <= 32 else keys, return_counts=True)
        doc, term = (keys >> keys.dtype.type(bits)).astype(np.int64), (keys & keys.dtype.type((1 << bits) - 1)).astype(np.int64)
        frequency = np.bincount(term)
        idf = np.log1p((len(docs) - frequency + 0.5) / (frequency + 0.5))
        weight = idf[term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[doc] / lengths.mean()))
        order = np.argsort(term.astype(np.uint16) if bits <= 16 else term, kind="stable")
        self.posting_docs, self.posting_weights = doc[order], weight[order]
        self.posting_ends = np.concatenate([[0], np.cumsum(frequency)])
        shared = frequency[term] > 1
        self.query_terms, self.query_ends = term[shared], np.searchsorted(doc[shared], np.arange(len(docs) + 1))
        self.docs = len(docs)

    def forget(self, used: np.ndarray) -> None:
        """Drop the postings of used documents; weights stay those of the whole shard."""
        left = ~used[self.posting_docs]
        self.posting_ends = np.concatenate([[0], np.cumsum(left)])[self.posting_ends]
        self.posting_docs, self.posting_weights = self.posting_docs[left], self.posting_weights[left]

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first by the BM25 of all its terms."""
        terms = self.query_terms[self.query_ends[seed] : self.query_ends[seed + 1]]
        if not len(terms):
            return terms
        spans = [slice(self.posting_ends[t], self.posting_ends[t + 1]) for t in terms]
        scores = np.bincount(np.concatenate([self.posting_docs[s] for s in spans]), np.concatenate([self.posting_weights[s] for s in spans]), self.docs)
        scores[used] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


class Packer:
    """Fills windows one after the other; pieces of the open window wait until it is full."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.sequence = window, first_sequence
        self.open: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids, doc_tokens
        self.filled = 0
        self.rows: list[tuple] = []

    def _close(self) -> None:
        offset = 0
        for doc_id, start, ids, total in self.open:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.open, self.filled, self.sequence = [], 0, self.sequence + 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            part = ids[start : start + self.window - self.filled]
            self.open.append((doc_id, start, part, total))
            self.filled += len(part)
            start += len(part)
            if self.filled == self.window:
                self._close()

    def shard(self, ids: list[int | None], docs: list[np.ndarray]) -> None:
        index, used, held = Index(docs), np.zeros(len(docs), bool), len(docs)
        for seed in range(len(docs)):
            if used[seed]:
                continue
            if seed % 64 == 0 and 2 * (left := len(docs) - int(used.sum())) < held:
                index.forget(used)
                held = left
            used[seed] = True
            self.add(ids[seed], docs[seed])
            if not self.filled:
                continue
            for k in index.neighbours(seed, used):
                used[k] = True
                self.add(ids[k], docs[k])
                if self.filled < len(docs[k]):  # the window was filled; the rest of k opened the next
                    break

    def finish(self) -> None:
        """Cut the last window at powers of two."""
        left, size = self.open, 1 << max(self.filled.bit_length() - 1, 0)
        self.open, todo, self.filled = [], self.filled, 0
        for doc_id, start, ids, total in left:
            while len(ids):
                while size > todo:
                    size >>= 1
                part, ids = ids[: size - self.filled], ids[size - self.filled :]
                self.open.append((doc_id, start, part, total))
                start += len(part)
                self.filled += len(part)
                if self.filled == size:
                    todo -= size
                    self._close()

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


class Sketcher:
    """Sketches of documents: their terms counted in buckets, on random directions.

    Ids of a vocabulary go from frequent to rare: terms of like rarity (CLASSES of them, by the id's logarithm) share buckets, and a bucket weighs as much as its terms are rare.
    """

    def __init__(self, vocabulary: int) -> None:
        r, rank = np.random.default_rng(7), np.log1p(np.arange(vocabulary))
        wide = BUCKETS // CLASSES
        rarity = (rank / rank[-1] * (CLASSES - 1e-9)).astype(np.int64) if vocabulary > 1 else np.zeros(vocabulary, np.int64)
        self.bucket = rarity * wide + r.integers(0, wide, vocabulary)
        self.directions = (r.standard_normal((BUCKETS, DIRECTIONS)) * (1 + np.arange(BUCKETS) // wide)[:, None]).astype(np.float32)

    def __call__(self, docs: list[np.ndarray]) -> np.ndarray:
        counts = np.array([np.bincount(self.bucket[ids], minlength=BUCKETS) for ids in docs], np.float32)
        out = np.log1p(counts) @ self.directions
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def halvings(sketches: np.ndarray) -> list[tuple[np.ndarray, float] | None]:
    """A tree as a list: node k parts its sketches at a direction's threshold into nodes 2k + 1 (below) and 2k + 2; None is a leaf. Each node has two means; the direction is their difference."""
    nodes: list = [None] * ((1 << DEPTH + 1) - 1)
    todo = [(0, 0, sketches)]
    while todo:
        k, depth, rows = todo.pop()
        if depth == DEPTH or len(rows) < 2 * LEAF_DOCS:
            continue
        a = rows[((rows - rows.mean(0)) ** 2).sum(1).argmax()]
        b = rows[((rows - a) ** 2).sum(1).argmax()]
        for _ in range(8):
            right = rows @ (b - a) > (b @ b - a @ a) / 2
            if right.all() or not right.any():
                break
            a, b = rows[~right].mean(0), rows[right].mean(0)
        if right.all() or not right.any():
            continue
        nodes[k] = (b - a, float(b @ b - a @ a) / 2)
        todo += [(2 * k + 1, depth + 1, rows[~right]), (2 * k + 2, depth + 1, rows[right])]
    return nodes


def places(nodes: list[tuple[np.ndarray, float] | None], sketches: np.ndarray) -> np.ndarray:
    """The place of each sketch in the order of the tree's leaves, and within a leaf by the sketch's signs."""
    out = np.zeros(len(sketches), np.int64)
    todo = [(0, 0, np.arange(len(sketches)))]
    while todo:
        k, depth, rows = todo.pop()
        if not len(rows) or nodes[k] is None:
            continue
        direction, threshold = nodes[k]
        right = sketches[rows] @ direction > threshold
        out[rows[right]] += 1 << DEPTH - depth - 1
        todo += [(2 * k + 1, depth + 1, rows[~right]), (2 * k + 2, depth + 1, rows[right])]
    signs = (sketches[:, :16] > 0) @ (1 << np.arange(16))
    return out << 16 | signs


def sampled_sketches(docs: DataFrame, coder: Callable[[], Coder]) -> np.ndarray:
    """Sketches of a sample of rows of id, text: about FIT_DOCS by hash, twice as many at most. They come to the driver, a few numbers each."""
    every = max(docs.count() // FIT_DOCS, 1)
    sample = docs.filter(F.pmod(F.xxhash64("id", F.length("text")), F.lit(every)) == 0)

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in coder().sketch(coder().ids(batch))], pa.binary())], ["sketch"])

    rows = map_batches(sample, sketch, "sketch binary").limit(2 * FIT_DOCS).collect()
    return np.frombuffer(b"".join(bytes(r.sketch) for r in rows), np.float32).reshape(-1, DIRECTIONS)


class Coder:
    """Ids and sketches of texts, with the caches of one worker. Ids are kept in 16 bits where the vocabulary allows it."""

    def __init__(self, content: str, end_id: int) -> None:
        self.words, self.end_id = WordIds(content), end_id
        size = max(self.words.tokenizer.get_vocab_size(), end_id + 1)
        self.sketch, self.kind = Sketcher(size), "<u2" if size <= 1 << 16 else "<u4"

    def ids(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        return [encode_ids(self.words, x, self.end_id) for x in texts_utf8(batch)]


def dealt(docs: DataFrame, coder: Callable[[], Coder], parts: int) -> DataFrame:
    """id, place, part, wide (whether ids have 32 bits), ids of rows of id, text; part is one of the ranges of the lexical order."""
    sample = sampled_sketches(docs, coder)
    nodes = halvings(sample) if len(sample) else [None]
    at = np.sort(places(nodes, sample)) if len(sample) else np.zeros(1, np.int64)
    told = docs.sparkSession.sparkContext.broadcast((nodes, at[np.arange(1, parts) * len(at) // parts]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tree, borders = told.value
        ids, make = coder().ids(batch), coder()
        place = np.concatenate([places(tree, make.sketch(ids[k : k + 256])) for k in range(0, len(ids), 256)])
        low, high = np.searchsorted(borders, place, "left"), np.searchsorted(borders, place, "right")
        spread, names = np.zeros(len(ids), np.int64), batch.column("id")
        for k in np.flatnonzero(high > low):
            spread[k] = zlib.crc32(ids[k].tobytes() + str(names[int(k)].as_py()).encode())
        columns = [batch.column("id"), pa.array(place, pa.int64()), pa.array(low + spread % (high - low + 1), pa.int32()), pa.array([make.kind == "<u4"] * len(ids)), pa.array([x.astype(make.kind).tobytes() for x in ids], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "place", "part", "wide", "ids"])

    return map_batches(docs, run, "id long, place long, part int, wide boolean, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES: which ids of which document lie where in which sequence. tokenizer_path is read by the driver only; its content is broadcast."""
    with open(tokenizer_path, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    given = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt(given, lambda: worker_cache((content.value, end_id), lambda: Coder(content.value, end_id)), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_caches()  # the words of the encoding stage, which ran in the same workers
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        ids, held, tokens = [], [], 0
        for part in (x for batch in batches for x in slices(batch)):
            for doc_id, wide, data in zip(*(part.column(c).to_pylist() for c in ("id", "wide", "ids"))):
                ids.append(doc_id)
                held.append(np.frombuffer(data, "<u4" if wide else "<u2").astype("<u4"))
                tokens += len(held[-1])
                if len(ids) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    packer.shard(ids, held)
                    ids, held, tokens = [], [], 0
                    yield packer.take()
        if ids:
            packer.shard(ids, held)
        packer.finish()
        yield packer.take()

    ordered = rows.repartitionById(parts, "part").sortWithinPartitions("place", "id", F.xxhash64("ids"))
    return ordered.select("id", "wide", "ids").mapInArrow(run, PIECES)
