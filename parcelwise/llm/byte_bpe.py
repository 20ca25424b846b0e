"""Byte-level BPE as a finite-state transducer, with streaming decoding.

The merges are never replayed over a text. A token sequence is the BPE encoding of its bytes exactly when each token is
and each two neighbours are, so the encoding of every prefix is that of a shorter prefix plus one token. The transducer
reads bytes; its state holds, for each earlier boundary from which a vocabulary entry may still grow, the bytes since
then and the tokens not emitted yet. What all of these agree on is emitted, so output lags by the longest entry at most.
States and transitions are made when first met and kept (a lazy DFA); the store is emptied when it is full.

Nulls and empty texts encode to no tokens. Texts of any length take linear time; no piece is cut. Rows are independent:
repeated rows and ties give repeated results, an empty table an empty one, and only the named columns are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import map_batches, text_of, texts_str

#: States, pairs of tokens and pieces that are kept before each starts anew, and the longest piece whose tokens are kept.
MAX_STATES, MAX_PAIRS, MAX_PIECES, MAX_KEPT = 150_000, 800_000, 400_000, 64


def read_ranks(content: bytes) -> dict[bytes, int]:
    """token bytes -> rank, from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Transducer:
    """bytes of one piece -> token ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.growing = {token[:k] for token in ranks for k in range(1, len(token))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.last_merge: dict[bytes, tuple[bytes, bytes]] = {}
        self.edges: dict[int, dict[int, list]] = {0: {}, -1: {}}
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple]]] = []
        self.start = self._numbered(((b"", -1, ()),))

    def _numbered(self, state: tuple) -> int:
        if (k := self.number.get(state)) is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return k

    def merged(self, data: bytes) -> list[int]:
        """The definition: join the neighbours of lowest rank, leftmost first, until none is in the vocabulary."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            options = [(self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, k = min(options)
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[x] for x in parts]

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of the last merge that makes this token; None for one byte."""
        if len(token) == 1:
            return None
        if (known := self.last_merge.get(token)) is None:
            rank, parts = self.ranks.pop(token), []
            try:
                parts = [self.bytes_of[x] for x in self.merged(token)]
            finally:
                self.ranks[token] = rank
            known = self.last_merge[token] = tuple(parts)
        return known

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, float]]:
        """What stands at the token's left (0) or right (-1) end while it is made: bytes, rank, and the rank that ends it."""
        if (known := self.edges[side].get(token)) is None:
            part, until, known = self.bytes_of[token], float("inf"), []
            while True:
                known.append((part, rank := self.ranks[part], until))
                halves = self._split(part)
                if halves is None:
                    break
                part, until = halves[side], rank
            self.edges[side][token] = known
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Whether left, right is the encoding of its bytes; left is -1 at the start.

        It isn't if some part at left's right end and some part at right's left end exist at the same time and merge
        before either is absorbed. Of equal ranks the leftmost merges first.
        """
        if left < 0:
            return self._whole(right)
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self._whole(left) and self._whole(right)
            ranks = self.ranks
            for a, rank_a, until_a in self._edge(left, -1) if known else ():
                for b, rank_b, until_b in self._edge(right, 0):
                    joint = ranks.get(a + b)
                    if joint is not None and max(joint, rank_a, rank_b) < until_a and max(joint, rank_a, rank_b) <= until_b:
                        known = False
                        break
                if not known:
                    break
            self.pairs[left, right] = known
        return known

    def _whole(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def _move(self, state: tuple, byte: int) -> tuple[tuple, tuple]:
        added, open_, ended = bytes((byte,)), [], None
        ranks, growing = self.ranks, self.growing
        for since, last, held in state:
            now = since + added
            if ended is None and (token := ranks.get(now)) is not None and self._fits(last, token):
                ended = (b"", token, (*held, token))
            if now in growing:
                open_.append((now, last, held))
        open_.append(ended)
        first = open_[0][2]
        sure = 0
        for k, token in enumerate(first):
            for _, _, held in open_:
                if len(held) <= k or held[k] != token:
                    break
            else:
                sure = k + 1
                continue
            break
        if sure:
            return tuple([(since, last, held[sure:]) for since, last, held in open_]), first[:sure]
        return tuple(open_), ()

    def encode(self, data: bytes) -> list[int]:
        at, out = self.start, []
        for byte in data:
            move = self.moves[at].get(byte)
            if move is None:
                state, sure = self._move(self.states[at], byte)
                if len(self.states) >= MAX_STATES:
                    self._reset()
                    move = (self._numbered(state), sure)
                else:
                    move = self.moves[at][byte] = (self._numbered(state), sure)
            at = move[0]
            if move[1]:
                out += move[1]
        return out + list(self.states[at][-1][2])


class Pieces(dict):
    """piece of text -> its ids as little-endian unsigned 32-bit integers; bounded."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = little_endian(self.transducer.encode(piece.encode()))
        if len(piece) <= MAX_KEPT:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Utf8Stream:
    """An incremental UTF-8 state machine: feed() returns the characters completed so far, in chunks cut anywhere."""

    def __init__(self) -> None:
        self.tail = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end belong to a character that has not ended."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF8 else 1
                return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        cut = len(data) - self._open(data)
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.tail = self.tail, b""
        return rest.decode("utf-8", "replace")


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pieces = Pieces(Transducer(ranks))
        self.split = regex.compile(pattern).findall
        self.table = [self.pieces.transducer.bytes_of.get(k, b"") for k in range(max(ranks.values()) + 1)]

    def encode_bytes(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decoded(self, ids: list[int], step: int = 4096):
        """Bytes of each step ids, cut wherever their tokens end."""
        for k in range(0, len(ids), step):
            yield self.decode_bytes(ids[k : k + step])

    def decode_stream(self, ids: list[int], step: int = 4096):
        """Text in chunks, each of whole characters."""
        stream = Utf8Stream()
        yield from map(stream.feed, self.decoded(ids, step))
        if rest := stream.finish():
            yield rest


@functools.lru_cache(maxsize=4)
def compiled(content: bytes, pattern: str) -> Encoder:
    """One encoder in each Python worker."""
    return Encoder(read_ranks(content), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (binary: little-endian unsigned 32-bit integers). ranks_path is read by the driver only; its content, the vocabulary, is broadcast."""
    with open(ranks_path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = compiled(content.value, pattern)
        ids = [encoder.encode_bytes(x) for x in texts_str(batch)]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return map_batches(given, run, "id long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id, text from id, ids."""
    with open(ranks_path, "rb") as file:
        content = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = compiled(content.value, pattern)
        texts = ["".join(encoder.decode_stream(np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return map_batches(encoded.select(F.col(id_col).cast("long").alias("id"), "ids"), run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (of the decoded bytes) of every text encoded and decoded again, in one pass over the texts.

    The bytes also go through the incremental UTF-8 decoder; if its characters are not those of the text, the task fails.
    """
    with open(ranks_path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = compiled(content.value, pattern)
        counts, ids_sha, decoded_sha = [], [], []
        for text in texts_str(batch):
            ids = encoder.encode_bytes(text)
            back, stream, at = hashlib.sha256(), Utf8Stream(), 0
            for raw in encoder.decoded(np.frombuffer(ids, "<u4").tolist()):
                back.update(raw)
                chars = stream.feed(raw)
                if not text.startswith(chars, at):
                    raise ValueError("decoding differs from the text")
                at += len(chars)
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(back.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return map_batches(given, run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
