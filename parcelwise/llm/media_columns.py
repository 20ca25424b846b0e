"""Media columns: storing payloads losslessly, and telling stored media by their signatures.

An Aho-Corasick automaton finds all magic bytes in one pass over a media value. At each hit the format's validator
checks structure and lengths; only what it confirms counts. The medium confirmed at offset 0 corrects the declared type;
others are carved with their offsets and lengths. Bytes that only look like a signature are thus left alone.
Chains of chunks and blocks are remembered by position, so that many signatures in one value don't walk the same bytes again.

Formats: WAV (RIFF), BMP, PNG (with chunk checksums), GIF, PGM. A null value is an empty one, of type
"application/octet-stream". Repeated rows give equal results, an empty table an empty one. Values of any length are
scanned whole, in linear time. Only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import map_batches, text_of, texts_utf8

#: Samples in a row of an image; payloads are padded to a positive multiple of it. Samples a second of a sound.
ROW, RATE = 192, 8000
UNKNOWN = "application/octet-stream"
#: Media types that store() writes, in the order of the type's number.
STORED_TYPES = ["audio/wav", "image/bmp", "image/x-portable-graymap"]
SIGNATURES = {b"RIFF": "audio/wav", b"BM": "image/bmp", b"\x89PNG\r\n\x1a\n": "image/png", b"GIF87a": "image/gif", b"GIF89a": "image/gif", b"P5\n": "image/x-portable-graymap"}
MEDIA = "id long, declared string, media binary"


def padded(data: bytes) -> bytes:
    return data + b" " * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def write_wav(samples: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def write_bmp(samples: bytes) -> bytes:
    """24 bits a pixel, top row first, so that the samples lie in order; a row of ROW bytes needs no filling."""
    rows = len(samples) // ROW
    return b"BM" + struct.pack("<IHHI", 54 + len(samples), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, ROW // 3, -rows, 1, 24, 0, len(samples), 2835, 2835, 0, 0) + samples


def write_pgm(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(samples) // ROW) + samples


WRITERS = [write_wav, write_bmp, write_pgm]


class Chains:
    """What is known of the chains of chunks and blocks in one value, by position: chains that meet are the same from there on, so each position is walked once,
    whatever the number of signatures. Arrays hold 0 where nothing is known yet; their pages are used as far as chains reach."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.tables: dict[str, np.ndarray] = {}
        self.sums: list[int] = []

    def table(self, name: str) -> np.ndarray:
        if name not in self.tables:
            self.tables[name] = np.zeros(len(self.data) + 1, np.int64)
        return self.tables[name]

    def wav(self, k: int) -> tuple[int, int]:
        """Of the chunks from k on: the first one of samples, and the last one of the format before it; -1 if there is none."""
        data, sound, form, trail, at, told = self.data, self.table("wav data"), self.table("wav form"), [], -1, -1
        while k + 8 <= len(data):
            if sound[k]:
                at, told = int(sound[k]), int(form[k])
                at, told = at - 1 if at > 0 else -1, told - 1 if told > 0 else -1
                break
            trail.append(k)
            if data[k : k + 4] == b"data":
                at = k
                break
            size = struct.unpack_from("<I", data, k + 4)[0]
            k += 8 + size + size % 2
        for p in reversed(trail):
            if told < 0 and data[p : p + 4] == b"fmt " and struct.unpack_from("<I", data, p + 4)[0] >= 16 and p + 24 <= len(data):
                told = p
            sound[p], form[p] = at + 1 if at >= 0 else -1, told + 1 if told >= 0 else -1
        return at, told

    def gif_blocks(self, k: int) -> int:
        """Where the run of sub-blocks from k ends."""
        data, ends, trail = self.data, self.table("gif blocks"), []
        while k < len(data) and data[k] and not ends[k]:
            trail.append(k)
            k += 1 + data[k]
        end = int(ends[k]) if k < len(data) and ends[k] else k + 1
        for p in trail:
            ends[p] = end
        return end

    def gif(self, k: int) -> tuple[int, bool] | None:
        """End of the picture whose blocks go on at k, and whether an image is among them."""
        data, known, trail = self.data, self.table("gif"), []
        found = -1  # else twice the end, and one more with an image
        while k < len(data):
            if known[k]:
                found = int(known[k])
                break
            trail.append(k)
            if data[k] == 0x3B:
                found = 2 * (k + 1)
                break
            if data[k] == 0x21:
                k = self.gif_blocks(k + 2)
            elif data[k] == 0x2C and k + 10 < len(data):
                k = self.gif_blocks(k + 10 + (3 << (data[k + 9] & 7) + 1 if data[k + 9] & 0x80 else 0) + 1)
            else:
                break
        for p in reversed(trail):
            if found > 0 and data[p] == 0x2C:
                found |= 1
            known[p] = found
        return (found >> 1, bool(found & 1)) if found > 0 else None

    def png(self, k: int) -> int:
        """End of the chunks from k on, all of them sound and none a header; -1 if they aren't."""
        data, known, trail, end = self.data, self.table("png"), [], -1
        while k + 12 <= len(data):
            if known[k]:
                end = int(known[k])
                break
            trail.append(k)
            size, name = struct.unpack_from(">I4s", data, k)
            if k + 12 + size > len(data) or name == b"IHDR" or not name.isalpha() or self.crc(k + 4, k + 8 + size) != struct.unpack_from(">I", data, k + 8 + size)[0]:
                break
            k += 12 + size
            if name == b"IEND":
                end = k
                break
        for p in trail:
            known[p] = end
        return end

    def crc(self, start: int, stop: int) -> int:
        """CRC-32 of a part. Long ones come from those of the value's beginnings, summed up once every STRIDE bytes: taking the part before away costs the logarithm of the length."""
        if stop - start <= STRIDE:
            return zlib.crc32(self.data[start:stop])
        if not self.sums:
            self.sums = [0]
            for k in range(0, len(self.data), STRIDE):
                self.sums.append(zlib.crc32(self.data[k : k + STRIDE], self.sums[-1]))
        first, last = (zlib.crc32(self.data[x - x % STRIDE : x], self.sums[x // STRIDE]) for x in (start, stop))
        return last ^ times(power(8 * (stop - start)), first)


#: Bytes between two sums of Chains.crc; the polynomial of CRC-32, lowest power first.
STRIDE, POLYNOMIAL = 4096, 0xEDB88320


def times(a: int, b: int) -> int:
    """Product of two polynomials over two elements, modulo that of CRC-32; the highest bit is the power 0."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


@functools.lru_cache(maxsize=64)
def squared(n: int) -> int:
    """x to the power of 2 ** n."""
    return 1 << 30 if n == 0 else times(squared(n - 1), squared(n - 1))


def power(n: int) -> int:
    """x to the power of n."""
    out = 1 << 31
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = times(out, squared(k))
    return out


def check_wav(data: bytes, at: int, chains: Chains) -> tuple[int, int, int] | None:
    """End of the medium, start and end of its samples, if a whole 8-bit PCM sound starts here (the format before the samples); the checks below alike."""
    if len(data) < at + 44 or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    sound, form = chains.wav(at + 12) if end <= len(data) else (-1, -1)
    if sound < 0 or form < 0:
        return None
    coded, stop = struct.unpack_from("<HHIIHH", data, form + 8), sound + 8 + struct.unpack_from("<I", data, sound + 4)[0]
    if stop > end or coded[0] != 1 or coded[5] != 8 or coded[3] != coded[2] * coded[1]:
        return None
    return end, sound + 8, stop


def check_bmp(data: bytes, at: int, chains: Chains) -> tuple[int, int, int] | None:
    if len(data) < at + 54:
        return None
    size, a, b, start = struct.unpack_from("<IHHI", data, at + 2)
    header, width, height, planes, bits, packed = struct.unpack_from("<IiiHHI", data, at + 14)
    if a or b or header < 40 or planes != 1 or bits not in (8, 24) or packed or width <= 0 or not height or at + size > len(data):
        return None
    held = -(-width * bits // 32) * 4 * abs(height)
    return (at + size, at + start, at + size) if start >= 54 and start + held == size else None


def check_png(data: bytes, at: int, chains: Chains) -> tuple[int, int, int] | None:
    k = at + 8
    if len(data) < k + 25 or data[k : k + 8] != b"\0\0\0\x0dIHDR" or zlib.crc32(data[k + 4 : k + 21]) != struct.unpack_from(">I", data, k + 21)[0]:
        return None
    end = chains.png(k + 25)
    return (end, at, end) if end >= 0 else None


def check_gif(data: bytes, at: int, chains: Chains) -> tuple[int, int, int] | None:
    if len(data) < at + 13:
        return None
    found = chains.gif(at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 0x80 else 0))
    return (found[0], at, found[0]) if found and found[1] else None


_PGM = re.compile(rb"P5\n([1-9]\d{0,8}) ([1-9]\d{0,8})\n255\n")


def check_pgm(data: bytes, at: int, chains: Chains) -> tuple[int, int, int] | None:
    if (m := _PGM.match(data, at)) is None:
        return None
    end = m.end() + int(m[1]) * int(m[2])
    return (end, m.end(), end) if end <= len(data) else None


CHECKS = {"audio/wav": check_wav, "image/bmp": check_bmp, "image/png": check_png, "image/gif": check_gif, "image/x-portable-graymap": check_pgm}


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in SIGNATURES.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff_value(data: bytes) -> list[tuple[int, int, str, int, int]]:
    """offset, length, type, start and end of the samples, of each confirmed medium outside another; the one at 0 may hold others.

    Media inside the samples of an uncompressed one (a whole file stored as samples) are told too.
    """
    out, covered, chains = [], 0, Chains(data)
    for last, (size, kind) in automaton().iter(data.decode("latin-1")):
        at = last - size + 1
        if at < covered or (found := CHECKS[kind](data, at, chains)) is None:
            continue
        end, start, stop = found
        out.append((at, end - at, kind, start, stop))
        if at:
            covered = end
    return out


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """MEDIA and n_bytes (the text's own UTF-8 bytes). The payload's crc32 chooses the container, and a declared type that is right only in a part of the rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        media, declared, sizes = [], [], []
        for text in texts_utf8(batch):
            payload = padded(text)
            crc = zlib.crc32(payload)
            media.append(WRITERS[crc % 3](payload))
            declared.append(STORED_TYPES[crc // 3 % 3])
            sizes.append(len(text))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(declared), pa.array(media, pa.binary()), pa.array(sizes, pa.int64())], ["id", "declared", "media", "n_bytes"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return map_batches(given, run, MEDIA + ", n_bytes long")


def sniff(media: DataFrame) -> DataFrame:
    """id, declared, detected (UNKNOWN if nothing is confirmed at 0), and embedded: the carved media with offset, length, type and bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        detected, embedded = [], []
        for data in batch.column("media").to_pylist():
            data = data or b""
            found = sniff_value(data)
            detected.append(next((kind for at, _, kind, _, _ in found if at == 0), UNKNOWN))
            embedded.append([{"offset": at, "length": n, "type": kind, "bytes": data[at : at + n]} for at, n, kind, _, _ in found if at])
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())]))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("declared"), pa.array(detected, pa.string()), pa.array(embedded, kind)], ["id", "declared", "detected", "embedded"])

    return map_batches(media.select("id", "declared", "media"), run, "id long, declared string, detected string, embedded array<struct<offset: long, length: long, type: string, bytes: binary>>")


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each stored medium read back: its type told by its signature, its samples taken from where the validator finds them.

    feature: detected type, whether the declared one was right, number of embedded media, mean of the samples in
    thousandths, number of distinct samples.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in batch.column("media").to_pylist():
            found = sniff_value(data)
            kind, (start, stop) = next(((x[2], x[3:]) for x in found if x[0] == 0), (UNKNOWN, (0, len(data))))
            payload = data[start:stop]
            cells = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            mean = int(cells @ np.arange(256)) * 1000 // max(len(payload), 1)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), kind, sum(x[0] > 0 for x in found), mean, int(np.count_nonzero(cells))))
        columns = list(zip(*rows))
        feature = [f"{kind};{'as declared' if kind == declared else 'corrected'};embedded={n};mean={mean};distinct={k}" for kind, n, mean, k, declared in zip(*columns[5:], batch.column("declared").to_pylist())]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *map(pa.array, columns[:5], kinds), pa.array(feature)], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(media, run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
