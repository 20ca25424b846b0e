"""Signatures: linear time on hostile values, and the same verdicts as validators that walk every chain anew."""

import random
import struct
import time
import zlib

import pytest

from parcelwise.llm import media_columns as m


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


IHDR = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
PNG = b"\x89PNG\r\n\x1a\n" + IHDR + chunk(b"IDAT", b"abc") + chunk(b"IEND", b"")
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x21\xf9\x04abcd\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02Lx\0" + b";"


def plain_png(data, at):
    k, first = at + 8, True
    while k + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, k)
        if k + 12 + size > len(data) or first != (name == b"IHDR") or (first and size != 13) or not name.isalpha() or zlib.crc32(data[k + 4 : k + 8 + size]) != struct.unpack_from(">I", data, k + 8 + size)[0]:
            return None
        first, k = False, k + 12 + size
        if name == b"IEND":
            return k, at, k
    return None


def plain_gif(data, at):
    def blocks(k):
        while k < len(data) and data[k]:
            k += 1 + data[k]
        return k + 1

    if len(data) < at + 13:
        return None
    k, images = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 0x80 else 0), 0
    while k < len(data):
        if data[k] == 0x3B:
            return (k + 1, at, k + 1) if images else None
        if data[k] == 0x21:
            k = blocks(k + 2)
        elif data[k] == 0x2C and k + 10 < len(data):
            k, images = blocks(k + 10 + (3 << (data[k + 9] & 7) + 1 if data[k + 9] & 0x80 else 0) + 1), images + 1
        else:
            return None
    return None


def plain_wav(data, at):
    if len(data) < at + 44 or data[at + 8 : at + 12] != b"WAVE":
        return None
    end, k, form = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12, None
    while end <= len(data) and k + 8 <= len(data):
        name, size = data[k : k + 4], struct.unpack_from("<I", data, k + 4)[0]
        if name == b"data":
            right = form and k + 8 + size <= end and form[0] == 1 and form[5] == 8 and form[3] == form[2] * form[1]
            return (end, k + 8, k + 8 + size) if right else None
        if name == b"fmt " and size >= 16 and k + 24 <= len(data):
            form = struct.unpack_from("<HHIIHH", data, k + 8)
        k += 8 + size + size % 2
    return None


@pytest.mark.parametrize("seed", range(6))
def test_verdicts_are_those_of_plain_validators(seed):
    r = random.Random(seed)
    wav = m.write_wav(b"samples." * 24)
    odd = wav[:36] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + wav[36:]
    odd = odd[:4] + struct.pack("<I", len(odd) - 8) + odd[8:]
    pieces = [PNG, GIF, wav, odd, PNG[:-9], GIF[:20], GIF[:13], wav[:40], b"GIF89a", b"RIFF", b"\x89PNG\r\n\x1a\n", IHDR, b"\x21\x05", b"\x2c", b"\0", b";", b"data", b"WAVE", bytes(r.randrange(256) for _ in range(30)), m.write_bmp(b"x" * 192), m.write_pgm(b"y" * 192)]
    checks = {"image/png": (m.check_png, plain_png), "image/gif": (m.check_gif, plain_gif), "audio/wav": (m.check_wav, plain_wav)}
    seen = 0
    for _ in range(120):
        data = b"".join(r.choice(pieces) for _ in range(r.randrange(1, 25)))
        if r.random() < 0.3:
            spoiled = bytearray(data)
            spoiled[r.randrange(len(data))] = r.randrange(256)
            data = bytes(spoiled)
        chains = m.Chains(data)
        for magic, kind in m.SIGNATURES.items():
            at = data.find(magic)
            while at >= 0 and kind in checks:
                new, plain = checks[kind]
                want = plain(data, at)
                assert new(data, at, chains) == want
                seen += want is not None
                at = data.find(magic, at + 1)
    assert seen > 50


def test_crc_of_parts():
    r = random.Random(3)
    data = r.randbytes(50_000)
    chains = m.Chains(data)
    for _ in range(200):
        a, b = sorted(r.randrange(len(data) + 1) for _ in range(2))
        assert chains.crc(a, b) == zlib.crc32(data[a:b])


HEAD = b"GIF89a" + b"\x10\x10\x10\x10\0\0\0"


@pytest.mark.parametrize(
    "unit",
    [b"RIFF", b"BM", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"GIF87a", b"P5\n", b"P5\n9 9\n255\n", HEAD, HEAD + b"\x21\x01\x01", HEAD + b"\x2c" + b"\0" * 9 + b"\x01\x01", b"RIFF\x40\x00\x01\x00WAVELIST\x01\0\0\0x\0" + b"q" * 22,
     b"\x89PNG\r\n\x1a\n" + IHDR + struct.pack(">I", 0x7FFF) + b"IDAT", b"\x89PNG\r\n\x1a\n" + IHDR + chunk(b"tEXt", b"x")],
)
def test_a_megabyte_of_signatures(unit):
    data = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    m.sniff_value(data)
    m.sniff_value(data[::-1][:100] + data)
    assert time.perf_counter() - began < 6  # walking every chain anew takes minutes


def test_feature_has_five_parts(spark):
    text = "AB" * 96 + GIF.decode("latin-1")
    payload = m.padded(text.encode())
    row = m.digests(m.store(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    kind = m.STORED_TYPES[zlib.crc32(payload) % 3]
    declared = m.STORED_TYPES[zlib.crc32(payload) // 3 % 3]
    inside = len([x for x in m.sniff_value(m.WRITERS[zlib.crc32(payload) % 3](payload)) if x[0]])
    assert row.feature == f"{kind};{'as declared' if kind == declared else 'corrected'};embedded={inside};mean={sum(payload) * 1000 // len(payload)};distinct={len(set(payload))}"
