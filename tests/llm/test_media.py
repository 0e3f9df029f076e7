import hashlib
import random
import zlib

import numpy as np
import pytest

from citeloom.llm import media


def test_zigzag():
    assert media.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.zigzag()) == list(range(64))


def test_round_trip():
    r = random.Random(3)
    for n in [1, 63, 64, 192, 193, 5000, 70_000]:
        raw = bytes(r.randrange(256) for _ in range(n))
        for payload in (raw, media.padded(raw), b"\xff" * n, b"\x00" * n):
            assert media.read_jpeg(media.encode_payload(payload)).payload() == payload
    big = bytes(range(256)) * 9000
    j = media.read_jpeg(media.encode_payload(big))
    assert j.payload() == big and j.height <= 65535


def test_both_decoders_agree(monkeypatch):
    r = random.Random(5)
    payloads = [bytes(r.randrange(256) for _ in range(192 * n)) for n in (1, 7, 40)]
    files = [media.encode_payload(p) for p in payloads]
    assert [j.payload() for j in media.read_jpegs(files)] == payloads
    monkeypatch.setattr(media, "LANES", 10**9)  # one code after the other
    assert [j.payload() for j in media.read_jpegs(files)] == payloads


def with_variable_codes(blocks, restart):
    """A file of one row of blocks with codes of unlike lengths, runs, ends of blocks and restarts."""
    import struct

    dcc, dn, ds = media.canonical({0: 2, 1: 2, 2: 3, 3: 3, 4: 4, 5: 5, 6: 5})
    acc, an, as_ = media.canonical({0x00: 2, 0x01: 2, 0x02: 3, 0x11: 3, 0x33: 5, 0xF0: 5, 0x05: 6})

    def number(v):
        n = int(v).bit_length() if v >= 0 else int(-v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    scan, bits, before = b"", "", 0
    for i, b in enumerate(blocks):
        n, v = number(b[0] - before)
        before = b[0]
        bits += f"{dcc[n][0]:0{dcc[n][1]}b}" + v
        run, last = 0, max(np.flatnonzero(b), default=0)
        for x in b[1 : last + 1] if last else []:
            if x == 0:
                run += 1
                if run == 16:
                    bits, run = bits + f"{acc[0xF0][0]:0{acc[0xF0][1]}b}", 0
                continue
            n, v = number(x)
            c = acc[run << 4 | n]
            bits, run = bits + f"{c[0]:0{c[1]}b}" + v, 0
        if last < 63:
            bits += f"{acc[0][0]:0{acc[0][1]}b}"
        if (i + 1) % restart == 0 or i == len(blocks) - 1:
            bits += "1" * (-len(bits) % 8)
            scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + (b"" if i == len(blocks) - 1 else bytes([0xFF, 0xD0 + i // restart % 8]))
            bits, before = "", 0
    return b"".join([b"\xff\xd8", media._segment(0xDB, b"\x00" + b"\x08" * 64), media._segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * len(blocks), 1) + b"\x01\x11\x00"), media._segment(0xC4, b"\x00" + bytes(dn) + bytes(ds)), media._segment(0xC4, b"\x10" + bytes(an) + bytes(as_)), media._segment(0xDD, struct.pack(">H", restart)), media._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"), scan, b"\xff\xd9"])


def test_variable_codes_side_by_side(monkeypatch):
    r = random.Random(8)
    blocks = np.zeros((200, 64), int)
    for b in blocks:
        b[0] = r.randint(-20, 20)
        at = 0
        while (at := at + r.choice([1, 1, 2, 4, 17])) < 64:
            gap = at - max(np.flatnonzero(b[:at]), default=0) - 1
            b[at] = {0: r.choice([1, -1, 2, -3, 19, -31]), 1: r.choice([1, -1]), 3: r.choice([4, -7]), 16: r.choice([1, -2])}.get(gap, 0)
            if not b[at]:
                break
    for restart in (1, 3, 7):
        data = with_variable_codes(blocks, restart)
        assert (media.read_jpeg(data).components[0].blocks == blocks).all()
        with monkeypatch.context() as m:
            m.setattr(media, "LANES", 10**9)
            assert (media.read_jpeg(data).components[0].blocks == blocks).all()
        for cut in (media.read_jpeg, media._parsed):
            with pytest.raises(ValueError):
                cut(data[: len(data) // 2])


def test_shapes_and_hash():
    for n in (1, 2, 3, 53, 54, 300, 5000, 40_000):
        w, h = media._shape(n)
        assert w * h >= n and w * h - n < max(w, h) and max(w, h) <= media.MAX_SIDE
    r = random.Random(4)
    texts = ["".join(r.choice("abc DEF") for _ in range(20_000)) for _ in range(6)]
    bits = np.array([np.unpackbits(np.frombuffer(bytes.fromhex(media.image_features(media.encode_payload(media.padded(t.encode())))[2]), np.uint8)) for t in texts])
    assert (bits.any(axis=0)).sum() > 48  # all columns of the hash take part


def test_foreign_jpeg():
    """A hand-made 16x8 file of 2 blocks with the usual kind of tables: runs, EOB, a restart and stuffing."""
    dc = {0: 2, 3: 2, 5: 2}
    ac = {0x00: 2, 0x12: 2, 0xF0: 3, 0x01: 3}
    dcc, dn, ds = media.canonical(dc)
    acc, an, as_ = media.canonical(ac)

    def bits(*xs):
        return "".join(f"{c:0{n}b}" for c, n in xs if n)

    first = bits(dcc[5], (20, 5), acc[0x12], (1, 2), acc[0x00])  # 20; run 1, value -2
    second = bits(dcc[3], (0, 3), acc[0xF0], acc[0x01], (1, 1), acc[0x00])  # -7; 16 zeros, then 1

    def pack(s):
        s += "1" * (-len(s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00")

    import struct

    data = b"".join([b"\xff\xd8", media._segment(0xDB, b"\x00" + b"\x08" * 64), media._segment(0xC0, struct.pack(">BHHB", 8, 8, 16, 1) + b"\x01\x11\x00"), media._segment(0xC4, b"\x00" + bytes(dn) + bytes(ds)), media._segment(0xC4, b"\x10" + bytes(an) + bytes(as_)), media._segment(0xDD, b"\x00\x01"), media._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"), pack(first), b"\xff\xd0", pack(second), b"\xff\xd9"])
    b = media.read_jpeg(data).components[0].blocks
    assert b[0, 0] == 20 and b[0, 2] == -2 and b[1, 0] == -7 and b[1, 17] == 1 and np.count_nonzero(b) == 4
    assert media.read_jpeg(data).thumbnail().tolist() == [[148, 121]]
    assert media.image_features(data)[:2] == (16, 8)
    assert media.image_features(None) is None and media.image_features(b"GIF89a") is None and media.image_features(data[:60]) is None


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "é" * 200), (3, "é" * 200), (4, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'keep' as feature", "7 as width")
    got = sorted(media.media_columns(df).collect(), key=lambda r: r.doc_id)
    for (_, t), r in zip(rows, got, strict=True):
        want = media.padded((t or "").encode())
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(want)) and len(want) % 192 == 0
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-16:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.feature == "keep"
        assert media.image_features(r.media) == (r.width, r.height, r.thumb_hash)
    assert media.media_columns(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        media.read_jpeg(b"")
