"""Operator 10: media columns held as baseline JPEG.

``encode_payload`` stores bytes losslessly as the quantised coefficients of a
greyscale baseline JPEG (its unit: 64 coefficients a block), each block a restart
interval. ``read_jpegs`` parses markers and Huffman-decodes scans of any baseline
files (several components, sampling factors, restart intervals). Restart intervals
don't depend on each other, so those of all files with the same tables are decoded
side by side in numpy, one code of each at a time; few or interleaved ones take a
plain loop. Thumbnails come from the DC coefficients of the luminance only: one
pixel a block, no inverse transform.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from citeloom.llm.common import table

UNIT = 192
BLOCK = 64
#: Most blocks in a row or column of an image.
MAX_SIDE = 8191
#: Restart intervals from which decoding side by side pays.
LANES = 24
#: Characters of texts whose images are decoded together.
BATCH = 500_000
#: Bits of one coefficient, its Huffman code included: DC differences have 0 to 8 bits, AC values 1 to 9.
DC_BITS, AC_BITS = 9, 10


def zigzag() -> np.ndarray:
    """Natural position of each of the 64 coefficients in zigzag order."""
    order = sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
    return np.array(order)


def canonical(lengths: dict[int, int]) -> tuple[dict[int, tuple[int, int]], list[int], list[int]]:
    """symbol -> (code, length), and the counts and symbols of a DHT segment."""
    code, at, codes = 0, 0, {}
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    for s in symbols:
        code <<= lengths[s] - at
        at = lengths[s]
        codes[s] = (code, at)
        code += 1
    return codes, [sum(v == k for v in lengths.values()) for k in range(1, 17)], symbols


DC_CODES, DC_COUNTS, DC_SYMBOLS = canonical({s: DC_BITS - s for s in range(9)})
AC_CODES, AC_COUNTS, AC_SYMBOLS = canonical({s: AC_BITS - s for s in range(1, 10)})


def _size(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v).astype(np.float64) + 1)).astype(np.int64)


#: Bits of the AC coefficient byte + 1, and of the DC difference d + 255.
AC_TABLE = np.array([(AC_CODES[int(s)][0] << int(s)) | (b + 1) for b, s in enumerate(_size(np.arange(256) + 1))], np.uint16)
DC_TABLE = np.array([(DC_CODES[int(s)][0] << int(s)) | (d if d >= 0 else d + (1 << int(s)) - 1) for d, s in zip(range(-255, 256), _size(np.arange(-255, 256)), strict=True)], np.uint16)


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    """raw with bytes 32 appended up to a positive multiple of unit."""
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low width bits of 16-bit values, most significant first, along a new last axis."""
    as_bytes = values.astype(">u2").view(np.uint8).reshape(*values.shape, 2)
    return np.unpackbits(as_bytes, axis=-1)[..., 16 - width :]


def _shape(blocks: int) -> tuple[int, int]:
    """Width and height in blocks of an image of at least so many: near a square, without a rest where a divisor is near."""
    if blocks > MAX_SIDE * MAX_SIDE:
        raise ValueError("payload too large for one image")
    side = min(MAX_SIDE, math.isqrt(blocks - 1) + 1)
    for wide in range(side, max(1, side // 2), -1):
        if blocks % wide == 0 and blocks // wide <= MAX_SIDE:
            return blocks // wide, wide
    return side, -(-blocks // side)


def encode_payload(payload: bytes) -> bytes:
    """A greyscale baseline JPEG whose coefficients are the payload's bytes.

    A block's first byte b is the DC coefficient b - 128, each other byte b the AC
    coefficient b + 1 (never 0, so there are no runs), in zigzag order. Each block is
    a restart interval. A comment segment holds the payload's length.
    """
    wide, high = _shape(max(1, -(-len(payload) // BLOCK)))
    data = np.full(wide * high * BLOCK, 32, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(-1, BLOCK)
    bits = np.ones((len(data), -(-(DC_BITS + 63 * AC_BITS) // 8) * 8), np.uint8)  # filled up with ones
    bits[:, :DC_BITS] = _bits(DC_TABLE[data[:, 0].astype(np.int64) - 128 + 255], DC_BITS)
    bits[:, DC_BITS : DC_BITS + 63 * AC_BITS] = _bits(AC_TABLE[data[:, 1:]], AC_BITS).reshape(len(data), -1)
    packed = np.packbits(bits, axis=-1)
    # A zero follows each byte 255, and a restart marker each block but the last.
    step = 1 + (packed == 255).astype(np.int64)
    step[:-1, -1] += 2
    ends = np.cumsum(step.reshape(-1))
    scan = np.zeros(ends[-1], np.uint8)
    scan[ends - step.reshape(-1)] = packed.reshape(-1)
    marks = ends.reshape(len(data), -1)[:-1, -1]
    scan[marks - 2], scan[marks - 1] = 255, 0xD0 + np.arange(len(marks)) % 8
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xFE, b"bytes:%d" % len(payload)),
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\x01\x11\x00"),
            _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
            _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
            _segment(0xDD, b"\x00\x01"),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
            scan.tobytes(),
            b"\xff\xd9",
        ]
    )


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0
    wide: int = 0
    high: int = 0
    blocks: np.ndarray | None = None


@dataclass
class Jpeg:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)

    def thumbnail(self) -> np.ndarray:
        """Luminance pixels, one a block, from the DC coefficients alone."""
        y = self.components[0]
        dc = y.blocks[:, 0].reshape(y.high, y.wide).astype(np.int64) * int(self.quant[y.quant][0])
        rows, cols = -(-self.height * y.v // (8 * max(c.v for c in self.components))), -(-self.width * y.h // (8 * max(c.h for c in self.components)))
        return np.clip(np.floor_divide(dc, 8) + 128, 0, 255).astype(np.uint8)[:rows, :cols]

    def payload(self) -> bytes:
        """The bytes that encode_payload has stored."""
        b = self.components[0].blocks
        out = np.empty(b.shape, np.uint8)
        out[:, 0], out[:, 1:] = b[:, 0] + 128, b[:, 1:] - 1
        return out.tobytes()[: int(self.comment.removeprefix(b"bytes:"))]


def _huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16 bits that may follow; length 0: no code."""
    symbol, length, at, code = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            lo = code << (16 - bits)
            symbol[lo : lo + (1 << (16 - bits))], length[lo : lo + (1 << (16 - bits))] = symbols[at], bits
            code, at = code + 1, at + 1
        code <<= 1
    return symbol, length


def _extend(v: int, size: int) -> int:
    return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


def _scan_generic(data: bytes, order: list[Component], units: list[tuple[int, np.ndarray]], tables: dict) -> None:
    """Huffman-decode one restart interval: units are (component's place in order, its blocks)."""
    bits, n, at = int.from_bytes(data, "big"), len(data) * 8, 0
    pad = 64
    bits = (bits << pad) | ((1 << pad) - 1)
    total = n + pad
    view = data + b"\xff" * 12
    pred = [0] * len(order)

    def peek16(p: int) -> int:
        k = p >> 3
        return (int.from_bytes(view[k : k + 3], "big") >> (8 - (p & 7))) & 0xFFFF

    def take(p: int, size: int) -> int:
        if not size:
            return 0
        k = p >> 3
        return (int.from_bytes(view[k : k + 5], "big") >> (40 - (p & 7) - size)) & ((1 << size) - 1)

    del bits, total
    for place, block in units:
        c = order[place]
        symbol, length = tables[0, c.dc]
        w = peek16(at)
        s, size = int(symbol[w]), int(length[w])
        if not size or at > n:
            raise ValueError("bad Huffman code")
        at += size
        pred[place] += _extend(take(at, s), s)
        at += s
        block[0] = pred[place]
        symbol, length = tables[1, c.ac]
        k = 1
        while k < 64:
            w = peek16(at)
            rs, size = int(symbol[w]), int(length[w])
            if not size or at > n:
                raise ValueError("bad Huffman code")
            at += size
            r, s = rs >> 4, rs & 15
            if s == 0:
                if r != 15:
                    break
                k += 16
                continue
            k += r
            if k > 63:
                raise ValueError("run past the block")
            block[k] = _extend(take(at, s), s)
            at += s
            k += 1


@dataclass
class Scan:
    """An entropy-coded segment: its components in order, bytes, restart interval (0: none) and Huffman tables as (counts + symbols)."""

    image: Jpeg
    order: list[Component]
    data: bytes
    restart: int
    tables: dict[tuple[int, int], bytes]

    def alone(self) -> list[int]:
        """Of a scan of one component, the places of its blocks in their order."""
        c = self.order[0]
        w = -(-self.image.width * c.h // (8 * max(x.h for x in self.image.components)))
        h = -(-self.image.height * c.v // (8 * max(x.v for x in self.image.components)))
        return (np.arange(h)[:, None] * c.wide + np.arange(w)[None, :]).reshape(-1)


def _parsed(data: bytes) -> tuple[Jpeg, list[Scan]]:
    """Markers of a baseline JPEG; ValueError for anything that isn't one."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI")
    out, scans, at, restart, raw = Jpeg(), [], 2, 0, {}
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("no EOI")
        marker = data[at + 1]
        if marker in (0xFF, 0x00):
            at += 1
            continue
        if marker == 0xD9:
            break
        if 0xD0 <= marker <= 0xD8 or marker == 0x01:
            at += 2
            continue
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            out.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                out.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                raw[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            precision, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8 or not out.width or not out.height:
                raise ValueError("not 8-bit baseline")
            out.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            mh, mv = max(c.h for c in out.components), max(c.v for c in out.components)
            for c in out.components:
                c.wide, c.high = -(-out.width // (8 * mh)) * c.h, -(-out.height // (8 * mv)) * c.v
                c.blocks = np.zeros((c.wide * c.high, 64), np.int16)
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body[:2])
        elif marker == 0xDA:
            order = []
            for i in range(body[0]):
                c = next(c for c in out.components if c.ident == body[1 + 2 * i])
                c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                order.append(c)
            stop = at
            while True:
                stop = data.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= len(data):
                    raise ValueError("scan has no end")
                if data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                    stop += 2
                    continue
                break
            scans.append(Scan(out, order, data[at:stop], restart, dict(raw)))
            at = stop
    if not out.components:
        raise ValueError("no frame")
    return out, scans


def _decode_plain(scan: Scan) -> None:
    """One code after the other."""
    order = scan.order
    tables = {k: _huffman(v[:16], v[16:]) for k, v in scan.tables.items()}
    if len(order) == 1:
        units, per = [(0, order[0].blocks[i]) for i in scan.alone()], 1
    else:
        mw, mhigh = order[0].wide // order[0].h, order[0].high // order[0].v
        units = [(p, c.blocks[(my * c.v + y) * c.wide + mx * c.h + x]) for my in range(mhigh) for mx in range(mw) for p, c in enumerate(order) for y in range(c.v) for x in range(c.h)]
        per = sum(c.h * c.v for c in order)
    pieces, start, i, data = [], 0, 0, scan.data
    while (i := data.find(b"\xff", i)) >= 0:
        if 0xD0 <= data[i + 1] <= 0xD7:
            pieces.append(data[start:i])
            start = i + 2
        i += 2
    pieces.append(data[start:])
    step = scan.restart * per if scan.restart else len(units)
    if len(pieces) * step < len(units):
        raise ValueError("scan ends early")
    for k, piece in enumerate(pieces):
        _scan_generic(piece.replace(b"\xff\x00", b"\xff"), order, units[k * step : (k + 1) * step], tables)


def _intervals(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A scan's bytes without stuffing and markers, and where each restart interval starts."""
    a = np.frombuffer(data, np.uint8)
    after = np.zeros(len(a), bool)
    after[1:] = a[:-1] == 255
    mark = after & (a >= 0xD0) & (a <= 0xD7)
    keep = ~(after & (a == 0)) & ~mark
    keep[np.flatnonzero(mark) - 1] = False
    starts = np.concatenate([[0], np.cumsum(keep)[mark]])
    return a[keep], starts


def _decode_side_by_side(scans: list[Scan]) -> None:
    """Scans of one component with the same tables: a code of every restart interval at a time."""
    codes = np.zeros(2 << 16, np.int64)
    first = scans[0]
    for kind, ident in ((0, first.order[0].dc), (1, first.order[0].ac)):
        symbol, length = _huffman(first.tables[kind, ident][:16], first.tables[kind, ident][16:])
        codes[kind << 16 : (kind + 1) << 16] = symbol.astype(np.int64) << 8 | length
    buffers, starts, ends, counts, firsts, places = [], [], [], [], [], []
    size = rows = 0
    for scan in scans:
        body, begin = _intervals(scan.data)
        where = scan.alone()
        step = scan.restart or len(where)
        lanes = -(-len(where) // step)
        if len(begin) < lanes:
            raise ValueError("scan ends early")
        begin = begin[:lanes]
        buffers += [body, np.full(8, 255, np.uint8)]
        starts.append(size + begin)
        ends.append(size + np.append(begin[1:], len(body)))
        counts.append(np.minimum(step, len(where) - step * np.arange(lanes)))
        firsts.append(rows + step * np.arange(lanes))
        places.append(where)
        size, rows = size + len(body) + 8, rows + len(where)
    buf = np.concatenate(buffers).astype(np.int64)
    at, end, row, left = np.concatenate(starts) * 8, np.concatenate(ends) * 8, np.concatenate(firsts), np.concatenate(counts)
    k, before = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    out = np.zeros((rows, 64), np.int16)
    while len(at):
        i = at >> 3
        if (at >= end).any():
            raise ValueError("scan ends early")
        window = (((buf[i] << 16) | (buf[i + 1] << 8) | buf[i + 2]) >> (8 - (at & 7))) & 0xFFFF
        is_dc = k == 0
        code = codes[window + np.where(is_dc, 0, 1 << 16)]
        length, symbol = code & 255, code >> 8
        if (length == 0).any():
            raise ValueError("bad Huffman code")
        at = at + length
        bits, run = np.where(is_dc, symbol, symbol & 15), np.where(is_dc, 0, symbol >> 4)
        i = at >> 3
        value = (((buf[i] << 24) | (buf[i + 1] << 16) | (buf[i + 2] << 8) | buf[np.minimum(i + 3, len(buf) - 1)]) >> (32 - (at & 7) - bits)) & ((1 << bits) - 1)
        value = np.where((bits > 0) & (value < (1 << np.maximum(bits - 1, 0))), value - (1 << bits) + 1, value)
        at = at + bits
        before = np.where(is_dc, before + value, before)
        k = k + run
        some = is_dc | (bits > 0)
        if (k[some] > 63).any():
            raise ValueError("run past the block")
        out[row[some], k[some]] = np.where(is_dc, before, value)[some]
        # No bits: sixteen zeros, or the end of the block.
        k = np.where(some, k + 1, np.where(run == 15, k + 1, 64))
        done = k >= 64
        if done.any():
            row, left, k = row + done, left - done, np.where(done, 0, k)
            go = left > 0
            if not go.all():
                at, end, row, left, k, before = (x[go] for x in (at, end, row, left, k, before))
    for scan, where, lo in zip(scans, places, np.cumsum([0, *map(len, places)]), strict=False):
        scan.order[0].blocks[where] = out[lo : lo + len(where)]


def read_jpegs(files: list[bytes]) -> list[Jpeg]:
    """Parse and decode baseline JPEGs; ValueError for anything that isn't one."""
    parsed = [_parsed(data) for data in files]
    like: dict[tuple, list[Scan]] = {}
    for _, scans in parsed:
        for scan in scans:
            c = scan.order[0]
            key = (scan.tables.get((0, c.dc)), scan.tables.get((1, c.ac))) if len(scan.order) == 1 and scan.restart else None
            if key is None:
                _decode_plain(scan)
            else:
                like.setdefault(key, []).append(scan)
    for scans in like.values():
        if sum(len(s.alone()) // s.restart for s in scans) >= LANES:
            _decode_side_by_side(scans)
        else:
            for scan in scans:
                _decode_plain(scan)
    return [image for image, _ in parsed]


def read_jpeg(data: bytes) -> Jpeg:
    return read_jpegs([data])[0]


def difference_hash(thumb: np.ndarray, side: int = 8) -> str:
    """64 bits as hex: whether each of side x side cell means is less than its right neighbour's."""
    rows = np.linspace(0, thumb.shape[0], side + 1).astype(int)
    cols = np.linspace(0, thumb.shape[1], side + 2).astype(int)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    r0, r1 = np.minimum(rows[:-1], thumb.shape[0] - 1), None
    r1 = np.maximum(rows[1:], r0 + 1)
    c0 = np.minimum(cols[:-1], thumb.shape[1] - 1)
    c1 = np.maximum(cols[1:], c0 + 1)
    sums = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    means = sums / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    return np.packbits(means[:, :-1] < means[:, 1:]).tobytes().hex()


def image_features(data: bytes | None) -> tuple[int, int, str] | None:
    """Width, height and thumbnail hash of a stored image; None if it is null or no baseline JPEG."""
    if data is None:
        return None
    try:
        j = read_jpeg(bytes(data))
    except (ValueError, IndexError, StopIteration, KeyError, struct.error):
        return None
    return j.width, j.height, difference_hash(j.thumbnail())


def media_columns(docs: DataFrame, text: str = "text", keep_media: bool = True) -> DataFrame:
    """Store each text (null: empty) as a JPEG, read it back and add what the stored form shows.

    Added: media binary (if keep_media), n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, width, height, thumb_hash. One map over
    the rows: no shuffle, equal texts give equal values, repeated rows stay, other
    columns stay (those named like an added one are replaced).
    """
    added = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumb_hash string" + (", media binary" if keep_media else "")
    fields = T._parse_datatype_string(added).fields
    base = docs.drop(*[f.name for f in fields])
    schema = T.StructType([*base.schema.fields, *fields])

    def some(texts: list[str | None]) -> list[dict]:
        raws = [(t or "").encode("utf-8") for t in texts]
        stored = [encode_payload(padded(raw)) for raw in raws]
        out = []
        for raw, media, j in zip(raws, stored, read_jpegs(stored), strict=True):
            back = j.payload()
            if len(back) != max(UNIT, -(-len(raw) // UNIT) * UNIT):
                raise ValueError("the stored image lost bytes")
            out.append({"n_bytes": len(raw), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "width": j.width, "height": j.height, "thumb_hash": difference_hash(j.thumbnail())} | ({"media": media} if keep_media else {}))
        return out

    def pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """Ranges of texts of about BATCH characters together, a longer text on its own."""
        lo = size = 0
        for i, t in enumerate(texts):
            n = len(t or "")
            if i > lo and size + n > BATCH:
                yield lo, i
                lo, size = i, 0
            size += n
        if lo < len(texts):
            yield lo, len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo, hi in pieces(pdf[text].tolist()):  # stored forms of few rows at a time
                part = pdf.iloc[lo:hi]
                got = pd.DataFrame(some(part[text].tolist()), index=part.index, columns=[f.name for f in fields])
                yield pd.concat([part, got], axis=1)

    return base.mapInPandas(run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_media=False).drop("text")
    return out.withColumn("feature", F.format_string("jpeg:%dx%d:%s", "width", "height", "thumb_hash")).drop("width", "height", "thumb_hash")
