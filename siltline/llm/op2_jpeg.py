"""Baseline JPEG media columns: an entropy coder and a decoder that run on whole batches.

Payload bytes are stored as quantised coefficients (the format's unit; going through the
cosine transform would round), 64 to a block in scan order, with a restart marker every few
blocks. The decoder parses markers and Huffman-decodes any baseline scan: all restart
intervals of a batch advance together, one symbol a step, as numpy vectors. Thumbnails take the
DC coefficients of the luminance component, one pixel a block.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import by_rows, table, utf8, written

#: Blocks between restart markers, and intervals that are coded or decoded at once.
RESTART, CODED, DECODED = 4, 1 << 12, 1 << 14
ZRL, EOB = 0xF0, 0x00


def code_lengths(ac: bool) -> dict[int, int]:
    """Symbol to code length. AC: the sizes of text bytes get the short codes, by rule."""
    if not ac:
        return dict.fromkeys(range(12), 4)
    short = {0x05: 2, 0x04: 2, 0x07: 2, 0x06: 3, 0x03: 4, 0x02: 5, 0x08: 6, 0x01: 7, EOB: 8}
    rest = [r << 4 | s for r in range(16) for s in range(1, 11)] + [ZRL]
    return short | {s: 16 for s in rest if s not in short}


def dht_segment(kind: int, lengths: dict[int, int]) -> bytes:
    ordered = sorted(lengths, key=lambda s: lengths[s])
    counts = bytes(sum(n == i for n in lengths.values()) for i in range(1, 17))
    return bytes([kind]) + counts + bytes(ordered)


def canonical(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length) of a Huffman table as the format lays it down."""
    out, code, at = {}, 0, 0
    for n in range(1, 17):
        for s in symbols[at : at + counts[n - 1]]:
            out[s] = (code, n)
            code += 1
        at += counts[n - 1]
        code <<= 1
    return out


@lru_cache
def _own_tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    """The DHT body and, for DC and AC, code << 8 | length of each symbol."""
    body, codes = b"", []
    for kind, ac in ((0x00, False), (0x10, True)):
        seg = dht_segment(kind, code_lengths(ac))
        body += seg
        t = np.zeros(256, np.int64)
        for s, (code, n) in canonical(seg[1:17], seg[17:]).items():
            t[s] = code << 8 | n
        codes.append(t)
    return body, *codes


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _bit_size(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def _code_intervals(coef: np.ndarray, first: np.ndarray, closing: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded bytes of intervals with their markers, and each interval's length in them.

    coef: blocks x 64; first: each interval's first block; closing: the marker byte after it, 0
    for none.
    """
    _, dc_codes, ac_codes = _own_tables()
    m = len(coef)
    v = coef.astype(np.int64)
    v[1:, 0] -= coef[:-1, 0]
    v[first, 0] = coef[first, 0]
    flat = v.ravel()
    at = np.arange(m * 64)
    nz = flat != 0
    nz[::64] = True
    last = np.maximum.accumulate(np.where(nz, at, 0))
    before = np.r_[0, last[:-1]]
    size = _bit_size(flat)
    run = at - before - 1
    symbol = ((run & 15) << 4) | size
    zero = at - last  # zeros since the last coefficient, here included
    end = (nz.reshape(m, 64) * np.arange(64)).max(axis=1)
    later = (at & 63) < np.repeat(end, 64)
    code = np.where(nz, ac_codes[symbol & 255], 0)
    code[::64] = dc_codes[size[::64]]
    zeros = np.flatnonzero(~nz)
    code[zeros] = np.where(later[zeros] & (zero[zeros] & 15 == 0), ac_codes[ZRL], 0)
    stop = np.flatnonzero(end < 63)
    code[stop * 64 + end[stop] + 1] = ac_codes[EOB]
    extra = np.where(flat < 0, flat + (1 << size) - 1, flat)
    bits = code & 255
    size[zeros] = 0
    value = ((code >> 8) << size) | np.where(nz, extra, 0)
    bits += size
    total = np.add.reduceat(bits, first * 64)
    pad = -total % 8
    length = (total + pad) >> 3
    start = np.r_[0, np.cumsum(length)]
    inside = np.cumsum(bits) - bits
    many = np.diff(np.r_[first, m]) * 64
    off = inside + np.repeat(start[:-1] * 8 - inside[first * 64], many)
    left = value << np.minimum(64 - bits - (off & 31), 63)  # 64 bits from the word's first on
    word = off >> 5
    n = int(start[-1] // 4) + 2
    hi = np.bincount(word, (left >> 32 & 0xFFFFFFFF).astype(np.float64), n)
    lo = np.bincount(word + 1, (left & 0xFFFFFFFF).astype(np.float64), n)
    raw = np.frombuffer((hi + lo).astype(np.uint64).astype(">u4").tobytes(), np.uint8)[: start[-1]].copy()
    raw[start[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    ff = raw == 0xFF
    marks = 2 * (closing != 0)
    which = np.repeat(np.r_[0, np.cumsum(marks)[:-1]], length)
    pos = np.arange(len(raw)) + np.cumsum(ff) - ff + which
    stuffed = np.add.reduceat(ff.astype(np.int64), start[:-1]) + length + marks
    out = np.zeros(int(stuffed.sum()), np.uint8)
    out[pos] = raw
    tail = np.cumsum(stuffed)[closing != 0]
    out[tail - 2], out[tail - 1] = 0xFF, closing[closing != 0]
    return out.tobytes(), stuffed


def encode(payloads: list[bytes], comments: list[bytes]) -> list[bytes]:
    """A grey baseline JPEG of each payload (a positive multiple of 64 bytes each)."""
    blocks, first, closing, shape, n_first = [], [], [], [], 0
    for p in payloads:
        n = len(p) // 64
        wide = math.isqrt(n - 1) + 1
        high = -(-n // wide)
        x = np.zeros((wide * high, 64), np.int16)
        x[:n] = np.frombuffer(p, np.uint8).reshape(n, 64).astype(np.int16) - 128
        blocks.append(x)
        f = np.arange(0, wide * high, RESTART)
        c = 0xD0 + np.arange(len(f)) % 8
        c[-1] = 0
        first.append(f + n_first)
        closing.append(c)
        shape.append((wide, high, len(f)))
        n_first += wide * high
    coef, first, closing = np.concatenate(blocks), np.concatenate(first), np.concatenate(closing)
    scans, sizes = [], []
    for i in range(0, len(first), CODED):
        z = first[i + CODED] if i + CODED < len(first) else len(coef)
        f = first[i : i + CODED]
        data, size = _code_intervals(coef[f[0] : z], f - f[0], closing[i : i + CODED])
        scans.append(data)
        sizes.append(size)
    data, ends = b"".join(scans), np.r_[0, np.cumsum(np.concatenate(sizes))]
    out, at = [], 0
    for (wide, high, n), comment in zip(shape, comments, strict=True):
        head = b"\xff\xd8" + segment(0xFE, comment) + segment(0xDB, bytes([0]) + bytes([1]) * 64)
        head += segment(0xC0, bytes([8]) + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        head += segment(0xC4, _own_tables()[0]) + segment(0xDD, RESTART.to_bytes(2, "big"))
        head += segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
        out.append(head + data[ends[at] : ends[at + n]] + b"\xff\xd9")
        at += n
    return out


class Jpeg:
    """Parsed markers of a baseline file: size, components, tables and the place of its scan."""

    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.comment, self.restart, self.quant, self.tables, at = b"", 0, {}, {}, 2
        while True:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = 1 + (body[i] >> 4)
                    self.quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + 64 * wide], f">u{wide}").astype(int)
                    i += 1 + 64 * wide
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    n = sum(body[i + 1 : i + 17])
                    self.tables[body[i]] = body[i + 1 : i + 17 + n]
                    i += 17 + n
            elif marker == 0xC0:
                self.high, self.wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDA:
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        self.scan = slice(at, data.rindex(b"\xff\xd9"))
        one = len(self.parts) == 1
        self.layout = tuple((i, chosen[c] >> 4, 16 + (chosen[c] & 15)) for i, (c, h, v, _) in enumerate(self.parts) for _ in range(1 if one else h * v))
        hmax, vmax = (1, 1) if one else (max(p[1] for p in self.parts), max(p[2] for p in self.parts))
        self.across, self.down = -(-self.wide // (8 * hmax)), -(-self.high // (8 * vmax))
        self.key = (self.layout, tuple(sorted(self.tables.items())))


@lru_cache(maxsize=16)
def _lookup(table_: bytes) -> np.ndarray:
    """length << 8 | symbol for the next 16 bits of a stream; 0 where no code starts so."""
    out = np.zeros(1 << 16, np.uint16)
    for s, (code, n) in canonical(table_[:16], table_[16:]).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return out


def _decode_lanes(data: np.ndarray, pos: np.ndarray, blocks: np.ndarray, layout: tuple, tables: dict[int, bytes]) -> np.ndarray:
    """Coefficients (blocks x 64) of intervals that start at bit pos and hold so many blocks each."""
    kinds = sorted({t for _, d, a in layout for t in (d, a)})
    lut = np.concatenate([_lookup(tables[t]) for t in kinds])
    dc = np.array([kinds.index(d) << 16 for _, d, _ in layout])
    ac = np.array([kinds.index(a) << 16 for _, _, a in layout])
    comp, width = np.array([c for c, _, _ in layout]), len(layout)
    b = np.r_[data, np.full(8, 255, np.uint8)].astype(np.uint32)
    w = b[:-4] << 24 | b[1:-3] << 16 | b[2:-2] << 8 | b[3:-1]
    base = np.r_[0, np.cumsum(blocks)[:-1]]
    coef = np.zeros((int(blocks.sum()), 64), np.int16)
    flat = coef.ravel()
    pred = np.zeros((len(pos), int(comp.max()) + 1), np.int64)
    lane, k, done, pos = np.arange(len(pos)), np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64), pos.astype(np.int64)
    only = width == 1
    while len(lane):
        i = pos >> 3
        x = (w[i].astype(np.int64) << 8) | b[i + 4]
        room = 40 - (pos & 7)
        start = k == 0
        turn = 0 if only else done % width
        entry = lut[np.where(start, dc[turn], ac[turn]) + (x >> (room - 16) & 0xFFFF)].astype(np.int64)
        n, symbol = entry >> 8, entry & 255
        if not n.all():
            raise ValueError("damaged scan")
        size = symbol & 15
        n += size
        pos += n
        value = x >> (room - n) & ((1 << size) - 1)
        value -= np.where(value < (1 << size >> 1), (1 << size) - 1, 0)
        if start.any():
            s = np.flatnonzero(start)
            c = 0 if only else comp[turn[s]]
            value[s] += pred[lane[s], c]
            pred[lane[s], c] = value[s]
        k += np.where(start, 0, symbol >> 4)
        put = (size > 0) | start
        flat[((base[lane] + done) * 64 + k)[put]] = value[put]
        k += 1
        k[(symbol == EOB) & ~start] = 64
        over = k >= 64
        if over.any():
            done += over
            k[over] = 0
            alive = done < blocks[lane]
            if not alive.all():
                lane, k, done, pos = lane[alive], k[alive], done[alive], pos[alive]
    return coef


def decode(files: list[bytes]) -> list[tuple[Jpeg, np.ndarray]]:
    """(parsed markers, coefficients in scan order, blocks x 64) of each baseline file."""
    parsed = [Jpeg(f) for f in files]
    out: list = [None] * len(files)
    groups: dict[tuple, list[int]] = {}
    for i, j in enumerate(parsed):
        groups.setdefault(j.key, []).append(i)
    for members in groups.values():
        layout, tables = parsed[members[0]].layout, parsed[members[0]].tables
        s = np.frombuffer(b"".join(files[i][parsed[i].scan] for i in members), np.uint8)
        sizes = [parsed[i].scan.stop - parsed[i].scan.start for i in members]
        image = np.r_[0, np.cumsum(sizes)]
        after = np.r_[s[1:], 0]
        ff = s == 0xFF
        rst = np.flatnonzero(ff & (after >= 0xD0) & (after <= 0xD7))
        drop = np.zeros(len(s), bool)
        drop[rst] = drop[rst + 1] = True
        drop[1:] |= ff[:-1] & (s[1:] == 0)
        begin = np.sort(np.r_[image[:-1], rst + 2])
        kept = np.r_[0, np.cumsum(~drop)]
        mcus = [parsed[i].across * parsed[i].down for i in members]
        steps = [parsed[i].restart or m for i, m in zip(members, mcus, strict=True)]
        blocks = np.concatenate([np.minimum(r, m - np.arange(0, m, r)) for m, r in zip(mcus, steps, strict=True)]) * len(layout)
        if len(blocks) != len(begin):
            raise ValueError("restart markers are missing")
        data, pos = s[~drop], kept[begin] * 8
        parts = []
        for a in range(0, len(pos), DECODED):
            z = pos[a + DECODED] >> 3 if a + DECODED < len(pos) else len(data)
            lo = pos[a] >> 3
            parts.append(_decode_lanes(data[lo:z], pos[a : a + DECODED] - lo * 8, blocks[a : a + DECODED], layout, tables))
        coef, at = np.concatenate(parts), 0
        for i, m in zip(members, mcus, strict=True):
            out[i] = (parsed[i], coef[at : at + m * len(layout)])
            at += m * len(layout)
    return out


def thumbnail(j: Jpeg, coef: np.ndarray) -> np.ndarray:
    """Luminance of each 8x8 block from its DC coefficient, rows x columns, 0 to 255."""
    _, h, v, q = j.parts[0]
    if len(j.parts) == 1:
        h = v = 1
    mine = [i for i, (c, _, _) in enumerate(j.layout) if c == 0]
    dc = coef.reshape(j.down, j.across, len(j.layout), 64)[:, :, mine, 0].reshape(j.down, j.across, v, h)
    dc = dc.transpose(0, 2, 1, 3).reshape(j.down * v, j.across * h)
    return np.clip(np.rint(dc * (j.quant[q][0] / 8) + 128), 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """16 hex digits: of an 8x8 reduction, which cells are brighter than the mean."""
    rows = [np.arange(8) * n // 8 for n in pixels.shape]
    ends = [np.maximum((np.arange(8) + 1) * n // 8, r + 1) for n, r in zip(pixels.shape, rows, strict=True)]
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    total[1:, 1:] = pixels.cumsum(0, dtype=np.float64).cumsum(1)
    (r0, c0), (r1, c1) = rows, ends
    cell = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    cell /= np.outer(r1 - r0, c1 - c0)
    return np.packbits(cell.ravel() > cell.mean()).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text's bytes, filled with zeros to a positive multiple of 64, as a JPEG.

    A null text is empty. The text's length is kept in the file's comment. A text may have up
    to 4 GB, more than Spark's strings. Rows are independent; repeats and null ids stay.
    """

    def run(b: dict[str, list]) -> dict[str, list]:
        if not b["text"]:
            return {"doc_id": [], "media": []}
        padded = [t + bytes(64 if not t else -len(t) % 64) for t in b["text"]]
        return {"doc_id": b["doc_id"], "media": encode(padded, [str(len(t)).encode() for t in b["text"]])}

    return by_rows(docs.select("doc_id", utf8().alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def features(media: DataFrame) -> DataFrame:
    """What is read back from a media column made by store(): digests, dimensions, thumbnail hash.

    Rows whose media is null are dropped by no one: their columns are null.
    """

    def one(file: bytes, j: Jpeg, coef: np.ndarray) -> tuple:
        n = int(j.comment)
        payload = (coef.ravel()[: n + (64 if not n else -n % 64)] + 128).astype(np.uint8).tobytes()
        shown = thumbnail_hash(thumbnail(j, coef))
        return (
            n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
            len(file), hashlib.sha256(file).hexdigest(), f"{j.wide}x{j.high}:{shown}", j.wide, j.high,
        )

    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(b: dict[str, list]) -> dict[str, list]:
        there = [i for i, m in enumerate(b["media"]) if m is not None]
        rows: list = [(None,) * len(names)] * len(b["media"])
        for i, (j, coef) in zip(there, decode([b["media"][i] for i in there]), strict=True):
            rows[i] = one(b["media"][i], j, coef)
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return {"doc_id": b["doc_id"]} | dict(zip(names, map(list, cols), strict=True))

    return by_rows(media.select("doc_id", "media"), run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def op2_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(written(store(table(spark, sf_dir, "documents")), "media"))
