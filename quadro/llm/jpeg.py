"""Progressive JPEG in numpy: coefficient arrays from scans, and pictures from them.

encode() stores a payload, encode's own pictures being lossless containers: each byte is
one AC coefficient of magnitude 128 to 255 (JPEG's size category 8, whose additional
bits are the byte itself). DC stays 0. Per component, two spectral bands give the upper
seven bits of all coefficients and one refinement scan gives the lowest bit. Every code
is one bit long, so all scans have fixed-width entries.

decode() reads progressive files of this or any other Huffman coding, 8 bits a sample,
one or three components, restart intervals included. Scans whose entries have a fixed
width are read by numpy as a whole, others bit by bit.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

# The zigzag order (index k of a scan is position ZIGZAG[k] of a block).
ZIGZAG = np.array([x * 8 + d - x if d % 2 else (d - x) * 8 + x for d in range(15) for x in range(8) if 0 <= d - x < 8])
_U = np.cos((2 * np.arange(8) + 1)[None, :] * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.125), 0.5)[:, None]
#: 64 coefficients in zigzag order to 64 samples.
_INVERSE = np.einsum("ui,vj->uvij", _U, _U).reshape(64, 64)[ZIGZAG].astype(np.float32)
#: Payload bytes in one group of four luminance and two chroma blocks.
GROUP = 6 * 63
#: Rows of groups that are turned into samples at a time, in groups.
SLAB = 2048


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _table(kind: int, slot: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot, 1, *[0] * 15, symbol]))


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG that holds the payload; its length is in a comment."""
    groups = max(1, -(-len(payload) // GROUP))
    cols = min(4095, int(np.ceil(np.sqrt(groups))))
    rows = -(-groups // cols)
    blocks = np.zeros((rows * cols * 6, 63), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    n = rows * cols
    out = [b"\xff\xd8", _segment(0xFE, b"%d" % len(payload)), _segment(0xDB, bytes([0, *[1] * 64])),
           _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
           _table(0, 0, 0x00), _table(1, 0, 0x07), _table(1, 1, 0x00),
           _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0]))]
    full, rest = divmod(6 * n, 8)
    out.append(bytes(full) + (bytes([255 >> rest]) if rest else b""))
    for c, part in ((1, blocks[: 4 * n]), (2, blocks[4 * n : 5 * n]), (3, blocks[5 * n :])):
        upper = part >> 1
        bits = np.zeros((len(part), 64), np.uint8)
        bits[:, 1:] = (part & 1) ^ (part < 128)
        out += [_segment(0xDA, bytes([1, c, 0, 1, 5, 0x01])), upper[:, :5].tobytes(),
                _segment(0xDA, bytes([1, c, 0, 6, 63, 0x01])), upper[:, 5:].tobytes(),
                _segment(0xDA, bytes([1, c, 1, 1, 63, 0x10])), np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")]
    return b"".join([*out, b"\xff\xd9"])


@dataclass
class Picture:
    """Coefficient arrays (block rows, block columns, 64 in zigzag order) and their frame."""

    height: int
    width: int
    sampling: list[tuple[int, int]]
    tables: list[int]
    coefficients: list[np.ndarray]
    quantisation: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


class _Bits:
    """A bit reader; past the end it reads ones."""

    def __init__(self, data: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def bit(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 1

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        v = 0
        for n in range(1, 17):
            v = v << 1 | self.bit()
            if (n, v) in codes:
                return codes[n, v]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    codes, code, k = {}, 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            codes[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def _one_bit(codes: dict[tuple[int, int], int]) -> int | None:
    """The symbol of a table that has a single code of one bit."""
    return codes.get((1, 0)) if len(codes) == 1 else None


def _fixed_scan(blocks: np.ndarray, data: bytes, lo: int, hi: int, high: int, low: int, symbol: int) -> bool:
    """Reads an AC scan of fixed-width entries into blocks (a view); False if it isn't one."""
    flat, width = blocks.shape[0] * blocks.shape[1], hi - lo + 1
    band = blocks[:, :, lo : hi + 1]
    bits = np.frombuffer(data, np.uint8)
    if not high and 0 < symbol < 16:
        size = symbol
        if size == 7:  # an entry is a byte
            if len(bits) < flat * width or (bits[: flat * width] > 127).any():
                return False
            v = bits[: flat * width].astype(np.int16)
        else:
            entry = np.unpackbits(bits)[: flat * width * (1 + size)].reshape(-1, 1 + size)
            if len(entry) != flat * width or entry[:, 0].any():
                return False
            v = (entry[:, 1:] @ (1 << np.arange(size - 1, -1, -1))).astype(np.int16)
        v[v < 1 << (size - 1)] -= (1 << size) - 1
        band[...] = (v << low).reshape(band.shape)
        return True
    if high and symbol == 0 and band.all():
        entry = np.unpackbits(bits)[: flat * (1 + width)].reshape(-1, 1 + width)
        if len(entry) != flat or entry[:, 0].any():
            return False
        band += np.sign(band) * (entry[:, 1:].astype(np.int16) << low).reshape(band.shape)
        return True
    return False


def _ac_scan(order: list[np.ndarray], bits: _Bits, codes: dict, lo: int, hi: int, high: int, low: int) -> None:
    run = 0  # blocks that have ended already
    for block in order:
        k = lo
        if not high:
            while not run and k <= hi:
                zeros, size = divmod(bits.symbol(codes), 16)
                if size:
                    k += zeros
                    block[k] = bits.signed(size) << low
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) + bits.take(zeros)
            run -= run > 0
            continue

        def refine(at: int, block: np.ndarray = block) -> None:
            if bits.bit():
                block[at] += (1 if block[at] > 0 else -1) << low

        while not run and k <= hi:
            zeros, size = divmod(bits.symbol(codes), 16)
            new = 0
            if size:
                new = (1 if bits.bit() else -1) << low
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= hi:
                if block[k]:
                    refine(k)
                elif zeros:
                    zeros -= 1
                else:
                    if new:
                        block[k] = new
                    k += 1
                    break
                k += 1
        if run:
            for at in range(k, hi + 1):
                if block[at]:
                    refine(at)
            run -= 1


def decode(data: bytes) -> Picture:
    """Accumulates all scans into coefficient arrays."""
    at, interval, huffman, quant, pic, ids, comment = 2, 0, {}, {}, None, [], b""
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            ids, sampling = [body[6 + 3 * i] for i in range(n)], [divmod(body[7 + 3 * i], 16) for i in range(n)]
            wide, tall = max(s[0] for s in sampling), max(s[1] for s in sampling)
            cols, rows = -(-width // (8 * wide)), -(-height // (8 * tall))
            pic = Picture(height, width, sampling, [body[8 + 3 * i] for i in range(n)], [np.zeros((rows * v, cols * h, 64), np.int16) for h, v in sampling], quant)
        elif marker == 0xDA and pic is not None:
            end = re.compile(rb"\xff[^\x00\xd0-\xd7]").search(data, at).start()
            parts = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", data[at:end])]
            at = end
            chosen = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            lo, hi, high, low = *body[-3:-1], body[-1] >> 4, body[-1] & 15
            _scan(pic, parts, interval, chosen, huffman, lo, hi, high, low)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("not a progressive JPEG with Huffman codes")
    if pic is None:
        raise ValueError("no frame")
    pic.comment = comment
    return pic


def _scan(pic: Picture, parts: list[bytes], interval: int, chosen: list[tuple[int, int]], huffman: dict, lo: int, hi: int, high: int, low: int) -> None:
    wide, tall = max(s[0] for s in pic.sampling), max(s[1] for s in pic.sampling)
    if len(chosen) == 1:  # only the blocks that the picture needs
        c = chosen[0][0]
        h, v = pic.sampling[c]
        view = pic.coefficients[c][: -(-pic.height * v // (8 * tall)), : -(-pic.width * h // (8 * wide))]
        order = lambda: [[(c, b)] for row in view for b in row]
        if lo and len(parts) == 1:
            symbol = _one_bit(huffman[16 | chosen[0][1] & 15])
            if symbol is not None and _fixed_scan(view, parts[0], lo, hi, high, low, symbol):
                return
    else:
        if not high and len(parts) == 1 and all(_one_bit(huffman[t >> 4]) == 0 for _, t in chosen):
            return  # every difference is 0
        rows, cols = (n // s for n, s in zip(pic.coefficients[0].shape[:2], pic.sampling[0][::-1], strict=True))
        order = lambda: [
            [(c, pic.coefficients[c][y * pic.sampling[c][1] + j, x * pic.sampling[c][0] + i]) for c, _ in chosen for j in range(pic.sampling[c][1]) for i in range(pic.sampling[c][0])]
            for y in range(rows) for x in range(cols)]
    units, table = order(), dict(chosen)
    step = interval or len(units)
    for k, part in enumerate(parts):
        bits, own = _Bits(part), units[k * step : (k + 1) * step]
        if lo:
            _ac_scan([b for u in own for _, b in u], bits, huffman[16 | chosen[0][1] & 15], lo, hi, high, low)
        elif high:
            for u in own:
                for _, b in u:
                    b[0] |= bits.bit() << low
        else:
            last = dict.fromkeys(table, 0)
            for u in own:
                for c, b in u:
                    last[c] += bits.signed(bits.symbol(huffman[table[c] >> 4]))
                    b[0] = last[c] << low


def payload_of(pic: Picture) -> bytes:
    """What encode() stored."""
    flat = np.concatenate([c[:, :, 1:].reshape(-1) for c in pic.coefficients])
    stored = flat[: int(pic.comment)]
    return np.where(stored < 0, stored + 255, stored).astype(np.uint8).tobytes()


def slabs(pic: Picture):
    """The RGB picture from top to bottom, as uint8 arrays (rows, width, 3) of bounded size."""
    wide, tall = max(s[0] for s in pic.sampling), max(s[1] for s in pic.sampling)
    rows = pic.coefficients[0].shape[0] // pic.sampling[0][1]
    cols = pic.coefficients[0].shape[1] // pic.sampling[0][0]
    step = max(1, SLAB // cols)
    for top in range(0, rows, step):
        planes = []
        for (h, v), q, c in zip(pic.sampling, pic.tables, pic.coefficients, strict=True):
            part = c[top * v : (top + step) * v]
            samples = ((part * pic.quantisation[q]).astype(np.float32).reshape(-1, 64) @ _INVERSE).reshape(*part.shape[:2], 8, 8)
            plane = samples.transpose(0, 2, 1, 3).reshape(part.shape[0] * 8, part.shape[1] * 8)
            if v < tall:
                plane = np.repeat(plane, tall // v, axis=0)
            if h < wide:
                plane = np.repeat(plane, wide // h, axis=1)
            planes.append(plane)
        y = planes[0] + np.float32(128.5)
        if len(planes) == 1:
            r = g = b = y
        else:
            _, cb, cr = planes
            r, g, b = y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb
        out = np.empty((*y.shape, 3), np.uint8)
        for k, plane in enumerate((r, g, b)):
            out[..., k] = np.clip(plane, 0, 255, out=plane if plane is not y else None)
        yield out[: max(0, pic.height - top * 8 * tall), : pic.width]


def rgb(pic: Picture) -> np.ndarray:
    """The whole picture at full resolution: (height, width, 3)."""
    return np.concatenate(list(slabs(pic)))
