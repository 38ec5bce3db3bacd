"""Pixels of image files and the perceptual hash, in numpy: the small part of a scan that no Spark expression has.

PNG (all colour types and depths, interlaced or not) and baseline JPEG become RGB arrays;
anything else, and any damage, is a ``ValueError``. Chroma of JPEG is repeated, not
interpolated, so pixels of subsampled files may differ a little from other decoders'.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Larger pictures are refused: a few bytes may claim any size.
MAX_PIXELS = 178_956_970
#: First pixel and step of the seven passes of an interlaced PNG (x, y, dx, dy).
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Samples of a pixel by PNG colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Weights of red, green and blue in luminance, in 65,536ths.
LUMINANCE = np.array([19595, 38470, 7471], np.int64)


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) RGB of a PNG or baseline JPEG file, told apart by content, not by name."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if data[:2] == b"\xff\xd8":
        return decode_jpeg(data)
    raise ValueError("cannot identify image file")


def _sized(width: int, height: int) -> None:
    if not (0 < width and 0 < height and width * height <= MAX_PIXELS):
        raise ValueError(f"bad image size {width} x {height}")


def _unfiltered(raw: memoryview, width_bytes: int, rows: int, step: int) -> np.ndarray:
    """Undo the row filters of one pass: none, left, above, their mean, or the nearest of three."""
    out = np.zeros((rows + 1, width_bytes + step), np.uint8)  # with a row above and a pixel to the left
    for y in range(rows):
        at = y * (width_bytes + 1)
        kind, line = raw[at], np.frombuffer(raw[at + 1 : at + 1 + width_bytes], np.uint8)
        above = out[y, step:]
        if kind == 0:
            out[y + 1, step:] = line
        elif kind == 1:
            padded = np.zeros(-(-width_bytes // step) * step, np.uint8)
            padded[:width_bytes] = line
            out[y + 1, step:] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width_bytes]
        elif kind == 2:
            out[y + 1, step:] = line + above
        elif kind in (3, 4):
            row, up = [0] * step + line.tolist(), out[y].tolist()
            for x in range(step, len(row)):
                a, b, c = row[x - step], up[x], up[x - step]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                row[x] = (row[x] + guess) & 255
            out[y + 1] = row
        else:
            raise ValueError(f"unknown PNG filter {kind}")
    return out[1:, step:]


def decode_png(data: bytes) -> np.ndarray:
    at, header, palette, packed = 8, None, None, []
    while True:
        if at + 12 > len(data):
            raise ValueError("image file is truncated")
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise ValueError("image file is truncated")
        if zlib.crc32(name + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"broken PNG chunk {name!r}")
        at += 12 + size
        if name == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
    if header is None or header[3] not in SAMPLES or header[2] not in (1, 2, 4, 8, 16) or header[6] > 1:
        raise ValueError("broken PNG header")
    width, height, depth, colour, _, _, interlaced = header
    _sized(width, height)
    samples = SAMPLES[colour]
    parts = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in (PASSES if interlaced else ((0, 0, 1, 1),))]
    parts = [p for p in parts if p[4] > 0 and p[5] > 0]
    lengths = [(-(-w * samples * depth // 8), h) for *_, w, h in parts]
    expected = sum((b + 1) * h for b, h in lengths)
    raw = memoryview(zlib.decompressobj().decompress(b"".join(packed), expected))
    if len(raw) < expected:
        raise ValueError("image file is truncated")
    grid, at = np.zeros((height, width, samples), np.uint8), 0
    for (x, y, dx, dy, w, h), (row_bytes, _) in zip(parts, lengths, strict=True):
        rows = _unfiltered(raw[at : at + (row_bytes + 1) * h], row_bytes, h, max(1, samples * depth // 8))
        at += (row_bytes + 1) * h
        if depth == 16:
            rows = rows[:, ::2]
        elif depth < 8:
            rows = np.unpackbits(rows, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
            rows = rows if colour == 3 else rows * (255 // ((1 << depth) - 1))
        grid[y::dy, x::dx] = rows[:, : w * samples].reshape(h, w, samples)
    if colour == 3:
        if palette is None or grid.max() >= len(palette):
            raise ValueError("broken PNG palette")
        return palette[grid[:, :, 0]]
    return np.repeat(grid[:, :, :1], 3, axis=2) if colour in (0, 4) else grid[:, :, :3]


def cosines(n: int) -> np.ndarray:
    """The orthonormal DCT-II of n values as a matrix."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def _diagonals() -> np.ndarray:
    """Places of the 64 coefficients of a block in the order of a scan: along the diagonals, by turns."""
    cells = [(x, y) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (sum(c), c[1] if sum(c) % 2 else c[0]))
    return np.array([8 * y + x for x, y in cells])


class _Bits:
    """Bits of one entropy-coded stretch, without stuffed zeros."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.at = self.held = self.n = 0

    def need(self, n: int) -> None:
        while self.n < n:
            more = self.data[self.at : self.at + 8]
            if not more and self.at > len(self.data) + 16:
                raise ValueError("image file is truncated")
            self.at += 8
            self.held = ((self.held & ((1 << self.n) - 1)) << 64) | int.from_bytes(more.ljust(8, b"\xff"), "big")
            self.n += 64

    def symbol(self, table: list[int]) -> int:
        self.need(16)
        found = table[(self.held >> (self.n - 16)) & 0xFFFF]
        if found < 0:
            raise ValueError("broken JPEG data")
        self.n -= found >> 8
        return found & 255

    def value(self, size: int) -> int:
        """A signed number of ``size`` bits."""
        if not size:
            return 0
        self.need(size)
        self.n -= size
        v = (self.held >> self.n) & ((1 << size) - 1)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _code_table(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits the symbol that they begin with and its length; -1 for none."""
    table, code, k = [-1] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            span = 1 << (16 - length)
            if code + span > 65536 or k >= len(symbols):
                raise ValueError("broken JPEG code table")
            table[code : code + span] = [(length << 8) | symbols[k]] * span
            code, k = code + span, k + 1
    return table


def decode_jpeg(data: bytes) -> np.ndarray:
    at, tables, codes, frame, restart, adobe, coefficients = 2, {}, {}, None, 0, None, {}
    while True:
        if at + 4 > len(data):
            raise ValueError("image file is truncated")
        if data[at] != 0xFF:
            raise ValueError("broken JPEG marker")
        kind = data[at + 1]
        if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD7:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if len(body) < size - 2:
            raise ValueError("image file is truncated")
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                tables[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _code_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            _sized(width, height)
            frame = (width, height, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)})
            if depth != 8 or n not in (1, 3):
                raise ValueError("unsupported JPEG samples")
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("unsupported JPEG process")
        elif kind == 0xDA:
            if frame is None:
                raise ValueError("broken JPEG: a scan before its frame")
            end = at
            while True:  # to the next marker that isn't a restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("image file is truncated")
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            _scan(data[at:end], body, frame, codes, restart, coefficients)
            at = end
            if len(coefficients) == len(frame[2]):
                break
    if frame is None or len(coefficients) < len(frame[2]):
        raise ValueError("image file is truncated")
    return _picture(frame, coefficients, tables, adobe)


def _scan(data: bytes, head: bytes, frame: tuple, codes: dict, restart: int, out: dict) -> None:
    width, height, parts = frame
    hmax, vmax = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    own = [(head[1 + 2 * i], head[2 + 2 * i] >> 4, 16 + (head[2 + 2 * i] & 15)) for i in range(head[0])]
    if len(own) == 1:  # one component: its own blocks in rows
        h, v, _ = parts[own[0][0]]
        across, down = -(--(-width * h // hmax) // 8), -(--(-height * v // vmax) // 8)
        shape = {own[0][0]: (1, 1)}
    else:
        across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        shape = {c: parts[c][:2] for c, _, _ in own}
    for c, _, _ in own:
        full = (-(-height // (8 * vmax)) * parts[c][1], -(-width // (8 * hmax)) * parts[c][0])
        out[c] = np.zeros((*full, 64), np.int32)
    stretches, begin, find = [], 0, 0
    while (find := data.find(b"\xff", find)) >= 0:
        if find + 1 < len(data) and data[find + 1]:
            stretches.append(data[begin:find])
            begin = find + 2
        find += 2
    stretches.append(data[begin:])
    order, last, bits = _diagonals().tolist(), {}, None
    for unit in range(across * down):
        if bits is None or (restart and unit % restart == 0):
            number = unit // restart if restart else 0
            if number >= len(stretches):
                raise ValueError("image file is truncated")
            bits, last = _Bits(stretches[number]), dict.fromkeys(out, 0)
        row, column = divmod(unit, across)
        for c, dc, ac in own:
            if dc not in codes or ac not in codes:
                raise ValueError("broken JPEG: a code table is missing")
            wide, high = shape[c]
            for v in range(high):
                for h in range(wide):
                    block = out[c][row * high + v, column * wide + h]
                    last[c] += bits.value(bits.symbol(codes[dc]))
                    block[0] = last[c]
                    k = 1
                    while k < 64:
                        symbol = bits.symbol(codes[ac])
                        run, size = symbol >> 4, symbol & 15
                        if not size:
                            if run < 15:
                                break
                            k += 16
                            continue
                        k += run
                        if k > 63:
                            raise ValueError("broken JPEG data")
                        block[order[k]] = bits.value(size)
                        k += 1


def _picture(frame: tuple, coefficients: dict, tables: dict, adobe: int | None) -> np.ndarray:
    width, height, parts = frame
    hmax, vmax = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    m, order, planes = cosines(8), _diagonals(), []
    for c, (h, v, q) in parts.items():
        if q not in tables:
            raise ValueError("broken JPEG: a quantisation table is missing")
        scale = np.zeros(64)
        scale[order] = tables[q]
        rows, columns = coefficients[c].shape[:2]
        blocks = (coefficients[c] * scale).reshape(rows, columns, 8, 8)
        plane = np.einsum("ux,rcuv,vy->rxcy", m, blocks, m, optimize=True).reshape(rows * 8, columns * 8) + 128
        planes.append(np.repeat(np.repeat(plane, vmax // v, axis=0), hmax // h, axis=1)[:height, :width])
    if len(planes) == 1:
        return np.repeat(np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)
    y, b, r = np.clip(np.rint(planes[0]), 0, 255), planes[1] - 128, planes[2] - 128
    if adobe == 0:
        rgb = np.stack(planes, axis=2)
    else:
        rgb = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def luminance(rgb: np.ndarray) -> np.ndarray:
    return ((rgb.astype(np.int64) @ LUMINANCE + 32768) >> 16).astype(np.uint8)


def resampling(old: int, new: int, lobes: int = 3) -> np.ndarray:
    """(new, old) weights of a windowed-sinc (Lanczos) resize; the window widens as pictures shrink."""
    scale = old / new
    wide = max(scale, 1.0)
    middle = (np.arange(new)[:, None] + 0.5) * scale
    x = (np.arange(old)[None, :] + 0.5 - middle) / wide
    weight = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return weight / weight.sum(1, keepdims=True)


def shrunk(grey: np.ndarray, size: int = 32) -> np.ndarray:
    """A square of ``size`` by ``size``, rows first, rounded to whole values after each direction."""
    whole = lambda a: np.clip(np.floor(a + 0.5), 0, 255)
    across = whole(grey.astype(np.float64) @ resampling(grey.shape[1], size).T)
    return whole(resampling(grey.shape[0], size) @ across)


def hash_bits(squares: np.ndarray) -> np.ndarray:
    """(n, 64) bits of n squares: which of the 8 x 8 lowest frequencies exceed the median of the 63 that aren't constant.

    Two products with a cosine matrix for the whole batch. Frequencies are rounded to six
    decimals, so that a flat picture has no bits rather than those of rounding errors.
    """
    low = cosines(squares.shape[-1])[:8]
    found = np.round(np.einsum("ux,nxy,vy->nuv", low, squares, low, optimize=True).reshape(-1, 64), 6) + 0.0
    return found > np.median(found[:, 1:], axis=1, keepdims=True)


def halves(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) numbers of 32 bits each; bit i is worth 2^i."""
    worth = np.int64(1) << np.arange(32, dtype=np.int64)
    return bits[:, :32] @ worth, bits[:, 32:] @ worth
