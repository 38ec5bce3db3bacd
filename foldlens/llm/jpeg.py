"""Media columns as baseline JPEG files that hold their payload without loss.

Layout. JPEG's unit is the quantised DCT coefficient, so the payload's bytes are stored
as coefficients: the 63 AC coefficients and the DC coefficient of a block carry 64 bytes
in zigzag order. A byte b stands as the coefficient b if b >= 128, else b - 255; these are
just the 256 values of JPEG's size category 8, whose extra bits are b itself.
Quantisation tables are all ones, so nothing is rounded. The Huffman tables are chosen
for it: AC has the one symbol 0/8 with a 1-bit code; a DC difference of category c has a
code of 10 - c bits. Each block then takes 577 bits, so that a scan can be written as a matrix
of bits. Files are proper baseline JPEG (SOI, COM with the payload's length, DQT,
SOF0, DHT, SOS, EOI).

``read`` parses the markers of any single-component baseline file and Huffman-decodes the
scan. Every symbol is looked up in tables made from the file's DHT segments: one by one, or,
if these tables make all symbols of a kind equally long with their extra bits (as above), so
that it is known where each begins, those of ``SLICE`` blocks at once. The thumbnail is reconstructed from
the DC coefficients alone, one luminance sample for each 8x8 block.

Defined results: a null text is an empty one, whose payload is 192 blanks; equal texts
give equal values, and repeated rows too; an empty table gives an empty one; columns named
like the results are replaced, all others stay. A payload of any length up to 4 GB fits the
format (an image is 24 pixels wide until it would be higher than 65,528, then wider). Blocks
are handled in slices; a text needs about ten times its bytes of memory.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .words import to_bytes

UNIT = 192
MAX_SIDE = 8191  # blocks
AC_BITS, BLOCK_BITS = 9, 10 + 63 * 9
#: Blocks handled at once; a multiple of 8, so that slices end with a byte.
SLICE = 2048


class BadJpeg(ValueError):
    """The bytes are no baseline JPEG of one component."""


def zigzag() -> np.ndarray:
    """natural[k]: the place (row * 8 + column) of the k-th coefficient of a scan."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))))


def canonical(counts: list[int], symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a DHT segment."""
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes


# Category c has a code of 10 - c bits: lengths 1 ... 10 hold the categories 9 ... 0.
_DC_COUNTS, _DC_SYMBOLS = [1] * 10 + [0] * 6, bytes(range(9, -1, -1))
_AC_COUNTS, _AC_SYMBOLS = [1] + [0] * 15, bytes([0x08])


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _shape(blocks: int) -> tuple[int, int]:
    wide = 3
    while -(-blocks // wide) > MAX_SIDE:
        wide *= 2
    return wide, -(-blocks // wide)


def _size(v: np.ndarray) -> np.ndarray:
    """JPEG's category: the number of bits of |v|, for |v| < 1024."""
    return np.ceil(np.log2(np.abs(v) + 1.0)).astype(np.int64)


def write(payload: bytes) -> bytes:
    wide, high = _shape(max(1, -(-len(payload) // 64)))
    raw = np.full(wide * high * 64, 32, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    raw = raw.reshape(-1, 64)
    dc = np.where(raw[:, 0] >= 128, raw[:, 0].astype(np.int64), raw[:, 0].astype(np.int64) - 255)
    diff = np.diff(dc, prepend=0)
    size = _size(diff)
    # The code of category c: 9 - c ones and a zero; then c extra bits.
    word = (((1 << (9 - size)) - 1) << (size + 1)) | np.where(diff >= 0, diff, diff + (1 << size) - 1)
    parts = []
    for at in range(0, len(raw), SLICE):
        own = raw[at : at + SLICE]
        bits = np.zeros((len(own), BLOCK_BITS), np.uint8)
        bits[:, :10] = (word[at : at + SLICE, None] >> np.arange(9, -1, -1)) & 1
        bits[:, 10:].reshape(len(own), 63, AC_BITS)[:, :, 1:] = np.unpackbits(own[:, 1:].reshape(-1)).reshape(len(own), 63, 8)
        flat = bits.reshape(-1)
        parts.append(np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])).tobytes())
    scan = b"".join(parts).replace(b"\xff", b"\xff\x00")
    frame = bytes([8]) + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xFE, len(payload).to_bytes(8, "big")),
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, frame),
            _segment(0xC4, b"\x00" + bytes(_DC_COUNTS) + _DC_SYMBOLS),
            _segment(0xC4, b"\x10" + bytes(_AC_COUNTS) + _AC_SYMBOLS),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
            scan,
            b"\xff\xd9",
        ]
    )


def _parse(data: bytes) -> dict:
    if data[:2] != b"\xff\xd8":
        raise BadJpeg("no SOI")
    found: dict = {"quant": {}, "huffman": {}, "note": b"", "restart": 0}
    at = 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 0xFF:
            raise BadJpeg(f"no marker at {at}")
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        if len(body) != length - 2:
            raise BadJpeg("a segment is cut off")
        at += 2 + length
        if marker == 0xDB:
            while body:
                step = 64 * (1 + (body[0] >> 4))
                table = np.frombuffer(body[1 : 1 + step], ">u2" if body[0] >> 4 else np.uint8)
                found["quant"][body[0] & 15], body = table.astype(np.int64), body[1 + step :]
        elif marker == 0xC0:
            if body[0] != 8 or body[5] != 1:
                raise BadJpeg("only one component of 8 bits is read")
            found |= {"high": int.from_bytes(body[1:3], "big"), "wide": int.from_bytes(body[3:5], "big"), "q": body[8]}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise BadJpeg("not baseline")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                found["huffman"][body[0]], body = (list(body[1:17]), body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xDD:
            found["restart"] = int.from_bytes(body, "big")
        elif marker == 0xFE:
            found["note"] = body
        elif marker == 0xDA:
            if "wide" not in found:
                raise BadJpeg("a scan before its frame")
            end = data.rfind(b"\xff\xd9")
            if end < at:
                raise BadJpeg("no EOI")
            return found | {"scan": data[at:end], "dc": body[2] >> 4, "ac": 0x10 | (body[2] & 15)}


class Lookup:
    """A Huffman table as arrays: the next 16 bits give the code's length (0: none) and symbol."""

    def __init__(self, codes: dict[tuple[int, int], int]):
        self.length, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        for (length, code), symbol in codes.items():
            low = code << (16 - length)
            self.length[low : low + (1 << (16 - length))] = length
            self.symbol[low : low + (1 << (16 - length))] = symbol
        sizes = {length + (symbol & 15) for (length, _), symbol in codes.items()}
        #: Bits of each symbol with its extra bits, if all take as many, else 0; as AC table, if none is a run or an end.
        self.stride = sizes.pop() if len(sizes) == 1 else 0
        self.ac_stride = self.stride if all(0 < symbol < 16 for symbol in codes.values()) else 0


def _decode_equal(scan: bytes, blocks: int, dc: Lookup, ac: Lookup) -> np.ndarray:
    """Coefficients (blocks, 64) in scan order, for tables whose symbols are equally long."""
    raw = scan.replace(b"\xff\x00", b"\xff")
    first, step = dc.stride, ac.ac_stride
    per = first + 63 * step
    if not blocks * per <= 8 * len(raw) < blocks * per + 8:
        raise BadJpeg("the scan's length doesn't fit its blocks")
    data = np.frombuffer(raw + bytes(4), np.uint8)
    out = np.empty((blocks, 64), np.int16)
    within = np.concatenate([[0], first + step * np.arange(63)])

    def peek(at: np.ndarray) -> np.ndarray:
        byte = at >> 3
        word = data[byte].astype(np.uint32) << np.uint32(16) | data[byte + 1].astype(np.uint32) << np.uint32(8) | data[byte + 2]
        return word >> (8 - (at & 7)).astype(np.uint32) & np.uint32(0xFFFF)

    for begin in range(0, blocks, SLICE):
        at = (np.arange(begin, min(begin + SLICE, blocks)) * per)[:, None] + within
        code = peek(at)
        length, size = ac.length[code], ac.symbol[code] & 15
        length[:, 0], size[:, 0] = dc.length[code[:, 0]], dc.symbol[code[:, 0]]
        if not length.all():
            raise BadJpeg("a code that isn't in the table")
        extra = (peek(at + length) >> (16 - size).astype(np.uint32)).astype(np.int32)
        full = np.left_shift(1, size.astype(np.int32))
        out[begin : begin + SLICE] = np.where(2 * extra >= full, extra, extra - full + 1)
    out[:, 0] = np.cumsum(out[:, 0], dtype=np.int64)
    return out


def _decode_any(scan: bytes, blocks: int, dc: dict, ac: dict, restart: int) -> np.ndarray:
    """Coefficients (blocks, 64) in scan order, symbol by symbol."""
    out = np.zeros((blocks, 64), np.int16)
    parts, at = [], 0
    while (cut := next((i for i in range(at, len(scan) - 1) if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7), -1)) >= 0:
        parts.append(scan[at:cut])
        at = cut + 2
    parts.append(scan[at:])
    block = 0
    for part in parts:
        bits = np.unpackbits(np.frombuffer(part.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        pos, last = 0, 0

        def symbol(table):
            nonlocal pos
            code = 0
            for length in range(1, 17):
                if pos >= len(bits):
                    raise BadJpeg("the scan is cut off")
                code, pos = code << 1 | bits[pos], pos + 1
                if (length, code) in table:
                    return table[length, code]
            raise BadJpeg("a code that isn't in the table")

        def extra(n):
            nonlocal pos
            v = 0
            for _ in range(n):
                if pos >= len(bits):
                    raise BadJpeg("the scan is cut off")
                v, pos = v << 1 | bits[pos], pos + 1
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(restart or blocks, blocks - block)):
            last += extra(symbol(dc))
            out[block, 0] = last
            k = 1
            while k < 64:
                run = symbol(ac)
                if run == 0:
                    break
                if run == 0xF0:
                    k += 16
                    continue
                k += run >> 4
                if k > 63:
                    raise BadJpeg("a run beyond the block")
                out[block, k] = extra(run & 15)
                k += 1
            block += 1
    return out


@functools.lru_cache(maxsize=16)
def _lookup(counts: tuple[int, ...], symbols: bytes) -> Lookup:
    return Lookup(canonical(list(counts), symbols))


def read(data: bytes) -> dict:
    """wide, high, coefficients (blocks, 64) in scan order, quant, note."""
    file = _parse(data)
    blocks = -(-file["wide"] // 8) * -(-file["high"] // 8)
    dc, ac = file["huffman"].get(file["dc"]), file["huffman"].get(file["ac"])
    if dc is None or ac is None or file["q"] not in file["quant"]:
        raise BadJpeg("a table is missing")
    tables = _lookup(tuple(dc[0]), dc[1]), _lookup(tuple(ac[0]), ac[1])
    if not file["restart"] and tables[0].stride and tables[1].ac_stride:
        found = _decode_equal(file["scan"], blocks, *tables)
    else:
        found = _decode_any(file["scan"], blocks, canonical(*dc), canonical(*ac), file["restart"])
    return {"wide": file["wide"], "high": file["high"], "coefficients": found, "quant": file["quant"][file["q"]], "note": file["note"]}


def payload_of(image: dict) -> bytes:
    value = image["coefficients"]
    if (np.abs(value) < 128).any() or (np.abs(value) > 255).any():
        raise BadJpeg("coefficients that hold no payload")
    raw = np.where(value > 0, value, value + 255).astype(np.uint8).reshape(-1)
    return raw[: int.from_bytes(image["note"], "big")].tobytes()


def thumbnail(image: dict) -> np.ndarray:
    """One luminance sample (0 to 255) for each block, from its DC coefficient."""
    rows, columns = -(-image["high"] // 8), -(-image["wide"] // 8)
    level = image["coefficients"][:, 0] * image["quant"][0] / 8.0 + 128.0
    return np.clip(np.rint(level), 0, 255).astype(np.uint8).reshape(rows, columns)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """16 hex digits: of an 8x8 mean-pooled thumbnail, which samples exceed their mean."""
    def pooled(a: np.ndarray) -> np.ndarray:
        edge = np.arange(9) * len(a) // 8
        sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
        low, high = edge[:-1], np.maximum(edge[1:], edge[:-1] + 1)
        return (sums[high] - sums[low]) / (high - low)[:, None]

    small = pooled(pooled(thumb.astype(float)).T).T
    return np.packbits(small > small.mean()).tobytes().hex()


def media(text: str | None) -> dict:
    raw = to_bytes(text)
    padded = raw + b" " * (-len(raw) % UNIT if raw else UNIT)
    data = write(padded)
    image = read(data)
    back = payload_of(image)
    return {
        "n_bytes": len(raw),
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-16:]),
        "media_bytes": len(data),
        "media_sha256": hashlib.sha256(data).hexdigest(),
        "width": image["wide"],
        "height": image["high"],
        "thumb_hash": (thumb := thumbnail_hash(thumbnail(image))),
        "feature": f"jpeg:{image['wide']}x{image['high']}:{thumb}",
        "media": data,
    }


_LONGS = ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "width", "height")


def with_media(docs: DataFrame, text_col: str = "text", keep_file: bool = True) -> DataFrame:
    """``docs`` plus the media columns; ``media`` is the JPEG file itself."""
    names = [n for n in media(None) if keep_file or n != "media"]
    kinds = {n: T.LongType() for n in _LONGS} | {"media": T.BinaryType()}
    added = [T.StructField(n, kinds.get(n, T.StringType())) for n in names]
    kept = [f for f in docs.schema.fields if f.name not in names]
    columns = [f.name for f in kept]

    def run(frames):
        for pdf in frames:
            rows = []
            for text in pdf[text_col]:
                row = media(text)
                rows.append([row[n] for n in names])
            new = pd.DataFrame(rows, columns=names, index=pdf.index)
            yield pd.concat([pdf[columns], new], axis=1)

    return docs.mapInPandas(run, T.StructType([*kept, *added]))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_media(docs, keep_file=False).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
