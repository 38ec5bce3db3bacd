"""Image files: decoders against pictures made here, errors as values, hashes by definition."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlens import runs
from foldlens.functions import pixels
from foldlens.sources import images, sinks, tables


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(samples, colour, depth=8, filters=(0,), palette=None, interlaced=False):
    """A PNG of (h, w, n) samples, its rows filtered in turn by ``filters``."""
    h, w, n = samples.shape
    step, raw = max(1, n * depth // 8), b""
    for x, y, dx, dy in pixels.PASSES if interlaced else ((0, 0, 1, 1),):
        part = samples[y::dy, x::dx]
        if not part.size:
            continue
        above = None
        for i, row in enumerate(part):
            if depth == 16:
                line = row.astype(">u2").tobytes()
            elif depth == 8:
                line = row.astype(np.uint8).tobytes()
            else:
                bits = "".join(format(int(v), f"0{depth}b") for v in row.ravel())
                line = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
            kind = filters[i % len(filters)]
            up = above or bytes(len(line))
            out = []
            for k, v in enumerate(line):
                a, b, c = line[k - step] if k >= step else 0, up[k], up[k - step] if k >= step else 0
                near = min((abs(a + b - c - a), 0, a), (abs(a + b - c - b), 1, b), (abs(a + b - c - c), 2, c))[2]
                out.append((v - (0, a, b, (a + b) // 2, near)[kind]) & 255)
            raw += bytes([kind, *out])
            above = line
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))
    middle = chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + middle + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


RNG = np.random.default_rng(5)


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("colour", "samples"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_of_all_filters(colour, samples, interlaced):
    data = RNG.integers(0, 256, (13, 11, samples))
    got = pixels.decode(png(data, colour, filters=(4, 3, 1, 2, 0), interlaced=interlaced))
    assert (got == (data[:, :, :3] if samples > 2 else np.repeat(data[:, :, :1], 3, axis=2))).all()


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_png_of_palettes_and_low_depths(depth):
    data = RNG.integers(0, 1 << depth, (7, 13, 1))
    palette = RNG.integers(0, 256, (1 << depth, 3))
    assert (pixels.decode(png(data, 3, depth, palette=palette)) == palette[data[:, :, 0]]).all()
    grey = pixels.decode(png(data, 0, depth))
    assert (grey[:, :, 0] == data[:, :, 0] * (255 // ((1 << depth) - 1))).all()
    deep = RNG.integers(0, 65536, (5, 4, 3))
    assert (pixels.decode(png(deep, 2, 16)) == deep >> 8).all()


def jpeg(planes, sampling, restart=0):
    """A baseline JPEG of level-shifted planes, with one quantisation step of 1 and simple code tables."""
    order = pixels._diagonals()
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    height, width = planes[0].shape
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    m, blocks = pixels.cosines(8), []
    for plane, (h, v) in zip(planes, sampling, strict=True):
        small = plane[:: vmax // v, :: hmax // h]
        full = np.pad(small, ((0, down * v * 8 - small.shape[0]), (0, across * h * 8 - small.shape[1])), mode="edge").astype(float) - 128
        cut = full.reshape(down * v, 8, across * h, 8).transpose(0, 2, 1, 3)
        blocks.append(np.rint(np.einsum("ux,rcxy,vy->rcuv", m, cut, m)).astype(int).reshape(down * v, across * h, 64)[:, :, order])
    # sizes 0 ... 11 as codes of 4 bits; all (run, size) as codes of 8 bits: 0xFF stays unused
    dc_counts, dc_symbols = bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12))
    symbols = bytes([r << 4 | s for r in range(16) for s in range(11) if s or r in (0, 15)])
    ac_counts = bytes([0] * 7 + [len(symbols)] + [0] * 8)
    bits, out, last = "", b"", [0] * len(planes)

    def number(value):
        size = abs(value).bit_length()
        return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""

    def flush():
        nonlocal bits, out
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            last = [0] * len(planes)
        for c, (h, v) in enumerate(sampling):
            for y in range(v):
                for x in range(h):
                    block = blocks[c][unit // across * v + y, unit % across * h + x].tolist()
                    size, text = number(block[0] - last[c])
                    last[c] = block[0]
                    bits += format(size, "04b") + text
                    run = 0
                    ends = max([k for k in range(1, 64) if block[k]], default=0)
                    for k in range(1, ends + 1):
                        if not block[k]:
                            run += 1
                            continue
                        while run > 15:
                            bits += format(symbols.index(0xF0), "08b")
                            run -= 16
                        size, text = number(block[k])
                        bits += format(symbols.index(run << 4 | size), "08b") + text
                        run = 0
                    if ends < 63:
                        bits += format(symbols.index(0), "08b")
    flush()
    segment = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    parts = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    head = segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + parts)
    codes = segment(0xC4, b"\x00" + dc_counts + dc_symbols) + segment(0xC4, b"\x10" + ac_counts + symbols)
    scan = segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0\x3f\0")
    return b"\xff\xd8" + head + codes + (segment(0xDD, struct.pack(">H", restart)) if restart else b"") + scan + out + b"\xff\xd9"


def smooth(h, w, seed):
    y, x = np.mgrid[:h, :w]
    return np.clip(128 + 90 * np.sin(x / 9 + seed) * np.cos(y / 7 + seed), 0, 255).round()


@pytest.mark.parametrize(("sampling", "restart"), [([(1, 1)], 0), ([(1, 1)] * 3, 0), ([(1, 1)] * 3, 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_jpeg_of_all_samplings(sampling, restart):
    planes = [smooth(37, 51, s) for s in range(len(sampling))]
    got = pixels.decode(jpeg(planes, sampling, restart)).astype(float)
    if len(planes) == 1:
        assert abs(got[:, :, 0] - planes[0]).max() <= 2
        return
    hmax, vmax = sampling[0]
    chroma = [np.repeat(np.repeat(p[::vmax, ::hmax], vmax, 0), hmax, 1)[:37, :51] - 128 for p in planes[1:]]
    want = np.stack([planes[0] + 1.402 * chroma[1], planes[0] - 0.344136 * chroma[0] - 0.714136 * chroma[1], planes[0] + 1.772 * chroma[0]], axis=2)
    assert abs(got - np.clip(want, 0, 255)).max() <= 5


def test_hash_is_the_double_sum():
    squares = RNG.integers(0, 256, (6, 32, 32)).astype(float)
    for square, bits in zip(squares, pixels.hash_bits(squares), strict=True):
        scale = lambda k: math.sqrt((1 if k == 0 else 2) / 32)
        low = [
            scale(u) * scale(v) * sum(square[y, x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32))
            for u in range(8)
            for v in range(8)
        ]
        assert bits.tolist() == [f > sorted(low[1:])[31] for f in low]
    assert not pixels.hash_bits(np.full((1, 32, 32), 77.0))[0, 1:].any()


@pytest.fixture
def folder(tmp_path):
    red = np.zeros((40, 30, 3), int)
    red[:, :15, 0] = 200
    good = png(red, 2)
    files = {
        "Train/a/1.PNG": good, "Train/a/2.png": good, "Test/b/3.jpg": jpeg([smooth(64, 64, 1)], [(1, 1)]), "Test/b/4.png": jpeg([smooth(64, 64, 1)], [(1, 1)]),
        "b/5.png": good[: len(good) // 2], "6.jpg": b"", "Val/a/7.jpg": b"not an image", "Val/a/8.png": good[:-30] + bytes(8) + good[-22:], "x/notes.txt": b"text",
        "Val/a/9.tif": b"II*\0", "Test/b/10.jpg": jpeg([smooth(64, 64, 1)], [(1, 1)])[:-200],
    }
    for name, data in files.items():
        path = tmp_path / "images" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "images"), files


def test_inventory_captures_errors(spark, folder):
    root, files = folder
    got = {r["sample_id"]: r for r in images.read_images(spark, root).collect()}
    assert set(got) == {n for n in files if not n.endswith(".txt")}
    assert {n for n, r in got.items() if r["decode_ok"]} == {"Train/a/1.PNG", "Train/a/2.png", "Test/b/3.jpg", "Test/b/4.png"}
    one = got["Train/a/1.PNG"]
    assert (one["width"], one["height"], one["bytes"], one["archive_split"], one["archive_label"]) == (30, 40, len(files["Train/a/1.PNG"]), "Train", "a")
    assert one["sha256"] == hashlib.sha256(files["Train/a/1.PNG"]).hexdigest() and one["pixel_sha256"] == got["Train/a/2.png"]["pixel_sha256"]
    assert abs(one["grayscale_mean"] - 30) < 0.1 and len(one["phash"]) == 16  # half of the pixels at 200 * 0.299
    assert (got["b/5.png"]["archive_split"], got["b/5.png"]["archive_label"], got["6.jpg"]["archive_label"]) == ("unknown", "b", "unknown")
    errors = {n: r["decode_error"] for n, r in got.items() if not r["decode_ok"]}
    assert errors["b/5.png"] == "ValueError: image file is truncated" and errors["6.jpg"] == "ValueError: cannot identify image file"
    assert all(e and ": " in e for e in errors.values()) and all(got[n]["phash"] is None for n in errors)


def test_audit_from_a_folder(spark, folder):
    root, _ = folder
    meta = spark.createDataFrame([("data/Train/a/1.PNG", "a", "30", "Man", "White"), ("data/Test/b/3.jpg", "b", "70", "Woman", "Asian")], tables.METADATA.replace("split string, ", ""))
    routes = spark.createDataFrame([("Train/a/1.PNG", "clinic")], "sample_id string, annotation_route string")
    out = runs.audit_folder(spark, root, meta, strip_prefix="data/", routes=routes, distance=6)
    audited = {r["sample_id"]: r for r in out["audit_metadata"].collect()}
    assert audited["Train/a/1.PNG"]["annotation_route"] == "clinic" and audited["Train/a/1.PNG"]["width"] == 30
    pairs = {(r["id_a"], r["id_b"]): r for r in out["duplicate_candidates"].collect()}
    assert pairs["Train/a/1.PNG", "Train/a/2.png"]["verified_related"] == "yes" and pairs["Train/a/1.PNG", "Train/a/2.png"]["split_a"] == "Train"
    assert pairs["Test/b/3.jpg", "Test/b/4.png"]["metadata_label_a"] == "b" and pairs["Test/b/3.jpg", "Test/b/4.png"]["metadata_label_b"] is None
    stages = {r["stage"]: r["n"] for r in out["image_accounting"].collect()}
    assert stages == {"original image files": 10, "decode success": 4, "decode failures (not automatically excluded)": 6}
    flat = runs.audit_folder(spark, root, meta.withColumn("filepath", F.element_at(F.split("filepath", "/"), -1)), flat_images=True)
    assert sorted(r[0] for r in flat["audit_metadata"].select("sample_id").collect()) == ["Test/b/3.jpg", "Train/a/1.PNG"]
    with pytest.raises(Exception, match="routes"):
        runs.audit_folder(spark, root, meta, strip_prefix="data/", routes=spark.createDataFrame([("gone", "x")], "sample_id string, annotation_route string"))


def test_no_nan_is_written_at_any_depth(spark, tmp_path):
    df = spark.sql("SELECT array(1D, double('NaN')) AS a, named_struct('x', double('inf'), 's', 'NaN') AS b, map('k', array(named_struct('y', float('NaN')))) AS c, double('NaN') AS d, 1 AS e, cast(NULL AS struct<x:double>) AS f")
    sinks.write_new_json(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":[1.0,null],"b":{"x":null,"s":"NaN"},"c":{"k":[{"y":null}]},"d":null,"e":1,"f":null}'
