"""Image files as a table: bytes, hashes and pixels, with errors as values.

Spark lists and reads the files (any file system it knows) and splits them over tasks by size;
tasks decode Arrow batches of them. A file that can't be decoded is a row with ``decode_ok``
false and the reason, never a failed task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from .tables import IMAGE_EXTENSIONS, scan_files

_DECODED = "decode_ok boolean, width int, height int, pixel_sha256 string, low long, high long, grayscale_mean double, decode_error string"


def inspect(content: bytes | None) -> tuple:
    """The values of ``_DECODED`` for one file."""
    try:
        rgb = pixels.decode(content or b"")
        grey = pixels.luminance(rgb)
        height, width = grey.shape
        low, high = pixels.halves(pixels.hash_bits(pixels.shrunk(grey)[None]))
        digest = hashlib.sha256(str((width, height)).encode() + rgb.tobytes()).hexdigest()
        return True, width, height, digest, int(low[0]), int(high[0]), float(grey.mean()), None
    except Exception as e:  # whatever a broken file does to a decoder is that file's result
        return False, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
    names = [part.split()[0] for part in _DECODED.split(", ")]
    for batch in batches:
        kept = [n for n in batch.schema.names if n != "content"]
        found = [inspect(c.as_py()) for c in batch.column("content")]  # one file's bytes at a time
        columns = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *columns], [*kept, *names])


def hash_digits(low: Column, high: Column) -> Column:
    """The 64-bit hash as 16 hexadecimal digits."""
    return F.concat(*[F.lower(F.lpad(F.hex(half), 8, "0")) for half in (high, low)])


def read_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """The inventory of image files below ``root``: sample_id (relative path), bytes, sha256, path parts, decode_ok, width, height, pixel_sha256, phash (and its halves low, high), grayscale_mean, decode_error."""
    files = scan_files(spark, root, extensions)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content"]
    rows = files.mapInArrow(_decode, ", ".join([*kept, _DECODED]))
    return rows.withColumn("phash", F.when(F.col("decode_ok"), hash_digits(F.col("low"), F.col("high"))))


def pixel_hashes(rows: DataFrame, square: str, size: int = 32) -> DataFrame:
    """``rows`` with low and high, the perceptual hash of ``square``: size x size luminances, row by row.

    NULL for squares of another size or with NULLs in them.
    """
    values = F.transform(F.col(square), lambda x: x.cast("double"))
    good = (F.size(square) == size * size) & F.forall(square, lambda x: x.isNotNull())
    given = rows.withColumn("__square", F.when(good, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__square")
            known = column.is_valid().to_numpy(zero_copy_only=False)
            squares = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size)
            out = []
            for half in pixels.halves(pixels.hash_bits(squares)) if len(squares) else (np.zeros(0, np.int64),) * 2:
                full = np.zeros(len(known), np.int64)
                full[known] = half
                out.append(pa.array(full, mask=~known))
            kept = [n for n in batch.schema.names if n != "__square"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *out], [*kept, "low", "high"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["low long", "high long"])
    return given.mapInArrow(run, schema)
