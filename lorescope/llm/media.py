"""Media columns: Netpbm and BMP bytes as numpy arrays, area-resized tiles in NPY form, difference hashes.

Cases: bytes that are NULL or no image of these formats give NULL features; a text that is NULL counts as empty
and is stored as one padded block; very long texts are tall images; repeated rows are images each; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescope.llm.common import frugal, narrowed, texts_of
from lorescope.llm.registry import documents, query

BLOCK = 576  # bytes of 24 x 24 grey or 24 x 8 coloured pixels
WIDTH = 24
TILE = 16

_HEAD = re.compile(rb"(P[2356])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def netpbm(pixels: np.ndarray) -> bytes:
    """P5 for height x width, P6 for height x width x 3."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit bitmap of height x width x 3, lowest row first, rows padded to four bytes."""
    height, width, _ = pixels.shape
    row = -(-width * 3 // 4) * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0)
    return head + body.tobytes()


def decoded(data: bytes | None) -> np.ndarray | None:
    """Pixels as uint8, height x width (x 3); None if the bytes are no Netpbm or plain BMP image of 8-bit samples."""
    if not data:
        return None
    if data[:2] == b"BM":
        return _bmp_pixels(data)
    head = _HEAD.match(data)
    if head is None or not 0 < int(head[4]) <= 255:
        return None
    kind, width, height, top = head[1], int(head[2]), int(head[3]), int(head[4])
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8, offset=head.end())[:n]
    else:
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[head.end() :]).split()[:n], np.int64).astype(np.uint8)
    if n == 0 or len(flat) < n:
        return None
    if top != 255:
        flat = (flat.astype(np.float64) * 255 / top).round().clip(0, 255).astype(np.uint8)
    return flat.reshape((height, width) if channels == 1 else (height, width, 3))


def _bmp_pixels(data: bytes) -> np.ndarray | None:
    if len(data) < 54:
        return None
    start, size, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    rows = abs(height)
    if packing or bits not in (8, 24, 32) or width <= 0 or not rows:
        return None
    row = -(-width * bits // 32) * 4
    if len(data) < start + row * rows:
        return None
    body = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)[:: -1 if height > 0 else 1, : width * bits // 8]
    if bits == 8:
        palette = np.zeros((256, 4), np.uint8)
        entries = np.frombuffer(data[14 + size : start], np.uint8)
        palette.reshape(-1)[: min(1024, len(entries))] = entries[:1024]
        return palette[body][:, :, 2::-1]
    return body.reshape(rows, width, bits // 8)[:, :, 2::-1]


def area_resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each cell of a height x width grid, exact for fractions of pixels.

    The integral image is needed only where cells begin and end: sums up to the pixel before an edge and a share of
    the one it cuts, along rows and then columns. No copy of the pixels is made.
    """

    def integral(values: np.ndarray, cells: int) -> np.ndarray:
        n = values.shape[0]
        edge = np.arange(cells + 1) * n / cells
        low = np.minimum(edge.astype(np.int64), n - 1)
        part = (edge - low).reshape(-1, *[1] * (values.ndim - 1))
        total = np.zeros((cells + 1, *values.shape[1:]))
        for i in range(cells):
            np.add.reduce(values[low[i] : low[i + 1]], axis=0, dtype=np.float64, out=total[i + 1])
        return np.diff(np.cumsum(total, axis=0) + part * values[low], axis=0) * cells / n

    return integral(integral(pixels, height).swapaxes(0, 1), width).swapaxes(0, 1)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, as hexadecimal digits: whether each of 8 x 8 cells is darker than its right neighbour."""
    cells = area_resized(pixels, 8, 9)
    if cells.ndim == 3:  # grey of the means is the mean of the grey
        cells = cells @ np.array([0.299, 0.587, 0.114])
    cells = np.round(cells, 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to side x side, as an NPY file of uint8."""
    out = io.BytesIO()
    np.save(out, np.clip(np.round(area_resized(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def stored(payload: bytes) -> bytes:
    """A padded payload as an image: blocks modulo three choose a grey map, a colour map or a bitmap."""
    samples = np.frombuffer(payload, np.uint8)
    which = len(samples) // BLOCK % 3
    if which == 1:
        return netpbm(samples.reshape(-1, WIDTH))
    pixels = samples.reshape(-1, WIDTH, 3)
    return netpbm(pixels) if which == 0 else bmp(pixels)


def texts_as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every text: its UTF-8 bytes, padded by 255 to full blocks, as an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, raw, at in texts_of(batch.column(1)):
                data, sizes = raw.tobytes(), np.diff(at)
                media = []
                for a, n in zip(at[:-1].tolist(), sizes.tolist()):
                    full = max(1, -(-n // BLOCK)) * BLOCK
                    media.append(stored(data[a : a + n].ljust(full, b"\xff")))
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return narrowed(docs, ["doc_id", "text"]).mapInArrow(frugal(run), "doc_id bigint, n_bytes bigint, media binary")


FEATURES = (
    "width int, height int, channels int, samples bigint, samples_sha256 string, tail binary, "
    "media_bytes bigint, media_sha256 string, dhash string, tile binary"
)


def media_features(rows: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """The columns ``keep`` and, from the image in ``media``: its shape, digests of its samples, its last 32
    samples, size and digest of the bytes, the difference hash and a small tile as NPY bytes."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, *[x.split()[0] for x in FEATURES.split(", ")]]

    def of(data: bytes | None) -> tuple:
        pixels = decoded(data)
        if pixels is None:
            return (None,) * 6 + ((None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())) + (None, None)
        samples = pixels.tobytes()
        channels = 1 if pixels.ndim == 2 else pixels.shape[2]
        return (
            pixels.shape[1], pixels.shape[0], channels, len(samples), hashlib.sha256(samples).hexdigest(), samples[-32:],
            len(data), hashlib.sha256(data).hexdigest(), difference_hash(pixels), npy_tile(pixels),
        )

    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [of(x.as_py()) for x in batch.column(len(keep))]
            arrays = [pa.array(list(column), kind) for column, kind in zip(zip(*own), types)] if own else [pa.array([], kind) for kind in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names)

    return narrowed(rows, [*keep, media]).mapInArrow(frugal(run), f"{schema}, {FEATURES}")


@query("op8_media")
def op8(spark, folder):
    found = media_features(texts_as_media(documents(spark, folder)), ["doc_id", "n_bytes"])
    return found.select(
        "doc_id", "n_bytes", F.col("samples").alias("payload_bytes"), F.col("samples_sha256").alias("payload_sha256"),
        F.crc32("tail").alias("tail_crc32"), "media_bytes", "media_sha256",
        F.concat_ws(":", "dhash", F.lower(F.hex(F.crc32("tile")))).alias("feature"),
    )
