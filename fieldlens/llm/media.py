"""Media columns: texts kept as greyscale PNG, read back chunk by chunk, and hashed by their low cosine frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import concat_rows

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Samples a pixel by PNG colour type, at 8 bits.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
IDAT_BYTES = 1 << 16


class BadPng(ValueError):
    """A stored image that breaks the format or fails a checksum."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(image: np.ndarray, level: int = 3) -> bytes:
    """8-bit greyscale PNG; each row takes the filter (none, sub, up) of the least sum of absolute differences."""
    height, width = image.shape
    left, above = np.zeros_like(image), np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    above[1:] = image[:-1]
    forms = np.stack([image, image - left, image - above])
    cost = np.minimum(forms, np.uint8(0) - forms).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = forms[best, np.arange(height)]
    packed = zlib.compress(rows.tobytes(), level)
    parts = [packed[i : i + IDAT_BYTES] for i in range(0, len(packed), IDAT_BYTES)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", p) for p in parts) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes the five row filters of PNG: running sums where filters look one way only, else diagonal by diagonal."""
    kind, raw = rows[:, 0], rows[:, 1:]
    if kind.max(initial=0) > 4:
        raise BadPng("unknown row filter")
    height, width = raw.shape
    if kind.max(initial=0) > 2:
        return _by_diagonals(kind, raw.reshape(height, width // bpp, bpp)).reshape(height, width)
    out = raw.copy()
    sub = np.flatnonzero(kind == 1)
    if len(sub):
        out[sub] = np.cumsum(raw[sub].reshape(len(sub), -1, bpp), axis=1, dtype=np.uint8).reshape(len(sub), width)
    rest = np.flatnonzero(kind == 2)
    # runs of consecutive rows with filter `up` are one running sum
    for run in np.split(rest, np.flatnonzero(np.diff(rest) != 1) + 1) if len(rest) else []:
        above = out[run[0] - 1] if run[0] else np.zeros(width, np.uint8)
        out[run] = np.cumsum(np.vstack([above, raw[run]]), axis=0, dtype=np.uint8)[1:]
    return out


def _by_diagonals(kind: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Samples (row, pixel, channel) of any filters: a pixel needs its left, upper and upper left ones, so those of one
    anti-diagonal are worked out together."""
    height, pixels, channels = raw.shape
    out = np.zeros((height + 1, pixels + 1, channels), np.int16)
    for d in range(height + pixels - 1):
        y = np.arange(max(0, d - pixels + 1), min(height, d + 1))
        x = d - y
        a, b, c, k = out[y + 1, x], out[y, x + 1], out[y, x], kind[y][:, None]
        far_a, far_b, far_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((far_a <= far_b) & (far_a <= far_c), a, np.where(far_b <= far_c, b, c))
        out[y + 1, x + 1] = (raw[y, x] + np.select([k == 1, k == 2, k == 3, k == 4], [a, b, (a + b) >> 1, nearest], 0)) & 0xFF
    return out[1:, 1:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """Samples (height, width * channels) of an 8-bit PNG without interlacing; BadPng on any fault."""
    if data[:8] != SIGNATURE:
        raise BadPng("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise BadPng(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise BadPng("a chunk is missing")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or colour not in CHANNELS or interlace:
        raise BadPng("only 8-bit images without interlacing")
    bpp = CHANNELS[colour]
    want = height * (width * bpp + 1)
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), want + 1)
    except zlib.error as e:
        raise BadPng(str(e)) from e
    if len(raw) != want:
        raise BadPng("the samples do not fill the image")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width * bpp + 1), bpp)


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_DCT = _cosines(32, 8)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine frequencies of the 32 x 32 image exceed their median.

    Frequencies are rounded to 1e-6 first, so that those which are nothing but rounding noise are equal.
    """
    height, width = image.shape
    grid = image.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        edges = np.arange(32) * n // 32
        if n >= 32:
            counts = np.diff(np.append(edges, n))
            grid = np.add.reduceat(grid, edges, axis=axis) / (counts[:, None] if axis == 0 else counts[None, :])
        else:
            grid = np.take(grid, edges, axis=axis)
    low = np.round((_DCT @ grid @ _DCT.T).ravel(), 6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text (null: none) and these with zeros up to a positive multiple of the row width."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


MEDIA = "n_bytes long, media binary"
READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dct_hash binary, feature string, fault string"


def _mapped(df: DataFrame, column: str, ddl: str, keep: list[str] | None, row, drop: bool) -> DataFrame:
    new = T.StructType.fromDDL(ddl)
    carried = [c for c in (keep if keep is not None else df.columns) if c.lower() not in {f.name for f in new} and not (drop and c == column)]
    extra = column not in carried
    source = df.select(*(F.col(f"`{c}`") for c in carried), *([F.col(f"`{column}`")] if extra else []))
    types = {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(column)
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                out = [row(v.as_py()) for v in part.column(at)]
                cols = {f.name: pa.array([o[i] for o in out], types[f.dataType.simpleString()]) for i, f in enumerate(new.fields)}
                yield concat_rows(part, [column] if extra else [], cols)

    return source.mapInArrow(apply, T.StructType([source.schema[c] for c in carried] + list(new.fields)))


def _stored(text: str | None) -> tuple[int, bytes]:
    n, payload = payload_of(text)
    return n, encode_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))


def _read(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 7 + ("no media",)
    digest = (len(media), hashlib.sha256(media).hexdigest())
    try:
        image = decode_png(media)
    except BadPng as e:
        return (None, None, None, *digest, None, None, str(e))
    payload = image.tobytes()
    found = cosine_hash(image)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *digest, found, found.hex(), None


def text_to_media(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_bytes and the binary column media: the text's bytes, padded with zeros to rows of 64, as PNG.

    Null is empty; an empty text is one row of zeros. Equal texts give equal media. `keep` names the columns to carry
    (all without it); those that clash with new ones are replaced.
    """
    return _mapped(docs, text, MEDIA, keep, _stored, drop=False)


def media_features(stored: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """stored with what its PNG column holds: payload digests, the cosine hash as binary and hex, and fault.

    Null and broken media (checksum, format, size) give null features and say why in fault; they never fail the job.
    """
    return _mapped(stored, media, READ, keep, _read, drop=False)
