"""Image kernels over decoded pixels: border crop, perceptual hashes, colour histogram, tone.

Pixels come as rows of blue, green, red bytes (the order of Spark's image
source). Kernels take one image or a stack of equal size, so that a batch is a
few array operations; the Arrow functions at the end group what a batch holds
by size. Resampling and transforms follow their public definitions; equality
with any library in the last bit isn't claimed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.package import ship

DARK, BORDER, SIDE, FLAT, SMALLEST = 20, 0.85, 256, 30.0, 10
PIECE = 64 << 20  # bytes of pixels that are worked on at once
NORMAL = 4 * 3 * SIDE * SIDE * 8  # bytes that normalizing an image takes, however small it is: colours as doubles, and copies


def to_rgb(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[:, :, 2::-1]


def grey(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.int32) for k in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 0x8000 >> 16).astype(np.uint8)


def letterbox(rgb: np.ndarray) -> tuple[int, int, int, int]:
    """top, bottom, left, right of one image without borders in which nearly all pixels are dark."""
    dark = grey(rgb) < DARK
    rows, cols = np.flatnonzero(dark.mean(1) < BORDER), np.flatnonzero(dark.mean(0) < BORDER)
    if not len(rows) or not len(cols):
        return 0, rgb.shape[0], 0, rgb.shape[1]
    return int(rows[0]), int(rows[-1]) + 1, int(cols[0]), int(cols[-1]) + 1


@lru_cache(64)
def _weights(n: int, m: int) -> np.ndarray:
    """m x n matrix of a three-lobed Lanczos kernel, widened when shrinking."""
    scale = n / m
    wide = max(scale, 1.0)
    at = ((np.arange(m) + 0.5) * scale)[:, None]
    x = (np.arange(n)[None, :] + 0.5 - at) / wide
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(grey_image: np.ndarray, height: int, width: int) -> np.ndarray:
    """(..., h, w) to (..., height, width)."""
    out = _weights(grey_image.shape[-2], height) @ grey_image.astype(np.float64) @ _weights(grey_image.shape[-1], width).T
    return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)


def normalize(rgb: np.ndarray) -> np.ndarray:
    """Grey 256 x 256 images without borders; an image that would lose nearly everything stays whole."""
    if rgb.ndim == 3:
        return normalize(rgb[None])[0]
    out = np.empty((len(rgb), SIDE, SIDE), np.uint8)
    boxes: dict[tuple, list[int]] = {}
    for i, image in enumerate(rgb):
        t, b, left, right = letterbox(image)
        boxes.setdefault((t, b, left, right) if b - t >= SMALLEST and right - left >= SMALLEST else (0, rgb.shape[1], 0, rgb.shape[2]), []).append(i)
    for (t, b, left, right), which in boxes.items():
        cut = np.moveaxis(rgb[which, t:b, left:right], -1, 1)  # colours apart, then as the resampling of colour images does
        out[which] = grey(np.moveaxis(resize(cut, SIDE, SIDE), 1, -1))
    return out


def _shares(values: np.ndarray, bins: int) -> np.ndarray:
    """Share of each of ``bins`` values in each row."""
    n, size = values.shape
    counts = np.bincount((values + bins * np.arange(n)[:, None]).ravel(), minlength=n * bins)
    return counts.reshape(n, bins) / max(size, 1)


def quality(image: np.ndarray) -> np.ndarray:
    """Geometric mean of entropy and variance, each as a share of its bound."""
    if image.ndim == 2:
        return quality(image[None])[0]
    flat = image.reshape(len(image), -1)
    p = _shares(flat.astype(np.int64), 256)
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    return np.sqrt(np.minimum(1.0, entropy / 8) * np.minimum(1.0, flat.astype(float).var(1) / 1e4))


def _dct(a: np.ndarray) -> np.ndarray:
    n = a.shape[-1]
    c = np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))
    return 4 * c @ a @ c.T


def _haar(a: np.ndarray, size: int) -> np.ndarray:
    while a.shape[-1] > size:
        a = (a[..., ::2, ::2] + a[..., 1::2, ::2] + a[..., ::2, 1::2] + a[..., 1::2, 1::2]) / 4
    return a


def phash(image: np.ndarray, size: int) -> np.ndarray:
    low = _dct(resize(image, 4 * size, 4 * size).astype(float))[..., :size, :size]
    return low > np.median(low, (-2, -1), keepdims=True)


def dhash(image: np.ndarray, size: int) -> np.ndarray:
    a = resize(image, size, size + 1).astype(int)
    return a[..., 1:] > a[..., :-1]


def ahash(image: np.ndarray, size: int) -> np.ndarray:
    a = resize(image, size, size).astype(float)
    return a > a.mean((-2, -1), keepdims=True)


def whash(image: np.ndarray, size: int) -> np.ndarray:
    """size must be a power of two."""
    a = image.astype(float) / 255
    low = _haar(a - a.mean((-2, -1), keepdims=True), size)
    return low > np.median(low, (-2, -1), keepdims=True)


HASHES = {"phash": phash, "dhash": dhash, "ahash": ahash, "whash": whash}


def lanes(hash_bits: np.ndarray) -> list[int]:
    """Bits in 64-bit lanes, the first bit highest; a last lane is filled with zeros."""
    b = np.packbits(hash_bits.ravel())
    return np.frombuffer(np.pad(b, (0, -len(b) % 8)).tobytes(), ">i8").astype(np.int64).tolist()


def colour_histogram(rgb: np.ndarray) -> np.ndarray | list[int]:
    """4 x 4 x 4 bins of hue, saturation and value; shares times 255. A list for one image, an array for a stack."""
    if rgb.ndim == 3:
        return colour_histogram(rgb[None])[0].tolist()
    v = rgb.astype(float)
    top, low = v.max(-1), v.min(-1)
    span = np.where(top > low, top - low, 1)
    r, g, b = v[..., 0], v[..., 1], v[..., 2]
    hue = np.where(top == r, (g - b) / span, np.where(top == g, 2 + (b - r) / span, 4 + (r - g) / span)) / 6 % 1
    hue = np.where(top > low, hue * 255, 0).astype(int)
    sat = np.where(top > 0, (top - low) / np.where(top > 0, top, 1) * 255, 0).astype(int)
    index = (hue * 4 // 256) * 16 + (sat * 4 // 256) * 4 + top.astype(int) * 4 // 256
    return np.rint(_shares(index.reshape(len(rgb), -1), 64) * 255).astype(int)


def tone(image: np.ndarray) -> np.ndarray:
    """Grey levels of 8 x 8 fields."""
    return resize(image, 8, 8).reshape(*image.shape[:-2], 64).astype(int)


def features_of(rgb: np.ndarray, algorithm: str = "phash", size: int = 16, refuse_flat: bool = True) -> list[tuple]:
    """(lanes, hash_quality, histogram, tone, tone_quality) of each image of a stack; a nearly even image gets no hash if refused."""
    square = normalize(rgb)
    flat = refuse_flat & (square.reshape(len(square), -1).astype(float).var(1) < FLAT)
    q, bits, hist, tones = quality(square), HASHES.get(algorithm, phash)(square, size), colour_histogram(rgb), tone(square)
    return [(None if flat[i] else lanes(bits[i]), None if flat[i] else float(q[i]), hist[i].tolist(), tones[i].tolist(), float(q[i])) for i in range(len(rgb))]


def stacks(images: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Positions and stack of the images of each size, a bounded number of bytes at a time."""
    by_size: dict[tuple, list[int]] = {}
    for i, a in enumerate(images):
        by_size.setdefault(a.shape, []).append(i)
    for shape, which in by_size.items():
        step = max(1, PIECE // max(NORMAL, int(np.prod(shape)) * 8))
        for lo in range(0, len(which), step):
            yield which[lo : lo + step], np.stack([images[i] for i in which[lo : lo + step]])


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions: small pictures are long work, so their bytes must not decide how many tasks there are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


FEATURES = "lanes array<long>, hash_quality double, histogram array<long>, tone array<long>, tone_quality double"
_TYPES = [pa.list_(pa.int64()), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64()]


def _columns(found: list[tuple | None]) -> list[pa.Array]:
    return [pa.array([f and f[k] for f in found], t) for k, t in enumerate(_TYPES)]


def image_features(images: DataFrame, algorithm: str = "phash", size: int = 16, refuse_flat: bool = True) -> DataFrame:
    """``images`` (height, width, channels, pixels, ...) with FEATURES in place of these columns; all null where there are no pixels."""
    ship(images.sparkSession)
    keys = [c for c in images.columns if c not in ("height", "width", "channels", "pixels")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * PIECE // max(1, whole.nbytes))
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                at, pixels = [], []
                for i, (h, w, n, p) in enumerate(zip(*[b.column(c).to_pylist() for c in ("height", "width", "channels", "pixels")], strict=True)):
                    if p is not None and h and w and h > 0 and w > 0 and n in (1, 3, 4) and len(p) == h * w * n:
                        at.append(i)
                        pixels.append(to_rgb(p, h, w, n))
                found: list[tuple | None] = [None] * b.num_rows
                for which, stack in stacks(pixels):
                    for i, f in zip(which, features_of(stack, algorithm, size, refuse_flat), strict=True):
                        found[at[i]] = f
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], *_columns(found)], [*keys, "lanes", "hash_quality", "histogram", "tone", "tone_quality"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name in keys], FEATURES])
    return spread(images.select(*keys, "height", "width", "channels", "pixels"), *keys).mapInArrow(run, schema)


def sampled(n: int, size: int) -> list[int]:
    """All of n positions, or ``size`` of them at even steps."""
    return list(range(n)) if size <= 0 or size >= n else [i * n // size for i in range(size)]


def crop(rgb: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
    """A box of an image; what lies outside is black."""
    out = np.zeros((height, width, 3), np.uint8)
    inside = rgb[max(top, 0) : max(top + height, 0), max(left, 0) : max(left + width, 0)]
    y, x = max(-top, 0), max(-left, 0)
    out[y : y + inside.shape[0], x : x + inside.shape[1]] = inside
    return out


def sprite_features(sheets: DataFrame, cues: DataFrame, sample: int = 8, algorithm: str = "phash", size: int = 16) -> DataFrame:
    """(ref, position, start, FEATURES) of a sampled set of each sheet's tiles, even ones hashed too.

    sheets (ref, height, width, channels, pixels) meet their cues, as of
    vtt_cues(), once: a sheet's cues travel as an array, and its tiles are cut
    and hashed together, with those of other sheets while they are few, so no
    sheet is copied for each tile. Sheets
    without pixels, without cues and boxes without area give no row.
    """
    ship(sheets.sparkSession)
    box = F.struct("position", "start", "left", "top", F.col("width").alias("box_width"), F.col("height").alias("box_height"))
    by_ref = cues.groupBy("ref").agg(F.array_sort(F.collect_list(box)).alias("cues"))  # a sheet's tiles: some hundred at most

    def hashed(refs: list, kind: pa.DataType, boxes: list[dict], tiles: list[np.ndarray]) -> pa.RecordBatch:
        found: list[tuple | None] = [None] * len(tiles)
        for which, stack in stacks(tiles):
            for i, f in zip(which, features_of(stack, algorithm, size, refuse_flat=False), strict=True):
                found[i] = f
        return pa.RecordBatch.from_arrays(
            [pa.array(refs, kind), pa.array([x["position"] for x in boxes], pa.int32()), pa.array([x["start"] for x in boxes], pa.float64()), *_columns(found)],
            ["ref", "position", "start", "lanes", "hash_quality", "histogram", "tone", "tone_quality"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.column(0).type
            refs, seen, tiles, held = [], [], [], 0
            for r in range(b.num_rows):
                ref, h, w, n, pixels, boxes = (b.column(k)[r].as_py() for k in range(6))
                if pixels is None or not h or h < 0 or n not in (1, 3, 4) or len(pixels) != h * w * n:
                    continue
                sheet = to_rgb(pixels, h, w, n)
                some = [boxes[i] for i in sampled(len(boxes), sample)]
                some = [x for x in some if x["box_width"] > 0 and x["box_height"] > 0]
                refs += [ref] * len(some)
                seen += some
                tiles += [crop(sheet, x["left"], x["top"], x["box_width"], x["box_height"]) for x in some]
                held += sum(t.nbytes for t in tiles[len(tiles) - len(some) :])
                if held >= PIECE // 8 or len(tiles) >= 1000:
                    yield hashed(refs, kind, seen, tiles)
                    refs, seen, tiles, held = [], [], [], 0
            if tiles:
                yield hashed(refs, kind, seen, tiles)

    both = sheets.select("ref", "height", "width", "channels", "pixels").join(by_ref, "ref")
    return spread(both, "ref").mapInArrow(run, f"ref {sheets.schema['ref'].dataType.simpleString()}, position int, start double, {FEATURES}")
