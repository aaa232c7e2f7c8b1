"""Features of decoded grey images."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Clipped levels.
DARK, BRIGHT = 8, 247


def _dct_rows(n: int) -> np.ndarray:
    i = np.arange(n)
    return np.cos(np.pi * (2 * i[None, :] + 1) * i[:, None] / (2 * n))


def perceptual_hash(grey: np.ndarray) -> str:
    """Signs of the 8x8 low frequencies of a 32x32 image against their median, as 16 hex digits."""
    return _perceptual_hashes(grey[None])[0]


def _perceptual_hashes(grey: np.ndarray) -> list[str]:
    """Of images of one size."""
    n, small = 32, grey
    for axis in (1, 2):
        size = grey.shape[axis]
        at = np.linspace(0, size, n + 1).astype(int)
        # cells of one pixel, or sums of whole numbers
        small = np.take(small, at[:-1], axis=axis) if size < n else np.add.reduceat(small, at[:-1], axis=axis)
        if size >= n:
            small = small / np.diff(at).reshape((1, -1, 1) if axis == 1 else (1, 1, -1))
    c = _dct_rows(n)
    low = (c @ small @ c.T)[:, :8, :8].reshape(len(grey), -1)
    return [b.tobytes().hex() for b in np.packbits(low > np.median(low, axis=1)[:, None], axis=1)]


#: Images of one size that are measured at once: so many at most, of so many pixels together.
PIECE_IMAGES, PIECE_PIXELS = 512, 1 << 22


def _measured(g: np.ndarray) -> list[tuple]:
    """What `features` says of images of one size."""
    flat = g.reshape(len(g), -1)
    lap = [None] * len(g)
    if min(g.shape[1:]) >= 3:
        edges = 4 * g[:, 1:-1, 1:-1] - g[:, :-2, 1:-1] - g[:, 2:, 1:-1] - g[:, 1:-1, :-2] - g[:, 1:-1, 2:]
        lap = edges.reshape(len(g), -1).var(axis=1).tolist()
    means = (flat.mean(axis=1) / 255, flat.std(axis=1) / 255, (flat <= DARK).mean(axis=1), (flat >= BRIGHT).mean(axis=1))
    return list(zip(_perceptual_hashes(g), lap, *(m.tolist() for m in means), strict=True))


def features(df: DataFrame, *, key: str = "id", pixels: str = "pixels", width: str = "width") -> DataFrame:
    """phash, sharpness (variance of the Laplacian), brightness, contrast, clip_dark and clip_bright of grey images, given
    as bytes row by row. Null, empty or ragged images give nulls; images under 3x3 have no sharpness. Images of one size are
    measured together."""
    kind = df.schema[key].dataType.simpleString()
    names = ("phash", "sharpness", "brightness", "contrast", "clip_dark", "clip_bright")

    def run(batches):
        for b in batches:
            raws, sizes = b.column(1).to_pylist(), {}
            for i, (raw, w) in enumerate(zip(raws, b.column(2).to_pylist(), strict=True)):
                if raw and w and not len(raw) % w:
                    sizes.setdefault((len(raw), w), []).append(i)
            rows = [(None,) * 6] * b.num_rows
            for (size, w), at in sizes.items():
                step = max(1, min(PIECE_IMAGES, PIECE_PIXELS // size))
                for x in range(0, len(at), step):
                    piece = at[x : x + step]
                    g = np.frombuffer(b"".join([raws[i] for i in piece]), np.uint8).reshape(len(piece), -1, w).astype(float)
                    for i, row in zip(piece, _measured(g), strict=True):
                        rows[i] = row
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), *(pa.array(c, pa.float64()) for c in cols[1:])], [key, *names])

    return df.select(key, pixels, width).mapInArrow(run, f"{key} {kind}, phash string, " + ", ".join(f"{n} double" for n in names[1:]))
