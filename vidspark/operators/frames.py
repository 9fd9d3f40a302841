"""Frame features and transforms (V1-V12), in NumPy inside Arrow batches that Spark hands out.

A frame is a row (video_id, frame_idx, h, w, pixels BINARY of h*w*3 bytes, RGB). Frames of a batch that share a size
are worked on as one stack of bounded size, so the memory of a task depends on the stack limit, not on the clip.
Arrow batches are bounded in bytes, not only in rows, since ten thousand rows of video frames would not fit.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.functions.hashing import seed_of

# Tasks get these functions by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STACK_BYTES = 192 << 10  # pixels worked on at a time: small enough for the cache, one frame at least
BATCH_BYTES = 64 << 20
BLOCK = 8

BASE_FEATURES = ["noise_energy", "noise_mean", "noise_std", "dct_dc_mean", "dct_dc_std", "dct_ac_mean", "dct_ac_std",
                 "dct_ac_energy", "laplacian_var", "gradient_mean", "gradient_std", "boundary_inconsistency"]
CODEC_FEATURES = ["codec_bitrate", "codec_fps", "codec_resolution"]
SCALED_FEATURES = ["edge_density_grad", "texture_uniformity", "color_consistency_r", "color_consistency_g",
                   "color_consistency_b", "compression_artifacts"]
PIXEL_FEATURES = BASE_FEATURES + SCALED_FEATURES


def gray_of(rgb: np.ndarray) -> np.ndarray:
    """(n, h, w, 3) bytes to (n, h, w) whole gray levels, weighted in thousandths so that halves round alike everywhere."""
    r, g, b = (rgb[..., i].astype(np.int32) for i in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(np.float64)


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(len(a), -1)


def _filtered(g: np.ndarray, down: tuple[int, ...], across: tuple[int, ...]) -> np.ndarray:
    """Correlation with a kernel that is a column times a row; borders mirrored without repeating the edge."""
    out = g
    for axis, weights in ((1, down), (2, across)):
        r = len(weights) // 2
        pad = [(r, r) if a == axis else (0, 0) for a in range(3)]
        p, n = np.pad(out, pad, mode="reflect"), g.shape[axis]
        out = 0.0
        for i, weight in enumerate(weights):
            if weight:
                piece = p[:, i:i + n] if axis == 1 else p[:, :, i:i + n]
                out = out + (piece if weight == 1 else weight * piece)
    return out


def high_pass(g: np.ndarray) -> np.ndarray:
    """Nine times the pixel less the 3 x 3 around it: 8 in the middle, -1 beside it."""
    return 9.0 * g - _filtered(g, (1, 1, 1), (1, 1, 1))


def laplace(g: np.ndarray) -> np.ndarray:
    return _filtered(g, (1, 0, 1), (1,)) + _filtered(g, (1,), (1, 0, 1)) - 4.0 * g


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _filtered(g, (1, 2, 1), (-1, 0, 1)), _filtered(g, (-1, 0, 1), (1, 2, 1))


def box_5(g: np.ndarray) -> np.ndarray:
    return _filtered(g, (1,) * 5, (1,) * 5) / 25.0


def _dct_matrix(n: int = BLOCK) -> np.ndarray:
    k, x = np.mgrid[0:n, 0:n]
    m = np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(2.0 / n)
    m[0] /= np.sqrt(2.0)
    return m


EDGE_LEVEL = 100.0


def noise_residual(g: np.ndarray) -> list[np.ndarray]:
    squared = np.square(_flat(high_pass(g)))
    return [squared.sum(1), squared.mean(1), squared.std(1)]


def dct_statistics(g: np.ndarray) -> list[np.ndarray]:
    n, h, w = g.shape
    p = np.pad(g, ((0, 0), (0, -h % BLOCK), (0, -w % BLOCK)), mode="edge")
    m, (rows, cols) = _dct_matrix(), (p.shape[1] // BLOCK, p.shape[2] // BLOCK)
    # along rows, then along columns: two large products instead of two small ones per block
    half = (p.reshape(-1, BLOCK) @ m.T).reshape(n, rows, BLOCK, cols, BLOCK).transpose(0, 1, 3, 4, 2)
    coeffs = (half.reshape(-1, BLOCK) @ m.T).reshape(n, rows * cols, BLOCK * BLOCK)
    dc = coeffs[:, :, 0].copy()
    coeffs[:, :, 0] = 0.0
    flat = coeffs.reshape(n, -1)
    energy = np.einsum("ij,ij->i", flat, flat)
    return [dc.mean(1), dc.std(1), flat.mean(1), flat.std(1), energy]


def sharpness(g: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> list[np.ndarray]:
    size = np.sqrt(_flat(gx) ** 2 + _flat(gy) ** 2)
    return [_flat(laplace(g)).var(1), size.mean(1), size.std(1)]


def boundary_inconsistency(g: np.ndarray) -> np.ndarray:
    """Mean deviation along the rows and columns where blocks begin; 0 when the frame has no inner border."""
    spread = np.concatenate([g[:, BLOCK::BLOCK, :].std(2), g[:, :, BLOCK::BLOCK].std(1)], axis=1)
    return spread.mean(1) if spread.shape[1] else np.zeros(len(g))


def blockiness(g: np.ndarray) -> np.ndarray:
    """Mean absolute steps inside each block; the last block of a row or column counts in the divisor only."""
    n, h, w = g.shape
    rows, cols = len(range(0, h - BLOCK, BLOCK)), len(range(0, w - BLOCK, BLOCK))
    divisor = (h // BLOCK) * (w // BLOCK)
    if not rows or not cols or not divisor:
        return np.zeros(n)
    b = g[:, :rows * BLOCK, :cols * BLOCK].reshape(n, rows, BLOCK, cols, BLOCK)
    across = np.abs(np.diff(b, axis=4)).mean((2, 4)).sum((1, 2))
    down = np.abs(np.diff(b, axis=2)).mean((2, 4)).sum((1, 2))
    return (across + down) / divisor


def _byte_deviation(x: np.ndarray) -> np.ndarray:
    """Deviation per row of whole numbers, from sums that are exact in doubles."""
    n = x.shape[1]
    total, squares = x.sum(1), np.einsum("ij,ij->i", x, x)
    return np.sqrt(np.maximum(squares * n - total * total, 0.0)) / n


def pixel_features(rgb: np.ndarray) -> np.ndarray:
    """(n, h, w, 3) bytes to (n, 18) features in the order of PIXEL_FEATURES."""
    g = gray_of(rgb)
    gx, gy = sobel(g)
    edges = (_flat(np.abs(gx) + np.abs(gy)) > EDGE_LEVEL).mean(1)
    texture = 1.0 / (1.0 + _flat(box_5(g)).std(1))
    spread = [_byte_deviation(_flat(rgb[..., i].astype(np.float64))) for i in range(3)]
    columns = [*noise_residual(g), *dct_statistics(g), *sharpness(g, gx, gy), boundary_inconsistency(g),
               edges, texture, *spread, blockiness(g)]
    return np.stack(columns, axis=1)


def _readable(pdf: pd.DataFrame) -> pd.Series:
    """Whether a frame has sizes and as many bytes as they say."""
    size = pdf["pixels"].map(lambda p: -1 if p is None else len(p))
    return pdf["h"].notna() & pdf["w"].notna() & (size == pdf["h"] * pdf["w"] * 3) & (size > 0)


def _stacks(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for (h, w), same in pdf.groupby(["h", "w"], sort=False):
        step = max(1, STACK_BYTES // max(1, int(h) * int(w) * 3))
        for start in range(0, len(same), step):
            part = same.iloc[start:start + step]
            flat = np.frombuffer(b"".join(part["pixels"]), dtype=np.uint8)
            yield part, flat.reshape(len(part), int(h), int(w), 3)


def frame_features(frames: DataFrame, keys: list[str]) -> DataFrame:
    """The 18 pixel features of every frame (V1-V4, V6-V9); NULL for a frame that can't be read. One pass, no shuffle."""
    fields = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = ", ".join([f"{k} {fields[k]}" for k in keys] + [f"{c} double" for c in PIXEL_FEATURES])

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = _readable(pdf)
            done = [(part[keys], pixel_features(rgb)) for part, rgb in _stacks(pdf[good])]
            if not good.all():
                done.append((pdf.loc[~good, keys], np.full(((~good).sum(), len(PIXEL_FEATURES)), np.nan)))
            if done:
                out = pd.concat([part for part, _ in done], ignore_index=True)
                values = pd.DataFrame(np.concatenate([v for _, v in done]), columns=PIXEL_FEATURES)
                yield pd.concat([out, values], axis=1)

    return frames.select(*keys, *[c for c in ("h", "w", "pixels") if c not in keys]).mapInPandas(compute, schema)


def clip_features(frames: DataFrame, cues: DataFrame, key: str = "video_id") -> DataFrame:
    """Means over the frames of each clip plus its codec cues.

    Clips without readable frames get the features of a black picture (V12).
    """
    per_frame = frame_features(frames, [key])
    means = per_frame.groupBy(key).agg(*[F.avg(c).alias(c) for c in PIXEL_FEATURES])
    black = dict(zip(PIXEL_FEATURES, pixel_features(np.zeros((1, 224, 224, 3), dtype=np.uint8))[0].tolist()))
    stand_in = {**black, "codec_bitrate": 0.0, "codec_fps": 30.0, "codec_resolution": 0.0}
    joined = cues.join(means, key, "left")
    return joined.select(key, *[F.coalesce(c, F.lit(stand_in[c])).alias(c)
                                for c in BASE_FEATURES + CODEC_FEATURES + SCALED_FEATURES])


def _area_weights(source: int, target: int) -> np.ndarray:
    """(target, source) shares: each target pixel averages the stretch of source pixels it covers."""
    edges = np.arange(target + 1) * (source / target)
    left = np.maximum(edges[:-1, None], np.arange(source)[None])
    right = np.minimum(edges[1:, None], np.arange(1, source + 1)[None])
    shares = np.clip(right - left, 0.0, None)
    return shares / shares.sum(1, keepdims=True)


def letterboxed(rgb: np.ndarray, target: int = 224) -> np.ndarray:
    """(n, h, w, 3) fitted into black squares by area averaging."""
    n, h, w = rgb.shape[:3]
    scale = min(target / w, target / h)
    nw, nh = max(1, int(w * scale)), max(1, int(h * scale))
    small = np.einsum("yh,nhwc,xw->nyxc", _area_weights(h, nh), rgb.astype(np.float64), _area_weights(w, nw),
                      optimize=True)
    out = np.zeros((n, target, target, 3), dtype=np.uint8)
    y, x = (target - nh) // 2, (target - nw) // 2
    out[:, y:y + nh, x:x + nw] = np.clip(small + 0.5, 0, 255).astype(np.uint8)
    return out


def letterbox_frames(frames: DataFrame, keys: list[str], target: int = 224) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", h int, w int, pixels binary"

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, rgb in _stacks(pdf):
                out = part[keys].reset_index(drop=True)
                boxed = letterboxed(rgb, target)
                yield out.assign(h=target, w=target, pixels=[f.tobytes() for f in boxed])

    return frames.select(*keys, "h", "w", "pixels").mapInPandas(compute, schema)
