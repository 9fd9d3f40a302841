"""Numbers: scores, geometry, sampling sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def finite_or_zero(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(INF)), F.lit(0.0)).otherwise(x)


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / F.when(den > 0, den)).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    exps = [F.exp(s - top) for s in scores]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return [e / total for e in exps]


def argmax(scores: list[Column]) -> Column:
    """Index of the largest score, the first of equals."""
    top = F.greatest(*scores)
    out = F.lit(len(scores) - 1)
    for i in range(len(scores) - 2, -1, -1):
        out = F.when(scores[i] == top, F.lit(i)).otherwise(out)
    return out


def above(p: Column, threshold: float = 0.5) -> Column:
    """Feature models: positive only beyond the threshold."""
    return (p > F.lit(threshold)).cast("int")


def at_least(p: Column, threshold: float = 0.5) -> Column:
    """Network metrics: the threshold itself counts as positive."""
    return (p >= F.lit(threshold)).cast("int")


def adaptive_frames(total: Column, share: float = 0.1, low: int = 5, high: int = 50) -> Column:
    wanted = F.floor(total.cast("double") * F.lit(share)).cast("int")
    return F.when(total > 0, F.greatest(F.lit(low), F.least(F.lit(high), wanted))).otherwise(F.lit(low))


def letterbox(width: Column, height: Column, target: int = 224) -> dict[str, Column]:
    """Size and place of a picture fitted into a square."""
    scale = F.least(F.lit(float(target)) / width, F.lit(float(target)) / height)
    new_w = F.floor(width * scale).cast("int")
    new_h = F.floor(height * scale).cast("int")
    return {
        "new_width": new_w,
        "new_height": new_h,
        "paste_x": F.floor((F.lit(target) - new_w) / F.lit(2)).cast("int"),
        "paste_y": F.floor((F.lit(target) - new_h) / F.lit(2)).cast("int"),
    }


def scaling_flags(ow: Column, oh: Column, sw: Column, sh: Column) -> dict[str, Column]:
    """1 or 0 for up and down; 0 when any side is unknown."""
    known = ow.isNotNull() & oh.isNotNull() & sw.isNotNull() & sh.isNotNull()
    before, after = F.greatest(ow, oh), F.greatest(sw, sh)
    return {
        "is_upscaled": F.when(known & (after > before), 1).otherwise(0),
        "is_downscaled": F.when(known & (after < before), 1).otherwise(0),
    }


def rate(text: Column) -> Column:
    """'30000/1001' as a number; NULL unless it is two whole numbers with a positive second."""
    num = F.get(F.split(text, "/"), F.lit(0)).try_cast("bigint")
    den = F.get(F.split(text, "/"), F.lit(1)).try_cast("bigint")
    return F.when((F.size(F.split(text, "/")) == 2) & (den > 0), num.cast("double") / F.when(den > 0, den))


def frame_total(frames: Column, duration: Column, fps: Column) -> Column:
    """Stated number of frames, else what duration and rate give (when both are non-zero)."""
    guess = F.when((duration != 0) & (fps != 0), (duration * fps).try_cast("bigint"))
    return F.coalesce(frames.cast("bigint"), guess)
