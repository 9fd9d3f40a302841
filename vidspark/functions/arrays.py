"""Frame indices, windows, chunks, vectors and augmentation plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vidspark.functions.hashing import seeded_hash, uniform

# Augmentation types in plan order.
AUGMENTATION_TYPES = ["rotation", "flip", "brightness", "contrast", "saturation",
                      "gaussian_noise", "gaussian_blur", "affine", "elastic", "cutout"]


def _upto(n: Column) -> Column:
    """0 .. n-1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def even_indices(total: Column, k: Column) -> Column:
    """k indices spread over 0 .. total-1, both ends included, truncated; none of a clip without frames."""
    last = total.cast("double") - 1
    step = last / F.when(k > 1, (k - 1).cast("double"))
    return F.when(total <= 0, F.array().cast("array<int>")).otherwise(F.transform(_upto(k), lambda i: F.when(k == 1, F.lit(0)).when(i == k - 1, last.cast("int"))
                       .otherwise(F.floor(i.cast("double") * step).cast("int"))))


def step_indices(total: Column, k: int) -> Column:
    """k indices at a fixed step; a short clip is repeated from its start."""
    step = total.cast("double") / F.lit(float(k))
    picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                         lambda i: F.when(total <= k, (i % F.when(total > 0, total)).cast("int"))
                         .otherwise(F.floor(step * i.cast("double")).cast("int")))
    return F.when(total > 0, picked).otherwise(F.array().cast("array<int>"))


def window_starts(total: Column, window: int, stride: int | None = None) -> Column:
    """First frame of every window; a last one flush with the end is added when needed."""
    if window <= 0:
        return F.array().cast("array<int>")
    stride = stride or max(1, window // 2)
    room = (total - window).cast("int")
    regular = F.sequence(F.lit(0), F.greatest(room, F.lit(0)), F.lit(stride))
    tail = F.when(F.pmod(room, F.lit(stride)) != 0, F.array(room)).otherwise(F.array().cast("array<int>"))
    return F.when(total <= 0, F.array().cast("array<int>")) \
        .when(total <= window, F.array(F.lit(0))).otherwise(F.concat(regular, tail))


def chunks(total: Column, size: int) -> Column:
    """array of struct(chunk, first, end) that covers 0 .. total-1."""
    count = F.ceil(total.cast("double") / F.lit(float(size))).cast("int")
    return F.transform(_upto(count), lambda i: F.struct(
        i.alias("chunk"), (i * size).cast("bigint").alias("first"),
        F.least((i + 1) * size, total).cast("bigint").alias("end")))


def fit_length(vector: Column, length: Column | int) -> Column:
    """Cut, or pad with zeros, to the given length."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), n.cast("int"))), 1, n.cast("int"))


def l2_norm(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.lit(1.0)).otherwise(norm)


def augmentation_plan(seed: Column, n: int) -> Column:
    """n types: up to ten each once in an order set by the seed, more cycle through the list."""
    if n > len(AUGMENTATION_TYPES):
        names = [AUGMENTATION_TYPES[i % len(AUGMENTATION_TYPES)] for i in range(n)]
        return F.array(*[F.lit(t) for t in names])
    keyed = F.array(*[F.struct(F.md5(F.concat_ws("-", seed.cast("string"), F.lit(t))).alias("h"), F.lit(t).alias("t"))
                      for t in AUGMENTATION_TYPES[:n]])
    return F.transform(F.array_sort(keyed), lambda s: s["t"])


def drop_some(seq: Column, key: Column, prob: float = 0.1) -> Column:
    """With the given chance lose 1 to a quarter of the elements, chosen by hash."""
    most = F.greatest(F.lit(1), F.floor(F.size(seq) / F.lit(4)))
    lose = F.lit(1) + F.floor(uniform("drop-n", key) * most).cast("int")
    order = F.array_sort(F.transform(seq, lambda x, i: F.struct(seeded_hash("drop", key, i).alias("h"), i.alias("i"))))
    lost = F.transform(F.slice(order, 1, F.least(lose, F.size(seq))), lambda s: s["i"])
    kept = F.filter(seq, lambda x, i: ~F.array_contains(lost, i))
    return F.when((uniform("drop?", key) < prob) & (F.size(seq) > 0), kept).otherwise(seq)


def repeat_some(seq: Column, key: Column, prob: float = 0.1, each: float = 0.3) -> Column:
    """With the given chance every element is repeated with chance ``each``."""
    twice = F.flatten(F.transform(seq, lambda x, i: F.when(uniform("dup", key, i) < each, F.array(x, x))
                                  .otherwise(F.array(x))))
    return F.when(uniform("dup?", key) < prob, twice).otherwise(seq)


def reverse_some(seq: Column, key: Column, prob: float = 0.1) -> Column:
    return F.when(uniform("rev?", key) < prob, F.reverse(seq)).otherwise(seq)
