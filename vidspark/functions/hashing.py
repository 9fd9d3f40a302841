"""Hash keys, seeds and hash-based random numbers.

Random choices are functions of a key and a seed, so a lost task that runs again makes the same choices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded_hash(seed, *parts: Column) -> Column:
    """32 hex digits, evenly spread, that fix an order for (seed, parts)."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seed_of(path: Column, offset: Column | int = 0) -> Column:
    """Number in [0, 2^31) that belongs to a path, plus an offset for its clips, chunks or frames."""
    base = F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("bigint") % F.lit(1 << 31)
    return base + (F.lit(offset) if isinstance(offset, int) else offset.cast("bigint"))


def uniform(seed, *parts: Column) -> Column:
    """Double in [0, 1) from 52 bits of the hash."""
    bits = F.conv(F.substring(seeded_hash(seed, *parts), 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(float(1 << 52))


def file_key(path: Column, mtime: Column) -> Column:
    return F.md5(F.concat_ws(":", path, mtime.cast("string")))


def frames_key(path: Column, mtime: Column, num_frames: Column, seed: Column) -> Column:
    return F.md5(F.concat_ws(":", path, *[c.cast("string") for c in (mtime, num_frames, seed)]))


# Settings that do not count when two runs are compared.
VOLATILE_SETTINGS = ["run_id", "project_root", "output_dir"]


def config_hash(df: DataFrame, columns: list[str]) -> Column:
    """First 16 digits of the SHA-256 of the row as JSON, keys in order, volatile settings left out."""
    fields = []
    for name in sorted(c for c in columns if c not in VOLATILE_SETTINGS):
        as_list = F.to_json(F.array(F.col(name)), {"ignoreNullFields": "false"})
        value = F.substring(as_list, F.lit(2), F.length(as_list) - 2)
        fields.append(F.concat(F.lit(f'"{name}": '), value))
    text = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    return F.substring(F.sha2(text, 256), 1, 16)
