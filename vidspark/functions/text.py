"""Paths, names, URLs and label texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL patterns in the order they are tried, and the platform each stands for.
URL_PATTERNS = [
    (r"youtube\.com/watch\?v=([^&\s]+)", "youtube"),
    (r"youtu\.be/([^?\s]+)", "youtube"),
    (r"twitter\.com/[^/]+/status/(\d+)", "twitter"),
    (r"facebook\.com/[^/]+/videos/(\d+)", "facebook"),
]

# Label texts.
REAL_TEXTS = ["real", "authentic", "genuine", "0", "false"]
FAKE_TEXTS = ["fake", "manipulated", "tampered", "1", "true"]

# Texts read as true.
TRUE_TEXTS = ["true", "1", "yes", "t"]

# Column names accepted for each logical column, best first.
LABEL_COLUMNS = ["label", "class", "truth_label", "is_fake", "Label", "Class"]
URL_COLUMNS = ["video_url", "url", "videoUrl", "Video_URL", "URL"]
GROUP_COLUMNS = ["cascade_id", "cascadeId", "Cascade_ID", "group_id"]

# Parts of error messages that tell corrupt from empty files.
CORRUPT_WORDS = "moov atom|corrupt"
EMPTY_WORDS = "no frames|empty"

_BLANKS = " \t\n\r\f\x0b"
_WHOLE_NUMBER = r"^\s*[+-]?\d+(_\d+)*\s*$"


def find_column(columns: list[str], candidates: list[str]) -> str:
    for name in candidates:
        if name in columns:
            return name
    raise ValueError(f"none of {candidates} among {columns}")


def url_parts(url: Column, patterns=None) -> Column:
    """struct(video_id, platform) of the first pattern that matches, NULL when none does."""
    hits = []
    for pattern, platform in patterns or URL_PATTERNS:
        found = F.regexp_extract(url, "(?U)" + pattern, 1)
        hits.append(F.when(found != "", F.struct(found.alias("video_id"), F.lit(platform).alias("platform"))))
    return F.coalesce(*hits)


def label_from_text(text: Column) -> Column:
    word = F.lower(F.btrim(text, F.lit(_BLANKS)))
    return F.when(word.isin(REAL_TEXTS), 0).when(word.isin(FAKE_TEXTS), 1).cast("int")


def label_from_number(number: Column) -> Column:
    """Truncated towards zero; NaN has no label."""
    x = number.cast("double")
    return F.when(~F.isnan(x), x.try_cast("int"))


def bool_from_text(text: Column) -> Column:
    return F.lower(text).isin(TRUE_TEXTS)


def sanitize(name: Column, keep: str = "-_") -> Column:
    """Everything but letters, digits and the kept signs becomes an underscore."""
    signs = "".join("\\" + c for c in keep)
    return F.regexp_replace(name, rf"[^\p{{L}}\p{{N}}{signs}]", "_")


def clip_id(path: Column) -> Column:
    """Name of the folder the file lies in; a hash of the path when there is none."""
    plain = F.regexp_replace(path, r"(^|(?<=/))\./", "")
    parent = F.nullif(F.regexp_extract(plain, r"([^/]+)/+[^/]+/*$", 1), F.lit(""))
    root = F.when(path.startswith("/"), F.lit("/"))
    return sanitize(F.coalesce(parent, root, F.substring(F.md5(path), 1, 12)))


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?s)^(.+)\.[^.]+$", "$1")


def match_key(path: Column, folder_stems: tuple[str, ...] = ("video",)) -> Column:
    """Key under which a clip and its derived files meet.

    Cut at ``_scaled``, augmentation number kept, lower case, ``none`` without a path. Files all named alike (``folder_stems``) go by
    their folder, otherwise every original would share one key. A chain in which each step reads the one before once,
    so the generated code stays small.
    """
    name = path
    if folder_stems:
        alike = "|".join(folder_stems)
        name = F.regexp_replace(name, rf"(?s)^(?:.*/)?([^/]+)/+(?:{alike})(?:\.[^./]+)?$", "$1.f")
    base = F.substring_index(stem(name), "_scaled", 1)
    keyed = F.regexp_replace(base, r"(?s)^(.*?)(_aug\s*[+-]?\d+(?:_\d+)*\s*)?(?:_aug.*)?$", "$1$2")
    return F.coalesce(F.lower(keyed), F.lit("none"))


def path_candidates(path: Column, root: str) -> Column:
    """Where a file may lie, likeliest first."""
    trimmed = F.btrim(path, F.lit(_BLANKS))
    base = root.rstrip("/") + "/"
    inside = F.when(trimmed.startswith("videos/"), F.concat(F.lit(base), F.substring(trimmed, 8, 1 << 30)))
    both = F.array(F.concat(F.lit(base + "videos/"), trimmed), F.concat(F.lit(base), trimmed), inside)
    return F.when(trimmed != "", F.filter(both, lambda c: c.isNotNull()))


def scaled_name(path: Column, augmentation_idx: Column, is_original: Column) -> Column:
    original = F.coalesce(is_original, F.lit(False)) | augmentation_idx.isNull() | (augmentation_idx == -1)
    suffix = F.when(original, F.lit("_scaled_original.mp4")) \
        .otherwise(F.concat(F.lit("_scaled_aug"), augmentation_idx.cast("string"), F.lit(".mp4")))
    return F.concat(sanitize(stem(path), "-_."), suffix)


def augmented_name_parts(base: Column) -> Column:
    """struct(video_id, augmentation_idx, is_original) of a file stem, NULL for other names.

    Give the stem as a column of its own: it is used several times.
    """
    pieces = F.split(base, "_aug")
    number = F.get(pieces, F.lit(1))

    def row(video_id, idx, original):
        return F.struct(video_id.alias("video_id"), idx.cast("int").alias("augmentation_idx"),
                        F.lit(original).alias("is_original"))

    number_value = F.translate(F.trim(number), "_", "").try_cast("int")
    return F.when((F.size(pieces) > 1) & number.rlike(_WHOLE_NUMBER), row(F.get(pieces, F.lit(0)), number_value, False)) \
        .when(base.endswith("_original"), row(F.regexp_replace(base, "_original$", ""), F.lit(-1), True))


def error_class(message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    return F.when(text.rlike(CORRUPT_WORDS), "corrupt").when(text.rlike(EMPTY_WORDS), "empty").otherwise("other")


def display_name(name: Column) -> Column:
    return F.initcap(F.translate(name, "_", " "))
