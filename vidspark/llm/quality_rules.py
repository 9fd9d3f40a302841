"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Defined results: a null or empty text has no words and fails; extra columns pass through ``measured`` unless they are
called like a measure, then the measure takes their place; repeated rows are judged alike. Repeated three-word windows
are told by 64-bit hashes within one text. Texts of any length are measured whole; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm.common import documents

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "was", "with", "be", "as", "by", "are",
              "this", "from", "at", "de", "la", "le", "les", "et", "des", "un", "une", "du", "en", "que", "qui", "dans",
              "pour", "est", "au", "der", "die", "und", "das", "den", "von", "mit", "ist", "im", "zu", "ein", "el", "los",
              "y", "se", "del", "por", "con", "no", "su", "para", "es", "una", "al"]
WORD = r"[^\x20\x09-\x0D]+"

#: (rule, measure over the counts, least, most); a document is kept if every measure lies within its bounds.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("words", "n_words", 50, None),
    ("repeated_words", "100 * n_repeat_words / nullif(n_words, 0)", None, 50),
    ("word_length", "word_chars / nullif(n_words, 0)", 3.0, 10.0),
    ("symbols", "n_symbols / nullif(n_words, 0)", None, 0.1),
    ("stop_words", "n_stop_words / nullif(n_words, 0)", 0.06, None),
    ("letters", "n_letter_words / nullif(n_words, 0)", 0.7, None),
    ("shouts", "n_shouts / nullif(n_words, 0)", None, 0.3),
    ("repeated_lines", "n_dup_lines / nullif(n_lines, 0)", None, 0.4),
    ("bullet_lines", "n_bullets / nullif(n_lines, 0)", None, 0.9),
    ("open_lines", "n_open_lines / nullif(n_lines, 0)", None, 0.3),
]


def verdict(rules: list = RULES) -> Column:
    """True if every rule holds; a measure that can't be computed fails its rule."""
    out = F.lit(True)
    for _, measure, low, high in rules:
        value = F.expr(measure)
        if low is not None:
            out = out & F.coalesce(value >= low, F.lit(False))
        if high is not None:
            out = out & F.coalesce(value <= high, F.lit(False))
    return out


def _repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words from _words. Windows are hashed; where some hash repeats, longs made of a hash's upper bits and
    the window's place are sorted, so that equal windows stand together, and neighbours are compared by the whole hash."""
    n = F.size("_words")
    docs = docs.withColumn("_hashes", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    docs = docs.withColumn("_low", F.expr("shiftleft(1L, cast(ceil(log2(size(_words) + 1)) AS int)) - 1"))
    docs = docs.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: h.bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long")))
                     )).otherwise(F.array().cast("array<bigint>")))
    full = lambda j: F.get("_hashes", F.get("_sorted", j).bitwiseAND(F.col("_low")).cast("int"))
    same = F.filter("_sorted", lambda x, j: F.coalesce((j > 0) & (full(j - 1) == full(j)), F.lit(False)) | F.coalesce(
        full(j + 1) == full(j), F.lit(False)))
    docs = docs.withColumn("_starts", F.sort_array(F.transform(same, lambda x: x.bitwiseAND(F.col("_low")))))
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))
    return docs.withColumn("n_repeat_words", F.aggregate("_starts", start, lambda a, x: F.struct(
        x.alias("last"), (a["total"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("total")),
        lambda a: a["total"]))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts the rules use."""
    whole = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(whole, F.lit(pattern)).cast("long")
    out = docs.withColumn("_words", F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    out = out.withColumn("_lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)))
    out = _repeated_words(out)
    return out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        "n_letter_words": count(r"\p{L}[^\x20\x09-\x0D]*"),
        "n_shouts": count(r"![\x20\x09-\x0D]"),
        "n_bullets": F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long"),
        "n_open_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))).cast("long"),
    }).drop("_words", "_lines", "_hashes", "_low", "_sorted", "_starts")


def judged(docs: DataFrame, text: str = "text", rules: list = RULES) -> DataFrame:
    """docs with the counts, base_failed and kept. To filter by the verdict, use ``kept_rows`` or write this table first."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs, text).withColumn("base_failed", base).withColumn("kept", ~base & verdict(rules))


def kept_rows(docs: DataFrame, text: str = "text", rules: list = RULES) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever these are called.

    Kept rows are unpacked from an array: a filter would be pushed below the measures and repeat them in its condition.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = judged(docs.select(whole.alias("_row"), F.col(text).alias("_text")), "_text", rules)
    some = F.when(F.col("kept"), F.array("_row")).otherwise(F.slice(F.array("_row"), 1, 0))
    return rows.select(F.explode(some).alias("_row")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                   "n_repeat_words", "base_failed", "kept")


def _bounds() -> str:
    parts = []
    for _, measure, low, high in RULES:
        parts += [f"coalesce({measure} >= {low}, false)"] if low is not None else []
        parts += [f"coalesce({measure} <= {high}, false)"] if high is not None else []
    return " AND ".join(parts)


SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, k, w[k:k + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM split)),
repeats AS (
  SELECT doc_id, count(DISTINCT j)::BIGINT AS n FROM (
    SELECT doc_id, unnest(range(k, k + 3)) AS j
    FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1) GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(repr(x) for x in STOP_WORDS)}))) AS n_stop_words,
    len(regexp_extract_all(t, '\p{{L}}[^\x20\x09-\x0D]*')) AS n_letter_words,
    len(regexp_extract_all(t, '![\x20\x09-\x0D]')) AS n_shouts,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) AS n_open_lines
  FROM split LEFT JOIN repeats USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_bounds()} AS kept
FROM based
"""
