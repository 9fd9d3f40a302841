"""Feature tables: aggregation, matching, combination, pruning, preparation."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.functions.arrays import fit_length, l2_norm
from vidspark.functions.text import match_key, stem
from vidspark.operators.ranking import exact_quantiles
from vidspark.session import materialize

METADATA_COLUMNS = ("video_path", "label", "feature_path")


def feature_columns(df: DataFrame, metadata=METADATA_COLUMNS) -> list[str]:
    return [c for c in df.columns if c not in metadata]


def prefixed(df: DataFrame, prefix: str, metadata=METADATA_COLUMNS) -> DataFrame:
    """video_path and the feature columns, named ``<prefix><column>`` (P10)."""
    return df.select("video_path", *[F.col(c).cast("double").alias(prefix + c) for c in feature_columns(df, metadata)])


def clip_means(frames: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mean of every frame feature per clip."""
    return frames.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])


def modal_length(df: DataFrame, vector: str) -> DataFrame:
    """The commonest length; the shorter of equally common ones."""
    counts = df.groupBy(F.size(vector).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("length", F.struct("n", -F.col("length"))).alias("length"))


def equal_lengths(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, fit_length(F.col(vector), modal_length(df, vector).scalar()))


# ---- matching -------------------------------------------------------------------------------------------------

def match_exact(targets: DataFrame, features: DataFrame, seq: str, folder_stems=("video",)) -> DataFrame:
    """Left join of targets to features on the match key; the last feature row wins among equal keys."""
    keyed = features.withColumn("_key", match_key(F.col("video_path"), folder_stems))
    columns = [c for c in features.columns if c not in ("video_path", "label", "feature_path", seq)]
    last = keyed.groupBy("_key").agg(F.max_by(F.struct(F.col("video_path").alias("matched_path"), *columns),
                                              F.col(seq)).alias("_f"))
    return targets.withColumn("_key", match_key(F.col("video_path"), folder_stems)) \
        .join(last, "_key", "left").select(*targets.columns, "_f.*")


#: Letters of the pieces that keys are looked up by. Pieces of so many letters of long numbered names are rare.
GRAM = 8


def _grams(text: Column, n: int) -> Column:
    """All distinct pieces of n letters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))) \
        .otherwise(F.array().cast("array<string>"))


def containments(needles: DataFrame, hay: DataFrame, gram: int = GRAM, least: str | None = None) -> DataFrame:
    """Rows of needles and hay where the text ``needle`` lies in the text ``hay``; both columns hold distinct texts.

    Hay texts are indexed by their pieces of ``gram`` letters, one row a piece, and by shorter pieces of the lengths that
    shorter needles have: at most ``gram`` rows a letter, never all substrings. A needle sends one row: itself if it is
    that short, else the rarest of its pieces by the counts of the index; a needle with a piece that no hay text has is
    out. Candidates that share the piece are compared whole, and an aggregation that follows combines them on the map side.
    With ``least``, a column of the hay, there is one row a needle with the least value of that column: the shorter pieces
    then meet that value on the map side, and no hay text leaves with them.
    Spark takes an index for as small as the names it is made of, so the joins with it must never broadcast.
    """
    brief = needles.where(F.length("needle").between(1, gram - 1))
    lengths = brief.select(F.length("needle").alias("n")).distinct()
    short = sorted(r["n"] for r in lengths.collect())  # fewer than gram numbers
    index = hay.withColumn("_piece", F.explode(_grams(F.col("hay"), gram)))
    # written: Spark deals out a piece that most needles have only where no aggregation stands before the join
    counts = materialize(index.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    long = needles.where(F.length("needle") >= gram)
    pieces = long.select("needle", F.explode(_grams(F.col("needle"), gram)).alias("_piece"))
    rarest = pieces.join(counts.hint("merge"), "_piece", "left").groupBy("needle").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_piece").alias("piece"))).alias("_r"))
    sent = long.join(rarest.where(F.col("_r.n") > 0).select("needle", F.col("_r.piece").alias("_piece")).hint("merge"), "needle")
    found = sent.join(index.hint("merge"), "_piece").where(F.contains("hay", "needle")).drop("_piece")
    if least:
        found = found.groupBy("needle").agg(F.min(least).alias(least))
    if not short:
        return found
    index = hay.withColumn("_piece", F.explode(F.concat(*[_grams(F.col("hay"), n) for n in short])))
    if least:
        index = index.groupBy("_piece").agg(F.min(least).alias(least))
    same = brief.withColumn("_piece", F.col("needle")).join(index.hint("merge"), "_piece").drop("_piece")
    return found.unionByName(same.select(*found.columns))


def match_contained(targets: DataFrame, candidates: DataFrame, key_of=None, seq: str = "seq") -> DataFrame:
    """First candidate that contains the target's key or lies in it (J10), found by the rarest pieces of shorter keys.

    Returns (video_path, matched_path) for the targets that match.
    """
    key_of = key_of or (lambda c: match_key(c))
    cands = candidates.select(key_of(F.col("video_path")).alias("_ck"), F.col("video_path").alias("matched_path"), seq) \
        .where(F.col("_ck") != "")
    # equal keys: the place of the first, the path of the last
    firsts = cands.groupBy("_ck").agg(F.min(seq).alias("_seq"), F.max_by("matched_path", seq).alias("matched_path"))
    # a number in the order of the places goes through the exchanges for the path; ranges keep it in order across tasks
    order, parts = ["_seq", "matched_path", "_ck"], int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = firsts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    firsts = materialize(ranged.select("_ck", "matched_path", F.monotonically_increasing_id().alias("_best")), "candidates")
    wanted = materialize(targets.select("video_path", key_of(F.col("video_path")).alias("_tk")).where(F.col("_tk") != "").distinct(), "targets")
    keys = wanted.select("_tk").distinct()
    best = F.min("_best").alias("_best")
    inside = containments(keys.select(F.col("_tk").alias("needle")), firsts.select(F.col("_ck").alias("hay"), "_best"), least="_best") \
        .select(F.col("needle").alias("_tk"), "_best")
    around = containments(firsts.select(F.col("_ck").alias("needle"), "_best"), keys.select(F.col("_tk").alias("hay"))) \
        .groupBy(F.col("hay").alias("_tk")).agg(best)
    found = inside.unionByName(around).groupBy("_tk").agg(best)
    paths = found.join(firsts.select("_best", "matched_path").hint("merge"), "_best").select("_tk", "matched_path")
    return wanted.join(paths.hint("merge"), "_tk").select("video_path", "matched_path")


def match_paths(targets: DataFrame, candidates: DataFrame, seq: str = "seq", contained: bool = False,
                folder_stems=("video",)) -> DataFrame:
    """(video_path, matched_path, level): by key, then by containment of keys, then of plain stems if asked for."""
    wanted = targets.select("video_path").distinct()
    exact = match_exact(wanted, candidates.select("video_path", seq), seq, folder_stems) \
        .where(F.col("matched_path").isNotNull()).withColumn("level", F.lit(1))
    if not contained:
        return exact
    left = wanted.join(exact, "video_path", "left_anti")
    by_key = match_contained(left, candidates, lambda c: match_key(c, folder_stems), seq).withColumn("level", F.lit(2))
    left = left.join(by_key, "video_path", "left_anti")
    by_stem = match_contained(left, candidates, lambda c: F.lower(stem(c)), seq).withColumn("level", F.lit(3))
    return exact.unionByName(by_key).unionByName(by_stem)


def combine_stages(targets: DataFrame, stage2: DataFrame | None, stage4: DataFrame | None, seq: str = "seq") -> DataFrame:
    """Features of both stages per target; targets lacking a given stage drop out."""
    if stage2 is None and stage4 is None:
        raise ValueError("no features given")
    out = targets.withColumn("_key", match_key(F.col("video_path")))
    for prefix, stage in (("stage2_", stage2), ("stage4_", stage4)):
        if stage is None:
            continue
        columns = [c for c in feature_columns(stage) if c != seq]
        # one number per column and key: a hash aggregate, where whole rows would need sorting
        last = stage.groupBy(match_key(F.col("video_path")).alias("_key")).agg(
            *[F.coalesce(F.max_by(F.col(c).cast("double"), F.col(seq)), F.lit(0.0)).alias(prefix + c) for c in columns])
        out = out.join(last, "_key")
    return out.drop("_key")


# ---- statistics and pruning -----------------------------------------------------------------------------------

def population_variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, variance), all columns in one pass."""
    return df.agg(*[F.var_pop(c).alias(c) for c in columns]).unpivot([], columns, "feature", "variance")


def finite_or_zero(column: str) -> Column:
    """NULL, NaN and infinities count as 0, as they do once stages are combined."""
    x = F.col(column).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """p x p Pearson matrix (A27) over all rows; they stay on the cluster. A constant column correlates with none."""
    rows = df.select(*[finite_or_zero(c).alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(rows)
    found = np.nan_to_num(Correlation.corr(vectors, "_v").head()[0].toArray())
    np.fill_diagonal(found, 1.0)
    return found


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_1, feature_2, correlation) for every pair, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    entries = F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.corr(a, b).alias("correlation"))
                        for a, b in pairs])
    return df.agg(entries.alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")


@dataclass
class FeaturePruner:
    """Which columns to keep: constant ones go, then the weaker of each strongly related pair, then high VIFs.

    ``fit`` brings one row of moments and one p x p matrix to the driver. Fit on training rows only; features that
    vary with the number of rows never reach the driver.
    """

    method: str = "correlation"
    correlation_threshold: float = 0.95
    vif_threshold: float = 10.0
    kept: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, columns: list[str]) -> "FeaturePruner":
        if not columns:
            self.kept = []
            return self
        row = df.agg(*[F.var_pop(finite_or_zero(c)).alias(c) for c in columns]).head()
        variances = {c: (row[c] if row[c] is not None else 0.0) for c in columns}
        kept = [c for c in columns if variances[c] > 0] or list(columns)
        if self.method in ("correlation", "both") and len(kept) > 1:
            dropped = weaker_of_pairs(correlation_matrix(df, kept), [variances[c] for c in kept],
                                      self.correlation_threshold)
            kept = [c for i, c in enumerate(kept) if i not in dropped]
        if self.method in ("vif", "both") and len(kept) > 1:
            vifs = inflation_factors(correlation_matrix(df, kept))
            kept = [c for c, v in zip(kept, vifs) if v <= self.vif_threshold]
        self.kept = kept
        return self

    def transform(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return df.select(*keys, *self.kept)


def weaker_of_pairs(corr: np.ndarray, variances: list[float], threshold: float) -> set[int]:
    """Columns to drop, pairs taken in order; of a pair the one with less variance goes, the later one if equal.

    A column already dropped starts no new comparisons, but one dropped midway finishes its own.
    """
    dropped: set[int] = set()
    for i, own in enumerate(variances):
        if i in dropped:
            continue
        related = np.flatnonzero(np.abs(corr[i, i + 1:]) >= threshold) + i + 1
        for j in related.tolist():
            if j not in dropped:
                dropped.add(i if own < variances[j] else j)
    return dropped


def inflation_factors(corr: np.ndarray) -> np.ndarray:
    """Variance inflation: the diagonal of the inverse. Columns that depend on each other, those with a share in the
    null space, are infinite; the others get theirs from the pseudo-inverse."""
    values, vectors = np.linalg.eigh(corr)
    null = values < 1e-10 * max(1.0, values.max())
    inverse = np.where(null, 0.0, 1.0 / np.where(null, 1.0, values))
    factors = (vectors ** 2 * inverse).sum(axis=1)
    factors[(np.abs(vectors[:, null]) > 1e-9).any(axis=1)] = np.inf
    return factors


def load_features(targets: DataFrame, stage2: DataFrame | None, stage4: DataFrame | None, seq: str = "seq",
                  pruner: FeaturePruner | None = None, fit_on: Column | None = None) -> tuple[DataFrame, FeaturePruner]:
    """Combined and pruned features (F8). ``fit_on`` picks the rows the pruner may see.

    The combined table is written once; the two passes of the fit and the result read it from there.
    """
    combined = materialize(combine_stages(targets, stage2, stage4, seq), "combined")
    columns = [c for c in combined.columns if c.startswith(("stage2_", "stage4_"))]
    fitted = (pruner or FeaturePruner()).fit(combined.where(fit_on) if fit_on is not None else combined, columns)
    return fitted.transform(combined, targets.columns), fitted


# ---- preparation ----------------------------------------------------------------------------------------------

def _wide_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float]) -> dict[str, dict[str, float]]:
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    rows = exact_quantiles(long, ["column"], "value", probs).collect()  # one row per column
    return {r["column"]: {n: r[n] for n in probs} for r in rows}


@dataclass
class FeaturePreprocessor:
    """Impute, scale, normalise (F4-F7). ``fit`` learns a few numbers per column; ``transform`` is a projection."""

    imputation: str = "mean"
    scaling: str | None = "standard"
    normalize: bool = True
    constant: float = 0.0
    fill: dict[str, float] = field(default_factory=dict)
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def _clean(self, c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    def _fills(self, df: DataFrame, columns: list[str]) -> dict[str, float]:
        if self.imputation == "constant":
            return {c: self.constant for c in columns}
        clean = df.select(*[self._clean(c).alias(c) for c in columns])
        if self.imputation == "mean":
            row = clean.agg(*[F.avg(c).alias(c) for c in columns]).head()
            found = {c: row[c] for c in columns}
        elif self.imputation == "median":
            quantiles = _wide_quantiles(clean, columns, {"m": 0.5})
            found = {c: quantiles.get(c, {}).get("m") for c in columns}
        elif self.imputation == "most_frequent":
            counts = clean.unpivot([], columns, "column", "value").where(F.col("value").isNotNull()) \
                .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
            rows = counts.groupBy("column").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("m")).collect()
            found = {r["column"]: r["m"] for r in rows}
        else:
            raise ValueError(f"unknown imputation {self.imputation!r}")
        return {c: (found.get(c) if found.get(c) is not None else 0.0) for c in columns}

    def fit(self, df: DataFrame, columns: list[str]) -> "FeaturePreprocessor":
        self.fill = self._fills(df, columns)
        filled = df.select(*[F.coalesce(self._clean(c), F.lit(self.fill[c])).alias(c) for c in columns])
        if self.scaling == "standard":
            row = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                             *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).head()
            self.center = {c: row[f"m_{c}"] for c in columns}
            self.scale = {c: row[f"s_{c}"] or 1.0 for c in columns}
        elif self.scaling == "robust":
            q = _wide_quantiles(filled, columns, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
            self.center = {c: q[c]["q2"] for c in columns}
            self.scale = {c: (q[c]["q3"] - q[c]["q1"]) or 1.0 for c in columns}
        elif self.scaling is None:
            self.center, self.scale = {c: 0.0 for c in columns}, {c: 1.0 for c in columns}
        else:
            raise ValueError(f"unknown scaling {self.scaling!r}")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fill:
            raise ValueError("fit before transform")
        columns = list(self.fill)
        scaled = {c: (F.coalesce(self._clean(c), F.lit(float(self.fill[c]))) - F.lit(float(self.center[c])))
                  / F.lit(float(self.scale[c])) for c in columns}
        out = df.withColumns(scaled)
        return normalized_rows(out, columns) if self.normalize else out


def normalized_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of unit length; an all-zero row stays as it is."""
    return df.withColumn("_norm", l2_norm(F.array(*columns))) \
        .withColumns({c: F.col(c) / F.col("_norm") for c in columns}).drop("_norm")
