"""Frame features and transforms over whole texts read as frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidspark import tables as t
from vidspark.operators import frames as fr
from vidspark.plans.registry import query
from vidspark.plans.reports import rounded
from vidspark.plans.views import BLOCKS, BOUNDARY, DCT, GRAY, NEIGHBOURS


OFF_HALVES = 0.0000123  # many of these values are exact halves of the last digit shown, which engines round either way


def shown(df, columns):
    return df.withColumns({c: F.round(F.col(c) + OFF_HALVES, 4) + 0.0 for c in columns})


def _register(name: str, columns: list[str], views: str, table: str) -> None:
    """One group of features per frame, and the same in SQL."""
    picked = ", ".join(f"round({c} + {OFF_HALVES:.7f}::DOUBLE, 4) + 0.0::DOUBLE AS {c}" for c in columns)

    @query(name, f"WITH {views} SELECT video_id, frame_idx, {picked} FROM {table}")
    def run(spark, d):
        out = fr.frame_features(t.frames(spark, d), ["video_id", "frame_idx"])
        return shown(out.select("video_id", "frame_idx", *columns), columns)


_register("v1_noise_residual", ["noise_energy", "noise_mean", "noise_std"], NEIGHBOURS, "simple")
_register("v2_dct_statistics", ["dct_dc_mean", "dct_dc_std", "dct_ac_mean", "dct_ac_std", "dct_ac_energy"], f"{GRAY}, {DCT}", "dct")
_register("v3_sharpness", ["laplacian_var", "gradient_mean", "gradient_std"], NEIGHBOURS, "simple")
_register("v4_boundary_inconsistency", ["boundary_inconsistency"], BOUNDARY, "boundary")
_register("v6_edge_density", ["edge_density_grad"], NEIGHBOURS, "simple")
_register("v7_texture_uniformity", ["texture_uniformity"], NEIGHBOURS, "simple")
_register("v8_color_spread", ["color_consistency_r", "color_consistency_g", "color_consistency_b"], NEIGHBOURS, "simple")
_register("v9_blockiness", ["compression_artifacts"], f"{GRAY}, {BLOCKS}", "blocks")


def codec_table(spark, d):
    """Every document, also those without frames, with cues from its length."""
    n = F.col("n_chars")
    return t.load(spark, d, "documents").select(
        F.col("doc_id").alias("video_id"), (n * 8).cast("double").alias("codec_bitrate"),
        F.when(n % 2 == 0, 25.0).alias("codec_fps"), F.lit(float(t.FRAME_SIDE ** 2)).alias("codec_resolution"))


_MEANS = ", ".join(f"avg({c}) AS {c}" for c in fr.PIXEL_FEATURES)
_ROUNDED = ", ".join(f"round({c} + {OFF_HALVES:.7f}::DOUBLE, 4) + 0.0::DOUBLE AS {c}" for c in fr.BASE_FEATURES + fr.CODEC_FEATURES + fr.SCALED_FEATURES)
_CUES = """cues AS (SELECT doc_id AS video_id, CAST(n_chars * 8 AS DOUBLE) AS codec_bitrate,
  CASE WHEN n_chars % 2 = 0 THEN 25.0::DOUBLE ELSE 30.0::DOUBLE END AS codec_fps, 576.0::DOUBLE AS codec_resolution FROM documents)"""


def _clips(readable: str) -> str:
    return f"""WITH {NEIGHBOURS}, {BOUNDARY[len(GRAY) + 2:]}, {BLOCKS}, {DCT}, {_CUES},
means AS (SELECT video_id, {_MEANS} FROM simple JOIN boundary USING (video_id, frame_idx) JOIN blocks USING (video_id, frame_idx)
  JOIN dct USING (video_id, frame_idx) WHERE {readable} GROUP BY video_id),
every_clip AS (SELECT * FROM cues JOIN means USING (video_id)
UNION ALL BY NAME SELECT *, {", ".join(f"{1.0 if c == 'texture_uniformity' else 0.0}::DOUBLE AS {c}" for c in fr.PIXEL_FEATURES)}
  FROM cues WHERE video_id NOT IN (SELECT video_id FROM means))
SELECT video_id, {_ROUNDED} FROM every_clip"""


@query("v5_clip_features", _clips("true"))
def v5(spark, d):
    out = fr.clip_features(t.frames(spark, d), codec_table(spark, d))
    return shown(out, out.columns[1:])


@query("v12_stand_in_features", _clips("video_id % 3 <> 0"))
def v12(spark, d):
    """Every third clip has frames that can't be read: half of them cut short, the others without a size."""
    k = F.col("video_id")
    broken = t.frames(spark, d).withColumn("pixels", F.when(k % 6 == 0, F.substring("pixels", 1, 5)).otherwise(F.col("pixels"))) \
        .withColumn("h", F.when(k % 6 != 3, F.col("h")))
    out = fr.clip_features(broken, codec_table(spark, d))
    return shown(out, out.columns[1:])


@query("v11_letterboxed_frames")
def v11(spark, d):
    out = fr.letterbox_frames(t.frames(spark, d), ["video_id", "frame_idx"], 32)
    return out.select("video_id", "frame_idx", "h", "w", F.length("pixels").alias("bytes"), F.md5("pixels").alias("digest"))


@query("v11_doubled_frames", """WITH d AS (SELECT doc_id, hex(encode(text)) AS b FROM documents WHERE strlen(text) > 0),
f AS (SELECT doc_id, b, unnest(range(CAST(ceil(strlen(b) / 3456.0::DOUBLE) AS BIGINT))) AS i FROM d),
p AS (SELECT doc_id, i, rpad(substring(b, i * 3456 + 1, 3456), 3456, '0') AS px FROM f),
rows_ AS (SELECT doc_id, i, [array_to_string([repeat(substring(px, (y * 24 + x) * 6 + 1, 6), 2) FOR x IN range(24)], '') FOR y IN range(24)] AS r FROM p)
SELECT doc_id AS video_id, CAST(i AS INTEGER) AS frame_idx, 48 AS h, 48 AS w, 6912 AS bytes,
  md5(unhex(array_to_string([repeat(x, 2) FOR x IN r], ''))) AS digest FROM rows_""")
def v11b(spark, d):
    """Frames at twice their size: every pixel four times."""
    out = fr.letterbox_frames(t.frames(spark, d), ["video_id", "frame_idx"], 48)
    return out.select("video_id", "frame_idx", "h", "w", F.length("pixels").alias("bytes"), F.md5("pixels").alias("digest"))
