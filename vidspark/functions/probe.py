"""Media probe output as JSON text to typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vidspark.functions.numeric import frame_total, rate

PROBE_SCHEMA = """
    format struct<duration:string, bit_rate:string, size:string>,
    streams array<struct<codec_type:string, width:string, height:string, r_frame_rate:string, nb_frames:string,
                         codec_name:string, codec_long_name:string, bit_rate:string, pix_fmt:string,
                         display_aspect_ratio:string>>
"""


def probe_columns(json_text: Column) -> dict[str, Column]:
    """Statistics of the first video stream; what cannot be read is NULL."""
    data = F.from_json(json_text, PROBE_SCHEMA)
    form = data["format"]
    video = F.get(F.filter(data["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    duration = form["duration"].try_cast("double")
    fps = rate(video["r_frame_rate"])
    return {
        "width": video["width"].try_cast("int"),
        "height": video["height"].try_cast("int"),
        "fps": fps,
        "frame_count": frame_total(video["nb_frames"].try_cast("bigint"), duration, fps),
        "duration_sec": duration,
        "codec_name": video["codec_name"],
        "codec_long_name": video["codec_long_name"],
        "bitrate": video["bit_rate"].try_cast("bigint"),
        "total_bitrate": form["bit_rate"].try_cast("bigint"),
        "file_size_bytes": form["size"].try_cast("bigint"),
        "pixel_format": video["pix_fmt"],
        "aspect_ratio": video["display_aspect_ratio"],
    }


def codec_cues(json_text: Column) -> dict[str, Column]:
    """Three features of the first stream listed, with fixed stand-ins (0, 30, 0) for what is missing."""
    stream = F.get(F.from_json(json_text, PROBE_SCHEMA)["streams"], F.lit(0))
    area = F.coalesce(stream["width"].try_cast("double"), F.lit(0.0)) \
        * F.coalesce(stream["height"].try_cast("double"), F.lit(0.0))
    text = stream["r_frame_rate"]
    fps = F.when(F.contains(text, F.lit("/")), rate(text)).otherwise(text.try_cast("double"))
    return {
        "codec_bitrate": F.coalesce(stream["bit_rate"].try_cast("double"), F.lit(0.0)),
        "codec_fps": F.coalesce(fps, F.lit(30.0)),
        "codec_resolution": area,
    }
