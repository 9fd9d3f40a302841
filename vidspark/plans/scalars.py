"""Scalar, array and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidspark import tables as t
from vidspark.functions import arrays as ar
from vidspark.functions import hashing as hs
from vidspark.functions import numeric as nu
from vidspark.functions import probe as pr
from vidspark.functions import text as tx
from vidspark.plans.registry import query
from vidspark.plans.views import MANIFEST, SCALED, STAGE1


def joined(c):
    """Arrays as text, so that both engines give one plain value."""
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


_URLS = """urls AS (SELECT page_id, CASE page_id % 6
  WHEN 0 THEN 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) || '&t=' || page_id
  WHEN 1 THEN 'https://youtu.be/' || substr(md5(url), 1, 11) || '?s=1'
  WHEN 2 THEN ' http://twitter.com/user' || page_id || '/status/' || (page_id * 7919 + 12345)
  WHEN 3 THEN 'https://www.facebook.com/page' || page_id || '/videos/' || (page_id * 104729 + 1) || '/'
  WHEN 4 THEN 'https://twitter.com/status/' || page_id ELSE url END AS u FROM pages)"""


def clip_urls(spark, d):
    """Page ids and addresses as links of the four kinds, of a kind that gives no id, and as they are."""
    p, k = t.load(spark, d, "pages"), F.col("page_id")
    i, short = k.cast("string"), F.substring(F.md5("url"), 1, 11)
    return p.select("page_id", F.when(k % 6 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), short, F.lit("&t="), i))
                    .when(k % 6 == 1, F.concat(F.lit("https://youtu.be/"), short, F.lit("?s=1")))
                    .when(k % 6 == 2, F.concat(F.lit(" http://twitter.com/user"), i, F.lit("/status/"), (k * 7919 + 12345).cast("string")))
                    .when(k % 6 == 3, F.concat(F.lit("https://www.facebook.com/page"), i, F.lit("/videos/"),
                                               (k * 104729 + 1).cast("string"), F.lit("/")))
                    .when(k % 6 == 4, F.concat(F.lit("https://twitter.com/status/"), i)).otherwise(F.col("url")).alias("u"))


@query("x1_url_ids", f"""WITH {_URLS} SELECT page_id,
  CASE page_id % 6 WHEN 0 THEN regexp_extract(u, 'v=([^&]+)', 1) WHEN 1 THEN regexp_extract(u, 'be/([^?]+)', 1)
    WHEN 2 THEN regexp_extract(u, 'status/([0-9]+)', 1) WHEN 3 THEN regexp_extract(u, 'videos/([0-9]+)', 1) END AS video_id,
  CASE page_id % 6 WHEN 0 THEN 'youtube' WHEN 1 THEN 'youtube' WHEN 2 THEN 'twitter' WHEN 3 THEN 'facebook' END AS platform FROM urls""")
def x1(spark, d):
    return clip_urls(spark, d).select("page_id", tx.url_parts(F.col("u")).alias("_p")).select("page_id", "_p.*")


_WORDS = ["real", " Authentic", "GENUINE", "fake", "Tampered ", "uncertain", "1", "0", "false", "parody"]


@query("x2_label_texts", f"""WITH w AS (SELECT p_partkey, list_extract({_WORDS!r}, CAST(p_partkey % 10 AS INTEGER) + 1) AS word FROM part)
SELECT p_partkey, CASE WHEN lower(trim(word)) IN ('real', 'authentic', 'genuine', '0', 'false') THEN 0
  WHEN lower(trim(word)) IN ('fake', 'manipulated', 'tampered', '1', 'true') THEN 1 END AS label,
  CAST(trunc(p_partkey / 4.0::DOUBLE) AS INTEGER) AS number_label FROM w""")
def x2(spark, d):
    words = F.array(*[F.lit(w) for w in _WORDS])
    return t.load(spark, d, "part").select(
        "p_partkey", tx.label_from_text(F.get(words, (F.col("p_partkey") % 10).cast("int"))).alias("label"),
        tx.label_from_number(F.col("p_partkey") / 4.0).alias("number_label"))


@query("x3_boolean_texts", """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n,
  bool_or(lower(CASE WHEN l_linenumber = 1 THEN 'Yes' WHEN l_linenumber = 2 THEN 'TRUE' WHEN l_linenumber = 3 THEN '1'
    WHEN l_linenumber = 4 THEN 't' ELSE l_returnflag END) IN ('true', '1', 'yes', 't')) AS flag
FROM lineitem GROUP BY 1, 2, 3""")
def x3(spark, d):
    word = F.when(F.col("l_linenumber") == 1, "Yes").when(F.col("l_linenumber") == 2, "TRUE") \
        .when(F.col("l_linenumber") == 3, "1").when(F.col("l_linenumber") == 4, "t").otherwise(F.col("l_returnflag"))
    return t.load(spark, d, "lineitem").withColumn("flag", tx.bool_from_text(word)) \
        .groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.bool_or("flag").alias("flag"))


_PATHS = """paths AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'set/' || url || '/video.mp4' WHEN 1 THEN 'clip ' || page_id || '.mp4'
  WHEN 2 THEN 'a/b c+' || page_id || '/x.y_é.mp4' ELSE url END AS path FROM pages)"""


def odd_paths(spark, d):
    p, k = t.load(spark, d, "pages"), F.col("page_id")
    i = k.cast("string")
    return p.select("page_id", F.when(k % 4 == 0, F.concat(F.lit("set/"), F.col("url"), F.lit("/video.mp4")))
                    .when(k % 4 == 1, F.concat(F.lit("clip "), i, F.lit(".mp4")))
                    .when(k % 4 == 2, F.concat(F.lit("a/b c+"), i, F.lit("/x.y_é.mp4"))).otherwise(F.col("url")).alias("path"))


@query("x4_clip_ids", rf"""WITH {_PATHS}, parts AS (
  SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS p FROM paths)
SELECT page_id, regexp_replace(CASE WHEN len(p) >= 2 THEN p[len(p) - 1] ELSE substr(md5(path), 1, 12) END,
  '[^\p{{L}}\p{{N}}_-]', '_', 'g') AS clip FROM parts""")
def x4(spark, d):
    return odd_paths(spark, d).select("page_id", tx.clip_id(F.col("path")).alias("clip"))


@query("x5_clean_names", rf"""WITH {_PATHS} SELECT page_id, regexp_replace(path, '[^\p{{L}}\p{{N}}_-]', '_', 'g') AS strict,
  regexp_replace(path, '[^\p{{L}}\p{{N}}_.-]', '_', 'g') AS with_dots FROM paths""")
def x5(spark, d):
    return odd_paths(spark, d).select("page_id", tx.sanitize(F.col("path")).alias("strict"),
                                      tx.sanitize(F.col("path"), "-_.").alias("with_dots"))


_NAMES = """names AS (SELECT o_orderkey, CASE o_orderkey % 6
  WHEN 0 THEN 'out/Clip' || o_orderkey || '_aug' || (o_orderkey % 10) || '_scaled_aug' || (o_orderkey % 10) || '.mp4'
  WHEN 1 THEN 'out/Clip' || o_orderkey || '_original.mp4' WHEN 2 THEN 'out/Clip' || o_orderkey || '_augX.mp4'
  WHEN 3 THEN 'set/ID' || o_orderkey || '/video.mp4' WHEN 4 THEN 'Clip' || o_orderkey || '_aug' || (o_orderkey % 12) || '.v2.mp4'
  ELSE 'out/Clip' || o_orderkey || '_aug' || (o_orderkey % 12) || '.mp4' END AS path FROM orders)"""


def clip_names(spark, d):
    o, k = t.load(spark, d, "orders"), F.col("o_orderkey")
    i = k.cast("string")

    def mod(n):
        return (k % n).cast("string")

    head = F.concat(F.lit("out/Clip"), i)
    return o.select("o_orderkey", F.when(k % 6 == 0, F.concat(head, F.lit("_aug"), mod(10), F.lit("_scaled_aug"), mod(10), F.lit(".mp4")))
                    .when(k % 6 == 1, F.concat(head, F.lit("_original.mp4"))).when(k % 6 == 2, F.concat(head, F.lit("_augX.mp4")))
                    .when(k % 6 == 3, F.concat(F.lit("set/ID"), i, F.lit("/video.mp4")))
                    .when(k % 6 == 4, F.concat(F.lit("Clip"), i, F.lit("_aug"), mod(12), F.lit(".v2.mp4")))
                    .otherwise(F.concat(head, F.lit("_aug"), mod(12), F.lit(".mp4"))).alias("path"))


@query("x6_match_keys", f"""WITH {_NAMES} SELECT o_orderkey, lower(CASE o_orderkey % 6
  WHEN 0 THEN 'clip' || o_orderkey || '_aug' || (o_orderkey % 10) WHEN 1 THEN 'clip' || o_orderkey || '_original'
  WHEN 2 THEN 'clip' || o_orderkey WHEN 3 THEN 'id' || o_orderkey WHEN 4 THEN 'clip' || o_orderkey
  ELSE 'clip' || o_orderkey || '_aug' || (o_orderkey % 12) END) AS match_key FROM names""")
def x6(spark, d):
    return clip_names(spark, d).select("o_orderkey", tx.match_key(F.col("path")).alias("match_key"))


@query("x7_path_candidates", f"""WITH {MANIFEST}, p AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN video_path ELSE substr(video_path, 8) END AS v FROM manifest)
SELECT doc_id, 0 AS pos, '/data/videos/' || v AS path FROM p UNION ALL SELECT doc_id, 1, '/data/' || v FROM p
UNION ALL SELECT doc_id, 2, '/data/' || substr(v, 8) FROM p WHERE v LIKE 'videos/%'""")
def x7(spark, d):
    v = F.when(F.col("doc_id") % 2 == 0, F.col("video_path")).otherwise(F.substring(F.col("video_path"), 8, 1 << 30))
    return t.manifest(spark, d).select("doc_id", F.posexplode(tx.path_candidates(v, "/data")).alias("pos", "path"))


@query("x8_scaled_names", f"""WITH {STAGE1} SELECT video_path, regexp_replace(regexp_replace(video_path, '^.*/', ''), '\\.mp4$', '')
  || CASE WHEN is_original THEN '_scaled_original.mp4' ELSE '_scaled_aug' || augmentation_idx || '.mp4' END AS scaled_name FROM stage1""")
def x8(spark, d):
    return t.stage1(t.manifest(spark, d)).select(
        "video_path", tx.scaled_name(F.col("video_path"), F.col("augmentation_idx"), F.col("is_original")).alias("scaled_name"))


@query("x9_name_parts", f"""WITH {_NAMES} SELECT o_orderkey,
  CASE WHEN o_orderkey % 6 IN (1, 5) THEN 'Clip' || o_orderkey END AS video_id,
  CAST(CASE o_orderkey % 6 WHEN 1 THEN -1 WHEN 5 THEN o_orderkey % 12 END AS INTEGER) AS augmentation_idx,
  CASE o_orderkey % 6 WHEN 1 THEN true WHEN 5 THEN false END AS is_original FROM names""")
def x9(spark, d):
    # a scaled clip's second part is not a number, so it is no stage-1 file
    stems = clip_names(spark, d).select("o_orderkey", tx.stem(F.col("path")).alias("_s"))
    return stems.select("o_orderkey", tx.augmented_name_parts(F.col("_s")).alias("_p")).select(
        "o_orderkey", "_p.video_id", "_p.augmentation_idx", "_p.is_original")


@query("x10_seeds", f"""WITH {MANIFEST} SELECT doc_id, CAST('0x' || substr(md5(video_path), 1, 8) AS BIGINT) % 2147483648 AS seed,
  CAST('0x' || substr(md5(video_path), 1, 8) AS BIGINT) % 2147483648 + 1000 * (doc_id % 3) AS chunk_seed FROM manifest""")
def x10(spark, d):
    return t.manifest(spark, d).select("doc_id", hs.seed_of(F.col("video_path")).alias("seed"),
                                       hs.seed_of(F.col("video_path"), (F.col("doc_id") % 3) * 1000).alias("chunk_seed"))


@query("x11_cache_keys", f"""WITH {MANIFEST} SELECT doc_id, md5(video_path || ':' || frame_count) AS file_key,
  md5(video_path || ':' || frame_count || ':8:42') AS frames_key FROM manifest""")
def x11(spark, d):
    return t.manifest(spark, d).select(
        "doc_id", hs.file_key(F.col("video_path"), F.col("frame_count")).alias("file_key"),
        hs.frames_key(F.col("video_path"), F.col("frame_count"), F.lit(8), F.lit(42)).alias("frames_key"))


@query("x12_config_hashes", """SELECT o_orderkey, substr(sha256('{"batch": ' || (o_custkey % 8) || ', "model": "' || o_orderpriority ||
  '", "rate": "' || o_orderstatus || '"}'), 1, 16) AS config_hash FROM orders""")
def x12(spark, d):
    runs = t.load(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("rate"),
                                             F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 8).alias("batch"))
    return runs.select("o_orderkey", hs.config_hash(runs, ["run_id", "rate", "model", "batch"]).alias("config_hash"))


@query("x14_adaptive_frames", f"""WITH {MANIFEST} SELECT doc_id, CAST(CASE WHEN frame_count > 0
  THEN greatest(5, least(50, CAST(floor(frame_count * 0.1::DOUBLE) AS INTEGER))) ELSE 5 END AS INTEGER) AS frames FROM manifest""")
def x14(spark, d):
    return t.manifest(spark, d).select("doc_id", nu.adaptive_frames(F.col("frame_count")).alias("frames"))


@query("x15_letterbox", f"""WITH {MANIFEST}, s AS (SELECT doc_id, width, height, least(224.0::DOUBLE / width, 224.0::DOUBLE / height) AS k FROM manifest),
n AS (SELECT doc_id, CAST(floor(width * k) AS INTEGER) AS new_width, CAST(floor(height * k) AS INTEGER) AS new_height FROM s)
SELECT doc_id, new_width, new_height, CAST((224 - new_width) // 2 AS INTEGER) AS paste_x, CAST((224 - new_height) // 2 AS INTEGER) AS paste_y FROM n""")
def x15(spark, d):
    box = nu.letterbox(F.col("width"), F.col("height"))
    return t.manifest(spark, d).select("doc_id", *[c.alias(n) for n, c in box.items()])


@query("p12_scaling_flags", f"WITH {SCALED} SELECT doc_id, is_upscaled, is_downscaled FROM scaled")
def p12(spark, d):
    return t.scaled(t.manifest(spark, d)).select("doc_id", "is_upscaled", "is_downscaled")


@query("x20_display_names", """SELECT l_linenumber, l_returnflag, 'Model ' || upper(l_returnflag) || ' Stage ' || l_linenumber AS name, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def x20(spark, d):
    raw = F.concat(F.lit("model_"), F.lower("l_returnflag"), F.lit("_stage_"), F.col("l_linenumber").cast("string"))
    return t.load(spark, d, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("name", tx.display_name(raw))


@query("x21_label_index", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS idx FROM orders")
def x21(spark, d):
    from vidspark.operators.models import label_index
    return label_index(t.load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "idx") \
        .select("o_orderkey", "idx")


@query("x22_chunks", f"""WITH {MANIFEST} SELECT doc_id, CAST(i AS INTEGER) AS chunk, i * 250 AS first, least((i + 1) * 250, frame_count) AS "end"
FROM (SELECT doc_id, frame_count, unnest(range(0, CAST(ceil(frame_count / 250.0::DOUBLE) AS BIGINT))) AS i FROM manifest)""")
def x22(spark, d):
    return t.manifest(spark, d).select("doc_id", F.explode(ar.chunks(F.col("frame_count"), 250)).alias("_c")).select("doc_id", "_c.*")


@query("p9_error_classes", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'empty'
  WHEN 3 THEN 'empty' ELSE 'other' END AS error_class FROM events""")
def p9(spark, d):
    k = F.col("event_id") % 5
    message = F.when(k == 0, "Moov atom not found").when(k == 1, F.concat(F.lit("file is CORRUPTED: "), F.col("event_type"))) \
        .when(k == 2, "Video has no frames").when(k == 3, F.concat(F.lit("Empty "), F.col("event_type")))
    return t.load(spark, d, "events").select("event_id", tx.error_class(message).alias("error_class"))


@query("y1_even_indices", f"""WITH {MANIFEST}, n AS (SELECT doc_id, frame_count AS total, CAST(greatest(5, least(50, CAST(floor(frame_count * 0.1::DOUBLE) AS INTEGER))) AS INTEGER) AS k
  FROM manifest WHERE frame_count > 0),
i AS (SELECT doc_id, total, k, unnest(range(0, k)) AS i FROM n)
SELECT m.doc_id, CAST(i AS INTEGER) AS pos, CAST(CASE WHEN i = k - 1 THEN total - 1
  ELSE floor(i::DOUBLE * ((total::DOUBLE - 1) / (k - 1)::DOUBLE)) END AS INTEGER) AS frame_idx FROM manifest m LEFT JOIN i USING (doc_id)""")
def y1(spark, d):
    """Clips without frames stay, without an index."""
    picked = ar.even_indices(F.col("frame_count"), nu.adaptive_frames(F.col("frame_count")))
    return t.manifest(spark, d).select("doc_id", F.posexplode_outer(picked).alias("pos", "frame_idx"))


@query("y2_step_indices", f"""WITH {MANIFEST}, i AS (SELECT doc_id, frame_count AS total, unnest(range(0, 300)) AS i FROM manifest WHERE frame_count > 0)
SELECT doc_id, CAST(i AS INTEGER) AS pos, CAST(CASE WHEN total <= 300 THEN i % total ELSE floor(total / 300.0::DOUBLE * i) END AS INTEGER) AS frame_idx FROM i""")
def y2(spark, d):
    return t.manifest(spark, d).select("doc_id", F.posexplode(ar.step_indices(F.col("frame_count"), 300)).alias("pos", "frame_idx"))


@query("w7_rolling_windows", f"""WITH {MANIFEST}, s AS (
  SELECT doc_id, frame_count AS n, unnest(CASE WHEN frame_count <= 64 THEN [0::BIGINT] ELSE
    list_concat(range(0, frame_count - 64 + 1, 32), CASE WHEN (frame_count - 64) % 32 <> 0 THEN [frame_count - 64] ELSE [] END) END) AS first
  FROM manifest WHERE frame_count > 0)
SELECT doc_id, CAST(first AS INTEGER) AS first, CAST(least(first + 64, n) AS BIGINT) AS "end" FROM s""")
def w7(spark, d):
    return t.manifest(spark, d).select("doc_id", "frame_count", F.explode(ar.window_starts(F.col("frame_count"), 64)).alias("first")) \
        .select("doc_id", "first", F.least(F.col("first") + 64, F.col("frame_count")).cast("bigint").alias("end"))


@query("y3_fixed_length", """WITH v AS (SELECT vec_id, embedding[1:CAST(40 + vec_id % 30 AS INTEGER)] AS e FROM embeddings)
SELECT vec_id, 48 AS len, round(list_sum(list_transform(list_resize(e, 48, 0.0::FLOAT), lambda x: x::DOUBLE)), 6) AS total,
  round(coalesce(e[48], 0)::DOUBLE, 6) AS last FROM v""")
def y3(spark, d):
    v = F.transform(F.slice("embedding", F.lit(1), (F.lit(40) + F.col("vec_id") % 30).cast("int")), lambda x: x.cast("double"))
    fixed = t.load(spark, d, "embeddings").select("vec_id", ar.fit_length(v, 48).alias("e"))
    return fixed.select("vec_id", F.size("e").alias("len"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                        F.round(F.get("e", F.lit(47)), 6).alias("last"))


def _draw(seed: str) -> str:
    """The number in [0, 1) that belongs to a text, in SQL."""
    return f"(CAST('0x' || substr(md5({seed}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@query("y4_sequence_changes", f"""WITH {MANIFEST}, s AS (SELECT doc_id, video_path AS p, CASE WHEN frame_count > 0 THEN
    [CASE WHEN frame_count <= 16 THEN i % frame_count ELSE CAST(floor(frame_count / 16.0::DOUBLE * i) AS BIGINT) END FOR i IN range(16)]
    ELSE [] END AS seq FROM manifest),
lose AS (SELECT *, 1 + CAST(floor({_draw("'drop-n-' || p")} * greatest(1, len(seq) // 4)) AS BIGINT) AS n FROM s),
ranked AS (SELECT *, CASE WHEN {_draw("'drop?-' || p")} < 0.5 THEN
    list_sort([{{'h': md5('drop-' || p || '-' || i), 'i': i}} FOR i IN range(len(seq))])[1:n] ELSE [] END AS lost FROM lose),
kept AS (SELECT *, [seq[i + 1] FOR i IN range(len(seq)) IF NOT list_contains([x.i FOR x IN lost], i)] AS k FROM ranked),
twice AS (SELECT *, CASE WHEN {_draw("'dup?-' || p")} < 0.5 THEN
    flatten([CASE WHEN {_draw("'dup-' || p || '-' || i")} < 0.3 THEN [k[i + 1], k[i + 1]] ELSE [k[i + 1]] END FOR i IN range(len(k))])
    ELSE k END AS d FROM kept)
SELECT doc_id, array_to_string(seq, ',') AS before,
  array_to_string(CASE WHEN {_draw("'rev?-' || p")} < 0.5 THEN list_reverse(d) ELSE d END, ',') AS after FROM twice""")
def y4(spark, d):
    """Clips without frames have nothing to change."""
    seq = ar.step_indices(F.col("frame_count"), 16)
    changed = ar.reverse_some(ar.repeat_some(ar.drop_some(seq, F.col("video_path"), 0.5), F.col("video_path"), 0.5),
                              F.col("video_path"), 0.5)
    return t.manifest(spark, d).select("doc_id", joined(seq).alias("before"), joined(changed).alias("after"))


@query("y5_vector_norms", """SELECT vec_id, round(CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS norm FROM (
  SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)""")
def y5(spark, d):
    return t.load(spark, d, "embeddings").select("vec_id", F.round(ar.l2_norm(F.col("embedding")), 6).alias("norm"))


_PROBE = """p AS (SELECT o_orderkey AS k, o_custkey * 10 AS rate, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 600 AS DOUBLE) END AS duration,
  CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 30000.0::DOUBLE / 1001 ELSE 25.0::DOUBLE END AS fps
  FROM orders)"""


@query("y6_probe_columns", f"""WITH {_PROBE} SELECT k AS video_id, CAST(k % 1920 + 1 AS INTEGER) AS width, CAST(k % 1080 + 1 AS INTEGER) AS height,
  round(fps, 6) AS fps, CASE WHEN k % 3 = 0 THEN k % 900 WHEN duration <> 0 AND fps <> 0 THEN CAST(floor(duration * fps) AS BIGINT) END AS frame_count,
  duration AS duration_sec, 'h264' AS codec_name, rate AS total_bitrate, k AS file_size_bytes, 'yuv420p' AS pixel_format FROM p""")
def y6(spark, d):
    cols = pr.probe_columns(F.col("probe"))
    keep = ["width", "height", "fps", "frame_count", "duration_sec", "codec_name", "total_bitrate", "file_size_bytes", "pixel_format"]
    return t.probe_texts(spark, d).select("video_id", *[cols[c].alias(c) for c in keep]).withColumn("fps", F.round("fps", 6))


@query("y7_codec_cues", """SELECT event_id, 0.0::DOUBLE AS codec_bitrate, 30.0::DOUBLE AS codec_fps, 0.0::DOUBLE AS codec_resolution FROM events
UNION ALL SELECT -1 - o_orderkey, CAST(o_custkey AS DOUBLE), CASE WHEN o_orderkey % 5 = 0 THEN 30.0::DOUBLE ELSE 24.0::DOUBLE END,
  CAST((o_orderkey % 1920 + 1) * (o_orderkey % 1080 + 1) AS DOUBLE) FROM orders""")
def y7(spark, d):
    events = t.load(spark, d, "events").select("event_id", F.col("props").alias("probe"))
    k = F.col("o_orderkey")
    good = t.load(spark, d, "orders").select((-1 - k).alias("event_id"), F.concat(
        F.lit('{"streams": [{"bit_rate": "'), F.col("o_custkey").cast("string"), F.lit('", "width": '), (k % 1920 + 1).cast("string"),
        F.lit(', "height": '), (k % 1080 + 1).cast("string"), F.lit(', "r_frame_rate": "'),
        F.when(k % 5 == 0, "30/0").otherwise("24/1"), F.lit('"}]}')).alias("probe"))
    cues = pr.codec_cues(F.col("probe"))
    return events.unionByName(good).select("event_id", *[c.alias(n) for n, c in cues.items()])


@query("x19_rates", f"""WITH {_PROBE} SELECT k AS video_id, CAST(round(fps * 1000, 0) AS BIGINT) AS mhz FROM p""")
def x19(spark, d):
    stream = F.get(F.from_json("probe", pr.PROBE_SCHEMA)["streams"], F.lit(1))
    return t.probe_texts(spark, d).select("video_id", F.round(nu.rate(stream["r_frame_rate"]) * 1000, 0).cast("bigint").alias("mhz"))


@query("y9_records", """SELECT l_orderkey, l_partkey, l_quantity, '{"n":' || l_linenumber || ',"flag":"' || l_returnflag || '"}' AS record FROM lineitem""")
def y9(spark, d):
    return t.load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.to_json(F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"))).alias("record"))


@query("y10_augmentation_plans", f"""WITH {STAGE1} SELECT video_path, string_agg(kind, ',' ORDER BY idx) AS plan FROM plans GROUP BY video_path""")
def y10(spark, d):
    return t.manifest(spark, d).select("video_path", joined(ar.augmentation_plan(hs.seed_of(F.col("video_path")), 10)).alias("plan"))


@query("y10_cycled_plans", f"""WITH {MANIFEST} SELECT video_path, 'rotation,flip,brightness,contrast,saturation,gaussian_noise,gaussian_blur,affine,elastic,cutout,rotation,flip' AS plan FROM manifest""")
def y10b(spark, d):
    return t.manifest(spark, d).select("video_path", joined(ar.augmentation_plan(hs.seed_of(F.col("video_path")), 12)).alias("plan"))


@query("y11_augmentation_manifest", f"""WITH {STAGE1} SELECT video_path, label, original_video, augmentation_idx, is_original, augmentation_type, seed FROM stage1""")
def y11(spark, d):
    return t.stage1(t.manifest(spark, d)).drop("width", "height")


@query("p11_no_op_augmentation", f"""WITH {MANIFEST} SELECT video_path, label, video_path AS original_video, 0 AS augmentation_idx FROM manifest""")
def p11(spark, d):
    return t.manifest(spark, d).select("video_path", "label", F.col("video_path").alias("original_video"), F.lit(0).alias("augmentation_idx"))
