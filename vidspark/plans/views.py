"""The views of vidspark.tables once more, as SQL over the raw tables, for the checks."""

MANIFEST = """manifest AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS video_id,
         'videos/' || d.source || '/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR) || '/video.mp4' AS video_path,
         d.source AS subset, d.lang AS platform, l.quality AS label, d.n_chars AS frame_count,
         CAST(320 + (d.doc_id * 37) % 1601 AS INTEGER) AS width, CAST(240 + (d.doc_id * 53) % 1001 AS INTEGER) AS height,
         CAST(24 + d.doc_id % 7 AS DOUBLE) AS fps, d.n_chars / CAST(24 + d.doc_id % 7 AS DOUBLE) AS duration_sec
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

COPIES = """copies AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS video_id, md5(text) AS dup_group FROM documents
  WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1))"""

_TYPES = ["rotation", "flip", "brightness", "contrast", "saturation", "gaussian_noise", "gaussian_blur", "affine",
          "elastic", "cutout"]
STAGE1 = MANIFEST + """, seeds AS (
  SELECT *, CAST('0x' || substr(md5(video_path), 1, 8) AS BIGINT) % 2147483648 AS base_seed FROM manifest),
plans AS (
  SELECT video_path, t.kind, row_number() OVER (PARTITION BY video_path
         ORDER BY md5(CAST(base_seed AS VARCHAR) || '-' || t.kind)) - 1 AS idx
  FROM seeds, (SELECT unnest([""" + ", ".join(f"'{t}'" for t in _TYPES) + """]) AS kind) t),
stage1 AS (
  SELECT 'augmented/' || s.video_id || CASE WHEN i.idx < 0 THEN '_original' ELSE '_aug' || CAST(i.idx AS VARCHAR) END
         || '.mp4' AS video_path, s.label, s.video_path AS original_video, CAST(i.idx AS INTEGER) AS augmentation_idx,
         i.idx < 0 AS is_original, p.kind AS augmentation_type,
         CASE WHEN i.idx >= 0 THEN s.base_seed + i.idx END AS seed, s.width, s.height
  FROM seeds s CROSS JOIN (SELECT unnest(range(-1, 10)) AS idx) i
  LEFT JOIN plans p ON p.video_path = s.video_path AND p.idx = i.idx)"""

SCALED = MANIFEST + """, sized AS (
  SELECT *, CAST(floor(width * least(640.0::DOUBLE / width, 640.0::DOUBLE / height)) AS INTEGER) AS scaled_width,
         CAST(floor(height * least(640.0::DOUBLE / width, 640.0::DOUBLE / height)) AS INTEGER) AS scaled_height
  FROM manifest),
scaled AS (
  SELECT *, width AS original_width, height AS original_height,
         CASE WHEN greatest(scaled_width, scaled_height) > greatest(width, height) THEN 1 ELSE 0 END AS is_upscaled,
         CASE WHEN greatest(scaled_width, scaled_height) < greatest(width, height) THEN 1 ELSE 0 END AS is_downscaled
  FROM sized)"""

CORPUS = """corpus AS (
  SELECT o_orderkey AS video_id, o_orderstatus AS label, o_orderpriority AS platform, o_custkey AS dup_group
  FROM orders)"""

SCORED = """scored AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y_true, l_quantity / 50.0::DOUBLE AS p1,
         CAST(l_quantity / 50.0::DOUBLE > 0.5 AS INTEGER) AS y_pred, l_discount * 10.0::DOUBLE AS p_alt FROM lineitem)"""

FOLDS = """folds AS (
  SELECT event_type AS model, CAST(user_id % 5 AS INTEGER) AS fold, avg(value) / 500.0::DOUBLE AS val_acc,
         stddev_pop(value) / 100.0::DOUBLE AS val_loss,
         CASE WHEN CAST(user_id % 5 AS INTEGER) = 3 AND event_type = 'click' THEN 'NaN'::DOUBLE
              ELSE avg(value) / 600.0::DOUBLE END AS val_f1
  FROM events GROUP BY event_type, user_id % 5)"""

LOG = """log AS (
  SELECT 'run' || CAST(user_id AS VARCHAR) AS run_id, event_id AS step, CAST(event_id % 20 AS INTEGER) AS epoch,
         CASE WHEN event_id % 3 = 0 THEN 'train' ELSE 'val' END AS phase, event_type AS metric, value FROM events)"""

STAGE2 = """stage2 AS (
  SELECT 'features/' || CAST(l_orderkey AS VARCHAR) || '_aug1.mp4' AS video_path, l_orderkey AS seq,
         avg(l_quantity) AS quantity, avg(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax,
         CAST(count(*) AS DOUBLE) AS lines, avg(l_extendedprice) * 2.0::DOUBLE + avg(l_tax) AS price_twice,
         1.0::DOUBLE AS constant
  FROM lineitem GROUP BY l_orderkey)"""

STAGE4 = """stage4 AS (
  SELECT 'scaled/' || CAST(o_orderkey AS VARCHAR) || '_aug1_scaled_aug1.mp4' AS video_path, o_orderkey AS seq,
         o_totalprice AS total, CAST(o_custkey % 97 AS DOUBLE) AS customer FROM orders)"""

TARGETS = """targets AS (
  SELECT 'clips/' || CAST(o_orderkey AS VARCHAR) || '_Aug1.mp4' AS video_path, o_orderkey AS id,
         CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders)"""

# Frames once more from the text's bytes in hex: three bytes a pixel, 576 pixels a frame, zeros after the end. Neighbours
# come from windows along rows (r) and columns (c); at a border the inner neighbour stands in for the missing one.
GRAY = """padded AS (
  SELECT doc_id AS video_id, rpad(h, CAST(ceil(length(h) / 3456.0::DOUBLE) * 3456 AS INTEGER), '0') AS h
  FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents) WHERE length(h) > 0),
pieces AS (SELECT video_id, unnest(regexp_extract_all(h, '.{6}')) AS p, unnest(range(length(h) // 6)) AS i FROM padded),
pixels AS (SELECT video_id, CAST(i // 576 AS INTEGER) AS frame_idx, i % 576 // 24 AS y, i % 24 AS x,
  CAST('0x' || substr(p, 1, 2) AS BIGINT) AS red, CAST('0x' || substr(p, 3, 2) AS BIGINT) AS green,
  CAST('0x' || substr(p, 5, 2) AS BIGINT) AS blue FROM pieces),
gray AS (SELECT *, (299 * red + 587 * green + 114 * blue + 500) // 1000 AS v FROM pixels)"""

NEIGHBOURS = GRAY + """, across AS (SELECT *,
  coalesce(lag(v) OVER r, lead(v) OVER r) AS lf, coalesce(lead(v) OVER r, lag(v) OVER r) AS rt,
  coalesce(lag(v, 2) OVER r, CASE WHEN x = 0 THEN lead(v, 2) OVER r ELSE v END) AS lf2,
  coalesce(lead(v, 2) OVER r, CASE WHEN x = 23 THEN lag(v, 2) OVER r ELSE v END) AS rt2
  FROM gray WINDOW r AS (PARTITION BY video_id, frame_idx, y ORDER BY x)),
sums AS (SELECT *, lf + v + rt AS s3, lf + v + rt + lf2 + rt2 AS s5, rt - lf AS dx, lf + 2 * v + rt AS wx FROM across),
kernels AS (SELECT *,
  9 * v - (coalesce(lag(s3) OVER c, lead(s3) OVER c) + s3 + coalesce(lead(s3) OVER c, lag(s3) OVER c)) AS noise,
  lf + rt + coalesce(lag(v) OVER c, lead(v) OVER c) + coalesce(lead(v) OVER c, lag(v) OVER c) - 4 * v AS lap,
  coalesce(lag(dx) OVER c, lead(dx) OVER c) + 2 * dx + coalesce(lead(dx) OVER c, lag(dx) OVER c) AS gx,
  coalesce(lead(wx) OVER c, lag(wx) OVER c) - coalesce(lag(wx) OVER c, lead(wx) OVER c) AS gy,
  coalesce(lag(s5, 2) OVER c, CASE WHEN y = 0 THEN lead(s5, 2) OVER c ELSE s5 END) + coalesce(lag(s5) OVER c, lead(s5) OVER c) + s5
    + coalesce(lead(s5) OVER c, lag(s5) OVER c) + coalesce(lead(s5, 2) OVER c, CASE WHEN y = 23 THEN lag(s5, 2) OVER c ELSE s5 END) AS s25
  FROM sums WINDOW c AS (PARTITION BY video_id, frame_idx, x ORDER BY y)),
simple AS (SELECT video_id, frame_idx, CAST(sum(noise * noise) AS DOUBLE) AS noise_energy, avg(noise * noise) AS noise_mean,
  stddev_pop(noise * noise) AS noise_std, var_pop(lap) AS laplacian_var, avg(sqrt(gx * gx + gy * gy)) AS gradient_mean,
  stddev_pop(sqrt(gx * gx + gy * gy)) AS gradient_std,
  avg(CASE WHEN abs(gx) + abs(gy) > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS edge_density_grad,
  1.0::DOUBLE / (1.0::DOUBLE + stddev_pop(s25 / 25.0::DOUBLE)) AS texture_uniformity, stddev_pop(red) AS color_consistency_r,
  stddev_pop(green) AS color_consistency_g, stddev_pop(blue) AS color_consistency_b FROM kernels GROUP BY 1, 2)"""

BOUNDARY = GRAY + """, lines AS (SELECT video_id, frame_idx, stddev_pop(v) AS s FROM gray WHERE y IN (8, 16) GROUP BY 1, 2, y
  UNION ALL SELECT video_id, frame_idx, stddev_pop(v) FROM gray WHERE x IN (8, 16) GROUP BY 1, 2, x),
boundary AS (SELECT video_id, frame_idx, avg(s) AS boundary_inconsistency FROM lines GROUP BY 1, 2)"""

BLOCKS = """steps AS (SELECT *, x // 8 AS bx, y // 8 AS by_,
  CASE WHEN x % 8 > 0 THEN abs(v - lag(v) OVER (PARTITION BY video_id, frame_idx, y ORDER BY x)) END AS h,
  CASE WHEN y % 8 > 0 THEN abs(v - lag(v) OVER (PARTITION BY video_id, frame_idx, x ORDER BY y)) END AS w FROM gray),
per_block AS (SELECT video_id, frame_idx, avg(h) + avg(w) AS s FROM steps WHERE x < 16 AND y < 16 GROUP BY 1, 2, bx, by_),
blocks AS (SELECT video_id, frame_idx, sum(s) / 9.0::DOUBLE AS compression_artifacts FROM per_block GROUP BY 1, 2)"""

DCT = """basis AS (SELECT k, i, cos(pi() * k * (2 * i + 1) / 16) * sqrt(0.25::DOUBLE) * CASE WHEN k = 0 THEN sqrt(0.5::DOUBLE) ELSE 1.0::DOUBLE END AS m
  FROM range(8) a(k), range(8) b(i)),
half AS (SELECT video_id, frame_idx, y // 8 AS by_, x, k, sum(m * v) AS s FROM gray JOIN basis ON i = y % 8 GROUP BY ALL),
coeffs AS (SELECT video_id, frame_idx, by_, x // 8 AS bx, half.k AS u, b.k AS w, sum(b.m * s) AS c FROM half JOIN basis b ON b.i = half.x % 8 GROUP BY ALL),
dct AS (SELECT video_id, frame_idx, avg(c) FILTER (u = 0 AND w = 0) AS dct_dc_mean, stddev_pop(c) FILTER (u = 0 AND w = 0) AS dct_dc_std,
  avg(CASE WHEN u = 0 AND w = 0 THEN 0.0::DOUBLE ELSE c END) AS dct_ac_mean, stddev_pop(CASE WHEN u = 0 AND w = 0 THEN 0.0::DOUBLE ELSE c END) AS dct_ac_std,
  sum(CASE WHEN u = 0 AND w = 0 THEN 0.0::DOUBLE ELSE c * c END) AS dct_ac_energy FROM coeffs GROUP BY 1, 2)"""
