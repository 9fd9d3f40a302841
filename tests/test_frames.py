import numpy as np
import pytest

from vidspark.operators import frames as fr


HIGH_PASS = np.array([[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]])
LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])
SOBEL_X = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
BOX_5 = np.full((5, 5), 1 / 25)


def mirrored(i, n):
    if n == 1:
        return 0
    period = 2 * (n - 1)
    i = abs(i) % period
    return i if i < n else period - i


def slow_kernel(g, k):
    h, w = g.shape
    r = k.shape[0] // 2
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            out[y, x] = sum(k[a, b] * g[mirrored(y + a - r, h), mirrored(x + b - r, w)]
                            for a in range(2 * r + 1) for b in range(2 * r + 1))
    return out


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (8, 8), (9, 17), (24, 24)])
def test_kernels_by_hand(shape):
    g = np.random.default_rng(0).integers(0, 256, shape).astype(float)
    gx, gy = fr.sobel(g[None])
    pairs = [(fr.high_pass(g[None]), HIGH_PASS), (fr.laplace(g[None]), LAPLACE), (gx, SOBEL_X), (gy, SOBEL_X.T), (fr.box_5(g[None]), BOX_5)]
    for got, k in pairs:
        np.testing.assert_allclose(got[0], slow_kernel(g, k), atol=1e-9)


def test_features_by_hand():
    rgb = np.random.default_rng(1).integers(0, 256, (1, 19, 26, 3)).astype(np.uint8)
    got = dict(zip(fr.PIXEL_FEATURES, fr.pixel_features(rgb)[0]))
    g = ((rgb[0].astype(int) @ np.array([299, 587, 114]) + 500) // 1000).astype(float)
    noise = slow_kernel(g, HIGH_PASS) ** 2
    assert got["noise_energy"] == pytest.approx(noise.sum()) and got["noise_std"] == pytest.approx(noise.std())
    assert got["laplacian_var"] == pytest.approx(slow_kernel(g, LAPLACE).var())
    size = np.sqrt(slow_kernel(g, SOBEL_X) ** 2 + slow_kernel(g, SOBEL_X.T) ** 2)
    assert got["gradient_mean"] == pytest.approx(size.mean())
    spread = [g[8].std(), g[16].std(), g[:, 8].std(), g[:, 16].std(), g[:, 24].std()]
    assert got["boundary_inconsistency"] == pytest.approx(np.mean(spread))
    assert got["texture_uniformity"] == pytest.approx(1 / (1 + slow_kernel(g, BOX_5).std()))
    assert got["color_consistency_g"] == pytest.approx(rgb[0, :, :, 1].std())
    blocks = 0.0
    for i in range(0, 19 - 8, 8):
        for j in range(0, 26 - 8, 8):
            b = g[i:i + 8, j:j + 8]
            blocks += np.abs(np.diff(b, axis=1)).mean() + np.abs(np.diff(b, axis=0)).mean()
    assert got["compression_artifacts"] == pytest.approx(blocks / ((19 // 8) * (26 // 8)))


def test_dct_by_hand():
    g = np.random.default_rng(2).integers(0, 256, (1, 11, 8)).astype(float)
    p = np.pad(g[0], ((0, 5), (0, 0)), mode="edge")
    dc, ac = [], []
    for i in (0, 8):
        b = p[i:i + 8]
        c = np.zeros((8, 8))
        for u in range(8):
            for v in range(8):
                s = sum(b[x, y] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
                        for x in range(8) for y in range(8))
                c[u, v] = s / 4 * (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1)
        dc.append(c[0, 0])
        c[0, 0] = 0
        ac.append(c)
    want = [np.mean(dc), np.std(dc), np.mean(ac), np.std(ac), np.sum(np.square(ac))]
    np.testing.assert_allclose([x[0] for x in fr.dct_statistics(g)], want, atol=1e-8)


def test_uniform_frame_has_no_energy():
    got = dict(zip(fr.PIXEL_FEATURES, fr.pixel_features(np.full((1, 16, 16, 3), 128, np.uint8))[0]))
    assert got["noise_energy"] == 0 and got["laplacian_var"] == 0 and got["dct_ac_energy"] == pytest.approx(0, abs=1e-12)
    assert got["texture_uniformity"] == pytest.approx(1.0)


def test_broken_frames_have_no_features(spark):
    from pyspark.sql import functions as F
    rows = [(1, 8, 8, bytes(192)), (2, 8, 8, bytes(5)), (3, None, 8, bytes(192)), (4, 8, 8, None)]
    df = spark.createDataFrame(rows, "k long, h int, w int, pixels binary")
    out = {r[0]: r[1] for r in fr.frame_features(df, ["k"]).select("k", "noise_energy").collect()}
    assert out == {1: 0.0, 2: None, 3: None, 4: None}
    cues = df.select(F.col("k").alias("video_id"))
    cues = cues.withColumns({c: F.lit(1.0) for c in fr.CODEC_FEATURES})
    clips = {r[0]: r[1] for r in fr.clip_features(df.withColumnRenamed("k", "video_id"), cues).select(
        "video_id", "noise_energy").collect()}
    assert set(clips) == {1, 2, 3, 4} and None not in clips.values()


def test_letterbox():
    rgb = np.full((1, 10, 40, 3), 200, np.uint8)
    out = fr.letterboxed(rgb, 20)[0]
    assert out.shape == (20, 20, 3) and (out[:7] == 0).all() and (out[12:] == 0).all() and (out[7:12] == 200).all()
    halves = np.repeat(np.repeat(np.arange(16, dtype=np.uint8).reshape(4, 4), 2, 0), 2, 1)
    small = fr.letterboxed(np.stack([halves] * 3, -1)[None], 4)[0, :, :, 0]
    assert (small == np.arange(16).reshape(4, 4)).all()


def test_sizes_may_mix(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        h, w = int(rng.integers(1, 20)), int(rng.integers(1, 20))
        rows.append((i % 5, i, h, w, bytearray(rng.integers(0, 256, h * w * 3).astype(np.uint8).tobytes())))
    df = spark.createDataFrame(rows, "video_id long, frame_idx int, h int, w int, pixels binary")
    got = {r["frame_idx"]: r for r in fr.frame_features(df, ["video_id", "frame_idx"]).collect()}
    for vid, i, h, w, px in rows:
        want = fr.pixel_features(np.frombuffer(bytes(px), np.uint8).reshape(1, h, w, 3))[0]
        np.testing.assert_allclose([got[i][c] for c in fr.PIXEL_FEATURES], want)
