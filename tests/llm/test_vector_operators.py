import hashlib

import numpy as np
import pytest

from vidspark.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, part string"


def table(spark, values, labels=None):
    labels = labels or [i % 3 for i in range(len(values))]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], label, 0, "p")
            for i, (v, label) in enumerate(zip(values, labels))]
    return spark.createDataFrame(rows, SCHEMA)


def write(df, folder):
    df.write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def brute_codes(ids, x, parts=16, entries=64, rounds=2):
    """Python whole numbers, one vector at a time."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i], x[i]))
    cuts = vector_codes.part_slices(len(x[0]), parts)
    books = [[x[i][c] for i in order[:entries]] for c in cuts]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, c in enumerate(cuts):
            of = [nearest(v[c], books[p])[1] for v in x]
            for k in set(of):
                mine = [v[c] for v, o in zip(x, of) if o == k]
                books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    best = [[nearest(v[c], books[p]) for p, c in enumerate(cuts)] for v in x]
    text = ",".join(str(n) for book in books for e in book for n in e)
    return ["".join(f"{k:02x}" for _, k in b) for b in best], [sum(d for d, _ in b) for b in best], text


@pytest.mark.parametrize("size,scale,rows", [(32, 1.0, 150), (35, 900.0, 90), (16, 30000.0, 70), (5, 1.0, 40)])
def test_codes_equal_brute_force(spark, tmp_path, size, scale, rows):
    values = np.round(np.random.default_rng(size).standard_normal((rows, size)) * scale, 1).astype(np.float32)
    values[1] = values[0]  # equal entries: ties go to the lower index
    got = {r["vec_id"]: r for r in vector_codes.query(spark, write(table(spark, values.tolist()), tmp_path)).collect()}
    x = [[int(v) for v in np.floor(256 * row.astype(np.float64))] for row in values]
    codes, errors, text = brute_codes(list(range(rows)), x)
    assert [got[i]["code"] for i in range(rows)] == codes
    assert [got[i]["error"] for i in range(rows)] == errors
    assert {r["codebooks_sha256"] for r in got.values()} == {hashlib.sha256(text.encode()).hexdigest()}
    for label in range(3):
        assert {got[i]["label_error"] for i in range(label, rows, 3)} == {sum(errors[label::3])}


def test_products_of_limbs_are_exact():
    draw = np.random.default_rng(1)
    for bits, inner in ((8, 4), (26, 4), (27, 64), (29, 1), (20, 4096), (0, 3)):
        a, b = (draw.integers(-(1 << bits), (1 << bits) + 1, (7, inner)) for _ in range(2))
        assert (vector_codes.exact_products(a, b) == (a.astype(object) @ b.T.astype(object)).astype(np.int64)).all()


def test_codes_of_odd_rows(spark, tmp_path):
    good = [1.0] * 16
    values = [None, good, [None] + good[1:], [float("nan")] + good[1:], [float("inf")] + good[1:], good[:5], [3e38] * 16, []]
    rows = table(spark, values, [None, None, 1, 1, 1, 1, None, 1])
    out = vector_codes.query(spark, write(rows.union(rows.where("vec_id = 1")), tmp_path / "a")).collect()
    assert sorted((r["vec_id"], r["error"], r["label_error"]) for r in out) == [(1, 0, 0), (1, 0, 0), (6, 0, 0)]
    assert len({r["code"] for r in out if r["vec_id"] == 1}) == 1
    assert vector_codes.query(spark, write(table(spark, []), tmp_path / "b")).collect() == []
    assert vector_codes.query(spark, write(table(spark, [None]), tmp_path / "c")).collect() == []


def white_rows(spark, folder):
    out = whitening.query(spark, folder).orderBy("vec_id", "component").collect()
    return out, np.array([[r["whitened"] for r in out]], float).reshape(-1)


@pytest.mark.parametrize("rows,size", [(300, 20), (40, 70), (50, 3)])
def test_whitening_equals_a_dense_solver(spark, tmp_path, rows, size):
    values = (np.random.default_rng(rows).standard_normal((rows, size)) * np.linspace(1, 2, size)).astype(np.float32)
    out, got = white_rows(spark, write(table(spark, values.tolist()), tmp_path))
    k = min(8, size)
    x = np.floor(1024 * values.astype(np.float64)).astype(np.int64) + 100_000
    z = x - x.sum(axis=0) / rows
    e, u = np.linalg.eigh(z.T @ z / rows)
    e, u = e[::-1], u[:, ::-1]
    want = z @ (u[:, :k] / np.sqrt(e[:k]))
    got = got.reshape(rows, k)
    got = got * np.sign((got * want).sum(axis=0))
    assert np.abs(got - want).max() < 1e-9
    assert [r["component"] for r in out[:k]] == list(range(1, k + 1))
    assert np.allclose([r["explained"] for r in out[:k]], e[:k] / e.sum(), rtol=1e-10)
    assert {r["n"] for r in out} == {rows} and len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-9
    far = ((rows * x.astype(object) - x.sum(axis=0)) ** 2).sum(axis=1)
    assert [r["deviation"] for r in out[::k]] == list(far)


def test_whitening_of_odd_rows(spark, tmp_path):
    flat = [[1.0, 2.0, 3.0]] * 4
    out, _ = white_rows(spark, write(table(spark, flat + [None, [1.0], [None, 1.0, 1.0], [float("nan"), 1.0, 1.0]]), tmp_path / "a"))
    assert [(r["vec_id"], r["component"]) for r in out] == [(i, c) for i in range(4) for c in (1, 2, 3)]
    assert all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] is None for r in out)
    line = table(spark, [[float(i), 0.0, 0.0] for i in range(5)])
    out, _ = white_rows(spark, write(line, tmp_path / "b"))
    assert [r["whitened"] is None for r in out[:3]] == [False, True, True] and out[0]["explained"] == pytest.approx(1.0)
    huge = table(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 0.0]])
    out, _ = white_rows(spark, write(huge, tmp_path / "c"))
    assert len(out) == 6 and out[0]["deviation"] is None and out[0]["whitened"] is not None
    for name, rows in (("d", []), ("e", [None]), ("f", [[]])):
        assert white_rows(spark, write(table(spark, rows), tmp_path / name))[0] == []


@pytest.mark.parametrize("size", [1, 2, 9, 64, 200])
def test_eigenpairs(size):
    draw = np.random.default_rng(size)
    for spectrum in (draw.random(size), np.ones(size), np.r_[np.ones(size // 2), np.zeros(size - size // 2)], 10.0 ** -np.arange(size)):
        q = np.linalg.qr(draw.standard_normal((size, size)))[0]
        a = (q * spectrum) @ q.T
        found = whitening.jacobi_davidson(lambda w: a @ w, size, 8)
        want = np.sort(spectrum)[::-1][:8]
        assert np.allclose(found.values, want, atol=1e-13 * want[0], rtol=0)
        assert found.residuals.max() <= 1e-12 * want[0]
        assert np.allclose(found.vectors.T @ found.vectors, np.eye(len(want)), atol=1e-12)
