import numpy as np
import pytest

from placeloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component int, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 9, 3, "x") for i, v in rows], SCHEMA)


def against_plain(frame, rows, k=16):
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    want = (x - s / n) @ u / np.sqrt(e)
    p = frame.toPandas()
    have = p.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    assert have.shape == want.shape
    assert np.abs(want * np.sign((want * have).sum(axis=0)) - have).max() < 1e-7
    assert (p["n"] == n).all() and p["identity_error"].nunique() == 1 and p["identity_error"][0] < 1e-9
    share = p.groupby("component")["explained"].agg(["min", "max"])
    assert (share["min"] == share["max"]).all() and np.allclose(share["min"], e / np.trace(v), rtol=1e-9)
    exact = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for (i, _), r in zip(rows, x, strict=True)}
    assert all(exact[i] == d for i, d in zip(p["vec_id"], p["deviation"], strict=True))


def test_the_table(spark):
    folder = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    against_plain(queries.queries()["op13_whitening"](spark, folder), [(r["vec_id"], r["embedding"]) for r in e])


@pytest.mark.parametrize("dim, decay", [(24, 1.0), (300, 0.995), (40, 0.5)])
def test_blocks_and_restarts(spark, dim, decay):
    """Flat and steep spectra, more dimensions than blocks may hold at once, and a group of copies that counts once."""
    g = np.random.default_rng(dim)
    v = g.standard_normal((600, dim)) * decay ** np.arange(dim) * 4
    v[100:300] = v[7]
    rows = list(enumerate(v.astype(np.float32).tolist()))
    against_plain(whitening.whitened_vectors(spark, table(spark, rows)), rows)


def test_restarted_blocks(spark):
    g = np.random.default_rng(9)
    x = np.floor(g.standard_normal((500, 120)) * 500).astype(np.int64)
    fit = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>")
    axes = whitening.principal_axes(fit, whitening.Centre(500, x.sum(axis=0)), 4, extra=1, tolerance=1e-10)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    assert axes.passes > 8 and np.allclose(axes.values, e[::-1][:4], rtol=1e-10)
    assert np.allclose(np.abs((axes.vectors * u[:, ::-1][:, :4]).sum(axis=0)), 1, atol=1e-8)


def test_few_directions_vary(spark):
    rows = [(i, [i / 64, 3.0, -2 * i / 64]) for i in range(10)]
    p = whitening.whitened_vectors(spark, table(spark, rows)).toPandas()
    assert set(p["component"]) == {1} and len(p) == 10 and abs(p["explained"][0] - 1) < 1e-12
    w = p.sort_values("vec_id")["whitened"].to_numpy()
    assert abs(w.mean()) < 1e-12 and abs((w**2).mean() - 1) < 1e-12
    assert whitening.whitened_vectors(spark, table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_edges(spark):
    bad = [(0, None), (1, []), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("-inf"), 1.0]), (5, [1.0, 2.0, 3.0])]
    good = [(10, [0.1, 0.2]), (11, [1.0, -0.5]), (12, [0.0, 0.0]), (12, [0.0, 0.0]), (None, [0.3, 0.9])]
    p = whitening.whitened_vectors(spark, table(spark, bad + good)).toPandas()
    assert len(p) == 10 and set(p["n"]) == {4} and p["vec_id"].isna().sum() == 2
    empty = whitening.whitened_vectors(spark, table(spark, bad[:5]))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    wide = whitening.whitened_vectors(spark, table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 0.0])])).toPandas()
    assert wide["whitened"].notna().all() and wide["deviation"].isna().any()
