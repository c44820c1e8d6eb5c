"""Arrays of many columns beside dense computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import kernels, standard, wide
from panelforge.operators import multivariate as mv


def rows(spark, *sides):
    names = ["x", "y"][: len(sides)]
    return spark.createDataFrame([(i, *(s[i].tolist() for s in sides)) for i in range(len(sides[0]))], "subject int, " + ", ".join(f"{n} array<double>" for n in names)).repartition(3)


def dense_pca(x):
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return s**2, vt.T


def same_up_to_sign(a, b, within):
    sign = np.sign((a * b).sum(0))
    assert np.abs(a - b * sign).max() <= within * np.abs(a).max()


def test_sums_and_keys(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 7))
    df = rows(spark, x).withColumn("keys", F.when(F.col("subject") % 2 == 0, F.array(F.lit(3))).when(F.col("subject") == 1, F.array(F.lit(3), F.lit(4))).otherwise(F.array().cast("array<int>")))
    got = wide.sum_over_rows(df, ["x"], lambda m: m.T @ m, "keys")
    in3 = [i for i in range(50) if i % 2 == 0 or i == 1]
    assert got["3"].reshape(7, 7) == pytest.approx(x[in3].T @ x[in3]) and got["4"].reshape(7, 7) == pytest.approx(np.outer(x[1], x[1]))
    n, mean = wide.means(df, ["x"])
    assert n == 50 and mean == pytest.approx(x.mean(0))
    r = wide.tall_qr(df, "x", np.eye(7)[:, :3], mean)
    c = (x - x.mean(0))[:, :3]
    assert r.T @ r == pytest.approx(c.T @ c)


def test_rows_of_other_lengths_are_an_error(spark):
    for odd in ([1.0], None):
        df = spark.createDataFrame([(0, [1.0, 2.0]), (1, odd)], "subject int, x array<double>").coalesce(1)
        with pytest.raises(Exception, match="arrays of one length"):
            wide.sum_over_rows(df, ["x"], lambda m: m.sum(0))


@pytest.mark.parametrize("shape", [(80, 30), (25, 400), (300, 64)])
def test_principal_directions(spark, shape):
    """Also where the spectrum is flat, and where there are more columns than rows."""
    x = np.random.default_rng(1).normal(size=shape) + 3
    x[0, 0] = np.nan
    df, x = rows(spark, x), np.nan_to_num(x)
    variances, vectors = dense_pca(x)
    mean, directions, got, total = wide.principal_directions(df, "x", 4)
    assert got == pytest.approx(variances[:4], rel=1e-9) and total == pytest.approx(variances.sum())
    same_up_to_sign(directions, vectors[:, :4], 1e-6)
    mean, directions, got, _ = wide.principal_directions(df, "x", 1, share=0.7)
    k = int(np.searchsorted(np.cumsum(variances) / variances.sum(), 0.7)) + 1
    assert len(got) == k
    same_up_to_sign(directions[:, :1], vectors[:, :1], 1e-6)


def test_pca_of_either_kind_is_the_same(spark):
    x = np.random.default_rng(2).normal(size=(60, 40)) * np.r_[4, 3, 2, np.ones(37)]
    df = rows(spark, x).withColumnRenamed("x", "features")
    for n in (1, 3):
        a, b = (np.array([r["comps"] for r in mv.pca_reduce(df, n, most_columns=m)[0].orderBy("subject").collect()]) for m in (1024, 8))
        assert a == pytest.approx(b, abs=1e-6)


def dual_correlations(x, y, reg, n):
    kx, ky = ((k := (a - a.mean(0)) @ (a - a.mean(0)).T) / np.linalg.eigvalsh(k)[-1] for a in (x, y))
    left = [np.linalg.solve(a @ a + reg * np.eye(len(a)), a @ b) for a, b in ((kx, ky), (ky, kx))]
    return np.sqrt(np.sort(np.linalg.eigvals(left[0] @ left[1]).real)[::-1][:n])


@pytest.mark.parametrize("reg", [0.1, 1.0, 1000.0])
def test_wide_cca_beside_the_solver_of_gram_matrices(spark, reg):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 40)) * np.linspace(3, 0.5, 40)
    y = x[:, :24] * 0.7 + rng.normal(size=(150, 24))
    a, b = x - x.mean(0), y - y.mean(0)
    wx, wy, rho = kernels.cca_solve(a.T @ a, b.T @ b, a.T @ b, reg, 4)
    got = wide.wide_cca(rows(spark, x, y), "x", "y", reg, 4)
    assert got["rho"] == pytest.approx(rho, rel=1e-8)
    assert np.abs(got["ws_x"] - wx).max() < 1e-6 * np.abs(wx).max() and np.abs(got["ws_y"] - wy).max() < 1e-6 * np.abs(wy).max()
    assert got["xy_w"] == pytest.approx(a.T @ b @ got["ws_y"]) and got["yy_w"] == pytest.approx(b.T @ b @ got["ws_y"])


def test_wide_cca_with_more_columns_than_rows(spark):
    rng = np.random.default_rng(4)
    common = rng.normal(size=(40, 3))
    x = common @ rng.normal(size=(3, 1500)) + rng.normal(size=(40, 1500))
    y = common @ rng.normal(size=(3, 900)) + rng.normal(size=(40, 900))
    got = wide.wide_cca(rows(spark, x, y), "x", "y", 0.5, 3)
    assert got["rho"] == pytest.approx(dual_correlations(x, y, 0.5, 3), rel=1e-8)


def test_models_of_either_kind_are_the_same(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 12))
    y = x[:, :8] + rng.normal(size=(120, 8))
    df = rows(spark, x, y)
    a, b = (mv.kcca(df, "x", "y", 0.5, 3, most_columns=m) for m in (1024, 4))
    assert b["cancorrs"] == pytest.approx(a["cancorrs"], abs=1e-8) and b["ws_x"] == pytest.approx(a["ws_x"], abs=1e-6)
    one, two = ({(s, i): r for s, i, r in mv.kcca_validate(m)} for m in (a, b))
    assert two == pytest.approx(one, abs=1e-7)
    grid = [mv.kcca_cross_validate(df, "x", "y", "subject", (0.5, 2.0), (1, 3), most_columns=m) for m in (1024, 4)]
    assert np.array(grid[1][0]) == pytest.approx(np.array(grid[0][0]), abs=1e-7)
    assert (grid[0][1]["reg"], grid[0][1]["n_cc"]) == (grid[1][1]["reg"], grid[1][1]["n_cc"])


def test_held_out_sums_beside_folds_one_by_one(spark):
    rng = np.random.default_rng(6)
    df = rows(spark, rng.normal(size=(130, 6)), rng.normal(size=(130, 5)))
    total, held = mv.held_out_grams(df, "x", "y", "subject", 3, 0)
    from panelforge.operators.folds import block_holdout

    assert total == pytest.approx(mv.grams(df, ["x", "y"])[""])
    for f, h in enumerate(held):
        assert h == pytest.approx(mv.grams(block_holdout(df, "subject", f, 0).filter("held_out"), ["x", "y"])[""])


def test_residuals_of_arrays(spark):
    rng = np.random.default_rng(7)
    c = rng.normal(size=(90, 2))
    v = np.concatenate([c @ rng.normal(size=(2, 5)) + rng.normal(size=(90, 5)), np.full((90, 1), 2.0)], 1)
    df = spark.createDataFrame([(i, v[i].tolist(), float(c[i, 0]), float(c[i, 1])) for i in range(90)] + [(90, v[0].tolist(), None, 1.0)], "subject int, v array<double>, a double, b double")
    got = wide.residualize_arrays(df, "v", ["a", "b"]).orderBy("subject").collect()
    z, d = ((m - m.mean(0)) / np.where(m.std(0) > 0, m.std(0), 1) for m in (v, c))
    want = z - d @ np.linalg.lstsq(d, z, rcond=None)[0]
    assert np.array([r["residuals"] for r in got[:90]]) == pytest.approx(want, abs=1e-9) and got[90]["residuals"] is None
    flat = df.select("subject", "a", "b", *(F.col("v")[i].alias(f"v{i}") for i in range(5)))
    by_columns = standard.residualize(flat.dropna(), [f"v{i}" for i in range(5)], ["a", "b"]).orderBy("subject").collect()
    assert np.array([[r[f"res_v{i}"] for i in range(5)] for r in by_columns]) == pytest.approx(want[:, :5], abs=1e-9)
