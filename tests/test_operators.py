"""Operators against hand-computed cases and dense computations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import features, folds, kernels, metrics, models, prepare, ranking, standard, summaries
from panelforge.operators import multivariate as mv
from panelforge.sources import files


def test_label_matching_example():
    a, b = [0, 0, 1, 2, 2, 3, 3, 3, 1], [1, 1, 2, 0, 0, 3, 3, 3, 2]
    table = np.zeros((4, 4))
    np.add.at(table, (a, b), 1)
    assert kernels.match(table).tolist() == [1, 2, 0, 3]


def test_assignment_is_cheapest():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        cost = rng.integers(0, 20, (n, n)).astype(float)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert cost[np.arange(n), kernels.assign(cost)].sum() == best


def test_window_count():
    assert features.window_count(30, 10, 2) == 10
    assert features.window_count(30, 30, 4) == 0
    assert features.window_count(30, 30, 4, include_last=True) == 1


def test_percentile_split_and_range(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 5)], "id int, v double")
    rows = prepare.split_at_percentile(df, "v", 0.5).orderBy("id").collect()
    assert [r["y"] for r in rows] == [0, 0, 1, 1] and rows[0]["cut"] == 2.5
    with pytest.raises(ValueError):
        prepare.split_at_percentile(df, "v", 1.5)


def test_clean(spark):
    nan, inf = float("nan"), float("inf")
    x = spark.createDataFrame([(0, 0, nan), (0, 1, 0.0), (1, 0, 0.0), (1, 1, inf), (2, 0, None), (2, 1, 2.0)], "subject int, feature int, value double")
    assert sorted(map(tuple, prepare.clean(x).select("subject", "feature", "value").collect())) == [(0, 1, 0.0), (1, 1, 0.0), (2, 1, 2.0)]


def test_missing_column_and_odd_matrix(spark):
    db = spark.createDataFrame([(1, 2)], "id int, a int")
    with pytest.raises(ValueError):
        prepare.select_columns(db, "id", "a,b")
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i int, j int, v double")
    order = spark.createDataFrame([(0, 1), (1, 0)], "old int, new int")
    with pytest.raises(Exception, match="not square"):
        prepare.reorder(m, order).collect()


def test_scrub_of_an_empty_vector(spark):
    x = spark.createDataFrame([(0, float("nan")), (0, 0.0)], "subject int, value double")
    with pytest.raises(Exception, match="empty vector"):
        prepare.scrub(x).collect()


def test_metrics_by_hand(spark):
    c = spark.createDataFrame([(0, 1, 1, 3), (0, 1, 0, 1), (0, 0, 1, 2), (0, 0, 0, 4)], "fold int, actual int, predicted int, n long")
    m = metrics.classification_metrics(c, ["fold"]).first()
    assert m["accuracy"] == pytest.approx(0.7) and m["recall_macro"] == pytest.approx((0.75 + 2 / 3) / 2)
    assert m["auc_macro"] == pytest.approx(m["recall_macro"]) and m["f1_micro"] == pytest.approx(0.7)


def test_sem(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 5)], "m double")
    assert summaries.summarize_folds(df, ["m"]).first()["sem"] == pytest.approx(0.6455, abs=1e-4)


def test_folds_are_complete_and_balanced(spark):
    df = spark.range(103).withColumn("y", F.col("id") % 3)
    rows = folds.stratified_kfold(df, "id", "y", 4).groupBy("y", "fold").count().collect()
    for y in range(3):
        sizes = [r["count"] for r in rows if r["y"] == y]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    again = folds.stratified_kfold(df.repartition(7), "id", "y", 4)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, folds.stratified_kfold(df, "id", "y", 4).collect()))


def test_block_holdout(spark):
    df = spark.range(60)
    held = sorted(r["id"] for r in folds.block_holdout(df, "id", 0).filter("held_out").collect())
    assert len(held) == 10 and held[-1] - held[0] == 9 and held[0] % 10 == 0
    assert folds.block_holdout(spark.range(50), "id", 0).filter("held_out").count() == 10


def test_connectivity_forms_agree_and_a_constant_is_zero(spark):
    rng = np.random.default_rng(0)
    rows = [(s, "e", r, t, 2.0 if r == 1 else float(rng.normal())) for s in range(3) for r in range(4) for t in range(20)]
    panel = spark.createDataFrame(rows, "subject long, experiment string, roi int, t int, v double")
    a = features.edges_long(features.connectivity(features.series_of(panel)))
    b = features.connectivity_long(panel, 4)
    x, y = ({(r["subject"], r["edge"]): r["r"] for r in df.collect()} for df in (a, b))
    assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-12 for k in x)
    assert x[(0, 0)] == 0 and all(abs(v) <= 1 + 1e-12 for v in x.values())


def test_leave_one_out_template(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(5, 2, 12))
    rows = [(s, "e", r, t, float(z[s, r, t])) for s in range(5) for r in range(2) for t in range(12)]
    panel = features.zscored(spark.createDataFrame(rows, "subject int, experiment string, roi int, t int, v double")).withColumn("inside", F.lit(True))
    got = {(r["subject"], r["roi_i"], r["roi_j"]): r["r"] for r in features.intersubject(panel, "inside", 2).collect()}
    z = (z - z.mean(2, keepdims=True)) / z.std(2, keepdims=True)
    for (s, i, j), r in got.items():
        mean = np.delete(z, s, 0)[:, i].mean(0)
        assert r == pytest.approx(np.corrcoef(mean, z[s, j])[0, 1], abs=1e-9)
    by_matrices = {(r["subject"], r["roi_i"], r["roi_j"]): r for r in features.intersubject_matrices(panel, "inside", 2).collect()}
    assert {k: r["r"] for k, r in by_matrices.items()} == pytest.approx(got, abs=1e-9)
    assert {k[1:]: r["feature"] for k, r in by_matrices.items()} == {(0, 0): 0, (0, 1): 1, (1, 1): 2}
    same = {(r["subject"], r["roi_i"], r["roi_j"]): r["r"] for r in features.homologous_corr(panel, "inside", 2).collect()}
    assert same == pytest.approx({k: r for k, r in got.items() if k[1] == k[2]}, abs=1e-9)
    assert all(r["r"] == 0 for r in features.intersubject_matrices(panel.filter("subject = 0"), "inside", 2).collect())  # no one else
    full = {(r["roi_i"], r["roi_j"]): r["feature"] for r in features.intersubject_matrices(panel, "inside", 2, full=True).collect()}
    assert full == {(0, 0): 0, (0, 1): 1, (1, 0): 2, (1, 1): 3}


def test_mask_without_a_voxel(spark):
    voxels = spark.createDataFrame([(1, "m", 5, 1.0)], "subject int, map string, voxel_id int, stat double")
    mask = spark.createDataFrame([(4, 1)], "voxel_id int, roi int")
    with pytest.raises(Exception, match="lacks a voxel"):
        features.roi_means(voxels, mask).collect()


def test_t_tail():
    assert ranking.t_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert ranking.t_tail(0.0, 7) == pytest.approx(1.0)
    assert ranking.t_tail(12.7062, 1) == pytest.approx(0.05, abs=1e-5)


def test_residuals_are_uncorrelated(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), float(a + 2 * b + e)) for i, (a, b, e) in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, "subject int, a double, b double, y double")
    r = standard.residualize(df, ["y"], ["a", "b"])
    got = r.agg(F.corr("res_y", "a"), F.corr("res_y", "b")).first()
    assert abs(got[0]) < 1e-9 and abs(got[1]) < 1e-9


def test_gauss_fit():
    x = np.linspace(-3, 3, 61)
    y = 2 * np.exp(-((x - 0.5) ** 2) / (2 * 0.7**2))
    assert summaries.fit_gauss(lambda p: [float(t.sum()) for t in summaries.gauss_terms(x, y, p)]) == pytest.approx([2, 0.5, 0.7], abs=1e-6)


def dual_cca(x, y, reg):
    """The textbook form: an eigenproblem of twice the number of rows."""
    kx, ky = (k / np.linalg.eigvalsh(k).max() for k in ((x - x.mean(0)) @ (x - x.mean(0)).T, (y - y.mean(0)) @ (y - y.mean(0)).T))
    n = len(x)
    left = np.block([[np.zeros((n, n)), kx @ ky], [ky @ kx, np.zeros((n, n))]])
    right = np.block([[kx @ kx + reg * np.eye(n), np.zeros((n, n))], [np.zeros((n, n)), ky @ ky + reg * np.eye(n)]])
    return np.sort(np.linalg.eigvals(np.linalg.solve(right, left)).real)[::-1]


def test_cca_equals_its_dual_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 5))
    y = x[:, :3] @ rng.normal(size=(3, 4)) + rng.normal(size=(30, 4))
    a, b = x - x.mean(0), y - y.mean(0)
    _, _, rho = kernels.cca_solve(a.T @ a, b.T @ b, a.T @ b, 0.5, 3)
    assert rho == pytest.approx(dual_cca(x, y, 0.5)[:3], abs=1e-9)
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(30)], "subject int, x array<double>, y array<double>")
    model = mv.kcca(df, "x", "y", 0.5, 2)
    comps = mv.kcca_components(df, "x", "y", model).orderBy("subject").collect()
    u, v = (np.array([r[c] for r in comps]) for c in ("comps_x", "comps_y"))
    assert model["cancorrs"] == pytest.approx([np.corrcoef(u[:, k], v[:, k])[0, 1] for k in range(2)], abs=1e-9)
    pred = np.array([r["pred_x"] for r in mv.kcca_predict(df, "x", "y", model).orderBy("subject").collect()])
    want = [np.corrcoef(pred[:, i], x[:, i])[0, 1] for i in range(5)]
    assert [r for s, _, r in mv.kcca_validate(model) if s == "x"] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("kind", ["linear", "gaussian", "poly"])
def test_kernel_cca(spark, kind):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(24, 3))
    y = x @ rng.normal(size=(3, 3)) + 0.3 * rng.normal(size=(24, 3))
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(24)], "subject int, x array<double>, y array<double>")
    model = mv.kcca_kernel(df, "x", "y", kind, 0.5, 2)
    n, kx, ky = 24, kernels.kernel_matrix(x, kind), kernels.kernel_matrix(y, kind)
    left = np.block([[np.zeros((n, n)), kx @ ky], [ky @ kx, np.zeros((n, n))]])
    right = np.block([[kx @ kx + 0.5 * np.eye(n), np.zeros((n, n))], [np.zeros((n, n)), ky @ ky + 0.5 * np.eye(n)]])
    assert model["kernel_corrs"] == pytest.approx(np.sort(np.linalg.eigvals(np.linalg.solve(right, left)).real)[::-1][:2], abs=1e-9)
    if kind == "linear":
        assert np.abs(model["cancorrs"]) == pytest.approx(np.abs(mv.kcca(df, "x", "y", 0.5, 2)["cancorrs"]), abs=1e-9)
    with pytest.raises(ValueError):
        mv.kcca_kernel(df, "x", "y", kind, most=10)


@pytest.mark.parametrize("kind", ["linear", "gaussian", "poly"])
def test_kernel_cca_by_products(spark, kind, monkeypatch):
    """The same weights and correlations without a kernel in one place, by passes over some rows after another."""
    monkeypatch.setattr(mv.wide, "PART", 8)
    rng = np.random.default_rng(18)
    x = rng.normal(size=(90, 4)) / 2 + 3
    y = (x - 3) @ rng.normal(size=(4, 3)) + 0.2 * rng.normal(size=(90, 3))
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in rng.permutation(90).tolist()], "subject int, x array<double>, y array<double>").repartition(3)
    want, got = (mv.kcca_kernel(df, "x", "y", kind, 0.5, 3, dense=d) for d in (90, 0))
    assert got["kernel_corrs"] == pytest.approx(want["kernel_corrs"], abs=1e-9) and got["cancorrs"] == pytest.approx(want["cancorrs"], abs=1e-7)
    for side in ("ws_x", "ws_y"):
        sign = np.sign((got[side] * want[side]).sum(0))
        assert got[side] * sign == pytest.approx(want[side], rel=1e-5, abs=1e-7)


def test_kernel_cca_refuses_no_number_of_rows(spark):
    df = spark.range(5001).select(F.col("id").alias("subject"), F.array(F.sin("id"), F.cos("id")).alias("x"), F.array(F.sin(F.col("id") + 0.1), F.cos(F.col("id") * 3)).alias("y"))
    assert mv.kcca_kernel(df, "x", "y", "gaussian", 1.0, 2)["cancorrs"][0] > 0


def test_pca(spark):
    x = np.random.default_rng(4).normal(size=(40, 6)) * [5, 3, 1, 1, 1, 1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "subject int, features array<double>")
    got = np.array([r["comps"] for r in mv.pca_reduce(df, 1)[0].orderBy("subject").collect()])[:, 0]
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, 0] * s[0]), abs=1e-8)
    assert np.corrcoef(got, x.mean(1))[0, 1] > 0


def test_mdmr_equals_explicit_matrices(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(25, 2)), rng.normal(size=(25, 4))
    y[:, 0] += 2 * x[:, 0]
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(25)], "subject int, x array<double>, y array<double>")
    got = mv.mdmr(df, "x", "y", 200).first()
    a, b = ((m - m.mean(0)) / m.std(0) for m in (x, y))
    d = np.sqrt(((b[:, None] - b[None]) ** 2).sum(2))
    centre = np.eye(25) - 1 / 25
    g = centre @ (-0.5 * d**2) @ centre
    q = np.concatenate([np.ones((25, 1)), a], 1)
    h = q @ np.linalg.pinv(q)
    assert got["f"] == pytest.approx(np.trace(h @ g @ h) / np.trace((np.eye(25) - h) @ g @ (np.eye(25) - h)))
    assert got["explained"] == pytest.approx(np.trace(h @ g @ h) / np.trace(g)) and got["p"] < 0.05


@pytest.mark.parametrize("method", ["euclidean", "correlation"])
@pytest.mark.parametrize("denominator", ["published", "residual"])
def test_mdmr_by_columns_in_tasks(spark, method, denominator, monkeypatch):
    """The same permutations as in one place, for some columns of all rows in a task; rows beyond any former limit."""
    monkeypatch.setattr(mv.wide, "PART", 4)
    rng = np.random.default_rng(17)
    x, y = rng.normal(size=(40, 3)) + 5, rng.normal(size=(40, 6))
    y[:, :3] += x[:, [1]] * [1, -1, 0]
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in rng.permutation(40).tolist()], "subject int, x array<double>, y array<double>").repartition(3)
    a, b = ((m - m.mean(0)) / m.std(0) for m in (x, y))
    if method == "correlation":
        b = b - b.mean(1, keepdims=True)
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = b - b.mean(0)
    s = np.linalg.svd(b, compute_uv=False)
    total, squares = (b * b).sum(), (s**2 * (1 - s**2) ** 2).sum()

    def want(columns, denominator):
        q = np.linalg.qr(np.concatenate([np.ones((40, 1)), a[:, columns]], 1))[0]
        fit = lambda order: ((q[order].T @ b) ** 2).sum()
        f = lambda t: t / (total - t) if denominator == "published" else t / squares
        null = [f(fit(np.random.default_rng([0, i]).permutation(40))) for i in range(70)]
        own = fit(np.arange(40))
        return f(own), np.mean(np.array(null) >= f(own)), own / total, np.quantile(null, 0.95)

    assert tuple(mv.mdmr(df, "x", "y", 70, method, denominator).first()) == pytest.approx(want([0, 1, 2], denominator)[:3])
    if denominator == "published":
        alone = [want([k], denominator) for k in range(3)]
        got = {r["predictor"]: r["explained"] for r in mv.mdmr_importances(df, "x", "y", 70, method).collect()}
        assert got == pytest.approx({k: e if f > cut else 0.0 for k, (f, _, e, cut) in enumerate(alone)}) and got[1] > 0
    with pytest.raises(ValueError):
        mv.mdmr(df, "x", "y", 70, most=39)


def many_rows(spark):
    return spark.range(20_001).select(F.col("id").alias("subject"), F.array(F.sin("id"), F.cos(F.col("id") * 7)).alias("x"), F.array(F.sin("id") + F.sin(F.col("id") * 3), F.cos(F.col("id") * 5)).alias("y"))


def test_mdmr_refuses_no_number_of_rows(spark):
    row = mv.mdmr(many_rows(spark), "x", "y", 20).first()
    assert row["p"] == 0 and 0.2 < row["explained"] < 0.3


def test_mdmr_importances_refuse_no_number_of_rows(spark):
    assert [r["explained"] > 0.2 for r in mv.mdmr_importances(many_rows(spark), "x", "y", 20).orderBy("predictor").collect()] == [True, False]


def test_ward_finds_planted_groups(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(20, 2)) + c for c in ([0, 0], [10, 0], [0, 10])])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "subject int, comps array<double>")
    for most in (2000, 12):
        labels = [r["cluster"] for r in mv.ward_clusters(df, 3, most=most).orderBy("subject").collect()]
        assert all(len(set(labels[20 * i : 20 * i + 20])) == 1 for i in range(3)) and len(set(labels)) == 3
    assert kernels.instability(x, 3, np.random.default_rng(0)) == 0


def test_occupancy_is_least_squares(spark):
    rng = np.random.default_rng(8)
    w = rng.normal(size=(3, 10))
    windows = spark.createDataFrame([(1, "e", i, r.tolist()) for i, r in enumerate(w)], "subject int, experiment string, win int, edges array<double>")
    state = rng.normal(size=10)
    states = spark.createDataFrame([("a", 0, state.tolist())], "grp string, state int, centroid array<double>")
    design = np.concatenate([np.ones((10, 1)), w.T], 1)
    want = np.linalg.lstsq(design, state, rcond=None)[0][1:].mean()
    assert features.state_occupancy(windows, states).first()["weight"] == pytest.approx(want)


def test_cross_validation_finds_a_planted_signal_and_not_noise(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, r.tolist(), int(r[0] > 0)) for i, r in enumerate(x)], "subject long, features array<double>, y int")
    m, predictions, settings = models.cross_validate(df, 2, cs=(1.0,), penalties=(0.0,), max_iter=10)
    assert all(r["accuracy"] > 0.8 for r in m.filter("split = 'test'").collect()) and predictions.count() == 60
    noise, _, _ = models.cross_validate(df, 2, null=True, cs=(1.0,), penalties=(0.0,), max_iter=10)
    assert np.mean([r["accuracy"] for r in noise.filter("split = 'test'").collect()]) < 0.75


def test_fold_features_see_no_test_subject(spark):
    rng = np.random.default_rng(12)
    shape = rng.normal(size=(3, 40))
    cells = [(i, "e", r, t, float(shape[r, t] * (1 + i % 2) + rng.normal())) for i in range(24) for r in range(3) for t in range(40)]
    panel = spark.createDataFrame(cells, "subject long, experiment string, roi int, t int, v double").persist()
    rows = spark.createDataFrame([(i, i % 2, "test" if i < 8 else "train") for i in range(24)], "subject long, y int, split string")
    build = models.fold_features(panel, 3, length=10, step=5, n_states=2)
    got = {r["subject"]: r["features"] for r in build(rows).collect()}
    assert len(got) == 24 and {len(v) for v in got.values()} == {6 + 3 + 4}
    # whatever the other test subjects are, a subject's features are the same
    changed = panel.withColumn("v", F.when(F.col("subject").between(1, 7), F.rand(3)).otherwise(F.col("v")))
    again = {r["subject"]: r["features"] for r in models.fold_features(changed, 3, length=10, step=5, n_states=2)(rows).collect()}
    assert all(again[i] == pytest.approx(got[i]) for i in [0, *range(8, 24)]) and again[1] != pytest.approx(got[1])


def test_cross_validation_of_anomalies_and_settings(spark, tmp_path):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(70, 3)), rng.normal(size=(10, 3)) + 9])
    df = spark.createDataFrame([(i, r.tolist(), int(i < 70)) for i, r in enumerate(x)], "subject long, features array<double>, y int")
    found = models.cross_validate(df, 2, "anomaly", trees=100, sample=32)
    assert all(r["accuracy"] > 0.85 for r in found.metrics.filter("split = 'test'").collect())
    found = models.cross_validate(df, 2, "logistic", cs=(0.01, 1.0), penalties=(0.0,), max_iter=10, n_folds=2, iterations=2)
    assert found.settings.count() == 4 and set(found.settings.columns) == {"i", "fold", "regParam", "elasticNetParam"}
    assert summaries.summarize_hyperparameters(found.settings, ["elasticNetParam"], []).first()["summary"] == "0.0"
    files.write_results(found.metrics, str(tmp_path))
    means = {(r["i"], r["split"]): float(r["accuracy"]) for r in spark.read.option("header", True).csv(str(tmp_path / "means")).collect()}
    rows = found.metrics.collect()
    for (i, split), mean in means.items():
        assert mean == pytest.approx(np.mean([r["accuracy"] for r in rows if r["i"] == int(i) and r["split"] == split]))
    assert len(means) == 4


def test_svc_grid_of_three_classes(spark):
    rng = np.random.default_rng(14)
    df = spark.createDataFrame([(i, (rng.normal(size=2) + 6 * np.array([i % 3 == 1, i % 3 == 2])).tolist(), i % 3) for i in range(60)], "subject long, features array<double>, y int")
    rows = models.vectors(df).persist()
    model, best = models.fit_svc_grid(rows, exponents=(-2, 0), n_folds=2, max_iter=20)
    assert best["regParam"] in (4 / 60, 1 / 60)
    size = lambda m: np.linalg.norm(m.coefficients)
    weak, strong = (models.fit_svc_grid(rows, exponents=(e,), max_iter=20)[0] for e in (-20, 0))
    assert size(weak) < size(strong) / 100
    got = models.predict(model, models.vectors(df)).collect()
    assert np.mean([r["actual"] == r["predicted"] for r in got]) > 0.95


def test_explained_variance_and_cca_without_kernel(spark):
    rng = np.random.default_rng(15)
    a = rng.normal(size=(50, 4)) + 100
    a[:, 3] = 7.0
    b = a[:, :3] @ rng.normal(size=(3, 3)) + rng.normal(size=(50, 3))
    df = spark.createDataFrame([(i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(zip(a, b, strict=True))], "subject int, x array<double>, y array<double>")
    model = mv.kcca(df, "x", "y", 0.5, 2, kernel=False)
    wx, wy = model["ws_x"], model["ws_y"]
    assert np.diag(wx.T @ (a.T @ a + 0.5 * np.eye(4)) @ wx) == pytest.approx([0.5, 0.5]) and np.diag(wy.T @ (b.T @ b + 0.5 * np.eye(3)) @ wy) == pytest.approx([0.5, 0.5])
    got = {(r["side"], r["cc"], r["feature"]): r["explained"] for r in mv.explained_variance(df, "x", "y", model).collect()}
    for side, v, o, w, other in (("x", a, b, wx, wy), ("y", b, a, wy, wx)):
        for k in range(2):
            e = np.abs(v - o @ np.outer(other[:, k], np.linalg.pinv(w[:, k : k + 1])[0]))
            for f in range(v.shape[1]):
                want = abs(v[:, f].var() - e[:, f].var()) / v[:, f].var() if v[:, f].var() > 1e-12 else 0.0
                assert got[side, k, f] == pytest.approx(want)


def test_rows_in_order_by_blocks(spark):
    rng = np.random.default_rng(16)
    values = rng.permutation(1000).tolist()
    df = spark.createDataFrame([(int(v), f"g{v % 3}", f"{v:04d}") for v in values] + [(None, "g0", None)], "id long, g string, s string")
    for column in ("id", "s"):
        rows = folds.ordered(df, column).collect()
        assert [r["id"] for r in sorted(rows, key=lambda r: r["nth"])] == [None, *range(1000)] and sorted(r["nth"] for r in rows) == list(range(1001))
    for r in folds.ordered(df.dropna(), "id", ["g"]).collect():
        assert r["nth"] == r["id"] // 3


def test_files(spark, tmp_path):
    for s in ("a", "b"):
        (tmp_path / f"{s}.csv").write_text("1,2,3\n4,x,6\n")
    (tmp_path / "db.csv").write_text(f"SUBJ,IQ,TS\na,100,{tmp_path}/a.csv\nb,NA,{tmp_path}/b.csv\n")
    db = files.read_database(spark, str(tmp_path / "db.csv"))
    assert dict(db.dtypes)["IQ"] == "double" and db.filter("IQ is null").count() == 1
    panel = files.read_timeseries(db, "SUBJ", ["TS"]).orderBy("subject", "roi").collect()
    assert panel[0]["series"] == [1, 2, 3] and math.isnan(panel[1]["series"][1]) and len(panel) == 4
    (tmp_path / "b.csv").write_text("1,2\n4,5\n")
    with pytest.raises(ValueError, match="shapes"):
        files.read_timeseries(db, "SUBJ", ["TS"])
    files.save_model(spark, {"reg": 1.0, "clusters": spark.range(3)}, str(tmp_path / "model"))
    assert files.load_model(spark, str(tmp_path / "model"), ("reg", "clusters"))["clusters"].count() == 3
    with pytest.raises(KeyError):
        files.load_model(spark, str(tmp_path / "model"))
    files.write_results(spark.createDataFrame([(0, 0.5), (1, 0.7)], "fold int, accuracy double"), str(tmp_path / "results"))
    assert spark.read.option("header", True).csv(str(tmp_path / "results/summary")).first()["metric"] == "accuracy"
    files.write_predictions(db, spark.createDataFrame([("a", 1, 0)], "SUBJ string, y_actual int, y_predictions int"), "SUBJ", str(tmp_path / "p"))
    files.dump_matrix(spark.range(2), spark.range(2), str(tmp_path / "dump"))
    assert spark.read.parquet(str(tmp_path / "dump/x")).count() == 2 and files.read_voxels(spark, str(tmp_path / "dump/y")).count() == 2
