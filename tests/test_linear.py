"""Linear models fitted together, beside the conditions of each one's optimum, and the choice of settings."""

import numpy as np
import pytest

from panelforge.operators import linear, models


def table(spark, n=120, classes=2, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * np.r_[1, 2, 3, 1, 1, 1] + 5
    x[:, 5] = 1.0
    y = (x[:, :classes] - x[:, :classes].mean(0) + rng.normal(size=(n, classes))).argmax(1)
    y[rng.random(n) < 0.1] = 0
    return x, y, spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 3) for i in range(n)], "subject long, features array<double>, label double, fold int").repartition(3).persist()


def slope(kind, c, l1, x, y, rows, w, target, classes):
    """The least subgradient of the penalty plus c times the weighted losses, computed plainly."""
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), np.inf)
    weights = {k: rows.sum() / (classes * (y[rows] == k).sum()) for k in range(classes)}
    s, sign = np.array([weights[k] for k in y[rows]]), np.where(y[rows] == target, 1.0, -1.0)
    design = np.concatenate([z[rows], np.ones((rows.sum(), 1))], 1)
    m = sign * (design @ w)
    change = -2 * np.maximum(1 - m, 0) if kind == "squared_hinge" else -1 / (1 + np.exp(m))
    g = c * design.T @ (s * change * sign)
    if not l1:
        return g + w, g
    return np.where(w != 0, g + np.sign(w), np.sign(g) * np.maximum(np.abs(g) - 1, 0)), g


@pytest.mark.parametrize("kind", ["squared_hinge", "logistic"])
@pytest.mark.parametrize("classes", [2, 3])
def test_every_model_is_at_its_optimum(spark, kind, classes):
    x, y, df = table(spark, classes=classes)
    problems = linear.Problems(df, "fold")
    settings = [(c, l1) for c in (0.01, 0.1, 1.0, 10.0) for l1 in (False, True)]
    runs = [(s, f, t) for s in settings for f in (-1, 0, 2) for t in problems.targets]
    w = linear.fit_all(problems, kind, [s for s, _, _ in runs], [t for _, _, t in runs], [f for _, f, _ in runs], 400, 1e-8)
    for k, ((c, l1), f, t) in enumerate(runs):
        rows = np.arange(len(x)) % 3 != f
        rest, g = slope(kind, c, l1, x, y, rows, w[:, k], t, classes)
        assert np.abs(rest).max() < 1e-4 * max(1.0, c * len(x)), (c, l1, f, t)
    sparse = (w[:, [k for k, ((c, l1), f, t) in enumerate(runs) if l1 and c == 0.01]] == 0).mean()
    assert sparse > 0.5


def test_models_in_turns_are_the_same(spark, monkeypatch):
    _, _, df = table(spark)
    problems = linear.Problems(df)
    settings = [(c, False) for c in (0.1, 1.0, 5.0)]
    both = [linear.fit_all(problems, "logistic", settings, [1] * 3, [-1] * 3, 200, 1e-9)]
    monkeypatch.setattr(linear, "CELLS", 7 * (2 * linear.REMEMBERED + 4))
    both.append(linear.fit_all(problems, "logistic", settings, [1] * 3, [-1] * 3, 200, 1e-9))
    assert both[0] == pytest.approx(both[1], abs=1e-4)


def test_scores_of_the_grid_are_macro(spark):
    """The scores are those of fitting each setting to the rows outside each fold, one by one."""
    x, y, df = table(spark, n=150, classes=3)
    settings = [(0.001, False), (1.0, False)]
    model, best, scores = linear.grid(df, "fold", "squared_hinge", settings, 200)
    for k, s in enumerate(settings):
        want = []
        for f in range(3):
            problems = linear.Problems(df, "fold")
            w = linear.fit_all(problems, "squared_hinge", [s] * 3, [0, 1, 2], [f] * 3, 200)
            left = np.arange(150) % 3 == f
            z = (x[left] - problems.view.mean) * problems.view.scale
            guess = (z @ w[:-1] + w[-1]).argmax(1)
            f1 = []
            for c in range(3):
                hit = ((guess == c) & (y[left] == c)).sum()
                f1.append(2 * hit / max(1, (guess == c).sum() + (y[left] == c).sum()))
            want.append(np.mean(f1))
        assert scores[k] == pytest.approx(np.mean(want), abs=0.02)
    assert best == int(np.argmax(scores)) and len(model.classes) == 3


def test_macro_and_weighted_f1_differ(spark):
    """Nine to one: the evaluator of the forests, and the score of the linear grids, is the mean over classes."""
    rows = [(0.0, 0.0)] * 90 + [(1.0, 0.0)] * 10
    df = spark.createDataFrame(rows, "label double, prediction double")
    assert models.MacroF1().evaluate(df) == pytest.approx(0.5 * 2 * 90 / 190)
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    assert MulticlassClassificationEvaluator(metricName="f1").evaluate(df) > 0.85
    assert linear.macro_f1(np.array([[90, 0], [10, 0]])) == pytest.approx(0.5 * 2 * 90 / 190)


def test_selection_leaves_out_what_does_not_vary(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 5))
    x[:, 1] = 3.0
    df = spark.createDataFrame([(i, x[i].tolist(), int(x[i, 3] > 0)) for i in range(80)], "subject long, features array<double>, y int")
    kept = models.forest_select(models.vectors(df), 1, trees=30)
    assert [r["feature"] for r in kept.collect()] == [3]
    with pytest.raises(ValueError, match="no feature varies"):
        models.forest_select(models.vectors(df.selectExpr("subject", "array(1.0D, 2.0D) AS features", "y")), 1, trees=5)


def test_selection_grows_few_trees_at_once(spark, monkeypatch):
    """The driver never holds more trees than their leaves allow, whatever their number; the forest has them all."""
    from pyspark.ml.classification import RandomForestClassifier

    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 6))
    df = spark.createDataFrame([(i, x[i].tolist(), int(x[i, 2] + x[i, 4] > 0)) for i in range(120)], "subject long, features array<double>, y int")
    grown, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, rows: grown.append((self.getNumTrees(), self.getSeed())) or fit(self, rows))
    monkeypatch.setattr(models, "LEAVES", 360, raising=False)
    got = {r["feature"]: r["importance"] for r in models.forest_select(models.vectors(df), 2, trees=10).collect()}
    assert set(got) == {2, 4} and max(t for t, _ in grown) == 3 and sum(t for t, _ in grown) == 10 and len(set(grown)) == 4
    monkeypatch.setattr(models, "LEAVES", 1 << 18)
    whole = {r["feature"]: r["importance"] for r in models.forest_select(models.vectors(df), 2, trees=10).collect()}
    assert grown[-1][0] == 10 and got == pytest.approx(whole, abs=0.15)


def test_sparsity_path(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, 8))
    y = (x[:, 0] + 0.2 * rng.normal(size=160) > 0).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(160)], "subject long, features array<double>, y int")
    train, test = (models.vectors(df.filter(f"subject % 4 {op} 0")) for op in ("!=", "="))
    rows = models.sparsity_path(train, test, (-12, -4, 4)).orderBy("c").collect()
    assert [r["c"] for r in rows] == [2.0**-12, 2.0**-4, 16.0]
    assert rows[0]["kept"] == 0 and rows[0]["kept"] <= rows[1]["kept"] <= rows[2]["kept"] and rows[2]["kept"] >= 5
    assert rows[2]["f1_train"] > 0.9 and rows[1]["f1_test"] > 0.85


def test_grids_choose_and_predict(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i, x[i].tolist(), int(x[i, 0] > 0)) for i in range(90)], "subject long, features array<double>, y int")
    train = models.vectors(df).persist()
    for fit, options in ((models.fit_svc_grid, {"exponents": (-18, -2)}), (models.fit_logistic_grid, {"cs": (0.001, 1.0)}), (models.fit_forest_grid, {"depths": (1, None), "impurities": ("gini",), "min_split": (2,), "trees": 15, "n_folds": 2})):
        model, best = fit(train, **options)
        got = models.predict(model, train).collect()
        assert np.mean([r["actual"] == r["predicted"] for r in got]) > 0.9 and best
    with pytest.raises(ValueError, match="penalties"):
        models.fit_logistic_grid(train, penalties=(0.5,))
