"""Many penalised linear classifiers at once: all settings, folds and classes share each pass over the rows.

A pass sends the weights of all models to the tasks and gets the sums of their losses and gradients; quasi-Newton steps
are taken on the driver for all models side by side. Models are those of the published analysis: the squared hinge loss
or the logistic one, an L2 or L1 penalty that includes the intercept, and class weights of the rows a model learns from.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.wide import few_tasks, means, sum_over_rows
from panelforge.sources.files import kept

#: Weights, with the steps that are remembered, that the driver holds at once; more models go in turns.
CELLS, REMEMBERED = 1 << 25, 8
#: Margins of one slice of rows.
SLICE = 1 << 20


class LinearModel:
    """Classes, scaling, and one column of weights (the intercept last) for each class, or one column for two classes."""

    def __init__(self, classes, mean, scale, weights):
        self.classes, self.mean, self.scale, self.weights = classes, mean, scale, weights

    @property
    def coefficients(self):
        """Of the scaled columns."""
        return self.weights[:-1]

    def margins(self, x):
        return (x - self.mean) * self.scale @ self.weights[:-1] + self.weights[-1]

    def transform(self, df: DataFrame) -> DataFrame:
        """`prediction`: the label of the class with the largest margin."""
        import numpy as np

        @F.pandas_udf("double")
        def predicted(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=float)
            z = self.margins(np.nan_to_num(np.stack(v.to_numpy()).astype(float), posinf=0, neginf=0))
            return pd.Series(np.asarray(self.classes, float)[chosen(z)])

        return df.withColumn("prediction", predicted(F.col("features").cast("array<double>")))


def chosen(margins):
    """The place of the class with the largest margin; of two classes the second has the one margin there is."""
    return (margins[:, 0] > 0).astype(int) if margins.shape[1] == 1 else margins.argmax(1)


def _losses(kind: str, m):
    """Loss of margins and its derivative."""
    import numpy as np

    if kind == "squared_hinge":
        short = np.maximum(1 - m, 0)
        return short**2, -2 * short
    return np.logaddexp(0, -m), -1 / (1 + np.exp(np.clip(m, -500, 500)))


class _View:
    """How models see rows: scaling, classes, and by fold left out (-1: none) class weights and numbers of rows."""

    def __init__(self, mean, scale, classes, weights, sizes):
        self.mean, self.scale, self.classes, self.weights, self.sizes = mean, scale, classes, weights, sizes

    def slices(self, x, of, models: int):
        """Scaled rows, the place of their class, and their fold, some rows at a time."""
        import numpy as np

        step = max(1, SLICE // max(1, models))
        for at in range(0, len(x), step):
            yield (x[at : at + step] - self.mean) * self.scale, np.searchsorted(self.classes, of[at : at + step, 0]), of[at : at + step, 1]


class Problems:
    """A table of `features, label` for models that may each leave out one value of `fold`."""

    def __init__(self, train: DataFrame, fold: str | None = None):
        import numpy as np

        chosen_rows = train.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"), (F.col(fold) if fold else F.lit(-1)).cast("double").alias("fold"))
        # written once, as many passes read it
        self.rows = kept(chosen_rows.select("features", F.array("label", "fold").alias("of")), "linear-rows")
        self.few = few_tasks(self.rows)
        by_class = self.rows.groupBy(F.col("of")[0].alias("label"), F.col("of")[1].alias("fold")).count()
        counted = [(r["label"], int(r["fold"]), r["count"]) for r in by_class.collect()]
        classes = np.array(sorted({c for c, _, _ in counted}))
        self.folds = sorted({f for _, f, _ in counted} - {-1})
        n, mean = means(self.rows, ["features"])
        sd = np.sqrt(sum_over_rows(self.rows, ["features"], lambda v: ((v - mean) ** 2).sum(0))[""] / n)
        weights, sizes = {}, {}
        for out in [-1, *self.folds]:
            of_class = np.array([sum(k for c, f, k in counted if c == one and (f != out or out == -1)) for one in classes], float)
            sizes[out] = float(of_class.sum())
            weights[out] = np.divide(sizes[out], len(classes) * of_class, out=np.zeros_like(of_class), where=of_class > 0)
        self.view = _View(mean, np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0), classes, weights, sizes)

    @property
    def targets(self) -> list[int]:
        """The classes that have a model: two share the second's."""
        return [1] if len(self.view.classes) == 2 else list(range(len(self.view.classes)))

    def sums(self, kind: str, w, target, out):
        """Mean loss and its gradient of each model: weights `w` (a column each), its class and the fold it leaves out."""
        import numpy as np

        view = self.view
        by_model = np.array([view.weights[o] for o in out.tolist()]).T
        sizes = np.array([max(1.0, view.sizes[o]) for o in out.tolist()])

        def partial(x, of):
            loss, slope = np.zeros(w.shape[1]), np.zeros_like(w)
            for z, c, f in view.slices(x, of, w.shape[1]):
                sign = np.where(c[:, None] == target[None], 1.0, -1.0)
                weight = by_model[c] * ((f[:, None] != out[None]) | (out[None] == -1))
                value, change = _losses(kind, sign * (z @ w[:-1] + w[-1]))
                loss += (weight * value).sum(0)
                d = weight * change * sign
                slope[:-1] += z.T @ d
                slope[-1] += d.sum(0)
            return np.concatenate([loss, slope.ravel()])

        flat = sum_over_rows(self.rows, ["features", "of"], partial, cells=w.size + w.shape[1], few=self.few)[""]
        return flat[: w.shape[1]] / sizes, flat[w.shape[1] :].reshape(w.shape) / sizes

    def confusion(self, w, target, out, groups: int):
        """(group, actual, predicted) counts of the rows that each group of models left out; a group has a model for each target."""
        import numpy as np

        view, each, classes = self.view, len(self.targets), len(self.view.classes)
        left = out.reshape(groups, each)[:, 0]

        def partial(x, of):
            table = np.zeros((groups, classes, classes))
            for z, c, f in view.slices(x, of, w.shape[1]):
                margins = (z @ w[:-1] + w[-1]).reshape(len(z), groups, each)
                for g in range(groups):
                    some = f == left[g]
                    np.add.at(table[g], (c[some], chosen(margins[some, g])), 1)
            return table.ravel()

        return sum_over_rows(self.rows, ["features", "of"], partial, cells=groups * classes * classes)[""].reshape(groups, classes, classes)


def fit_all(problems: Problems, kind: str, settings: list[tuple], target, out, max_iter: int = 100, tolerance: float = 1e-6):
    """Weights of many models, one for each (c, l1) of `settings` with its class `target` and fold `out`.

    A model minimises its penalty plus c times the sum of its rows' weighted losses: half the squared length of the
    weights, or with l1 the sum of their sizes, kept sparse by steps that stay in an orthant. Each pass over the rows
    tries a step of every model that isn't done; `max_iter` passes at most.
    """
    import numpy as np

    target, out = np.asarray(target), np.asarray(out)
    width = len(problems.view.mean) + 1
    together = max(1, CELLS // (width * (2 * REMEMBERED + 4)))
    if len(settings) > together:
        parts = [slice(at, at + together) for at in range(0, len(settings), together)]
        return np.concatenate([fit_all(problems, kind, settings[p], target[p], out[p], max_iter, tolerance) for p in parts], 1)
    m = len(settings)
    size = np.array([max(1.0, problems.view.sizes[o]) for o in out.tolist()])
    penalty = 1 / (np.array([c for c, _ in settings], float) * size)
    l1 = np.array([bool(x) for _, x in settings])
    w = np.zeros((width, m))
    steps, turns, known = [], [], []

    def value(w, loss):
        return loss + penalty * np.where(l1, np.abs(w).sum(0), 0.5 * (w * w).sum(0))

    def slope(w, g, some):
        """The gradient, or with L1 the steepest of the subgradients."""
        p = penalty[some]
        up = g + p * np.sign(w)
        zero = np.sign(g) * np.maximum(np.abs(g) - p, 0)
        return np.where(l1[some], np.where(w != 0, up, zero), g + p * w)

    loss, g = problems.sums(kind, w, target, out)
    f, live = value(w, loss), np.ones(m, bool)
    first = np.abs(slope(w, g, slice(None))).max(0)
    length = np.zeros(m)
    direction = np.zeros_like(w)
    fresh, curved, scale = np.ones(m, bool), np.zeros(m, bool), np.ones(m)
    for _ in range(max_iter):
        steep = slope(w, g, slice(None))
        live &= np.abs(steep).max(0) > tolerance * np.maximum(first, 1e-12)
        if not live.any():
            break
        new = fresh & live
        if new.any():
            d, back = steep.copy(), []
            for s, t, r in zip(reversed(steps), reversed(turns), reversed(known), strict=True):
                a = r * (s * d).sum(0)
                back.append(a)
                d -= a * t
            d *= scale
            for s, t, r, a in zip(steps, turns, known, reversed(back), strict=True):
                d += s * (a - r * (t * d).sum(0))
            d = np.where(l1 & (d * steep <= 0), 0, -d)
            lost = (d * steep).sum(0) >= 0
            d = np.where(lost, -steep, d)
            direction[:, new] = d[:, new]
            plain = lost | ~curved
            length[new] = np.where(plain, np.minimum(1, 1 / np.maximum(np.abs(steep).sum(0), 1e-300)), 1.0)[new]
        some = np.flatnonzero(live)
        trial = w[:, some] + length[some] * direction[:, some]
        side = np.where(w[:, some] != 0, np.sign(w[:, some]), -np.sign(steep[:, some]))
        trial = np.where(l1[some] & (np.sign(trial) != side), 0, trial)
        loss, grad = problems.sums(kind, trial, target[some], out[some])
        found = loss + penalty[some] * np.where(l1[some], np.abs(trial).sum(0), 0.5 * (trial * trial).sum(0))
        gain = (steep[:, some] * (trial - w[:, some])).sum(0)
        good = found <= f[some] + 1e-4 * gain
        took = some[good]
        s, t, r = np.zeros_like(w), np.zeros_like(w), np.zeros(m)
        s[:, took] = trial[:, good] - w[:, took]
        smooth = np.where(l1, 0, penalty)
        t[:, took] = grad[:, good] - g[:, took] + smooth[took] * s[:, took]
        curve = (s * t).sum(0)
        bent = curve > 1e-12 * (t * t).sum(0)
        r[bent], scale[bent] = 1 / curve[bent], curve[bent] / (t * t).sum(0)[bent]
        curved |= bent
        if len(took):
            steps, turns, known = [*steps, s][-REMEMBERED:], [*turns, t][-REMEMBERED:], [*known, r][-REMEMBERED:]
        still = f[took] - found[good] <= 1e-12 * np.maximum(np.abs(f[took]), 1e-300)
        w[:, took], g[:, took], f[took] = trial[:, good], grad[:, good], found[good]
        fresh[:] = False
        fresh[took] = True
        live[took[still]] = False
        length[some[~good]] *= 0.5
        live[some[~good]] &= length[some[~good]] > 1e-12
    return w


def macro_f1(table) -> float:
    """From counts of (actual, predicted), over the classes that occur on either side."""
    import numpy as np

    both = table.sum(0) + table.sum(1)
    return float(np.mean(2 * np.diag(table)[both > 0] / both[both > 0])) if both.any() else 0.0


def grid(train: DataFrame, fold: str | None, kind: str, settings: list[tuple], max_iter: int = 100, tolerance: float = 1e-6) -> tuple:
    """The model of the best setting, the place of that, and the mean macro F1 over folds of each (None without folds).

    All settings are fitted for all values of `fold` together, scored in one pass, and the best is fitted to all rows.
    Ties take the first.
    """
    import numpy as np

    problems = Problems(train, fold)
    targets, best, scores = problems.targets, 0, None
    if fold is not None and len(settings) > 1:
        runs = [(k, f, t) for k in range(len(settings)) for f in problems.folds for t in targets]
        target, out = np.array([t for _, _, t in runs]), np.array([f for _, f, _ in runs])
        w = fit_all(problems, kind, [settings[k] for k, _, _ in runs], target, out, max_iter, tolerance)
        tables = problems.confusion(w, target, out, len(runs) // len(targets)).reshape(len(settings), len(problems.folds), len(problems.view.classes), -1)
        scores = [float(np.mean([macro_f1(t) for t in by_fold])) for by_fold in tables]
        best = int(np.argmax(scores))
    w = fit_all(problems, kind, [settings[best]] * len(targets), targets, [-1] * len(targets), max_iter, tolerance)
    return LinearModel(problems.view.classes, problems.view.mean, problems.view.scale, w), best, scores


def path(train: DataFrame, kind: str, settings: list[tuple], max_iter: int = 100) -> list[LinearModel]:
    """A model of all rows for each setting, fitted together."""
    problems = Problems(train)
    targets, v = problems.targets, problems.view
    w = fit_all(problems, kind, [s for s in settings for _ in targets], [t for _ in settings for t in targets], [-1] * len(settings) * len(targets), max_iter)
    return [LinearModel(v.classes, v.mean, v.scale, w[:, k * len(targets) : (k + 1) * len(targets)]) for k in range(len(settings))]


def confusions(df: DataFrame, models: list[LinearModel]):
    """Counts of (actual, predicted) of `features, label` by each of some models of the same classes, in one pass."""
    import numpy as np

    classes = np.asarray(models[0].classes, float)

    def partial(x, label):
        known = np.isin(label[:, 0], classes)
        place = np.searchsorted(classes, label[known, 0])
        table = np.zeros((len(models), len(classes), len(classes)))
        for k, model in enumerate(models):
            np.add.at(table[k], (place, chosen(model.margins(x[known]))), 1)
        return table.ravel()

    rows = df.select(F.col("features").cast("array<double>").alias("features"), F.array(F.col("label").cast("double")).alias("label"))
    found = sum_over_rows(rows, ["features", "label"], partial, cells=len(models) * len(classes) ** 2)
    shape = (len(models), len(classes), len(classes))
    return found[""].reshape(shape) if found else np.zeros(shape)
