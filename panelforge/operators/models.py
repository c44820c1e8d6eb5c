"""Classifiers on `subject, features, y` tables: grids, selection, cross-validation, diagnostics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.config import DEFAULTS
from panelforge.operators import folds as splits
from panelforge.operators import linear, metrics, wide
from panelforge.operators.ranking import balanced_weights, top_features
from panelforge.sources.files import kept


#: Spark's deepest tree, where there is no limit.
DEEPEST = 30
#: Leaves of the trees that the driver holds at once, if each leaf has the least rows.
LEAVES = 1 << 18


def vectors(df: DataFrame, y: str = "y") -> DataFrame:
    """ML vectors of `features`, a double `label`, and balanced class weights (a broadcast of a row for each class)."""
    from pyspark.ml.functions import array_to_vector

    weights = balanced_weights(df, y).select(F.col(y), F.col("weight"))
    out = df.join(F.broadcast(weights), y)
    return out.withColumn("vector", array_to_vector(F.transform("features", lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))))).withColumn("label", F.col(y).cast("double"))


class MacroF1(Evaluator):
    """The mean over classes of F1, from the confusion table."""

    def _evaluate(self, dataset: DataFrame) -> float:
        import numpy as np

        counts = dataset.groupBy("label", "prediction").count().collect()
        classes = sorted({r["label"] for r in counts} | {r["prediction"] for r in counts})
        table = np.zeros((len(classes), len(classes)))
        for r in counts:
            table[classes.index(r["label"]), classes.index(r["prediction"])] += r["count"]
        return linear.macro_f1(table)

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


def _grid(estimator, params: list[dict], train: DataFrame, n_folds: int, seed: int):
    """The estimator, after scaling, with the setting of the best macro F1 over stratified folds; ties take the first."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.tuning import CrossValidator

    scaler = StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True)
    pipeline = Pipeline(stages=[scaler, estimator])
    maps = [{estimator.getParam(k): v for k, v in p.items()} for p in params]
    if len(maps) == 1:
        return pipeline.copy(maps[0]).fit(train), dict(params[0])
    folded = splits.stratified_kfold(train, "subject", "label", n_folds, seed)
    found = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=MacroF1(), numFolds=n_folds, foldCol="fold", parallelism=4, seed=seed).fit(folded)
    best = max(range(len(params)), key=lambda i: (found.avgMetrics[i], -i))
    return found.bestModel, params[best]


def _linear_grid(train: DataFrame, kind: str, settings: list[tuple], n_folds: int, max_iter: int, tolerance: float, seed: int):
    folded = splits.stratified_kfold(train, "subject", "label", n_folds, seed) if len(settings) > 1 else train
    return linear.grid(folded, "fold" if len(settings) > 1 else None, kind, settings, max_iter, tolerance)


def fit_svc_grid(train: DataFrame, n_classes: int | None = None, exponents=DEFAULTS.svc_exponents, n_folds: int = 3, max_iter: int = DEFAULTS.svc_iterations, seed: int = 0):
    """Balanced linear SVC with the squared hinge loss, C = 2^e, by the macro F1 of folds; more than two classes go one
    against the rest. All settings, folds and classes share each pass over the rows, `max_iter` passes at most."""
    n, exponents = max(1, train.count()), list(exponents)
    model, best, _ = _linear_grid(train, "squared_hinge", [(2.0**e, False) for e in exponents], n_folds, max_iter, DEFAULTS.svc_tolerance, seed)
    return model, {"regParam": 1.0 / (2.0 ** exponents[best] * n)}


def fit_logistic_grid(train: DataFrame, cs=DEFAULTS.logistic_cs, penalties=(0.0, 1.0), n_folds: int = 3, max_iter: int = 100, seed: int = 0):
    """Balanced logistic regression, L2 (0) and L1 (1), by the macro F1 of folds, fitted as `fit_svc_grid` does."""
    if set(penalties) - {0.0, 1.0}:
        raise ValueError("penalties are 0 for L2 and 1 for L1")
    n, params = max(1, train.count()), [(c, p) for c in cs for p in penalties]
    model, best, _ = _linear_grid(train, "logistic", [(c, p == 1.0) for c, p in params], n_folds, max_iter, 1e-4, seed)
    return model, {"regParam": 1.0 / (params[best][0] * n), "elasticNetParam": params[best][1]}


def fit_forest_grid(train: DataFrame, depths=DEFAULTS.forest_depths, impurities=("gini", "entropy"), min_split=None, trees: int = DEFAULTS.forest_trees, n_folds: int = 3, seed: int = 0):
    """Balanced random forest over depth (None: 30, Spark's deepest), split size and impurity. The least rows to split
    are, by default, ten shares of the number of columns; a leaf has at least half of them."""
    from pyspark.ml.classification import RandomForestClassifier

    if min_split is None:
        width = len(train.select("features").first()[0])
        low, high, steps = DEFAULTS.forest_splits
        min_split = [round(width * (low + (high - low) * i / (steps - 1))) for i in range(steps)]
    sizes = sorted({max(1, -(-int(m) // 2)) for m in min_split})
    estimator = RandomForestClassifier(featuresCol="scaled", labelCol="label", weightCol="weight", numTrees=trees, seed=seed)
    return _grid(estimator, [{"maxDepth": DEEPEST if d is None else d, "impurity": i, "minInstancesPerNode": m} for d in depths for i in impurities for m in sizes], train, n_folds, seed)


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df).select("subject", F.col("label").cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"))


def forest_select(train: DataFrame, n: int, trees: int = DEFAULTS.selection_trees, seed: int = 0, depth: int | None = None) -> DataFrame:
    """`feature, importance`: the n most important features of a balanced forest, ties kept.

    Columns that don't vary are left out first. The least split size starts at a third of the others and is halved until
    more than n features matter; at 2 that is an error. depth: None for Spark's deepest, 30.

    Only importances are kept: where all trees have more leaves than `LEAVES`, by the rows and the least of a leaf, they are
    grown some at a time, each lot with a seed of its own, and the driver holds the nodes of one lot.
    """
    import numpy as np
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorSlicer

    rows, mean = wide.means(train, ["features"])
    varying = np.flatnonzero(wide.sum_over_rows(train, ["features"], lambda v: ((v - mean) ** 2).sum(0))[""] > 1e-12 * rows * np.maximum(mean**2, 1e-12)).tolist()
    if not varying:
        raise ValueError("no feature varies")
    some = VectorSlicer(inputCol="vector", outputCol="varying", indices=varying).transform(train) if len(varying) < len(mean) else train.withColumn("varying", F.col("vector"))
    size, written = max(2, round(0.33 * len(varying))), False
    while True:
        least, deepest = -(-size // 2), DEEPEST if depth is None else depth
        lot = int(min(trees, max(1, LEAVES // max(1, min(rows // least, 2**deepest)))))
        lots = -(-trees // lot)
        if lots > 1 and not written:
            some, written = kept(some.select("varying", "label", "weight"), "forest-rows"), True
        found, split = np.zeros(len(varying)), 0
        for k in range(lots):
            grown = trees * (k + 1) // lots - trees * k // lots
            # by itself, a tree of a lot would take all columns for each split
            forest = RandomForestClassifier(featuresCol="varying", labelCol="label", weightCol="weight", numTrees=grown, minInstancesPerNode=least, maxDepth=deepest, seed=seed + 1_000_003 * k, featureSubsetStrategy="sqrt" if trees > 1 else "auto")
            model = forest.fit(some)
            # the importances are a mean over the trees that have a split
            having = sum(t.depth > 0 for t in model.trees) if lots > 1 else 1
            found, split = found + model.featureImportances.toArray() * having, split + having
        found /= max(1, split)
        if (found > 0).sum() > n:
            break
        if size == 2:
            raise ValueError(f"no more than {(found > 0).sum()} features matter")
        size = max(2, size // 2)
    scores = train.sparkSession.createDataFrame([(i, float(v)) for i, v in zip(varying, found, strict=True)], "feature int, importance double")
    return top_features(scores, n)


def sparsity_path(train: DataFrame, test: DataFrame, exponents=DEFAULTS.sparsity_exponents, max_iter: int = 50) -> DataFrame:
    """`c, kept, f1_train, f1_test` of L1 logistic regressions, which are fitted and scored together."""
    import numpy as np

    cs = [2.0**e for e in exponents]
    fitted = linear.path(train, "logistic", [(c, True) for c in cs], max_iter)
    scores = [[linear.macro_f1(t) for t in linear.confusions(df, fitted)] for df in (train, test)]
    kept = [int((np.abs(m.coefficients).sum(1) > 0).sum()) for m in fitted]
    return train.sparkSession.createDataFrame(list(zip(cs, kept, *scores, strict=True)), "c double, kept int, f1_train double, f1_test double")


class Results(NamedTuple):
    """Metrics by iteration, fold and split; test predictions; the settings that each fold's grid chose."""

    metrics: DataFrame
    predictions: DataFrame
    settings: DataFrame


def fold_features(panel: DataFrame, n_rois: int, blocks: tuple = ("xcorr", "connectivity", "dynamics"), target=None, other=None, length: int = DEFAULTS.win_length, step: int = DEFAULTS.win_step, n_states: int = DEFAULTS.n_states, extra: tuple = (), seed: int = 0):
    """What `cross_validate` builds the features of a fold with: a function of `subject, y, split`.

    xcorr: correlations with the template of the training subjects (of class `target`, if given; less those with the
    template of class `other`, if given). connectivity: a subject's own correlations. dynamics: weights of the states of
    the training subjects' windows, found for each class. `extra`: tables of `subject, features` that follow. Nothing
    that is fitted sees a test subject. `panel` is long: subject, experiment, roi, t, v. What doesn't depend on a fold is
    cached, and freed by calling `release` of the function.
    """
    from panelforge.operators import features as fx
    from panelforge.operators.prepare import assemble_features
    from panelforge.sources.domain import to_series

    series = to_series(panel)
    z = fx.zscored(panel).persist()
    alone = {"connectivity": fx.connectivity(series).persist(), "dynamics": fx.dynamic_connectivity(series, length, step).persist()}
    in_order = lambda value, *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, F.col(value).alias("_v")))), lambda x: x["_v"]).alias("features")

    def against_all(folded: DataFrame, k: int) -> DataFrame:
        """`fold, subject, features`: xcorr of all folds, in one job for each template."""

        def against(group) -> DataFrame:
            member = F.lit(True) if group is None else F.coalesce(F.col("y") == F.lit(group), F.lit(False))
            return fx.intersubject_by_fold(z, folded.select("subject", "fold", member.alias("member")), k, n_rois)

        r = against(target)
        if other is not None:
            keys = ["fold", "subject", "experiment", "feature"]
            r = r.join(against(other).withColumnRenamed("r", "less"), keys).withColumn("r", F.col("r") - F.col("less"))
        return r.groupBy("fold", "subject").agg(in_order("r", "experiment", "feature"))

    def assembled(known: DataFrame, xcorr) -> DataFrame:
        out = [xcorr()] if "xcorr" in blocks else []
        if "connectivity" in blocks:
            own = fx.edges_long(alone["connectivity"].join(known.select("subject"), "subject", "left_semi"))
            out.append(own.groupBy("subject").agg(in_order("r", "experiment", "edge")))
        if "dynamics" in blocks:
            windows = alone["dynamics"].join(known.select("subject"), "subject", "left_semi")
            states = fx.dynamic_states(windows.join(known.filter("training"), "subject"), "y", n_states, seed)
            out.append(fx.state_occupancy(windows, states).groupBy("subject").agg(in_order("weight", "experiment", "state")))
        return assemble_features([*out, *extra])

    def build(rows: DataFrame) -> DataFrame:
        # the training side is one fold of two, the test side the other: features are those of leaving the latter out
        known = rows.select("subject", "y", (F.col("split") == "train").alias("training"))
        pair = known.select("subject", "y", F.when(F.col("training"), 1).otherwise(0).alias("fold"))
        return assembled(known, lambda: against_all(pair, 2).filter("fold = 0").drop("fold"))

    def build_all(folded: DataFrame, k: int):
        """The same for all of k folds: a function of the fold and its rows. The templates' features are computed once."""
        xcorr = kept(against_all(folded, k), "fold-features") if "xcorr" in blocks else None

        def of_fold(fold: int, rows: DataFrame) -> DataFrame:
            known = rows.select("subject", "y", (F.col("split") == "train").alias("training"))
            return assembled(known, lambda: xcorr.filter(F.col("fold") == fold).drop("fold"))

        return of_fold

    build.all_folds = build_all
    build.release = lambda: [df.unpersist() for df in (z, *alone.values())]
    return build


def _biotyped(rows: DataFrame, model: dict) -> DataFrame:
    """`y` of both sides of a fold by biotypes fitted to its training side; `rows` has arrays `x` and `scores`."""
    from panelforge.operators.multivariate import apply_biotypes

    train, test = apply_biotypes(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "x", "scores", model)
    found = train.select("subject", "cluster").unionByName(test.select("subject", "cluster"))
    return rows.drop("y").join(found.withColumnRenamed("cluster", "y"), "subject")


def anomalies(train: DataFrame, share: float, **options):
    """A function that takes the highest `share` of isolation scores for outliers, 0, by trees and a cutoff of `train`."""
    from panelforge.operators.isolation import grow_isolation_forest, isolation_scores
    from panelforge.operators.quantiles import exact_quantiles

    forest = grow_isolation_forest(train, **options)
    cut = exact_quantiles(isolation_scores(train, forest), "score", [1 - share]).first()["q0"]
    return lambda df: isolation_scores(df, forest).select("subject", F.col("y").cast("int").alias("actual"), (F.col("score") <= cut).cast("int").alias("predicted"))


def cross_validate(db: DataFrame, k: int = DEFAULTS.folds, method: str = "logistic", select: int | None = None, null: bool = False, iterations: int = 1, seed: int = 0, features=None, biotypes: dict | None = None, select_trees: int = DEFAULTS.selection_trees, **options) -> Results:
    """Fold metrics of train and test, test predictions, and chosen settings, of `subject, y` and `features`.

    Folds are stratified. `features` may be a function of a fold's `subject, y, split` instead of a column, such as
    `fold_features`. Selection, scaling and the grid see the training rows alone. method: logistic, svc, forest, or
    anomaly, an isolation forest that takes y = 0 for outliers and their share from the training rows. With a model of
    `estimate_biotypes`, y of each fold is the biotype, fitted to its training rows (`db` then has arrays `x` and
    `scores`, and y, for the folds, is the biotype of the full sample). `null` shuffles y within the training and the
    test rows. `iterations` repeats all with other folds. `options` go to the grid.
    """
    from panelforge.operators.prepare import shuffle_labels

    spark, keys = db.sparkSession, ["i", "fold", "split", "n_features"]
    tables, predictions, settings = [], [], []
    for i in range(iterations):
        folded = splits.stratified_kfold(db, "subject", "y", k, seed + i).persist()
        # labels that change with the fold need templates of their own
        at_once = features.all_folds(folded, k) if hasattr(features, "all_folds") and biotypes is None and not null else None
        for fold in range(k):
            rows = folded.withColumn("split", F.when(F.col("fold") == fold, "test").otherwise("train"))
            if biotypes is not None:
                rows = _biotyped(rows, biotypes)
            if null:
                rows = shuffle_labels(rows, "subject", "y", ["split"], seed + 1000 * i + fold).drop("y").withColumnRenamed("shuffled", "y")
            if features is not None:
                known = rows.select("subject", "y", "split")
                rows = rows.drop("features").join(features(known) if at_once is None else at_once(fold, known), "subject")
            rows = rows.persist()
            train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
            if select is not None:
                kept = sorted(r["feature"] for r in forest_select(vectors(train), select, select_trees, seed).collect())
                pick = lambda df, kept=kept: df.withColumn("features", F.array(*(F.col("features")[j] for j in kept)))
                train, test = pick(train), pick(test)
            width = len(train.select("features").first()[0])
            if method == "anomaly":
                share = train.agg(F.avg((F.col("y") == 0).cast("double"))).first()[0]
                trees = {"sample": width, "seed": seed} | options
                guess = anomalies(train, share, **trees)
                best = {}
            else:
                fitted = vectors(train).persist()
                model, best = {"logistic": fit_logistic_grid, "svc": fit_svc_grid, "forest": fit_forest_grid}[method](fitted, seed=seed, **options)
                fitted.unpersist()
                guess = lambda df, model=model: predict(model, vectors(df))
            both = guess(train).withColumn("split", F.lit("train")).unionByName(guess(test).withColumn("split", F.lit("test")))
            both = both.withColumns({"i": F.lit(i), "fold": F.lit(fold), "n_features": F.lit(width)})
            # a row for each pair of classes; predictions, when they are read, follow from the fitted model
            tables += metrics.confusion_table(both, keys).collect()
            predictions.append(both.filter("split = 'test'").select("i", "fold", "subject", F.col("actual").alias("y_actual"), F.col("predicted").alias("y_predictions")))
            settings.append((i, fold, {name: str(value) for name, value in best.items()}))
            rows.unpersist()
        folded.unpersist()
    confusion = spark.createDataFrame([tuple(r) for r in tables], "i int, fold int, split string, n_features int, actual int, predicted int, n long")
    join = lambda dfs: dfs[0] if len(dfs) == 1 else join(dfs[: len(dfs) // 2]).unionByName(join(dfs[len(dfs) // 2 :]))
    names = sorted({name for _, _, best in settings for name in best})
    chosen = spark.createDataFrame([(i, fold, *(best.get(c) for c in names)) for i, fold, best in settings], ", ".join(["i int, fold int", *(f"{c} string" for c in names)]))
    return Results(metrics.classification_metrics(confusion, keys), join(predictions), chosen)


def diagnostics(train: DataFrame, test: DataFrame, bins: int = 20, exponents=DEFAULTS.sparsity_exponents, max_iter: int = 50) -> dict:
    """First-fold report: distributions of y and X, top three components by class, the sparsity path, and the matrix itself
    (`subject, y, split, features`), which `sources.files.dump_matrix` writes."""
    from panelforge.operators.multivariate import pca_reduce
    from panelforge.operators.summaries import histogram

    long = train.select(F.explode("features").alias("value"))
    return {
        "y": train.groupBy("y").count(),
        "x": histogram(long, "value", bins),
        "scores": pca_reduce(train, 3)[0].select("subject", "y", "comps"),
        "path": sparsity_path(vectors(train), vectors(test), exponents, max_iter=max_iter),
        "matrix": train.select("subject", "y", F.lit("train").alias("split"), "features").unionByName(test.select("subject", "y", F.lit("test").alias("split"), "features")),
    }
