"""Queries of models and multivariate statistics; SQL expresses residuals, tests hold the others against dense computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.series import rounded
from panelforge.operators import features, folds, models, prepare, standard
from panelforge.operators import multivariate as mv
from panelforge.plans.basics import R, _corr, _z, residual_steps
from panelforge.sources import domain
from panelforge.sources.domain import LI

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _binary(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings with y: whether the sum of the first four components is positive."""
    return domain.features_wide(spark, d).withColumn("y", F.when(F.aggregate(F.slice("features", 1, 4), F.lit(0.0), lambda s, v: s + v) > 0, 1).otherwise(0))


def _two_sides(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 40 + 24 columns; the second side leans on the first."""
    wide = domain.features_wide(spark, d)
    x = F.slice("features", 1, 40)
    return wide.select("subject", x.alias("x"), F.transform(F.slice("features", 41, 24), lambda v, i: v + 0.5 * F.get(x, i)).alias("y"))


def _split(df: DataFrame, y: str = "y"):
    rows = folds.stratified_kfold(df, "subject", y, 4)
    return rows.filter("fold != 0").drop("fold"), rows.filter("fold = 0").drop("fold")


@query
def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    out, _, _ = mv.pca_reduce(domain.features_wide(spark, d), 3)
    return out.select("subject", "label", *(rounded(F.col("comps")[i]).alias(f"pc{i + 1}") for i in range(3)))


def _fitted(spark: SparkSession, d: str, fit, **options) -> DataFrame:
    train, test = _split(_binary(spark, d))
    model, _ = fit(models.vectors(train), **options)
    return models.predict(model, models.vectors(test))


@query
def svc_cv(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, models.fit_svc_grid, max_iter=100)


@query
def logistic_cv(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, models.fit_logistic_grid)


@query
def forest_cv(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, models.fit_forest_grid, depths=(5,), impurities=("gini",), min_split=(2,), trees=50)


@query
def forest_select(spark: SparkSession, d: str) -> DataFrame:
    return models.forest_select(models.vectors(_binary(spark, d)), 16, trees=100)


@query
def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    return mv.isolation_forest(domain.features_wide(spark, d), 0.05, trees=1000).select("subject", rounded("score").alias("score"), "outlier")


@query
def sparsity_path(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(_binary(spark, d))
    return models.sparsity_path(models.vectors(train), models.vectors(test), max_iter=60)


@query
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return models.diagnostics(*_split(_binary(spark, d)), exponents=(0,), max_iter=15)["scores"].select("subject", "y", rounded(F.col("comps")[0]).alias("pc1"))


@query
def cross_validate(spark: SparkSession, d: str) -> DataFrame:
    """Correlations with templates, connectivity and states of the event panel, each fitted to a fold's training users,
    against a percentile split of the users' mean value."""
    panel = domain.events_panel(spark, d).persist()
    y = prepare.split_at_percentile(panel.groupBy("subject").agg(F.avg("v").alias("score")), "score").select("subject", "y")
    built = models.fold_features(panel, 5, length=10, step=2, n_states=3)
    found = models.cross_validate(y.persist(), 3, "logistic", features=built, max_iter=30)
    built.release()
    return found.metrics


@query
def kcca(spark: SparkSession, d: str) -> DataFrame:
    model = mv.kcca(_two_sides(spark, d), "x", "y", 1.0, 5)
    return spark.createDataFrame([(i, float(r)) for i, r in enumerate(model["cancorrs"])], "cc int, r double")


@query
def kcca_gaussian(spark: SparkSession, d: str) -> DataFrame:
    model = mv.kcca_kernel(_two_sides(spark, d), "x", "y", "gaussian", 1.0, 5)
    return spark.createDataFrame([(i, float(r)) for i, r in enumerate(model["cancorrs"])], "cc int, r double")


@query
def kcca_cv(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(mv.kcca_cross_validate(_two_sides(spark, d), "x", "y", "subject", (0.1, 1.0), (2, 5, 9))[0], "reg double, n_cc int, score double")


@query
def kcca_predict(spark: SparkSession, d: str) -> DataFrame:
    sides = _two_sides(spark, d)
    model = mv.kcca(sides, "x", "y", 1.0, 5)
    return mv.kcca_predict(sides, "x", "y", model).select("subject", rounded(F.col("pred_x")[0]).alias("x0"), rounded(F.col("pred_y")[0]).alias("y0"))


@query
def kcca_validate(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(mv.kcca_validate(mv.kcca(_two_sides(spark, d), "x", "y", 1.0, 5)), "side string, feature int, r double")


@query
def cca_explained_variance(spark: SparkSession, d: str) -> DataFrame:
    sides = _two_sides(spark, d)
    return mv.explained_variance(sides, "x", "y", mv.kcca(sides, "x", "y", 1.0, 3))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return mv.pca_reduce(domain.features_wide(spark, d), 3)[0].select("subject", "label", "features", "comps")


@query
def ward_clusters(spark: SparkSession, d: str) -> DataFrame:
    return mv.ward_clusters(_points(spark, d), 4).select("subject", "cluster")


@query
def lda_project(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(_points(spark, d), "label")
    return mv.lda_project(train, test, "label").select("subject", "label", "cluster")


@query
def match_labels(spark: SparkSession, d: str) -> DataFrame:
    return mv.match_labels(mv.ward_clusters(_points(spark, d), 4).withColumn("other", F.col("label") % 4), "cluster", "other")


@query
def cluster_stability(spark: SparkSession, d: str) -> DataFrame:
    return mv.cluster_stability(_points(spark, d), range(2, 5), 8)


@query
def estimate_biotypes(spark: SparkSession, d: str) -> DataFrame:
    return mv.estimate_biotypes(_two_sides(spark, d), "x", "y", k=3, keep=20)["clusters"]


@query
def apply_biotypes(spark: SparkSession, d: str) -> DataFrame:
    sides = _two_sides(spark, d)
    model = mv.estimate_biotypes(sides, "x", "y", k=3, keep=20)
    rows = folds.kfold(sides, "subject", 4)
    return mv.apply_biotypes(rows.filter("fold != 0"), rows.filter("fold = 0"), "x", "y", model)[1].select("subject", "cluster")


@query
def mdmr(spark: SparkSession, d: str) -> DataFrame:
    w = domain.features_wide(spark, d).select("subject", F.slice("features", 1, 3).alias("x"), F.slice("features", 4, 61).alias("y"))
    return mv.mdmr(w, "x", "y", 1000)


@query
def mdmr_importances(spark: SparkSession, d: str) -> DataFrame:
    w = domain.features_wide(spark, d).select("subject", F.slice("features", 1, 3).alias("x"), F.slice("features", 4, 61).alias("y"))
    return mv.mdmr_importances(w, "x", "y", 500)


@query
def residual_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's first edge without what its nation and balance explain."""
    from panelforge.sources.domain import table

    edges = features.connectivity(domain.to_series(domain.lineitem_panel(spark, d, ("qty",)))).select("subject", F.col("edges")[0].alias("edge0"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"), F.col("s_nationkey").cast("double").alias("nation"), "s_acctbal")
    return standard.residualize(edges.join(s, "subject"), ["edge0"], ["nation", "s_acctbal"]).select("subject", rounded("res_edge0").alias("res_edge0"))


SQL["residual_connectivity"] = f"""WITH {LI}, e AS (SELECT a.subject, {_corr('a.v', 'b.v')} AS edge0 FROM qty a JOIN qty b ON a.subject = b.subject AND a.t = b.t AND a.roi = 0 AND b.roi = 1 GROUP BY a.subject),
db AS (SELECT subject, edge0, s_nationkey, s_acctbal FROM e JOIN supplier ON subject = s_suppkey),
r0 AS (SELECT subject, {_z('s_nationkey')} AS a, {_z('s_acctbal')} AS b, {_z('edge0')} AS y FROM db),
{residual_steps(['a', 'b', 'y'])} SELECT subject, {R('y')} AS res_edge0 FROM r2"""
