"""Queries of correlation features, windows and templates, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.series import rounded
from panelforge.operators import features, prepare, folds
from panelforge.plans.basics import CONN, TAPER, R, _corr
from panelforge.sources import domain
from panelforge.sources.domain import EV, LI, VOX, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {EV}, c AS ({CONN}) SELECT subject, experiment, edge::INT AS edge, {R('r')} AS r FROM c")
def connectivity(spark: SparkSession, d: str) -> DataFrame:
    c = features.connectivity(domain.to_series(domain.events_panel(spark, d)))
    return features.edges_long(c).select("subject", "experiment", "edge", rounded("r").alias("r"))


@query(SQL["connectivity"])
def connectivity_join(spark: SparkSession, d: str) -> DataFrame:
    return features.connectivity_long(domain.events_panel(spark, d), 5).select("subject", "experiment", "edge", rounded("r").alias("r"))


def _dynamic(source: str, rois: int, length: int, step: int, t: int) -> str:
    count = features.window_count(t, length, step)
    return f"""z AS (SELECT subject, experiment, roi, t, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS z FROM {source} WINDOW w AS (PARTITION BY subject, experiment, roi)),
  w AS (SELECT subject, experiment, roi, win, t, z * ({TAPER.format(n=length - 1).replace('pos', f'(t - win * {step})')}) AS v FROM z, range(0, {count}) g(win) WHERE t >= win * {step} AND t < win * {step} + {length})
SELECT a.subject, a.experiment, a.win::INT AS win, (a.roi * {rois - 1} - a.roi * (a.roi - 1) // 2 + b.roi - a.roi - 1)::INT AS edge, {R(_corr('a.v', 'b.v'))} AS r
FROM w a JOIN w b ON a.subject = b.subject AND a.experiment = b.experiment AND a.win = b.win AND a.t = b.t AND a.roi < b.roi GROUP BY a.subject, a.experiment, a.win, a.roi, b.roi"""


@query(f"WITH {EV}, {_dynamic('ev', 5, 10, 2, 30)}")
def dynamic_connectivity(spark: SparkSession, d: str) -> DataFrame:
    w = features.dynamic_connectivity(domain.to_series(domain.events_panel(spark, d)), 10, 2)
    return features.edges_long(w).select("subject", "experiment", "win", "edge", rounded("r").alias("r"))


@query(f"WITH {LI}, {_dynamic('both_panels', 7, 30, 4, 83)}")
def dynamic_connectivity_lines(spark: SparkSession, d: str) -> DataFrame:
    w = features.dynamic_connectivity(domain.to_series(domain.lineitem_panel(spark, d)))
    return features.edges_long(w).select("subject", "experiment", "win", "edge", rounded("r").alias("r"))


Z = "z AS (SELECT subject, experiment, roi, t, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS z FROM {0} WINDOW w AS (PARTITION BY subject, experiment, roi))"


def _even(spark: SparkSession, d: str, z: DataFrame) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"), (F.col("s_nationkey") % 2 == 0).alias("even"))
    return z.join(s, "subject")


@query(f"WITH {LI}, {Z.format('qty')} SELECT experiment, roi, t, {R('avg(z)')} AS mean FROM z JOIN supplier ON subject = s_suppkey WHERE s_nationkey % 2 = 0 GROUP BY 1, 2, 3")
def select_group_template(spark: SparkSession, d: str) -> DataFrame:
    z = _even(spark, d, features.zscored(domain.lineitem_panel(spark, d, ("qty",))))
    z = prepare.select_group(z, "even", True)
    return features.template_sums(z, []).select("experiment", "roi", "t", rounded(F.col("s") / F.col("n")).alias("mean"))


@query(f"""WITH {LI}, {Z.format('both_panels')}, f AS (SELECT subject, (row_number() OVER (ORDER BY md5('0:' || subject), subject) - 1) % 5 AS fold FROM (SELECT DISTINCT subject FROM li))
SELECT k::INT AS fold, experiment, roi, t, {R('avg(z)')} AS mean FROM z JOIN f USING (subject), range(0, 5) g(k) WHERE fold <> k GROUP BY 1, 2, 3, 4""")
def template_mean_folds(spark: SparkSession, d: str) -> DataFrame:
    z = features.zscored(domain.lineitem_panel(spark, d))
    f = folds.kfold(z.select("subject").distinct(), "subject", 5)
    return features.training_templates(z.join(f, "subject"), []).select("fold", "experiment", "roi", "t", rounded("mean").alias("mean"))


def _inter(flag: str, rois: int = 7) -> str:
    return f"""s AS (SELECT experiment, roi, t, sum(z) AS s, count(*) AS n FROM z JOIN g USING (subject) WHERE {flag} GROUP BY 1, 2, 3),
m AS (SELECT z.subject, z.experiment, z.roi, z.t, (s.s - CASE WHEN {flag} THEN z.z ELSE 0 END) / nullif(s.n - ({flag})::INT, 0) AS m FROM z JOIN g USING (subject) JOIN s ON s.experiment = z.experiment AND s.roi = z.roi AND s.t = z.t)
SELECT a.subject, a.experiment, a.roi AS i, b.roi AS j, a.roi * {rois} - a.roi * (a.roi - 1) // 2 + b.roi - a.roi AS feature, {_corr('a.m', 'b.z')} AS r
FROM m a JOIN z b ON a.subject = b.subject AND a.experiment = b.experiment AND a.t = b.t AND a.roi <= b.roi GROUP BY ALL"""


EVEN = "g AS (SELECT s_suppkey AS subject, s_nationkey % 2 = 0 AS even FROM supplier)"


@query(f"WITH {LI}, {Z.format('qty')}, {EVEN}, r AS (WITH {_inter('even')}) SELECT subject, experiment, feature::INT AS feature, {R('r')} AS r FROM r")
def intersubject_corr(spark: SparkSession, d: str) -> DataFrame:
    z = _even(spark, d, features.zscored(domain.lineitem_panel(spark, d, ("qty",))))
    return features.intersubject_matrices(z, "even", 7).select("subject", "experiment", "feature", rounded("r").alias("r"))


@query(SQL["intersubject_corr"])
def intersubject_join(spark: SparkSession, d: str) -> DataFrame:
    z = _even(spark, d, features.zscored(domain.lineitem_panel(spark, d, ("qty",))))
    return features.intersubject(z, "even", 7).select("subject", "experiment", "feature", rounded("r").alias("r"))


@query(f"WITH {LI}, {Z.format('qty')}, {EVEN}, r AS (WITH {_inter('even')}) SELECT subject, experiment, feature::INT AS feature, {R('r')} AS r FROM r WHERE i = j")
def homologous_corr(spark: SparkSession, d: str) -> DataFrame:
    z = _even(spark, d, features.zscored(domain.lineitem_panel(spark, d, ("qty",))))
    return features.homologous_corr(z, "even", 7).select("subject", "experiment", "feature", rounded("r").alias("r"))


@query(f"""WITH {LI}, {Z.format('qty')}, {EVEN}, a AS (WITH {_inter('even')}), b AS (WITH {_inter('NOT even')})
SELECT a.subject, a.experiment, a.feature::INT AS feature, {R('a.r - b.r')} AS difference FROM a JOIN b USING (subject, experiment, feature)""")
def two_template_difference(spark: SparkSession, d: str) -> DataFrame:
    z = _even(spark, d, features.zscored(domain.lineitem_panel(spark, d, ("qty",)))).withColumn("odd", ~F.col("even"))
    out = features.template_difference(features.intersubject_matrices(z, "even", 7), features.intersubject_matrices(z, "odd", 7))
    return out.withColumn("difference", rounded("difference"))


@query(f"WITH {VOX} SELECT subject, map, roi, {R('avg(stat)')} AS mean FROM vox JOIN mask USING (voxel_id) WHERE roi <> 0 GROUP BY 1, 2, 3")
def roi_means(spark: SparkSession, d: str) -> DataFrame:
    return features.roi_means(domain.voxels(spark, d), domain.mask(spark, d)).select("subject", "map", "roi", rounded("mean").alias("mean"))


@query()
def dynamic_states(spark: SparkSession, d: str) -> DataFrame:
    w = features.dynamic_connectivity(domain.to_series(domain.events_panel(spark, d)), 10, 2)
    return features.dynamic_states(w.withColumn("half", F.pmod("subject", F.lit(2))), "half")


@query()
def state_occupancy(spark: SparkSession, d: str) -> DataFrame:
    w = features.dynamic_connectivity(domain.to_series(domain.events_panel(spark, d)), 10, 2)
    return features.state_occupancy(w, features.dynamic_states(w.withColumn("half", F.pmod("subject", F.lit(2))), "half"))
