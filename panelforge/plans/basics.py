"""Queries of cleaning, encoding, scaling, splitting, ranking and metrics, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import series as fx
from panelforge.functions.series import rounded
from panelforge.operators import features, folds, metrics, prepare, ranking, standard, summaries
from panelforge.sources import domain
from panelforge.sources.domain import DB, EV, LI, VOX, X, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def R(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def _corr(a: str, b: str) -> str:
    return f"coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0)"


SCORES = ["c_acctbal", "n_orders", "total_spend"]


@query(f"WITH {DB} SELECT subject, grp, {R('c_acctbal')} AS c_acctbal, n_orders, {R('total_spend')} AS total_spend FROM db WHERE n_orders IS NOT NULL AND total_spend IS NOT NULL AND c_acctbal IS NOT NULL AND grp IS NOT NULL")
def db_select_dropna(spark: SparkSession, d: str) -> DataFrame:
    db = prepare.drop_incomplete(prepare.select_columns(domain.database(spark, d), "subject", "grp", "c_acctbal,n_orders,total_spend"))
    return db.withColumns({"c_acctbal": rounded("c_acctbal"), "total_spend": rounded("total_spend")})


@query(f"WITH {X}, y AS (SELECT subject, feature, CASE WHEN feature = 7 THEN 0 WHEN subject % 10 = 3 AND feature % 5 = 1 THEN 0 ELSE value END AS value FROM x) SELECT subject, feature, {R('value')} AS value FROM y WHERE feature IN (SELECT feature FROM y GROUP BY feature HAVING max(abs(value)) > 0)")
def matrix_clean(spark: SparkSession, d: str) -> DataFrame:
    x = domain.features_long(spark, d)
    gap = F.when(F.col("feature") == 7, 0.0).when((F.col("subject") % 10 == 3) & (F.col("feature") % 5 == 1), None).otherwise(F.col("value"))
    return prepare.clean(x.withColumn("value", gap)).select("subject", "feature", rounded("value").alias("value"))


@query(f"WITH {X} SELECT subject, {R('sum(CASE WHEN feature % 9 = 4 THEN 0 ELSE value END)')} AS total FROM x GROUP BY subject")
def vector_scrub(spark: SparkSession, d: str) -> DataFrame:
    x = domain.features_long(spark, d).withColumn("value", F.when(F.col("feature") % 9 == 4, float("nan")).otherwise(F.col("value")))
    return prepare.scrub(x).groupBy("subject").agg(rounded(F.sum("value")).alias("total"))


@query(f"""WITH {LI}, {VOX},
e AS (SELECT a.subject, a.roi * 6 - a.roi * (a.roi - 1) // 2 + b.roi - a.roi - 1 AS pos, {_corr('a.v', 'b.v')} AS value FROM qty a JOIN qty b ON a.subject = b.subject AND a.t = b.t AND a.roi < b.roi GROUP BY a.subject, a.roi, b.roi),
m AS (SELECT s.subject, 21 + s.k AS pos, ln(1 + coalesce(v.mean, 0)) AS value FROM (SELECT * FROM (SELECT DISTINCT subject FROM vox), (SELECT roi, row_number() OVER (ORDER BY roi) - 1 AS k FROM (SELECT DISTINCT roi FROM mask WHERE roi <> 0))) s
  LEFT JOIN (SELECT subject, roi, avg(stat) AS mean FROM vox JOIN mask USING (voxel_id) WHERE roi <> 0 GROUP BY 1, 2) v ON v.subject = s.subject AND v.roi = s.roi),
r AS (SELECT s_suppkey AS subject, 21 + (SELECT count(DISTINCT roi) FROM mask WHERE roi <> 0) AS pos, s_acctbal AS value FROM supplier WHERE s_suppkey IN (SELECT subject FROM vox)),
u AS (SELECT * FROM e UNION ALL SELECT * FROM m UNION ALL SELECT * FROM r)
SELECT subject, pos::INT AS pos, {R('value')} AS value FROM u""")
def assemble_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Edges, logarithms of regional means, and a raw column, side by side."""
    edges = features.connectivity(domain.to_series(domain.lineitem_panel(spark, d, ("qty",)))).select("subject", F.col("edges").alias("features"))
    voxels, mask = domain.voxels(spark, d), domain.mask(spark, d)
    rois = [r[0] for r in mask.filter("roi != 0").select("roi").distinct().orderBy("roi").collect()]  # the mask's regions
    means = features.roi_means(voxels, mask).groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("roi", "mean"))).alias("m"))
    means = voxels.select("subject").distinct().join(means, "subject", "left").select("subject", F.array(*(F.log1p(F.coalesce(F.col("m")[F.lit(r)], F.lit(0.0))) for r in rois)).alias("features"))
    raw = prepare.gather_columns(table(spark, d, "supplier"), "s_suppkey", ["s_acctbal"])
    return prepare.assemble_features([edges, means, raw]).select("subject", F.posexplode("features").alias("pos", "value")).select("subject", "pos", rounded("value").alias("value"))


@query(f"WITH {DB} SELECT subject, grp, (dense_rank() OVER (ORDER BY grp) - 1)::INT AS code, (grp = 'MACHINERY')::INT AS is_target FROM db")
def encode_classes(spark: SparkSession, d: str) -> DataFrame:
    return prepare.encode_classes(domain.database(spark, d).select("subject", "grp"), "grp", "MACHINERY").select("subject", "grp", "code", "is_target")


@query(f"WITH {DB} SELECT subject, CASE WHEN grp = 'BUILDING' THEN 1 ELSE 0 END AS y FROM db")
def one_vs_rest(spark: SparkSession, d: str) -> DataFrame:
    return prepare.one_vs_rest(domain.database(spark, d), "grp", "BUILDING").select("subject", "y")


@query(f"WITH {DB}, c AS (SELECT quantile_cont(c_acctbal, 0.25) AS cut FROM db) SELECT subject, CASE WHEN c_acctbal < cut THEN 0 WHEN c_acctbal >= cut THEN 1 END AS y, {R('cut')} AS cut FROM db, c")
def split_percentile(spark: SparkSession, d: str) -> DataFrame:
    return prepare.split_at_percentile(domain.database(spark, d), "c_acctbal", 0.25).select("subject", "y", rounded("cut").alias("cut"))


@query(f"""WITH {DB}, u AS (SELECT 'grp' AS variable, count(DISTINCT grp) AS n_distinct FROM db UNION ALL SELECT 'nation', count(DISTINCT nation) FROM db UNION ALL SELECT 'n_orders', count(DISTINCT n_orders) FROM db UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal) FROM db)
SELECT variable, n_distinct, CASE WHEN n_distinct > 9 THEN 'continuous' ELSE 'discrete' END AS kind FROM u""")
def infer_kind(spark: SparkSession, d: str) -> DataFrame:
    return prepare.infer_kind(domain.database(spark, d), ["grp", "nation", "n_orders", "c_acctbal"])


@query(f"""WITH {LI}, e AS (SELECT a.subject, a.roi AS i, b.roi AS j, {_corr('a.v', 'b.v')} AS v FROM qty a JOIN qty b ON a.subject = b.subject AND a.t = b.t GROUP BY ALL)
SELECT subject, 6 - i AS i, 6 - j AS j, {R('v')} AS v FROM e""")
def reorder_symmetric(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier's full correlation matrix, its regions in reverse."""
    p = domain.lineitem_panel(spark, d, ("qty",))
    other = p.select("subject", "t", F.col("roi").alias("j"), F.col("v").alias("w"))
    m = p.join(other, ["subject", "t"]).groupBy("subject", F.col("roi").alias("i"), "j").agg(fx.guarded_corr("v", "w").alias("v"))
    order = spark.range(7).select(F.col("id").cast("int").alias("old"), (6 - F.col("id")).cast("int").alias("new"))
    return prepare.reorder(m, order, by=["subject"]).withColumn("v", rounded("v"))


@query(f"""WITH {DB}, a AS (SELECT subject, grp, nation, row_number() OVER (PARTITION BY nation ORDER BY subject) AS nth, row_number() OVER (PARTITION BY nation ORDER BY md5('7:' || subject), subject) AS other FROM db)
SELECT a.subject, b.grp AS shuffled FROM a JOIN a b ON a.nation = b.nation AND a.nth = b.other""")
def shuffle_labels(spark: SparkSession, d: str) -> DataFrame:
    return prepare.shuffle_labels(domain.database(spark, d).select("subject", "grp", "nation"), "subject", "grp", ["nation"], 7).select("subject", "shuffled")


@query(f"WITH {EV}, m AS (SELECT *, avg(v) OVER (PARTITION BY subject, roi) AS mean FROM ev) SELECT subject, roi, t, {R('(v - mean) / nullif(mean, 0) * 100')} AS pct FROM m")
def series_pct_change(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    mean = F.avg("v").over(Window.partitionBy("subject", "roi"))
    return domain.events_panel(spark, d).select("subject", "roi", "t", rounded(fx.percent_change(F.col("v"), mean)).alias("pct"))


@query(f"WITH {EV}, m AS (SELECT *, avg(v) OVER (PARTITION BY subject, roi) AS mean, stddev_pop(v) OVER (PARTITION BY subject, roi) AS sd FROM ev) SELECT subject, roi, t, {R('coalesce((v - mean) / nullif(sd, 0), 0)')} AS z FROM m")
def series_zscore(spark: SparkSession, d: str) -> DataFrame:
    return features.zscored(domain.events_panel(spark, d)).select("subject", "roi", "t", rounded("z").alias("z"))


@query(f"""WITH {EV}, p AS (SELECT subject, roi, t, v FROM ev UNION ALL SELECT subject, roi, k AS t, 0.0 FROM (SELECT DISTINCT subject, roi FROM ev), (VALUES (-2), (-1), (30), (31)) g(k)),
f AS (SELECT subject, roi, t, median(v) OVER (PARTITION BY subject, roi ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM p)
SELECT subject, roi, t, {R('m')} AS filtered FROM f WHERE t BETWEEN 0 AND 29""")
def series_median_filter(spark: SparkSession, d: str) -> DataFrame:
    return features.median_filtered(domain.events_panel(spark, d)).select("subject", "roi", "t", rounded("filtered").alias("filtered"))


TAPER = "CASE WHEN pos / {n}.0 < 0.375 THEN 0.5 * (1 + cos(2 * pi() / 0.75 * (pos / {n}.0 - 0.375))) WHEN pos / {n}.0 >= 0.625 THEN 0.5 * (1 + cos(2 * pi() / 0.75 * (pos / {n}.0 - 0.625))) ELSE 1 END"


@query(f"WITH {EV}, e AS (SELECT subject, roi, t AS pos, v FROM ev) SELECT subject, roi, {R('sum(v * ' + TAPER.format(n=29) + ')')} AS tapered FROM e GROUP BY subject, roi")
def tukey_taper(spark: SparkSession, d: str) -> DataFrame:
    """Each series' sum under the taper."""
    weight = fx.tukey(F.col("t"), domain.EV_T)
    return domain.events_panel(spark, d).groupBy("subject", "roi").agg(rounded(F.sum(F.col("v") * weight)).alias("tapered"))


@query(f"WITH {DB} SELECT subject, unnest([-2, -1, 0, 1, 2]) AS e, {R('pow(2.0, unnest([-2, -1, 0, 1, 2])) * nation')} AS scaled FROM db")
def power_grid(spark: SparkSession, d: str) -> DataFrame:
    exps = F.array(*map(F.lit, range(-2, 3)))
    pairs = F.arrays_zip(exps.alias("e"), fx.power_grid(2.0, exps).alias("p"))
    return domain.database(spark, d).select("subject", "nation", F.explode(pairs).alias("x")).select("subject", F.col("x.e").alias("e"), rounded(F.col("x.p") * F.col("nation")).alias("scaled"))


CONN = f"""SELECT a.subject, a.experiment, a.roi * 4 - a.roi * (a.roi - 1) // 2 + b.roi - a.roi - 1 AS edge, {_corr('a.v', 'b.v')} AS r
  FROM ev a JOIN ev b ON a.subject = b.subject AND a.t = b.t AND a.roi < b.roi GROUP BY a.subject, a.experiment, a.roi, b.roi"""


@query(f"WITH {EV}, c AS ({CONN}) SELECT subject, edge::INT AS edge, {R('CASE WHEN abs(r) < 1 THEN 0.5 * ln((1 + r) / (1 - r)) END')} AS z, {R('sqrt(2 * (1 - r))')} AS distance FROM c")
def fisher_z_distance(spark: SparkSession, d: str) -> DataFrame:
    c = features.connectivity_long(domain.events_panel(spark, d), 5)
    return c.select("subject", "edge", rounded(fx.fisher_z(F.col("r"))).alias("z"), rounded(fx.corr_distance(F.col("r"))).alias("distance"))


@query(f"WITH {DB} SELECT subject, {R('3.0 * exp(-((c_acctbal - 1000) * (c_acctbal - 1000)) / (2 * 2500.0 * 2500.0))')} AS g FROM db")
def gauss_curve(spark: SparkSession, d: str) -> DataFrame:
    return domain.database(spark, d).select("subject", rounded(fx.gauss(F.col("c_acctbal"), 3.0, 1000.0, 2500.0)).alias("g"))


def _z(c: str, where: str = "") -> str:
    return f"({c} - (SELECT avg({c}) FROM db {where})) / (SELECT stddev_pop({c}) FROM db {where})"


@query(f"WITH {DB} SELECT subject, {', '.join(f'{R(_z(c))} AS z_{c}' for c in SCORES)} FROM db")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    return standard.standardize(domain.database(spark, d), SCORES).select("subject", *(rounded(f"z_{c}").alias(f"z_{c}") for c in SCORES))


_BY_GROUP = "WHERE grp = 'BUILDING'"


@query(f"WITH {DB} SELECT subject, {', '.join(f'{R(_z(c, _BY_GROUP))} AS z_{c}' for c in SCORES)} FROM db")
def standardize_by_group(spark: SparkSession, d: str) -> DataFrame:
    return standard.standardize_by_group(domain.database(spark, d), SCORES, "grp", "BUILDING").select("subject", *(rounded(f"z_{c}").alias(f"z_{c}") for c in SCORES))


FOLD5 = "(row_number() OVER (ORDER BY md5('0:' || subject), subject) - 1) % 5"


@query(f"WITH {DB.replace('db AS', 'db0 AS')}, db AS (SELECT *, {FOLD5} = 0 AS is_test FROM db0) SELECT subject, is_test, {', '.join(f'{R(_z(c, 'WHERE NOT is_test'))} AS z_{c}' for c in SCORES)} FROM db")
def scale_train_test(spark: SparkSession, d: str) -> DataFrame:
    db = folds.kfold(domain.database(spark, d), "subject", 5).withColumn("is_test", F.col("fold") == 0)
    return standard.scale_train_test(db, SCORES, "is_test").select("subject", "is_test", *(rounded(f"z_{c}").alias(f"z_{c}") for c in SCORES))


@query(f"""WITH {DB}, z AS (SELECT subject, {_z('c_acctbal')} AS y, {_z('nation')} AS c FROM db), b AS (SELECT regr_slope(y, c) AS s, regr_intercept(y, c) AS i FROM z)
SELECT subject, {R('y - s * c - i')} AS res_c_acctbal FROM z, b""")
def residualize_one(spark: SparkSession, d: str) -> DataFrame:
    return standard.residualize(domain.database(spark, d), ["c_acctbal"], ["nation"]).select("subject", rounded("res_c_acctbal").alias("res_c_acctbal"))


def residual_steps(columns: list[str]) -> str:
    """CTEs r1, r2, ... after `r0`: each takes out of the later columns what the first one left explains; the last has the last column's residual."""
    steps = []
    for k, by in enumerate(columns[:-1]):
        rest = columns[k + 1 :]
        fit = ", ".join(f"regr_slope({x}, {by}) AS s_{x}, regr_intercept({x}, {by}) AS i_{x}" for x in rest)
        steps.append(f"r{k + 1} AS (SELECT subject, {', '.join(f'{x} - s_{x} * {by} - i_{x} AS {x}' for x in rest)} FROM r{k}, (SELECT {fit} FROM r{k}))")
    return ", ".join(steps)


@query(f"""WITH {DB}, r0 AS (SELECT subject, CASE WHEN n_orders IS NOT NULL THEN {_z('nation')} END AS a, CASE WHEN n_orders IS NOT NULL THEN {_z('c_acctbal')} END AS b, {_z('n_orders')} AS c, {_z('total_spend')} AS y FROM db),
{residual_steps(['a', 'b', 'c', 'y'])} SELECT subject, {R('y')} AS res_total_spend FROM r3""")
def residualize_many(spark: SparkSession, d: str) -> DataFrame:
    return standard.residualize(domain.database(spark, d), ["total_spend"], ["nation", "c_acctbal", "n_orders"]).select("subject", rounded("res_total_spend").alias("res_total_spend"))


@query(f"""WITH {DB}, e AS (SELECT min(c_acctbal) AS low, max(c_acctbal) AS high, count(c_acctbal) AS total FROM db)
SELECT least(floor((c_acctbal - low) / ((high - low) / 20)), 19)::INT AS bin, count(*) AS n, {R('count(*) / (any_value(total) * ((any_value(high) - any_value(low)) / 20))')} AS density FROM db, e GROUP BY 1""")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return summaries.histogram(domain.database(spark, d), "c_acctbal", 20).select("bin", "n", rounded("density").alias("density"))


@query()
def outlier_split(spark: SparkSession, d: str) -> DataFrame:
    """Users by the logarithm of what their events are worth."""
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("subject")).agg(F.log1p(F.abs(F.sum("value"))).alias("score"))
    return summaries.find_outliers(users, "score", 1.0).select("subject", "y", rounded("cut").alias("cut"))


@query(f"SELECT {R('quantile_cont(value, 0.025)')} AS low, {R('quantile_cont(value, 0.975)')} AS high FROM events")
def significance_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return summaries.significance_cutoffs(table(spark, d, "events"), "value").select(rounded("low").alias("low"), rounded("high").alias("high"))


@query(f"WITH {X} SELECT label AS cluster, feature, {R('avg(value)')} AS centroid FROM x GROUP BY 1, 2")
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    return summaries.cluster_centroids(domain.features_long(spark, d)).select("cluster", "feature", rounded("centroid").alias("centroid"))


def _comps(x: DataFrame) -> DataFrame:
    return x.filter("feature < 3").select("subject", F.col("feature").alias("cc"), F.col("value").alias("c"))


@query(f"""WITH {X}, s AS (SELECT vec_id AS subject, unnest(['label', 'vec']) AS score, unnest([label::DOUBLE, (vec_id % 17)::DOUBLE]) AS y FROM embeddings), c AS (SELECT subject, feature AS cc, value AS c FROM x WHERE feature < 3)
SELECT score, cc, {R(_corr('y', 'c'))} AS r FROM s JOIN c USING (subject) GROUP BY 1, 2""")
def score_loadings(spark: SparkSession, d: str) -> DataFrame:
    scores = domain.features_wide(spark, d).select("subject", F.explode(F.array(F.struct(F.lit("label").alias("score"), F.col("label").cast("double").alias("y")), F.struct(F.lit("vec").alias("score"), (F.col("subject") % 17).cast("double").alias("y")))).alias("x")).select("subject", "x.*")
    return summaries.score_loadings(scores, _comps(domain.features_long(spark, d))).select("score", "cc", rounded("r").alias("r"))


@query(f"WITH {X}, c AS (SELECT subject, feature AS cc, value AS c FROM x WHERE feature < 3) SELECT feature, cc, {R(_corr('value', 'c'))} AS r FROM x JOIN c USING (subject) GROUP BY 1, 2")
def edge_loadings(spark: SparkSession, d: str) -> DataFrame:
    x = domain.features_long(spark, d)
    return summaries.edge_loadings(x.drop("label"), _comps(x)).select("feature", "cc", rounded("r").alias("r"))


@query(f"""WITH {LI}, e AS (SELECT a.subject, a.roi AS i, b.roi AS j, {_corr('a.v', 'b.v')} AS r FROM qty a JOIN qty b ON a.subject = b.subject AND a.t = b.t AND a.roi < b.roi GROUP BY ALL),
m AS (SELECT subject, i AS roi, r FROM e UNION ALL SELECT subject, j, r FROM e)
SELECT subject, roi, {R('sum(greatest(r, 0)) / 7')} AS positive, {R('sum(least(r, 0)) / 7')} AS negative FROM m GROUP BY 1, 2""")
def roi_loading_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's matrix as one component."""
    p = domain.lineitem_panel(spark, d, ("qty",))
    other = p.select("subject", "t", F.col("roi").alias("roi_j"), F.col("v").alias("w"))
    e = p.join(other, ["subject", "t"]).filter("roi < roi_j").groupBy(F.col("subject").alias("cc"), F.col("roi").alias("roi_i"), "roi_j").agg(fx.guarded_corr("v", "w").alias("r"))
    return summaries.roi_loading_summary(e, 7).select(F.col("cc").alias("subject"), "roi", rounded("positive").alias("positive"), rounded("negative").alias("negative"))


@query(f"""WITH {DB}, z AS (SELECT grp, {', '.join(f'{_z(c)} AS {c}' for c in SCORES)} FROM db), l AS (UNPIVOT z ON {', '.join(SCORES)} INTO NAME variable VALUE v)
SELECT variable, grp, {R('min(v)')} AS low, {R('quantile_cont(v, 0.25)')} AS q25, {R('quantile_cont(v, 0.5)')} AS q50, {R('quantile_cont(v, 0.75)')} AS q75, {R('max(v)')} AS high, count(v) AS n FROM l WHERE v IS NOT NULL GROUP BY 1, 2""")
def cluster_score_summary(spark: SparkSession, d: str) -> DataFrame:
    s = summaries.cluster_score_summary(domain.database(spark, d), SCORES, "grp")
    return s.select("variable", "grp", *(rounded(c).alias(c) for c in ("low", "q25", "q50", "q75", "high")), "n")


@query(f"WITH {DB} SELECT subject, ({FOLD5})::INT AS fold FROM db")
def kfold(spark: SparkSession, d: str) -> DataFrame:
    return folds.kfold(domain.database(spark, d), "subject", 5).select("subject", "fold")


@query(f"WITH {DB} SELECT subject, grp, ((row_number() OVER (PARTITION BY grp ORDER BY md5('3:' || subject), subject) - 1) % 10)::INT AS fold FROM db")
def stratified_kfold(spark: SparkSession, d: str) -> DataFrame:
    return folds.stratified_kfold(domain.database(spark, d), "subject", "grp", 10, 3).select("subject", "grp", "fold")


@query(f"WITH {DB}, f AS (SELECT subject, {FOLD5} AS fold FROM db) SELECT k AS fold_id, fold = k AS is_test, count(*) AS n, min(subject) AS first FROM f, range(0, 5) g(k) GROUP BY 1, 2")
def train_test(spark: SparkSession, d: str) -> DataFrame:
    f = folds.train_test(folds.kfold(domain.database(spark, d), "subject", 5), 5)
    return f.groupBy("fold_id", "is_test").agg(F.count("*").alias("n"), F.min("subject").alias("first"))


@query(f"WITH {DB} SELECT subject, (row_number() OVER (ORDER BY md5('6:' || subject), subject) - 1 >= (SELECT count(*) FROM db) // 2)::INT AS half FROM db")
def half_split(spark: SparkSession, d: str) -> DataFrame:
    return folds.half_split(domain.database(spark, d), "subject", 1, 5).select("subject", "half")


@query(f"""WITH {DB}, n AS (SELECT count(*) AS n, CASE WHEN count(*) > 50 THEN 10 ELSE 1 END AS len FROM db),
c AS (SELECT g.c, row_number() OVER (ORDER BY md5('2:1:' || g.c)) AS nth FROM n, range(0, (n.n // n.len)::BIGINT) g(c)),
r AS (SELECT subject, (row_number() OVER (ORDER BY subject) - 1) // (SELECT len FROM n) AS chunk FROM db)
SELECT subject, coalesce(nth <= floor(0.2 * (SELECT n FROM n) / (SELECT len FROM n)), false) AS held_out FROM r LEFT JOIN c ON r.chunk = c.c""")
def block_holdout(spark: SparkSession, d: str) -> DataFrame:
    return folds.block_holdout(domain.database(spark, d), "subject", 1, 2).select("subject", "held_out")


@query(f"WITH {DB} SELECT subject, rank() OVER (ORDER BY nation) + (count(*) OVER (PARTITION BY nation) - 1) / 2.0 AS rank FROM db")
def average_rank(spark: SparkSession, d: str) -> DataFrame:
    long = domain.database(spark, d).select("subject", F.lit("nation").alias("feature"), F.col("nation").alias("value"))
    return ranking.average_rank(long).select("subject", F.col("rank").cast("double").alias("rank"))


@query(f"WITH {X}, s AS (SELECT feature, max(value) AS importance FROM x GROUP BY 1) SELECT feature, {R('importance')} AS importance FROM s WHERE importance >= (SELECT min(importance) FROM (SELECT importance FROM s ORDER BY importance DESC LIMIT 10))")
def top_features(spark: SparkSession, d: str) -> DataFrame:
    s = domain.features_long(spark, d).groupBy("feature").agg(F.max("value").alias("importance"))
    return ranking.top_features(s, 10).select("feature", rounded("importance").alias("importance"))


@query(f"""WITH {X}, e AS (SELECT feature AS k, var_pop(value) AS ev FROM x GROUP BY 1), c AS (SELECT k, ev, sum(ev) OVER (ORDER BY k) / (SELECT sum(ev) FROM e) AS cumulative FROM e)
SELECT k, {R('cumulative')} AS cumulative, cumulative >= 0.5 AND coalesce(lag(cumulative) OVER (ORDER BY k), 0) < 0.5 AS first FROM c""")
def cumulative_variance(spark: SparkSession, d: str) -> DataFrame:
    ev = domain.features_long(spark, d).groupBy(F.col("feature").alias("k")).agg(F.var_pop("value").alias("ev"))
    return ranking.cumulative_variance(ev, 0.5).select("k", rounded("cumulative").alias("cumulative"), "first")


@query(f"WITH {X}, s AS (SELECT feature, round(avg(value), 2) AS score FROM x GROUP BY 1) SELECT feature, {R('score')} AS score FROM s ORDER BY s.score DESC, feature LIMIT 1")
def best_setting(spark: SparkSession, d: str) -> DataFrame:
    s = domain.features_long(spark, d).groupBy("feature").agg(F.round(F.avg("value"), 2).alias("score"))
    return ranking.best_setting(s, "score", "feature").select("feature", rounded("score").alias("score"))


@query("SELECT DISTINCT o_custkey AS id, 'both' AS side FROM orders UNION SELECT c_custkey, 'both' FROM customer UNION SELECT c_custkey, 'no orders' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def label_universe(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return ranking.label_universe(a, b, "id").withColumn("side", F.lit("both")).unionByName(ranking.index_difference(b, a, "id").withColumn("side", F.lit("no orders")))


@query(f"""WITH {X}, s AS (SELECT vec_id AS subject, 'label' AS score, label::DOUBLE AS y FROM embeddings UNION ALL SELECT vec_id, 'mix', embedding[1]::DOUBLE + embedding[2]::DOUBLE FROM embeddings),
rx AS (SELECT subject, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM x),
ry AS (SELECT subject, score, rank() OVER (PARTITION BY score ORDER BY y) + (count(*) OVER (PARTITION BY score, y) - 1) / 2.0 AS q FROM s)
SELECT feature, score, {R(_corr('r', 'q'))} AS rho FROM rx JOIN ry USING (subject) GROUP BY 1, 2""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    x, y = _spearman_input(spark, d)
    return ranking.spearman(x, y).select("feature", "score", rounded("rho").alias("rho"))


def _spearman_input(spark: SparkSession, d: str):
    wide = domain.features_wide(spark, d)
    y = wide.select("subject", F.lit("label").alias("score"), F.col("label").cast("double").alias("y")).unionByName(wide.select("subject", F.lit("mix").alias("score"), (F.col("features")[0] + F.col("features")[1]).alias("y")))
    return domain.features_long(spark, d).drop("label"), y


@query(SQL["spearman"].replace("SELECT feature, score,", "SELECT feature, strength FROM (SELECT feature, (max(abs(rho)) + 0.0) AS strength FROM (SELECT feature, score,") + ") GROUP BY feature ORDER BY 2 DESC, 1 LIMIT 12)")
def spearman_screen(spark: SparkSession, d: str) -> DataFrame:
    return ranking.spearman_screen(*_spearman_input(spark, d), p=None, n=12).select("feature", rounded("strength").alias("strength"))


@query(f"WITH {X}, y AS (SELECT subject, feature, CASE WHEN feature IN (3, 40) THEN 2 ELSE value END AS value FROM x) SELECT feature, count(*) AS n FROM y GROUP BY 1 HAVING var_pop(value) > 0")
def variance_threshold(spark: SparkSession, d: str) -> DataFrame:
    x = domain.features_long(spark, d).withColumn("value", F.when(F.col("feature").isin(3, 40), 2.0).otherwise(F.col("value")))
    return ranking.variance_threshold(x).groupBy("feature").agg(F.count("*").alias("n"))


@query(f"WITH {DB}, c AS (SELECT grp, count(*) AS n FROM db GROUP BY 1) SELECT grp, n, {R('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)')} AS weight FROM c")
def balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    return ranking.balanced_weights(domain.database(spark, d), "grp").select("grp", "n", rounded("weight").alias("weight"))


PRED = """p AS (SELECT doc_id, (row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1) % 4 AS fold, quality AS actual, CASE WHEN n_chars > 1200 THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels USING (doc_id))"""


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("quality").alias("actual"), F.when(F.col("n_chars") > 1200, 1).otherwise(0).alias("predicted"))
    return folds.kfold(p, "doc_id", 4)


@query(f"WITH {PRED} SELECT fold::INT AS fold, actual, predicted, count(*) AS n FROM p GROUP BY ALL")
def confusion_table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_table(_predictions(spark, d), ["fold"])


METRIC_SQL = f"""{PRED}, c AS (SELECT fold, actual, predicted, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT fold, sum(n) AS n, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS ok FROM c GROUP BY 1),
l AS (SELECT fold, label, sum(p) AS p, sum(q) AS q, sum(tp) AS tp FROM (SELECT fold, actual AS label, n AS p, 0 AS q, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM c UNION ALL SELECT fold, predicted, 0, n, 0 FROM c) GROUP BY 1, 2),
x AS (SELECT fold, t.n, ok, p, q, tp, coalesce(tp / nullif(p, 0), 0) AS recall, coalesce(tp / nullif(q, 0), 0) AS prec, coalesce(2 * tp / nullif(p + q, 0), 0) AS f1, coalesce((t.n - p - q + tp) / nullif(t.n - p, 0), 0) AS tnr FROM l JOIN t USING (fold)),
m AS (SELECT fold::INT AS fold, max(ok / n) AS accuracy, avg(recall) AS recall_macro, avg(prec) AS precision_macro, avg(f1) AS f1_macro, max(ok / n) AS recall_micro, max(ok / n) AS precision_micro, max(ok / n) AS f1_micro,
  CASE WHEN sum((p > 0)::INT) > 1 THEN avg(CASE WHEN p > 0 THEN (recall + tnr) / 2 END) ELSE 0 END AS auc_macro,
  CASE WHEN sum((p > 0)::INT) > 1 THEN (max(ok / n) + coalesce(sum(n - p - q + tp) / nullif(sum(n - p), 0), 0)) / 2 ELSE 0 END AS auc_micro FROM x GROUP BY fold)"""


@query(f"WITH {METRIC_SQL} SELECT fold, {', '.join(f'{R(m)} AS {m}' for m in metrics.METRICS)} FROM m")
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.classification_metrics(metrics.confusion_table(_predictions(spark, d), ["fold"]), ["fold"])
    return m.select("fold", *(rounded(c).alias(c) for c in metrics.METRICS))


@query(f"WITH {METRIC_SQL}, u AS (UNPIVOT m ON accuracy, f1_macro, auc_macro INTO NAME metric VALUE v) SELECT metric, {R('avg(v)')} AS mean, {R('stddev_samp(v) / sqrt(count(v))')} AS sem FROM u GROUP BY 1")
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.classification_metrics(metrics.confusion_table(_predictions(spark, d), ["fold"]), ["fold"])
    return summaries.summarize_folds(m, ["accuracy", "f1_macro", "auc_macro"]).select("metric", rounded("mean").alias("mean"), rounded("sem").alias("sem"))


@query(f"WITH {DB} SELECT 'grp' AS name, (SELECT grp FROM db GROUP BY 1 ORDER BY count(*) DESC, grp LIMIT 1) AS summary UNION ALL SELECT 'nation', (SELECT median(nation) FROM db)::VARCHAR")
def hyperparameter_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.summarize_hyperparameters(domain.database(spark, d), ["grp"], ["nation"])


EDGES = f"x AS (SELECT a.subject, a.roi * 6 - a.roi * (a.roi - 1) // 2 + b.roi - a.roi - 1 AS feature, {_corr('a.v', 'b.v')} AS value FROM qty a JOIN qty b ON a.subject = b.subject AND a.t = b.t AND a.roi < b.roi GROUP BY a.subject, a.roi, b.roi)"


def _edge_features(spark: SparkSession, d: str) -> DataFrame:
    c = features.connectivity(domain.to_series(domain.lineitem_panel(spark, d, ("qty",))))
    return features.edges_long(c).select("subject", F.col("edge").alias("feature"), F.col("r").alias("value"))


@query(f"WITH {LI}, {EDGES} SELECT a.subject AS i, b.subject AS j, {R('sqrt(sum((a.value - b.value) * (a.value - b.value)))')} AS distance FROM x a JOIN x b ON a.feature = b.feature AND a.subject < b.subject GROUP BY 1, 2")
def pairwise_distance(spark: SparkSession, d: str) -> DataFrame:
    # rounded by the tasks that make the cells: for each pair as a column, rounding is most of the work
    return ranking.pairwise_distance(_edge_features(spark, d), digits=6)


@query(f"""WITH {LI}, {EDGES}, s AS (SELECT subject, avg(value) AS m, stddev_pop(value) AS sd FROM x GROUP BY 1), z AS (SELECT subject, feature, coalesce((value - m) / nullif(sd, 0), 0) AS z FROM x JOIN s USING (subject)),
d AS (SELECT a.subject AS i, b.subject AS j, CASE WHEN a.subject = b.subject THEN 0 ELSE -0.5 * greatest(2 * (1 - avg(a.z * b.z)), 0) END AS a FROM z a JOIN z b ON a.feature = b.feature GROUP BY 1, 2)
SELECT i, j, {R('a - avg(a) OVER (PARTITION BY i) - avg(a) OVER (PARTITION BY j) + (SELECT avg(a) FROM d)')} AS g FROM d""")
def gower_center(spark: SparkSession, d: str) -> DataFrame:
    return ranking.gower_centered(_edge_features(spark, d), "correlation", digits=6)


@query("SELECT (n_chars > 1200)::INT AS a, quality AS b, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def label_contingency(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).groupBy(F.col("predicted").alias("a"), F.col("actual").alias("b")).agg(F.count("*").alias("n"))
