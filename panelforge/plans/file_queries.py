"""Round trips of the given tables through the files that the library writes and reads, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.series import rounded
from panelforge.operators import folds, summaries
from panelforge.plans.basics import R
from panelforge.sources import domain, files
from panelforge.sources.domain import DB, LI, VOX, X

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {DB} SELECT subject::DOUBLE AS subject, grp, nation, {R('c_acctbal')} AS c_acctbal, n_orders, {R('total_spend')} AS total_spend FROM db")
def database_csv(spark: SparkSession, d: str) -> DataFrame:
    """The subject table as CSV with missing cells, read with the kinds of its columns inferred, its first column a text."""
    path = files.scratch(spark, "database")
    db = domain.database(spark, d).select("subject", "grp", "nation", "c_acctbal", "n_orders", "total_spend")
    db.select(*(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in db.columns)).write.option("header", True).csv(path)
    read = files.read_database(spark, path)
    return read.withColumns({"subject": F.col("subject").cast("double"), "c_acctbal": rounded("c_acctbal"), "total_spend": rounded("total_spend")})


@query(f"WITH {VOX} SELECT subject, map, voxel_id, {R('stat')} AS stat FROM vox")
def voxels_file(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "voxels")
    domain.voxels(spark, d).write.parquet(path)
    return files.read_voxels(spark, path).select("subject", "map", "voxel_id", rounded("stat").alias("stat"))


@query(f"""WITH {DB}, y AS (SELECT subject, (subject % 3)::INT AS y_actual, (subject % 5)::INT AS y_predictions FROM db WHERE subject % 2 = 0)
SELECT subject::DOUBLE AS subject, grp, {R('c_acctbal')} AS c_acctbal, y_actual::DOUBLE AS y_actual, y_predictions::DOUBLE AS y_predictions FROM db LEFT JOIN y USING (subject)""")
def predictions_csv(spark: SparkSession, d: str) -> DataFrame:
    """The subject table with predictions of those that have any."""
    path, db = files.scratch(spark, "predictions"), domain.database(spark, d).select("subject", "grp", "c_acctbal")
    made = db.filter("subject % 2 = 0").select("subject", (F.col("subject") % 3).cast("int").alias("y_actual"), (F.col("subject") % 5).cast("int").alias("y_predictions"))
    files.write_predictions(db, made, "subject", path)
    read = files.read_database(spark, path)
    return read.withColumns({"subject": F.col("subject").cast("double"), "c_acctbal": rounded("c_acctbal")})


@query(f"""WITH {DB}, f AS (SELECT *, (row_number() OVER (ORDER BY md5('0:' || subject), subject) - 1) % 4 AS fold FROM db WHERE n_orders IS NOT NULL),
m AS (SELECT fold % 2 AS i, fold, avg(c_acctbal) AS balance, avg(n_orders) AS orders FROM f GROUP BY fold)
SELECT i::VARCHAR AS i, {R('avg(balance)')} AS balance, {R('avg(orders)')} AS orders, {R('stddev_samp(balance) / sqrt(count(*))')} AS balance_sem, {R('stddev_samp(orders) / sqrt(count(*))')} AS orders_sem FROM m GROUP BY i""")
def results_csv(spark: SparkSession, d: str) -> DataFrame:
    """Final tables of means and standard errors by iteration, of averages by fold."""
    path = files.scratch(spark, "results")
    rows = folds.kfold(domain.database(spark, d).filter("n_orders is not null"), "subject", 4)
    by_fold = rows.groupBy("fold").agg(F.avg("c_acctbal").alias("balance"), F.avg("n_orders").alias("orders")).withColumn("i", F.col("fold") % 2)
    files.write_results(by_fold, path)
    read = lambda name: spark.read.option("header", True).csv(f"{path}/{name}")
    both = read("means").join(read("sems").withColumnsRenamed({"balance": "balance_sem", "orders": "orders_sem"}), "i")
    return both.select("i", *(rounded(F.col(c).cast("double")).alias(c) for c in ("balance", "orders", "balance_sem", "orders_sem")))


@query(f"WITH {X} SELECT label AS cluster, feature::INT AS feature, {R('avg(value)')} AS centroid, 7::BIGINT AS n_clst FROM x GROUP BY label, feature")
def model_files(spark: SparkSession, d: str) -> DataFrame:
    """A model of the classes' centroids, saved and loaded."""
    path = files.scratch(spark, "model")
    files.save_model(spark, {"n_clst": 7, "centroids": summaries.cluster_centroids(domain.features_long(spark, d))}, path)
    model = files.load_model(spark, path, ("n_clst", "centroids"))
    return model["centroids"].select("cluster", F.col("feature").cast("int").alias("feature"), rounded("centroid").alias("centroid"), F.lit(model["n_clst"]).cast("long").alias("n_clst"))


@query(f"WITH {X} SELECT subject, label, feature::INT AS feature, {R('value')} AS value FROM x")
def matrix_dump(spark: SparkSession, d: str) -> DataFrame:
    path, wide = files.scratch(spark, "matrix"), domain.features_wide(spark, d)
    files.dump_matrix(wide.select("subject", "features"), wide.select("subject", "label"), path)
    x, y = (spark.read.parquet(f"{path}/{name}") for name in ("x", "y"))
    return x.join(y, "subject").select("subject", "label", F.posexplode("features").alias("feature", "value")).withColumn("value", rounded("value"))


@query(f"WITH {LI} SELECT subject, experiment, roi, t, {R('v')} AS v FROM both_panels")
def timeseries_files(spark: SparkSession, d: str) -> DataFrame:
    """Two panels, each subject's series written as a CSV matrix and read by the paths of a subject table."""
    series = domain.to_series(domain.lineitem_panel(spark, d))
    paths = files.write_timeseries(series, files.scratch(spark, "series"))
    db = paths.groupBy("subject").pivot("experiment", ["qty", "price"]).agg(F.first("path"))
    panel = files.read_timeseries(db, "subject", ["qty", "price"])
    long = panel.select("subject", "experiment", "roi", F.posexplode("series").alias("t", "v"))
    return long.select("subject", "experiment", "roi", F.col("t").cast("int").alias("t"), rounded("v").alias("v"))
