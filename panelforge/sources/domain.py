"""The given tables as subjects, panels, voxels and features, each with its DuckDB SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EV_T, LI_T = 30, 83
EV_START, LI_START = "2024-01-01", 1995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers of this machine find the package wherever the driver was started
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dense(sums: DataFrame, experiment: str, rois: int, length: int) -> DataFrame:
    """Every (subject, roi, t), 0 where there is no sum."""
    grid = sums.select("subject").distinct().select("subject", F.explode(F.sequence(F.lit(0), F.lit(rois - 1))).alias("roi")).select("subject", "roi", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t"))
    return grid.join(sums, ["subject", "roi", "t"], "left").select("subject", F.lit(experiment).alias("experiment"), "roi", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel `ev`, long: a user's five event types by day. The types are the region numbers, in alphabetical order."""
    events = table(spark, sf_dir, "events")
    types = ["click", "error", "purchase", "signup", "view"]
    roi = F.array_position(F.array(*map(F.lit, types)), F.col("event_type")).cast("int") - 1
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit(EV_START)))
    sums = events.groupBy(F.col("user_id").alias("subject"), roi.alias("roi"), day.alias("t")).agg(F.sum("value").alias("v"))
    return _dense(sums, "ev", len(types), EV_T)


def lineitem_panel(spark: SparkSession, sf_dir: str, experiments: tuple = ("qty", "price")) -> DataFrame:
    """Panels `qty` and `price`, long: a supplier's line numbers by month."""
    li = table(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") - LI_START) * 12 + F.month("l_shipdate") - 1
    value = {"qty": "l_quantity", "price": "l_extendedprice"}
    sums = li.groupBy(F.col("l_suppkey").alias("subject"), (F.col("l_linenumber") - 1).cast("int").alias("roi"), month.alias("t")).agg(*(F.sum(value[e]).alias(e) for e in experiments))
    grid = sums.select("subject").distinct().select("subject", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("roi")).select("subject", "roi", F.explode(F.sequence(F.lit(0), F.lit(LI_T - 1))).alias("t"))
    cells = F.array(*(F.struct(F.lit(e).alias("experiment"), F.coalesce(e, F.lit(0.0)).alias("v")) for e in experiments))
    dense = grid.join(sums, ["subject", "roi", "t"], "left").select("subject", "roi", "t", F.explode(cells).alias("x"))
    return dense.select("subject", "x.experiment", "roi", "t", "x.v")


def to_series(panel: DataFrame) -> DataFrame:
    """The canonical panel: one row a region, with its series as an array."""
    return panel.groupBy("subject", "experiment", "roi").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("series"))


def database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects: customers with their orders; a customer without orders has nulls."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total_spend"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey").join(orders, "c_custkey", "left").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").cast("double").alias("nation"), "c_acctbal", F.col("n_orders").cast("double").alias("n_orders"), "total_spend")


def features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`subject, label, features` of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subject"), "label", F.col("embedding").cast("array<double>").alias("features"))


def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_wide(spark, sf_dir).select("subject", "label", F.posexplode("features").alias("feature", "value"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.lit("price").alias("map"), F.col("l_partkey").alias("voxel_id"), F.col("l_extendedprice").alias("stat"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by brand, the two digits of its name; brand 11 is background."""
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("voxel_id"), F.when(number == 11, 0).otherwise(number).alias("roi"))


EV = f"""ev AS (
  SELECT g.subject, 'ev' AS experiment, g.roi::INT AS roi, g.t::INT AS t, coalesce(s.v, 0.0) AS v
  FROM (SELECT * FROM (SELECT DISTINCT user_id AS subject FROM events), range(0, 5) a(roi), range(0, {EV_T}) b(t)) g
  LEFT JOIN (SELECT user_id AS subject, list_position(['click','error','purchase','signup','view'], event_type) - 1 AS roi,
                    date_diff('day', DATE '{EV_START}', ts::DATE) AS t, sum(value) AS v FROM events GROUP BY ALL) s
  ON g.subject = s.subject AND g.roi = s.roi AND g.t = s.t)"""
LI = f"""li AS (
  SELECT g.subject, g.roi::INT AS roi, g.t::INT AS t, coalesce(q, 0.0) AS qty, coalesce(p, 0.0) AS price
  FROM (SELECT * FROM (SELECT DISTINCT l_suppkey AS subject FROM lineitem), range(0, 7) a(roi), range(0, {LI_T}) b(t)) g
  LEFT JOIN (SELECT l_suppkey AS subject, l_linenumber - 1 AS roi, (year(l_shipdate) - {LI_START}) * 12 + month(l_shipdate) - 1 AS t,
                    sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem GROUP BY ALL) s
  ON g.subject = s.subject AND g.roi = s.roi AND g.t = s.t),
qty AS (SELECT subject, 'qty' AS experiment, roi, t, qty AS v FROM li),
both_panels AS (SELECT * FROM qty UNION ALL SELECT subject, 'price', roi, t, price FROM li)"""
DB = """db AS (
  SELECT c_custkey AS subject, c_mktsegment AS grp, c_nationkey::DOUBLE AS nation, c_acctbal, n_orders::DOUBLE AS n_orders, total_spend
  FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders, sum(o_totalprice) AS total_spend FROM orders GROUP BY 1) USING (c_custkey))"""
X = """x AS (SELECT vec_id AS subject, label, k - 1 AS feature, embedding[k]::DOUBLE AS value FROM embeddings, range(1, 65) r(k))"""
VOX = """vox AS (SELECT l_suppkey AS subject, 'price' AS map, l_partkey AS voxel_id, l_extendedprice AS stat FROM lineitem),
mask AS (SELECT p_partkey AS voxel_id, CASE WHEN n = 11 THEN 0 ELSE n END AS roi FROM (SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS n FROM part))"""
