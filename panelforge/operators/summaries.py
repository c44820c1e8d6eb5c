"""Histograms, cutoffs, centroids, loadings, fold summaries."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.series import guarded_corr
from panelforge.operators.quantiles import exact_quantiles


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """`bin, n, density` of equal-width bins, the last closed; bins without values are left out."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("total"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.least(F.floor((F.col(column) - F.col("low")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    counted = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("bin"), "low", "high", "total").agg(F.count("*").alias("n"))
    return counted.select("bin", "n", (F.col("n") / (F.col("total") * F.nullif(width, F.lit(0.0)))).alias("density"), (F.col("low") + F.col("bin") * width).alias("left_edge"))


def gauss_step(p, damp: float, sums):
    """A damped Gauss-Newton step for A, mu and sigma from the sums j j' (upper half) and j r."""
    import numpy as np

    a = np.zeros((3, 3))
    a[np.triu_indices(3)] = sums[:6]
    a = a + np.triu(a, 1).T
    return np.asarray(p) + np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), np.asarray(sums[6:9]), rcond=None)[0]


def fit_gauss(sums_at, start=(1.0, 0.0, 1.0), steps: int = 200):
    """A, mu and sigma of a Gaussian by damped least squares; an error if it doesn't converge.

    `sums_at(p)` gives, over all points, the sums of the products of derivatives and residuals, nine numbers, and last
    the squared residuals.
    """
    p, damp, sums = list(start), 1e-3, sums_at(start)
    for _ in range(steps):
        new = gauss_step(p, damp, sums)
        found = sums_at(new) if abs(new[2]) > 1e-9 else None
        if found is not None and found[9] < sums[9]:
            done = sums[9] - found[9] < 1e-12 * max(sums[9], 1e-300)
            p, sums, damp = new, found, damp / 5
            if done:
                return p
        else:
            damp *= 5
            if damp > 1e12:
                return p
    raise ValueError("the Gaussian fit didn't converge")


def gauss_terms(x, y, p) -> list:
    """What `fit_gauss` sums, of columns or of arrays: the products of the derivatives, those with the residual, its square."""
    import numpy as np

    a, mu, sigma = (float(v) for v in p)
    exp = F.exp if isinstance(x, Column) else np.exp
    g = exp(-((x - mu) * (x - mu)) / (2 * sigma * sigma))
    j = [g, a * g * (x - mu) / sigma**2, a * g * (x - mu) * (x - mu) / sigma**3]
    r = y - a * g
    return [j[i] * j[k] for i in range(3) for k in range(i, 3)] + [d * r for d in j] + [r * r]


def find_outliers(df: DataFrame, column: str, n_sigma: float = 1.0, most_bins: int | None = None) -> DataFrame:
    """`y`: 0 up to the cutoff mu - n_sigma * sigma of a Gaussian fitted to the standardised histogram, else 1.

    The histogram has a tenth as many bins as rows, `most_bins` at most if that is given. It stays a table: each step of
    the fit sums its ten numbers over the bins, and over those without a value by a sequence. The cutoff is carried over
    as a percentile.
    """
    from panelforge.operators.prepare import split_at_percentile
    from panelforge.operators.standard import standardize

    z = standardize(df.select(column).dropna(), [column])
    n, low, high = z.agg(F.count("*"), F.min(f"z_{column}"), F.max(f"z_{column}")).first()
    bins = max(3, n // 10 if most_bins is None else min(most_bins, n // 10))
    counted = histogram(z, f"z_{column}", bins).select("bin", "density")
    width = (high - low) / bins
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left")
    points = every.select((F.lit(low) + (F.col("bin") + 0.5) * width).alias("x"), F.coalesce("density", F.lit(0.0)).alias("y")).persist()
    try:
        sums = lambda p: list(points.agg(*(F.sum(t).alias(f"s{k}") for k, t in enumerate(gauss_terms(F.col("x"), F.col("y"), p)))).first())
        _, mu, sigma = fit_gauss(sums)
    finally:
        points.unpersist()
    cutoff = float(mu - n_sigma * abs(sigma))
    below = z.agg(F.avg((F.col(f"z_{column}") <= cutoff).cast("double"))).first()[0]
    return split_at_percentile(df, column, below).withColumn("y", F.when(F.col(column) <= F.col("cut"), 0).otherwise(1))


def significance_cutoffs(df: DataFrame, column: str, two_sided: bool = True) -> DataFrame:
    low, high = (0.025, 0.975) if two_sided else (0.05, 0.95)
    return exact_quantiles(df, column, [low, high]).select(F.col("q0").alias("low"), F.col("q1").alias("high"))


def cluster_centroids(x: DataFrame, label: str = "label") -> DataFrame:
    return x.groupBy(F.col(label).alias("cluster"), "feature").agg(F.avg("value").alias("centroid"))


def score_loadings(scores: DataFrame, comps: DataFrame) -> DataFrame:
    """Correlation of every score (`subject, score, y`) with every component (`subject, cc, c`)."""
    return scores.join(comps, "subject").groupBy("score", "cc").agg(guarded_corr("y", "c").alias("r"))


def edge_loadings(x: DataFrame, comps: DataFrame) -> DataFrame:
    """Correlation of every feature (`subject, feature, value`) with every component (`subject, cc, c`)."""
    return x.join(comps, "subject").groupBy("feature", "cc").agg(guarded_corr("value", "c").alias("r"))


def roi_loading_summary(edges: DataFrame, n_rois: int) -> DataFrame:
    """For each region and component, the mean of the positive and of the negative parts over all regions."""
    both = edges.select(F.col("roi_i").alias("roi"), "cc", "r").unionByName(edges.select(F.col("roi_j").alias("roi"), "cc", "r"))
    return both.groupBy("roi", "cc").agg((F.sum(F.greatest("r", F.lit(0.0))) / n_rois).alias("positive"), (F.sum(F.least("r", F.lit(0.0))) / n_rois).alias("negative"))


def cluster_score_summary(db: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    """Box-plot numbers of each standardised score in each cluster."""
    from panelforge.operators.standard import standardize

    z = standardize(db, columns).select(cluster, *(F.col(f"z_{c}").alias(c) for c in columns))
    long = z.unpivot([cluster], columns, "variable", "value").filter("value is not null")
    found = exact_quantiles(long, "value", [0.0, 0.25, 0.5, 0.75, 1.0], ["variable", cluster])
    return found.select("variable", cluster, *(F.col(f"q{k}").alias(name) for k, name in enumerate(("low", "q25", "q50", "q75", "high"))), "n")


def summarize_folds(folds: DataFrame, metrics: list[str], keys: list[str] = ()) -> DataFrame:
    """`metric, mean, sem` over folds, for each of `keys`; sem is the sample deviation by the root of the count."""
    keys = list(keys)
    long = folds.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"))


def summarize_hyperparameters(folds: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """`name, summary`: the commonest setting (ties to the smallest), or the median."""
    modes = [F.mode(c, True).cast("string").alias(c) for c in categorical]
    return folds.agg(*modes, *(F.median(c).cast("string").alias(c) for c in numeric)).unpivot([], [*categorical, *numeric], "name", "summary")


