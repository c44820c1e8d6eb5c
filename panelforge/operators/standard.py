"""Standardising and residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _scaled(db: DataFrame, columns: list[str], where, prefix: str) -> DataFrame:
    """Columns as z-scores by the population mean and standard deviation of the rows that `where` holds for."""
    inside = lambda c: F.when(where, F.col(c)) if where is not None else F.col(c)
    moments = db.agg(*(F.struct(F.avg(inside(c)).alias("m"), F.stddev_pop(inside(c)).alias("s")).alias(f"_{c}") for c in columns))
    z = lambda c: ((F.col(c) - F.col(f"_{c}.m")) / F.nullif(F.col(f"_{c}.s"), F.lit(0.0))).alias(f"{prefix}{c}")
    out = db.crossJoin(F.broadcast(moments))  # one row
    return out.select(*db.columns, *(z(c) for c in columns))


def standardize(db: DataFrame, columns: list[str], prefix: str = "z_") -> DataFrame:
    return _scaled(db, columns, None, prefix)


def standardize_by_group(db: DataFrame, columns: list[str], group_col: str, group, prefix: str = "z_") -> DataFrame:
    return _scaled(db, columns, F.col(group_col) == group, prefix)


def scale_train_test(db: DataFrame, columns: list[str], is_test: str, prefix: str = "z_") -> DataFrame:
    return _scaled(db, columns, ~F.col(is_test), prefix)


def residualize(db: DataFrame, columns: list[str], covariates: list[str], prefix: str = "res_") -> DataFrame:
    """Standardised columns minus their least-squares fit by the standardised covariates and an intercept.

    One pass gathers the covariances; the driver solves a system as wide as the covariates.
    """
    import numpy as np

    z = standardize(standardize(db, covariates, "_c_"), columns, "_y_")
    c, y = [f"_c_{n}" for n in covariates], [f"_y_{n}" for n in columns]
    pairs = [(a, b) for a in c for b in c + y]
    # all on complete rows, so that the products are those of one set of rows
    complete = z.dropna("any", subset=[*c, *y])
    got = complete.agg(*(F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs), *(F.avg(a).alias(f"m|{a}") for a in [*c, *y])).first()
    matrix = lambda rows, cols: np.array([[got[f"{a}|{b}"] or 0.0 for b in cols] for a in rows])
    beta = np.linalg.lstsq(matrix(c, c), matrix(c, y), rcond=None)[0]
    out = z
    for k, name in enumerate(columns):
        fit = sum(((F.col(a) - float(got[f"m|{a}"] or 0)) * float(beta[i, k]) for i, a in enumerate(c)), F.lit(float(got[f"m|{y[k]}"] or 0)))
        out = out.withColumn(f"{prefix}{name}", F.col(y[k]) - fit)
    return out.drop(*c, *y)
