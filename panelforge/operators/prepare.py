"""Projection, cleaning, encoding, splitting and shuffling of subject tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.series import seeded


def split_names(names: str | list[str]) -> list[str]:
    """Names in a comma list, in order."""
    return [n.strip() for n in names.split(",") if n.strip()] if isinstance(names, str) else list(names)


def select_columns(db: DataFrame, id_col: str, *lists: str | list[str]) -> DataFrame:
    """The id and the union of the named columns; a missing one is an error."""
    wanted = list(dict.fromkeys([id_col, *(n for x in lists for n in split_names(x))]))
    if lacking := [n for n in wanted if n not in db.columns]:
        raise ValueError(f"the subject table lacks {lacking}")
    return db.select(*wanted)


def drop_incomplete(db: DataFrame) -> DataFrame:
    """Rows without nulls."""
    return db.dropna("any")


def finite(value):
    """NaN, infinities and null as 0."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def clean(x: DataFrame) -> DataFrame:
    """Long features with bad values as 0, without the features that are 0 in every sample."""
    x = x.withColumn("value", finite("value"))
    alive = x.groupBy("feature").agg(F.max(F.abs("value")).alias("most")).filter("most > 0")
    return x.join(alive, "feature", "left_semi")


def scrub(x: DataFrame, key: str = "subject", value: str = "value") -> DataFrame:
    """Vectors with NaN as 0; one whose sum is 0 is an error."""
    value_ = F.when(F.col(value).isNull() | F.isnan(value), 0.0).otherwise(F.col(value))
    total = F.sum(value_).over(Window.partitionBy(key))
    return x.withColumn(value, F.when(total == 0, F.raise_error(F.concat(F.lit("empty vector: "), F.col(key).cast("string"))).cast("double")).otherwise(value_))


def gather_columns(db: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    return db.select(F.col(id_col).alias("subject"), F.array(*(F.col(c).cast("double") for c in columns)).alias("features"))


def assemble_features(blocks: list[DataFrame]) -> DataFrame:
    """Blocks of `subject, features` side by side, for the subjects that all have."""
    joined = reduce(lambda a, b: a.join(b[1].withColumnRenamed("features", f"f{b[0]}"), "subject"), enumerate(blocks[1:], 1), blocks[0].withColumnRenamed("features", "f0"))
    return joined.select("subject", F.concat(*(f"f{k}" for k in range(len(blocks)))).alias("features"))


def encode_classes(db: DataFrame, column: str, target: str | None = None) -> DataFrame:
    """`code`: the place of a label among the sorted labels; `is_target` for the target group.

    The labels are a distinct list, one row each; the code joins by label, so no window runs over all rows.
    """
    labels = db.select(column).distinct().filter(F.col(column).isNotNull())
    codes = labels.withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)
    out = db.join(codes, column, "left")
    return out if target is None else out.withColumn("is_target", (F.col(column) == target).cast("int"))


def one_vs_rest(db: DataFrame, column: str, target) -> DataFrame:
    return db.withColumn("y", F.when(F.col(column) == target, 1).otherwise(0))


def split_at_percentile(db: DataFrame, column: str, q: float = 0.5) -> DataFrame:
    """`y`: 0 below the percentile (linear interpolation), 1 from it on."""
    if not 0 <= q <= 1:
        raise ValueError("a percentile lies between 0 and 1")
    from panelforge.operators.quantiles import exact_quantiles

    cut = exact_quantiles(db, column, [q]).select(F.col("q0").alias("cut"))
    one = db.sparkSession.range(1).join(cut, how="left").select("cut")  # without a value there is no cut
    return db.crossJoin(F.broadcast(one)).withColumn("y", F.when(F.col(column) < F.col("cut"), 0).when(F.col(column) >= F.col("cut"), 1))


def infer_kind(db: DataFrame, columns: list[str], most: int = 9) -> DataFrame:
    """`variable, n_distinct, kind`: more than nine distinct values make a column continuous."""
    counts = db.agg(*(F.count_distinct(c).alias(c) for c in columns))
    return counts.unpivot([], columns, "variable", "n_distinct").withColumn("kind", F.when(F.col("n_distinct") > most, "continuous").otherwise("discrete"))


def select_group(df: DataFrame, column: str | None, group) -> DataFrame:
    return df if column is None or group is None else df.filter(F.col(column) == group)


def reorder(matrix: DataFrame, order: DataFrame, symmetric: bool = True, by: list[str] = ()) -> DataFrame:
    """A long matrix `i, j, v`, or one for each of `by`, with rows (and columns) moved by `old, new`; a matrix that isn't
    square is an error."""
    rows = matrix.join(order.select(F.col("old").alias("i"), F.col("new").alias("new_i")), "i")
    if not symmetric:
        return rows.select(*by, F.col("new_i").alias("i"), "j", "v")
    shape = matrix.groupBy(*by).agg(F.count_distinct("i").alias("rows"), F.count_distinct("j").alias("columns"))
    both = rows.join(order.select(F.col("old").alias("j"), F.col("new").alias("new_j")), "j")
    both = both.join(shape, list(by)) if by else both.crossJoin(F.broadcast(shape))
    v = F.when(F.col("rows") == F.col("columns"), F.col("v")).otherwise(F.raise_error(F.lit("the matrix is not square")).cast("double"))
    return both.select(*by, F.col("new_i").alias("i"), F.col("new_j").alias("j"), v.alias("v"))


def shuffle_labels(df: DataFrame, id_col: str, column: str, within: list[str], seed: int = 0) -> DataFrame:
    """`column` shuffled among the rows of each group of `within`: the row that is n-th by id gets the value of the row
    that is n-th by md5 of seed and id. Null ids and null groups count like others."""
    from panelforge.operators.folds import numbered, ordered

    there = numbered(df.select(*within, id_col, column), id_col, seed, within).select(*(F.col(c).alias(f"_of_{c}") for c in within), F.col("nth").alias("_of_nth"), F.col(column).alias("shuffled"))
    same = F.col("nth") == F.col("_of_nth")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return ordered(df, id_col, within).join(there, same).drop("nth", "_of_nth", *(f"_of_{c}" for c in within))
