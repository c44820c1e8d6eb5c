"""Seeded splits: k folds, halves, blocks. The order is md5 of seed and id, the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.series import seeded

#: Blocks of the md5 order, by its first hex digits, in which rows are numbered.
DIGITS = 3
#: Ranges in which rows are numbered, and values of a text's sample for each.
BLOCKS, PER_BLOCK = 256, 16


def _numbered_in_blocks(blocked: DataFrame, by: list[str], within_order: list, name: str) -> DataFrame:
    """`name` from 0 within `by`, in the order of `_block` and of `within_order` in a block; nulls are values like others."""
    sizes = blocked.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*(F.col(c).alias(f"_of_{c}") for c in by), F.col("_block").alias("_of"), "_before")
    same = F.col("_block").eqNullSafe(F.col("_of"))
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    within = Window.partitionBy(*by, "_block").orderBy(*within_order)
    return blocked.join(sizes, same).withColumn(name, F.col("_before") + F.row_number().over(within) - 1).drop("_block", "_before", "_of", *(f"_of_{c}" for c in by))


def numbered(df: DataFrame, id_col: str, seed: int, by: list[str] = (), name: str = "nth") -> DataFrame:
    """`nth` from 0 in md5 order within `by`, rows with a null id first. Rows are numbered in blocks of the order, and the
    blocks' sizes added up, so that no task gets all rows of a class."""
    blocked = df.withColumn("_h", seeded(seed, id_col)).withColumn("_block", F.substring("_h", 1, DIGITS))
    return _numbered_in_blocks(blocked, list(by), ["_h", id_col], name).drop("_h")


def ordered(df: DataFrame, order_col: str, by: list[str] = (), name: str = "nth") -> DataFrame:
    """`nth` from 0 in the order of `order_col` within `by`, null first. Rows are numbered in blocks of the order, ranges
    of a number or of a text, so that no task gets all rows. The ranges of a text part a sample of its values, those of
    least hash, evenly."""
    column = F.col(order_col)
    if dict(df.dtypes)[order_col] == "string":
        texts = df.select(column.alias("t")).filter("t IS NOT NULL").orderBy(F.xxhash64("t"), "t").limit(BLOCKS * PER_BLOCK)
        sample = sorted((r["t"] for r in texts.collect()), key=lambda t: t.encode())
        cuts, value = sorted({sample[i * len(sample) // BLOCKS] for i in range(1, BLOCKS)} if sample else ()), column
    else:
        value = column.cast("double")
        cuts = sorted(set(df.agg(F.percentile_approx(value, [i / BLOCKS for i in range(1, BLOCKS)])).first()[0] or []))
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)
    return _numbered_in_blocks(df.withColumn("_block", F.when(column.isNotNull(), block)), list(by), [order_col], name)


def kfold(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """`fold`: shuffled folds of equal size; k beyond the rows leaves one out at a time."""
    return numbered(df, id_col, seed).withColumn("fold", F.pmod("nth", F.lit(k)).cast("int")).drop("nth")


def stratified_kfold(df: DataFrame, id_col: str, y: str, k: int, seed: int = 0) -> DataFrame:
    """`fold`: of equal size within each class."""
    return numbered(df, id_col, seed, [y]).withColumn("fold", F.pmod("nth", F.lit(k)).cast("int")).drop("nth")


def train_test(df: DataFrame, k: int) -> DataFrame:
    """Every row once for each fold, as a test row in its own: `fold_id, is_test`."""
    return df.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("is_test", F.col("fold") == F.col("fold_id"))


def half_split(df: DataFrame, id_col: str, i: int = 0, seed: int = 0) -> DataFrame:
    """`half`: 0 for the first n // 2 rows of the i-th order, else 1."""
    n = df.agg(F.count("*").alias("_total"))
    return numbered(df, id_col, seed + i).crossJoin(F.broadcast(n)).withColumn("half", (F.col("nth") >= F.floor(F.col("_total") / 2)).cast("int")).drop("nth", "_total")


def _chunked(df: DataFrame, order_col: str) -> tuple:
    """Rows with the number of their chunk in order, and the numbers of chunks and of rows in one."""
    n = df.count()
    length = 10 if n > 50 else 1
    return ordered(df, order_col, name="_nth").withColumn("_chunk", F.floor(F.col("_nth") / length)).drop("_nth"), n // length, int(n), length


def _held_chunks(df: DataFrame, chunks: int, held: int, fold: int, seed: int) -> DataFrame:
    every = df.sparkSession.range(chunks).withColumnRenamed("id", "_chunk")
    return every.orderBy(F.md5(F.concat(F.lit(f"{seed}:{fold}:"), F.col("_chunk").cast("string")).cast("binary"))).limit(held)


def block_holdout(df: DataFrame, order_col: str, fold: int, seed: int = 0, share: float = 0.2) -> DataFrame:
    """`held_out`: a random share of consecutive chunks of ten rows (one, for 50 rows or fewer); the tail isn't chunked.

    The chunks of a fold are the first by md5 of seed, fold and chunk.
    """
    rows, chunks, n, length = _chunked(df, order_col)
    chosen = _held_chunks(df, chunks, int(share * n / length), fold, seed).withColumn("_held", F.lit(True))
    return rows.join(chosen, "_chunk", "left").withColumn("held_out", F.coalesce("_held", F.lit(False))).drop("_chunk", "_held")


def block_holdouts(df: DataFrame, order_col: str, n_folds: int, seed: int = 0, share: float = 0.2) -> DataFrame:
    """`order_col, held`: the folds of `block_holdout` that hold a row out. Only that column is ordered, once for all."""
    rows, chunks, n, length = _chunked(df.select(order_col), order_col)
    chosen = [_held_chunks(df, chunks, int(share * n / length), f, seed).withColumn("_fold", F.lit(f)) for f in range(n_folds)]
    for c in chosen[1:]:
        chosen[0] = chosen[0].unionByName(c)
    folds = chosen[0].groupBy("_chunk").agg(F.sort_array(F.collect_list("_fold")).alias("held"))
    return rows.join(folds, "_chunk", "left").select(order_col, F.coalesce("held", F.array().cast("array<int>")).alias("held"))
