"""Ranks, screens, choices and set operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import blocks as blocks_of_pairs
from panelforge.operators.wide import bounded_batches, few_tasks, sum_over_rows
from panelforge.sources.files import kept

#: Ranges in which the values of a feature are ranked, and values up to which one range does.
BLOCKS, WHOLE = 64, 50_000


def average_rank(x: DataFrame, by: str = "feature", value: str = "value", blocks: int = BLOCKS, whole: int = WHOLE) -> DataFrame:
    """`rank`, ties averaged, within `by`. Rows with a null value, or a null `by`, have no rank and are left out.

    Equal values are counted before they are ranked, so ties cost one row. A feature of more than `whole` values is ranked
    in ranges that part them about evenly, `blocks` at most, and the ranges' sizes are added up: no task gets all of it.
    """
    counts = x.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("ties"))
    parts = F.percentile_approx(F.col(value).cast("double"), [i / blocks for i in range(1, blocks)], 8 * blocks)
    cuts = counts.groupBy(by).agg(F.when(F.count("*") > whole, F.array_distinct(parts)).otherwise(F.array().cast("array<double>")).alias("cuts"))
    placed = counts.join(cuts, by).withColumn("block", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    sizes = placed.groupBy(by, "block").agg(F.sum("ties").alias("size"))
    earlier = F.sum("size").over(Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("ties").over(Window.partitionBy(by, "block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    numbered = placed.join(sizes.select(by, "block", F.coalesce(earlier, F.lit(0)).alias("earlier")), [by, "block"])
    ranks = numbered.select(by, value, (F.col("earlier") + F.coalesce(before, F.lit(0)) + (F.col("ties") + 1) / 2).alias("rank"))
    return x.join(ranks, [by, value])


def _rank_rows(x: DataFrame, by: str, value: str, name: str) -> tuple:
    """`subject, name`: the ranks of all features of a subject in one array, NaN where there is none; and the features."""
    names = sorted(r[by] for r in x.select(by).distinct().collect() if r[by] is not None)  # as wide as a row
    place = F.array_position(F.array(*map(F.lit, names)), F.col(by)) if len(names) <= 64 else None
    ranked = average_rank(x, by, value)
    if place is None:
        numbers = x.sparkSession.createDataFrame(list(enumerate(names, 1)), f"place long, `{by}` {x.schema[by].dataType.simpleString()}")
        ranked = ranked.join(numbers, by)
    else:
        ranked = ranked.withColumn("place", place)
    cells = ranked.groupBy("subject").agg(F.collect_list(F.struct("place", "rank")).alias("cells"))
    kind, width = x.schema["subject"].dataType.simpleString(), len(names)

    def dense(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = np.full((batch.num_rows, width), np.nan)
            flat = batch["cells"].flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch["cells"].offsets)))
            out[row, flat.field("place").to_numpy(zero_copy_only=False) - 1] = flat.field("rank").to_numpy(zero_copy_only=False)
            ends = pa.array(np.arange(0, out.size + 1, width, dtype=np.int32))
            yield pa.record_batch([batch["subject"], pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["subject", name])

    bounded_batches(x)
    return cells.mapInArrow(dense, f"subject {kind}, {name} array<double>"), names


def spearman(x: DataFrame, y: DataFrame) -> DataFrame:
    """`feature, score, rho, n` of long features (`subject, feature, value`) with long scores (`subject, score, y`), each
    pair over the subjects that have both, one value of each.

    The ranks of a subject stand in one array; rho comes from sums of products of such arrays, a matrix of features by
    scores, so no row is made for a feature, score and subject. A pair without a common subject is left out.
    """
    import numpy as np
    import pyarrow as pa

    left, features = _rank_rows(x, "feature", "value", "rx")
    right, scores = _rank_rows(y, "score", "y", "ry")
    p, q = len(features), len(scores)
    kinds = (x.schema["feature"].dataType, y.schema["score"].dataType)
    schema = f"feature {kinds[0].simpleString()}, score {kinds[1].simpleString()}, rho double, n long"
    both = kept(left.join(right, "subject"), "ranks") if p and q else None
    n_rows = both.count() if both is not None else 0
    if not n_rows:
        return x.sparkSession.createDataFrame([], schema)
    middle = (n_rows + 1) / 2  # about the mean of ranks, so that sums of squares keep their digits

    def partial(a, b):
        in_a, in_b = np.isfinite(a).astype(float), np.isfinite(b).astype(float)
        a, b = np.where(in_a > 0, a - middle, 0), np.where(in_b > 0, b - middle, 0)
        return np.stack([in_a.T @ in_b, a.T @ in_b, in_a.T @ b, (a * a).T @ in_b, in_a.T @ (b * b), a.T @ b])

    n, sx, sy, xx, yy, xy = sum_over_rows(both, ["rx", "ry"], partial, cells=6 * p * q, few=few_tasks(both), bad=True)[""].reshape(6, p, q)
    some = n > 0
    up = xy - np.divide(sx * sy, n, out=np.zeros_like(n), where=some)
    spread = lambda s, ss: np.maximum(ss - np.divide(s * s, n, out=np.zeros_like(n), where=some), 0)
    down = np.sqrt(spread(sx, xx) * spread(sy, yy))
    rho = np.divide(up, down, out=np.zeros_like(n), where=down > 1e-9)
    i, j = np.nonzero(some)
    cells = {"feature": [features[k] for k in i], "score": [scores[k] for k in j], "rho": rho[i, j], "n": n[i, j].astype(np.int64)}
    return x.sparkSession.createDataFrame(pa.table(cells), schema)


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    return _beta(df / 2, 0.5, x)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * (f - 1)


def rho_at(p: float, n: int) -> float:
    """The |rho| whose two-sided p-value is p for n samples."""
    if n < 3:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid * math.sqrt((n - 2) / max(1e-300, 1 - mid * mid)), n - 2) > p else (low, mid)
    return high


def spearman_screen(x: DataFrame, y: DataFrame, p: float | None = 0.005, n: int | None = None) -> DataFrame:
    """`feature, strength`: the n features with the largest |rho| over the scores, or those with a p-value of p or less.

    For a fixed number of samples the order of p-values is that of |rho|. A feature without rho is never kept.
    """
    best = spearman(x, y).groupBy("feature").agg(F.max(F.abs("rho")).alias("strength"), F.max("n").alias("samples")).filter("strength > 0")
    if n is not None:
        return best.select("feature", "strength").orderBy(F.desc("strength"), "feature").limit(n)
    samples = best.agg(F.max("samples")).first()[0] or 0
    return best.filter(F.col("strength") >= rho_at(p, samples)).select("feature", "strength")


def top_features(scores: DataFrame, n: int, column: str = "importance") -> DataFrame:
    """Features whose score is the n-th largest or more, ties kept."""
    least = scores.orderBy(F.desc(column)).limit(n).agg(F.min(column).alias("_least"))
    return scores.crossJoin(F.broadcast(least)).filter(F.col(column) >= F.col("_least")).drop("_least")


def cumulative_variance(ev: DataFrame, share: float) -> DataFrame:
    """`k, ev, cumulative, first`: running share of explained variance, and whether k is the first to reach `share`."""
    by_k = Window.orderBy("k")
    out = ev.withColumn("cumulative", F.sum("ev").over(by_k) / F.sum("ev").over(Window.partitionBy(F.lit(0))))
    return out.withColumn("first", (F.col("cumulative") >= share) & (F.coalesce(F.lag("cumulative").over(by_k), F.lit(0.0)) < share))


def best_setting(grid: DataFrame, score: str, order: str, largest: bool = True) -> DataFrame:
    """The setting with the best score, the first of those that tie."""
    return grid.orderBy(F.desc(score) if largest else F.asc(score), order).limit(1)


def label_universe(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).unionByName(b.select(column)).distinct()


def index_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).distinct().join(b.select(column), column, "left_anti")


def variance_threshold(x: DataFrame, train=None) -> DataFrame:
    """Long features without those that don't vary (in the rows that `train` holds for)."""
    rows = x if train is None else x.filter(train)
    return x.join(rows.groupBy("feature").agg(F.var_pop("value").alias("var")).filter("var > 0"), "feature", "left_semi")


def balanced_weights(db: DataFrame, y: str) -> DataFrame:
    """`y, n, weight`: n / (C * n_c) for each class."""
    counts = db.groupBy(y).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(F.lit(0))
    return counts.withColumn("weight", F.sum("n").over(all_) / (F.count("*").over(all_) * F.col("n")))


def pairwise_distance(x: DataFrame, method: str = "euclidean", digits: int | None = None) -> DataFrame:
    """`i, j, distance` for i < j, of long features, each pair over the features that both have; see `blocks`."""
    return blocks_of_pairs.entries(blocks_of_pairs.pair_distances(x, method), "distance", digits=digits)


def gower_centered(x: DataFrame, method: str = "euclidean", digits: int | None = None) -> DataFrame:
    """`i, j, g`: the doubly centred -d^2/2 of the distances of long features, of all pairs in both orders."""
    return blocks_of_pairs.entries(blocks_of_pairs.centre(blocks_of_pairs.pair_distances(x, method)), "g", both=True, digits=digits)


def gower_center(distances: DataFrame) -> DataFrame:
    """`i, j, g`: the doubly centred -d^2/2 of a full distance table `i, j, distance` (both orders and the diagonal)."""
    a = distances.withColumn("a", -0.5 * F.col("distance") * F.col("distance"))
    row, column = Window.partitionBy("i"), Window.partitionBy("j")
    grand = a.agg(F.avg("a").alias("grand"))
    return a.crossJoin(F.broadcast(grand)).select("i", "j", (F.col("a") - F.avg("a").over(row) - F.avg("a").over(column) + F.col("grand")).alias("g"))
