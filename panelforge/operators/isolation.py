"""Isolation forests: each tree's sample is taken of all rows, and trees are grown in tasks of their own.

The sample of a tree is the rows of least hash of tree and row, the same on any partitioning.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.config import DEFAULTS
from panelforge.operators.kernels import harmonic
from panelforge.operators.quantiles import exact_quantiles
from panelforge.operators.wide import bounded_batches, matrix
from panelforge.sources.files import kept

TREE = "tree int, feature array<int>, cut array<double>, next array<int>, depth array<double>"


class Forest(NamedTuple):
    """Trees as arrays by node: the column it splits (-1: a leaf), where, its lower child (the other follows), and, of a
    leaf, the depth that it stands for; and the size of the samples."""

    trees: list
    sample: int


def _mixed(h, tree: int, seed: int):
    """A hash of row and tree from the row's."""
    import numpy as np

    x = h ^ np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + (seed + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grow(x, rng, limit: int):
    """A tree of the rows of x: random columns that vary, cut at random between their ends, to a depth of `limit`."""
    import numpy as np

    feature, cut, child, depth = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, deep = todo.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        spread = np.flatnonzero(high > low)
        if deep == limit or not len(spread):
            depth[node] = deep + harmonic(len(rows))
            continue
        c = int(rng.choice(spread))
        feature[node], cut[node], child[node] = c, float(rng.uniform(low[c], high[c])), len(feature)
        for k in range(2):
            feature.append(-1), cut.append(0.0), child.append(0), depth.append(0.0)
            todo.append((child[node] + k, rows[(x[rows, c] >= cut[node]) == bool(k)], deep + 1))
        # a cut at the very end leaves one side empty, which has no depth below it
        todo = [t if len(t[1]) else (t[0], rows[:1], t[2]) for t in todo]
    return feature, cut, child, depth


def grow_isolation_forest(x: DataFrame, trees: int = DEFAULTS.isolation_trees, sample: int | None = None, seed: int = 0) -> Forest:
    """A forest of `subject, features`; a tree's sample has as many rows as there are columns, or `sample`, or all rows.

    Two passes: one counts rows; in the other each row goes to the trees whose hash of it is small, some twice as many
    as needed, and a task grows the tree of those of least hash. Rows of one subject have one hash: they tie in the
    order of their features.
    """
    import numpy as np

    bounded_batches(x)
    n = x.count()
    if not n:
        raise ValueError("there are no rows")
    size = int(min(sample or len(x.select("features").first()[0]), n))
    hashed = x.select(F.xxhash64(F.col("subject").cast("string")).alias("h"), F.col("features").cast("array<double>").alias("features"))
    limit = int(np.ceil(np.log2(max(2, size))))
    share = min(1.0, (2 * size + 40) / n)

    def deal(batches):
        import pyarrow as pa

        bound = np.uint64(min(2**64 - 1, int(share * 2**64)))
        for batch in batches:
            h = batch["h"].to_numpy().view(np.uint64)
            for tree in range(trees):
                order = _mixed(h, tree, seed)
                some = np.flatnonzero(order <= bound)
                if len(some):
                    at = pa.array(some)
                    yield pa.record_batch([pa.array(np.full(len(some), tree, np.int32)), pa.array(order[some].view(np.int64)), batch["features"].take(at)], names=["tree", "order", "features"])

    def plant(group):
        import pyarrow as pa

        order = group["order"].to_numpy().view(np.uint64)
        v = matrix(group["features"].combine_chunks())
        first = np.lexsort((*v.T[::-1], order))[:size] if v.shape[1] <= 64 else np.argsort(order, kind="stable")[:size]
        tree = group["tree"][0].as_py()
        cells = grow(v[first], np.random.default_rng([seed, tree]), limit) if len(first) == size else ([], [], [], [])
        return pa.table([pa.array([tree], pa.int32()), *(pa.array([c], pa.list_(t)) for c, t in zip(cells, (pa.int32(), pa.float64(), pa.int32(), pa.float64()), strict=True))], names=["tree", "feature", "cut", "next", "depth"])

    while True:
        grown = hashed.mapInArrow(deal, "tree int, order long, features array<double>").groupBy("tree").applyInArrow(plant, TREE).orderBy("tree").collect()
        if len(grown) == trees and all(r["feature"] for r in grown) or share == 1.0:
            break
        share = min(1.0, 2 * share)  # a tree got too few
    made = [(np.array(r["feature"]), np.array(r["cut"]), np.array(r["next"]), np.array(r["depth"])) for r in grown]
    return Forest(made, size)


def depths(tree, x):
    """The depth at which each row of x ends."""
    import numpy as np

    feature, cut, child, depth = tree
    node = np.zeros(len(x), np.int64)
    live = np.flatnonzero(feature[node] >= 0)
    while len(live):
        at = node[live]
        node[live] = child[at] + (x[live, feature[at]] >= cut[at])
        live = live[feature[node[live]] >= 0]
    return depth[node]


def isolation_scores(df: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """`name`: 2^(-mean depth / c), where c is the mean depth of a search among as many rows as a sample has."""
    import numpy as np

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x = np.nan_to_num(np.stack(v.to_numpy()).astype(float), posinf=0, neginf=0)
        total = np.zeros(len(x))
        for tree in forest.trees:
            total += depths(tree, x)
        return pd.Series(2.0 ** (-total / len(forest.trees) / max(harmonic(forest.sample), 1e-9)))

    return df.withColumn(name, score(F.col("features").cast("array<double>")))


def isolation_forest(x: DataFrame, contamination: float, trees: int = DEFAULTS.isolation_trees, sample: int | None = None, seed: int = 0, rows: DataFrame | None = None) -> DataFrame:
    """`score, outlier`: isolation scores, and whether one is among the highest `contamination` share.

    Trees and cutoff are those of `x`; scored are `rows`, or `x` itself. Scores are written once, and read for both.
    """
    forest = grow_isolation_forest(x, trees, sample, seed)
    own = kept(isolation_scores(x, forest), "isolation-scores")
    cut = exact_quantiles(own, "score", [1 - contamination]).select(F.col("q0").alias("_cut"))
    scored = own if rows is None else isolation_scores(rows, forest)
    return scored.crossJoin(F.broadcast(cut)).withColumn("outlier", (F.col("score") > F.col("_cut")).cast("int")).drop("_cut")
