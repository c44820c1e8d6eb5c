"""Quantiles, ranks and pairs in ranges and blocks beside plain computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import blocks, folds, prepare, quantiles, ranking, summaries


@pytest.mark.parametrize("most", [5, 40, 1 << 16])
def test_quantiles_are_exact(spark, most):
    """Uniform values, heavy ties, one value, a heavy tail, a null group; large groups and small ones."""
    rng = np.random.default_rng(0)
    groups = {"even": rng.uniform(size=900), "ties": rng.integers(0, 4, 700).astype(float), "one": np.full(300, 2.5), "tail": np.exp(rng.normal(size=800) * 8), "few": np.array([3.0, 1.0]), None: rng.normal(size=120)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("even", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = [0.0, 0.025, 0.5, 0.777, 1.0]
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, "v", qs, ["g"], most=most).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        assert [got[g][f"q{k}"] for k in range(len(qs))] == pytest.approx(np.quantile(values, qs).tolist(), rel=1e-12)
    alone = quantiles.exact_quantiles(df.filter("g = 'tail'"), "v", qs, most=most).first()
    assert [alone[f"q{k}"] for k in range(len(qs))] == pytest.approx(np.quantile(groups["tail"], qs).tolist(), rel=1e-12)
    assert quantiles.exact_quantiles(df.filter("v IS NULL"), "v", qs, most=most).count() == 0


def test_quantiles_of_values_that_change_when_computed_again(spark):
    """As z-scores do in their last digits, whose moments are summed in another order each time: many ties, a long tail."""
    values = np.concatenate([np.repeat([1.0, 2.0, 3.0, 5.0], 400), [40.0] * 60])

    @F.pandas_udf("double")
    def again(v: pd.Series) -> pd.Series:
        return v * (1 + 1e-15 * np.random.default_rng().integers(-40, 40))

    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5).select(again("v").alias("v"))
    qs = [0.0, 0.25, 0.5, 0.777, 1.0]
    got = quantiles.exact_quantiles(df, "v", qs, most=30).first()
    assert got["n"] == len(values) and [got[f"q{k}"] for k in range(5)] == pytest.approx(np.quantile(values, qs).tolist(), rel=1e-12)


def test_split_without_a_value(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    rows = prepare.split_at_percentile(df, "v").collect()
    assert len(rows) == 2 and all(r["cut"] is None and r["y"] is None for r in rows)


def test_no_row_is_lost_to_nulls(spark):
    rows = [(None if i == 3 else i, None if i % 4 == 0 else f"g{i % 2}", i) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    assert folds.kfold(df, "id", 4).count() == 20
    halves = folds.half_split(df, "id").groupBy("half").count().collect()
    assert {r["half"]: r["count"] for r in halves} == {0: 10, 1: 10}
    by_class = folds.stratified_kfold(df, "id", "g", 5).groupBy("g", "fold").count().collect()
    assert sum(r["count"] for r in by_class) == 20 and {r["count"] for r in by_class if r["g"] is None} == {1}
    shuffled = prepare.shuffle_labels(df, "id", "v", ["g"]).collect()
    assert len(shuffled) == 20
    for g in (None, "g0", "g1"):
        assert sorted(r["v"] for r in shuffled if r["g"] == g) == sorted(r["shuffled"] for r in shuffled if r["g"] == g)


def test_prefixed_ids_part_evenly(spark):
    """Ids that begin alike don't fall into one block."""
    df = spark.createDataFrame([(f"sub-{i:05d}", i) for i in range(3000)], "id string, n int").repartition(4)
    rows = folds.ordered(df, "id").collect()
    assert all(r["nth"] == r["n"] for r in rows)
    plan = folds._numbered_in_blocks
    sizes = []
    folds._numbered_in_blocks = lambda blocked, *a: sizes.append(blocked.groupBy("_block").count().agg(F.max("count"), F.count("*")).first()) or plan(blocked, *a)
    try:
        folds.ordered(df, "id")
    finally:
        folds._numbered_in_blocks = plan
    assert sizes[0][0] < 100 and sizes[0][1] > 200


def ranks(values):
    values = np.asarray(values, float)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


@pytest.mark.parametrize("n_blocks", [4, 64])
def test_ranks_in_ranges(spark, n_blocks):
    rng = np.random.default_rng(1)
    data = {0: rng.normal(size=300), 1: rng.integers(0, 5, 300).astype(float), 2: np.zeros(300)}
    rows = [(s, f, float(v)) for f, values in data.items() for s, v in enumerate(values)] + [(900, 0, None), (901, None, 1.0)]
    got = ranking.average_rank(spark.createDataFrame(rows, "subject int, feature int, value double"), blocks=n_blocks, whole=20).collect()
    assert len(got) == 900
    for f, values in data.items():
        assert [r["rank"] for r in sorted((r for r in got if r["feature"] == f), key=lambda r: r["subject"])] == ranks(values).tolist()


@pytest.mark.parametrize("width", [3, 80])
def test_rho_over_common_subjects(spark, width):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, width)), rng.integers(0, 6, (30, 2)).astype(float)
    x[:, 2] = 4.0
    x[rng.random(x.shape) < 0.1] = np.nan
    y[3, 1] = np.nan
    long = lambda m, names: spark.createDataFrame([(i, k, None if math.isnan(v) else float(v)) for i, row in enumerate(m) for k, v in enumerate(row)], names).dropna()
    got = {(r["feature"], r["score"]): r for r in ranking.spearman(long(x, "subject int, feature int, value double"), long(y, "subject int, score int, y double")).collect()}
    assert len(got) == 2 * width
    for f in range(width):
        for s in range(2):
            in_x, in_y = np.isfinite(x[:, f]), np.isfinite(y[:, s])
            rx, ry = np.full(30, np.nan), np.full(30, np.nan)
            rx[in_x], ry[in_y] = ranks(x[in_x, f]), ranks(y[in_y, s])
            both = in_x & in_y
            constant = rx[both].std() == 0 or ry[both].std() == 0
            want = 0.0 if constant else np.corrcoef(rx[both], ry[both])[0, 1]
            assert got[f, s]["n"] == both.sum() and got[f, s]["rho"] == pytest.approx(want, abs=1e-9)


def test_screen_by_p(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    y = x[:, 1] + 0.5 * rng.normal(size=60)
    long = spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(x) for k, v in enumerate(row)], "subject int, feature int, value double")
    scores = spark.createDataFrame([(i, "s", float(v)) for i, v in enumerate(y)], "subject int, score string, y double")
    want = {k for k in range(5) for r in [abs(np.corrcoef(ranks(x[:, k]), ranks(y))[0, 1])] if ranking.t_tail(r * math.sqrt(58 / (1 - r * r)), 58) <= 0.005}
    assert {r["feature"] for r in ranking.spearman_screen(long, scores, 0.005).collect()} == want and 1 in want


@pytest.mark.parametrize("method", ["euclidean", "correlation"])
@pytest.mark.parametrize("rows", [7, None])
def test_pairs_in_blocks(spark, method, rows):
    """Also with features that some subjects lack, equal subjects, a constant one, and a common offset."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(25, 6)) + 1000
    x[4], x[9] = x[3], 1000.0
    for lacking in (False, True):
        if lacking:
            x[2, 1] = x[11, 5] = np.nan
        long = spark.createDataFrame([(f"s{i:02d}", k, float(v)) for i, row in enumerate(x) for k, v in enumerate(row) if not math.isnan(v)], "subject string, feature int, value double")
        d = np.zeros((25, 25))
        for i in range(25):
            for j in range(25):
                both = np.isfinite(x[i]) & np.isfinite(x[j])
                if method == "euclidean":
                    d[i, j] = np.linalg.norm((x[i] - x[j])[both])
                elif i != j:
                    z = [np.divide(v - np.nanmean(v), np.nanstd(v), out=np.zeros(6), where=np.nanstd(v) > 1e-9) for v in (x[i], x[j])]
                    d[i, j] = math.sqrt(max(0, 2 * (1 - (z[0] * z[1])[both].mean())))
        made = blocks.pair_distances(long, method, rows)
        got = {(r["i"], r["j"]): r["distance"] for r in blocks.entries(made, "distance").collect()}
        assert len(got) == 300
        within = 1e-7 if not lacking else 2e-2 if method == "euclidean" else 1e-7
        assert all(abs(v - d[int(i[1:]), int(j[1:])]) < within and i < j for (i, j), v in got.items())
        a = -0.5 * d * d
        want = a - a.mean(0) - a.mean(1)[:, None] + a.mean()
        centred = {(r["i"], r["j"]): r["g"] for r in blocks.entries(blocks.centre(made), "g", both=True).collect()}
        assert len(centred) == 625
        assert all(abs(v - want[int(i[1:]), int(j[1:])]) < max(within, 1e-6) for (i, j), v in centred.items())


def test_outliers_by_sums(spark):
    """The fit's sums are taken over a table of bins, empty ones too: the labels are those of a fit of all points."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=900), rng.normal(size=100) - 6])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(1000, None)], "id int, v double")
    rows = summaries.find_outliers(df, "v", 2.0).collect()
    z = (v - v.mean()) / v.std()
    density, edges = np.histogram(z, 100, density=True)
    x = edges[:-1] + (edges[1] - edges[0]) / 2
    _, mu, sigma = summaries.fit_gauss(lambda p: [float(np.sum(t)) for t in summaries.gauss_terms(x, density, p)])
    share = (z <= mu - 2 * abs(sigma)).mean()
    cut = np.quantile(v, share)
    assert len(rows) == 1001 and all(r["y"] == int(r["v"] > cut) for r in rows if r["v"] is not None)
    assert 80 < sum(r["y"] == 0 for r in rows if r["v"] is not None) < 150


def test_isolation_forest_is_the_same_on_any_partitioning(spark):
    """Samples are of all rows, of the size asked for, and those of least hash."""
    from panelforge.operators import isolation

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(290, 5)), rng.normal(size=(10, 5)) + 8])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "subject int, features array<double>")
    runs = []
    for parts in (1, 7):
        got = isolation.isolation_forest(df.repartition(parts), 10 / 300, trees=60, sample=40).collect()
        runs.append({r["subject"]: (round(r["score"], 12), r["outlier"]) for r in got})
    assert runs[0] == runs[1] and len(runs[0]) == 300
    assert sum(o for _, o in runs[0].values()) == 10 and all(runs[0][i][1] == 1 for i in range(290, 300))
    forest = isolation.grow_isolation_forest(df, trees=3, sample=None)
    assert forest.sample == 5 and len(forest.trees) == 3
    whole = isolation.grow_isolation_forest(df, trees=2, sample=1000)
    assert whole.sample == 300
    feature, cut, child, depth = whole.trees[0]
    inner = feature >= 0
    assert len(feature) == 2 * inner.sum() + 1 and (depth[~inner] > 0).all()


def test_templates_of_all_folds_at_once(spark):
    """Equal to the templates of each fold by itself: all others' mean, the subject left out."""
    from panelforge.operators import features

    rng = np.random.default_rng(7)
    z = rng.normal(size=(9, 3, 20))
    cells = [(s, e, r, t, float(z[s, r, t] * (1 + (e == "b")) + t * (e == "b"))) for s in range(9) for e in "ab" for r in range(3) for t in range(20)]
    panel = features.zscored(spark.createDataFrame(cells, "subject int, experiment string, roi int, t int, v double"))
    members = spark.createDataFrame([(s, s % 3, s % 4 != 0) for s in range(9)], "subject int, fold int, member boolean")
    got = {(r["fold"], r["subject"], r["experiment"], r["feature"]): r["r"] for r in features.intersubject_by_fold(panel, members, 3, 3).collect()}
    assert len(got) == 3 * 9 * 2 * 6
    for f in range(3):
        marked = panel.join(members, "subject").withColumn("inside", F.col("member") & (F.col("fold") != f))
        for r in features.intersubject_matrices(marked, "inside", 3).collect():
            assert got[f, r["subject"], r["experiment"], r["feature"]] == pytest.approx(r["r"], abs=1e-9)


def plan_above_tiles(df):
    """The operators of a plan that stand above the one that makes the cells of pairs."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return "\n".join(lines[: next(i for i, line in enumerate(lines) if "FlatMapGroupsInArrow" in line)])


def few_subjects(spark, n=17, width=4):
    x = np.random.default_rng(8).normal(size=(n, width))
    return x, spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(x) for k, v in enumerate(row)], "subject int, feature int, value double")


def test_centred_cells_are_not_shuffled(spark, monkeypatch):
    """Cells go from the task that makes them to the result, in tiles; only features are shuffled."""
    monkeypatch.setattr(blocks, "TILE", 3, raising=False)
    x, long = few_subjects(spark)
    df = blocks.entries(blocks.centre(blocks.pair_distances(long, rows=7)), "g", both=True)
    assert "Exchange" not in plan_above_tiles(df) and "Join" not in plan_above_tiles(df)
    a = -0.5 * ((x[:, None] - x[None]) ** 2).sum(2)
    want = a - a.mean(0) - a.mean(1)[:, None] + a.mean()
    got = {(r["i"], r["j"]): r["g"] for r in df.collect()}
    assert len(got) == 17 * 17 and all(v == pytest.approx(want[k], abs=1e-9) for k, v in got.items())


def test_distances_are_not_shuffled(spark, monkeypatch):
    """Nor are they, rounded where they are made, and those of features that some lack keep their digits."""
    monkeypatch.setattr(blocks, "TILE", 5, raising=False)
    x, _ = few_subjects(spark)
    x += 1e5
    x[3], x[4, 0] = x[2], np.nan
    long = spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(x) for k, v in enumerate(row) if np.isfinite(v)], "subject int, feature int, value double")
    df = ranking.pairwise_distance(long)
    assert "Exchange" not in plan_above_tiles(df) and "Join" not in plan_above_tiles(df)
    got = {(r["i"], r["j"]): r["distance"] for r in df.collect()}
    want = np.sqrt(np.nansum((x[:, None] - x[None]) ** 2, 2))
    assert len(got) == 17 * 16 // 2 and got[2, 3] == 0 and all(v == pytest.approx(want[k], abs=1e-9) for k, v in got.items())
    rounded = {(r["i"], r["j"]): r["distance"] for r in ranking.pairwise_distance(long, digits=3).collect()}
    assert all(v == round(got[k], 3) for k, v in rounded.items())
