"""Features of multichannel series: correlations, windows, templates, regional means, states."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.config import DEFAULTS
from panelforge.functions.series import edge_index, guarded_corr, zscore
from panelforge.sources.domain import to_series


def _matrix(group):
    """A group's series as a matrix, its regions in order, with bad values as 0."""
    import numpy as np

    order = np.argsort(group["roi"].to_numpy())
    return np.nan_to_num(np.array([group["series"][int(k)].as_py() for k in order], dtype=float), posinf=0, neginf=0)


def _corr(a, b):
    """Correlation of each row of a with each row of b; 0 where a row is constant."""
    import numpy as np

    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
    return np.divide(a @ b.T, norms, out=np.zeros((len(a), len(b))), where=norms > 0)


def zscored(panel: DataFrame) -> DataFrame:
    """A long panel with `z`, the value in standard deviations of its series."""
    w = Window.partitionBy("subject", "experiment", "roi")
    return panel.withColumn("z", F.coalesce(zscore(F.col("v"), F.avg("v").over(w), F.stddev_pop("v").over(w)), F.lit(0.0)))


def median_filtered(panel: DataFrame, k: int = 5) -> DataFrame:
    """A long panel with `filtered`, the running median of k values (odd), with zeros beyond the ends."""
    if k % 2 == 0:
        raise ValueError("the kernel is odd")
    w = Window.partitionBy("subject", "experiment", "roi").orderBy("t").rowsBetween(-(k // 2), k // 2)
    got = F.collect_list("v").over(w)
    padded = F.array_sort(F.concat(got, F.array_repeat(F.lit(0.0), F.lit(k) - F.size(got))))
    return panel.withColumn("filtered", F.element_at(padded, k // 2 + 1))


def connectivity(series: DataFrame) -> DataFrame:
    """`subject, experiment, edges`: the correlations of all pairs of regions i < j. A task holds one matrix at a time."""

    def one(group):
        import numpy as np
        import pyarrow as pa

        m = _matrix(group)
        edges = _corr(m, m)[np.triu_indices(len(m), 1)]
        return pa.table({"subject": group["subject"][:1], "experiment": group["experiment"][:1], "edges": [edges.tolist()]})

    kind = series.schema["subject"].dataType.simpleString()
    return series.groupBy("subject", "experiment").applyInArrow(one, f"subject {kind}, experiment string, edges array<double>")


def connectivity_long(panel: DataFrame, n_rois: int) -> DataFrame:
    """The same by a self-join of a long panel on time: for few regions, and in the JVM alone."""
    other = panel.select("subject", "experiment", "t", F.col("roi").alias("roi_j"), F.col("v").alias("v_j"))
    pairs = panel.join(other, ["subject", "experiment", "t"]).filter("roi < roi_j")
    return pairs.groupBy("subject", "experiment", edge_index(F.col("roi"), F.col("roi_j"), n_rois).alias("edge")).agg(guarded_corr("v", "v_j").alias("r"))


def taper(length: int, alpha: float):
    import numpy as np

    x = np.arange(length) / max(1, length - 1)
    if alpha <= 0:
        return np.ones(length)
    if alpha >= 1:
        return 0.5 * (1 - np.cos(2 * math.pi * x))
    rise, half = 2 * math.pi / alpha, alpha / 2
    return np.where(x < half, 0.5 * (1 + np.cos(rise * (x - half))), np.where(x >= 1 - half, 0.5 * (1 + np.cos(rise * (x - 1 + half))), 1.0))


def window_count(t: int, length: int, step: int, include_last: bool = False) -> int:
    """A window that ends with the series counts only with `include_last`."""
    return max(0, (t - length - (not include_last)) // step + 1)


def dynamic_connectivity(series: DataFrame, length: int = DEFAULTS.win_length, step: int = DEFAULTS.win_step, alpha: float = DEFAULTS.taper_alpha, include_last: bool = False) -> DataFrame:
    """`subject, experiment, win, edges`: correlations within sliding, tapered windows of z-scored series."""

    def one(group):
        import numpy as np
        import pyarrow as pa

        m = _matrix(group)
        std = m.std(1, keepdims=True)
        m = np.divide(m - m.mean(1, keepdims=True), std, out=np.zeros_like(m), where=std > 0)
        shape, upper = taper(length, alpha), np.triu_indices(len(m), 1)
        n = window_count(m.shape[1], length, step, include_last)
        edges = [_corr(x, x)[upper].tolist() for x in (m[:, w * step : w * step + length] * shape for w in range(n))]
        names = {c: pa.array([group[c][0].as_py()] * n, group.schema.field(c).type) for c in ("subject", "experiment")}
        return pa.table(names | {"win": pa.array(range(n), pa.int32()), "edges": pa.array(edges, pa.list_(pa.float64()))})

    kind = series.schema["subject"].dataType.simpleString()
    return series.groupBy("subject", "experiment").applyInArrow(one, f"subject {kind}, experiment string, win int, edges array<double>")


def edges_long(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "edges"], F.posexplode("edges").alias("edge", "r"))


def template_sums(z_panel: DataFrame, keys: list[str]) -> DataFrame:
    """Sums and counts of z by `keys`, experiment, region and time: all templates of all folds come from these."""
    return z_panel.groupBy(*keys, "experiment", "roi", "t").agg(F.sum("z").alias("s"), F.count("*").alias("n"))


def training_templates(z_panel: DataFrame, keys: list[str]) -> DataFrame:
    """For each fold, the mean series of the subjects of other folds: the total less the fold's own sum."""
    sums = template_sums(z_panel, ["fold", *keys])
    total = sums.groupBy(*keys, "experiment", "roi", "t").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    rest = F.nullif(F.col("all_n") - F.col("n"), F.lit(0))
    return sums.join(total, [*keys, "experiment", "roi", "t"]).select("fold", *keys, "experiment", "roi", "t", ((F.col("all_s") - F.col("s")) / rest).alias("mean"))


def against_template(z_panel: DataFrame, in_template: str) -> DataFrame:
    """`subject, experiment, roi, t, z, mean`: each row with the mean of the subjects that `in_template` (a boolean column)
    marks, the subject itself left out: (S - z) / (n - 1), from one sum. The template has a row for each region and time."""
    template = template_sums(z_panel.filter(in_template), [])
    own, present = F.when(F.col(in_template), F.col("z")).otherwise(0.0), F.col(in_template).cast("int")
    mean = (F.col("s") - own) / F.nullif(F.col("n") - present, F.lit(0))
    return z_panel.join(F.broadcast(template), ["experiment", "roi", "t"]).select("subject", "experiment", "roi", "t", "z", mean.alias("mean"))


def intersubject(z_panel: DataFrame, in_template: str, n_rois: int, full: bool = False) -> DataFrame:
    """`subject, experiment, feature, roi_i, roi_j, r`: template region i with the subject's region j, for i <= j.

    By a join on time, n_rois squared rows for each: for few regions, in the JVM alone.
    """
    rest = against_template(z_panel, in_template).select("subject", "experiment", F.col("roi").alias("roi_i"), "t", "mean")
    mine = z_panel.select("subject", "experiment", "t", F.col("roi").alias("roi_j"), "z")
    pairs = rest.join(mine, ["subject", "experiment", "t"])
    pairs = pairs if full else pairs.filter("roi_i <= roi_j")
    feature = F.col("roi_i") * n_rois + F.col("roi_j") if full else edge_index(F.col("roi_i"), F.col("roi_j"), n_rois, 0)
    return pairs.groupBy("subject", "experiment", "roi_i", "roi_j").agg(guarded_corr("mean", "z").alias("r")).withColumn("feature", feature)


def intersubject_matrices(z_panel: DataFrame, in_template: str, n_rois: int, full: bool = False) -> DataFrame:
    """The same by matrices, for many regions: a task holds one subject's series at a time; all of one length."""
    cells = F.array_sort(F.collect_list(F.struct("t", "z", F.coalesce("mean", F.lit(0.0)).alias("mean"))))
    series = against_template(z_panel, in_template).groupBy("subject", "experiment", "roi").agg(cells.alias("x"))
    series = series.select("subject", "experiment", "roi", F.col("x.z").alias("z"), F.col("x.mean").alias("mean"))

    def one(group):
        import numpy as np
        import pyarrow as pa

        group = group.sort_by("roi")
        roi = group["roi"].to_numpy().astype(np.int32)
        r = _corr(*(np.array(group[c].to_pylist(), dtype=float) for c in ("mean", "z")))
        i, j = np.indices(r.shape).reshape(2, -1) if full else np.triu_indices(len(r))
        names = {c: pa.array([group[c][0].as_py()] * len(i), group.schema.field(c).type) for c in ("subject", "experiment")}
        return pa.table(names | {"roi_i": pa.array(roi[i]), "roi_j": pa.array(roi[j]), "r": pa.array(r[i, j])})

    kind = z_panel.schema["subject"].dataType.simpleString()
    out = series.groupBy("subject", "experiment").applyInArrow(one, f"subject {kind}, experiment string, roi_i int, roi_j int, r double")
    return out.withColumn("feature", F.col("roi_i") * n_rois + F.col("roi_j") if full else edge_index(F.col("roi_i"), F.col("roi_j"), n_rois, 0))


def homologous_corr(z_panel: DataFrame, in_template: str, n_rois: int) -> DataFrame:
    """The features of each region with the template's same region alone: no pairs are made."""
    own = against_template(z_panel, in_template).groupBy("subject", "experiment", "roi").agg(guarded_corr("mean", "z").alias("r"))
    return own.select("subject", "experiment", F.col("roi").alias("roi_i"), F.col("roi").alias("roi_j"), "r", edge_index(F.col("roi"), F.col("roi"), n_rois, 0).alias("feature"))


def intersubject_by_fold(z_panel: DataFrame, members: DataFrame, k: int, n_rois: int) -> DataFrame:
    """`fold, subject, experiment, feature, r` of every subject in each of k folds, in one job: template region i with the
    subject's region j, i <= j, where a fold's template is the mean of the `members` (`subject, fold, member`) of the
    other folds that are marked, the subject itself left out.

    All templates are differences of one sum by (fold, experiment, region, time): total less fold, and less the subject.
    They go to the tasks, k + 1 matrices of one subject's size for each experiment; a task holds one subject at a time.
    """
    import numpy as np

    marked = z_panel.join(members.select("subject", "fold", "member"), "subject")
    sums = template_sums(marked.filter("member"), ["fold"])
    subjects = {(r["experiment"], r["fold"]): r["n"] for r in marked.filter("member").groupBy("experiment", "fold").agg(F.count_distinct("subject").alias("n")).collect()}
    length = {r["experiment"]: r["t"] + 1 for r in z_panel.groupBy("experiment").agg(F.max("t").alias("t")).collect()}
    folds_of = {name: np.zeros((k, n_rois, t)) for name, t in length.items()}
    for r in sums.select("fold", "experiment", "roi", "t", "s").toLocalIterator():
        folds_of[r["experiment"]][r["fold"], r["roi"], r["t"]] = r["s"]
    counts = {name: np.array([subjects.get((name, f), 0) for f in range(k)]) for name in length}
    series = marked.groupBy("subject", "experiment", "roi").agg(F.first("fold").alias("fold"), F.first("member").alias("member"), F.transform(F.array_sort(F.collect_list(F.struct("t", "z"))), lambda x: x["z"]).alias("z"))

    def one(group):
        import pyarrow as pa

        group = group.sort_by("roi")
        name, own, member = (group[c][0].as_py() for c in ("experiment", "fold", "member"))
        z = np.array(group["z"].to_pylist(), dtype=float)
        upper, out = np.triu_indices(len(z)), []
        total, n = folds_of[name].sum(0), counts[name].sum()
        for f in range(k):
            present = bool(member) and f != own
            mean = (total - folds_of[name][f] - z * present) / max(1, n - counts[name][f] - present)
            out.append(_corr(mean, z)[upper])
        m = len(upper[0])
        same = {c: pa.array([group[c][0].as_py()] * (k * m), group.schema.field(c).type) for c in ("subject", "experiment")}
        return pa.table({"fold": pa.array(np.repeat(np.arange(k, dtype=np.int32), m))} | same | {"feature": pa.array(np.tile(np.arange(m, dtype=np.int32), k)), "r": pa.array(np.concatenate(out))})

    kind = z_panel.schema["subject"].dataType.simpleString()
    return series.groupBy("subject", "experiment").applyInArrow(one, f"fold int, subject {kind}, experiment string, feature int, r double")


def homologous(features: DataFrame) -> DataFrame:
    return features.filter("roi_i = roi_j")


def template_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select("subject", "experiment", "feature", F.col("r").alias("other"))
    return a.join(other, ["subject", "experiment", "feature"]).select("subject", "experiment", "feature", (F.col("r") - F.col("other")).alias("difference"))


def roi_means(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Mean statistic of each region but 0; a voxel that the mask lacks is an error."""
    joined = voxels.join(mask, "voxel_id", "left").filter("roi is null or roi != 0")
    roi = F.when(F.col("roi").isNull(), F.raise_error(F.lit("the mask lacks a voxel of a map")).cast("int")).otherwise(F.col("roi"))
    return joined.groupBy("subject", "map", roi.alias("roi")).agg(F.avg("stat").alias("mean"))


def dynamic_states(windows: DataFrame, group_col: str | None = None, k: int = DEFAULTS.n_states, seed: int = 0) -> DataFrame:
    """`grp, state, centroid`: k-means of window vectors, for each class on its own."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = windows.sparkSession
    groups = [r[0] for r in windows.select(group_col).distinct().orderBy(group_col).collect()] if group_col else [None]
    out = []
    for group in groups:
        rows = windows.filter(F.col(group_col) == group) if group_col else windows
        vectors = rows.select(array_to_vector(F.transform("edges", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))).alias("features"))
        model = KMeans(k=k, seed=seed, maxIter=50).fit(vectors)
        out += [(str(group), i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame([(g, n, c) for n, (g, _, c) in enumerate(out)], "grp string, state int, centroid array<double>")


def state_occupancy(windows: DataFrame, states: DataFrame) -> DataFrame:
    """`subject, experiment, state, weight`: the mean coefficient when a state is fitted by a subject's windows.

    Samples are edges, regressors are windows (those that are all 0 left out), with an intercept; minimum norm.
    """
    centroids = [(r["state"], r["centroid"]) for r in states.orderBy("state").collect()]  # classes times k rows

    def one(group):
        import numpy as np
        import pyarrow as pa

        x = np.nan_to_num(np.array(group["edges"].to_pylist(), dtype=float)).T
        x = x[:, np.abs(x).sum(0) > 0]
        y = np.array([c for _, c in centroids]).T
        beta = np.linalg.lstsq(x - x.mean(0), y - y.mean(0), rcond=None)[0] if x.shape[1] else np.zeros((1, y.shape[1]))
        n = len(centroids)
        names = {c: pa.array([group[c][0].as_py()] * n, group.schema.field(c).type) for c in ("subject", "experiment")}
        return pa.table(names | {"state": pa.array([s for s, _ in centroids], pa.int32()), "weight": pa.array(beta.mean(0))})

    kind = windows.schema["subject"].dataType.simpleString()
    return windows.select("subject", "experiment", "edges").groupBy("subject", "experiment").applyInArrow(one, f"subject {kind}, experiment string, state int, weight double")


def series_of(panel: DataFrame) -> DataFrame:
    return to_series(panel)
