"""Exact quantiles by narrowing ranges: no task holds more than a bounded number of values, however many there are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.sources.files import kept

#: Values of one group that a task may hold; steps of the grid that narrows a range; accuracy of its mergeable sketch.
MOST, GRID, ACCURACY = 1 << 16, 256, 4096


def exact_quantiles(df: DataFrame, column: str, qs: list[float], by: list[str] = (), most: int = MOST, passes: int = 40) -> DataFrame:
    """`by..., n, q0, q1, ...` of the values of each group that aren't null, by linear interpolation; no group for no value.

    Groups of at most `most` values are sorted as they are. For each larger one, a pass counts the values below and
    within a range around each quantile, and takes mergeable sketches of those within; the sketch gives a narrower range
    for the next pass, until it holds at most `most` values or equal ones. The driver gets a row for each larger group,
    of which there are at most one for every `most` rows. The values are written once then: computed anew for each pass,
    a sum of them may differ in its last digit, and ties would change sides.
    """
    by, spark = list(by), df.sparkSession
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    large = [r.asDict() for r in sizes.filter(F.col("_n") > most).collect()]
    plain = lambda d: d.groupBy(*by).agg(F.count("*").alias("n"), *(F.percentile("_v", F.lit(q)).alias(f"q{k}") for k, q in enumerate(qs))).filter("n > 0")
    if not large:
        return plain(rows)
    rows = kept(rows, "quantile-values")
    # each quantile lies between the values of two ranks
    for g in large:
        for k, q in enumerate(qs):
            at = q * (g["_n"] - 1)
            g |= {f"first{k}": int(at), f"last{k}": min(g["_n"] - 1, int(at) + (at > int(at))), f"low{k}": None, f"high{k}": None, f"done{k}": False}
    kinds = {c: t for c, t in rows.dtypes}
    state_schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "_n long", *(f"first{k} long, last{k} long, low{k} double, high{k} double, below{k} long, inside{k} long, done{k} boolean" for k in range(len(qs)))])
    names = [f.name for f in spark.createDataFrame([], state_schema).schema]

    def with_state() -> DataFrame:
        state = spark.createDataFrame([tuple(g.get(c) for c in names) for g in large], state_schema)
        mine = state.select(*(F.col(c).alias(f"_of_{c}") for c in by), *names[len(by) :])
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by), F.lit(True))
        return rows.join(F.broadcast(mine), same)  # a row for every `most` rows at most

    def within(k: int) -> Column:
        return (F.col(f"low{k}").isNull() | (F.col("_v") >= F.col(f"low{k}"))) & (F.col(f"high{k}").isNull() | (F.col("_v") <= F.col(f"high{k}")))

    levels = [i / GRID for i in range(GRID + 1)]
    for _ in range(passes):
        inside = lambda k: F.when(within(k), F.col("_v"))
        cells = [x for k in range(len(qs)) for x in (F.count_if(F.col("_v") < F.col(f"low{k}")).alias(f"below{k}"), F.count(inside(k)).alias(f"inside{k}"), F.min(inside(k)).alias(f"min{k}"), F.max(inside(k)).alias(f"max{k}"), F.percentile_approx(inside(k), levels, ACCURACY).alias(f"grid{k}"))]
        found = {tuple(r[c] for c in by): r for r in with_state().groupBy(*by).agg(*cells).collect()}
        for g in large:
            r = found[tuple(g[c] for c in by)]
            for k in range(len(qs)):
                below, count = r[f"below{k}"], r[f"inside{k}"]
                if not below <= g[f"first{k}"] <= g[f"last{k}"] < below + count:
                    raise ValueError(f"a sketch missed the quantile {qs[k]}")
                low, high = r[f"min{k}"], r[f"max{k}"]
                g |= {f"below{k}": below, f"inside{k}": count, f"low{k}": low, f"high{k}": high, f"done{k}": count <= most or low == high}
                if not g[f"done{k}"]:
                    grid, place = r[f"grid{k}"], [GRID * (g[f"{end}{k}"] - below) / max(1, count - 1) for end in ("first", "last")]
                    g |= {f"low{k}": max(low, grid[max(0, int(place[0]) - 2)]), f"high{k}": min(high, grid[min(GRID, int(place[1]) + 3)])}
        if all(g[f"done{k}"] for g in large for k in range(len(qs))):
            break
    else:
        raise ValueError(f"the quantiles aren't found within {passes} passes")
    # ranges of equal values need none of them; of the others there are few
    few = lambda k: F.array_sort(F.collect_list(F.when(within(k) & (F.col(f"low{k}") < F.col(f"high{k}")), F.col("_v"))))
    settled = [F.first(c).alias(c) for k in range(len(qs)) for c in (f"first{k}", f"last{k}", f"low{k}", f"below{k}")]
    got = with_state().groupBy(*by).agg(F.first("_n").alias("n"), *settled, *(few(k).alias(f"few{k}") for k in range(len(qs))))

    def value(k: int, end: str) -> Column:
        return F.coalesce(F.get(f"few{k}", (F.col(f"{end}{k}") - F.col(f"below{k}")).cast("int")), F.col(f"low{k}"))

    share = lambda k, q: q * (F.col("n") - 1) - F.col(f"first{k}")
    exact = got.select(*by, "n", *((value(k, "first") + F.when(F.col(f"first{k}") < F.col(f"last{k}"), share(k, q) * (value(k, "last") - value(k, "first"))).otherwise(0.0)).alias(f"q{k}") for k, q in enumerate(qs)))
    if not by:
        return exact
    mine = spark.createDataFrame([tuple(g[c] for c in by) for g in large], ", ".join(f"`_of_{c}` {kinds[c]}" for c in by))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by))
    return plain(rows.join(F.broadcast(mine), same, "left_anti")).unionByName(exact)
