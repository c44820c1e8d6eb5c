"""Arrays of many thousand columns: sums over rows, tall-skinny QR, and solvers that need only products with blocks.

No matrix as wide as the columns on both sides is made anywhere. A pass sends a tall block of directions to the tasks
and gets a block of the same shape back; what the tasks have summed meets in a tree, in parts of half a megabyte.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.sources.files import kept

#: Cells in one part of a sum, and partial sums that meet at a node of the tree.
PART, FAN = 1 << 16, 64
#: Cells of the basis that the driver holds of one side, beyond which it keeps only the best directions.
CELLS = 1 << 24
#: Directions beyond those wanted.
SPARE = 8
#: Bytes of one Arrow batch, where the session sets none: a row may have hundreds of kB.
BATCH_BYTES = "8m"


def bounded_batches(df: DataFrame) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, BATCH_BYTES)


def matrix(column, bad: bool = False):
    """An Arrow column of lists as a matrix, with bad values as 0, or as they are; rows of other lengths, and null rows,
    are an error."""
    import numpy as np
    import pyarrow.compute as pc

    width = pc.list_value_length(column)
    if column.null_count or pc.min_max(width)["min"].as_py() != pc.min_max(width)["max"].as_py():
        raise ValueError("the rows aren't arrays of one length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    flat = flat.reshape(len(column), -1)
    return flat if bad else np.nan_to_num(flat, posinf=0, neginf=0)


def tree(parts: DataFrame, combine, small: bool = False, few: bool = False) -> dict:
    """`key, block, part, data` brought together by `combine` (of a list of buffers) for each key and block, in a tree.

    Small parts leave the last level, of FAN at most, to the driver, and all levels if there are `few` tasks.
    """
    schema = "key string, block int, part int, data binary"

    out: dict = {}

    def meet(group):
        import pyarrow as pa

        data = combine([x.as_buffer() for x in group["data"]])
        first = group.slice(0, 1)
        return pa.table([first["key"].combine_chunks(), first["block"].combine_chunks(), first["part"].combine_chunks(), pa.array([data], pa.binary())], names=["key", "block", "part", "data"])

    if small and few:
        found = parts.toArrow()
        return _joined(found, combine, out)
    low = parts.withColumn("part", F.pmod("part", F.lit(FAN)).cast("int")).groupBy("key", "block", "part").applyInArrow(meet, schema)
    found = (low if small else low.groupBy("key", "block").applyInArrow(meet, schema)).toArrow()
    return _joined(found, combine, out)


def _joined(found, combine, out: dict) -> dict:
    for key, block, data in zip(found["key"].to_pylist(), found["block"].to_pylist(), found["data"].to_pylist(), strict=True):
        out.setdefault(key, {}).setdefault(block, []).append(data)
    return {k: b"".join(combine(v[i]) for i in sorted(v)) for k, v in out.items()}


def few_tasks(written: DataFrame) -> bool:
    """Whether a table that is read from files is read by at most FAN tasks."""
    return written.rdd.getNumPartitions() <= FAN


def _added(buffers):
    import numpy as np

    total = np.frombuffer(buffers[0], np.float64).copy()
    for b in buffers[1:]:
        total += np.frombuffer(b, np.float64)
    return total.tobytes()


def sum_over_rows(df: DataFrame, columns: list[str], partial, keys: str | None = None, cells: int | None = None, few: bool = False, bad: bool = False) -> dict:
    """For each key, one flat array: the sum over all rows of what `partial` makes of the matrices of some rows.

    `keys` is a column of arrays of numbers: a row counts for each of them. Without it the key is "". `cells`: how many
    the sum has, if that is known; a small one takes one level of the tree less, or, of `few` tasks,
    none. `bad`: the matrices keep NaN and infinities, which else are 0.
    """
    bounded_batches(df)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, sums = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [matrix(batch[c], bad) for c in columns]
            if keys is None:
                chosen = [("", slice(None))]
            else:
                of = batch["keys"].flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch["keys"].offsets)))
                chosen = [(str(k), row[of == k]) for k in np.unique(of)]
            for k, some in chosen:
                found = partial(*(m[some] for m in rows))
                sums[k] = found if k not in sums else sums[k] + found
        for k, total in sums.items():
            flat = np.ascontiguousarray(total, np.float64).ravel()
            for b, at in enumerate(range(0, len(flat), PART)):
                yield pa.record_batch([pa.array([k]), pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([flat[at : at + PART].tobytes()], pa.binary())], names=["key", "block", "part", "data"])

    import numpy as np

    chosen = df.select(*columns) if keys is None else df.select(*columns, F.col(keys).alias("keys"))
    return {k: np.frombuffer(v, np.float64) for k, v in tree(chosen.mapInArrow(run, "key string, block int, part int, data binary"), _added, cells is not None and cells <= PART, few).items()}


def means(df: DataFrame, columns: list[str]):
    """Number of rows, and the mean array of each column."""
    import numpy as np

    widths = df.select(*map(F.size, columns)).first()
    if widths is None:
        raise ValueError("there are no rows")
    flat = sum_over_rows(df, columns, lambda *m: np.concatenate([[float(len(m[0]))], *(x.sum(0) for x in m)]), cells=1 + sum(widths))[""]
    ends = np.cumsum([1, *widths])
    return flat[0], *(flat[i:j] / flat[0] for i, j in zip(ends, ends[1:], strict=False))


def tall_qr(df: DataFrame, column: str, weights, mean):
    """R of the QR decomposition of (column - mean) @ weights, by a tree of tasks."""
    import numpy as np

    bounded_batches(df)
    wide = weights.shape[1]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        r = np.zeros((0, wide))
        for batch in batches:
            if batch.num_rows:
                r = np.linalg.qr(np.concatenate([r, (matrix(batch["v"]) - mean) @ weights]), mode="r")
        if len(r):
            yield pa.record_batch([pa.array([""]), pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["key", "block", "part", "data"])

    def stacked(buffers):
        return np.linalg.qr(np.concatenate([np.frombuffer(b, np.float64).reshape(-1, wide) for b in buffers]), mode="r").tobytes()

    found = tree(df.select(F.col(column).alias("v")).mapInArrow(run, "key string, block int, part int, data binary"), stacked)
    return np.frombuffer(found[""], np.float64).reshape(-1, wide)


def orthonormal(block, basis=None):
    """An orthonormal basis of what `block` adds to `basis`; columns that add next to nothing are left out."""
    import numpy as np

    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # once more for what rounding left
        if basis is not None and basis.shape[1]:
            block = block - basis @ (basis.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-9]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block / np.linalg.norm(block, axis=0), full_matrices=False)
        block = u[:, s > 1e-9 * s[0]]
    return block


def principal_directions(df: DataFrame, column: str, n: int, share: float | None = None, tolerance: float = 1e-10, passes: int = 60, seed: int = 0):
    """`mean, directions, variances, total` of the largest principal components, by randomized subspace iteration.

    Seeded test columns are multiplied by X'X, a summed pass each time; earlier blocks are kept, and the wanted
    directions are the best within all of them, until X'X maps each to itself within `tolerance` of the largest. A last
    pass makes a tall-skinny QR of the rows along them, whose singular values are the variances' roots. With `share`, n
    grows to as many as reach that share of the variance.
    """
    import numpy as np

    df = kept(df.select(column), "wide-rows")  # written once, as every pass reads it
    few = few_tasks(df)
    rows, mean = means(df, [column])
    width = len(mean)
    rank = int(min(width, max(1, rows - 1)))

    def images(block):
        """X'X block, and the sum of squares."""

        def products(x):
            x = x - mean
            return np.concatenate([(x.T @ (x @ block)).ravel(), [(x * x).sum()]])

        found = sum_over_rows(df, [column], products, cells=block.size + 1, few=few)[""]
        return found[:-1].reshape(width, -1), float(found[-1])

    asked = n
    # the sketch: what X'X makes of test columns lies within the span of the rows
    n = min(n, rank)
    sketch, total = images(np.random.default_rng(seed).normal(size=(width, min(rank, n + SPARE))))
    block = orthonormal(sketch)
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    value, vector = np.zeros(1), np.zeros((0, 0))
    for _ in range(passes):
        if not block.shape[1]:
            break
        basis, image = np.concatenate([basis, block], 1), np.concatenate([image, images(block)[0]], 1)
        inner = basis.T @ image
        value, vector = np.linalg.eigh((inner + inner.T) / 2)
        value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
        if share is not None:
            n = max(n, min(int(np.searchsorted(np.cumsum(value), (share - 1e-12) * total)) + 1, rank, basis.shape[1]))
        some = vector[:, : min(n, basis.shape[1])]
        rest = image @ some - basis @ (some * value[: some.shape[1]])
        settled = np.linalg.norm(rest, axis=0) <= tolerance * max(value[0], 1e-300)
        reached = share is None or value[:n].sum() >= (share - 1e-9) * total
        if basis.shape[1] >= n and settled.all() and reached:
            break
        last = image[:, -block.shape[1] :]
        block = orthonormal(last if share is not None else np.concatenate([rest, last], 1), basis)[:, : n + SPARE]
        if (basis.shape[1] + block.shape[1]) * width > CELLS and basis.shape[1] > 2 * (n + SPARE):
            if share is not None:
                raise ValueError(f"more than {basis.shape[1]} components for that share of the variance")
            best = vector[:, : n + SPARE]
            basis, image = basis @ best, image @ best
            block = orthonormal(block, basis)
    else:
        raise ValueError(f"the directions aren't found within {passes} passes")
    if not basis.shape[1]:
        return mean, np.eye(width)[:, :n], np.zeros(n), 0.0
    directions = orthonormal(basis @ vector[:, : min(n + SPARE, basis.shape[1])])
    _, s, turn = np.linalg.svd(tall_qr(df, column, directions, mean), full_matrices=False)
    if share is not None:
        n = max(asked, int(np.searchsorted(np.cumsum(s**2), (share - 1e-12) * total)) + 1)
    directions, n = directions @ turn.T, min(n, len(s))
    return mean, directions[:, :n], s[:n] ** 2, total


def side_products(df: DataFrame, x: str, y: str, mean_x, mean_y, block_x, block_y, few: bool = False):
    """X'X bx, Y'X bx, X'Y by and Y'Y by of the centred columns, in one pass."""
    import numpy as np

    p, q, a, b = len(mean_x), len(mean_y), block_x.shape[1], block_y.shape[1]

    def partial(u, v):
        u, v = u - mean_x, v - mean_y
        both = np.concatenate([u @ block_x, v @ block_y], 1)
        return np.concatenate([(u.T @ both).ravel(), (v.T @ both).ravel()])

    flat = sum_over_rows(df, [x, y], partial, cells=(p + q) * (a + b), few=few)[""]
    left, right = flat[: p * (a + b)].reshape(p, a + b), flat[p * (a + b) :].reshape(q, a + b)
    return left[:, :a], right[:, :a], left[:, a:], right[:, a:]


class _Side:
    """A basis of one side of a CCA with its images: by its own products, and on the other side."""

    def __init__(self, width: int, other: int):
        import numpy as np

        self.basis, self.own, self.cross = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((other, 0))

    def add(self, block, own, cross) -> None:
        import numpy as np

        self.basis, self.own, self.cross = (np.concatenate(z, 1) for z in ((self.basis, block), (self.own, own), (self.cross, cross)))
        inner = self.basis.T @ self.own
        value, vector = np.linalg.eigh((inner + inner.T) / 2)
        self.most, self.top = max(float(value[-1]), 1e-300), vector[:, -1:]

    def keep(self, best) -> None:
        """Only the span of some combinations."""
        import numpy as np

        q, r = np.linalg.qr(self.basis @ best)
        turn = best @ np.linalg.pinv(r)
        self.basis, self.own, self.cross = q, self.own @ turn, self.cross @ turn


def wide_cca(df: DataFrame, x: str, y: str, reg: float, n_cc: int, tolerance: float = 1e-9, passes: int = 100, seed: int = 0) -> dict:
    """Weights of a regularised linear kernel CCA, as `kernels.cca_solve` has them, for any number of columns.

    With S = X'X / its largest eigenvalue, and T of Y alike, weights solve S C w_y = rho (S^2 + reg) w_x and the same
    with sides changed. They are sought within a basis for each side, of which all products are known; each pass adds
    the directions in which the equations don't hold, until they do. The driver holds the bases, at most CELLS cells a
    side and some directions; beyond that it goes on from the best.
    """
    import numpy as np

    if reg <= 0:
        raise ValueError("the regularisation is positive")
    df = kept(df.select(x, y), "wide-rows")  # written once, as every pass reads it
    few = few_tasks(df)
    rows, mean_x, mean_y = means(df, [x, y])
    rng, sizes = np.random.default_rng(seed), (len(mean_x), len(mean_y))
    n_cc = int(min(n_cc, *sizes, max(1, rows - 1)))
    first = min(n_cc + SPARE, *sizes)
    blocks = [orthonormal(rng.normal(size=(w, first))) for w in sizes]
    rho, out, _ = solve_cca(lambda *new: side_products(df, x, y, mean_x, mean_y, *new, few=few), blocks, reg, n_cc, tolerance, passes, CELLS)
    (wx, own_x, cross_x, size_x), (wy, own_y, cross_y, size_y) = out
    sign = np.sign(wx[np.abs(wx).argmax(0), np.arange(n_cc)])
    size_x, size_y = size_x * sign, size_y * sign
    return {"ws_x": wx * size_x, "ws_y": wy * size_y, "rho": rho, "xx_w": own_x * size_x, "yy_w": own_y * size_y, "xy_w": cross_x * size_y, "yx_w": cross_y * size_x, "means": (mean_x, mean_y), "n": rows}


def solve_cca(images, blocks: list, reg: float, n_cc: int, tolerance: float, passes: int, cells: int, symmetric: bool = False) -> tuple:
    """Correlations, of each side weights, their images, the other side's images and what scales the weights, and the
    largest eigenvalues.

    `images` gives of new directions of both sides S bx, C' bx, C by and T by; `blocks` are the first ones. S and T are taken
    over their largest eigenvalues. A basis has at most `cells` cells. `symmetric`: S C is the transpose of T C', as of
    kernels; correlations of 1e-4 then keep their digits, which their squares would lose.
    """
    import numpy as np

    sides = (_Side(len(blocks[0]), len(blocks[1])), _Side(len(blocks[1]), len(blocks[0])))
    for _ in range(passes):
        xx, yx, xy, yy = images(*blocks)
        sides[0].add(blocks[0], xx, yx)
        sides[1].add(blocks[1], yy, xy)
        a, b = sides
        squares = [(s.own.T @ s.own) / s.most**2 + reg * np.eye(s.own.shape[1]) for s in sides]
        if symmetric:
            low = [np.linalg.cholesky(m) for m in squares]
            u, rho, vt = np.linalg.svd(np.linalg.solve(low[1], np.linalg.solve(low[0], a.own.T @ b.cross / (a.most * b.most)).T).T, full_matrices=False)
            rho = np.maximum(rho[:n_cc], 1e-300)
            mix = [np.linalg.solve(m.T, v[:, :n_cc]) for m, v in zip(low, (u, vt.T), strict=True)]
        else:
            step = [np.linalg.solve(m, s.own.T @ o.cross / (s.most * o.most)) for m, s, o in zip(squares, (a, b), (b, a), strict=True)]
            value, vector = np.linalg.eig(step[0] @ step[1])
            order = np.argsort(-value.real)[:n_cc]
            rho = np.sqrt(np.maximum(value.real[order], 1e-300))
            c = vector[:, order].real
            mix = [c, step[1] @ c / rho]
        blocks, far, out = [], 0.0, []
        for s, o, m, k in ((a, b, mix[0], mix[1]), (b, a, mix[1], mix[0])):
            w, own = s.basis @ m, s.own @ m
            # reg * rho * w = S t is the equation; what of t the basis lacks has no product yet
            t = o.cross @ k / o.most - own / s.most * rho
            known = s.basis.T @ t
            lacking = t - s.basis @ known
            wrong = s.own @ known / s.most - reg * rho * w
            scale = np.linalg.norm(reg * rho * w, axis=0) + 1e-300
            top = s.own @ s.top - s.basis @ s.top * s.most
            far = max(far, float((np.linalg.norm(lacking, axis=0) / scale).max()), float((np.linalg.norm(wrong, axis=0) / scale).max()), float(np.linalg.norm(top)) / s.most)
            extra = [z for z, size in ((lacking, scale), (wrong, scale)) for z in [z[:, np.linalg.norm(z, axis=0) > tolerance * size]] if z.shape[1]]
            extra += [top] * bool(np.linalg.norm(top) > tolerance * s.most)
            blocks.append(orthonormal(np.concatenate(extra, 1), s.basis) if extra else np.zeros((len(w), 0)))
            norm = (w * own).sum(0) / s.most**2 + (w * t).sum(0) / (s.most * rho)
            out.append((w, own, o.cross @ k, 1 / np.sqrt(np.maximum(norm, 1e-300))))
        if far <= tolerance or not (blocks[0].shape[1] or blocks[1].shape[1]):
            break
        for i, (s, m) in enumerate(zip(sides, mix, strict=True)):
            if (s.basis.shape[1] + blocks[i].shape[1]) * len(s.basis) > cells and s.basis.shape[1] > 6 * (n_cc + 1):
                s.keep(np.concatenate([m, s.top], 1))
                blocks[i] = orthonormal(blocks[i], s.basis)
    else:
        raise ValueError(f"the weights aren't found within {passes} passes")
    return rho, out, [s.most for s in sides]


def residualize_arrays(df: DataFrame, column: str, covariates: list[str], name: str = "residuals") -> DataFrame:
    """`name`: the standardised array less its least-squares fit by the standardised covariates and an intercept.

    Rows with a null covariate have null residuals and don't count; a constant column has zeros. Three passes: moments,
    products of covariates and columns, and the residuals, whose coefficients go to the tasks as one matrix.
    """
    import numpy as np
    from pyspark.sql.types import ArrayType, DoubleType

    bounded_batches(df)
    known = df.withColumn("_c", F.array(*(F.col(c).cast("double") for c in covariates)))
    complete = known.dropna(subset=[*covariates, column])
    n, mean, mean_c = means(complete, [column, "_c"])
    squares = lambda v, c: np.concatenate([((v - mean) ** 2).sum(0), ((c - mean_c) ** 2).sum(0)])
    sd = np.sqrt(sum_over_rows(complete, [column, "_c"], squares)[""] / n)
    up = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    up_v, up_c = up[: len(mean)], up[len(mean) :]

    def products(v, c):
        c = (c - mean_c) * up_c
        return np.concatenate([(c.T @ c).ravel(), (c.T @ ((v - mean) * up_v)).ravel()])

    flat, k = sum_over_rows(complete, [column, "_c"], products)[""], len(covariates)
    beta = np.linalg.lstsq(flat[: k * k].reshape(k, k), flat[k * k :].reshape(k, -1), rcond=None)[0]

    @F.pandas_udf(ArrayType(DoubleType()))
    def left_over(v: pd.Series, c: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        some = np.flatnonzero([a is not None and b is not None and not np.isnan(np.asarray(b, float)).any() for a, b in zip(v, c, strict=True)])
        if len(some):
            a, b = (np.stack(s.iloc[some].to_numpy()).astype(float) for s in (v, c))
            rest = (np.nan_to_num(a, posinf=0, neginf=0) - mean) * up_v - (b - mean_c) * up_c @ beta
            for i, row in zip(some.tolist(), rest, strict=True):
                out[i] = row
        return out

    return known.withColumn(name, left_over(F.col(column), F.col("_c"))).drop("_c")
