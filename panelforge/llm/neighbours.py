"""Approximate nearest neighbours: a balanced partition of a neighbour graph, learned by a small classifier that routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import staged

#: The bounded sample that the partition is learned from, its graph, the partitions, and the share of a query's
#: neighbours that its most probable partitions should hold, by the part of the sample kept back (one row in five).
SAMPLE, NEIGHBOURS, PARTITIONS, RECALL = 6000, 10, 16, 0.95
HIDDEN, EPOCHS, BATCH, RATE = 96, 60, 128, 0.003
#: Vectors, and queries, that one task compares at a time.
BLOCK, QUERY_BLOCK = 4096, 1024


def neighbour_graph(x, k: int = NEIGHBOURS):
    """The k nearest rows of each row, itself left out."""
    import numpy as np

    k, norms, out = min(k, len(x) - 1), (x * x).sum(1), []
    for at in range(0, len(x), 1000):
        d = norms[None] - 2 * x[at : at + 1000] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, 1)[:, :k] if k else np.zeros((len(d), 0), int))
    return np.concatenate(out)


def balanced_partition(x, graph, parts: int):
    """A part for each row: halves again and again, each half cut at the median of the main direction and then improved
    by swapping pairs of rows that have more neighbours on the other side."""
    import numpy as np

    label = np.zeros(len(x), int)
    edges = np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], 1)
    size = 1
    while size < parts:
        for part in range(size):
            rows = np.flatnonzero(label == part)
            if len(rows) < 2:
                continue
            centred = x[rows] - x[rows].mean(0)
            along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
            side = np.zeros(len(x), int)
            side[rows[np.argsort(along, kind="stable")[len(rows) // 2 :]]] = 1
            within = edges[(label[edges[:, 0]] == part) & (label[edges[:, 1]] == part)]
            for _ in range(20):
                other = side[within[:, 0]] != side[within[:, 1]]
                gain = np.zeros(len(x))
                for end in (0, 1):
                    np.add.at(gain, within[:, end], np.where(other, 1, -1))
                zero, one = (rows[side[rows] == s] for s in (0, 1))
                zero, one = (r[np.argsort(-gain[r], kind="stable")] for r in (zero, one))
                n = min(len(zero), len(one))
                swap = int(((gain[zero[:n]] + gain[one[:n]]) > 2).sum()) // 2
                if not swap:
                    break
                side[zero[:swap]], side[one[:swap]] = 1, 0
            label[rows] += side[rows] * size
        size *= 2
    return label


class Router:
    """A network of one hidden layer; it gives the probability of each partition for a vector.

    A query looks into its most probable partitions until those hold the probability `mass`.
    """

    def __init__(self, centre, scale, weights, parts: int):
        self.centre, self.scale, self.weights, self.parts, self.mass = centre, scale, weights, parts, 1.0

    @classmethod
    def fit(cls, x, parts: int = PARTITIONS, recall: float = RECALL, seed: int = 0) -> Router:
        """Learn, for each row, how its own and its neighbours' partitions are spread."""
        import numpy as np

        rng = np.random.default_rng(seed)
        x = np.unique(x, axis=0)
        if len(x) < 4 * parts:
            return cls(np.zeros(x.shape[1]), 1.0, None, 1)
        graph = neighbour_graph(x)
        label = balanced_partition(x, graph, parts)
        target = np.zeros((len(x), parts))
        near = np.concatenate([np.arange(len(x))[:, None], graph], 1)
        for column in near.T:
            target[np.arange(len(x)), label[column]] += 1 / near.shape[1]
        centre, scale = x.mean(0), x.std() or 1.0
        z, kept_back = (x - centre) / scale, np.arange(len(x)) % 5 == 0
        learned = np.flatnonzero(~kept_back)
        shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, parts), (parts,)]
        w = [rng.normal(0, (2 / s[0]) ** 0.5, s) if len(s) > 1 else np.zeros(s) for s in shapes]
        first, second, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(learned), max(1, len(learned) // BATCH)):
                h = np.maximum(z[rows] @ w[0] + w[1], 0)
                p = _softmax(h @ w[2] + w[3])
                back = (p - target[rows]) / len(rows)
                under = (back @ w[2].T) * (h > 0)
                step += 1
                for a, g, m, v in zip(w, (z[rows].T @ under, under.sum(0), h.T @ back, back.sum(0)), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    a -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        router = cls(centre, scale, w, parts)
        chances = router.probabilities(x)
        own, asked = chances.argmax(1), chances[kept_back]
        theirs = np.take_along_axis(asked, own[graph[kept_back]], 1)  # the probability of each neighbour's partition
        before = np.where(asked[:, None] > theirs[:, :, None], asked[:, None], 0).sum(2)
        router.mass = float(np.quantile(before, recall, method="higher"))
        return router

    def looked_into(self, x):
        """The partitions of each vector, most probable first, one after another; and how many each has."""
        import numpy as np

        chances = self.probabilities(x)
        order = np.argsort(-chances, 1, kind="stable")
        ordered = np.take_along_axis(chances, order, 1)
        take = np.cumsum(ordered, 1) - ordered <= self.mass + 1e-9
        return order[take].astype(np.int32), take.sum(1)

    def probabilities(self, x):
        import numpy as np

        if self.parts == 1:
            return np.ones((len(x), 1))
        w = self.weights
        return _softmax(np.maximum((x - self.centre) / self.scale @ w[0] + w[1], 0) @ w[2] + w[3])


def _softmax(z):
    import numpy as np

    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`vec_id, v`: rows with an id and a vector of finite components, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(fine & F.exists("v", lambda c: c != 0))


def sample_vectors(rows: DataFrame, size: int):
    """At most `size` vectors of the commonest length among them, by hash of id; they are what the driver gets."""
    import numpy as np

    share = min(1.0, 2 * size / max(1, rows.count()))
    order = F.xxhash64(F.col("vec_id"), F.lit(7))
    some = rows.select(order.alias("order"), "vec_id", "v").filter(F.pmod("order", F.lit(1 << 20)) <= int(share * (1 << 20)))
    found = [r["v"] for r in some.orderBy("order", "vec_id", "v").limit(size).collect()]
    if not found:
        return np.zeros((0, 1))
    lengths = [len(v) for v in found]
    width = max(set(lengths), key=lambda n: (lengths.count(n), -n))
    return np.array([v for v in found if len(v) == width])


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTITIONS, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """The k nearest rows found for each row that `is_query` (a column of `vec_id`) chooses: query_id, rank, vec_id, score.

    Score is the Euclidean distance in double precision; ties go to the smaller id; a query doesn't find its own id.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id or of
    another length than the sample's commonest. Rows that repeat an id count once in a list, by the nearest; a query id
    that repeats asks once, by its smallest vector. No valid vectors give no rows.

    Scale: the partition is learned from a bounded sample; every row is assigned to its most probable partition, and
    queries go to their most probable ones, up to the probability by which the kept-back rows of the sample find `recall`
    of their neighbours. Partitions are cut into blocks of bounded size by hash of id, so
    that equal vectors, all in one partition, spread over tasks; a task compares one block of vectors with one block of
    queries and returns k rows for each query. Comparisons don't become rows. More rows call for more `parts`.
    """
    rows = valid_vectors(vectors, id_col, vector_col)
    found = sample_vectors(rows, sample)
    width = found.shape[1]
    router = Router.fit(found, parts, recall)

    def route(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch["v"]
            if not len(column):
                continue
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            best, counts = router.looked_into(x)
            data = pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.record_batch([batch["vec_id"], data, pa.ListArray.from_arrays(offsets, pa.array(best))], names=["vec_id", "data", "parts"])

    routed = staged(rows.filter(F.size("v") == width).mapInArrow(route, "vec_id long, data binary, parts array<int>"), "routed")
    base = routed.select("vec_id", "data", F.get("parts", 0).alias("part"))
    queries = routed.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min_by("parts", "data").alias("parts"), F.min("data").alias("data"))
    queries = queries.select("vec_id", "data", F.explode("parts").alias("part"))
    # a row for each partition
    blocks = lambda df, size, name: df.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = staged(blocks(base, BLOCK, "blocks").join(blocks(queries, QUERY_BLOCK, "query_blocks"), "part"), "sizes")
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = base.join(F.broadcast(sizes), "part").withColumn("block", own("blocks")).withColumn("query_block", every("query_blocks")).withColumn("asks", F.lit(False))
    right = queries.join(F.broadcast(sizes), "part").withColumn("query_block", own("query_blocks")).withColumn("block", every("blocks")).withColumn("asks", F.lit(True))
    both = left.unionByName(right).select("part", "block", "query_block", "asks", "vec_id", "data")

    def compare(group):
        import numpy as np
        import pyarrow as pa

        asks = group["asks"].to_numpy()
        ids = group["vec_id"].to_numpy()
        x = np.frombuffer(b"".join(group["data"].to_pylist()), dtype="<f8").reshape(len(ids), -1)
        q, query_ids, v, vec_ids = x[asks], ids[asks], x[~asks], ids[~asks]
        out = ([], [], [])
        for at in range(0, len(q), 16):
            d = np.sqrt(((q[at : at + 16, None] - v[None]) ** 2).sum(-1))
            d[query_ids[at : at + 16, None] == vec_ids[None]] = np.inf
            for row, query_id in zip(d, query_ids[at : at + 16], strict=True):
                near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
                near = near[np.isfinite(row[near])]
                near = near[np.lexsort((vec_ids[near], row[near]))]
                near = near[np.sort(np.unique(vec_ids[near], return_index=True)[1])][:k]
                for column, values in zip(out, (np.full(len(near), query_id), vec_ids[near], row[near]), strict=True):
                    column.append(values)
        none = np.zeros(0, np.int64)
        return pa.table({"query_id": np.concatenate(out[0] or [none]), "vec_id": np.concatenate(out[1] or [none]), "score": np.concatenate(out[2] or [none]).astype(float)})

    near = both.groupBy("part", "block", "query_block").applyInArrow(compare, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
