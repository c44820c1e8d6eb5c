"""Quality scores by positive-unlabelled learning: a network fitted by the non-negative unbiased risk.

Trusted positives are documents that are labelled good; all others are unlabelled, whatever their label. The share of
good documents among the unlabelled is estimated first, from the scores of a plain positive-against-unlabelled fit.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, crc32_remainder, id_remainder, quoted

#: The bounded sample: trusted positives and unlabelled documents, by hash of id.
POSITIVES, UNLABELLED = 3000, 6000
#: Kinds of bytes whose pairs are counted, and buckets of hashed runs of three bytes.
KINDS, HASHED = 40, 1024
HIDDEN, BATCH, RATE = 24, 256, 0.003
#: Passes and weight decay of the network, and of those that the prior is estimated by; these are fitted so many times.
EPOCHS, DECAY, PLAIN_EPOCHS, PLAIN_DECAY, SEEDS = 60, 1e-5, 30, 1e-4, 2
#: Bytes of a text that are counted at once.
PART = 1 << 20
THRESHOLD = 0.3


def kinds_of_bytes():
    """White space, line feeds, letters, digits, bytes beyond ASCII, each punctuation mark by itself, the rest."""
    import numpy as np

    kind = np.zeros(256, np.int64)
    kind[[9, 11, 12, 13, 32]], kind[10] = 1, 2
    kind[0x61:0x7B], kind[0x41:0x5B], kind[0x30:0x3A] = 3, 4, 5
    kind[0x80:0xC0], kind[0xC0:] = 6, 7
    marks = [b for b in range(0x21, 0x7F) if kind[b] == 0]
    kind[marks] = 8 + np.arange(len(marks))
    return kind


#: Numbers of repeats and sizes.
REPEATS = 7
WIDTH = KINDS * KINDS + HASHED + REPEATS


def features(text: str | None):
    """Numbers of a whole text: roots of the shares of pairs of kinds and of hashed runs of three bytes, and how much it
    repeats. A null text is an empty one, which has zeros."""
    import numpy as np

    out = np.zeros(WIDTH, np.float32)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    pairs, runs, packed, pack = np.zeros(KINDS * KINDS), np.zeros(HASHED), 0, zlib.compressobj(1)
    for at in range(0, len(data), PART):
        x = np.frombuffer(data[at : at + PART + 2], np.uint8)
        own = x[: PART + 1]
        kind = _kinds()[own]
        pairs += np.bincount(kind[:-1] * KINDS + kind[1:], minlength=len(pairs))
        y = x.astype(np.uint32)
        runs += np.bincount(((y[:-2] * 0x9E3779B1 + y[1:-1] * 0x85EBCA6B + y[2:] * 0xC2B2AE35) >> np.uint32(20)) % HASHED, minlength=HASHED)
        packed += len(pack.compress(data[at : at + PART]))
    packed += len(pack.flush())
    words, lines = text.split(), text.split("\n")
    out[: KINDS * KINDS] = np.sqrt(pairs / max(1, pairs.sum()))
    out[KINDS * KINDS : -REPEATS] = np.sqrt(runs / max(1, runs.sum()))
    size = np.log1p(len(data))
    again = sum(map(str.__eq__, words, words[1:])) / max(1, len(words) - 1)
    out[-REPEATS:] = (again, size / 10, packed / (len(data) + 20), len(set(words)) / max(1, len(words)) * size / 10, len(set(lines)) / len(lines), min(2, len(text) / max(1, len(words)) / 10), min(2, len(text) / len(lines) / 200))
    return out


_kept: dict = {}


def _kinds():
    if "kinds" not in _kept:
        _kept["kinds"] = kinds_of_bytes()
    return _kept["kinds"]


class Network:
    """One hidden layer on scaled features; its output's logistic is the probability of a good document."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights, self.key = mean, scale, weights, uuid.uuid4().hex

    def logits(self, x):
        import numpy as np

        w, b, v, c = self.weights
        return np.maximum((x - self.mean) * self.scale @ w + b, 0) @ v + c

    def scores(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64), -30, 30)))

    @classmethod
    def fit(cls, positive, unlabelled, prior: float | None, seed: int = 0) -> Network:
        """Adam on the non-negative risk with the logistic loss; without `prior`, on positive against unlabelled.

        The risk is prior * R(positives as good) + max(0, R(unlabelled as bad) - prior * R(positives as bad)). Where the
        second part is negative, which no true risk is, the step goes up on it instead: the network has begun to take
        the positives of the unlabelled for bad ones.
        """
        import numpy as np

        rng = np.random.default_rng(seed)
        n = len(positive) + len(unlabelled)
        mean = ((positive.sum(0, dtype=np.float64) + unlabelled.sum(0, dtype=np.float64)) / n).astype(np.float32)
        p, u = positive.astype(np.float32) - mean, unlabelled.astype(np.float32) - mean
        sd = np.sqrt((np.einsum("ij,ij->j", p, p) + np.einsum("ij,ij->j", u, u)) / n)
        scale = (1 / (sd + 0.05 * max(float(sd.max()), 1e-9))).astype(np.float32)
        p *= scale
        u *= scale
        size, epochs, decay = p.shape[1], *((EPOCHS, DECAY) if prior is not None else (PLAIN_EPOCHS, PLAIN_DECAY))
        weights = [rng.normal(0, 1 / np.sqrt(size), (size, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32), np.zeros((), np.float32)]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for _ in range(epochs):
            steps = max(1, len(u) // BATCH)
            parts_p = np.array_split(rng.permutation(max(len(p), steps)) % len(p), steps)
            for rows_p, rows_u in zip(parts_p, np.array_split(rng.permutation(len(u)), steps), strict=True):
                x = np.concatenate([p[rows_p], u[rows_u]])
                n_p, n_u = len(rows_p), len(rows_u)
                inner = x @ weights[0] + weights[1]
                h = np.maximum(inner, 0)
                z = h @ weights[2] + weights[3]
                prob = logistic(z)
                # gradients of softplus(-z), "as good", and softplus(z), "as bad"
                if prior is None:
                    g = np.concatenate([(prob[:n_p] - 1) / n_p, prob[n_p:] / n_u])
                else:
                    bad = np.logaddexp(0, z[n_p:]).mean() - prior * np.logaddexp(0, z[:n_p]).mean()
                    as_bad = np.concatenate([-prior * prob[:n_p] / n_p, prob[n_p:] / n_u])
                    g = np.concatenate([prior * (prob[:n_p] - 1) / n_p, np.zeros(n_u)]) + as_bad if bad >= 0 else -as_bad
                g = g.astype(np.float32)
                back = np.outer(g, weights[2]) * (inner > 0)
                grads = [x.T @ back + decay * weights[0], back.sum(0), h.T @ g, np.asarray(g.sum(), np.float32)]
                step += 1
                for k, d in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d * d
                    weights[k] = (weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return cls(mean, scale, weights)


def estimate_prior(positive, unlabelled, half_p, half_u, seed: int = 0, risk: float = 0.1) -> float:
    """The share of good documents among the unlabelled: the least ratio of the shares of both above a score.

    Above any score, the unlabelled hold at least the share of positives times their own share. Scores of either half
    come from a network that was fitted on the other; a document that is in both lists has to be in the same half of
    both. Of all scores, that with the least upper bound counts; the estimate is the mean of the halves
    and seeds.
    """
    import numpy as np

    found = []
    for flip, k in itertools.product((False, True), range(SEEDS)):
        fit_p, fit_u = half_p != flip, half_u != flip
        if not fit_p.any() or not fit_u.any() or fit_p.all() or fit_u.all():
            continue
        made = Network.fit(positive[fit_p], unlabelled[fit_u], None, seed + k)
        p, u = np.sort(made.logits(positive[~fit_p])), np.sort(made.logits(unlabelled[~fit_u]))
        cuts = np.unique(np.concatenate([p, u]))
        above_p, above_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (p, u))
        error = sum(np.sqrt(np.log(4 / risk) / (2 * len(x))) for x in (p, u))
        above_p, above_u = above_p[above_p > 0], above_u[above_p > 0]
        best = int(((above_u + error) / above_p).argmin())
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), 0.02, 0.98)) if found else 0.5


class QualityModel:
    """The network and the estimated prior; without positives or unlabelled there is no network, and all score 0.5."""

    def __init__(self, network: Network | None, prior: float):
        self.network, self.prior = network, prior

    def predict(self, texts: list[str | None]):
        import numpy as np

        if self.network is None or not texts:
            return np.full(len(texts), 0.5)
        parts = [self.network.scores(np.stack([features(t) for t in texts[at : at + 256]])) for at in range(0, len(texts), 256)]
        return np.concatenate(parts)


def held_out(id_col: str = "doc_id"):
    return id_remainder(id_col, 5) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 0) -> QualityModel:
    """Fit the network on documents that aren't held out: `labels` has the ids of both and a label, 1 for good.

    The bounded sample: at most `positives` ids whose labels are all 1, and `unlabelled` ids of any documents, by hash of
    id. Of the rows of an id one counts. Rows without id don't; a null label is none. What the driver gets is the
    sample's features, some 5 kB a document.
    """
    import numpy as np

    bounded_batches(docs.sparkSession)
    order = F.xxhash64("id", F.lit(seed))
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull() & ~held_out("id"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id"))
    good = known.groupBy("id").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least = 1 AND most = 1").select("id")
    good = good.orderBy(order, "id").limit(positives).withColumn("positive", F.lit(True))
    rest = named.select("id").orderBy(order, "id").limit(2 * unlabelled).distinct().orderBy(order, "id").limit(unlabelled).withColumn("positive", F.lit(False))
    # at most so many ids
    chosen = named.join(F.broadcast(good.unionByName(rest)), "id").groupBy("id", "positive").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            found = [features(t).astype(np.float16).tobytes() for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["id"], batch["positive"], pa.array(found, pa.binary())], names=["id", "positive", "data"])

    # halves by id, so that an id is in the same half of both
    got = chosen.select("id", "positive", "text").mapInArrow(measure, "id long, positive boolean, data binary").toArrow().sort_by([("positive", "ascending"), ("id", "ascending")])
    data = [np.frombuffer(x.as_buffer(), np.float16) for chunk in got["data"].chunks for x in chunk]
    halves = np.array(crc32_remainder(got["id"].to_pylist(), 2), bool)
    flags = np.array(got["positive"].to_pylist(), bool)
    if flags.all() or not flags.any():
        return QualityModel(None, 0.5)
    p, u = (np.stack([x for x, f in zip(data, flags, strict=True) if f == which]) for which in (True, False))
    del data, got
    prior = estimate_prior(p, u, halves[flags], halves[~flags], seed)
    return QualityModel(Network.fit(p, u, prior, seed), prior)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the score of each whole text, from 0 to 1, from the text alone; a null text scores as an empty one.

    A column of that name is replaced. Scale: a projection; the network, some hundred kB, goes with the task.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.predict([t if isinstance(t, str) else None for t in texts]), dtype=float)

    keep = [quoted(c) for c in docs.columns if c.lower() != score_col.lower()]
    return docs.select(*keep, predict(F.col(text_col).cast("string")).alias(score_col))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`, by a model of those not held out."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return score(rows, model).drop("text").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
