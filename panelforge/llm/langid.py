"""Language ID: a byte convolutional network with filters of several widths, max pooling and softmax, in numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, free_name, id_remainder, quoted

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: The bounded sample of labelled rows: the most frequent labels, documents of each by hash of id, windows of each.
MAX_LABELS, DOCS_PER_LABEL, WINDOWS_PER_DOC = 128, 250, 6
EPOCHS, BATCH, RATE = 8, 32, 0.01
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a category of letters; number signs are none."""
    return bool(text) and any(map(str.isalpha, text))


def to_windows(data: bytes):
    """Whole text as rows of WINDOW bytes, the last filled up with zeros."""
    import numpy as np

    return np.frombuffer(data + bytes(-len(data) % WINDOW), dtype=np.uint8).reshape(-1, WINDOW)


class ByteConvolution:
    """`tables[w]` holds, for each place in a filter of width w and each byte, what it adds to each of the filters."""

    def __init__(self, labels: list[str], tables: dict, bias, dense, offset, left_out: int = 0):
        self.left_out = left_out
        self.labels, self.tables, self.bias, self.dense, self.offset = labels, tables, bias, dense, offset
        self.key = uuid.uuid4().hex

    @classmethod
    def fit(cls, windows, target, labels: list[str], seed: int = 0) -> ByteConvolution:
        """Adam on the cross-entropy; only the place of its maximum moves a filter."""
        import numpy as np

        rng = np.random.default_rng(seed)
        shapes = [(w, 256, FILTERS) for w in WIDTHS] + [(len(WIDTHS), FILTERS), (len(WIDTHS) * FILTERS, len(labels)), (len(labels),)]
        weights = [rng.normal(0, 0.3 if len(s) == 3 else 0.2, s).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for s in shapes]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
                x, n = windows[rows].astype(np.int64), len(rows)
                pooled, peaks = [], []
                for k, w in enumerate(WIDTHS):
                    out = sum(weights[k][j][x[:, j : WINDOW - w + 1 + j]] for j in range(w)) + weights[-3][k]
                    peaks.append(out.argmax(1))
                    pooled.append(np.take_along_axis(out, peaks[-1][:, None], 1)[:, 0])
                h = np.maximum(np.concatenate(pooled, 1), 0)
                z = h @ weights[-2] + weights[-1]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), target[rows]] -= 1
                p /= n
                back = (p @ weights[-2].T) * (h > 0)
                grads = [np.zeros_like(w) for w in weights]
                grads[-2], grads[-1] = h.T @ p, p.sum(0)
                for k, w in enumerate(WIDTHS):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    grads[-3][k] = g.sum(0)
                    for j in range(w):
                        np.add.at(grads[k][j], (np.take_along_axis(x, peaks[k] + j, 1), np.arange(FILTERS)[None]), g)
                step += 1
                for w, g, a, b in zip(weights, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return cls(labels, dict(zip(WIDTHS, weights, strict=False)), weights[-3], weights[-2], weights[-1])

    def prepare(self):
        """Tables by pairs of bytes, so that a filter of width w takes (w + 1) // 2 lookups."""
        pair = lambda t: (t[0][:, None] + t[1][None]).reshape(65536, FILTERS)
        self.pairs = {w: [(j, pair(t[j : j + 2]) if j + 1 < w else t[j]) for j in range(0, w, 2)] for w, t in self.tables.items()}
        return self

    def window_probabilities(self, windows):
        """Softmax of each window, some windows at a time."""
        import numpy as np

        out = np.empty((len(windows), len(self.labels)), np.float32)
        for at in range(0, len(windows), 64):
            x = windows[at : at + 64].astype(np.intp)
            two = x[:, :-1] * 256 + x[:, 1:]
            pooled = []
            for k, w in enumerate(WIDTHS):
                end, total = WINDOW - w + 1, 0
                for j, t in self.pairs[w]:
                    total = total + t.take((two if j + 1 < w else x)[:, j : j + end], axis=0)
                pooled.append(total.max(1) + self.bias[k])
            z = np.maximum(np.concatenate(pooled, 1), 0) @ self.dense + self.offset
            p = np.exp(z - z.max(1, keepdims=True))
            out[at : at + 64] = p / p.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The label with the largest mean probability over all windows of a text, and that mean.

        A null text, or one without a letter, is `und` with score 0; so is any text if there are no labels.
        """
        import numpy as np

        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if has_letter(t)] if self.labels else []
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            data = [texts[i].encode("utf-8", "replace") for i in part]
            counts = [-(-len(b) // WINDOW) for b in data]
            windows = np.concatenate([to_windows(b) for b in data])
            begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
            mean = np.add.reduceat(self.window_probabilities(windows).astype(np.float64), begin) / np.array(counts)[:, None]
            best = mean.argmax(1)
            for i, b, m in zip(part, best, mean, strict=True):
                labels[i], scores[i] = self.labels[b], float(min(1.0, max(0.0, m[b])))
        return labels, scores


def held_out(id_col: str = "doc_id"):
    return id_remainder(id_col, 4) == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_labels: int | None = MAX_LABELS, docs_per_label: int = DOCS_PER_LABEL, windows_per_doc: int = WINDOWS_PER_DOC) -> ByteConvolution:
    """Fit the network on a bounded sample of the labelled rows that aren't held out.

    The sample: of the `max_labels` most frequent labels (None: all), `docs_per_label` documents each, by md5 of their
    id; of each, `windows_per_doc` windows at most, evenly spaced over the text. Its windows, at most as many as those
    three multiply to, are what the driver gets. Labels beyond the most frequent can't be predicted; the model's
    `left_out` is their number. Rows with a null label, text or id don't count; of the rows of one id and label one counts.
    """
    import numpy as np
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    named = named.filter(F.col("label").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    counted = named.groupBy("label").agg(F.count("*").alias("n"))
    wanted = counted if max_labels is None else counted.orderBy(F.desc("n"), "label").limit(max_labels)
    wanted = [r["label"] for r in wanted.select("label").collect()]
    left_out = counted.count() - len(wanted)
    labels = docs.sparkSession.createDataFrame(pa.table({"label": pa.array(wanted, pa.string())}))
    by_hash = Window.partitionBy("label").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    chosen = named.select("doc_id", "label").join(F.broadcast(labels), "label").withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= docs_per_label).select("doc_id", "label").distinct()
    # at most so many ids, and for each one text
    sample = named.join(F.broadcast(chosen), ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            names, windows = [], []
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if has_letter(text):
                    all_windows = to_windows(text.encode("utf-8", "replace"))
                    for i in np.unique(np.linspace(0, len(all_windows) - 1, windows_per_doc).round().astype(int)):
                        names.append(label)
                        windows.append(all_windows[i].tobytes())
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(windows, pa.binary())], names=["label", "data"])

    rows = sorted((r["label"], bytes(r["data"])) for r in sample.mapInArrow(cut, "label string, data binary").collect())
    found = sorted({r[0] for r in rows})
    if not found:
        return ByteConvolution([], {}, None, None, None, left_out)
    windows = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    target = np.array([found.index(r[0]) for r in rows])
    model = ByteConvolution.fit(windows, target, found)
    model.left_out = left_out
    return model


_prepared: dict = {}


def identify(docs: DataFrame, model: ByteConvolution, text_col: str = "text", label_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with a predicted label and its score, from the whole text alone; see ByteConvolution.predict.

    Columns of `docs` with the names of the two are replaced. Scale: a projection; the model, some hundred kB, goes
    with the task, and texts go through the network 256 at a time, 64 windows at a time.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("label string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if model.key not in _prepared:
            _prepared.clear()
            _prepared[model.key] = model.prepare() if model.labels else model
        for texts in batches:
            labels, scores = _prepared[model.key].predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"label": labels, "score": scores})

    keep = [quoted(c) for c in docs.columns if c.lower() not in (label_col.lower(), score_col.lower())]
    found = free_name(docs, "found_")
    out = docs.select(*keep, predict(F.col(text_col).cast("string")).alias(found))
    return out.select(*keep, F.col(f"{found}.label").alias(label_col), F.col(f"{found}.score").alias(score_col))


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of `docs`, by a model trained on those not held out."""
    model = train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return identify(rows, model).drop("text")
