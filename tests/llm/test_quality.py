"""The quality classifier: its risk, the estimated prior, held-out accuracy, and odd rows."""

import zlib

import numpy as np
import pytest

from panelforge.llm import quality
from panelforge.llm.common import table


def auc(label, score):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    return (order[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def planted(prior, n=3000, wide=12, seed=0):
    """Positives, and unlabelled rows of which a share `prior` is like them."""
    rng = np.random.default_rng(seed)
    good = lambda k: rng.normal(0, 1, (k, wide)).astype(np.float32)
    label = (rng.random(n) < prior).astype(int)
    rows = good(n)
    rows[label == 0, :3] += 4
    return good(n // 2), rows, label


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_and_fit_on_planted_rows(prior):
    p, u, label = planted(prior)
    rng = np.random.default_rng(1)
    found = quality.estimate_prior(p, u, rng.random(len(p)) < 0.5, rng.random(len(u)) < 0.5)
    assert abs(found - prior) < 0.06
    score = quality.Network.fit(p, u, prior).scores(u)
    assert auc(label, score) > 0.97
    assert ((score >= 0.5) == label).mean() > 0.9
    assert abs(score.mean() - prior) < 0.08


def test_risk_stays_non_negative():
    """With far too large a prior the second part of the risk would fall below zero without its guard."""
    p, u, _ = planted(0.5, n=600)
    made = quality.Network.fit(p, u, 0.9)
    loss = lambda x: np.logaddexp(0, made.logits(x)).mean()
    assert loss(u) - 0.9 * loss(p) > -0.1


def test_features_of_whole_texts():
    import collections

    text = "Some wörds, and MORE words!\nand 12 lines\n" * 50_000
    data = text.encode()
    assert len(data) > 2 * quality.PART
    kind = quality.kinds_of_bytes()
    pairs = collections.Counter(zip(kind[list(data[:-1])].tolist(), kind[list(data[1:])].tolist(), strict=True))
    got = quality.features(text)
    want = np.zeros(quality.KINDS**2)
    for (a, b), n in pairs.items():
        want[a * quality.KINDS + b] = np.sqrt(n / (len(data) - 1))
    assert np.allclose(got[: quality.KINDS**2], want, atol=1e-6)
    assert np.isfinite(got).all() and len(got) == quality.WIDTH
    assert not quality.features(None).any() and not quality.features("").any()
    assert np.isfinite(quality.features("a")).all() and np.isfinite(quality.features("\n")).all()


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    out = quality.score_documents(docs, labels)
    rows = out.join(labels, "doc_id", "left").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    label, score = (np.array([r[c] for r in held]) for c in ("quality", "score"))
    assert auc(label, score) > 0.9
    assert ((score >= 0.3) == label).mean() >= max(label.mean(), 1 - label.mean())


def test_labels_of_held_out_rows_do_not_count(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    first, second = ({r["doc_id"]: r["score"] for r in quality.score_documents(docs, x).collect()} for x in (labels, flipped))
    assert first == second


def test_odd_rows(spark, messy, empty):
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, extra string")
    some = label([(1, 1, "a"), (1, 1, "b"), (2, 1, "a"), (2, 0, "a"), (None, 1, None), (4, None, None), (6, 1, "a"), (99, 1, "not there")])
    out = quality.score_documents(messy, some)
    got = out.collect()
    assert len(got) == messy.count() and out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1
    assert {r["score"] for r in quality.score_documents(messy, label([(1, 0, "a")])).collect()} == {0.5}
    assert quality.score_documents(empty, some).collect() == []
