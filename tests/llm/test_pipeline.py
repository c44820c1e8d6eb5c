"""The pipeline's stages on their own input, and all of them."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from panelforge.llm import mixing
from panelforge.llm.common import table

DATA = "/root/testdata/sf0.001"


def words(k, n):
    return " ".join(f"word{k}x{j}" for j in range(n))


def test_stages_keep_clean_documents(spark, make):
    docs = make([(i, words(i, 60), "en", f"s{i % 3}") for i in range(12)] + [(50, words(3, 60), "en", "s0"), (60, "1 2 3", "en", "s0"), (61, None, None, None)])
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(12), 50] and kept.columns == docs.columns
    lines = corpus_pipeline.dedup_lines(spark, docs, "")
    assert lines.count() == docs.count() and lines.columns == docs.columns
    near = corpus_pipeline.dedup_near(spark, docs, "")
    assert sorted(r["doc_id"] for r in near.collect()) == [*range(12), 60, 61] and near.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mixture_report(docs).collect() if r["size"]}
    assert collections.Counter(r["doc_id"] for r in mixed.collect() if r["text"]) == {i: n for i, n in taken.items() if n}


def test_repeated_lines_go(spark, make):
    passage = "\n".join(f"line {k} of a passage" for k in range(4))
    docs = make([(1, f"{passage}\nown words here", "en", "a"), (2, f"other start\n{passage}\nother end", "en", "a"), (3, passage, "en", "a"), (4, "", "en", "a"), (5, None, "en", "a")])
    rows = {r["doc_id"]: r for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert {i: r["text"] for i, r in rows.items()} == {1: f"{passage}\nown words here", 2: "other start\nother end", 4: "", 5: None}
    assert rows[2]["n_chars"] == len(rows[2]["text"])


def test_stages_of_odd_tables(spark, make):
    long = "\n".join(words(k, 40) for k in range(4000))
    rows = [(1, long, "en", "a"), (1, long, "en", "a"), (2, words(2, 50), "en", None), (3, "", "en", "a"), (None, None, None, None), (None, words(2, 50), "de", "b")]
    docs = make(rows)
    clashing = {c: f"kept {c}" for c in ("a.b", "lines_", "removed_", "language_", "language_score_", "row_", "times_", "found_")}
    odd = docs.drop("n_chars").withColumns({f"{c}": F.lit(v) for c, v in clashing.items()})
    for table_ in (odd, odd.limit(0), docs.limit(0)):
        n = table_.count()
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, table_, "")
            assert out.columns == table_.columns, name
            got = out.collect()
            assert len(got) <= 3 * n
            if "a.b" in table_.columns:
                assert all(r[c] == v for r in got for c, v in clashing.items()), name
        assert (corpus_pipeline.pack(spark, table_, "").count() > 0) == (n > 0)
    near = [r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, "").collect()]
    assert collections.Counter(near) == {1: 1, 2: 1, 3: 1, None: 1}


def test_stages_without_writes_between(spark):
    """A chain of stages, and two interleaved runs, still have all that they read."""
    chains = []
    for _ in range(2):
        docs = table(spark, DATA, "documents")
        for _, step in corpus_pipeline.STAGES[:4]:
            docs = step(spark, docs, DATA)
        chains.append(docs)
    first, second = (collections.Counter(r["doc_id"] for r in c.collect()) for c in chains)
    assert first and first == second


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    ids = {r["doc_id"] for r in table(spark, DATA, "documents").collect()}
    assert rows and {r["doc_id"] for r in rows} <= ids
    packs = {}
    for r in rows:
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in packs.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and sum(n for _, n in parts) <= 4096
