"""Cross-tokenizer alignment beside a plain one of whole texts, its minimal perfect hash, and odd texts."""

import collections
import hashlib
import random

import numpy as np
import pytest

from panelforge.llm import alignment
from panelforge.llm.common import table
from panelforge.llm.tokens import public_tokenizer

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizer("piece_bpe_32k.model"))


def spelled(libraries, text):
    """Ids with their bytes of both tokenizers, of the whole text."""
    a, b = libraries
    letters = alignment.byte_of_letter()
    ids_a = a.encode(" " + text, add_special_tokens=False)
    first = [(i, bytes(letters[c] for c in t)) for i, t in zip(ids_a.ids, ids_a.tokens, strict=True)]
    second = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return first, second


def groups_of(libraries, text):
    if not text:
        return []
    first, second = spelled(libraries, text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in first) != whole or b"".join(x for _, x in second) != whole:
        return []
    cuts = []
    for ids in (first, second):
        at, ends = 0, {}
        for k, (_, x) in enumerate(ids):
            at += len(x)
            ends[at] = k + 1
        cuts.append(ends)
    out, i, j = [], 0, 0
    for end in sorted(set(cuts[0]) & set(cuts[1])):
        out.append(([x for x, _ in first[i : cuts[0][end]]], [x for x, _ in second[j : cuts[1][end]]]))
        i, j = cuts[0][end], cuts[1][end]
    return out


def brute(libraries, rows):
    aligned = [(i, groups_of(libraries, text)) for i, text in rows]
    counts = collections.Counter((g[0][-1], g[1][-1]) for _, gs in aligned for g in gs)
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, gs in aligned:
        links = [(g[0][-1], g[1][-1]) for g in gs]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((i, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), best, sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def odd_texts():
    rng = random.Random(3)
    parts = ["word", " ", "  ", "\n", "\n\n", "\r\n", "\t", ".", ",", "'s", "é", "ß", "日本", "😀", " ", "　", "▁", "1", "23", "<s>", "<|endoftext|>", "<0x0A>", "\x00", "é", "Straße", "x" * 30, "()", ";\r", "\x0b", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(400)] + [" ", "\n", " a", "a ", "▁", "a\n", "\nfoo", " \n foo  bar\n\n"]


def test_as_whole_texts(spark, libraries, make, messy, empty):
    made = make([(i, t, "en", "a") for i, t in enumerate(odd_texts())])
    for df in (made, messy, empty):
        assert rows(alignment.align_documents(df)) == brute(libraries, df.select("doc_id", "text").collect())


def test_documents_in_several_rounds(spark, libraries):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = brute(libraries, docs.select("doc_id", "text").collect())
    assert rows(alignment.align_documents(docs)) == want
    out = alignment.align(docs, most_pairs=700, shard_pairs=300, with_groups=True)
    assert rows(out) == want
    one = out.filter("n_groups > 0").select("text", "groups").first()
    assert one["groups"] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups_of(libraries, one["text"]))
    assert out.columns[: len(docs.columns)] == docs.columns


def test_memory_is_bounded(spark, libraries, make, monkeypatch):
    """Pieces beyond the memory are learned again, and counted all the same."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "KNOWN", 50)
    found = alignment.Aligner(public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))
    for k in range(5):
        texts = pa.array([f"some words {k * 30 + i} again▁ " for i in range(30)] + [f"some words {k * 30 + i} again\n more" for i in range(30)])
        numbers, ends = found.pieces(texts)
        got = np.diff(np.concatenate([[0], np.cumsum(found.n_groups[numbers])])[ends]) * found.whole(numbers, ends)
        assert got.tolist() == [len(groups_of(libraries, t)) for t in texts.to_pylist()]
    found.keep(50)
    assert len(found.known) == len(found.sound) == 50 and len(found.keys) == found.n_groups.sum()
    docs = [(i, t) for i, t in enumerate(odd_texts()[:60])]
    counted = collections.Counter()
    monkeypatch.setattr(alignment, "SLICE", 400)

    class Frame:  # the function that tasks run, here, with the small memory
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):  # noqa: N802
            for batch in f(iter([pa.record_batch([pa.array([t for _, t in docs])], names=["text"])])):
                counted.update(dict(zip(batch["key"].to_pylist(), batch["n"].to_pylist(), strict=True)))

    frame = Frame()
    frame.sparkSession = spark
    alignment.count_pairs(frame, public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))
    assert counted == collections.Counter((g[0][-1] << 32) + g[1][-1] for _, t in docs for g in groups_of(libraries, t))


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 50_000, 20_000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 32_000, 20_000).astype(np.uint64))
    shard = (keys & np.uint64(0xFFFFFFFF)) % np.uint64(5)
    parts = [(s, *alignment.hash_levels(keys[shard == s])) for s in (0, 1, 3, 4)]
    made = alignment.PairTable(5, parts)
    here = shard != 2
    at = made.numbers(keys)
    assert sorted(at[here].tolist()) == list(range(here.sum())) and (at[~here] == -1).all()
    assert (made.keys[at[here]] == keys[here]).all()
    assert 64 * len(made.bits) < 6 * here.sum()
    assert made.numbers(keys[here] + (np.uint64(1) << np.uint64(40))).max() == -1  # unknown keys are verified
    with pytest.raises(ValueError, match="distinct"):
        alignment.hash_levels(np.array([7, 7], np.uint64))
