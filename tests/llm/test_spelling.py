"""Spelling variants beside brute force, with odd words, large buckets, ties and chains."""

import random
import zlib

import pytest

from panelforge.llm import spelling

LETTERS = "abcéÿ"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(counts, times=5):
    out, form = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
        out[w] = len(near)

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, out[w], counts.get(form[w])) for w, n in counts.items()}


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    made = {"".join(rng.choice(LETTERS) for _ in range(rng.choice([1, 2, 3, 6, 7, 7, 8, 9]))) for _ in range(700)}
    long = "ab" * 3000
    made |= {long, long + "a", "c" + long, long[:2000] + "c" + long[2000:], long[:4000] + "é" + long[4001:]}
    made |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaaa", "aaaabaaa"}
    return {w: rng.choice([5, 5, 6, 30, 40, 200, 2000]) for w in sorted(made)}


def test_kernel_as_brute_force(words):
    names = sorted(words)
    a, b = spelling.pairs_within(names)
    got = [(names[i], names[j]) for i, j in zip(a, b, strict=True)]
    assert len(got) == len(set(got))
    assert set(got) == {(x, y) for x in names for y in names if len(x) <= len(y) and one_edit(x, y)}
    assert spelling.pairs_within([])[0].size == spelling.pairs_within(["lonely"])[0].size == 0


@pytest.mark.parametrize("bucket", [2048, 3])
def test_variants_as_brute_force(spark, words, bucket):
    """Also where nearly all buckets are dealt anew, down to single letters."""
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r) for r in spelling.group_variants(df, bucket=bucket).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(words) and set(got) == brute(words)


def test_chain_of_forms_and_ties(spark):
    counts = {"abcdef": 5, "abcdeg": 25, "abcdeh": 25, "abcdefg": 125, "abcdefgh": 700, "abcdefghi": 9999, "zzzzzz": 5}
    got = {r[0]: r for r in rows(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))}
    assert set(got.values()) == brute(counts)
    assert got["abcdef"][1:3] == ("abcdefg", "abcdefghi") and got["zzzzzz"][1:3] == (None, "zzzzzz")


def counted(docs):
    import re

    out = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= 6:
                out[word] = out.get(word, 0) + 1
    return {w: n for w, n in out.items() if n >= 5}


def test_counts_as_brute_force(spark, make, messy, empty):
    made = make([(i, "Straße ÀÉÏÕÜ Größere größere GRÖSSERE naïveté×÷ abc_defghi wörter " * (i % 4), "de", "a") for i in range(400)])
    for df in (made, messy, empty):
        got = {r["word"]: r["n"] for r in spelling.count_words(df).collect()}
        assert got == counted(df.select("doc_id", "text").collect())
    assert rows(spelling.spelling_variants(empty)) == []
    assert {r[0] for r in rows(spelling.spelling_variants(messy))} == set(counted(messy.select("doc_id", "text").collect()))
