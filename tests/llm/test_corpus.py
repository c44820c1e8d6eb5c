"""The corpus operators: brute force, exact round trips, held-out accuracy, and odd inputs."""

import collections
import hashlib
import itertools
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.llm import common, exact_dedup, langid, line_dedup, mixing, near_dedup, neighbours, packing, pii, queries, suffix_tree, token_files, tokens
from panelforge.llm.common import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents").persist()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def cells(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((cells(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted((cells(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]}) q").fetchall()), key=repr)
    assert got == want


# near-dedup


def word_sets(rows):
    out = {}
    for i, text in rows:
        w = (text or "").lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def classes(sets, least=0.8):
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both / (len(sets[a]) + len(sets[b]) - both) >= least:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return {i: root(i) for i in sets}


def test_near_duplicates_as_brute_force(docs):
    want = classes(word_sets(docs.select("doc_id", "text").collect()))
    got = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert collections.Counter(r["class_id"] for r in got if r["kept"]) == collections.Counter(set(want.values()))


def test_a_large_group_of_near_copies(make):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(24, rng.integers(0, 3), replace=False):
            w[5 * int(j)] = f"x{i}"
        texts.append((i, " ".join(w), "en", "a"))
    texts += [(1000 + i, " ".join(f"v{i}_{j}" for j in range(60)), "en", "b") for i in range(50)]
    docs = make(texts)
    want = classes(word_sets([(t[0], t[1]) for t in texts]))
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()} == want


def test_near_copies_that_repeat_a_passage(make):
    # plain similarity 0.98; the tenfold passage takes the weighted one to about a half
    texts = []
    for i in range(40):
        passage, rest = [f"p{i}_{j}" for j in range(44)], [f"r{i}_{j}" for j in range(200)]
        texts += [(2 * i, " ".join(passage + rest), "en", "a"), (2 * i + 1, " ".join(passage * 10 + rest), "en", "a")]
    want = classes(word_sets([(t[0], t[1]) for t in texts]))
    assert want == {i: i - i % 2 for i in range(80)}
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(make(texts)).collect()} == want


def test_either_fine_signature_lets_a_pair_pass(spark):
    h, times = np.arange(1, 241, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15), np.ones(240, "<u4")
    times[:40] = 10
    sets = spark.createDataFrame([(0, h.tobytes(), b""), (1, h.tobytes(), times.tobytes())], "row long, hashes binary, times binary")
    bands = spark.createDataFrame([(i, list(range(2 * near_dedup.BANDS))) for i in range(2)], "row long, bands array<long>")
    open_ = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 0)], "band long, row long, part long, largest long")
    assert [tuple(r) for r in near_dedup.compared(open_, bands, sets, 2).collect()] == [(0, 1)]


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**62, 80).astype(np.uint64)
    a, b = (np.sort(h[:60]), np.ones(60, int)), (np.sort(h[15:75]), np.ones(60, int) * 3)
    s = near_dedup.prob_minhash([a, b])
    assert (s[0] == s[1]).mean() == pytest.approx(45 / 75, abs=0.12)
    assert near_dedup.similarities(a[0], a[1], b[0], b[1]) == pytest.approx((0.6, 0.6))
    x, y = np.array([1, 2, 3], np.uint64), np.array([2, 3, 9], np.uint64)
    wx, wy = np.array([1, 2, 5]), np.array([4, 1, 1])
    p, q = {1: 1, 2: 2, 3: 5}, {2: 4, 3: 1, 9: 1}
    brute = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in {*p, *q}) for i in p if i in q)
    assert near_dedup.similarities(x, wx, y, wy)[1] == pytest.approx(brute)


def test_near_duplicates_of_odd_rows(messy, empty):
    got = near_dedup.near_duplicates(messy).collect()
    assert len(got) == messy.count()
    same = [r for r in got if r["class_id"] == 1]
    assert len(same) == 4 and sum(r["kept"] for r in same) == 1
    assert all(r["kept"] for r in got if r["doc_id"] in (3, 4, 5))
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_duplicates(messy).columns == messy.columns


# language ID


def test_languages_of_held_out_documents(docs):
    got = langid.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_rows(messy, empty):
    got = langid.predict_documents(messy).collect()
    assert len(got) == messy.count()
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (3, 4, 5, 9))
    assert langid.predict_documents(empty).count() == 0
    taken = messy.withColumnsRenamed({"source": "a.b", "n_chars": "found_"}) if "n_chars" in messy.columns else messy.withColumn("a.b", F.lit(1)).withColumn("found_", F.lit(2))
    assert langid.identify(taken, langid.ByteConvolution([], {}, None, None, None)).columns == [*taken.columns, "lang_pred", "score"]
    out = langid.identify(messy, langid.ByteConvolution([], {}, None, None, None))
    assert {r["lang_pred"] for r in out.collect()} == {"und"} and out.columns == [*messy.columns, "lang_pred", "score"]


def test_letters_are_no_number_signs():
    assert [langid.has_letter(t) for t in ("\u00bd", "\u00b2", "\u2460", "12 _", "", None, "1a", "\u4e2d", "\u00e9")] == [False] * 6 + [True] * 3


def test_labels_left_out_are_told(make):
    docs = make([(i, f"some words of {x}", x, "a") for i, x in enumerate(["aa"] * 6 + ["bb"] * 5 + ["cc"] * 4)])
    assert langid.train(docs, max_labels=2).labels == ["aa", "bb"] and langid.train(docs, max_labels=2).left_out == 1
    assert langid.train(docs, max_labels=None).labels == ["aa", "bb", "cc"]


def test_windows_as_a_plain_convolution():
    rng = np.random.default_rng(3)
    tables = {w: rng.normal(size=(w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS}
    bias, dense, offset = rng.normal(size=(3, langid.FILTERS)), rng.normal(size=(3 * langid.FILTERS, 2)), rng.normal(size=2)
    model = langid.ByteConvolution(["a", "b"], tables, bias, dense, offset).prepare()
    windows = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    for window, got in zip(windows, model.window_probabilities(windows), strict=True):
        pooled = []
        for k, w in enumerate(langid.WIDTHS):
            for f in range(langid.FILTERS):
                pooled.append(max(0.0, max(sum(tables[w][j, window[i + j], f] for j in range(w)) for i in range(langid.WINDOW - w + 1)) + bias[k][f]))
        z = [sum(p * dense[i, c] for i, p in enumerate(pooled)) + offset[c] for c in range(2)]
        want = 1 / (1 + math.exp(z[1] - z[0]))
        assert got[0] == pytest.approx(want, abs=1e-4)


# mixing


def test_targets_share_again_what_exceeds_a_cap(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # b and c weigh 2 and 3: c stops at 30, so b takes the rest
    assert got == {"a": 3.0, "b": 78.0, "c": 30.0, None: 0.0}


def test_mix_keeps_to_its_budget(docs, messy, empty):
    rows = mixing.mixture_report(docs).collect()
    total = sum(r["size"] for r in rows)
    assert total * 0.97 < sum(r["taken"] for r in rows) <= total
    assert all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in rows)
    again = mixing.mixture_report(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert mixing.mixture_report(messy).count() == messy.count()
    assert mixing.mix(messy).columns == messy.columns
    assert mixing.mixture_report(empty).count() == 0 and mixing.mix(empty).count() == 0
    taken = {r["doc_id"]: r["taken"] for r in rows}
    assert sum(taken[r["doc_id"]] > 0 for r in rows) <= mixing.mix(docs).count()


# neighbours


def test_neighbours_recall(spark):
    e = table(spark, DATA, "embeddings").select("vec_id", "embedding", F.lit(1).alias("part"))
    got = neighbours.nearest(e, lambda i: i % 100 == 0).collect()
    rows = e.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    hits = 0
    for q in (asked := [i for i in ids if i % 100 == 0]):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(d[ids == r["vec_id"]][0], abs=1e-12) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(ids[order].tolist()))
    assert hits >= 0.9 * 10 * len(asked)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [0.0, 1.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, lambda i: i % 100 == 0).collect())
    root = math.sqrt(2)
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 0.0), (0, 4, 9, root), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 0.0), (100, 4, 9, root)]
    assert neighbours.nearest(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_partition_is_balanced():
    x = np.random.default_rng(0).normal(size=(400, 8))
    sizes = np.bincount(neighbours.balanced_partition(x, neighbours.neighbour_graph(x), 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 3


# line dedup


def lines_by_hand(docs):
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            window = tuple(x if x.strip(" \t\n\r\x0b\f") else "" for x in lines[k : k + 3])
            if any(window):
                gone |= {k, k + 1, k + 2} if window in seen else set()
                seen.add(window)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_as_brute_force(docs):
    want = lines_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert got == want and any(got[r["doc_id"]] != r["text"] for r in docs.collect())


def test_line_dedup_of_odd_rows(messy, empty, make):
    got = line_dedup.remove_repeated_lines(messy)
    assert got.columns == [*messy.columns, "n_lines", "n_removed"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[-3]["text"] == "l1\nl2\nl3" and rows[-3]["n_removed"] == 6
    assert rows[3]["text"] is None and rows[3]["n_lines"] == 0 and rows[4]["text"] == ""
    assert line_dedup.remove_repeated_lines(empty).count() == 0
    twice = line_dedup.remove_repeated_lines(make([(1, "a\nb\nc", "en", "s"), (1, "a\nb\nc", "en", "s")])).collect()
    assert sorted(r["text"] for r in twice) == ["", "a\nb\nc"]


# exact dedup


def test_exact_dedup_of_odd_rows(messy, empty):
    rows = exact_dedup.mark_exact_duplicates(messy).collect()
    texts = collections.defaultdict(list)
    for r in messy.collect():
        texts[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in texts.items()}
    assert len(rows) == messy.count()
    for r in rows:
        ids = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
    assert collections.Counter(r["text_sha256"] for r in rows if r["kept"]) == collections.Counter(list(by_hash))
    assert exact_dedup.mark_exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(messy)
    assert kept.columns == messy.columns and kept.count() == len(by_hash)


def test_a_full_filter_loses_nothing(docs):
    want = sorted(map(tuple, exact_dedup.mark_exact_duplicates(docs).drop("row").collect()))
    assert sorted(map(tuple, exact_dedup.mark_exact_duplicates(docs, bits_per_row=1, max_bits=1).drop("row").collect())) == want


# LM scoring


def test_base_scores_and_a_better_model(docs):
    rows = {r["doc_id"]: r for r in suffix_tree.score_documents(docs).collect()}
    split = {r["doc_id"]: [*(x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode())), None] for r in docs.collect()}
    held = {i for i in split if zlib.crc32(str(i).encode()) % 7 == 2}
    count = collections.Counter(x for i, ts in split.items() if i not in held for x in ts)
    n, v = sum(count.values()), len(count)
    for i, ts in split.items():
        r = rows[i]
        assert r["held_out"] == (i in held) and r["n_tokens"] == len(ts) and r["train_tokens"] == n
        assert r["n_known"] == sum(count[x] > 0 for x in ts)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in ts), rel=1e-9)
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)


def test_states_are_distributions(make):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join("abcd"[(j * (1 + i % 2) + int(rng.integers(0, 5) == 0)) % 4] for j in range(60)), "en", "s") for i in range(60)]
    tree, _ = suffix_tree.fit(make(texts))
    n = len(tree.hashes)
    codes = [suffix_tree.coded(tree, [w])[0][0] for w in "abcd"]
    kept = sum(int(k.sum()) for k in tree.kept)
    assert kept > 3
    for path in itertools.chain.from_iterable(itertools.product(codes, repeat=k) for k in range(4)):
        total = sum(10 ** tree.log10(np.array([-1, *path, t]))[-1] for t in range(n))
        # what no token of training has: one unit of the root, times what the states leave to it
        unseen = 10 ** tree.log10(np.array([-1, *path, -1]))[-1]
        assert total + unseen == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("common", [1_000_000, 300, 0])
def test_tables_score_as_the_tree(docs, monkeypatch, common):
    monkeypatch.setattr(suffix_tree, "COMMON", common)  # at 0, all is joined
    rows = {r["doc_id"]: r for r in suffix_tree.score_documents(docs).collect()}
    tree, _ = suffix_tree.fit(docs.filter(~suffix_tree.held_out()))
    for r in docs.collect():
        tokens, _ = suffix_tree.coded(tree, [r["text"]])
        got = rows[r["doc_id"]]
        root = np.where(tokens >= 0, np.log10(tree.counts[np.maximum(tokens, 0)] + 1.0), 0.0).sum() - len(tokens) * math.log10(tree.total + tree.distinct + 1)
        assert got["score"] - got["base_score"] == pytest.approx(tree.log10(tokens).sum() - root, abs=1e-6)


def test_the_tree_leaves_only_what_its_result_reads(spark, docs):
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = {x.name for x in folder.iterdir()}
    rows = suffix_tree.score_documents(docs)
    left = {x.name.rsplit("-", 1)[0] for x in folder.iterdir() if x.name not in before}
    assert left == {"words", "documents", "known", "settled", "kept", "told"}
    assert rows.count() == docs.count()


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_filter_of_repeated_keys(spark, docs, monkeypatch, bits):
    monkeypatch.setattr(suffix_tree, "FILTER_BITS", bits)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.lit(False).alias("held_out"), "text")
    hashed = suffix_tree.tokenized(rows)
    n = collections.Counter()
    for batch in hashed.toArrow().to_batches():
        _, place, _, found = suffix_tree.grams(batch, 3)
        n.update(found[2][place >= 2].tolist())
    every = type("Every", (), {"value": staticmethod(lambda h: np.ones(len(h), bool))})
    keys = suffix_tree.Repeated(hashed, 2, 7, every)
    passed = dict(zip(n, keys(np.fromiter(n, np.int64, len(n))).tolist(), strict=True))
    assert all(passed[k] for k, times in n.items() if times > 1)
    once = [passed[k] for k, times in n.items() if times == 1]
    assert len(once) > 100 and (bits == 64 or np.mean(once) < 0.1)


def test_rare_contexts_of_a_large_corpus_are_states(make):
    # 60 of 240,060 tokens: far less than the shares of 1e-4 that contexts had to have
    texts = [(i, " ".join(f"w{(i * 37 + j * j) % 997}" for j in range(400)), "en", "s") for i in range(600)]
    texts += [(1000 + i, "zyx abc", "en", "s") for i in range(20)]
    rows = {r["doc_id"]: r for r in suffix_tree.score_documents(make(texts)).collect()}
    assert rows[1000]["score"] > rows[1000]["base_score"] + 4


def test_scores_of_odd_rows(messy, empty):
    rows = suffix_tree.score_documents(messy).collect()
    assert len(rows) == messy.count() and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert suffix_tree.score_documents(empty).count() == 0


def test_the_tree_stages_few_bytes_a_token(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "COMMON", 300)
    total = 0

    def staged(df, name):
        nonlocal total
        out = common.staged(df, name)
        total += sum(Path(x.removeprefix("file://")).stat().st_size for x in out.inputFiles())
        return out

    monkeypatch.setattr(suffix_tree, "staged", staged)
    rows = suffix_tree.score_documents(table(spark, DATA.replace("0.001", "0.01"), "documents"))
    n = rows.agg(F.sum("n_tokens")).first()[0]
    assert total < 16 * n, total / n


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint32, np.int64):
        for size, most in ((0, 1), (1, 200), (1000, 1), (5000, np.iinfo(kind).max)):
            x = rng.integers(0, most, size).astype(kind)
            assert (suffix_tree.unpacked(suffix_tree.packed(x), kind) == x).all()
    assert len(suffix_tree.packed(np.arange(256, dtype=np.int64))) < 400  # seven of the planes are zeros


def test_numbers_of_words_go_by_how_often_they_occur(spark, make):
    texts = [(7 * i, "aa " * 9 + "bb cc bb " + "dd ee dd ee " * (i % 2), "en", "s") for i in range(40)]
    rows = make(texts).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.lit(False).alias("held_out"), "text")
    found = suffix_tree.Ranks(suffix_tree.count_words_of_slices(suffix_tree.cut_slices(rows), 3), 3)
    assert found.count(np.arange(7)).tolist() == [360, 80, 40, 40, 40, 40, 0]
    assert (found.total, found.distinct, found.other, found.contexts) == (600, 6, 6, 6)


# tokens, packing, files


@pytest.mark.parametrize(("name", "pieces"), [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "words")])
def test_pieces_give_the_library_s_ids(docs, name, pieces):
    from tokenizers import Tokenizer

    encode, whole = tokens.Encoder(tokens.public_tokenizer(name), pieces), Tokenizer.from_file(tokens.public_tokenizer(name))
    whole.encode_special_tokens = True
    odd = ["", "a  b", "\n", " a", "a ", "Foo.\nBar,", "x\x1cy z", "  ", "Éa's, it's. don't.\n\nY", "<|endoftext|> a <|endoftext|>.", " x y\n z", "a.\n b", "a\n\nb", "1. 2,", "ǅabc. Σας Ας.", " x  y", "ﬁne été."]
    for text in [r["text"] for r in docs.collect()] + odd:
        assert np.frombuffer(encode(text), "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], text[:80]


@pytest.mark.parametrize(("name", "pieces"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_ids_of_odd_characters(name, pieces):
    from tokenizers import Tokenizer

    encode, whole = tokens.Encoder(tokens.public_tokenizer(name), pieces), Tokenizer.from_file(tokens.public_tokenizer(name))
    whole.encode_special_tokens = True
    odd = [*"aAbz\u00e9 \u00f1\u00df  \n\n\t.,;!?0123\u00b2\u00bd\u4e00\u00a0\u2003\u0301\u0085\u3000\x0b\x1c\x1f\u03a3\u03c2\u0660\u0409\u212b\U0001f600\r", "'s", "'ll", "<|endoftext|>", "\u0345"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(odd, n)) for n in rng.integers(0, 60, 5000)]
    ids, offsets = encode.encode(pa.array(texts))
    for k, found in enumerate(whole.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*found.ids, 2], texts[k]


def test_remembered_pieces_are_not_encoded_again(monkeypatch):
    name = tokens.public_tokenizer("byte_bpe_50k.json")
    texts = ["Some words, and ten 10 more.", None, "été à côté " * 3]
    first = tokens.encoder(name, "spaced", 2, 1000).encode(pa.array(texts))
    with monkeypatch.context() as m:  # another task of the same worker
        m.setattr(tokens.Encoder, "_ids", lambda *_: pytest.fail("encoded again"))
        again = tokens.encoder(name, "spaced", 2, 1000).encode(pa.array(texts))
    assert all((a == b).all() for a, b in zip(first, again, strict=True))
    assert len(tokens.encoder(name, "spaced").known) == 0  # without it, a task starts anew
    few, many = tokens.encoder(name, "spaced", 2, 4), [f"w{'x' * k} y{'z' * k} {k}" for k in range(1, 40)]
    for text in many:
        assert few.encode(pa.array([text]))[0].tolist() == tokens.Encoder(name, "spaced").encode(pa.array([text]))[0].tolist()
        assert len(few.known) <= 4


def test_packs_are_whole_and_full(docs, messy, empty):
    for df in (docs, messy):
        rows = packing.pack_documents(df).collect()
        encode = tokens.Encoder(tokens.public_tokenizer("word_bpe_49k.json"), "words")
        want = collections.Counter((r["doc_id"], zlib.crc32(encode(r["text"]))) for r in df.collect())
        by_row = collections.defaultdict(list)
        for r in rows:
            assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
            by_row[r["row"]].append(r)
        got = collections.Counter()
        for parts in by_row.values():
            parts.sort(key=lambda r: r["start"])
            assert [r["start"] for r in parts] == [sum(x["length"] for x in parts[:k]) for k in range(len(parts))]
            assert {r["doc_tokens"] for r in parts} == {sum(r["length"] for r in parts)}
            got[parts[0]["doc_id"], zlib.crc32(b"".join(r["ids"] for r in parts))] += 1
        assert got == want
        packs = collections.defaultdict(list)
        for r in rows:
            packs[r["sequence_id"]].append(r)
        for parts in packs.values():
            parts.sort(key=lambda r: r["offset"])
            assert [r["offset"] for r in parts] == [sum(x["length"] for x in parts[:k]) for k in range(len(parts))]
            assert sum(r["length"] for r in parts) == parts[0]["sequence_tokens"] <= 4096
        least = -(-sum(r["length"] for r in rows) // 4096)
        assert len(packs) <= 1.05 * least + 1
    assert packing.pack_documents(empty).count() == 0


def test_patterns_hold_the_histogram():
    rng = np.random.default_rng(0)
    histogram = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 65), 40, replace=False), rng.integers(1, 10**9, 40), strict=True)}
    got = collections.Counter()
    for count, pattern in packing.shortest_pack_first(histogram, 64):
        assert sum(k * v for k, v in pattern.items()) <= 64
        for k, v in pattern.items():
            got[k] += count * v
    assert got == histogram


def test_token_files_round_trip(docs, messy, empty, spark, tmp_path):
    encode = tokens.Encoder(tokens.public_tokenizer("byte_bpe_50k.json"), "spaced")
    for k, df in enumerate((docs, messy)):
        path = f"file://{tmp_path}/{k}"
        manifest = token_files.write_token_files(df, path)
        rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
        want = collections.Counter((r["doc_id"], encode(r["text"])) for r in df.collect())
        assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == want
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert ids == sorted(ids) and [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in rows)
        name = manifest.orderBy(F.desc("part"), F.desc("file")).first()["name"]
        last = rows[-1]
        assert token_files.read_document(path, name, last["doc_id"]) == np.frombuffer(last["ids"], "<u4").tolist()
    assert token_files.round_trip(empty).count() == 0


# PII


def spans_by_hand(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, fine in kinds for m in re.finditer(p, text) if fine(m[0])]


def test_spans_as_by_hand(make, docs, messy, empty):
    odd = [
        "write a.b@c.de_f@g.hi, 😀 x@y.z.w. or a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "card 4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111110000",
        "tel +49 (30) 123-456 78 and +1 2 +1234567890123456", "IBAN DE89 3704 0044 0532 0130 00, DE88 3704 0044 0532 0130 00", "my ssn is 123-45-6789 but not 123-45-6780 " + "y" * 40 + " 321-54-9876", "1 2 3 4" * 3000, "+1" + "(" * 20_000,
    ]
    df = make([(i, t, "en", "a") for i, t in enumerate(odd)])
    for some in (df, docs, messy):
        got = sorted((tuple((s["kind"], s["start"], s["end"]) for s in r["base"]) for r in pii.find_pii(some).collect()))
        assert got == sorted(tuple(spans_by_hand(r["text"] or "")) for r in some.collect())
    more = {r["doc_id"]: [s["text"] for s in r["spans"] if s["kind"] in ("iban", "ssn")] for r in pii.find_pii(df).collect()}
    assert more[4] == ["DE89 3704 0044 0532 0130 00"] and more[5] == ["123-45-6789", "123-45-6780"]
    assert pii.find_pii(empty).count() == 0
    assert pii.redact(df).filter("doc_id = 0").first()["text"].count("<email>") == 3


def test_ibans_context_and_redaction(make, messy):
    texts = {
        1: "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", 2: "GB82 WEST 1234 5698 7654 32 UK", 3: "DE89370400440532013000 The end", 4: "XDE89370400440532013000", 5: "DE893704004405320130001",
        6: "a ship of 1.2.3.4 sails", 7: "the ip: 1.2.3.4", 8: "1.2.3.4 is the host", 9: "123-45-6789 (ssn)", 10: "essn 123-45-6789", 11: "card 4111 1111 1111 1111, tel +49 30 1234567, a@b.cd from 10.0.0.1",
    }
    df = make([(i, t, "en", "a") for i, t in texts.items()])
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert [[s["text"] for s in found[i] if s["kind"] == "iban"] for i in range(1, 6)] == [["DE89 3704 0044 0532 0130 00"], ["GB82 WEST 1234 5698 7654 32"], ["DE89370400440532013000"], [], []]
    assert [round(found[i][0]["score"], 2) for i in (6, 7, 8)] == [0.6, 0.9, 0.9]
    assert [[s["kind"] for s in found[i]] for i in (9, 10)] == [["ssn"], []]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[11] == "card <card>, tel <phone>, <email> from <ip>" and clean[1] == "IBAN <iban> BIC COBADEFFXXX" and clean[6] == "a ship of <ip> sails"
    out = pii.redact(messy)
    assert out.columns == messy.columns and out.filter("text is null").count() == messy.filter("text is null").count()
    assert pii.digest(pii.find_pii(df)).filter("doc_id = 7").first()["scores"] == "90"
