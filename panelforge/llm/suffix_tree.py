"""LM scoring by a probabilistic suffix tree over words: contexts of variable length, kept by a divergence test.

Each token goes, with the three words before it, to the bucket of its contexts, where these are counted, tested and used.
`SuffixTree` and `fit` hold the same model on the driver, for small corpora and to test the buckets against.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import Staging, bounded_batches, id_remainder, slices, staged
from panelforge.llm.near_dedup import mixed
from panelforge.llm.words import SLICE, distinct_words, word_hashes

DEPTH = 3
#: How often a context has to occur, and a context with its next token.
LEAST_CONTEXT, LEAST_JOINT = 5, 2
#: A word that occurs more often is common: what follows it is counted by itself, and its longer contexts are dealt to many
#: buckets. This has no bearing on the result.
COMMON = 1_000_000
#: Tokens for each bucket of contexts, and in how many parts it handles them.
BUCKET, PARTS = 2_000_000, 4
#: Bits of the filter `Repeated`, at most. A fuller filter lets more keys pass, and loses none.
FILTER_BITS = 1 << 27
#: Weight of the shorter context in a next-token distribution, and what a context's divergence has to exceed.
SHORTER, SIGMAS = 2.0, 3.0
#: Words that a worker knows by heart; a full cache starts anew.
CACHE = 200_000
END = b"\n"  # no word holds white space
RARE = -(1 << 63)
#: Of what the sum of a text in a bucket is a whole number, as few bytes hold it then.
UNIT = 2.0**-30
#: What a context's entries add to its divergence.
SUMS = ("freedom", "p", "shorter", "gain")


def word_hash(word: bytes) -> int:
    """63 bits."""
    import xxhash

    return xxhash.xxh64_intdigest(word) >> 1


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case; words are parted by ASCII white space. bytes.lower and bytes.split are ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _Codes(dict):
    """Word to its number among the frequent words, or to RARE + its hash."""

    def __init__(self, frequent):
        super().__init__()
        self.frequent = frequent

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        h = word_hash(word)
        self[word] = code = self.frequent.get(h, RARE + h)
        return code


class SuffixTree:
    """`hashes` numbers the frequent words. For each depth d, `contexts[d]` holds the sorted codes of contexts, each the
    place of the context without its last word times the number of words, plus its last word; `kept[d]` says which are
    states; `entries[d]` and `logp[d]` hold next-token log10 probabilities by context and token; `back[d]` the log10
    weight of the next shorter state for any other token."""

    def __init__(self, hashes, counts, total: int, distinct: int):
        self.hashes, self.counts, self.total, self.distinct = hashes, counts, total, distinct
        self.contexts, self.kept, self.entries, self.logp, self.back = [], [], [], [], []
        self.key = uuid.uuid4().hex

    def context_places(self, tokens):
        """For each depth, the place of the context that ends at each token, or -1."""
        import numpy as np

        n, out = max(1, len(self.hashes)), []
        for d, codes in enumerate(self.contexts):
            if d == 0:
                wanted = tokens
            else:
                before = np.concatenate([[-1], out[-1][:-1]])
                wanted = np.where((before >= 0) & (tokens >= 0), before * n + tokens, -1)
            place = np.searchsorted(codes, wanted) if len(codes) else np.zeros(len(tokens), np.int64)
            found = (place < len(codes)) & (wanted >= 0)
            found[found] = codes[place[found]] == wanted[found]
            out.append(np.where(found, place, -1))
        return out

    def log10(self, tokens):
        """log10 probability of each token after those before it; of a rare token, without log10(count + 1)."""
        import numpy as np

        n = max(1, len(self.hashes))
        total = np.where(tokens >= 0, np.log10(self.counts[np.maximum(tokens, 0)] + 1.0) if len(self.counts) else 0.0, 0.0) - math.log10(self.total + self.distinct + 1)
        for d, places in enumerate(self.context_places(tokens)):
            state = np.concatenate([[-1], places[:-1]])
            at = np.flatnonzero((state >= 0) & (self.kept[d][state] if len(self.kept[d]) else False))
            if not len(at):
                continue
            wanted = np.where(tokens[at] >= 0, state[at] * n + tokens[at], -1)
            place = np.minimum(np.searchsorted(self.entries[d], wanted), max(0, len(self.entries[d]) - 1))
            known = self.entries[d][place] == wanted if len(self.entries[d]) else np.zeros(len(at), bool)
            total[at] = np.where(known, self.logp[d][place] if len(self.entries[d]) else 0.0, self.back[d][state[at]] + total[at])
        return total

    def add_depth(self, contexts, seen, codes, counts) -> None:
        """Add contexts (sorted codes, how often each was seen) with the counts of (context, token) codes, sorted."""
        import numpy as np

        n, d = max(1, len(self.hashes)), len(self.contexts)
        of, token = codes // n, codes % n
        # what the shorter states say of each entry: the tree is still without this depth
        shorter = 10.0 ** self._shorter(contexts, of, token)
        p = (counts + SHORTER * shorter) / (seen[of] + SHORTER) if len(of) else np.zeros(0)
        size = len(contexts)
        left = np.clip(1 - np.bincount(of, p, size), 1e-12, 1)
        left_shorter = np.clip(1 - np.bincount(of, shorter, size), 1e-12, 1)
        gain = 2 * seen * (np.bincount(of, p * np.log(p / shorter), size) + left * np.log(left / left_shorter))
        freedom = np.maximum(1, np.bincount(of, minlength=size))
        self.contexts.append(contexts)
        self.kept.append(gain > freedom + SIGMAS * np.sqrt(2 * freedom))
        self.entries.append(codes)
        self.logp.append(np.log10(p))
        self.back.append(np.log10(left / left_shorter))
        assert len(self.contexts) == d + 1

    def _shorter(self, contexts, of, token):
        """log10 probability of each (context, token) by the tree as it is."""
        import numpy as np

        n, d = max(1, len(self.hashes)), len(self.contexts)
        columns, codes = [token], contexts[of]
        for k in range(d, 0, -1):
            columns.append(codes % n)
            codes = self.contexts[k - 1][codes // n]
        columns.append(codes)
        path = np.stack([np.full(len(of), -1, np.int64), *columns[::-1][1:]], 1)  # all but the context's first word
        return self.log10(path.reshape(-1)).reshape(path.shape)[:, -1] if len(of) else np.zeros(0)


_codes: dict = {}


def coded(tree: SuffixTree, texts: list) -> tuple:
    """The tokens of some texts one after another, each text's end included, and how many each has."""
    import numpy as np

    if tree.key not in _codes:
        _codes.clear()
        _codes[tree.key] = _Codes(dict(zip(tree.hashes.tolist(), range(len(tree.hashes)), strict=True)))
    code = _codes[tree.key].__getitem__
    flat, lengths = [], []
    for text in texts:
        found = words(text)
        flat += map(code, found)
        flat.append(code(END))
        lengths.append(len(found) + 1)
    return np.array(flat, dtype=np.int64), np.array(lengths, dtype=np.int64)


def held_out(id_col: str = "doc_id"):
    return id_remainder(id_col, 7) == 2


def parts(batch, size: int = 1000):
    texts = batch["text"].to_pylist()
    for at in range(0, len(texts), size):
        yield at, texts[at : at + size]


def count_words(training: DataFrame) -> DataFrame:
    """`h, c`: how often each token occurs, by hash; counted within tasks before they shuffle."""

    def count(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = Counter()
            for _, texts in parts(batch):
                for text in texts:
                    found.update(words(text))
                found[END] += len(texts)
            hashes = np.fromiter(map(word_hash, found), dtype=np.int64, count=len(found))
            yield pa.record_batch([pa.array(hashes), pa.array(list(found.values()), pa.int64())], names=["h", "c"])

    return training.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def count_next(training: DataFrame, tree: SuffixTree, contexts) -> DataFrame:
    """`code, n`: how often each frequent token follows each of `contexts`, one word longer than the tree's longest."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        n = len(tree.hashes)
        wider = SuffixTree(tree.hashes, tree.counts, tree.total, tree.distinct)
        wider.key, wider.contexts = tree.key, [*tree.contexts, contexts]
        for batch in batches:
            codes = []
            for _, texts in parts(batch):
                tokens, _ = coded(tree, texts)
                state = np.concatenate([[-1], wider.context_places(tokens)[-1][:-1]])
                both = (state >= 0) & (tokens >= 0)
                codes.append(state[both] * n + tokens[both])
            found, counts = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64),) * 2
            yield pa.record_batch([pa.array(found), pa.array(counts.astype(np.int64))], names=["code", "n"])

    return training.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def fit(training: DataFrame) -> tuple[SuffixTree, DataFrame]:
    """The tree from the `text` column of all rows of `training`, and the counts of all tokens.

    The driver gets all of the model, which grows with the corpus; `states` is the same as tables.
    """
    import numpy as np

    vocabulary = staged(count_words(training), "words")
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    least, least_context = LEAST_JOINT, LEAST_CONTEXT
    frequent = vocabulary.filter(F.col("c") >= least).toPandas().sort_values(["c", "h"], ascending=[False, True])
    tree = SuffixTree(frequent["h"].to_numpy(np.int64), frequent["c"].to_numpy(np.int64), sums["total"], sums["distinct"])
    end = np.flatnonzero(tree.hashes == word_hash(END))
    contexts = np.setdiff1d(np.flatnonzero(tree.counts >= least_context), end).astype(np.int64)
    for _ in range(DEPTH):
        if not len(contexts):
            break
        found = count_next(training, tree, contexts).filter(F.col("n") >= least).toPandas().sort_values("code")
        codes, counts = found["code"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
        seen = tree.counts[contexts] if not tree.contexts else longer
        tree.add_depth(contexts, seen, codes, counts)
        wide = (counts >= least_context) & ~np.isin(codes % max(1, len(tree.hashes)), end)
        contexts, longer = codes[wide], counts[wide]
    return tree, vocabulary


def tokenized(rows: DataFrame) -> DataFrame:
    """`row, doc_id, held_out, tokens`: the hashes of each text's words and the end token."""
    bounded_batches(rows.sparkSession)

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        end = np.int64(word_hash(END))
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                hashes, offsets = word_hashes(batch["text"])
                flat = np.insert((hashes >> np.uint64(1)).astype(np.int64), offsets[1:], end)
                offsets = (offsets + np.arange(len(offsets))).astype(np.int32)
                yield pa.record_batch([*(batch[c] for c in ("row", "doc_id", "held_out")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["row", "doc_id", "held_out", "tokens"])

    return rows.mapInArrow(cut, "row long, doc_id long, held_out boolean, tokens array<long>")


def grams(batch, longest: int = DEPTH + 1):
    """The tokens of a batch, their places in their texts, how many each text has, and the hashes of the 1 to `longest`
    tokens that end at each token: that of k tokens holds from place k - 1 on."""
    import numpy as np

    lists = batch["tokens"]
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found = [tokens]
    for k in range(2, longest + 1):
        before = np.concatenate([[0], found[-1][:-1]]).astype(np.uint64)[: len(tokens)]
        found.append((mixed(mixed(before + np.uint64(k)) ^ tokens.astype(np.uint64)) >> np.uint64(1)).astype(np.int64))
    return tokens, place, lengths, found


def earlier(x):
    """What the token before each token has."""
    import numpy as np

    return np.concatenate([[-1], x[:-1]])[: len(x)]


def bucket_of(key, buckets: int):
    """Which of some buckets a hash of 63 bits belongs to, by its upper 31 bits: sorted hashes are in order of bucket."""
    import numpy as np

    return ((key.astype(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(31)


def sent(bucket, buckets: int, columns: dict):
    """A row for each bucket that has any of some values, with its part of each array of `columns`; `bucket` ascends."""
    import numpy as np
    import pyarrow as pa

    ends = np.searchsorted(bucket, np.arange(buckets + 1).astype(bucket.dtype))
    some = np.flatnonzero(np.diff(ends))
    cut = lambda x: pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in some], pa.binary())
    return pa.record_batch([pa.array(some.astype(np.int32)), *map(cut, columns.values())], names=["bucket", *columns])


class Repeated:
    """A Bloom filter of the keys of `depth` + 1 tokens that occur twice or more after a context that passes the filter
    `contexts` (a broadcast); each of `buckets` has bits of its own.

    A task sends 32 bits of each key to the key's bucket, where its other bits are the same or nearly so, and those that
    it has twice or more often two times; what a bucket gets twice is set.
    """

    def __init__(self, training: DataFrame, depth: int, buckets: int, contexts):
        import numpy as np

        low, most = np.uint64(0xFFFFFFFF), max(64, FILTER_BITS // buckets)

        def send(batches):
            for batch in batches:
                _, place, _, found = grams(batch, depth + 1)
                at = np.flatnonzero(place >= depth)
                key = found[depth][at[contexts.value(earlier(found[depth - 1])[at])]]
                x = np.sort(bucket_of(key, buckets) << np.uint64(32) | key.astype(np.uint64) & low)
                more = np.ones(len(x), bool)
                more[2:] = x[2:] != x[:-2]
                x = x[more]
                yield sent(x >> np.uint64(32), buckets, {"low": (x & low).astype(np.uint32)})

        def mark(group):
            import pyarrow as pa

            x = np.sort(np.frombuffer(b"".join(group["low"].to_pylist()), np.uint32))
            x = np.unique(x[1:][x[1:] == x[:-1]])
            bits = np.zeros(-(-max(64, min(most, 16 * len(x))) // 8) * 8, bool)
            for cell in self.cells(x, np.uint64(len(bits))):
                bits[cell] = True
            return pa.table({"bucket": group["bucket"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        rows = training.select("tokens").mapInArrow(send, "bucket int, low binary").groupBy("bucket").applyInArrow(mark, "bucket int, bits binary").toArrow()
        found = dict(zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist(), strict=True))
        bits = [np.frombuffer(found.get(k, bytes(8)), np.uint8) for k in range(buckets)]
        self.sizes = np.array([8 * len(b) for b in bits], np.uint64)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int64)
        self.bits = np.concatenate(bits)

    @staticmethod
    def cells(x, size):
        """Two bits of `size` for each 32 bits."""
        import numpy as np

        for odd in (0x9E3779B1, 0x85EBCA77):
            yield ((((x.astype(np.uint64) * np.uint64(odd)) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)).astype(np.int64)

    def __call__(self, key):
        import numpy as np

        bucket, out = bucket_of(key, len(self.sizes)).astype(np.int64), np.ones(len(key), bool)
        for cell in self.cells(key.astype(np.uint64) & np.uint64(0xFFFFFFFF), self.sizes[bucket]):
            cell += self.starts[bucket]
            out &= (self.bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return out


def freed(spark) -> None:
    """Let Spark delete the shuffle files of what is no longer used; it does so when the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def packed(x) -> bytes:
    """An array of numbers, each of its byte planes compressed by itself; a plane of zeros takes no room."""
    import numpy as np
    import pyarrow as pa

    planes, zstd = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T), pa.Codec("zstd", compression_level=1)
    parts_ = [zstd.compress(p.tobytes(), asbytes=True) if p.any() else b"" for p in planes]
    return np.array([len(x), *map(len, parts_)], np.int64).tobytes() + b"".join(parts_)


def unpacked(data: bytes, kind):
    import numpy as np
    import pyarrow as pa

    size, zstd = np.dtype(kind).itemsize, pa.Codec("zstd")
    n, *lengths = np.frombuffer(data, np.int64, size + 1).tolist()
    planes, at = np.zeros((size, n), np.uint8), 8 * (size + 1)
    for plane, length in zip(planes, lengths, strict=True):
        if length:
            plane[:] = np.frombuffer(zstd.decompress(data[at : at + length], decompressed_size=n), np.uint8)
        at += length
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def numbered(key):
    """The place of each key among the distinct ones, in order, and where one of each is."""
    import numpy as np

    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(key)]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def places(lengths):
    """The place of each token in its text, and the number of its text."""
    import numpy as np

    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(np.arange(len(lengths)), lengths)


def numpied(row, name: str, kind):
    import numpy as np

    return np.array(row[name], dtype=kind)


def cut_slices(rows: DataFrame) -> DataFrame:
    """A row for each slice of texts, named by the first of its rows: the ids, `held_out` and numbers of tokens of its texts, the
    hashes of its distinct words, the end token among them, and how often training texts have each; and its tokens, as places among those."""
    bounded_batches(rows.sparkSession)

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found, numbers, offsets = distinct_words(batch["text"])
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, [*found, END]), np.uint64, len(found) + 1)
                tokens = np.insert(numbers, offsets[1:], len(found))
                lengths = np.diff(offsets) + 1
                # the more frequent, the smaller, as that packs best
                unique, of = np.unique((hashes >> np.uint64(1)).astype(np.int64), return_inverse=True)
                tokens = of[tokens]
                order = np.argsort(-np.bincount(tokens, minlength=len(unique)), kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                tokens = place[tokens]
                held = batch["held_out"].to_numpy(zero_copy_only=False).astype(bool)
                seen = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(unique))
                one = lambda x: pa.array([x])
                yield pa.record_batch(
                    [
                        batch["row"][:1], pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), batch["doc_id"]), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), batch["held_out"]),
                        one(lengths.astype(np.int32)), one(int(lengths.sum())), one(unique[order].tobytes()), one(packed(seen.astype(np.int64))), one(packed(tokens.astype(np.uint32))),
                    ],
                    names=["slice", "doc_id", "held_out", "lengths", "size", "words", "seen", "tokens"],
                )

    return rows.mapInArrow(cut, "slice long, doc_id array<long>, held_out array<boolean>, lengths array<int>, size long, words binary, seen binary, tokens binary")


def count_words_of_slices(cut: DataFrame, buckets: int) -> DataFrame:
    """How often training texts have each word, told to each slice that has it: `slice, bucket, n, place` for each bucket of hashes,
    the last two of each word of the slice in order of hash; `place` is a word's among those of its bucket that occur as often.

    Each bucket also has a row of slice -1: the numbers `n` that occur, how many words have each, and of the common words the hashes,
    numbers and places, one array after another.
    """

    def send(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                words_ = np.frombuffer(row["words"], np.int64)
                order = np.argsort(words_)
                out = sent(bucket_of(words_[order], buckets), buckets, {"key": words_[order], "n": unpacked(row["seen"], np.int64)[order]})
                yield pa.record_batch([pa.array(np.full(len(out), row["slice"], np.int64)), *out.columns], names=["slice", *out.schema.names])

    def add(group):
        import numpy as np
        import pyarrow as pa

        keys, n = (np.frombuffer(b"".join(group[c].to_pylist()), np.int64) for c in ("key", "n"))
        of, first = numbered(keys)
        total = np.bincount(of, n).astype(np.int64)
        order = np.argsort(total, kind="stable")
        numbers, starts, many = np.unique(total[order], return_index=True, return_counts=True)
        place = np.empty(len(total), np.int64)
        place[order] = np.arange(len(total)) - np.repeat(starts, many)
        ends = np.cumsum([len(x) // 8 for x in group["key"].to_pylist()])[:-1]
        told = [[packed(x) for x in np.split(y[of], ends)] for y in (total, place)]
        most = total >= max(LEAST_CONTEXT, COMMON + 1)
        common = np.concatenate([x[most] for x in (keys[first], total, place)]).tobytes()
        return pa.table(
            {
                "slice": pa.array([*group["slice"].to_pylist(), -1], pa.int64()), "bucket": pa.array([group["bucket"][0].as_py()] * (len(group) + 1), pa.int32()),
                "n": pa.array([*told[0], packed(numbers)], pa.binary()), "place": pa.array([*told[1], packed(many.astype(np.int64))], pa.binary()),
                "common": pa.array([None] * len(group) + [common], pa.binary()),
            }
        )

    dealt = cut.select("slice", "words", "seen").mapInArrow(send, "slice long, bucket int, key binary, n binary")
    return dealt.groupBy("bucket").applyInArrow(add, "slice long, bucket int, n binary, place binary, common binary")


class Ranks:
    """Numbers of the words that training texts have LEAST_JOINT times or more, the most frequent first; all other words
    have the number `other`. What is kept of them is how many words occur how often, in each bucket."""

    def __init__(self, counted: DataFrame, buckets: int):
        import numpy as np

        told = counted.filter("slice = -1").collect()
        rows = {r["bucket"]: (unpacked(bytes(r["n"]), np.int64), unpacked(bytes(r["place"]), np.int64)) for r in told}
        none = np.zeros(0, np.int64)
        each = [rows.get(b, (none, none)) for b in range(buckets)]
        n, many = (np.concatenate([x[k] for x in each]) for k in (0, 1))
        self.total, self.distinct = int((n * many).sum()), int(many[n > 0].sum())
        self.size = float(self.total + self.distinct + 1)
        bucket = np.repeat(np.arange(buckets), [len(x[0]) for x in each])
        often = n >= LEAST_JOINT
        n, many, bucket = n[often], many[often], bucket[often]
        order = np.lexsort((bucket, -n))
        n, many, bucket = n[order], many[order], bucket[order]
        starts = np.cumsum(many) - many
        self.other = int(many.sum())
        if self.other >= 1 << 32:
            raise ValueError("the numbers of words are of 32 bits")
        self.in_bucket = []
        for b in range(buckets):
            at = np.flatnonzero(bucket == b)[::-1]
            self.in_bucket.append((n[at], starts[at]))
        new = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])[: len(n)])
        self.firsts, self.counts = starts[new], n[new]
        #: How many words may be in a context: the first ones.
        self.contexts = int(many[n >= LEAST_CONTEXT].sum())
        common = {r["bucket"]: np.frombuffer(r["common"], np.int64).reshape(3, -1) for r in told}
        number = np.concatenate([np.zeros(0, np.int64), *(self.of_bucket(b, *x[1:]) for b, x in common.items())])
        order = np.argsort(number)
        #: The hashes of the common words, which are the first ones of all.
        self.common_hashes = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in common.values())])[order]
        self.common = len(order)

    def of_bucket(self, bucket: int, n, place):
        import numpy as np

        numbers, starts = self.in_bucket[bucket]
        out = np.full(len(n), self.other, np.int64)
        often = n >= LEAST_JOINT
        out[often] = starts[np.searchsorted(numbers, n[often])] + place[often]
        return out

    def count(self, number):
        """How often training texts have words, by number; 0 for other words."""
        import numpy as np

        if not self.other:
            return np.zeros(len(number), np.int64)
        return np.where(number < self.other, self.counts[np.searchsorted(self.firsts, number, side="right") - 1], 0)


def divergence(of, size: int, p, shorter):
    """For each of `size` contexts, by its entries (which context each is `of`): the sums that `back_weights` needs."""
    import numpy as np

    return [np.bincount(of, x, size) for x in (np.ones(len(of)), p, shorter, p * np.log(p / shorter))]


def back_weights(seen, freedom, p, shorter, gain):
    """The log10 weight of the shorter context in each context for tokens without an entry; NaN if it isn't a state."""
    import numpy as np

    left, left_shorter = np.clip(1 - p, 1e-12, 1), np.clip(1 - shorter, 1e-12, 1)
    gain = 2 * seen * (gain + left * np.log(left / left_shorter))
    return np.where((freedom > 0) & (gain > freedom + SIGMAS * np.sqrt(2 * freedom)), np.log10(left / left_shorter), np.nan)


def common_weights(kept: DataFrame, ranks: Ranks):
    """The weights of the shorter context after each common word, by its number."""
    import numpy as np

    out, rows = np.full(ranks.common, np.nan), kept.toArrow()
    ctx = rows["ctx"].to_numpy()
    out[ctx] = back_weights(ranks.count(ctx), *(rows[c].to_numpy() for c in SUMS))
    return out


def spread(key, buckets: int):
    import numpy as np

    return bucket_of(mixed(key.astype(np.uint64)) >> np.uint64(1), buckets)


def with_second(c, b, token, ranks: Ranks):
    """What a window is dealt by: its context's last word, and if that is common, the word before it, or else the token."""
    import numpy as np

    return c << 32 | np.where(c < ranks.common, np.where(b < ranks.other, b, token) + 1, 0)


def common_pairs(words_, tokens, place, training, ranks: Ranks, buckets: int):
    """Which tokens of a slice follow a common word, the place of each one's pair among the distinct pairs, these pairs' hashes in order of
    bucket, their buckets, how often training texts of the slice have each, and where one of each is."""
    import numpy as np

    order = np.argsort(ranks.common_hashes)
    at = np.searchsorted(ranks.common_hashes[order], words_)
    number = np.full(len(words_), -1, np.int64)
    if ranks.common:
        own = order[np.minimum(at, ranks.common - 1)]
        number[ranks.common_hashes[own] == words_] = own[ranks.common_hashes[own] == words_]
    before = earlier(number[tokens])
    at = np.flatnonzero((place >= 1) & (before >= 0))
    pairs, one = numbered(before[at] << 32 | tokens[at])
    first = at[one]
    key = (mixed(mixed(before[first].astype(np.uint64) + np.uint64(1)) ^ words_[tokens[first]].astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    bucket = bucket_of(key, buckets)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    pairs = back[pairs]
    return at, pairs, key[order], bucket[order], np.bincount(pairs[training[at]], minlength=len(order)).astype(np.int64), before[first][order], tokens[first][order]


def pairs_of(row, ranks: Ranks, buckets: int):
    import numpy as np

    lengths = numpied(row, "lengths", np.int64)
    return common_pairs(np.frombuffer(row["words"], np.int64), unpacked(row["tokens"], np.uint32).astype(np.int64), places(lengths)[0], np.repeat(~numpied(row, "held_out", bool), lengths), ranks, buckets)


def count_common_pairs(cut: DataFrame, ranks, buckets: int) -> DataFrame:
    """How often training texts have each token after each common word, told to each slice that has it: `slice, bucket, n`, in the order
    of `common_pairs`. `n` is twice that number, and 1 more in one of the slices, which adds the pair to the divergence."""

    def send(batches):
        import numpy as np
        import pyarrow as pa

        r = ranks.value
        for batch in batches:
            for row in batch.to_pylist() if r.common else []:
                _, _, pairs, bucket, n, *_ = pairs_of(row, r, buckets)
                out = sent(bucket, buckets, {"key": pairs, "n": n})
                yield pa.record_batch([pa.array(np.full(len(out), row["slice"], np.int64)), *out.columns], names=["slice", *out.schema.names])

    def add(group):
        import numpy as np
        import pyarrow as pa

        keys, n = (np.frombuffer(b"".join(group[c].to_pylist()), np.int64) for c in ("key", "n"))
        of, first = numbered(keys)
        told = 2 * np.bincount(of, n).astype(np.int64)[of]
        told[first] += 1
        ends = np.cumsum([len(k) // 8 for k in group["key"].to_pylist()])[:-1]
        return pa.table({"slice": group["slice"], "bucket": group["bucket"], "n": pa.array([packed(y) for y in np.split(told, ends)], pa.binary())})

    dealt = cut.select("slice", "lengths", "held_out", "words", "tokens").mapInArrow(send, "slice long, bucket int, key binary, n binary")
    return dealt.groupBy("bucket").applyInArrow(add, "slice long, bucket int, n binary")


def number_slices(cut: DataFrame, counted: DataFrame, pairs: DataFrame, ranks, buckets: int) -> DataFrame:
    """The slices with the numbers of their tokens, packed, and for each text how many tokens are known and its base score; `given`,
    how often training texts have each token after the common word before it; and what the slice adds to the divergence of common words."""

    def number(batches):
        import numpy as np
        import pyarrow as pa

        r = ranks.value
        for batch in batches:
            for row in batch.to_pylist():
                order = np.argsort(np.frombuffer(row["words"], np.int64))
                n, ids = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
                n_found = [unpacked(x["n"], np.int64) for x in row["told"]]
                n[order] = np.concatenate(n_found)
                ids[order] = np.concatenate([r.of_bucket(x["bucket"], m, unpacked(x["place"], np.int64)) for x, m in zip(row["told"], n_found, strict=True)])
                tokens, lengths = unpacked(row["tokens"], np.uint32), numpied(row, "lengths", np.int64)
                begin = np.cumsum(lengths) - lengths
                known = np.add.reduceat((n > 0)[tokens].astype(np.int64), begin)
                base = np.add.reduceat((np.log10(n + 1.0) - math.log10(r.size))[tokens], begin)
                given, ctx, sums = np.zeros(len(tokens), np.int64), np.zeros(0, np.int64), [np.zeros(0)] * len(SUMS)
                if row["pairs"]:
                    follows, pair, _, _, _, before, after = pairs_of(row, r, buckets)
                    told = np.concatenate([unpacked(x["n"], np.int64) for x in row["pairs"]])
                    given[follows] = (told >> 1)[pair]
                    own = (told & 1 == 1) & (told >> 1 >= LEAST_JOINT)
                    ctx, x = np.unique(before[own], return_inverse=True)
                    shorter = (n[after[own]] + 1) / r.size
                    sums = divergence(x, len(ctx), ((told >> 1)[own] + SHORTER * shorter) / (r.count(before[own]) + SHORTER), shorter)
                one = lambda x: pa.array([x])
                yield pa.record_batch(
                    [
                        one(row["slice"]), pa.array([row["doc_id"]], pa.list_(pa.int64())), one(row["held_out"]), one(lengths.astype(np.int32)), one(known), one(base), one(packed(ids.astype(np.uint32)[tokens])), one(packed(given)), one(ctx), *map(one, sums),
                    ],
                    names=["slice", "doc_id", "held_out", "lengths", "known", "base", "ids", "given", "ctx", *SUMS],
                )

    told = counted.filter("slice >= 0").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "place"))).alias("told"))
    pairs = pairs.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("pairs"))
    joined = cut.select("slice", "doc_id", "held_out", "lengths", "words", "tokens").join(told, "slice").join(pairs, "slice", "left")
    schema = "slice long, doc_id array<long>, held_out array<boolean>, lengths array<int>, known array<long>, base array<double>, ids binary, given binary, ctx array<long>"
    return joined.mapInArrow(number, ", ".join([schema, *(f"{c} array<double>" for c in SUMS)]))


def settle(c, b, a, token, training, given, ranks: Ranks, common_back):
    """log10 of what the longest state says of each token after the words a, b, c, over what the root says of it.

    All windows of a context of two or three words are here, and all of a word that isn't common; `given` is how often a token
    follows a common word. A word that can't be in a context is `ranks.other`, and so is one before it.
    """
    import numpy as np

    other, shift = ranks.other, np.uint64(32)
    root = (ranks.count(token) + 1) / ranks.size
    eff, delta = root.copy(), np.zeros(len(c))
    at, x, words_ = np.arange(len(c)), np.zeros(len(c), np.int64), (c, b, a)
    for depth in range(DEPTH):
        word = words_[depth][at]
        at, x = at[word < other], x[word < other]
        x, first = numbered(x.astype(np.uint64) << shift | words_[depth][at].astype(np.uint64))
        seen = np.bincount(x[training[at]], minlength=len(first)) if depth else ranks.count(c[at[first]])
        if depth:
            enough = (seen >= LEAST_CONTEXT)[x]
            at, x = at[enough], x[enough]
        if not len(at):
            break
        e, one = numbered(x.astype(np.uint64) << shift | token[at].astype(np.uint64))
        n = np.bincount(e[training[at]], minlength=len(one))
        of, shorter = x[one], eff[at[one]]
        if not depth:
            is_common = c[at[one]] < ranks.common
            n = np.where(is_common, given[at[one]], n)
        entry = (n >= LEAST_JOINT) & (token[at[one]] < other)
        p = (n + SHORTER * shorter) / (seen[of] + SHORTER)
        back = back_weights(seen, *divergence(of[entry], len(seen), p[entry], shorter[entry]))
        if not depth and ranks.common:
            own = c[at[first]]
            back = np.where(own < ranks.common, common_back[np.minimum(own, ranks.common - 1)], back)
        state = ~np.isnan(back[x])
        said = state & entry[e]
        eff[at[said]] = p[e[said]]
        delta[at[said]] = np.log10(p[e[said]] / root[at[said]])
        rest = state & ~said
        delta[at[rest]] += back[x[rest]]
    return delta


def settle_windows(known: DataFrame, ranks, back, buckets: int) -> DataFrame:
    """`slice, doc, delta`: for some texts of a slice, the sum of what states say of their tokens over the root, in units of UNIT.

    Each token goes with the three words before it to a bucket by the last of these, by the last two if the last is
    common; there are all windows of all contexts that it may have.
    """
    kinds = {"c": "uint32", "b": "uint32", "a": "uint32", "token": "uint32", "doc": "uint32", "training": "uint8", "given": "int64"}

    def send(batches):
        import numpy as np
        import pyarrow as pa

        r = ranks.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = unpacked(row["ids"], np.uint32).astype(np.int64), numpied(row, "lengths", np.int64)
                training = np.repeat(~numpied(row, "held_out", bool), lengths)
                place, doc = places(lengths)
                given = unpacked(row["given"], np.int64)
                at = np.flatnonzero((place >= 1) & (earlier(ids) < r.contexts))
                c, token, b, a = ids[at - 1], ids[at], ids[at - 2], ids[at - 3]
                b[(place[at] < 2) | (b >= r.contexts)] = r.other
                a[(place[at] < 3) | (a >= r.contexts) | (b == r.other)] = r.other
                bucket = spread(with_second(c, b, token, r), buckets)
                order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
                columns = {"c": c, "b": b, "a": a, "token": token, "doc": doc[at], "training": training[at], "given": given[at]}
                columns = {k: x[order].astype(kinds[k]) for k, x in columns.items()}
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(bucket.dtype))
                some = np.flatnonzero(np.diff(ends))
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(some), row["slice"], np.int64)), pa.array(some.astype(np.int32)),
                        *(pa.array([packed(np.diff(x[ends[k] : ends[k + 1]], prepend=x[:1] * 0) if name == "doc" else x[ends[k] : ends[k + 1]]) for k in some], pa.binary()) for name, x in columns.items()),
                    ],
                    names=["slice", "bucket", *columns],
                )

    def add(group):
        import numpy as np
        import pyarrow as pa

        r = ranks.value
        doc = [np.cumsum(unpacked(x.as_py(), np.uint32), dtype=np.uint32) for x in group["doc"]]
        got = {k: np.concatenate([unpacked(x.as_py(), kind) for x in group[k]]) for k, kind in kinds.items() if k not in ("doc", "given")}
        given = np.concatenate([unpacked(x.as_py(), np.int64) for x in group["given"]]) if r.common else np.broadcast_to(np.int64(0), len(got["c"]))
        # a bucket's contexts in some parts, one after another, for the memory
        ends, part = np.cumsum([0, *map(len, doc)]), np.empty(len(given), np.uint8)
        for begin, end in zip(ends[:-1], ends[1:], strict=True):
            c, b, token = (got[k][begin:end].astype(np.int64) for k in ("c", "b", "token"))
            part[begin:end] = mixed(with_second(c, b, token, r).astype(np.uint64)) & np.uint64(PARTS - 1)
        delta = np.zeros(len(part))
        for k in range(PARTS):
            at = np.flatnonzero(part == k)
            c, b, a, token = (got[x][at].astype(np.int64) for x in ("c", "b", "a", "token"))
            delta[at] = settle(c, b, a, token, got["training"][at].astype(bool), given[at], r, back.value)
        docs, sums = [], []
        for x, begin, end in zip(doc, ends[:-1], ends[1:], strict=True):
            summed = np.rint(np.bincount(x, delta[begin:end]) / UNIT).astype(np.int64)
            some = np.flatnonzero(summed)
            docs.append(packed(np.diff(some, prepend=0).astype(np.uint32)))
            sums.append(packed(summed[some] << 1 ^ summed[some] >> 63))  # small ones of either sign have few bytes
        return pa.table({"slice": group["slice"], "doc": pa.array(docs, pa.binary()), "delta": pa.array(sums, pa.binary())})

    dealt = known.select("slice", "lengths", "held_out", "ids", "given").mapInArrow(send, "slice long, bucket int, " + ", ".join(f"{k} binary" for k in kinds))
    return dealt.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(add, "slice long, doc binary, delta binary")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The tree learns from the documents that aren't held out. `score` is the log10 probability of all tokens, each after
    the longest state that ends before it; the root is the add-one distribution of `base_score`. A null text is the end
    token alone. Ids may be null or repeated; a null id isn't held out. Other columns are ignored.

    Scale: texts are read once, and cut into slices. Slices send their distinct words to buckets by hash, which tell them how often
    each occurs, and then each token with the three words before it to the bucket of its contexts, which counts, tests and
    scores, and returns a sum for each text. The tasks get how many words occur how often, and the weights of common words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    with Staging() as read:
        cut = staged(cut_slices(rows), "tokens")
    size = cut.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = size // BUCKET + 1
    vocabulary = staged(count_words_of_slices(cut, buckets), "words")
    numbers = Ranks(vocabulary, buckets)
    ranks = spark.sparkContext.broadcast(numbers)
    told = staged(count_common_pairs(cut, ranks, buckets), "told")
    known = staged(number_slices(cut, vocabulary, told, ranks, buckets), "known")
    read.release()
    documents = staged(known.select("slice", "doc_id", "held_out", "lengths", "known", "base"), "documents")
    sums = known.select(F.explode(F.arrays_zip("ctx", *SUMS)).alias("x")).groupBy(F.col("x.ctx").alias("ctx")).agg(*(F.sum(f"x.{c}").alias(c) for c in SUMS))
    kept = staged(sums, "kept")
    back = spark.sparkContext.broadcast(common_weights(kept, numbers))
    freed(spark)
    settled = staged(settle_windows(known, ranks, back, buckets), "settled")
    ranks.destroy()
    back.destroy()
    freed(spark)
    total = numbers.total

    def put_together(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                lengths, base = numpied(row, "lengths", np.int64), numpied(row, "base", float)
                sums = np.zeros(len(base), np.int64)
                for x in row["settled"] or []:
                    delta = unpacked(x["delta"], np.int64)
                    sums[np.cumsum(unpacked(x["doc"], np.uint32))] += delta >> 1 ^ -(delta & 1)
                yield pa.record_batch(
                    [pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(lengths), pa.array(numpied(row, "known", np.int64)), pa.array(np.full(len(base), total, np.int64)), pa.array(base), pa.array(base + sums * UNIT)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    returned = settled.groupBy("slice").agg(F.collect_list(F.struct("doc", "delta")).alias("settled"))
    return documents.join(returned, "slice", "left").mapInArrow(put_together, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
