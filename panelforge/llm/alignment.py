"""Cross-tokenizer alignment: groups of ids of two tokenizers that cover the same bytes, with corpus-wide link counts.

One pass aligns all texts and counts, in each task, the pairs of ids that end together. A minimal perfect hash of the
distinct pairs numbers them without gaps; tasks add their counts to dense vectors by that number, which are summed in a
tree. A second pass aligns the texts again and looks the counts up; the key that stands at a number is verified.

Texts are cut where white space begins, which no token of either tokenizer spans, so a task aligns each distinct piece
once and the rest are array operations.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import Staging, bounded_batches, free_name, quoted, slices, staged
from panelforge.llm.tokens import KIND, LEAD, PLAIN, SPACE, public_tokenizer

#: Bytes of text in one slice; distinct pieces that a task remembers.
SLICE, KNOWN = 1 << 22, 400_000
#: Bits of a level for each key; pairs of a shard; counts in one piece of a dense vector; pieces that a task holds.
SPREAD, SHARD, CHUNK, CHUNKS = 2, 1 << 16, 1 << 15, 128
#: Pairs whose hash, keys and counts go to the tasks together, about 20 bytes each. More take further rounds.
TABLE = 1 << 22
#: Partial vectors that meet at each node of the tree, at the least.
FAN = 64
MARK = "▁"
WIDE_MARK = MARK.encode()
#: Pieces that are encoded as one text, which begins with another.
TOGETHER, FIRST = 2000, b" a"


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, others in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Texts to pieces, pieces to ids of both tokenizers and to groups."""

    def __init__(self, byte_tokenizer: str, piece_tokenizer: str):
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_tokenizer)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_tokenizer)
        letters = byte_of_letter()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_size[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.space = self.b.piece_to_id(MARK)
        # white space that no piece has behind something else, nor after the mark
        self.cuts = np.zeros(256, bool)
        self.cuts[32] = not any(MARK in n.lstrip(MARK) for n in names)
        self.cuts[10] = not any("\n" in n and len(n) > 1 for n in names)
        self.lookup, self.strings, self.use = None, False, None
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.known: dict[bytes, int] = {}
        none = np.zeros(0, np.int64)
        #: By piece: numbers of ids of both, of groups, of links that are best and sum of counts, and whether it is sound.
        self.n_a = self.n_b = self.n_groups = self.n_best = self.count_sum = none
        self.sound = np.zeros(0, bool)
        #: By link: its key. Links of a piece stand together, one for each group.
        self.keys = np.zeros(0, np.uint64)
        self.groups: list[bytes] = []

    def keep(self, pieces: int) -> None:
        """Only the first pieces that were learned."""
        links = int(self.n_groups[:pieces].sum())
        for piece in list(itertools.islice(reversed(self.known), len(self.known) - pieces)):
            del self.known[piece]
        self.keys, self.groups = self.keys[:links], self.groups[:pieces]
        for name in ("n_a", "n_b", "n_groups", "n_best", "count_sum", "sound"):
            setattr(self, name, getattr(self, name)[:pieces])

    def _ids(self, text: str):
        """Ids of both of a text that starts with a space or line feed, which is the one that the second model adds or
        else stands behind it."""
        import numpy as np

        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = [self.space] if text == " " else self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        return np.array(a, np.int64), np.array(b, np.int64)

    def _spelled(self, piece: bytes, a, b) -> bool:
        return b"".join([self.a_bytes[i] for i in a.tolist()]) == piece and b"".join([self.b_bytes[i] for i in b.tolist()]) == piece

    def _encoded(self, pieces: list[bytes]):
        """The pieces in some order, with the ids of both, how many each piece has, and which are spelled by both.

        Pieces that could follow each other in a text are encoded as one text; where that isn't spelled as it should be,
        one by one.
        """
        import numpy as np

        data, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        kind = KIND[data]
        last = kind[ends - 1]
        follow = self.cuts[data[ends - sizes]] & (sizes > 1) & ((last > SPACE) & (last <= PLAIN) | (kind[np.maximum(ends - 2, 0)] == LEAD))
        marks = np.flatnonzero((data[:-2] == WIDE_MARK[0]) & (data[1:-1] == WIDE_MARK[1]) & (data[2:] == WIDE_MARK[2]))
        follow[np.searchsorted(ends, marks, "right")] = False
        together, alone = list(itertools.compress(pieces, follow)), list(itertools.compress(pieces, ~follow))
        out, order = [], []
        for at in range(0, len(together), TOGETHER):
            part = together[at : at + TOGETHER]
            text = FIRST + b"".join(part)
            a, b = self._ids(text.decode())
            bounds = len(FIRST) + np.concatenate([[0], np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))])
            end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            at_a, at_b = np.searchsorted(end_a, bounds), np.searchsorted(end_b, bounds)
            whole = len(end_a) and len(end_b) and end_a[-1] == end_b[-1] == len(text)
            if not whole or (end_a[at_a] != bounds).any() or (end_b[at_b] != bounds).any() or not self._spelled(text, a, b):
                alone += part
                continue
            order += part
            out.append((a[at_a[0] + 1 :], b[at_b[0] + 1 :], np.diff(at_a), np.diff(at_b), np.ones(len(part), bool)))
        none = np.zeros(0, np.int64)
        for piece in alone:
            a, b = self._ids(piece.decode())
            sound = self._spelled(piece, a, b)
            a, b = (a, b) if sound else (none, none)
            out.append((a, b, np.array([len(a)]), np.array([len(b)]), np.array([sound])))
        return [*order, *alone], *(np.concatenate(x) for x in zip(*out, strict=True))

    def _learn(self, pieces: list[bytes]) -> None:
        import numpy as np

        pieces, a, b, n_a, n_b, sound = self._encoded(pieces)
        # the bytes of all sound pieces in a row: tokens end together where the running sums are equal
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        _, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        keys = a[last_a].astype(np.uint64) << np.uint64(32) | b[last_b].astype(np.uint64)
        n_groups = np.bincount(np.repeat(np.arange(len(pieces)), n_a)[last_a], minlength=len(pieces)).astype(np.int64)
        base, ends = len(self.known), np.concatenate([[0], np.cumsum(n_groups)])
        if self.lookup is not None:
            counts, best = self.lookup(keys)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            self.count_sum = np.concatenate([self.count_sum, total(counts)])
            self.n_best = np.concatenate([self.n_best, total(best.astype(np.int64))])
        if self.strings:
            text, bounds = written(a, b, last_a, last_b)
            bounds = bounds[ends].tolist()
            self.groups += [text[i : max(i, j - 1)] for i, j in itertools.pairwise(bounds)]
        self.known.update(zip(pieces, range(base, base + len(pieces)), strict=True))
        self.keys = np.concatenate([self.keys, keys])
        self.sound = np.concatenate([self.sound, sound])
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b])
        self.n_groups = np.concatenate([self.n_groups, n_groups])

    def pieces(self, texts):
        """The number of each piece of some texts in turn, and where each text's begin (and the last ones end).

        A null or empty text has none. Numbers beyond KNOWN hold until the next call: the first pieces are remembered,
        and the most frequent are soon among them.
        """
        import numpy as np
        import pyarrow as pa

        if len(self.known) > KNOWN:
            self.keep(KNOWN)
        texts = texts.cast(pa.large_utf8()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        begin, end = int(offsets[0]), int(offsets[-1])
        if end == begin:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        data, offsets = np.frombuffer(texts.buffers()[2], np.uint8)[begin:end], offsets - begin
        some = np.flatnonzero(offsets[1:] > offsets[:-1])
        starts = offsets[:-1][some] + np.arange(len(some))
        data = np.insert(data, offsets[:-1][some], 32)  # the space before each text
        kind = KIND[data]
        cut = np.zeros(len(data) + 1, bool)
        inner = (kind[:-1] > SPACE) & (kind[:-1] <= PLAIN)
        inner[1:] |= kind[:-2] == LEAD
        cut[1:-1] = self.cuts[data[1:]] & inner
        cut[starts], cut[-1] = True, True
        bounds = np.flatnonzero(cut)
        coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        found = coded.dictionary.to_pylist()
        new = [p for p in found if p not in self.known]
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))[coded.indices.to_numpy()]
        ends = np.zeros(len(texts) + 1, np.int64)
        ends[some + 1] = np.searchsorted(bounds, np.append(starts[1:], len(data)))
        return numbers, np.maximum.accumulate(ends)

    def whole(self, numbers, ends):
        """Which texts have tokens: those with pieces, all of them sound."""
        import numpy as np

        bad = np.concatenate([[0], np.cumsum(~self.sound[numbers])])
        return (bad[ends[1:]] == bad[ends[:-1]]) & (ends[1:] > ends[:-1])


def written(a, b, last_a, last_b):
    """Groups as text, `a1,a2|b1;` each, and where each begins (and the last ends)."""
    import numpy as np

    # all ids of both sides, a group's first ones before its second ones
    group = np.concatenate([np.searchsorted(last_a, np.arange(len(a))) * 2, np.searchsorted(last_b, np.arange(len(b))) * 2 + 1])
    order = np.argsort(group, kind="stable")
    group, ids = group[order], np.concatenate([a, b])[order]
    digits = 1 + sum((ids >= 10**d).astype(np.int64) for d in range(1, 10))
    ends = np.cumsum(digits + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, ord(","), np.uint8)
    for d in range(int(digits.max(initial=0))):
        some = digits > d
        out[ends[some] - 2 - d] = 48 + ids[some] // 10**d % 10
    final = np.append(group[1:] != group[:-1], True)[: len(group)]
    out[ends[final] - 1] = np.where(group[final] % 2 == 0, ord("|"), ord(";"))
    return out.tobytes(), np.concatenate([[0], ends[final & (group % 2 == 1)]])


_aligners: dict = {}


def aligner(byte_tokenizer: str, piece_tokenizer: str, lookup: PairTable | None = None, strings: bool = False) -> Aligner:
    """One for each Python worker; what it knows of pieces holds for tasks with the same table of counts."""
    key = (byte_tokenizer, piece_tokenizer)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*key)
    out, use = _aligners[key], (getattr(lookup, "name", None), strings)
    if out.use != use:
        out.use, out.lookup, out.strings = use, lookup, strings
        out.forget()
    return out


def _mixed(keys, level: int):
    """A hash of 64-bit keys, another one for each level."""
    import numpy as np

    x = keys + np.uint64((level * 0x9E3779B97F4A7C15 + 0x1D8E4E27C47D124F) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def hash_levels(keys):
    """Bits of each level of a minimal perfect hash of distinct keys, and the keys by their numbers.

    A key that is alone at its place of a level sets its bit there; the others go to the next. A key's number is the
    number of bits set before its own.
    """
    import numpy as np

    levels, placed, rest = [], [], np.asarray(keys, np.uint64)
    while len(rest):
        if len(levels) == 128:
            raise ValueError("the keys aren't distinct")
        size = -(-len(rest) * SPREAD // 64) * 64
        at = (_mixed(rest, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        here = alone[at]
        placed.append(rest[here][np.argsort(at[here])])
        rest = rest[~here]
    return levels, np.concatenate(placed) if placed else np.zeros(0, np.uint64)


class PairTable:
    """The minimal perfect hash of some shards: numbers, verified keys and, once they are known, counts by number."""

    def __init__(self, shards: int, parts: list[tuple[int, list, object]]):
        import numpy as np

        depth = max([1, *(len(levels) for _, levels, _ in parts)])
        self.shards, self.starts, self.sizes = shards, np.zeros((shards, depth), np.int64), np.zeros((shards, depth), np.int64)
        self.present, at, bits = np.zeros(shards, bool), 0, []
        for shard, levels, _ in parts:
            self.present[shard] = True
            for k, level in enumerate(levels):
                self.starts[shard, k], self.sizes[shard, k] = at, 64 * len(level)
                at += 64 * len(level)
                bits.append(level)
        self.bits = np.concatenate([*bits, np.zeros(1, np.uint64)])
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits))]).astype(np.int64)
        self.keys = np.concatenate([keys for _, _, keys in parts] or [np.zeros(0, np.uint64)])
        self.counts = self.best = None
        self.name = uuid.uuid4().hex

    def holds(self, keys):
        """Whether the shard of each key is in here."""
        import numpy as np

        return self.present[((keys & np.uint64(0xFFFFFFFF)) % np.uint64(self.shards)).astype(np.int64)]

    def numbers(self, keys):
        """The number of each key that stands there, -1 for keys of other shards or that are unknown."""
        import numpy as np

        shard = ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(self.shards)).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        rest = np.flatnonzero(self.present[shard])
        for level in range(self.starts.shape[1]):
            size = self.sizes[shard[rest], level]
            rest, size = rest[size > 0], size[size > 0]
            at = self.starts[shard[rest], level] + (_mixed(keys[rest], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[there]] = (self.rank[at >> 6] + before)[there]
            rest = rest[~there]
        found = np.flatnonzero(out >= 0)
        out[found[self.keys[out[found]] != keys[found]]] = -1
        return out

    def set_counts(self, counts) -> None:
        """Keep counts by number, and which of them are the highest of their second id, whose pairs share a shard."""
        import numpy as np

        second = (self.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        most = np.zeros(int(second.max(initial=0)) + 1, np.int64)
        np.maximum.at(most, second, counts)
        self.counts, self.best = counts, counts == most[second]

    def __call__(self, keys):
        import numpy as np

        at = self.numbers(keys)
        own = at >= 0
        counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        counts[own], best[own] = self.counts[at[own]], self.best[at[own]]
        return counts, best


def count_pairs(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, text_col: str = "text") -> DataFrame:
    """`key, n`: first id * 2^32 + second id, and how many links of a task hold them; a task tells a pair a few times."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        found = aligner(byte_tokenizer, piece_tokenizer)
        seen, rare = np.zeros(KNOWN, np.int64), []

        def summed(parts):
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)
            return keys[n > 0], n[n > 0]

        for texts in (p["text"] for batch in batches for p in slices(batch, "text", SLICE)):
            numbers, ends = found.pieces(texts)
            here = np.bincount(numbers[np.repeat(found.whole(numbers, ends), np.diff(ends))], minlength=len(found.sound))
            seen[: min(KNOWN, len(here))] += here[:KNOWN]
            if len(here) > KNOWN:  # pieces that are forgotten at the next call
                links = int(found.n_groups[:KNOWN].sum())
                rare.append((found.keys[links:], np.repeat(here[KNOWN:], found.n_groups[KNOWN:])))
                if sum(len(k) for k, _ in rare) > KNOWN:
                    rare = [summed(rare)]
        found.keep(min(KNOWN, len(found.known)))
        keys, n = summed([*rare, (found.keys, np.repeat(seen[: len(found.n_groups)], found.n_groups))])
        yield pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "key long, n long")


def _hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """`shard, n, levels, keys`: the minimal perfect hash of the distinct pairs of each shard, which has the pairs of whole second ids."""

    def build(group):
        import numpy as np
        import pyarrow as pa

        levels, keys = hash_levels(group["key"].to_numpy().astype(np.uint64))
        cells = [[group["shard"][0].as_py()], [len(keys)], [[x.tobytes() for x in levels]], [keys.tobytes()]]
        types = [pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=["shard", "n", "levels", "keys"])

    shard = F.pmod(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(shards)).cast("int").alias("shard")
    return pairs.select("key").distinct().select("key", shard).groupBy("shard").applyInArrow(build, "shard int, n long, levels array<binary>, keys binary")


def _dense_counts(pairs: DataFrame, table: PairTable):
    """The sums of `key, n` by number: dense vectors of the tasks, summed in a tree."""
    import numpy as np

    schema = "chunk int, part int, counts binary"

    def add(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}

        def told():
            for c, x in held.items():
                yield pa.record_batch([pa.array([c], pa.int32()), pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["chunk", "part", "counts"])
            held.clear()

        for batch in batches:
            keys = batch["key"].to_numpy().astype(np.uint64)
            at = table.numbers(keys)
            own = at >= 0
            if own.sum() != table.holds(keys).sum():
                raise ValueError("a pair that isn't hashed")
            at, n = at[own], batch["n"].to_numpy()[own]
            for c in np.unique(at // CHUNK).tolist():
                if c not in held and len(held) >= CHUNKS:
                    yield from told()
                here = at // CHUNK == c
                np.add.at(held.setdefault(c, np.zeros(CHUNK, np.int64)), at[here] % CHUNK, n[here])
        yield from told()

    def meet(group):
        import pyarrow as pa

        total = np.zeros(CHUNK, np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x.as_buffer(), np.int64)
        cells = [group["chunk"][:1].cast(pa.int32()), group["part"][:1].cast(pa.int32()), pa.array([total.tobytes()], pa.binary())]
        return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cells], names=["chunk", "part", "counts"])

    dense = pairs.mapInArrow(add, schema).withColumn("part", F.pmod("part", F.lit(FAN)).cast("int"))
    dense = dense.groupBy("chunk", "part").applyInArrow(meet, schema).groupBy("chunk").applyInArrow(meet, schema)
    counts = np.zeros(-(-len(table.keys) // CHUNK) * CHUNK, np.int64)
    for r in dense.select("chunk", "counts").toLocalIterator():
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return counts[: len(table.keys)]


def _rounds(hashes: DataFrame, most: int):
    """Shards in rounds of at most `most` pairs together, or one larger shard."""
    rounds, held = [[]], 0
    for r in hashes.select("shard", "n").orderBy("shard").collect():
        if rounds[-1] and held + r["n"] > most:
            rounds.append([])
            held = 0
        rounds[-1].append(r["shard"])
        held += r["n"]
    return rounds


def align(docs: DataFrame, byte_tokenizer: str | None = None, piece_tokenizer: str | None = None, text_col: str = "text", with_groups: bool = False, most_pairs: int = TABLE, shard_pairs: int = SHARD) -> DataFrame:
    """The rows of `docs` with `n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`, and `groups` if asked for.

    A text is a space and itself for both tokenizers; one that is null, empty, or that the tokens of either don't spell
    has no tokens: zeros, and '' for its groups and their hash. Repeated rows count each. Columns of `docs` of these
    names are replaced. An empty table gives an empty one.

    Scale: texts are never shuffled. What tasks have counted is written once, some thousand pairs for each task. The
    hash, keys and counts of at most `most_pairs` pairs go to the tasks; where there are more, each round looks up its
    share of them and passes the rows on as a table.
    """
    import numpy as np

    spark = docs.sparkSession
    bounded_batches(spark)
    byte_tokenizer = byte_tokenizer or public_tokenizer("byte_bpe_50k.json")
    piece_tokenizer = piece_tokenizer or public_tokenizer("piece_bpe_32k.model")
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    made_names = [*sums, "groups_sha256", *["groups"] * with_groups]
    keep = [c for c in docs.columns if c.lower() not in made_names]
    inner = free_name(docs, "aligned_")
    with Staging() as made:
        pairs = staged(count_pairs(docs, byte_tokenizer, piece_tokenizer, text_col), "alignment-pairs")
        shards = max(1, -(-pairs.select("key").distinct().count() // shard_pairs))
        hashes = staged(_hashes(pairs, shards), "alignment-hashes")
        rounds = _rounds(hashes, most_pairs)
        out = docs.select(*map(quoted, docs.columns))
        for k, chosen in enumerate(rounds):
            rows = hashes.filter(F.col("shard").isin(chosen)).orderBy("shard").toLocalIterator() if chosen else []
            table = PairTable(shards, [(r["shard"], [np.frombuffer(x, np.uint64) for x in r["levels"]], np.frombuffer(r["keys"], np.uint64)) for r in rows])
            table.set_counts(_dense_counts(pairs, table))
            found = _looked_up(text_col, byte_tokenizer, piece_tokenizer, table, first=k == 0, with_groups=with_groups)
            if k == 0:
                out = out.select(*map(quoted, docs.columns), found.alias(inner))
            else:
                more = F.struct(*((F.col(f"{inner}.{c}") + F.col(f"more_.{c}") if c in ("n_best", "count_sum") else F.col(f"{inner}.{c}")).alias(c) for c in made_names))
                out = out.withColumn("more_", found).withColumn(inner, more).drop("more_")
            if k + 1 < len(rounds):
                out = staged(out, "alignment-round")
        made.release(keep=(out,) if len(rounds) == 1 else tuple(df for path, df in made.tables if "alignment-round" in path))
    return out.select(*map(quoted, keep), *(F.col(f"{inner}.{c}").alias(c) for c in made_names))


def _looked_up(text_col: str, byte_tokenizer: str, piece_tokenizer: str, table: PairTable, first: bool, with_groups: bool):
    """A column of the counts of each text's links; of what needs no count only in the first round."""
    schema = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups

    @F.pandas_udf(schema)
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pyarrow as pa

        found = aligner(byte_tokenizer, piece_tokenizer, table, first)
        for series in batches:
            parts = []
            for rows in slices(pa.record_batch([pa.array(series, pa.string(), from_pandas=True)], names=["text"]), "text", SLICE):
                numbers, ends = found.pieces(rows["text"])
                whole = found.whole(numbers, ends)
                total = lambda x, numbers=numbers, ends=ends, whole=whole: np.where(whole, np.diff(np.concatenate([[0], np.cumsum(x[numbers])])[ends]), 0)
                cells = {c: total(getattr(found, c)) for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum")}
                cells["n_links"] = cells["n_groups"]
                texts, digests, numbers = [], [], numbers.tolist()
                for fine, (i, j) in zip(whole.tolist(), itertools.pairwise(ends.tolist()), strict=True):
                    text = b";".join([found.groups[p] for p in numbers[i:j]]) if fine and first else b""
                    digests.append(hashlib.sha256(text).hexdigest() if text else "")
                    if with_groups:
                        texts.append(text.decode())
                cells["groups_sha256"] = digests
                if with_groups:
                    cells["groups"] = texts
                parts.append(pd.DataFrame(cells))
            names = [x.split()[0] for x in schema.split(", ")]
            yield pd.concat(parts)[names] if parts else pd.DataFrame({c: [] for c in names})

    return look_up(F.col(text_col).cast("string"))


def align_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the digest columns of each row of `docs`."""
    out = align(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.drop("text")
