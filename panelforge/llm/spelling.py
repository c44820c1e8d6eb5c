"""Spelling variants: words within one edit of a far more frequent word, by bit-sliced position indexes.

A position index holds, for each position and letter, the set of the words that have that letter there, as bits over the
words. A query word is read once: the set of words that agree with it so far, that differ in one letter, and that have
one letter more (read from the position behind) are updated for all words at once, 64 to an integer.

Two words one edit apart agree outside one half of the shorter. So words meet in buckets by length and half, and each
bucket is indexed and queried by itself. A bucket of too many words is dealt anew by halves of its half, until a part
is one letter, where a bucket can't hold more words than letters and pairs of letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import Staging, staged, text_or_empty

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, TIMES, TYPO = 6, 5, 5, 199
#: Words of a bucket beyond which it is dealt anew; words, and letters of them, that one index holds.
BUCKET, INDEX, INDEX_LETTERS = 2048, 4096, 1 << 21
#: Words by words of bits that are handled together.
TOGETHER = 1 << 15


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int | None = TYPO) -> DataFrame:
    """`word, n`: runs of letters of whole texts, A-Z in lower case, of a length and frequency at least.

    If `typo` divides the crc32 of `id:run`, the run loses the letter at crc32 mod length, in that row. A null id is
    empty text there; a null text has no words; repeated rows count each. Words shuffle as counts of tasks.
    """
    lower = F.translate(text_or_empty(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(text_or_empty(id_col).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    if typo is not None:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs = runs.withColumn("run", F.when(F.col("h") % typo == 0, cut).otherwise(F.col("run"))).filter(F.length("run") >= least_length)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _key(length, part, parts: int):
    """The hash of what lies outside a part of a word, for partners of `length` letters or one more."""
    begin, end = F.floor(part * length / parts).cast("int"), F.floor((part + 1) * length / parts).cast("int")
    head = F.substring("word", F.lit(1), begin)
    tail = F.when(length - end > 0, F.expr("right(word, length - floor((part + 1) * length / %d))" % parts)).otherwise("")
    return F.xxhash64(length, part, F.lit(parts), head, tail)


def _dealt(words: DataFrame, most: int) -> DataFrame:
    """`word, n, length, key`: each word in the buckets of its own length and of the length before, for each part."""
    twice = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("length")).filter(F.col("length") > 0)
    parts = 2
    rows = twice.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("key", _key(F.col("length"), F.col("part"), parts))
    fine = []
    while True:
        sizes = rows.groupBy("length", "key").agg(F.count("*").alias("size")).filter((F.col("size") > most) & (F.col("length") > parts)).select("length", "key")
        sizes = staged(sizes, "spelling-large")
        if sizes.isEmpty():
            fine.append(rows)
            break
        fine.append(rows.join(sizes, ["length", "key"], "left_anti"))
        parts *= 2
        rows = rows.join(sizes, ["length", "key"], "left_semi").withColumn("part", F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)))
        rows = rows.withColumn("key", _key(F.col("length"), F.col("part"), parts))
    out = [d.select("length", "key", "word", "n") for d in fine]
    for d in out[1:]:
        out[0] = out[0].unionByName(d)
    return out[0]


class PositionIndex:
    """Bits over some words, of lengths `length` and `length` + 1: `bits[p, c]` are those with letter c at position p."""

    def __init__(self, words: list[str], length: int):
        import numpy as np

        n = len(words)
        wide = -(-n // 64)
        codes = np.frombuffer("".join(w.ljust(length + 1, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(n, length + 1)
        self.letters, coded = np.unique(codes, return_inverse=True)
        coded = coded.reshape(n, length + 1)
        self.bits = np.zeros((length + 1, len(self.letters) + 1, wide), np.uint64)  # the last letter is any other
        for c in range(len(self.letters)):
            self.bits[:, c] = self._pack(coded.T == c, wide)
        self.same_length = self._pack(np.array([[len(w) == length for w in words]]), wide)[0]
        self.longer = self._pack(np.array([[len(w) == length + 1 for w in words]]), wide)[0]
        self.length, self.n = length, n

    @staticmethod
    def _pack(flags, wide: int):
        import numpy as np

        out = np.zeros((len(flags), wide * 8), np.uint8)
        packed = np.packbits(flags, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def near(self, queries: list[str]):
        """(query, word) numbers of words one edit from a query of `length` letters, and not shorter than it."""
        import numpy as np

        codes = np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32).reshape(len(queries), self.length)
        coded = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        coded = np.where(self.letters[coded] == codes, coded, len(self.letters))
        step, found = max(1, TOGETHER // self.bits.shape[2]), []
        for at in range(0, len(queries), step):
            q = coded[at : at + step]
            agree = np.full((len(q), self.bits.shape[2]), np.uint64(0xFFFFFFFFFFFFFFFF))
            replaced, inserted = np.zeros_like(agree), np.zeros_like(agree)
            for i in range(self.length):
                here = self.bits[i].take(q[:, i], axis=0)
                inserted |= agree  # the word's letter here is the one more; what follows stands one behind
                inserted &= self.bits[i + 1].take(q[:, i], axis=0)
                replaced &= here
                np.bitwise_or(replaced, agree & ~here, out=replaced)
                agree &= here
            hit = (replaced & self.same_length) | ((inserted | agree) & self.longer)
            row, word = np.nonzero(hit)
            if len(row):
                flags = np.unpackbits(hit[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                one, bit = np.nonzero(flags)
                found.append(np.stack([row[one] + at, word[one] * 64 + bit]))
        return np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)


def pairs_within(words: list[str]):
    """(shorter or equal, other) numbers of the pairs of distinct words one edit apart; equal lengths come both ways."""
    import numpy as np

    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    found = []
    for length, own in by_length.items():
        both = own + by_length.get(length + 1, [])
        pairs = PositionIndex([words[i] for i in both], length).near([words[i] for i in own])
        found.append(np.array(both)[pairs])
    return np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """`word, near, near_n`: all words of `word, n` (distinct) one inserted, deleted or replaced code point away.

    Scale: each word goes to four buckets; tasks index some buckets at a time, at most INDEX words and one bucket.
    """
    rows = _dealt(words, bucket).repartition("length", "key").sortWithinPartitions("length", "key")

    def search(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(rows):
            held = dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True))
            names, counts = pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())
            a, b = pairs_within(list(held))
            back = np.array([len(x) for x in held])
            longer = back[b] > back[a] if len(a) else np.zeros(0, bool)
            a, b = pa.array(np.concatenate([a, b[longer]])), pa.array(np.concatenate([b, a[longer]]))
            return pa.record_batch([names.take(a), names.take(b), counts.take(b)], names=["word", "near", "near_n"])

        rest, letters = None, 0
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            while rest.num_rows:
                keys, length = rest["key"].to_numpy(), rest["length"].to_numpy()
                ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1  # the last bucket may go on
                fit = ends[(ends <= INDEX) & (np.cumsum(length + 1)[ends - 1] <= INDEX_LETTERS)]
                full = rest.num_rows > INDEX or int(length.sum()) > INDEX_LETTERS
                if not len(ends) or not full:
                    break
                end = int(fit[-1]) if len(fit) else int(ends[0])
                yield pairs(rest.slice(0, end))
                rest = rest.slice(end)
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    return rows.mapInArrow(search, "word string, near string, near_n long").distinct()


def group_variants(words: DataFrame, times: int = TIMES, bucket: int = BUCKET) -> DataFrame:
    """`word, n, n_near, form, form_n, root` of each row of `word, n`, whose words are distinct.

    A word's form is its near word of largest n (ties: the first in code-point order), if that is at least `times` the
    word's n; else null, as is form_n. root follows forms to the last, and is the word itself if it has none: counts
    grow at each step, so there is a last. An empty table gives an empty one.
    """
    with Staging() as made:
        words = staged(words.select("word", "n"), "spelling-words")
        near = near_words(words, bucket)
        best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        joined = words.join(best, "word", "left")
        is_form = -F.col("best.less") >= F.col("n") * times
        found = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
        found = staged(found, "spelling-forms")
        roots = found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
        moved = True
        while moved:  # chains halve at each step
            on = roots.select(F.col("word").alias("root"), F.col("root").alias("after"))
            roots = staged(roots.join(on, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")), "spelling-roots")
            moved = not roots.filter("moved").isEmpty()
            last, roots = roots, roots.select("word", "root")
        made.release(keep=(found, last))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of the words of `docs`: see count_words and group_variants for odd rows."""
    return group_variants(count_words(docs)).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 by bytes of 8 steps each; letters beyond ASCII are two bytes.
ORACLE = r"""
WITH steps AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{6,}')) AS run
    FROM documents) GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END)) AS b FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS h
  FROM bytes, steps),
cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (
  SELECT DISTINCT word, near, near_n FROM (
    SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most, min_by(near, (-near_n, near)) AS form FROM pairs GROUP BY word),
found AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 5 * w.n THEN form END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
ends AS (
  WITH RECURSIVE walk AS (
    SELECT word, word AS last FROM found
    UNION ALL SELECT walk.word, f.form FROM walk JOIN found f ON walk.last = f.word WHERE f.form IS NOT NULL)
  SELECT walk.word, last AS root FROM walk JOIN found f ON walk.last = f.word WHERE f.form IS NULL)
SELECT found.word, form, root, n, n_near, form_n FROM found JOIN ends ON found.word = ends.word
"""
