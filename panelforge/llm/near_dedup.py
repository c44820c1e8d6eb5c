"""Near-dedup: ProbMinHash signatures of weighted word shingles, banding, and exact verification of candidates."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelforge.llm.common import Staging, bounded_batches, free_name, slices, staged
from panelforge.llm.words import word_hashes

WORDS, SIMILARITY = 5, 0.8
#: At similarity 0.8, of either kind, a pair of texts shares one of the bands of that kind with probability 0.9999: a
#: text has BANDS of its shingles as weighted by how often they occur, and BANDS of the same with all weights 1.
BANDS, ROWS = 40, 7
REGISTERS = BANDS * ROWS
#: Registers of the finer signatures that nodes of different classes are compared by, a byte each, and how many have to
#: agree: at similarity 0.8 it is 819 of 1024, give or take 13, and four such deviations fewer are let through.
FINE_REGISTERS, FINE_AGREE = 1024, 768
#: Nodes of a band, in and outside its largest class, that one task compares.
MEMBERS, OUTSIDE = 1024, 256
#: Bands that part the nodes of another band further.
FINER = 6
#: Bytes of text that a task signs at a time.
SLICE = 1 << 20


def mixed(x):
    """A 64-bit mixing function on arrays, by shifts and odd multipliers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts):
    """For each text of an Arrow array: the hashes of its shingles, sorted, how often each occurs, and a key of its words.

    Words are parted by ASCII white space, A-Z in lower case. A text of fewer words than a shingle is one shingle; one
    without words has none, and no key.
    """
    import numpy as np
    import xxhash

    h, offsets = word_hashes(texts)
    size = len(h)
    # of each word, the shingle that starts there, with as many words as the text has from there on
    total, lengths = np.zeros(size, np.uint64), np.diff(offsets)
    left = np.repeat(offsets[1:], lengths) - np.arange(size)
    for k in range(WORDS):
        on = np.flatnonzero(left > k)
        total[on] = mixed(total[on] + h[on + k] + np.uint64(k + 1))
    out = []
    for a, b in itertools.pairwise(offsets.tolist()):
        found, counts = np.unique(total[a : max(min(a + 1, b), b - WORDS + 1)], return_counts=True)
        out.append((found, counts, xxhash.xxh3_128_digest(h[a:b].tobytes()) if b > a else None))
    return out


def prob_minhash(sets: list, registers: int = REGISTERS):
    """Signatures of weighted sets, a list of (hashes, weights): for each register the element that arrives first.

    Each element arrives again and again, as a Poisson process whose rate is its weight, each time at a random register.
    An element is done once it is later than the latest register; since registers fill at the same pace, most elements
    are done after a few arrivals. Two sets agree in a register with the probability Jaccard similarity.
    """
    import numpy as np

    out = np.zeros((len(sets), registers), np.uint64)
    many = []
    for i, (hashes, _) in enumerate(sets):
        if len(hashes) == 1:
            out[i] = hashes[0]
        elif len(hashes):
            many.append(i)
    if not many:
        return out
    h = np.concatenate([sets[i][0] for i in many])
    w = np.concatenate([sets[i][1] for i in many]).astype(float)
    of = np.repeat(np.arange(len(many)), [len(sets[i][0]) for i in many])
    first, who = np.full(len(many) * registers, np.inf), np.zeros(len(many) * registers, np.uint64)
    t, state = np.zeros(len(h)), mixed(h + np.uint64(0x9E3779B97F4A7C15))
    while len(h):
        state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
        t -= np.log(((state >> np.uint64(11)).astype(float) + 1) / 9007199254740993.0) / w
        place = of * registers + (mixed(state) % np.uint64(registers)).astype(np.int64)
        sooner = np.flatnonzero(t < first[place])
        np.minimum.at(first, place[sooner], t[sooner])
        won = sooner[t[sooner] == first[place[sooner]]]
        who[place[won]] = h[won]
        left = np.flatnonzero(t < first.reshape(-1, registers).max(1)[of])
        h, w, of, t, state = h[left], w[left], of[left], t[left], state[left]
    out[many] = who.reshape(-1, registers)
    return out


def similarities(a, a_times, b, b_times) -> tuple[float, float]:
    """Jaccard and probability Jaccard similarity of two sorted sets with multiplicities (empty: all are 1)."""
    import numpy as np

    both, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    plain = len(both) / max(1, len(a) + len(b) - len(both))
    if not len(a_times) and not len(b_times):
        return plain, plain
    x = a_times.astype(float) if len(a_times) else np.ones(len(a))
    y = b_times.astype(float) if len(b_times) else np.ones(len(b))
    p, q = x[in_a], y[in_b]
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    # of an element i of both, the sum over all j of max(x_j / x_i, y_j / y_i); those of one side only add to one sum
    ratio = p / q
    above = x.sum() - p.sum() + p.sum() - np.concatenate([[0], np.cumsum(p)])[np.searchsorted(ratio, ratio, "left")]
    below = y.sum() - q.sum() + np.concatenate([[0], np.cumsum(q)])[np.searchsorted(ratio, ratio, "left")]
    return plain, float((1 / (above / p + below / q)).sum())


def both_signatures(sets: list, registers: int = REGISTERS):
    """Signatures by the weights of `sets`, and with all weights 1; for sets without repeats they are the same."""
    import numpy as np

    weighted = prob_minhash(sets, registers)
    plain, repeats = weighted.copy(), [i for i, (_, w) in enumerate(sets) if len(w) and np.max(w) > 1]
    if repeats:
        plain[repeats] = prob_minhash([(sets[i][0], np.ones(len(sets[i][0]))) for i in repeats], registers)
    return weighted, plain


def signed(docs: DataFrame) -> DataFrame:
    """`row, doc_id, text` with the key of each text's words (null if it has none) and its bands, the weighted ones and
    then the plain ones, which are the same for a text without repeated shingles."""

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = shingles(batch["text"])
                both = []
                for signature in both_signatures([f[:2] for f in found]):
                    bands = np.zeros((len(found), BANDS), np.uint64)
                    for k in range(ROWS):
                        bands = mixed(bands + signature[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64)[None])
                    both.append(bands)
                bands = np.concatenate(both, 1)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(m).view(np.int64).ravel()))
                yield pa.record_batch([batch["row"], batch["doc_id"], batch["text"], pa.array([f[2] for f in found], pa.binary()), lists(bands)], names=["row", "doc_id", "text", "key", "bands"])

    return docs.mapInArrow(sign, "row long, doc_id long, text string, key binary, bands array<long>")


def of_large_groups(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Left join on `key`, of which `right` has one row; `n` is how many rows of `left` have it. There are `total` texts.

    Keys that a thousandth as many rows as texts or more have are at most a thousand for each row that `left` has of a
    text (2 * BANDS, or 2 * BANDS * FINER, at most): they are broadcast. The others are shuffled.
    """
    values = [c for c in right.columns if c != key]
    limit = max(1000, total // 1000)
    named = right.select(key, F.struct(*values).alias("_of"))
    large = left.join(F.broadcast(named.filter(F.col(f"_of.{n}") >= limit)), key, "left")
    small = large.filter("_of is null").drop("_of").join(named.filter(F.col(f"_of.{n}") < limit), key, "left")
    return large.filter("_of is not null").unionByName(small).select(*left.columns, *(F.col(f"_of.{c}").alias(c) for c in values))


@F.pandas_udf(DoubleType())
def verified(a: pd.Series, a_times: pd.Series, b: pd.Series, b_times: pd.Series) -> pd.Series:
    """The larger of the two similarities of each pair."""
    import numpy as np

    read = lambda x, kind: np.frombuffer(x, dtype=kind)
    return pd.Series([max(similarities(read(p, "<u8"), read(s, "<u4"), read(q, "<u8"), read(t, "<u4"))) for p, s, q, t in zip(a, a_times, b, b_times, strict=True)], dtype=float)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """`row, hashes, times` of each `row, text`; times is empty if all are 1."""

    def cut(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = shingles(batch["text"])
                hashes = pa.array([f[0].astype("<u8").tobytes() for f in found], pa.binary())
                times = pa.array([f[1].astype("<u4").tobytes() if (f[1] > 1).any() else b"" for f in found], pa.binary())
                yield pa.record_batch([batch["row"], hashes, times], names=["row", "hashes", "times"])

    return texts.select("row", "text").mapInArrow(cut, "row long, hashes binary, times binary")


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs `a, b` of texts that are similar enough, staged."""
    one = sets.select(F.col("row").alias("a"), F.col("hashes").alias("a_hashes"), F.col("times").alias("a_times"))
    other = sets.select(F.col("row").alias("b"), F.col("hashes").alias("b_hashes"), F.col("times").alias("b_times"))
    joined = pairs.join(one, "a").join(other, "b")
    score = verified("a_hashes", "a_times", "b_hashes", "b_times")
    return staged(joined.select("a", "b", score.alias("score")).filter(F.col("score") >= similarity - 1e-9), "links")


def fine_signatures(sets: DataFrame) -> DataFrame:
    """`row, fine`: a byte of each register of a long signature by weights, and of one with all weights 1 if that differs."""

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                hashes = [np.frombuffer(x, "<u8") for x in batch["hashes"].to_pylist()]
                times = [np.frombuffer(x, "<u4") if x else np.ones(len(h)) for x, h in zip(batch["times"].to_pylist(), hashes, strict=True)]
                weighted, plain = ((mixed(s) & np.uint64(255)).astype(np.uint8) for s in both_signatures(list(zip(hashes, times, strict=True)), FINE_REGISTERS))
                fine = [w.tobytes() + (b"" if (w == p).all() else p.tobytes()) for w, p in zip(weighted, plain, strict=True)]
                yield pa.record_batch([batch["row"], pa.array(fine, pa.binary())], names=["row", "fine"])

    return sets.mapInArrow(sign, "row long, fine binary")


def compared(open_: DataFrame, bands: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """`a, b`: of each band of `open_` (band, row, part, largest), the pairs of a node outside the largest class and a node
    of another class that their finer signatures leave possible; each pair in the first band that it shares.

    Blocks of a band's nodes meet blocks of its outside nodes, so a large band is many tasks; only what is left possible
    becomes rows.
    """
    rows = open_.select("row").distinct()
    fine = staged(fine_signatures(sets.join(rows, "row", "left_semi")).join(bands, "row"), "fine")
    sizes = open_.groupBy("band").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"), F.ceil(F.count(F.when(F.col("part") != F.col("largest"), 1)) / OUTSIDE).cast("int").alias("outs"))
    sized = of_large_groups(open_, sizes.join(open_.groupBy("band").agg(F.count("*").alias("size")), "band"), "band", "size", total)
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = sized.withColumn("block", own("blocks")).withColumn("out", every("outs")).withColumn("asks", F.lit(False))
    outside = sized.filter("part != largest").withColumn("out", own("outs")).withColumn("block", every("blocks")).withColumn("asks", F.lit(True))
    columns = ["band", "block", "out", "row", "part", "asks"]
    both = members.select(columns).unionByName(outside.select(columns)).join(fine, "row")

    def pairs(group):
        import numpy as np
        import pyarrow as pa

        asks, row, part = (group[c].to_numpy() for c in ("asks", "row", "part"))
        data = np.frombuffer(b"".join(x if len(x) > FINE_REGISTERS else x + x for x in group["fine"].to_pylist()), np.uint8).reshape(len(row), -1)
        keys = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(row), -1)
        weighted, plain = np.ascontiguousarray(data[:, :FINE_REGISTERS]), np.ascontiguousarray(data[:, FINE_REGISTERS:])
        repeats = (weighted != plain).any(1)
        place = int(np.flatnonzero(keys[0] == group["band"][0].as_py())[0]) % BANDS
        # the weighted and the plain bands before this one
        early = [np.ascontiguousarray(keys[:, :place]), np.ascontiguousarray(keys[:, BANDS : BANDS + place])]
        inside, found = np.flatnonzero(~asks), ([], [])
        for i in np.flatnonzero(asks):
            other = inside[part[inside] != part[i]]
            like = (weighted[other] == weighted[i]).sum(1) >= FINE_AGREE
            left = np.flatnonzero(~like & (repeats[other] | repeats[i]))
            like[left] = (plain[other[left]] == plain[i]).sum(1) >= FINE_AGREE
            other = other[like]
            for a in early:
                for b in early:
                    other = other[~(a[other] == b[i]).any(1)]
            found[0].append(np.minimum(row[other], row[i]))
            found[1].append(np.maximum(row[other], row[i]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(found[0] or none), "b": np.concatenate(found[1] or none)})

    return both.groupBy("band", "block", "out").applyInArrow(pairs, "a long, b long")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (row, label) after `links` (a, b) have joined classes: each class takes its least label. A label is a
    struct with a `row` of its own, and names the class it is the label of.

    Links become edges between classes. Each class points to its least neighbour, or itself if that is less; pointers are
    followed to their ends, and edges are drawn between the ends, until none is left. Each round at least halves the
    classes that have an edge, so rounds are few on chains too.
    """
    side = lambda k, name: labels.select(F.col("row").alias(k), F.col("label").alias(name))
    ends = links.join(side("a", "x"), "a").join(side("b", "y"), "b").filter("x.row != y.row")
    edges = staged(ends.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*").distinct(), "edges")
    while not edges.isEmpty():
        points = staged(edges.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to")), "points")
        while True:
            further = points.select(F.col("x.row").alias("of"), F.col("to").alias("next"))
            points = staged(points.join(further, F.col("to.row") == F.col("of")).select("x", F.col("next").alias("to"), (F.col("next.row") != F.col("to.row")).alias("moved")), "points")
            if points.filter("moved").isEmpty():
                break
        ending = lambda c: points.select(F.col("x.row").alias(f"{c}_of"), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        on = lambda c: F.col(f"{c}.row") == F.col(f"{c}_of")
        labels = staged(labels.join(ending("label"), on("label"), "left").select("row", F.coalesce("label_to", "label").alias("label")), "labels")
        drawn = edges.join(ending("x"), on("x")).join(ending("y"), on("y")).filter("x_to.row != y_to.row")
        edges = staged(drawn.select(F.col("x_to").alias("x"), F.col("y_to").alias("y")).distinct(), "edges")
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: row, doc_id, class_id, kept, n_copies.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles, or the probability Jaccard
    similarity of the shingles weighted by how often they occur, is `similarity` or more; a class is what links connect.
    `class_id` is the smallest id in the class (null ids last), and of each class one row with it is kept. Texts with
    the same words are copies, `n_copies` with the row itself. A null text, and one without words, is a class of its own.
    Ids may be null or repeated; an empty table gives an empty result; other columns are ignored.

    Candidates share a band of their signatures, by weights or without. Copies are one node. In each band, first all nodes are verified
    against one of them; then those in other classes against the node with most links, in the band and in the parts that
    agree in a further band; at last each node outside the band's largest class against all nodes of other classes,
    except pairs that finer signatures rule out. Of the candidates with a similarity of just 0.8, the finer signatures
    rule out some 3 in 100,000, besides the 1 in 10,000 that share no band; the more similar, the fewer. A band of
    thousands of similar texts makes few pairs for each; the last step compares a band's nodes outside its largest class
    with all of its nodes, in blocks, so its work is the product of the two.

    Scale: signatures, shingles and pairs stay with their tasks; keys and bands that many rows share are aggregated
    before they shuffle, and joined by a broadcast of at most a thousand of them. Nothing but counts comes to the driver.
    """
    bounded_batches(docs.sparkSession)
    with Staging() as made:
        tagged = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        table = staged(signed(tagged), "signed")
        total = table.count()
        label = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
        keys = staged(table.filter("key is not null").groupBy("key").agg(F.count("*").alias("n_copies"), F.min(label).alias("label")), "keys")
        nodes = keys.select(F.col("label.row").alias("row"), "label")
        banded = table.select("row", F.explode(F.array_distinct("bands")).alias("band")).join(nodes.select("row"), "row", "left_semi")
        order = F.struct(F.xxhash64("row").alias("order"), "row")
        shared = staged(banded.groupBy("band").agg(F.count("*").alias("n"), F.min(order).alias("centre")).filter("n > 1"), "bands")
        member = of_large_groups(banded, shared.select("band", "n", F.col("centre.row").alias("centre")), "band", "n", total)
        member = staged(member.filter("n is not null"), "members")
        involved = table.select("row", "text").join(member.select("row").distinct().hint("merge"), "row", "left_semi")
        sets = staged(shingle_sets(involved), "shingles")
        pair = lambda x, y: (F.least(F.col(x), F.col(y)).alias("a"), F.greatest(F.col(x), F.col(y)).alias("b"))

        tried = staged(member.filter("row != centre").select(*pair("row", "centre")).distinct(), "pairs")
        links = verify(tried, sets, similarity)
        labels = components(nodes, links)
        for step in ("band", "finer", "all others"):
            part = lambda df: df.join(labels.select("row", F.col("label.row").alias("part")), "row", "left").withColumn("part", F.coalesce("part", "row"))
            sides = part(member.select("band", "row", "n"))
            # bands whose nodes are in several classes, with their largest class
            classes = sides.groupBy("band", "part").agg(F.count("*").alias("size"), F.max("n").alias("n"))
            split = classes.groupBy("band").agg(F.count("*").alias("parts"), F.max("n").alias("n"), F.max_by("part", F.struct("size", "part")).alias("largest"))
            split = staged(split.filter("parts > 1").select("band", "n", "largest"), "split")
            if split.isEmpty():
                break
            open_ = staged(of_large_groups(sides.drop("n"), split, "band", "n", total).filter("largest is not null"), "open")
            if step != "all others":
                degree = links.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count("*").alias("degree"))
                ranked = open_.join(degree, "row", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
                if step == "finer":
                    further = F.explode(F.slice("bands", 1, FINER)).alias("further")
                    ranked = ranked.join(table.select("row", further), "row").withColumn("band", F.struct("band", "further"))
                ranked = staged(ranked.select("band", "row", "part", "degree"), "ranked")
                hub = ranked.groupBy("band").agg(F.count("*").alias("n"), F.max_by(F.struct("row", "part"), F.struct("degree", "row")).alias("hub")).filter("n > 1")
                near = of_large_groups(ranked.drop("degree"), hub, "band", "n", total).filter("hub.part != part")
                new = near.select(*pair("row", "hub.row"))
            else:
                new = compared(open_, table.select("row", "bands"), sets, total)
            new = staged(new.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
            if new.isEmpty():
                continue
            found = verify(new, sets, similarity)
            labels = components(labels, found)
            links, tried = links.unionByName(found), tried.unionByName(new)
        classes = keys.withColumn("row", F.col("label.row")).join(labels.withColumnRenamed("label", "class"), "row", "left")
        classes = staged(classes.select("key", "n_copies", F.coalesce("class", "label").alias("class")), "classes")
        rows = staged(table.select("row", "doc_id", "key"), "rows")
        made.release((rows, classes))
    out = of_large_groups(rows, classes, "key", "n_copies", total)
    alone = F.col("class").isNull()
    return out.select(
        "row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class.doc_id")).alias("class_id"),
        F.coalesce(F.col("class.row") == F.col("row"), F.lit(True)).alias("kept"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each class; columns stay as they are."""
    row = free_name(docs, "row_")
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = near_duplicates(keyed, row_col=row, **options)
    return keyed.join(found.filter("kept").select(F.col("row").alias(row)).hint("merge"), row, "left_semi").drop(row)
