"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import SPACE, free_name, quoted, staged, text_or_empty

#: Blocks into which the shuffled documents of a source are cut, by the first hex digits of their shuffle key; ranges of
#: finish times up to 1, and for each doubling beyond.
BLOCK_DIGITS, RANGES, RANGES_BEYOND = 3, 4096, 64


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """`source, source_size` with a target for each source: a share of all sizes by weight.

    Sources by code point, null last, get the weights in turn. No target exceeds `repeats` times its source's size;
    the excess is shared again by weight. Filling the sources in ascending order of cap by weight, the level that the
    rest would reach rises while caps bind and falls after, so its maximum is the common level.

    The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before, here_on = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    return (
        sizes.withColumn("source_rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(here_on))
        .withColumn("target", F.least(F.col("weight") * F.max("level").over(everything), F.col("cap").cast("double")))
        .select("source", "source_rank", "source_size", "budget", "target")
    )


def queue_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The documents with their places in their sources, and the entries that the mix takes.

    Documents: row, doc_id, source, size, source_size, target, and place: the source's words up to and with it, in
    shuffled order. Entries: row, epoch, size, finish, position. A source whose target exceeds its size queues its
    documents again, up to `repeats` times. An entry's finish time is its source's words so far by its target; entries
    go by finish time, and those that fit in the total budget (the sum of all sizes) are taken. `position` is the mix's
    words up to and with the entry.

    Null texts have size 0; a null source is a source, the last. Documents are shuffled by md5 of seed and id; rows of
    one id go by size, so reruns agree, and rows that agree in all are interchangeable. A source without words has
    target 0, and its documents are taken once. Other columns are ignored.

    Scale: texts are read once; narrow rows shuffle by (source, block), so a source with a third of all rows is spread
    over 4096 blocks, and again by range of finish time. Nothing passes through one task but a row for each source
    and a row for each range.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    narrow = staged(
        docs.select(
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_or_empty(text_col)).alias("size"),
            key.alias("key"),
        )
        .withColumn("block", F.substring("key", 1, BLOCK_DIGITS))
        .withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))),  # a join key without nulls
        "queue",
    )
    blocks = narrow.groupBy("of", "block").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    so_far = Window.partitionBy("of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("earlier", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
    targets = source_targets(narrow.groupBy("of").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")).drop("of"), weights, repeats)
    targets = targets.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    within = Window.partitionBy("of", "block").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = staged(
        narrow.join(blocks.drop("source", "words").join(targets, "of"), ["of", "block"])
        .withColumn("place", F.col("earlier") + F.sum("size").over(within))
        .select("row", "doc_id", "source", "source_rank", "key", "size", "source_size", "budget", "target", "place"),
        "placed",
    )
    finish = F.when(F.col("target") > 0, (F.col("epoch") * F.col("source_size") + F.col("place")) / F.col("target")).otherwise(F.col("epoch").cast("double"))
    entries = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("finish", finish)
    entries = entries.withColumn("range", F.when(F.col("finish") < 1, F.floor(F.col("finish") * RANGES)).otherwise(RANGES + F.floor(F.log2("finish") * RANGES_BEYOND)))
    in_order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # at most RANGES rows, and RANGES_BEYOND for each doubling of a finish time
    ranges = entries.groupBy("range").agg(F.sum("size").alias("words")).withColumn("base", F.coalesce(F.sum("words").over(in_order), F.lit(0))).select("range", "base")
    in_range = Window.partitionBy("range").orderBy("finish", "source_rank", "epoch", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    taken = (
        entries.join(F.broadcast(ranges), "range")
        .filter(F.col("base") <= F.col("budget"))
        .withColumn("position", F.col("base") + F.sum("size").over(in_range))
        .filter(F.col("position") <= F.col("budget"))
        .select("row", "epoch", "size", "finish", "position")
    )
    return placed, taken


def mixture_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken (its words in the mix, repeats counted).

    Null and empty texts have size 0 and take 0; each repeated row of an id has a row of its own. See `queue_documents`
    for ties, null sources and scale.
    """
    placed, taken = queue_documents(docs, **options)
    both = placed.select("row", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")).unionByName(taken.select("row", F.col("size").alias("taken")), allowMissingColumns=True)
    return both.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("taken").alias("taken")).drop("row")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, once for each time that it takes them; columns stay as they are.

    Documents without words are taken as their places in the queue come up, since they cost nothing; an empty table gives
    an empty mix. Scale: as `queue_documents`, and one more shuffle of the texts to meet their numbers of copies.
    """
    row = free_name(docs, "row_")
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    _, taken = queue_documents(keyed, row_col=row, **options)
    copies = taken.groupBy(F.col("row").alias(row)).agg(F.count("*").cast("int").alias("n"))
    times = free_name(docs, "times_")
    out = keyed.join(copies.withColumnRenamed("n", times).hint("merge"), row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*map(quoted, docs.columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank, source_size * 3 AS cap FROM s),
w AS (SELECT *, (source_rank - 1) % 3 + 1 AS weight, (SELECT sum(size)::BIGINT FROM d) AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source_rank
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source_rank
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(weight * (SELECT max(level) FROM l), cap::DOUBLE) AS target FROM l),
p AS (SELECT d.*, source_rank, source_size, budget, target,
             sum(size) OVER (PARTITION BY source_rank ORDER BY key, size ROWS UNBOUNDED PRECEDING)::BIGINT AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN target > 0 THEN (epoch * source_size + place)::DOUBLE / target ELSE epoch::DOUBLE END AS finish
      FROM p, range(0, 3) AS g(epoch)),
o AS (SELECT doc_id, size, budget,
             sum(size) OVER (ORDER BY finish, source_rank, epoch, key, size ROWS UNBOUNDED PRECEDING) AS position FROM e),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM o WHERE position <= budget GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN k USING (doc_id)
"""
