"""Exact dedup: a two-pass Bloom filter finds texts that may repeat; only their rows shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import SPACE, free_name, staged, text_or_empty

#: Bits of one block of the filter, as Spark's bitmap functions have them (4096 bytes).
BLOCK_BITS = 32768


def possible_repeats(rows: DataFrame, digest: str, bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """First pass: blocks of a Bloom filter of digests that may occur twice, `block int, bitmap binary`.

    Each digest sets two cells of one block. A cell is kept if two rows or more have set it, so that all rows of a
    repeated digest find both of their cells, and a single digest rarely does. Cells are counted before they are
    shuffled. The filter has at most `max_bits` bits whatever the input; beyond that more rows pass as possible
    repeats, and none is lost.
    """
    blocks = max(1, min(max_bits, bits_per_row * rows.count()) // BLOCK_BITS + 1)
    return (
        rows.select(_block(digest, blocks).alias("block"), F.explode(F.array(*_cells(digest))).alias("cell"))
        .groupBy("block", "cell")
        .count()
        .filter("count > 1")
        .groupBy("block")
        .agg(F.bitmap_construct_agg(F.col("cell").cast("long")).alias("bitmap"), F.lit(blocks).alias("blocks"))
    )


def _block(digest, blocks):
    return F.pmod(F.xxhash64(digest), F.lit(blocks)).cast("int")


def _cells(digest):
    h = F.xxhash64(digest, F.lit(1))
    return [h.bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int"), F.shiftrightunsigned(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")]


def _is_set(bitmap, cell):
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(cell / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, cell % 8).bitwiseAND(F.lit(1)) == 1


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, and row, a number of its own
    (that in `row_col`, if given).

    Texts are equal when identical after each run of ASCII white space is one space; a null text is empty. The row
    with the smallest id stays (null ids last). Repeated rows of one id: exactly one of them stays. An empty table
    gives an empty result. Other columns are ignored.

    Scale: texts are read once, and only 32-byte digests go further. A group that holds a thousandth of all rows or
    more is one of at most a thousand, so those are broadcast; the other repeated digests are joined by shuffle.
    """
    digests = staged(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.regexp_replace(text_or_empty(text_col), f"[{SPACE}]+", " "), 256)).alias("digest"),
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        ),
        "digests",
    )
    total = digests.count()
    blocks = max(1, min(max_bits, bits_per_row * total) // BLOCK_BITS + 1)
    bloom = staged(possible_repeats(digests, "digest", bits_per_row, max_bits).select("block", "bitmap"), "bloom")
    # at most max_bits / 8 bytes
    first, second = _cells("digest")
    tested = digests.withColumn("block", _block("digest", blocks)).join(F.broadcast(bloom), "block", "left")
    tested = tested.select("doc_id", "digest", "row", F.coalesce(_is_set(F.col("bitmap"), first) & _is_set(F.col("bitmap"), second), F.lit(False)).alias("maybe"))

    groups = staged(
        tested.filter("maybe")
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
        .filter("n > 1")
        .select("digest", "n", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")),
        "groups",
    )
    hot = max(1000, total // 1000)  # so many rows have at most a thousand groups
    large = F.broadcast(groups.filter(F.col("n") >= hot).select("digest", F.struct("n", "keep_id", "keep_row").alias("large")))
    small = groups.filter(F.col("n") < hot).select("digest", F.struct("n", "keep_id", "keep_row").alias("small"))
    repeats = tested.filter("maybe").join(large, "digest", "left")
    in_large = repeats.filter("large is not null").select("doc_id", "digest", "row", F.col("large").alias("of"))
    in_small = repeats.filter("large is null").drop("large").join(small, "digest", "left").select("doc_id", "digest", "row", F.col("small").alias("of"))
    single = tested.filter("not maybe").select("doc_id", "digest", "row", F.lit(None).cast(in_small.schema["of"].dataType).alias("of"))
    return single.unionByName(in_large).unionByName(in_small).select(
        "doc_id",
        F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("of.keep_id")).alias("keep_id"),
        F.coalesce("of.n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("of.keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `mark_exact_duplicates` doesn't keep; columns and texts stay as they are."""
    row = free_name(docs, "row_")
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    marks = mark_exact_duplicates(keyed, id_col, text_col, row_col=row)
    return keyed.join(marks.filter("kept").select(F.col("row").alias(row)), row, "left_semi").drop(row)


ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM hashed
"""
