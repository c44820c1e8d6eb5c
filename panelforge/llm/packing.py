"""Packing documents into sequences by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import heapq
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, slices, staged
from panelforge.llm.tokens import SLICE, encoder, public_tokenizer

SEQUENCE = 4096
#: Blocks over which the pieces of one length are ranked.
RANK_BLOCKS = 1024
#: The columns of `assignments`.
PLACE = ("length", "rank_from", "rank_to", "first_sequence", "each", "first_offset", "sequence_tokens")
PIECE = "row long, doc_id long, start long, length int, doc_tokens long, ids_crc32 long, ids binary"


def shortest_pack_first(histogram: dict[int, int], space: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (how many packs, {length: how many pieces of it in each}) that hold all pieces.

    Lengths go longest first, each into the packs with the most space left, or into new packs if it fits nowhere. All
    packs of one pattern are filled alike, so the work depends on the histogram's lengths rather than its counts.
    """
    heap, made = [], 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                free, _, count, pattern = heapq.heappop(heap)
                free = -free
                more = free + (heap[0][0] if heap else 0)  # space beyond the next pattern's
                each = max(1, min(more // length, left // count))
                take = min(count, left // each)
                if take < count:
                    heapq.heappush(heap, (-free, made := made + 1, count - take, pattern))
            else:
                free, pattern = space, {}
                each = 1
                take = left
            left -= take * each
            heapq.heappush(heap, (-(free - each * length), made := made + 1, take, pattern | {length: pattern.get(length, 0) + each}))
    return [(count, pattern) for _, _, count, pattern in sorted(heap)]


def assignments(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, ...]]:
    """For each pattern and length: (length, first rank, end rank, first sequence, pieces in each, offset of the first, tokens in the sequence)."""
    out, next_rank, sequence = [], {}, 0
    for count, pattern in patterns:
        offset, filled = 0, sum(k * v for k, v in pattern.items())
        for length, each in pattern.items():
            rank = next_rank.get(length, 0)
            next_rank[length] = rank + count * each
            out.append((length, rank, rank + count * each, sequence, each, offset, filled))
            offset += length * each
        sequence += count
    return out


def cut_pieces(docs: DataFrame, path: str, pieces: str | None, space: int, end_id: int, id_col: str, text_col: str, with_ids: bool = True) -> DataFrame:
    """The ids of each document in pieces of `space` and a rest."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        found_by = encoder(path, pieces, end_id)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, offsets = found_by.encode(part["text"])
                lengths = np.diff(offsets)
                each = -(-lengths // space)
                of = np.repeat(np.arange(len(lengths)), each)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)) * space
                begin = offsets[of] + start
                size = np.minimum(space, lengths[of] - start)
                data = memoryview(ids.astype("<u4")).cast("B")
                found = [bytes(data[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
                columns = [
                    part["row"].take(pa.array(of)), part["doc_id"].take(pa.array(of)), pa.array(start, pa.int64()), pa.array(size, pa.int32()),
                    pa.array(lengths[of], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array(found if with_ids else [None] * len(found), pa.binary()),
                ]
                yield pa.record_batch(columns, names=[x.split()[0] for x in PIECE.split(", ")])
        found_by.forget()

    return keyed.mapInArrow(cut, PIECE)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = "words", space: int = SEQUENCE, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: row, doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset, sequence_tokens, ids.

    A document is its token ids and the end id; a null text has the end id alone. Documents longer than a sequence are
    cut into whole sequences and a rest. Each id lies in one piece, and pieces fill their sequence from 0 without gaps.
    `ids` (left out on request) holds little-endian unsigned 32-bit ids; `sequence_tokens` says how much of the sequence is filled. Ids may
    be null or repeated: each row is a document of its own. An empty table has no sequences. Other columns are ignored.

    Scale: texts are tokenized once, and ids don't shuffle. The driver gets the histogram, at most `space` rows, and
    broadcasts the patterns' places. Pieces are ranked within their length in blocks, so that a length which many
    pieces have is spread over tasks.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    cut = staged(cut_pieces(docs, tokenizer or public_tokenizer("word_bpe_49k.json"), pieces, space, end_id, id_col, text_col, with_ids).drop(*[] if with_ids else ["ids"]), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = list(zip(*assignments(shortest_pack_first(histogram, space)), strict=True)) or [()] * len(PLACE)
    places = spark.createDataFrame(pa.table({c: pa.array(x, pa.int64()) for c, x in zip(PLACE, found, strict=True)}))

    light = cut.withColumn("block", F.pmod(F.xxhash64("row", "start"), F.lit(RANK_BLOCKS)).cast("int"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = light.groupBy("length", "block").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = (
        light.select("length", "block", "row", "doc_id", "start", "doc_tokens", "ids_crc32")
        .join(blocks, ["length", "block"])
        .withColumn("rank", F.col("earlier") + F.row_number().over(Window.partitionBy("length", "block").orderBy("row", "start")) - 1)
    )
    place = F.broadcast(places).alias("p")
    at = F.col("rank") - F.col("rank_from")
    placed = ranked.alias("c").join(place, (F.col("c.length") == F.col("p.length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))).select(
        "row", "doc_id", "start", F.col("c.length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(at, F.col("each")) * F.col("c.length")).cast("long").alias("offset"),
        F.col("sequence_tokens").cast("long").alias("sequence_tokens"),
    )
    return placed.join(cut.select("row", "start", "ids"), ["row", "start"]) if with_ids else placed
