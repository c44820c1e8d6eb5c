"""Token ids in binary files: a shared zstandard dictionary, a frame for each document, and an offset index.

A file holds, in this order, the magic, the dictionary's SHA-256, a zstandard frame of each document's ids (little-endian
unsigned 32-bit), the index, and a footer that says where the index starts and how many documents it has. The index
holds, as arrays of 64-bit integers, the documents' ids, whether the id is null, where their frames end, and how many
tokens they have. A document is read by two reads of its file and one decompression.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, new_path, slices
from panelforge.llm.tokens import SLICE, encoder, public_tokenizer

MAGIC, FOOTER = b"PFTOKEN1", "<QQ8s"
#: Documents of at most so many characters train the dictionary: so many of them, by hash of id. Bytes of the dictionary.
SAMPLE_CHARS, SAMPLE_DOCS, DICTIONARY = 4000, 1000, 1 << 16
LEVEL = 3
#: Distinct pieces whose ids a worker remembers from task to task, some 200 bytes each.
REMEMBERED = 600_000
#: Uncompressed bytes of ids in one file, beyond which the next begins, and bytes of rows in one batch of a reader.
FILE_BYTES, BATCH_BYTES = 1 << 27, 1 << 23


def filesystem(path: str):
    """The file system of a path and the path in it; executors and driver open files through it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def train_dictionary(docs: DataFrame, tokenizer: str, pieces: str | None, end_id: int, id_col: str, text_col: str) -> bytes:
    """A zstandard dictionary from the ids of a bounded sample of short documents, trained in one task.

    Too small a sample for training is the dictionary itself, as raw content.
    """
    share = min(1.0, 4 * SAMPLE_DOCS / max(1, docs.count()))
    order = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    short = docs.select(order.alias("order"), F.col(text_col).cast("string").alias("text")).filter(F.pmod("order", F.lit(1 << 20)) <= int(share * (1 << 20)))
    sample = short.filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).orderBy("order", "text").limit(SAMPLE_DOCS)

    def train(batches):
        import pyarrow as pa
        import zstandard

        encode, samples = encoder(tokenizer, pieces, end_id).encode, []
        for batch in batches:
            ids, offsets = encode(batch["text"])
            samples += [ids[a:b].astype("<u4").tobytes() for a, b in itertools.pairwise(offsets.tolist())]
        try:
            found = zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
        except zstandard.ZstdError:
            found = b"".join(samples)[:DICTIONARY]
        yield pa.record_batch([pa.array([found], pa.binary())], names=["dictionary"])

    return bytes(sample.select("text").coalesce(1).mapInArrow(train, "dictionary binary").first()[0])


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, pieces: str | None = "spaced", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of `docs` to files below `path`, in ascending order of id, and return the manifest.

    The manifest, itself a Parquet table below `path`, has a row for each file: part and file (their order), name,
    n_docs and n_tokens. Only files that it names count: an attempt that was lost leaves others. Each document is its
    ids and the end id; a null text has the end id alone. Null ids come first; rows of one id keep some order. An empty
    table has an empty manifest. Other columns are ignored.

    Scale: texts shuffle once, by range of id, and are tokenized where they are written. The dictionary has a bounded
    size; a task holds one document at a time and the index of its file.
    """
    bounded_batches(docs.sparkSession)
    tokenizer = tokenizer or public_tokenizer("byte_bpe_50k.json")
    dictionary = train_dictionary(docs, tokenizer, pieces, end_id, id_col, text_col)
    fs, root = filesystem(path)
    fs.create_dir(f"{root}/files", recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        found_by = encoder(tokenizer, pieces, end_id, REMEMBERED)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
        fs, root = filesystem(path)
        part, made = TaskContext.get().partitionId(), []
        out, index, raw, at = None, [], 0, 0

        def close():
            doc_ids, ends, tokens = zip(*index, strict=True)
            arrays = [[x or 0 for x in doc_ids], [int(x is None) for x in doc_ids], ends, tokens]
            out.write(b"".join(np.array(a, dtype="<i8").tobytes() for a in arrays))
            out.write(struct.pack(FOOTER, at, len(index), MAGIC))
            out.close()
            made[-1] += (len(index), sum(tokens))

        for rows in (p for batch in batches for p in slices(batch, "text", SLICE)):
            all_ids, offsets = found_by.encode(rows["text"])
            data = memoryview(all_ids.astype("<u4")).cast("B")
            for doc_id, (a, b) in zip(rows["doc_id"].to_pylist(), itertools.pairwise(offsets.tolist()), strict=True):
                if out is None:
                    name = f"{part:06d}-{len(made):04d}-{uuid.uuid4().hex}"
                    made.append((part, len(made), name))
                    out = fs.open_output_stream(f"{root}/files/{name}")
                    out.write(MAGIC + hashlib.sha256(dictionary).digest())
                    index, raw, at = [], 0, len(MAGIC) + 32
                frame = compress(data[4 * a : 4 * b])
                out.write(frame)
                at, raw = at + len(frame), raw + 4 * (b - a)
                index.append((doc_id, at, b - a))
                if raw >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*made, strict=True)) or [()] * 5
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "file", "name", "n_docs", "n_tokens"])

    ordered.mapInArrow(write, "part int, file int, name string, n_docs long, n_tokens long").write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.parquet(f"{path}/manifest")


def read_index(fs, file: str):
    """The arrays of a file's index (ids, whether null, where frames start and end, tokens) and its dictionary's hash."""
    import numpy as np

    with fs.open_input_file(file) as source:
        size = source.size()
        source.seek(size - struct.calcsize(FOOTER))
        at, n, magic = struct.unpack(FOOTER, source.read(struct.calcsize(FOOTER)))
        source.seek(0)
        head = source.read(len(MAGIC) + 32)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{file} is not a token file")
        source.seek(at)
        doc_ids, null, ends, tokens = np.frombuffer(source.read(32 * n), dtype="<i8").reshape(4, n)
    return doc_ids, null, np.concatenate([[len(head)], ends[:-1]]), ends, tokens, head[len(MAGIC) :]


def read_dictionary(fs, root: str, expected: bytes):
    import zstandard

    with fs.open_input_file(f"{root}/dictionary") as source:
        found = source.read()
    if hashlib.sha256(found).digest() != expected:
        raise ValueError("the dictionary is not the one that the file was written with")
    return zstandard.ZstdCompressionDict(found)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files below `path`: doc_id, start, n_tokens, ids_crc32, ids.

    `start` is the number of ids of all documents before it. Files are read in parallel, each as a stream.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    files = files.repartition(max(1, min(4096, manifest.count())), "name")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        fs, root = filesystem(path)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for name, base in zip(batch["name"].to_pylist(), batch["base"].to_pylist(), strict=True):
                doc_ids, null, begin, end, tokens, digest = read_index(fs, f"{root}/files/{name}")
                expand = zstandard.ZstdDecompressor(dict_data=read_dictionary(fs, root, digest)).decompress
                starts = base + np.concatenate([[0], np.cumsum(tokens)[:-1]])
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/files/{name}") as source:
                    source.read(int(begin[0]))
                    for k in range(len(doc_ids)):
                        ids = expand(source.read(int(end[k] - begin[k])))
                        rows.append((None if null[k] else int(doc_ids[k]), int(starts[k]), len(ids) // 4, zlib.crc32(ids), ids)[: len(names)])
                        held += len(ids)
                        if held > BATCH_BYTES:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(read, schema)


def read_document(path: str, name: str, doc_id: int) -> list[int]:
    """The ids of one document of a file: only its index and its own frame are read."""
    import numpy as np
    import zstandard

    fs, root = filesystem(path)
    doc_ids, null, begin, end, _, digest = read_index(fs, f"{root}/files/{name}")
    at = int(np.flatnonzero((doc_ids == doc_id) & (null == 0))[0])
    with fs.open_input_file(f"{root}/files/{name}") as source:
        source.seek(int(begin[at]))
        frame = source.read(int(end[at] - begin[at]))
    ids = zstandard.ZstdDecompressor(dict_data=read_dictionary(fs, root, digest)).decompress(frame)
    return np.frombuffer(ids, dtype="<u4").tolist()


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write `docs` to files in the shared folder and read them back."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, **options)
    return read_token_files(docs.sparkSession, path, with_ids=False)
