"""What the operators of this subpackage share: reading tables, the shared folder, staged tables."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and RE2 character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers of this machine find the package wherever the driver was started
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch to a Python worker, where the session sets none.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Have Arrow batches limited by bytes besides rows, as texts may be long; a limit that the session sets stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only a local session that names none gets a temporary folder; a cluster has to name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}")
    found = context.getCheckpointDir()
    if found.startswith("file:/") and not found.startswith("file://"):
        found = "file://" + found[len("file:") :]
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Staging:
    """The tables that `staged` writes while this is open, in one thread: `with Staging() as made: ...`.

    `made.release(keep)` deletes them but for the DataFrames in `keep`; what isn't deleted passes on, at the end of the
    block, to the one that was open before. So operators delete what their results don't read, and a caller who has
    written a result deletes the rest. Without an open one, tables stay in the shared folder.
    """

    def __init__(self):
        self.tables: list[tuple[str, DataFrame]] = []

    def __enter__(self) -> Staging:
        self._outer = _open.get()
        self._token = _open.set(self)
        return self

    def __exit__(self, *_) -> None:
        _open.reset(self._token)
        if self._outer is not None:
            self._outer.tables += self.tables

    def release(self, keep: tuple[DataFrame, ...] = ()) -> None:
        gone = [path for path, df in self.tables if not any(df is k for k in keep)]
        self.tables = [(path, df) for path, df in self.tables if any(df is k for k in keep)]
        release(gone)

    def read_by(self, df: DataFrame) -> bool:
        """Whether `df` reads one of the tables."""
        names = {path.rsplit("/", 1)[-1] for path, _ in self.tables}
        return any(part in names for file in df.inputFiles() for part in file.split("/"))


_open: contextvars.ContextVar[Staging | None] = contextvars.ContextVar("staging", default=None)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: it is computed once, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _open.get() is not None:
        _open.get().tables.append((path, out))
    return out


def release(paths: list[str]) -> None:
    """Delete tables of the shared folder."""
    from pyarrow import fs

    for path in paths:
        files, root = fs.FileSystem.from_uri(path)
        if files.get_file_info(root).type == fs.FileType.Directory:
            files.delete_dir(root)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def slices(batch, column: str, size: int):
    """The rows of an Arrow batch in turn, some at a time: about `size` bytes of `column` together, or one longer row."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    nth = np.cumsum(lengths + 64) // size
    ends = [*(np.flatnonzero(np.diff(nth)) + 1).tolist(), batch.num_rows]
    begin = 0
    for end in ends:
        if end > begin:
            yield batch.slice(begin, end - begin)
        begin = end


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def crc32_remainder(ids, modulus: int):
    """The same in Python, for plain values."""
    import zlib

    return [zlib.crc32(b"" if i is None else str(int(i)).encode()) % modulus for i in ids]
