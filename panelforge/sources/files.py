"""Reading subject tables, time series and voxels, and writing results and models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, `spark.checkpoint.dir`; a local session without one gets a
    temporary folder."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-files-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: computed once, and it survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Cells of a subject table that mean "missing".
MISSING = ["", "#N/A", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null", "-nan", "-NaN", "#NA", "None"]


def read_database(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The subject table of a CSV file with a header; its first column is the subject's id. Missing cells are null."""
    raw = spark.read.option("header", True).csv(path)
    clean = raw.select(*(F.when(~F.trim(c).isin(MISSING), F.trim(c)).alias(c) for c in raw.columns))
    if schema is None:
        kinds = clean.agg(*((F.count(F.col(c).try_cast("double")) == F.count(c)).alias(c) for c in raw.columns)).first()
        return clean.select(*(F.col(c).cast("double").alias(c) if kinds[c] and k else F.col(c) for k, c in enumerate(raw.columns)))
    want = spark.createDataFrame([], schema).schema
    return clean.select(*(F.col(f.name) if isinstance(f.dataType, StringType) else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in want))


def _opened(path: str):
    """A path's file system, through which any executor reaches it, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


def read_timeseries(db: DataFrame, id_col: str, path_cols: list[str]) -> DataFrame:
    """The panel `subject, experiment, roi, series` of the CSV matrices (a row a region) that `path_cols` name.

    A cell that isn't a number is NaN; a null path has no rows, and a file that isn't there is an error. Series of one
    experiment must have one length and one number of regions.

    Scale: subjects and paths are rows that are dealt over the tasks, and each task opens its files one by one, through
    the file system that executors share; the driver sees no path.
    """
    kind = db.schema[id_col].dataType.simpleString()
    named = db.select(F.col(id_col).alias("subject"), F.explode(F.array(*(F.struct(F.lit(c).alias("experiment"), F.col(c).alias("path")) for c in path_cols))).alias("x"))
    named = named.select("subject", "x.experiment", "x.path").filter("path is not null").repartition("path")

    def read(batches):
        import numpy as np
        import pyarrow as pa

        def number(cell: str) -> float:
            try:
                return float(cell)
            except ValueError:
                return float("nan")

        for batch in batches:
            for k, path in enumerate(batch["path"].to_pylist()):
                source, place = _opened(path)
                with source.open_input_stream(place) as file:
                    lines = [x for x in file.read().decode().replace("\r", "").split("\n") if x.strip()]
                series = [np.array([number(c) for c in x.split(",")]) for x in lines]
                same = {c: batch[c].take(pa.array(np.full(len(lines), k))) for c in ("subject", "experiment")}
                yield pa.record_batch([same["subject"], same["experiment"], pa.array(range(len(lines)), pa.int32()), pa.array(series, pa.list_(pa.float64()))], names=["subject", "experiment", "roi", "series"])

    return checked_panel(named.mapInArrow(read, f"subject {kind}, experiment string, roi int, series array<double>"))


def write_timeseries(panel: DataFrame, path: str) -> DataFrame:
    """`subject, experiment, path`: each subject's series (`subject, experiment, roi, series`) as a CSV matrix, a row a
    region in order, written where its task runs. A task that is run again writes the same files."""
    kind = panel.schema["subject"].dataType.simpleString()
    root = path if "://" in path else f"file://{path}"

    def write(group):
        import hashlib

        import pyarrow as pa

        group = group.sort_by("roi")
        subject, experiment = group["subject"][0].as_py(), group["experiment"][0].as_py()
        name = f"{root}/{hashlib.md5(f'{experiment}:{subject}'.encode()).hexdigest()}.csv"
        target, place = _opened(name)
        target.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with target.open_output_stream(place) as out:
            out.write("".join(",".join(map(repr, row)) + "\n" for row in group["series"].to_pylist()).encode())
        return pa.table([group["subject"][:1], group["experiment"][:1], pa.array([name])], names=["subject", "experiment", "path"])

    return kept(panel.groupBy("subject", "experiment").applyInArrow(write, f"subject {kind}, experiment string, path string"), "series-paths")


def checked_panel(panel: DataFrame) -> DataFrame:
    """The panel, or an error if subjects of an experiment differ in regions or length."""
    by_subject = panel.groupBy("experiment", "subject").agg(F.count("*").alias("rois"), F.min(F.size("series")).alias("low"), F.max(F.size("series")).alias("high"))
    odd = by_subject.groupBy("experiment").agg((F.max("rois") != F.min("rois")).alias("a"), (F.max("high") != F.min("low")).alias("b")).filter("a or b")
    found = [r["experiment"] for r in odd.select("experiment").take(5)]
    if found:
        raise ValueError(f"series of different shapes in {found}: truncated?")
    return panel


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """A table of voxels (`subject, map, voxel_id, stat`) or of a mask (`voxel_id, roi`)."""
    return spark.read.parquet(path)


def write_results(folds: DataFrame, path: str) -> None:
    """Fold metrics, their mean and standard error by iteration `i` and `split`, and final tables, as CSV below `path`.

    The final tables, `means` and `sems`, have a row for each iteration and split and a column for each metric.
    """
    from panelforge.operators.summaries import summarize_folds

    def write(df: DataFrame, name: str) -> None:
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")

    write(folds, "folds")
    metrics = [c for c, kind in folds.dtypes if kind in ("double", "bigint", "int") and c not in ("k", "fold", "i")]
    keys = [c for c in ("i", "split") if c in folds.columns]
    summary = summarize_folds(folds, metrics, keys)
    write(summary.orderBy(*keys, "metric"), "summary")
    for name, value in (("means", "mean"), ("sems", "sem")):
        wide = summary.groupBy(*keys).pivot("metric", metrics).agg(F.first(value))
        write(wide.orderBy(*keys) if keys else wide, name)


def write_predictions(db: DataFrame, predictions: DataFrame, id_col: str, path: str) -> None:
    """The subject table with `y_actual`, `y_predictions` and further columns of `predictions`, as CSV."""
    db.join(predictions, id_col, "left").write.mode("overwrite").option("header", True).csv(path)


#: What a biotype model has to hold.
MODEL_KEYS = ("reg", "n_cc", "n_clst", "clusters", "cancorrs", "centroids", "comps_x", "comps_y", "ws_x", "ws_y", "idx_x", "x", "y", "y_names", "cca")


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """A model's tables as Parquet, and its plain values as one JSON text."""
    tables = {k: v for k, v in model.items() if isinstance(v, DataFrame)}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    plain = {k: v.tolist() if hasattr(v, "tolist") else v for k, v in model.items() if k not in tables}
    spark.createDataFrame([(json.dumps({"plain": plain, "tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str, required: tuple = MODEL_KEYS) -> dict:
    """A saved model; an error names the keys that it lacks."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    model = meta["plain"] | {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}
    if lacking := [k for k in required if k not in model]:
        raise KeyError(f"the model lacks {lacking}")
    return model


def dump_matrix(x: DataFrame, y: DataFrame, path: str) -> None:
    """Features and target as Parquet."""
    x.write.mode("overwrite").parquet(f"{path}/x")
    y.write.mode("overwrite").parquet(f"{path}/y")
