"""python tools/wide_columns.py [COLUMNS [ROWS]]: principal components and CCA weights of made-up rows of many columns, with
seconds and the peak memory of the driver's Python; run it under `spark.driver.memory` of 1g."""

import resource
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from panelforge.operators import wide  # noqa: E402


def main(columns: int = 36_000, n: int = 200) -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "1g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        shape = np.random.default_rng(0).normal(size=(5, columns))
        for batch in batches:
            for i in batch["id"].to_pylist():
                rng = np.random.default_rng(i + 1)
                common = rng.normal(size=5) * [9, 7, 5, 4, 3]
                x, y = (common @ shape + rng.normal(size=columns) for _ in range(2))
                yield pa.record_batch([pa.array([i]), pa.array([x], pa.list_(pa.float64())), pa.array([y[: columns // 4]], pa.list_(pa.float64()))], names=["subject", "x", "y"])

    df = spark.range(0, n, 1, 4).mapInArrow(rows, "subject long, x array<double>, y array<double>")
    peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
    began = time.time()
    _, directions, values, total = wide.principal_directions(df, "x", 3)
    print(f"components: {directions.shape}, shares {[f'{v / total:.3f}' for v in values]}, {time.time() - began:.0f} s, {peak()} MB", flush=True)
    began = time.time()
    found = wide.wide_cca(df, "x", "y", 1000.0, 3)
    print(f"CCA: {found['ws_x'].shape}, {found['ws_y'].shape}, rho {[f'{r:.3g}' for r in found['rho']]}, {time.time() - began:.0f} s, {peak()} MB", flush=True)


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
