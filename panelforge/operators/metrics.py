"""Confusion tables and the classification metrics that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_table(pred: DataFrame, keys: list[str] = ()) -> DataFrame:
    """`actual, predicted, n` by `keys`."""
    return pred.groupBy(*keys, "actual", "predicted").agg(F.count("*").alias("n"))


def classification_metrics(confusion: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, recall, precision, F1 and label-based AUC, macro and micro, from a confusion table.

    Precision without predictions is 0. Macro averages run over the labels seen on either side. AUC of a class is
    (TPR + TNR) / 2; macro averages over the actual classes, micro uses the summed cells. If there is only one actual
    class, all AUCs are 0. Everything is a few rows for each of `keys`.
    """
    cells = confusion.select(*keys, F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("in_actual"), F.lit(0).cast("long").alias("in_predicted"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("in_actual"), F.col("n").alias("in_predicted"), F.lit(0).cast("long").alias("hit")))).alias("x")).select(*keys, "x.*")
    by_label = cells.groupBy(*keys, "label").agg(F.sum("in_actual").alias("p"), F.sum("in_predicted").alias("q"), F.sum("hit").alias("tp"))
    totals = confusion.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    x = by_label.join(totals, list(keys))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, p, q, n = (F.col(c) for c in ("tp", "p", "q", "n"))
    recall, precision = ratio(tp, p), ratio(tp, q)
    f1 = ratio(2 * tp, p + q)
    tnr = ratio(n - p - q + tp, n - p)
    auc = F.when(p > 0, (recall + tnr) / 2)
    classes = F.sum((p > 0).cast("int"))
    micro = F.max(F.col("right") / n)
    cells_tnr = ratio(F.sum(n - p - q + tp), F.sum(n - p))
    return x.groupBy(*keys).agg(
        micro.alias("accuracy"), F.avg(recall).alias("recall_macro"), F.avg(precision).alias("precision_macro"), F.avg(f1).alias("f1_macro"),
        micro.alias("recall_micro"), micro.alias("precision_micro"), micro.alias("f1_micro"),
        F.when(classes > 1, F.avg(auc)).otherwise(0.0).alias("auc_macro"), F.when(classes > 1, (micro + cells_tnr) / 2).otherwise(0.0).alias("auc_micro"),
    )


METRICS = ["accuracy", "recall_macro", "precision_macro", "f1_macro", "recall_micro", "precision_micro", "f1_micro", "auc_macro", "auc_micro"]
