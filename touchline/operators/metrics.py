"""Metrics of predictions, class balance and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import share


def confusion_matrix(pred: DataFrame, classes: list[str]) -> DataFrame:
    """A count for each pair of classes, zeros too."""
    spark = pred.sparkSession
    names = spark.createDataFrame([(c,) for c in classes], "actual string")
    grid = names.withColumn("predicted", F.explode(F.array(*map(F.lit, classes))))
    return grid.join(pred.groupBy("actual", "predicted").agg(F.count("*").alias("n")), ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("count"))


def classification_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where a ratio has no ground."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)
    rows = matrix.groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("support"), F.sum(hit).alias("tp"))
    cols = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").alias("found"))
    df = rows.join(cols, "label").withColumn("precision", share(F.col("tp"), F.col("found"))).withColumn("recall", share(F.col("tp"), F.col("support")))
    return df.select("label", "support", "precision", "recall", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def accuracy_macro_f1(matrix: DataFrame) -> DataFrame:
    total = matrix.agg(share(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count"))), F.sum("count")).alias("accuracy"))
    return total.join(classification_report(matrix).agg(F.avg("f1").alias("macro_f1")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse frequency, divided by the mean."""
    all_ = Window.partitionBy()
    g = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    g = g.withColumn("w", F.sum("n").over(all_) / (F.count("*").over(all_) * F.col("n")))
    return g.select("label", "n", (F.col("w") / F.avg("w").over(all_)).alias("weight"))


def clip_split(clips: DataFrame, train: int = 6, val: int = 1) -> DataFrame:
    """Fixed split: the first clips by id train, the next validate, the rest test. Only the first train + val clips, found by a partial top-n, are numbered."""
    ids = clips.select("clip_id").distinct()
    r = F.row_number().over(Window.orderBy("clip_id"))
    first = ids.orderBy("clip_id").limit(train + val).withColumn("_r", r)
    return ids.join(F.broadcast(first), "clip_id", "left").select("clip_id", F.when(F.col("_r") <= train, "train").when(F.col("_r").isNotNull(), "val").otherwise("test").alias("split"))


def split_counts(windows: DataFrame, split: DataFrame, label: str) -> DataFrame:
    return windows.join(split, "clip_id").groupBy("split", F.col(label).alias("label")).agg(F.count("*").alias("windows"))


def long_summary(df: DataFrame, section: str, metrics: dict) -> DataFrame:
    """(section, metric, value) rows of aggregates."""
    one = df.agg(*(c.cast("double").alias(k) for k, c in metrics.items()))
    return one.select(F.lit(section).alias("section"), F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics))).alias("x")).select("section", "x.metric", "x.value")
