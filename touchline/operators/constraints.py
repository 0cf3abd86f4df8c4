"""Constraints that a plan checks as it runs.

What breaks a constraint is gathered by one aggregate into one row; if there is
any, that row raises an error that names it. The row is joined to the data by a
filter, so the optimizer can't drop the check with a column that nobody reads.
The names in a message are the first NAMED by order; how many there are is told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMED = 20


def required(df: DataFrame, bad: DataFrame, name: str, says: str) -> DataFrame:
    """df, or an error `says: a, b, ...` if bad has rows; `name` is bad's column of names."""
    n, rank = F.col(name).cast("string"), F.row_number().over(Window.orderBy(F.col(name).cast("string")))
    first = bad.select(n.alias(name)).distinct().withColumn("_rank", rank).where(F.col("_rank") <= NAMED)
    one = first.agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("_names"))
    total = bad.select(n.alias(name)).distinct().agg(F.count("*").alias("_bad"))
    told = F.concat(F.lit(f"{says}: "), "_names", F.when(F.col("_bad") > NAMED, F.format_string(" and %d more", F.col("_bad") - NAMED)).otherwise(""))
    fine = F.when(F.col("_bad") == 0, True).otherwise(F.raise_error(told).cast("boolean"))
    return df.join(F.broadcast(one.join(total))).where(fine).drop("_names", "_bad")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(name, n): keys that more than one row has, joined by a slash."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return g.select(F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("name"), "n")


def unique(df: DataFrame, *keys: str, says: str = "Duplicate") -> DataFrame:
    """df, or an error that names the keys of several rows."""
    return required(df, duplicates(df, *keys), "name", says)


def covered(df: DataFrame, known: DataFrame, key: str, says: str) -> DataFrame:
    """df, or an error that names the keys of df that `known` lacks."""
    return required(df, df.select(key).distinct().join(known.select(key), key, "left_anti"), key, says)


def lookup(df: DataFrame, key: str, value: Column | str | int, what: str = "Clip ID") -> DataFrame:
    """The one row of df whose key is value; an error if there is none or more than one."""
    found = df.where(F.col(key) == (F.lit(value) if not isinstance(value, Column) else value))
    n = found.agg(F.count("*").alias("_n"))
    wrong = F.when(F.col("_n") == 0, F.raise_error(F.lit(f"{what} not found: {value}"))).otherwise(F.raise_error(F.lit(f"Duplicate {what}: {value}"))).cast("boolean")
    return n.where(F.when(F.col("_n") == 1, True).otherwise(wrong)).join(found).drop("_n")
