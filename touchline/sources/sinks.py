"""Tables of one partition a clip that can be built again and again: a stopped run is repeated, a finished one rewrites nothing.

A build takes the clips that aren't done, sets those apart that break a rule,
overwrites the partitions of the others and then records them as done. What a
stopped run left half-written isn't recorded, so the next run writes those clips
anew; a clip's partition is replaced whole. Errors are rows, not exceptions: a
clip that breaks a rule leaves the others alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DONE = "_done"
SUMMARY = "clip_id string, status string, rows long, message string, settings string, built_at string"


def guarded(path: str, forbidden: tuple[str, ...] = ("outputs",), required: str | None = None) -> str:
    """path, or an error if a part of it is forbidden or the required part is missing."""
    parts = path.replace("\\", "/").split("/")
    for name in forbidden:
        if name in parts:
            raise ValueError(f"Refusing to write inside {name}/: {path}")
    if required and required not in parts:
        raise ValueError(f"Expected a path under {required}/: {path}")
    return path


def build_stamp() -> Column:
    """When the query runs, UTC, ISO 8601 in seconds."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_schema(df: DataFrame, path: str, settings: dict | None = None) -> None:
    """The columns and types of df, and settings, as _schema.json in the folder of its table; readers of the table pass it over."""
    p, fs = _fs(df.sparkSession, f"{path}/_schema.json")
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps({"columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema], "settings": settings or {}}, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def read_schema(spark: SparkSession, path: str) -> dict:
    p, fs = _fs(spark, f"{path}/_schema.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path; an empty one of this schema if there is none."""
    p, fs = _fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)


def finished(spark: SparkSession, path: str, settings: str = "{}") -> DataFrame:
    """(clip_id) of the clips that were built with these settings."""
    return read_optional(spark, f"{path}/{DONE}", SUMMARY).where((F.col("status") == "built") & (F.col("settings") == settings)).select("clip_id").distinct()


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(clip_id, message) of the clips that break a rule, all messages with their number of rows. rules: a message, and what holds for a row that breaks it."""
    each = F.explode(F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(m)) for m, bad in rules.items())), lambda m: m.isNotNull()))
    g = rows.select("clip_id", each.alias("m")).groupBy("clip_id", "m").agg(F.count("*").alias("n"))
    return g.groupBy("clip_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s (%d rows)", "m", "n"))), "; ").alias("message"))


def build_clips(rows: DataFrame, path: str, rules: dict[str, Column] | None = None, settings: dict | None = None, overwrite: bool = False) -> DataFrame:
    """Writes rows as a table by clip_id and returns what became of each clip: SUMMARY, status built, failed (message: the rules it breaks) or skipped (done before with the same settings; none if `overwrite`).

    rows: any columns with clip_id. Reading the table back gives clip_id as text.
    """
    spark, told = rows.sparkSession, json.dumps(settings or {}, sort_keys=True)
    df = rows.withColumn("clip_id", F.col("clip_id").cast("string"))
    done = finished(spark, path, told).where(F.lit(not overwrite))
    bad = violations(df, rules) if rules else spark.createDataFrame([], "clip_id string, message string")
    open_ = df.join(done, "clip_id", "left_anti")
    counts = df.groupBy("clip_id").agg(F.count("*").alias("rows")).join(done.withColumn("_done", F.lit(True)), "clip_id", "left").join(bad, "clip_id", "left")
    status = F.when(F.col("_done").isNotNull(), "skipped").when(F.col("message").isNotNull(), "failed").otherwise("built")
    summary = counts.select("clip_id", status.alias("status"), "rows", F.when(status == "failed", F.col("message")).alias("message"), F.lit(told).alias("settings"), build_stamp().alias("built_at"))
    # what is to be recorded must not change once the data are there: it is kept in the folder of the run first
    runs = f"{path}/_runs/{uuid.uuid4().hex}"
    summary.write.parquet(runs)
    kept = spark.read.schema(SUMMARY).parquet(runs)
    good = open_.join(kept.where("status = 'built'").select("clip_id"), "clip_id", "left_semi")
    good.repartition("clip_id").write.partitionBy("clip_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    write_schema(rows, path, settings)
    kept.where("status = 'built'").coalesce(1).write.mode("append").parquet(f"{path}/{DONE}")
    return kept


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """The table that build_clips wrote, clip_id as text."""
    names = ", ".join(f"`{c['name']}` {c['type'] if c['name'] != 'clip_id' else 'string'}" for c in read_schema(spark, path)["columns"])
    return spark.read.schema(names).parquet(path)
