"""Tables in CSV and JSON files: read with a fixed schema, written with fixed digits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import number

#: Column types of the files of tracked objects.
SCHEMAS = {
    "tracks": "clip_id long, frame long, timestamp double, track_id long, class_name string, confidence double, center_x double, center_y double, width double, height double",
    "ball": "clip_id long, frame long, timestamp double, center_x double, center_y double, confidence double, is_interpolated boolean",
    "player_teams": "clip_id long, track_id long, team string, role string",
}


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as the schema's types: what doesn't parse is null, columns that aren't there too, others go."""
    have = {c.lower(): c for c in raw.columns}

    def one(f: T.StructField):
        if f.name.lower() not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.nullif(F.trim(F.col(f"`{have[f.name.lower()]}`")), F.lit(""))
        if isinstance(f.dataType, (T.LongType, T.IntegerType)):
            return number(c).try_cast(f.dataType).alias(f.name)
        return (number(c) if isinstance(f.dataType, T.DoubleType) else c.try_cast(f.dataType)).alias(f.name)

    return raw.select(*map(one, schema.fields))


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """Files with a header, columns in any order. A required column that is missing is an error that names it. Rows in which one of the columns `keys` is empty or doesn't parse are left out."""
    raw = spark.read.option("header", True).option("multiLine", False).csv(path)
    missing = [c for c in required if c.lower() not in {x.lower() for x in raw.columns}]
    if missing:
        raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
    df = _typed(raw, T.StructType.fromDDL(schema))
    return df.na.drop(subset=list(keys)) if keys else df


def read_csv_with_header(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(table, header) of files whose columns aren't known: types are inferred from all rows, names stay as they are written, in their order."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df, df.columns


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """With a header, doubles with a fixed number of digits, null as the empty text."""
    text = [F.when(F.col(f.name).isNotNull(), F.format_string(f"%.{digits}f", f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema]
    df.select(*text).write.option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def read_json(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """Files of JSON: an object a line, read in parts by many tasks; or, with `whole`, an array of objects or one object a file, over any number of lines, a file in one task. What doesn't parse gives one row of nulls (with `whole`, one a file)."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", whole).json(path).select(*(f.name for f in T.StructType.fromDDL(schema)))


def saved_path(spark: SparkSession, what: str = "table") -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir; on a local master one of our own if that is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its plan ends there, which long chains of operators need."""
    path = saved_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
