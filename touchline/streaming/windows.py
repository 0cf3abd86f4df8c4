"""Summaries of tracks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_summary(stream: DataFrame, at: str = "ts", every: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Rows and mean position of each clip and window; rows that come later than `late` are left out, so state is bounded by the open windows."""
    return stream.withWatermark(at, late).groupBy("clip_id", F.window(at, every).alias("w")).agg(F.count("*").alias("rows"), F.avg("center_x").alias("mean_x"), F.avg("center_y").alias("mean_y")).select("clip_id", F.col("w.start").alias("start"), "rows", "mean_x", "mean_y")


def owner_sessions(stream: DataFrame, at: str = "ts", gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Stretches of an owner's rows with no pause longer than gap."""
    return stream.withWatermark(at, late).groupBy("clip_id", "player_id", F.session_window(at, gap).alias("w")).agg(F.count("*").alias("rows")).select("clip_id", "player_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")
