"""What to fetch: duplicates by any of many keys, priorities, diversity, seeded samples.

An inventory's rows are described by columns whose names vary; what a column says
is told by tokens in its name. Values are compared as normalised paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import tokens

#: Fixed tokens of column names, and of values.
IDENTITY, PARENT, HALF = ("clip", "video", "path", "file", "name", "slug", "id"), ("parent", "folder", "directory", "path"), ("half", "period")
TRUE = ("1", "true", "yes", "y", "ok", "available", "readable", "exists", "present")
#: Fixed scores: what a row has, by tokens of names and of values.
SCORES = (
    (100, "readable_video", ("readable", "video"), ("readable", "ok", "available", "exists")),
    (50, "ready_for_video_pilot", ("status", "pilot"), ("ready_for_video_pilot",)),
    (20, "nearby_annotation_files", ("annotation", "label"), ("nearby", "available", "exists", ".json", ".xml", ".csv")),
    (10, "tracking_files_available", ("tracking", "track"), ("available", "exists", ".json", ".csv", ".pkl")),
)


def normalised(c: Column | str) -> Column:
    """A value as a path: without quotes and slashes around it, with single forward slashes, in lower case; empty for null."""
    text = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), '^"+|"+$', ""), "^'+|'+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.translate(text, "\\", "/"), "/+", "/"), "^/|/$", ""))


def _named(df: DataFrame, words: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if any(w in c.lower() for w in words)]


def _has(df: DataFrame, names: tuple[str, ...], values: tuple[str, ...]) -> Column:
    """Whether a column of such a name says yes or holds one of the values."""
    out = F.lit(False)
    for c in _named(df, names):
        text = F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
        out = out | F.trim(text).isin(*TRUE)
        for v in values:
            out = out | F.contains(text, F.lit(v))
    return out


def _filled(c: str) -> Column:
    return F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))


def _folder(x: Column) -> Column:
    return F.when(F.instr(x, "/") > 0, F.regexp_replace(x, "/[^/]*$", "")).otherwise(x)


def _first(df: DataFrame, words: tuple[str, ...], f) -> Column:
    """f of the first column (of such a name, in order of the table) that isn't empty; null without one."""
    cols = [F.when(_filled(c).isNotNull(), f(c)) for c in _named(df, words)]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def described(inventory: DataFrame) -> DataFrame:
    """inventory with parent_group, duration_bucket, half, priority_score and what the score counts (reasons)."""
    df = inventory
    seconds = lambda c: F.col(c).cast("string").try_cast("double")
    bucket = lambda c: F.when(F.expr(f"try_cast(trim(cast(`{c}` AS string)) AS double)").isNull(), normalised(c)).when(seconds(c) < 300, "short").when(seconds(c) < 1800, "medium").otherwise("long")
    halves = [F.nullif(normalised(c), F.lit("")) for c in _named(df, HALF)]
    for c in _named(df, IDENTITY):
        halves.append(F.when(F.contains(normalised(c), F.lit("h1")), "h1").when(F.contains(normalised(c), F.lit("h2")), "h2"))
    has = [(_has(df, n, v), score, word) for score, word, n, v in SCORES]
    total = sum((F.when(h, score).otherwise(0) for h, score, _ in has), F.lit(0))
    group = F.coalesce(_first(df, PARENT, lambda c: _folder(normalised(c))), _first(df, IDENTITY, lambda c: _folder(normalised(c))), F.lit("unknown_parent"))
    return df.withColumns({"parent_group": group, "duration_bucket": F.coalesce(_first(df, ("duration",), bucket), F.lit("unknown_duration")), "half": F.coalesce(*halves, F.lit("unknown_half")), "priority_score": total.cast("int"), "reasons": tokens(*((h, word) for h, _, word in has))})


def local_duplicates(inventory: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """(key, matching_local_clip_id) of the inventory's rows that are there already: one of their identifying values, or its last part, equals a local clip's id, both normalised. Of several, the first column's value counts, whole before its last part.

    Each row gives two candidates a column; they meet the local ids in one join on
    equal text, and the least place of each row that met one is kept.
    """
    values = []
    for i, c in enumerate(_named(inventory, IDENTITY)):
        text = normalised(c)
        values += [F.struct(F.lit(2 * i).alias("place"), text.alias("value")), F.struct(F.lit(2 * i + 1).alias("place"), F.substring_index(text, "/", -1).alias("value"))]
    each = inventory.select(key, F.explode(F.array(*values)).alias("x")).select(key, "x.*").where("value <> ''").distinct()
    names = local.select(normalised("clip_id").alias("value"), F.col("clip_id").cast("string").alias("_id")).where("value <> ''").groupBy("value").agg(F.max("_id").alias("_id"))
    met = each.join(names, "value")
    return met.groupBy(key).agg(F.min(F.struct("place", "_id")).alias("x")).select(key, F.col("x._id").alias("matching_local_clip_id"))


def download_plan(inventory: DataFrame, local: DataFrame, key: str, target: int) -> DataFrame:
    """Every row of the inventory (`key` is unique) with what is recommended, and a rank and reason for the `target` rows to fetch.

    Rows that are there already are excluded, those that nothing identifies are left
    to a reviewer. The others come by turns: of each group (folder, duration, half)
    the row of the highest priority, then the second of each, and so on; inside a
    turn groups come by name. Ties go by folder, duration, half, then by the first
    identifying value and the key.
    """
    dup = local_duplicates(inventory, local, key)
    df = described(inventory).join(dup, key, "left")
    first = _first(inventory, IDENTITY, normalised)
    recommended = F.when(F.col("matching_local_clip_id").isNotNull(), "exclude_exact_duplicate").when(first.isNotNull(), "candidate_for_new_download").otherwise("manual_review_required")
    df = df.withColumns({"is_exact_local_duplicate": F.col("matching_local_clip_id").isNotNull().cast("int"), "download_recommendation": recommended, "_group": F.concat_ws("|", "parent_group", "duration_bucket", "half"), "_first": F.coalesce(first, F.lit(""))})
    new = df.where("download_recommendation = 'candidate_for_new_download'")
    turn = F.row_number().over(Window.partitionBy("_group").orderBy(F.desc("priority_score"), "_first", key))
    # the target's rows are taken by a partial top-n, and only they are numbered in one task
    chosen = new.withColumn("_turn", turn).orderBy("_turn", "_group").limit(max(0, target)).withColumn("selection_rank", F.row_number().over(Window.orderBy("_turn", "_group"))).select(key, "selection_rank")
    why = F.concat_ws(";", F.nullif("reasons", F.lit("")), F.concat(F.lit("parent_group="), "parent_group"), F.concat(F.lit("duration_bucket="), "duration_bucket"), F.concat(F.lit("half="), "half"))
    out = df.join(chosen, key, "left").withColumn("selection_reason", F.when(F.col("selection_rank").isNotNull(), why))
    return out.drop("_group", "_first", "reasons")


def plan_summary(plan: DataFrame, target: int) -> DataFrame:
    """One row: candidates, duplicates, those for review, those selected, and the target."""
    what = lambda k: F.count_if(F.col("download_recommendation") == k)
    return plan.agg(F.count("*").alias("candidates_considered"), what("exclude_exact_duplicate").alias("exact_duplicates_excluded"), what("manual_review_required").alias("manual_review_candidates"), F.count("selection_rank").alias("new_download_candidates_selected"), F.lit(target).alias("requested_target"))


def clip_slug(game_id: Column, half: Column, resolution: str) -> Column:
    """A clip's id: the game's, slashes as two underscores, spaces and hyphens as one, with half and resolution."""
    safe = F.regexp_replace(F.translate(F.regexp_replace(game_id, r"[/\\]", "__"), " -", "__"), "^$", "")
    return F.concat(safe, F.lit("__h"), half.cast("string"), F.lit(f"_{resolution}"))


def seeded_sample(df: DataFrame, n: int, *keys: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    """n rows that a seeded hash of the keys picks (all, if there are fewer), the same in every run and partitioning: each task keeps its n least, so there is no global sort. order: another seeded key."""
    return df.orderBy(F.xxhash64(*(F.col(k).cast("string") for k in keys), F.lit(seed)) if order is None else order, *keys).limit(n)


def manifest_of(videos: DataFrame, n: int, resolution: str, prefix: str, split: str = "valid", seed: int = 42, order: Column | None = None) -> DataFrame:
    """A manifest of n halves sampled from videos (game_id, half, video_path) whose game begins with prefix. Fewer than n are an error."""
    rows = videos.where(F.col("game_id").startswith(prefix)).withColumn("clip_id", clip_slug(F.col("game_id"), F.col("half"), resolution))
    there = rows.agg(F.count("*").alias("_n"))
    enough = F.when(F.col("_n") >= n, True).otherwise(F.raise_error(F.format_string(f"found %d local video(s), need {n}", "_n")).cast("boolean"))
    competition = prefix.rstrip("/")
    picked = seeded_sample(rows, n, "clip_id", seed=seed, order=order)
    return picked.join(F.broadcast(there)).where(enough).select("clip_id", F.lit(split).alias("split"), F.lit(competition).alias("competition"), "game_id", "half", "video_path", F.lit(True).alias("enabled"), F.lit("local_manifest").alias("notes"))
