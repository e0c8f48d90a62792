"""Filters and joins over frames and episodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.functions.tokens import folder_key


def succeeded(path: Column) -> Column:
    """Whether a path tells of success."""
    return path.rlike("success")


def keep_ranges(frames: DataFrame, ranges: DataFrame | None, key: str = "episode_id", order: str = "frame_index") -> DataFrame:
    """Frames within [start, stop) of some range of their episode. Without a table all stay; an episode without a range goes.

    The ranges of an episode are gathered into one row, so the join is by key alone, however ranges overlap.
    """
    if ranges is None:
        return frames
    held = ranges.groupBy(key).agg(F.collect_list(F.struct("start", "stop")).alias("ranges__"))
    return frames.join(held, key).where(F.exists("ranges__", lambda r: (r["start"] <= F.col(order)) & (F.col(order) < r["stop"]))).drop("ranges__")


def pairing(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Left rows that have a partner, and those that have none."""
    keys = right.select(key)
    return left.join(keys, key, "left_semi"), left.join(keys, key, "left_anti")


def count_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose numbers of rows differ between two tables."""
    a, b = left.groupBy(key).agg(F.count("*").alias("n_left")), right.groupBy(key).agg(F.count("*").alias("n_right"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("n_left", F.lit(0)).cast("long").alias("n_left"), F.coalesce("n_right", F.lit(0)).cast("long").alias("n_right"))
    return both.where("n_left <> n_right")


def folder_summary(episodes: DataFrame, folder: str) -> DataFrame:
    """(folder, n_episodes, date, batch): how many episodes a batch folder holds, for an order by date and batch; other names sort last."""
    date, batch = folder_key(F.col(folder))
    return episodes.groupBy(folder).agg(F.count("*").alias("n_episodes")).select(folder, "n_episodes", date.alias("date"), batch.alias("batch"))


def isolate(frames: DataFrame, fn: Callable, schema: str, key: str = "episode_id") -> tuple[DataFrame, DataFrame]:
    """What ``fn`` makes of each episode, and (key, error) of those in which it failed; a failing episode stops no other.

    fn: the frames of an episode as a pandas table -> a table of the schema, which has the key first.
    """
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def run(episode):
        import pandas as pd

        try:
            return fn(episode)[names].assign(error__=None)
        except Exception as e:  # whatever goes wrong in an episode is that episode's result
            return pd.DataFrame({names[0]: [episode[key].iloc[0]]}).reindex(columns=names).assign(error__=f"{type(e).__name__}: {e}")

    out = frames.groupBy(key).applyInPandas(run, f"{schema}, error__ string")
    return out.where("error__ IS NULL").drop("error__"), out.where("error__ IS NOT NULL").select(F.col(names[0]).alias(key), F.col("error__").alias("error"))


def require_columns(files: DataFrame, names: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files (with an array of their column names) that have all required columns, and the others."""
    has = F.size(F.array_except(F.array(*map(F.lit, required)), F.col(names))) == 0
    return files.where(has), files.where(~has)


def validity(n: Column, has_key: Column, least: int = 2) -> Column:
    """Why an episode cannot be used; null if it can."""
    return F.when(~has_key, "a dataset is missing").when(n == 0, "empty").when(n < least, "too short")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """The value from a table, or the key itself."""
    return df.join(table.select(key, F.col(value).alias("v__")), key, "left").withColumn(value, F.coalesce("v__", F.col(key))).drop("v__")


def three_way(raw: DataFrame, middle: DataFrame, key: str) -> DataFrame:
    """Rows of the middle table, each with whether the raw table has its key."""
    return middle.join(raw.select(key).distinct().withColumn("raw__", F.lit(True)), key, "left").withColumn("has_raw", F.coalesce("raw__", F.lit(False))).drop("raw__")


def require_partners(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The left rows; one without a partner is an error that stops the run."""
    found = left.join(right.select(key).distinct().withColumn("found__", F.lit(True)), key, "left")
    return found.where(F.coalesce("found__", F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string"))).cast("boolean"))).drop("found__")
