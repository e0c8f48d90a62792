"""Episode datasets as files: scans, episode dimension, writes, reports, statistics as JSON."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.operators.frames import KEY, ORDER


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share; where none is configured, as in tests, a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return at.rstrip("/") if at else tempfile.mkdtemp(prefix="strideframe-")


def scan(spark: SparkSession, path: str, *, columns: list[str] | None = None, episodes: list[int] | None = None, pattern: str = "*.parquet", schema: T.StructType | None = None) -> DataFrame:
    """A folder of parquet files, searched to any depth; column and episode choices reach the files."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    df = (reader.schema(schema) if schema else reader).parquet(path)
    df = df.where(F.col(KEY).isin(episodes)) if episodes is not None else df
    return df.select(*columns) if columns else df


def files(spark: SparkSession, path: str, pattern: str = "*", most: int = 0) -> DataFrame:
    """Files in the order of their paths, up to ``most`` (0: all); contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime").orderBy("path")
    return found.limit(most) if most else found


def by_number(df: DataFrame, name: str) -> DataFrame:
    """Ordered by the number at the end of a name, not as text."""
    return df.orderBy(F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("long"), name)


def frame_counts(df: DataFrame) -> DataFrame:
    """Frames of each episode, from the key column alone."""
    return df.select(KEY).groupBy(KEY).agg(F.count("*").alias("n_frames"))


def episode_list(spark: SparkSession, path: str) -> DataFrame:
    """episodes.jsonl: episode_index, length and the one task of each; a row with more tasks is an error."""
    rows = spark.read.schema("episode_index long, length long, tasks array<string>").json(path)
    return rows.withColumn("task", F.when(F.size("tasks") == 1, F.get("tasks", F.lit(0))).otherwise(F.raise_error(F.lit("an episode has one task")).cast("string"))).drop("tasks")


def fake(spark: SparkSession, n: int, widths: dict[str, int], tokens: dict[str, int] | None = None, seed: int = 0) -> DataFrame:
    """Seeded rows: arrays uniform in [-1, 1), token arrays in [0, 2048)."""
    def unit(k: str, j: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.lit(j), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    out = spark.range(n)
    arrays = [F.array(*[unit(k, j) * 2 - 1 for j in range(w)]).alias(k) for k, w in widths.items()]
    whole = [F.array(*[F.floor(unit(k, j) * 2048).cast("int") for j in range(w)]).alias(k) for k, w in (tokens or {}).items()]
    return out.select("id", *arrays, *whole)


def episode_attributes(frames: DataFrame, ts: str | None = None, per_second: float = 1e9, attributes: dict[str, str] | None = None) -> DataFrame:
    """One row for each episode: its frames, first and last time, duration in seconds, frames a second, and the given attributes as they are."""
    times = [F.min(ts).alias("start_time"), F.max(ts).alias("end_time")] if ts else []
    out = frames.select(KEY, *([ts] if ts else [])).groupBy(KEY).agg(F.count("*").alias("n_frames"), *times)
    if ts:
        out = out.withColumn("duration", (F.col("end_time") - F.col("start_time")) / per_second)
        out = out.withColumn("fps", F.when(F.col("duration") > 0, (F.col("n_frames") - 1) / F.nullif("duration", F.lit(0.0))).otherwise(0.0))
    return out.withColumns({k: F.lit(v) for k, v in (attributes or {}).items()})


def write_episodes(frames: DataFrame, path: str, *, overwrite: bool = False, ts: str | None = None, per_second: float = 1e9, attributes: dict[str, str] | None = None) -> None:
    """Frames dealt by episode, an episode in one file and in order, and a small dimension with their attributes beside them; existing data is an error unless overwritten."""
    mode = "overwrite" if overwrite else "errorifexists"
    frames.repartition(KEY).sortWithinPartitions(KEY, ORDER).write.mode(mode).parquet(f"{path}/frames")
    episode_attributes(frames, ts, per_second, attributes).write.mode(mode).parquet(f"{path}/episodes")


def next_episode(spark: SparkSession, path: str) -> int:
    """The number behind all that were written or discarded. There is one writer at a time."""
    def last(table: str) -> int:
        try:
            at = spark.read.schema(f"{KEY} long").parquet(f"{path}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1
        found = at.agg(F.max(KEY)).first()[0]
        return -1 if found is None else found

    return max(last("episodes"), last("discarded")) + 1


def append_episode(frames: DataFrame, path: str, *, ts: str | None = None, per_second: float = 1e9, attributes: dict[str, str] | None = None) -> int:
    """Appended under the next episode number, which is returned; an empty episode is skipped."""
    number = next_episode(frames.sparkSession, path)
    if frames.isEmpty():
        return number
    own = frames.withColumn(KEY, F.lit(number).cast("long"))
    own.write.mode("append").parquet(f"{path}/frames")
    episode_attributes(own, ts, per_second, attributes).write.mode("append").parquet(f"{path}/episodes")
    return number


def discard_episode(spark: SparkSession, path: str, *, keep_index: bool = False) -> int:
    """The number that the next episode gets once the current one is given up: its own, or, where that is used up, the one behind."""
    number = next_episode(spark, path)
    if keep_index:
        return number
    spark.range(number, number + 1).select(F.col("id").alias(KEY)).write.mode("append").parquet(f"{path}/discarded")
    return number + 1


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/frames")


def as_features(frames: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Training features: 32-bit arrays; a scalar becomes an array of one."""
    kinds = dict(frames.dtypes)
    out = [(F.col(c) if kinds[c].startswith("array") else F.array(c)).cast("array<float>").alias(name) for name, c in columns.items()]
    return frames.select(KEY, ORDER, *out)


def report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    rows.write.mode("overwrite").json(path)


def stats_json(stats: DataFrame, key: str) -> str:
    """{key: {mean, std, q01, q99}} from rows (key, dim, ...), one for each dimension of few vectors."""
    names = [c for c in ("mean", "std", "q01", "q99") if c in stats.columns]
    listed = stats.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", *names))).alias("s")).collect()
    return json.dumps({"norm_stats": {r[key]: {n: [x[n] for x in r["s"]] for n in names} for r in listed}}, sort_keys=True)


def stats_from_json(spark: SparkSession, text: str) -> DataFrame:
    rows = [(k, i, *[v.get(n, [None] * len(v["mean"]))[i] for n in ("mean", "std", "q01", "q99")]) for k, v in json.loads(text)["norm_stats"].items() for i in range(len(v["mean"]))]
    return spark.createDataFrame(rows, "key string, dim int, mean double, std double, q01 double, q99 double")


def steps(trajectories: DataFrame, array: str = "steps") -> DataFrame:
    """One row for each step of a trajectory, with its number."""
    return trajectories.select("*", F.posexplode(array).alias(ORDER, "step")).drop(array)


def file_columns(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, names) of each parquet file, from footers alone, which the tasks read; the file system must be one that Arrow opens by URI."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            names = []
            for p in paths:
                system, at = FileSystem.from_uri(p)
                names.append(pq.read_schema(at, filesystem=system).names)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.list_(pa.string()))], ["path", "names"])

    # the order of the paths says nothing about their work, so they are dealt evenly
    return files(spark, path, pattern).select("path").repartition(spark.sparkContext.defaultParallelism).mapInArrow(footers, "path string, names array<string>")


def latest_step(names: list[str]) -> int | None:
    """The largest of the names that are numbers."""
    return max((int(n) for n in names if n.isdigit()), default=None)
