"""Batches and samplers. Random choices are hashes of seed and place, so a lost task draws the same again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators.frames import global_number


def quotas(weights: list[float], batch: int) -> list[int]:
    """Samples of each dataset in a batch: shares rounded down, the last one gets what is left."""
    total = sum(weights)
    out = [int(batch * w / total) for w in weights[:-1]]
    return [*out, batch - sum(out)]


def draw(seed: int, *place: Column, below: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *place), below)


def weighted_batches(spark: SparkSession, sizes: list[int], weights: list[float], batch: int, seed: int = 0, epoch: int = 0, ranks: int = 1) -> DataFrame:
    """(rank, batch_id, place, dataset, row) of an epoch: by dataset its quota, drawn with replacement, then the batch permuted.

    row numbers the concatenated datasets. An epoch has as many batches as all rows fill, for each rank.
    """
    per = quotas(weights, batch)
    if sum(sizes) < batch:
        raise ValueError("fewer rows than a batch has")
    n = sum(sizes) // (batch * ranks)
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    plan = F.array(*[F.struct(F.lit(i).alias("dataset"), F.lit(q).alias("quota"), F.lit(s).cast("long").alias("size"), F.lit(a).cast("long").alias("first")) for i, (q, s, a) in enumerate(zip(per, sizes, starts)) if q])
    rows = spark.range(n * ranks).select((F.col("id") % ranks).cast("int").alias("rank"), F.floor(F.col("id") / ranks).alias("batch_id"), F.explode(plan).alias("d"))
    rows = rows.select("rank", "batch_id", "d.*", F.explode(F.sequence(F.lit(0), F.col("d.quota") - 1)).alias("j"))
    key = F.lit(seed + epoch * ranks) + F.col("rank")
    drawn = rows.select("rank", "batch_id", "dataset", (F.col("first") + F.pmod(F.xxhash64(key, "batch_id", "dataset", "j"), F.col("size"))).alias("row"), F.xxhash64(F.lit(1), key, "batch_id", "dataset", "j").alias("o"))
    listed = drawn.groupBy("rank", "batch_id").agg(F.array_sort(F.collect_list(F.struct("o", "dataset", "row"))).alias("b"))  # a batch has a fixed size
    return listed.select("rank", "batch_id", F.posexplode("b").alias("place", "x")).select("rank", "batch_id", "place", "x.dataset", "x.row")


def batches(df: DataFrame, key: str, size: int, shuffle_seed: int | None = None) -> DataFrame:
    """batch_id and place for each row, by a numeric key or in a shuffled order; an incomplete last batch goes."""
    if shuffle_seed is None:
        placed = global_number(df, key, out="position")
    else:
        placed = global_number(df.withColumn("o__", F.xxhash64(F.lit(shuffle_seed), key)), "o__", key, out="position").drop("o__")
    total = df.agg(F.count("*").alias("n")).first()["n"]
    if total < size:
        raise ValueError("fewer rows than a batch has")
    return placed.where(F.col("position") < total // size * size).withColumn("batch_id", F.floor(F.col("position") / size)).withColumn("place", (F.col("position") % size).cast("int")).drop("position")


def take_batches(numbered: DataFrame, wanted: int) -> DataFrame:
    """``turn`` counts the batches that a consumer takes, ``wanted`` in all: those there are in order, and again from the first when they are used up."""
    last = numbered.agg(F.max("batch_id").alias("b")).first()["b"]
    if last is None:
        raise ValueError("there is no batch")
    turns = F.sequence(F.col("batch_id").cast("long"), F.lit(wanted - 1).cast("long"), F.lit(last + 1).cast("long"))
    return numbered.where(F.col("batch_id") < wanted).withColumn("turn", F.explode(turns))


def bounded_batches(df: DataFrame, key: str, size: int, max_rows: int | None = None, seed: int = 0) -> DataFrame:
    """All full batches in order; where ``max_rows`` is less than there are, as many full batches of a shuffled order as it fills."""
    if max_rows is None or max_rows >= df.count():
        return batches(df, key, size)
    return batches(df, key, size, shuffle_seed=seed).where(F.col("batch_id") < max_rows // size)


def epochs(df: DataFrame, n: int) -> DataFrame:
    """The rows once for each epoch."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def collate(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each batch: the columns as arrays in the order of the places."""
    listed = df.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("place", *columns))).alias("b"))
    return listed.select("batch_id", *[F.col(f"b.{c}").alias(c) for c in columns])


def choose(key: Column, options: list[Column], seed: int = 0) -> Column:
    """One of the options for each key, always the same one."""
    return F.element_at(F.array(*options), (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(options))) + 1).cast("int"))


def jitter(key: Column, amount: float, seed: int = 0) -> Column:
    """Uniform in [-amount, amount) for each key."""
    return (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / F.lit(float(1 << 30)) * 2 - 1) * amount


#: Fixed values of the training distortions: share of a side that a crop keeps, degrees, and changes of brightness, contrast and saturation.
CROP, DEGREES, COLOUR = 0.95, 5.0, {"brightness": 0.3, "contrast": 0.4, "saturation": 0.5}


def distortion(key: Column, camera: Column, width: int, height: int, seed: int = 0) -> dict[str, Column]:
    """How training distorts an image: begin and size of its crop, its rotation in degrees, and changes of its colours.

    Drawn from the key, so a task that runs again draws the same. Cameras at a wrist keep their view.
    """
    w, h = int(width * CROP), int(height * CROP)
    wrist = camera.contains("wrist")
    view = {
        "crop_x": F.when(wrist, 0).otherwise(draw(seed, F.lit("x"), key, below=F.lit(width - w + 1)).cast("int")),
        "crop_y": F.when(wrist, 0).otherwise(draw(seed, F.lit("y"), key, below=F.lit(height - h + 1)).cast("int")),
        "crop_w": F.when(wrist, width).otherwise(w),
        "crop_h": F.when(wrist, height).otherwise(h),
        "angle": F.when(wrist, 0.0).otherwise(jitter(F.struct(F.lit("angle"), key), DEGREES, seed)),
    }
    return view | {name: jitter(F.struct(F.lit(name), key), most, seed) for name, most in COLOUR.items()}


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A total order by hash; equal on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def union_datasets(parts: list[DataFrame]) -> DataFrame:
    """Datasets one behind the other, with _dataset_idx; missing columns are null."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_dataset_idx", F.lit(i).cast("int"))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
