"""Pixel tables: splats, neighbourhood masks, frame buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def splat(points: DataFrame, image: str, u: str, v: str, depth: str, values: list[str], width: int, height: int, scale: float = 50.0) -> DataFrame:
    """Points into pixels: each goes to its four corners by bilinear weight, far ones weigh less; a pixel is the weighted mean.

    Corners beyond the image fall away before the shuffle, and sums are partial.
    """
    top = points.groupBy(image).agg(F.max(F.log1p(F.greatest(F.col(depth), F.lit(0.0)))).alias("top__"))
    near = points.join(top, image).withColumn("z__", F.exp(F.log1p(F.greatest(F.col(depth), F.lit(0.0))) / (F.col("top__") + 1e-7) * scale) + 1e-7)
    x0, y0, x1, y1 = F.floor(u), F.floor(v), F.ceil(u), F.ceil(v)
    wx0, wy0, wx1, wy1 = 1 - (F.col(u) - x0), 1 - (F.col(v) - y0), 1 - (x1 - F.col(u)), 1 - (y1 - F.col(v))
    corner = F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y"), (wx * wy).alias("w")) for x, y, wx, wy in ((x0, y0, wx0, wy0), (x0, y1, wx0, wy1), (x1, y0, wx1, wy0), (x1, y1, wx1, wy1))]))
    spread = near.withColumn("c__", corner).where((F.col("c__.x") >= 0) & (F.col("c__.x") < width) & (F.col("c__.y") >= 0) & (F.col("c__.y") < height))
    w = F.col("c__.w") / F.col("z__")
    sums = spread.groupBy(image, F.col("c__.x").alias("x"), F.col("c__.y").alias("y")).agg(F.sum(w).alias("weight"), *[F.sum(w * F.col(c)).alias(c) for c in values])
    return sums.where("weight > 0").select(image, "x", "y", "weight", *[(F.col(c) / F.col("weight")).alias(c) for c in values])


def reliable(pixels: DataFrame, image: str, depth: str, size: int = 5, limit: float = 0.05) -> DataFrame:
    """Whether the spread of depth around a pixel is small against its mean; beyond the image the mean takes zeros.

    Every pixel of the image has a row. The square neighbourhood is then separable: rows first, then
    columns, each a window of bounded range.
    """
    r = size // 2
    row = Window.partitionBy(image, "y").orderBy("x").rangeBetween(-r, r)
    col = Window.partitionBy(image, "x").orderBy("y").rangeBetween(-r, r)
    rows = pixels.withColumn("hi__", F.max(depth).over(row)).withColumn("lo__", F.min(depth).over(row)).withColumn("sum__", F.sum(depth).over(row))
    both = rows.withColumn("h__", F.max("hi__").over(col)).withColumn("l__", F.min("lo__").over(col)).withColumn("s__", F.sum("sum__").over(col))
    ratio = (F.col("h__") - F.col("l__")) / (F.col("s__") / (size * size) + 1e-6)
    return both.withColumn("reliable", (ratio < limit) & (F.col(depth) > 0)).drop("hi__", "lo__", "sum__", "h__", "l__", "s__")


def newest(df: DataFrame, key: str, ts: str, k: int) -> DataFrame:
    """The k newest rows of a key, numbered from the newest."""
    w = Window.partitionBy(key).orderBy(F.desc(ts))
    return df.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < k)


def frame_buffer(df: DataFrame, key: str, ts: str, k: int) -> DataFrame:
    """What a buffer of ``k`` slots holds in the end: filled from the front, then only slot 0 is overwritten, so old frames stay behind."""
    w = Window.partitionBy(key).orderBy(ts)
    placed = df.withColumn("n__", F.row_number().over(w)).withColumn("all__", F.count(F.lit(1)).over(Window.partitionBy(key)))
    stays = (F.col("n__") == F.col("all__")) | (F.col("n__") < F.least(F.lit(k), F.col("all__")))
    return placed.where(stays).withColumn("slot", F.when(F.col("n__") == F.col("all__"), 0).otherwise(F.least(F.lit(k), F.col("all__")) - F.col("n__")).cast("int")).drop("n__", "all__")


def best_buffers(df: DataFrame, batch: str, buffer: str, mask: str, k: int) -> DataFrame:
    """The k buffers of a batch whose masks cover most; ties go to the smaller buffer."""
    scores = df.groupBy(batch, buffer).agg(F.sum(mask).alias("score"))
    w = Window.partitionBy(batch).orderBy(F.desc("score"), buffer)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exclusive_full(df: DataFrame, batch: str, buffer: str, mask: str, least: float = 0.9) -> DataFrame:
    """The first buffer of a batch that is nearly full stands alone; where none is, all stay."""
    means = df.groupBy(batch, buffer).agg(F.avg(mask).alias("mean_mask"))
    first = means.where(F.col("mean_mask") >= least).groupBy(batch).agg(F.min(buffer).alias("only__"))
    return means.join(first, batch, "left").where(F.col("only__").isNull() | (F.col("only__") == F.col(buffer))).drop("only__")


def replace_frames(source: DataFrame, processed: DataFrame, keys: list[str], col: str) -> DataFrame:
    """One column from the processed frames; frames that were not processed keep theirs."""
    return source.join(processed.select(*keys, F.col(col).alias("new__")), keys, "left").withColumn(col, F.coalesce("new__", F.col(col))).drop("new__")


def overlay(index: Column, n: Column) -> Column:
    """The text over a video frame."""
    return F.concat_ws("/", (index + 1).cast("string"), n.cast("string"))


def warped(pixels: DataFrame, image: str, depth: str, values: list[str], width: int, height: int, move, camera: tuple[float, float, float, float]) -> DataFrame:
    """Pixels (x, y, depth, values) seen from a moved camera: unproject, move, project, splat. ``move`` maps a point to a point."""
    from strideframe.functions import geometry as G

    p = move(G.unproject(F.col("x"), F.col("y"), G.clean_depth(F.col(depth)), *camera))
    u, v, d = G.project(p, *camera)
    seen = pixels.withColumn("u__", u).withColumn("v__", v).withColumn("d__", d).where("d__ > 0 AND u__ IS NOT NULL").drop("x", "y")
    return splat(seen, image, "u__", "v__", "d__", values, width, height)


def round_trip(pixels: DataFrame, image: str, depth: str, values: list[str], width: int, height: int, move, camera: tuple[float, float, float, float]) -> DataFrame:
    """A view there and back: values are splatted with their flow, and then splatted back against it, at the depth of the pixel where they land."""
    from strideframe.functions import geometry as G

    p = move(G.unproject(F.col("x"), F.col("y"), G.clean_depth(F.col(depth)), *camera))
    u, v, d = G.project(p, *camera)
    flow = pixels.withColumn("u__", u).withColumn("v__", v).withColumn("d__", d).where("d__ > 0 AND u__ IS NOT NULL").withColumn("du__", F.col("u__") - F.col("x")).withColumn("dv__", F.col("v__") - F.col("y")).drop("x", "y")
    there = splat(flow, image, "u__", "v__", "d__", [*values, "du__", "dv__"], width, height).drop("weight")
    back = there.join(pixels.select(image, "x", "y", F.col(depth).alias("z__")), [image, "x", "y"])
    back = back.withColumn("u__", F.col("x") - F.col("du__")).withColumn("v__", F.col("y") - F.col("dv__")).drop("x", "y")
    return splat(back, image, "u__", "v__", "z__", values, width, height)
