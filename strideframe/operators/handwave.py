"""Binary hand signals: fits of square waves and of chunks with one change."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.control import WAVES
from strideframe.operators.frames import KEY, ORDER, in_order, whole


def fit_one_pulse(df: DataFrame, signal: str, weight: str) -> DataFrame:
    """The best wave 0-1-0 of each episode: first and end frame of the pulse, and its error.

    The error of a pulse [a, b) is the error of no pulse plus the sum of gains within; the best pair is a
    running minimum of prefix sums, so one ordered pass is enough. Ties go to the smaller a, then b.
    """
    w = in_order()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s, g = F.col(signal), F.col(weight)
    cost = df.withColumn("gain__", g * ((1 - s) * (1 - s) - s * s)).withColumn("zero__", g * s * s)
    total = cost.withColumn("p1__", F.sum("gain__").over(upto)).withColumn("p0__", F.col("p1__") - F.col("gain__"))
    # opening at frame i costs -p0, closing behind frame j adds p1; the best opening so far has the largest p0
    best = total.withColumn("open__", F.min(F.struct((-F.col("p0__")).alias("v"), F.col(ORDER).alias("a"))).over(upto))
    scored = best.groupBy(KEY).agg(F.min(F.struct((F.col("p1__") + F.col("open__.v")).alias("v"), F.col("open__.a").alias("a"), (F.col(ORDER) + 1).alias("b"))).alias("m"), F.sum("zero__").alias("z"))
    return scored.select(KEY, F.col("m.a").alias("x"), F.col("m.b").alias("y"), (F.col("z") + F.col("m.v")).alias("error"))


def fit_wave(df: DataFrame, signal: str, weight: str, kind: str, margin: int = 1) -> DataFrame:
    """Edges of the best wave of a kind for each episode, an exact minimum of the weighted squared error.

    Levels last at least ``margin`` frames. A table over (level, frame) gives the least error of all
    prefixes; it depends on the whole episode, so each episode goes to numpy as one group.
    """
    levels = np.array(WAVES[kind], float)

    def each(pdf):
        pdf = pdf.sort_values(ORDER)
        x, w = pdf[signal].to_numpy(float), pdf[weight].to_numpy(float)
        n, k = len(x), len(levels)
        if n < margin * k:
            return pdf.iloc[:1].assign(edges=[None], error=np.nan)[[KEY, "edges", "error"]]
        sums = np.concatenate([np.zeros((k, 1)), np.cumsum(w * (levels[:, None] - x) ** 2, 1)], 1)
        best, back = np.full((k, n + 1), np.inf), np.zeros((k, n + 1), int)
        best[0, margin:] = sums[0, margin:]
        for j in range(1, k):
            open_ = best[j - 1] - sums[j]
            low, at = np.inf, 0
            for end in range(margin * (j + 1), n + 1):
                if open_[end - margin] < low:
                    low, at = open_[end - margin], end - margin
                best[j, end], back[j, end] = low + sums[j, end], at
        edges, end = [], n
        for j in range(k - 1, 0, -1):
            end = int(back[j, end])
            edges.append(end)
        return pdf.iloc[:1].assign(edges=[edges[::-1]], error=best[k - 1, n])[[KEY, "edges", "error"]]

    return df.select(KEY, ORDER, signal, weight).groupBy(KEY).applyInPandas(each, f"{KEY} long, edges array<int>, error double")


def binarise(df: DataFrame, value: str, threshold: float = 0.5) -> DataFrame:
    """Each chunk (an episode) as 0s and 1s with at most one change, nearest to the values in squared error.

    Of equal errors the order is: all 0, all 1, 0 to 1 at the smallest place, 1 to 0 at the smallest
    place. A chunk of one row is compared with the threshold.
    """
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value)
    cost = df.withColumn("c0__", v * v).withColumn("c1__", (1 - v) * (1 - v))
    for c in ("c0__", "c1__"):
        cost = cost.withColumn(f"b{c}", F.coalesce(F.sum(c).over(before), F.lit(0.0))).withColumn(f"t{c}", F.sum(c).over(whole()))
    up = F.col("bc0__") + F.col("tc1__") - F.col("bc1__")
    down = F.col("bc1__") + F.col("tc0__") - F.col("bc0__")
    # frame 0 stands for the constant patterns
    options = F.array_min(
        F.array(
            F.struct(F.when(F.col(ORDER) == 0, F.col("tc0__")).otherwise(up).alias("e"), F.when(F.col(ORDER) == 0, 0).otherwise(2).alias("kind"), F.col(ORDER).alias("at")),
            F.struct(F.when(F.col(ORDER) == 0, F.col("tc1__")).otherwise(down).alias("e"), F.when(F.col(ORDER) == 0, 1).otherwise(3).alias("kind"), F.col(ORDER).alias("at")),
        )
    )
    n = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    picked = cost.withColumn("best__", F.min(options).over(whole())).withColumn("n__", n)
    kind, at, i = F.col("best__.kind"), F.col("best__.at"), F.col(ORDER)
    bit = F.when(F.col("n__") == 1, v > threshold).otherwise((kind == 1) | ((kind == 2) & (i >= at)) | ((kind == 3) & (i < at)))
    return picked.withColumn("binary", bit.cast("double")).drop("c0__", "c1__", "bc0__", "bc1__", "tc0__", "tc1__", "best__", "n__")
