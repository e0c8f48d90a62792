"""Sequence operators within an episode: differences, directions, commands, smoothing, chunks, edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.operators.frames import KEY, ORDER, in_order, whole


def delta(col: str) -> Column:
    """The difference to the frame before; 0 at the first."""
    return F.coalesce(F.col(col) - F.lag(col).over(in_order()), F.lit(0.0))


def clamped(col: str, by: int) -> Column:
    """The value ``by`` frames ahead (or back), held at the ends of the episode."""
    if by >= 0:
        return F.coalesce(F.lead(col, by).over(in_order()), F.last(col).over(whole()))
    return F.coalesce(F.lag(col, -by).over(in_order()), F.first(col).over(whole()))


def with_tangent(df: DataFrame, x: str, y: str, lag: int) -> DataFrame:
    """dir_x, dir_y: unit central difference over ``lag`` frames; where it vanishes the direction before, at first (1, 0)."""
    dx, dy = clamped(x, lag) - clamped(x, -lag), clamped(y, lag) - clamped(y, -lag)
    raw = df.withColumn("dx__", dx).withColumn("dy__", dy).withColumn("n__", F.sqrt(F.col("dx__") * F.col("dx__") + F.col("dy__") * F.col("dy__")))
    unit = [F.when(F.col("n__") >= 1e-9, F.col(c) / F.col("n__")) for c in ("dx__", "dy__")]
    back = in_order().rowsBetween(Window.unboundedPreceding, 0)
    return (
        raw.withColumn("ux__", unit[0]).withColumn("uy__", unit[1])
        .withColumn("dir_x", F.coalesce(F.last("ux__", True).over(back), F.lit(1.0)))
        .withColumn("dir_y", F.coalesce(F.last("uy__", True).over(back), F.lit(0.0)))
        .drop("dx__", "dy__", "n__", "ux__", "uy__")
    )


def continuous_sign(df: DataFrame, columns: list[str], out: str = "sign") -> DataFrame:
    """+1 or -1 for each frame, so that a vector times it never turns by more than a right angle from the one before.

    A negative product with the frame before flips, a positive one keeps, and zero starts anew at +1: the
    parity of negative products since the last zero. Two window sums, no recursion.
    """
    w = in_order()
    dot = sum((F.col(c) * F.lag(c).over(w) for c in columns[1:]), F.col(columns[0]) * F.lag(columns[0]).over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("dot__", dot).withColumn("island__", F.count_if(F.col("dot__") == 0).over(upto))
    inside = Window.partitionBy(KEY, "island__").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(out, F.when(F.count_if(F.col("dot__") < 0).over(inside) % 2 == 1, -1.0).otherwise(1.0)).drop("dot__", "island__")


def navigation_command(df: DataFrame, x: str, y: str, hx: str, hy: str, dt: float) -> DataFrame:
    """vx, vy, yaw_rate of the step to the next frame, seen from the heading; the last frame repeats the one before, a single frame has zeros."""
    w = in_order()
    dx, dy = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    nx, ny = F.lead(hx).over(w), F.lead(hy).over(w)
    step = (
        df.withColumn("a__", (dx * F.col(hx) + dy * F.col(hy)) / dt)
        .withColumn("b__", (-dx * F.col(hy) + dy * F.col(hx)) / dt)
        .withColumn("c__", F.atan2(F.col(hx) * ny - F.col(hy) * nx, F.col(hx) * nx + F.col(hy) * ny) / dt)
    )
    for name, c in (("vx", "a__"), ("vy", "b__"), ("yaw_rate", "c__")):
        step = step.withColumn(name, F.coalesce(F.col(c), F.lag(c).over(w), F.lit(0.0)))
    return step.drop("a__", "b__", "c__")


def integrate(df: DataFrame, vx: str, vy: str, wz: str, dt: float) -> DataFrame:
    """x, y, yaw from velocity commands, from the origin; the command of the last frame is not used."""
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    turned = df.withColumn("yaw", F.coalesce(F.sum(F.col(wz) * dt).over(before), F.lit(0.0)))
    c, s = F.cos("yaw"), F.sin("yaw")
    moved = turned.withColumn("mx__", (c * F.col(vx) - s * F.col(vy)) * dt).withColumn("my__", (s * F.col(vx) + c * F.col(vy)) * dt)
    return moved.withColumn("x", F.coalesce(F.sum("mx__").over(before), F.lit(0.0))).withColumn("y", F.coalesce(F.sum("my__").over(before), F.lit(0.0))).drop("mx__", "my__")


def rebase(df: DataFrame, x: str, y: str, hx: str, hy: str) -> DataFrame:
    """Positions seen from the first frame: x along its heading, y to the left of it."""
    w = whole()
    dx, dy = F.col(x) - F.first(x).over(w), F.col(y) - F.first(y).over(w)
    n = F.greatest(F.sqrt(F.first(hx).over(w) ** 2 + F.first(hy).over(w) ** 2), F.lit(1e-12))
    ax, ay = F.first(hx).over(w) / n, F.first(hy).over(w) / n
    return df.withColumn("x0", dx * ax + dy * ay).withColumn("y0", -dx * ay + dy * ax)


def savgol_coefficients(window: int, order: int) -> list[float]:
    """Weights of the value that a least-squares polynomial has in the middle of the window."""
    half = window // 2
    at = np.arange(-half, half + 1) / max(half, 1)
    return np.linalg.pinv(np.vander(at, order + 1, increasing=True))[0].tolist()


def savgol_shape(n: int, window: int, order: int) -> tuple[int, int]:
    """Window and order that fit ``n`` frames: an odd window of at least 3, an order below it."""
    wl = max(3, min(window, n if n % 2 else n - 1))
    wl = max(3, wl - (wl % 2 == 0))
    return wl, min(max(1, order), wl - 1)


def window_frames(seconds: float, dt: float) -> int:
    """Frames of a time span, odd and at least 3."""
    n = int(round(seconds / dt))
    return max(3, n + (n % 2 == 0))


def smooth(df: DataFrame, col: str, out: str, window: int, order: int, widest: int = 64) -> DataFrame:
    """Savitzky-Golay smoothing with the ends repeated; episodes of fewer than three frames stay.

    Windows of up to ``widest`` frames are sums over the ordered values of an episode; wider ones go to
    numpy, an episode at a time, where the sums are convolutions.
    """
    if window > widest:
        return smooth_wide(df, col, out, window, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    shapes: dict[tuple[int, int], int] = {}
    for size in range(3, window + 1):
        shapes.setdefault(savgol_shape(size, window, order), size)
    taps = {by: clamped(col, by) for by in range(-(window // 2), window // 2 + 1)}
    held = df.withColumn("n__", n).withColumns({f"t{by + window}__": e for by, e in taps.items()})
    value = F.col(col).cast("double")
    for (wl, po), least in sorted(shapes.items()):
        weights = savgol_coefficients(wl, po)
        fitted = sum(F.col(f"t{by + window}__") * weights[by + wl // 2] for by in range(-(wl // 2), wl // 2 + 1))
        value = F.when(F.col("n__") >= least, fitted).otherwise(value)
    return held.withColumn(out, value).drop("n__", *[f"t{by + window}__" for by in taps])


def smooth_wide(df: DataFrame, col: str, out: str, window: int, order: int) -> DataFrame:
    """The same by numpy for each episode."""
    schema = df.withColumn(out, F.lit(0.0)).schema

    def each(pdf):
        pdf = pdf.sort_values(ORDER)
        x = pdf[col].to_numpy(float)
        if len(x) >= 3:
            wl, po = savgol_shape(len(x), window, order)
            x = np.convolve(np.pad(x, wl // 2, mode="edge"), savgol_coefficients(wl, po)[::-1], mode="valid")
        return pdf.assign(**{out: x})

    return df.groupBy(KEY).applyInPandas(each, schema)


def look_ahead(col: str, horizon: int) -> Column:
    """The values of the next ``horizon`` frames, this one first; the last one is repeated beyond the end."""
    held = F.collect_list(col).over(in_order().rowsBetween(0, horizon - 1))
    return F.concat(held, F.array_repeat(F.element_at(held, -1), horizon - F.size(held)))


def look_ahead_pad(horizon: int, col: str = ORDER) -> Column:
    """Which places of a look-ahead lie beyond the end."""
    held = F.collect_list(col).over(in_order().rowsBetween(0, horizon - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: i >= F.size(held))


def edges(df: DataFrame, level: str) -> DataFrame:
    """Frames whose level differs from the frame before, with their number within the episode from 0."""
    changed = df.withColumn("before__", F.lag(level).over(in_order())).where(F.col("before__").isNotNull() & (F.col("before__") != F.col(level))).drop("before__")
    return changed.withColumn("edge", F.row_number().over(in_order()) - 1)


def shift_edges(df: DataFrame, level: str, shifts: list[int]) -> DataFrame:
    """The level after its k-th change is moved by shifts[k] frames (0 beyond the list), held in the episode; moved changes must stay in order."""
    n = df.groupBy(KEY).agg(F.count("*").alias("n__"), F.min_by(level, ORDER).alias("first__"))
    shift = F.coalesce(F.get(F.array(*map(F.lit, shifts)), F.col("edge").cast("int")), F.lit(0)) if shifts else F.lit(0)
    moved = edges(df, level).join(n, KEY).select(KEY, "edge", F.col(level).alias("level__"), F.least(F.greatest(F.col(ORDER) + shift, F.lit(0)), F.col("n__")).alias("at__"))
    listed = moved.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("edge", "at__", "level__"))).alias("e__"))
    ordered = F.forall(F.sequence(F.lit(1), F.greatest(F.size("e__") - 1, F.lit(1))), lambda i: F.coalesce(F.get(F.col("e__"), i)["at__"] >= F.get(F.col("e__"), i - 1)["at__"], F.lit(True)))
    checked = listed.withColumn("e__", F.when(ordered, F.col("e__")).otherwise(F.raise_error(F.lit("moved changes are out of order")).cast(listed.schema["e__"].dataType)))
    held = df.join(n.select(KEY, "first__"), KEY).join(checked, KEY, "left")
    passed = F.filter("e__", lambda e: e["at__"] <= F.col(ORDER))
    return held.withColumn("shifted", F.coalesce(F.get(passed, F.size(passed) - 1)["level__"], F.col("first__"))).drop("first__", "e__")


def stopped(df: DataFrame, level: str, hold: int) -> DataFrame:
    """stop: the hand, once it has been closed, has been open for ``hold`` frames in a row."""
    w = in_order().rowsBetween(Window.unboundedPreceding, 0)
    closed = F.col(level) > 0.5
    run = df.withColumn("run__", F.count_if(closed).over(w))
    inside = Window.partitionBy(KEY, "run__").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.count_if(~closed).over(inside)
    return run.withColumn("open_frames", F.when(F.col("run__") > 0, opened).otherwise(0)).withColumn("stop", F.col("open_frames") >= hold).drop("run__")


def hold_after_edge(df: DataFrame, level: str, nth: int, frames: int) -> DataFrame:
    """The level is 1 for ``frames`` frames from the n-th fall from above 0.1 on."""
    fall = (F.lag(level).over(in_order()) > 0.1) & (F.col(level) <= 0.1)
    upto = in_order().rowsBetween(Window.unboundedPreceding, 0)
    counted = df.withColumn("f__", fall).withColumn("k__", F.count_if("f__").over(upto))
    start = F.min(F.when(F.col("f__") & (F.col("k__") == nth), F.col(ORDER))).over(whole())
    return counted.withColumn("s__", start).withColumn("held", F.when((F.col(ORDER) >= F.col("s__")) & (F.col(ORDER) < F.col("s__") + frames), 1.0).otherwise(F.col(level))).drop("f__", "k__", "s__")


def latch(df: DataFrame, condition: Column, out: str) -> DataFrame:
    """True from the first frame on that meets the condition."""
    return df.withColumn(out, F.max(condition).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))


def repeat_2_3(df: DataFrame) -> DataFrame:
    """Frames twice and three times in turn, twice first; step is the place in the output."""
    n = F.when(F.col(ORDER) % 2 == 0, 2).otherwise(3)
    before = F.floor(F.col(ORDER) / 2) * 5 + F.when(F.col(ORDER) % 2 == 1, 2).otherwise(0)
    return df.withColumn("k__", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("step", before + F.col("k__")).drop("k__")


def changed(df: DataFrame, columns: list[str], atol: float = 1e-4) -> DataFrame:
    """Frames in which some column moved by more than ``atol``; the first frame always."""
    w = in_order()
    moved = [F.coalesce(F.abs(F.col(c) - F.lag(c).over(w)) > atol, F.lit(True)) for c in columns]
    any_ = moved[0]
    for m in moved[1:]:
        any_ = any_ | m
    return df.withColumn("c__", any_).where("c__").drop("c__")


def capture_rate(df: DataFrame, ts: str, every: int = 100, per_second: float = 1e6) -> DataFrame:
    """Every so many frames, how many were captured in a second since the episode began; 0 where no time has passed."""
    passed = (F.col(ts) - F.first(ts).over(whole())) / per_second
    n = F.col(ORDER) + 1
    return df.withColumn("rate", F.when(passed > 0, n / F.nullif(passed, F.lit(0.0))).otherwise(0.0)).where(n % every == 0)
