"""Array columns: padding, masks, differences, normalisation, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bool_mask(*dims: int) -> list[bool]:
    """+n gives n times true, -n gives n times false, 0 nothing."""
    return [d > 0 for d in dims for _ in range(abs(d))]


def concat_parts(columns: list[Column]) -> Column:
    """Arrays one behind the other, as doubles; a missing part is an error."""
    return F.concat(*[F.when(c.isNull(), F.raise_error(F.lit("a part to concatenate is missing")).cast("array<double>")).otherwise(c.cast("array<double>")) for c in columns])


def pad_to(a: Column, dim: int, value: float = 0.0) -> Column:
    """Padded on the right; never cut."""
    return F.concat(a.cast("array<double>"), F.array_repeat(F.lit(float(value)), F.greatest(dim - F.size(a), F.lit(0))))


def fit_to(a: Column, dim: int) -> Column:
    """Padded with zeros on the right, or cut."""
    return F.slice(pad_to(a, dim), 1, dim)


def stride(a: Column, step: int) -> Column:
    return F.filter(a, lambda _, i: i % step == 0)


def masked(state: Column, mask: list[bool]) -> Column:
    """The state where the mask holds, else 0; as long as the mask."""
    return F.transform(F.array(*map(F.lit, mask)), lambda m, i: F.when(m, F.coalesce(F.get(state, i).cast("double"), F.lit(0.0))).otherwise(0.0))


def shift_by(row: Column, by: Column, sign: int) -> Column:
    """A row plus or minus another, which may be shorter."""
    return F.transform(row, lambda v, i: v.cast("double") + sign * F.coalesce(F.get(by, i), F.lit(0.0)))


def delta_actions(actions: Column, state: Column, mask: list[bool] | None) -> Column:
    """Actions as differences to the state, in the masked dimensions; without a mask they stay."""
    return actions if mask is None else F.transform(actions, lambda row: shift_by(row, masked(state, mask), -1))


def absolute_actions(actions: Column, state: Column, mask: list[bool] | None) -> Column:
    """The inverse of delta_actions."""
    return actions if mask is None else F.transform(actions, lambda row: shift_by(row, masked(state, mask), 1))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / (std + 1e-6); statistics are cut to the length of x."""
    return F.transform(x, lambda v, i: (v - F.get(mean, i)) / (F.get(std, i) + 1e-6))


def zscore_back(x: Column, mean: Column, std: Column) -> Column:
    """The inverse; where statistics end, mean 0 and deviation 1 hold."""
    return F.transform(x, lambda v, i: v * (F.coalesce(F.get(std, i), F.lit(1.0)) + 1e-6) + F.coalesce(F.get(mean, i), F.lit(0.0)))


def quantile_scale(x: Column, low: Column, high: Column) -> Column:
    """The span between the quantiles to [-1, 1]; missing quantiles are an error."""
    checked = F.when(low.isNull() | high.isNull(), F.raise_error(F.lit("quantile statistics are missing")).cast("array<double>")).otherwise(low)
    return F.transform(x, lambda v, i: (v - F.get(checked, i)) / (F.get(high, i) - F.get(checked, i) + 1e-6) * 2 - 1)


def quantile_back(x: Column, low: Column, high: Column) -> Column:
    """The inverse; dimensions beyond the statistics pass through."""
    return F.transform(x, lambda v, i: F.when(i < F.size(low), (v + 1) / 2 * (F.get(high, i) - F.get(low, i) + 1e-6) + F.get(low, i)).otherwise(v))


def zero_out_of_range(x: Column, limit: float) -> Column:
    return F.transform(x, lambda v: F.when(F.abs(v) > limit, 0.0).otherwise(v))


def close_to(a: Column, b: Column, atol: float = 1e-5, rtol: float = 1e-5) -> Column:
    """Whether two arrays have the same length and all elements are within atol + rtol * |b|."""
    return (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("p"), b.alias("q")), lambda z: F.abs(z["p"] - z["q"]) <= atol + rtol * F.abs(z["q"]))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def mean_where(x: Column, mask: Column) -> Column:
    """Sum where the mask holds, over its count, at least 1."""
    total = F.aggregate(F.zip_with(x, mask, lambda v, m: F.when(m, v.cast("double")).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    return total / F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))


def align_right(a: Column, valid: Column) -> Column:
    """Rolled so that the last valid element stands at the end."""
    last = F.aggregate(F.transform(valid, lambda v, i: F.when(v, i).otherwise(-1)), F.lit(-1), lambda s, v: F.greatest(s, v)) + 1
    return F.concat(F.slice(a, last + 1, F.greatest(F.size(a) - last, F.lit(0))), F.slice(a, 1, last))


def put_at(a: Column, index: Column, value: Column) -> Column:
    return F.transform(a, lambda v, i: F.when(i == index, value).otherwise(v))


def exponential_mean(values: Column, decay: float) -> Column:
    """d * old + (1 - d) * new along an ordered array, from its first element."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)).cast("double"), lambda s, v: decay * s + (1 - decay) * v)


def sinusoid(pos: Column, dim: int, min_period: float, max_period: float) -> Column:
    """Sines, then cosines, of a position at geometrically spaced periods."""
    half = dim // 2
    periods = [min_period * (max_period / min_period) ** (i / max(half - 1, 1)) for i in range(half)]
    angles = [pos * (6.283185307179586 / p) for p in periods]
    return F.array(*[F.sin(a) for a in angles], *[F.cos(a) for a in angles])
