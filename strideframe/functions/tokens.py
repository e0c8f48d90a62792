"""Prompts, token arrays and digit codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_prompt(text: Column) -> Column:
    """Stripped; underscores and line ends become spaces."""
    return F.translate(F.btrim(text, F.lit(" \t\n\r")), "_\n", "  ")


def digitise(x: Column) -> Column:
    """Bin of a value in [-1, 1) over 256 bins; -1 below, 255 from 1 on. Scaling by 128 is exact."""
    return F.when(x < -1, -1).when(x >= 1, 255).otherwise(F.floor(x * 128) + 128).cast("int")


def state_prompt(prompt: Column, state: Column) -> Column:
    """Task: ..., State: ...; and an open Action, for autoregressive action tokens."""
    digits = F.array_join(F.transform(state, lambda v: digitise(v).cast("string")), " ")
    return F.concat(F.lit("Task: "), F.lower(clean_prompt(prompt)), F.lit(", State: "), digits, F.lit(";\nAction: "))


def pad_tokens(tokens: Column, length: int, fill: int = 0) -> Column:
    """Cut or padded to a length."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(fill), length)), 1, length)


def token_mask(tokens: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i < F.size(tokens))


def postfix_mask(prefix: Column, postfix: Column, length: int) -> Column:
    """0 in the prefix, 1 in the postfix, 0 behind: what attends causally, and what counts in the loss."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: ((i >= F.size(prefix)) & (i < F.size(prefix) + F.size(postfix))).cast("int"))


def action_token(token: Column, vocabulary: int, skip: int = 128) -> Column:
    """Action tokens at the end of a vocabulary, counted from behind; the map is its own inverse."""
    return vocabulary - 1 - skip - token


def unbin(tokens: Column, bins: int, length: int) -> Column:
    """Tokens to values in [-1, 1); zeros where there are too few."""
    values = F.transform(tokens, lambda t: t / F.lit(float(bins)) * 2 - 1)
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), length)), 1, length)


def fsq_index(digits: Column, levels: list[int]) -> Column:
    """Mixed-radix digits to one code."""
    place, out = 1, F.lit(0)
    for i, base in enumerate(levels):
        out = out + F.get(digits, F.lit(i)) * place
        place *= base
    return out


def fsq_digits(code: Column, levels: list[int]) -> Column:
    place, out = 1, []
    for base in levels:
        out.append(F.floor(code / place).cast("int") % base)
        place *= base
    return F.array(*out)


def fsq_round(z: Column, base: int) -> Column:
    """A value in [-1, 1] to a digit; halves go to the even digit."""
    return F.bround((z + 1) * (base - 1) / 2, 0).cast("int")


def block_causal(steps: Column, valid: Column) -> Column:
    """Which element attends to which: those of its own or an earlier block, where both are valid."""
    total = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.aggregate(F.slice(steps, F.lit(1), i), F.lit(0), lambda s, v: s + v))
    pairs = F.arrays_zip(total.alias("c"), valid.alias("v"))
    return F.transform(pairs, lambda q: F.transform(pairs, lambda k: (k["c"] <= q["c"]) & k["v"] & q["v"]))


def episode_number(name: Column) -> Column:
    """The number behind ``episode_``, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"episode_(\d+)", 1), F.lit("")), F.lit("0")).cast("long")


def folder_key(name: Column) -> tuple[Column, Column]:
    """(date, batch) of a folder such as 0102_2; others sort last."""
    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(name, r"^(\d+)_(\d+)$", i), F.lit("")).cast("long"), F.lit(999999))

    return part(1), part(2)


def tokenise(text: Column, encode: Callable[[list[str]], list[list[int]]]) -> Column:
    """Token arrays through a tokenizer that the caller brings, an Arrow batch at a time."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(texts.fillna("").tolist()))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<int>")(text)


def causal_inputs(prefix: Column, postfix: Column, length: int) -> dict[str, Column]:
    """Tokens, their mask, the autoregressive mask and the loss mask, all cut or padded to a length."""
    both = F.concat(prefix, postfix)
    causal = postfix_mask(prefix, postfix, length)
    return {"tokens": pad_tokens(both, length), "token_mask": token_mask(both, length), "ar_mask": causal, "loss_mask": F.transform(causal, lambda v: v == 1)}
