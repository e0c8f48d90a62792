"""Projection and renaming of nested samples, and groups of transforms."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.functions import arrays, tokens

Transform = Callable[[DataFrame], DataFrame]


def flat_names(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of all leaves, with slashes."""
    out: list[str] = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += flat_names(f.dataType, f"{path}/") if isinstance(f.dataType, T.StructType) else [path]
    return out


def leaf(path: str) -> Column:
    parts = path.split("/")
    out = F.col(f"`{parts[0]}`")
    for p in parts[1:]:
        out = out.getField(p)
    return out


def _struct(tree: dict) -> Column:
    return F.struct(*[(_struct(v) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()])


def from_tree(df: DataFrame, tree: dict) -> DataFrame:
    """A row shaped as the tree, whose leaves are columns."""
    return df.select(*[(_struct(v) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()])


def unflatten(leaves: dict[str, Column]) -> dict:
    tree: dict = {}
    for path, value in leaves.items():
        *nodes, last = path.split("/")
        at = tree
        for n in nodes:
            at = at.setdefault(n, {})
            if not isinstance(at, dict):
                raise ValueError(f"{path}: a leaf stands where a node is needed")
        if last in at:
            raise ValueError(f"{path} stands twice, or is a node and a leaf")
        at[last] = value
    return tree


def repack(structure: dict) -> Transform:
    """Rows with the given structure, whose leaves name old paths; top-level columns with a leading underscore stay."""

    def run(df: DataFrame) -> DataFrame:
        known = set(flat_names(df.schema)) | set(df.columns)

        def build(tree: dict) -> dict:
            out = {}
            for k, v in tree.items():
                if isinstance(v, dict):
                    out[k] = build(v)
                elif v in known:
                    out[k] = leaf(v)
                else:
                    raise KeyError(v)
            return out

        kept = {c: F.col(f"`{c}`") for c in df.columns if c.startswith("_")}
        return from_tree(df, build(structure) | kept)

    return run


def rename_paths(patterns: dict[str, str | None], names: list[str]) -> dict[str, str]:
    """Old path of each new path: the first pattern that matches a whole path renames it, None drops it."""
    out: dict[str, str] = {}
    for name in names:
        new: str | None = name
        for pattern, to in patterns.items():
            if m := re.fullmatch(pattern, name):
                new = None if to is None else m.expand(to)
                break
        if new is not None:
            if new in out:
                raise ValueError(f"{new} would stand for {out[new]} and {name}")
            out[new] = name
    ordered = sorted(out)
    for a, b in zip(ordered, ordered[1:]):
        if b.startswith(f"{a}/"):
            raise ValueError(f"{a} would be a leaf and a node")
    return out


def rename(patterns: dict[str, str | None]) -> Transform:
    """rename_paths over the leaves of a row."""
    return lambda df: from_tree(df, unflatten({new: leaf(old) for new, old in rename_paths(patterns, flat_names(df.schema)).items()}))


def apply_leaves(selected: list[str], fn: Callable[[str, Column], Column], strict: bool = False) -> Transform:
    """fn over the selected leaves, the others unchanged; with ``strict`` a missing one is an error."""

    def run(df: DataFrame) -> DataFrame:
        names = flat_names(df.schema)
        if strict and (missing := set(selected) - set(names)):
            raise ValueError(f"no such leaves: {sorted(missing)}")
        return from_tree(df, unflatten({n: fn(n, leaf(n)) if n in selected else leaf(n) for n in names}))

    return run


def compose(*steps: Transform) -> Transform:
    """Left to right."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


@dataclass(frozen=True)
class Group:
    """Transforms of inputs and outputs; what is pushed later comes last on the way in and first on the way out."""

    inputs: tuple[Transform, ...] = field(default=())
    outputs: tuple[Transform, ...] = field(default=())

    def push(self, *, inputs: tuple[Transform, ...] = (), outputs: tuple[Transform, ...] = ()) -> Group:
        return replace(self, inputs=(*self.inputs, *inputs), outputs=(*outputs, *self.outputs))


def normalise(stats: dict[str, dict[str, list[float]]] | None, quantiles: bool = False, strict: bool = False) -> Transform:
    """Leaves that have statistics, by them: mean and std, or q01 and q99; others unchanged. No statistics change nothing; ``strict``: each must have its leaf."""
    return _by_stats(stats, ("q01", "q99") if quantiles else ("mean", "std"), arrays.quantile_scale if quantiles else arrays.zscore, strict)


def unnormalise(stats: dict[str, dict[str, list[float]]] | None, quantiles: bool = False) -> Transform:
    """The inverse, in which all statistics must have their leaves."""
    return _by_stats(stats, ("q01", "q99") if quantiles else ("mean", "std"), arrays.quantile_back if quantiles else arrays.zscore_back, True)


def _by_stats(stats: dict[str, dict[str, list[float]]] | None, names: tuple[str, str], fn: Callable[..., Column], strict: bool) -> Transform:
    def value(numbers: list[float] | None) -> Column:
        return F.lit(None).cast("array<double>") if numbers is None else F.array(*[F.lit(float(x)) for x in numbers])

    if stats is None:
        return lambda df: df
    return apply_leaves(list(stats), lambda path, x: fn(x.cast("array<double>"), *[value(stats[path].get(n)) for n in names]), strict)


def default_prompt(prompt: str | None) -> Transform:
    """A prompt column where there is none; nulls in an existing one stay."""
    return lambda df: df if prompt is None or "prompt" in df.columns else df.withColumn("prompt", F.lit(prompt))


def dataset_index(i: int) -> Transform:
    return lambda df: df.withColumn("_dataset_idx", F.lit(i).cast("int"))


def concat_actions(keys: list[str], output: str = "actions", mask: str | None = None) -> Transform:
    """The action columns as one array, in order; the sources go. ``mask`` names an all-true array of its length."""

    def run(df: DataFrame) -> DataFrame:
        if missing := [k for k in keys if k not in df.columns]:
            raise ValueError(f"missing action columns: {missing}")
        out = df.withColumn(output, F.concat(*[F.col(k).cast("array<double>") for k in keys]))
        out = out.withColumn(mask, F.transform(output, lambda _: F.lit(True))) if mask else out
        return out.drop(*[k for k in keys if k != output])

    return run


def concat_by_dataset(keys: list[list[str]], output: str = "actions") -> Transform:
    """The columns that the row's dataset names, as one array; the marker goes, the sources stay."""

    def run(df: DataFrame) -> DataFrame:
        out = F.raise_error(F.concat(F.lit("no such dataset: "), F.col("_dataset_idx").cast("string"))).cast("array<double>")
        for i, names in enumerate(keys):
            if missing := [k for k in names if k not in df.columns]:
                raise ValueError(f"missing action columns: {missing}")
            out = F.when(F.col("_dataset_idx") == i, F.concat(*[F.col(k).cast("array<double>") for k in names])).otherwise(out)
        return df.withColumn(output, out).drop("_dataset_idx")

    return run


def prompt_from_task(tasks: DataFrame) -> Transform:
    """prompt from task_index by a table (task_index, task); an index without a task is an error."""

    def run(df: DataFrame) -> DataFrame:
        found = df.join(tasks.select("task_index", F.col("task").alias("prompt")), "task_index", "left")
        return found.withColumn("prompt", F.coalesce("prompt", F.raise_error(F.concat(F.lit("no task "), F.col("task_index").cast("string"))).cast("string")))

    return run


def _require(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing: {missing}")


def _prompt() -> Column:
    return F.coalesce("prompt", F.raise_error(F.lit("a prompt is required")).cast("string"))


Encode = Callable[[list[str]], list[list[int]]]


def tokenise_prompt(encode: Encode, length: int, with_state: bool = False) -> Transform:
    """tokenized_prompt and its mask instead of the prompt, cut or padded to a length. ``with_state``: the state's digits follow the task. A null prompt is an error."""

    def run(df: DataFrame) -> DataFrame:
        _require(df, "prompt", *(["state"] if with_state else []))
        text = tokens.state_prompt(_prompt(), F.col("state")) if with_state else F.concat(tokens.clean_prompt(_prompt()), F.lit("\n"))
        out = df.withColumn("tokens__", tokens.tokenise(text, encode)).drop("prompt")
        return out.withColumns({"tokenized_prompt": tokens.pad_tokens(F.col("tokens__"), length), "tokenized_prompt_mask": tokens.token_mask(F.col("tokens__"), length)}).drop("tokens__")

    return run


def tokenise_actions(encode: Encode, encode_actions: Callable[[Column], Column], end: list[int], length: int) -> Transform:
    """The prompt with its state, then the actions' tokens and the end's: tokens, mask, what attends causally, what counts in the loss.

    encode_actions: the actions column -> an array of token numbers. Rows without actions end behind the prompt.
    """

    def run(df: DataFrame) -> DataFrame:
        _require(df, "prompt", "state")
        out = df.withColumn("prefix__", tokens.tokenise(tokens.state_prompt(_prompt(), F.col("state")), encode)).drop("prompt")
        postfix = F.array().cast("array<int>")
        if "actions" in df.columns:
            postfix = F.when(F.col("actions").isNull(), postfix).otherwise(F.concat(encode_actions(F.col("actions")).cast("array<int>"), F.array(*map(F.lit, end)).cast("array<int>")))
        parts = tokens.causal_inputs(F.col("prefix__"), F.col("postfix__"), length)
        names = {"tokens": "tokenized_prompt", "token_mask": "tokenized_prompt_mask", "ar_mask": "token_ar_mask", "loss_mask": "token_loss_mask"}
        return out.withColumn("postfix__", postfix).withColumns({names[k]: v for k, v in parts.items()}).drop("prefix__", "postfix__")

    return run


def extract_actions(decode: Callable[[Column], Column], horizon: int, dim: int) -> Transform:
    """Actions (horizon x dim) from the action tokens that a model gave; rows without them stay as they are.

    decode: the array of tokens -> an array of values. Values that are missing are zero, those beyond are cut.
    """

    def run(df: DataFrame) -> DataFrame:
        if "actions" not in df.columns:
            return df
        flat = F.slice(F.concat(decode(F.col("actions")).cast("array<double>"), F.array_repeat(F.lit(0.0), horizon * dim)), 1, horizon * dim)
        rows = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.slice(F.col("flat__"), i * dim + 1, F.lit(dim)))
        return df.withColumn("flat__", flat).withColumn("actions", F.when(F.col("flat__").isNotNull(), rows)).drop("flat__")

    return run


def drop_strings(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, T.StringType)])


def merge_names(loaded: list[str], reference: list[str], missing: str) -> dict[str, bool]:
    """Names of a merged tree: those loaded that the reference has (True), and missing ones that the pattern allows (False)."""
    have = [n for n in loaded if n in set(reference)]
    return {n: True for n in have} | {n: False for n in reference if n not in set(have) and re.fullmatch(missing, n)}


def action_keys(keys: list[str], masked: list[bool], hidden: str = "hand_status") -> list[list[str]]:
    """The action columns of each dataset: a masked one goes without its hands."""
    return [[k for k in keys if not (m and k == hidden)] for m in masked]
