"""Suffix-array dedup of byte passages, by external induced sorting.

A shard holds the distinct segments whose windows may repeat, each with a separator of its own. Its suffixes are
sorted by recursive induction in external memory (``induced``): disk-backed priority queues carry tuples of a suffix
and its common prefix with the one before it, and what has the length of the shard is on disk beyond a memory limit.
Neighbours in the suffix array share a window when their common prefix has its length.

Defined results: null and empty texts lose nothing; bytes are those of the UTF-8 text, whatever
characters they cut; rows with the same doc_id never count as earlier than each other; a null doc_id
counts as larger than all others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strideframe.llm._common import table
from strideframe.llm.induced import MEMORY, blocks, byte_suffixes, scratch
from strideframe.llm.repeats import Spec, covered, mark_repeats
from strideframe.llm.words import mix

WINDOW = 50
ANCHOR = 16


def equal_windows(data: np.ndarray, lengths: np.ndarray, k: int = WINDOW, memory: int = MEMORY) -> np.ndarray:
    """A group number for each window of each segment: neighbours in the suffix array whose common prefix has ``k`` bytes."""
    n_windows = lengths - k + 1
    total = int(n_windows.sum())
    # the window that begins at a place, from 1; places count separators
    window_at = scratch(int(lengths.sum()) + len(lengths), np.int32 if total < 1 << 31 else np.int64, memory)
    begin, window = np.cumsum(lengths + 1) - lengths - 1, np.cumsum(n_windows) - n_windows
    for a, b in blocks(len(lengths), max(64, memory >> 12)):
        own = np.arange(int(window[a]), int(window[b - 1] + n_windows[b - 1]))
        window_at[own + np.repeat(begin[a:b] - window[a:b], n_windows[a:b])] = own + 1
    out, group = scratch(total, np.int64, memory), 0
    for rows, prefix in byte_suffixes(data, lengths, k, memory):
        number = group + np.cumsum(prefix < k)
        group = int(number[-1])
        at = window_at[rows]
        out[at[at > 0] - 1] = number[at > 0]
    return out


_CODE = mix(np.arange(1, 257, dtype=np.uint64))


def _bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


def _codes(units: np.ndarray) -> np.ndarray:
    return _CODE[units]


SPEC = Spec(units=_bytes, codes=_codes, dtype=np.uint8, k=WINDOW, m=ANCHOR, group=equal_windows, within=False)


def removed_bytes(docs: DataFrame) -> DataFrame:
    """doc_id and the spans (begin, end) of bytes that a smaller doc_id has too, in passages of 50 bytes or more."""

    def finish(rows: list, runs: list[np.ndarray]) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        spans = [[{"begin": int(a), "end": int(b)} for a, b in merged(r)] for r in runs]
        return pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.int64()), pa.array(spans, kind)], ["doc_id", "spans"])

    return mark_repeats(docs, SPEC, finish, "doc_id long, spans array<struct<begin:long,end:long>>")


def merged(runs: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, runs.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay."""

    def finish(rows: list, runs: list[np.ndarray]) -> pa.RecordBatch:
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for (_, raw, doc_id), spans in zip(rows, runs):
            gone, n = covered(spans, len(raw))
            out["doc_id"].append(doc_id)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(n)
            out["kept_sha256"].append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes() if n else raw).hexdigest())
        return pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return mark_repeats(docs, SPEC, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte passages of every whole text of documents that stand in a smaller doc_id."""
    return dedup_bytes(table(spark, sf_dir, "documents"))
