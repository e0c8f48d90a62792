"""Substring dedup of word passages with prefix-partitioned suffix trees.

A shard's suffixes are split by prefixes of variable length: by their first word, and where too many
share it by the next, until a group fits in memory or has a whole window in common. In each group the
sorted suffixes and their common prefixes give the subtree's internal nodes; a node at least as deep as
a window is a maximal repeat, and the suffixes below it share that window. Which suffixes meet in a shard is
decided by anchors (``repeats``), not by prefixes: neighbouring suffixes have no prefix in common, so each would
have to carry its window alone.

Defined results: null and empty texts have no words and the digest of no bytes; rows with the same
doc_id count as one document, in which an earlier start decides; a null doc_id counts as larger than
all others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strideframe.llm._common import table
from strideframe.llm.repeats import Spec, covered, mark_repeats
from strideframe.llm.words import hashes

WINDOW = 20
ANCHOR = 4
#: Suffixes in a group: at most so many are sorted together.
GROUP = 1 << 16


def prefix_groups(words: np.ndarray, starts: np.ndarray, depth: int, limit: int = GROUP) -> Iterator[tuple[np.ndarray, int]]:
    """(suffixes, words that they have in common) in groups of at most ``limit``, or with ``depth`` words in common.

    Small neighbours travel together; their groups then have no common prefix.
    """
    todo = [(starts, 0)]
    held: list[np.ndarray] = []
    size = 0
    while todo:
        rows, common = todo.pop()
        if common >= depth:
            yield rows, common
        elif len(rows) <= limit:
            if size + len(rows) > limit:
                yield np.concatenate(held), 0
                held, size = [], 0
            held.append(rows)
            size += len(rows)
        else:
            key = words[rows + common]
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])).tolist() + [len(rows)]
            todo += [(rows[order[a:b]], common + 1) for a, b in zip(cuts, cuts[1:])]
    if held:
        yield np.concatenate(held), 0


class Subtree:
    """The suffixes of a group in order, with the common prefix of each and the one before it, up to ``depth`` words."""

    def __init__(self, words: np.ndarray, rows: np.ndarray, common: int, depth: int):
        if common >= depth:
            self.rows, self.lcp = rows, np.full(len(rows), depth, np.int64)
            self.lcp[:1] = 0
            return
        columns = words[rows[:, None] + np.arange(common, depth)]
        order = np.lexsort(columns.T[::-1])
        self.rows, columns = rows[order], columns[order]
        differ = columns[1:] != columns[:-1]
        self.lcp = np.concatenate([[0], common + np.where(differ.any(1), differ.argmax(1), depth - common)])

    def internal_nodes(self) -> Iterator[tuple[int, int, int]]:
        """(depth, first row, end) of every internal node, children before parents."""
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate([*self.lcp[1:].tolist(), 0], 1):
            first = i - 1
            while stack and stack[-1][0] > depth:
                d, first = stack.pop()
                yield d, first, i
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, first))

    def deep_nodes(self, depth: int) -> np.ndarray:
        """For each row the number of the topmost internal node of at least ``depth`` words above it; a row without one has its own."""
        return np.cumsum(self.lcp < depth) - 1


def equal_windows(words: np.ndarray, lengths: np.ndarray, k: int = WINDOW, limit: int = GROUP) -> np.ndarray:
    """A group number for each window of each segment: the deep internal node above it."""
    n_windows = lengths - k + 1
    first, start = np.cumsum(lengths) - lengths, np.cumsum(n_windows) - n_windows
    total = int(n_windows.sum())
    places = np.arange(total) - np.repeat(start - first, n_windows)
    window_at = np.zeros(len(words) + 1, np.int64)
    window_at[places] = np.arange(total)
    out, seen = np.empty(total, np.int64), 0
    for rows, common in prefix_groups(words, places, k, limit):
        tree = Subtree(words, rows, common, k)
        nodes = tree.deep_nodes(k)
        out[window_at[tree.rows]] = nodes + seen
        seen += int(nodes[-1]) + 1 if len(nodes) else 0
    return out


def maximal_repeats(words: np.ndarray, lengths: np.ndarray, k: int = WINDOW, depth: int = 256, limit: int = GROUP) -> Iterator[tuple[int, np.ndarray]]:
    """(words, places) of the internal nodes of at least ``k`` words, looked at to ``depth`` words; for reports on a shard."""
    first = np.cumsum(lengths) - lengths
    ends = np.repeat(first + lengths, lengths)
    padded = np.concatenate([words, np.zeros(depth, np.uint64)])
    starts = np.arange(len(words))
    for rows, common in prefix_groups(padded, starts[ends - starts >= k], k, limit):
        tree = Subtree(padded, rows, min(common, k - 1), depth)
        left = ends[tree.rows] - tree.rows
        tree.lcp[1:] = np.minimum(tree.lcp[1:], np.minimum(left[1:], left[:-1]))
        for d, a, b in tree.internal_nodes():
            if d >= k:
                yield d, tree.rows[a:b]


def _words(raw: bytes) -> np.ndarray:
    return hashes(raw.split())


def _codes(units: np.ndarray) -> np.ndarray:
    return units


SPEC = Spec(units=_words, codes=_codes, dtype=np.uint64, k=WINDOW, m=ANCHOR, group=equal_windows, within=True)


def dedup_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans and the digest of the words that stay, joined by one space."""

    def finish(rows: list, runs: list[np.ndarray]) -> pa.RecordBatch:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for (_, raw, doc_id), spans in zip(rows, runs):
            words = raw.split()
            gone, n = covered(spans, len(words))
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if n else words
            out["doc_id"].append(doc_id)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(n)
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return mark_repeats(docs, SPEC, finish, "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string")


def kept_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text that stays, its words joined by one space."""

    def finish(rows: list, runs: list[np.ndarray]) -> pa.RecordBatch:
        texts = []
        for (_, raw, _), spans in zip(rows, runs):
            words = raw.split()
            gone, _ = covered(spans, len(words))
            texts.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
        return pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return mark_repeats(docs, SPEC, finish, "doc_id long, text string")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word passages of every whole text of documents that stand earlier."""
    return dedup_words(table(spark, sf_dir, "documents"))
