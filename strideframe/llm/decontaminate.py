"""Benchmark decontamination by suffix arrays of the training text.

A few megabytes of documents are a shard, and each shard gets a suffix array over all its words; every
document ends in a separator of its own, so that no match crosses it. Every benchmark suffix is searched in
every shard: word by word, two binary searches narrow the interval of suffixes that begin with it. An interval
that is left at the depth of a window holds all verbatim places, and places that continue each other on one
diagonal are the longest matches.

The benchmark goes out in blocks of a bounded size, one broadcast each. Neither the driver nor a task ever holds
more than one of them, and a shard's suffix array serves them all.

Defined results: null and empty texts have no words and are clean; an item without words is never
found; an empty benchmark leaves all documents clean; items with one item_id are one item; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm._common import bound_batches, slices, table
from strideframe.llm.words import alnum_words, hashes

WINDOW = 10
#: Benchmark text in one block, of which each task holds one at a time, and training text in one shard.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 4 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of small integers, of which the last stands nowhere else: by two symbols, then twice as many each round."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    key = text.astype(np.int64) * (int(text.max()) + 1)
    key[:-1] += text[1:]
    rows, rank, ahead = np.arange(n), np.zeros(n, np.int64), 2
    while len(rows):
        order = np.argsort(key)
        rows, key = rows[order], key[order]
        old = rank[rows]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(rows))
        # a rank is the place of the first suffix that shares it
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
        rank[rows] = old + np.maximum.accumulate(np.where(head, place, 0)) - group
        rows = rows[~(head & np.concatenate([head[1:], [True]]))]
        key = rank[rows] * (n + 1) + rank[np.minimum(rows + ahead, n - 1)]
        ahead *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Tests:
    """The benchmark suffixes of a block: all words, and where the item of each ends."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        each = [hashes(alnum_words(t)) for _, t in items]
        sizes = np.array([len(h) for h in each], np.int64)
        self.ids = [str(i) for i, _ in items]
        self.words = np.concatenate([np.empty(0, np.uint64), *each])
        self.item = np.repeat(np.arange(len(items)), sizes)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.at = np.arange(len(self.words)) - begin
        #: words that a suffix must match: a window, or the whole of a shorter item
        self.need = np.minimum(window, np.repeat(sizes, sizes))
        self.use = np.flatnonzero(np.repeat(sizes, sizes) - self.at >= self.need)


class Shard:
    """Documents with the suffix array of their words."""

    def __init__(self, texts: list[str | None]):
        split = [alnum_words(t) for t in texts]
        self.counts = np.array([len(w) for w in split], np.int64)
        flat = hashes([w for doc in split for w in doc])
        number, known = pd.factorize(flat)
        order = np.argsort(known)
        self.known, code = known[order], np.argsort(order)[number]
        #: places of the separators, which are the least symbols
        self.ends = np.cumsum(self.counts + 1) - 1
        self.text = np.empty(len(flat) + len(split), np.int64)
        word = np.ones(len(self.text), bool)
        word[self.ends] = False
        self.text[self.ends] = np.arange(len(split))
        self.text[word] = code + len(split)
        self.sa = suffix_array(self.text)

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: int, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each interval whose suffixes have a symbol at a depth, by two binary searches."""
        out = []
        for upper in (False, True):
            a, b = lo.copy(), hi.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                # an interval's suffixes have `depth` words in common, so none of them ends before
                there = self.text[self.sa[np.minimum(mid, len(self.sa) - 1)] + depth * open_]
                right = (there <= symbol) if upper else (there < symbol)
                a = np.where(open_ & right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            out.append(a)
        return out[0], out[1]

    def matches(self, tests: Tests) -> np.ndarray:
        """Rows (place, length, item, place in item) of every window of the tests that occurs here."""
        found = [np.empty((0, 4), np.int64)]
        if len(self.known) and len(tests.use):
            near = np.minimum(np.searchsorted(self.known, tests.words), len(self.known) - 1)
            symbol = np.where(self.known[near] == tests.words, near + len(self.counts), -1)
            use = tests.use
            lo, hi = np.zeros(len(use), np.int64), np.full(len(use), len(self.sa))
            for depth in range(int(tests.need[use].max())):
                lo, hi = self.narrow(lo, hi, depth, symbol[use + depth])
                some = lo < hi
                use, lo, hi = use[some], lo[some], hi[some]
                done = tests.need[use] == depth + 1
                if done.any():
                    test, first, count = use[done], lo[done], (hi - lo)[done]
                    inside = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
                    test = np.repeat(test, count)
                    found.append(np.stack([self.sa[inside], tests.need[test], tests.item[test], tests.at[test]], 1))
                    use, lo, hi = use[~done], lo[~done], hi[~done]
                if not len(use):
                    break
        return np.concatenate(found)

    def places(self, blocks: Iterator[Tests]) -> list[list[dict]]:
        """The longest verbatim matches of each document, over all blocks of tests."""
        each: list[list[dict]] = [[] for _ in self.counts]
        for tests in blocks:
            got = longest(self.matches(tests))
            of = np.searchsorted(self.ends, got[:, 0])
            begin = self.ends - self.counts
            for d, (place, length, item, at) in zip(of.tolist(), got.tolist()):
                each[d].append({"word": place - int(begin[d]), "length": length, "item": tests.ids[item], "item_word": at})
        return each


def longest(rows: np.ndarray) -> np.ndarray:
    """Windows joined along their diagonals: rows (place, length, item, place in item) of maximal verbatim matches."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 0], rows[:, 0] - rows[:, 3], rows[:, 2]))]
    same = (rows[1:, 2] == rows[:-1, 2]) & (rows[1:, 0] - rows[1:, 3] == rows[:-1, 0] - rows[:-1, 3]) & (rows[1:, 0] == rows[:-1, 0] + 1)
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    end = np.concatenate([begin[1:], [len(rows)]]) - 1
    out = rows[begin].copy()
    out[:, 1] = rows[end, 0] + rows[end, 1] - rows[begin, 0]
    return out


_PLACE = pa.list_(pa.struct([("word", pa.int64()), ("length", pa.int64()), ("item", pa.string()), ("item_word", pa.int64())]))
_PLACES = "array<struct<word:long,length:long,item:string,item_word:long>>"


def broadcast_tests(benchmark: DataFrame, window: int, block_bytes: int) -> list[Broadcast]:
    """The benchmark in blocks of about ``block_bytes`` of text; the driver reads one, sends it out and forgets it."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = int(items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0)
    n = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [spark.sparkContext.broadcast(Tests([tuple(r) for r in (items.where(block == k) if n > 1 else items).toLocalIterator()], window)) for k in range(n)]


def _each(blocks: list[Broadcast]) -> Iterator[Tests]:
    """One block after the other; with several, each is let go before the next is loaded."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            del block._value


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about SHARD_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, limit=SHARD_BYTES):
            if held and size + part.column("text").nbytes > SHARD_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.column("text").nbytes
    if held:
        yield pa.concat_batches(held)


def map_shards(docs: DataFrame, benchmark: DataFrame, rows: Callable[[pa.RecordBatch, np.ndarray, list[list[dict]]], pa.RecordBatch], schema: str, window: int, block_bytes: int) -> DataFrame:
    """What ``rows`` makes of each shard, the words of its documents and their matches."""
    blocks = broadcast_tests(benchmark, window, block_bytes)

    def run(batches):
        for part in _shards(batches):
            shard = Shard(part.column("text").to_pylist())
            yield rows(part, shard.counts, shard.places(_each(blocks)))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words and the longest verbatim matches (word, length, item, item_word) of each document."""

    def rows(part: pa.RecordBatch, counts: np.ndarray, found: list[list[dict]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(found, _PLACE)], ["doc_id", "n_words", "places"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_shards(own, benchmark, rows, f"doc_id long, n_words long, places {_PLACES}", window, block_bytes)


def summarise(found: DataFrame) -> DataFrame:
    """Counts and digests from the places of each document."""

    def run(batches):
        for batch in batches:
            out = {"doc_id": batch.column("doc_id").to_pylist(), "n_words": batch.column("n_words").to_pylist(), "n_hit": [], "n_items": [], "items_sha256": [], "contaminated": [], "longest_match": []}
            for places in batch.column("places").to_pylist():
                hit, end = 0, -1
                for a, b in sorted((p["word"], p["word"] + p["length"]) for p in places):
                    hit += max(0, b - max(a, end))
                    end = max(end, b)
                items = sorted({p["item"] for p in places})
                out["n_hit"].append(hit)
                out["n_items"].append(len(items))
                out["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
                out["contaminated"].append(hit > 0)
                out["longest_match"].append(max((p["length"] for p in places), default=0))
            yield pa.RecordBatch.from_pydict(out)

    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every whole text of documents."""
    return summarise(find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("longest_match")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without those that hold a benchmark window; their columns are unchanged."""

    def rows(part: pa.RecordBatch, counts: np.ndarray, found: list[list[dict]]) -> pa.RecordBatch:
        return part.filter(pa.array([not p for p in found], pa.bool_()))

    return map_shards(docs, benchmark, rows, docs.schema, window, block_bytes)
