"""SimHash near-duplicates, searched with vantage-point trees.

A tree is built on the driver from a bounded sample of fingerprints. At each node, those within the
median distance of a vantage point go inside, the others outside; one that is outside by no more
than the search radius is also sent inside, which the triangle inequality shows to be enough to meet
every partner. Leaves are shards: within one, a local tree prunes by the same bound and the last
blocks are compared exactly. A leaf reports a spanning forest of its links, never all pairs.

Equal fingerprints are one node, so groups of copies shrink before anything is shuffled.

Defined results: a null or empty text has the fingerprint zero, linked like any other; fewer words
than a shingle make one shingle; repeated rows get the same component; a null doc_id takes part and
is never the smallest; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe.llm._common import bound_batches, map_texts, slices, table, text_bytes
from strideframe.llm.components import components
from strideframe.llm.storage import discard, materialise
from strideframe.llm.words import mix, raw

SEED = 42
#: Fingerprints that the driver may hold to build a tree; it gets an eighth of all at most.
SAMPLE = 1 << 18
#: Fingerprints that a shard should hold, and that a block compares with each other.
LEAF, BLOCK = 4096, 512


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of words, repeats included."""
    split = raw(text).lower().split()
    if not split:
        return np.empty(0, np.uint64)
    joined = b" ".join(split)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(split) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[words - 1 :].tolist())], np.uint64)


def fingerprints(each: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array of hashes: bits set in over half of them; no hashes give zero."""
    out = np.zeros(len(each), np.uint64)
    use = [i for i, h in enumerate(each) if len(h)]
    if use:
        sizes = np.array([len(each[i]) for i in use])
        flat = np.concatenate([each[i] for i in use]).astype("<u8")
        step = 1 << 18  # hashes unpacked at a time
        counts = np.zeros((len(use), 64), np.int64)
        owner = np.repeat(np.arange(len(use)), sizes)
        for k in range(0, len(flat), step):
            bits = np.unpackbits(flat[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = owner[k : k + step]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts[own[first]] += np.add.reduceat(bits, first, 0, dtype=np.int64)
        ones = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")
        out[use] = np.ascontiguousarray(ones).view("<u8")[:, 0]
    return out


class Tree:
    """Nodes as arrays: vantage point, bound, and the inside and outside child; a leaf's children are -1."""

    def __init__(self, sample: np.ndarray, total: int, radius: int, leaf: int = LEAF, seed: int = 5):
        self.radius = radius
        self.vantage, self.bound, self.inside, self.outside = [], [], [], []
        self._rng = np.random.default_rng(seed)
        self._scale = total / max(len(sample), 1)
        todo = [(sample, self._node())]
        while todo:
            rows, at = todo.pop()
            if len(rows) * self._scale <= leaf or len(rows) < 32:
                continue
            if (cut := split(rows, self.radius, self._rng)) is None:
                continue
            self.vantage[at], self.bound[at] = cut
            d = np.bitwise_count(rows ^ self.vantage[at]).astype(np.int16)
            self.inside[at], self.outside[at] = self._node(), self._node()
            todo += [(rows[d <= cut[1] + self.radius], self.inside[at]), (rows[d > cut[1]], self.outside[at])]
        self.arrays = tuple(np.array(x, t) for x, t in ((self.vantage, np.uint64), (self.bound, np.int16), (self.inside, np.int64), (self.outside, np.int64)))

    def _node(self) -> int:
        self.vantage.append(np.uint64(0))
        self.bound.append(0)
        self.inside.append(-1)
        self.outside.append(-1)
        return len(self.vantage) - 1

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every shard that a fingerprint belongs to or whose boundary it overlaps."""
        vantage, bound, inside, outside = self.arrays
        rows, at = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        done_rows, done_leaf = [], []
        while len(rows):
            leaf = inside[at] < 0
            done_rows.append(rows[leaf])
            done_leaf.append(at[leaf])
            rows, at = rows[~leaf], at[~leaf]
            d = np.bitwise_count(fps[rows] ^ vantage[at]).astype(np.int16)
            go_in, go_out = d <= bound[at] + self.radius, d > bound[at]
            rows, at = np.concatenate([rows[go_in], rows[go_out]]), np.concatenate([inside[at[go_in]], outside[at[go_out]]])
        return np.concatenate(done_rows), np.concatenate(done_leaf)


def split(rows: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The vantage point and bound that shrink both sides most for what they repeat; None if nothing shrinks."""
    look = rows if len(rows) <= 2048 else rows[rng.integers(0, len(rows), 2048)]
    best, out = 0.995, None
    for v in rows[rng.integers(0, len(rows), tries)]:
        below = np.cumsum(np.bincount(np.bitwise_count(look ^ v), minlength=65)) / len(look)
        for bound in range(64 - radius):
            ins, outs = below[bound + radius], 1 - below[bound]
            if 0 < outs and ins < 1 and (cost := ins * ins + outs * outs) < best:
                best, out = cost, (v, bound)
    return out


def close_pairs(fps: np.ndarray, rows: np.ndarray, radius: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within the radius, some of them more than once."""
    todo = [rows]
    while todo:
        rows = todo.pop()
        cut = split(fps[rows], radius, rng) if len(rows) > BLOCK else None
        if cut:
            d = np.bitwise_count(fps[rows] ^ cut[0]).astype(np.int16)
            todo += [rows[d <= cut[1] + radius], rows[d > cut[1]]]
            continue
        own = fps[rows]
        for k in range(0, len(rows), BLOCK):
            a, b = np.nonzero(np.bitwise_count(own[k : k + BLOCK, None] ^ own[None, k:]) <= radius)
            keep = a < b
            if keep.any():
                yield rows[k + a[keep]], rows[k + b[keep]]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row of each row's component."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b = a[differ], b[differ]
            np.minimum.at(root, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
            while not np.array_equal(hop := root[root], root):
                root = hop
    return root


def link(nodes: DataFrame, radius: int, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) that join all fingerprints ``fp`` of a table of distinct ones within the radius of each other, over any number of steps."""
    total = nodes.count()
    # a share of the fingerprints, never all of them; those of one leaf need no tree
    share = min(sample, total / 8) / total if total > leaf else 0.0
    drawn = nodes.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * share)).select("fp").orderBy("fp").collect() if share else []
    held = np.array([r["fp"] for r in drawn], np.int64).view(np.uint64)
    tree = Tree(held, total, radius, leaf)

    def send(batches):
        for batch in batches:
            fps = np.array(batch.column("fp"), np.int64)
            rows, leaves = tree.route(fps.view(np.uint64))
            for k in range(0, len(rows), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(leaves[k : k + (1 << 18)]), pa.array(fps[rows[k : k + (1 << 18)]])], ["leaf", "fp"])

    def within(group: pa.Table) -> pa.Table:
        fps = np.unique(group.column("fp").to_numpy())
        root = forest(len(fps), close_pairs(fps.view(np.uint64), np.arange(len(fps)), radius, np.random.default_rng(9)))
        other = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"a": fps[other], "b": fps[root[other]]})

    shards = max(1, len(tree.vantage) // 16)  # some eight leaves each
    return nodes.select("fp").mapInArrow(send, "leaf long, fp long").repartition(shards, "leaf").groupBy("leaf").applyInArrow(within, "a long, b long")


def fingerprint_documents(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and the 64-bit fingerprint ``fp`` of every whole text."""

    def rows():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = fingerprints([shingle_hashes(t, words) for t in batch.column("text").to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

        return step

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, "doc_id long, fp long")


def components_of(marked: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp and component_id of a written table (doc_id, fp)."""
    nodes, _ = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots, _ = materialise(components(link(nodes, radius)))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_doc")
    least = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return marked.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    marked, _ = materialise(fingerprint_documents(docs, words))
    return components_of(marked, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Pipeline defaults: words of a shingle and the least similarity of near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits within which fingerprints of two texts make them candidates.
RADIUS = 2
#: Rows of an Arrow batch of pairs with their sets: a long text's set takes hundreds of kilobytes.
PAIR_ROWS = 64
#: Rows whose shingles are counted to put common shingles last, shingles that are put last, and their least count.
COUNTED, COMMON, OFTEN = 1 << 14, 1 << 18, 3
#: Rows of a class of which all pairs are looked at; larger classes are told apart by what their rows have unlike one of them.
SMALL = 64
#: Rows of a class that one task pairs with as many others.
CROWD = 1000


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text, as ascending mixed hashes."""
    return np.unique(mix(shingle_hashes(text, words)))


def sketches(texts: list[str | None], words: int) -> tuple[list[bytes], list[np.ndarray], list[bytes]]:
    """For each text: a key of its shingle set, the set, and the set as bytes."""
    each = [shingle_set(t, words) for t in texts]
    whole = [h.astype("<u8").tobytes() for h in each]
    return [xxhash.xxh3_128_digest(w) for w in whole], each, whole


def parities(h: np.ndarray) -> bytes:
    """Bits that say whether an odd number of the set's shingles falls on each: two to four for a shingle, a power of two, 64 at least.

    Two sets differ in no more bits than shingles. Both halves of the bits, one over the other, are those of half the number.
    """
    bits = 1 << max(6, (2 * len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_distance(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which the parities of pairs differ, at the shorter length of each pair."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(a), np.int64)
    for n, m in set(zip(la.tolist(), lb.tolist())):
        at = np.flatnonzero((la == n) & (lb == m))
        x, y = (np.frombuffer(b"".join(side[i] for i in at), "<u8").reshape(len(at), -1) for side in (a, b))
        while x.shape[1] != y.shape[1]:
            half = max(x.shape[1], y.shape[1]) // 2
            x, y = (z[:, :half] ^ z[:, half:] if z.shape[1] > half else z for z in (x, y))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def prefix(h: np.ndarray, least: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in an order that all sets share, so many that two similar sets must have one of them in common.

    Common shingles (ascending, with their ranks) come last. The order decides how many candidates there are, never which pairs are found.
    """
    size = len(h) - math.ceil(least * len(h) - 1e-6) + 1 if len(h) else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.argsort(np.where(common[at] == h, rank[at], 0), kind="stable")]
    return h[:size]


def common_shingles(cols: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of some rows have, ascending, and their counts."""
    total = cols.count()
    share = min(1.0, COUNTED / max(total, 1))
    some = cols.where(F.pmod(F.xxhash64("row__", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * share))

    def spread(batches):
        for batch in batches:
            for part in slices(batch):
                for t in part.column("text").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view(np.int64))], ["shingle"])

    bound_batches(cols.sparkSession)
    counted = some.select("text").distinct().mapInArrow(spread, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    rows = counted.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    found, n = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(found)
    return found[order], n[order]


def unlike_pairs(deltas: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) among rows with the same pivot, from their differences (a, b the pivot, size, delta) to its set.

    With Dx and Dy what x and y have unlike the pivot, x and y differ in |Dx| + |Dy| - 2 |Dx and Dy| shingles, and similar sets
    differ in w (|x| + |y|) at most, w = (1 - least) / (1 + least). So similar x and y share (|Dx| + |Dy| - w (|x| + |y|)) / 2
    elements of Dx and Dy at least: more than none, unless both are similar to the pivot, which links them. They meet in the first
    element that they share in an order by its count at the pivot, and behind it each has as many left. Rows of a family differ
    from each other mostly in what they share with few: such a pair is never made, as large as the family may be.
    """
    w = (1 - least) / (1 + least)
    each = deltas.select("a", "b", "size", F.size("delta").alias("span"), F.explode("delta").alias("shingle"))
    # what one row has alone comes first, and only its number matters
    held = each.groupBy("b", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    pair = Window.partitionBy("a", "b")
    rank = F.row_number().over(pair.orderBy("n", "shingle")) - 1
    placed = each.join(held, ["b", "shingle"]).withColumns({"pos": F.col("span") - F.count("*").over(pair) + rank, "parts": F.ceil(F.col("n") / CROWD).cast("int")})
    # a similar set differs in no more shingles than this; the side of the smaller difference needs half of it,
    # and (1 + w) / 2 of its own, as one of the two is not similar to the pivot
    top = F.col("size") * (w * (1 + 1 / least)) + 1e-6
    first = placed.where(F.col("pos") <= top).join(groups.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("group", F.coalesce("root", "a"))
    of = ("a", "size", "span", "pos", "group")
    low = first.where((F.col("pos") <= top / 2) & (F.col("pos") <= F.col("span") * ((1 + w) / 2) + 1e-6)).select("b", "shingle", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), *[F.col(c).alias(f"l_{c}") for c in of])
    high = first.select("b", "shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *of)
    sizes = (F.least("size", "l_size") >= least * F.greatest("size", "l_size") - 1e-6) & ((F.col("l_span") < F.col("span")) | ((F.col("l_span") == F.col("span")) & (F.col("l_a") < F.col("a"))))
    rest = 2 * F.least(F.col("span") - F.col("pos"), F.col("l_span") - F.col("l_pos")) >= F.col("span") + F.col("l_span") - w * (F.col("size") + F.col("l_size")) - 1e-6
    met = low.join(high, ["b", "shingle", "part"]).where((F.col("group") != F.col("l_group")) & sizes & rest)
    return met.select(F.greatest("a", "l_a").alias("a"), F.least("a", "l_a").alias("b"))


#: Bits of a filter of rows, in parts of 4096 bytes: 8 MB at most.
FILTER_BITS, PART_BITS = 1 << 26, 1 << 15


def sieve(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows with a column ``may__``: false if their ``row__`` is none of the wanted ones, true for those and few others.

    The filter is broadcast, with at most FILTER_BITS bits. So rows that are not looked for stay where they are; where far
    more rows are wanted than it has bits, it lets all pass, and the join behind it decides alone.
    """

    def place(df: DataFrame) -> DataFrame:
        at = F.pmod(F.xxhash64("row__"), F.lit(FILTER_BITS))
        return df.withColumns({"part__": F.floor(at / PART_BITS).cast("int"), "bit__": F.pmod(at, F.lit(PART_BITS)).cast("int")})

    bits = place(wanted.select("row__")).groupBy("part__").agg(F.bitmap_construct_agg(F.col("bit__").cast("long")).alias("bits__"))
    byte = F.conv(F.hex(F.substring("bits__", F.floor(F.col("bit__") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod("bit__", F.lit(8)))), F.lit(2)) == 1, F.lit(False))
    return place(rows).join(F.broadcast(bits), "part__", "left").withColumn("may__", may).drop("part__", "bit__", "bits__")


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE, least: float = SIMILARITY, rounds: int = 2, radius: int = RADIUS) -> DataFrame:
    """The documents with one, of the smallest doc_id, of each group of near duplicates; their columns are unchanged.

    Fingerprints within the radius of each other, found as in ``near_duplicates``, are compared first; whole shingle sets
    decide. The others have an exact way: two sets of at least this similarity share a shingle of their prefixes, so the
    rows with one prefix shingle are a class, and all pairs that matter meet in one. For some rounds each class is
    compared with one of its rows; then every pair of a small class that no links join yet is compared, and of a large one
    those that can be similar by what both have unlike one row of it (``unlike_pairs``).
    """
    spark = docs.sparkSession
    base, _ = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row__")))
    cols = base.select("row__", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))
    common, rank = common_shingles(cols, words)

    def rows():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, each, _ = sketches(batch.column("text").to_pylist(), words)
            firsts = [prefix(h, least, common, rank).view(np.int64) for h in each]
            ends = np.cumsum([0, *map(len, firsts)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *firsts])))
            sizes = pa.array([len(h) for h in each], pa.int32())
            fps, odd = pa.array(fingerprints(each).view(np.int64)), pa.array([parities(h) for h in each], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column("row__"), batch.column("doc_id"), pa.array(keys, pa.binary()), sizes, fps, lists, odd], ["row__", "doc_id", "key", "size", "fp", "first", "odd"])

        return step

    marked, marked_at = materialise(map_texts(cols, rows, "row__ long, doc_id long, key binary, size int, fp long, first array<long>, odd binary"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row__")
    sets, sets_at = materialise(marked.groupBy("key").agg(F.min(order).alias("lead")).select("key", F.col("lead.row__").alias("lead")))
    leads, leads_at = materialise(marked.join(sets.select(F.col("lead").alias("row__")), "row__", "left_semi").drop("doc_id", "key"))
    crowd = Window.partitionBy("shingle")
    spread = leads.select("row__", "size", F.posexplode("first").alias("pos", "shingle"))
    shared, shared_at = materialise(spread.withColumn("n", F.count("*").over(crowd)).where("n > 1"))
    # classes of the same rows are one class: that of the shingle which comes first in the common order
    same = shared.groupBy("shingle").agg(F.bit_xor(F.xxhash64("row__", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("row__", F.lit(2))).alias("y"), F.count("*").alias("n"), F.min(F.struct("row__", "pos")).alias("low"))
    one_each = same.groupBy("x", "y", "n", "low.row__").agg(F.min(F.struct("low.pos", "shingle")).alias("s")).select("s.shingle")
    classes, classes_at = materialise(shared.join(one_each, "shingle", "left_semi"))
    discard(spark, shared_at)
    # fingerprints of the different sets, one row for each
    nodes, nodes_at = materialise(leads.where("size > 0").groupBy("fp").agg(F.min("row__").alias("b")))
    near = link(nodes.select("fp"), radius).select(F.col("a").alias("fp"), F.col("b").alias("to"))
    linked = near.join(nodes.withColumnRenamed("b", "a"), "fp").select("a", F.col("to").alias("fp")).join(nodes, "fp").select("a", "b")
    equal = leads.where("size > 0").select(F.col("row__").alias("a"), "fp").join(nodes, "fp").where("a <> b").select("a", "b")
    found, found_at = materialise(linked.union(equal).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # what is read again is a small part of the table
    odd, odd_at = materialise(leads.select("row__", "size", "odd").join(classes.select("row__").union(found.select("a")).union(found.select("b")).distinct(), "row__", "left_semi"))
    with_prefixes = marked_at
    marked, marked_at = materialise(marked.select("row__", "doc_id", "key"))
    discard(spark, with_prefixes, leads_at, nodes_at)
    total = text_bytes(cols)

    def sets_of():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("row__"), pa.array(sketches(batch.column("text").to_pylist(), words)[2], pa.binary())], ["row__", "whole"])

        return step

    def by_parity(batches):
        for batch in batches:
            both = np.asarray(batch.column("size"), np.int64) + np.asarray(batch.column("b_size"), np.int64)
            differ = parity_distance(batch.column("odd").to_pylist(), batch.column("b_odd").to_pylist())
            # sets that differ in more bits than similar sets do in shingles need no more
            may = differ * (1 + least) <= (1 - least) * both + 1e-6
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(may), pa.array(8 * both)], ["a", "b", "may", "bytes"])

    def by_set(batches):
        for batch in batches:
            ok = [similarity(a, b) >= least for a, b in zip(batch.column("whole").to_pylist(), batch.column("other").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    def by_delta(batches):
        for batch in batches:
            whole, other = ([np.frombuffer(x, "<u8") for x in batch.column(c).to_pylist()] for c in ("whole", "other"))
            each = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(whole, other)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *each]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([len(x) for x in whole], pa.int32()), pa.array([len(y) for y in other], pa.int32()), lists], ["a", "b", "size", "b_size", "delta"])

    old = [marked_at, sets_at, classes_at, found_at, odd_at]

    def written(df: DataFrame) -> DataFrame:
        df, at = materialise(df)
        old.append(at)
        return df

    def in_small_batches(df: DataFrame) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        held = spark.conf.get(key)
        spark.conf.set(key, PAIR_ROWS)
        try:
            return written(df)
        finally:
            spark.conf.set(key, held)

    def compare(pairs: DataFrame) -> DataFrame:
        """(a, b, ok) of pairs (a, b)."""
        seen = pairs.join(odd.withColumnRenamed("row__", "a"), "a").join(odd.select(F.col("row__").alias("b"), F.col("size").alias("b_size"), F.col("odd").alias("b_odd")), "b")
        quick = written(seen.select("a", "b", "size", "b_size", "odd", "b_odd").mapInArrow(by_parity, "a long, b long, may boolean, bytes long"))
        may = quick.where("may")
        return over_sets(may, "b", by_set, "a long, b long, ok boolean").union(quick.where("NOT may").select("a", "b", F.lit(False).alias("ok")))

    def over_sets(pairs: DataFrame, by: str, step, schema: str) -> DataFrame:
        """``step`` over pairs (a, b, bytes) and their sets, those of one part of the pairs at a time."""
        # the sets of a part are on disk, a quarter of the texts' bytes or 64 MB
        parts = max(1, -(-int(pairs.agg(F.sum("bytes")).first()[0] or 0) // max(total // 4, 64 << 20)))
        out = []
        for k in range(parts):
            part = (pairs.where(F.pmod(F.xxhash64(by), F.lit(parts)) == k) if parts > 1 else pairs).select("a", "b")
            need, need_at = materialise(part.select(F.col("a").alias("row__")).union(part.select("b")).distinct())
            whole, whole_at = materialise(map_texts(sieve(cols.select("row__", "text"), need).where("may__").drop("may__").join(need.hint("merge"), "row__", "left_semi"), sets_of, "row__ long, whole binary"))
            both = part.join(whole.withColumnRenamed("row__", "a"), "a").join(whole.select(F.col("row__").alias("b"), F.col("whole").alias("other")), "b")
            out.append(in_small_batches(both.select("a", "b", "whole", "other").mapInArrow(step, schema)))
            discard(spark, need_at, whole_at)
        return reduce(DataFrame.union, out)

    def fits():
        """Whether two rows can be similar by their sizes, and by what is left of both behind their first common shingle."""
        size, other = F.col("size"), F.col("b_size")
        rest = F.least(size - F.col("pos"), other - F.col("b_pos"))
        return (F.least(size, other) >= least * F.greatest(size, other) - 1e-6) & (rest * (1 + least) >= least * (size + other) - 1e-6)

    done = compare(found)
    groups, at = materialise(components(done.where("ok").select("a", "b")))
    old.append(at)

    def apart(classes: DataFrame) -> DataFrame:
        """The classes with rows of more than one group."""
        named = classes.join(groups, classes.row__ == groups.node, "left").select("shingle", "n", "row__", "size", "pos", F.coalesce("root", "row__").alias("group"))
        both = named.groupBy("shingle").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
        return written(named.join(both.select("shingle"), "shingle", "left_semi"))

    def link_more(more: DataFrame) -> None:
        """Compare the pairs (a, b) that were not yet, and find the groups again."""
        nonlocal done, groups
        done = done.union(compare(written(more.distinct().join(done.select("a", "b"), ["a", "b"], "left_anti"))))
        regroup()

    def regroup() -> None:
        nonlocal groups
        groups, at = materialise(components(done.where("ok").select("a", "b")))
        old.append(at)

    def likely(met: DataFrame) -> DataFrame:
        return met.where((F.col("group") != F.col("b_group")) & fits()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    open_classes = apart(classes)
    for k in range(rounds):
        # one row for the classes of a family at first, then one by chance
        pick = F.min(F.struct(F.xxhash64("shingle", "row__", F.lit(k)) if k else F.col("row__"), F.col("row__").alias("b"), F.col("size").alias("b_size"), F.col("pos").alias("b_pos"), F.col("group").alias("b_group")))
        link_more(likely(open_classes.join(open_classes.groupBy("shingle").agg(pick.alias("p")).select("shingle", "p.b", "p.b_size", "p.b_pos", "p.b_group"), "shingle").withColumnRenamed("row__", "a")))
        # classes of one group stay so; after the first round, two rows have been compared
        open_classes = apart(open_classes.drop("group").where("n > 2"))
    left = open_classes.where(F.col("n") <= SMALL)
    right = left.select("shingle", F.col("row__").alias("b"), F.col("size").alias("b_size"), F.col("pos").alias("b_pos"), F.col("group").alias("b_group"))
    rest = likely(left.withColumnRenamed("row__", "a").join(right, "shingle").where("a > b"))
    large = open_classes.where(F.col("n") > SMALL)
    if not large.isEmpty():
        # one pivot for the classes of a family, as far as they hold the same first row
        pivots = large.groupBy("shingle").agg(F.min(F.struct("row__", "size")).alias("p")).select("shingle", F.col("p.row__").alias("b"), F.col("p.size").alias("b_size"))
        spokes = written(large.join(pivots, "shingle").where("row__ <> b").select(F.col("row__").alias("a"), "b", (8 * (F.col("size").cast("long") + F.col("b_size"))).alias("bytes")).distinct())
        deltas = written(over_sets(spokes, "a", by_delta, "a long, b long, size int, b_size int, delta array<long>"))
        similar = F.size("delta") * (1 + least) <= (1 - least) * (F.col("size") + F.col("b_size")) + 1e-6
        done = done.union(written(deltas.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), similar.alias("ok"))))
        regroup()
        rest = rest.union(unlike_pairs(deltas, groups, least))
    link_more(rest)
    of_set = sets.join(groups, sets.lead == groups.node, "left").select("key", F.coalesce("root", "lead").alias("group"))
    members = marked.select("row__", "doc_id", "key").join(of_set, "key")
    stay = members.groupBy("group").agg(F.min(order).alias("lead")).select(F.col("lead.row__").alias("row__"))
    gone, _ = materialise(marked.select("row__").join(stay, "row__", "left_anti"))
    discard(spark, *old)
    # rows that the filter clears do not move; the join of the others is a merge at every size, as what goes grows with the documents
    sieved = sieve(base, gone)
    return sieved.where("NOT may__").select("doc.*").union(sieved.where("may__").join(gone.hint("merge"), "row__", "left_anti").select("doc.*"))
