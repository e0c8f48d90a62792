"""Where windows of a fixed length repeat across documents: the distributed part of both substring operators.

1. Documents are dealt into buckets of bounded text. Every window of ``k`` units has one anchor: its
   least gram by hash. A run of windows with the same anchor is a segment. Equal windows have equal
   anchors, wherever they stand.
2. Each bucket sends its distinct anchor hashes, once each, to anchor shards; the answer is one bit for
   each, whether the anchor occurs anywhere else. No window whose anchor is alone can repeat.
3. Segments of shared anchors go to window shards by their anchor, each distinct segment once for a
   bucket with the least place where it occurs there. Where else it occurs stays with the bucket.
4. A shard drops the windows whose surroundings of the anchor stand in one segment alone, sorts the others
   (by the method that the operator brings), and answers with the least place of each, where that is another one.
5. Each bucket compares the places of its windows with the least ones, and marks its covered units.

A passage that a third of all documents hold arrives once for each bucket, not once for each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm._common import bound_batches, text_bytes
from strideframe.llm.words import mix, raw

#: Text in a bucket, and text whose windows, or anchors, one shard holds on average.
BUCKET_BYTES, SHARD_BYTES, ANCHOR_BYTES = 8 << 20, 4 << 20, 64 << 20
#: Units that one step handles at a time; a longer text is cut into steps that overlap.
STEP = 1 << 20
#: Bits of a place within a step.
_PLACE_BITS = np.uint64(28)
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Spec:
    """What a unit is, how long windows and anchors are (``m`` a power of two), and how equal windows are found."""

    units: Callable[[bytes], np.ndarray]
    codes: Callable[[np.ndarray], np.ndarray]
    dtype: type
    k: int
    m: int
    #: (units of all segments, their lengths) -> a group number for each window, in order
    group: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: whether an earlier place in the same document counts
    within: bool


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def grams(codes: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all runs of ``m`` codes, not yet mixed."""
    g, have = codes, 1
    while have * 2 <= m:
        g = g[:-have] * np.uint64(0x9E3779B97F4A7C15) + g[have:]
        have *= 2
    rest = m - have
    return mix(g[:-rest]) * np.uint64(0x9E3779B97F4A7C15) + g[rest:] if rest else g


def segments(units: np.ndarray, bounds: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, anchor hash, anchor's place) of the runs of windows with one anchor; ends are those of the last window.

    bounds: the ends of the documents.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(units) < spec.k:
        return none
    g = mix(grams(spec.codes(units), spec.m))
    key = (g >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(g), dtype=np.uint64)
    anchor = (sliding_min(key, spec.k - spec.m + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for back in range(1, spec.k):  # windows that would cross the end of a document
        at = bounds - back
        valid[at[(at >= 0) & (at < len(valid))]] = False
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(first)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    last = np.flatnonzero(stop)
    return begin, last + spec.k, g[anchor[begin]], anchor[begin]


class Bucket:
    """The documents of a bucket in a fixed order, cut into steps of whole documents."""

    def __init__(self, rows: pa.Table, spec: Spec):
        ids = rows.column("doc_id").to_pylist()
        texts = rows.column("text").to_pylist()
        self.rows = sorted(((_LAST if i is None else i), raw(t), i) for i, t in zip(ids, texts))
        self.spec = spec

    def steps(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, place in it, units, ends of the documents). A window is in one step alone."""
        held, size, first = [], 0, 0
        for i, (_, text, _) in enumerate(self.rows):
            u = self.spec.units(text)
            if held and size + len(u) > STEP:
                yield first, 0, np.concatenate(held), np.cumsum([len(x) for x in held])
                held, size = [], 0
            if len(u) > 2 * STEP:
                for at in range(0, len(u), STEP):
                    part = u[at : at + STEP + self.spec.k - 1]
                    yield i, at, part, np.array([len(part)])
                continue
            if not held:
                first = i
            held.append(u)
            size += len(u)
            if i + 1 == len(self.rows) or len(self.rows[i + 1][1]) > STEP:
                yield first, 0, np.concatenate(held), np.cumsum([len(x) for x in held])
                held, size = [], 0
        if held:
            yield first, 0, np.concatenate(held), np.cumsum([len(x) for x in held])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchor hashes, and whether each occurs twice in this bucket already."""
        got = [segments(u, ends, self.spec)[2] for _, _, u, ends in self.steps()]
        h, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.empty(0, np.uint64), np.empty(0, np.int64))
        return h, n > 1


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(n)).astype(np.int64)


def _by_shard(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that groups hashes by shard, and the shards with the begin of each (and the end of the last)."""
    shard = _shard(h, n)
    order = np.lexsort((h, shard))
    found, begin = np.unique(shard[order], return_index=True)
    return order, found, np.append(begin, len(h))


def earliest(key: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int, places: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The least (doc, at) of each key below ``n``; without ``places`` the least doc, and 0."""
    least = np.full(n, _LAST)
    np.minimum.at(least, key, doc)
    if not places:
        return least, np.zeros(n, np.int64)
    own = doc == least[key]
    first = np.full(n, _LAST)
    np.minimum.at(first, key[own], at[own])
    return least, first


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of its run, and its place in it, of each element of runs of these lengths."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def runs_of(hit: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the runs of hits; ``joined``: whether an element continues the one before it."""
    first, stop = hit.copy(), hit.copy()
    first[1:] &= ~(hit[:-1] & joined[1:])
    stop[:-1] &= ~(hit[1:] & joined[1:])
    a = np.flatnonzero(first)
    return a, np.flatnonzero(stop) - a + 1


def window_groups(units: np.ndarray, lengths: np.ndarray, anchor: np.ndarray, spec: Spec) -> np.ndarray:
    """A group number for each window of distinct segments; equal windows, and no others, share one.

    anchor: its place in each segment. Of equal windows both hold either the ``reach`` units before the anchor or those
    behind it; where these with the anchor stand in no other segment, nothing needs sorting.
    """
    n_windows = lengths - spec.k + 1
    start = np.cumsum(n_windows) - n_windows
    reach = (spec.k - spec.m + 1) // 2
    first = np.cumsum(lengths) - lengths
    g = mix(grams(spec.codes(units), spec.m + reach)) if len(units) >= spec.m + reach else np.empty(0, np.uint64)
    before = np.clip(anchor - reach + 1, 0, n_windows)  # so many windows hold what stands before the anchor
    parts = []
    for begin, count, gram in ((np.zeros_like(before), before, first + anchor - reach), (before, n_windows - before, first + anchor)):
        use = np.flatnonzero(count > 0)
        hashes = g[gram[use]]
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        twin = np.zeros(len(use), bool)
        twin[order[1:]] |= same
        twin[order[:-1]] |= same
        use = use[twin]
        parts.append((use, begin[use], count[use]))
    seg, begin, count = (np.concatenate(x) for x in zip(*parts))
    out = np.arange(int(n_windows.sum()))
    if len(seg):
        sizes = count + spec.k - 1
        run, at = spread(sizes)
        groups = spec.group(units[(first[seg] + begin)[run] + at], sizes)
        run, at = spread(count)
        out[(start[seg] + begin)[run] + at] = len(out) + groups
    return out


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def mark_repeats(docs: DataFrame, spec: Spec, finish: Callable[[list, list[np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``finish`` makes of each bucket's rows and the begins of their windows that have an earlier place.

    finish: (rows as (order, bytes, doc_id), for each row the begins of repeated windows) -> a table
    """
    bound_batches(docs.sparkSession)
    # lengths and places within a segment are below 2 * k
    small = np.uint8 if 2 * spec.k < 256 else np.int32
    total = text_bytes(docs)
    n_buckets, n_shards, n_anchor = (max(1, -(-total // size)) for size in (BUCKET_BYTES, SHARD_BYTES, ANCHOR_BYTES))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_buckets)).cast("int"))

    def send_anchors(rows: pa.Table) -> pa.Table:
        h, twice = Bucket(rows, spec).anchors()
        order, shards, cuts = _by_shard(h, n_anchor)
        # five bytes tell a shard's anchors apart; a chance meeting only adds a candidate
        short = np.ascontiguousarray(h[order].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        return pa.table(
            {
                "shard": pa.array(shards, pa.int32()),
                "bucket": pa.array(np.full(len(shards), rows.column("bucket")[0].as_py() if len(rows) else 0), pa.int32()),
                "anchors": pa.array([short[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                "twice": pa.array([_bits(twice[order[a:b]]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
            }
        )

    def answer_anchors(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        parts, twice = [], []
        for blob, flags in zip(rows.column("anchors").to_pylist(), rows.column("twice").to_pylist()):
            wide = np.zeros((len(blob) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
            parts.append(wide.view("<u8")[:, 0])
            twice.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=len(wide)).astype(bool))
        h, flag = np.concatenate(parts), np.concatenate(twice)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        shared = np.zeros(len(h), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        cuts = np.cumsum([0, *map(len, parts)])
        shared |= flag
        return pa.table({"bucket": rows.column("bucket"), "shard": rows.column("shard"), "shared": pa.array([_bits(shared[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})

    def send_segments(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in SENT}
        if len(rows) and len(answers):
            bucket = Bucket(rows, spec)
            h, _ = bucket.anchors()
            order, shards, cuts = _by_shard(h, n_anchor)
            told = dict(zip(answers.column("shard").to_pylist(), answers.column("shared").to_pylist()))
            keep = [np.unpackbits(np.frombuffer(told[s], np.uint8), count=b - a).astype(bool) for s, a, b in zip(shards.tolist(), cuts, cuts[1:])]
            shared = np.sort(h[order][np.concatenate(keep)]) if keep else h[:0]
            distinct: dict[bytes, int] = {}
            shard_of: list[int] = []
            anchor_at: list[int] = []
            seen: list[list[np.ndarray]] = [[], [], []]
            size = np.dtype(spec.dtype).itemsize
            for first, offset, units, ends in bucket.steps():
                begin, end, anchor, place = segments(units, ends, spec)
                at = np.minimum(np.searchsorted(shared, anchor), max(len(shared) - 1, 0))
                use = np.flatnonzero(shared[at] == anchor) if len(shared) else np.empty(0, np.int64)
                begin, end, anchor, place = begin[use], end[use], anchor[use], place[use]
                blob, to = units.tobytes(), _shard(anchor, n_shards).tolist()
                owner = np.empty(len(use), np.int64)
                for i, (a, b, s, p) in enumerate(zip((begin * size).tolist(), (end * size).tolist(), to, (place - begin).tolist())):
                    n = len(distinct)
                    owner[i] = distinct.setdefault(blob[a:b], n)
                    if len(distinct) > n:
                        shard_of.append(s)
                        anchor_at.append(p)
                row = np.searchsorted(ends, begin, side="right")
                seen[0].append(owner)
                seen[1].append(first + row)
                seen[2].append(begin - np.concatenate([[0], ends])[row] + offset)
            owner, row, begin = (np.concatenate(x) if x else np.empty(0, np.int64) for x in seen)
            to, parts, name = np.array(shard_of, np.int64), list(distinct), rows.column("bucket")[0].as_py()
            order = np.argsort(to, kind="stable")
            number = np.empty(len(parts), np.int64)
            number[order] = np.arange(len(parts))
            owner = number[owner]
            lengths = np.array([len(p) // size for p in parts], small)[order]
            doc, at = earliest(owner, np.array([r[0] for r in bucket.rows], np.int64)[row] if len(row) else row, begin, len(parts))
            found, cuts = np.unique(to[order], return_index=True)
            cuts = [*cuts.tolist(), len(parts)]
            for s, a, b in zip(found.tolist(), cuts, cuts[1:]):
                values = b"".join([parts[i] for i in order[a:b].tolist()]), lengths[a:b], np.array([anchor_at[i] for i in order[a:b].tolist()], small), doc[a:b], at[a:b] if spec.within else None, None, None
                _add(out, s, name, a, *values)
            # what the bucket needs again travels with its shards' answers
            _add(out, n_shards + name, name, -1, None, lengths, None, None, None, owner.astype(np.int32), np.stack([np.diff(row, prepend=0), np.diff(begin, prepend=0)]).astype(np.int32))
        return _table(out, SENT)

    def answer_segments(rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in SENT}
        if rows.column("first")[0].as_py() < 0:
            return rows.select(list(SENT))
        # the same segment from several buckets is one segment
        number: dict[bytes, int] = {}
        size = np.dtype(spec.dtype).itemsize
        local, anchor = [], []
        for blob, sizes, at in zip(rows.column("units").to_pylist(), rows.column("sizes").to_pylist(), rows.column("anchors").to_pylist()):
            cuts = np.cumsum(np.frombuffer(sizes, small).astype(np.int64)) * size
            own = []
            for a, b, p in zip([0, *cuts.tolist()], cuts.tolist(), np.frombuffer(at, small).tolist()):
                n = len(number)
                own.append(number.setdefault(blob[a:b], n))
                if len(number) > n:
                    anchor.append(p)
            local.append(np.array(own, np.int64))
        docs = [np.frombuffer(x, np.int64) for x in rows.column("doc").to_pylist()]
        ats = [np.frombuffer(x, np.int64) if spec.within else np.zeros(len(d), np.int64) for x, d in zip(rows.column("at").to_pylist(), docs)]
        lengths = np.array([len(x) // size for x in number], np.int64)
        # the least place of each segment, then of each group of equal windows
        lead_doc, lead_at = earliest(np.concatenate(local), np.concatenate(docs), np.concatenate(ats), len(lengths))
        group = window_groups(np.frombuffer(b"".join(number), spec.dtype), lengths, np.array(anchor, np.int64), spec)
        number.clear()
        n_windows = lengths - spec.k + 1
        start = np.cumsum(n_windows) - n_windows
        seg, inside = spread(n_windows)
        group_doc, group_at = earliest(group, lead_doc[seg], lead_at[seg] + inside, int(group.max()) + 1, spec.within)
        least_doc, least_at = group_doc[group], group_at[group]
        del group, seg, inside
        for name, first, own, doc, at in zip(rows.column("bucket").to_pylist(), rows.column("first").to_pylist(), local, docs, ats):
            told: list[list[np.ndarray]] = [[] for _ in range(5)]
            cost = np.cumsum(n_windows[own])
            lo = 0
            while lo < len(own):
                hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + STEP)))
                run, t = spread(n_windows[own[lo:hi]])
                w, run = start[own[lo:hi]][run] + t, run + lo
                d, p = least_doc[w], least_at[w]
                other = d < doc[run]
                if spec.within:
                    other |= (d == doc[run]) & (p < at[run] + t)
                joined = np.zeros(len(w), bool)
                joined[1:] = (run[1:] == run[:-1]) & (d[1:] == d[:-1]) & ((p[1:] == p[:-1] + 1) | (not spec.within))
                a, n = runs_of(other, joined)
                for x, y in zip(told, (first + run[a], t[a], n, d[a], p[a])):
                    x.append(y)
                lo = hi
            seg, t, n, d, p = (np.concatenate(x) if x else np.empty(0, np.int64) for x in told)
            _add(out, 0, name, 0, None, n.astype(small), t.astype(small), d, p if spec.within else None, seg.astype(np.int32), None)
        return _table(out, SENT)

    def close(rows: pa.Table, answers: pa.Table) -> pa.Table:
        own = Bucket(rows, spec).rows if len(rows) else []
        hits: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
        kinds = np.array(answers.column("first").to_pylist(), np.int64)
        for i in np.flatnonzero(kinds < 0).tolist():
            mine = {c: answers.column(c)[i].as_py() for c in ("sizes", "owner", "begin")}
            n_windows = np.frombuffer(mine["sizes"], small).astype(np.int64) - spec.k + 1
            start = np.cumsum(n_windows) - n_windows
            owner = np.frombuffer(mine["owner"], np.int32).astype(np.int64)
            row, begin = np.cumsum(np.frombuffer(mine["begin"], np.int32).astype(np.int64).reshape(2, -1), axis=1)
            doc = np.array([r[0] for r in own], np.int64)[row] if len(row) else row
            least_doc, least_at = (np.repeat(x, n_windows) for x in earliest(owner, doc, begin, len(n_windows), spec.within))
            least_at += spread(n_windows)[1]
            for k in np.flatnonzero(kinds >= 0).tolist():
                seg, t, n, d, p = (np.frombuffer(answers.column(c)[k].as_py(), kind) for c, kind in (("owner", np.int32), ("anchors", small), ("sizes", small), ("doc", np.int64), ("at" if spec.within else "doc", np.int64)))
                run, at = spread(n.astype(np.int64))
                w = (start[seg] + t)[run] + at
                least_doc[w] = d[run]
                if spec.within:
                    least_at[w] = p[run] + at
            cost = np.cumsum(n_windows[owner])
            lo = 0
            # occurrences are many where a passage is common, so they are expanded in steps
            while lo < len(owner):
                hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + STEP)))
                run, t = spread(n_windows[owner[lo:hi]])
                run += lo
                w = start[owner[run]] + t
                hit = least_doc[w] < doc[run]
                if spec.within:
                    hit |= (least_doc[w] == doc[run]) & (least_at[w] < begin[run] + t)
                a, n = runs_of(hit, np.concatenate([[False], run[1:] == run[:-1]]))
                for x, y in zip(hits, (row[run[a]], begin[run[a]] + t[a], n)):
                    x.append(y)
                lo = hi
        row, begin, count = (np.concatenate(x) for x in hits)
        order = np.lexsort((begin, row))
        row, begin, count = row[order], begin[order], count[order]
        runs = []
        for i in range(len(own)):
            a, b = np.searchsorted(row, i), np.searchsorted(row, i, side="right")
            runs.append(np.stack([begin[a:b], begin[a:b] + count[a:b] + spec.k - 1], 1))
        return pa.Table.from_batches([finish(own, runs)])

    # partition counts follow the text, whatever the session's default is, so tasks stay the same size; each shard is a partition
    dealt = dealt.repartitionById(n_buckets, "bucket")
    by_bucket = dealt.groupBy("bucket")
    seeds = by_bucket.applyInArrow(send_anchors, "shard int, bucket int, anchors binary, twice binary")
    answers = seeds.repartitionById(n_anchor, "shard").groupBy("shard").applyInArrow(answer_anchors, "bucket int, shard int, shared binary")
    sent = by_bucket.cogroup(answers.repartitionById(n_buckets, "bucket").groupBy("bucket")).applyInArrow(send_segments, _ddl(SENT))
    marked = sent.repartitionById(n_shards, "shard").groupBy("shard").applyInArrow(answer_segments, _ddl(SENT))
    return by_bucket.cogroup(marked.repartitionById(n_buckets, "bucket").groupBy("bucket")).applyInArrow(close, schema)


#: What goes to the window shards, and what they answer with: of each segment of a bucket, or of each run of windows, its
#: length, the place of its anchor or of the run in it, and the least document and place; and where a bucket has its segments.
SENT = {"shard": "int", "bucket": "int", "first": "int", "units": "binary", "sizes": "binary", "anchors": "binary", "doc": "binary", "at": "binary", "owner": "binary", "begin": "binary"}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def _add(out: dict[str, list], *values) -> None:
    for column, value in zip(out.values(), values):
        column.append(value.tobytes() if isinstance(value, np.ndarray) else value)


def _table(out: dict[str, list], columns: dict[str, str]) -> pa.Table:
    return pa.table({c: pa.array(v, pa.int32() if columns[c] == "int" else pa.binary()) for c, v in out.items()})


def covered(runs: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Which of ``n`` units the spans cover, and the number of maximal covered runs."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0], 1)
    np.add.at(change, runs[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    return gone, int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if n else 0
