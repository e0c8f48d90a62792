"""Suffix sorting in external memory: recursive induction through disk-backed priority queues.

The suffixes that begin an S-type run are sorted by the pieces between them; the pieces' names make a shorter text,
which is sorted by the same recursion until all names differ. All other suffixes are induced from them, L-type ones by
ascending and S-type ones by descending symbols. Whatever waits for a symbol still to come lies in a priority queue,
as a tuple of the suffix and its common prefix with the tuple before it; queues write themselves to disk beyond a
memory limit. A common prefix is one more than the least since the symbol was last sent, so it is carried along
with the tuples and nothing is compared again.

Arrays of the length of the text are files beyond the limit, read where they are needed.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that one queue, or one array, holds in memory.
MEMORY = 64 << 20


def scratch(n: int, dtype, limit: int) -> np.ndarray:
    """An array of zeros, which is a file if it is larger than the limit."""
    if n * np.dtype(dtype).itemsize <= limit:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype, "r+", shape=(n,))


def blocks(n: int, size: int) -> Iterator[tuple[int, int]]:
    return ((a, min(n, a + size)) for a in range(0, n, size))


class Queues:
    """First-in-first-out queues of tuples, one for each key; together a priority queue over the keys. Beyond ``limit`` bytes all go to disk."""

    def __init__(self, keys: int, limit: int):
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(keys)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(keys)]
        self.limit, self.size, self.file = limit, 0, None

    def push(self, key: int, rows: np.ndarray, prefix: np.ndarray) -> None:
        if len(rows):
            self.held[key].append((rows, prefix))
            self.size += 9 * len(rows)
            if self.size > self.limit:
                self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for key, parts in enumerate(self.held):
            for rows, prefix in parts:
                self.spilled[key].append((self.file.tell(), len(rows)))
                self.file.write(rows.astype(np.int64).tobytes())
                self.file.write(prefix.astype(np.uint8).tobytes())
            parts.clear()
        self.size = 0

    def push_all(self, keys: np.ndarray, rows: np.ndarray, prefix: np.ndarray) -> None:
        """Tuples under their keys, which are grouped, in the order in which they stand."""
        if len(rows):
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(rows)]
            for a, b in zip(cuts, cuts[1:]):
                self.push(int(keys[a]), rows[a:b], prefix[a:b])

    def _read(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)

    def pop(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tuples of a key, block by block, those too that arrive meanwhile."""
        while self.spilled[key] or self.held[key]:
            if self.spilled[key]:
                yield self._read(*self.spilled[key].pop(0))
            else:
                parts, self.held[key] = self.held[key], []
                self.size -= sum(9 * len(r) for r, _ in parts)
                yield np.concatenate([r for r, _ in parts]), np.concatenate([p for _, p in parts])

    def pop_last(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tuples of a key from the last to the first, block by block."""
        while self.held[key]:
            rows, prefix = self.held[key].pop()
            self.size -= 9 * len(rows)
            yield rows[::-1], prefix[::-1]
        while self.spilled[key]:
            rows, prefix = self._read(*self.spilled[key].pop())
            yield rows[::-1], prefix[::-1]

    def take(self, key: int) -> np.ndarray:
        """All suffixes of a key at once."""
        return np.concatenate([np.empty(0, np.int64), *(rows for rows, _ in self.pop(key))])


def run_starts(text: np.ndarray, size: int) -> np.ndarray:
    """The places, ascending, where an S-type run begins: smaller than what follows, behind something larger. The last place is one of them."""
    out, follows, s_next = [np.array([len(text) - 1])], None, True
    for a, b in reversed(list(blocks(len(text), size))):
        part = np.asarray(text[a:b])
        ahead = np.append(part[1:], part[-1] if follows is None else follows)
        # what ends a run of equal symbols decides for all of it
        change = np.flatnonzero(part != ahead)
        if follows is None or not len(change) or change[-1] != len(part) - 1:
            change = np.append(change, len(part) - 1)
        s_type = part[change] < ahead[change]
        if part[-1] == ahead[-1]:
            s_type[-1] = s_next
        s_type = np.repeat(s_type, np.diff(change, prepend=-1))
        # the first of the next block begins a run if the last of this one is no S-type
        if follows is not None and s_next and not s_type[-1]:
            out.append(np.array([b]))
        out.append(np.flatnonzero(s_type[1:] & ~s_type[:-1])[::-1] + a + 1)
        follows, s_next = part[0], bool(s_type[0])
    found = np.concatenate(out)[::-1]
    return found if len(found) < 2 or found[-1] != found[-2] else found[:-1]


def sorted_rows(keys: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """The places of ascending keys, range by range, each of which fits in memory."""
    n = len(keys)
    if not n:
        return
    parts = 1 + 32 * n // limit
    some = np.sort(keys[:: max(1, n // 4096)])
    cuts = np.unique(some[np.arange(1, parts) * len(some) // parts])
    for i in range(len(cuts) + 1):
        got = []
        for a, b in blocks(n, max(1024, limit // 16)):
            of = np.searchsorted(cuts, keys[a:b], side="right")
            got.append(np.flatnonzero(of == i) + a)
        rows = np.concatenate(got)
        yield rows[np.argsort(keys[rows], kind="stable")]


def piece_names(text: np.ndarray, starts: np.ndarray, first: int, limit: int, bits: int) -> tuple[np.ndarray, bool]:
    """The names of the pieces between neighbouring starts, and whether all differ. Equal pieces have equal names; the order of names is that of pieces.

    first: as many starts, of the least symbols, are known to be in descending order of their places.
    bits: of a symbol. Pieces are compared by as many symbols as fit in a key, in rounds that only ties enter again.
    """
    n, per = len(starts), 62 // (bits + 1)
    rank = scratch(n, np.int64, limit)
    least = np.asarray(text[starts]) == 0 if first else np.zeros(n, bool)
    rank[least] = np.arange(first - 1, -1, -1) if first else 0
    ends = np.append(starts[1:] + 1, len(text))

    def key_of(rows: np.ndarray, at: int) -> np.ndarray:
        key = np.zeros(len(rows), np.int64)
        begin, end = starts[rows] + at, ends[rows]
        for j in range(per):
            place = begin + j
            # past its end a piece is larger than one that goes on: what goes on is L-type there
            symbol = np.where(place < end, text[np.minimum(place, len(text) - 1)].astype(np.int64), 1 << bits)
            key = (key << (bits + 1)) | symbol
        return key

    rows = np.flatnonzero(~least)
    keys = scratch(len(rows), np.int64, limit)
    for a, b in blocks(len(rows), max(1024, limit // 64)):
        keys[a:b] = key_of(rows[a:b], 0)
    ties, seen, last = [], 0, None
    for part in sorted_rows(keys, limit):
        if len(part):
            key = keys[part]
            head = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
            group = np.maximum.accumulate(np.where(head, np.arange(len(part)), 0))
            rank[rows[part]] = first + seen + group
            open_ = ~(head & np.concatenate([head[1:], [True]]))
            ties.append(rows[part[open_]])
            seen, last = seen + len(part), key[-1]
    tied = np.concatenate([np.empty(0, np.int64), *ties])
    at = per
    going = ends[tied] - starts[tied] >= at
    distinct, tied = bool(going.all()), tied[going]
    while len(tied):
        key, old = key_of(tied, at), rank[tied]
        order = np.lexsort((key, old))
        tied, key, old = tied[order], key[order], old[order]
        new = np.concatenate([[True], old[1:] != old[:-1]])
        head = new | np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(tied))
        rank[tied] = old + np.maximum.accumulate(np.where(head, place, 0)) - np.maximum.accumulate(np.where(new, place, 0))
        at += per
        tied = tied[~(head & np.concatenate([head[1:], [True]]))]
        going = ends[tied] - starts[tied] >= at
        distinct, tied = distinct and bool(going.all()), tied[going]
    return rank, distinct


def sort_starts(text: np.ndarray, starts: np.ndarray, first: int, limit: int, bits: int) -> np.ndarray:
    """The order of the suffixes at run starts, by their names and, where these are equal, by the recursion."""
    names, distinct = piece_names(text, starts, first, limit, bits)
    if distinct:
        out = scratch(len(names), np.int64, limit)
        for part in sorted_rows(names, limit):
            out[names[part]] = part
        return out
    return sort_names(names, limit)


def sort_names(text: np.ndarray, limit: int) -> np.ndarray:
    """The suffix array of a text of names, the last of which is less than all others."""
    n = len(text)
    bits = max(1, int(n).bit_length())
    starts = run_starts(text, max(1024, limit // 32))
    order = starts[sort_starts(text, starts, 0, limit, bits)]
    # ranges of names with about as many suffixes as fit in memory; a name is below the length of its text
    counts = scratch(n + 1, np.int64, limit)
    for a, b in blocks(n, max(1024, limit // 32)):
        np.add.at(counts, text[a:b], 1)
    room = max(1024, limit // 128)
    edge = np.unique(np.cumsum(counts) // room, return_index=True)[1][1:]
    del counts
    seeds, found = Queues(len(edge) + 1, limit), Queues(len(edge) + 1, limit)
    _deal(seeds, edge, text, order)
    for at, rows, seed in sweep(text, edge, seeds, 1, limit):
        found.push(at, rows[~seed], np.zeros((~seed).sum(), np.uint8))
    back = Queues(len(edge) + 1, limit)
    for at in range(len(edge) + 1):
        for rows, prefix in found.pop_last(at):
            back.push(at, rows, prefix)
    out = scratch(n, np.int64, limit)
    out[0], end = n - 1, n
    for _, rows, _ in sweep(text, edge, back, -1, limit):
        out[end - len(rows) : end] = rows[::-1]
        end -= len(rows)
    return out


def _deal(queues: Queues, edge: np.ndarray, text: np.ndarray, rows: np.ndarray) -> None:
    """Push suffixes under the ranges of their symbols, in the order in which they stand."""
    for a, b in blocks(len(rows), 1 << 20):
        part = np.asarray(rows[a:b])
        of = np.searchsorted(edge, text[part], side="right")
        order = np.argsort(of, kind="stable")
        queues.push_all(of[order], part[order], np.zeros(len(part), np.uint8))


def sweep(text: np.ndarray, edge: np.ndarray, seeds: Queues, sign: int, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, suffixes, whether each is a seed) by ascending symbols, or descending ones: the seeds and all that they induce.

    A suffix sends the one before it if that has a later symbol, or the same and the sender is no seed. Within
    a range, what is sent into the range itself is ranked by its symbol, then by the rank of its sender.
    """
    waiting = Queues(len(edge) + 1, limit)
    for at in range(len(edge) + 1)[::sign]:
        sent, seed = waiting.take(at), seeds.take(at)
        rows, sender = [sent, seed], [np.full(len(sent), -1), np.full(len(seed), -2)]
        front, base, later = np.concatenate(rows), 0, []
        symbol = sign * text[front].astype(np.int64)
        symbols, is_seed = [symbol], np.arange(len(front)) >= len(sent)
        while len(front):
            left = front - 1
            symbol_left = np.where(left >= 0, sign * text[left].astype(np.int64), np.iinfo(np.int64).min)
            go = (symbol_left > symbol) | ((symbol_left == symbol) & ~is_seed)
            inside = go & (np.searchsorted(edge, sign * symbol_left, side="right") == at)
            out = np.flatnonzero(go & ~inside)
            later.append((out + base, left[out], sign * symbol_left[out]))
            new = np.flatnonzero(inside)
            rows.append(left[new])
            sender.append(new + base)
            base += len(front)
            front, symbol, is_seed = left[new], symbol_left[new], np.zeros(len(new), bool)
            symbols.append(symbol)
        rows, sender, symbol = np.concatenate(rows), np.concatenate(sender), np.concatenate(symbols)
        if not len(rows):
            continue
        # sent before this range, then sent within it, then seeds, for each symbol; a rank is the place of the first that shares it
        kind = np.where(sender == -1, 0, np.where(sender == -2, 2, 1))
        bits = max(1, int(len(rows)).bit_length())
        key = np.sort(((symbol - symbol.min()) * 4 + kind << bits) | np.arange(len(rows)))
        order, key = key & ((1 << bits) - 1), key >> bits
        head = np.concatenate([[True], key[1:] != key[:-1]]) | (key & 3 != 1)
        place = np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))
        rank = np.empty(len(rows), np.int64)
        rank[order] = place
        tied = order[~(head & np.concatenate([head[1:], [True]]))]
        of = np.where(kind == 1, sender, np.arange(len(rows)))
        while len(tied):
            key = (rank[tied] << bits) | rank[of[tied]]
            by = np.argsort(key)
            tied, key = tied[by], key[by]
            old = key >> bits
            head = np.concatenate([[True], key[1:] != key[:-1]])
            new = np.concatenate([[True], old[1:] != old[:-1]])
            place = np.arange(len(tied))
            rank[tied] = old + np.maximum.accumulate(np.where(head, place, 0)) - np.maximum.accumulate(np.where(new, place, 0))
            tied, of = tied[~(head & np.concatenate([head[1:], [True]]))], of[of]
        order = np.empty(len(rows), np.int64)
        order[rank] = np.arange(len(rows))
        place, left, symbol = (np.concatenate(x) for x in zip(*later))
        by = np.argsort(rank[place])
        for a, b in blocks(len(by), 1 << 20):
            part = by[a:b]
            to = np.searchsorted(edge, symbol[part], side="right")
            group = np.argsort(to, kind="stable")
            waiting.push_all(to[group], left[part[group]], np.zeros(len(part), np.uint8))
        yield at, rows[order], kind[order] == 2


class Minima:
    """Least values over ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.rows = [values.astype(np.int16)]
        while 2 << (len(self.rows) - 1) <= len(values):
            low, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(low[:-step], low[step:]))
        self.flat = np.concatenate(self.rows)
        self.begin = np.cumsum([0, *map(len, self.rows[:-1])])

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of values a to b, both included."""
        level = np.frexp(b - a + 1)[1] - 1
        at = self.begin[level]
        return np.minimum(self.flat[at + a], self.flat[at + b - (1 << level) + 1])


def shared(words: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The common prefixes of suffixes, up to ``k`` and to the next separator. words: the eight bytes from each place on."""
    out, use = np.zeros(len(a), np.int64), np.arange(len(a))
    ones, tops = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
    for _ in range(-(-k // 8)):
        x, y = words[a[use] + out[use]], words[b[use] + out[use]]
        stop = (x ^ y) | ((x - ones) & ~x & tops)
        n = np.where(stop == 0, 8, np.bitwise_count((stop & (~stop + np.uint64(1))) - np.uint64(1)) >> 3)
        out[use] += n
        use = use[(n == 8) & (out[use] < k)]
    return np.minimum(out, k)


def byte_suffixes(data: np.ndarray, lengths: np.ndarray, k: int, limit: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefixes with the one before, up to ``k``) of all suffixes in descending order, block by block.

    The strings stand one behind the other, each followed by a separator of its own; places count these. No byte is 255.
    """
    n = len(data) + len(lengths)
    padded = scratch(n + 8, np.uint8, limit)
    text, words = padded[:n], np.ndarray((n,), "<u8", padded, 0, (1,))
    ends = np.cumsum(lengths)
    for a, b in blocks(len(data), max(1024, limit // 32)):
        # a byte stands further on by the separators before it
        low, high = np.searchsorted(ends, [a, b - 1], side="right")
        step = np.diff(np.clip(ends[low : high + 1], a, b), prepend=a)
        text[np.arange(a, b) + np.repeat(np.arange(low, high + 1), step)] = data[a:b] + np.uint8(1)
    starts = run_starts(text, max(1024, limit // 32))
    ordered = starts[sort_starts(text, starts, len(lengths), limit, 8)]
    separators, stars = ordered[: len(lengths)], ordered[len(lengths) :]
    room = max(1024, limit // 256)
    seeds = Queues(256, limit)
    for a, b in blocks(len(stars), room):
        part = np.asarray(stars[a:b])
        prefix = np.concatenate([[0], shared(words, part[:-1], part[1:], k)]) if a == 0 else shared(words, np.asarray(stars[a - 1 : b - 1]), part, k)
        seeds.push_all(text[part], np.array(part), prefix.astype(np.uint8))
    waiting, found = Queues(256, limit), Queues(256, limit)
    since = np.full(256, -1, np.int16)

    def visit(rows: np.ndarray, prefix: np.ndarray, symbol: int, seed: bool, up: bool) -> None:
        """Send the suffixes before these to the queues of their symbols."""
        before = text[rows - 1]  # that of the first place is the last, a separator
        go = before > symbol if up else (before < symbol) & (before > 0)
        if not seed:
            go |= before == symbol
        use = np.flatnonzero(go)
        low = prefix.min()
        if not len(use):
            np.minimum(since, low, out=since)
            return
        order = np.argsort(before[use], kind="stable")
        use = use[order]
        key = before[use]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        minima = Minima(prefix)
        begin = np.where(head, 0, np.concatenate([[0], use[:-1] + 1]))
        common = minima.least(begin, use)
        common[head] = np.minimum(common[head], since[key[head]])
        tail = np.flatnonzero(np.concatenate([head[1:], [True]]))
        np.minimum(since, low, out=since)
        rest = use[tail] + 1
        inside = rest < len(prefix)
        since[key[tail]] = k
        since[key[tail[inside]]] = minima.least(rest[inside], np.full(inside.sum(), len(prefix) - 1))
        waiting.push_all(key, rows[use] - 1, np.minimum(common + 1, k).astype(np.uint8))

    def first_against(last: int | None, rows: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """The prefixes with the first one counted from the suffix before it; 0 where the symbol begins."""
        prefix = prefix.copy()
        prefix[0] = 0 if last is None else shared(words, np.array([last]), rows[:1], k)[0]
        return prefix

    def parts(of: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows, prefix in of:
            for a, b in blocks(len(rows), room):
                yield rows[a:b], prefix[a:b]

    for a, b in blocks(len(separators), room):
        visit(np.asarray(separators[a:b]), np.zeros(b - a, np.uint8), 0, True, True)
    for c in range(1, 256):
        last = None
        for rows, prefix in parts(waiting.pop(c)):
            prefix = first_against(None, rows, prefix) if last is None else prefix
            found.push(c, rows, prefix)
            visit(rows, prefix, c, False, True)
            last = int(rows[-1])
        fresh = True
        for rows, prefix in parts(seeds.pop(c)):
            prefix = first_against(last, rows, prefix) if fresh else prefix
            visit(rows, prefix, c, True, True)
            fresh = False
    since[:] = -1
    for c in range(255, 0, -1):
        last = None
        for rows, prefix in parts(waiting.pop(c)):
            prefix = first_against(None, rows, prefix) if last is None else prefix
            yield rows, prefix
            visit(rows, prefix, c, False, False)
            last = int(rows[-1])
        carried = None
        for rows, own in parts(found.pop_last(c)):
            # from behind, a suffix shares with the one before it what that one shares with it
            prefix = np.concatenate([own[:1] if carried is None else [carried], own[:-1]]).astype(np.uint8)
            prefix = first_against(last, rows, prefix) if carried is None else prefix
            carried = own[-1]
            yield rows, prefix
            visit(rows, prefix, c, True, False)
