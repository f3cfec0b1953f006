"""External induced sorting: the suffixes of one shard in order, with common-prefix lengths.

Suffixes are sorted from those of type S* (smaller than their right neighbour, larger than their
left one). Sorted S* suffixes induce all others: whenever a suffix is taken out in order, the
suffix that begins one symbol earlier enters a priority queue keyed by (first symbol, arrival), so
what is taken out next is always the next suffix in order. One pass gives the suffixes of type L
in ascending order, a second one the rest in descending order. S* substrings are sorted by the
same two passes, named, and the string of names is sorted by recursion.

Queue rows are tuples (position, value). In the passes that sort suffixes the value is the common
prefix with the row before: that of two suffixes that arrive one after another at a symbol is one
more than the least over the suffixes taken out between the two that sent them. In the passes that
sort substrings it is the substring's end. The recursion hands common prefixes back in names, which
become symbols by the positions of the S* suffixes.

Memory. Text, names, positions of S* suffixes and the state per symbol are memory maps of unlinked
scratch files, whose pages the system writes out and reads again; queues and sorted rows are streams that
write what exceeds the task's ``memory`` (rows) to such files. The heap holds ``memory`` rows, the
rows of one bucket of the queue and chunks of CHUNK rows, whatever the shard's size. Types of suffixes
need no table: a row taken from a queue sends on iff the symbol before it is not beyond its own.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

CHUNK = 1 << 16
FAR = np.uint16(65535)
#: Defaults: rows that a task's streams hold in memory, symbols up to which a reduced string is
#: ranked in memory, rows of a queue's bucket of several symbols, and symbols up to which each has one.
MEMORY, BASE, BUCKET, SINGLE = 1 << 19, 1 << 20, 1 << 17, 1 << 9

Rows = tuple[np.ndarray, np.ndarray]
Emit = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]


def mapped(n: int, kind) -> np.ndarray:
    """A zeroed array in an unlinked scratch file of the task."""
    with tempfile.TemporaryFile() as file:
        file.truncate(max(1, n * np.dtype(kind).itemsize))
        return np.memmap(file, kind, "r+", shape=(n,)).view(np.ndarray) if n else np.zeros(0, kind)


class Pool:
    """What the streams of a task hold in memory, and how often it was not enough."""

    def __init__(self, memory: int = MEMORY, base: int = BASE, bucket: int = BUCKET, single: int = SINGLE):
        self.free, self.base, self.bucket, self.single = memory, base, bucket, single
        self.spilled, self.recursions = 0, 0


class Stream:
    """Rows in order of arrival, to be taken out from either end; what the pool can't hold is on disk."""

    def __init__(self, pool: Pool):
        self.pool, self.parts, self.file, self.end, self.kinds = pool, deque(), None, 0, None

    def append(self, at: np.ndarray, value: np.ndarray) -> None:
        if not len(at):
            return
        self.kinds = at.dtype, value.dtype
        if len(at) <= self.pool.free:
            self.pool.free -= len(at)
            self.parts.append((at, value))
            return
        self.pool.spilled += len(at)
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(self.end)
        self.file.write(np.ascontiguousarray(at))
        self.file.write(np.ascontiguousarray(value))
        self.parts.append((self.end, len(at)))
        self.end = self.file.tell()

    def load(self, part: tuple) -> Rows:
        if isinstance(part[0], np.ndarray):
            self.pool.free += len(part[0])
            return part
        place, n = part
        a, b = self.kinds
        self.file.seek(place)
        data = self.file.read(n * (a.itemsize + b.itemsize))
        return np.frombuffer(data, a, n), np.frombuffer(data, b, n, n * a.itemsize)

    def take(self, back: bool = False) -> Iterator[Rows]:
        """Chunks in order (of arrival, or with ``back`` from the last row on), and those that arrive meanwhile."""
        held: list[Rows] = []
        n = 0
        while self.parts:
            rows = self.load(self.parts.pop() if back else self.parts.popleft())
            held.append((rows[0][::-1], rows[1][::-1]) if back else rows)
            n += len(rows[0])
            if n >= CHUNK or not self.parts:
                yield held[0] if len(held) == 1 else tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if self.file:
            self.file.close()
            self.file = None


def reversed_rows(stream: Stream, prefixes: bool) -> Iterator[Rows]:
    """A sorted stream from its end on. A row's common prefix is the one that the row before, its
    former follower, had with it."""
    carried = None
    for at, value in stream.take(back=True):
        if prefixes:
            last = value[-1:]
            value = np.concatenate([np.zeros(1, value.dtype) if carried is None else carried, value[:-1]])
            carried = last
        yield at, value


class Queue:
    """A priority queue of rows by (symbol, arrival): a stream per bucket of symbols.

    A bucket is one symbol, or with a larger alphabet neighbours of at most about ``pool.bucket`` rows in all.
    """

    def __init__(self, pool: Pool, counts: np.ndarray):
        n = len(counts)
        shared = (np.cumsum(counts) - counts) // max(pool.bucket, 1)
        heavy = np.flatnonzero(counts > pool.bucket)
        starts = np.concatenate([[0], np.flatnonzero(shared[1:] != shared[:-1]) + 1, heavy, heavy + 1])
        self.edges = np.append(np.unique(starts[starts < n]), n) if n > pool.single else np.arange(n + 1)
        self.streams = [Stream(pool) for _ in self.edges[1:]]
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def push(self, symbol: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        """Rows by symbol, those of one symbol in order of arrival."""
        self.waiting.append((symbol, at, value))
        self.held += len(at)
        if self.held >= CHUNK // 4:
            self.deal()

    def deal(self) -> None:
        if not self.held:
            return
        symbol, at, value = self.waiting[0]
        if len(self.waiting) > 1:
            symbol, at, value = map(np.concatenate, zip(*self.waiting, strict=True))
            order = np.argsort(symbol, kind="stable")
            symbol, at, value = symbol[order], at[order], value[order]
        self.waiting, self.held = [], 0
        first, last = np.searchsorted(self.edges, (int(symbol[0]), int(symbol[-1])), "right") - 1
        cuts = np.searchsorted(symbol, self.edges[first + 1 : last + 1].astype(symbol.dtype)).tolist()
        for k, a, b in zip(range(first, last + 1), [0, *cuts], [*cuts, len(at)], strict=True):
            self.streams[k].append(at[a:b], value[a:b])

    def take(self, bucket: int) -> Iterator[Rows]:
        """Rows of a bucket in order of arrival, those that are sent to it meanwhile too."""
        self.deal()
        while True:
            for rows in self.streams[bucket].take():
                yield rows
                self.deal()
            if not self.streams[bucket].parts:
                return


class Between:
    """Least common prefix of what was taken out between two rows that are sent to one symbol."""

    def __init__(self, symbols: int):
        self.batch, self.tail = mapped(symbols, np.int32), mapped(symbols, np.uint16)  # batch: 0 before the first
        self.low, self.n = np.empty(1 << 10, np.uint16), 1  # low[b]: least of batches b and later

    def close(self, least: int) -> None:
        """The batch is over: least is its least common prefix."""
        if self.n + 1 >= len(self.low):
            self.low = np.concatenate([self.low, np.empty_like(self.low)])
        self.low[self.n] = FAR
        k = np.searchsorted(self.low[1 : self.n + 1], least, "right") + 1  # low ascends
        self.low[k : self.n + 1] = least
        self.n += 1
        self.low[self.n] = FAR

    def prefixes(self, taken: np.ndarray, who: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Common prefixes for the rows that ``who`` send to ``target``; both ordered by target."""
        heads = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        ends = np.append(heads[1:], len(who)) - 1
        low = np.empty(len(who), np.int64)
        low[1:] = who[:-1] + 1
        low[heads] = 0
        least = range_minima(taken, np.concatenate([low, who[ends] + 1]), np.concatenate([who, np.full(len(ends), len(taken) - 1)]))
        value, rest = least[: len(who)], least[len(who) :]
        symbol = target[heads]
        batch = self.batch[symbol]
        self.low[self.n] = FAR
        earlier = np.minimum(self.tail[symbol], self.low[batch + 1])
        value[heads] = np.minimum(value[heads], earlier)
        value = np.minimum(value, np.uint16(65534)) + np.uint16(1)
        value[heads[batch == 0]] = 0
        self.batch[symbol], self.tail[symbol] = self.n, rest
        return value


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high]; FAR for an empty range."""
    size = high - low + 1
    out = np.full(len(low), FAR)
    table, width, place = values, 1, np.flatnonzero(size > 0)
    while len(place):
        here = size[place] < 2 * width
        mine = place[here]
        out[mine] = np.minimum(table[low[mine]], table[high[mine] - width + 1])
        place = place[~here]
        if len(place):
            table = np.minimum(table[: len(table) - width], table[width:])
            width *= 2
    return out


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and b, counted up to cap; what is past the end differs from all."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(cap > 0)
    n, step = len(t), 4
    while len(live):
        lanes = np.arange(step)
        x, y = a[live] + out[live], b[live] + out[live]
        if int(max(x.max(), y.max())) + step <= n:
            same = t[x[:, None] + lanes] == t[y[:, None] + lanes]
        else:
            x, y = x[:, None] + lanes, y[:, None] + lanes
            same = (t[np.minimum(x, n - 1)] == t[np.minimum(y, n - 1)]) & (x < n) & (y < n)
        whole = same.all(axis=1)
        out[live] += np.where(whole, step, same.argmin(axis=1))
        live = live[whole & (out[live] < cap[live])]
        step = min(2 * step, 32)
    return np.minimum(out, cap)


class Suffixes:
    """Suffixes of a string of symbols 0..count-1 whose last, 0, occurs nowhere else."""

    def __init__(self, t: np.ndarray, count: int, pool: Pool, cap: int):
        self.t, self.count, self.pool, self.cap = t, count, pool, cap
        self.place = np.int32 if len(t) < 1 << 31 else np.int64

    def descending(self, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """emit(positions, common prefixes with the suffix before) for all suffixes, the largest first."""
        if len(self.t) <= max(self.pool.base, 2):
            order = by_doubling(self.t)[::-1]
            emit(order, np.append(np.uint16(0), self.direct(order[1:], order[:-1])))
            return
        stars, names, distinct = self.named()
        self.counts = self.histogram()
        rows = Cursor(self, self.star_rows(stars, names, distinct), False)
        larges = Stream(self.pool)
        self.induce(rows, False, True, lambda at, value, before, queued: larges.append(at[queued], value[queued]))
        del rows, names
        rows = Cursor(self, reversed_rows(larges, True), True)
        self.induce(rows, True, True, lambda at, value, before, queued: emit(at, value))
        emit(np.array([len(self.t) - 1], self.place), np.zeros(1, np.uint16))

    def direct(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return common_prefix(self.t, a, b, np.full(len(a), self.cap)).astype(np.uint16)

    def histogram(self) -> np.ndarray:
        counts = mapped(self.count, np.int64)
        for i in range(0, len(self.t), 16 * CHUNK):
            symbol, n = np.unique(self.t[i : i + 16 * CHUNK], return_counts=True)
            counts[symbol] += n
        return counts

    def key(self, at: np.ndarray, flip: bool) -> np.ndarray:
        """Symbols at the positions; from the largest on with flip."""
        return self.t.dtype.type(self.count - 1) - self.t[at] if flip else self.t[at]

    def star_positions(self) -> Iterator[np.ndarray]:
        """Positions of the S* suffixes by blocks from the right, each ascending."""
        small = True  # whether the suffix after the block is of type S
        for end in range(len(self.t) - 1, 0, -CHUNK):
            begin = max(0, end - CHUNK)
            s = np.asarray(self.t[begin : end + 1])
            other = np.where(s[1:] != s[:-1], np.arange(end - begin), end - begin)
            after = np.minimum.accumulate(other[::-1])[::-1]
            kind = np.where(after < end - begin, s[np.minimum(after, end - begin - 1)] < s[np.minimum(after + 1, end - begin)], small)
            kind = np.append(kind, small)
            yield (np.flatnonzero(kind[1:] & ~kind[:-1]) + begin + 1).astype(self.place)
            small = bool(kind[0])

    def named(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions of the S* suffixes, the name of each one's substring, and how many names there are."""
        self.counts = self.histogram()
        first = Queue(self.pool, self.counts)
        total = 0
        for at in self.star_positions():
            symbol = self.t[at]
            order = np.argsort(symbol, kind="stable")
            first.push(symbol[order], at[order], at[order])
            total += len(at)

        def by_first() -> Iterator[Rows]:
            for k, (low, high) in enumerate(zip(first.edges, first.edges[1:], strict=False)):
                if high - low == 1:
                    yield from first.take(k)
                else:
                    for at, end in gathered(first.take(k)):
                        order = np.argsort(self.t[at], kind="stable")
                        yield at[order], end[order]

        larges = Stream(self.pool)
        self.induce(Cursor(self, by_first(), False), False, False, lambda at, value, before, queued: larges.append(at[queued], value[queued]))
        parts = max(1, -(-len(self.t) * 2 // max(self.pool.bucket, 1)))
        width = -(-len(self.t) // parts)
        dealt = [Stream(self.pool) for _ in range(parts)]
        state = {"at": None, "name": -1}

        def name(at: np.ndarray, end: np.ndarray) -> None:
            """Number the substrings in descending order and deal them out by position."""
            if state["at"] is not None:
                at, end = np.append(state["at"], at), np.append(state["end"], end)
            size = end - at + 1
            fresh = size[1:] != size[:-1]
            maybe = np.flatnonzero(~fresh)
            fresh[maybe] = common_prefix(self.t, at[maybe], at[maybe + 1], size[maybe]) < size[maybe]
            number = np.cumsum(np.append(state["at"] is None, fresh)).astype(self.place) + self.place(state["name"])
            new = slice(int(state["at"] is not None), None)
            state.update(at=at[-1], end=end[-1], name=int(number[-1]))
            at, number = at[new], number[new]
            order = np.argsort(at // width, kind="stable")
            at, number = at[order], number[order]
            cuts = np.searchsorted(at // width, np.arange(parts + 1)).tolist()
            for k in range(parts):
                if cuts[k] < cuts[k + 1]:
                    dealt[k].append(at[cuts[k] : cuts[k + 1]], number[cuts[k] : cuts[k + 1]])

        waiting: list[Rows] = []
        state["waiting"] = 0

        def stars_only(at: np.ndarray, end: np.ndarray, before: np.ndarray, queued: np.ndarray) -> None:
            star = np.flatnonzero(queued & (at > 0) & (before < self.key(at, True)))
            waiting.append((at[star], end[star]))
            state["waiting"] += len(star)
            if state["waiting"] >= CHUNK:
                name(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting.clear()
                state["waiting"] = 0

        self.induce(Cursor(self, reversed_rows(larges, False), True), True, False, stars_only)
        last = np.array([len(self.t) - 1], self.place)
        waiting.append((last, last))
        name(*map(np.concatenate, zip(*waiting, strict=True)))
        distinct = state["name"] + 1
        stars, names, done = mapped(total, self.place), mapped(total, np.int32 if distinct < 1 << 31 else np.int64), 0
        for part in dealt:
            for at, number in gathered(part.take()):
                order = np.argsort(at, kind="stable")
                stars[done : done + len(at)] = at[order]
                names[done : done + len(at)] = distinct - 1 - number[order]
                done += len(at)
        return stars, names, distinct

    def star_rows(self, stars: np.ndarray, names: np.ndarray, distinct: int) -> Iterator[Rows]:
        """S* suffixes in order, each with its common prefix with the one before."""
        n = len(names)
        if distinct == n:
            order = mapped(n, self.place)
            for i in range(0, n, CHUNK):
                order[names[i : i + CHUNK]] = np.arange(i, min(i + CHUNK, n))
            ranked: Iterator[Rows] = ((np.asarray(order[i : i + CHUNK]), np.zeros(min(CHUNK, n - i), np.uint16)) for i in range(0, n, CHUNK))
        else:
            self.pool.recursions += n > self.pool.base
            found = Stream(self.pool)
            Suffixes(names, distinct, self.pool, self.cap).descending(found.append)
            ranked = reversed_rows(found, True)
        last = None
        for number, equal in ranked:
            at = np.asarray(stars[number])
            other = np.append(number[:1] if last is None else last, number[:-1])
            equal = equal.astype(np.int64)
            done = stars[np.minimum(number + equal, n - 1)] - at
            left = np.where(done < self.cap, self.cap - done, 0)
            value = np.minimum(done, self.cap)
            value += common_prefix(self.t, stars[np.minimum(other + equal, n - 1)], stars[np.minimum(number + equal, n - 1)], left)
            if last is None:
                value[0] = 0
            last = number[-1:]
            yield at, value.astype(np.uint16)

    def run_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes of different types that begin with one symbol: the shorter of both runs of it."""
        out = np.ones(len(a), np.int64)
        live = np.arange(len(a))
        symbol, n = self.t[a], len(self.t)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            more = (x < n) & (y < n) & (self.t[np.minimum(x, n - 1)] == symbol[live]) & (self.t[np.minimum(y, n - 1)] == symbol[live])
            live = live[more]
            out[live] += 1
            live = live[out[live] < self.cap]
        return out

    def induce(self, second: Cursor, flip: bool, prefixes: bool, emit: Emit) -> None:
        """Take out all rows by symbol, for each symbol first the queue's and then those of ``second``.

        A queue's row sends the suffix before it if that symbol isn't less than its own, one of
        second if it is greater. emit(positions, values, symbols before, whether from the queue).
        """
        queue = Queue(self.pool, self.counts[::-1] if flip else self.counts)
        between = Between(self.count) if prefixes else None

        def step(at: np.ndarray, value: np.ndarray, before: np.ndarray, sends: np.ndarray, queued: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Emit rows in order; the rows that they send, by symbol."""
            emit(at, value, before, queued)
            who = np.flatnonzero(sends)
            target = before[who]
            order = np.argsort(target, kind="stable")
            who, target = who[order], target[order]
            if between:
                carried = between.prefixes(value, who, target) if len(who) else value[:0]
                if len(value):
                    between.close(value.min())
            else:
                carried = value[who]
            return target, at[who] - self.place(1), carried

        for k, (low, high) in enumerate(zip(queue.edges.tolist(), queue.edges[1:].tolist(), strict=False)):
            if high - low == 1:
                self.one(queue, k, low, second, flip, prefixes, step)
            else:
                self.several(queue, k, high, second, flip, prefixes, step)

    def one(self, queue: Queue, bucket: int, symbol: int, second: Cursor, flip: bool, prefixes: bool, step) -> None:
        """The rows of one symbol, chunk by chunk; its queue grows by what the symbol sends to itself."""
        last = None
        for at, value in queue.take(bucket):
            before = self.key(at - 1, flip)
            queue.push(*step(at, value, before, (at > 0) & (before >= symbol), np.ones(len(at), bool)))
            last = at[-1:]
        for at, value, before in second.below(symbol + 1):
            if prefixes and last is not None:
                value = value.copy()
                value[0] = self.run_prefix(last, at[:1])[0]
                last = None
            queue.push(*step(at, value, before, (at > 0) & (before > symbol), np.zeros(len(at), bool)))

    def several(self, queue: Queue, bucket: int, high: int, second: Cursor, flip: bool, prefixes: bool, step) -> None:
        """The rows of a bucket of symbols, in batches of as many symbols as can be ordered at once.

        No row is sent to a symbol below its own. So symbols below the least one that any row left
        would send to within the bucket get no more rows, and are taken out together.
        """
        empty = np.empty(0, np.int64)

        def described(at: np.ndarray, value: np.ndarray, from_queue: bool, order: bool) -> list[np.ndarray]:
            symbol, before = self.key(at, flip).astype(np.int64), self.key(at - 1, flip).astype(np.int64)
            if order:
                o = np.argsort(symbol, kind="stable")
                at, value, symbol, before = at[o], value[o], symbol[o], before[o]
            sends = (at > 0) & ((before >= symbol) if from_queue else (before > symbol))
            return [at, value, symbol, before, sends, np.where(sends & (before < high), before, high)]

        rows = [described(*r, True, True) for r in gathered(queue.take(bucket))]
        main = rows[0] if rows else [empty] * 6
        other = [described(at, value, False, False) for at, value, _ in second.below(high)]
        other = [np.concatenate(c) for c in zip(*other, strict=True)] if other else [empty] * 6
        least = [np.append(np.minimum.accumulate(x[5][::-1])[::-1], high) for x in (main, other)]
        arrived: list[np.ndarray] | None = None
        i = j = 0
        while True:
            some = [int(x[2][p]) for x, p in ((main, i), (other, j)) if p < len(x[2])]
            if arrived is not None and len(arrived[0]):
                some.append(int(arrived[2].min()))
            if not some:
                return
            floor = min(some)
            cut = min(int(least[0][i]), int(least[1][j]), int(arrived[5].min()) if arrived is not None and len(arrived[0]) else high)
            upto = max(cut, floor + 1)
            i2, j2 = int(np.searchsorted(main[2], upto)), int(np.searchsorted(other[2], upto))
            parts = [[c[i:i2] for c in main]] if i2 > i else []
            if arrived is not None and len(arrived[0]):
                mine = arrived[2] < upto
                if mine.any():
                    parts.append([c[mine] for c in arrived])
                    arrived = [c[~mine] for c in arrived]
            late = [c[j:j2] for c in other]
            i, j = i2, j2
            new: list[list[np.ndarray]] = []
            if floor < cut:
                if j2 > 0 and len(late[0]):
                    parts.append(late)
                batch = [np.concatenate(c) for c in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]
                queued = np.ones(len(batch[0]), bool)
                if len(late[0]):
                    queued[len(queued) - len(late[0]) :] = False
                o = np.argsort(2 * batch[2] + ~queued, kind="stable")
                batch, queued = [c[o] for c in batch], queued[o]
                at, value, symbol, before, sends, _ = batch
                if prefixes:
                    meet = np.flatnonzero(~queued[1:] & queued[:-1] & (symbol[1:] == symbol[:-1])) + 1
                    if len(meet):
                        value = value.copy()
                        value[meet] = self.run_prefix(at[meet - 1], at[meet])
                new.append(self.split(queue, high, step(at, value, before, sends, queued)))
            else:  # the symbol sends to itself: wave by wave
                wave = [np.concatenate(c) for c in zip(*parts, strict=True)] if len(parts) > 1 else parts[0] if parts else None
                last = None
                while wave is not None and len(wave[0]):
                    at, value, _, before, sends, _ = wave
                    last = at[-1:]
                    target, at, value = self.split(queue, high, step(at, value, before, sends, np.ones(len(at), bool)))
                    own = target == floor
                    new.append((target[~own], at[~own], value[~own]))
                    wave = described(at[own], value[own], True, False)
                if len(late[0]):
                    at, value, _, before, sends, _ = late
                    if prefixes and last is not None:
                        value = value.copy()
                        value[0] = self.run_prefix(last, at[:1])[0]
                    new.append(self.split(queue, high, step(at, value, before, sends, np.zeros(len(at), bool))))
            fresh = [described(at, value, True, False) for _, at, value in new if len(at)]
            if fresh:
                fresh = fresh if arrived is None else [arrived, *fresh]
                arrived = [np.concatenate(c) for c in zip(*fresh, strict=True)] if len(fresh) > 1 else fresh[0]

    @staticmethod
    def split(queue: Queue, high: int, sent: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Send rows beyond the bucket on to the queue; the others."""
        n = int(np.searchsorted(sent[0], high))
        if n < len(sent[0]):
            queue.push(*(c[n:] for c in sent))
        return tuple(c[:n] for c in sent)


class Cursor:
    """Rows in order of their symbols, handed out up to a symbol at a time."""

    def __init__(self, suffixes: Suffixes, rows: Iterator[Rows], flip: bool):
        self.suffixes, self.rows, self.flip, self.held = suffixes, rows, flip, None

    def below(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of (position, value, symbol before) of the rows left whose symbol is less."""
        while True:
            if self.held is None:
                rows = next(self.rows, None)
                if rows is None:
                    return
                self.held = (*rows, self.suffixes.key(rows[0], self.flip))
            at, value, own = self.held
            n = int(np.searchsorted(own, symbol)) if int(own[-1]) >= symbol else len(own)
            if n:
                yield at[:n], value[:n], self.suffixes.key(at[:n] - 1, self.flip)
            if n < len(own):
                self.held = at[n:], value[n:], own[n:]
                return
            self.held = None


def gathered(rows: Iterator[Rows]) -> list[Rows]:
    """All rows as one chunk, if there are any."""
    parts = list(rows)
    return [tuple(map(np.concatenate, zip(*parts, strict=True)))] if parts else []


def by_doubling(symbols: np.ndarray) -> np.ndarray:
    """Suffix order of a string that fits in memory, where the recursion ends."""
    n, width = len(symbols), 1
    rank = np.asarray(symbols, np.int64)
    while True:
        key = rank * (n + 1)
        key[: max(n - width, 0)] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        if rank[order[-1]] == n - 1:
            return order.astype(np.int32)
        width *= 2


def suffix_array(symbols: np.ndarray, count: int, memory: int = MEMORY, base: int = BASE, cap: int = 60_000, pool: Pool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of symbols (0..count-1) in order, and their common prefix with the one before, counted
    up to cap. The result is in memory; a shard's consumer takes the rows as they come."""
    if not len(symbols):
        return np.empty(0, np.int32), np.empty(0, np.uint16)
    pool = pool or Pool(memory, base)
    text = mapped(len(symbols) + 1, np.uint8 if count < 255 else np.uint16 if count < 65535 else np.int32)
    text[:-1] = symbols
    text[:-1] += 1
    found: list[Rows] = []
    Suffixes(text, count + 1, pool, cap).descending(lambda at, value: found.append((np.array(at), np.array(value))))
    order, value = map(np.concatenate, zip(*found, strict=True))
    return order[::-1][1:], np.minimum(np.append(0, value[::-1][:-1])[1:], cap)
