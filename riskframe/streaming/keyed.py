"""Past-only entity features of a stream: state by key in time buckets, in a state store that keeps it on disk.

The features are those of operators.windows.segmented, with the same names. The state of a key is a map from time
bucket to the bucket's rows, and a bounded list of the moments of each recent bucket. A row asks its own bucket and, for
each window, the one where the window begins; what lies between comes from the moments. A batch rewrites the buckets
that it adds to, and no others, so that its cost does not grow with a key's history. A key of at most SMALL rows is one
value instead, read and written at once: most keys are small, and each call to the store takes longer than their rows.

A key's rows of a batch go to its state and come back as lists, PACK rows each at most, as a row by itself costs more to
hand over than to compute; their features are computed together.

Keys are dealt by a hash into `groups` a level, and a group's small keys are one value, as a call for each key costs more
than its rows: the features of all of them are computed together. A batch reads and writes the small keys of each group
that it adds to; tens of millions of keys want more groups. Keys that expire (idle) have a state each.
"""

from __future__ import annotations

import bisect
import math
import pickle
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskframe.operators.windows import BUCKET, DAY, STATS

#: The provider that transformWithState needs: state on local disk, changes in the checkpoint.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE = (0, 0, 0.0, 0.0, 0.0)
#: Rows (and values of other columns) up to which a key's state is one value.
SMALL = 512
#: Rows that a key holds up to which all of them are compared at once, and rows whose features are computed together.
DENSE, TOGETHER = 1_024, 256
#: Rows of a key in a list, and rows that a task holds while it makes lists.
PACK, HELD = 4_096, 500_000
NEVER = -(1 << 62)
#: Groups that the keys of a level are dealt into, and rows in windows that are looked at together.
GROUPS, LOOKED_AT = 256, 1 << 20


def moments(values: np.ndarray, rows: int) -> tuple[int, int, float, float, float]:
    """(rows, values, sum, mean, sum of squared deviations); NaN is no value."""
    x = values[~np.isnan(values)] if rows else values
    if not len(x):
        return rows, 0, 0.0, 0.0, 0.0
    mean = float(x.mean())
    return rows, len(x), float(x.sum()), mean, float(((x - mean) ** 2).sum())


def merged(a: tuple, b: tuple) -> tuple[int, int, float, float, float]:
    if not a[1] or not b[1]:
        x = a if a[1] else b
        return a[0] + b[0], x[1], x[2], x[3], x[4]
    m, d = a[1] + b[1], b[3] - a[3]
    share = b[1] / m
    mean = a[3] + d * share if math.isfinite(d) else (a[2] + b[2]) / m
    return a[0] + b[0], m, a[2] + b[2], mean, a[4] + b[4] + d * d * share * a[1]


def points(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """moments() of each value by itself."""
    known = ~np.isnan(values)
    x = np.where(known, values, 0.0)
    return np.ones(len(x), np.int64), known.astype(np.int64), x, x, np.zeros(len(x))


def ranges(parts: tuple[np.ndarray, ...], lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Moments of the parts lo <= i < hi, for each of such pairs; nothing but counts is ever subtracted."""
    n, m, s, mean, q = parts
    hi = np.maximum(lo, hi)
    counts = [np.concatenate([[0], np.cumsum(x)]) for x in (n, m)]
    n_in, m_in = (c[hi] - c[lo] for c in counts)
    least, most = (lo.min(), hi.max()) if len(lo) else (0, 0)
    span = slice(least, most)
    i = np.arange(least, most)
    inside = (i >= lo[:, None]) & (i < hi[:, None]) & (m[span] > 0)
    s_in = np.where(inside, s[span], 0.0).sum(1)
    mean_in = s_in / np.maximum(m_in, 1)
    d = np.where(inside, mean[span] - mean_in[:, None], 0.0)
    return n_in, m_in, s_in, mean_in, (np.where(inside, q[span], 0.0) + d * d * m[span]).sum(1)


def merged_all(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """merged() of each pair."""
    m, d = a[1] + b[1], b[3] - a[3]
    share = b[1] / np.maximum(m, 1)
    both = (a[1] > 0) & (b[1] > 0)
    other = [np.where(a[1] > 0, x, y) for x, y in zip(a[3:], b[3:], strict=True)]
    mean = np.where(np.isfinite(d), a[3] + d * share, (a[2] + b[2]) / np.maximum(m, 1))
    return a[0] + b[0], m, a[2] + b[2], np.where(both, mean, other[0]), np.where(both, a[4] + b[4] + d * d * share * a[1], other[1])


def spans(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Moments of the values lo <= i < hi, for each of such pairs, by LOOKED_AT of these rows at once; nothing is ever subtracted."""
    known, out = ~np.isnan(values), []
    x, n = np.where(known, values, 0.0), np.maximum(hi - lo, 0)
    parts = np.concatenate([[0], np.cumsum(n)]) // LOOKED_AT
    for at in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(parts[:-1])) + 1):
        size = n[at]
        row = np.repeat(np.arange(len(at)), size)
        i = np.arange(len(row)) + np.repeat(lo[at] - (np.cumsum(size) - size), size)
        m = np.bincount(row, known[i], len(at)).astype(np.int64)
        total = np.bincount(row, x[i], len(at))
        mean = total / np.maximum(m, 1)
        d = np.where(known[i], x[i] - mean[row], 0.0)
        out.append((size, m, total, mean, np.bincount(row, d * d, len(at))))
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., _level, _key) as lists by key, as (_level, _key, lists); a key comes once for HELD rows, if it has no more than PACK."""

    def lists(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        codes = [rows[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in ("_level", "_key")]
        order = np.lexsort(codes)
        level, key = (c[order] for c in codes)
        fresh = np.concatenate([[True], (level[1:] != level[:-1]) | (key[1:] != key[:-1])])
        starts = np.flatnonzero(fresh)
        starts = starts[np.cumsum(fresh) - 1]
        starts = np.flatnonzero((np.arange(len(order)) - starts) % PACK == 0)
        ends = pa.array(np.append(starts, len(order)).astype(np.int32))
        rows = rows.take(pa.array(order))
        names = [c for c in rows.column_names if c not in ("_level", "_key")]
        keys = [rows[c].take(pa.array(starts)).combine_chunks() for c in ("_level", "_key")]
        return pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(ends, rows[c].combine_chunks()) for c in names)], ["_level", "_key", *names])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield lists(held)
            held, n = [], 0
    if n:
        yield lists(held)


class Features(StatefulProcessor):
    """One key: rows in, as lists, a row of features out for each, as lists too."""

    def __init__(self, t: str, amount: str, id: str, windows: dict[str, int | None], others: list[str], bucket: int, lateness: int, idle_ms: int | None) -> None:
        self.t, self.amount, self.id, self.windows, self.others, self.bucket, self.idle_ms = t, amount, id, windows, others, bucket, idle_ms
        self.most, self.dense = SMALL, DENSE
        # Buckets behind the latest one: of a row in time, and of what its windows reach.
        self.in_time = lateness // bucket
        self.keep = self.in_time + max(s for s in [0, *windows.values()] if s is not None) // bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        firsts = "".join(f", f{j} array<bigint>" for j in range(len(self.others)))
        counts = "".join(f", d{j} bigint" for j in range(len(self.others)))
        self.handle = handle
        self.rows = handle.getMapState("rows", "bucket bigint", f"times array<bigint>, amounts array<double>{firsts}")
        self.index = handle.getListState("index", f"bucket bigint, n bigint, m bigint, s double, mean double, q double, last bigint{counts}")
        small = "".join(f", f{j} array<array<bigint>>, l{j} array<string>, v{j} array<bigint>" for j in range(len(self.others)))
        self.small = handle.getValueState("small", f"buckets array<bigint>, times array<array<bigint>>, amounts array<array<double>>, old array<bigint>, olds array<double>{small}")
        self.levels = [handle.getMapState(f"level{j}", "level string", "first bigint") for j in range(len(self.others))]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        lists: list[list] = [[] for _ in range(3 + len(self.others))]
        for row in rows:
            for own, c in zip(lists, (self.t, self.id, self.amount, *self.others), strict=True):
                own.extend(row[c])
        order = sorted(range(len(lists[0])), key=list(zip(*lists[:2], strict=True)).__getitem__)
        times, ids, amounts, *levels = ([x[i] for i in order] for x in lists)
        amounts = [math.nan if a is None else a for a in amounts]
        held: dict[int, list[list]] = {}
        known_first: list[dict[str, int]] = [{} for _ in self.others]
        small, index = self.small.get(), {}  # a bucket's moments; None: to be taken from its rows
        old = [*NONE, NEVER, *[0] * len(self.others)]
        if small is None:
            # One entry stands for all buckets that are older than those kept.
            index = {e[0]: tuple(e[1:]) for e in self.index.get()}
            inline = not index
            old = list(index.pop(NEVER, old))
        else:
            inline = True
            own_buckets, all_times, all_amounts, o, q, *firsts = small
            old = [o[0], o[1], *q, *o[2:]]
            for i, b in enumerate(own_buckets):
                held[b] = [list(x[i]) for x in (all_times, all_amounts, *firsts[::3])]
                index[b] = None
            known_first = [dict(zip(names, at, strict=True)) for names, at in zip(firsts[1::3], firsts[2::3], strict=True)]
        own = [t // self.bucket for t in times]
        low, least = (max(index) - self.keep, max(index) - self.in_time) if index else (NEVER,) * 2
        changed: set[int] = set()
        stored = set() if inline else set(index)

        def bucket(b: int) -> list[list]:
            if b not in held:
                held[b] = [list(x) for x in self.rows.getValue((b,))] if b in stored else [[] for _ in range(2 + len(self.others))]
            return held[b]

        for b, t, a in zip(own, times, amounts, strict=True):
            if b < low:  # too late for a bucket of its own
                old = [*merged(tuple(old[:5]), moments(np.array([a]), 1)), max(old[5], t), *old[6:]]
                continue
            at = bucket(b)
            i = bisect.bisect_right(at[0], t)
            at[0].insert(i, t), at[1].insert(i, a)
            changed.add(b)
        for j, firsts in enumerate(self.first_times(levels, times)):
            for level, t in firsts.items():
                known = (known_first[j].get(level),) if inline else self.levels[j].getValue((level,))
                known = None if known is None else known[0]
                if known is not None and known <= t:
                    continue
                if inline:
                    known_first[j][level] = t
                else:
                    self.levels[j].updateValue((level,), (t,))
                if known is not None:  # a late row came before the one that was the first
                    if known // self.bucket < low:
                        old[6 + j] -= 1
                    else:
                        bucket(known // self.bucket)[2 + j].remove(known)
                        changed.add(known // self.bucket)
                if t // self.bucket < low:
                    old[6 + j] += 1
                else:
                    bisect.insort(bucket(t // self.bucket)[2 + j], t)
                    changed.add(t // self.bucket)
        for b in changed:
            index[b] = None
        compared = inline and sum(len(held[b][0]) for b in index) <= self.dense
        if not compared:
            self.summarise(index, held)
        yield from self.features(key, ids, times, own, index, old, least, bucket, compared)
        # Buckets that no window of a row in time can reach any more join the oldest entry.
        low = max(index) - self.keep if index else low
        gone = sorted(b for b in index if b < low)
        fresh = [b for b in gone if index[b] is None]
        if fresh:  # no moments yet: those of all their rows at once
            old = self.joined(old, self.summary([[x for part in column for x in part] for column in zip(*(held[b] for b in fresh), strict=True)]))
        for b in gone:
            e = index.pop(b)
            old = old if e is None else self.joined(old, e)
            changed.discard(b)
            if b in stored:
                self.rows.removeKey((b,))
        if inline and index and sum(len(held[b][0]) for b in index) <= self.most and sum(map(len, known_first)) <= self.most:
            order = sorted(index)
            parts = [x for j, known in enumerate(known_first) for x in ([held[b][2 + j] for b in order], list(known), list(known.values()))]
            self.small.update((order, [held[b][0] for b in order], [held[b][1] for b in order], [int(x) for x in (old[0], old[1], *old[5:])], [float(x) for x in old[2:5]], *parts))
        else:
            if inline:  # it was small until now
                changed = set(index)
                for j, known in enumerate(known_first):
                    for level, t in known.items():
                        self.levels[j].updateValue((level,), (t,))
                self.summarise(index, held)
                if small is not None:
                    self.small.clear()
            for b in changed:
                self.rows.updateValue((b,), tuple(held[b]))
            self.index.put([(NEVER, *old), *((b, *index[b]) for b in sorted(index))])
        if self.idle_ms:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    @staticmethod
    def summary(x: list[list]) -> tuple:
        return (*moments(np.array(x[1], float), len(x[0])), x[0][-1] if x[0] else NEVER, *map(len, x[2:]))

    def summarise(self, index: dict, held: dict) -> None:
        """The moments of all buckets that have none yet."""
        index.update({b: self.summary(held[b]) for b, e in index.items() if e is None})

    @staticmethod
    def joined(old: list | tuple, e: tuple) -> list:
        return [*merged(tuple(old[:5]), e[:5]), max(old[5], e[5]), *(x + y for x, y in zip(old[6:], e[6:], strict=True))]

    @staticmethod
    def first_times(levels: list[list], times: list[int]) -> list[dict[str, int]]:
        """For each other column, the earliest time of each of its values in the batch, which is in order; null is one."""
        out: list[dict[str, int]] = []
        for column in levels:
            out.append({})
            for x, t in zip(column, times, strict=True):
                out[-1].setdefault("n" if x is None else f"v{x}", t)
        return out

    def features(self, key, ids, times, own, index, old, least, bucket, compared: bool) -> Iterator[Row]:
        """compared: index has no moments, but the rows of all buckets are at hand."""
        named = Row("level", "key", "id", "late", *(f"{label}_{c}" for label in self.windows for c in STATS), "gap", *(f"{o}_distinct" for o in self.others))
        late = np.array(own, np.int64) < least
        found: list[list] = [[] for _ in range(len(named) - 4)]
        t, b = np.array(times, np.int64)[~late], np.array(own, np.int64)[~late]
        order = sorted(index)
        with np.errstate(all="ignore"):
            if not compared:
                upto = [list(old)]  # all before each bucket
                for x in order:
                    upto.append(self.joined(upto[-1], index[x]))
            for at in range(0, len(t), TOGETHER):
                part = slice(at, at + TOGETHER)
                columns = self.compared(t[part], order, old, bucket) if compared else self.spread(t[part], b[part], order, index, upto, bucket)
                for own_column, column in zip(found, columns, strict=True):
                    own_column.extend(column.tolist())
        if late.any():
            places = np.where(late, -1, np.cumsum(~late) - 1).tolist()
            found = [[None if i < 0 else column[i] for i in places] for column in found]
        late = late.tolist()
        for at in range(0, len(ids), PACK):
            part = slice(at, at + PACK)
            yield named(*key, ids[part], late[part], *(column[part] for column in found))

    @staticmethod
    def stats(found: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        n, m, s, mean, q = found
        return [n, np.where(m > 0, s, None), np.where(m > 0, mean, None), np.where(m > 1, np.sqrt(q / np.maximum(m - 1, 1)), None)]

    def compared(self, t: np.ndarray, order: list[int], old: list, bucket) -> list[np.ndarray]:
        """Features of rows in order from all rows that the key holds, and what is older."""
        all_times = np.array([x for b in order for x in bucket(b)[0]], np.int64)
        values = points(np.array([x for b in order for x in bucket(b)[1]], float))
        hi = np.searchsorted(all_times, t)
        out = []
        for seconds in self.windows.values():
            if seconds is None:
                whole = ranges(values, np.zeros(len(t), np.int64), hi)
                out += self.stats(merged_all(tuple(np.full(len(t), x) for x in old[:5]), whole) if old[0] else whole)
            else:
                out += self.stats(ranges(values, np.searchsorted(all_times, t - seconds), hi))
        last = np.append(all_times, old[5])[np.where(hi > 0, hi - 1, len(all_times))]
        out.append(np.where(last == NEVER, None, t - last))
        for j in range(len(self.others)):
            firsts = np.array([x for b in order for x in bucket(b)[2 + j]], np.int64)
            out.append(old[6 + j] + np.searchsorted(firsts, t))
        return out

    def spread(self, t: np.ndarray, b: np.ndarray, order: list[int], index: dict, upto: list, bucket) -> list[np.ndarray]:
        """Features of rows in order from the rows of their own buckets and of those where windows begin, and the moments of others."""
        buckets = np.array(order, np.int64)

        def rows_of(wanted: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(values, starts, ends) of each wanted bucket's list; one that is not there is empty."""
            each, place = np.unique(wanted, return_inverse=True)
            parts = [bucket(x)[column] if x in index else [] for x in each.tolist()]
            ends = np.cumsum([len(x) for x in parts])
            starts = ends - [len(x) for x in parts]
            return np.array([x for part in parts for x in part], float if column == 1 else np.int64), starts[place], ends[place]

        place = np.searchsorted(buckets, b)
        here, starts, _ = rows_of(b, 0)
        until = np.searchsorted(here, t)
        head = ranges(points(rows_of(b, 1)[0]), starts, until)
        known = tuple(np.array([index[x][i] for x in order]) for i in range(5))
        out = []
        for seconds in self.windows.values():
            if seconds is None:
                out += self.stats(merged_all(tuple(np.array([upto[i][c] for i in place.tolist()]) for c in range(5)), head))
                continue
            first = b - seconds // self.bucket
            begun, _, ends = rows_of(first, 0)
            tail = ranges(points(rows_of(first, 1)[0]), np.searchsorted(begun, t - seconds), ends)
            own, again = np.unique(b, return_inverse=True)
            inner = ranges(known, np.searchsorted(buckets, own - seconds // self.bucket, "right"), np.searchsorted(buckets, own))
            out += self.stats(merged_all(merged_all(tail, tuple(x[again] for x in inner)), head))
        before = np.array([upto[i][5] for i in place.tolist()], np.int64)
        last = np.where(until > starts, np.append(here, NEVER)[until - 1], before)
        out.append(np.where(last == NEVER, None, t - last))
        for j in range(len(self.others)):
            firsts, starts, _ = rows_of(b, 2 + j)
            out.append(np.array([upto[i][6 + j] for i in place.tolist()]) + np.searchsorted(firsts, t) - starts)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """A key that stayed away: its history begins anew."""
        for state in (self.rows, self.index, self.small, *self.levels):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


class View:
    """What Features asks of a state, by functions."""

    def __init__(self, **calls: Callable) -> None:
        self.__dict__.update(calls)


class Groups(Features):
    """A group of keys: rows in, as lists with their keys, a row of features out for each, as lists too.

    What Features does for a key it does here with views of the group's states; keys whose rows are all compared
    wait until all of them are, and are computed together.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        firsts = "".join(f", f{j} array<bigint>" for j in range(len(self.others)))
        counts = "".join(f", d{j} array<bigint>" for j in range(len(self.others)))
        rows = handle.getMapState("rows", "own string, bucket bigint", f"times array<bigint>, amounts array<double>{firsts}")
        index = handle.getMapState("index", "own string", f"bucket array<bigint>, n array<bigint>, m array<bigint>, s array<double>, mean array<double>, q array<double>, last array<bigint>{counts}")
        levels = [handle.getMapState(f"level{j}", "own string, level string", "first bigint") for j in range(len(self.others))]
        self.group = handle.getValueState("group", "keys binary")

        def put(entries: list[tuple]) -> None:
            self.large.add(self.own)
            index.updateValue((self.own,), tuple(list(column) for column in zip(*entries, strict=True)))

        def of_key(state) -> View:
            return View(getValue=lambda k: state.getValue((self.own, *k)), updateValue=lambda k, v: state.updateValue((self.own, *k), v), removeKey=lambda k: state.removeKey((self.own, *k)))

        self.rows, self.levels = of_key(rows), [of_key(x) for x in levels]
        self.index = View(get=lambda: zip(*index.getValue((self.own,)), strict=True) if self.own in self.large else (), put=put)
        self.small = View(get=lambda: self.keys.get(self.own), update=lambda value: self.keys.__setitem__(self.own, value), clear=lambda: self.keys.pop(self.own))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        wanted = list(dict.fromkeys([self.t, self.id, self.amount, *self.others]))
        columns: list[list] = [[] for _ in wanted]
        places: dict[str | None, list[int]] = {}
        n = 0
        for row in rows:
            for i, own in enumerate(row["_own"], n):
                places.setdefault(own, []).append(i)
            n += len(row["_own"])
            for column, c in zip(columns, wanted, strict=True):
                column.extend(row[c])
        held = self.group.get()
        self.keys, self.large = pickle.loads(held[0]) if held else ({}, set())
        self.waiting: list[tuple] = []
        for own, at in places.items():
            self.own = "null" if own is None else f"key {own}"
            yield from super().handleInputRows((key[0], own), [{c: [column[i] for i in at] for c, column in zip(wanted, columns, strict=True)}], timerValues)
        self.group.update((pickle.dumps((self.keys, self.large), 5),))
        yield from self.together(key[0])

    def named(self) -> Row:
        return Row("level", "key", "id", "late", *(f"{label}_{c}" for label in self.windows for c in STATS), "gap", *(f"{o}_distinct" for o in self.others))

    def features(self, key, ids, times, own, index, old, least, bucket, compared: bool) -> Iterator[Row]:
        if compared:
            parts = [bucket(b) for b in sorted(index)]
            lists = [list(chain.from_iterable(column)) for column in zip(*parts, strict=True)] if parts else [[] for _ in range(2 + len(self.others))]
            self.waiting.append((key[1], ids, times, [b < least for b in own], tuple(old), lists))
            return
        named = self.named()
        for row in super().features(key, ids, times, own, index, old, least, bucket, compared):
            yield named(row[0], [key[1]] * len(row[2]), *row[2:])

    def together(self, level: str) -> Iterator[Row]:
        """compared() of all keys that wait."""
        if not self.waiting:
            return
        keys, ids, times, late, olds, lists = zip(*self.waiting, strict=True)
        sizes = [len(x) for x in ids]
        late, t = np.array(list(chain.from_iterable(late))), np.array(list(chain.from_iterable(times)), np.int64)
        place = np.repeat(np.arange(len(keys)), sizes)[~late]
        t = t[~late]

        def column(c: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
            """That list of all keys, and where each key's begins."""
            return np.array(list(chain.from_iterable(x[c] for x in lists)), kind), np.concatenate([[0], np.cumsum([len(x[c]) for x in lists])])

        def before(values: np.ndarray, starts: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
            """How many of values, in order within each key, come before a row's key or are less than a bound in it."""
            each, rank = np.unique(values, return_inverse=True)
            codes = np.repeat(np.arange(len(keys)), np.diff(starts)) * (len(each) + 1) + rank
            return lambda bounds: np.searchsorted(codes, place * (len(each) + 1) + np.searchsorted(each, bounds))

        old = [np.array(x)[place] for x in zip(*olds, strict=True)]
        found: list[np.ndarray] = []
        with np.errstate(all="ignore"):
            all_times, starts = column(0, np.int64)
            amounts, until = column(1, float)[0], before(all_times, starts)
            first, hi = starts[place], until(t)
            for seconds in self.windows.values():
                if seconds is None:
                    found += self.stats(merged_all(tuple(old[:5]), spans(amounts, first, hi)))
                else:
                    found += self.stats(spans(amounts, until(t - seconds), hi))
            last = np.where(hi > first, np.append(all_times, NEVER)[hi - 1], old[5])
            found.append(np.where(last == NEVER, None, t - last))
            for j in range(len(self.others)):
                firsts, starts = column(2 + j, np.int64)
                found.append(old[6 + j] + before(firsts, starts)(t) - starts[place])
        if late.any():
            places = np.where(late, -1, np.cumsum(~late) - 1)
            found = [np.append(x.astype(object), [None])[places] for x in found]
        named, ids = self.named(), list(chain.from_iterable(ids))
        names, flags = [keys[i] for i in np.repeat(np.arange(len(keys)), sizes).tolist()], late.tolist()
        for at in range(0, len(ids), PACK):
            part = slice(at, at + PACK)
            yield named(level, names[part], ids[part], flags[part], *(x[part].tolist() for x in found))


def entity_features(stream: DataFrame, keys: dict[str, str], t: str, amount: str, id: str, windows: dict[str, int | None], others: list[str], *, bucket: int = BUCKET, lateness: int = 7 * DAY, idle: int | None = None, groups: int = GROUPS) -> DataFrame:
    """(id, level, key, late, window features, gap, distincts) of each row and each of its keys, from strictly earlier
    rows of that key that have arrived; as segmented() names them, without what is 0 or null there.

    keys: level to key column, of any type (the key comes out as text). Rows of a batch are taken in the order of time,
    and ties do not see each other. Rows may come late by `lateness` seconds after the latest of their key: they get
    all their features, and later rows see them. Still later ones count in the history of what follows, but get no
    features themselves (`late` is true). Null keys are one key; NaN and null amounts are no values.

    idle: seconds of absence after which a key's state goes. groups: into how many the keys of a level are dealt.
    """
    if bad := [s for s in windows.values() if s is not None and (s <= 0 or s % bucket)]:
        raise ValueError(f"windows of {bad} seconds are no multiples of {bucket}")
    own = lambda c: F.col(c).cast("string")
    group = lambda c: own(c) if idle else F.pmod(F.xxhash64(own(c)), F.lit(groups)).cast("string")
    levels = F.array(*(F.struct(F.lit(level).alias("_level"), group(c).alias("_key"), own(c).alias("_own")) for level, c in keys.items()))
    wanted = dict.fromkeys([id, t, amount, *others])
    rows = stream.select(*(F.col(c).cast("string").alias(c) if c in others else F.col(c).cast("double").alias(c) if c == amount else F.col(c).cast("long").alias(c) if c == t else F.col(c) for c in wanted), F.explode(levels).alias("_l"))
    rows = rows.select(*wanted, "_l._own", "_l._level", "_l._key")
    processor = (Features if idle else Groups)(t, amount, id, windows, others, bucket, lateness, idle * 1000 if idle else None)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    lists = rows.repartition("_level", "_key").mapInArrow(packed, "_level string, _key string, " + ", ".join(f"`{c}` array<{kinds[c]}>" for c in [*wanted, "_own"]))
    stats = {f"{label}_{c}": "bigint" if c == "cnt" else "double" for label in windows for c in STATS}
    out = {"id": kinds[id], "late": "boolean", **stats, "gap": "bigint", **{f"{o}_distinct": "bigint" for o in others}}
    if not idle:
        out = {"key": "string", **out}
    schema = "level string, " + ("key string, " if idle else "") + ", ".join(f"{c} array<{kind}>" for c, kind in out.items())
    found = lists.groupBy("_level", "_key").transformWithState(processor, schema, "append", "ProcessingTime" if idle else "None")
    found = found.select("level", *(["key"] if idle else []), F.inline(F.arrays_zip(*out)))
    return found.select("id", "level", "key", *(c for c in out if c not in ("id", "key")))
