"""Best-fit packing of pieces by exact-complement hashing over the histogram of their lengths."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.runtime import Scratch

Pattern = tuple[tuple[int, ...], int]


class Sums:
    """Which available lengths, one, two or three of them, add up to a sum; counts only fall.

    Pairs are indexed by their sum, the longest first, triples by their longest and the sum of the
    pair beside it.  What has run out, or is longer than any piece to come, is passed for good.
    """

    def __init__(self, count: np.ndarray, capacity: int):
        self.count = count.tolist()
        self.longest = capacity
        self.lengths = np.flatnonzero(count)[::-1].tolist()
        lengths = np.array(self.lengths, np.int64)
        a, b = (lengths[i] for i in np.triu_indices(len(lengths)))
        some = np.flatnonzero(a + b <= capacity)
        some = some[np.argsort((a + b)[some], kind="stable")]
        self.a, self.b = a[some].tolist(), b[some].tolist()
        first = np.searchsorted((a + b)[some], np.arange(capacity + 2)).tolist()
        self.pair_at, self.pair_end = first[:-1], first[1:]
        self.triple_at = [0] * (capacity + 1)

    def has(self, *parts: int) -> bool:
        return all(self.count[n] >= parts.count(n) for n in parts)

    def gone(self, n: int) -> bool:
        return n > self.longest or not self.count[n]

    def pair(self, total: int, beside: tuple[int, ...] = ()) -> tuple[int, int] | None:
        """Two available lengths of that sum, the first as long as can be, with ``beside`` available as well."""
        at, end = self.pair_at[total], self.pair_end[total]
        while at < end and (self.gone(self.a[at]) or self.gone(self.b[at])):
            at += 1
        self.pair_at[total] = at
        for k in range(at, end):
            a, b = self.a[k], self.b[k]
            if a <= self.longest and self.has(a, b, *beside):
                return a, b
        return None

    def triple(self, total: int, beside: tuple[int, ...] = ()) -> tuple[int, int, int] | None:
        at, passing = self.triple_at[total], True
        for k in range(at, len(self.lengths)):
            a = self.lengths[k]
            if 3 * a < total:
                break
            if a + 2 <= total and not self.gone(a):
                if (two := self.pair(total - a, (a, *beside))) and two[0] <= a:
                    self.triple_at[total] = max(at, self.triple_at[total])
                    return (a, *two)
                passing = passing and self.pair_at[total - a] == self.pair_end[total - a]
            if passing:
                self.triple_at[total] = k + 1
        return None

    def filling(self, n: int, capacity: int) -> tuple[int, ...] | None:
        """Available lengths up to ``n`` that fill a sequence beside one of ``n``."""
        gap = capacity - n
        if not gap:
            return ()
        if gap <= n and self.has(n, gap):
            return (gap,)
        return self.pair(gap, (n,)) or self.triple(gap, (n,))


def exact_complements(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns that fill a sequence exactly, longest piece first, taken out of ``count``.

    The gap beside a piece is looked up among single lengths, then sums of two and of three; a
    combination is used as often as its scarcest length allows.
    """
    patterns: list[Pattern] = []
    sums = Sums(count, capacity)
    for longest in sums.lengths:
        sums.longest = longest
        while sums.count[longest] and (rest := sums.filling(longest, capacity)) is not None:
            parts = (longest, *rest)
            times = min(sums.count[n] // parts.count(n) for n in parts)
            for n in parts:
                sums.count[n] -= times
            patterns.append((parts, times))
    count[:] = sums.count
    return patterns


def best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing of what is left, in groups of equal sequences."""
    groups: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for n in range(capacity, 0, -1):
        left, gap = int(count[n]), n
        while left and gap < capacity:
            while left and groups[gap]:
                parts, times = groups[gap].popitem()
                taken = min(left, times)
                if taken < times:
                    groups[gap][parts] = times - taken
                room = groups[gap - n]
                room[(*parts, n)] = room.get((*parts, n), 0) + taken
                left -= taken
            gap += 1
        each = capacity // n
        for k, times in ((each, left // each), (left % each, 1)):
            if k and times:
                groups[capacity - k * n][(n,) * k] = times
        count[n] = 0
    return [(parts, times) for room in groups for parts, times in room.items()]


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """How often each combination of lengths makes up a sequence."""
    count = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        count[n] = c
    patterns = exact_complements(count, capacity)
    return patterns + best_fit(count, capacity)


def _intervals(patterns: list[Pattern], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): which sequence the piece of that rank starts a run of, and its offset."""
    rows, rank, base = [], [0] * (capacity + 1), 0
    for parts, times in patterns:
        offset = 0
        for n in parts:
            rows.append((n, rank[n], base, offset))
            rank[n] += times
            offset += n
        base += times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 4


def _number(batches):
    """Adds the task and the piece's number among the task's pieces of its length."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        nth = []
        for n in batch.column(1).to_pylist():
            nth.append(seen.get(n, 0))
            seen[n] = nth[-1] + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(nth), pa.int64()), pa.array(nth, pa.int64())], ["record", "length", "part", "nth"])


def _place(batches, intervals: tuple[np.ndarray, ...]):
    length, first, base, offset = intervals
    span = np.int64(1 << 40)
    for batch in batches:
        n, rank = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        # Lengths are bounded, so (length, rank) is one sortable number.
        at = np.searchsorted(length * span + first, n * span + rank, side="right") - 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base[at] + rank - first[at]), pa.array(offset[at])], ["record", "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """(record, sequence_id, offset): each row of ``pieces``, whole in ``record``, and its place.

    Lengths must be 1 to ``capacity`` (at most 65,536), so their histogram is bounded by the capacity
    and is all that the driver sees: the plan says how often each combination of lengths makes up a
    sequence.  Pieces of one length are interchangeable; each gets a rank (its task's base plus its
    number within the task, so a length that a third of all pieces share is no hot key), and the
    rank alone tells its sequence and offset.  An empty table gives an empty result.
    """
    scratch = Scratch(pieces.sparkSession)
    record = T.StructField("record", pieces.schema)
    numbered = T.StructType([record, *(T.StructField(c, T.LongType()) for c in ("length", "part", "nth"))])
    tagged = scratch.save(pieces.select(F.struct("*").alias("record"), F.col(length_col).cast("long").alias("length")).mapInArrow(_number, numbered), "pieces")
    by_task = scratch.save(tagged.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not all(1 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # The bases grow with the tasks, so they are dealt out, not broadcast.
    ranked = tagged.join(bases.hint("merge"), ["part", "length"]).select("record", "length", (F.col("base") + F.col("nth")).alias("rank"))
    placed = T.StructType([record, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(partial(_place, intervals=_intervals(plan(histogram, capacity), capacity)), placed)
