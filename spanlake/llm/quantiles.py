"""Percentiles per group from mergeable sketches of relative rank error.

A sketch is a ladder of compactors (Cormode, Karnin, Liberty, Thaler, Vesely: Relative Error Streaming Quantiles, 2021).
Level h holds values that stand for 2^h rows each. When a level is full, the part away from the protected tail is sorted
and every other value of it goes up a level; how much of the buffer that is follows the binary counter of its
compactions, so values near the protected end are touched rarely. The rank of a value is thus wrong by a part of its
distance from that end: with ``tail="high"`` the error at the rank r of n is about 0.13 / k * (n - r) as one standard
deviation, so the 99.9th percentile is as sharp, in proportion, as the median. Sketches of partitions, files or days are
merged level by level, with the same bound for the whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 64
SECTIONS = 3
#: One standard deviation of the relative rank error is this / k.
RELATIVE_ERROR = 0.13
#: Groups whose sketches a map task holds before it hands them on.
GROUPS = 20_000
#: Ways in which the sketches of a group are merged at once, before these are merged.
FAN = 64
PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


class _Level:
    __slots__ = ("values", "held", "state", "sections", "k")

    def __init__(self, k: float, state: int = 0, sections: int = SECTIONS):
        self.values: list[np.ndarray] = []
        self.held, self.state, self.sections, self.k = 0, state, sections, k

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.values.append(values)
            self.held += len(values)

    @property
    def section(self) -> int:
        return max(4, 2 * round(self.k / 2))

    @property
    def capacity(self) -> int:
        return 2 * self.section * self.sections

    def sorted(self) -> np.ndarray:
        return np.sort(np.concatenate(self.values)) if self.values else np.zeros(0)


class Sketch:
    def __init__(self, k: int = K, tail: str = "high", salt: int = 0):
        self.k, self.high, self.n, self.salt = k, tail == "high", 0, salt
        self.low, self.top = np.inf, -np.inf
        self.levels: list[_Level] = []

    def _level(self, h: int) -> _Level:
        while len(self.levels) <= h:
            self.levels.append(_Level(self.k))
        return self.levels[h]

    def update(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self.low, self.top = min(self.low, float(values.min())), max(self.top, float(values.max()))
        self._level(0).add(values.astype(float))
        self._compress()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.low, self.top = min(self.low, other.low), max(self.top, other.top)
        for h, theirs in enumerate(other.levels):
            mine = self._level(h)
            mine.state |= theirs.state
            if theirs.sections > mine.sections:
                mine.sections, mine.k = theirs.sections, theirs.k
            for v in theirs.values:
                mine.add(v)
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            if level.held >= level.capacity:
                self._compact(h, level)
            h += 1

    def _compact(self, h: int, level: _Level) -> None:
        values = level.sorted()
        ready = min(((~level.state & (level.state + 1)).bit_length() - 1) + 1, level.sections)  # one more than the trailing ones of the counter
        kept = level.capacity // 2 + (level.sections - ready) * level.section
        kept += (len(values) - kept) % 2
        away, stay = (values[: len(values) - kept], values[len(values) - kept :]) if self.high else (values[kept:], values[:kept])
        level.values, level.held = [stay], len(stay)
        # the coin comes from the content and the salt, which says which partition and group: a task that runs again throws
        # the same, while equal rows of other partitions or days throw others, so that their errors don't add up
        coin = hash((self.salt, float(away[0]), float(away[-1]), len(away), h, level.state)) >> 7 & 1
        self._level(h + 1).add(away[coin::2])
        level.state += 1
        if level.state >= 1 << (level.sections - 1) and level.k > 8:
            level.sections *= 2
            level.k /= 2**0.5

    def quantiles(self, ps: tuple[float, ...]) -> list[float]:
        """For each p the least held value whose rank reaches p of all rows; the exact ends for 0 and 1."""
        values = np.concatenate([lv.sorted() for lv in self.levels])
        weights = np.concatenate([np.full(lv.held, 1 << h, np.int64) for h, lv in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, ranks = values[order], np.cumsum(weights[order])
        at = np.minimum(np.searchsorted(ranks, np.ceil(np.array(ps) * self.n)), len(values) - 1)
        return [self.low if p <= 0 else self.top if p >= 1 else float(values[i]) for p, i in zip(ps, at, strict=True)]

    def to_bytes(self) -> bytes:
        head = struct.pack("<iiqddi", self.k, self.high, self.n, self.low, self.top, len(self.levels))
        return head + b"".join(struct.pack("<iqid", lv.held, lv.state, lv.sections, lv.k) + lv.sorted().tobytes() for lv in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        k, high, n, low, top, levels = struct.unpack_from("<iiqddi", data)
        s, at = cls(k, "high" if high else "low"), struct.calcsize("<iiqddi")
        s.n, s.low, s.top = n, low, top
        for _ in range(levels):
            held, state, sections, section = struct.unpack_from("<iqid", data, at)
            at += struct.calcsize("<iqid")
            level = _Level(section, state, sections)
            level.add(np.frombuffer(data, float, held, at))
            at += 8 * held
            s.levels.append(level)
        return s


def _build(keys: list[str], k: int, tail: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        partition = getattr(TaskContext.get(), "partitionId", int)()

        def out() -> pa.RecordBatch:
            columns = [pa.array([key[i] for key in held], pa.string()) for i in range(len(keys))]
            return pa.record_batch([*columns, pa.array([s.to_bytes() for s in held.values()], pa.binary())], names=[*keys, "sketch"])

        for b in batches:
            if not b.num_rows:
                continue
            value = b.column("_v").to_numpy(zero_copy_only=False).astype(float)
            code = np.zeros(b.num_rows, np.int64)
            for c in keys:
                d = b.column(c).dictionary_encode()
                code = code * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
            names = zip(*(b.column(c).take(pa.array(order[at])).to_pylist() for c in keys), strict=True)
            for name, own in zip(names, np.split(value[order], at[1:]), strict=True):
                if name not in held:
                    held[name] = Sketch(k, tail, zlib.crc32(repr((partition, name)).encode()))
                held[name].update(own)
            if len(held) > GROUPS:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for parts in b.column("_sketches"):
            first, *rest = (Sketch.from_bytes(p.as_py()) for p in parts.values)
            for s in rest:
                first.merge(s)
            out.append(first.to_bytes())
        names = [n for n in b.schema.names if n != "_sketches"]
        yield pa.record_batch([*(b.column(n) for n in names), pa.array(out, pa.binary())], names=[*names, "sketch"])


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the merged ``sketch`` of all rows with these keys: of partitions, files, days or other groups.

    Further columns are dropped. In two steps, so that no task holds more than a share of a group's sketches.
    """
    schema = "".join(f"{k} string, " for k in keys)
    some = sketches.groupBy(*keys, F.pmod(F.xxhash64("sketch"), F.lit(FAN)).cast("int").alias("_fan")).agg(F.collect_list("sketch").alias("_sketches"))
    some = some.drop("_fan").mapInArrow(_merged, f"{schema}sketch binary")
    return some.groupBy(*keys).agg(F.collect_list("sketch").alias("_sketches")).mapInArrow(_merged, f"{schema}sketch binary")


def build_sketches(rows: DataFrame, keys: dict[str, Column], value: Column, k: int = K, tail: str = "high") -> DataFrame:
    """The keys (as strings) and one ``sketch`` of ``value`` for each; rows with a null or NaN value are ignored.

    A null key is a group of its own. Only the named expressions are read. An empty table gives no row.
    """
    plain = rows.select(*(c.cast("string").alias(n) for n, c in keys.items()), value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    parts = plain.mapInArrow(_build(list(keys), k, tail), "".join(f"{n} string, " for n in keys) + "sketch binary")
    return merge_sketches(parts, list(keys))


def percentiles(sketches: DataFrame, ps: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """The key columns, ``p``, ``value`` (a value of the rows), ``n`` (rows, exact) and ``rank_error``: three standard
    deviations of the rank's error as a part of the rows between it and the protected end."""
    keys = [c for c in sketches.columns if c != "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Sketch.from_bytes(s.as_py()) for s in b.column("sketch")]
            rows = pa.array(np.repeat(np.arange(b.num_rows), len(ps)))
            flat = [v for s in got for v in s.quantiles(ps)]
            n = np.repeat([s.n for s in got], len(ps))
            error = np.repeat([3 * RELATIVE_ERROR / s.k for s in got], len(ps))
            yield pa.record_batch([*(b.column(c).take(rows) for c in keys), pa.array(np.tile(ps, len(got))), pa.array(flat, pa.float64()), pa.array(n, pa.int64()), pa.array(error, pa.float64())], names=[*keys, "p", "value", "n", "rank_error"])

    return sketches.mapInArrow(run, "".join(f"{k} string, " for k in keys) + "p double, value double, n bigint, rank_error double")
