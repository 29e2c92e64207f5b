"""The index beside a sorted BAM file: which stretches of the file hold a region's records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from spanlake.sources.bam import blocks, header
from spanlake.sources.files import Piece, created, exists, listed, opened

#: (first bin, positions of a bin as a power of two) of the index's six levels.
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))


class Chunk(Piece):
    """Records between two virtual places (block << 16 | offset in it)."""


def index_of(path: str) -> str | None:
    return next((p for p in (path + ".bai", path.removesuffix(".bam") + ".bai") if exists(p)), None)


def bin_of(start: int, end: int) -> int:
    """The least bin that holds positions start to end - 1 (from 0)."""
    for first, bits in reversed(LEVELS):
        if start >> bits == (end - 1) >> bits:
            return first + (start >> bits)
    return 0


def _bins(start: int, end: int) -> set[int]:
    return {first + b for first, bits in LEVELS for b in range(start >> bits, ((end - 1) >> bits) + 1)}


def chunks(index: str, refs: set[int], start: int, end: int) -> list[tuple[int, int]]:
    """Merged stretches of virtual places that may hold records of ``refs`` over positions start to end - 1 (from 0)."""
    with opened(index) as f:
        data = f.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"{index} is no index")
    at, found = 8, []
    wanted = _bins(start, min(end, 1 << 29))
    for ref in range(struct.unpack_from("<i", data, 4)[0]):
        held, (n_bins,), at = [], struct.unpack_from("<i", data, at), at + 4
        for _ in range(n_bins):
            number, n = struct.unpack_from("<Ii", data, at)
            if ref in refs and number in wanted:
                held += [struct.unpack_from("<QQ", data, at + 8 + 16 * i) for i in range(n)]
            at += 8 + 16 * n
        n_linear = struct.unpack_from("<i", data, at)[0]
        linear = struct.unpack_from(f"<{n_linear}Q", data, at + 4)
        at += 4 + 8 * n_linear
        least = linear[min(start >> 14, n_linear - 1)] if n_linear else 0
        found += [(max(a, least), b) for a, b in held if b > least]
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a >> 16 <= merged[-1][1] >> 16:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def placed_records(path: str, start: int, end: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """The virtual place, the place after it, and the content of each record from ``start`` on, up to ``end``."""
    with opened(path) as f:
        data, skip, places = b"", start & 0xFFFF, []

        def place(offset: int) -> int:
            while len(places) > 1 and places[1][1] <= offset:
                places.pop(0)
            return places[0][0] << 16 | offset - places[0][1]

        for at, more in blocks(f, start >> 16):
            places.append((at, len(data)))
            data += more
            while skip + 4 <= len(data) and skip + 4 + (size := struct.unpack_from("<i", data, skip)[0]) <= len(data):
                here = place(skip)
                if end is not None and here >= end:
                    return
                body, skip = data[skip + 4 : skip + 4 + size], skip + 4 + size
                yield here, place(skip) if skip < len(data) else (at << 16 | 0xFFFF), body
            place(skip)
            base = min(skip, len(data))
            data, skip = data[base:], skip - base
            places[:] = [(p, o - base) for p, o in places]


def write_index(path: str) -> str:
    """Writes the index of a sorted BAM file beside it."""
    names, block, offset = header(path)
    bins: list[dict[int, list[list[int]]]] = [{} for _ in names]
    linear: list[dict[int, int]] = [{} for _ in names]
    for here, after, body in placed_records(path, block << 16 | offset):
        ref, pos, l_name, _, _, n_cigar = struct.unpack_from("<iiBBHH", body)
        if ref < 0 or pos < 0:
            continue
        ops = struct.unpack_from(f"<{n_cigar}I", body, 32 + l_name)
        end = pos + max(1, sum(o >> 4 for o in ops if o & 15 in (0, 2, 3, 7, 8)))
        own = bins[ref].setdefault(bin_of(pos, end), [])
        if own and here >> 16 <= own[-1][1] >> 16:
            own[-1][1] = after
        else:
            own.append([here, after])
        for window in range(pos >> 14, ((end - 1) >> 14) + 1):
            linear[ref].setdefault(window, here)
    out = b"BAI\1" + struct.pack("<i", len(names))
    for own, windows in zip(bins, linear, strict=True):
        out += struct.pack("<i", len(own)) + b"".join(struct.pack("<Ii", b, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for b, c in own.items())
        n, last = max(windows, default=-1) + 1, 0
        filled = []
        for w in range(n):
            last = windows.get(w, last)
            filled.append(last)
        out += struct.pack("<i", n) + struct.pack(f"<{n}Q", *filled)
    with created(path + ".bai") as f:
        f.write(out)
    return path + ".bai"


def write_indexes(spark: SparkSession, folder: str) -> list[str]:
    """Indexes all files of a folder, each in a task of its own."""
    paths = listed(folder, (".bam",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([write_index(p) for p in b.column("path").to_pylist()], pa.string())], names=["path"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return sorted(r.path for r in files.mapInArrow(run, "path string").collect())
