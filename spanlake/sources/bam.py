"""BAM files as a Spark data source, decoded in pure Python from the published format.

A file is read in byte ranges, so one large file makes many tasks. A task looks for the first compressed block at or
after its range's start and from it on, however far, for the first place where plausible records follow one another; the
records that begin in blocks that begin in its range are its own, whatever their length. Equality on ``sample_id`` leaves out files, conditions on ``contig`` and
positions leave out records before they are decoded further, and where an index (``.bai``) lies beside a file only its
stretches for the contig and positions are read; only asked columns and tags are decoded.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, LessThanOrEqual
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from spanlake.sources.files import SPLIT, Piece, listed, opened, pieces, sample_of

# The columns of an aligned read, then the tags of the SAM format, with those that are whole numbers.
COLUMNS = ("sample_id", "qname", "flag", "contig", "pos", "pos_start", "pos_end", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
INTEGERS = ("flag", "pos", "pos_start", "pos_end", "mapq", "pnext", "tlen")
TAGS = tuple(
    "AM AS BC BQ BZ CB CC CM CO CP CQ CR CS CT CY E2 FI FS H0 H1 H2 HI IH LB MC MD MI MQ NH NM OA OC OP OQ OX PG PQ PT PU Q2 QT QX R2 RG RX SA SM TC U2 UQ".split()
)
INTEGER_TAGS = frozenset("AM AS CM CP FI H0 H1 H2 HI IH MQ NH NM OP PQ SM TC UQ".split())
_SEQ, _CIGAR = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_SIZES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

SCHEMA = StructType(
    [StructField(c, IntegerType() if c in INTEGERS else StringType()) for c in COLUMNS] + [StructField(f"tag_{t}", IntegerType() if t in INTEGER_TAGS else StringType()) for t in TAGS]
)


def blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    """The place and content of each compressed block from ``at`` on."""
    f.seek(at)
    while len(head := f.read(18)) == 18:
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no block at {at}")
        size = struct.unpack_from("<H", head, 16)[0] + 1
        body = f.read(size - 18)
        data = zlib.decompress(body[:-8], -15)
        if data:
            yield at, data
        at += size


def block_start(f, at: int, end: int) -> int | None:
    """The first block that begins in the range."""
    f.seek(at)
    data = f.read(min(end - at, 1 << 16) + 64)
    for m in re.finditer(rb"\x1f\x8b\x08\x04.{6}\x06\x00BC\x02\x00", data, re.DOTALL):
        if at + m.start() < end:
            size = struct.unpack_from("<H", data, m.end())[0] + 1 if m.end() + 2 <= len(data) else 0
            f.seek(at + m.start() + size)
            if f.read(4) in (b"\x1f\x8b\x08\x04", b""):
                return at + m.start()
    return None


def header(path: str) -> tuple[list[str], int, int]:
    """Reference names, and the block and offset in it where the records begin."""
    with opened(path) as f:
        data, places = b"", []

        def need(n: int) -> None:
            nonlocal data
            while len(data) < n:
                at, more = next(source)
                places.append((at, len(data)))
                data += more

        source = blocks(f, 0)
        need(12)
        if data[:4] != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        need(at + 4)
        n, at, names = struct.unpack_from("<i", data, at)[0], at + 4, []
        for _ in range(n):
            need(at + 4)
            length = struct.unpack_from("<i", data, at)[0]
            need(at + 8 + length)
            names.append(data[at + 4 : at + 3 + length].decode())
            at += 8 + length
        block, base = next((p for p in reversed(places) if p[1] <= at), (0, 0))
        return names, block, at - base


_HEAD = 36
#: Records that must follow one another from a place for it to be a start: so many, or two with so many bytes.
_CERTAIN, _CERTAIN_BYTES = 5, 1 << 20


def _plausible(data: bytearray, at: int, n_ref: int) -> int | None:
    """The length of the record that could begin here, 0 if none can, null if more data must tell."""
    if at + _HEAD > len(data):
        return None
    size, ref, pos, name, _, _, cigar, _, seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if size < 32 or not -1 <= ref < n_ref or not -1 <= mate < n_ref or pos < -1 or mate_pos < -1 or name < 2 or seq < 0 or size < 32 + name + 4 * cigar + (seq + 1) // 2 + seq:
        return 0
    if at + _HEAD + name + 4 * cigar > len(data):
        return None
    raw = data[at + _HEAD : at + _HEAD + name]
    if raw[-1] != 0 or not all(33 <= c <= 126 for c in raw[:-1]):
        return 0
    ops = np.frombuffer(bytes(data[at + _HEAD + name : at + _HEAD + name + 4 * cigar]), "<u4")
    read = int((ops >> 4)[np.isin(ops & 15, (0, 1, 4, 7, 8))].sum())
    return size + 4 if (ops & 15 <= 8).all() and (not cigar or not seq or read == seq) else 0


def _candidates(data: bytearray, start: int, end: int, n_ref: int) -> np.ndarray:
    """Offsets from ``start`` to before ``end`` where the fixed fields could be a record's."""
    raw = np.frombuffer(bytes(data[start : end - 1 + _HEAD]), np.uint8)
    n = len(raw) - _HEAD + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    number = lambda k: (raw[k : k + n].astype(np.int64) | raw[k + 1 : k + 1 + n].astype(np.int64) << 8 | raw[k + 2 : k + 2 + n].astype(np.int64) << 16 | raw[k + 3 : k + 3 + n].astype(np.int64) << 24)
    signed = lambda k: (x := number(k)) - ((x >> 31) << 32)
    ok = (raw[12 : 12 + n] > 1) & (signed(0) >= 32)
    for k in (4, 24):
        x = signed(k)
        ok &= (x >= -1) & (x < n_ref)
    for k in (8, 20, 28):
        ok &= signed(k) >= (0 if k == 20 else -1)
    return start + np.flatnonzero(ok)


class _Stream:
    """The content of a file's blocks from one on. ``limit`` is where, in ``data``, the blocks that begin at or after ``end`` start."""

    def __init__(self, f, at: int, end: int):
        self.source, self.end, self.data = blocks(f, at), end, bytearray()
        self.limit: int | None = None
        self.ended = False

    def more(self) -> bool:
        if (got := next(self.source, None)) is None:
            self.ended = True
            return False
        if self.limit is None and got[0] >= self.end:
            self.limit = len(self.data)
        self.data += got[1]
        return True

    def drop(self, n: int) -> None:
        del self.data[:n]
        if self.limit is not None:
            self.limit -= n

    def follows(self, at: int, n_ref: int) -> bool:
        """Whether records follow one another from here."""
        begun, n = at, 0
        while n < _CERTAIN and not (n > 1 and at - begun > _CERTAIN_BYTES):
            if n and at == len(self.data) and not self.more():
                return True
            size = _plausible(self.data, at, n_ref) if at < len(self.data) else None
            if size == 0:
                return False
            if size is None:
                if not self.more():
                    return False
                continue
            at, n = at + size, n + 1
        return True

    def start(self, n_ref: int) -> int | None:
        """Where the first record begins before ``limit``, however far it is; what lies before is dropped on the way."""
        seen = 0
        while True:
            upto = max(seen, len(self.data) - _HEAD + 1)
            for at in _candidates(self.data, seen, upto if self.limit is None else min(upto, self.limit), n_ref):
                if self.follows(int(at), n_ref):
                    return int(at)
            seen = upto
            if self.limit is not None and seen >= self.limit:
                return None
            self.drop(seen)
            seen = 0
            if not self.more():
                return None


def records(path: str, start: int, end: int, names: list[str], first: tuple[int, int]) -> Iterator[bytes]:
    """The records that begin in the blocks that begin in the range, without their length."""
    with opened(path) as f:
        at = first[0] if start <= first[0] else block_start(f, start, end)
        if at is None or at >= end:
            return
        s = _Stream(f, at, end)
        if start <= first[0]:
            skip = first[1]
        else:  # a record from the range before may reach in, or over the whole range
            found = s.start(len(names))
            if found is None:
                return
            skip = found
        while True:
            while skip + 4 > len(s.data) or skip + 4 + struct.unpack_from("<i", s.data, skip)[0] > len(s.data):
                if s.limit is not None and skip >= s.limit:
                    return
                gone = min(skip, len(s.data))
                s.drop(gone)
                skip -= gone
                if not s.more():
                    if s.data:
                        raise ValueError(f"{path} ends within a record")
                    return
            if s.limit is not None and skip >= s.limit:
                return
            size = struct.unpack_from("<i", s.data, skip)[0]
            yield bytes(s.data[skip + 4 : skip + 4 + size])
            skip += 4 + size


def _tags(data: bytes, at: int, wanted: set[str]) -> dict[str, object]:
    out: dict[str, object] = {}
    while at + 3 <= len(data):
        tag, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            stop = data.index(b"\0", at)
            value: object = data[at:stop].decode("utf-8", "replace") if tag in wanted else None
            at = stop + 1
        elif kind == "B":
            code, n = _SIZES[chr(data[at])], struct.unpack_from("<i", data, at + 1)[0]
            value = struct.unpack_from(f"<{n}{code}", data, at + 5) if tag in wanted else None
            at += 5 + n * struct.calcsize(code)
        else:
            value = struct.unpack_from("<" + _SIZES[kind], data, at)[0]
            value = value.decode() if kind == "A" else value
            at += struct.calcsize(_SIZES[kind])
        if tag in wanted:
            out[tag] = value
    return out


_PAIRS = np.array([ord(_SEQ[b >> 4]) | ord(_SEQ[b & 15]) << 8 for b in range(256)], "<u2")
_QUALITY = bytes(min(q + 33, 255) for q in range(256))


class Decoder:
    """Records to columns: only what is asked for is decoded."""

    def __init__(self, names: list[str], sample: str, wanted: list[str]):
        self.names, self.sample, self.wanted = [*names, None], sample, wanted
        self.bare = [_bare(n) for n in self.names]
        self.tags = {c[4:] for c in wanted if c.startswith("tag_")}
        self.rows: list[list] = [[] for _ in wanted]
        self.n = 0
        self.makers = [self._maker(c) for c in wanted]

    def _maker(self, column: str):
        if column.startswith("tag_"):
            tag, whole = column[4:], column[4:] in INTEGER_TAGS

            def of_tag(r: _Record):
                v = r.tag_values.get(tag)
                if v is None or isinstance(v, tuple):
                    return None if v is None or whole else ",".join(map(str, v))
                return (v if isinstance(v, int) else None) if whole else str(v)

            return of_tag
        names, bare, sample = self.names, self.bare, self.sample
        return {
            "sample_id": lambda r: sample, "qname": lambda r: r.data[32 : 31 + r.l_name].decode(), "flag": lambda r: r.flag, "contig": lambda r: bare[r.ref], "pos": lambda r: r.pos + 1, "pos_start": lambda r: r.pos + 1,
            "pos_end": lambda r: r.pos + sum(o >> 4 for o in r.ops if o & 15 in (0, 2, 3, 7, 8)) if r.pos >= 0 else 0, "mapq": lambda r: r.mapq,
            "cigar": lambda r: "".join(f"{o >> 4}{_CIGAR[o & 15]}" for o in r.ops) or "*", "rnext": lambda r: "=" if r.mate == r.ref and r.mate >= 0 else names[r.mate] or "*", "pnext": lambda r: r.mate_pos + 1, "tlen": lambda r: r.tlen,
            "seq": lambda r: _PAIRS[np.frombuffer(r.data, np.uint8, (r.l_seq + 1) // 2, r.at_seq)].tobytes()[: r.l_seq].decode() or "*", "qual": lambda r: r.qual(),
        }[column]

    def add(self, data: bytes) -> None:
        r = _Record(data, self.tags)
        self.n += 1
        for rows, make in zip(self.rows, self.makers, strict=True):
            rows.append(make(r))

    def batch(self, shape: pa.Schema) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.rows, shape, strict=True)], schema=shape) if self.wanted else pa.RecordBatch.from_struct_array(pa.array([{}] * self.n, pa.struct([])))
        self.rows, self.n = [[] for _ in self.wanted], 0
        return out


class _Record:
    __slots__ = ("at_seq", "data", "flag", "l_name", "l_seq", "mapq", "mate", "mate_pos", "ops", "pos", "ref", "tag_values", "tlen")

    def __init__(self, data: bytes, tags: set[str]):
        self.data = data
        self.ref, self.pos, self.l_name, self.mapq, _, n_cigar, self.flag, self.l_seq, self.mate, self.mate_pos, self.tlen = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32 + self.l_name
        self.ops: tuple[int, ...] = struct.unpack_from(f"<{n_cigar}I", data, at)
        self.at_seq = at + 4 * n_cigar
        at_tags = self.at_seq + (self.l_seq + 1) // 2 + self.l_seq
        # more operations than a record can count stand in a tag, and two stand for them
        long = n_cigar == 2 and self.ops[0] == self.l_seq << 4 | 4 and self.ops[1] & 15 == 3
        self.tag_values = _tags(data, at_tags, tags | {"CG"} if long else tags) if tags or long else {}
        if long and isinstance(self.tag_values.get("CG"), tuple):
            self.ops = self.tag_values["CG"]

    def qual(self) -> str:
        at = self.at_seq + (self.l_seq + 1) // 2
        own = self.data[at : at + self.l_seq]
        return "*" if not own or own[0] == 255 else own.translate(_QUALITY).decode("latin-1")


def _bare(contig: str | None) -> str | None:
    return None if contig is None else "MT" if (b := contig.removeprefix("chr")) == "M" else b


@dataclass
class _Wanted:
    samples: set[str] | None = None
    contigs: set[str] | None = None
    #: least ``pos_end`` and greatest ``pos_start``
    low: int | None = None
    high: int | None = None


class BamReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options, self.wanted = schema, options, _Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        w = self.wanted
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "sample_id" and values is not None:
                w.samples = values if w.samples is None else w.samples & values
            elif column == "contig" and values is not None:
                w.contigs = values if w.contigs is None else w.contigs & values
            elif column == "pos_end" and isinstance(f, GreaterThanOrEqual):
                w.low = f.value if w.low is None else max(w.low, f.value)
            elif column == "pos_start" and isinstance(f, LessThanOrEqual):
                w.high = f.value if w.high is None else min(w.high, f.value)
            yield f  # Spark tests every row again

    def partitions(self) -> list[Piece]:
        paths = [p for p in listed(self.options["path"], (".bam",)) if self.wanted.samples is None or sample_of(p) in self.wanted.samples]
        split = int(self.options.get("splitSize", SPLIT))
        if self.wanted.contigs is None:
            return pieces(paths, split)
        from spanlake.sources.bai import Chunk, chunks, index_of

        out: list[Piece] = []
        low, high = max((self.wanted.low or 1) - 1, 0), self.wanted.high or (1 << 29)
        for p in paths:
            if (index := index_of(p)) is None:
                out += pieces([p], split)
            elif high > low:
                out += [Chunk(p, a, b) for a, b in chunks(index, self._refs(header(p)[0]), low, high)]
        return out

    def _refs(self, names: list[str]) -> set[int]:
        """The numbers of the wanted contigs, whichever way a file spells them."""
        return {i for i, n in enumerate(names) if _bare(n) in self.wanted.contigs}

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where no file is left
            return
        names, block, offset = header(partition.path)
        w = self.wanted
        shape = pa.schema([(f.name, pa.int32() if isinstance(f.dataType, IntegerType) else pa.string()) for f in self.schema])
        kept = None if w.contigs is None else self._refs(names)
        out = Decoder(names, sample_of(partition.path), self.schema.fieldNames())
        from spanlake.sources.bai import Chunk, placed_records

        if isinstance(partition, Chunk):
            found = (body for _, _, body in placed_records(partition.path, partition.start, partition.end))
        else:
            found = records(partition.path, partition.start, partition.end, names, (block, offset))
        size = 0
        for data in found:
            ref, pos = struct.unpack_from("<ii", data)
            if (kept is not None and ref not in kept) or (w.high is not None and pos + 1 > w.high):
                continue
            out.add(data)
            size += len(data)
            if out.n == 5000 or size > 32 << 20:  # long reads make short batches
                yield out.batch(shape)
                size = 0
        if out.n:
            yield out.batch(shape)


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``: a file, a folder or a glob; option ``splitSize`` in bytes."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool):
        from spanlake.sinks.bam import BamWriter

        return BamWriter(dict(self.options), overwrite)


class CramSource(DataSource):
    """Known by name, so that a table can be declared; reading needs a decoder that pure Python has none of."""

    @classmethod
    def name(cls) -> str:
        return "cram"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        raise NotImplementedError("CRAM can't be decoded here; convert it to BAM")


def samples(path: str) -> list[str]:
    """The samples of a path, from the names of its files alone."""
    return sorted({sample_of(p) for p in listed(path, (".bam",))})
