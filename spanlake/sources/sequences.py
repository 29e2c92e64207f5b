"""FASTQ reads and FASTA references as Spark data sources."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from spanlake.sources.files import SPLIT, Piece, exists, listed, opened, pieces, sample_of, size_of

FASTQ = "sample_id string, instrument_name string, run_id int, flowcell_id string, lane int, tile int, pos_x int, pos_y int, filter_passed boolean, control_num int, index_seq string, seq string, qual string"
_FASTQ = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in FASTQ.split(", "))])
FASTA = "contig string, chunk_start int, bases string"
_FASTA = pa.schema([("contig", pa.string()), ("chunk_start", pa.int32()), ("bases", pa.string())])
CHUNK = 10_000
#: Bases of an indexed contig that one task reads.
SPLIT_BASES = 32_000_000


def _number(s: str) -> int | None:
    return int(s) if s.isdigit() else None


def read_name(line: str) -> dict[str, object]:
    """The fields of a read's name as sequencers write it; null where the name has another form."""
    first, _, second = line.removeprefix("@").partition(" ")
    a, b = first.split(":"), second.split(":")
    out: dict[str, object] = {}
    if len(a) == 7:
        out = {"instrument_name": a[0], "run_id": _number(a[1]), "flowcell_id": a[2], "lane": _number(a[3]), "tile": _number(a[4]), "pos_x": _number(a[5]), "pos_y": _number(a[6])}
    if len(b) >= 4:
        out |= {"filter_passed": {"N": True, "Y": False}.get(b[1]), "control_num": _number(b[2]), "index_seq": b[3]}
    return out


class FastqReader(DataSourceReader):
    """A task reads the records that begin in its byte range: an ``@`` line whose next but one begins with ``+``."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.options = schema.fieldNames(), options
        self.samples: set[str] | None = None

    def pushFilters(self, filters):  # noqa: N802
        from pyspark.sql.datasource import EqualTo, In

        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("sample_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.samples = values if self.samples is None else self.samples & values
            yield f

    def partitions(self) -> list[Piece]:
        paths = listed(self.options["path"], (".fastq", ".fq"))
        return pieces([p for p in paths if self.samples is None or sample_of(p) in self.samples], int(self.options.get("splitSize", SPLIT)))

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where no file is left
            return
        sample, rows = sample_of(partition.path), []
        shape = pa.schema([_FASTQ.field(c) for c in self.columns])
        with opened(partition.path) as f:
            f.seek(partition.start)
            if partition.start:
                f.seek(partition.start - 1)
                f.readline()
                ahead = [(f.tell(), f.readline()) for _ in range(3)]
                while not (ahead[0][1].startswith(b"@") and ahead[2][1].startswith(b"+")):
                    if not ahead[0][1] or ahead[0][0] >= partition.end:
                        return
                    ahead = [*ahead[1:], (f.tell(), f.readline())]
                f.seek(ahead[0][0])
            while f.tell() < partition.end:
                line = f.readline()
                if not line:
                    break
                name = line.decode().rstrip("\r\n")
                if not name.strip():
                    continue
                seq, plus, qual = (f.readline().decode().rstrip("\r\n") for _ in range(3))
                if not name.startswith("@") or not plus.startswith("+") or len(qual) < len(seq):
                    raise ValueError(f"{partition.path}: no whole record before byte {f.tell()}: {name[:80]}")
                row = {"sample_id": sample, "seq": seq, "qual": qual} | read_name(name)
                rows.append({c: row.get(c) for c in self.columns})
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_pylist(rows, shape)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return FASTQ

    def reader(self, schema: StructType) -> FastqReader:
        return FastqReader(schema, dict(self.options))


class _Stretch(Piece):
    """Bases ``first`` to ``last`` (from 1) of one contig of an indexed file, and the byte of the first."""

    def __init__(self, path: str, name: str, first: int, last: int, offset: int):
        super().__init__(path, offset, offset)
        self.name, self.first, self.last = name, first, last


class FastaReader(DataSourceReader):
    """With an index beside it (``.fai``), a contig is cut into tasks of ``splitBases`` bases; without, each file is a task."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Piece]:
        out: list[Piece] = []
        size = max(1, int(self.options.get("splitBases", SPLIT_BASES)) // CHUNK) * CHUNK
        for p in listed(self.options["path"], (".fasta", ".fa")):
            if exists(p + ".fai"):
                with opened(p + ".fai") as f:
                    rows = [c for c in (line.split("\t") for line in f.read().decode().splitlines()) if len(c) >= 5]
                for name, length, offset, bases, width in ((c[0], *map(int, c[1:5])) for c in rows):
                    # every line but the last has the same number of bases, so the byte of any base is known
                    out += [_Stretch(p, name, at + 1, min(at + size, length), offset + at // bases * width + at % bases) for at in range(0, length, size)]
            else:
                out.append(Piece(p, 0, size_of(p)))
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where no file is left
            return
        bare = lambda n: "MT" if (b := n.split()[0].removeprefix("chr")) == "M" else b

        def batch(contig: str, start: int, bases: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"contig": contig, "chunk_start": start, "bases": bases.upper()}], _FASTA)

        with io.TextIOWrapper(opened(partition.path), encoding="ascii", newline="") as f:
            indexed = isinstance(partition, _Stretch)
            f.seek(partition.start)
            contig, held, at, left = (bare(partition.name), "", partition.first, partition.last) if indexed else (None, "", 1, None)
            for line in f:
                line = line.rstrip("\r\n")
                if line.startswith(">"):
                    if indexed:
                        break
                    if contig is not None and held:
                        yield batch(contig, at, held)
                    contig, held, at = bare(line[1:]), "", 1
                    continue
                held += line if left is None else line[: left - len(held) - at + 1]
                while len(held) >= CHUNK:
                    yield batch(contig, at, held[:CHUNK])
                    held, at = held[CHUNK:], at + CHUNK
                if left is not None and at - 1 + len(held) >= left:
                    break
            if contig is not None and held:
                yield batch(contig, at, held)


class FastaSource(DataSource):
    """``contig`` (plain), ``chunk_start`` (1-based), ``bases`` (upper case), in chunks of 10,000 bases."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return FASTA

    def reader(self, schema: StructType) -> FastaReader:
        return FastaReader(dict(self.options))
