"""BAM files from rows with the columns of an aligned read."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from spanlake.functions.alignment import cigar_ops
from spanlake.sources.bam import _CIGAR, _SEQ, INTEGER_TAGS
from spanlake.sources.files import Place, created

END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_BLOCK = 65_000
#: Operations that a record's own count can say.
_MOST_OPS = 65_535
#: The code of each letter (N for one that the format hasn't), and the quality of each character.
_CODES = bytes(_SEQ.index(c) if (c := chr(b).upper()) in _SEQ else _SEQ.index("N") for b in range(256))
_LEVELS = bytes(max(b - 33, 0) for b in range(256))


def _compressed(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _record(row: dict, ids: dict[str, int]) -> bytes:
    name = (row.get("qname") or "*").encode() + b"\0"
    ops = cigar_ops(row.get("cigar"))
    seq = "" if row.get("seq") in (None, "*") else row["seq"]
    qual = row.get("qual")
    start = (row.get("pos_start") or 0) - 1
    end = start + max(1, sum(n for n, op in ops if op in "MDN=X"))
    level = next(((shift, (1 << (29 - shift)) // 7) for shift in (14, 17, 20, 23, 26) if start >> shift == (end - 1) >> shift), None)
    bin_ = level[1] + (start >> level[0]) if level else 0
    mate = row.get("rnext") or "*"
    ref = ids.get(row.get("contig") or "", -1)
    padded = seq + "=" * (len(seq) % 2)
    codes = np.frombuffer(padded.encode("ascii").translate(_CODES), np.uint8)
    bases = (codes[::2] << 4 | codes[1::2]).tobytes()
    quals = qual.encode("latin-1").translate(_LEVELS) if qual and qual != "*" and len(qual) == len(seq) else b"\xff" * len(seq)
    tags = b""
    for column, v in row.items():
        if column.startswith("tag_") and v is not None:
            tag = column[4:].encode()
            tags += tag + (b"i" + struct.pack("<i", v) if column[4:] in INTEGER_TAGS else b"Z" + str(v).encode() + b"\0")
    coded = [n << 4 | _CIGAR.index(op) for n, op in ops]
    if len(coded) > _MOST_OPS:  # they go into a tag, and two operations of the same lengths stand for them
        tags += b"CGBI" + struct.pack(f"<i{len(coded)}I", len(coded), *coded)
        coded = [len(seq) << 4 | 4, (end - start) << 4 | 3]
    head = struct.pack("<iiBBHHHiiii", ref, start, len(name), row.get("mapq") if row.get("mapq") is not None else 255, bin_ & 0xFFFF, len(coded), row.get("flag") or 0, len(seq), ref if mate == "=" else ids.get(mate, -1), (row.get("pnext") or 0) - 1, row.get("tlen") or 0)
    data = head + name + struct.pack(f"<{len(coded)}I", *coded) + bases + quals + tags
    return struct.pack("<i", len(data)) + data


def write_file(path: str, rows: Iterable[dict], contigs: dict[str, int]) -> int:
    """One BAM file; ``contigs`` gives each name's length, in the order of the header. Returns the number of rows."""
    ids = {c: i for i, c in enumerate(contigs)}
    text = "@HD\tVN:1.6\tSO:unknown\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs.items())
    held = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    held += b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs.items())
    count = 0
    held = bytearray(held)
    with created(path) as f:
        for row in rows:
            held += _record(row, ids)
            count += 1
            if len(held) >= _BLOCK:
                whole = len(held) // _BLOCK * _BLOCK
                for at in range(0, whole, _BLOCK):
                    f.write(_compressed(bytes(held[at : at + _BLOCK])))
                del held[:whole]
        f.write(_compressed(bytes(held)) + END)
    return count


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class BamWriter(DataSourceWriter):
    """``df.write.format("bam").option("contigs", "1:1000,2:500").save(folder)``: a file for each task, named at the commit.

    The folder may be on any file system that ``sources.files`` knows. With the option ``sample`` the files' names begin
    with it, so that they are read back as that sample's.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.contigs = {c: int(n) for c, n in (p.rsplit(":", 1) for p in options["contigs"].split(","))}
        self.sample = options.get("sample")

    def write(self, rows: Iterator) -> _Written:
        place = Place.of(self.folder)
        place.system.create_dir(place.path, recursive=True)
        name = f".part-{uuid.uuid4().hex}"
        write_file(f"{self.folder}/{name}", (r.asDict() for r in rows), self.contigs)
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        place = Place.of(self.folder)
        old = [f.path for f in place.system.get_file_info(fs.FileSelector(place.path, allow_not_found=True)) if f.base_name.endswith(".bam")] if self.overwrite else []
        for m in messages:
            if m is not None:
                final = f"{self.sample}.{m.name[1:]}" if self.sample else m.name[1:]
                place.system.move(f"{place.path}/{m.name}", f"{place.path}/{final}.bam")
        for p in old:
            place.system.delete_file(p)

    def abort(self, messages: list[_Written | None]) -> None:
        place = Place.of(self.folder)
        for m in messages:
            if m is not None and place.system.get_file_info(f"{place.path}/{m.name}").type == fs.FileType.File:
                place.system.delete_file(f"{place.path}/{m.name}")
