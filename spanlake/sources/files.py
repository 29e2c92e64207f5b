"""Files of a path or glob on any file system that Arrow knows, and their byte ranges.

A plain path or ``file:`` is local; ``hdfs:``, ``s3:``, ``gs:`` and the like go through ``pyarrow.fs``, on the driver for
listing and on the workers for reading and writing.
"""

from __future__ import annotations

import fnmatch
import os
import re
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

SPLIT = 128 << 20
_SCHEME = re.compile(r"^([a-z][a-z0-9+.-]*):/")


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Piece(InputPartition):
    """A byte range of a file: records that begin in it are the partition's."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


@dataclass(frozen=True)
class Place:
    """A path with its file system."""

    system: fs.FileSystem
    path: str
    #: What stands before the path in its full name.
    prefix: str = ""

    @classmethod
    def of(cls, path: str) -> Place:
        if (m := _SCHEME.match(path)) is None or m.group(1) == "file":
            return cls(fs.LocalFileSystem(), plain(path))
        # a glob is no valid URI, so the system is asked for with the part before it
        head = re.split(r"[*?\[]", path)[0]
        system, own = _system(head)
        prefix = head[: len(head) - len(own)] if head.endswith(own) else m.group(0) + "/"
        return cls(system, own + path[len(head) :], prefix)

    def name(self, path: str) -> str:
        return self.prefix + path


def plain(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def opened(path: str) -> BinaryIO:
    """The file for reading at any place."""
    if _SCHEME.match(plain(path)) is None:
        return open(plain(path), "rb")  # noqa: SIM115
    p = Place.of(path)
    return p.system.open_input_file(p.path)


def created(path: str) -> BinaryIO:
    p = Place.of(path)
    return p.system.open_output_stream(p.path)


def exists(path: str) -> bool:
    p = Place.of(path)
    return p.system.get_file_info(p.path).type == fs.FileType.File


def size_of(path: str) -> int:
    p = Place.of(path)
    return p.system.get_file_info(p.path).size


def listed(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The files of a path: itself, those of a folder by their endings, or those of a glob."""
    p = Place.of(path)
    if not re.search(r"[*?\[]", p.path):
        info = p.system.get_file_info(p.path)
        if info.type == fs.FileType.Directory:
            found = p.system.get_file_info(fs.FileSelector(p.path))
            return sorted(p.name(f.path) for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffixes))
        if info.type == fs.FileType.File:
            return [p.name(p.path)]
        raise FileNotFoundError(path)
    base = re.split(r"[*?\[]", p.path)[0].rpartition("/")[0] or ("/" if p.path.startswith("/") else ".")
    depth = p.path.count("/")
    files = p.system.get_file_info(fs.FileSelector(base, recursive=p.path[len(base) :].count("/") > 1, allow_not_found=True))
    clean = (f.path.removeprefix("./") for f in files if f.type == fs.FileType.File)
    found = sorted(p.name(f) for f in clean if f.count("/") == depth and fnmatch.fnmatchcase(f, p.path))
    if not found:
        raise FileNotFoundError(path)
    return found


def sample_of(path: str) -> str:
    """A file's sample: its name up to the first dot."""
    return os.path.basename(path).split(".")[0]


def pieces(paths: list[str], split: int = SPLIT) -> list[Piece]:
    return [Piece(p, at, min(at + split, size)) for p in paths for size in [size_of(p)] for at in range(0, max(size, 1), split)]
