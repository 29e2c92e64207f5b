"""What CIGAR strings and MD tags say about a read."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = re.compile(r"(\d+)([MIDNSHP=X])")
_MD = re.compile(r"(\d+)|\^([A-Za-z]+)|([A-Za-z])")


_BLOCK = "array<struct<s:int,e:int,i:int,m:int>>"


def aligned_blocks(start: Column | str, cigar: Column | str) -> Column:
    """Array of ``s``, ``e``, ``i``, ``m``: the stretches of the reference a read is aligned to (M, = and X), where in the
    read's sequence (from 0) each begins, and how many aligned and deleted bases are before it, as MD tags count.

    D and N move on along the reference without a block, I and S along the read; H and P don't move. A null or ``*``
    CIGAR, or one without such a stretch, gives an empty array.
    """
    start, cigar = (F.col(x) if isinstance(x, str) else x for x in (start, cigar))
    lengths = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), 1), lambda x: x.cast("int"))
    ops = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), 1)
    zero = F.struct(start.cast("int").alias("p"), F.lit(0).alias("i"), F.lit(0).alias("m"), F.array().cast(_BLOCK).alias("b"))

    def step(acc: Column, x: Column) -> Column:
        aligned, moved = x["op"].isin("M", "=", "X"), acc["p"] + x["n"]
        own = F.array(F.struct(acc["p"].alias("s"), (moved - 1).cast("int").alias("e"), acc["i"].alias("i"), acc["m"].alias("m")))
        on = F.when(aligned | x["op"].isin("N", "D"), moved).otherwise(acc["p"])
        read = F.when(aligned | x["op"].isin("I", "S"), acc["i"] + x["n"]).otherwise(acc["i"])
        counted = F.when(aligned | (x["op"] == "D"), acc["m"] + x["n"]).otherwise(acc["m"])
        return F.struct(on.cast("int").alias("p"), read.cast("int").alias("i"), counted.cast("int").alias("m"), F.when(aligned, F.concat(acc["b"], own)).otherwise(acc["b"]).alias("b"))

    folded = F.aggregate(F.arrays_zip(lengths.alias("n"), ops.alias("op")), zero, step, lambda acc: acc["b"])
    simple = one_block(cigar)
    one = F.array(F.struct(start.cast("int").alias("s"), (start + simple - 1).cast("int").alias("e"), F.lit(0).alias("i"), F.lit(0).alias("m")))
    return F.when(cigar.isNull(), F.array().cast(_BLOCK)).when(simple.isNotNull(), one).otherwise(folded)


def one_block(cigar: Column) -> Column:
    """The length of a CIGAR that is one aligned stretch, else null."""
    return F.when(F.right(cigar, F.lit(1)).isin("M", "=", "X") & F.ascii(cigar).between(48, 57), F.left(cigar, F.length(cigar) - 1).try_cast("int"))


def indices_in_read(blocks: Column, position: Column) -> Column:
    """Array of where in the read (from 0) a reference position stands, by its ``aligned_blocks``: one index, or none in a
    deletion, a skip or outside."""
    at = F.filter(blocks, lambda b: (b["s"] <= position) & (b["e"] >= position))
    all_of = F.transform(at, lambda b: b["i"] + position - b["s"])
    # most reads are one stretch, which needs no function over an array
    only = F.get(blocks, F.lit(0))
    one = F.when((only["s"] <= position) & (only["e"] >= position), F.array(only["i"] + position - only["s"])).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(blocks) == 1, one).otherwise(all_of)


def cigar_ops(cigar: str | None) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in _OPS.findall(cigar or "")]


def md_ops(md: str | None) -> list[tuple[str, int, str]]:
    """``("=", n, "")`` for n equal bases, ``("X", 1, base)`` for a mismatch, ``("D", n, bases)`` for a deletion."""
    out = []
    for same, deleted, base in _MD.findall(md or ""):
        if same:
            if int(same):
                out.append(("=", int(same), ""))
        elif deleted:
            out.append(("D", len(deleted), deleted))
        else:
            out.append(("X", 1, base))
    return out


def read_index(start: int, cigar: str, position: int) -> int | None:
    """Where in the read's sequence the base at a reference position stands; null in a deletion, a skip or outside."""
    at, index = start, 0
    for n, op in cigar_ops(cigar):
        if op in "M=X":
            if at <= position < at + n:
                return index + position - at
            at, index = at + n, index + n
        elif op in "DN":
            if at <= position < at + n:
                return None
            at += n
        elif op in "IS":
            index += n
    return None


def mismatches(start: int, cigar: str, md: str, seq: str, reverse: bool) -> list[tuple[int, str, str]]:
    """Position, the read's base (lower case on the reverse strand) and the reference's base of each mismatch of an MD tag."""
    # an MD tag counts aligned and deleted bases of the reference, skips apart: (first count, after it, position, index in the read)
    spans, at, index, n_md = [], start, 0, 0
    for n, op in cigar_ops(cigar):
        if op in "M=X":
            spans.append((n_md, n_md + n, at, index))
            at, index, n_md = at + n, index + n, n_md + n
        elif op == "D":
            at, n_md = at + n, n_md + n
        elif op == "N":
            at += n
        elif op in "IS":
            index += n
    out, k, span = [], 0, 0
    for op, n, base in md_ops(md):
        if op == "X":
            while span < len(spans) and spans[span][1] <= k:
                span += 1
            if span == len(spans):
                break
            first, _, position, i = spans[span]
            i += k - first
            if k >= first and i < len(seq):
                out.append((position + k - first, seq[i].lower() if reverse else seq[i].upper(), base.upper()))
        k += n
    return out


# the same for whole batches, without a loop over reads ----------------------------------------------------------------


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column, and where each text begins in them, with the end; a null is empty."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row of each byte, whether it is a digit, and two running sums before each byte: of the numbers, of the letters."""
    data, at = text_bytes(texts)
    data, at = data[at[0] : at[-1]], at - at[0]
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    digit = (data >= 48) & (data <= 57)
    # a digit's place is the distance to the end of its number, which is the next byte that is none, or the row's end
    place = np.arange(len(data))
    stop = np.where(digit, len(data), place)
    stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1] if len(stop) else stop, at[row + 1])
    value = np.where(digit, (data.astype(np.int64) - 48) * 10 ** np.clip(stop - place - 1, 0, 17), 0)
    letter = ~digit & (data != ord("^"))
    before = lambda x: np.append(0, np.cumsum(x))
    return data, row, digit, before(value), before(letter)


def batch_blocks(start: np.ndarray, cigar: pa.Array) -> tuple[np.ndarray, ...]:
    """The aligned stretches of a batch: row, first and last position, index in the read, aligned and deleted bases before (as ``aligned_blocks``)."""
    data, row, digit, value, _ = _tokens(cigar)
    op = np.flatnonzero(~digit)
    code, own = data[op], row[op]
    first = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
    n = value[op] - np.where(first, value[np.searchsorted(row, own)] if len(own) else 0, np.append(0, value[op[:-1]]) if len(op) else 0)
    is_in = lambda letters: np.isin(code, np.frombuffer(letters, np.uint8))

    def until(moves: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(np.where(moves, n, 0)))
        return total[:-1] - total[np.searchsorted(own, own)] if len(own) else total[:0]

    aligned = is_in(b"M=X")
    here, index, counted = until(aligned | is_in(b"ND")), until(aligned | is_in(b"IS")), until(aligned | is_in(b"D"))
    k = np.flatnonzero(aligned & (n > 0))
    s = start[own[k]] + here[k]
    return own[k], s, s + n[k] - 1, index[k], counted[k]


def batch_mismatches(md: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mismatches of a batch of MD tags: row, aligned and deleted bases before, code of the reference's base (upper case)."""
    data, row, digit, value, letters = _tokens(md)
    place = np.arange(len(data))
    alpha = ~digit & (data != ord("^"))
    # a letter is a deleted base if what stands before its run of letters is a caret
    mark = np.maximum.accumulate(np.where(alpha, -1, place)) if len(data) else place
    deleted = alpha & (mark >= 0) & (data[mark] == ord("^")) & (row[mark] == row) if len(data) else alpha
    k = np.flatnonzero(alpha & ~deleted)
    begin = np.searchsorted(row, row[k])
    return row[k], value[k] - value[begin] + letters[k] - letters[begin], data[k] & 0xDF
