"""Pileup: depth in blocks, with a row of its own for each position where a read differs from the reference.

Mismatches come from the MD tag and their places from the CIGAR string, in Arrow batches, in the pass over the reads that
gives the changes of depth. They are counted per position and base before they are gathered, so a map holds at most
the letters of a sequence. Blocks are the blocks of the coverage, cut at the mismatch positions. Base qualities are looked
up only where there is a mismatch, by a binned join of the reads with these positions, which is a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.alignment import aligned_blocks, batch_blocks, batch_mismatches, indices_in_read, text_bytes
from spanlake.functions.contigs import plain_contig
from spanlake.functions.quality import alt_total
from spanlake.operators.coverage import FILTER_FLAG, depth_blocks, usable
from spanlake.operators.intervals import interval_join

MAX_QUALITY = 40
REVERSE = 16


#: What stands for a base that isn't one: the depth's own changes.
_DEPTH = 0


def _batch_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads to summed changes of depth and mismatches, a row for each contig, position and base of a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        contig = b.column("contig").dictionary_encode()
        code = contig.indices.to_numpy().astype(np.int64)
        row, s, e, index, counted = batch_blocks(b.column("pos_start").to_numpy().astype(np.int64), b.column("cigar").fill_null(""))
        at, k, ref = batch_mismatches(b.column("tag_md").fill_null(""))
        # the stretch of each mismatch: the last of its read that begins, as the tag counts, at or before it
        width = int(max(counted.max(initial=0), k.max(initial=0))) + 1
        j = np.searchsorted(row * width + counted, at * width + k, "right") - 1
        ok = (j >= 0) & (row[j] == at) & (k - counted[j] <= e[j] - s[j]) if len(row) else np.zeros(len(at), bool)
        at, k, ref, j = at[ok], k[ok], ref[ok], j[ok]
        letters, begin = text_bytes(b.column("seq").fill_null(""))
        i = index[j] + k - counted[j]
        ok = i < (begin[1:] - begin[:-1])[at]
        at, k, ref, j, i = at[ok], k[ok], ref[ok], j[ok], i[ok]
        base = letters[begin[at] + i] & 0xDF
        reverse = (b.column("flag").fill_null(0).to_numpy().astype(np.int64) & REVERSE) != 0
        base = np.where(reverse[at], base | 0x20, base).astype(np.int64)
        n_ends = len(row)
        p = np.concatenate([s, e + 1, s[j] + k - counted[j]])
        key = np.concatenate([code[row], code[row], code[at]]) << 40 | p << 8 | np.concatenate([np.full(2 * n_ends, _DEPTH), base])
        d = np.concatenate([np.ones(n_ends, np.int64), np.full(n_ends, -1), np.zeros(len(at), np.int64)])
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else np.zeros(0, np.int64)
        held = key[order][first]
        total = np.add.reduceat(d[order], first) if len(first) else first
        n = np.diff(np.append(first, len(key)))
        refs = np.concatenate([np.zeros(2 * n_ends, np.int64), ref.astype(np.int64)])[order]
        refs = np.maximum.reduceat(refs, first) if len(first) else first
        kept = (total != 0) | (held & 0xFF != _DEPTH)
        held, total, n, refs = held[kept], total[kept], n[kept], refs[kept]
        columns = [contig.dictionary.take(pa.array(held >> 40)), pa.array((held >> 8 & 0xFFFFFFFF).astype(np.int32)), pa.array((held & 0xFF).astype(np.int32)), pa.array(total), pa.array(n.astype(np.int64)), pa.array(refs.astype(np.int32))]
        yield pa.record_batch(columns, names=["contig", "p", "base", "d", "n", "ref"])


def _events(reads: DataFrame) -> DataFrame:
    """``contig`` (plain), ``p``, ``base``, ``d``, ``n``, ``ref``: summed changes of depth (base 0), and reads that differ, by the code of their base.

    One pass over the reads in Arrow batches, as array expressions over a whole batch: the same as functions over the
    arrays of each row takes Spark ten times as long. Each batch is summed before it is handed on. Sequences and tags
    are handed over only where the tag names a mismatch. Positions are those of the format, from 1 to 2^31 - 1.
    """
    differs = F.col("tag_md").rlike("(^|[0-9])[A-Za-z]") & F.col("seq").isNotNull()
    needed = reads.where(F.col("contig").isNotNull() & F.col("pos_start").isNotNull() & F.col("cigar").isNotNull()).select(
        plain_contig("contig").alias("contig"), F.col("pos_start").cast("int").alias("pos_start"), "cigar", "flag", F.when(differs, F.col("tag_md")).alias("tag_md"), F.when(differs, F.col("seq")).alias("seq"))
    events = needed.mapInArrow(_batch_events, "contig string, p int, base int, d bigint, n bigint, ref int")
    return events.groupBy("contig", "p", "base").agg(F.sum("d").alias("d"), F.sum("n").cast("int").alias("n"), F.max("ref").alias("ref"))


def mismatch_counts(reads: DataFrame) -> DataFrame:
    """``contig`` (plain), ``pos``, ``base`` (lower case on the reverse strand), ``ref``, ``n``."""
    return _events(reads).where(F.col("base") != _DEPTH).select("contig", F.col("p").alias("pos"), F.char("base").alias("base"), F.char("ref").alias("ref"), "n")


def with_reference(blocks: DataFrame, reference: DataFrame) -> DataFrame:
    """``blocks`` with ``ref``: the bases of ``reference`` (``contig``, ``chunk_start``, ``bases``) from their start to their end.

    Where the reference has nothing, ``ref`` is null. A block that spans chunks is put together in their order.
    """
    chunks = reference.select(F.col("contig").alias("_contig"), F.col("chunk_start").alias("_from"), (F.col("chunk_start") + F.length("bases") - 1).alias("_to"), "bases")
    cut = interval_join(blocks.select("contig", "pos_start", "pos_end"), chunks, [("contig", "_contig")], right_span=("_from", "_to"), measured=("right",))
    first = F.greatest(F.col("pos_start"), F.col("_from"))
    part = F.substring(F.col("bases"), first - F.col("_from") + 1, F.least(F.col("pos_end"), F.col("_to")) - first + 1)
    parts = cut.groupBy("contig", "pos_start", "pos_end").agg(F.array_sort(F.collect_list(F.struct(F.col("_from"), F.upper(part).alias("part")))).alias("_parts"))
    return blocks.drop("ref").join(parts.withColumn("ref", F.array_join(F.col("_parts.part"), "")).drop("_parts"), ["contig", "pos_start", "pos_end"], "left")


def pileup(reads: DataFrame, reference: DataFrame | None = None, quals: bool = False, filter_flag: int = FILTER_FLAG, min_mapq: int = 0, bin_size: int = 1, max_quality: int = MAX_QUALITY) -> DataFrame:
    """``contig``, ``pos_start``, ``pos_end``, ``ref``, ``coverage``, ``countRef``, ``countNonRef``, ``alts``, ``quals``.

    ``alts`` maps a base to its reads where some differ, else it is null, and so are ``quals``: base → counts by quality
    (by quality div ``bin_size``), of the length ``max_quality`` div ``bin_size`` + 1; higher qualities count as the
    highest. Without ``quals`` that column is null, without a reference ``ref`` is ``R`` (the mismatch's own base from the
    tag at such positions). Reads need ``contig``, ``pos_start``, ``pos_end``, ``cigar``, ``seq``, ``qual``, ``flag``,
    ``tag_md``; one without an MD tag only adds depth. Null bases or qualities are left out of ``quals``.
    """
    reads = usable(reads, filter_flag, min_mapq)
    events = _events(reads)
    differs = F.col("base") != _DEPTH
    kept = lambda c: F.when(differs, F.col(c))
    own = F.struct(F.col("p"), "d", differs.cast("int").alias("cut"), kept("base").alias("base"), kept("n").alias("n"), kept("ref").alias("ref"))
    nothing = F.lit(None).cast("int")
    after = F.struct((F.col("p") + 1).alias("p"), F.lit(0).cast("bigint").alias("d"), F.lit(1).alias("cut"), nothing.alias("base"), nothing.alias("n"), nothing.alias("ref"))
    changes = events.select("contig", F.explode(F.when(differs, F.array(own, after)).otherwise(F.array(own))).alias("_c")).select("contig", "_c.*")
    # a position where reads differ is a block of its own, so its bases go with the block that begins there
    held = {"_bases": F.sort_array(F.collect_list(F.when(F.col("base").isNotNull(), F.struct("base", "n")))), "_ref": F.max("ref")}
    rows = depth_blocks(changes, ["contig"], carry=held)
    rows = rows.withColumns({"alts": F.when(F.size("_bases") > 0, F.map_from_entries(F.transform("_bases", lambda x: F.struct(F.char(x["base"]).alias("key"), x["n"].alias("value"))))), "alt_ref": F.char("_ref")}).drop("_bases", "_ref")
    if reference is None:
        rows = rows.withColumn("ref", F.coalesce("alt_ref", F.lit("R")))
    else:
        rows = with_reference(rows, reference)
    if quals:
        points = events.where(differs).groupBy("contig", F.col("p").alias("pos")).agg(F.char(F.max("ref")).alias("alt_ref"))
        plain = reads.select(plain_contig("contig").alias("contig"), "pos_start", "pos_end", aligned_blocks("pos_start", "cigar").alias("_b"), "seq", "qual", "flag").dropna()
        at = interval_join(plain, points, right_span=("pos", "pos"), right_longest=1, bin_size=256).withColumn("_i", F.explode(indices_in_read(F.col("_b"), F.col("pos")))).withColumn("_i", F.col("_i") + 1)
        own = F.upper(F.substring(F.col("seq"), F.col("_i"), F.lit(1)))
        base = F.when((F.col("flag").bitwiseAND(REVERSE) != 0) & (own != F.col("alt_ref")), F.lower(own)).otherwise(own)
        q = F.ascii(F.substring(F.col("qual"), F.col("_i"), F.lit(1))) - 33
        at = at.where((F.col("_i") <= F.length("seq")) & (F.col("_i") <= F.length("qual"))).select("contig", "pos", base.alias("base"), q.alias("q"))
        size = max_quality // bin_size + 1
        level = F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor(F.col("q") / bin_size)))
        seen = at.groupBy("contig", "pos", "base", level.cast("int").alias("q")).agg(F.count(F.lit(1)).cast("int").alias("n"))
        held = seen.groupBy("contig", "pos", "base").agg(F.map_from_entries(F.collect_list(F.struct("q", "n"))).alias("m"))
        held = held.withColumn("a", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))))
        own = held.groupBy("contig", F.col("pos").alias("pos_start")).agg(F.map_from_entries(F.collect_list(F.struct("base", "a"))).alias("quals"))
        rows = rows.join(own, ["contig", "pos_start"], "left")
    else:
        rows = rows.withColumn("quals", F.lit(None).cast("map<string,array<int>>"))
    other = alt_total("alts")
    return rows.select("contig", "pos_start", "pos_end", "ref", "coverage", (F.col("coverage") - other).cast("int").alias("countRef"), other.cast("int").alias("countNonRef"), "alts", "quals")
