"""The library in a Spark session: SQL functions, data sources, and the table functions ``coverage`` and ``pileup``.

    from spanlake.session import Session
    s = Session(spark)
    s.sql("SELECT * FROM coverage('reads', 'NA12878', 'ref.fa')")

The table functions are put in as views of native plans, so filters and column selections around them reach the scan.
Settings of the session: ``spanlake.filterFlag``, ``spanlake.minMapQual``, ``spanlake.maxBaseQuality``; for overlap joins in
SQL ``spanlake.minOverlap``, ``spanlake.maxGap``, ``spanlake.useJoinOrder`` (the right side is broadcast) and
``spanlake.rangeJoin`` (``false`` leaves them to Spark); ``spanlake.allPositions`` puts uncovered stretches between blocks.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake import sources
from spanlake.functions import quality, ranges
from spanlake.operators.coverage import FILTER_FLAG, coverage, per_base, windows
from spanlake.operators.pileup import MAX_QUALITY, pileup
from spanlake.operators.sqljoin import planned
from spanlake.sources.bam import samples as bam_samples
from spanlake.sources.files import listed, sample_of

#: SQL functions are registered bare and under the prefix that existing queries use.
PREFIXES = ("", "bdg_")
_SKIPPED = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/"
_CALL = re.compile(rf"(?is)(?P<skipped>{_SKIPPED})|(?P<before>(?:\bFROM|\bJOIN|,)\s*)(?P<name>coverage|pileup)\s*\(\s*(?P<given>(?:'[^']*'|\"[^\"]*\"|[^()'\"])*)\)")
_LITERAL = re.compile(r"'[^']*'|\"[^\"]*\"|[^,\s]+")
#: How a setting says yes.
_TRUE = ("true", "1")


def register(spark: SparkSession, prefixes: tuple[str, ...] = PREFIXES) -> SparkSession:
    """Adds the functions and data sources to the session."""
    ranges.register(spark, prefixes)
    quality.register(spark)
    sources.register(spark)
    return spark


class Session:
    def __init__(self, spark: SparkSession, prefixes: tuple[str, ...] = PREFIXES):
        self.spark = register(spark, prefixes)

    def _setting(self, name: str, default: int) -> int:
        return int(self.spark.conf.get(f"spanlake.{name}", str(default)))

    def reads(self, source: DataFrame | str, sample: str | None = None) -> DataFrame:
        """A DataFrame, a table, or the path of BAM files; of one sample only, if given."""
        if isinstance(source, str):
            source = self.spark.read.format("bam").load(source) if source.endswith(".bam") else self.spark.table(source)
        return source if sample is None else source.where(F.col("sample_id") == sample)

    def samples(self, source: DataFrame | str) -> list[str]:
        """The samples of BAM files by their names alone, or of a table by its distinct values."""
        if isinstance(source, str) and (source.endswith(".bam") or "/" in source):
            return bam_samples(source)
        return sorted(r[0] for r in self.reads(source).select("sample_id").distinct().collect() if r[0] is not None)

    def files(self, source: DataFrame | str, sample: str | None = None) -> list[str]:
        """The files of a path of BAM files, or of a table or DataFrame that is read from files; of one sample only, if given."""
        if isinstance(source, str) and (source.endswith(".bam") or "/" in source):
            found = listed(source, (".bam",))
        else:
            found = sorted(self.reads(source).inputFiles())
        return [f for f in found if sample is None or sample_of(f) == sample or f"/sample_id={sample}/" in f]

    def location(self, table: str) -> str | None:
        """The folder of a table in the catalog, as it was declared; null for a view."""
        rows = self.spark.sql(f"DESCRIBE EXTENDED {table}").collect()
        return next((r.data_type for r in rows if r.col_name == "Location"), None)

    def reference(self, path: str | None) -> DataFrame | None:
        return None if not path else self.spark.read.format("fasta").load(path)

    def coverage(self, source: DataFrame | str, reference: str | None = None, sample: str | None = None) -> DataFrame:
        """Blocks of equal depth. ``reference`` is taken for the sake of the call: blocks say ``R`` for it."""
        reads, lengths = self.reads(source, sample), None
        if self.spark.conf.get("spanlake.allPositions", "false").lower() in _TRUE and reference:
            lengths = self.reference(reference).groupBy("contig").agg(F.max(F.col("chunk_start") + F.length("bases") - 1).alias("n_bases"))
        return coverage(reads, ("contig",), self._setting("filterFlag", FILTER_FLAG), self._setting("minMapQual", 0), lengths)

    def pileup(self, source: DataFrame | str, reference: str | None = None, quals: bool = True, sample: str | None = None, bin_size: int = 1) -> DataFrame:
        return pileup(self.reads(source, sample), self.reference(reference), quals, self._setting("filterFlag", FILTER_FLAG), self._setting("minMapQual", 0), bin_size, self._setting("maxBaseQuality", MAX_QUALITY))

    def _call(self, name: str, text: str) -> DataFrame:
        given = [a.strip("'\"") for a in _LITERAL.findall(text)]
        if name == "coverage":
            if len(given) not in (3, 4):
                raise ValueError(f"coverage takes a table, a sample, a reference and perhaps 'blocks', 'bases' or the length of windows; {len(given)} arguments given")
            blocks, form = self.coverage(given[0], given[2], given[1]), given[3].lower() if len(given) > 3 else "blocks"
            if form in ("blocks", "bases"):
                return blocks if form == "blocks" else per_base(blocks)
            return windows(blocks, int(form))
        if not 3 <= len(given) <= 6:
            raise ValueError(f"pileup takes a table, a sample, a reference and perhaps alts, quals and the size of bins; {len(given)} arguments given")
        on = [a.lower() == "true" for a in given[3:5]]
        quals = len(on) > 1 and on[1]
        df = self.pileup(given[0], given[2], quals, given[1], int(given[5]) if len(given) > 5 else 1)
        return df.select("contig", "pos_start", "pos_end", "ref", "coverage", "countRef", "countNonRef", *(["alts"] if not on or on[0] else []), *(["quals"] if quals else []))

    def sql(self, query: str) -> DataFrame:
        """``spark.sql`` that also knows the table functions ``coverage(table, sample, reference[, form])`` and
        ``pileup(table, sample, reference[, alts[, quals[, bin]]])``, and plans overlap joins on bins (``operators.sqljoin``).

        ``form`` is ``blocks``, ``bases`` or the length of windows. Literals, quoted names and comments are left as they
        are. An empty reference means none. But for the lengths that an overlap join has (two columns of each side), nothing
        runs before the result is asked for.
        """
        views: list[str] = []

        def put(m: re.Match) -> str:
            if m.group("skipped") is not None:
                return m.group()
            views.append(f"_spanlake_{uuid.uuid4().hex}")
            self._call(m.group("name").lower(), m.group("given")).createOrReplaceTempView(views[-1])
            return m.group("before") + views[-1]

        try:
            df = self.spark.sql(_CALL.sub(put, query))
        finally:
            for v in views:  # the result holds their plans
                self.spark.catalog.dropTempView(v)
        if self.spark.conf.get("spanlake.rangeJoin", "true").lower() not in _TRUE:
            return df
        return planned(df, self._setting("minOverlap", 1), self._setting("maxGap", 0), self.spark.conf.get("spanlake.useJoinOrder", "false").lower() in _TRUE)
