"""Pileup texts of other tools in one per-base form, and comparisons of two pileups.

The common form: ``contig``, ``pos_start``, ``pos_end``, ``ref``, ``coverage``, ``alts`` (base → count), ``quals`` (base →
quality character → count).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.contigs import plain_contig
from spanlake.functions.quality import altmap_to_str, qualsmap_to_str
from spanlake.operators.intervals import TILE_BITS

_INDEL = re.compile(r"[+-](\d+)")


def clean_marks(pileup: str) -> str:
    """Without read starts (``^`` and the character after it) and read ends (``$``)."""
    return re.sub(r"\^.|\$", "", pileup, flags=re.DOTALL)


def split_indels(pileup: str) -> tuple[str, list[int]]:
    """The letters of the position itself, and the lengths of the deletions that begin after it."""
    text, out, deleted, at = re.sub(r"\^.|\$", "", pileup, flags=re.DOTALL), [], [], 0
    for m in iter(lambda: _INDEL.search(text, at), None):
        out.append(text[at : m.start()])
        n = int(m.group(1))
        if m.group().startswith("-"):
            deleted.append(n)
        at = m.end() + n
    return "".join([*out, text[at:]]), deleted


def base_counts(letters: str) -> dict[str, int]:
    return dict(sorted((b, n) for b, n in Counter(letters).items() if b in "ACGTNacgtn"))


def _mpileup(case_sensitive: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for contig, pos, ref, cov, text, quality in zip(b.contig, b.pos, b.ref, b.coverage, b.pileup, b.quality, strict=True):
                letters, deleted = split_indels(text if case_sensitive else text.upper())
                alts, quals = base_counts(letters), None
                if alts:
                    counts: dict[str, Counter] = {}
                    for base, q in zip(letters, quality, strict=False):
                        if base != "*":
                            counts.setdefault(ref.upper() if base in ".," else base, Counter())[q] += 1
                    quals = {k: dict(v) for k, v in sorted(counts.items())}
                rows.append((contig, pos, ref.upper(), cov, alts or None, quals, deleted))
            yield pd.DataFrame(rows, columns=["contig", "pos", "ref", "coverage", "alts", "quals", "deleted"])

    return run


def from_mpileup(rows: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Rows of ``sources.text.mpileup`` in the common form.

    A deletion of n bases after a position takes its read off the depth of the n positions after it, wherever their rows
    are; positions without depth are left out. Rows with a null text are left out.
    """
    rows = rows.dropna(subset=["contig", "pos", "pileup", "quality"])
    parsed = rows.withColumn("contig", plain_contig("contig")).mapInPandas(_mpileup(case_sensitive), "contig string, pos int, ref string, coverage int, alts map<string,int>, quals map<string,map<string,int>>, deleted array<int>")
    gone = parsed.where(F.size("deleted") > 0).select("contig", "pos", F.explode("deleted").alias("n")).select("contig", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + F.col("n"))).alias("pos"))
    gone = gone.groupBy("contig", "pos").agg(F.count(F.lit(1)).cast("int").alias("gone"))
    depth = F.col("coverage") - F.coalesce("gone", F.lit(0))
    return parsed.join(gone, ["contig", "pos"], "left").withColumn("coverage", depth).where("coverage > 0").select("contig", F.col("pos").alias("pos_start"), F.col("pos").alias("pos_end"), "ref", "coverage", "alts", "quals")


def from_spaced_pileup(rows: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Rows of ``sources.text.spaced_pileup`` in the common form: the depth is the number of letters."""
    text = F.col("pileup") if case_sensitive else F.upper("pileup")
    letters = F.array(*map(F.lit, "ACGTNacgtn"))
    entries = F.filter(F.transform(letters, lambda b: F.struct(b.alias("key"), (F.length(text) - F.length(F.replace(text, b, F.lit("")))).alias("value"))), lambda x: x["value"] > 0)
    return rows.select(
        plain_contig("contig").alias("contig"), F.col("pos").alias("pos_start"), F.col("pos").alias("pos_end"), F.upper("ref").alias("ref"), F.length("pileup").alias("coverage"),
        F.when(F.size(entries) > 0, F.map_from_entries(entries)).alias("alts"), F.lit(None).cast("map<string,map<string,int>>").alias("quals"),
    )


def blocks_to_bases(blocks: DataFrame) -> DataFrame:
    """A row for each position of the blocks, with its own letter of ``ref`` (``R`` stays)."""
    at = F.posexplode(F.sequence("pos_start", "pos_end")).alias("_i", "_p")
    rest = [c for c in blocks.columns if c not in ("contig", "pos_start", "pos_end", "ref")]
    ref = F.when(F.col("ref") == "R", F.col("ref")).otherwise(F.substring(F.col("ref"), F.col("_i") + 1, F.lit(1)))
    return blocks.select("*", at).select("contig", F.col("_p").alias("pos_start"), F.col("_p").alias("pos_end"), ref.alias("ref"), *rest)


def bases_to_blocks(bases: DataFrame) -> DataFrame:
    """Successive positions of equal depth without differing bases as one block; others stay by themselves.

    Where a block starts is found within tiles of 65,536 positions, and over the tiles' ends, so that no task holds a
    whole contig's positions.
    """
    tiled = bases.withColumn("_tile", F.shiftright("pos_start", TILE_BITS)).withColumn("_plain", F.col("alts").isNull())
    order = Window.partitionBy("contig").orderBy("_tile")
    here = F.struct("pos_start", "coverage", "_plain")
    ends = tiled.groupBy("contig", "_tile").agg(F.max(here).alias("_end")).withColumn("_prior", F.lag("_end").over(order)).drop("_end")
    w = Window.partitionBy("contig", "_tile").orderBy("pos_start")
    before = F.coalesce(F.lag(here).over(w), F.col("_prior"))
    goes_on = (before["pos_start"] + 1 == F.col("pos_start")) & (before["coverage"] == F.col("coverage")) & F.col("_plain") & before["_plain"]
    marked = tiled.join(ends, ["contig", "_tile"]).withColumn("_begin", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("pos_start")))
    begun = marked.groupBy("contig", "_tile").agg(F.max("_begin").alias("_b")).withColumn("_carried", F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, -1))).drop("_b")
    run = F.coalesce(F.max("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried"))
    ref = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos_start", "ref"))), lambda x: x["ref"]), "")
    runs = marked.join(begun, ["contig", "_tile"]).withColumn("_run", run).groupBy("contig", "_run", "coverage")
    return runs.agg(F.max("pos_end").alias("e"), ref.alias("ref"), F.first("alts").alias("alts"), F.first("quals").alias("quals")).select("contig", F.col("_run").alias("pos_start"), F.col("e").alias("pos_end"), "ref", "coverage", "alts", "quals")


def maps_to_strings(common: DataFrame) -> DataFrame:
    return common.withColumns({"alts": altmap_to_str("alts"), "quals": qualsmap_to_str("quals")})


def compare(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that only one of two pileups has, each as often as it has more; both empty where they are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b), b.exceptAll(a)


def compare_all(pileups: dict[str, DataFrame]) -> dict[tuple[str, str], bool]:
    """For every two of them, whether they are equal."""
    names = list(pileups)
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    return {(x, y): all(d.isEmpty() for d in compare(pileups[x], pileups[y])) for x, y in pairs}
