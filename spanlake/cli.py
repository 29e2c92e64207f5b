"""``python -m spanlake.cli feature-counts|depth-of-coverage|compare-pileups``: reports from files of reads, and of pileups."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanlake.converters import pileups
from spanlake.operators.intervals import feature_counts
from spanlake.session import Session
from spanlake.sinks.tables import write_report
from spanlake.sources.text import block_pileup, mpileup, spaced_pileup, targets

#: Formats of pileup files, and how each is read in the common form.
FORMATS = {
    "mpileup": lambda spark, path: pileups.maps_to_strings(pileups.from_mpileup(mpileup(spark, path))),
    "spaced": lambda spark, path: pileups.maps_to_strings(pileups.from_spaced_pileup(spaced_pileup(spark, path))),
    "blocks": lambda spark, path: pileups.blocks_to_bases(block_pileup(spark, path)),
}


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="spanlake")
    sub = p.add_subparsers(dest="what", required=True)
    counts = sub.add_parser("feature-counts", help="reads that overlap each target")
    counts.add_argument("-a", "--annotations", required=True, help="tab-separated: GeneID, Chr, Start, End, Strand")
    depth = sub.add_parser("depth-of-coverage", help="blocks of equal depth")
    for s in (counts, depth):
        s.add_argument("-r", "--reads", required=True)
        s.add_argument("-o", "--output", required=True)
    other = sub.add_parser("compare-pileups", help="which of several pileups are equal, two by two")
    other.add_argument("files", nargs="+", metavar="FORMAT:PATH", help=f"formats: {', '.join(FORMATS)}")
    a = p.parse_args(arguments)
    session = Session(SparkSession.builder.getOrCreate())
    if a.what == "compare-pileups":
        read = {f: FORMATS[f.partition(":")[0]](session.spark, f.partition(":")[2]) for f in a.files}
        for (x, y), equal in pileups.compare_all(read).items():
            print(f"{x} and {y}: {'equal' if equal else 'not equal'}")
        return
    reads = session.reads(a.reads)
    if a.what == "depth-of-coverage":
        write_report(session.coverage(reads), a.output, ["contig", "pos_start"])
        return
    t = targets(session.spark, a.annotations)
    t = t.select(F.col("GeneID").alias("GeneId"), F.regexp_replace("Chr", "^chr", "").alias("contig"), F.col("Start").cast("int").alias("pos_start"), F.col("End").cast("int").alias("pos_end"), F.col("Strand"))
    out = feature_counts(reads, t).select("GeneId", F.col("contig").alias("Chr"), F.col("pos_start").alias("Start"), F.col("pos_end").alias("End"), "Strand", F.col("length").alias("Length"), F.col("n_reads").alias("Counts"))
    write_report(out, a.output, ["GeneId"], single_file=True)  # a row for each target


if __name__ == "__main__":
    main()
