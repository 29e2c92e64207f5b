"""Contig names: one spelling for joins and groupings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_contig(c: Column | str) -> Column:
    """Leading ``chr`` (lower case only) removed, then ``M`` written ``MT``. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    # no regular expression: this stands in the hot path of every scan
    return F.when(c.isin("M", "chrM"), F.lit("MT")).when(c.startswith("chr"), F.substring(c, 4, 1 << 30)).otherwise(c)


def chr_contig(c: Column | str) -> Column:
    """The inverse spelling: ``MT`` becomes ``chrM``, any other name gets the prefix once. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin("MT", "M"), F.lit("chrM")).when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))
