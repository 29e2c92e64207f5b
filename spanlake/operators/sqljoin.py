"""Overlap joins written in plain SQL, or with DataFrame conditions, planned as ``intervals.interval_join`` plans them.

Spark joins on an overlap by comparing all rows, or all rows of a key. ``planned`` looks for inner joins in the query's own
optimized plan whose condition holds two comparisons, one with the left side the greater and one with the right (what any
test for an overlap comes to, casts and strict comparisons included), and replaces each by a join on bins with the whole
condition as a residual. Columns keep their identity, so what stands above in the plan doesn't change.

Which rows match is not changed by the bins: if ``a >= y`` and ``z >= b`` hold for left values a, b and right values y, z,
then the stretches between a and b and between y and z share a position, whichever of their ends is the greater, so they
share a bin. Only comparisons of whole numbers are taken. Which levels of bins each side has is asked for when the query
is planned, by a job over the two columns of a comparison: as a scalar within the plan it would repeat a side's tables
there, and Spark gives repeated tables other column identities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators.intervals import BIN, LEVELS, LONG_LEVELS, _Bins

_GREATER = {"GreaterThanOrEqual": False, "GreaterThan": False, "LessThanOrEqual": True, "LessThan": True}
_WHOLE = {"integer", "long", "short", "byte"}


class _Planner:
    def __init__(self, spark: SparkSession, min_overlap: int, max_gap: int, broadcast_right: bool):
        self.spark, self.jvm, self.session = spark, spark._jvm, spark._jsparkSession
        self.min_overlap, self.max_gap, self.broadcast_right, self.found = min_overlap, max_gap, broadcast_right, 0

    def frame(self, plan) -> DataFrame:
        return DataFrame(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.session, plan), self.spark)

    def column(self, expression) -> Column:
        return Column(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))

    def conjuncts(self, e) -> list:
        return self.conjuncts(e.left()) + self.conjuncts(e.right()) if e.nodeName() == "And" else [e]

    def rewritten(self, plan):
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        new = [self.rewritten(c) for c in children]
        if any(a is not b for a, b in zip(children, new, strict=True)):
            held = self.jvm.java.util.ArrayList()
            for c in new:
                held.add(c)
            plan = plan.withNewChildren(self.jvm.scala.jdk.javaapi.CollectionConverters.asScala(held).toSeq())
        if plan.nodeName() == "Join" and plan.joinType().toString() == "Inner" and plan.condition().isDefined():
            return self.joined(plan) or plan
        return plan

    def joined(self, join):
        """The plan of an overlap join, or nothing if the condition isn't one."""
        left, right = join.left(), join.right()
        of = lambda e, side: e.references().nonEmpty() and e.references().subsetOf(side.outputSet())
        over = {}  # which side is the greater: the greater and the lesser expression
        keys, rest = [], []
        for c in self.conjuncts(join.condition().get()):
            name = c.nodeName()
            if name in _GREATER and {c.left().dataType().typeName(), c.right().dataType().typeName()} <= _WHOLE:
                great, less = (c.right(), c.left()) if _GREATER[name] else (c.left(), c.right())
                side = "left" if of(great, left) and of(less, right) else "right" if of(great, right) and of(less, left) else None
                if side and side not in over:
                    over[side] = (great, less, c)
                    continue
            if name == "EqualTo" and ((of(c.left(), left) and of(c.right(), right)) or (of(c.left(), right) and of(c.right(), left))):
                keys.append((c.left(), c.right()) if of(c.left(), left) else (c.right(), c.left()))
            rest.append(c)
        if len(over) < 2:
            return None
        self.found += 1
        end1, start2, first = over["left"]
        end2, start1, second = over["right"]
        big = lambda e: self.column(e).cast("bigint")
        ends = lambda a, b, gap: {"low": F.least(a, b) - gap, "high": F.greatest(a, b) + gap}
        bins = _Bins(BIN, LONG_LEVELS if any(e.dataType().typeName() == "long" for e in (end1, start1, end2, start2)) else LEVELS)

        def side(plan, start, end, own_keys, n: int, gap: int) -> DataFrame:
            span = ends(big(start), big(end), gap)
            df = self.frame(plan).withColumns({f"_s{n}": big(start), f"_e{n}": big(end), f"_from{n}": span["low"], f"_to{n}": span["high"], f"_key{n}": F.xxhash64(*(self.column(k) for k in own_keys)) if own_keys else F.lit(0)})
            return df

        a = side(left, start1, end1, [k for k, _ in keys], 1, 0)
        b = side(right, start2, end2, [k for _, k in keys], 2, self.max_gap)
        levels1, levels2 = (bins.levels_of(bins.mask(df, F.col(f"_from{n}"), F.col(f"_to{n}")).first().mask) for n, df in ((1, a), (2, b)))
        a = bins.repeated(a, F.col("_from1"), F.col("_to1"), levels2, "_lv1", "_bin1").withColumn("_place1", F.xxhash64("_key1", "_bin1"))
        b = bins.repeated(b, F.col("_from2"), F.col("_to2"), levels1, "_lv2", "_bin2").withColumn("_place2", F.xxhash64("_key2", "_bin2"))
        met = (F.col("_place1") == F.col("_place2")) & (F.col("_bin1") == F.col("_bin2")) & (F.col("_bin1") == bins.key(F.greatest("_from1", "_from2"), F.greatest("_lv1", "_lv2")))
        if self.max_gap:
            met = met & (F.col("_e1") + self.max_gap >= F.col("_s2")) & (F.col("_e2") + self.max_gap >= F.col("_s1"))
        else:
            met = met & self.column(first) & self.column(second)
        if self.min_overlap > 1:
            met = met & (F.least("_e1", "_e2") - F.greatest("_s1", "_s2") + 1 >= self.min_overlap)
        out = a.join(F.broadcast(b) if self.broadcast_right else b, reduce(lambda x, y: x & y, map(self.column, rest), met))
        names = [join.output().apply(i) for i in range(join.output().size())]
        return out.select(*map(self.column, names))._jdf.queryExecution().analyzed()


def planned(df: DataFrame, min_overlap: int = 1, max_gap: int = 0, broadcast_right: bool = False) -> DataFrame:
    """``df`` with its overlap joins planned on bins; ``df`` itself if it has none.

    ``min_overlap`` and ``max_gap`` change what these joins mean: at least so many shared positions, or at most so far
    apart. With ``broadcast_right`` their right sides are broadcast. Needs the classic session, not Connect.
    """
    p = _Planner(df.sparkSession, min_overlap, max_gap, broadcast_right)
    plan = p.rewritten(df._jdf.queryExecution().optimizedPlan())
    return p.frame(plan) if p.found else df
