"""Places in an order, without a window over a whole scope.

Rows are dealt out by ranges of the scope and the order, so that a scope of very many rows lies in
many partitions. Each partition counts its rows of each scope, the counts of the partitions before
give its offset, and a row's place is its offset and its place in the partition. The window that
adds up the counts has a row for each partition of a scope, not for each row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasswing.operators.tables import materialised


def numbered(rows: DataFrame, scope: list[str], order: list[Column | str], name: str = "place", total: str | None = None, descending: list[bool] | None = None, ranges: int | None = None) -> DataFrame:
    """All columns of ``rows`` and each row's place from 0 in the order of its scope, ``total`` the scope's rows.

    Nulls come first, last where descending; null scopes are one scope. Rows that the order doesn't
    tell apart have different places, in no stated order. Columns named ``name`` or ``total`` are
    replaced; no other name matters. The sorted rows are written once, as the bounds of ranges
    differ from one evaluation to the next.
    """
    kept = [c for c in rows.columns if c not in (name, total)]
    s, o = [f"s{i}" for i in range(len(scope))], [f"o{i}" for i in range(len(order))]
    keys = [F.col(c).alias(k) for c, k in zip(scope, s, strict=True)]
    keys += [(F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(order, o, strict=True)]
    by = [F.col(k) for k in s] + [F.desc(k) if down else F.asc(k) for k, down in zip(o, descending or [False] * len(o), strict=True)]
    dealt = rows.select(F.struct(*kept).alias("row"), *keys)
    dealt = dealt.repartitionByRange(ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    dealt = materialised(dealt.select("row", *s, F.monotonically_increasing_id().alias("m")), "places").withColumn("part", F.shiftright("m", 33))
    counts = dealt.groupBy("part", *s).agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy(*(s or [F.lit(0)]))
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", *s, (before - F.col("first")).alias("shift"), F.sum("n").over(of).alias("whole"))
    same = reduce(Column.__and__, [dealt[k].eqNullSafe(offsets[k]) for k in s], dealt["part"] == offsets["part"])
    extra = [(dealt["m"] + offsets["shift"]).alias(name)] + ([offsets["whole"].alias(total)] if total else [])
    return dealt.join(offsets, same).select(*[dealt["row"][c].alias(c) for c in kept], *extra)


def around(rows: DataFrame, scope: list[str], order: list[Column | str], key: str, descending: list[bool] | None = None) -> DataFrame:
    """Each row with the ``key`` of the one before and after it in its scope, around the ends.

    Rows meet by the number of their neighbour's place, so no task holds a scope.
    """
    n = numbered(rows.select(F.struct("*").alias("row"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(scope)], *[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)]), [f"s{i}" for i in range(len(scope))], [f"o{i}" for i in range(len(order))], "place", "total", descending)
    s = [f"s{i}" for i in range(len(scope))]

    def beside(step: int, name: str) -> DataFrame:
        at = F.pmod(F.col("place") + step, F.col("total")).alias(f"at_{name}")
        return n.select(*[F.col(k).alias(f"{k}_{name}") for k in s], at, F.col("row")[key].alias(name))

    out = n
    for step, name in ((1, "previous"), (-1, "next")):
        other = beside(step, name)
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_{name}")) for k in s], F.col("place") == F.col(f"at_{name}"))
        out = out.join(other, same)
    return out.select(*[F.col("row")[c].alias(c) for c in rows.columns if c not in ("previous", "next")], "previous", "next")


def places(rows: DataFrame, scope: list[str], order: list[Column | str], first: int, last: int, descending: list[bool] | None = None) -> DataFrame:
    """Rows of each scope from one place of its order to another, in either direction, from 0."""
    low, high = sorted((first, last))
    out = numbered(rows.select(F.struct("*").alias("row"), *scope, *[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)]), scope, [f"o{i}" for i in range(len(order))], "place", None, descending)
    return out.where(F.col("place").between(low, high)).select(*[F.col("row")[c].alias(c) for c in rows.columns])
