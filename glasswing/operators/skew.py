"""Joins in which a few keys hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a sketch follows, and the share of rows from which a key is heavy.
FOLLOWED, SHARE = 1_000, 0.005


def heavy(rows: DataFrame, key: str, share: float = SHARE) -> list:
    """The keys that may hold more than ``share`` of the rows, by a sketch of frequent items in one pass.

    The sketch is merged from all partitions and of a fixed size, so at most ``FOLLOWED`` keys come to
    the driver. It never misses a key above the share, as long as that is well above 1 / ``FOLLOWED``;
    a key that it adds wrongly costs a few copies of the other side's row, and no result.
    """
    if not 4 / FOLLOWED <= share <= 1:
        raise ValueError("the sketch can't tell so small a share")
    found = rows.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {FOLLOWED // 2}, {FOLLOWED})").alias("top"), F.count(F.lit(1)).alias("n")).head()
    return [x["item"] for x in found["top"] or [] if x["count"] > share * found["n"]]


def join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = SHARE, salts: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, rows of heavy keys of ``left`` spread over ``salts`` parts.

    Only the right rows of heavy keys are repeated, ``salts`` times; all others are shuffled as in
    a plain join. The salt is a hash of the left row, so a task that runs again deals out the
    same. ``how``: inner, left, left_semi or left_anti. Null keys match nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no {how} join of a spread left side")
    keys = heavy(left, key, share)
    if not keys:
        return left.join(right, key, how)
    n = salts or 2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_heavy = F.coalesce(F.col(key).isin(keys), F.lit(False))
    salt = F.when(is_heavy | F.col(key).isNull(), F.pmod(F.hash(*[c for c in left.columns if c != key], F.monotonically_increasing_id()), F.lit(n))).otherwise(0)
    spread = F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))))
    a = left.select(F.struct("*").alias("l"), F.col(key).alias("k"), salt.cast("int").alias("z"))
    b = right.select(F.struct(*[c for c in right.columns if c != key] or [F.lit(None).alias("none")]).alias("r"), F.col(key).alias("k"), spread.alias("z"))
    out = a.join(b, ["k", "z"], how)
    rest = [] if how in ("left_semi", "left_anti") else [F.col("r")[c].alias(c) for c in right.columns if c != key]
    return out.select(F.col("k").alias(key), *[F.col("l")[c].alias(c) for c in left.columns if c != key], *rest)


def repeated(files: DataFrame, content: str = "hash", share: float = SHARE) -> DataFrame:
    """Rows whose content occurs more than once, with ``copies``, however many rows one content has.

    Counts are aggregated before their shuffle; the rows come to them by a join that spreads heavy contents.
    """
    often = files.where(F.col(content).isNotNull()).groupBy(content).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return join(files.where(F.col(content).isNotNull()), often, content, share=share).select(*files.columns, "copies")

