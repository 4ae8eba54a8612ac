"""Ranks within groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

# More candidate rows than this for one group are cut in two steps.
GROUP_ROWS = 1_000_000


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | None,
          rank_col: str = "rank", pieces: int = 1) -> DataFrame:
    """The first `k` rows per group with their rank, counted from 1.

    The limit on `row_number` lets Spark cut each group to `k` rows inside every map task, so a
    group of any size sends at most `k` rows per task to the shuffle. With `pieces`, the number of
    tasks the rows come from, so high that even these are many, or with a `k` above Spark's
    threshold for the cut, a group is first cut in parts and then as a whole.
    """
    if k is not None and k < 0:
        raise ValueError("k must be non-negative")
    if k == 0:
        return df.withColumn(rank_col, F.lit(0)).filter(F.lit(False))
    if k is None:
        return _numbered(df, keys, order, rank_col)
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > threshold:
        pieces = max(pieces, 4096)
    if k > threshold or k * pieces > GROUP_ROWS:
        others = [c for c in df.columns if c not in keys]
        salt = F.pmod(F.xxhash64(*others), F.lit(math.isqrt(pieces) + 1))
        parts = _numbered(df.withColumn("_salt", salt), [*keys, "_salt"], order, rank_col)
        df = parts.filter(F.col(rank_col) <= k).drop("_salt", rank_col)
    return _numbered(df, keys, order, rank_col).filter(F.col(rank_col) <= k)


def _numbered(df: DataFrame, keys: list[str], order: list[Column], rank_col: str) -> DataFrame:
    return df.withColumn(
        rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def by_score(tie: str = "doc_id") -> list[Column]:
    return [F.col("score").desc(), F.col(tie).asc()]
