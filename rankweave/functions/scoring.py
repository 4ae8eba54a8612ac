"""Score formulas and the rounding that makes ranks reproducible."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# Sums of doubles depend on the order of the terms; ranks are taken on scores rounded to this
# many digits, and the rounded score is what is returned.
BM25_DIGITS = 9
VECTOR_DIGITS = 6
RRF_DIGITS = 12
METRIC_DIGITS = 9


def rounded(score: Column, digits: int) -> Column:
    """Round halves away from zero, as SQL does, without a detour over decimals."""
    scale = F.lit(float(10 ** digits))
    return F.signum(score) * F.floor(F.abs(score) * scale + F.lit(0.5)) / scale


def rounded_array(scores: np.ndarray, digits: int) -> np.ndarray:
    """The same for the scores of an Arrow batch."""
    scale = float(10 ** digits)
    return np.sign(scores) * np.floor(np.abs(scores) * scale + 0.5) / scale


def idf(total_docs: Column, doc_freq: Column) -> Column:
    return F.log1p((total_docs - doc_freq + F.lit(0.5)) / (doc_freq + F.lit(0.5)))


def bm25_weight(idf_: Column, tf: Column, length: Column, avgdl: Column,
                k1: Column | float, b: Column | float) -> Column:
    """The part of a document's score that one query term gives."""
    k1 = k1 if isinstance(k1, Column) else F.lit(float(k1))
    b = b if isinstance(b, Column) else F.lit(float(b))
    relative = F.coalesce(F.try_divide(length.cast("double"), avgdl), F.lit(0.0))
    saturation = tf + k1 * (F.lit(1.0) - b + b * relative)
    return idf_ * (tf * (k1 + F.lit(1.0))) / saturation
