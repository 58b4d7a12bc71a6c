"""Approximate quantiles that merge: KLL sketches kept per group and run.

The reports' quantiles are exact by default; where runs are kept apart and many, or values have too many
distinct ones to be folded, a sketch of fixed size stands for a group's values. Sketches of
several groups or runs merge to that of all their rows, so a report over any of them reads sketches only.

The error is one of rank: a sketched p-quantile lies between the exact quantiles of p - error and
p + error. The size follows from it; the published bound (99 of 100 times) is kept at half the error.
Null values are left out; a group without values has no sketch. Which values a sketch keeps is drawn at
random, so reruns may differ within the error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR = 0.01


def size_for(error: float) -> int:
    """The sketch's k: 2.296 / k ** 0.9021, the published bound of the rank error, is at most half of ``error``."""
    k = math.ceil((2 * 2.296 / error) ** (1 / 0.9021)) if 0 < error < 1 else None
    if k is None or k > 65_535:
        raise ValueError("a sketch's error lies between about 0.0003 and 1")
    return max(8, k)


def sketches(rows: DataFrame, value: str, by: Sequence[str] = (), error: float = ERROR) -> DataFrame:
    """by..., ``sketch`` and ``n``: one sketch of ``value`` per group; partial sketches combine map-side."""
    known = rows.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    return known.groupBy(*by).agg(F.kll_sketch_agg_double("_v", size_for(error)).alias("sketch"), F.count("*").alias("n"))


def merged_sketches(kept: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of several runs or finer groups as one per group."""
    return kept.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def sketched_quantiles(kept: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``kept`` with ``q``, the quantiles as an array of doubles, in place of the sketch."""
    asked = F.array(*(F.lit(float(p)) for p in probs))
    return kept.withColumn("q", F.kll_sketch_get_quantile_double("sketch", asked)).drop("sketch")
