"""Exact quantiles with linear interpolation, and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_weights(
    df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Non-null values folded to (by..., value, _n).

    ``weight`` names the count column of rows that stand for several.
    """
    known = df.where(F.col(value).isNotNull())
    n = F.sum(weight) if weight else F.count("*")
    return known.groupBy(*by, value).agg(n.alias("_n"))


def weighted_quantiles(value: str, probs: Sequence[float], weight: str = "_n") -> Column:
    """Aggregate: exact quantiles of folded values, as an array of doubles."""
    array = F.array(*(F.lit(float(p)) for p in probs))
    return F.percentile(F.col(value), array, F.col(weight))


def bounded_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """One row per group with ``q``, the quantiles as an array of doubles.

    For values from a small range, such as the length of a capped text: what
    reaches the exact percentile is at most one row per distinct value.
    """
    folded = value_weights(df, value, by, weight)
    return folded.groupBy(*by).agg(weighted_quantiles(value, probs).alias("q"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    steps: int = 10,
    weight: str | None = None,
) -> DataFrame:
    """Like ``bounded_quantiles``, for values with any number of distinct ones.

    Approximate edges cut the distinct values into even buckets. Counts per
    bucket then tell which bucket holds each wanted rank. Only those buckets go on:
    each is cut into equal widths, counted again, and of the pieces only those with a
    wanted rank are put in order, one piece per window. Edges and widths decide how
    even the work is, never the result.
    """
    by = list(by)
    values = (
        df.where(F.col(value).isNotNull())
        .select(*by, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).alias("_w"))
        .groupBy(*by, "_v")
        .agg(F.sum("_w").alias("_n"))
    )
    n_edges = (1 << steps) - 1
    splits = F.array(*(F.lit((i + 1) / (n_edges + 1)) for i in range(n_edges)))
    edges = values.agg(
        F.struct(
            F.percentile_approx("_v", splits, F.lit(4 * (n_edges + 1))).alias("e"),
            F.min("_v").alias("lo"),
            F.max("_v").alias("hi"),
        )
    ).scalar()
    placed = values.withColumn("_span", edges).withColumn("_edges", F.col("_span.e"))
    search = F.aggregate(
        F.array(*(F.lit(1 << k) for k in range(steps - 1, -1, -1))),
        F.lit(0),
        lambda pos, half: F.when(
            F.element_at(F.col("_edges"), pos + half) <= F.col("_v"), pos + half
        ).otherwise(pos),
    )
    placed = placed.withColumn("_b", search)
    lo = F.coalesce(F.get("_edges", F.col("_b") - 1), F.col("_span.lo"))
    hi = F.coalesce(F.get("_edges", F.col("_b")), F.col("_span.hi"))
    piece = F.when(
        hi > lo, F.least(F.floor((F.col("_v") - lo) / (hi - lo) * (n_edges + 1)), F.lit(n_edges))
    ).otherwise(0)
    placed = placed.withColumn("_p", piece).drop("_edges", "_span")

    totals = placed.groupBy(*by, "_b").agg(F.sum("_n").alias("_n"))
    group = Window.partitionBy(*by)
    ranks = F.array_distinct(
        F.flatten(
            F.array(
                *(
                    F.array(
                        F.floor((F.col("_total") - 1) * F.lit(float(p))),
                        F.ceil((F.col("_total") - 1) * F.lit(float(p))),
                    )
                    for p in probs
                )
            )
        )
    )
    targets = (
        totals.withColumn("_total", F.sum("_n").over(group))
        .withColumn("_before", F.sum("_n").over(group.orderBy("_b")) - F.col("_n"))
        .withColumn(
            "_ranks",
            F.filter(
                ranks,
                lambda r: (r >= F.col("_before"))
                & (r < F.col("_before") + F.col("_n")),
            ),
        )
        .where(F.size("_ranks") > 0)
        .drop("_n")
    )
    wanted = _same_group(placed, targets, [*by, "_b"])
    bucket = Window.partitionBy(*by, "_b").orderBy("_p")
    first = F.col("_before") + F.sum("_n").over(bucket) - F.col("_n")
    pieces = (
        wanted.groupBy(*by, "_b", "_p")
        .agg(
            F.sum("_n").alias("_n"),
            *(F.first(c).alias(c) for c in ("_before", "_total", "_ranks")),
        )
        .withColumn("_before", first)
        .withColumn(
            "_ranks",
            F.filter(
                "_ranks",
                lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")),
            ),
        )
        .where(F.size("_ranks") > 0)
        .drop("_n")
    )
    in_piece = Window.partitionBy(*by, "_b", "_p").orderBy("_v")
    wanted = _same_group(placed, pieces, [*by, "_b", "_p"]).withColumn(
        "_first", F.col("_before") + F.sum("_n").over(in_piece) - F.col("_n")
    )
    hits = wanted.select(
        *by,
        "_total",
        "_v",
        F.explode(
            F.filter(
                "_ranks",
                lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_n")),
            )
        ).alias("_rank"),
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col("_v")))

    def quantile(p: float) -> Column:
        pos = (F.col("_total") - 1) * F.lit(float(p))
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        return low + (high - low) * (F.max(pos) - F.floor(F.max(pos)))

    return hits.groupBy(*by).agg(F.array(*(quantile(p) for p in probs)).alias("q"))


def _same_group(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on null-safe equality, keeping the left key columns."""
    renamed = right.select(
        *(F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns)
    )
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = one if cond is None else cond & one
    return left.join(renamed, cond).drop(*(f"_r_{k}" for k in keys))


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    weight: str | None = None,
    span: DataFrame | None = None,
) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty ones count 0.

    Columns: bin (0-based), lower, upper, n. Equal values all fall in bin 0.
    ``weight`` names the count column of rows that stand for several; values from a
    small range are best folded first, so that finding the range and filling the bins
    share one pass over the rows. ``span`` is a row that
    holds the range as a struct of lo and hi, where it is known already.
    """
    known = df.where(F.col(value).isNotNull())
    n = F.sum(weight) if weight else F.count("*")
    x = F.col(value).cast("double")
    if span is None:
        # n is not needed here; asking for it lets Spark reuse the folded rows' exchange
        span = known.agg(
            F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), n.alias("n"))
        )
    span = span.scalar()
    lo, hi = F.col("_span.lo"), F.col("_span.hi")
    width = (hi - lo) / bins
    place = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    )
    counts = (
        known.withColumn("_span", span)
        .groupBy(place.cast("int").alias("_bin"))
        .agg(n.alias("_n"), F.max("_span").alias("_span"))
    )
    heights = [
        F.coalesce(F.sum(F.when(F.col("_bin") == i, F.col("_n"))), F.lit(0))
        for i in range(bins)
    ]
    # equal values fill one bin, no values none
    wanted = F.when(hi > lo, F.lit(bins)).when(hi == lo, F.lit(1)).otherwise(F.lit(0))
    return (
        counts.agg(F.array(*heights).alias("_ns"), F.max("_span").alias("_span"))
        .select("_span", F.posexplode(F.slice("_ns", F.lit(1), wanted)).alias("bin", "n"))
        .select(
            "bin",
            (lo + F.col("bin") * width).alias("lower"),
            (lo + (F.col("bin") + 1) * width).alias("upper"),
            "n",
        )
    )
