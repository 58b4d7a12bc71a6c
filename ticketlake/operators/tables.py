"""Distributions and crosstabs.

All of them first fold the rows to one count per distinct value or pair, which
combines on the map side; shares, totals, cubes and dense frames then work on
those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    return part * F.lit(100.0) / F.nullif(whole, F.lit(0))


def _sum_where(condition: Column, col: str) -> Column:
    """Sum of ``col`` over the rows that meet the condition, 0 if there are none."""
    return F.coalesce(F.sum(F.when(condition, F.col(col))), F.lit(0))


def value_counts(df: DataFrame, col: str, weight: str | None = None) -> DataFrame:
    """Rows per value; ``weight`` names the count column of rows that stand for several."""
    return df.groupBy(col).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def distribution(df: DataFrame, col: str, weight: str | None = None) -> DataFrame:
    """Count and percentage per value, null included."""
    counts = value_counts(df, col, weight)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", percent(F.col("n"), total))


def dense_distribution(
    df: DataFrame, col: str, values: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Count and percentage for exactly the listed values, in order, 0 where absent.

    Percentages are over the rows that have one of the values.
    """
    counts = value_counts(df, col, weight)
    rows = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(v).alias(col),
            _sum_where(F.col(col) == v, "n").alias("n"),
        )
        for i, v in enumerate(values)
    ]
    listed = counts.agg(
        F.array(*rows).alias("rows"),
        _sum_where(F.col(col).isin(list(values)), "n").alias("total"),
    )
    return listed.select(F.inline("rows"), "total").select(
        "ord", col, "n", F.coalesce(percent(F.col("n"), F.col("total")), F.lit(0.0)).alias("pct")
    )


def top_values(df: DataFrame, col: str, k: int, weight: str | None = None) -> DataFrame:
    """The k most frequent non-null values: n, pct, and n_more values left out.

    Ties go by value; percentages are over the rows that have a value.
    """
    counts = value_counts(df.where(F.col(col).isNotNull()), col, weight)
    all_values = counts.agg(
        F.struct(F.sum("n").alias("rows"), F.count(col).alias("values"))
    ).scalar()
    return (
        counts.orderBy(F.desc("n"), col)
        .limit(k)
        .withColumn("pct", percent(F.col("n"), all_values["rows"]))
        .withColumn("n_more", F.greatest(all_values["values"] - k, F.lit(0)))
    )


def pair_cube(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Counts of every pair, row totals, column totals and the grand total.

    Long form, for open value sets; ``<column>_total`` is 1 where the column
    has been summed over, so a null value never looks like a total.
    """
    pairs = df.groupBy(a, b).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return pairs.cube(a, b).agg(
        F.grouping(a).cast("int").alias(f"{a}_total"),
        F.grouping(b).cast("int").alias(f"{b}_total"),
        F.sum("n").alias("n"),
    )


def crosstab(
    df: DataFrame,
    row: str,
    col: str,
    rows: Sequence[str],
    cols: Sequence[str],
    margins: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Dense counts in fixed order: one column per listed value, 0 where empty.

    With margins a ``Total`` row and a ``total`` column over all counted rows
    are added; a null row value is never counted. ``weight`` names the count
    column of rows that stand for several.
    """
    n = F.sum(weight) if weight else F.count("*")
    pairs = df.where(F.col(row).isNotNull()).groupBy(row, col).agg(n.alias("n"))

    def line(i: int, label: str, of_row: Column) -> Column:
        cells = [_sum_where(of_row & (F.col(col) == c), "n").alias(c) for c in cols]
        if margins:
            cells.append(_sum_where(of_row, "n").alias("total"))
        return F.struct(F.lit(i).alias("ord"), F.lit(label).alias(row), *cells)

    lines = [line(i, r, F.col(row) == r) for i, r in enumerate(rows)]
    if margins:
        lines.append(line(len(rows), "Total", F.lit(True)))
    return pairs.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))
