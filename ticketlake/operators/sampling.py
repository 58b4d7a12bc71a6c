"""Seeded sampling with exact sizes.

Rows are ordered by ``md5(id:seed)``. The n smallest are found without sorting
the table: the leading hex digits of the hash cut it into 65,536 even buckets,
counts per bucket (combined map-side) show in which bucket the n-th row falls,
and only that one bucket is ranked. So no group, however large, is sorted in
one task, and nothing but counts is shuffled before the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

_DIGITS = 4
_BROADCAST_ROWS = 100_000  # strata; one (stratum, cut, need) row each


def sample_key(id_col: Column, seed: int | str) -> Column:
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))


def _bucket(key: Column) -> Column:
    return F.substring(key, 1, _DIGITS)


def lowest(df: DataFrame, n: int, key: str, tie: str) -> DataFrame:
    """The n rows with the smallest (key, tie), where ``key`` is a hex digest."""
    counts = df.groupBy(_bucket(F.col(key)).alias("_b")).agg(F.count("*").alias("_n"))
    running = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_b")))
    cut = (
        running.where(F.col("_upto") >= n)
        .agg(F.min(F.struct("_b", "_n", "_upto")).alias("c"))
        .select(
            F.struct(
                F.col("c._b").alias("bucket"),
                (F.lit(n) - (F.col("c._upto") - F.col("c._n"))).alias("need"),
            )
        )
        .scalar()
    )
    cut_bucket, need = cut["bucket"], cut["need"]
    below = df.where(cut_bucket.isNull() | (_bucket(F.col(key)) < cut_bucket))
    edge = (
        df.where(_bucket(F.col(key)) == cut_bucket)
        .withColumn("_rank", F.row_number().over(Window.orderBy(key, tie)))
        .where(F.col("_rank") <= need)
        .drop("_rank")
    )
    return below.unionByName(edge)


def _as_small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a table known to have at most ``rows`` rows for broadcast, unless that is too many."""
    return F.broadcast(df) if rows <= _BROADCAST_ROWS else df


def _flag_lowest(df: DataFrame, cuts: DataFrame, key: str, tie: str) -> DataFrame:
    """Add ``_picked``: whether a row is within its stratum's quota.

    ``cuts`` names, per stratum, the bucket its quota ends in and how many rows
    of that bucket it still needs; strata without a cut are taken whole.
    """
    placed = df.join(cuts, F.col("_stratum") == F.col("_s"), "left").withColumn(
        "_b", _bucket(F.col(key))
    )
    # the boundary bucket of each stratum is the only part that is ranked
    at_cut = F.coalesce(F.col("_b") == F.col("_cut"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy(key, tie))
    edge = placed.where(at_cut).withColumn("_picked", rank <= F.col("_need"))
    inside = F.col("_cut").isNull() | (F.col("_b") < F.col("_cut"))
    plain = placed.where(~at_cut).withColumn(
        "_picked", F.col("_stratum").isNotNull() & inside
    )
    return plain.unionByName(edge).drop("_s", "_b", "_cut", "_need")


def _unstratified_ids(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    rows = df.select(id_col, sample_key(F.col(id_col), seed).alias("_key"))
    return lowest(rows, n, "_key", id_col).select(id_col)


def _bucket_counts(rows: DataFrame) -> DataFrame:
    """Rows per stratum and bucket of the key, and (with no stratum) per bucket of the fill key, in one pass."""
    own = F.struct(F.col("_stratum").alias("_s"), _bucket(F.col("_key")).alias("_b"))
    fill = F.struct(F.lit(None).cast(rows.schema["_stratum"].dataType).alias("_s"), _bucket(F.col("_fill")).alias("_b"))
    both = F.when(F.col("_stratum").isNotNull(), F.array(own, fill)).otherwise(F.array(fill))
    return rows.select(F.explode(both).alias("c")).groupBy("c._s", "c._b").agg(F.count("*").alias("_n"))


def _cuts(counts: DataFrame, quota: int, n: int) -> DataFrame:
    """Per stratum: the bucket in which its last row lies, and how many rows of that bucket it takes.

    A stratum takes ``quota`` rows, the line of fill keys (null stratum) ``n``.
    """
    need = F.when(F.col("_s").isNull(), F.lit(n)).otherwise(F.lit(quota))
    upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_b"))
    return (
        counts.withColumn("_upto", upto)
        .where(F.col("_upto") >= need)
        .groupBy("_s")
        .agg(F.min(F.struct("_b", "_n", "_upto")).alias("c"))
        .select("_s", F.col("c._b").alias("_cut"), (need - (F.col("c._upto") - F.col("c._n"))).alias("_need"))
    )


def stratified_sample(
    df: DataFrame,
    n: int,
    stratum: str | None = "queue",
    seed: int = 42,
    id_col: str = "ticket_id",
) -> DataFrame:
    """A sample of min(n, rows) tickets, even over ``stratum``, with ``sample_order``, a seeded shuffle of it.

    Each stratum gives ``n // strata`` rows, small ones all they have; what is
    then missing is drawn from all other rows, those without a stratum
    included. Without any stratum value the whole draw is unstratified.

    ``df`` is scanned twice. The first scan counts, per stratum, the rows in each bucket of their key
    and, over all rows, those in each bucket of the key that settles the fill. Both are sums
    that combine map-side, and they bound the sample from above: a stratum's quota ends in a known bucket,
    and as at most ``n`` rows are taken before the fill, the fill is among the ``n`` rows with
    the lowest fill keys. The second scan keeps the rows within these bounds, about 2 n with
    all their columns, and everything after that works on them.
    """
    if stratum is None or stratum not in df.columns:
        return _ordered(df, _unstratified_ids(df, n, seed, id_col), n, seed, id_col)
    keyed = df.withColumns(
        {
            "_stratum": F.col(stratum),
            "_key": sample_key(F.col(id_col), seed),
            "_fill": sample_key(F.col(id_col), f"{seed}:fill"),
        }
    )
    counts = stage(_bucket_counts(keyed.select("_stratum", "_key", "_fill")), "strata-counts")
    sizes = counts.where("_s IS NOT NULL").groupBy("_s").agg(F.sum("_n").alias("size"))
    strata = F.count("*").over(Window.partitionBy())
    share = F.least("size", F.floor(F.lit(n) / F.col("strata")))
    found = sizes.withColumn("strata", strata).agg(F.max("strata").alias("strata"), F.sum(share).alias("own")).first()
    if not found["strata"]:
        return _ordered(df, _unstratified_ids(df, n, seed, id_col), n, seed, id_col)
    cuts = stage(_cuts(counts, n // found["strata"], n), "strata-cuts")
    own = _as_small(cuts.where("_s IS NOT NULL"), found["strata"])
    last_fill = cuts.where("_s IS NULL").agg(F.max("_cut").alias("c")).scalar()  # null: fewer than n rows
    low = F.col("_stratum").isNotNull() & (F.col("_cut").isNull() | (_bucket(F.col("_key")) <= F.col("_cut")))
    filling = F.coalesce(_bucket(F.col("_fill")) <= last_fill, F.lit(True))
    near = keyed.join(own.select("_s", "_cut"), F.col("_stratum") == F.col("_s"), "left").where(low | filling)
    near = stage(near.drop("_s", "_cut"), "sample-candidates")
    flagged = _flag_lowest(near.select(id_col, "_stratum", "_key", "_fill"), own, "_key", id_col)
    picked = flagged.where("_picked").select(id_col)
    if n > found["own"]:
        rest = flagged.where("NOT _picked").select(id_col, F.col("_fill").alias("_key"))
        picked = picked.unionByName(lowest(rest, n - found["own"], "_key", id_col).select(id_col))
    return _ordered(near.drop("_stratum", "_key", "_fill"), picked, n, seed, id_col)


def stratified_ids(
    df: DataFrame,
    n: int,
    stratum: str | None = "queue",
    seed: int = 42,
    id_col: str = "ticket_id",
) -> DataFrame:
    """Ids of the sample alone; no other column is read."""
    columns = [c for c in dict.fromkeys((id_col, stratum)) if c in df.columns]
    return stratified_sample(df.select(*columns), n, stratum, seed, id_col).select(id_col)


def _ordered(rows: DataFrame, ids: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """The rows of at most ``n`` ids, with their place in the sample."""
    picked = rows.join(_as_small(ids, n), id_col, "left_semi")
    return picked.withColumn("sample_order", sample_key(F.col(id_col), f"{seed}:order"))


def head(df: DataFrame, n: int, id_col: str = "ticket_id") -> DataFrame:
    """The first n tickets of a sample, in sample order; only ids and keys are ranked."""
    ids = lowest(df.select(id_col, "sample_order"), n, "sample_order", id_col)
    return df.join(ids.select(id_col), id_col, "left_semi")


def random_row(df: DataFrame, seed: int, id_col: str = "ticket_id") -> DataFrame:
    """One row drawn by ``seed``."""
    keyed = df.withColumn("_key", sample_key(F.col(id_col), f"{seed}:one"))
    return keyed.orderBy("_key", id_col).limit(1).drop("_key")
