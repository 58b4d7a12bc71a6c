"""Mixing sources to target weights by a low-discrepancy schedule of slots.

Each source's documents are laid on a line of words in an order shuffled by a hash
of the id, and the line is cut into blocks of equal word counts. Slots 0, 1, 2, ...
take golden-ratio points, frac(j * phi); the cumulative target weights map a point to
a source, and the r-th slot of a source takes the r-th block of its line, which
starts over after its end. Any run of the schedule holds the sources in nearly
the target proportions. Where the points leave a source short of its target's blocks, as they leave one
whose target is less than a block, slots at the schedule's end make up for them, so each source gets
its target to the word.

Targets: ``share`` times all words split by weight, none above ``cap`` times its
source's words; what is cut off goes to the others by weight until none is above.

Nothing is collected: line positions and slot ranks are prefix sums in two levels
(sums per bucket, then within a bucket), so a source with a third of all rows is
spread over all tasks. Only DataFrame functions are used.

Null texts count no words; null sources form a source of their own, ordered last.
Rows without words are returned with nothing taken. Repeated ids are laid out row
by row. An empty table gives an empty result. Only the id, text and source columns
are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: words in a block
BLOCK = 128
#: buckets of a source's line for the prefix sums, cells of the unit interval
BUCKETS, CELLS = 4096, 1024
PHI = 0.6180339887498949


def sizes(docs: DataFrame, id_col="doc_id", text_col="text", group_col="source") -> DataFrame:
    """doc_id, source, size of each row."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(group_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, share=1.5, cap=2) -> DataFrame:
    """One row per source: src (its ordinal), source, source_size, target, lo and hi.

    [lo, hi) is the source's part of the unit interval.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    # sources by the level at which they reach their cap
    by_level = Window.orderBy("level", "src")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("src", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(w, (F.col("src") % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("level", F.col("most") / F.col("weight"))
    )
    wanted = F.sum("source_size").over(everything) * F.lit(float(share))
    reached = (wanted - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = (
        summed.withColumn("reached", reached)
        .withColumn("fill", F.max("reached").over(everything))
        .withColumn("target", F.least("most", F.col("fill") * F.col("weight")))
    )
    return (
        filled.withColumn("upto", F.sum("target").over(upto))
        .withColumn("all", F.max("upto").over(everything))
        .withColumn("hi", F.when(F.col("all") > 0, F.col("upto") / F.col("all")).otherwise(0.0))
        .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("src")), F.lit(0.0)))
        .select("src", "source", "source_size", "target", "lo", "hi", "all")
    )


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, src, block: which block of which source each slot takes.

    Slots from the number of points on make up for blocks the points did not reach; those of several sources
    may share a number.
    """
    spark = sources.sparkSession
    n_slots = int(sources.agg(F.ceil(F.max("all") / block)).first()[0] or 0)
    # as many slots in a chunk as chunks, so that neither level of the ranks is long
    chunk = max(1024, int(n_slots**0.5))
    slots = spark.range(n_slots).select(
        F.col("id").alias("slot"), point_of(F.col("id")).alias("point")
    ).withColumn("cell", F.floor(F.col("point") * CELLS))
    cells = F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.least("hi", F.lit(1.0)) * CELLS))
    parts = sources.where("hi > lo").select("src", "lo", "hi", F.explode(cells).alias("cell"))
    taken = (
        slots.join(parts, "cell")
        .where("point >= lo AND point < hi")
        .select("slot", "src", F.floor(F.col("slot") / chunk).alias("chunk"))
    )
    starts = taken.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("src", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    own = Window.partitionBy("src", "chunk").orderBy("slot")
    drawn = (
        taken.withColumn("rank", F.row_number().over(own) - 1)
        .join(starts, ["src", "chunk"])
        .select("slot", "src", (F.col("first") + F.col("rank")).alias("block"))
    )
    # what the points leave a source short of: the rest of its blocks, after the last slot
    counts = taken.groupBy("src").agg(F.count("*").alias("n"))
    wanted = F.ceil(F.col("target") / block)
    short = (
        sources.select("src", "target")
        .join(counts, "src", "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        .where(wanted > F.col("n"))
        .select("src", F.explode(F.sequence(F.col("n"), wanted - 1)).alias("block"))
    )
    return drawn.unionByName(short.select((F.lit(n_slots) + F.col("block")).alias("slot"), "src", "block"))


def point_of(slot: Column) -> Column:
    x = slot * F.lit(PHI)
    return x - F.floor(x)


def lines(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with its source's figures and ``start``, its first word's place on the line."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bucket = F.floor(F.conv(F.substring("order", 1, 4), 16, 10).cast("int") * BUCKETS / 65536)
    known = sources.select(F.col("source").alias("name"), "src", "source_size", "target")
    placed = (
        sized.join(known, F.col("source").eqNullSafe(F.col("name")))
        .drop("name")
        .withColumn("order", order)
        .withColumn("bucket", bucket)
    )
    sums = placed.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("src", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    own = Window.partitionBy("src", "bucket").orderBy("order", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        placed.withColumn("upto", F.sum("size").over(own))
        .join(firsts, ["src", "bucket"])
        .withColumn("start", F.col("first") + F.col("upto") - F.col("size"))
        .select("doc_id", "source", "src", "size", "source_size", "target", "start")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share=1.5, cap=2, block: int = BLOCK,
        id_col="doc_id", text_col="text", group_col="source") -> DataFrame:
    """doc_id, size, source_size, target, taken and source of each row.

    ``taken`` counts the words the mix takes, repeats included; at most ``cap``
    (2, or 1) times the size.
    """
    sized = stage(sizes(docs, id_col, text_col, group_col), "sizes")
    sources = stage(targets(sized, weights, share, cap), "sources")
    line = lines(sized, sources)
    slots = schedule(sources, block).select("src", "block", F.lit(1).alias("hit"))
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max(1, int(cap)) - 1)))
    quota = F.round("target").cast("long")
    pieces = (
        line.where("size > 0")
        .withColumn("epoch", epochs)
        .withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size"))
        .withColumn("end", F.least(F.col("at") + F.col("size"), quota))
        .withColumn(
            "block",
            F.explode_outer(
                F.when(
                    F.col("end") > F.col("at"),
                    F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block)),
                )
            ),
        )
    )
    words = F.least("end", (F.col("block") + 1) * block) - F.greatest("at", F.col("block") * block)
    keys = ["src", "start", "doc_id", "source", "size", "source_size", "target"]
    taken = (
        pieces.join(slots, ["src", "block"], "left")
        .withColumn("words", F.when(F.col("hit") == 1, words).otherwise(0))
        .groupBy(*keys)
        .agg(F.sum("words").cast("long").alias("taken"))
    )
    empty = line.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


SQL = f"""
WITH sized AS (
  SELECT row_number() OVER () AS n, doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
  FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, [3.0, 1.0, 2.0][src % 3 + 1]::DOUBLE AS weight FROM sums),
reached AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY most / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reached
  FROM levels),
filled AS (SELECT *, least(most, max(reached) OVER () * weight) AS target FROM reached),
upto AS (SELECT *, sum(target) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) AS upto FROM filled),
bounds AS (
  SELECT *, upto / max(upto) OVER () AS hi, coalesce(lag(upto) OVER (ORDER BY src), 0) / max(upto) OVER () AS lo FROM upto),
slots AS (
  SELECT slot, slot * {PHI}::DOUBLE - floor(slot * {PHI}::DOUBLE) AS point
  FROM (SELECT unnest(range(ceil(max(upto) / {BLOCK})::BIGINT)) AS slot FROM upto)),
counts AS (
  SELECT src, greatest(count(point), ceil(any_value(target) / {BLOCK})::BIGINT) AS n
  FROM bounds LEFT JOIN slots ON point >= lo AND point < hi GROUP BY src),
line AS (
  SELECT s.n, s.doc_id, s.size, b.src, b.source_size, b.target, s.source,
         sum(s.size) OVER (PARTITION BY b.src
           ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN bounds b ON s.source IS NOT DISTINCT FROM b.source),
ends AS (
  SELECT l.*, least(c.n * {BLOCK}, round(l.target)::BIGINT) AS stop FROM line l JOIN counts c USING (src))
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, stop) - start)
        + greatest(0, least(start + size + source_size, stop) - start - source_size))::BIGINT AS taken, source
FROM ends
"""
