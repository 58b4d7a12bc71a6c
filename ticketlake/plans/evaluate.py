"""Evaluate: result records against mapped labels.

Reports are read from two tables. ``fold`` turns the evaluation frame (``eval_frame``)
into counts and sums per combination of the few values that most reports are about;
those reports never see single tickets. The rest (exact quantiles, examples) reads the
frame itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import priority_urgency, queue_topic, urgency_ordinal
from ..operators.quantiles import (
    bounded_quantiles,
    exact_quantiles,
    histogram,
    value_weights,
    weighted_quantiles,
)
from ..operators.sketches import ERROR, merged_sketches, sketched_quantiles, sketches
from ..operators.tables import (
    crosstab,
    dense_distribution,
    distribution,
    pair_cube,
    percent,
    top_values,
)
from ..schemas import (
    ACTIONS,
    FALLBACK_MARK,
    LOOP_BREAK_MARK,
    TOPIC_MARGIN_THRESHOLD,
    TOPICS,
    URGENCY_DISPLAY,
)
from ..storage import stage

NO_PATH = "(none)"


def tool_path(tools: Column) -> Column:
    joined = F.array_join(F.coalesce(tools, F.array().cast("array<string>")), " -> ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_PATH))


def eval_frame(results: DataFrame) -> DataFrame:
    """One flat row per result: predictions, mapped labels, and what reports need."""
    queue, priority = F.col("ground_truth.queue"), F.col("ground_truth.priority")
    return results.select(
        "ticket_id",
        F.col("topic").alias("predicted_topic"),
        F.col("urgency").alias("predicted_urgency"),
        "topic_margin",
        "action",
        "next_step",
        "tools_used",
        tool_path(F.col("tools_used")).alias("tool_path"),
        F.coalesce(F.size("clarification_questions"), F.lit(0)).alias(
            "n_clarifications"
        ),
        "runtime_seconds",
        "text_length",
        queue.alias("gt_queue"),
        priority.alias("gt_priority"),
        queue_topic(queue).alias("mapped_topic"),
        priority_urgency(priority).alias("mapped_urgency"),
        F.coalesce("text_snippet", F.lit("")).alias("snippet"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
    )


def filtered(
    frame: DataFrame,
    actions: Sequence[str] | None = None,
    topics: Sequence[str] | None = None,
    urgencies: Sequence[str] | None = None,
) -> DataFrame:
    """Rows within all the given value sets; a set left out does not filter."""
    for col, values in (
        ("action", actions),
        ("predicted_topic", topics),
        ("predicted_urgency", urgencies),
    ):
        if values is not None:
            frame = frame.where(F.col(col).isin(list(values)))
    return frame


KEYS = [
    "action",
    "tool_path",
    "is_fallback",
    "is_loop_break",
    "predicted_topic",
    "mapped_topic",
    "predicted_urgency",
    "mapped_urgency",
    "n_clarifications",
    "text_length",
]


def fold(frame: DataFrame, keys: Sequence[str] = KEYS, margins: bool = True) -> DataFrame:
    """One row per combination of ``keys``: tickets, and sums over their margins unless left out.

    Combines map-side. All keys but text_length, which is capped, and tool_path,
    which holds four tools at most, are from short lists. A single report folds by
    the keys it reads (``fold_for``), so columns, joins and searches that only
    others need are pruned.
    """
    marks = {"is_fallback": FALLBACK_MARK, "is_loop_break": LOOP_BREAK_MARK}
    tools = {k: F.array_contains("tools_used", mark) for k, mark in marks.items() if k in keys}
    margin = F.col("topic_margin")
    sums = {
        "n_margin": F.count(margin),
        "margin_sum": F.sum(margin),
        "margin_min": F.min(margin),
        "margin_max": F.max(margin),
        "n_low": F.count_if(margin < TOPIC_MARGIN_THRESHOLD),
    }
    wanted = sums.items() if margins else ()
    return (
        frame.withColumns(tools)
        .groupBy(*keys)
        .agg(F.count("*").alias("n"), *(c.alias(name) for name, c in wanted))
    )


def merged(folds: DataFrame) -> DataFrame:
    """Folds of several runs as the fold of all their tickets."""
    how = {"margin_min": F.min, "margin_max": F.max}
    sums = ("n", "n_margin", "margin_sum", "margin_min", "margin_max", "n_low")
    return folds.groupBy(*KEYS).agg(*(how.get(c, F.sum)(c).alias(c) for c in sums))


# --- single figures --------------------------------------------------------


def _topic_hit() -> Column:
    return F.col("predicted_topic") == F.col("mapped_topic")


def _urgency_hit() -> Column:
    return F.col("predicted_urgency") == F.col("mapped_urgency")


def _tickets(condition: Column | None = None, of: str = "n") -> Column:
    """Tickets of folded rows, those that meet the condition; 0 if there are none."""
    n = F.col(of) if condition is None else F.when(condition, F.col(of))
    return F.coalesce(F.sum(n), F.lit(0))


def _known(col: str) -> Column:
    return _tickets(F.col(col).isNotNull())


def _with_percent(df: DataFrame, *shares: tuple[str, str, str]) -> DataFrame:
    """Add percentage columns, each given as (name, part, whole)."""
    return df.select(
        "*",
        *(
            percent(F.col(part), F.col(whole)).alias(name)
            for name, part, whole in shares
        ),
    )


def fallback_rate(folded: DataFrame) -> DataFrame:
    """Tickets decided by fallback; tickets cut off by the loop guard apart."""
    counts = folded.agg(
        _tickets().alias("n"),
        _tickets(F.col("is_fallback")).alias("n_fallback"),
        _tickets(F.col("is_loop_break")).alias("n_loop_break"),
    )
    return _with_percent(
        counts,
        ("fallback_pct", "n_fallback", "n"),
        ("loop_break_pct", "n_loop_break", "n"),
    )


def urgency_agreement(folded: DataFrame) -> DataFrame:
    gap = F.abs(
        urgency_ordinal(F.col("predicted_urgency"))
        - urgency_ordinal(F.col("mapped_urgency"))
    )
    counts = folded.agg(
        _tickets().alias("n"),
        _known("mapped_urgency").alias("n_comparable"),
        _tickets(_urgency_hit()).alias("n_exact"),
        _tickets(gap <= 1).alias("n_within_1"),
    )
    return _with_percent(
        counts,
        ("exact_pct", "n_exact", "n_comparable"),
        ("within_1_pct", "n_within_1", "n_comparable"),
    )


def topic_agreement(folded: DataFrame) -> DataFrame:
    """Over all tickets with a queue, and over those not mapped to Other."""
    specific = F.col("mapped_topic") != "Other"
    counts = folded.agg(
        _tickets().alias("n"),
        _known("mapped_topic").alias("n_comparable"),
        _tickets(_topic_hit()).alias("n_exact"),
        _tickets(specific).alias("n_specific"),
        _tickets(specific & _topic_hit()).alias("n_specific_exact"),
    )
    return _with_percent(
        counts,
        ("exact_pct", "n_exact", "n_comparable"),
        ("specific_pct", "n_specific_exact", "n_specific"),
    )


def margin_stats(folded: DataFrame) -> DataFrame:
    """Margins of the tickets with a queue."""
    margins = folded.where(F.col("mapped_topic").isNotNull())
    counts = margins.agg(
        _tickets(of="n_margin").alias("n"),
        (F.sum("margin_sum") / F.nullif(F.sum("n_margin"), F.lit(0))).alias("mean_margin"),
        F.min("margin_min").alias("min_margin"),
        F.max("margin_max").alias("max_margin"),
        _tickets(of="n_low").alias("n_low"),
    )
    return _with_percent(counts, ("low_pct", "n_low", "n"))


def headline_kpis(folded: DataFrame) -> DataFrame:
    """The dashboard's figures."""
    specific = F.col("mapped_topic") != "Other"
    counts = folded.agg(
        _tickets().alias("n"),
        _known("mapped_topic").alias("_t"),
        _tickets(_topic_hit()).alias("_th"),
        _tickets(specific).alias("_s"),
        _tickets(specific & _topic_hit()).alias("_sh"),
        _known("mapped_urgency").alias("_u"),
        _tickets(_urgency_hit()).alias("_uh"),
        _tickets(F.col("is_fallback")).alias("n_fallback"),
        _tickets(F.col("is_loop_break")).alias("n_loop_break"),
    )
    return counts.select(
        "n",
        percent(F.col("_th"), F.col("_t")).alias("topic_pct"),
        percent(F.col("_sh"), F.col("_s")).alias("topic_specific_pct"),
        percent(F.col("_uh"), F.col("_u")).alias("urgency_pct"),
        "n_fallback",
        "n_loop_break",
    )


# --- distributions and matrices --------------------------------------------


def action_distribution(folded: DataFrame) -> DataFrame:
    return distribution(folded, "action", weight="n").orderBy(F.desc("n"), "action")


def action_shares(folded: DataFrame) -> DataFrame:
    """All five actions in fixed order, 0 where none was taken."""
    return dense_distribution(folded, "action", ACTIONS, weight="n")


def top_tool_paths(folded: DataFrame, k: int = 10) -> DataFrame:
    return top_values(folded, "tool_path", k, weight="n")


def action_path_cube(folded: DataFrame) -> DataFrame:
    return pair_cube(folded, "action", "tool_path", weight="n")


def question_coverage(folded: DataFrame) -> DataFrame:
    """Per action: tickets, those that ask something, questions per ticket."""
    counts = folded.groupBy("action").agg(
        _tickets().alias("n"),
        _tickets(F.col("n_clarifications") > 0).alias("n_asking"),
        (F.sum(F.col("n_clarifications") * F.col("n")) / F.sum("n")).alias("mean_questions"),
    )
    return _with_percent(counts, ("asking_pct", "n_asking", "n"))


def urgency_confusion(folded: DataFrame, margins: bool = True) -> DataFrame:
    return crosstab(
        folded,
        "mapped_urgency",
        "predicted_urgency",
        URGENCY_DISPLAY,
        URGENCY_DISPLAY,
        margins,
        weight="n",
    )


def topic_confusion(folded: DataFrame, margins: bool = True) -> DataFrame:
    return crosstab(
        folded, "mapped_topic", "predicted_topic", TOPICS, TOPICS, margins, weight="n"
    )


def topic_recall(folded: DataFrame) -> DataFrame:
    """Per mapped topic that occurs: tickets and how many were predicted right."""
    counts = (
        folded.where(F.col("mapped_topic").isNotNull())
        .groupBy("mapped_topic")
        .agg(_tickets().alias("n"), _tickets(_topic_hit()).alias("n_correct"))
    )
    order = F.array_position(F.array(*(F.lit(t) for t in TOPICS)), F.col("mapped_topic"))
    return _with_percent(counts, ("recall_pct", "n_correct", "n")).orderBy(order)


def margin_histogram(
    frame: DataFrame, bins: int = 30, folded: DataFrame | None = None
) -> DataFrame:
    """Margins in equal-width bins; the range comes from ``folded`` where it is at hand."""
    span = None
    if folded is not None:
        span = folded.agg(
            F.struct(F.min("margin_min").alias("lo"), F.max("margin_max").alias("hi"))
        )
    return histogram(frame, "topic_margin", bins, span=span)


# --- text length ------------------------------------------------------------

_LENGTH_PROBS = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
_LENGTH_NAMES = ["min", "p25", "median", "p75", "p95", "max"]


def length_quantiles(folded: DataFrame) -> DataFrame:
    """Whole-number quantiles, cut off like the report's."""
    q = bounded_quantiles(folded, "text_length", _LENGTH_PROBS, weight="n")
    return q.where(F.col("q").isNotNull()).select(
        *(
            F.floor(F.col("q")[i]).cast("int").alias(name)
            for i, name in enumerate(_LENGTH_NAMES)
        )
    )


def length_by_action(folded: DataFrame) -> DataFrame:
    known = F.when(F.col("text_length").isNotNull(), F.col("n"))
    return folded.groupBy("action").agg(
        (F.sum(F.col("text_length") * F.col("n")) / F.sum(known)).alias("mean_length"),
        _tickets().alias("n"),
    )


LENGTH_BUCKETS = ["short", "medium", "long"]


# Capped texts have at most 2,007 lengths. The bucket reports fold to one row per
# length first; quartiles and buckets then come from those rows.


def _length_cuts(folded: DataFrame) -> Column:
    """Quartiles [q25, q75] of rows folded by text_length, as a scalar.

    The subquery also reads the other columns, so that Spark reuses the exchange
    of these rows instead of making them a second time.
    """
    others = [c for c in folded.columns if c not in ("text_length", "_n")]
    return folded.agg(
        F.struct(
            weighted_quantiles("text_length", [0.25, 0.75]).alias("q"),
            *(F.max(c).alias(c) for c in others),
        )
    ).scalar()["q"]


def length_bucket(length: Column, cuts: Column) -> Column:
    return (
        F.when(length <= cuts[0], "short").when(length <= cuts[1], "medium").otherwise("long")
    )


def length_bucket_actions(folded: DataFrame, margins: bool = True) -> DataFrame:
    lengths = value_weights(folded, "text_length", ["action"], weight="n")
    cut = lengths.withColumn("_q", _length_cuts(lengths))
    return crosstab(
        cut.withColumn("bucket", length_bucket(F.col("text_length"), F.col("_q"))),
        "bucket",
        "action",
        LENGTH_BUCKETS,
        ACTIONS,
        margins,
        weight="_n",
    )


def bucket_quality(folded: DataFrame) -> DataFrame:
    """Agreement per length bucket, each figure over the rows that have it.

    All three buckets are listed, with their cut points and display labels.
    """
    tallies = {
        "_n": _tickets(),
        "n_topic": _known("mapped_topic"),
        "n_topic_exact": _tickets(_topic_hit()),
        "n_urgency": _known("mapped_urgency"),
        "n_urgency_exact": _tickets(_urgency_hit()),
        "_margins": _tickets(of="n_margin"),
        "_margin_sum": F.sum("margin_sum"),
    }
    lengths = (
        folded.where(F.col("text_length").isNotNull())
        .groupBy("text_length")
        .agg(*(c.alias(n) for n, c in tallies.items()))
    )
    q = F.col("_q")
    placed = lengths.withColumn("_q", _length_cuts(lengths)).withColumn(
        "bucket", length_bucket(F.col("text_length"), q)
    )
    low, high = q[0].cast("int"), q[1].cast("int")
    label = (
        F.when(F.col("bucket") == "short", F.format_string("short (<=%d)", low))
        .when(
            F.col("bucket") == "medium", F.format_string("medium (%d-%d)", low + 1, high)
        )
        .otherwise(F.format_string("long (>%d)", high))
    )

    def in_bucket(name: str, col: str) -> Column:
        return F.sum(F.when(F.col("bucket") == name, F.col(col)))

    rows = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(b).alias("bucket"),
            F.coalesce(in_bucket(b, "_n"), F.lit(0)).alias("n"),
            *(F.coalesce(in_bucket(b, n), F.lit(0)).alias(n) for n in list(tallies)[1:5]),
            (
                in_bucket(b, "_margin_sum") / F.nullif(in_bucket(b, "_margins"), F.lit(0))
            ).alias("mean_margin"),
        )
        for i, b in enumerate(LENGTH_BUCKETS)
    ]
    listed = (
        placed.agg(F.array(*rows).alias("rows"), F.max("_q").alias("_q"))
        .select("_q", F.inline("rows"))
        .select("*", label.alias("bucket_label"), q[0].alias("q25"), q[1].alias("q75"))
        .drop("_q")
    )
    return _with_percent(
        listed,
        ("topic_pct", "n_topic_exact", "n_topic"),
        ("urgency_pct", "n_urgency_exact", "n_urgency"),
    )


# --- runtime ------------------------------------------------------------------


def runtimes(frame: DataFrame) -> DataFrame:
    """tool_path, runtime_seconds and how often (_n); the runtime reports are made from it.

    Stage it when several reports are made.
    """
    return value_weights(frame, "runtime_seconds", ["tool_path"])


def _spent() -> Column:
    return F.sum(F.col("runtime_seconds") * F.col("_n"))


def runtime_stats(spent: DataFrame) -> DataFrame:
    """Sum, mean, median, 95th percentile and maximum of the recorded runtimes."""
    q = exact_quantiles(spent, "runtime_seconds", [0.5, 0.95], weight="_n").select("q").scalar()
    return spent.agg(
        _tickets(of="_n").alias("n"),
        _spent().alias("total"),
        (_spent() / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"),
        F.max("runtime_seconds").alias("slowest"),
    ).select("*", q[0].alias("p50"), q[1].alias("p95"))


def runtime_by_path(spent: DataFrame) -> DataFrame:
    """Mean runtime and count per tool path, slowest first."""
    return (
        spent.groupBy("tool_path")
        .agg((_spent() / F.sum("_n")).alias("mean"), F.sum("_n").alias("n"))
        .orderBy(F.desc("mean"), "tool_path")
    )


def runtime_box(spent: DataFrame) -> DataFrame:
    """Box statistics per tool path, fastest mean first."""
    q = exact_quantiles(
        spent, "runtime_seconds", [0.0, 0.25, 0.5, 0.75, 1.0], ["tool_path"], weight="_n"
    )
    names = ["min", "q1", "median", "q3", "max"]
    return (
        runtime_by_path(spent)
        .join(q, "tool_path")
        .select(
            "tool_path",
            "n",
            "mean",
            *(F.col("q")[i].alias(name) for i, name in enumerate(names)),
        )
        .orderBy("mean", "tool_path")
    )


# --- disagreements --------------------------------------------------------------


def disagreement_counts(folded: DataFrame) -> DataFrame:
    return folded.agg(
        _tickets(~_topic_hit()).alias("n_topic"),
        _tickets(~_urgency_hit()).alias("n_urgency"),
    )


def disagreements(frame: DataFrame, n: int = 5, cut: int | None = 140) -> DataFrame:
    """First n wrong topics and first n wrong urgencies, by ticket id.

    Snippet and reasoning are cut at ``cut`` characters, or left whole.
    """

    def shown(col: str) -> Column:
        return F.col(col) if cut is None else F.substring(col, 1, cut).alias(col)

    def examples(focus: str, hit: Column, predicted: str, mapped: str, label: str):
        return (
            frame.where(~hit)
            .orderBy("ticket_id")
            .limit(n)
            .select(
                F.lit(focus).alias("focus"),
                "ticket_id",
                shown("snippet"),
                F.col(predicted).alias("predicted"),
                F.col(mapped).alias("mapped"),
                F.col(label).alias("label"),
                "action",
                "tool_path",
                shown("reasoning"),
            )
        )

    return examples(
        "topic", _topic_hit(), "predicted_topic", "mapped_topic", "gt_queue"
    ).unionByName(
        examples(
            "urgency",
            _urgency_hit(),
            "predicted_urgency",
            "mapped_urgency",
            "gt_priority",
        )
    )


_TOPIC = ("predicted_topic", "mapped_topic")
_URGENCY = ("predicted_urgency", "mapped_urgency")
_MARKS = ("is_fallback", "is_loop_break")
_READS = {
    action_distribution: ("action",),
    action_shares: ("action",),
    top_tool_paths: ("tool_path",),
    fallback_rate: _MARKS,
    action_path_cube: ("action", "tool_path"),
    question_coverage: ("action", "n_clarifications"),
    urgency_agreement: _URGENCY,
    urgency_confusion: _URGENCY,
    topic_agreement: _TOPIC,
    margin_stats: ("mapped_topic",),
    topic_confusion: _TOPIC,
    topic_recall: _TOPIC,
    length_quantiles: ("text_length",),
    length_by_action: ("action", "text_length"),
    length_bucket_actions: ("action", "text_length"),
    bucket_quality: (*_TOPIC, *_URGENCY, "text_length"),
    disagreement_counts: (*_TOPIC, *_URGENCY),
    headline_kpis: (*_TOPIC, *_URGENCY, *_MARKS),
}


def fold_for(report: Callable[[DataFrame], DataFrame], frame: DataFrame) -> DataFrame:
    """The fold of ``frame`` by no more than what ``report`` reads."""
    return fold(frame, _READS[report], margins=report in (margin_stats, bucket_quality))


# made from the folded table alone
REPORTS = {
    "action_distribution": action_distribution,
    "action_shares": action_shares,
    "top_tool_paths": top_tool_paths,
    "fallback_rate": fallback_rate,
    "action_path_cube": action_path_cube,
    "question_coverage": question_coverage,
    "urgency_agreement": urgency_agreement,
    "urgency_confusion": urgency_confusion,
    "topic_agreement": topic_agreement,
    "margin_stats": margin_stats,
    "topic_confusion": topic_confusion,
    "topic_recall": topic_recall,
    "length_quantiles": length_quantiles,
    "length_by_action": length_by_action,
    "length_bucket_actions": length_bucket_actions,
    "bucket_quality": bucket_quality,
    "disagreement_counts": disagreement_counts,
    "headline_kpis": headline_kpis,
}
# made from the folded runtimes
RUNTIME_REPORTS = {
    "runtime_stats": runtime_stats,
    "runtime_by_path": runtime_by_path,
    "runtime_box": runtime_box,
}


def evaluate(
    results: DataFrame,
    actions: Sequence[str] | None = None,
    topics: Sequence[str] | None = None,
    urgencies: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """All reports, over the results with the given values.

    The results are read four times in all: to fold them, to fold the runtimes,
    for the histogram of margins, and for the examples; columns that a pass does not
    need are not read. The frame is returned under the key ``frame``.
    """
    frame = filtered(eval_frame(results), actions, topics, urgencies)
    folded = stage(fold(frame), "evaluation")
    spent = stage(runtimes(frame), "runtimes")
    reports = {name: make(folded) for name, make in REPORTS.items()}
    return {
        "frame": frame,
        **reports,
        "margin_histogram": margin_histogram(frame, folded=folded),
        **{name: make(spent) for name, make in RUNTIME_REPORTS.items()},
        "disagreements": disagreements(frame),
    }


# --- folds kept over runs ----------------------------------------------------------

_FILTERS = ["action", "predicted_topic", "predicted_urgency"]


def store_folds(results: DataFrame, path: str, run: str) -> None:
    """Keep one run's folds below ``path``; storing a run again replaces it.

    Three tables: counts per combination of KEYS, how often each runtime occurs per tool
    path, and sketches of the runtimes. All hold the values reports can be filtered by.
    """
    frame = eval_frame(results)
    fold(frame).write.mode("overwrite").parquet(f"{path}/counts/run={run}")
    spent = value_weights(frame, "runtime_seconds", ["tool_path", *_FILTERS])
    spent.write.mode("overwrite").parquet(f"{path}/runtimes/run={run}")
    store_runtime_sketches(frame, path, run)


def store_runtime_sketches(frame: DataFrame, path: str, run: str, error: float = ERROR) -> None:
    """Keep a run's runtimes as sketches of fixed size per tool path and filter values."""
    by = ["tool_path", *(c for c in _FILTERS if c in frame.columns)]
    sketches(frame, "runtime_seconds", by, error).write.mode("overwrite").parquet(f"{path}/sketches/run={run}")


def sketched_runtimes(
    spark: SparkSession,
    path: str,
    probs: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0),
    actions: Sequence[str] | None = None,
    topics: Sequence[str] | None = None,
    urgencies: Sequence[str] | None = None,
) -> DataFrame:
    """tool_path, n and q, approximate quantiles of the runtimes of all runs, from their sketches alone."""
    kept = filtered(spark.read.parquet(f"{path}/sketches").drop("run"), actions, topics, urgencies)
    return sketched_quantiles(merged_sketches(kept, ["tool_path"]), probs)


def read_folds(spark: SparkSession, path: str, runs: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts and runtimes of the given runs, or of all, not merged yet."""

    def rows(table: str) -> DataFrame:
        base = f"{path}/{table}"
        paths = [base] if runs is None else [f"{base}/run={r}" for r in runs]
        return spark.read.option("basePath", base).parquet(*paths).drop("run")

    return rows("counts"), rows("runtimes")


def reports_of_folds(
    spark: SparkSession,
    path: str,
    runs: Sequence[str] | None = None,
    actions: Sequence[str] | None = None,
    topics: Sequence[str] | None = None,
    urgencies: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Reports (``names``, or all) over all tickets of the runs, from their stored folds; results are not read.

    Filters are applied to the folds. A ticket that is in two runs counts twice. Examples and
    the histogram of margins need single tickets and are not among the reports.
    """
    counts, spent = read_folds(spark, path, runs)
    folded = stage(merged(filtered(counts, actions, topics, urgencies)), "evaluation")
    times = filtered(spent, actions, topics, urgencies)
    times = stage(value_weights(times, "runtime_seconds", ["tool_path"], weight="_n"), "runtimes")
    made = [(REPORTS, folded), (RUNTIME_REPORTS, times)]
    return {
        name: make(rows) for which, rows in made for name, make in which.items() if names is None or name in names
    }
