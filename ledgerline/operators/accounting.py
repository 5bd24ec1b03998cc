"""Batch and outcome accounting: A8-A11, R1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.balance import refusal_reason
from ledgerline.operators.paging import positions
from ledgerline.schemas import DEFAULT_BATCH_SIZE, DURATION_BUCKETS


def cut_batches(rows: DataFrame, order: Sequence[str], batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """Number the rows in order and close a batch after every ``batch_size`` of them."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    numbered = positions(rows, [F.col(c) for c in order])
    return numbered.withColumn("batch_no", F.floor(F.col("position") / batch_size)).drop("position")


def event_log(ledger: DataFrame) -> DataFrame:
    """Per-event outcome of a folded ledger: success, is_duplicate, error."""
    return ledger.withColumns({
        "success": F.col("status").isin("applied", "duplicate"),
        "is_duplicate": F.col("status") == "duplicate",
        "error": refusal_reason(),
    })


def batch_status(failed: Column, total: Column) -> Column:
    return F.when(failed == 0, "completed").when(failed < total, "partial_failure").otherwise("failed")


def batch_outcomes(
    log: DataFrame, batch: str = "batch_no", time_ms: str | None = None, batches: DataFrame | None = None
) -> DataFrame:
    """One row per batch. The error texts stay in the log, see :func:`batch_errors`.

    ``batches`` lists the batches there were; one without any event is completed.
    """
    success, duplicate = F.col("success"), F.col("is_duplicate")
    measures = [
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(success & ~duplicate).alias("successful_events"),
        F.count_if(~success).alias("failed_events"),
        F.count_if(success & duplicate).alias("duplicate_events"),
    ]
    if time_ms is not None:
        measures.append(F.sum(time_ms).alias("processing_time_ms"))
    counted = log.groupBy(batch).agg(*measures)
    if batches is not None:
        counted = batches.select(batch).join(counted, batch, "left").fillna(0)
    return counted.withColumn("status", batch_status(F.col("failed_events"), F.col("total_events")))


def batch_errors(log: DataFrame, batch: str = "batch_no") -> DataFrame:
    return log.where(~F.col("success") & F.col("error").isNotNull()).select(batch, "event_id", "error")


def batch_metrics(batches: DataFrame, operations: DataFrame | None = None) -> DataFrame:
    """Running totals over batch outcomes (needs ``processing_time_ms``).

    ``operations`` (kind, success) adds the database and cache operation counters.
    """
    time = F.col("processing_time_ms")

    def rounded(value: Column) -> Column:
        return F.round(F.coalesce(value, F.lit(0.0)), 2)

    totals = batches.agg(
        F.count(F.lit(1)).alias("total_batches_processed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{name}") for c, name in (
            ("total_events", "events_processed"), ("successful_events", "successful_events"),
            ("failed_events", "failed_events"), ("duplicate_events", "duplicate_events"))],
        rounded(F.sum(time)).alias("total_processing_time_ms"),
        rounded(F.min(time)).alias("min_batch_processing_time_ms"),
        # The reference value before any batch is 0, so a maximum below 0 cannot occur.
        rounded(F.max(time)).alias("max_batch_processing_time_ms"),
        rounded(F.avg(time)).alias("avg_batch_processing_time_ms"),
        F.count_if(F.col("status") == "failed").alias("total_batch_failures"),
        F.count_if(F.col("status") == "partial_failure").alias("total_partial_failures"),
    )
    if operations is None:
        return totals
    counted = operations.agg(*[
        F.count_if((F.col("kind") == kind) & condition).alias(f"total_{label}")
        for kind, prefix in (("redis", "redis_pipeline"), ("database", "database"))
        for condition, label in ((F.lit(True), f"{prefix}_operations"), (~F.col("success"), f"{prefix}_errors"))])
    # Two one-row results side by side.
    return totals.join(F.broadcast(counted))


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    """A10: occurrences per outcome; rows may carry a ``count`` greater than one."""
    amount = F.greatest(F.col("count"), F.lit(0)) if "count" in outcomes.columns else F.lit(1)
    return outcomes.groupBy("outcome").agg(F.sum(amount).cast("long").alias("total"))


def duration_histogram(observations: DataFrame) -> DataFrame:
    """Cumulative buckets per outcome with count and sum, as rows (outcome, le, observations).

    One pass counts all bounds; the buckets are unpivoted from one row per outcome afterwards.
    """
    seconds = F.col("seconds")
    bounds = [*[(str(b), seconds <= b) for b in DURATION_BUCKETS], ("+Inf", F.lit(True))]
    counted = observations.where(seconds >= 0).groupBy("outcome").agg(
        *[F.count_if(inside).alias(f"b{i}") for i, (_, inside) in enumerate(bounds)],
        F.sum(seconds).alias("duration_sum"))
    pairs = F.array(*[F.struct(F.lit(name).alias("le"), F.col(f"b{i}").alias("observations"))
                      for i, (name, _) in enumerate(bounds)])
    return counted.select("outcome", "duration_sum", F.inline(pairs))
