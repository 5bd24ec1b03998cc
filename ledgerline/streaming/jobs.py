"""The ledger as a Structured Streaming job: R1-R7, N6.

One query reads both topics, because one writer must own the balances. Each micro-batch is validated, folded with
the same operators as a batch job, checked for anomalies, and written to the store. Order inside a batch is arrival
order (topic, partition, offset); event times are validated and, for sales, kept, but never used to drop late data.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from time import perf_counter

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline import texts
from ledgerline.functions.validation import good, validate_sales_events, validate_stock_events
from ledgerline.operators import accounting, alerts, anomalies, balance, deadletter, sales, snapshot
from ledgerline.operators.rules import RuleContext, RuleEngine
from ledgerline.schemas import ALERT_TOPIC, ALERTS, DLQ_TOPIC, INVENTORY_TOPIC, MAX_FUTURE_SKEW_SECONDS, SALES_TOPIC
from ledgerline.session import cut_lineage, use_utc
from ledgerline.sources.domain import inventory_table
from ledgerline.streaming.store import Store

ORDER = ("topic", "partition", "offset")
Deliver = Callable[[str, DataFrame, int], None]
ENVELOPE_COLUMNS = ("value", "topic", "partition", "offset")


def now(_: int) -> datetime:
    return datetime.now(timezone.utc)


def run_ledger(
    records: DataFrame,
    store: Store,
    checkpoint: str,
    *,
    engine: RuleEngine | None = None,
    clock: Callable[[int], datetime] = now,
    alert_key: tuple[str, ...] = ("anomaly_id",),
    available_now: bool = False,
    processing_time: str = "5 seconds",
    deliver: Deliver | None = None,
) -> StreamingQuery:
    """Start the job on a stream of broker records. ``available_now`` stops after what is there.

    ``deliver`` (topic, messages, batch id) sends alerts and dead letters on, at least once; see
    :func:`ledgerline.sources.streams.kafka_sink`.
    """
    use_utc(store.spark)
    rules = engine or RuleEngine()

    def step(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, store, rules, clock(batch_id), alert_key, deliver)

    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    trigger = {"availableNow": True} if available_now else {"processingTime": processing_time}
    return writer.trigger(**trigger).start()


def process_batch(
    batch: DataFrame, batch_id: int, store: Store, engine: RuleEngine, at: datetime, alert_key: tuple[str, ...],
    deliver: Deliver | None = None,
) -> None:
    started = perf_counter()
    at = store.begin(batch_id, at)
    as_of = F.lit(at)
    store.compact_balances(batch_id)
    stock = validate_stock_events(batch.where(F.col("topic") == INVENTORY_TOPIC), as_of)
    sold = validate_sales_events(batch.where(F.col("topic") == SALES_TOPIC), as_of)
    # Source offsets of a batch are fixed, so lost blocks are recomputed to the same rows.
    stock, sold = stock.persist(StorageLevel.MEMORY_AND_DISK), sold.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ledger = _fold(stock, sold, batch_id, store)
        # Neither needs what the other writes.
        with ThreadPoolExecutor(2) as pool:
            written = [pool.submit(_write_ledger, ledger, stock, sold, batch_id, store, as_of),
                       pool.submit(_write_findings, ledger, batch_id, store, engine, at, alert_key)]
            for result in written:
                result.result()
        if deliver is not None:
            for topic, name in ((ALERT_TOPIC, "alert_messages"), (DLQ_TOPIC, "dlq")):
                deliver(topic, store.before(name, batch_id + 1, batch_id).select("key", "value"), batch_id)
        _write_accounts(ledger, batch_id, store, perf_counter() - started)
        store.commit(batch_id, at)
    finally:
        stock.unpersist()
        sold.unpersist()


def _write_accounts(ledger: DataFrame, batch_id: int, store: Store, seconds: float) -> None:
    """A8 and A10 of the batch; one without events is completed."""
    this = store.spark.range(1).select(F.lit(batch_id).alias("batch_no"))
    log = accounting.event_log(ledger).withColumn("batch_no", F.lit(batch_id))
    outcome = accounting.batch_outcomes(log, batches=this)
    counted = F.inline(F.array(*[F.struct(F.lit(name).alias("outcome"), F.col(f"{column}_events").alias("count"))
                                 for name, column in (("processed", "successful"), ("failed", "failed"),
                                                      ("duplicate", "duplicate"))]))
    store.write_all(batch_id, {
        "batch_log": outcome.withColumn("processing_time_ms", F.lit(seconds * 1000)),
        "outcomes": outcome.select(counted, F.lit(seconds).alias("seconds")).where("count > 0")})


def _arrival() -> Column:
    """One number that grows with (topic, partition, offset)."""
    topic = F.when(F.col("topic") == SALES_TOPIC, 1).otherwise(0).cast("long")
    return F.shiftleft(topic, 60) + F.shiftleft(F.col("partition").cast("long"), 40) + F.col("offset")


def _fold(stock: DataFrame, sold: DataFrame, batch_id: int, store: Store) -> DataFrame:
    stock_rows = balance.stock_movements(good(stock)).select(
        *ENVELOPE_COLUMNS, "event_id", "product_id", "store_id", "operation", "event_time", "delta", "change_type",
        F.lit(False).alias("must_exist"), F.lit(None).cast("string").alias("sale_id"),
        F.lit(None).cast("decimal(12,2)").alias("sale_price"),
        F.lit(None).cast("long").alias("quantity_sold"))
    sale_rows = sales.sale_movements(good(sold)).select(
        *ENVELOPE_COLUMNS, "event_id", "product_id", "store_id", F.lit("SALE").alias("operation"), "event_time",
        "delta", "change_type", "must_exist", "sale_id", "sale_price", "quantity_sold")
    movements = stock_rows.unionByName(sale_rows)
    # Only what the batch touches leaves the large tables; Spark broadcasts the batch side when it is small.
    pairs = movements.select(*balance.PAIR).distinct()
    opening = store.balances_before(batch_id).join(pairs, list(balance.PAIR), "left_semi")
    used_events = store.before("inventory_history", batch_id).select(F.col("source_event_id").alias("event_id"))
    used_sales = store.before("sales", batch_id).select(F.col("external_sale_id").alias("sale_id"))
    used = {
        "event_id": used_events.join(movements.select("event_id").distinct(), "event_id", "left_semi"),
        "sale_id": used_sales.join(sale_rows.select("sale_id").distinct(), "sale_id", "left_semi"),
    }
    return cut_lineage(balance.fold_movements(movements, order=ORDER, balances=opening, used_ids=used))


def _write_ledger(
    ledger: DataFrame, stock: DataFrame, sold: DataFrame, batch_id: int, store: Store, as_of
) -> None:
    of_stock, of_sales = ledger.where(~F.col("must_exist")), ledger.where("must_exist")
    failures = deadletter.stock_failures(stock, balance.refused(of_stock))
    lost = failures.unionByName(deadletter.sales_failures(sold, balance.refused(of_sales)))
    store.write_all(batch_id, {
        "inventory_history": balance.audit_rows(ledger, as_of, _arrival()),
        "sales": sales.sales_rows(of_sales, F.col("event_time"), _arrival()),
        "balances": _touched(ledger),
        "processed_events": balance.processed_rows(balance.applied(of_stock), order=ORDER, processed_at=as_of),
        "failed_events": deadletter.failed_event_rows(failures, as_of, store.before("failed_events", batch_id)),
        "dlq": deadletter.dlq_messages(lost, as_of),
        "cache": snapshot.latest_state(of_stock, order=ORDER, synced_at=as_of),
    })


def _touched(ledger: DataFrame) -> DataFrame:
    """New balance of every pair the batch changed."""
    return balance.applied(ledger).groupBy(*balance.PAIR).agg(
        F.max_by("quantity_after", F.struct(*ORDER)).alias("quantity"))


def _write_findings(
    ledger: DataFrame, batch_id: int, store: Store, engine: RuleEngine, at: datetime, alert_key: tuple[str, ...]
) -> None:
    """Detection follows applied stock events, as sales alone do not trigger it."""
    as_of = F.lit(at)
    # A sale may carry a time somewhat ahead of the batch that posts it.
    reach = engine.lookback_seconds()
    since = store.since(batch_id, at, None if reach is None else reach + MAX_FUTURE_SKEW_SECONDS)
    of_stock, of_sales = balance.applied(ledger.where(~F.col("must_exist"))), ledger.where("must_exist")
    changes = balance.audit_rows(of_stock, as_of, _arrival())
    stocked = inventory_table(_touched(ledger), as_of)
    keys = stocked.select(F.col("id").alias("inventory_id"))
    # Sales of earlier batches arrived before any change of this one.
    earlier = store.before("sales", batch_id, since).drop("batch_id").withColumn("sequence", F.lit(-1).cast("long"))
    sold = earlier.unionByName(sales.sales_rows(of_sales, F.col("event_time"), _arrival()))
    recorded = store.before("inventory_history", batch_id, since).drop("batch_id").unionByName(
        balance.audit_rows(ledger, as_of, _arrival()))
    context = RuleContext(stocked, sold.join(keys, "inventory_id", "left_semi"),
                          recorded.join(keys, "inventory_id", "left_semi"), as_of)
    found = anomalies.new_anomalies(engine.detect_after(changes, context), store.before("anomalies", batch_id))
    found = cut_lineage(found)
    candidates = alerts.alert_candidates(found)
    if candidates.isEmpty():
        raised = store.spark.createDataFrame([], ALERTS)
    else:
        earlier = store.before("alerts", batch_id)
        if "anomaly_type" in alert_key:
            earlier = earlier.withColumn("anomaly_type", F.regexp_replace("title", f"^{texts.ALERT_TITLE}", ""))
        kept = alerts.deduplicate(candidates, key=alert_key, order=("at", "anomaly_id"), alerts=earlier)
        raised = cut_lineage(alerts.alert_rows(kept))
    store.write_all(batch_id, {
        "anomalies": found, "alerts": raised, "alert_messages": alerts.alert_messages(raised)})
