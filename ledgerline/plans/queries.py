"""Every operator as a query over the shared tables: name -> callable(spark, sf_dir) -> DataFrame.

Times leave as microseconds so that results compare exactly with the SQL twins in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import validation
from ledgerline.functions.columns import inventory_id
from ledgerline.operators import (accounting, alerts, anomalies, balance, cascade, deadletter, paging, reconcile,
                                  rules, sales, snapshot)
from ledgerline.operators.balance import apply_stock_events
from ledgerline.session import cut_lineage
from ledgerline.sources import domain, samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPIKE = rules.SuddenSalesSpike(spike_multiplier=3.0, lookback_hours=120, min_prior_sales=5)
RAPID = rules.RapidConsecutiveSales(transaction_count=5, time_window_seconds=86_400)
ADJUSTMENT = rules.LargeInventoryAdjustment(lookback_hours=120)
PAIR = ("product_id", "store_id")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def micros(name: str) -> Column:
    return F.unix_micros(name).alias(name)


# -- stock events and balances -----------------------------------------------------------------------------------


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_stock_events(domain.stock_events(spark, sf_dir), order=domain.EVENT_ORDER)


@query
def guarded_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).select(
        "event_id", *PAIR, "operation", F.col("quantity").cast("long").alias("quantity"), "status",
        "quantity_before", "quantity_after", "quantity_delta")


@query
def balances_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.balances_after(_ledger(spark, sf_dir))


@query
def rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.refused(_ledger(spark, sf_dir)).select("event_id", "quantity_before", "delta", "reason")


@query
def duplicate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event arrives twice; a repeat is a duplicate only if its first delivery was applied."""
    twice = samples.replayed(domain.stock_events(spark, sf_dir))
    ledger = apply_stock_events(twice, order=[*domain.EVENT_ORDER, "copy"])
    return ledger.where("copy = 1").select("event_id", "status", "quantity_before", "quantity_after", "quantity_delta")


@query
def contested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth id comes up a second time, mostly for another key, and often after it was refused."""
    events = domain.stock_events(spark, sf_dir)
    again = F.col("event_no") - F.when(F.col("event_no") % 20 == 1, 1).otherwise(0)
    events = events.withColumn("event_id", domain.numbered_uuid("00000000-0000-4000-8000-", again))
    return apply_stock_events(events, order=domain.EVENT_ORDER).select(
        "event_no", "event_id", "status", "quantity_before", "quantity_after")


@query
def audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.audit_rows(_ledger(spark, sf_dir), F.col("ts")).withColumn("changed_at", F.unix_micros("changed_at"))


@query
def opening_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run on top of an earlier one: stock, history ids and new balances carry over."""
    events = domain.stock_events(spark, sf_dir)
    first = apply_stock_events(events.where("event_no % 2 = 0"), order=domain.EVENT_ORDER)
    carried = balance.balances_after(first)
    history = balance.audit_rows(first, F.col("ts"))
    second = apply_stock_events(events, order=domain.EVENT_ORDER, balances=carried, history=history)
    return second.select("event_id", "status", "quantity_before", "quantity_after")


def _twentieth(rows: DataFrame) -> int:
    return max(1, rows.count() // 20)


@query
def store_balance_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One balance per store: few keys with very many rows, folded as about forty segments."""
    events = domain.stock_events(spark, sf_dir).withColumn("product_id", F.lit("ALL"))
    ledger = apply_stock_events(events, order=domain.EVENT_ORDER, hot_rows=_twentieth(events))
    return ledger.select("event_id", "store_id", "status", "quantity_before", "quantity_after")


@query
def processed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = samples.replayed(domain.stock_events(spark, sf_dir))
    stored = domain.stock_events(spark, sf_dir).where("event_no % 10 = 3").select("event_id")
    rows = balance.processed_rows(events, order=["ts", "copy"], processed_at=F.col("ts"), processed=stored)
    return rows.withColumn("processed_at", F.unix_micros("processed_at"))


@query
def processed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = domain.stock_events(spark, sf_dir)
    fresh, seen = balance.split_processed(events, events.where("event_no % 10 = 3"))
    return fresh.select("event_id", F.lit("fresh").alias("outcome")).unionByName(
        seen.select("event_id", F.lit("duplicate").alias("outcome")))


# -- validation and dead letter ----------------------------------------------------------------------------------


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate_stock_events(samples.envelopes(spark, sf_dir), samples.as_of())


@query
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select(
        F.col("offset").alias("source_offset"), "event_id", "operation", "quantity", micros("event_time"),
        "failure_reason", "detail", "claimed_event_id")


@query
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.reason_counts(_validated(spark, sf_dir))


def _valid_ledger(validated: DataFrame) -> DataFrame:
    return apply_stock_events(validation.good(validated), order=["event_time", "offset"])


@query
def dlq_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read by the fold, its size checks and the invalid branch: parse once.
    validated = cut_lineage(_validated(spark, sf_dir))
    failures = deadletter.stock_failures(validated, balance.refused(_valid_ledger(validated)))
    messages = deadletter.dlq_messages(failures, samples.as_of())
    fields = ("event_id", "failure_reason", "retry_count", "timestamp", "source_topic", "source_partition",
              "source_offset", "payload")
    return messages.select("key", *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])


@query
def failed_event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failure is written twice; the first write counts, although the reason of the second sorts before it."""
    failures = deadletter.stock_failures(_validated(spark, sf_dir))
    again = failures.withColumn("failure_reason", F.concat(F.lit("!"), "failure_reason"))
    twice = failures.withColumn("attempt", F.lit(0)).unionByName(again.withColumn("attempt", F.lit(1)))
    stored = failures.where("source_offset % 10 = 0")
    rows = deadletter.failed_event_rows(twice, samples.as_of(), stored, order=["attempt"])
    return rows.withColumn("failed_at", F.unix_micros("failed_at"))


def _validated_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate_sales_events(samples.sales_envelopes(spark, sf_dir), samples.as_of())


@query
def validate_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated_sales(spark, sf_dir).select(
        F.col("offset").alias("source_offset"), "event_id", "sale_id", *PAIR, "quantity_sold",
        F.col("sale_price").cast("decimal(38,2)").alias("sale_price"), micros("event_time"), "failure_reason", "detail",
        "claimed_event_id")


@query
def sales_failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.reason_counts(_validated_sales(spark, sf_dir))


@query
def sales_dlq_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages for invalid sales; they carry no event id, so their key is the place of the record."""
    failures = deadletter.sales_failures(_validated_sales(spark, sf_dir))
    messages = deadletter.dlq_messages(failures, samples.as_of())
    fields = ("event_id", "failure_reason", "retry_count", "source_topic", "source_partition", "source_offset")
    return messages.select("key", *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])


# -- sales -------------------------------------------------------------------------------------------------------


def _sales_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.post_sales(domain.sales_events(spark, sf_dir), order=domain.SALE_ORDER,
                            balances=domain.opening_stock(spark, sf_dir))


def _stocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.inventory_table(domain.opening_stock(spark, sf_dir), samples.as_of())


def _posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.sales_rows(_sales_ledger(spark, sf_dir), F.col("sold_at"))


@query
def post_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sales_ledger(spark, sf_dir).select(
        "sale_id", *PAIR, "l_partkey", "l_suppkey", "quantity_sold", micros("sold_at"), "status", "quantity_before",
        "quantity_after")


@query
def refused_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.refused(_sales_ledger(spark, sf_dir)).groupBy("status", "reason").agg(
        F.count(F.lit(1)).alias("sales"))


@query
def duplicate_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.duplicate_sales(_sales_ledger(spark, sf_dir)).select(
        "sale_id", "l_partkey", "l_suppkey", micros("sold_at"), "quantity_sold", "original_quantity",
        F.col("original_price").cast("decimal(38,2)").alias("original_price"), "sales_record_id")


@query
def sales_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.sales_summary(_stocked(spark, sf_dir), _posted(spark, sf_dir))


@query
def sales_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.sales_items(_stocked(spark, sf_dir), _posted(spark, sf_dir)).select(
        *PAIR, "id", "inventory_id", "quantity_sold", F.col("sale_price").cast("decimal(38,2)").alias("sale_price"),
        "external_sale_id", micros("sold_at"))


@query
def sales_items_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posted sales, newest first within each pair, with their place in the pair's listing."""
    items = sales.sales_items(_stocked(spark, sf_dir), _posted(spark, sf_dir))
    return sales.newest_first(items).select(*PAIR, "place", "id", micros("sold_at"))


# -- reconciliation ----------------------------------------------------------------------------------------------


def _reconciled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    changes = samples.recorded_changes(spark, sf_dir)
    inventory = domain.inventory_table(samples.drifted_inventory(changes), samples.as_of())
    pairs = changes.select(*PAIR).distinct()
    return reconcile.reconcile(pairs, inventory, changes), changes


@query
def reconcile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir)[0]


def _earlier_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two earlier runs: product numbers divisible by 4 were never reconciled, odd ones matched before."""
    results, _ = _reconciled(spark, sf_dir)
    number = F.regexp_extract("product_id", r"(\d+)$", 1).cast("long")
    old = results.where(number % 4 != 0)
    runs = [
        old.withColumn("reconciled_at", F.timestamp_micros(F.lit(samples.AS_OF_MICROS - 2 * rules.HOUR))),
        old.withColumns({
            "difference": F.when(number % 2 == 1, F.lit(0)).otherwise(F.col("difference")),
            "status": F.when(number % 2 == 1, "match").otherwise(F.col("status")),
            "reconciled_at": F.timestamp_micros(F.lit(samples.AS_OF_MICROS - rules.HOUR))}),
    ]
    return reconcile.record_rows(runs[0].unionByName(runs[1]))


@query
def reconcile_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = _reconciled(spark, sf_dir)
    report, _ = reconcile.changed_results(results, _earlier_records(spark, sf_dir), samples.as_of())
    return report.withColumn("reconciled_at", F.unix_micros("reconciled_at"))


@query
def reconciliation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = _reconciled(spark, sf_dir)
    _, rows = reconcile.changed_results(results, _earlier_records(spark, sf_dir), samples.as_of())
    return rows.select("id", "store_id", "product_id", "expected_quantity", "actual_quantity", "difference", "status",
                       micros("reconciled_at"))


@query
def latest_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = reconcile.latest_records(_earlier_records(spark, sf_dir))
    return latest.select("store_id", "product_id", "latest.status", "latest.difference",
                         F.unix_micros("latest.reconciled_at").alias("reconciled_at"))


# -- rules -------------------------------------------------------------------------------------------------------


def _event_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SALE events as rows of the sales table."""
    return domain.stock_events(spark, sf_dir).where("operation = 'SALE'").select(
        F.col("event_id").alias("id"), inventory_id("store_id", "product_id").alias("inventory_id"), "event_id",
        F.col("quantity").alias("quantity_sold"), F.col("ts").alias("sold_at"), "event_no", "store_id")


def _context(spark: SparkSession, sf_dir: str) -> rules.RuleContext:
    """Rules as of the end of the data, over the guarded ledger."""
    ledger = _ledger(spark, sf_dir)
    inventory = domain.inventory_table(balance.balances_after(ledger), samples.as_of())
    return rules.RuleContext(inventory, _event_sales(spark, sf_dir), balance.audit_rows(ledger, F.col("ts")),
                             samples.as_of())


def _plain_context(spark: SparkSession, sf_dir: str) -> rules.RuleContext:
    changes = samples.recorded_changes(spark, sf_dir)
    inventory = domain.inventory_table(samples.drifted_inventory(changes), samples.as_of())
    return rules.RuleContext(inventory, _event_sales(spark, sf_dir), changes, samples.as_of())


@query
def rule_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.NegativeInventoryRule().evaluate(_plain_context(spark, sf_dir))


@query
def rule_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SPIKE.evaluate(_plain_context(spark, sf_dir))


@query
def rule_spike_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = SPIKE.per_event(_event_sales(spark, sf_dir))
    return found.select("event_id", *rules.FINDING)


@query
def rule_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes of a day carry one processing time, so that their arrival decides which is the latest."""
    ledger = _ledger(spark, sf_dir)
    history = balance.audit_rows(ledger, F.date_trunc("day", "ts"), F.col("event_no"))
    inventory = domain.inventory_table(balance.balances_after(ledger), samples.as_of())
    return ADJUSTMENT.evaluate(rules.RuleContext(inventory, history.limit(0), history, samples.as_of()))


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = balance.audit_rows(_ledger(spark, sf_dir), F.col("ts"))
    return ADJUSTMENT.per_change(history.withColumn("event_id", F.col("source_event_id")))


@query
def rule_adjustment_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjusted(spark, sf_dir).select("event_id", *rules.FINDING)


@query
def rule_rapid(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rules.RapidConsecutiveSales(transaction_count=5, time_window_seconds=5 * 86_400)
    return wide.evaluate(_plain_context(spark, sf_dir))


@query
def rule_rapid_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = RAPID.per_event(_event_sales(spark, sf_dir))
    return found.select("event_id", *rules.FINDING)


@query
def trailing_sales_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 24 hours of sales per store: few keys with very many rows, cut into time slots."""
    by_store = _event_sales(spark, sf_dir).withColumns({
        "at": F.unix_micros("sold_at"), "units": F.col("quantity_sold").cast("long")})
    stats = rules.trailing_stats(by_store, key=["store_id"], at="at", value="units", lookback_micros=24 * rules.HOUR,
                                 hot_rows=_twentieth(by_store))
    return stats.select("event_id", "store_id", "window_count", "window_sum", "window_max")


def _engine() -> rules.RuleEngine:
    engine = rules.RuleEngine([rules.NegativeInventoryRule(), SPIKE, ADJUSTMENT])
    engine.add_rule(RAPID)
    return engine


@query
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine().detect(_context(spark, sf_dir))
    return found.withColumn("detected_at", F.unix_micros("detected_at")).drop("event_id", "resolved_at")


@query
def detect_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection right after each applied event: rules over sales see those up to the event."""
    ledger = _ledger(spark, sf_dir)
    inventory = domain.inventory_table(balance.balances_after(ledger), samples.as_of())
    history = balance.audit_rows(ledger, F.col("ts"), F.col("event_no"))
    sold = _event_sales(spark, sf_dir).withColumn("sequence", F.col("event_no"))
    context = rules.RuleContext(inventory, sold, history, samples.as_of())
    return _engine().detect_after(history, context).select(
        "id", "inventory_id", "event_id", "anomaly_type", "severity", "score", "description", "rule_no")


class StockOut:
    """An example of a rule of one's own: nothing left in stock."""

    def evaluate(self, context: rules.RuleContext) -> DataFrame:
        return context.inventory.where("quantity = 0").select(
            F.col("id").alias("inventory_id"), F.lit("stock_out").alias("anomaly_type"), F.lit("high").alias("severity"),
            F.lit(50.0).alias("score"), F.concat(F.lit("Nothing left of "), F.col("sku")).alias("description"))


@query
def custom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine()
    engine.remove_rule(rules.SuddenSalesSpike)
    engine.remove_rule(rules.RapidConsecutiveSales)
    engine.add_rule(StockOut())
    return engine.findings(_context(spark, sf_dir)).select(*rules.FINDING)


# -- anomalies and alerts ----------------------------------------------------------------------------------------


def _event_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What detection finds right after every event."""
    sold = _event_sales(spark, sf_dir)
    parts = [
        SPIKE.per_event(sold).withColumn("at", F.col("sold_at")),
        _adjusted(spark, sf_dir).withColumn("at", F.col("changed_at")),
        RAPID.per_event(sold).withColumn("at", F.col("sold_at")),
    ]
    shaped = [p.select(*rules.FINDING, "event_id", "at", F.lit(i).alias("rule_no")) for i, p in enumerate(parts)]
    return rules.anomaly_rows(shaped[0].unionByName(shaped[1]).unionByName(shaped[2]), F.col("at"))


@query
def new_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected anomalies without those stored before; an event keeps one anomaly per rule."""
    found = _event_anomalies(spark, sf_dir)
    stored = domain.stock_events(spark, sf_dir).where("event_no % 3 = 0").select(
        "event_id", F.lit("large_inventory_adjustment").alias("anomaly_type"))
    return anomalies.new_anomalies(found, stored).select("id", "event_id", "anomaly_type", "severity", "score")


@query
def new_anomalies_one_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _event_anomalies(spark, sf_dir)
    return anomalies.new_anomalies(found, one_per_event=True).select("id", "event_id", "anomaly_type", "severity")


@query
def alerts_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    severe = alerts.alert_candidates(samples.anomalies(spark, sf_dir))
    return severe.withColumn("at", F.unix_micros("at")).drop("anomaly_type")


def _raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    severe = alerts.alert_candidates(samples.anomalies(spark, sf_dir))
    return alerts.deduplicate(severe, key=["inventory_id"], window_seconds=2 * 86_400)


@query
def alerts_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raised(spark, sf_dir).select("anomaly_id", "created", micros("triggered_at"))


@query
def alerts_dedup_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One suppression key per severity: few keys with very many rows."""
    severe = alerts.alert_candidates(samples.anomalies(spark, sf_dir))
    kept = alerts.deduplicate(severe, key=["severity"], window_seconds=7200, hot_rows=_twentieth(severe))
    return kept.select("anomaly_id", "created", micros("triggered_at"))


@query
def alerts_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_rows(_raised(spark, sf_dir)).select(
        "id", "anomaly_id", "inventory_id", "event_id", "severity", "status", "title", micros("triggered_at"))


@query
def alerts_dedup_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats are also suppressed by unresolved alerts raised before, here those of the first eight days."""
    limit = F.timestamp_micros(F.lit(samples.AS_OF_MICROS - 23 * 24 * rules.HOUR))
    severe = alerts.alert_candidates(samples.anomalies(spark, sf_dir)).where(F.col("at") >= limit)
    stored = samples.alerts(spark, sf_dir).where(F.col("triggered_at") < limit)
    kept = alerts.deduplicate(severe, key=["inventory_id"], window_seconds=2 * 86_400, alerts=stored)
    return kept.select("anomaly_id", "created", micros("triggered_at"))


@query
def alert_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated, _ = alerts.apply_commands(samples.alerts(spark, sf_dir), samples.alert_commands(spark, sf_dir))
    return updated.select("id", "status", micros("acknowledged_at"), "acknowledged_by", micros("resolved_at"),
                          micros("suppressed_until"), micros("updated_at"))


@query
def alert_commands_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, unknown = alerts.apply_commands(samples.alerts(spark, sf_dir), samples.alert_commands(spark, sf_dir))
    return unknown.select("seq", "target_id", "command")


@query
def anomaly_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated, _ = anomalies.apply_status_changes(samples.anomalies(spark, sf_dir), samples.anomaly_commands(spark, sf_dir))
    return updated.select("id", "status", micros("resolved_at"))


@query
def alert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_stats(samples.alerts(spark, sf_dir))


@query
def anomaly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.anomaly_stats(samples.anomalies(spark, sf_dir))


@query
def anomaly_stats_with_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics with one row per entry of their type map."""
    stats = anomalies.anomaly_stats_with_types(samples.anomalies(spark, sf_dir))
    return stats.select("total", "open", "critical", F.explode("anomaly_types_count").alias("anomaly_type", "anomalies"))


@query
def anomaly_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.anomaly_type_counts(samples.anomalies(spark, sf_dir))


@query
def list_anomalies_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = paging.matching(samples.anomalies(spark, sf_dir), severity="critical", status="open", anomaly_type=None)
    return paging.page_with_total(wanted, "detected_at", skip=10, limit=15).select(
        "id", "anomaly_type", micros("detected_at"), "total", "count", "skip", "limit")


@query
def list_anomalies_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page behind the last row still tells the total."""
    wanted = paging.matching(samples.anomalies(spark, sf_dir), severity="critical", status="open", anomaly_type=None)
    return paging.page_with_total(wanted, "detected_at", skip=10_000_000, limit=15).select(
        "id", "anomaly_type", "total", "count", "skip", "limit")


@query
def list_alerts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = paging.matching(samples.alerts(spark, sf_dir), severity="high", status="", anomaly_id=None)
    return paging.page_with_total(wanted, "triggered_at").select("id", "status", micros("triggered_at"), "total")


@query
def anomalies_by_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open anomalies of one product in one store."""
    wanted = inventory_id(F.lit("STORE-3"), F.lit("SKU-3"))
    return paging.anomalies_of(samples.anomalies(spark, sf_dir), wanted, "open").select("id", micros("detected_at"))


@query
def anomaly_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = samples.anomalies(spark, sf_dir)
    return paging.by_id(stored, "00000000-0000-4000-a000-000000000000").select("id", "event_id", "severity", "score")


@query
def alert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert that is there and one that is not, which gives no row."""
    stored = samples.alerts(spark, sf_dir)
    there = stored.agg(F.min("id").alias("id"))
    parts = [paging.by_id(stored.join(F.broadcast(there), "id"), F.col("id")), paging.by_id(stored, "missing")]
    return parts[0].unionByName(parts[1]).select("id", "anomaly_id", "status", micros("triggered_at"))


@query
def alert_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every alert in the newest-first listing, the way deep pages are found."""
    placed = paging.positions(samples.alerts(spark, sf_dir), [F.desc("triggered_at"), F.asc("id")])
    return placed.select("id", "position")


@query
def latest_open_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.latest_open(samples.alerts(spark, sf_dir)).select("anomaly_id", "id", "status", micros("triggered_at"))


@query
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in each table after deleting the inventory rows of one store."""
    changes = samples.recorded_changes(spark, sf_dir)
    inventory = domain.inventory_table(samples.drifted_inventory(changes), samples.as_of())
    tables = {"inventory": inventory, "inventory_history": changes, "sales": _event_sales(spark, sf_dir),
              "anomalies": samples.anomalies(spark, sf_dir), "alerts": samples.alerts(spark, sf_dir)}
    left = cascade.delete_inventory(tables, inventory.where("warehouse_id = 'STORE-2'"))
    parts = [left[name].select(F.lit(name).alias("table_name"), "id") for name in tables]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


@query
def cascade_delete_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = samples.anomalies(spark, sf_dir)
    left = cascade.delete_anomalies({"anomalies": stored, "alerts": samples.alerts(spark, sf_dir)},
                                    stored.where("severity = 'low'"))
    return left["anomalies"].select(F.lit("anomalies").alias("table_name"), "id").unionByName(
        left["alerts"].select(F.lit("alerts").alias("table_name"), "id"))


@query
def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = alerts.alert_messages(samples.alerts(spark, sf_dir))
    return messages.select("key", *[F.get_json_object("value", f"$.{f}").alias(f) for f in alerts.MESSAGE])


@query
def stale_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.timestamp_micros(F.lit(samples.AS_OF_MICROS - 10 * 24 * rules.HOUR))
    return alerts.stale_alerts(samples.alerts(spark, sf_dir), limit).select("id", micros("triggered_at"))


@query
def effective_alert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.effective_status(samples.alerts(spark, sf_dir), samples.as_of()).select("id", "status", "effective_status")


# -- snapshot ----------------------------------------------------------------------------------------------------


@query
def latest_state_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = snapshot.latest_state(_ledger(spark, sf_dir), order=domain.EVENT_ORDER, synced_at=samples.as_of())
    fields = ("product_id", "store_id", "quantity", "operation", "source_event_id", "synced_at")
    return entries.select("key", *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])


@query
def kv_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = snapshot.apply_operations(samples.cache_entries(spark, sf_dir), samples.cache_operations(spark, sf_dir),
                                      samples.as_of())
    return after.withColumn("expires_at", F.unix_micros("expires_at"))


@query
def kv_operation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.operation_counts(samples.cache_entries(spark, sf_dir), samples.cache_operations(spark, sf_dir),
                                     samples.as_of())


def _every_second_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = domain.read(spark, sf_dir, "events").select((F.col("user_id") * 2).alias("n")).distinct()
    return users.select(F.concat(F.lit("inventory:"), F.col("n").cast("string")).alias("key"))


@query
def kv_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.delete_keys(samples.cache_entries(spark, sf_dir), _every_second_key(spark, sf_dir)).select("key", "value")


@query
def kv_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key is listed twice; every fourth entry has expired."""
    keys = _every_second_key(spark, sf_dir)
    return snapshot.delete_counts(samples.cache_entries(spark, sf_dir), keys.unionByName(keys), samples.as_of())


@query
def kv_get_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked_up = snapshot.get_keys(samples.cache_entries(spark, sf_dir), _every_second_key(spark, sf_dir), samples.as_of())
    return snapshot.get_counts(looked_up)


@query
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.get_keys(samples.cache_entries(spark, sf_dir), _every_second_key(spark, sf_dir), samples.as_of())


@query
def kv_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _every_second_key(spark, sf_dir).withColumn("value", F.lit("new"))
    after = snapshot.overwrite_keys(samples.cache_entries(spark, sf_dir), entries)
    return after.withColumn("expires_at", F.unix_micros("expires_at"))


# -- accounting --------------------------------------------------------------------------------------------------


def _batched_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = domain.read(spark, sf_dir, "events").select(F.col("event_id").alias("event_no"), "value")
    log = accounting.event_log(_ledger(spark, sf_dir)).join(raw, "event_no")
    return accounting.cut_batches(log, domain.EVENT_ORDER)


@query
def batch_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.cut_batches(domain.stock_events(spark, sf_dir), domain.EVENT_ORDER, 64).select("event_id", "batch_no")


@query
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.batch_outcomes(_batched_log(spark, sf_dir))


@query
def batch_outcomes_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third batch of the log left empty: an empty batch is completed."""
    log = _batched_log(spark, sf_dir)
    batches = log.select("batch_no").distinct()
    return accounting.batch_outcomes(log.where("batch_no % 3 != 0"), batches=batches)


@query
def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.batch_errors(_batched_log(spark, sf_dir))


@query
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _batched_log(spark, sf_dir)
    operations = domain.read(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "click", "redis").otherwise("database").alias("kind"),
        (F.col("event_id") % 13 != 0).alias("success"))
    return accounting.batch_metrics(accounting.batch_outcomes(log, time_ms="value"), operations)


@query
def outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = domain.read(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "retried")
        .otherwise("processed").alias("outcome"), (F.col("event_id") % 4 - 1).alias("count"))
    return accounting.outcome_counters(outcomes)


@query
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = domain.read(spark, sf_dir, "events").select(
        F.col("event_type").alias("outcome"), (F.col("value") / 10).alias("seconds"))
    return accounting.duration_histogram(seen).withColumn("duration_sum", F.round("duration_sum", 2))
