"""Anomaly rules and the rule engine: N1-N7, P1, P2, J2, J4, J5, T2, A12, A13.

A rule maps a :class:`RuleContext` to findings (inventory_id, anomaly_type, severity, score, description).
``as_of`` plays the part of "now"; none of the windows has an upper bound, so slightly early sales count.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import texts
from ledgerline.functions.columns import severity_above, stable_id
from ledgerline.operators.ordered_fold import HOT_ROWS
from ledgerline.operators.running import running_stats
from ledgerline.operators.trailing import trailing_stats
from ledgerline.session import cut_lineage
from ledgerline.sources.tables import recent

log = logging.getLogger(__name__)

FINDING = ("inventory_id", "anomaly_type", "severity", "score", "description")
_NOTHING = "inventory_id string, anomaly_type string, severity string, score double, description string, rule_no int"
HOUR, SECOND = 3_600_000_000, 1_000_000


@dataclass(frozen=True)
class RuleContext:
    inventory: DataFrame
    sales: DataFrame
    history: DataFrame
    as_of: Column
    #: An inventory with more rows than this is spread over several tasks.
    hot_rows: int = HOT_ROWS


class Rule(Protocol):
    def evaluate(self, context: RuleContext) -> DataFrame: ...


def one_decimal(value: Column) -> Column:
    """One decimal, rounding the exact binary value half to even."""
    return F.regexp_replace(F.format_number(value, 1), ",", "")


def _before(as_of: Column, micros: int) -> Column:
    return F.timestamp_micros(F.unix_micros(as_of) - micros)


def _capped(score: Column) -> Column:
    return F.least(F.lit(100.0), score)


class NegativeInventoryRule:
    """N1. The folds never go below zero; this audits balances written by others."""

    lookback_seconds = 0

    def evaluate(self, context: RuleContext) -> DataFrame:
        return context.inventory.where(F.col("quantity") < 0).select(
            F.col("id").alias("inventory_id"), F.lit(texts.NEGATIVE_INVENTORY[0]).alias("anomaly_type"),
            F.lit("critical").alias("severity"), F.lit(100.0).alias("score"),
            F.format_string(texts.NEGATIVE_INVENTORY[1], "quantity", "sku").alias("description"))


class SuddenSalesSpike:
    """The largest recent sale far exceeds the recent average (which includes it)."""

    def __init__(self, spike_multiplier: float = 5.0, lookback_hours: int = 24, min_prior_sales: int = 5) -> None:
        self.spike_multiplier = float(spike_multiplier)
        self.lookback_hours = lookback_hours
        self.min_prior_sales = min_prior_sales
        self.lookback_seconds = lookback_hours * 3600

    def evaluate(self, context: RuleContext) -> DataFrame:
        window = recent(context.sales, "sold_at", _before(context.as_of, self.lookback_hours * HOUR))
        quantity = F.col("quantity_sold").cast("long")
        stats = window.groupBy("inventory_id").agg(
            F.count(F.lit(1)).alias("window_count"), F.sum(quantity).alias("window_sum"),
            F.max(quantity).alias("window_max"))
        # Detection looks at existing inventory only.
        return self.findings(_of_known(stats, context)).select(*FINDING)

    def after(self, changes: DataFrame, context: RuleContext) -> DataFrame:
        window = recent(context.sales, "sold_at", _before(context.as_of, self.lookback_hours * HOUR))
        return self.findings(_sales_until(changes, window, context.hot_rows))

    def per_event(self, sales: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
        """The rule as of every single sale, seeing sales up to that moment."""
        stats = _sales_windows(sales, self.lookback_hours * HOUR, hot_rows)
        return self.findings(stats)

    def findings(self, stats: DataFrame) -> DataFrame:
        average = F.col("window_sum").cast("double") / F.col("window_count")
        ratio = F.col("window_max") / average
        fired = (F.col("window_count") >= self.min_prior_sales) & (
            F.col("window_max") > average * F.lit(self.spike_multiplier))
        text = F.format_string(texts.SALES_SPIKE[1], "window_max", one_decimal(ratio), one_decimal(average))
        return stats.where(fired).withColumns({
            "anomaly_type": F.lit(texts.SALES_SPIKE[0]), "severity": severity_above(ratio, 10, 7, 5),
            "score": _capped(ratio / F.lit(self.spike_multiplier) * 100), "description": text})


class LargeInventoryAdjustment:
    """The latest recent change is large against the stock before it and the stock now."""

    def __init__(self, adjustment_threshold_percent: float = 50.0, lookback_hours: int = 24) -> None:
        self.adjustment_threshold_percent = float(adjustment_threshold_percent)
        self.lookback_hours = lookback_hours
        self.lookback_seconds = lookback_hours * 3600

    def evaluate(self, context: RuleContext) -> DataFrame:
        window = recent(context.history, "changed_at", _before(context.as_of, self.lookback_hours * HOUR))
        # Changes of one time are told apart by their arrival; the id only makes the choice repeatable.
        arrival = [c for c in ("changed_at", "sequence", "id") if c in window.columns]
        latest = window.groupBy("inventory_id").agg(
            F.max_by(F.struct("quantity_delta", "quantity_before"), F.struct(*arrival)).alias("latest"))
        joined = latest.join(
            context.inventory.select(F.col("id").alias("inventory_id"), F.col("quantity").alias("current")),
            "inventory_id")
        changes = joined.select("inventory_id", "latest.quantity_delta", "latest.quantity_before", "current")
        return self.findings(changes).select(*FINDING)

    def per_change(self, history: DataFrame) -> DataFrame:
        """The rule as of every recorded change: the stock then is the quantity after it, so no window is needed."""
        return self.findings(history.withColumn("current", F.col("quantity_after")))

    def findings(self, changes: DataFrame) -> DataFrame:
        amount, before, current = F.abs("quantity_delta"), F.col("quantity_before"), F.col("current")
        percent = amount / F.greatest(F.abs(before), F.abs(current), F.lit(1)) * 100
        text = F.format_string(texts.LARGE_ADJUSTMENT[1], amount, one_decimal(percent), before, current)
        return changes.where(percent > F.lit(self.adjustment_threshold_percent)).withColumns({
            "anomaly_type": F.lit(texts.LARGE_ADJUSTMENT[0]), "severity": severity_above(percent, 150, 100, 75),
            "score": _capped(percent), "description": text})


class RapidConsecutiveSales:
    """Many sales within a short time."""

    def __init__(self, transaction_count: int = 5, time_window_seconds: int = 60) -> None:
        self.transaction_count = transaction_count
        self.time_window_seconds = time_window_seconds
        self.lookback_seconds = time_window_seconds

    def evaluate(self, context: RuleContext) -> DataFrame:
        window = recent(context.sales, "sold_at", _before(context.as_of, self.time_window_seconds * SECOND))
        stats = window.groupBy("inventory_id").agg(
            F.count(F.lit(1)).alias("window_count"), F.sum(F.col("quantity_sold").cast("long")).alias("window_sum"))
        return self.findings(_of_known(stats, context)).select(*FINDING)

    def after(self, changes: DataFrame, context: RuleContext) -> DataFrame:
        window = recent(context.sales, "sold_at", _before(context.as_of, self.time_window_seconds * SECOND))
        return self.findings(_sales_until(changes, window, context.hot_rows))

    def per_event(self, sales: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
        stats = _sales_windows(sales, self.time_window_seconds * SECOND, hot_rows)
        return self.findings(stats)

    def findings(self, stats: DataFrame) -> DataFrame:
        count = F.col("window_count")
        text = F.format_string(texts.RAPID_SALES[1], count, "window_sum", F.lit(self.time_window_seconds))
        return stats.where(count >= self.transaction_count).withColumns({
            "anomaly_type": F.lit(texts.RAPID_SALES[0]), "severity": severity_above(count, 15, 10, 7),
            "score": _capped(count / F.lit(float(self.transaction_count)) * 100), "description": text})


def _sales_until(changes: DataFrame, window: DataFrame, hot_rows: int) -> DataFrame:
    """For each change the sales of ``window`` that arrived up to it: running aggregates, as all see one lower bound."""
    facts = window.select("inventory_id", "sequence", F.col("quantity_sold").cast("long").alias("_units"))
    asks = changes.select("inventory_id", "sequence", "event_id", F.lit(True).alias("_asks"))
    # Slim and fixed, because sizes are counted before the rows are read.
    both = cut_lineage(facts.unionByName(asks, allowMissingColumns=True))
    return running_stats(both, key=["inventory_id"], order=["sequence"], hot_rows=hot_rows, measures={
        "window_count": ("count", "_units"), "window_sum": ("sum", "_units"), "window_max": ("max", "_units"),
    }).where("_asks")


def _of_known(stats: DataFrame, context: RuleContext) -> DataFrame:
    return stats.join(context.inventory.select(F.col("id").alias("inventory_id")), "inventory_id", "left_semi")


def _sales_windows(sales: DataFrame, lookback: int, hot_rows: int) -> DataFrame:
    timed = sales.withColumns({"_at": F.unix_micros("sold_at"), "_units": F.col("quantity_sold").cast("long")})
    return trailing_stats(timed, key=["inventory_id"], at="_at", value="_units", lookback_micros=lookback,
                          hot_rows=hot_rows).drop("_at", "_units")


def default_rules() -> list[Rule]:
    return [NegativeInventoryRule(), SuddenSalesSpike(), LargeInventoryAdjustment(), RapidConsecutiveSales()]


class RuleEngine:
    """N5 + P2: an ordered rule list. An empty list means the default rules.

    A rule may say with ``lookback_seconds`` how far back it looks; a rule that does not may look at everything.

    A rule that cannot be planned is skipped. With ``isolate`` each rule's findings are computed and written apart, so a
    rule that fails while it runs is skipped as well and the others are delivered; without, findings stay lazy and such
    an error fails the run. ``failures`` tells which rules the last detection skipped.
    """

    def __init__(self, rules: Sequence[Rule] | None = None, isolate: bool = False) -> None:
        self.rules = list(rules or default_rules())
        self.isolate = isolate
        self.failed: list[tuple[int, str, str]] = []

    def add_rule(self, rule: Rule) -> None:
        self.rules.append(rule)

    def remove_rule(self, rule_type: type) -> bool:
        """Remove the first rule of this type; False when there is none."""
        for position, rule in enumerate(self.rules):
            if isinstance(rule, rule_type):
                del self.rules[position]
                return True
        return False

    def lookback_seconds(self) -> int | None:
        """How far back the rules look, None without a bound."""
        bounds = [getattr(rule, "lookback_seconds", None) for rule in self.rules]
        return None if None in bounds else max(bounds)

    def failures(self, spark: SparkSession) -> DataFrame:
        """(rule_no, rule, error) of the rules that the last detection skipped."""
        return spark.createDataFrame(self.failed, "rule_no int, rule string, error string")

    def _each(self, found_by: Callable[[Rule], DataFrame], *columns: str) -> list[DataFrame]:
        """Findings of each rule that works, with ``columns`` and ``rule_no``."""
        parts, self.failed = [], []
        for position, rule in enumerate(self.rules):
            try:
                found = found_by(rule).select(*FINDING, *columns, F.lit(position).alias("rule_no"))
                parts.append(cut_lineage(found) if self.isolate else found)
            except Exception as error:  # a broken custom rule must not stop the others
                log.exception("anomaly rule %s skipped", type(rule).__name__)
                self.failed.append((position, type(rule).__name__, str(error).strip().split("\n")[0]))
        return parts

    def findings(self, context: RuleContext) -> DataFrame:
        """Findings of all rules with ``rule_no``, their place in the list."""
        parts = self._each(lambda rule: rule.evaluate(context))
        if not parts:
            return context.inventory.sparkSession.createDataFrame([], _NOTHING)
        return reduce(DataFrame.unionByName, parts)

    def detect(self, context: RuleContext, event_ids: DataFrame | None = None) -> DataFrame:
        """Open anomalies. ``event_ids`` (inventory_id, event_id) restricts detection to triggering events."""
        found = self.findings(context).where(F.col("anomaly_type").isNotNull() & F.col("severity").isNotNull())
        if event_ids is None:
            found = found.withColumn("event_id", F.lit(None).cast("string"))
        else:
            found = found.join(event_ids.select("inventory_id", "event_id"), "inventory_id")
        return anomaly_rows(found, context.as_of)

    def detect_after(self, changes: DataFrame, context: RuleContext) -> DataFrame:
        """Open anomalies right after each applied event in ``changes`` (audit rows).

        Rules that only need the change itself offer ``per_change``. Rules over sales offer ``after`` and see the sales
        that arrived up to each change, if changes and sales carry their arrival as ``sequence``. Other rules look at
        the tables, which are the same for all events of one run.
        """
        in_order = "sequence" in changes.columns and "sequence" in context.sales.columns
        events = changes.select("inventory_id", F.col("source_event_id").alias("event_id"))
        tagged = changes.withColumn("event_id", F.col("source_event_id"))

        def found_by(rule: Rule) -> DataFrame:
            if hasattr(rule, "per_change"):
                return rule.per_change(tagged)
            if in_order and hasattr(rule, "after"):
                return rule.after(tagged, context)
            return rule.evaluate(context).select(*FINDING).join(events, "inventory_id")

        parts = self._each(found_by, "event_id")
        merged = reduce(DataFrame.unionByName, parts) if parts else changes.sparkSession.createDataFrame(
            [], _NOTHING + ", event_id string")
        return anomaly_rows(merged.where(F.col("anomaly_type").isNotNull() & F.col("severity").isNotNull()),
                            context.as_of)


def anomaly_rows(findings: DataFrame, detected_at: Column) -> DataFrame:
    """Findings in the shape of the anomalies table, plus ``rule_no`` when the engine set it."""
    trigger = F.coalesce("event_id", F.concat(F.lit("at:"), F.unix_micros(detected_at).cast("string")))
    extra = ["rule_no"] if "rule_no" in findings.columns else []
    return findings.select(
        stable_id(F.lit("anomaly"), "inventory_id", trigger, "anomaly_type").alias("id"), "inventory_id", "event_id",
        "anomaly_type", "severity", "score", F.lit("open").alias("status"), "description",
        detected_at.alias("detected_at"), F.lit(None).cast("timestamp").alias("resolved_at"), *extra)
