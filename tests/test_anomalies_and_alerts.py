"""Rules, alerts, listings and cascades on small hand-made cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import alerts, anomalies, cascade, paging, rules
from ledgerline.schemas import ALERTS, ANOMALIES, INVENTORY, INVENTORY_HISTORY, SALES

T0 = datetime(2026, 7, 13, 10)


def context(spark, quantity=100, sold=(), changes=()):
    inventory = spark.createDataFrame([("I", "SKU", "W", quantity, 0, True, T0, T0)], INVENTORY)
    sales = spark.createDataFrame([(str(i), "I", n, None, str(i), T0 - timedelta(seconds=ago))
                                   for i, (n, ago) in enumerate(sold)], SALES)
    history = spark.createDataFrame([(str(i), "I", "adjustment", before, before + delta, delta, str(i),
                                      T0 - timedelta(seconds=ago)) for i, (before, delta, ago) in enumerate(changes)],
                                    INVENTORY_HISTORY)
    return rules.RuleContext(inventory, sales, history, F.lit(T0))


def found(rule, ctx):
    return [(r["anomaly_type"], r["severity"], round(r["score"], 2), r["description"]) for r in rule.evaluate(ctx).collect()]


def test_negative_inventory(spark):
    assert found(rules.NegativeInventoryRule(), context(spark, -5)) == [
        ("negative_inventory", "critical", 100.0, "Negative inventory detected: -5 units for SKU SKU")]
    assert found(rules.NegativeInventoryRule(), context(spark, 0)) == []


def test_sales_spike(spark):
    rule = rules.SuddenSalesSpike()
    ten_twos = [(2, 100 + i) for i in range(10)]
    assert found(rule, context(spark, sold=[*ten_twos, (20, 5)])) == [
        ("sudden_sales_spike", "medium", 100.0,
         "Sales spike detected: maximum sale 20 units is 5.5x the average of 3.6 units")]
    assert found(rule, context(spark, sold=[(2, 1), (2, 2), (2, 3), (90, 4)])) == []
    # The window has no upper bound, and its lower bound counts.
    edge = [(1, 24 * 3600), (1, -200), *[(1, 9)] * 20, (40, 1)]
    assert found(rule, context(spark, sold=edge))[0][1] == "critical"


def test_large_adjustment(spark):
    rule = rules.LargeInventoryAdjustment()
    assert found(rule, context(spark, 30, changes=[(100, -70, 60), (10, 500, 90_000)])) == [
        ("large_inventory_adjustment", "low", 70.0, "Large adjustment detected: 70 units (70.0%) from 100 to 30 units")]
    assert found(rule, context(spark, 50, changes=[(100, -50, 60)])) == []
    assert [r[1:3] for r in found(rule, context(spark, 10, changes=[(10, 16, 60)]))] == [("critical", 100.0)]


def test_rapid_sales(spark):
    rule = rules.RapidConsecutiveSales()
    seven = [(1, i) for i in range(7)]
    assert found(rule, context(spark, sold=seven)) == [
        ("rapid_consecutive_sales", "low", 100.0, "Rapid sales detected: 7 transactions (7 units total) in 60 seconds")]
    assert found(rule, context(spark, sold=[(1, 60)] * 16))[0][1] == "critical"
    assert found(rule, context(spark, sold=[(1, 61)] * 16)) == []


class Broken:
    def evaluate(self, ctx):
        return ctx.inventory.select("no_such_column")


def test_engine(spark):
    engine = rules.RuleEngine([])
    assert len(engine.rules) == 4
    assert engine.remove_rule(rules.SuddenSalesSpike) and not engine.remove_rule(rules.SuddenSalesSpike)
    engine.add_rule(Broken())
    rows = engine.detect(context(spark, -1, sold=[(1, 1)] * 6)).collect()
    assert sorted((r["anomaly_type"], r["status"], r["event_id"]) for r in rows) == [
        ("negative_inventory", "open", None), ("rapid_consecutive_sales", "open", None)]


def anomaly(i, kind, severity, status, event=None, minutes=0):
    return (str(i), "I", event, kind, severity, 1.0, status, None, T0 + timedelta(minutes=minutes), None)


def test_persisting_per_event(spark):
    rows = spark.createDataFrame([anomaly(1, "a", "high", "open", "E1"), anomaly(2, "b", "high", "open", "E1"),
                                  anomaly(3, "a", "high", "open"), anomaly(4, "a", "low", "open", "E2")], ANOMALIES)
    stored = spark.createDataFrame([anomaly(9, "a", "low", "open", "E2")], ANOMALIES)
    assert sorted(r["id"] for r in anomalies.new_anomalies(rows, stored).collect()) == ["1", "2", "3"]
    assert sorted(r["id"] for r in anomalies.new_anomalies(rows, stored, one_per_event=True).collect()) == ["1", "3"]


def test_anomaly_statistics_and_status(spark):
    rows = spark.createDataFrame([anomaly(1, "a", "critical", "open"), anomaly(2, "a", "high", "investigating"),
                                  anomaly(3, "b", "medium", "resolved"), anomaly(4, "b", "critical", "open")], ANOMALIES)
    stats = anomalies.anomaly_stats_with_types(rows).first()
    assert (stats["total"], stats["open"], stats["critical"], stats["low"]) == (4, 2, 2, 0)
    assert stats["anomaly_types_count"] == {"a": 2, "b": 2}
    commands = spark.createDataFrame([(0, "1", "resolved", T0, None), (1, "1", "open", T0 + timedelta(1), None),
                                      (2, "2", "resolved", T0, T0 + timedelta(2)), (3, "77", "open", T0, None)],
                                     "seq int, target_id string, status string, at timestamp, resolved_at timestamp")
    updated, unknown = anomalies.apply_status_changes(rows, commands)
    got = {r["id"]: (r["status"], r["resolved_at"]) for r in updated.collect()}
    assert got["1"] == ("open", T0) and got["2"] == ("resolved", T0 + timedelta(2)) and got["4"] == ("open", None)
    assert [r["target_id"] for r in unknown.collect()] == ["77"]


def test_dedup_window_is_anchored(spark):
    candidates = spark.createDataFrame(
        [("A", "I", None, "high", "t", "Alert: t", None, T0 + timedelta(seconds=s)) for s in (0, 200, 300, 350, 651)],
        "anomaly_id string, inventory_id string, event_id string, severity string, anomaly_type string, title string, "
        "description string, at timestamp")
    kept = alerts.deduplicate(candidates, order=["at"]).orderBy("at").collect()
    assert [r["created"] for r in kept] == [True, False, False, True, True]
    assert kept[1]["triggered_at"] == T0
    open_alert = (("1", "A", "I", None, "high", "acknowledged", "t", None, T0 - timedelta(seconds=100)) + (None,) * 4
                  + (T0, T0))
    # Triggered 100 s earlier: it covers 0 and 200, not 300; the alert made at 300 covers 350, not 651.
    for status, expected in (("acknowledged", [False, False, True, False, True]), ("resolved", [True, False, False, True, True])):
        stored = spark.createDataFrame([open_alert[:5] + (status,) + open_alert[6:]], ALERTS)
        kept = alerts.deduplicate(candidates, order=["at"], alerts=stored).orderBy("at").collect()
        assert [r["created"] for r in kept] == expected


def alert(i, status, severity, triggered=0, acknowledged=None, resolved=None):
    at = T0 + timedelta(seconds=triggered)
    later = [None if s is None else at + timedelta(seconds=s) for s in (acknowledged, resolved)]
    return (str(i), "A", "I", None, severity, status, "Alert: t", None, at, later[0], None, later[1], None, at, at)


def test_alert_statistics(spark):
    rows = spark.createDataFrame([
        alert(1, "triggered", "high"), alert(2, "acknowledged", "critical", 1, 60), alert(3, "resolved", "high", 2, 20, 90),
        alert(4, "suppressed", "high", 3)], ALERTS)
    stats = alerts.alert_stats(rows).first()
    assert [stats[c] for c in ("total", "triggered", "acknowledged", "resolved", "suppressed", "critical", "high")] == [
        4, 1, 1, 1, 1, 1, 3]
    assert (stats["avg_ack_time"], stats["avg_resolution_time"]) == (40.0, 90.0)
    instant = alerts.alert_stats(spark.createDataFrame([alert(1, "resolved", "high", 0, 0, 0)], ALERTS)).first()
    assert (instant["avg_ack_time"], instant["avg_resolution_time"]) == (None, None)
    assert alerts.latest_open(rows).first()["id"] == "4"


def test_severity_gate(spark):
    rows = spark.createDataFrame([anomaly(i, "a", s, "open") for i, s in enumerate(("low", "medium", "high", "critical"))], ANOMALIES)
    assert sorted(r["severity"] for r in alerts.alert_candidates(rows).collect()) == ["critical", "high"]
    assert [r["severity"] for r in alerts.alert_candidates(rows, high=False).collect()] == ["critical"]


def test_pages(spark, monkeypatch):
    rows = spark.createDataFrame([anomaly(i, "a", "high", "open", minutes=i // 2) for i in range(10)], ANOMALIES)
    expected = ["8", "9", "6", "7", "4", "5", "2", "3", "0", "1"]
    for reach in (50_000, 0):
        monkeypatch.setattr(paging, "TOP_K_REACH", reach)
        got = paging.page(rows, "detected_at", skip=1, limit=4).collect()
        assert [r["id"] for r in got] == expected[1:5]
    lines = paging.page_with_total(rows, "detected_at", skip=8, limit=4).collect()
    assert [(r["id"], r["total"], r["count"], r["skip"], r["limit"]) for r in lines] == [("0", 10, 2, 8, 4), ("1", 10, 2, 8, 4)]
    (line,) = paging.page_with_total(rows, "detected_at", skip=50, limit=4).collect()
    assert (line["id"], line["total"], line["count"]) == (None, 10, 0)
    assert paging.matching(rows, severity="", status=None).count() == 10
    for skip, limit in ((-1, 5), (0, 0), (0, 101)):
        with pytest.raises(ValueError):
            paging.page(rows, "detected_at", skip, limit)


def test_cascade(spark):
    tables = {
        "inventory": context(spark).inventory, "anomalies": spark.createDataFrame([anomaly("A", "a", "high", "open")], ANOMALIES),
        "alerts": spark.createDataFrame([alert(1, "triggered", "high")], ALERTS)}
    assert cascade.delete_anomalies(tables, tables["anomalies"])["alerts"].isEmpty()
    assert all(t.isEmpty() for t in cascade.delete_inventory(tables, tables["inventory"]).values())
    # An alert on another inventory row goes too, when its anomaly does.
    moved = tables | {"alerts": tables["alerts"].withColumn("inventory_id", F.lit("elsewhere"))}
    assert cascade.delete_inventory(moved, tables["inventory"])["alerts"].isEmpty()


def test_commands_of_unknown_kind(spark):
    rows = spark.createDataFrame([alert(1, "triggered", "high")], ALERTS)
    commands = spark.createDataFrame([(1, "1", "resolve", T0, "u", None), (2, "1", "escalate", T0, "u", None),
                                      (3, "9", "resolve", T0, "u", None)],
                                     "seq int, target_id string, command string, at timestamp, actor string, until timestamp")
    updated, unknown = alerts.apply_commands(rows, commands)
    assert [(r["status"], r["resolved_at"]) for r in updated.collect()] == [("resolved", T0)]
    assert sorted(r["seq"] for r in unknown.collect()) == [2, 3]
