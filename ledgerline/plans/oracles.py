"""SQL twins of the registered queries, for comparison on the same tables.

They are written from the definitions of the operators, not from the DataFrame code: folds are recursive CTEs
over numbered rows. A query without an entry has no practical SQL form.
"""

from __future__ import annotations

AS_OF = 1_706_745_600_000_000
HOUR = 3_600_000_000
DAY = 24 * HOUR


def _id(*parts: str) -> str:
    """UUID-shaped id of text parts joined by character 1."""
    digest = f"sha256(concat_ws(chr(1), {', '.join(parts)}))"
    return "(" + " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in
                                    ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def _uuid(prefix: str, number: str) -> str:
    return f"('{prefix}' || lpad(CAST({number} AS VARCHAR), 12, '0'))"


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


INVENTORY_ID = _id("'inventory'", "store_id", "product_id")

EV = f"""ev AS (
  SELECT {_uuid('00000000-0000-4000-8000-', 'event_id')} AS event_id, event_id AS event_no, event_type, value,
    user_id, 'SKU-' || user_id AS product_id, 'STORE-' || (user_id % 7) AS store_id,
    CASE event_type WHEN 'signup' THEN 'RESTOCK' WHEN 'click' THEN 'RETURN' WHEN 'error' THEN 'MANUAL_ADJUSTMENT'
      ELSE 'SALE' END AS operation,
    CAST(CASE event_type WHEN 'signup' THEN ceil(value) WHEN 'click' THEN ceil(value / 4)
      WHEN 'purchase' THEN ceil(value) WHEN 'view' THEN ceil(value / 2)
      ELSE (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * ceil(value / 10) END AS BIGINT) AS quantity,
    epoch_us(ts) AS tm FROM events),
mv AS (SELECT *, CASE WHEN operation = 'SALE' THEN -quantity ELSE quantity END AS delta FROM ev)"""


def _fold(source: str, key: str, order: str, name: str = "ledger") -> str:
    """Guarded running balance over ``source`` (with delta); every row gets status, before, after."""
    on = " AND ".join(f"n.{k.strip()} = f.{k.strip()}" for k in key.split(","))
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}),
{name}_f AS (
  SELECT {key}, rn, CAST(0 AS BIGINT) AS before, CASE WHEN delta >= 0 THEN delta ELSE 0 END AS after,
    delta >= 0 AS ok FROM {name}_n WHERE rn = 1
  UNION ALL
  SELECT {", ".join("n." + k.strip() for k in key.split(","))}, n.rn, f.after,
    CASE WHEN f.after + n.delta >= 0 THEN f.after + n.delta ELSE f.after END, f.after + n.delta >= 0
  FROM {name}_f f JOIN {name}_n n ON {on} AND n.rn = f.rn + 1),
{name} AS (SELECT n.*, f.before AS quantity_before, f.after AS quantity_after, f.ok,
    CASE WHEN f.ok THEN 'applied' ELSE 'rejected' END AS status
  FROM {name}_n n JOIN {name}_f f ON {on} AND n.rn = f.rn)"""


LEDGER = f"{EV},\n{_fold('mv', 'product_id, store_id', 'tm, event_no')}"
BALANCES = "balances AS (SELECT product_id, store_id, CAST(sum(delta) AS BIGINT) AS quantity FROM ledger WHERE ok GROUP BY ALL)"
HISTORY = f"""history AS (SELECT {_id("'history'", 'event_id')} AS id, {INVENTORY_ID} AS inventory_id,
  CASE WHEN operation = 'MANUAL_ADJUSTMENT' THEN 'adjustment' ELSE lower(operation) END AS change_type,
  quantity_before, quantity_after, delta AS quantity_delta, event_id AS source_event_id, tm AS changed_at FROM ledger WHERE ok)"""

_TWICE = f"""{EV},
twice AS (SELECT *, 0 AS copy FROM mv UNION ALL
  SELECT * REPLACE (tm + {HOUR} AS tm), 1 AS copy FROM mv WHERE event_no % 5 = 0),
tn AS (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY tm, event_no, copy) AS rn FROM twice),
tf AS (
  SELECT product_id, store_id, rn, CAST(0 AS BIGINT) AS before, CASE WHEN delta >= 0 THEN delta ELSE 0 END AS after,
    CASE WHEN delta >= 0 THEN 'applied' ELSE 'rejected' END AS status, delta >= 0 AS known,
    CASE WHEN delta >= 0 AND event_no % 5 = 0 THEN [event_no] ELSE CAST([] AS BIGINT[]) END AS seen FROM tn WHERE rn = 1
  UNION ALL
  SELECT product_id, store_id, rn, before,
    CASE WHEN status = 'applied' THEN before + delta ELSE before END, status, known OR status = 'applied',
    CASE WHEN status = 'applied' AND event_no % 5 = 0 THEN list_append(seen, event_no) ELSE seen END
  FROM (SELECT n.product_id, n.store_id, n.rn, n.delta, n.event_no, f.after AS before, f.known, f.seen,
      CASE WHEN list_contains(f.seen, n.event_no) THEN 'duplicate'
        WHEN f.after + n.delta < 0 THEN 'rejected' ELSE 'applied' END AS status
    FROM tf f JOIN tn n ON n.product_id = f.product_id AND n.store_id = f.store_id AND n.rn = f.rn + 1) step)"""

# -- sales -------------------------------------------------------------------------------------------------------

SALES = f"""sale_events AS (
  SELECT l_orderkey || '-' || l_linenumber AS sale_id, 'SKU-' || (l_orderkey % 2000) AS product_id,
    'STORE-' || (l_orderkey % 5) AS store_id, CAST(l_quantity AS INTEGER) AS quantity_sold,
    CASE WHEN l_returnflag <> 'A' THEN CAST(p_retailprice AS DECIMAL(12,2)) END AS sale_price,
    epoch_us(l_shipdate) AS sold_at, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
known AS (SELECT DISTINCT product_id, store_id FROM sale_events WHERE l_orderkey % 2000 % 10 <> 0),
repeated AS (SELECT sale_id FROM sale_events GROUP BY 1 HAVING count(*) > 1),
sn AS (SELECT s.*, r.sale_id IS NOT NULL AS again, k.product_id IS NOT NULL AS stocked,
    row_number() OVER (PARTITION BY s.product_id, s.store_id ORDER BY sold_at, l_orderkey, l_linenumber, l_partkey,
      l_suppkey, l_quantity, l_extendedprice) AS rn
  FROM sale_events s LEFT JOIN repeated r USING (sale_id)
    LEFT JOIN known k ON k.product_id = s.product_id AND k.store_id = s.store_id),
sf AS (
  SELECT product_id, store_id, rn, CAST(400 AS BIGINT) AS before, CAST(400 - quantity_sold AS BIGINT) AS after,
    'applied' AS status, CASE WHEN again THEN [sale_id] ELSE CAST([] AS VARCHAR[]) END AS seen
  FROM sn WHERE rn = 1 AND stocked
  UNION ALL
  SELECT product_id, store_id, rn, before, CASE WHEN status = 'applied' THEN before - quantity_sold ELSE before END,
    status, CASE WHEN status = 'applied' AND again THEN list_append(seen, sale_id) ELSE seen END
  FROM (SELECT n.product_id, n.store_id, n.rn, n.quantity_sold, n.sale_id, n.again, f.after AS before, f.seen,
      CASE WHEN list_contains(f.seen, n.sale_id) THEN 'duplicate' WHEN f.after < n.quantity_sold THEN 'insufficient_stock'
        ELSE 'applied' END AS status
    FROM sf f JOIN sn n ON n.product_id = f.product_id AND n.store_id = f.store_id AND n.rn = f.rn + 1) step),
sales_ledger AS (SELECT n.*, coalesce(f.status, 'product_not_found') AS status, f.before AS quantity_before,
    f.after AS quantity_after
  FROM sn n LEFT JOIN sf f ON n.product_id = f.product_id AND n.store_id = f.store_id AND n.rn = f.rn)"""

# -- reconciliation ----------------------------------------------------------------------------------------------

CHANGES = f"""{EV},
numbers AS (SELECT DISTINCT product_id, store_id, user_id AS num FROM ev),
totals AS (SELECT product_id, store_id, CAST(sum(delta) AS BIGINT) AS total FROM mv GROUP BY ALL),
drifted AS (SELECT product_id, store_id, total + CASE WHEN num % 3 = 0 THEN 2 ELSE 0 END AS quantity
  FROM totals JOIN numbers USING (product_id, store_id) WHERE num % 11 <> 0)"""
RECONCILED = f"""{CHANGES},
reconciled AS (SELECT n.store_id, n.product_id, num,
    CASE WHEN d.quantity IS NULL THEN 0 ELSE t.total END AS expected_quantity,
    coalesce(d.quantity, 0) AS actual_quantity,
    CASE WHEN d.quantity IS NULL THEN 0 ELSE d.quantity - t.total END AS difference,
    CASE WHEN d.quantity IS NULL THEN 'missing' WHEN d.quantity = t.total THEN 'match' ELSE 'mismatch' END AS status
  FROM numbers n JOIN totals t USING (product_id, store_id) LEFT JOIN drifted d USING (product_id, store_id)),
latest AS (SELECT store_id, product_id, CASE WHEN num % 2 = 1 THEN 'match' ELSE status END AS status,
    CASE WHEN num % 2 = 1 THEN 0 ELSE difference END AS difference, {AS_OF - HOUR} AS reconciled_at
  FROM reconciled WHERE num % 4 <> 0),
report AS (SELECT r.*, NOT (l.status IS NOT DISTINCT FROM r.status AND l.difference IS NOT DISTINCT FROM r.difference)
    AS changed, CASE WHEN l.status IS NOT DISTINCT FROM r.status AND l.difference IS NOT DISTINCT FROM r.difference
      THEN l.reconciled_at ELSE {AS_OF} END AS reconciled_at
  FROM reconciled r LEFT JOIN latest l USING (store_id, product_id))"""

# -- rules -------------------------------------------------------------------------------------------------------


def _severity(measure: str, critical: int, high: int, medium: int) -> str:
    return (f"CASE WHEN {measure} > {critical} THEN 'critical' WHEN {measure} > {high} THEN 'high' "
            f"WHEN {measure} > {medium} THEN 'medium' ELSE 'low' END")


SOLD = f"""sold AS (SELECT event_id, event_no, store_id, {INVENTORY_ID} AS inventory_id, quantity, tm FROM ev
  WHERE operation = 'SALE')"""


def _spike(stats: str, extra: str = "") -> str:
    return f"""SELECT {extra} inventory_id, 'sudden_sales_spike' AS anomaly_type, {_severity('ratio', 10, 7, 5)} AS severity,
  least(100.0::DOUBLE, ratio / 3.0::DOUBLE * 100) AS score,
  'Sales spike detected: maximum sale ' || peak || ' units is ' || printf('%.1f', ratio) || 'x the average of '
    || printf('%.1f', average) || ' units' AS description
FROM (SELECT *, peak / average AS ratio FROM (SELECT *, CAST(units AS DOUBLE) / n AS average FROM {stats}) a) b
WHERE n >= 5 AND peak > average * 3.0::DOUBLE"""


def _rapid(stats: str, seconds: int, extra: str = "") -> str:
    return f"""SELECT {extra} inventory_id, 'rapid_consecutive_sales' AS anomaly_type, {_severity('n', 15, 10, 7)} AS severity,
  least(100.0::DOUBLE, n / 5.0::DOUBLE * 100) AS score,
  'Rapid sales detected: ' || n || ' transactions (' || CAST(units AS BIGINT) || ' units total) in {seconds} seconds'
    AS description FROM {stats} WHERE n >= 5"""


def _adjustment(source: str, extra: str = "") -> str:
    return f"""SELECT {extra} inventory_id, 'large_inventory_adjustment' AS anomaly_type,
  {_severity('pct', 150, 100, 75)} AS severity, least(100.0::DOUBLE, pct) AS score,
  'Large adjustment detected: ' || abs(quantity_delta) || ' units (' || printf('%.1f', pct) || '%) from '
    || quantity_before || ' to ' || current_quantity || ' units' AS description
FROM (SELECT *, CAST(abs(quantity_delta) AS DOUBLE) / greatest(abs(quantity_before), abs(current_quantity), 1) * 100 AS pct
  FROM {source}) p WHERE pct > 50"""


def _negative(source: str) -> str:
    return f"""SELECT {INVENTORY_ID} AS inventory_id, 'negative_inventory' AS anomaly_type, 'critical' AS severity,
  100.0::DOUBLE AS score, 'Negative inventory detected: ' || quantity || ' units for SKU ' || product_id AS description
FROM {source} WHERE quantity < 0"""


def _trailing(key: str, lookback: int, name: str) -> str:
    return f"""{name} AS (SELECT *, count(*) OVER w AS n, sum(quantity) OVER w AS units, max(quantity) OVER w AS peak
  FROM sold WINDOW w AS (PARTITION BY {key} ORDER BY tm RANGE BETWEEN {lookback} PRECEDING AND CURRENT ROW))"""


def _recent(lookback: int, name: str, known: str) -> str:
    return f"""{name} AS (SELECT inventory_id, count(*) AS n, sum(quantity) AS units, max(quantity) AS peak FROM sold
  WHERE tm >= {AS_OF - lookback} AND inventory_id IN (SELECT {INVENTORY_ID} FROM {known}) GROUP BY 1)"""


LATEST_CHANGE = f"""latest_change AS (SELECT h.inventory_id, h.quantity_delta, h.quantity_before, b.quantity AS current_quantity
  FROM (SELECT *, row_number() OVER (PARTITION BY inventory_id ORDER BY changed_at DESC, id DESC) AS r FROM history
    WHERE changed_at >= {AS_OF - 120 * HOUR}) h
  JOIN (SELECT {INVENTORY_ID} AS inventory_id, quantity FROM balances) b USING (inventory_id) WHERE r = 1)"""
PER_EVENT = f"""{LEDGER},\n{HISTORY},\n{SOLD},\n{_trailing('inventory_id', 120 * HOUR, 'spikes')},
{_trailing('inventory_id', DAY, 'rapids')},
changes_seen AS (SELECT *, source_event_id AS event_id, quantity_after AS current_quantity, changed_at AS tm FROM history),
found AS (
  SELECT *, 0 AS rule_no FROM ({_spike('spikes', 'event_id, tm,')})
  UNION ALL SELECT *, 1 FROM ({_adjustment('changes_seen', 'event_id, tm,')})
  UNION ALL SELECT *, 2 FROM ({_rapid('rapids', 86400, 'event_id, tm,')})),
per_event AS (SELECT *, {_id("'anomaly'", 'inventory_id', 'event_id', 'anomaly_type')} AS id FROM found)"""

# -- stored anomalies and alerts ---------------------------------------------------------------------------------

ANOMALIES = f"""anomalies AS (SELECT {_uuid('00000000-0000-4000-a000-', 'event_no')} AS id, {INVENTORY_ID} AS inventory_id,
  event_id, event_no, user_id,
  CASE event_no % 4 WHEN 0 THEN 'negative_inventory' WHEN 1 THEN 'sudden_sales_spike'
    WHEN 2 THEN 'large_inventory_adjustment' ELSE 'rapid_consecutive_sales' END AS anomaly_type,
  CASE WHEN value > 60 THEN 'critical' WHEN value > 30 THEN 'high' WHEN value > 15 THEN 'medium' ELSE 'low' END AS severity,
  least(100.0::DOUBLE, value) AS score,
  CASE event_no % 3 WHEN 2 THEN 'resolved' WHEN 1 THEN 'investigating' ELSE 'open' END AS status,
  'sample ' || event_no AS description, tm AS detected_at,
  CASE WHEN event_no % 3 = 2 THEN tm + CAST(ceil(value) AS BIGINT) * 1000000 END AS resolved_at
  FROM ev WHERE event_type = 'error')"""
ALERTS = f"""alerts AS (SELECT {_uuid('00000000-0000-4000-b000-', 'event_no')} AS id,
  {_uuid('00000000-0000-4000-a000-', '(user_id * 3 + event_no % 3)')} AS anomaly_id, {INVENTORY_ID} AS inventory_id, event_id,
  CASE WHEN value > 40 THEN 'critical' ELSE 'high' END AS severity,
  CASE event_no % 4 WHEN 0 THEN 'triggered' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'resolved' ELSE 'suppressed' END AS status,
  'Alert: sample' AS title, tm AS triggered_at,
  CASE WHEN event_no % 4 <> 0 THEN tm + CAST(ceil(value) AS BIGINT) * 1000000 END AS acknowledged_at,
  CASE WHEN event_no % 4 <> 0 THEN 'user-' || (event_no % 5) END AS acknowledged_by,
  CASE WHEN event_no % 4 = 2 THEN tm + CAST(ceil(value * 3) AS BIGINT) * 1000000 END AS resolved_at,
  CASE WHEN event_no % 4 = 3 THEN tm + CAST(ceil(value * 3600) AS BIGINT) * 1000000 END AS suppressed_until
  FROM ev WHERE event_type IN ('error', 'click'))"""
COMMANDS = f"""commands AS (SELECT event_no AS seq, {_uuid('00000000-0000-4000-b000-', '(event_no // 3)')} AS target_id,
  CASE WHEN event_no % 10 = 9 THEN 'escalate' WHEN event_no % 5 < 2 THEN 'acknowledge' WHEN event_no % 5 = 2 THEN 'resolve'
    ELSE 'suppress' END AS command,
  tm, 'user-' || (event_no % 9) AS actor, tm + {2 * HOUR} AS until FROM ev)"""
SEVERE = """severe AS (SELECT id AS anomaly_id, inventory_id, event_id, severity, 'Alert: ' || anomaly_type AS title,
  description, detected_at AS tm FROM anomalies WHERE severity IN ('critical', 'high'))"""


def _dedup(source: str, key: str, window: int, start: str = "CAST(NULL AS BIGINT)") -> str:
    return f"""dn AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY tm, anomaly_id) AS rn FROM {source}),
df AS (
  SELECT d.{key}, rn, coalesce({start} < tm - {window}, TRUE) AS created,
    CASE WHEN coalesce({start} < tm - {window}, TRUE) THEN tm ELSE {start} END AS anchor FROM dn d WHERE rn = 1
  UNION ALL
  SELECT n.{key}, n.rn, f.anchor < n.tm - {window}, CASE WHEN f.anchor < n.tm - {window} THEN n.tm ELSE f.anchor END
  FROM df f JOIN dn n ON n.{key} = f.{key} AND n.rn = f.rn + 1),
raised AS (SELECT n.*, f.created, f.anchor AS triggered_at FROM dn n JOIN df f ON n.{key} = f.{key} AND n.rn = f.rn)"""


_EARLY = AS_OF - 23 * DAY

# -- broker records ----------------------------------------------------------------------------------------------

CHECKED = f"""{EV},
records AS (SELECT *, event_no % 11 AS kind,
    '{{"event_id":"' || CASE WHEN event_no % 11 = 8 THEN 'not-a-uuid' ELSE event_id END || '","product_id":"' ||
    CASE WHEN event_no % 11 = 1 THEN ' ' ELSE product_id END || '","store_id":"' || store_id || '","operation":"' ||
    CASE WHEN event_no % 11 = 6 THEN lower(operation) ELSE operation END || '","quantity":' ||
    CASE event_no % 11 WHEN 2 THEN 0 WHEN 7 THEN 2000000 ELSE quantity END || ',"timestamp":"' ||
    CASE event_no % 11 WHEN 4 THEN '2099-01-01T00:00:00Z'
      ELSE strftime(make_timestamp(tm), '%Y-%m-%dT%H:%M:%S.%f') || CASE WHEN event_no % 11 = 3 THEN '' ELSE 'Z' END END
    || '"}}' AS document FROM mv),
checked AS (SELECT *, CASE kind
    WHEN 1 THEN 'product_id is not a valid identifier'
    WHEN 2 THEN CASE operation WHEN 'MANUAL_ADJUSTMENT' THEN 'quantity must be non-zero for MANUAL_ADJUSTMENT'
      ELSE 'quantity must be positive for ' || operation END
    WHEN 3 THEN 'timestamp must be timezone-aware' WHEN 5 THEN 'payload is not valid JSON'
    WHEN 6 THEN 'operation is not supported' WHEN 7 THEN 'quantity is not an integer within the limits'
    WHEN 8 THEN 'event_id is not a UUID' WHEN 9 THEN 'payload is not an object' END AS detail,
  CASE WHEN kind = 4 THEN 'invalid_inventory_event:timestamp is too far in the future'
    WHEN kind IN (1, 2, 3, 5, 6, 7, 8, 9) THEN 'invalid_event_payload' END AS failure_reason,
  CASE WHEN kind IN (5, 9) THEN NULL WHEN kind = 8 THEN 'not-a-uuid' ELSE event_id END AS claimed FROM records)"""

SALES_CHECKED = f"""numbered AS (
  SELECT l_orderkey * 8 + l_linenumber AS n, l_orderkey || '-' || l_linenumber AS sale_id,
    'SKU-' || (l_orderkey % 2000) AS product_id, 'STORE-' || (l_orderkey % 5) AS store_id,
    CAST(l_quantity AS INTEGER) AS quantity_sold, epoch_us(l_shipdate) AS sold_at,
    CASE WHEN l_returnflag <> 'A' THEN CAST(p_retailprice AS DECIMAL(12,2)) END AS sale_price
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
sales_checked AS (SELECT *, n % 13 AS kind, {_uuid('00000000-0000-4000-9000-', 'n')} AS event_id,
  CASE n % 13 WHEN 1 THEN 'sale_id must not be blank' WHEN 2 THEN 'quantity_sold is not an integer within the limits'
    WHEN 3 THEN 'timestamp must be timezone-aware' WHEN 5 THEN 'payload is not valid JSON'
    WHEN 6 THEN 'sale_price must be non-negative' WHEN 7 THEN 'sale_price is not a number'
    WHEN 8 THEN 'event_id is not a UUID' WHEN 9 THEN 'payload is not an object'
    WHEN 12 THEN 'store_id is not a valid identifier' END AS detail,
  CASE WHEN n % 13 = 4 THEN 'invalid_sales_event:timestamp is too far in the future'
    WHEN n % 13 IN (1, 2, 3, 5, 6, 7, 8, 9, 12) THEN 'invalid_sales_event_payload' END AS failure_reason FROM numbered)"""

CACHE = f"""{EV},
entries AS (SELECT 'inventory:' || user_id AS key, CAST(max(event_no) AS VARCHAR) AS value,
    CASE WHEN user_id % 4 = 0 THEN {AS_OF - 1_000_000} END AS expires_at FROM ev WHERE event_type = 'signup' GROUP BY user_id),
ops AS (SELECT event_no AS seq, 'inventory:' || user_id AS key,
    CASE WHEN event_type <> 'error' THEN CAST(event_no AS VARCHAR) END AS value,
    CASE WHEN event_type = 'click' THEN (event_no % 2) * 86400 END AS ttl FROM ev WHERE event_type <> 'signup'),
keys AS (SELECT DISTINCT 'inventory:' || (user_id * 2) AS key FROM ev)"""

BATCHED = f"""{LEDGER},
placed AS (SELECT *, CAST((row_number() OVER (ORDER BY tm, event_no) - 1) // 100 AS BIGINT) AS batch_no FROM ledger),
batches AS (SELECT batch_no, count(*) AS total_events, count(*) FILTER (ok) AS successful_events,
    count(*) FILTER (NOT ok) AS failed_events, CAST(0 AS BIGINT) AS duplicate_events, sum(value) AS ms FROM placed GROUP BY 1),
outcomes AS (SELECT *, CASE WHEN failed_events = 0 THEN 'completed' WHEN failed_events < total_events
    THEN 'partial_failure' ELSE 'failed' END AS status FROM batches)"""

ORACLES: dict[str, str] = {
    "guarded_balance": _with(LEDGER) + """SELECT event_id, product_id, store_id, operation, quantity, status, quantity_before,
  quantity_after, CASE WHEN ok THEN delta ELSE 0 END AS quantity_delta FROM ledger""",
    "balances_latest": _with(LEDGER, BALANCES) + "SELECT * FROM balances",
    "rejected_events": _with(LEDGER) + """SELECT event_id, quantity_before, delta,
  'inventory quantity cannot be negative after applying event' AS reason FROM ledger WHERE NOT ok""",
    "duplicate_events": _with(_TWICE) + """SELECT n.event_id, f.status,
  CASE WHEN f.known OR f.status = 'rejected' THEN f.before END AS quantity_before,
  CASE WHEN f.known OR f.status = 'rejected' THEN f.after END AS quantity_after,
  CASE WHEN f.status = 'applied' THEN n.delta ELSE 0 END AS quantity_delta
FROM tn n JOIN tf f ON n.product_id = f.product_id AND n.store_id = f.store_id AND n.rn = f.rn WHERE n.copy = 1""",
    "contested_events": _with(EV, f"""cn AS (SELECT row_number() OVER (ORDER BY tm, event_no) AS rn, event_no, user_id, delta,
    event_no - CASE WHEN event_no % 20 = 1 THEN 1 ELSE 0 END AS id FROM mv),
cf AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_no, CAST(NULL AS BIGINT) AS id, '' AS status,
    CAST(NULL AS BIGINT) AS before, CAST(NULL AS BIGINT) AS after, MAP {{CAST(-1 AS BIGINT): CAST(0 AS BIGINT)}} AS stock,
    CAST([] AS BIGINT[]) AS used
  UNION ALL
  SELECT rn, event_no, id, status, CASE WHEN prior IS NULL AND status <> 'duplicate' THEN 0 ELSE prior END,
    CASE status WHEN 'applied' THEN coalesce(prior, 0) + delta WHEN 'duplicate' THEN prior ELSE coalesce(prior, 0) END,
    CASE WHEN status = 'applied' THEN map_concat(stock, MAP {{user_id: coalesce(prior, 0) + delta}}) ELSE stock END,
    CASE WHEN status = 'applied' AND id % 20 = 0 THEN list_append(used, id) ELSE used END
  FROM (SELECT n.*, f.stock, f.used, f.stock[n.user_id] AS prior,
      CASE WHEN list_contains(f.used, n.id) THEN 'duplicate' WHEN coalesce(f.stock[n.user_id], 0) + n.delta < 0 THEN 'rejected'
        ELSE 'applied' END AS status FROM cf f JOIN cn n ON n.rn = f.rn + 1) step)""") + f"""SELECT event_no,
  {_uuid('00000000-0000-4000-8000-', 'id')} AS event_id, status, before AS quantity_before, after AS quantity_after
FROM cf WHERE rn > 0""",
    "audit_history": _with(LEDGER, HISTORY) + "SELECT * FROM history",
    "opening_balances": _with(
        EV, "even AS (SELECT * FROM mv WHERE event_no % 2 = 0)",
        _fold("even", "product_id, store_id", "tm, event_no", "first_run"),
        "carried AS (SELECT product_id, store_id, sum(delta) AS quantity FROM first_run WHERE ok GROUP BY ALL)",
        "done AS (SELECT event_id FROM first_run WHERE ok)",
        "fresh AS (SELECT * FROM mv WHERE event_id NOT IN (SELECT event_id FROM done))",
        """rn2 AS (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY tm, event_no) AS rn FROM mv),
f2 AS (
  SELECT product_id, store_id, CAST(0 AS BIGINT) AS rn, max(quantity) AS before, max(quantity) AS after, '' AS status
  FROM (SELECT n.product_id, n.store_id, CAST(c.quantity AS BIGINT) AS quantity FROM (SELECT DISTINCT product_id, store_id
    FROM mv) n LEFT JOIN carried c USING (product_id, store_id)) o GROUP BY ALL
  UNION ALL
  SELECT product_id, store_id, rn,
    CASE WHEN status = 'duplicate' THEN prior ELSE coalesce(prior, 0) END,
    CASE status WHEN 'duplicate' THEN prior WHEN 'applied' THEN coalesce(prior, 0) + delta ELSE coalesce(prior, 0) END, status
  FROM (SELECT n.product_id, n.store_id, n.rn, n.delta, f.after AS prior,
      CASE WHEN d.event_id IS NOT NULL THEN 'duplicate' WHEN coalesce(f.after, 0) + n.delta < 0 THEN 'rejected'
        ELSE 'applied' END AS status
    FROM f2 f JOIN rn2 n ON n.product_id = f.product_id AND n.store_id = f.store_id AND n.rn = f.rn + 1
      LEFT JOIN done d ON d.event_id = n.event_id) step)""") + """SELECT n.event_id, f.status, f.before AS quantity_before,
  f.after AS quantity_after FROM rn2 n JOIN f2 f ON n.product_id = f.product_id AND n.store_id = f.store_id AND n.rn = f.rn""",
    "store_balance_segmented": _with(EV, _fold("mv", "store_id", "tm, event_no")) + """SELECT event_id, store_id, status,
  quantity_before, quantity_after FROM ledger""",
    "processed_store": _with(EV) + f"""SELECT {_id("'processed'", 'event_id')} AS id, event_id, product_id, store_id,
  'processed' AS status, tm AS processed_at FROM ev WHERE event_no % 10 <> 3""",
    "processed_split": _with(EV) + """SELECT event_id, CASE WHEN event_no % 10 = 3 THEN 'duplicate' ELSE 'fresh' END AS outcome
FROM ev""",
    "validate_events": _with(CHECKED) + """SELECT event_no AS source_offset,
  CASE WHEN kind IN (5, 8, 9) THEN NULL ELSE event_id END AS event_id,
  CASE WHEN kind IN (5, 9) THEN NULL WHEN kind = 6 THEN lower(operation) ELSE operation END AS operation,
  CASE WHEN kind IN (5, 9) THEN NULL WHEN kind = 2 THEN 0 WHEN kind = 7 THEN 2000000 ELSE quantity END AS quantity,
  CASE WHEN kind = 3 THEN NULL WHEN kind IN (5, 9) THEN """ + str(AS_OF) + """
    WHEN kind = 4 THEN epoch_us(TIMESTAMP '2099-01-01') ELSE tm END AS event_time,
  failure_reason, detail, claimed AS claimed_event_id FROM checked""",
    "failure_reasons": _with(CHECKED) + """SELECT coalesce(failure_reason, 'valid') AS failure_reason,
  coalesce(detail, '') AS detail, count(*) AS records FROM checked GROUP BY ALL""",
    "dlq_messages": _with(
        CHECKED, "valid AS (SELECT * FROM checked WHERE failure_reason IS NULL)",
        _fold("valid", "product_id, store_id", "tm, event_no", "vl"),
        """failures AS (SELECT event_no, claimed AS event_id, failure_reason, kind, document FROM checked WHERE failure_reason IS NOT NULL
  UNION ALL SELECT event_no, event_id,
    'non_retryable_failure:inventory quantity cannot be negative after applying event', kind, document FROM vl WHERE NOT ok),
named AS (SELECT *, '{"event_id":' || json_extract(d, '$.event_id') || ',"operation":' || json_extract(d, '$.operation')
    || ',"product_id":' || json_extract(d, '$.product_id') || ',"quantity":' || json_extract(d, '$.quantity')
    || ',"store_id":' || json_extract(d, '$.store_id') || ',"timestamp":' || json_extract(d, '$.timestamp') || '}' AS sorted
  FROM (SELECT *, CAST(document AS JSON) AS d FROM failures) j)""",
    ) + """SELECT coalesce(event_id, 'inventory_updates:' || (event_no % 3) || ':' || event_no) AS key, event_id, failure_reason,
  '0' AS retry_count, '2024-02-01T00:00:00.000000+00:00' AS timestamp, 'inventory_updates' AS source_topic,
  CAST(event_no % 3 AS VARCHAR) AS source_partition, CAST(event_no AS VARCHAR) AS source_offset,
  CASE kind WHEN 5 THEN substr(document, 1, 20) WHEN 9 THEN '[' || sorted || ']' ELSE sorted END AS payload FROM named""",
    "validate_sales": _with(SALES_CHECKED) + f"""SELECT n AS source_offset, CASE WHEN kind IN (5, 8, 9) THEN NULL ELSE event_id END AS event_id,
  CASE WHEN kind IN (5, 9) THEN NULL WHEN kind = 1 THEN ' ' ELSE sale_id END AS sale_id,
  CASE WHEN kind IN (5, 9) THEN NULL ELSE product_id END AS product_id,
  CASE WHEN kind IN (5, 9) THEN NULL WHEN kind = 12 THEN '!' ELSE store_id END AS store_id,
  CASE WHEN kind IN (5, 9) THEN NULL WHEN kind = 2 THEN 0 ELSE CAST(quantity_sold AS BIGINT) END AS quantity_sold,
  CAST(CASE WHEN kind IN (5, 7, 9, 10, 11) THEN NULL WHEN kind = 6 THEN -1.50 ELSE sale_price END AS DECIMAL(38,2)) AS sale_price,
  CASE WHEN kind = 3 THEN NULL WHEN kind IN (5, 9) THEN {AS_OF} WHEN kind = 4 THEN epoch_us(TIMESTAMP '2099-01-01')
    ELSE sold_at END AS event_time, failure_reason, detail,
  CASE WHEN kind IN (5, 9) THEN NULL WHEN kind = 8 THEN 'not-a-uuid' ELSE event_id END AS claimed_event_id FROM sales_checked""",
    "sales_failure_reasons": _with(SALES_CHECKED) + """SELECT coalesce(failure_reason, 'valid') AS failure_reason,
  coalesce(detail, '') AS detail, count(*) AS records FROM sales_checked GROUP BY ALL""",
    "sales_dlq_messages": _with(SALES_CHECKED) + """SELECT 'sales_events:' || (n % 3) || ':' || n AS key,
  CAST(NULL AS VARCHAR) AS event_id, failure_reason, '0' AS retry_count, 'sales_events' AS source_topic,
  CAST(n % 3 AS VARCHAR) AS source_partition, CAST(n AS VARCHAR) AS source_offset
FROM sales_checked WHERE failure_reason IS NOT NULL""",
    "failed_event_store": _with(CHECKED) + f"""SELECT
  {_id("'failed'", "'inventory_updates'", 'CAST(event_no % 3 AS VARCHAR)', 'CAST(event_no AS VARCHAR)')} AS id,
  claimed AS event_id, 'inventory_updates' AS source_topic, CAST(event_no % 3 AS INTEGER) AS source_partition,
  event_no AS source_offset, CASE kind WHEN 5 THEN CAST(to_json(substr(document, 1, 20)) AS VARCHAR) WHEN 9 THEN '[' || document || ']'
    ELSE document END AS payload, failure_reason, 0 AS retry_count, {AS_OF} AS failed_at
FROM checked WHERE failure_reason IS NOT NULL AND event_no % 10 <> 0""",
    "post_sales": _with(SALES) + """SELECT sale_id, product_id, store_id, l_partkey, l_suppkey, quantity_sold, sold_at, status,
  quantity_before, quantity_after FROM sales_ledger""",
    "refused_sales": _with(SALES) + """SELECT status, CASE status WHEN 'product_not_found' THEN
    'no inventory record for product_id=''' || product_id || ''' store_id=''' || store_id || ''''
    ELSE 'insufficient stock: available=' || quantity_before || ', requested=' || quantity_sold END AS reason,
  count(*) AS sales FROM sales_ledger WHERE status IN ('product_not_found', 'insufficient_stock') GROUP BY ALL""",
    "duplicate_sales": _with(SALES) + f"""SELECT d.sale_id, d.l_partkey, d.l_suppkey, d.sold_at, d.quantity_sold,
  o.quantity_sold AS original_quantity, CAST(o.sale_price AS DECIMAL(38,2)) AS original_price,
  {_id("'sale'", 'd.sale_id')} AS sales_record_id
FROM sales_ledger d JOIN sales_ledger o ON o.sale_id = d.sale_id AND o.status = 'applied' WHERE d.status = 'duplicate'""",
    "sales_summary": _with(SALES) + """SELECT k.product_id, k.store_id,
  CAST(coalesce(sum(quantity_sold), 0) AS BIGINT) AS total_quantity_sold, count(sale_id) AS transaction_count,
  CAST(sum(sale_price * quantity_sold) AS DECIMAL(38,2)) AS total_revenue
FROM known k LEFT JOIN (SELECT * FROM sales_ledger WHERE status = 'applied') s USING (product_id, store_id) GROUP BY ALL""",
    "sales_items": _with(SALES) + f"""SELECT product_id, store_id, {_id("'sale'", 'sale_id')} AS id,
  {INVENTORY_ID} AS inventory_id, quantity_sold, CAST(sale_price AS DECIMAL(38,2)) AS sale_price,
  sale_id AS external_sale_id, sold_at FROM sales_ledger WHERE status = 'applied'""",
    "reconcile_all": _with(RECONCILED) + "SELECT * EXCLUDE (num) FROM reconciled",
    "reconcile_changes": _with(RECONCILED) + "SELECT * EXCLUDE (num) FROM report",
    "reconciliation_records": _with(RECONCILED) + f"""SELECT
  {_id("'reconciliation'", 'store_id', 'product_id', f"'{AS_OF}'")} AS id, store_id, product_id,
  expected_quantity, actual_quantity, difference, status, reconciled_at FROM report WHERE changed""",
    "latest_reconciliation": _with(RECONCILED) + "SELECT * FROM latest",
    "rule_negative": _with(CHANGES) + _negative("drifted"),
    "rule_spike": _with(CHANGES, SOLD, _recent(120 * HOUR, "st", "drifted")) + _spike("st"),
    "rule_spike_per_event": _with(EV, SOLD, _trailing("inventory_id", 120 * HOUR, "st")) + _spike("st", "event_id,"),
    "rule_adjustment": _with(LEDGER, BALANCES, f"""daily AS (SELECT {INVENTORY_ID} AS inventory_id, delta AS quantity_delta,
    quantity_before, event_no, tm - tm % {DAY} AS changed_at FROM ledger WHERE ok),
latest_change AS (SELECT h.inventory_id, h.quantity_delta, h.quantity_before, b.quantity AS current_quantity
  FROM (SELECT *, row_number() OVER (PARTITION BY inventory_id ORDER BY changed_at DESC, event_no DESC) AS r FROM daily
    WHERE changed_at >= {AS_OF - 120 * HOUR}) h
  JOIN (SELECT {INVENTORY_ID} AS inventory_id, quantity FROM balances) b USING (inventory_id) WHERE r = 1)""") +
    _adjustment("latest_change"),
    "rule_adjustment_per_event": _with(
        LEDGER, HISTORY, "c AS (SELECT *, source_event_id AS event_id, quantity_after AS current_quantity FROM history)"
    ) + _adjustment("c", "event_id,"),
    "rule_rapid": _with(CHANGES, SOLD, _recent(5 * DAY, "st", "drifted")) + _rapid("st", 432000),
    "rule_rapid_per_event": _with(EV, SOLD, _trailing("inventory_id", DAY, "st")) + _rapid("st", 86400, "event_id,"),
    "trailing_sales_segmented": _with(EV, SOLD, _trailing("store_id", DAY, "st")) + """SELECT event_id, store_id,
  n AS window_count, CAST(units AS BIGINT) AS window_sum, peak AS window_max FROM st""",
    "detect_all": _with(
        LEDGER, BALANCES, HISTORY, LATEST_CHANGE, SOLD, _recent(120 * HOUR, "sp", "balances"), _recent(DAY, "ra", "balances"),
        f"""found AS (SELECT *, 0 AS rule_no FROM ({_negative('balances')}) UNION ALL SELECT *, 1 FROM ({_spike('sp')})
  UNION ALL SELECT *, 2 FROM ({_adjustment('latest_change')}) UNION ALL SELECT *, 3 FROM ({_rapid('ra', 86400)}))""",
    ) + f"""SELECT {_id("'anomaly'", 'inventory_id', f"'at:{AS_OF}'", 'anomaly_type')} AS id, inventory_id, anomaly_type, severity,
  score, 'open' AS status, description, {AS_OF} AS detected_at, rule_no FROM found""",
    "custom_rule": _with(LEDGER, BALANCES, HISTORY, LATEST_CHANGE) + f"""SELECT * FROM ({_negative('balances')})
UNION ALL SELECT * FROM ({_adjustment('latest_change')})
UNION ALL SELECT {INVENTORY_ID}, 'stock_out', 'high', 50.0, 'Nothing left of ' || product_id FROM balances WHERE quantity = 0""",
    "new_anomalies": _with(PER_EVENT) + """SELECT id, event_id, anomaly_type, severity, score FROM per_event
WHERE NOT (anomaly_type = 'large_inventory_adjustment'
  AND event_id IN (SELECT event_id FROM ev WHERE event_no % 3 = 0))""",
    "new_anomalies_one_per_event": _with(PER_EVENT) + """SELECT id, event_id, anomaly_type, severity FROM per_event
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY rule_no, id) = 1""",
    "alerts_gated": _with(EV, ANOMALIES, SEVERE) + 'SELECT * RENAME (tm AS "at") FROM severe',
    "alerts_dedup": _with(EV, ANOMALIES, SEVERE, _dedup("severe", "inventory_id", 2 * DAY)) +
    "SELECT anomaly_id, created, triggered_at FROM raised",
    "alerts_dedup_segmented": _with(EV, ANOMALIES, SEVERE, _dedup("severe", "severity", 2 * HOUR)) +
    "SELECT anomaly_id, created, triggered_at FROM raised",
    "alerts_created": _with(EV, ANOMALIES, SEVERE, _dedup("severe", "inventory_id", 2 * DAY)) + f"""SELECT
  {_id("'alert'", 'anomaly_id', 'CAST(triggered_at AS VARCHAR)')} AS id, anomaly_id, inventory_id, event_id, severity,
  'triggered' AS status, title, triggered_at FROM raised WHERE created""",
    "alerts_dedup_existing": _with(
        EV, ANOMALIES, ALERTS, SEVERE,
        f"opened AS (SELECT inventory_id, max(triggered_at) AS start FROM alerts WHERE status <> 'resolved' AND triggered_at < {_EARLY} GROUP BY 1)",
        f"late AS (SELECT s.*, o.start FROM severe s LEFT JOIN opened o USING (inventory_id) WHERE tm >= {_EARLY})",
        _dedup("late", "inventory_id", 2 * DAY, "start")) + "SELECT anomaly_id, created, triggered_at FROM raised",
    "alert_lifecycle": _with(EV, ALERTS, COMMANDS, """c AS (SELECT target_id, max_by(command, seq) AS command, max_by(tm, seq) AS upd,
    max_by(tm, seq) FILTER (command = 'acknowledge') AS ack, max_by(actor, seq) FILTER (command = 'acknowledge') AS who,
    max_by(tm, seq) FILTER (command = 'resolve') AS res, max_by(until, seq) FILTER (command = 'suppress') AS sup
  FROM commands WHERE command <> 'escalate' GROUP BY 1)""") + """SELECT id, CASE command WHEN 'acknowledge' THEN 'acknowledged' WHEN 'resolve' THEN 'resolved'
    WHEN 'suppress' THEN 'suppressed' ELSE status END AS status, coalesce(ack, acknowledged_at) AS acknowledged_at,
  coalesce(who, acknowledged_by) AS acknowledged_by, coalesce(res, resolved_at) AS resolved_at,
  coalesce(sup, suppressed_until) AS suppressed_until, coalesce(upd, triggered_at) AS updated_at
FROM alerts LEFT JOIN c ON id = target_id""",
    "alert_commands_unknown": _with(EV, ALERTS, COMMANDS) + """SELECT seq, target_id, command FROM commands
WHERE target_id NOT IN (SELECT id FROM alerts) OR command = 'escalate'""",
    "anomaly_status_changes": _with(EV, ANOMALIES, f"""c AS (SELECT target_id, max_by(st, seq) AS st,
    max_by(res, seq) FILTER (st = 'resolved') AS res FROM (SELECT event_no AS seq,
      {_uuid('00000000-0000-4000-a000-', '(event_no // 2)')} AS target_id,
      CASE event_no % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'investigating' ELSE 'resolved' END AS st,
      CASE WHEN event_no % 2 = 0 THEN tm + 60000000 ELSE tm END AS res FROM ev) k GROUP BY 1)""") + """SELECT id,
  coalesce(st, status) AS status, coalesce(res, resolved_at) AS resolved_at FROM anomalies LEFT JOIN c ON id = target_id""",
    "alert_stats": _with(EV, ALERTS) + """SELECT count(*) AS total, count(*) FILTER (status = 'triggered') AS triggered,
  count(*) FILTER (status = 'acknowledged') AS acknowledged, count(*) FILTER (status = 'resolved') AS resolved,
  count(*) FILTER (status = 'suppressed') AS suppressed, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high,
  nullif(avg((acknowledged_at - triggered_at) / 1000000.0::DOUBLE), 0) AS avg_ack_time,
  nullif(avg((resolved_at - triggered_at) / 1000000.0::DOUBLE), 0) AS avg_resolution_time FROM alerts""",
    "anomaly_stats": _with(EV, ANOMALIES) + """SELECT count(*) AS total, count(*) FILTER (status = 'open') AS open,
  count(*) FILTER (status = 'investigating') AS investigating, count(*) FILTER (status = 'resolved') AS resolved,
  count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM anomalies""",
    "anomaly_type_counts": _with(EV, ANOMALIES) + "SELECT anomaly_type, count(*) AS anomalies FROM anomalies GROUP BY 1",
    "list_anomalies_page": _with(EV, ANOMALIES, "w AS (SELECT * FROM anomalies WHERE severity = 'critical' AND status = 'open')") +
    """SELECT id, anomaly_type, detected_at, (SELECT count(*) FROM w) AS total,
  least(greatest((SELECT count(*) FROM w) - 10, 0), 15) AS "count", 10 AS skip, 15 AS "limit"
FROM (SELECT 1) LEFT JOIN (SELECT * FROM w ORDER BY detected_at DESC, id LIMIT 15 OFFSET 10) ON true""",
    "list_anomalies_past_end": _with(EV, ANOMALIES) + """SELECT CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS anomaly_type,
  count(*) AS total, 0::BIGINT AS "count", 10000000 AS skip, 15 AS "limit"
FROM anomalies WHERE severity = 'critical' AND status = 'open'""",
    "alert_by_id": _with(EV, ALERTS) + """SELECT id, anomaly_id, status, triggered_at FROM alerts
WHERE id = (SELECT min(id) FROM alerts)""",
    "anomaly_stats_with_types": _with(EV, ANOMALIES) + """SELECT (SELECT count(*) FROM anomalies) AS total,
  (SELECT count(*) FROM anomalies WHERE status = 'open') AS open,
  (SELECT count(*) FROM anomalies WHERE severity = 'critical') AS critical, anomaly_type, count(*) AS anomalies
FROM anomalies GROUP BY anomaly_type""",
    "kv_get_counts": _with(CACHE) + f"""SELECT count(e.key) AS found, count(*) - count(e.key) AS missing
FROM keys k LEFT JOIN entries e ON e.key = k.key AND (e.expires_at IS NULL OR e.expires_at > {AS_OF})""",
    "sales_items_newest": _with(SALES) + f"""SELECT product_id, store_id, id, sold_at,
  row_number() OVER (PARTITION BY product_id, store_id ORDER BY sold_at DESC, id) AS place
FROM (SELECT *, {_id("'sale'", 'sale_id')} AS id FROM sales_ledger WHERE status = 'applied')""",
    "batch_outcomes_empty": _with(BATCHED) + """SELECT batch_no,
  CASE WHEN batch_no % 3 = 0 THEN 0 ELSE total_events END AS total_events,
  CASE WHEN batch_no % 3 = 0 THEN 0 ELSE successful_events END AS successful_events,
  CASE WHEN batch_no % 3 = 0 THEN 0 ELSE failed_events END AS failed_events, duplicate_events,
  CASE WHEN batch_no % 3 = 0 THEN 'completed' ELSE status END AS status FROM outcomes""",
    "detect_after": _with(
        LEDGER, BALANCES, HISTORY, SOLD,
        f"""changes AS (SELECT inventory_id, source_event_id AS event_id, event_no FROM history
  JOIN (SELECT event_id AS source_event_id, event_no FROM ev) USING (source_event_id)),
sp AS (SELECT c.inventory_id, c.event_id, count(*) AS n, sum(s.quantity) AS units, max(s.quantity) AS peak
  FROM changes c JOIN sold s ON s.inventory_id = c.inventory_id AND s.event_no <= c.event_no AND s.tm >= {AS_OF - 120 * HOUR}
  GROUP BY ALL),
ra AS (SELECT c.inventory_id, c.event_id, count(*) AS n, sum(s.quantity) AS units, max(s.quantity) AS peak
  FROM changes c JOIN sold s ON s.inventory_id = c.inventory_id AND s.event_no <= c.event_no AND s.tm >= {AS_OF - DAY}
  GROUP BY ALL),
c AS (SELECT *, source_event_id AS event_id, quantity_after AS current_quantity FROM history),
found AS (SELECT n.*, event_id, 0 AS rule_no FROM ({_negative('balances')}) n JOIN changes USING (inventory_id)
  UNION ALL SELECT * EXCLUDE (event_id), event_id, 1 FROM ({_spike('sp', 'event_id,')})
  UNION ALL SELECT * EXCLUDE (event_id), event_id, 2 FROM ({_adjustment('c', 'event_id,')})
  UNION ALL SELECT * EXCLUDE (event_id), event_id, 3 FROM ({_rapid('ra', 86400, 'event_id,')}))""",
    ) + f"""SELECT {_id("'anomaly'", 'inventory_id', 'event_id', 'anomaly_type')} AS id, inventory_id, event_id, anomaly_type,
  severity, score, description, rule_no FROM found""",
    "list_alerts_page": _with(EV, ALERTS, "w AS (SELECT * FROM alerts WHERE severity = 'high')") +
    """SELECT id, status, triggered_at, (SELECT count(*) FROM w) AS total FROM w ORDER BY triggered_at DESC, id LIMIT 20""",
    "anomalies_by_inventory": _with(EV, ANOMALIES) + """SELECT id, detected_at FROM anomalies WHERE user_id = 3 AND status = 'open'""",
    "anomaly_by_id": _with(EV, ANOMALIES) + """SELECT id, event_id, severity, score FROM anomalies
WHERE id = '00000000-0000-4000-a000-000000000000'""",
    "alert_positions": _with(EV, ALERTS) + """SELECT id, row_number() OVER (ORDER BY triggered_at DESC, id) - 1 AS position
FROM alerts""",
    "latest_open_alert": _with(EV, ALERTS) + """SELECT anomaly_id, id, status, triggered_at FROM alerts WHERE status <> 'resolved'
QUALIFY row_number() OVER (PARTITION BY anomaly_id ORDER BY triggered_at DESC, id DESC) = 1""",
    "cascade_delete": _with(CHANGES, SOLD, ANOMALIES, ALERTS,
                            f"gone AS (SELECT {INVENTORY_ID} AS id FROM drifted WHERE store_id = 'STORE-2')") +
    f"""SELECT 'inventory' AS table_name, {INVENTORY_ID} AS id FROM drifted WHERE store_id <> 'STORE-2'
UNION ALL SELECT 'inventory_history', event_id FROM ev WHERE {INVENTORY_ID} NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'sales', event_id FROM sold WHERE inventory_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'anomalies', id FROM anomalies WHERE inventory_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'alerts', id FROM alerts WHERE inventory_id NOT IN (SELECT id FROM gone)
  AND anomaly_id NOT IN (SELECT id FROM anomalies WHERE inventory_id IN (SELECT id FROM gone))""",
    "cascade_delete_anomalies": _with(EV, ANOMALIES, ALERTS) + """SELECT 'anomalies' AS table_name, id FROM anomalies WHERE severity <> 'low'
UNION ALL SELECT 'alerts', id FROM alerts WHERE anomaly_id NOT IN (SELECT id FROM anomalies WHERE severity = 'low')""",
    "alert_messages": _with(EV, ALERTS) + "SELECT id AS key, id, anomaly_id, inventory_id, event_id, severity, status, title, "
    "CAST(NULL AS VARCHAR) AS description, acknowledged_by, " + ", ".join(
        f"strftime(make_timestamp({c}), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS {c}"
        for c in ("triggered_at", "acknowledged_at", "resolved_at", "suppressed_until")) + " FROM alerts",
    "stale_alerts": _with(EV, ALERTS) + f"""SELECT id, triggered_at FROM alerts WHERE status = 'triggered'
  AND {AS_OF - 10 * DAY} - triggered_at > 3600000000""",
    "effective_alert_status": _with(EV, ALERTS) + f"""SELECT id, status,
  CASE WHEN status = 'suppressed' AND suppressed_until <= {AS_OF} THEN 'triggered' ELSE status END AS effective_status
FROM alerts""",
    "latest_state_cache": _with(LEDGER) + """SELECT 'inventory:' || store_id || ':' || product_id AS key, product_id, store_id,
  CAST(quantity_after AS VARCHAR) AS quantity, operation, event_id AS source_event_id,
  '2024-02-01T00:00:00.000000+00:00' AS synced_at FROM ledger WHERE ok
QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY tm DESC, event_no DESC) = 1""",
    "kv_apply": _with(CACHE) + f"""SELECT key, value, expires_at FROM (
  SELECT key, value, expires_at, CAST(-1 AS BIGINT) AS seq FROM entries UNION ALL
  SELECT key, value, CASE WHEN coalesce(ttl, 0) <> 0 THEN {AS_OF} + ttl * 1000000 END, seq FROM ops) m
QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
  AND value IS NOT NULL AND (expires_at IS NULL OR expires_at > {AS_OF})""",
    "kv_operation_counts": _with(CACHE) + f"""SELECT count(*) FILTER (good) AS successful, count(*) FILTER (NOT good) AS failed FROM (
  SELECT o.value IS NOT NULL OR coalesce(lag(o.value IS NOT NULL) OVER (PARTITION BY o.key ORDER BY o.seq),
    e.key IS NOT NULL) AS good
  FROM ops o LEFT JOIN entries e ON e.key = o.key AND (e.expires_at IS NULL OR e.expires_at > {AS_OF})) j""",
    "kv_delete": _with(CACHE) + "SELECT key, value FROM entries WHERE key NOT IN (SELECT key FROM keys)",
    "kv_delete_counts": _with(CACHE) + f"""SELECT count(*) AS deleted, (SELECT 2 * count(*) FROM keys) - count(*) AS failed
FROM entries WHERE key IN (SELECT key FROM keys) AND (expires_at IS NULL OR expires_at > {AS_OF})""",
    "kv_get": _with(CACHE) + f"""SELECT k.key, e.value FROM keys k LEFT JOIN entries e ON e.key = k.key
  AND (e.expires_at IS NULL OR e.expires_at > {AS_OF})""",
    "kv_overwrite": _with(CACHE) + """SELECT key, value, expires_at FROM entries WHERE key NOT IN (SELECT key FROM keys)
UNION ALL SELECT key, 'new', NULL FROM keys""",
    "batch_cut": _with(EV) + """SELECT event_id, CAST((row_number() OVER (ORDER BY tm, event_no) - 1) // 64 AS BIGINT) AS batch_no
FROM ev""",
    "batch_outcomes": _with(BATCHED) + "SELECT * EXCLUDE (ms) FROM outcomes",
    "batch_errors": _with(BATCHED) + """SELECT batch_no, event_id,
  'inventory quantity cannot be negative after applying event' AS error FROM placed WHERE NOT ok""",
    "batch_metrics": _with(BATCHED) + """SELECT count(*) AS total_batches_processed,
  CAST(sum(total_events) AS BIGINT) AS total_events_processed, CAST(sum(successful_events) AS BIGINT) AS total_successful_events,
  CAST(sum(failed_events) AS BIGINT) AS total_failed_events, CAST(sum(duplicate_events) AS BIGINT) AS total_duplicate_events,
  round(sum(ms), 2) AS total_processing_time_ms, round(min(ms), 2) AS min_batch_processing_time_ms,
  round(max(ms), 2) AS max_batch_processing_time_ms, round(avg(ms), 2) AS avg_batch_processing_time_ms,
  count(*) FILTER (status = 'failed') AS total_batch_failures,
  count(*) FILTER (status = 'partial_failure') AS total_partial_failures,
  (SELECT count(*) FROM ev WHERE event_type = 'click') AS total_redis_pipeline_operations,
  (SELECT count(*) FROM ev WHERE event_type = 'click' AND event_no % 13 = 0) AS total_redis_pipeline_errors,
  (SELECT count(*) FROM ev WHERE event_type <> 'click') AS total_database_operations,
  (SELECT count(*) FROM ev WHERE event_type <> 'click' AND event_no % 13 = 0) AS total_database_errors FROM outcomes""",
    "outcome_counters": """SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'retried' ELSE 'processed' END AS outcome,
  CAST(sum(greatest(event_id % 4 - 1, 0)) AS BIGINT) AS total FROM events GROUP BY 1""",
    "duration_histogram": """SELECT event_type AS outcome, round(any_value(total), 2) AS duration_sum, le,
  count(*) FILTER (seconds <= bound) AS observations
FROM (SELECT event_type, value / 10 AS seconds, sum(value / 10) OVER (PARTITION BY event_type) AS total FROM events) e
CROSS JOIN (VALUES ('0.001', 0.001::DOUBLE), ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1),
  ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5), ('5.0', 5.0), ('10.0', 10.0), ('+Inf', 'inf'::DOUBLE)) b(le, bound)
GROUP BY ALL""",
}
