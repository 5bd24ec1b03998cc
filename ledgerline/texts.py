"""Texts that downstream consumers of failures, anomalies and alerts match on."""

# Failure reasons of broker records.
BROKEN_STOCK_RECORD = "invalid_event_payload"
BROKEN_SALES_RECORD = "invalid_sales_event_payload"
REFUSED_STOCK_RECORD = "invalid_inventory_event"
REFUSED_SALES_RECORD = "invalid_sales_event"
REFUSED_BY_LEDGER = "non_retryable_failure"

# Why a record or a movement was refused.
TOO_FAR_AHEAD = "timestamp is too far in the future"
NOT_ZONED = "timestamp must be timezone-aware"
ZERO_ADJUSTMENT = "quantity must be non-zero for MANUAL_ADJUSTMENT"
NOT_POSITIVE = "quantity must be positive for %s"
BLANK_SALE_ID = "sale_id must not be blank"
NEGATIVE_PRICE = "sale_price must be non-negative"
BELOW_ZERO = "inventory quantity cannot be negative after applying event"
UNKNOWN_PRODUCT = "no inventory record for product_id='%s' store_id='%s'"
TOO_LITTLE_STOCK = "insufficient stock: available=%d, requested=%d"
USED_EVENT_ID = "event_id already recorded in history"

# Anomaly types and descriptions.
NEGATIVE_INVENTORY = ("negative_inventory", "Negative inventory detected: %d units for SKU %s")
SALES_SPIKE = ("sudden_sales_spike", "Sales spike detected: maximum sale %d units is %sx the average of %s units")
LARGE_ADJUSTMENT = ("large_inventory_adjustment", "Large adjustment detected: %d units (%s%%) from %d to %d units")
RAPID_SALES = ("rapid_consecutive_sales", "Rapid sales detected: %d transactions (%d units total) in %d seconds")

# Alerts.
ALERT_TITLE = "Alert: "
