"""Column expressions shared by batch and streaming operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_delta(operation: Column, quantity: Column) -> Column:
    """Stock effect of an operation: sales take away, everything else adds its (signed) quantity."""
    return F.when(operation == "SALE", -quantity.cast("long")).otherwise(quantity.cast("long"))


def change_type(operation: Column) -> Column:
    return F.when(operation == "MANUAL_ADJUSTMENT", F.lit("adjustment")).otherwise(F.lower(operation))


def stable_id(*parts: Column | str) -> Column:
    """UUID-shaped id derived from a natural key, so that a retried task writes the same id."""
    digest = F.sha2(F.concat_ws("\u0001", *parts), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


def inventory_id(store: Column | str, product: Column | str) -> Column:
    return stable_id(F.lit("inventory"), store, product)


def snapshot_key(store: Column, product: Column) -> Column:
    return F.concat(F.lit("inventory:"), store, F.lit(":"), product)


def severity_above(measure: Column, critical: float, high: float, medium: float) -> Column:
    """Severity ladder with strict thresholds."""
    return (
        F.when(measure > critical, F.lit("critical"))
        .when(measure > high, F.lit("high"))
        .when(measure > medium, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def seconds_between(start: Column, end: Column) -> Column:
    return F.expr("1.0D") * (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def all_of(conditions: Sequence[Column]) -> Column:
    combined = F.lit(True)
    for condition in conditions:
        combined = combined & condition
    return combined
