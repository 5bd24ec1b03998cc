"""Event contract as column expressions: F1-F6, F8.

Payloads are parsed once into a VARIANT, which keeps the JSON type of every field. That matters because the
contract accepts ``5``, ``5.0`` and ``"5"`` as a quantity but only a JSON string as an id, and because an absent
timestamp defaults to the processing time while an explicit null is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import schemas as S
from ledgerline import texts

# Accepted notations.
_NUMERAL = r"\A\s*[+-]?[0-9]+(_[0-9]+)*(\.0+)?\s*\z"
_DECIMAL = r"\A\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"
_ZONED = r"\A\d{4}-\d{2}-\d{2}[Tt _]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s?([Zz]|[+-]\d{2}:?\d{2})\z"
# What nearly all timestamps look like; Spark reads it as it is.
_PLAIN_ZONED = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z\z"
_NAIVE = r"\A\d{4}-\d{2}-\d{2}([Tt _]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?\z"
_UUID = r"\A(urn:uuid:)?\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?\z"
_CANONICAL_UUID = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
_BRACE = r"\A[\x20\t\r\n]*\{"
_MILLISECONDS_FROM = 20_000_000_000

_DOC, _OBJECT, _PRICE = "_doc", "_is_object", "_price"


def _computed_once(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections reuse instead of evaluating again.

    A one-element ``inline`` is a boundary the optimizer does not merge expressions across. Without it a filter on
    the final reason would carry a copy of the whole parser, for every filter in a plan.
    """
    return frame.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _text(name: str) -> Column:
    return F.col(f"_text_{name}")


def _kind(name: str) -> Column:
    """JSON type of a field: NULL when absent, VOID for an explicit null."""
    return F.col(f"_kind_{name}")


def _parse(envelopes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Parse once, then read text and JSON type of each field. Broken JSON leaves all of them NULL."""
    parsed = _computed_once(envelopes, {_DOC: F.try_parse_json("value")})
    # Valid JSON that begins with a brace is an object; its whole schema is not needed for that.
    fields = {_OBJECT: F.coalesce(F.col(_DOC).isNotNull() & F.col("value").rlike(_BRACE), F.lit(False))}
    for name in names:
        fields[f"_text_{name}"] = F.try_variant_get(F.col(_DOC), f"$.{name}", "string")
        fields[f"_kind_{name}"] = F.schema_of_variant(F.try_variant_get(F.col(_DOC), f"$.{name}", "variant"))
    return _computed_once(parsed, fields)


def _string(name: str) -> Column:
    return F.when(_kind(name) == "STRING", _text(name))


def _is_number(name: str) -> Column:
    return (_kind(name) == "BIGINT") | (_kind(name) == "DOUBLE") | _kind(name).startswith("DECIMAL")


def _whole_number(name: str) -> Column:
    text = _text(name)
    number = text.try_cast("decimal(38,10)")
    plain = F.regexp_replace(F.trim(text), r"_|\.0+$", "").try_cast("bigint")
    return (
        F.when((_kind(name) == "STRING") & text.rlike(_NUMERAL), plain)
        .when(_kind(name) == "BOOLEAN", (text == "true").cast("bigint"))
        .when(_is_number(name) & (number == F.floor(number)), number.try_cast("bigint"))
    )


def _money(name: str) -> Column:
    text = F.trim(_text(name))
    readable = _is_number(name) | ((_kind(name) == "STRING") & text.rlike(_DECIMAL))
    return F.when(readable, F.coalesce(text.try_cast("decimal(38,10)"), text.try_cast("double").try_cast("decimal(38,10)")))


def _instant(name: str) -> Column:
    """Zoned timestamp text, or seconds / milliseconds since the epoch. Naive times stay NULL."""
    text = _text(name)
    spaced = F.regexp_replace(F.upper(text), r"[_ ](?=\d{2}:\d{2})", "T")
    dotted = F.regexp_replace(F.regexp_replace(spaced, ",", "."), r"\s", "")
    seconds = F.regexp_replace(dotted, r"(T\d{2}:\d{2})(?=Z|[+-])", "$1:00")
    zoned = F.regexp_replace(seconds, r"([+-]\d{2})(\d{2})$", "$1:$2")
    epoch = text.try_cast("decimal(38,6)")
    scaled = F.when(F.abs(epoch) > _MILLISECONDS_FROM, epoch / 1000).otherwise(epoch)
    numeric = _is_number(name) | ((_kind(name) == "STRING") & text.rlike(_DECIMAL))
    return (
        F.when((_kind(name) == "STRING") & text.rlike(_PLAIN_ZONED), text.try_cast("timestamp"))
        .when((_kind(name) == "STRING") & text.rlike(_ZONED), zoned.try_cast("timestamp"))
        .when(numeric, F.timestamp_micros((scaled * 1_000_000).try_cast("bigint")))
    )


def _uuid(name: str) -> Column:
    text = _string(name)
    digits = F.lower(F.regexp_replace(text, r"urn:uuid:|[{}-]", ""))
    canonical = F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    # Nearly all ids come in the canonical form, which needs no rewriting.
    return F.when(text.rlike(_CANONICAL_UUID), text).when(text.rlike(_UUID), canonical)


def first_reason(checks: Sequence[tuple[Column, str]]) -> Column:
    """Text of the first failing check, NULL when all hold. A check that is NULL counts as failed."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in checks])


def _identifier(name: str) -> tuple[Column, str]:
    value = F.col(name)
    ok = value.rlike(S.IDENTIFIER_PATTERN) & F.length(value).between(1, S.IDENTIFIER_MAX_LENGTH)
    return ok, f"{name} is not a valid identifier"


def _event_time(as_of: Column) -> Column:
    return F.when(_kind("timestamp").isNull(), as_of).otherwise(_instant("timestamp"))


def _timestamp_checks() -> list[tuple[Column, str]]:
    # A text that gave an instant has a zone.
    naive = F.col("event_time").isNull() & (_kind("timestamp") == "STRING") & _text("timestamp").rlike(_NAIVE)
    return [
        (~F.coalesce(naive, F.lit(False)), texts.NOT_ZONED),
        (F.col("event_time").isNotNull(), "timestamp is not a valid instant"),
    ]


def _contract(
    envelopes: DataFrame, names: Sequence[str], fields: dict[str, Column], checks: list[tuple[Column, str]],
    read: dict[str, Column] | None = None,
) -> DataFrame:
    """Typed fields plus ``detail``, the first broken structural rule. The checks see the typed fields.

    ``read`` holds columns that both the fields and the checks use.
    """
    whole = [(F.col(_DOC).isNotNull(), "payload is not valid JSON"), (F.col(_OBJECT), "payload is not an object")]
    claimed = {"claimed_event_id": F.when(F.col(_OBJECT), _text("event_id"))}
    parsed = _parse(envelopes, names)
    typed = _computed_once(_computed_once(parsed, read) if read else parsed, {**fields, **claimed})
    checked = _computed_once(typed, {"detail": first_reason(whole + checks)})
    return checked.drop(_DOC, _OBJECT, *[f"_{part}_{n}" for n in names for part in ("text", "kind")])


def parse_stock_events(envelopes: DataFrame, as_of: Column) -> DataFrame:
    """F1 + F2: typed stock event fields next to the envelope, and ``detail`` for a broken structure."""
    quantity, operation = F.col("quantity"), F.col("operation")
    fields = {
        "event_id": _uuid("event_id"), "product_id": _string("product_id"), "store_id": _string("store_id"),
        "operation": _string("operation"), "quantity": _whole_number("quantity"), "event_time": _event_time(as_of),
    }
    checks = [
        (F.col("event_id").isNotNull(), "event_id is not a UUID"),
        _identifier("product_id"),
        _identifier("store_id"),
        (operation.isin(*S.OPERATIONS), "operation is not supported"),
        (quantity.between(-S.QUANTITY_LIMIT, S.QUANTITY_LIMIT), "quantity is not an integer within the limits"),
        *_timestamp_checks(),
        ((operation != "MANUAL_ADJUSTMENT") | (quantity != 0), texts.ZERO_ADJUSTMENT),
        *[((operation != op) | (quantity > 0), texts.NOT_POSITIVE % op) for op in S.POSITIVE_OPERATIONS],
    ]
    return _contract(envelopes, S.RAW_INVENTORY_EVENT.fieldNames(), fields, checks)


def parse_sales_events(envelopes: DataFrame, as_of: Column) -> DataFrame:
    """F4 + F6 for sales messages."""
    sale_id, price = F.col("sale_id"), F.col(_PRICE)
    absent_price = _kind("sale_price").isNull() | (_kind("sale_price") == "VOID")
    fields = {
        "event_id": _uuid("event_id"), "sale_id": _string("sale_id"), "product_id": _string("product_id"),
        "store_id": _string("store_id"), "quantity_sold": _whole_number("quantity_sold"),
        "sale_price": F.round(price, 2).try_cast("decimal(12,2)"), "event_time": _event_time(as_of),
    }
    not_blank = sale_id.rlike(r"(?U)\S")
    checks = [
        (F.col("event_id").isNotNull(), "event_id is not a UUID"),
        (F.length(sale_id).between(1, S.IDENTIFIER_MAX_LENGTH), "sale_id length is out of range"),
        (not_blank, texts.BLANK_SALE_ID),
        _identifier("product_id"),
        _identifier("store_id"),
        (F.col("quantity_sold").between(1, S.QUANTITY_LIMIT), "quantity_sold is not an integer within the limits"),
        (absent_price | price.isNotNull(), "sale_price is not a number"),
        (absent_price | (price >= 0), texts.NEGATIVE_PRICE),
        (absent_price | F.col("sale_price").isNotNull(), "sale_price is out of range"),
        *_timestamp_checks(),
    ]
    return _contract(envelopes, S.RAW_SALES_EVENT.fieldNames(), fields, checks, {_PRICE: _money("sale_price")}).drop(_PRICE)


def business_reason(as_of: Column, skew_seconds: int = S.MAX_FUTURE_SKEW_SECONDS) -> Column:
    """The one rule that structure does not already enforce. Exactly ``skew_seconds`` ahead is fine."""
    limit = F.unix_micros(as_of) + skew_seconds * 1_000_000
    return F.when(F.unix_micros("event_time") > limit, F.lit(texts.TOO_FAR_AHEAD))


def _validated(parsed: DataFrame, as_of: Column, skew: int, broken: str, refused: str) -> DataFrame:
    late = business_reason(as_of, skew)
    reason = (
        F.when(F.col("detail").isNotNull(), F.lit(broken))
        .when(late.isNotNull(), F.concat(F.lit(f"{refused}:"), late))
    )
    return _computed_once(parsed, {"failure_reason": reason})


def validate_stock_events(envelopes: DataFrame, as_of: Column, skew_seconds: int = S.MAX_FUTURE_SKEW_SECONDS) -> DataFrame:
    """All stock records with ``failure_reason`` (NULL = good)."""
    parsed = parse_stock_events(envelopes, as_of)
    return _validated(parsed, as_of, skew_seconds, texts.BROKEN_STOCK_RECORD, texts.REFUSED_STOCK_RECORD)


def validate_sales_events(envelopes: DataFrame, as_of: Column, skew_seconds: int = S.MAX_FUTURE_SKEW_SECONDS) -> DataFrame:
    """All sales records with ``failure_reason`` (NULL = good)."""
    parsed = parse_sales_events(envelopes, as_of)
    return _validated(parsed, as_of, skew_seconds, texts.BROKEN_SALES_RECORD, texts.REFUSED_SALES_RECORD)


def good(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("failure_reason").isNull())


def bad(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("failure_reason").isNotNull())


def reason_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy(F.coalesce("failure_reason", F.lit("valid")).alias("failure_reason"),
                             F.coalesce("detail", F.lit("")).alias("detail")).agg(F.count(F.lit(1)).alias("records"))
