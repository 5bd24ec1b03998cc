"""Event sources and message sinks: S1-S4, S5/S6 transport.

Kafka is used where its connector is installed; a folder of JSON records with the same envelope stands in for it
elsewhere. Both deliver (value, topic, partition, offset) and keep their position in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.deadletter import TIMESTAMP_FORMAT
from ledgerline.schemas import ENVELOPE, INVENTORY_TOPIC, SALES_TOPIC

STOCK_FIELDS = ("event_id", "product_id", "store_id", "operation", "quantity", "timestamp")
SALE_FIELDS = ("event_id", "sale_id", "product_id", "store_id", "quantity_sold", "sale_price", "timestamp")


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topics: Sequence[str] = (INVENTORY_TOPIC, SALES_TOPIC),
    max_records: int | None = None,
) -> DataFrame:
    """From the earliest offset; a micro-batch takes what has arrived, or at most ``max_records``."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
    )
    if max_records is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_records)
    raw = reader.load()
    return raw.select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset")


def folder_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ENVELOPE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def stock_event_messages(events: DataFrame) -> DataFrame:
    """Stock events as keyed JSON messages. The key is the event id, so order is per id, not per product."""
    return _messages(events, STOCK_FIELDS)


def sales_event_messages(events: DataFrame) -> DataFrame:
    """S4 for sales; the price travels as text to keep its digits."""
    return _messages(events.withColumn("sale_price", F.col("sale_price").cast("string")), SALE_FIELDS)


def _messages(events: DataFrame, fields: Sequence[str]) -> DataFrame:
    options = {"ignoreNullFields": "false", "timestampFormat": TIMESTAMP_FORMAT}
    return events.select(F.col("event_id").alias("key"), F.to_json(F.struct(*fields), options).alias("value"))


def send_to_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Write (key, value) messages, acknowledged by all replicas."""
    (messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all")
     .option("topic", topic).save())


def kafka_sink(servers: str) -> Callable[[str, DataFrame, int], None]:
    """Deliver the messages of a micro-batch to their topic. A replayed batch delivers them again."""
    return lambda topic, messages, batch_id: send_to_kafka(messages, servers, topic)


def folder_sink(root: str) -> Callable[[str, DataFrame, int], None]:
    """The same to a folder of JSON files per topic and micro-batch; a replayed batch overwrites its own."""
    return lambda topic, messages, batch_id: messages.write.mode("overwrite").json(f"{root}/{topic}/batch_id={batch_id}")
