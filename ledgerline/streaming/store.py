"""Output tables of the streaming job, replay-safe on plain Parquet.

Every micro-batch owns one folder per table and overwrites it when it is replayed. It first writes down its processing
time, which a replay reads back, and only ever reads folders of earlier batches, so a replay computes the same result.
Its commit marker is written last; :meth:`Store.committed` shows readers whole batches only.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import schemas as S

_BALANCES = T.StructType([
    T.StructField("product_id", T.StringType()), T.StructField("store_id", T.StringType()),
    T.StructField("quantity", T.LongType())])
_MESSAGES = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
# Arrival order, which tells apart changes of one processing time.
_HISTORY = T.StructType([*S.INVENTORY_HISTORY.fields, T.StructField("sequence", T.LongType())])
_SALES = T.StructType([*S.SALES.fields, T.StructField("sequence", T.LongType())])
_CLOCK = T.StructType([T.StructField("at", T.TimestampType())])
_OUTCOMES = T.StructType([
    T.StructField("outcome", T.StringType()), T.StructField("count", T.LongType()), T.StructField("seconds", T.DoubleType())])
_BATCH_LOG = T.StructType([
    T.StructField("total_events", T.LongType()), T.StructField("successful_events", T.LongType()),
    T.StructField("failed_events", T.LongType()), T.StructField("duplicate_events", T.LongType()),
    T.StructField("processing_time_ms", T.DoubleType()), T.StructField("status", T.StringType())])

TABLES: dict[str, T.StructType] = {
    "inventory_history": _HISTORY, "sales": _SALES, "anomalies": S.ANOMALIES, "alerts": S.ALERTS,
    "processed_events": S.PROCESSED_EVENTS, "failed_events": S.FAILED_EVENTS, "balances": _BALANCES,
    "balance_base": _BALANCES, "dlq": _MESSAGES, "alert_messages": _MESSAGES, "cache": _MESSAGES,
    "batch_log": _BATCH_LOG, "outcomes": _OUTCOMES, "clock": _CLOCK, "commits": _CLOCK,
}


def _numbered(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


@dataclass(frozen=True)
class Store:
    """``compact_every``: a full balance snapshot is written once per so many batches and must stay the same for
    the life of a store; in between, a batch only writes the balances it changed."""

    spark: SparkSession
    root: str
    compact_every: int = 100

    def begin(self, batch_id: int, at: datetime) -> datetime:
        """The processing time of a batch: ``at`` the first time, and what was written down then in a replay."""
        path = f"{self.root}/clock/batch_id={batch_id}"
        if self._exists(f"{path}/_SUCCESS"):
            return self._utc(self.spark.read.schema(_CLOCK).parquet(path).select(F.unix_micros("at")).first()[0])
        self.write("clock", batch_id, self._moment(at))
        return at

    def commit(self, batch_id: int, at: datetime) -> None:
        self.write("commits", batch_id, self._moment(at))

    def committed(self, name: str) -> DataFrame:
        """Rows of whole batches."""
        read = self.spark.read.option("ignoreMissingFiles", "true")
        done = read.schema(_numbered(_CLOCK)).parquet(f"{self.root}/commits").select("batch_id")
        return read.schema(_numbered(TABLES[name])).parquet(f"{self.root}/{name}").join(done, "batch_id", "left_semi")

    def since(self, batch_id: int, at: datetime, seconds: int | None) -> int:
        """The first batch processed within ``seconds`` before ``at``; batch 0 if there is no bound."""
        if seconds is None or batch_id == 0:
            return 0
        recent = self.before("clock", batch_id).where(F.col("at") >= F.lit(at - timedelta(seconds=seconds)))
        first = recent.agg(F.min("batch_id")).first()[0]
        return batch_id if first is None else first

    def _moment(self, at: datetime) -> DataFrame:
        return self.spark.range(1).select(F.lit(at).alias("at"))

    @staticmethod
    def _utc(micros: int) -> datetime:
        return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)

    def _exists(self, path: str) -> bool:
        file = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(file)

    def write(self, name: str, batch_id: int, frame: DataFrame) -> None:
        schema = TABLES[name]
        shaped = frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        shaped.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def write_all(self, batch_id: int, frames: dict[str, DataFrame]) -> None:
        """Independent tables are written side by side; each one is a small job."""
        with ThreadPoolExecutor(len(frames)) as pool:
            list(pool.map(lambda item: self.write(item[0], batch_id, item[1]), frames.items()))

    def before(self, name: str, batch_id: int, since: int = 0) -> DataFrame:
        """Rows of all batches in [since, batch_id); other folders are pruned."""
        schema = _numbered(TABLES[name])
        if batch_id <= since:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("ignoreMissingFiles", "true")
        return read.parquet(f"{self.root}/{name}").where(F.col("batch_id").between(since, batch_id - 1))

    def balances_before(self, batch_id: int) -> DataFrame:
        """Balances as the earlier batches left them."""
        start = batch_id // self.compact_every * self.compact_every
        changed = self.before("balances", batch_id, start)
        if start > 0:
            base = self.spark.read.schema(_BALANCES).parquet(f"{self.root}/balance_base/batch_id={start}")
            changed = changed.unionByName(base.withColumn("batch_id", F.lit(start - 1).cast("long")))
        return changed.groupBy("product_id", "store_id").agg(F.max_by("quantity", "batch_id").alias("quantity"))

    def compact_balances(self, batch_id: int) -> None:
        """Write the base that batches from ``batch_id`` on start from, when one is due."""
        if batch_id == 0 or batch_id % self.compact_every:
            return
        start = batch_id - self.compact_every
        changed = self.before("balances", batch_id, start)
        if start > 0:
            base = self.spark.read.schema(_BALANCES).parquet(f"{self.root}/balance_base/batch_id={start}")
            changed = changed.unionByName(base.withColumn("batch_id", F.lit(start - 1).cast("long")))
        latest = changed.groupBy("product_id", "store_id").agg(F.max_by("quantity", "batch_id").alias("quantity"))
        self.write("balance_base", batch_id, latest)
