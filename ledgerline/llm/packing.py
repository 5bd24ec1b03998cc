"""Packing (7): concatenate all documents and cut the stream into windows of fixed length.

Pass one encodes each document, ends it with ``end_id`` and writes it with its partition and its start inside that
partition (a running sum in the task). The partitions' totals, one row each, are summed up to global bases. Pass two
adds the base to each start and cuts every document at the multiples of the window: only the last window of the whole
stream can be short. Neither pass shuffles tokens, and since pass one is a written table, the order of the stream is
fixed even if a task runs again.

Defined results: null text is empty, so its document is ``end_id`` alone; repeated rows are packed each; an empty table
gives no pieces. A document that crosses a boundary gives one piece (boundary record) per window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.bpe import codec, texts_of
from ledgerline.llm.storage import scratch, ship

WINDOW = 2048
END_ID = 1


def token_stream(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                 end_id: int = END_ID) -> DataFrame:
    """Pass one, written: (key, part, at, n, ids), ``at`` being the tokens before the document in its partition."""
    ship(documents.sparkSession)
    schema = f"key {documents.schema[key].dataType.simpleString()}, part int, at bigint, n bigint, ids binary"
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, at = codec(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            row = 0
            for texts in texts_of(batch.column(1)):
                ids = [x + end for x in known.encode_many(texts)]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                ends = at + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(ids)), pa.array(np.full(len(ids), part, np.int32)),
                     pa.array(ends - sizes), pa.array(sizes), pa.array(ids, pa.binary())],
                    names=["key", "part", "at", "n", "ids"])
                row, at = row + len(ids), int(ends[-1])

    spark, folder = documents.sparkSession, scratch(documents.sparkSession, "token-stream")
    stream = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    stream.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(stream.schema).parquet(folder)


def bases(stream: DataFrame) -> DataFrame:
    """(part, base): the tokens of all partitions before each; one row per partition of pass one."""
    totals = stream.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))


def pack(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start in its document, length, CRC-32 of its ids, tokens of the document, sequence,
    offset in the sequence, and on request the ids themselves."""
    stream = token_stream(documents, path, key, text, end_id)
    kind = documents.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint" + ", ids binary" * with_ids)
    # 12 bytes for each partition of pass one: some megabytes for a million partitions.
    placed = stream.join(F.broadcast(bases(stream)), "part").select(
        "key", (F.col("base") + F.col("at")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            first = at // window
            pieces = (at + n - 1) // window - first + 1  # every document has its end, so n is never 0
            row = np.repeat(np.arange(len(at)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + number
            begin = np.maximum(at[row], sequence * window)
            length = np.minimum(at[row] + n[row], (sequence + 1) * window) - begin
            start = begin - at[row]
            ids = [memoryview(value) for value in batch.column(3).to_pylist()]
            parts = [ids[r][4 * s:4 * (s + m)] for r, s, m in zip(row.tolist(), start.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length),
                       pa.array([zlib.crc32(part) for part in parts], pa.int64()), pa.array(n[row]),
                       pa.array(sequence), pa.array(begin - sequence * window)]
            if with_ids:
                columns.append(pa.array([bytes(part) for part in parts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "length", "ids_crc32", "doc_tokens",
                                                             "sequence_id", "offset"] + ["ids"] * with_ids)

    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pieces packed with ``with_ids``; a short last sequence is padded up to
    ``window`` unless its length is a power of two."""
    # At most ``window`` pieces make up a sequence.
    joined = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts"),
        F.sum("length").alias("n_tokens"))
    padding = F.when(F.expr("(n_tokens & (n_tokens - 1)) = 0"), F.lit("")).otherwise(F.repeat(
        F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(window) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", "n_tokens", F.unhex(F.concat(
        F.array_join(F.col("parts.ids"), ""), padding)).alias("ids"))
