"""Token shards in training order.

The global order of training is a keyed permutation of the sequence numbers: a four-round Feistel
network over the next even number of bits, walked until it falls below the number of sequences. No
table of the order is ever made; sequences are range-partitioned by slot and written as shards of
records of one stride, so that a reader finds any slot by arithmetic and can resume anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from citeflow.llm.shared import new_path, worker_memory
from citeflow.llm.tokens import by_bytes, token_table, with_offsets

#: Ends every record: an id pair that no vocabulary below 65,535 has.
RECORD_END = "\u0000\u0000"
BYTES = 2
#: Records that a reader hands on at once.
READ_RECORDS = 256


def _round(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    """splitmix64 of the half block, the key and the round."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((key + (turn + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """The slots of ``index`` under a keyed permutation of ``range(n)``."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for turn in range(rounds):
            left, right = right, left ^ (_round(right, key, turn) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo[todo] = out[todo] >= n
    return out.astype(np.int64)


def write_shards(
    docs: DataFrame,
    path: str,
    *,
    tokenizer_path: str,
    length: int = 2048,
    end_id: int = 2,
    pad_id: int = 0,
    key: int = 2024,
    shard_records: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write ``path/shard=N/part-*`` and return the plan of pieces (id, sequence, slot, shard, offset).

    A record is ``length`` little-endian unsigned 16-bit ids (the last sequence padded with ``pad_id``)
    and a two-byte end mark, so record r of a shard begins at ``r * 2 * (length + 1)`` and slot s is
    record ``s % shard_records`` of shard ``s // shard_records``. One task writes a shard as one file;
    a lost task writes it again, and the same input in the same partitions gives the same bytes. Null
    and empty texts give ``end_id`` alone; an empty table writes no shard.
    """
    tokens = token_table(docs, tokenizer_path=tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col)
    parts = sequence_parts(tokens, length=length, key=key).withColumn("shard", F.expr(f"slot div {shard_records}"))
    body = parts.select("slot", "shard", F.struct("offset", F.col("raw").cast("string").alias("raw")).alias("part"), "length")
    records = body.repartitionByRange("shard").groupBy("shard", "slot").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("length").alias("n"))
    pad = F.lit(int(pad_id).to_bytes(BYTES, "little")).cast("string")
    value = F.concat(F.array_join(F.transform("parts", lambda p: p["raw"]), ""), F.repeat(pad, (F.lit(length) - F.col("n")).cast("int")))
    (
        records.select("shard", "slot", value.alias("value"))
        .sortWithinPartitions("shard", "slot")
        .select("value", "shard")
        .write.option("lineSep", RECORD_END)
        .partitionBy("shard")
        .text(path)
    )
    pieces = slotted_pieces(tokens.drop("_ids"), length=length, key=key, shard_records=shard_records)
    return pieces.select(id_col, "start", "length", "sequence_id", "slot", "shard", "offset")


def sequence_parts(tokens: DataFrame, *, length: int, key: int) -> DataFrame:
    """(slot, offset, length, raw): the ids of documents that stand next to each other, cut into sequences.

    A batch's documents are one or more stretches of the whole row of ids; each is cut once, so that
    neither a long document nor many short ones are copied for each sequence that they touch.
    """
    n = _sequences(tokens, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("shards")  # lets go of the tokenizer
        for whole in batches:
            for batch in by_bytes(whole, 2):
                starts, counts = (batch.column(k).to_numpy() for k in (0, 1))
                raws, breaks = batch.column(2).to_pylist(), np.nonzero(starts[1:] != starts[:-1] + counts[:-1])[0] + 1
                for a, b in zip([0, *breaks], [*breaks, len(raws)], strict=True):
                    run, first, end = b"".join(raws[a:b]), int(starts[a]), int(starts[b - 1] + counts[b - 1])
                    sequence = np.arange(first // length, (end - 1) // length + 1)
                    lo, hi = np.maximum(sequence * length, first), np.minimum((sequence + 1) * length, end)
                    data = [run[BYTES * (x - first) : BYTES * (y - first)] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(permute(sequence, n, key)), pa.array(lo - sequence * length), pa.array(hi - lo), pa.array(data, pa.binary())], names=["slot", "offset", "length", "raw"])

    return with_offsets(tokens).select("_start", "_n", "_ids").mapInArrow(cut, "slot long, offset long, length long, raw binary")


def _sequences(tokens: DataFrame, length: int) -> int:
    return -(-(tokens.agg(F.sum("_n")).first()[0] or 0) // length)


def slotted_pieces(tokens: DataFrame, *, length: int, key: int, shard_records: int) -> DataFrame:
    """A row for each part of a document in one sequence, with the sequence's slot and shard."""
    n = _sequences(tokens, length)

    @pandas_udf("long")
    def slot_of(sequence: pd.Series) -> pd.Series:
        return pd.Series(permute(sequence.to_numpy(), n, key))

    placed = with_offsets(tokens).withColumn("_end", F.col("_start") + F.col("_n"))
    placed = placed.withColumn("sequence_id", F.explode(F.expr(f"sequence(_start div {length}, (_end - 1) div {length})")))
    first = F.col("sequence_id") * length
    begin, end = F.greatest(first, F.col("_start")), F.least(first + length, F.col("_end"))
    placed = placed.withColumns({"offset": begin - first, "start": begin - F.col("_start"), "length": end - begin})
    placed = placed.withColumn("slot", slot_of("sequence_id"))
    return placed.withColumn("shard", F.expr(f"slot div {shard_records}"))


def read_shards(spark: SparkSession, path: str, *, length: int, shard_records: int, first_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, ids) of every record from ``first_slot`` on, by arithmetic alone.
    ``path`` has a shard at least; shards before the first are not read."""
    stride = BYTES * (length + 1)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("shards")  # lets go of the tokenizer
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                if len(raw) % stride:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                begin, end = max(0, first_slot - shard * shard_records), len(raw) // stride
                for at in range(begin, end, READ_RECORDS):
                    k = np.arange(at, min(end, at + READ_RECORDS), dtype=np.int64)
                    ids = [raw[i * stride : (i + 1) * stride - BYTES].view("<u2").astype("<u4").tobytes() for i in k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard * shard_records + k), pa.array(np.full(len(k), shard, np.int64)), pa.array(k * stride), pa.array(ids, pa.binary())],
                        names=["slot", "shard", "byte_offset", "ids"],
                    )

    # The folder's name is a partition column, so that earlier shards are neither opened nor read.
    files = spark.read.format("binaryFile").load(path).select("shard", "content").where(F.col("shard") >= first_slot // shard_records)
    return files.mapInArrow(records, "slot long, shard long, byte_offset long, ids binary")


def shard_report(docs: DataFrame, *, tokenizer_path: str, length: int = 2048, shard_records: int = 4096, id_col: str = "doc_id", **options) -> DataFrame:
    """Write the shards of ``docs`` in the shared folder, read them back, and describe each sequence."""
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    plan = write_shards(docs, path, tokenizer_path=tokenizer_path, length=length, shard_records=shard_records, id_col=id_col, **options)
    held = plan.groupBy("sequence_id", "slot", "shard").agg(
        F.array_sort(F.collect_list(F.struct("offset", F.col(id_col).alias("doc_id")))).alias("_docs"), F.sum("length").alias("n_tokens")
    )
    described = ["slot", "sequence_id", "shard", "byte_offset", "n_tokens", "ids_crc32", F.col("_docs.doc_id").alias("doc_ids")]
    if held.isEmpty():
        return held.withColumns({"byte_offset": F.lit(0).cast("long"), "ids_crc32": F.lit(0).cast("long")}).select(described)
    back = read_shards(spark, path, length=length, shard_records=shard_records).select("slot", "byte_offset", F.crc32("ids").alias("ids_crc32"))
    return held.join(back, "slot").select(described)
