"""Resumable ingestion: chunks of newly arrived documents, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from citeflow.operators.corpus import chunk_documents


def ingest_chunks(spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType, *, id_col: str = "doc_id", **options) -> None:
    """Chunk every document under ``source`` that earlier runs with this checkpoint have not seen."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_documents(batch, id_col=id_col, **options).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
