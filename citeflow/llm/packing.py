"""Packing by concatenation and cut: all documents in one long row of ids, cut into fixed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.llm.tokens import cut_pieces, token_table


def pack_documents(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    length: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    Documents follow each other in the order of the input's partitions, each closed by ``end_id``.
    Windows of ``length`` ids are the sequences; only the last can be short, so at most ``length - 1``
    ids of padding arise in all. Null or empty text gives ``end_id`` alone; repeated rows and ids,
    null ids and ties are documents of their own; an empty table gives no pieces; other columns are
    ignored.
    """
    if length < 1:
        raise ValueError("length must be positive")
    tokens = token_table(docs, tokenizer_path=tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col)
    return cut_pieces(tokens, length, id_col=id_col)


def piece_digests(pieces: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with the CRC-32 of the ids in their place."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
