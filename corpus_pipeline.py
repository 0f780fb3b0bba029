"""From raw documents to packed training sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeflow.llm.exact_dedup import drop_duplicates
from citeflow.llm.langid import keep_identified
from citeflow.llm.mixing import mix_documents
from citeflow.llm.ngram_join import drop_near_duplicates
from citeflow.llm.packing import pack_documents, piece_digests
from citeflow.llm.queries import tokenizer_path
from citeflow.llm.shared import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network takes for one of the languages it learned from ``docs``.

    Those with null text, without a letter, or with a score that no language reaches go. Null labels are
    predicted like others; repeated rows and null ids stay; an empty table stays empty; all columns are kept.
    """
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts: that of the largest id, null ids last, one row of repeated ones.

    Null text equals empty text; an empty table stays empty; all columns are kept."""
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id, null ids last.

    Null and empty texts are one class, as are equal texts without words; texts may have any length;
    an empty table stays empty; all columns are kept."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; the one at a cut with its first words.

    Null sources are one source; documents without words stay once; rows with null or repeated ids are
    documents of their own; an empty table stays empty; all columns are kept."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, one row each.

    Null and empty texts give the closing id alone; rows with null or repeated ids are documents of their
    own; an empty table gives no pieces; other columns are left behind."""
    return piece_digests(pack_documents(docs, tokenizer_path=tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: Language identification and packing have no SQL; tests/llm/test_row_identity.py compares the whole run with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
