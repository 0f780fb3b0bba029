"""Exact duplicates by content sort, with DataFrame functions only.

Sampled splitters range-partition the texts, Spark's external sort places equal texts next to each
other, and the window operator compares neighbouring texts in full. A text with very many copies is
cut into salted runs, so that the splitters can spread it over partitions; the few heavy texts' runs
are then merged by a second, small aggregation on the full text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.llm.shared import materialise, row_hash, text_or_empty, wrapped

#: Characters of a text that the sampled splitters see.
HEAD = 32


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=None,
    keep: str = "largest",
    heavy_parts: int = 4096,
    least_heavy: int = 64,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``normalise`` maps the text column to the bytes to compare (default: no change). ``keep`` says
    which id of equal texts stays, ``largest`` or ``smallest``. Null text counts as empty. Null ids
    lose to any other id; a group of null ids only keeps one of its rows. Repeated rows with one id
    count singly, and one of them is kept. Other columns are ignored; an empty table gives an empty
    result. Digests only choose which texts get salted; equality is always that of whole texts.

    A text is heavy when it has more than ``max(least_heavy, rows / heavy_parts)`` copies, so there are
    fewer than ``heavy_parts`` heavy texts at any size, and only their digests are broadcast.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    text: Column = text_or_empty(text_col)
    d = docs.select(F.col(id_col).alias("_id"), (normalise(text) if normalise else text).alias("_text"))
    d = d.withColumn("_sha", F.sha2("_text", 256))

    sizes = materialise(d.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least_heavy), "sizes")
    limit = max(least_heavy, docs.count() // heavy_parts)
    heavy = sizes.where(F.col("_n") > limit).select("_sha", F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))

    best = F.desc_nulls_last if keep == "largest" else F.asc_nulls_last
    pick = F.max if keep == "largest" else F.min
    salted = d.join(F.broadcast(heavy), "_sha", "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1)))).cast("int")
    )
    # The splitters are sampled from the texts' heads and, for texts with one head, a number: keys of
    # about fifty bytes that equal texts share, as the driver holds a hundred of them a partition.
    salted = salted.withColumns({"_head": F.substring("_text", 1, HEAD), "_number": F.xxhash64("_text")})
    run = Window.partitionBy("_head", "_number", "_text", "_salt")
    runs = (
        salted.repartitionByRange("_head", "_number", "_salt")
        .withColumn("_row", F.row_number().over(run.orderBy(best("_id"))))
        .withColumn("_best", pick("_id").over(run))
        .withColumn("_size", F.count(F.lit(1)).over(run))
    )
    # Only the first row of a heavy text's run carries the text on.
    first = F.col("_salts").isNotNull() & (F.col("_row") == 1)
    runs = materialise(runs.select("_id", "_sha", "_salt", "_salts", "_row", "_best", "_size", F.when(first, F.col("_text")).alias("_text")), "runs")

    # A heavy text's runs are told apart by their best ids and, where these are equal, by their salts.
    large = keep == "largest"
    key = F.struct((F.col("_best").isNotNull() if large else F.col("_best").isNull()).alias("known"), F.col("_best").alias("id"), F.col("_salt").alias("salt"))
    heads = runs.where(first).select("_text", "_sha", "_salt", "_size", key.alias("_run"))
    whole = heads.groupBy("_text").agg(pick("_run").alias("_first"), F.sum("_size").alias("_total"))
    merged = heads.join(whole, "_text").select("_sha", "_salt", "_first", "_total")
    # Fewer than heavy_parts texts with rows / limit runs at most: under 2 * heavy_parts rows.
    out = runs.drop("_text").join(
        F.broadcast(merged.withColumnsRenamed({"_sha": "_h", "_salt": "_s"})),
        F.col("_salts").isNotNull() & (F.col("_sha") == F.col("_h")) & (F.col("_salt") == F.col("_s")),
        "left",
    )
    heavy_here = F.col("_total").isNotNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(heavy_here, F.col("_first.id")).otherwise(F.col("_best")).alias("keep_id"),
        F.coalesce("_total", "_size").cast("long").alias("group_size"),
        ((F.col("_row") == 1) & (~heavy_here | (F.col("_salt") == F.col("_first.salt")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", heavy_parts: int = 4096, least_heavy: int = 64) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    The same content sort, with the whole rows carried along, so that no text is written or joined
    again: the first row of each run stays, and of a heavy text's runs the best. Rows count singly,
    whatever their ids: null ids lose to any other, of rows with one id and text one stays (by a number of
    all their columns). Null text equals empty text; columns may have any names and types; an empty table stays empty.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    row = F.col("row")
    d = wrapped(docs, "row").select(row[id_col].alias("id"), F.coalesce(row[text_col], F.lit("")).alias("text"), "row")
    d = d.withColumns({"number": F.xxhash64("text"), "head": F.substring("text", 1, HEAD)})
    limit = max(least_heavy, docs.count() // heavy_parts)
    sizes = materialise(d.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit), "heavy")
    heavy = F.broadcast(sizes.select(F.col("number").alias("hot"), F.ceil(F.col("n") / limit).cast("int").alias("salts")))  # fewer than heavy_parts

    d = d.join(heavy, F.col("number") == F.col("hot"), "left").withColumn("tie", row_hash(row, docs.schema))
    best = [F.desc_nulls_last("id") if keep == "largest" else F.asc_nulls_last("id"), F.col("tie")]

    def first(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where("place = 1").drop("place")

    light = first(d.where(F.col("salts").isNull()).repartitionByRange("head", "number"), "head", "number", "text")
    # Heavy texts are cut into runs of about ``limit`` rows by a number of the row, whatever its id; the runs'
    # best rows, fewer than two for each of the heavy_parts in all, are written before the best of them stays.
    runs = d.where(F.col("salts").isNotNull()).withColumn("salt", F.pmod(F.monotonically_increasing_id(), "salts"))
    runs = materialise(first(runs.repartitionByRange("head", "number", "salt"), "head", "number", "text", "salt"), "runs")
    kept = light.select("row").unionByName(first(runs, "number", "text").select("row"))
    return kept.select(*[row[c].alias(c) for c in docs.columns])
