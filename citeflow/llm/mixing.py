"""Mixing sources to target weights.

Documents get hash-random keys. Within a source they are ordered by key: equal ranges of the key are
the blocks of a range sort, running sums inside blocks plus sums over blocks are the distributed prefix
sums, and each source is cut exactly where its budget ends, after whole epochs where it is large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.llm.shared import materialise, row_hash, wrapped

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source that share a block of the key, about, once there are more than 4096 such blocks.
BLOCK_ROWS = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Sources in code-point order (null last) take the weights in turn. All targets together are
    ``share`` times all sizes; none exceeds ``cap`` times its source's size, what is above is dealt to
    the others by weight. That fixed point fills sources in order of cap / weight: a source is
    capped exactly if its cap is below the level that the rest would get.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.select(
        "source", "source_size", "_w", "_cap", "_ratio",
        (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).alias("_left"),
        F.sum("_w").over(after).alias("_weights"),
    )
    # The first source, by ratio, that the level of those from it on does not cap ends the capping.
    level = level.withColumn("_free", F.col("_w") * F.col("_left") / F.col("_weights") <= F.col("_cap"))
    first = level.where("_free").agg(F.min_by(F.struct("_left", "_weights"), F.struct("_ratio", F.col("source").isNull(), "source")).alias("_at"), F.min("_ratio").alias("_from"))
    capped = F.col("_from").isNull() | (F.col("_w") * F.col("_at._left") / F.col("_at._weights") > F.col("_cap"))
    return level.crossJoin(first).select("source", "source_size", F.when(capped, F.col("_cap")).otherwise(F.col("_w") * F.col("_at._left") / F.col("_at._weights")).alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: id, ``size``, ``source``, ``source_size``, ``target``, ``taken``.

    ``size`` is the number of words (null text: 0), ``taken`` the words that the mix takes, repeats
    counted: whole epochs of the source, then its documents by key up to the rounded target; the
    document at the cut gives its first words only. Null sources form one source; null ids sort first
    among equal keys; repeated rows are documents of their own. ``row_col``, a number of each row, decides
    what is left of ties and comes with the result. Sources of size 0 get target 0. Only
    one row per source passes through a single task (a source is a column value, not a document).
    """
    d = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *([row_col] if row_col else []))
    d = materialise(d.withColumn("_key", _key("_id", seed)), "sizes")
    d = _taken(d, weights=weights, share=share, cap=cap, rows=d.count(), ties=["_id", "size", *([row_col] if row_col else [])])
    return d.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", "taken", *([row_col] if row_col else []))


def _key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _taken(d: DataFrame, *, weights: tuple[int, ...], share: float, cap: float, rows: int, ties: list[str]) -> DataFrame:
    """``d`` (``source``, ``size``, ``_key`` and others, about ``rows`` of them) with ``source_size``, ``target``
    and ``taken``. ``d`` is read twice: for the sums of its blocks, and to cut.

    Blocks are named by the key's first hex digits, by more of them for more rows; the order is that of
    the keys, whatever the number of digits. The join with the blocks has the window's keys, none of them
    null, so that rows are shuffled once even where Spark does not broadcast the blocks.
    """
    digits = max(3, math.ceil(math.log(max(rows, 1) / BLOCK_ROWS, 16)))
    d = d.withColumns({"_none": F.col("source").isNull(), "_name": F.coalesce(F.col("source").cast("string"), F.lit("")), "_block": F.substring("_key", 1, digits)})
    blocks = materialise(d.groupBy("source", "_block").agg(F.sum("size").alias("_sum")), "blocks")
    sources = blocks.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sources, weights=weights, share=share, cap=cap)
    earlier = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    starts = materialise(starts.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(F.col("a.source").isNull().alias("_none"), F.coalesce(F.col("a.source").cast("string"), F.lit("")).alias("_name"), "_block", "_start", "source_size", "target"), "starts")

    inside = Window.partitionBy("_none", "_name", "_block").orderBy("_key", *ties).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(starts, ["_none", "_name", "_block"])
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start") - F.col("_in")))
    return d.withColumn("taken", (epochs * F.col("size") + cut).cast("long"))


def _repeated(held: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The rows in ``doc`` of ``held`` (``doc``, ``size``, ``taken``) as often as they are taken, the last time
    with the first words that are left; those without words once."""
    held = held.where((F.col("taken") > 0) | (F.col("size") == 0))
    copies = F.greatest(F.lit(1), F.ceil(F.col("taken") / F.greatest("size", F.lit(1)))).cast("int")
    held = held.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    text = F.when(words >= F.col("size"), F.col("doc")[text_col]).otherwise(first_words(F.col("doc")[text_col], words))
    return held.select(*[text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in columns])


def apply_mix(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as mixed: a document taken for two epochs comes twice, one at the cut with its first
    words, one not taken not at all (but documents without words, which cost nothing, stay once).

    Rows of ``docs`` and ``mixed`` belong together by ``id_col``, which is unique in both (null ids match
    nothing: give rows a number first, as ``mix_documents`` does). Columns of any name are kept; an empty
    table gives an empty result."""
    plan = mixed.select(F.col(id_col).alias("id"), "size", "taken")
    # Both sides are wrapped, so that no column of ``docs`` can clash with one of the plan.
    held = wrapped(docs)
    joined = held.join(plan.select(F.struct("*").alias("plan")), F.col("doc")[id_col] == F.col("plan.id"))
    return _repeated(joined.select("doc", "plan.size", "plan.taken"), docs.columns, text_col)


def mix_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """``docs`` as ``mix_sources`` and ``apply_mix`` would have it, with any ids, null or repeated.

    The rows themselves are carried through the range sort, so no text is written or joined again; a
    number of all their columns decides between rows of one id and size (rows that it does not tell apart
    are equal). Columns of any name and type are kept; an empty table gives an empty result."""
    doc = F.col("doc")
    d = wrapped(docs).select(doc[id_col].alias("_id"), doc[source_col].alias("source"), word_count(doc[text_col]).alias("size"), "doc")
    d = d.withColumns({"_key": _key("_id", seed), "_tie": row_hash(doc, docs.schema)})
    taken = _taken(d, weights=weights, share=share, cap=cap, rows=docs.count(), ties=["_id", "size", "_tie"])
    return _repeated(taken, docs.columns, text_col)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")
