"""How document filters overlap, for every order in which they can be applied.

Each document is one cell of a contingency tensor with an axis of two places (pass, fail) for each filter.
Spark counts the cells of each part; all orders, steps and questions are then contractions of that tensor
with vectors that select pass, fail or all along each axis.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.llm.shared import text_or_empty

#: The filters, one letter an axis of the tensor.
FILTERS = "ABCDE"
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at a text alone: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    failing = [n < 50, distinct.cast("long") * 100 < n.cast("long") * 65, upper.cast("long") * 100 > F.length(text).cast("long") * 5, text.rlike(r"[#$%&*|]")]
    bits = F.lit(0)
    for i, fails in enumerate(failing):
        bits = bits + F.when(fails, 1 << i).otherwise(0)
    return bits


def contingency(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, cell, n, good, toxic): how many documents of a part fail which filters (``cell``: bits A to E).

    Filter E fails documents whose text stands under a smaller id anywhere in the table; texts are compared
    by length and SHA-256. Texts are read once and never shuffled: rows of an id, 32 bytes of digest, part
    and bits are. Copies are added up before they are shuffled, so a text with any share of all rows is one
    row a task. Documents with null ids have no label, fail E never and make no other fail it. Repeated rows
    count singly. Of several labels of an id, any 1 counts. Null text or part is empty; other columns are ignored.
    """
    text = text_or_empty(text_col)
    d = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.octet_length(text).alias("size"),
        text_failures(text).alias("bits"),
    )
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    keyed = d.where("id is not null").join(known, "id", "left").select("id", "part", "sha", "size", "bits", *marks)
    # Rows of one id and text are one row with a count; this needs no shuffle of its own after the join.
    keyed = keyed.groupBy("id", "part", "sha", "size", "bits", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    cells = keyed.groupBy("sha", "size", "part", "bits", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    first = F.min("first.id").over(Window.partitionBy("sha", "size"))
    cells = cells.withColumn("stay", F.when(F.col("first.id") == first, F.col("first.n")).otherwise(0))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("stay").alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - F.col("stay")).alias("n"))))
    counted = cells.select("part", "bits", "good", "toxic", sides.alias("side")).where("side.n > 0")
    counted = counted.select("part", (F.col("bits") + F.col("side.e")).alias("cell"), "good", "toxic", F.col("side.n").alias("n"))
    loose = d.where("id is null").select("part", F.col("bits").alias("cell"), F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.lit(1).cast("long").alias("n"))
    total = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    return counted.unionByName(loose).groupBy("part", "cell").agg(*total)


def selectors() -> dict[str, np.ndarray]:
    """For each question a vector a step and axis: (600, 5, 2), orders as in ORDERS, then steps."""
    out = {name: np.empty((len(ORDERS) * 5, 5, 2), np.int64) for name in ("kept", "removed", "failing", "alone")}
    for o, order in enumerate(ORDERS):
        for step, letter in enumerate(order):
            row = 5 * o + step
            for axis, name in enumerate(FILTERS):
                place = order.index(name)
                out["kept"][row, axis] = PASS if place <= step else ALL
                out["removed"][row, axis] = PASS if place < step else FAIL if place == step else ALL
                out["failing"][row, axis] = FAIL if name == letter else ALL
                out["alone"][row, axis] = FAIL if name == letter else PASS
    return out


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(parts, 2, 2, 2, 2, 2) counts, (steps, 5, 2) selectors: (parts, steps) sums."""
    return np.einsum("pabcde,ka,kb,kc,kd,ke->pk", tensors, *(chosen[:, axis] for axis in range(5)), optimize=["einsum_path", (0, 1), (0, 4), (0, 3), (0, 2), (0, 1)])


def answers(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of some parts' tensors, each (parts, 600)."""
    by = selectors()
    out = {name: contract(n, by[question]) for name, question in (("kept", "kept"), ("removed", "removed"), ("unique_fails", "alone"))}
    out["redundant"] = contract(n, by["failing"]) - out["removed"]
    out["good_lost"], out["toxic_lost"] = contract(good, by["removed"]), contract(toxic, by["removed"])
    letters = np.array([FILTERS.index(x) for order in ORDERS for x in order])
    # One column a filter: what it removed over all orders, at any step.
    sums = np.stack([out["removed"][:, letters == i].sum(1) for i in range(5)], 1)
    out["shapley"] = sums[:, letters]
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, ``filter_order`` and ``step`` (1 to 5), with the MEASURES of the step's filter.

    Parts without a document in a cell get zeros; an empty table gives an empty result. A part is one row
    of 96 counts, whatever it holds, so that parts are spread over tasks and none holds its documents.
    """
    counts = contingency(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col)
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                some = frame.iloc[at : at + 256]
                flat = np.zeros((3, len(some), 32), np.int64)
                for p, row in enumerate(some.cells):
                    for c in row:
                        flat[:, p, c["cell"]] = c["n"], c["good"], c["toxic"]
                # The last axis of the reshaped counts is the lowest bit, filter A.
                tensors = flat.reshape(3, len(some), 2, 2, 2, 2, 2).transpose(0, 1, 6, 5, 4, 3, 2)
                found = answers(*tensors)
                yield pd.DataFrame(
                    {"part": np.repeat(some.part.to_numpy(), 600), "filter_order": np.tile(np.repeat(ORDERS, 5), len(some)), "step": np.tile(np.arange(1, 6, dtype=np.int32), 120 * len(some))}
                    | {name: found[name].ravel() for name in MEASURES}
                )

    return cells.mapInPandas(steps, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))
