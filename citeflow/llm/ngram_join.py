"""Similarity join on word n-grams: MinHash banding finds who may be close, full sets decide.

Documents with equal n-gram sets form one class and only its smallest id goes on, so that copies cost
nothing. Representatives are shuffled on band hashes; those that meet in a band are checked against the
first of the bucket on their whole signatures, and what is clearly apart does not join their groups.
Inside a group every two representatives are compared on their full n-gram sets, in blocks: a task holds
two blocks and returns counts and a spanning forest, never pairs, so a group of near copies costs many
comparisons but few rows. Only links that the full sets confirm are closed into classes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from citeflow.llm.shared import ROW, hash64, materialise, numbered, wrapped, worker_memory

_WORD = re.compile(r"\w+")
#: Columns of a set-by-n-gram matrix that are held at once.
STRIP = 4096
#: N-grams that a block of representatives holds (or one representative).
BLOCK_GRAMS = 1 << 21
#: A signature's estimate that joins a bucket's member to its first one, and the one from which nothing that
#: is not joined can be near the member: the distances .5, .15 and the threshold's .2 leave .15 for chance.
JOINED, SETTLED, CHECKS = 0.5, 0.85, 2


def choose_bands(threshold: float, recall: float, low: float = 0.4, noise: float = 0.1, most: int = 400) -> tuple[int, int]:
    """The fewest hashes (bands, rows) that let a pair at ``threshold`` meet with chance ``recall``
    and one at ``low`` with chance ``noise`` at most (else the least noisy within ``most`` hashes)."""
    found = []
    for rows in range(1, 17):
        meet = threshold**rows
        bands = 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))
        if bands * rows <= most:
            chance = 1 - (1 - low**rows) ** bands
            found.append((chance > noise, bands * rows if chance <= noise else chance, bands, rows))
    return min(found)[2:]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of a text's distinct n-grams of lower-cased words, sorted.

    A text of fewer than n words has one n-gram, all its words; one without words has its own text as
    its only item, so that such texts are near only to their equals.
    """

    def __init__(self, n: int):
        self.n, self.cache = n, worker_memory("word hashes")
        with np.errstate(over="ignore"):
            self.place = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def _hash(self, word: str) -> int:
        import xxhash

        if len(self.cache) > 200_000:
            self.cache.clear()
        h = self.cache[word] = xxhash.xxh64_intdigest(word)
        return h

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        if not words:
            return np.array([self._hash("\0" + text)], np.uint64)
        if len(words) < self.n:
            return np.array([self._hash("\1" + " ".join(words))], np.uint64)
        get = self.cache.get
        ids = np.array([get(w) or self._hash(w) for w in words], np.uint64)
        m = len(ids) - self.n + 1
        with np.errstate(over="ignore"):
            total = ids[:m] * self.place[0]
            for k in range(1, self.n):
                total += ids[k : k + m] * self.place[k]
        return np.unique(_mix(total))


def signatures(docs: DataFrame, *, n: int, bands: int, rows: int, id_col: str, text_col: str, seed: int = 11) -> DataFrame:
    """(``_id``, ``_set`` a 128-bit digest of the whole n-gram set, ``_grams`` its size, ``_sig`` a byte of
    each minimum, ``_bands``)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle = Shingler(n)
        rng = np.random.default_rng(seed)
        k = bands * rows
        flip = rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]
        times = (rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1))[:, None]
        for batch in batches:
            keys, banded, sizes, signs = [], [], [], []
            for text in batch.column(1).to_pylist():
                grams = shingle(text or "")
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()))
                low = (grams >> np.uint64(16)).astype(np.uint32)
                least = np.full((k, 1), 0xFFFFFFFF, np.uint32)
                for at in range(0, len(low), 1024):
                    least = np.minimum(least, ((low[at : at + 1024] ^ flip) * times).min(axis=1, keepdims=True))
                sizes.append(len(grams))
                signs.append(least.astype(np.uint8).tobytes())
                values = least.reshape(bands, rows).astype(np.uint64)
                mixed = np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(rows):
                    mixed = _mix(mixed ^ values[:, r])
                banded.append(mixed.view(np.int64))
            flat = np.concatenate(banded) if banded else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), lists], names=["_id", "_set", "_grams", "_sig", "_bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), text_col).mapInArrow(sign, f"_id {kind}, _set binary, _grams long, _sig binary, _bands array<long>")


@pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of equal bytes of two signatures, which estimates the sets' similarity."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def candidates(met: DataFrame, signs: DataFrame, limit: int = 1000) -> DataFrame:
    """Edges (``a``, ``b``) that join the representatives of ``met`` (``_key`` of a bucket, ``_rep``) which
    may be near; ``signs`` has ``_rep`` and ``_sig``. Buckets with more than ``limit`` members, of which
    there are few, are split over tasks.

    In each bucket the members are checked against the first one. Those near enough are joined to it; where
    all are, the bucket is done. Else those that are very near are settled, the others are checked again
    among themselves. What two checks leave is
    joined unchecked. No near pair of a bucket falls apart: a member that is joined to nothing is too far
    from the first one to be near a settled member.
    """
    left, edges = met, None
    for _ in range(CHECKS):
        first = left.groupBy("_key").agg(F.min("_rep").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("_key").alias("a"), "m", "n")
        held = _with_least(left.select(F.col("_key").alias("a"), F.col("_rep").alias("b")), first, limit)
        held = materialise(held.where("b != m").select(F.col("a").alias("_key"), F.col("b").alias("_rep"), F.col("m").alias("_first")), "members")
        pairs = held.select("_rep", "_first").distinct().join(signs, "_rep").join(signs.select(F.col("_rep").alias("_first"), F.col("_sig").alias("_other")), "_first")
        pairs = materialise(pairs.select("_rep", "_first", agreement("_sig", "_other").alias("_near")), "checked")
        new = pairs.where(F.col("_near") >= JOINED).select(F.col("_rep").alias("a"), F.col("_first").alias("b"))
        edges = new if edges is None else edges.union(new)
        # A bucket whose members are all joined to its first one is one group; nothing is left to find in it.
        apart = held.join(pairs.where(F.col("_near") < JOINED).select("_rep", "_first"), ["_rep", "_first"], "left_semi").select("_key").distinct()
        left = held.join(apart, "_key", "left_semi").join(pairs.where(F.col("_near") < SETTLED).select("_rep", "_first"), ["_rep", "_first"], "left_semi").select("_key", "_rep")
    rest = left.groupBy("_key").agg(F.min("_rep").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("_key").alias("a"), "m", "n")
    return edges.union(_with_least(left.select(F.col("_key").alias("a"), F.col("_rep").alias("b")), rest, limit).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _with_least(rows: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """``rows`` (``a``, ``b``) with ``m`` of their ``a`` in ``least`` (``a``, ``m``, ``n`` rows of it).

    The nodes with more than ``limit`` rows, of which there are few, are joined by broadcast, so that no
    task gets all rows of one node.
    """
    hot = F.broadcast(least.where(F.col("n") > limit).select(F.col("a").alias("_hot"), F.col("m").alias("_m")))
    met = rows.join(hot, F.col("a") == F.col("_hot"), "left")
    cold = met.where(F.col("_hot").isNull()).select("a", "b").join(least.select("a", "m"), "a")
    return met.where(F.col("_hot").isNotNull()).select("a", "b", F.col("_m").alias("m")).union(cold.select("a", "b", "m"))


def _contents(pairs: DataFrame) -> tuple:
    """The number of rows and two hashes over all of them, which rows in another order share."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``a``, ``b``); root is the smallest node.

    Each round hangs the larger neighbours of a node, and itself, under the smallest one (large star),
    then does so among the smaller ones (small star). Where the first changes nothing and every node hangs
    under one other, all are stars already. Only counts and hashes reach the driver; each half is a
    written table.
    """
    pairs = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while (state := _contents(pairs))[0]:
        # Fewer than 8192 nodes have more rows than the limit, as there are two rows a pair.
        limit = max(256, state[0] // 4096)
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = materialise(_with_least(both.where("b > a"), low, limit).select(F.col("b").alias("a"), F.col("m").alias("b")), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        if _contents(large) == state and least.where("n > 1").isEmpty():
            break
        small = _with_least(large, least, limit).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets."""
    sizes = [[len(x) for x in side] for side in (left, right)]
    values, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = sum(sizes[0])
    sides = [codes[:split], codes[split:]]
    shared = np.intersect1d(sides[0], sides[1])
    rank = np.full(len(values), -1)
    rank[shared] = np.arange(len(shared))
    cells = []
    for side, size in zip(sides, sizes, strict=True):
        col, row = rank[side], np.repeat(np.arange(len(size)), size)
        order = np.argsort(col[col >= 0], kind="stable")
        cells.append((row[col >= 0][order], col[col >= 0][order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), STRIP):
        width, strips = min(STRIP, len(shared) - at), []
        for (row, col), size in zip(cells, sizes, strict=True):
            lo, hi = np.searchsorted(col, (at, at + width))
            strip = np.zeros((len(size), width), np.float32)
            strip[row[lo:hi], col[lo:hi] - at] = 1
            strips.append(strip)
        out += strips[0] @ strips[1].T
    return out


def _links(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    both = _overlaps(left, right).astype(np.int64)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - both
    return both >= threshold * union - 1e-9


def _roots(link: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column the smallest id that links lead to. A row without links leads to itself, and
    so does such a column; where both sides are the same nodes, the rows' answer is the whole one."""
    out = [rows.copy(), columns.copy()]
    left = link.any(axis=1)
    while left.any():
        inside, new = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        reached = np.zeros(len(columns), bool)
        new[left.argmax()] = True
        while new.any():
            inside |= new
            ahead = link[new].any(axis=0) & ~reached
            reached |= ahead
            new = link[:, ahead].any(axis=1) & ~inside
        least = min(rows[inside].min(), columns[reached].min())
        out[0][inside], out[1][reached] = least, least
        left &= ~inside
    return out[0], out[1]


def ngram_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, ``class_id``, ``n_links``, ``set_id``.

    Two documents are linked when the Jaccard similarity of their sets of word n-grams is ``threshold``
    or more; ``class_id`` is the smallest id that links lead to, ``n_links`` the number of documents
    linked with this one, ``set_id`` the smallest id with the same n-gram set. A pair at the threshold
    is found with chance ``recall`` at least (closer ones with more), and pairs in one candidate group
    are compared whether or not they met. Null text is empty; texts without words link only with equal
    texts; null ids are never the smallest while a class or set has another; repeated rows and ids count
    as documents of their own; an empty table gives an empty result; other columns are ignored.
    ``options`` are those of ``row_classes``.
    """
    rows = numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")))
    found = materialise(row_classes(rows, id_col=ROW, **options).join(rows.select(ROW, "_id"), ROW), "found")
    sets = found.groupBy(F.col("set_id").alias("_set"), F.col("class_id").alias("_class")).agg(F.min("_id").alias("_least"))
    classes = sets.groupBy(F.col("_class").alias("_c")).agg(F.min("_least").alias("_root"))
    named = materialise(sets.join(classes, F.col("_class") == F.col("_c")).select("_set", "_least", "_root"), "named")
    return found.join(named, F.col("set_id") == F.col("_set")).select(F.col("_id").alias(id_col), F.col("_root").alias("class_id"), "n_links", F.col("_least").alias("set_id"))


def row_classes(
    docs: DataFrame,
    *,
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9995,
    block: int = 1024,
    id_col: str,
    text_col: str = "text",
) -> DataFrame:
    """``ngram_classes`` of rows whose ids are unique integers, none of them null."""
    bands, rows = choose_bands(threshold, recall)
    signed = materialise(signatures(docs, n=n, bands=bands, rows=rows, id_col=id_col, text_col=text_col), "signatures")
    sets = materialise(signed.groupBy("_set").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"), F.max("_grams").alias("_grams")), "sets")
    reps = signed.select("_id", F.col("_set").alias("_s"), "_sig", "_bands").join(sets.select("_rep", "_set"), (F.col("_id") == F.col("_rep")) & (F.col("_s") == F.col("_set")))
    reps = materialise(reps.select("_rep", "_sig", "_bands"), "representatives")

    met = reps.select("_rep", F.posexplode("_bands").alias("_band", "_hash")).select(F.xxhash64("_band", "_hash").alias("_key"), "_rep")
    limit = max(256, sets.count() * bands // 4096)
    groups = materialise(connected(candidates(met, reps.select("_rep", "_sig"), limit), "candidates"), "groups")

    # Blocks of about `block` members and BLOCK_GRAMS n-grams; small groups share a bin, large ones have pairs of blocks.
    nodes = materialise(groups.join(sets.select(F.col("_rep").alias("node"), "_copies", "_grams"), "node"), "nodes")
    sized = nodes.join(nodes.groupBy("root").agg(F.count(F.lit(1)).alias("_members"), F.sum("_grams").alias("_all")), "root")
    parts = F.greatest(F.ceil(F.col("_members") / block), F.ceil(F.col("_all") / BLOCK_GRAMS)).cast("int")
    total = nodes.agg(F.count(F.lit(1)), F.sum("_grams")).first()
    bins = max(1, math.ceil(total[0] / block), math.ceil((total[1] or 0) / BLOCK_GRAMS))
    # Written, so that Spark knows how few the members are before it decides whether texts have to be shuffled.
    member = materialise(sized.select("root", F.col("node").alias("_rep"), "_copies", parts.alias("_parts"), F.pmod(hash64("node"), parts).cast("int").alias("_block")), "sized")
    texts = docs.select(F.col(id_col).alias("_rep"), F.col(text_col).alias("_text"))
    held = member.join(texts, "_rep")
    mates = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.struct(F.least(F.col("_block"), j).alias("i"), F.greatest(F.col("_block"), j).alias("j")))
    held = held.select("root", "_rep", "_copies", "_text", "_block", "_parts", F.explode(mates).alias("_pair"))
    small = F.col("_parts") == 1
    held = held.withColumn("_task", F.when(small, F.pmod(hash64("root"), F.lit(bins))).otherwise(hash64("root", "_pair.i", "_pair.j") + bins))
    kind = docs.schema[id_col].dataType.simpleString()

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        shingle, out = Shingler(n), []
        for (_, i, j), g in frame.groupby(["root", "i", "j"], sort=False):
            halves = [g] if i == j else [g[g._block == i], g[g._block == j]]
            if not all(len(h) for h in halves):
                continue
            grams = [[shingle(t or "") for t in h._text] for h in halves]
            link = _links(grams[0], grams[-1], threshold)
            if i == j:
                np.fill_diagonal(link, False)
            ids = [h._rep.to_numpy() for h in halves]
            copies = [h._copies.to_numpy() for h in halves]
            counts = np.concatenate([link @ copies[-1], *([] if i == j else [link.T @ copies[0]])])
            roots = _roots(link, ids[0], ids[-1])
            ids, roots = (ids[0], roots[0]) if i == j else map(np.concatenate, (ids, roots))
            out.append(pd.DataFrame({"_rep": ids, "_links": counts, "_to": roots, "_whole": g._whole.iloc[0]}))
        return pd.concat(out) if out else pd.DataFrame({"_rep": [], "_links": [], "_to": [], "_whole": []})

    compared = held.select("_task", "root", F.col("_pair.i").alias("i"), F.col("_pair.j").alias("j"), "_block", (F.col("_parts") == 1).alias("_whole"), "_rep", "_copies", "_text")
    compared = materialise(compared.groupBy("_task").applyInPandas(compare, f"_rep {kind}, _links long, _to {kind}, _whole boolean"), "compared")
    # A group in one block is closed by its task; those of several blocks are closed over their tasks.
    counts = compared.groupBy("_rep").agg(F.sum("_links").alias("_links"), F.min(F.when(F.col("_whole"), F.col("_to"))).alias("_closed"))
    classes = connected(compared.where(~F.col("_whole")).select(F.col("_rep").alias("a"), F.col("_to").alias("b")), "classes")

    named = sets.join(counts, "_rep", "left").join(classes.select(F.col("node").alias("_rep"), "root"), "_rep", "left")
    named = named.select("_set", F.coalesce("root", "_closed", "_rep").alias("class_id"), (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).cast("long").alias("n_links"), F.col("_rep").alias("set_id"))
    return signed.select(F.col("_id").alias(id_col), "_set").join(named, "_set").select(id_col, "class_id", "n_links", "set_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the document of smallest id of each class, all columns kept. Null ids lose to any
    other, and of rows with one id in a class one stays. Columns may have any names and types."""
    rows = numbered(wrapped(docs))
    doc = F.col("doc")
    found = row_classes(rows.select(ROW, doc[text_col].alias("text")), id_col=ROW, **options).select(ROW, "class_id")
    order = F.struct(doc[id_col].isNull().alias("unknown"), doc[id_col].alias("id"), F.col(ROW).alias("row"))
    kept = found.join(rows.select(ROW, order.alias("_order")), ROW).groupBy("class_id").agg(F.min("_order").alias("_first"))
    kept = rows.join(kept.select(F.col("_first.row").alias(ROW)), ROW, "left_semi")
    return kept.select(*[doc[c].alias(c) for c in docs.columns])
