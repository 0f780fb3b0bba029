"""Approximate nearest neighbours by inner product: an inverted-file index with adaptive dimension scan.

An extra coordinate, the root of the largest squared norm less one's own, turns largest inner product
into smallest distance. A random rotation then spreads every vector's length evenly over coordinates, so
that a partial distance over the first d of D coordinates estimates the whole. Within each probed list
candidates are scanned in column blocks, and after each block a hypothesis test abandons those whose
estimate is beyond the query's bound. Survivors get their exact score from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from citeflow.llm.shared import hash64, materialise


@dataclass(frozen=True)
class AnnSettings:
    """``sample`` rows fit the centroids and the bound of each query; every row is indexed.

    ``epsilon`` is the test's width: a candidate is abandoned after d coordinates when its estimated
    distance exceeds (1 + epsilon / sqrt(d)) times the bound. ``recall`` is the share of true neighbours
    that the probed lists must hold, on the sample, for the number of probes that is chosen. A query's
    lists are visited in rounds, nearest first, each expected to yield ``yields`` times k rows at most.
    While more than the share ``sparse`` of a list is left, a column block is one matrix product.
    """

    k: int = 20
    sample: int = 20_000
    most_lists: int = 4096
    recall: float = 0.98
    epsilon: float = 2.1
    columns: int = 16
    sparse: float = 0.1
    yields: int = 8
    rounds: int = 8
    seed: int = 5


@dataclass
class Model:
    centroids: np.ndarray  # (lists, D) in rotated space
    rotation: np.ndarray  # (dim + 1, dim + 1)
    bounding: np.ndarray  # (sample, D) rotated, for the queries' first bounds
    largest: float  # largest squared norm
    probes: int


def usable(vector: Column, dim: int) -> Column:
    """Vectors of ``dim`` finite components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def squared(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def rotated(x: np.ndarray, model_rotation: np.ndarray, largest: float | None) -> np.ndarray:
    """Augment (a query's extra coordinate is 0) and rotate rows of ``x``."""
    extra = np.zeros(len(x)) if largest is None else np.sqrt(np.maximum(0.0, largest - (x * x).sum(axis=1)))
    return (np.column_stack([x, extra]) @ model_rotation).astype(np.float32)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T))


def fit(sample: np.ndarray, n: int, largest: float, how: AnnSettings) -> Model:
    """Centroids by Lloyd's rounds on the sample, and the number of lists to probe."""
    rng = np.random.default_rng(how.seed)
    dim = sample.shape[1] + 1
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    base = rotated(sample, rotation, largest)
    lists = int(min(how.most_lists, max(1, round(n**0.5)), max(1, len(base) // 4)))
    distinct = np.unique(base, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(how.rounds):
        near = np.concatenate([_distances(base[i : i + 1024], centroids).argmin(1) for i in range(0, len(base), 1024)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, base)
        count = np.bincount(near, minlength=len(centroids))
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids).astype(np.float32)
    near = np.concatenate([_distances(base[i : i + 1024], centroids).argmin(1) for i in range(0, len(base), 1024)])
    trial = rng.permutation(len(base))[:256]
    queries = rotated(sample[trial], rotation, None)
    exact = _distances(queries, base)
    exact[np.arange(len(trial)), trial] = np.inf
    # A smaller k, as the sample is thinner than the whole: the same nearness as k among all rows.
    k = max(1, min(len(base) - 1, round(how.k * len(base) / max(n, 1)) or 1))
    truth = np.argsort(exact, axis=1)[:, :k]
    place = np.argsort(np.argsort(_distances(queries, centroids), axis=1), axis=1)
    where = np.sort(np.take_along_axis(place, near[truth], axis=1).ravel())
    probes = int(where[min(len(where) - 1, int(np.ceil(how.recall * len(where))))]) + 1 if len(where) else 1
    return Model(centroids, rotation, base, largest, min(len(centroids), probes))


def bound_rank(k: int, sample: int, n: int) -> int:
    """The rank within the sample whose distance bounds the k-th of all n: twice what is expected there,
    for what the tests abandon wrongly, and room for the sample's chance."""
    expected = k * min(1.0, sample / n)
    return int(np.ceil(2 * expected + 2 * expected**0.5 + 2))


def visits(lists: int, passing: float, how: AnnSettings) -> list[int]:
    """Ends of the rounds over a query's probed lists.

    ``passing`` rows of all lists are within the first bound. After a share 1/y of the lists the k-th best
    so far is a bound that about y * k rows of the rest pass, so each round takes y times as many lists.
    """
    ends = [lists]
    while passing > how.yields * how.k and ends[0] > 1:
        ends.insert(0, -(-ends[0] // how.yields))
        passing /= how.yields
    return ends


def scan(ids: np.ndarray, turned: np.ndarray, original: np.ndarray, query_ids: np.ndarray, turned_q: np.ndarray, original_q: np.ndarray, bound: np.ndarray, how: AnnSettings, pairs: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``how.k`` of one list's candidates for each query: (query ids, ids, scores)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    dim, step = turned.shape[1], max(1, pairs // max(1, len(ids)))
    for at in range(0, len(query_ids), step):
        q, limit, qid = turned_q[at : at + step], bound[at : at + step], query_ids[at : at + step]
        partial, alive, row = np.zeros((len(q), len(ids)), np.float32), ids[None, :] != qid[:, None], None
        for lo in range(0, dim, how.columns):
            hi = min(dim, lo + how.columns)
            slack = (1 + how.epsilon / hi**0.5) ** 2 if hi < dim else 1 + 1e-4
            if row is None:
                # Many are left: a matrix product costs less than picking them out.
                partial += _distances(q[:, lo:hi], turned[:, lo:hi])
                alive &= partial * (dim / hi) <= limit[:, None] * slack + 1e-5
                if hi == dim or np.count_nonzero(alive) < how.sparse * alive.size:
                    row, col = np.nonzero(alive)
                    partial = partial[row, col]
            else:
                partial = partial + ((q[row, lo:hi] - turned[col, lo:hi]) ** 2).sum(1)
                keep = partial * (dim / hi) <= limit[row] * slack + 1e-5
                row, col, partial = row[keep], col[keep], partial[keep]
        score = np.einsum("ij,ij->i", original_q[at : at + step][row], original[col])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, row, side="left")
        best = np.arange(len(row)) - first < how.k
        out.append((qid[row[best]], ids[col[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(vectors: DataFrame, queries: DataFrame, *, how: AnnSettings | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best rows by inner product in double
    precision, best first, ties to the smaller id, never the row of the query's own id.

    Vectors that are null, zero, of another length than most, or with null or non-finite
    components take no part, nor do null ids; repeated ids count once. An empty table gives an empty
    result; other columns are ignored. Lists of any size are split into blocks of bounded size, and so are the
    queries that probe one.
    """
    how = how or AnnSettings()
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull())
    # The length that most rows have (the longer one of two alike), so that a malformed row decides nothing.
    dim = (given.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first() or [0])[0]
    good = given.where(usable(F.col("v"), dim))
    n, largest = good.agg(F.count(F.lit(1)), F.max(squared(F.col("v")))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, 1.2 * how.sample / n)
    chosen = good.where(F.pmod(F.xxhash64("id", F.lit(how.seed)), F.lit(1 << 30)) / float(1 << 30) < share).orderBy(F.xxhash64("id")).limit(how.sample)
    rows = chosen.select("v").collect() or good.select("v").limit(how.sample).collect()
    model = fit(np.array([r[0] for r in rows], np.float64), n, largest, how)
    rank = bound_rank(how.k, len(rows), n)
    sent = spark.sparkContext.broadcast(SimpleNamespace(**vars(model)))
    # Vectors travel in their own precision; each task rotates what it reads.
    kind = np.float32 if vectors.schema[vector_col].dataType == ArrayType(FloatType()) else np.float64

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for frame in frames:
            for at in range(0, len(frame), 2048):
                part = frame.iloc[at : at + 2048]
                x = np.array(part.v.tolist(), np.float64).reshape(len(part), -1)
                turned = rotated(x, m.rotation, m.largest)
                yield pd.DataFrame({"list": _distances(turned, m.centroids).argmin(1), "id": part.id.to_numpy(), "original": [o.tobytes() for o in x.astype(kind)]})

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                x = np.array(part.v.tolist(), np.float64).reshape(len(part), -1)
                turned = rotated(x, m.rotation, None)
                lists = np.argsort(_distances(turned, m.centroids), axis=1, kind="stable")[:, : m.probes]
                near = _distances(turned, m.bounding)
                bound = np.partition(near, rank, axis=1)[:, rank] if near.shape[1] > rank else np.full(len(part), np.inf)
                bound = bound + 1e-6 * (m.largest + (x * x).sum(axis=1))  # what single precision may lose
                yield pd.DataFrame({"lists": list(lists.astype(np.int32)), "id": part.id.to_numpy(), "original": [o.tobytes() for o in x.astype(kind)], "norm": (x * x).sum(axis=1), "bound": bound.astype(np.float64)})

    index = materialise(good.mapInPandas(assign, "list int, id long, original binary"), "index")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), dim)).dropDuplicates(["id"])
    probed = materialise(asked.mapInPandas(probe, "lists array<int>, id long, original binary, norm double, bound double"), "probes")

    block = int(min(4096, max(256, 2 * n // len(model.centroids))))
    found, begin = None, 0
    for end in visits(model.probes, rank * n / len(rows), how):
        now = probed.withColumn("lists", F.slice("lists", begin + 1, end - begin))
        if found is not None:
            now = _tightened(now, found, largest, how)
        new = materialise(_visit(index, now, block, how, sent, kind), "found")
        found, begin = new if found is None else found.union(new), end
    # Queries left with fewer than k: all lists, without abandoning anything.
    count = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= how.k)
    every = F.sequence(F.lit(0), F.lit(len(model.centroids) - 1))
    short = materialise(probed.join(count.select(F.col("query_id").alias("id")), "id", "left_anti").withColumns({"lists": every, "bound": F.lit(float("inf"))}), "short")
    if not short.isEmpty():
        found = found.union(_visit(index, short, block, how, sent, kind))
    return _best(found, how.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank."""
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _tightened(probed: DataFrame, found: DataFrame, largest: float, how: AnnSettings) -> DataFrame:
    """``probed`` with the distance of the k-th best found so far as bound, where that is smaller."""
    last = _best(found, how.k).where(F.col("rank") == how.k).select(F.col("query_id").alias("id"), F.col("score").alias("_score"))
    reached = F.col("norm") + F.lit(largest)
    # |q - x|^2 with the extra coordinate is |q|^2 + largest - 2 q.x; a little more for single precision.
    tight = F.least(F.col("bound"), reached - 2 * F.col("_score") + 1e-6 * reached)
    return probed.join(last, "id", "left").withColumn("bound", F.coalesce(tight, "bound")).select(probed.columns)


def _visit(index: DataFrame, probed: DataFrame, block: int, how: AnnSettings, sent, kind: type) -> DataFrame:
    """(query_id, vec_id, score): the best of each block of each probed list."""
    # At most `most_lists` rows each.
    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    calls = probed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / 1024).cast("int").alias("groups"))
    plan = F.broadcast(materialise(sizes.join(calls, "list"), "plan"))
    left = index.join(plan, "list").select("list", F.pmod(hash64("id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "id", "original")
    right = probed.select(F.explode("lists").alias("list"), "id", "original", "bound").join(plan, "list")
    right = right.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(hash64("id"), "groups").cast("int").alias("group"), "id", "original", "bound")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        m = sent.value
        x, q = (np.frombuffer(b"".join(f.original), kind).reshape(len(f), -1).astype(np.float64) for f in (a, b))
        found = scan(a.id.to_numpy(), rotated(x, m.rotation, m.largest), x, b.id.to_numpy(), rotated(q, m.rotation, None), q, b.bound.to_numpy(), how)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ["list", "part", "group"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(search, "query_id long, vec_id long, score double")
