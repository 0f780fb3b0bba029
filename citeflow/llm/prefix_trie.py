"""The trie of conversation prefixes, rolled up in bands of depth.

A node is a distinct sequence of first turns. Its key is the exclusive or of hashes of its turns, each
salted with its place, so that a node's key and those of its ancestors come from one running window over a
conversation. Sums over subtrees need no round per level: a node sends its values only to its ancestors
within its band of HEIGHT levels; the tops of bands, whose sums then hold their band, are a trie of their
own with a HEIGHT-th of the depth, which is rolled up in the same way; and the completed sums of the tops
go to their ancestors in the band above. Rounds grow with the logarithm of the depth, and no node is
copied more than HEIGHT times a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.llm.shared import materialise

#: Levels of a band.
HEIGHT = 8
#: First turns that a conversation can take over, and the size of the families that share them.
LEAST_HEAD, FAMILY = 9, 5
#: Ids that one row of a node's list holds.
CHUNK = 4096


def head_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % LEAST_HEAD


def digested(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns without their texts: (base, conv_id, turn, d1, d2, bytes), d1 and d2 the first 120 bits of a
    SHA-256 over role and text. All that follows moves these 48 bytes a turn."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    t = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), sha.alias("sha"), F.octet_length(text).cast("long").alias("bytes")
    )
    parts = [F.conv(F.substring("sha", at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "d1"), (16, "d2"))]
    return t.select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), "conv_id", "turn", *parts, "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(base, conv_id, depth, d1, d2, bytes, last): the rebuilt conversations' turns, each conversation's
    root (depth 0) included; ``last`` marks where a conversation ends.

    One shuffle by family. A family is at most nine ids, of which each row carries the list.
    """
    t = turns.repartition("base")
    conv, family = Window.partitionBy("base", "conv_id"), Window.partitionBy("base")
    t = t.withColumn("pos", F.row_number().over(conv.orderBy(F.asc_nulls_first("turn"), "d1", "d2")).cast("long"))
    t = t.withColumn("size", F.count(F.lit(1)).over(conv))
    first = F.col("conv_id") == F.col("base")
    t = t.withColumn("head", F.coalesce(F.max(F.when(first, F.col("size"))).over(family), F.lit(0)))
    t = t.withColumn("family", F.collect_set(F.when(F.col("pos") == 1, F.struct("conv_id", "size"))).over(family))

    def taken(conv_id: Column) -> Column:
        return F.least(head_turns(conv_id), F.col("head"))

    def length(conv_id: Column, size: Column) -> Column:
        return taken(conv_id) + F.greatest(F.lit(0), size - head_turns(conv_id))

    def place(conv_id: Column, depth: Column, size: Column, turn: bool) -> Column:
        return F.struct(conv_id.alias("conv_id"), depth.cast("long").alias("depth"), (depth == length(conv_id, size)).alias("last"), F.lit(turn).alias("turn"))

    me, pos, size = F.col("conv_id"), F.col("pos"), F.col("size")
    none = F.array().cast("array<struct<conv_id:bigint,depth:bigint,last:boolean,turn:boolean>>")
    root = F.when(pos == 1, F.array(place(me, F.lit(0), size, False))).otherwise(none)
    own = F.when(pos > head_turns(me), F.array(place(me, pos - head_turns(me) + taken(me), size, True))).otherwise(none)
    heirs = F.transform(F.filter("family", lambda c: head_turns(c["conv_id"]) >= pos), lambda c: place(c["conv_id"], pos, c["size"], True))
    heirs = F.when(first & (pos < LEAST_HEAD), heirs).otherwise(none)
    out = t.select("base", "d1", "d2", "bytes", F.explode(F.concat(root, own, heirs)).alias("p"))
    of_turn = lambda c: F.when(F.col("p.turn"), F.col(c)).otherwise(0).alias(c)
    return out.select("base", F.col("p.conv_id").alias("conv_id"), F.col("p.depth").alias("depth"), F.col("p.last").alias("last"), *map(of_turn, ("d1", "d2", "bytes")))


def lag_names(n: int) -> list[tuple[str, str]]:
    return [(f"u{i}", f"v{i}") for i in range(1, n + 1)]


def with_lags(rows: DataFrame, *partition: str) -> DataFrame:
    """The keys of the HEIGHT rows before each row of a conversation, nearest first, as u1, v1, u2, v2, ..."""
    w = Window.partitionBy(*partition).orderBy("depth")
    lags = {name: F.lag(key, i).over(w) for i, pair in enumerate(lag_names(HEIGHT), 1) for name, key in zip(pair, ("k1", "k2"), strict=True)}
    return rows.withColumns(lags)


def prefix_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, bytes, last and the lags): every conversation's path down the trie."""
    salted = lambda *c: F.when(F.col("depth") > 0, F.xxhash64(*c)).otherwise(0)
    rows = rebuilt(turns).withColumns({"h1": salted("depth", "d1", "d2"), "h2": salted("d2", "depth", "d1")})
    w = Window.partitionBy("base", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"k1": F.bit_xor("h1").over(w), "k2": F.bit_xor("h2").over(w)})
    return with_lags(rows, "base", "conv_id").drop("base", "d1", "d2", "h1", "h2")


KEY = ["k1", "k2"]
LAGS = [name for pair in lag_names(HEIGHT) for name in pair]
SUMS = ["n_leaves", "saved_tokens"]


def key_of(k1: str, k2: str) -> Column:
    return F.struct(F.col(k1).alias("k1"), F.col(k2).alias("k2"))


def added(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS])


def sent(nodes: DataFrame, to: Column) -> DataFrame:
    """The nodes' values, once for each key in ``to``."""
    return nodes.select(F.explode(to).alias("to"), *SUMS).select("to.k1", "to.k2", *SUMS)


def within_band(nodes: DataFrame, stride: int) -> DataFrame:
    """Sums over each node and what lies below it in its band; nodes are ``stride`` levels apart."""
    above = F.array(key_of("k1", "k2"), *[key_of(*pair) for pair in lag_names(HEIGHT - 1)])
    return added(sent(nodes, F.slice(above, 1, ((F.col("depth") / stride).cast("long") % HEIGHT + 1).cast("int"))))


def across_band(tops: DataFrame, inside: DataFrame) -> DataFrame:
    """``inside`` with the completed sums of the tops of bands added to the nodes in the band above each."""
    return added(sent(tops, F.array(*[key_of(*pair) for pair in lag_names(HEIGHT)])).unionByName(inside))


def roll_up(rows: DataFrame, tree: DataFrame, deepest: int) -> DataFrame:
    """Sums of n_leaves and saved_tokens over each node's subtree."""
    levels, inside, stride = [tree.select(*KEY, "depth", *LAGS)], [materialise(within_band(tree, 1), "band")], 1
    while deepest // stride >= HEIGHT:
        stride *= HEIGHT
        paths = with_lags(rows.where(F.col("depth") % stride == 0).select("conv_id", "depth", *KEY), "conv_id")
        nodes = paths.groupBy(*KEY).agg(F.max("depth").alias("depth"), *[F.max(c).alias(c) for c in LAGS])
        levels.append(materialise(nodes, "tops"))
        inside.append(materialise(within_band(levels[-1].join(inside[-1], KEY), stride), "band"))
    whole = inside[-1]
    for at in range(len(levels) - 2, -1, -1):
        tops = levels[at].where((F.col("depth") > 0) & (F.col("depth") % HEIGHT ** (at + 1) == 0))
        whole = materialise(across_band(tops.join(whole, KEY), inside[at]), "whole")
    return whole


def digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of each node's ids in order, comma-joined.

    A range sort puts a node's ids in order over as many partitions as they need; each partition joins
    CHUNK of them to one row, and a node's rows are hashed as they stream by, in the memory of one row.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [*KEY, "first", "ids"], [pa.int64()] * 3 + [pa.string()]
        key, ids, out = None, [], []

        def close() -> None:
            if ids:
                out.append((*key, ids[0], ",".join(map(str, ids))))
                ids.clear()

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            for k1, k2, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2) != key or len(ids) == CHUNK:
                    close()
                    key = (k1, k2)
                ids.append(conv_id)
                if len(out) >= CHUNK:
                    yield batch_of()
        close()
        if out:
            yield batch_of()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*KEY, "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=[*KEY, "ends_sha256"])

    chunks = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(join, "k1 long, k2 long, first long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def with_parents(tree: DataFrame, total: int, *, heavy: int = 4096, least: int = 1024) -> DataFrame:
    """(k1, k2, parent_conv_id). Fewer than ``heavy`` nodes have more children than ``total / heavy``: these are
    broadcast, and their children are spread by their own keys in the join with the other parents."""
    limit = max(least, total // heavy)
    parents = tree.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"), "n_children")
    many = F.broadcast(parents.where(F.col("n_children") > limit).select("p1", "p2", F.col("parent").alias("known")))
    few = parents.where(F.col("n_children") <= limit).select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), "parent")
    children = tree.where("depth > 0").select(*KEY, "u1", "v1").join(many, (F.col("u1") == F.col("p1")) & (F.col("v1") == F.col("p2")), "left")
    at = [F.when(F.col("known").isNull(), F.col(up)).otherwise(F.col(own)).alias(to) for up, own, to in (("u1", "k1", "q1"), ("v1", "k2", "q2"))]
    return children.select(*KEY, "known", *at).join(few, ["q1", "q2"], "left").select(*KEY, F.coalesce("known", "parent").alias("parent_conv_id"))


def prefix_trie(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Null turns come first; rows of one turn are ordered by a digest of role and text, so repeated rows are
    turns of their own and reruns agree. Null roles and texts are empty. Rows without a conv_id belong to no
    conversation and are left out. An empty table has no node. Other columns are ignored, names may clash.
    Texts are read once and become digests before the first shuffle; conversations of any length give tries
    of any depth. Turns of one conversation are put in order by one task, in an external sort of 48 bytes a turn.
    """
    rows = materialise(prefix_rows(digested(conversations, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)), "paths")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    same = [F.max(c).alias(c) for c in ("depth", "bytes", *LAGS)]
    nodes = materialise(rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *same), "nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("u1").alias("k1"), F.col("v1").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = tree.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    tree = materialise(tree, "tree")
    sums = roll_up(rows, tree, deepest)
    out = tree.drop(*SUMS, *LAGS, "bytes").join(sums, KEY)
    out = out.join(with_parents(tree, tree.count()), KEY, "left").join(digests(rows.where("last").select(*KEY, "conv_id")), KEY, "left")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *SUMS, ends)
