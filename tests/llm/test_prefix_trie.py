"""The trie of conversation prefixes against one built in plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from citeflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k1 string, base string"


def plain(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            turns[conv_id].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    given = {c: [x[3] for x in sorted(t)] for c, t in turns.items()}
    whole = {}
    for c, t in sorted(given.items()):
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = given.get(c - int(math.fmod(c, 5)), [])[:h] + t[h:]
    members, below = defaultdict(list), defaultdict(set)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    for node in members:
        if node:
            below[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not below[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(node))
        up = members[node[:-1]][0] if node else None
        out.append((m[0], len(node), up, len(m), len(below[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)


def test_small_and_odd_rows(spark):
    rows = [
        (0, 1, "user", "a"), (0, None, "system", None), (0, 2, None, "é"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, None, None), (2, 0, "z", "t"),
        (5, 0, "u", "x"), (7, 3, "u", "own"), (7, 4, "u", "b"), (-3, 0, "u", "a"), (-3, 1, "u", "b"), (13, 0, "u", "only"), (14, 0, "u", "only"), (None, 0, "u", "lost"), (None, None, None, None),
    ]
    assert found(table(spark, rows)) == plain(rows)
    assert found(table(spark, rows).limit(0)) == []


def test_many_copies_and_deep_paths(spark):
    rng = random.Random(5)
    rows = [(c, t, "u" if t % 2 else "a", f"hot {t}") for c in range(0, 900, 3) for t in range(3)]
    for c in range(1, 900, 3):
        rows += [(c, t, "u", rng.choice("ab") * 3 if t < 4 else "same") for t in range(rng.choice([1, 2, 9, 12, 20]))]
    # Paths of 90 and 600 turns: two and four rounds of bands of eight levels.
    rows += [(c, t, "u", f"deep {t if t < 70 or c % 2 else -t}") for c in (2000, 2001, 2005, 2006) for t in range(90)]
    rows += [(c, t, "u", f"well {t if t < 550 else c}") for c in (3000, 3005, 3010) for t in range(600)]
    assert found(table(spark, rows)) == plain(rows)


def test_heavy_parents_and_lists_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, 0, "u", "first") for c in range(400)] + [(c, 1, "u", f"next {c}") for c in range(300)]
    rows += [(c, t, "u", "w") for c in range(0, 400, 5) for t in range(2, 12)]
    d = table(spark, rows)
    assert found(d) == plain(rows)
    tree = spark.createDataFrame([(0, 0, 0, 5, 3, None, None), (1, 1, 1, 5, 0, 0, 0), (2, 2, 1, 6, 1, 0, 0), (3, 3, 1, 7, 0, 0, 0), (4, 4, 2, 6, 0, 2, 2)], "k1 long, k2 long, depth long, conv_id long, n_children long, u1 long, v1 long")
    for least in (0, 1, 2, 99):
        got = {(r.k1, r.parent_conv_id) for r in prefix_trie.with_parents(tree, 5, heavy=5, least=least).collect()}
        assert got == {(1, 5), (2, 5), (3, 5), (4, 6)}
