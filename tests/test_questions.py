"""Queries over the benchmark's questions against brute force, with what matters after the 80th character."""

import math
import random
import re
from collections import Counter

from citeflow.plans import queries

CITED = re.compile(r"(?:12\s+cfr\s+|§+\s*)([0-9]+[a-z]?(?:\.[0-9a-z-]+)+)")


def words(text):
    return re.findall(r"[a-z0-9]+(?:\.[a-z0-9-]+)*", text.lower())


def section(i):
    return f"{i // 50 + 1}.{i}"


def best(docs, question, k):
    toks = {d: words(t) for d, t in docs.items()}
    tf, mean = {d: Counter(t) for d, t in toks.items()}, sum(map(len, toks.values())) / len(toks)
    score = Counter()
    for term in words(question):
        df = sum(term in f for f in tf.values())
        for d, f in tf.items():
            if f[term]:
                score[d] += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * f[term] * 2.5 / (f[term] + 1.5 * (0.25 + 0.75 * len(toks[d]) / mean))
    return sorted(score, key=lambda d: (-round(score[d], 9), d))[:k]


def context(docs, question):
    """(section, source) in order: cited sections, their references, the five best."""
    by_section = {section(d): t + f" See § {section(d + 1)}(a)(1), and 12 CFR {section(d * 3 + 2)}." for d, t in docs.items()}
    cited = list(dict.fromkeys(CITED.findall(question.lower())))
    explicit, semantic = [s for s in cited if s in by_section], [section(d) for d in best(docs, question, 5)]
    fresh = list(dict.fromkeys(s for e in explicit for s in CITED.findall(by_section[e].lower()) if s not in cited and s not in semantic))[:5]
    rows = [(s, "explicit_citation") for s in explicit] + [(s, "cross_reference") for s in fresh if s in by_section] + [(s, "semantic") for s in semantic]
    return [(s, w) for i, (s, w) in enumerate(rows) if s not in [x for x, _ in rows[:i]]][:10]


def fixture(spark, path):
    rng = random.Random(3)
    docs = {i: " ".join(rng.choices([f"w{k}" for k in range(60)], k=30)) for i in range(40)}
    asked = {i: "common " * 12 + " ".join(rng.choices([f"w{k}" for k in range(60)], k=12)) + (f" under § {section(30 + i)}" if i % 3 == 0 else "") for i in range(8)}
    spark.createDataFrame([(i, t, "s") for i, t in docs.items()], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    cites = lambda i: f" 12 CFR {section(i * 4)} and § {section(i * 4 + 3)}" if i % 2 == 0 else ""
    return docs, {i: t + cites(i) for i, t in asked.items()}


def test_whole_questions(spark, tmp_path):
    docs, asked = fixture(spark, tmp_path)
    assert min(map(len, asked.values())) > 80
    assert {r.qid: r.question for r in queries.questions(spark, str(tmp_path)).collect()} == asked
    want = {q: context(docs, t) for q, t in asked.items()}
    got = queries.context_search(spark, str(tmp_path)).orderBy("qid", "rank").collect()
    assert {q: [(r.section, r.source) for r in got if r.qid == q] for q in asked} == want
    fused = {}
    for q, t in asked.items():
        score, level, first = Counter(), {}, {}
        for found in (want[q], [(section(d), "lexical") for d in best(docs, t, 10)]):
            for rank, (s, source) in enumerate(found, 1):
                score[s] += 1 / (60 + rank)
                level[s] = min(level.get(s, 2), {"explicit_citation": 0, "cross_reference": 1}.get(source, 2))
                first[s] = min(first.get(s, rank), rank)
        fused[q] = sorted(score, key=lambda s: (level[s], -round(score[s], 12), first[s], s))[:10]
    got = queries.rrf_hybrid(spark, str(tmp_path)).orderBy("qid", "rank").collect()
    assert {q: [r.doc for r in got if r.qid == q] for q in asked} == fused
