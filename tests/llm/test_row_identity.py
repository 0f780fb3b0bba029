"""The pipeline's stages on null ids, repeated rows and null labels against a plain run."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from citeflow.llm import langid, ngram_join
from citeflow.llm.exact_dedup import drop_duplicates
from citeflow.llm.mixing import mix_documents
from citeflow.llm.ngram_join import drop_near_duplicates
from citeflow.llm.queries import tokenizer_path
from citeflow.llm.tokens import WordTokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    near = [re.sub(r"^\S+", "other", t) for t in (a, b)]
    out = [(1, a, "s"), (1, a, "s"), (2, a, "t"), (2, near[0], "t"), (3, b, None), (3, c, "t"), (None, b, "s"), (None, d, "s"), (None, d, None), (None, near[1], "t"), (None, None, "s"), (4, None, None), (5, "123 !?", "s")]
    return out + [(10 + i // 2, text(), "stu"[i % 3]) for i in range(20)] + [(None, text(), "t") for _ in range(4)]


def table(spark, given):
    return spark.createDataFrame([(i, t, None, s, 7) for i, t, s in given], SCHEMA).repartition(3)


def bare(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def plain_language(given):
    return [r for r in given if r[1] and re.search(r"[^\W\d_]", r[1])]


def plain_exact(given):
    groups = defaultdict(list)
    for r in given:
        groups[r[1] or ""].append(r)
    return [max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]


def grams(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("", t or "")}


def plain_classes(given):
    sets, todo, out = [grams(r[1]) for r in given], set(range(len(given))), []
    while todo:
        reach, edge = set(), {min(todo)}
        while edge:
            reach |= edge
            edge = {j for i in edge for j in todo - reach if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        todo -= reach
        out.append([given[i] for i in reach])
    return out


def plain_near(given):
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in plain_classes(given)]


def plain_targets(given):
    sizes = Counter()
    for _, t, s in given:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        per = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * per > 2 * sizes[s]} or set()
        for s in over or free:
            out[s] = 2 * sizes[s] if over else w[s] * per
        left -= sum(out[s] for s in over)
        free = free - over if over else set()
    return sizes, {s: int(t + 0.5) for s, t in out.items()}


def unordered(given):
    """Without the source where equal rows leave open which one stays."""
    return Counter((r[0], r[1]) for r in given)


def test_stages(spark):
    given = rows()
    docs = table(spark, given)
    assert bare(corpus_pipeline.language(spark, docs, "")) == Counter(plain_language(given))
    assert unordered(bare(drop_duplicates(docs)).elements()) == unordered(plain_exact(given))
    unique = plain_exact(given)
    assert unordered(bare(drop_near_duplicates(table(spark, unique))).elements()) == unordered(plain_near(unique))
    sizes, budget = plain_targets(given)
    words = Counter()
    for (i, t, s), n in bare(mix_documents(docs)).items():
        words[s] += n * len(WORD.findall(t or ""))
        assert any((i, s) == (r[0], r[2]) and (r[1] or "").startswith(t or "") for r in given)
    assert words == budget


def test_classes(spark):
    given = rows()
    got = ngram_join.ngram_classes(table(spark, given))
    want = Counter((r[0], min((x[0] for x in g if x[0] is not None), default=None)) for g in plain_classes(given) for r in g)
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == want


def test_labelled(spark):
    d = spark.createDataFrame([(i, "one two" if i % 2 else "12", "en", "s", 7) for i in range(40)], SCHEMA)
    assert langid.keep_identified(d, how=langid.Training(steps=2)).count() == 20


def test_clashing_columns(spark):
    """Extra columns named like inner ones come through every stage unchanged."""
    names = ["_id", "_words", "_key", "_copy", "_size", "_taken", "_text", "_row", "_set", "_rep", "size", "taken", "doc", "plan", "copy", "id", "a b"]
    given = rows()
    docs = table(spark, given).select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce("text", F.lit(""))).alias(n) for n in names])
    for stage in (drop_duplicates, drop_near_duplicates, mix_documents, lambda d: corpus_pipeline.language(spark, d, "")):
        out = stage(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n].startswith(f"{n}:{r.text or ''}") for n in names)
        assert stage(docs.limit(0)).count() == 0


def test_drop_heavy_texts(spark):
    """Texts with very many copies, null ids and repeated rows among them; either end of the ids stays."""
    given = [(i if i % 5 else None, ["hot", "warm", None, "", f"t{i % 300}"][i % 5 if i % 4 else 0], "s") for i in range(1200)] + [(7, "hot", "s")] * 30
    docs = table(spark, given)
    groups = defaultdict(list)
    for i, t, _ in given:
        groups[t or ""].append(i)
    for keep, pick in (("largest", max), ("smallest", min)):
        got = drop_duplicates(docs, keep=keep, least_heavy=8, heavy_parts=64)
        assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter((pick((i for i in g if i is not None), default=None), t) for t, g in groups.items())


def plain_mix(given):
    """(id, source, text) as often as taken, of rows with different ids."""
    sizes, budget = plain_targets(given)
    out = []
    for source in sizes:
        order = sorted((r for r in given if r[2] == source), key=lambda r: (hashlib.md5(f"7|{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or -1))
        left = budget[source]
        out += [r for r in order if not WORD.findall(r[1] or "")]
        while left > 0 and sizes[source]:
            for r in order:
                n = len(WORD.findall(r[1] or ""))
                if left > 0 and n:
                    out.append(r if n <= left else (r[0], "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r[1])[:left]), source))
                left -= min(n, max(left, 0))
    return out


def test_whole_run(spark, tmp_path):
    """All rows of the pipeline against the five stages run plainly."""
    given = [(i, t, s) for i, (_, t, s) in enumerate(rows())]
    table(spark, given).write.parquet(str(tmp_path / "documents.parquet"))
    mixed = plain_mix(plain_near(plain_exact(plain_language(given))))
    tok = WordTokenizer(tokenizer_path())
    want = Counter((r[0], *tok.encode_whole(r[1] or "").tolist(), 2) for r in mixed)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ends = defaultdict(list)
    for p in pieces:
        ends[p.sequence_id].append((p.offset, p.length))
    for s, held in ends.items():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) == 4096 or s == max(ends)
    assert sum(p.length for p in pieces) == sum(len(x) - 1 for x in want.elements())
    digest = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    cut = lambda x, p: digest(x[1:][p.start : p.start + p.length]) == p.ids_crc32
    assert all(any(x[0] == p.doc_id and len(x) - 1 == p.doc_tokens and cut(x, p) for x in want) for p in pieces)
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == Counter((x[0], len(x) - 1) for x in want.elements())


def test_candidates_lose_no_pair(spark):
    """Chains, mixed buckets and hot groups: pairs near enough that share a bucket end up in one component."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts, row = [], list(base)
    for k in range(110):
        row = [*row[:k], f"x{k}", *row[k + 1 :]]
        texts += [" ".join(row)] * (1 if k % 4 else 2)
    other = [f"v{rng.randrange(900)}" for _ in range(90)]
    texts += [" ".join([*other[:k], "mark", *other[k + 1 :]]) for k in range(60)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in ngram_join.ngram_classes(d, block=16).collect()}
    sets = [grams(t) for t in texts]
    links = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    classes = {i: min(j for j, _ in c) for c in plain_classes(list(enumerate(texts))) for i, _ in c}
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (classes[i], links[i]) for i in range(len(texts))}


def test_connected_with_hot_node(spark):
    """Stars with more rows than the limit, chains and both at once."""
    rng = random.Random(4)
    edges = [(1000 + i, 7) for i in range(900)] + [(i, i + 1) for i in range(2000, 2060)] + [(2060, 1005), (5, 7)] + [(3000 + rng.randrange(50), 3000 + rng.randrange(50)) for _ in range(60)]
    got = {r.node: r.root for r in ngram_join.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in list(root)}
