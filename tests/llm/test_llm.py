"""Each operator against a plain version on small rows: nulls, empty and long texts, ties, repeats, empty
tables and extra columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from citeflow.llm import ann, exact_dedup, html_extract, langid, licenses, mixing, ngram_join, packing, tokenbin, warc
from citeflow.llm.queries import tokenizer_path
from citeflow.llm.tokens import WordTokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, slot long"


def documents(spark, texts, source=None):
    rows = [(i, t, "en", source[i] if source else "s", len(t or ""), 0.5, 1, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


TEXTS = ["a b c d e f g h", "a b c d e f g h", None, "", "", "x", "É ü ß", "long word " * 5000, "?!", "?!", "a b c d e f g h i"]


def test_exact_dedup(spark):
    d = documents(spark, [*TEXTS, *["hot"] * 200])
    got = exact_dedup.exact_duplicates(d, least_heavy=8, heavy_parts=16).collect()
    groups = defaultdict(list)
    for i, t in enumerate([*TEXTS, *["hot"] * 200]):
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(want)
    small = exact_dedup.exact_duplicates(d, keep="smallest").where("kept").collect()
    assert {r.doc_id for r in small} == {min(g) for g in groups.values()}
    assert exact_dedup.exact_duplicates(d.limit(0)).count() == 0
    twice = exact_dedup.exact_duplicates(spark.createDataFrame([(1, "t"), (1, "t"), (None, "t"), (None, "u")], "doc_id long, text string")).collect()
    assert Counter((r.keep_id, r.group_size, r.kept) for r in twice) == {(1, 3, True): 1, (1, 3, False): 2, (None, 1, True): 1}


def fill(sizes, weights, share, cap):
    """Targets by dealing the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        per = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * per > cap * sizes[s]}
        if not over:
            return out | {s: w[s] * per for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(spark):
    rng = np.random.default_rng(1)
    source = [[None, "b", "a", "é", "Z"][i % 5] if i % 3 else "b" for i in range(300)]
    texts = [None if i == 7 else " \t".join(["w"] * int(n)) for i, n in enumerate(rng.integers(0, 40, 300))]
    d = documents(spark, texts, source)
    got = {r.doc_id: r for r in mixing.mix_sources(d).collect()}
    sizes, taken = Counter(), Counter()
    for i, t in enumerate(texts):
        sizes[source[i]] += len((t or "").split())
        assert got[i].size == len((t or "").split())
        taken[source[i]] += got[i].taken
        assert 0 <= got[i].taken <= 2 * got[i].size
    want = fill(sizes, (3, 1, 2), 1.5, 2.0)
    for i in range(300):
        assert got[i].target == pytest.approx(want[source[i]]) and got[i].source_size == sizes[source[i]]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    mixed = mixing.mix_sources(d)
    out = mixing.apply_mix(d, mixed)
    assert out.columns == d.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len((r.text or "").split())
        assert (texts[r.doc_id] or "").startswith(r.text or "")
    assert all(words[i] == got[i].taken for i in range(300))
    assert mixing.mix_sources(d.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no tokenizers")
def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    texts = [*TEXTS, "İs a\x1cb don't I'LL 12½ ﬁ Σας", "<|endoftext|>"]
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    rows = packing.piece_digests(packing.pack_documents(documents(spark, texts), tokenizer_path=tokenizer_path(), length=64)).collect()
    seen = defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for s, parts in seen.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == 64 or s == max(seen)
    assert packing.pack_documents(documents(spark, texts).limit(0), tokenizer_path=tokenizer_path()).count() == 0


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no tokenizers")
def test_shards(spark, tmp_path):
    d = documents(spark, TEXTS)
    path = str(tmp_path / "shards")
    plan = tokenbin.write_shards(d, path, tokenizer_path=tokenizer_path(), length=64, shard_records=16).collect()
    back = {r.slot: np.frombuffer(r.ids, "<u4") for r in tokenbin.read_shards(spark, path, length=64, shard_records=16).collect()}
    assert sorted(back) == list(range(len({r.sequence_id for r in plan})))
    pieces = {(r.doc_id, r.start): r for r in packing.pack_documents(d, tokenizer_path=tokenizer_path(), length=64).collect()}
    for r in plan:
        want = np.frombuffer(pieces[r.doc_id, r.start].ids, "<u4")
        assert (back[r.slot][r.offset : r.offset + r.length] == want).all()
    assert {r.slot for r in tokenbin.read_shards(spark, path, length=64, shard_records=16, first_slot=20).collect()} == {s for s in back if s >= 20}
    assert tokenbin.shard_report(d.limit(0), tokenizer_path=tokenizer_path()).count() == 0
    plan = tokenbin.read_shards(spark, path, length=64, shard_records=16, first_slot=20)
    assert "PartitionFilters: [isnotnull(shard" in plan._jdf.queryExecution().toString()
    for n in (1, 2, 3, 1000, 4097):
        assert sorted(tokenbin.permute(np.arange(n), n, 9)) == list(range(n))


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no tokenizers")
def test_shard_report(spark):
    """Each sequence's ids, tokens and documents against the documents' ids in one row, cut plainly."""
    texts = [*TEXTS, *[f"row {i} of a table " * (i % 7) for i in range(60)]]
    d = documents(spark, texts)
    got = tokenbin.shard_report(d, tokenizer_path=tokenizer_path(), length=32, shard_records=8).collect()
    tok = WordTokenizer(tokenizer_path())
    ids = {i: [*tok.encode_whole(t or "").tolist(), 2] for i, t in enumerate(texts)}
    pieces = packing.pack_documents(d, tokenizer_path=tokenizer_path(), length=32).select("doc_id", "start", "length", "sequence_id", "offset").orderBy("sequence_id", "offset").collect()
    row, held = defaultdict(list), defaultdict(list)
    for p in pieces:
        row[p.sequence_id] += ids[p.doc_id][p.start : p.start + p.length]
        held[p.sequence_id].append(p.doc_id)
    slots = tokenbin.permute(np.arange(len(row)), len(row), 2024)
    want = {s: (int(slots[s]), int(slots[s]) // 8, len(x), zlib.crc32(np.array((x + [0] * 32)[:32], "<u4").tobytes()), held[s]) for s, x in row.items()}
    assert {r.sequence_id: (r.slot, r.shard, r.n_tokens, r.ids_crc32, list(r.doc_ids)) for r in got} == want
    assert all(r.byte_offset == r.slot % 8 * 2 * 33 for r in got)


def test_long_document_is_cut_once():
    """50 MB of ids in one document: parts in seconds."""
    import time
    from types import SimpleNamespace

    big, start = b"\1\0" * (25 << 20), time.time()
    tokens = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda f, _: f))
    keep = tokenbin.with_offsets, tokenbin._sequences
    tokenbin.with_offsets, tokenbin._sequences = lambda t: t, lambda t, n: 25 * 512
    try:
        cut = tokenbin.sequence_parts(tokens, length=2048, key=1)
    finally:
        tokenbin.with_offsets, tokenbin._sequences = keep
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([25 << 20]), pa.array([big], pa.binary())], names=["a", "b", "c"])
    parts = [b for b in cut(iter([batch]))]
    assert sum(b.num_rows for b in parts) == 25 * 512 and time.time() - start < 30


def test_ngram_join(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    near = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 120, 3)]
    texts = [*TEXTS, " ".join(base), *near, " ".join(base[:50]), "x"]
    got = {r.doc_id: r for r in ngram_join.ngram_classes(documents(spark, texts), block=8).collect()}

    def grams(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("", t or "")}

    sets = [grams(t) for t in texts]
    links = {i: {j for j in range(len(texts)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in range(len(texts))}
    for i in range(len(texts)):
        reach, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - reach)
            reach |= new
        assert (got[i].class_id, got[i].n_links) == (min(reach), len(links[i])), i
    assert ngram_join.ngram_classes(documents(spark, texts).limit(0)).count() == 0
    bands, rows = ngram_join.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_licenses(spark):
    texts = [None, "", "MIT License. The MIT\n-- license, mit licensed", "Licensed under the Apache License, Version 2.0.", "GNU General Public License v3 or MITLICENSE", "SPDX-License-Identifier: BSD-3-Clause", "é mit\tlicense", "plain text"]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if tuple(words[k : k + len(phrase)]) == phrase]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places)), t
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert got[5].labels == "bsd-3-clause" and got[7].score == 0
    assert len(licenses.rules()) > 200


def test_warc(spark):
    html = ["é" * 600, "é" * 600, "small", "small", None, "with\r\n\r\nWARC/1.1\r\n\r\nblank lines" * 60, "é" * 600]
    pages = spark.createDataFrame([(i, f"http://h/{i} x" if i else None, h, 3) for i, h in enumerate(html)], "page_id long, url string, html string, record_id int").repartition(2)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        same = [j for j, o in enumerate(html) if (o or "").encode() == raw]
        first = max(same) if len(raw) >= 1000 else i
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if first == i else ("revisit", first))
        assert got[i].payload == (h or "" if first == i else None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_repeated_ids_and_large_records(spark, tmp_path):
    big, same = "x" * (17 << 20), "y" * 2000
    given = [(1, same), (1, same), (1, "tiny"), (2, same), (2, "other" * 400), (None, same), (None, None), (3, big), (4, big), (5, "z" * ((1 << 24) - 300)), (5, same[:-1])]
    d = spark.createDataFrame([(i, f"u{i}", t, 0, "q") for i, t in given], "record_id long, uri string, payload string, payload_bytes long, refers_to string")
    path = str(tmp_path / "warc")
    warc.write_archives(d, path)
    back = warc.read_archives(spark, path).collect()
    number = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    best = {t: max((i for i, u in given if u == t and i is not None), default=None) for _, t in given}
    want = Counter()
    for i, t in given:
        first = best[t] if i is not None and len(t or "") >= 1000 else i
        want[i, len(t or ""), number(t), None if first == i else first] += 1
    assert Counter((r.record_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in back) == want
    assert all((r.payload is None) == (r.record_type == "revisit") and (r.payload is None or number(r.payload) == r.payload_digest) for r in back)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    members = sum(len(list(warc._expand(memoryview(open(f"{path}/{f}", "rb").read())))) for f in files)
    assert members == len(given)


def test_warc_reader_is_linear():
    """A 200 MB archive of many members is read in seconds."""
    import gzip
    import time

    head = b"WARC/1.1\r\nContent-Length: 40000\r\n\r\n"
    one = gzip.compress(head + os.urandom(40_000) + b"\r\n\r\n", 0)
    start = time.time()
    assert sum(1 for _ in warc._records(one * 5000)) == 5000 and time.time() - start < 20


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><h1>Head %d &amp; more</h1><p>One  two <b>bold</b>&nbsp;%s<p>Second %d<br>line</p><aside>pull</aside><form><input> Sign up</form></article>
<section id="comments"><article class="comment"><p>%s</p></article></section><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % (i, "x" * i, i, "comment " * 50), 1) for i in range(12)]
    rows += [(12, None, None, 1), (13, "http://one.example/", "", 1), (14, "http://one.example/b", "<p>cut <b>of", 1), (15, "bad", rows[0][2][:400], 1)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extract.extract_main_text(d).collect()}
    for i in range(12):
        assert got[i].text == f"Head {i} & more\nOne two bold {'x' * i}".rstrip() + f"\nSecond {i} line", got[i].text
        assert got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (12, 13, 14)] == ["", "", "cut of"]
    assert html_extract.extract_main_text(d.limit(0)).count() == 0


def test_language(spark):
    rng = np.random.default_rng(2)
    words = {"en": "the of and that with this from".split(), "de": "der die und nicht für über auch".split()}
    rows = [(i, " ".join(rng.choice(words[k], 30)), k, 1.0) for i in range(300) for k in [("en", "de")[i % 2]]]
    rows += [(900, None, "en", 1.0), (901, "", None, 1.0), (902, "123 !!", "de", 1.0), (903, "der und " * 20000, None, 1.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    how = langid.Training(steps=120)
    got = {r.doc_id: r for r in langid.identify_languages(d, how=how).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i in range(300) if got[i].held_out]
    assert np.mean([got[i].lang_pred == ("en", "de")[i % 2] for i in held]) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    odd = spark.createDataFrame([(910, "½ ² ⅷ Ⅳ", "en", 1.0), (911, "½ x", "en", 1.0), (912, "a\0b", "en", 1.0)], d.schema)
    both = {r.doc_id: r.lang_pred for r in langid.identify_languages(d.union(odd), how=how).collect()}
    assert both[910] == "und" and both[911] != "und" and both[912] != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.keep_identified(d, how=how).columns == d.columns and langid.keep_identified(d, how=how).count() == 301
    assert {r.lang_pred for r in langid.identify_languages(d.where("lang is null"), how=how).collect()} == {"und"}
    assert langid.identify_languages(d.limit(0), how=how).count() == 0


def test_labelling_and_pooling():
    """Labels of all positions and a document's probabilities against the recurrence written out."""
    rng = np.random.default_rng(1)
    net = langid.BiGru.fresh(["a", "b", "c"], 5, 3)
    net.scale = 5.0
    texts = [rng.integers(1, 256, n).astype(np.uint8).tobytes() for n in (1, 7, 8, 9, 40)]
    windows, owner = langid.byte_windows(texts, 8)
    got = net.document_probabilities(windows, owner, len(texts))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for k, text in enumerate(texts):
        logs = []
        for at in range(0, len(text), 8):
            piece = np.frombuffer(text[at : at + 8].ljust(8, b"\0"), np.uint8)
            logit = np.tile(net.p["bias"][:, 0].astype(np.float64), (8, 1))
            for d in "fb":
                h = np.zeros(5)
                for t in range(8) if d == "f" else range(7, -1, -1):
                    given = net.p[f"x{d}"][:, piece[t]].astype(np.float64)
                    z, r = np.split(sigmoid(given[:10] + net.p[f"g{d}"] @ h), 2)
                    c = np.tanh(given[10:] + net.p[f"c{d}"] @ (r * h))
                    h = z * h + (1 - z) * c
                    logit[t] += net.p[f"o{d}"] @ h
            log = logit - np.log(np.exp(logit).sum(1, keepdims=True))
            logs += list(log[: len(text) - at])
        mean = np.mean(logs, axis=0)
        want = np.exp(net.scale * (mean - mean.max()))
        assert np.allclose(got[k], want / want.sum(), atol=1e-4)


def test_gradients():
    """Backpropagation agrees with finite differences."""
    net = langid.BiGru.fresh(["a", "b", "c"], 4, 0)
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 256, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net.p = {k: v.astype(np.float64) * 0.3 for k, v in net.p.items()}
    _, g = net.gradients(x, y)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep, h = net.p[k][at], 1e-5
        net.p[k][at] = keep + h
        up = net.gradients(x, y)[0]
        net.p[k][at] = keep - h
        down = net.gradients(x, y)[0]
        net.p[k][at] = keep
        assert g[k][at] == pytest.approx((up - down) / (2 * h), rel=1e-4), k


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[100:200] = x[100]
    rows = [(i, [float(v) for v in x[i]], 1.0) for i in range(600)]
    bad = [(700, None, 1.0), (720, [0.0] * 16, 1.0), (740, [float("nan")] * 16, 1.0), (760, [None] * 16, 1.0), (780, [1.0], 1.0)]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score double").repartition(3)
    got = defaultdict(list)
    for r in ann.nearest(d, d.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(600), -np.round(s, 9))) if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(v - s[i]) < 1e-9 for _, i, v in found)
        hits += len({i for _, i, _ in found} & set(best))
    assert hits / (20 * len(got)) >= 0.9
    rounds = ann.nearest(d, d.where("vec_id % 20 = 0"), how=ann.AnnSettings(sample=60, yields=2)).collect()
    found = sum(r.score >= np.sort(np.delete(x @ x[r.query_id], r.query_id))[-20] - 1e-9 for r in rounds)
    assert len(rounds) == 600 and found >= 0.9 * 600
    assert ann.visits(64, 100 * 20, ann.AnnSettings()) == [1, 8, 64] and ann.visits(64, 160, ann.AnnSettings()) == [64]
    few = ann.nearest(d.where("vec_id < 5"), d.where("vec_id = 0")).collect()
    assert len(few) == 4 and ann.nearest(d.limit(0), d.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [*TEXTS, *[" ".join(f"w{(i * 7 + k) % 97}" for k in range(40)) for i in range(20)]]
    documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.where("text is null or text = ''").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_word_tokenizer():
    """Ids equal the library's for control signs, composed letters, case, special tokens' strings and other scripts."""
    tok = WordTokenizer(tokenizer_path())
    rng = random.Random(1)
    signs = [chr(c) for c in range(0x260)] + list("aaaa  eee'stre,.\n\t") * 20 + ["<|endoftext|>", "é", "日本"]
    texts = ["".join(rng.choices(signs[: 0x180 if k % 2 else None], k=k % 60)) for k in range(2000)] + [None, ""]
    for _ in range(2):
        got = tok.encode_many(pa.array(texts))
        assert [g.tolist() for g in got] == [tok.full.encode(t or "", add_special_tokens=False).ids for t in texts]
