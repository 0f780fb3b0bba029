"""The audit of filters against one loop over documents per order."""

import re
from itertools import permutations

from citeflow.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(doc, docs):
    doc_id, text, _ = doc
    text = text or ""
    words = WORD.findall(text)
    out = {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
        "E": doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in docs),
    }
    return out


def plain(docs, labels):
    marks = {}
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            old = marks.get(doc_id, (False, False))
            marks[doc_id] = (old[0] or quality == 1, old[1] or toxic == 1)
    facts = [(d[2] or "", fails(d, docs), marks.get(d[0], (False, False))) for d in docs]
    out = {}
    for part in {p for p, _, _ in facts}:
        mine = [(f, m) for p, f, m in facts if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[0][x]]
                left = [d for d in left if not d[0][x]]
                failing = sum(f[x] for f, _ in mine)
                alone = sum(f[x] and sum(f.values()) == 1 for f, _ in mine)
                shapley[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), alone, sum(m[0] for _, m in gone), sum(m[1] for _, m in gone), x]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return out


def test_all_orders(spark):
    fine = " ".join(f"w{i}" for i in range(60))
    texts = [fine, fine, fine, None, "", "", "A B C", "x " * 80, fine + " #", "tab\tand\x0bmore\x0c\r\n" * 20, fine.upper(), "é " * 60, fine + " #", "\u00a0\u2003" * 60]
    docs = [(i, t, [None, "", "web", "a"][i % 4]) for i, t in enumerate(texts)]
    docs += [(None, fine, "web"), (None, fine, None), (3, fine, "web"), (3, fine, "web"), (-1, fine + " #", "a"), (50, "é" * 100_000, "long")]
    labels = [(0, 1, 0), (1, 1, 1), (3, 0, 1), (8, 1, 1), (8, 0, 0), (None, 1, 1), (12, None, 1), (99, 1, 1)]
    d = spark.createDataFrame([(*x, 7, 7) for x in docs], "doc_id long, text string, source string, part int, cell int").repartition(3)
    names = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(d, names)
    rows = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}
    assert rows == plain(docs, labels)
    assert len(rows) == got.count() == 600 * 4
    assert filter_audit.audit_filters(d.limit(0), names).count() == 0
    assert filter_audit.audit_filters(d, names.limit(0)).count() == 2400
