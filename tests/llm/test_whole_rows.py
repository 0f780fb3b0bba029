"""Stages keep rows whole: columns of any name and type, and hot texts whose rows share an id."""

from collections import Counter

from citeflow.llm import exact_dedup, mixing, ngram_join

SHAPE = "doc_id long, text string, source string, _row_number string, doc string, row int, notes map<string,int>, deep array<map<int,string>>"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, f"mine {n}", "d", n, {"a": n}, [{n: "x"}]) for n, (i, t, s) in enumerate(rows)], SHAPE).repartition(3)


def seen(df):
    return Counter((r.doc_id, r.text, r._row_number, r.doc, r.row, tuple(sorted(r.notes.items())), tuple(tuple(m.items()) for m in r.deep)) for r in df.collect())


TEXT = " ".join(f"word{i}" for i in range(40))
ROWS = [(1, TEXT, "a"), (2, TEXT, "b"), (3, TEXT + " more", None), (4, "quite another text", "a"), (None, None, "a"), (5, "", "b"), (6, "quite another text", "a")]


def test_any_columns(spark):
    d = docs(spark, ROWS)
    given = seen(d)
    for kept, want in (
        (exact_dedup.drop_duplicates(d), {2, 3, 5, 6}),
        (ngram_join.drop_near_duplicates(d), {1, 4, 5}),
        (mixing.mix_documents(d, share=2.0, cap=2.0), None),
    ):
        assert kept.columns == d.columns and dict(kept.dtypes) == dict(d.dtypes)
        found = seen(kept)
        assert set(found) <= set(given)
        if want:
            assert {k[0] for k in found} == want and set(found.values()) == {1}
    classes = ngram_join.ngram_classes(d.withColumn("_id", d.row), id_col="_row_number")
    assert classes.count() == len(ROWS) and classes.columns[0] == "_row_number"


def test_hot_text_with_one_id_or_none(spark):
    for ids in ([None] * 300, [7] * 300, [7, None] * 150):
        d = docs(spark, [(i, "hot", "s") for i in ids] + [(i, f"cold {i}", "s") for i in range(20)])
        for keep in ("largest", "smallest"):
            kept = seen(exact_dedup.drop_duplicates(d, keep=keep, least_heavy=8, heavy_parts=16))
            assert len(kept) == 21 and sum(k[1] == "hot" for k in kept) == 1
            assert next(k[0] for k in kept if k[1] == "hot") == (7 if 7 in ids else None)
            found = [r for r in exact_dedup.exact_duplicates(d, keep=keep, least_heavy=8, heavy_parts=16).collect() if r.group_size == 300]
            assert len(found) == 300 and sum(r.kept for r in found) == 1 and {r.keep_id for r in found} == {7 if 7 in ids else None}
