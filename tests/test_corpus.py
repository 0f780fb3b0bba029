import pytest

from citeflow.operators import corpus, evaluation
from citeflow.sources import readers


def test_recover(spark):
    c = spark.createDataFrame([("1", 1, "part two"), ("1", 0, "part one, "), ("2", 0, "a"), ("2", 2, "b")], "row_id string, chunk_id int, chunk string")
    got = {r.row_id: r for r in corpus.recover_documents(c).collect()}
    assert got["1"].text == "part one, part two" and got["1"].missing_ids == []
    assert got["2"].missing_ids == [1]
    assert corpus.recovery_metrics(corpus.recover_documents(c)).first().gate == "NO_GO"


def test_align(spark):
    long = "word " * 300
    o = [("1", "Each  Lender MUST report."), ("2", "Some duty stands here."), ("3", "a branch can open on any day of the week it likes"), ("4", long + "end of it"), ("5", "nothing like it")]
    g = [("a", "each lender must report."), ("b", "Some duty stands here"), ("c", "a branch can open not on any day of the week it likes"), ("d", long.strip() + " …(已截断)")]
    got = corpus.align(spark.createDataFrame(o, "section string, text string"), spark.createDataFrame(g, "legacy_id string, text string"))
    assert {r.section: (r.status, r.reason, r.legacy_id) for r in got.collect()} == {
        "1": ("exact", "normalized_text_equal", "a"),
        "2": ("high_confidence", "content_tokens_equal", "b"),
        "3": ("review_required", "content_difference_detected", "c"),
        "4": ("review_required", "legacy_source_truncated", "d"),
        "5": ("unmatched", "no_candidate_above_review_threshold", None),
    }


def test_spans():
    text = "a" * 70 + "\n" + "b" * 70 + "\n" + "c" * 70
    got = list(corpus.spans(text, 150, 20))
    assert got[0] == (0, 141, "paragraph") and got[-1][1] == len(text)
    got = list(corpus.spans("x" * 350, 120, 20))
    assert all(b - a <= 120 for a, b, _ in got) and [k for _, _, k in got][:-1] == ["hard"] * (len(got) - 1)
    assert all(y[0] < x[1] for x, y in zip(got, got[1:]))
    assert list(corpus.spans(" \n ", 10, 2)) == []


def test_chunks(spark):
    d = spark.createDataFrame([(1, "x" * 350), (2, None), (3, "")], "document_id long, text string")
    c = corpus.chunk_documents(d, most=120, overlap=20)
    v = corpus.validate_chunks(d, c, most=120).first()
    assert v.chunks == 4 and not (v.orphans or v.empty or v.too_long or v.not_slice or v.gaps or v.doubled_ids)
    with pytest.raises(ValueError):
        corpus.chunk_documents(d, most=10, overlap=10)


def test_window_labels(spark):
    q = spark.createDataFrame([(1, "unique evidence text"), (2, "shared words"), (3, "absent")], "qid long, evidence string")
    s = spark.createDataFrame([("a", "has unique evidence  text and shared words"), ("b", "shared words too")], "section string, text string")
    got = {r.qid: (r.status, r.gold) for r in corpus.window_labels(q, s).collect()}
    assert got == {1: ("auto_labeled", "a"), 2: ("review_required", None), 3: ("unmatched", None)}


def test_metrics(spark):
    q = spark.createDataFrame([("q1", "cross_section", [["8.1"], ["8.2", "8.3"]]), ("q2", "single_section", [["1.1"]])], "question_id string, question_type string, groups array<array<string>>")
    r = spark.createDataFrame([("q1", 1, "8.3"), ("q1", 2, "77.7"), ("q1", 3, "8.1"), ("q2", 1, "1.1")], "question_id string, rank int, section string")
    m = {x.question_id: x for x in evaluation.question_metrics(q, r).collect()}
    assert m["q1"].complete_rank == 3 and m["q1"].recall_at_1 == 0.5
    s = evaluation.summary(evaluation.question_metrics(q, r)).first()
    assert (s.hit_at_1, s.hit_at_5, s.recall_at_1, s.mrr) == (0.5, 1.0, 0.75, round((1 + 1 / 3) / 2, 6))
    assert evaluation.failure_reasons(q, r).count() == 0
    assert evaluation.failure_reasons(q, r.where("rank = 1")).collect()[0].reason == "cross_section_retrieval_design_issue"


def test_answers(spark):
    rows = [("contains_all", "At most 30 days are given.", [], ["30 days", "$9 fee", "longer"], [["5.20", "5.30"]], ["5.20"])]
    shape = "policy string, answer string, aliases array<string>, terms array<string>, groups array<array<string>>, cited array<string>"
    got = evaluation.score_answers(spark.createDataFrame(rows, shape)).first()
    assert not got.passed and got.missing_terms == ["$9 fee", "longer"] and got.missing_groups == []
    with pytest.raises(Exception, match="unknown policy"):
        evaluation.score_answers(spark.createDataFrame([("x", *rows[0][1:])], shape)).collect()


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<ROOT><DIV5 TYPE="PART" N="Part 4"><HEAD>PART 4</HEAD><DIV8 TYPE="SECTION"><HEAD>Sec. 4.2 Hours and places.</HEAD><P>Offices open on <I>every</I> weekday.</P></DIV8><DIV8 TYPE="SECTION"><HEAD>none</HEAD></DIV8></DIV5></ROOT>')
    got = readers.read_xml_sections(spark, str(tmp_path), version="2025-09-01").collect()
    assert [(r.part, r.section, r.text) for r in got] == [("4", "4.2", "Hours and places.\nOffices open on every weekday.")]


def test_readers(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"section": "1.1"}\n\n{"section": "1.1)"}\n')
    from pyspark.sql.types import StringType, StructField, StructType

    with pytest.raises(ValueError, match="duplicate"):
        readers.read_sections(spark, str(tmp_path / "s.jsonl"), StructType([StructField("section", StringType())]))
    d = spark.createDataFrame([(i, "test") for i in range(10)], "n int, split string")
    assert readers.prefer_split(d).count() == 10
    assert sorted(r.n for r in readers.evenly_spaced(d, "n", 3).collect()) == [0, 4, 9]
    with pytest.raises(ValueError):
        readers.trace_name("..\\secret")


def test_stream(spark, tmp_path):
    from citeflow.streaming.ingest import ingest_chunks

    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    d = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    d.write.parquet(src)
    ingest_chunks(spark, src, out, cp, d.schema)
    spark.createDataFrame([(2, "again")], "doc_id long, text string").write.mode("append").parquet(src)
    ingest_chunks(spark, src, out, cp, d.schema)
    assert sorted(r.document_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_similar_texts_at_once_equal_single_ratios():
    import random
    from difflib import SequenceMatcher

    made = random.Random(8)
    words = ["".join(made.choices("abcdefghijklmnop", k=made.randint(3, 9))) for _ in range(400)]
    base = [made.choices(words, k=n) for n in (2, 30, 60, 60)]
    texts = [" ".join(w if made.random() < keep else made.choice(words) for w in made.choice(base)) for keep in [1, 0.97, 0.9, 0.6] * 40]
    a, b = texts[:80], texts[80:]
    want = {(i, j): r for i, x in enumerate(a) for j, y in enumerate(b) if min(len(x), len(y)) / max(len(x), len(y)) >= 0.8 and (r := SequenceMatcher(None, x, y).ratio()) >= 0.85}
    assert {(i, j): r for i, j, r in corpus.similar(a, b, 0.85, 0.8)} == want and len(want) > 100
