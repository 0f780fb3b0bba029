from pyspark.sql import functions as F

from citeflow.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_section_references(spark):
    got = one(spark, "Compare 12 CFR 335.101(c)(2) with § 9.18(d), then § 9.18(e) again.", T.section_references)
    assert got == ["335.101", "9.18"]
    assert one(spark, "§§ 1.1 and 1.2", T.section_references) == ["1.1"]
    assert one(spark, None, T.section_references) is None


def test_answer_key(spark):
    assert one(spark, " § 9.18,  Trust FUNDS? ", T.answer_key) == "section 918 trust funds"
    assert one(spark, "Up to $75 (each).", T.answer_key) == "up to $75 each"


def test_evidence_key(spark):
    assert one(spark, ' "first  line\n next\\," ', T.evidence_key) == "first line next"


def test_tokens_and_keys(spark):
    assert one(spark, "Under 9.18, i.e. half-way", T.tokens) == ["under", "9.18", "i.e", "half", "way"]
    assert one(spark, " 9.18A); ", T.section_key) == "9.18a"
    assert one(spark, "Ａ“x” —\ty", T.conservative) == 'a"x" - y'
    assert one(spark, "A x. Bank means a bank", T.definition_term) == "Bank"


def test_windows(spark):
    assert one(spark, "abc", lambda c: T.evidence_windows(c, 5)) == ["abc"]
    assert one(spark, "0123456789", lambda c: T.evidence_windows(c, 4)) == ["2345", "4567", "6789"]


def test_judge(spark):
    text = '```json\n{"overall": 5, "faithfulness": 4, "citation_support": 5, "answer_relevance": 3, "legal_caution": 4, "pass": true, "issues": "x"}\n```'
    got = one(spark, text, T.judge_scores)
    assert got.overall == 5 and got.passed and got.issues == ["x"]
    assert one(spark, text.replace("legal", "illegal"), T.judge_scores) is None
    assert one(spark, text.replace("5,", "6,"), T.judge_scores) is None
    assert one(spark, "no json", T.judge_scores) is None


def test_labels(spark):
    df = spark.createDataFrame([(1, None, "", "a"), (2, "d", "", ""), (3, None, None, None)], "rank int, id string, t string, s string")
    got = [r.y for r in df.orderBy("rank").select(T.source_label(F.col("rank"), F.col("id"), F.col("t"), F.col("s")).alias("y")).collect()]
    assert got == ["a", "chunk:d", "chunk:3"]
