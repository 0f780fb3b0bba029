"""Nested payloads, annotations that cover all records, and the judge's second pass."""

import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from citeflow.operators import agent, payloads


def asked(spark):
    rows = [("q1", "what?", [["1.1"], ["2.2", "2.3"]], "cross_section", "c1"), ("q2", "who?", [["9.9"]], None, None)]
    return spark.createDataFrame(rows, "question_id string, question string, groups array<array<string>>, question_type string, candidate_id string")


def hits(spark):
    rows = [("q1", r, s, f"{s} " + "long " * 100, None if r == 2 else "lexical") for r, s in ((3, "2.3"), (1, "1.1"), (2, "5.5"), (4, "6.6"))]
    return spark.createDataFrame(rows, "question_id string, rank int, section string, text string, retrieval_source string")


def test_payloads(spark):
    found = {r.question_id: r for r in payloads.question_payloads(asked(spark), hits(spark), k=3).collect()}
    assert [(h.rank, h.section, h.retrieval_source, len(h.text_preview), h.score) for h in found["q1"].top_hits] == [(1, "1.1", "lexical", 260, None), (2, "5.5", "semantic", 260, None), (3, "2.3", "lexical", 260, None)]
    assert (found["q1"].first_complete_rank, found["q1"].recall_at_10, found["q1"].candidate_id) == (3, 1.0, "c1")
    assert (found["q2"].question_type, found["q2"].first_complete_rank, found["q2"].recall_at_10, found["q2"].top_hits) == ("single_section", None, 0.0, [])
    plain = payloads.question_payloads(asked(spark).drop("question_type", "candidate_id"), hits(spark).drop("retrieval_source")).collect()
    assert {r.question_type for r in plain} == {"single_section"} and {h.retrieval_source for r in plain for h in r.top_hits} == {"semantic"}
    one = payloads.focus(payloads.question_payloads(asked(spark), hits(spark)), ["q1"], k=2).first()
    assert one.labels == ["1.1:lexical", "5.5:semantic"] and one.top_sections == ["1.1", "5.5"]
    with pytest.raises(KeyError, match="q7, q8"):
        payloads.focus(payloads.question_payloads(asked(spark), hits(spark)), ["q8", "q1", "q7"])


def test_questions_to_ask(spark):
    rows = [("b", "x", [], ["2.2"]), ("a", "y", ["1.1"], ["3.3"]), ("c", "z", None, None)]
    d = spark.createDataFrame(rows, "question_id string, question string, expected_sections array<string>, acceptable_sections array<string>")
    assert {r.question_id: r.expected_sections for r in payloads.questions_to_ask(d).collect()} == {"a": ["1.1"], "b": ["2.2"], "c": []}
    assert [r.question_id for r in payloads.questions_to_ask(d, 2).collect()] == ["a", "b"]
    assert payloads.questions_to_ask(d.drop("expected_sections")).count() == 3
    for bad in (lambda: payloads.questions_to_ask(d, 0), lambda: payloads.questions_to_ask(d.limit(0))):
        with pytest.raises(ValueError):
            bad()


NOTES = "question_id string, metric_policy string, acceptable_answers array<string>, must_contain array<string>"


def test_annotations_cover_all(spark):
    records = spark.createDataFrame([("q1", "old", 1), ("q2", None, 2), ("q2", None, 3)], "question_id string, metric_policy string, n int")
    notes = [("q1", "contains_all", ["a"], []), ("q2", "em_or_alias", [], ["t"]), ("q9", "em_or_alias", [], [])]
    table = lambda rows: spark.createDataFrame(rows, NOTES)
    rows, counts = payloads.annotate(records, table(notes))
    assert counts == {"contains_all": 1, "em_or_alias": 2}
    assert sorted((r.question_id, r.n, r.metric_policy, r.must_contain) for r in rows.collect()) == [("q1", 1, "contains_all", []), ("q2", 2, "em_or_alias", ["t"]), ("q2", 3, "em_or_alias", ["t"])]
    with pytest.raises(ValueError, match=r"2 records without annotations: \['q2'\]"):
        payloads.annotate(records, table(notes[:1]))
    with pytest.raises(ValueError, match="1 unknown policies"):
        payloads.annotate(records.limit(1), table([("q1", "guess", [], [])]))
    with pytest.raises(ValueError, match="repeated annotations"):
        payloads.annotate(records, table([*notes, notes[0]]))
    assert payloads.annotate(records.limit(0), table(notes))[1] == {}


FINE = json.dumps({"answer_relevance": 5, "faithfulness": 4, "citation_support": 3, "legal_caution": 2, "overall": 1, "pass": True})


def test_only_failures_are_asked_again(spark):
    def ask(prompts):
        out = []
        for p in prompts:
            repair = p.startswith("Write")
            assert not repair or "no object" in p  # the second pass sees what could not be read, and nothing else
            out.append(FINE if "good" in p or repair and "mend" in p else f"no object: {p[-20:]}")
        return out

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["good", "mend this", "bad", "good too"] * 10)], "n int, prompt string").repartition(3)
    found = payloads.judged(rows, ask, batch=3).collect()
    assert sorted((r.n % 4, r.attempts, r.scores is not None) for r in found) == sorted([(0, 1, True), (1, 2, True), (2, 2, False), (3, 1, True)] * 10)
    assert all(r.scores.overall == 1 and r.scores.passed for r in found if r.scores)
    assert payloads.judged(rows.limit(0), ask).count() == 0
    with pytest.raises(PythonException, match="0 answers"):
        payloads.judged(rows, lambda p: []).collect()
    told = rows.withColumn("answer", payloads.repair_prompt(F.lit(None))).first()
    assert "overall" in told.answer


def test_steps_and_their_limit(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "qid long, question string")
    ev = spark.createDataFrame([(1, 1, "1.1", "semantic"), (1, 2, "2.2", "explicit_citation"), (2, 1, "3.3", "semantic")], "qid long, rank int, section string, source string")
    v = "2031-05-06"
    secs = spark.createDataFrame([(s, v, f"https://www.ecfr.gov/on/{v}/title-12/section-{s}", s != "1.1") for s in ("1.1", "2.2", "3.3")], "section string, version_date string, source_url string, safe_for_citation boolean")

    def run(most, max_steps):
        fetched = agent.sections_to_fetch(ev, most)
        checked = agent.verify(fetched, secs, version=v)
        answers = agent.final_answers(q, ev, fetched, checked)
        steps = agent.run_steps(q, ev, fetched, checked, answers, max_steps=max_steps, most=most)
        rows = sorted((r.qid, r.step_number, r.action.split("_")[0], r.status, r.section) for r in steps.collect())
        return rows, {r.qid: (r.termination, r.steps, r.citations) for r in agent.limited_answers(answers, ev, steps).collect()}

    rows, ends = run(2, 6)
    assert [r[1:] for r in rows if r[0] == 1] == [(1, "search", "completed", None), (2, "fetch", "completed", "2.2"), (3, "fetch", "completed", "1.1"), (4, "verify", "completed", "2.2"), (5, "verify", "failed", "1.1"), (6, "final", "completed", None)]
    assert [r[1:3] for r in rows if r[0] == 3] == [(1, "search")]
    assert ends == {1: ("completed", 6, [f"12 CFR 2.2 ({v})"]), 2: ("completed", 4, [f"12 CFR 3.3 ({v})"]), 3: ("insufficient_evidence", 1, [])}
    rows, ends = run(0, 3)
    assert [r[2] for r in rows if r[0] == 1] == ["search", "fetch", "verify"] and ends[1] == ("max_steps_exceeded", 3, [])
    assert ends[2][:2] == ("completed", 2) and ends[3] == ("insufficient_evidence", 1, [])
    for bad in ({"max_steps": 0}, {"top_k": 0}, {"most": -1}, {"max_steps": 5, "most": 2}):
        with pytest.raises(ValueError):
            agent.check_limits(**bad)


def test_saved_rankings_and_hits(spark):
    rows = payloads.ranking_rows(asked(spark).fillna("single_section", ["question_type"]), hits(spark)).orderBy("rank").collect()
    assert [(r.rank, r.section, r.is_complete_hit_at_rank) for r in rows] == [(1, "1.1", False), (2, "5.5", False), (3, "2.3", True), (4, "6.6", True)]
    items = spark.createDataFrame([(1, " a text\n", "1.1", None), (2, " \t", "2.2", "h"), (3, None, "3.3", "h"), (4, "b", "4.4", "h")], "item long, text string, section string, heading string")
    scores = spark.createDataFrame([(7, i, i, 0.5) for i in (1, 2, 3, 4, 5)], "qid long, rank int, item long, score double")
    found = payloads.hits_from_items(scores, items, ["section", "heading", "absent"], source="lexical").orderBy("rank").collect()
    assert [(r.rank, r.text, json.loads(r.metadata)) for r in found] == [(1, "a text", {"section": "1.1", "retrieval_source": "lexical"}), (4, "b", {"section": "4.4", "heading": "h", "retrieval_source": "lexical"})]
    assert json.loads(payloads.hits_from_items(scores, items, ["section"]).first().metadata).keys() == {"section"}
