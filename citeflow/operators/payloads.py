"""What evaluations hand on: one nested row a question, annotations that cover all records, and answers of
a judge that are asked for again where they cannot be read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from citeflow.functions import text as T
from citeflow.operators.evaluation import question_metrics
from citeflow.operators.tables import stored

#: Characters of a hit's text that reports show.
PREVIEW = 260
#: Fields of a hit in a report; those that a ranking lacks are null.
HIT_FIELDS = {"score": "double", "chunk_id": "string", "section": "string", "parent_document_id": "string", "source_url": "string", "retrieval_sources": "array<string>", "rrf_score": "double"}
#: How answers to questions are scored.
POLICIES = ("em_or_alias", "contains_all", "evidence_groups_and_contains")


def _or_null(rows: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)


def hit_rows(hits: DataFrame) -> DataFrame:
    """(question_id, hit): each hit as a struct for reports. A hit without a source is a semantic one."""
    source = F.coalesce(F.col("retrieval_source") if "retrieval_source" in hits.columns else F.lit(None), F.lit("semantic"))
    fields = [_or_null(hits, name, kind) for name, kind in HIT_FIELDS.items()]
    hit = F.struct(F.col("rank").cast("int").alias("rank"), *fields, source.alias("retrieval_source"), F.substring(F.coalesce("text", F.lit("")), 1, PREVIEW).alias("text_preview"))
    return hits.select("question_id", hit.alias("hit"))


def question_payloads(questions: DataFrame, hits: DataFrame, *, k: int = 10) -> DataFrame:
    """One row per question: its fields, first_complete_rank, recall_at_10 and ``top_hits``, its ``k`` first
    hits in order, empty without any.

    ``questions`` has question_id, question, groups and perhaps candidate_id and question_type (by default
    single_section); ``hits`` question_id, rank, section, text and what ``hit_rows`` knows. The hits of a
    question are cut before they are put together, so that a row is bounded by ``k``.
    """
    q = questions.withColumn("question_type", F.coalesce(_or_null(questions, "question_type", "string"), F.lit("single_section")))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "section"))
    first = stored(hits.withColumn("_place", place).where(F.col("_place") <= k).drop("_place"), "hits")
    held = hit_rows(first).groupBy("question_id").agg(F.array_sort(F.collect_list("hit")).alias("top_hits"))
    metrics = question_metrics(q, first, ks=(10,)).select("question_id", F.col("complete_rank").alias("first_complete_rank"), "recall_at_10")
    none = F.array().cast(held.schema["top_hits"].dataType)
    out = q.select("question_id", _or_null(questions, "candidate_id", "string"), "question_type", "question", "groups").join(metrics, "question_id").join(held, "question_id", "left")
    return out.withColumn("top_hits", F.coalesce("top_hits", none))


def ranking_rows(questions: DataFrame, hits: DataFrame, *, k: int = 10) -> DataFrame:
    """The first ``k`` hits of each question as rows of a saved ranking: question_id, the fields of ``hit_rows``,
    and ``is_complete_hit_at_rank``: whether all evidence of the question is met by then."""
    first = hits.where(F.col("rank") <= k)
    complete = question_metrics(questions, first, ks=(k,)).select("question_id", "complete_rank")
    rows = hit_rows(first).join(complete, "question_id", "left").select("question_id", "hit.*", "complete_rank")
    return rows.withColumn("is_complete_hit_at_rank", F.coalesce(F.col("rank") >= F.col("complete_rank"), F.lit(False))).drop("complete_rank")


def hits_from_items(scores: DataFrame, items: DataFrame, fields: list[str], *, source: str | None = None) -> DataFrame:
    """(qid, rank, score, text, metadata) of ``scores`` (qid, rank, item, score): the stripped text of the item and
    those of its ``fields`` that are there, as JSON; with ``source``, that too. Items with blank text are no hits."""
    kept = [F.col(f) for f in fields if f in items.columns] + ([F.lit(source).alias("retrieval_source")] if source else [])
    shown = items.select("item", T.strip(F.coalesce("text", F.lit(""))).alias("text"), F.to_json(F.struct(*kept)).alias("metadata")).where(F.length("text") > 0)
    return scores.join(shown, "item").select("qid", "rank", "score", "text", "metadata")


def focus(payloads: DataFrame, wanted: list[str], *, k: int = 10) -> DataFrame:
    """(question_id, first_complete_rank, recall_at_10, top_sections, labels) of the ``wanted`` few questions;
    one that is not there raises. Labels are sections with their sources."""
    top = F.slice("top_hits", 1, k)
    labels = F.transform(top, lambda h: F.concat(h["section"], F.lit(":"), h["retrieval_source"]))
    found = stored(payloads.where(F.col("question_id").isin(wanted)).select("question_id", "first_complete_rank", "recall_at_10", top["section"].alias("top_sections"), labels.alias("labels")), "focus")
    there = {r.question_id for r in found.select("question_id").collect()}
    lost = sorted(set(wanted) - there)
    if lost:
        raise KeyError("no payload of: " + ", ".join(map(str, lost)))
    return found


def questions_to_ask(records: DataFrame, limit: int | None = None) -> DataFrame:
    """(question_id, question, expected_sections), the first ``limit`` by question_id if one is given; sections
    are the expected ones, or where there are none the acceptable ones. A limit under 1 and an empty result raise."""
    if limit is not None and limit < 1:
        raise ValueError("the limit must be at least 1")
    sections = [F.when(F.size(c) > 0, F.col(c)) for c in ("expected_sections", "acceptable_sections") if c in records.columns]
    out = records.select("question_id", "question", F.coalesce(*sections, F.array().cast("array<string>")).alias("expected_sections"))
    out = out if limit is None else out.orderBy("question_id").limit(limit)
    if out.isEmpty():
        raise ValueError("no questions selected")
    return out


def annotate(records: DataFrame, annotations: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(``records`` with metric_policy, acceptable_answers and must_contain of their ``annotations``, number of
    records by policy). Records without an annotation raise, as do repeated and unknown policies.

    The counts, and whether all is covered, are observed while the result is written: one pass in all.
    """
    fields = ("metric_policy", "acceptable_answers", "must_contain")
    said = annotations.select(F.col("question_id").alias("_id"), *[F.col(f).alias(f"_{f}") for f in fields], F.count(F.lit(1)).over(Window.partitionBy("question_id")).alias("_times"))
    joined = records.drop(*fields).join(said, F.col("question_id") == F.col("_id"), "left")
    seen, policy = Observation(), F.col("_metric_policy")
    counts = [F.count_if(policy == p).alias(p) for p in POLICIES]
    wrong = [F.count_if(policy.isNull()).alias("missing"), F.count_if(policy.isNotNull() & ~policy.isin(*POLICIES)).alias("unknown"), F.count_if(F.col("_times") > 1).alias("repeated")]
    kept = [*[c for c in records.columns if c not in fields], *[F.col(f"_{f}").alias(f) for f in fields]]
    out = stored(joined.observe(seen, *counts, *wrong).select(*kept), "annotated")
    found = seen.get
    if found["missing"]:
        lost = [r.question_id for r in out.where("metric_policy is null").select("question_id").distinct().orderBy("question_id").limit(20).collect()]
        raise ValueError(f"{found['missing']} records without annotations: {lost}")
    if found["unknown"] or found["repeated"]:
        raise ValueError(f"{found['unknown']} unknown policies, {found['repeated']} repeated annotations")
    return out, {p: found[p] for p in POLICIES if found[p]}


#: Answers prompts, in their order.
Ask = Callable[[list[str]], list[str]]


def repair_prompt(answer: Column) -> Column:
    """What is asked where an answer could not be read."""
    fields = ", ".join(T.SCORES)
    wanted = f"Write the judgement below as one JSON object and nothing else: whole numbers from 1 to 5 for {fields}; true or false for pass; a list of short texts for issues.\n\n"
    return F.concat(F.lit(wanted), F.coalesce(answer, F.lit("")))


def asked(rows: DataFrame, ask: Ask, *, prompt: str, answer: str, batch: int = 16) -> DataFrame:
    """``rows`` with the ``answer`` to their ``prompt``; prompts go to ``ask`` in batches, each in one task."""
    at = rows.columns.index(prompt)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{answer}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                said = ask(part.column(at).to_pylist())
                if len(said) != part.num_rows:
                    raise ValueError(f"{len(said)} answers to {part.num_rows} prompts")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string())], names=[*part.schema.names, answer])

    return rows.mapInArrow(run, schema)


def judged(rows: DataFrame, ask: Ask, *, prompt: str = "prompt", batch: int = 16) -> DataFrame:
    """``rows`` with ``answer``, its ``scores`` (null where it cannot be read) and ``attempts``.

    First answers are written before they are parsed, so that no prompt is paid for twice; only rows whose
    answer cannot be read are asked once more, to repair it.
    """
    first = stored(asked(rows, ask, prompt=prompt, answer="answer", batch=batch), "answers")
    read = first.withColumn("scores", T.judge_scores(F.col("answer")))
    fine = read.where("scores is not null").withColumn("attempts", F.lit(1))
    again = read.where("scores is null").drop("scores").withColumn("_repair", repair_prompt(F.col("answer"))).drop("answer")
    repaired = stored(asked(again, ask, prompt="_repair", answer="answer", batch=batch).drop("_repair"), "repairs")
    second = repaired.withColumn("scores", T.judge_scores(F.col("answer"))).withColumn("attempts", F.lit(2))
    return fine.unionByName(second)
