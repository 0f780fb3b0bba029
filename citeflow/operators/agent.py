"""Answering in batch: which sections to fetch, citation checks, final answers and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.functions import text as T

CHECKS = ("section_exists", "version_matches", "source_url_matches", "safe_for_citation")


def sections_to_fetch(evidence: DataFrame, most: int = 2) -> DataFrame:
    """(qid, fetch_rank, section): cited and cross-referenced sections by rank, then the others.

    With ``most`` 0 the first cited or cross-referenced section is fetched still, as a known quirk."""
    strong = F.col("source").isin("explicit_citation", "cross_reference")
    first = evidence.groupBy("qid", "section").agg(F.max(strong.cast("int")).alias("strong"), F.min(F.when(strong, F.col("rank"))).alias("s"), F.min("rank").alias("r"))
    w = Window.partitionBy("qid").orderBy(F.desc("strong"), F.coalesce("s", "r"), "section")
    ranked = first.withColumn("fetch_rank", F.row_number().over(w))
    keep = (F.col("fetch_rank") <= most) if most else ((F.col("fetch_rank") == 1) & (F.col("strong") == 1))
    return ranked.where(keep).select("qid", "fetch_rank", "section")


def verify(citations: DataFrame, sections: DataFrame, *, version: str, title: int = 12) -> DataFrame:
    """``citations`` (qid, section) with found, verified, checks and issues.

    ``sections`` has section, version_date, source_url, safe_for_citation. A section that is not there is
    found = false, with no checks (a single lookup would raise)."""
    s = sections.select(T.section_key(F.col("section")).alias("_key"), "version_date", "source_url", F.coalesce("safe_for_citation", F.lit(False)).alias("safe"), F.col("section").alias("_s"))
    citations = citations.withColumn("_key", T.section_key(F.col("section")))
    j = citations.join(s.join(citations.select("_key").distinct(), "_key", "left_semi"), "_key", "left")
    found = F.col("_s").isNotNull()
    values = [found, F.col("version_date") == version, F.col("source_url") == T.section_url(F.col("_s"), F.col("version_date"), title), F.col("safe")]
    values = [F.coalesce(v, F.lit(False)) for v in values]
    issues = F.array_compact(F.array(*[F.when(~v, F.lit(n)) for n, v in zip(CHECKS, values, strict=True)]))
    verified = values[0]
    for v in values[1:]:
        verified = verified & v
    return j.select("qid", "section", found.alias("found"), verified.alias("verified"), "version_date", F.when(found, F.create_map(*[x for n, v in zip(CHECKS, values, strict=True) for x in (F.lit(n), v)])).alias("checks"), F.when(found, issues).otherwise(F.array(F.lit("NOT_FOUND"))).alias("issues"))


def citation(section: Column, date: Column) -> Column:
    return F.when(T.or_null(date).isNull(), F.concat(F.lit("12 CFR "), section)).otherwise(F.format_string("12 CFR %s (%s)", section, date))


# The sentences of answers.
ANSWER = "Relevant evidence was found in {}. Use the cited fixed-snapshot sections to answer the question."
NO_EVIDENCE = "Insufficient information in the provided evidence."
NOT_VERIFIED = "Insufficient information in the verified evidence."


def final_answers(questions: DataFrame, evidence: DataFrame, fetched: DataFrame, verified: DataFrame) -> DataFrame:
    """(qid, answer, citations, termination).

    Sections that were fetched and verified are cited, in the order of fetching; where nothing was checked
    at all, those that were fetched, and where nothing was fetched either, the first two sections of the
    evidence. Without any, the answer says so. ``evidence`` has qid, rank, section, ``fetched`` qid,
    fetch_rank, section, ``verified`` qid, section, verified, version_date.
    """
    checked = verified.select("qid").distinct().withColumn("checked", F.lit(True))
    some = fetched.select("qid").distinct().withColumn("some", F.lit(True))
    state = questions.select("qid").join(checked, "qid", "left").join(some, "qid", "left")
    date = verified.select("qid", "section", "verified", "version_date")
    cited = fetched.join(date, ["qid", "section"], "left").join(checked, "qid", "left").where(F.col("checked").isNull() | F.coalesce("verified", F.lit(False)))
    first = evidence.where(T.or_null(F.col("section")).isNotNull()).groupBy("qid", "section").agg(F.min("rank").alias("at"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("at", "section"))).where("n <= 2")
    first = first.join(state.where("checked is null and some is null").select("qid"), "qid", "left_semi")
    shape = lambda d, order: d.select("qid", F.struct(F.col(order).cast("long").alias("at"), citation(F.col("section"), F.col("version_date")).alias("c")).alias("one"))
    both = shape(cited, "fetch_rank").unionByName(shape(first.withColumn("version_date", F.lit(None).cast("string")), "n"))
    held = both.groupBy("qid").agg(F.array_sort(F.collect_list("one")).alias("cs"))
    out = state.join(held, "qid", "left").join(evidence.select("qid").distinct().withColumn("found", F.lit(True)), "qid", "left")
    out = out.withColumn("citations", F.when(F.col("found"), F.coalesce(F.array_distinct("cs.c"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    good = F.size("citations") > 0
    before, after = ANSWER.split("{}")
    text = F.when(F.col("found").isNull(), NO_EVIDENCE).when(~good, NOT_VERIFIED).otherwise(F.concat(F.lit(before), F.array_join("citations", ", "), F.lit(after)))
    return out.select("qid", text.alias("answer"), "citations", F.when(good, "completed").otherwise("insufficient_evidence").alias("termination"))


def check_limits(*, max_steps: int = 6, top_k: int = 10, most: int = 2) -> None:
    """Raises where a run could not take the steps that its limits promise."""
    for name, value, least in (("max_steps", max_steps, 1), ("top_k", top_k, 1), ("max_fetch_sections", most, 0)):
        if value < least:
            raise ValueError(f"{name} must be at least {least}")
    if max_steps < 2 * most + 2:
        raise ValueError("max_steps must be at least 2 * max_fetch_sections + 2")


def run_steps(questions: DataFrame, evidence: DataFrame, fetched: DataFrame, verified: DataFrame, answers: DataFrame, *, max_steps: int = 6, top_k: int = 10, most: int = 2) -> DataFrame:
    """(qid, step_number, action, status, section): what a run of each question does, up to ``max_steps``.

    A search; where it finds anything, a fetch and then a check of each section in the order of fetching,
    and the final answer. Steps beyond the limit are not taken; ``limited_answers`` says how such runs end.
    """
    check_limits(max_steps=max_steps, top_k=top_k, most=most)
    some = evidence.select("qid").distinct()
    fetched = fetched.join(some, "qid", "left_semi").select("qid", "fetch_rank", "section")
    status = F.when(F.coalesce("verified", F.lit(False)), "completed").otherwise("failed")
    shape = lambda d, phase, at, action, status, section: d.select("qid", F.lit(phase).alias("phase"), at.cast("int").alias("at"), F.lit(action).alias("action"), status.alias("status"), section.cast("string").alias("section"))
    none, zero, done = F.lit(None), F.lit(0), F.lit("completed")
    steps = shape(questions, 0, zero, "search_regulations", done, none)
    steps = steps.unionByName(shape(fetched, 1, F.col("fetch_rank"), "fetch_section", done, F.col("section")))
    steps = steps.unionByName(shape(fetched.join(verified.select("qid", "section", "verified"), ["qid", "section"], "left"), 2, F.col("fetch_rank"), "verify_citation", status, F.col("section")))
    steps = steps.unionByName(shape(answers.join(some, "qid", "left_semi"), 3, zero, "final_answer", F.col("termination"), none))
    number = F.row_number().over(Window.partitionBy("qid").orderBy("phase", "at"))
    return steps.withColumn("step_number", number).where(F.col("step_number") <= max_steps).select("qid", "step_number", "action", "status", "section")


def limited_answers(answers: DataFrame, evidence: DataFrame, steps: DataFrame) -> DataFrame:
    """``answers`` with ``steps`` taken; a run that found evidence and did not come to its final answer gets the
    fixed sentence, no citation and max_steps_exceeded."""
    taken = steps.groupBy("qid").agg(F.count(F.lit(1)).alias("steps"), F.max(F.col("action") == "final_answer").alias("ended"))
    some = evidence.select("qid").distinct().withColumn("some", F.lit(True))
    out = answers.join(taken, "qid").join(some, "qid", "left").withColumn("over", F.coalesce("some", F.lit(False)) & ~F.col("ended"))
    none = F.array().cast("array<string>")
    return out.select(
        "qid", F.when(F.col("over"), NO_EVIDENCE).otherwise(F.col("answer")).alias("answer"), F.when(F.col("over"), none).otherwise(F.col("citations")).alias("citations"),
        F.when(F.col("over"), "max_steps_exceeded").otherwise(F.col("termination")).alias("termination"), "steps",
    )


def traces(answers: DataFrame, evidence: DataFrame, most: int = 10) -> DataFrame:
    """(qid, trace): a JSON object of the answer and its first pieces of evidence."""
    e = evidence.where(F.col("rank") <= most).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "section", "source"))).alias("evidence"))
    return answers.join(e, "qid", "left").select("qid", F.to_json(F.struct("qid", "answer", "citations", "termination", "evidence")).alias("trace"))


def used_citations(answers: DataFrame) -> DataFrame:
    """``answers`` (qid, said, citations) with the citations that the answer names, by themselves or by
    their section alone; all of them where it names none."""
    named = F.filter("citations", lambda c: F.contains(F.col("said"), c) | F.contains(F.col("said"), F.regexp_replace(c, r" \([^)]*\)$", "")))
    return answers.withColumn("citations", F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(F.col("citations")))


def simple_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, evidence, answer): the numbered evidence that an answer may use; without any, the answer is
    the fixed sentence and no model is asked. ``hits`` has qid, rank, label, text."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), "label", F.lit("\n"), "text")
    held = hits.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))["b"], "\n\n").alias("evidence"))
    return questions.select("qid").join(held, "qid", "left").withColumn("answer", F.when(F.col("evidence").isNull(), NO_EVIDENCE))
