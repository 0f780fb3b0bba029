"""Evaluation of rankings and answers.

Questions have question_id, question_type and groups (array of arrays of sections: any of a group will
do, every group is needed; a single-section question has one group). Rankings have question_id, rank, section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.functions import text as T


# What is said of each kind of failure.
ACTIONS = {
    "cross_section_retrieval_design_issue": "The query retrieves part of the required evidence but not every required evidence group.",
    "cross_section_ranking_issue": "None of the required evidence sections appear in the saved ranking.",
    "same_part_ranking_issue": "The ranking stays in the expected CFR part but favors neighboring or competing sections.",
    "ranking_issue": "The expected section is absent from the saved ranking and top results are not concentrated in the same part.",
}


def group_ranks(questions: DataFrame, rankings: DataFrame) -> DataFrame:
    """(question_id, group_no, first): the rank at which each evidence group is first met, or null."""
    groups = questions.select("question_id", F.posexplode("groups").alias("group_no", "g"))
    wanted = groups.select("question_id", "group_no", F.explode("g").alias("section"))
    met = wanted.join(rankings, ["question_id", "section"]).groupBy("question_id", "group_no").agg(F.min("rank").alias("first"))
    return groups.select("question_id", "group_no").join(met, ["question_id", "group_no"], "left")


def question_metrics(questions: DataFrame, rankings: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(question_id, question_type, complete_rank, recall_at_k ...): complete where every group is met."""
    per = group_ranks(questions, rankings).groupBy("question_id").agg(
        F.when(F.count("first") == F.count(F.lit(1)), F.max("first")).alias("complete_rank"),
        *[(F.sum(F.when(F.col("first") <= k, 1).otherwise(0)) / F.count(F.lit(1))).alias(f"recall_at_{k}") for k in ks],
    )
    filled = questions.select("question_id", "question_type").join(per, "question_id", "left")
    return filled.select("question_id", "question_type", "complete_rank", *[F.coalesce(f"recall_at_{k}", F.lit(0.0)).alias(f"recall_at_{k}") for k in ks])


def summary(metrics: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: questions, hit and recall at each k, mean reciprocal rank within the largest k."""
    rate = lambda c, name: F.round(F.avg(c), 6).alias(name)
    hit = [rate(F.when(F.col("complete_rank") <= k, 1.0).otherwise(0.0), f"hit_at_{k}") for k in ks]
    recall = [rate(F.col(f"recall_at_{k}"), f"recall_at_{k}") for k in ks]
    rr = F.when(F.col("complete_rank") <= max(ks), 1.0 / F.col("complete_rank")).otherwise(0.0)
    return metrics.agg(F.count(F.lit(1)).alias("questions"), *hit, *recall, rate(rr, "mrr"))


def delta(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Differences of two summaries, rounded to six places."""
    names = [c for c in candidate.columns if c != "questions"]
    return candidate.alias("a").crossJoin(baseline.alias("b")).select(*[F.round(F.col(f"a.{n}") - F.col(f"b.{n}"), 6).alias(n) for n in names])


def failure_reasons(questions: DataFrame, rankings: DataFrame, k: int = 10) -> DataFrame:
    """(question_id, reason, action, found_groups) of questions whose evidence is not complete within k."""
    met = group_ranks(questions, rankings.where(F.col("rank") <= k)).groupBy("question_id").agg(F.count("first").alias("found"), F.count(F.lit(1)).alias("groups"))
    parts = questions.select("question_id", F.explode(F.flatten("groups")).alias("s")).select("question_id", F.split_part("s", F.lit("."), F.lit(1)).alias("part")).distinct()
    near = rankings.where(F.col("rank") <= k).select("question_id", F.split_part("section", F.lit("."), F.lit(1)).alias("part")).distinct()
    same_part = parts.join(near, ["question_id", "part"], "left_semi").select("question_id").distinct().withColumn("same_part", F.lit(True))
    rows = questions.select("question_id", "question_type").join(met, "question_id", "left").join(same_part, "question_id", "left")
    reason = (
        F.when((F.col("question_type") == "cross_section") & (F.coalesce("found", F.lit(0)) > 0), "cross_section_retrieval_design_issue")
        .when(F.col("question_type") == "cross_section", "cross_section_ranking_issue")
        .when(F.coalesce("same_part", F.lit(False)), "same_part_ranking_issue")
        .otherwise("ranking_issue")
    )
    return rows.where(F.coalesce("found", F.lit(0)) < F.coalesce("groups", F.lit(1))).select("question_id", reason.alias("reason"), F.create_map(*[F.lit(x) for item in ACTIONS.items() for x in item])[reason].alias("action"), F.coalesce("found", F.lit(0)).cast("long").alias("found_groups"))


def missing_groups(groups: Column, cited: Column) -> Column:
    return F.filter(groups, lambda g: ~F.arrays_overlap(g, cited))


def missing_terms(answer: Column, terms: Column) -> Column:
    return F.filter(terms, lambda t: ~F.contains(T.answer_key(answer), T.answer_key(t)))


def matched_alias(answer: Column, aliases: Column) -> Column:
    return F.get(F.filter(aliases, lambda a: T.answer_key(a) == T.answer_key(answer)), F.lit(0))


def score_answers(answers: DataFrame) -> DataFrame:
    """``answers`` (policy, answer, aliases, terms, groups, cited) with matched_alias, missing terms and
    groups, and ``passed`` by the policy em_or_alias, contains_all or evidence_groups_and_contains; an
    unknown policy raises."""
    out = answers.withColumns({
        "matched_alias": matched_alias(F.col("answer"), F.col("aliases")),
        "missing_terms": missing_terms(F.col("answer"), F.col("terms")),
        "missing_groups": missing_groups(F.col("groups"), F.col("cited")),
    })
    no_term = F.size("missing_terms") == 0
    rule = (
        F.when(F.col("policy") == "em_or_alias", F.col("matched_alias").isNotNull() | ((F.size("terms") > 0) & no_term))
        .when(F.col("policy") == "contains_all", no_term)
        .when(F.col("policy") == "evidence_groups_and_contains", no_term & (F.size("missing_groups") == 0))
        .otherwise(F.raise_error(F.concat(F.lit("unknown policy: "), F.coalesce("policy", F.lit("null")))).cast("boolean"))
    )
    return out.withColumn("passed", rule)


def process_rates(runs: DataFrame, flags: list[str], steps: str = "steps") -> DataFrame:
    """Rates of boolean columns and the mean number of steps, rounded to six places."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), *[F.round(F.avg(F.col(f).cast("int")), 6).alias(f"{f}_rate") for f in flags], F.round(F.avg(steps), 6).alias("avg_steps"))


# What a context search uses in each variant (cited sections, references, references without a citation).
VARIANTS = {
    "baseline": (False, False, False),
    "explicit_only": (True, False, False),
    "semantic_cross_reference": (False, True, True),
    "full_context": (True, True, False),
}


def by_variant(questions: DataFrame, rankings: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``summary`` of each variant of ``rankings`` (variant, question_id, rank, section), in one pass."""
    names = rankings.select("variant").distinct()
    key = F.concat_ws("\u0001", "variant", "question_id")
    q = questions.crossJoin(F.broadcast(names)).withColumn("question_id", key)
    m = question_metrics(q.drop("variant"), rankings.withColumn("question_id", key), ks).withColumn("variant", F.split_part("question_id", F.lit("\u0001"), F.lit(1)))
    rate = lambda c, name: F.round(F.avg(c), 6).alias(name)
    hit = [rate(F.when(F.col("complete_rank") <= k, 1.0).otherwise(0.0), f"hit_at_{k}") for k in ks]
    recall = [rate(F.col(f"recall_at_{k}"), f"recall_at_{k}") for k in ks]
    rr = F.when(F.col("complete_rank") <= max(ks), 1.0 / F.col("complete_rank")).otherwise(0.0)
    return m.groupBy("variant").agg(F.count(F.lit(1)).alias("questions"), *hit, *recall, rate(rr, "mrr"))


def gold_expansion(questions: DataFrame, rankings: DataFrame) -> DataFrame:
    """``rankings`` (question_id, rank, section) of cross-section questions with the first section of each
    missing group put in after the first hit that counts, ranked anew, and ``expanded``.

    It reads the labels, so it is an upper bound and no search. Questions without any such hit stay as they are.
    """
    cross = questions.where(F.col("question_type") == "cross_section").select("question_id", F.posexplode("groups").alias("group_no", "g"))
    wanted = cross.select("question_id", "group_no", F.explode("g").alias("section")).distinct()
    met = wanted.join(rankings.select("question_id", "section", "rank"), ["question_id", "section"])
    first = met.groupBy("question_id").agg(F.min("rank").alias("after"))
    # A missing group whose first section an earlier missing group brought in is there by then.
    missing = cross.join(met.select("question_id", "group_no").distinct(), ["question_id", "group_no"], "left_anti").join(first, "question_id")
    seen = F.array_distinct(F.flatten(F.collect_list(F.array(F.get("g", F.lit(0)))).over(Window.partitionBy("question_id").orderBy("group_no").rowsBetween(Window.unboundedPreceding, -1))))
    added = missing.withColumn("before", seen).where(~F.arrays_overlap("g", "before") | (F.size("before") == 0)).select("question_id", F.col("after").alias("rank"), (F.col("group_no") + 1).alias("turn"), F.get("g", F.lit(0)).alias("section"), F.lit(True).alias("expanded"))
    both = rankings.select("question_id", "rank", F.lit(0).alias("turn"), "section", F.lit(False).alias("expanded")).unionByName(added)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "turn"))
    return both.select("question_id", place.alias("rank"), "section", "expanded")


def tool_checks(expected: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, passed, missing, mismatches): expected sections that were not found, and those whose
    first source is another than ``expected`` (question_id, section, source) says (null: any)."""
    first = evidence.where(T.or_null(F.col("section")).isNotNull()).groupBy("question_id", "section").agg(F.min_by("source", "rank").alias("actual"))
    e = expected.join(first, ["question_id", "section"], "left")
    wrong = F.col("source").isNotNull() & ~F.col("actual").eqNullSafe(F.col("source"))
    out = e.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("actual").isNull(), F.col("section")))).alias("missing"), F.array_sort(F.collect_list(F.when(wrong, F.col("section")))).alias("mismatches")
    )
    return out.select("question_id", ((F.size("missing") == 0) & (F.size("mismatches") == 0)).alias("passed"), "missing", "mismatches")


def process_flags(expected: DataFrame, evidence: DataFrame, fetched: DataFrame, verified: DataFrame, answers: DataFrame) -> DataFrame:
    """Per question (question_id): whether the expected sections were found, fetched, all fetched ones
    verified, every citation backed by a verified section, how many steps it took, and how it ended.

    A search, a step for each fetched section, one for each check, and the answer; without evidence only
    the search."""
    found = evidence.select("question_id", "section").union(fetched.select("question_id", "section")).distinct().withColumn("f", F.lit(True))
    got = fetched.select("question_id", "section").distinct().withColumn("g", F.lit(True))
    want = expected.join(found, ["question_id", "section"], "left").join(got, ["question_id", "section"], "left").groupBy("question_id").agg(F.every(F.col("f").isNotNull()).alias("found"), F.every(F.col("g").isNotNull()).alias("fetched_all"))
    checks = fetched.select("question_id", "section").join(verified.select("question_id", "section", "verified"), ["question_id", "section"], "left")
    checks = checks.groupBy("question_id").agg(F.every(F.coalesce("verified", F.lit(False))).alias("checked"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(F.col("verified"), F.concat(F.lit("12 CFR "), "section")))).alias("backed"))
    some = evidence.select("question_id").distinct().withColumn("any", F.lit(True))
    a = answers.join(want, "question_id", "left").join(checks, "question_id", "left").join(some, "question_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    backed = F.coalesce("backed", F.array().cast("array<string>"))
    supported = (F.size("citations") > 0) & F.forall("citations", lambda c: F.exists(backed, lambda b: F.contains(c, b)))
    steps = F.when(F.col("any").isNull(), 1).otherwise(2 + 2 * F.coalesce("n", F.lit(0)))
    return a.select("question_id", yes("found").alias("expected_section_found"), yes("fetched_all").alias("fetch_section_success"), yes("checked").alias("citation_verified"), F.coalesce(supported, F.lit(False)).alias("final_answer_citation_supported"), steps.cast("long").alias("steps"), "termination")


FLAGS = ("expected_section_found", "fetch_section_success", "citation_verified", "final_answer_citation_supported")


def process_summary(flags: DataFrame) -> DataFrame:
    """One row: questions, the rate of each flag, average steps, and how runs ended as JSON; no runs raise."""
    ends = flags.groupBy("termination").agg(F.count(F.lit(1)).alias("n")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("termination", "n"))))).alias("terminations"))
    one = flags.agg(F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(F.col(f).cast("int")), 6).alias(f"{f}_rate") for f in FLAGS], F.round(F.avg("steps"), 6).alias("average_steps"))
    some = F.when(F.col("questions") == 0, F.raise_error(F.lit("results must not be empty")).cast("long")).otherwise(F.col("questions"))
    return one.withColumn("questions", some).crossJoin(ends)


def judge_summary(scores: DataFrame) -> DataFrame:
    """One row: questions, pass rate and the average of each score, rounded to six places; none raise."""
    out = scores.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"), *[F.round(F.avg(s), 6).alias(f"average_{s}") for s in T.SCORES])
    some = F.when(F.col("questions") == 0, F.raise_error(F.lit("results must not be empty")).cast("long")).otherwise(F.col("questions"))
    return out.withColumn("questions", some)


def lineage(alignment: DataFrame) -> DataFrame:
    """(row_id, sections): the official sections that a legacy row safely stands for, from alignment rows
    (row_id, section, status, reason, legacy_id). Statuses and the reason are fixed values."""
    safe = F.col("status").isin("exact", "high_confidence") | ((F.col("reason") == "legacy_source_truncated") & F.col("legacy_id").isNotNull())
    ok = alignment.where(F.col("row_id").isNotNull() & F.coalesce(safe, F.lit(False)))
    return ok.groupBy("row_id").agg(F.array_sort(F.collect_set("section")).alias("sections"))


def acceptable_summary(hits: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row over ``hits`` (question_id, rank, sections, acceptable): hit rates, mean reciprocal rank,
    failures, and how many results stand for no section."""
    per = questions.select("question_id").distinct().join(hits.groupBy("question_id").agg(F.min(F.when(F.col("acceptable"), F.col("rank"))).alias("first"), F.count(F.lit(1)).alias("results"), F.count_if(F.coalesce(F.size("sections"), F.lit(0)) < 1).alias("unmapped")), "question_id", "left")
    hit = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_at_{k}") for k in ks]
    return per.agg(
        F.count(F.lit(1)).alias("questions"), *hit, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr_at_10"),
        F.count_if(F.col("first").isNull()).alias("failures"), F.coalesce(F.sum("unmapped"), F.lit(0)).alias("unmapped"), F.round(F.sum("unmapped") / F.sum("results"), 6).alias("unmapped_rate"),
    )
