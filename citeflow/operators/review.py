"""Review of evaluation candidates: automatic audit, human decisions, replacements, labels and question records.

Rows that break a rule carry the rule's name in ``problem``; ``require_clean`` raises where there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.functions import text as T
from citeflow.operators.positions import numbered
from citeflow.operators.evaluation import score_answers

# What shows a question type in a text, in the order of preference, and what its questions ask.
TYPE_PATTERNS = {
    "authority": r"(?i)(?:\(a\)\s*)?authority\.|issued pursuant to",
    "applicability": r"(?i)\b(?:applicability|scope)\b|\bappl(?:y|ies) to\b",
    "definition": r"(?i)\bmeans\b",
    "numeric_or_date": rf"(?i)\b\d+(?:\.\d+)?\s*(?:%|percent|days?|months?|years?)\b|\b(?:{T.MONTHS})\s+\d{{1,2}}(?:,\s+\d{{4}})?\b",
    "obligation": r"(?i)\b(?:must|shall|required to|may not)\b",
    "cross_section": r"(?i)§+\s*[0-9]+[a-z]?(?:\.[0-9a-z-]+)+",
}
TYPE_FOCUS = {
    "authority": "statutory authority, purpose, or decision-making power",
    "applicability": "entities, transactions, or situations covered by the rule",
    "definition": "the meaning of one clearly named regulatory term",
    "numeric_or_date": "a threshold, percentage, deadline, or effective date",
    "obligation": "a required, prohibited, or conditionally permitted action",
    "cross_section": "how the source rule depends on a specifically cited provision",
}
ACTIONS = ("approve", "retype", "needs_pair", "replace")
POLICIES = ("em_or_alias", "contains_all", "evidence_groups_and_contains")
CONTRACT = "AND across required evidence groups; OR only within an explicit alternative group"


def require_clean(rows: DataFrame) -> DataFrame:
    """``rows`` without ``problem``; raises, naming up to five problems, if any row has one."""
    bad = rows.where(F.col("problem").isNotNull()).select("problem").distinct().orderBy("problem").limit(5).collect()
    if bad:
        raise ValueError("; ".join(r.problem for r in bad))
    return rows.drop("problem")


def evidence_window(text: Column, pattern: str, width: int = 700) -> Column:
    """The text around the first match: a third of ``width`` before its start to ``width`` after it; null without one."""
    at = F.regexp_instr(text, F.lit(pattern)) - 1
    start = F.greatest(F.lit(0), at - width // 3)
    return F.when(at >= 0, T.collapse(F.substring(text, start + 1, F.least(F.length(text), at + width) - start)))


def by_type(kind: Column, make) -> Column:
    """``make(pattern, name)`` of the row's question type."""
    out = None
    for name, pattern in TYPE_PATTERNS.items():
        out = (F.when if out is None else out.when)(kind == name, make(pattern, name))
    return out


def review_candidates(candidates: DataFrame, sections: DataFrame, legacy: DataFrame) -> DataFrame:
    """An automatic review of each candidate (candidate_id, question_type, section, refs), joined with its
    section (section, heading, text); ``legacy`` has the sections of the older baseline.

    Adds proposed_type, recommendation (approved, retype, needs_pair, replace), difficulty, focus,
    excerpt, partners (five at most) and flags. A candidate without its section has a problem.
    """
    known = sections.select("section", "heading", "text").withColumn("there", F.lit(True))
    c = candidates.join(known, "section", "left").join(legacy.select("section").distinct().withColumn("old", F.lit(True)), "section", "left")
    refs = candidates.select("candidate_id", "section", F.posexplode("refs").alias("at", "ref")).where("ref != section")
    valid = refs.join(sections.select(F.col("section").alias("ref")).distinct(), "ref", "left_semi").groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("at", "ref")))["ref"].alias("valid"))
    c = c.join(valid, "candidate_id", "left").withColumn("valid", F.coalesce("valid", F.array().cast("array<string>")))
    kind, cross = F.col("question_type"), F.col("question_type") == "cross_section"
    label = T.strip(F.regexp_replace(F.lower("heading"), r"^§\s*\S+\s*", ""))
    headed = ((kind == "authority") & label.startswith("authority")) | ((kind == "applicability") & (label.startswith("applicability") | label.startswith("scope")))
    c = c.withColumns({"types": T.section_types(F.col("heading"), F.col("text")), "found": F.coalesce(by_type(kind, lambda p, _: evidence_window(F.col("text"), p)), F.when(headed, T.collapse(F.substring("text", 1, 700))))})
    flags = {"long_section": F.length("text") > 5000, "many_possible_question_types": F.size("types") >= 4, "overlaps_legacy_baseline": F.col("old").isNotNull(), "many_cross_section_choices": cross & (F.size("valid") > 5)}
    others = [F.when((kind != n) & F.array_contains("types", n) & F.col("text").rlike(p), F.lit(n)) for n, p in TYPE_PATTERNS.items() if n != "cross_section"]
    c = c.withColumns({"flags": F.array_compact(F.array(*[F.when(on, F.lit(n)) for n, on in flags.items()])), "other": F.coalesce(*others), "has": F.coalesce(F.col("found") != "", F.lit(False))})
    c = c.withColumn("recommendation", F.when(cross, F.when(F.size("valid") > 0, "needs_pair").otherwise("replace")).when(F.col("has"), "approved").when(F.col("other").isNotNull(), "retype").otherwise("replace"))
    retyped = F.col("recommendation") == "retype"
    c = c.withColumn("proposed_type", F.when(retyped, F.col("other")).otherwise(kind))
    term = F.when(F.col("proposed_type") == "definition", T.definition_term(F.col("text")))
    focus = F.create_map(*[F.lit(x) for item in TYPE_FOCUS.items() for x in item])[F.col("proposed_type")]
    return c.select(
        "candidate_id", "section", "question_type", "proposed_type", "recommendation",
        F.when(cross, "hard").when((F.length("text") > 3000) | (F.size("flags") > 0), "medium").otherwise("easy").alias("difficulty"),
        F.coalesce(F.concat(F.lit("definition of '"), term, F.lit("'")), focus).alias("focus"),
        F.when(retyped, by_type(F.col("other"), lambda p, _: evidence_window(F.col("text"), p))).otherwise(F.col("found")).alias("excerpt"),
        F.slice("valid", 1, 5).alias("partners"), "flags",
        F.when(F.col("there").isNull(), "candidate without section").alias("problem"),
    )


def partner_sections(options: Column) -> Column:
    """All sections that a decision's options name (arrays ``defaults`` and ``conditionals``)."""
    return F.array_distinct(F.flatten(F.transform(options, lambda o: F.concat(F.coalesce(o["defaults"], F.array().cast("array<string>")), F.coalesce(o["conditionals"], F.array().cast("array<string>"))))))


def apply_decisions(candidates: DataFrame, reviews: DataFrame, decisions: DataFrame, sections: DataFrame) -> DataFrame:
    """(candidate_id, route, review_state, approved_types, human_reason, automatic, problem).

    ``decisions`` (candidate_id, action, reason, approved_types, options) of people come before the automatic
    ``reviews`` (candidate_id, recommendation). Routes are single, cross and excluded.
    """
    d = decisions.select("candidate_id", "action", "reason", "approved_types", partner_sections(F.col("options")).alias("partners"))
    asked = d.select("candidate_id", F.explode("partners").alias("section")).join(sections.select("section").distinct(), "section", "left_anti").select("candidate_id").distinct().withColumn("lost", F.lit(True))
    c = candidates.select("candidate_id", "question_type").withColumn("known", F.lit(True)).join(d, "candidate_id", "full")
    c = c.join(reviews.select("candidate_id", F.col("recommendation").alias("automatic")), "candidate_id", "left").join(asked, "candidate_id", "left")
    act, own = F.col("action"), F.array("question_type")
    none = F.coalesce(F.size("approved_types"), F.lit(0)) < 1
    problem = (
        F.when(F.col("known").isNull(), "decision on an unknown candidate")
        .when(act.isNotNull() & ~act.isin(*ACTIONS), "invalid action")
        .when((act == "needs_pair") & F.col("lost").isNotNull(), "invalid partner sections")
        .when((F.col("question_type") == "cross_section") & ~F.coalesce(act, F.lit("")).isin("replace", "needs_pair"), "cross-section candidate without a pairing")
        .when((act == "retype") & none, "retype without approved types")
        .when(act.isNull() & (F.coalesce("automatic", F.lit("")) != "approved"), "recommendation needs a decision")
    )
    state = F.when(act == "replace", "excluded").when(act == "needs_pair", "human_pairing_confirmed").when(act == "retype", "human_confirmed_retype").when(act == "approve", "human_confirmed").otherwise("auto_prescreened_pending")
    route = F.when(act == "replace", "excluded").when(act == "needs_pair", "cross").otherwise("single")
    types = F.when(act == "retype", F.col("approved_types")).when(act.isNull() | (act == "approve"), own)
    return c.select("candidate_id", route.alias("route"), state.alias("review_state"), types.alias("approved_types"), F.col("reason").alias("human_reason"), "automatic", problem.alias("problem"))


def merge_replacements(shortlist: DataFrame, selections: DataFrame, sections: DataFrame) -> DataFrame:
    """(candidate_id, replaces, section, approved_types, review_state, problem) of selected replacements.

    ``shortlist`` has replacement_id, replacement_for, section; ``selections`` replaced_id, selected_id,
    approved_types, reason."""
    there = sections.select("section").distinct().withColumn("there", F.lit(True))
    s = selections.join(shortlist.withColumnRenamed("replacement_id", "selected_id"), "selected_id", "left").join(there, "section", "left")
    s = s.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("selected_id")))
    problem = (
        F.when(F.col("replacement_for").isNull(), "unknown replacement")
        .when(F.col("times") > 1, "replacement selected more than once")
        .when(F.col("replacement_for") != F.col("replaced_id"), "replacement of another candidate")
        .when(F.col("there").isNull(), "replacement without section")
        .when(F.coalesce(F.size("approved_types"), F.lit(0)) < 1, "replacement without approved types")
    )
    return s.select(F.col("selected_id").alias("candidate_id"), F.col("replaced_id").alias("replaces"), "section", "approved_types", F.lit("human_confirmed_replacement").alias("review_state"), problem.alias("problem"))


def still_to_replace(decisions: DataFrame, selections: DataFrame) -> DataFrame:
    """candidate_id of the candidates to be replaced for which nothing is selected yet."""
    return decisions.where(F.col("action") == "replace").select("candidate_id").join(selections.select(F.col("replaced_id").alias("candidate_id")), "candidate_id", "left_anti")


def finalize_labels(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(question_id, label_method, sections, problem): automatic labels stay, others need a person's.

    ``records`` has question_id, label_status, candidates (sections); ``labels`` question_id, sections."""
    r = records.withColumn("known", F.lit(True)).join(labels.select("question_id", F.col("sections").alias("given"), F.lit(True).alias("labelled")), "question_id", "full")
    auto, review = F.col("label_status") == "auto_labeled", F.coalesce(F.col("label_status") == "review_required", F.lit(False))
    problem = (
        F.when(F.col("labelled").isNotNull() & ~review, "unexpected label")
        .when(review & F.col("labelled").isNull(), "missing label")
        .when(~auto & ~review, "cannot finalize this status")
        .when(review & (F.size(F.array_except("given", "candidates")) > 0), "label is no candidate")
        .when(review & (F.size("given") < 1), "no accepted section")
    )
    return r.select("question_id", F.when(auto, "auto_unique_exact").when(review, "human_confirmed_equivalence").alias("label_method"), F.when(auto, F.col("candidates")).when(review, F.col("given")).alias("sections"), problem.alias("problem"))


def validate_records(records: DataFrame) -> DataFrame:
    """(question_id, position, errors) of the records that break a rule.

    ``records`` has position, question_id, split, question_type, policy, expected_answer, aliases, terms,
    groups, sections. A repeated id is reported and not judged again. The expected answer must pass its own policy.
    """
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    cross = F.coalesce(F.col("question_type") == "cross_section", F.lit(False))
    supported = F.coalesce(F.col("policy").isin(*POLICIES), F.lit(False))
    rules = [
        (F.coalesce(F.col("split") != "development", F.lit(True)), "split must be development"),
        (~supported, "unsupported metric_policy"),
        (empty("aliases"), "acceptable_answers must be a non-empty list"),
        (empty("terms"), "must_contain must be a non-empty list"),
        (cross & empty("groups"), "cross_section records need required_evidence_groups"),
        (cross & ~empty("groups") & F.coalesce(F.exists("groups", lambda g: F.coalesce(F.size(g), F.lit(0)) < 1), F.lit(False)), "required_evidence_groups must be non-empty lists"),
        (~cross & empty("sections"), "single-section records need acceptable_sections"),
    ]
    r = records.withColumn("nth", F.row_number().over(Window.partitionBy("question_id").orderBy("position")))
    r = r.withColumn("errors", F.when(F.col("nth") > 1, F.array(F.lit("duplicate question_id"))).otherwise(F.array_compact(F.array(*[F.when(on, F.lit(name)) for on, name in rules]))))
    cited = F.when(cross, F.flatten("groups")).otherwise(F.col("sections"))
    none = F.array().cast("array<array<string>>")
    fine = r.where(F.size("errors") == 0).select("position", "policy", F.col("expected_answer").alias("answer"), "aliases", "terms", F.when(cross, F.col("groups")).otherwise(none).alias("groups"), cited.alias("cited"))
    failed = score_answers(fine).where(~F.col("passed")).select("position", F.lit(True).alias("failed"))
    r = r.join(failed, "position", "left").withColumn("errors", F.when(F.col("failed"), F.array(F.lit("expected_answer does not pass metric policy"))).otherwise(F.col("errors")))
    return r.where(F.size("errors") > 0).select("question_id", "position", "errors")


def assemble_records(candidates: DataFrame, drafts: DataFrame, sections: DataFrame) -> DataFrame:
    """(question_id, candidate_id, question_type, sections, urls, headings, problem).

    ``candidates`` has candidate_id, route, question_type, approved_types, section; ``drafts`` candidate_id,
    draft_type, groups (for pairs); ``sections`` section, heading, source_url. Ids count single records
    first, then cross ones, each in the order of candidate_id.
    """
    c = candidates.where("route in ('single', 'cross')").join(drafts.withColumn("drafted", F.lit(True)), "candidate_id", "left")
    pair = F.col("question_type") == "cross_section"
    approved = F.coalesce("approved_types", F.array().cast("array<string>"))
    kind = F.coalesce("draft_type", F.when(pair, "cross_section").otherwise(F.get(approved, F.lit(0))))
    problem = F.when(F.col("drafted").isNull(), "no draft").when(F.col("draft_type").isNotNull() & ~F.array_contains(approved, F.col("draft_type")), "draft type is not approved").when(F.col("draft_type").isNull() & ~pair & (F.size(approved) != 1), "needs one question type")
    wanted = F.when(F.col("route") == "cross", F.flatten("groups")).otherwise(F.array("section"))
    c = c.select("candidate_id", "route", kind.alias("question_type"), wanted.alias("wanted"), problem.alias("problem"))
    each = c.select("candidate_id", F.posexplode("wanted").alias("at", "section")).join(sections.select("section", "heading", "source_url"), "section", "left")
    held = each.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("at", "section", "heading", "source_url"))).alias("s"), F.count_if(F.col("heading").isNull()).alias("lost"))
    return _numbered(c, held)


def _numbered(c: DataFrame, held: DataFrame) -> DataFrame:
    number = F.col("at") + 1
    placed = numbered(c.withColumn("late", (F.col("route") == "cross").cast("int")), ["late", "candidate_id"])
    out = placed.withColumn("question_id", F.format_string("title12-dev-q%03d", number.cast("long"))).join(held, "candidate_id", "left")
    return out.select("question_id", "candidate_id", "question_type", F.col("s.section").alias("sections"), F.col("s.source_url").alias("urls"), F.col("s.heading").alias("headings"), F.coalesce("problem", F.when(F.coalesce("lost", F.lit(1)) > 0, "unknown section")).alias("problem"))
