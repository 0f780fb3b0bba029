"""Queries of search modes, evaluation matrices, reviews and samples, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeflow.functions import text as T
from citeflow.operators import agent, corpus, evaluation, retrieval, review, sampling
from citeflow.operators.tables import stored
from citeflow.plans.queries import (
    SQL_CONTEXT, SQL_DENSE, SQL_EVAL, SQL_FETCH, SQL_JUDGED, SQL_REF, _semantic, _typed, answered, chunks, context_rows, gold, judged, query, questions, ref, sections, table,
)

# --- search ---

SQL_LEX = r"""docs as (select d.doc_id as doc, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:\.[a-z0-9-]+)*') as t from documents d where doc_id in (select vec_id from embeddings)),
    lens as (select doc, len(t) as doc_len from docs), whole as (select count(*) as n, avg(doc_len) as avg_len from lens),
    post as (select term, doc, count(*) as tf from (select doc, unnest(t) as term from docs) group by all), dfs as (select term, count(*) as df from post group by term),
    asked as (select qid, term, count(*) as times from (select doc as qid, unnest(t) as term from docs where doc % 50 = 0) group by all),
    lex as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc) as rank from (
        select qid, post.doc, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))) as score
        from asked join dfs using (term) join post using (term) join lens on lens.doc = post.doc cross join whole group by qid, post.doc))"""


@query(f"""with {SQL_DENSE}, {SQL_LEX}, lists as (select qid, doc, rank from dn where rank <= 30 union all select qid, doc, rank from lex where rank <= 30),
    fused as (select qid, doc, sum(1.0 / (60 + rank)) as score, min(rank) as first from lists group by qid, doc)
    select qid, rank, doc, round(score, 9) as score from (select *, row_number() over (partition by qid order by round(score, 12) desc, first, doc) as rank from fused) where rank <= 10""")
def hybrid_search(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(v.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    docs = stored(docs, "docs")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.coalesce("text", F.lit("")).alias("question"))
    return retrieval.hybrid(docs, v, asked, v.where("vec_id % 50 = 0")).select("qid", "rank", "doc", F.round("score", 9).alias("score"))


@query(f"with {SQL_CONTEXT} select 'semantic' as mode, qid, rank, section, 'semantic' as source from semantic union all select 'citation_aware', qid, rank, section, source from context where rank <= 10")
def search_modes(spark, sf_dir):
    q, c, s = questions(spark, sf_dir), chunks(spark, sf_dir), _semantic(spark, sf_dir)
    both = [retrieval.search(q, c, s, mode=m).select(F.lit(m).alias("mode"), "qid", "rank", "section", "source") for m in ("semantic", "citation_aware")]
    return both[0].unionByName(both[1])


@query(f"""with {SQL_FETCH}, c as (select qid, list('12 CFR ' || section || ' (' || version_date || ')' order by fetch_rank) as cs, first(section order by fetch_rank) as s from verified where v and u and s group by qid)
    select qid, case when qid % 3 = 0 and len(cs) > 1 then cs[1:1] else cs end as citations from c""")
def used_citations(spark, sf_dir):
    evidence, fetched, checked = answered(spark, sf_dir)
    full = agent.final_answers(questions(spark, sf_dir), evidence, fetched, checked).where(F.size("citations") > 0)
    said = F.expr("case when qid % 3 = 0 then concat('By ', split_part(citations[0], ' (', 1), ' it must.') else 'It must.' end")
    return agent.used_citations(full.select("qid", said.alias("said"), "citations")).select("qid", "citations")


@query(f"""with {SQL_CONTEXT}, kept as (select qid, rank, section, s.text from semantic s where qid % 4 <> 1)
    select questions.qid, md5(string_agg('[' || rank || '] Source: ' || section || chr(10) || text, chr(10) || chr(10) order by rank)) as evidence,
           case when count(rank) = 0 then 'Insufficient information in the provided evidence.' end as answer from questions left join kept using (qid) group by questions.qid""")
def simple_answers(spark, sf_dir):
    hits = _semantic(spark, sf_dir).where("qid % 4 <> 1").select("qid", "rank", T.source_label(F.col("rank"), F.col("chunk_id"), F.lit(None), F.col("section")).alias("label"), "text")
    return agent.simple_prompts(questions(spark, sf_dir), hits).select("qid", F.md5("evidence").alias("evidence"), "answer")


# --- evaluation ---

SQL_VARIANTS = f"""{SQL_EVAL}, sx as (select qid, rank, in_text, key from (select qid, rank, unnest(x) as key, generate_subscripts(x, 1) as in_text from (
        select qid, rank, regexp_extract_all(lower(text), '(?:12\\s+cfr\\s+|§+\\s*)([0-9]+[a-z]?(?:\\.[0-9a-z-]+)+)', 1) as x from semantic))),
    sfresh as (select qid, key, min(rank * 100000 + in_text) as pos from sx where not exists (select 1 from semantic s where s.qid = sx.qid and s.section = sx.key) group by qid, key),
    staken as (select * from (select *, row_number() over (partition by qid order by pos, key) as n from sfresh) where n <= 5),
    vhits as (
        select 'baseline' as variant, qid, 2 as tier, rank as a, section from semantic
        union all select 'explicit_only', qid, 0, ref_pos, section from explicit union all select 'explicit_only', qid, 2, rank, section from semantic
        union all select 'semantic_cross_reference', qid, 1, n, section from staken join sections on key = section union all select 'semantic_cross_reference', qid, 2, rank, section from semantic
        union all select 'full_context', qid, tier, a, section from hits),
    vfirst as (select * from (select *, row_number() over (partition by variant, qid, section order by tier, a) as c from vhits) where c = 1),
    vrank as (select variant, qid as question_id, section, row_number() over (partition by variant, qid order by tier, a) as rank from vfirst)"""
SQL_MATRIX = """ vg as (select v.variant, g.question_id, g.no, min(case when r.rank <= 10 then r.rank end) as first from g cross join (select distinct variant from {0}) v
        left join {0} r on r.variant = v.variant and r.question_id = g.question_id and list_contains(g.secs, r.section) group by all),
    vper as (select variant, question_id, case when count(first) = count(*) then max(first) end as complete_rank, avg(case when first <= 1 then 1.0 else 0 end) as r1, avg(case when first <= 5 then 1.0 else 0 end) as r5,
        avg(case when first <= 10 then 1.0 else 0 end) as r10 from vg group by all)
    select variant, count(*) as questions, round(avg(case when complete_rank <= 1 then 1.0 else 0 end), 6) as hit_at_1, round(avg(case when complete_rank <= 5 then 1.0 else 0 end), 6) as hit_at_5,
        round(avg(case when complete_rank <= 10 then 1.0 else 0 end), 6) as hit_at_10, round(avg(r1), 6) as recall_at_1, round(avg(r5), 6) as recall_at_5, round(avg(r10), 6) as recall_at_10,
        round(avg(coalesce(1.0 / complete_rank, 0)), 6) as mrr from vper group by variant"""


def variant_rankings(spark, sf_dir):
    q, c, s = questions(spark, sf_dir), chunks(spark, sf_dir), _semantic(spark, sf_dir)
    out = None
    for name, (cited, expand, anyway) in evaluation.VARIANTS.items():
        found = retrieval.search(q, c, s, mode="semantic") if name == "baseline" else retrieval.context_search(q, c, s, citations=cited, expand=expand, without_citation=anyway)
        one = found.select(F.lit(name).alias("variant"), F.col("qid").alias("question_id"), "rank", "section")
        out = one if out is None else out.unionByName(one)
    return out.checkpoint()


@query(f"with {SQL_VARIANTS}, {SQL_MATRIX.format('vrank')}")
def variant_matrix(spark, sf_dir):
    return evaluation.by_variant(gold(spark, sf_dir), variant_rankings(spark, sf_dir))


SQL_EXPANDED = f"""{SQL_EVAL}, mets as (select g.question_id, g.no, c.rank, g.secs from g join context c on c.qid = g.question_id and list_contains(g.secs, c.section) and c.rank <= 10 where g.question_type = 'cross_section'),
    firsts2 as (select question_id, min(rank) as after from mets group by question_id),
    adds as (select g.question_id, f.after as rank, g.no as turn, g.secs[1] as section from g join firsts2 f using (question_id) where not exists (select 1 from mets m where m.question_id = g.question_id and m.no = g.no)),
    exp as (select question_id, section, expanded, row_number() over (partition by question_id order by rank, turn) as rank from (
        select qid as question_id, rank, 0 as turn, section, false as expanded from context where rank <= 10 union all select question_id, rank, turn, section, true from adds))"""


@query(f"with {SQL_EXPANDED} select question_id, rank, section, expanded from exp")
def gold_expansion(spark, sf_dir):
    found = context_rows(spark, sf_dir).select(F.col("qid").alias("question_id"), "rank", "section").checkpoint()
    return evaluation.gold_expansion(gold(spark, sf_dir), found)


@query(f"with {SQL_EXPANDED}, arank as (select 'baseline' as variant, qid as question_id, section, rank from context where rank <= 10 union all select 'cross_reference_expansion', question_id, section, rank from exp), {SQL_MATRIX.format('arank')}")
def ablation_matrix(spark, sf_dir):
    found = context_rows(spark, sf_dir).select(F.col("qid").alias("question_id"), "rank", "section").checkpoint()
    more = evaluation.gold_expansion(gold(spark, sf_dir), found).drop("expanded")
    both = found.withColumn("variant", F.lit("baseline")).unionByName(more.withColumn("variant", F.lit("cross_reference_expansion")))
    return evaluation.by_variant(gold(spark, sf_dir), both)


@query("""with h as (select conv_id, list(role || ' of ' || conv_id % 3 order by turn) as x from conversations group by conv_id) select conv_id,
    'Q' || conv_id || case when conv_id % 4 = 0 then '' else chr(10) || 'Relevant section heading: ' || array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), '; ') end as query from h""")
def heading_queries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.expr("concat(role, ' of ', conv_id % 3)").alias("h"))))["h"].alias("h"))
    return c.select("conv_id", T.query_text(F.expr("concat('Q', conv_id)"), F.when(F.col("conv_id") % 4 != 0, F.col("h"))).alias("query"))


def expected(spark, sf_dir):
    g = gold(spark, sf_dir).select("question_id", F.explode(F.flatten("groups")).alias("section"))
    return g.withColumn("source", F.expr("case when question_id % 2 = 0 then 'explicit_citation' end"))


SQL_EXPECTED = "expected as (select distinct question_id, unnest(secs) as section, case when question_id % 2 = 0 then 'explicit_citation' end as source from g)"


@query(f"""with {SQL_EVAL}, {SQL_EXPECTED}, e as (select e.*, c.source as actual from expected e left join context c on c.qid = e.question_id and c.section = e.section and c.rank <= 10)
    select question_id, count_if(actual is null) = 0 and count_if(source is not null and actual is distinct from source) = 0 as passed,
        coalesce(list(section order by section) filter (where actual is null), []) as missing, coalesce(list(section order by section) filter (where source is not null and actual is distinct from source), []) as mismatches from e group by question_id""")
def tool_validation(spark, sf_dir):
    evidence = context_rows(spark, sf_dir).withColumnRenamed("qid", "question_id")
    return evaluation.tool_checks(expected(spark, sf_dir), evidence)


SQL_FLAGS = f"""{SQL_FETCH.replace('with ', '')}, {SQL_EVAL[len(SQL_CONTEXT):].lstrip(', ')}, {SQL_EXPECTED},
    want as (select question_id, bool_and(exists (select 1 from context c where c.qid = e.question_id and c.section = e.section and c.rank <= 10)) as expected_section_found,
        bool_and(exists (select 1 from fetched f where f.qid = e.question_id and f.section = e.section)) as fetch_section_success from expected e group by question_id),
    chk as (select qid, bool_and(v and u and s) as citation_verified, count(*) as n, count_if(v and u and s) as good from verified group by qid)"""


@query(f"""with {SQL_FLAGS} select w.question_id, expected_section_found, fetch_section_success, coalesce(citation_verified, false) as citation_verified, coalesce(good, 0) > 0 as final_answer_citation_supported,
    case when exists (select 1 from context c where c.qid = w.question_id) then 2 + 2 * coalesce(n, 0) else 1 end as steps, case when coalesce(good, 0) > 0 then 'completed' else 'insufficient_evidence' end as termination from want w left join chk on qid = question_id""")
def agent_validation(spark, sf_dir):
    return _flags(spark, sf_dir)


def _flags(spark, sf_dir):
    parts = answered(spark, sf_dir)
    answers = agent.final_answers(questions(spark, sf_dir), *parts)
    evidence, fetched, checked, answers = (d.withColumnRenamed("qid", "question_id") for d in (*parts, answers))
    return evaluation.process_flags(expected(spark, sf_dir).select("question_id", "section"), evidence, fetched, checked, answers)


@query(f"""with {SQL_FLAGS}, f as (select expected_section_found, fetch_section_success, coalesce(citation_verified, false) as cv, coalesce(good, 0) > 0 as fs, case when exists (select 1 from context c where c.qid = w.question_id) then 2 + 2 * coalesce(n, 0) else 1 end as steps from want w left join chk on qid = question_id)
    select count(*) as questions, round(avg(expected_section_found::int), 6) as expected_section_found_rate, round(avg(fetch_section_success::int), 6) as fetch_section_success_rate, round(avg(cv::int), 6) as citation_verified_rate,
        round(avg(fs::int), 6) as final_answer_citation_supported_rate, round(avg(steps), 6) as average_steps,
        '{{' || concat_ws(',', case when count_if(fs) > 0 then '"completed":' || count_if(fs) end, case when count_if(not fs) > 0 then '"insufficient_evidence":' || count_if(not fs) end) || '}}' as terminations from f""")
def process_summary(spark, sf_dir):
    return evaluation.process_summary(_flags(spark, sf_dir))


@query(f"with {SQL_JUDGED} select count(*) as questions, round(avg(passed::int), 6) as pass_rate, round(avg(answer_relevance), 6) as average_answer_relevance, round(avg(faithfulness), 6) as average_faithfulness, round(avg(citation_support), 6) as average_citation_support, round(avg(legal_caution), 6) as average_legal_caution, round(avg(overall), 6) as average_overall from j where ok")
def judge_summary(spark, sf_dir):
    return evaluation.judge_summary(judged(spark, sf_dir).where("j is not null").select("j.*"))


@query(f"""with a as (select doc_id, {SQL_REF('doc_id')} as section, doc_id // 2 as row_id, ['exact', 'high_confidence', 'review_required', 'unmatched'][doc_id % 4 + 1] as status, doc_id % 8 = 2 as cut from documents where doc_id % 9 <> 0)
    select row_id, list(distinct section order by section) as sections from a where status in ('exact', 'high_confidence') or cut group by row_id""")
def legacy_lineage(spark, sf_dir):
    return evaluation.lineage(_alignment(spark, sf_dir))


def _alignment(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 9 <> 0")
    return d.select(
        F.expr(ref("doc_id")).alias("section"), F.expr("doc_id div 2").alias("row_id"), F.expr("element_at(array('exact', 'high_confidence', 'review_required', 'unmatched'), cast(doc_id % 4 + 1 as int))").alias("status"),
        F.expr("case when doc_id % 8 = 2 then 'legacy_source_truncated' end").alias("reason"), F.expr("case when doc_id % 4 <> 3 then doc_id end").alias("legacy_id"),
    )


@query(f"""with {SQL_DENSE}, a as (select doc_id // 2 as row_id, {SQL_REF('doc_id')} as section from documents where doc_id % 9 <> 0 and (doc_id % 4 < 2 or doc_id % 8 = 2)), l as (select row_id, list(section) as sections from a group by row_id),
    h as (select qid, rank, sections, doc <> qid and vl = ql as ok from dn left join l on l.row_id = doc where rank <= 10),
    p as (select qid, min(rank) filter (where ok) as first, count(*) as results, count_if(sections is null) as unmapped from h group by qid)
    select count(*) as questions, round(avg(case when first <= 1 then 1.0 else 0 end), 6) as hit_at_1, round(avg(case when first <= 3 then 1.0 else 0 end), 6) as hit_at_3, round(avg(case when first <= 5 then 1.0 else 0 end), 6) as hit_at_5,
        round(avg(case when first <= 10 then 1.0 else 0 end), 6) as hit_at_10, round(avg(coalesce(1.0 / first, 0)), 6) as mrr_at_10, count_if(first is null) as failures, sum(unmapped)::bigint as unmapped, round(sum(unmapped) / sum(results), 6) as unmapped_rate from p""")
def compare_indexes(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    labels = v.select(F.col("vec_id").alias("id"), "label")
    hits = retrieval.dense(v, v.where("vec_id % 50 = 0")).join(labels.toDF("qid", "ql"), "qid").join(labels.toDF("doc", "vl"), "doc")
    hits = hits.join(evaluation.lineage(_alignment(spark, sf_dir)).withColumnRenamed("row_id", "doc"), "doc", "left")
    hits = hits.select(F.col("qid").alias("question_id"), "rank", "sections", ((F.col("doc") != F.col("qid")) & (F.col("vl") == F.col("ql"))).alias("acceptable"))
    return evaluation.acceptable_summary(hits, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id")))


# --- reviews ---


def eval_sections(spark, sf_dir):
    """Sections with kinds of text: document_id, part, section, heading, text, text_hash, safe_for_citation, source_url."""
    s = sections(spark, sf_dir).select("doc_id", "section", "source_url")
    t = _typed(spark, sf_dir).join(s, "doc_id")
    return t.select(F.col("doc_id").alias("document_id"), F.split_part("section", F.lit("."), F.lit(1)).alias("part"), "section", "heading", "text", F.sha2(T.plain_lower(F.col("text")), 256).alias("text_hash"), F.expr("doc_id % 7 <> 0").alias("safe_for_citation"), "source_url")


KINDS = "element_at(array('authority', 'applicability', 'cross_section', 'definition', 'numeric_or_date', 'obligation'), cast({} % 6 + 1 as int))"


def candidates(spark, sf_dir):
    c = eval_sections(spark, sf_dir)
    return c.select(F.expr("concat('c', document_id)").alias("candidate_id"), F.expr(KINDS.format("(document_id div 3)")).alias("question_type"), "section", T.section_references(F.col("text")).alias("refs"), "document_id")


SQL_TYPED = f"""typed as (select doc_id, {SQL_REF('doc_id')} as section, case doc_id % 4 when 0 then '§ 1.1 Definitions' when 1 then '§ 2.3 Authority and scope' else '§ 4.5 Other' end as heading,
    text || case doc_id % 5 when 0 then ' Bank means a bank. Loan means a loan.' when 1 then ' It must act and shall report within 30 days.' when 2 then ' This part applies to banks on January 5, 2020.' when 3 then ' See § 1.2 and § 3.4-a.' else '' end as text from documents)"""
_CASES = " ".join(f"when '{k}' then regexp_extract(text, '(?is)^(.*?)(?:{p.removeprefix('(?i)')})', 1)" for k, p in review.TYPE_PATTERNS.items())
_MATCH = " ".join(f"when '{k}' then regexp_matches(text, '{p}')" for k, p in review.TYPE_PATTERNS.items())
SQL_WINDOW = r"trim(regexp_replace(substr(text, greatest(0, {0} - 233) + 1, least(length(text), {0} + 700) - greatest(0, {0} - 233)), '\s+', ' ', 'g'))"


@query(rf"""with {SQL_TYPED}, c as (select 'c' || doc_id as candidate_id, doc_id, section, heading, text, ['authority', 'applicability', 'cross_section', 'definition', 'numeric_or_date', 'obligation'][(doc_id // 3) % 6 + 1] as question_type from typed),
    r as (select candidate_id, list_filter(list_distinct_x, lambda v: v <> section and list_contains(alls, v)) as valid from (select list(section) as alls from typed), (select candidate_id, section, list_filter(x, lambda v, i: list_position(x, v) = i) as list_distinct_x from (select candidate_id, section, regexp_extract_all(lower(text), '(?:12\s+cfr\s+|§+\s*)([0-9]+[a-z]?(?:\.[0-9a-z-]+)+)', 1) as x from c))),
    m as (select c.*, valid, case question_type {_MATCH} end as has, length(case question_type {_CASES} end) as pos0, starts_with(lower(heading), '§ 2.3') and question_type = 'authority' as headed,
        len(regexp_extract_all(lower(text), '\b(?:must|shall|required to|may not)\b')) >= 2 as ob, len(regexp_extract_all(lower(text), '\bmeans\b')) >= 2 as mean2 from c join r using (candidate_id))
    select candidate_id, question_type, case when question_type = 'cross_section' then case when len(valid) > 0 then 'needs_pair' else 'replace' end when has or (headed and length(trim(text)) > 0) then 'approved' else 'other' end as recommendation,
        case when has then {SQL_WINDOW.format('pos0')} when headed then trim(regexp_replace(substr(text, 1, 700), '\s+', ' ', 'g')) end as excerpt from m""")
def candidate_review(spark, sf_dir):
    legacy = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.expr(ref("doc_id")).alias("section"))
    r = review.require_clean(review.review_candidates(candidates(spark, sf_dir), eval_sections(spark, sf_dir), legacy))
    first = F.when(F.col("recommendation") != "retype", F.col("excerpt"))
    return r.select("candidate_id", "question_type", F.expr("case when recommendation in ('approved', 'needs_pair') or question_type = 'cross_section' then recommendation else 'other' end").alias("recommendation"), first.alias("excerpt"))


@query()
def review_totals(spark, sf_dir):
    legacy = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.expr(ref("doc_id")).alias("section"))
    r = review.review_candidates(candidates(spark, sf_dir), eval_sections(spark, sf_dir), legacy)
    return r.groupBy("question_type", "proposed_type", "recommendation", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("flags")).alias("flags"), F.sum(F.size("partners")).alias("partners"))


def _decided(spark, sf_dir):
    """Candidates, automatic reviews and decisions, derived from the labels: each action and each mistake occurs."""
    d = table(spark, sf_dir, "labels")
    c = d.select(F.expr("concat('c', doc_id)").alias("candidate_id"), F.expr("case when doc_id % 8 = 3 then 'cross_section' else 'definition' end").alias("question_type"))
    auto = d.select(F.expr("concat('c', doc_id)").alias("candidate_id"), F.expr("case when quality = 1 then 'approved' else 'replace' end").alias("recommendation"))
    options = f"array(named_struct('defaults', array({ref('doc_id')}), 'conditionals', case when doc_id % 16 = 3 then array('9.99999999') end))"
    said = d.where("quality = 0 or doc_id % 8 = 3").where("doc_id % 25 <> 0").select(
        F.expr("case when doc_id % 50 = 1 then concat('x', doc_id) else concat('c', doc_id) end").alias("candidate_id"),
        F.expr("case when doc_id % 8 = 3 then 'needs_pair' when doc_id % 31 = 0 then 'guess' when toxic = 1 then 'replace' when doc_id % 3 = 0 then 'retype' else 'approve' end").alias("action"),
        F.expr("concat('because ', doc_id)").alias("reason"), F.expr("case when doc_id % 6 = 0 then array('obligation') end").alias("approved_types"), F.expr(options).alias("options"),
    )
    return c, auto, said


SQL_DECIDED = f"""c as (select doc_id, 'c' || doc_id as candidate_id, case when doc_id % 8 = 3 then 'cross_section' else 'definition' end as question_type, case when quality = 1 then 'approved' else 'replace' end as automatic from labels),
    d as (select case when doc_id % 50 = 1 then 'x' || doc_id else 'c' || doc_id end as candidate_id, case when doc_id % 8 = 3 then 'needs_pair' when doc_id % 31 = 0 then 'guess' when toxic = 1 then 'replace' when doc_id % 3 = 0 then 'retype' else 'approve' end as action,
        'because ' || doc_id as reason, case when doc_id % 6 = 0 then ['obligation'] end as types, not exists (select 1 from documents o where o.doc_id = l.doc_id) or doc_id % 16 = 3 as lost from labels l where (quality = 0 or doc_id % 8 = 3) and doc_id % 25 <> 0),
    j as (select coalesce(c.candidate_id, d.candidate_id) as candidate_id, c.candidate_id is not null as known, question_type, automatic, action, reason, types, lost from c full join d on c.candidate_id = d.candidate_id)"""


@query(f"""with {SQL_DECIDED} select candidate_id, case when action = 'replace' then 'excluded' when action = 'needs_pair' then 'cross' else 'single' end as route,
    case action when 'replace' then 'excluded' when 'needs_pair' then 'human_pairing_confirmed' when 'retype' then 'human_confirmed_retype' when 'approve' then 'human_confirmed' else 'auto_prescreened_pending' end as review_state,
    case when action = 'retype' then types when action is null or action = 'approve' then [question_type] end as approved_types, reason as human_reason, automatic,
    case when not known then 'decision on an unknown candidate' when action not in ('approve', 'retype', 'needs_pair', 'replace') then 'invalid action' when action = 'needs_pair' and lost then 'invalid partner sections'
         when question_type = 'cross_section' and coalesce(action, '') not in ('replace', 'needs_pair') then 'cross-section candidate without a pairing' when action = 'retype' and types is null then 'retype without approved types'
         when action is null and coalesce(automatic, '') <> 'approved' then 'recommendation needs a decision' end as problem from j""")
def review_decisions(spark, sf_dir):
    c, auto, said = _decided(spark, sf_dir)
    return review.apply_decisions(c, auto, said, sections(spark, sf_dir))


@query("""with s as (select 'r' || doc_id as replacement_id, 'c' || doc_id % 90 as replacement_for, doc_id from labels where doc_id % 2 = 0), sel as (select 'c' || doc_id % 90 as replaced_id, 'r' || case when doc_id % 14 = 0 then doc_id + 2 else doc_id end as selected_id, case when doc_id % 5 = 0 then [] else ['definition'] end as types, doc_id from labels where doc_id % 4 = 0 or doc_id % 7 = 0),
    j as (select sel.*, replacement_for, s.doc_id as d, count(*) over (partition by selected_id) as times from sel left join s on selected_id = replacement_id)
    select selected_id as candidate_id, replaced_id as replaces, case when replacement_for is null then 'unknown replacement' when times > 1 then 'replacement selected more than once' when replacement_for <> replaced_id then 'replacement of another candidate'
        when not exists (select 1 from documents o where o.doc_id = j.d) then 'replacement without section' when len(types) < 1 then 'replacement without approved types' end as problem from j""")
def merged_replacements(spark, sf_dir):
    d = table(spark, sf_dir, "labels")
    short = d.where("doc_id % 2 = 0").select(F.expr("concat('r', doc_id)").alias("replacement_id"), F.expr("concat('c', doc_id % 90)").alias("replacement_for"), F.expr(ref("doc_id")).alias("section"))
    sel = d.where("doc_id % 4 = 0 or doc_id % 7 = 0").select(F.expr("concat('c', doc_id % 90)").alias("replaced_id"), F.expr("concat('r', case when doc_id % 14 = 0 then doc_id + 2 else doc_id end)").alias("selected_id"), F.expr("case when doc_id % 5 = 0 then cast(array() as array<string>) else array('definition') end").alias("approved_types"))
    return review.merge_replacements(short, sel, sections(spark, sf_dir)).select("candidate_id", "replaces", "problem")


@query(f"with {SQL_DECIDED} select distinct candidate_id from d where action = 'replace' and candidate_id not in (select 'c' || doc_id from labels where doc_id % 4 = 0)")
def open_replacements(spark, sf_dir):
    done = table(spark, sf_dir, "labels").where("doc_id % 4 = 0").select(F.expr("concat('c', doc_id)").alias("replaced_id"))
    return review.still_to_replace(_decided(spark, sf_dir)[2], done)


@query("""with r as (select conv_id as question_id, ['auto_labeled', 'review_required', 'review_required', 'unmatched'][conv_id % 4 + 1] as status, list('s' || turn order by turn) as cands from conversations group by conv_id),
    l as (select conv_id as question_id, case when conv_id % 12 = 1 then [] when conv_id % 20 = 2 then ['none'] else ['s' || min(turn)] end as given from conversations where conv_id % 4 in (1, 2) and conv_id % 10 <> 5 or conv_id % 16 = 0 group by conv_id)
    select question_id, case status when 'auto_labeled' then 'auto_unique_exact' when 'review_required' then 'human_confirmed_equivalence' end as label_method, case status when 'auto_labeled' then cands when 'review_required' then given end as sections,
        case when given is not null and status <> 'review_required' then 'unexpected label' when status = 'review_required' and given is null then 'missing label' when status = 'unmatched' then 'cannot finalize this status'
             when status = 'review_required' and len(list_filter(given, lambda g: not list_contains(cands, g))) > 0 then 'label is no candidate' when status = 'review_required' and len(given) < 1 then 'no accepted section' end as problem from r left join l using (question_id)""")
def finalized_labels(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.expr("concat('s', turn)").alias("s"))))["s"].alias("candidates"), F.min("turn").alias("t"))
    records = g.select("question_id", F.expr("element_at(array('auto_labeled', 'review_required', 'review_required', 'unmatched'), cast(question_id % 4 + 1 as int))").alias("label_status"), "candidates")
    labels = g.where("question_id % 4 in (1, 2) and question_id % 10 <> 5 or question_id % 16 = 0")
    labels = labels.select("question_id", F.expr("case when question_id % 12 = 1 then cast(array() as array<string>) when question_id % 20 = 2 then array('none') else array(concat('s', t)) end").alias("sections"))
    return review.finalize_labels(records, labels)


def qa_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    said = "concat_ws(' ', lang, source, n_chars)"
    return d.select(
        F.col("doc_id").alias("position"), F.expr("concat('q', case when doc_id % 40 = 7 then doc_id - 1 else doc_id end)").alias("question_id"), F.expr("case when doc_id % 13 = 0 then 'held_out' else 'development' end").alias("split"),
        F.expr("case when doc_id % 4 = 0 then 'cross_section' else 'definition' end").alias("question_type"), F.expr("element_at(array('em_or_alias', 'contains_all', 'evidence_groups_and_contains', 'other'), cast(doc_id % 7 div 2 + 1 as int))").alias("policy"),
        F.expr(said).alias("expected_answer"), F.expr("case when doc_id % 17 = 0 then cast(array() as array<string>) else array('x') end").alias("aliases"), F.expr("array(source, case when doc_id % 6 = 1 then 'zzz' else lang end)").alias("terms"),
        F.expr("case when doc_id % 4 = 0 then case when doc_id % 20 = 0 then array(array('1.1'), cast(array() as array<string>)) when doc_id % 28 = 0 then null else array(array('1.1'), array('2.2', '3.3')) end end").alias("groups"),
        F.expr("case when doc_id % 4 <> 0 and doc_id % 9 <> 0 then array('1.1') end").alias("sections"),
    )


@query("""with r as (select doc_id as position, 'q' || case when doc_id % 40 = 7 then doc_id - 1 else doc_id end as question_id, doc_id % 4 = 0 as cross_, ['em_or_alias', 'contains_all', 'evidence_groups_and_contains', 'other'][doc_id % 7 // 2 + 1] as policy,
        lower(concat_ws(' ', lang, source, n_chars)) as answer, [source, case when doc_id % 6 = 1 then 'zzz' else lang end] as terms, doc_id from documents),
    e as (select *, row_number() over (partition by question_id order by position) as nth, list_filter([case when doc_id % 13 = 0 then 'split must be development' end, case when policy = 'other' then 'unsupported metric_policy' end, case when doc_id % 17 = 0 then 'acceptable_answers must be a non-empty list' end,
        case when cross_ and doc_id % 28 = 0 and doc_id % 20 <> 0 then 'cross_section records need required_evidence_groups' end, case when doc_id % 20 = 0 then 'required_evidence_groups must be non-empty lists' end,
        case when not cross_ and doc_id % 9 = 0 then 'single-section records need acceptable_sections' end], lambda x: x is not null) as errs from r),
    f as (select *, not list_bool_and(list_transform(terms, lambda t: contains(answer, lower(t)))) as failed from e)
    select question_id, position, case when nth > 1 then ['duplicate question_id'] when len(errs) > 0 then errs else ['expected_answer does not pass metric policy'] end as errors from f where nth > 1 or len(errs) > 0 or failed""")
def qa_validation(spark, sf_dir):
    return review.validate_records(qa_records(spark, sf_dir))


@query(f"""with d as (select doc_id, 'c' || lpad(doc_id::varchar, 7, '0') as candidate_id, case when doc_id % 5 = 0 then 'cross' else 'single' end as route from documents),
    n as (select *, row_number() over (order by route desc, candidate_id) as no from d)
    select case when no < 1000 then 'title12-dev-q' || lpad(no::varchar, 3, '0') else 'title12-dev-q' || no end as question_id, candidate_id, case when route = 'cross' then 'cross_section' when doc_id % 7 = 0 and doc_id % 11 <> 0 then 'obligation' else 'definition' end as question_type,
        case when route = 'cross' then [{SQL_REF('doc_id')}, {SQL_REF('doc_id + 1')}] else [{SQL_REF('doc_id')}] end as sections,
        case when doc_id % 11 = 0 then 'no draft' when route = 'single' and doc_id % 7 = 0 and doc_id % 2 = 0 then 'draft type is not approved' when route = 'cross' and doc_id + 1 > (select max(doc_id) from documents) then 'unknown section' end as problem from n where doc_id % 11 <> 0 or route = 'single'
    union all select case when no < 1000 then 'title12-dev-q' || lpad(no::varchar, 3, '0') else 'title12-dev-q' || no end, candidate_id, 'cross_section', null, 'no draft' from n where doc_id % 11 = 0 and route = 'cross'""")
def qa_assembly(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("candidate_id", F.expr("concat('c', lpad(cast(doc_id as string), 7, '0'))"))
    c = d.select("candidate_id", F.expr("case when doc_id % 5 = 0 then 'cross' else 'single' end").alias("route"), F.expr("case when doc_id % 5 = 0 then 'cross_section' else 'definition' end").alias("question_type"), F.expr("case when doc_id % 7 = 0 and doc_id % 2 = 1 then array('definition', 'obligation') when doc_id % 5 <> 0 then array('definition') end").alias("approved_types"), F.expr(ref("doc_id")).alias("section"))
    drafts = d.where("doc_id % 11 <> 0").select("candidate_id", F.expr("case when doc_id % 7 = 0 and doc_id % 5 <> 0 then 'obligation' end").alias("draft_type"), F.expr(f"array(array({ref('doc_id')}), array({ref('doc_id + 1')}))").alias("groups"))
    full = review.assemble_records(c, drafts, sections(spark, sf_dir))
    # A single record without a draft takes its own type; only the drafts say 'obligation'.
    return full.select("question_id", "candidate_id", "question_type", "sections", "problem")


# --- samples ---


#: The kinds of question that a section serves, from its heading and text in lower case.
SQL_KINDS = r"""list_filter([case when contains(h, 'applicability') or contains(h, 'scope') or contains(substr(t, 1, 1000), 'applies to') then 'applicability' end,
        case when starts_with(trim(regexp_replace(h, '^§\s*\S+\s*', '')), 'authority') or starts_with(t, 'authority.') or contains(substr(t, 1, 500), '(a) authority.') or contains(substr(t, 1, 500), 'this part is issued pursuant to') then 'authority' end,
        case when len(list_distinct(regexp_extract_all(t, '§+\s*([0-9]+[a-z]?(?:\.[0-9a-z-]+)+)', 1))) >= 2 then 'cross_section' end,
        case when contains(h, 'definition') or (length(t) <= 3000 and len(regexp_extract_all(t, '\bmeans\b')) >= 2) then 'definition' end,
        case when regexp_matches(t, '\b\d+(?:\.\d+)?\s*(?:%|percent|days?|months?|years?)\b') or regexp_matches(t, '\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}(?:,\s+\d{4})?\b') then 'numeric_or_date' end,
        case when len(regexp_extract_all(t, '\b(?:must|shall|required to|may not)\b')) >= 2 then 'obligation' end], lambda x: x is not null)"""
SQL_POOL = rf"""{SQL_TYPED}, lowered as (select *, lower(heading) as h, lower(text) as t, split_part(section, '.', 1) as part, case when length(text) <= 900 then 'short' when length(text) <= 3000 then 'medium' else 'long' end as bucket,
        sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) as hash from typed),
    kinds as (select *, unnest({SQL_KINDS}) as kind from lowered where doc_id % 7 <> 0),
    replaceable as (select *, trim(regexp_replace(h, '^§\s*\S+\s*', '')) as label from kinds where length(text) between 300 and 5000 and not contains(t, '[reserved]') and doc_id % 12 <> 0 and doc_id % 22 <> 0 and hash not in (select hash from lowered where doc_id % 30 = 1))"""
#: A greedy draw: each turn takes, of the rows of its kind (and length class, while it has any), the first by unused part, length class and key.
SQL_DRAW = """walk as (select 0::bigint as n, ''::varchar as kind, []::bigint[] as taken, []::varchar[] as parts, null::struct(used int, place int, key varchar, doc_id bigint, part varchar, section varchar, bucket varchar) as pick
        union all select n, kind, list_append(taken, pick.doc_id), list_append(parts, pick.part), pick from (
            select t.n, t.kind, w.taken, w.parts, coalesce(
                (select min({{'used': list_contains(w.parts, p.part)::int, 'place': 0, 'key': p.key, 'doc_id': p.doc_id, 'part': p.part, 'section': p.section, 'bucket': p.bucket}}) from pool p where p.kind = t.kind and p.bucket = t.bucket and not list_contains(w.taken, p.doc_id)),
                (select min({{'used': list_contains(w.parts, p.part)::int, 'place': list_position(['short', 'medium', 'long'], p.bucket)::int, 'key': p.key, 'doc_id': p.doc_id, 'part': p.part, 'section': p.section, 'bucket': p.bucket}}) from pool p where p.kind = t.kind and not list_contains(w.taken, p.doc_id))) as pick
            from (select n, kind, taken, parts from (select w0.n, w0.kind, w0.taken, case when {same} then w0.parts else [] end as parts from walk w0 left join turns t0 on t0.n = w0.n + 1)) w join turns t on t.n = w.n + 1))"""


@query(rf"""with recursive {SQL_POOL}, pool as (select doc_id, kind, bucket, part, section, sha256('7|' || kind || '|' || doc_id) as key from kinds where length(text) between 250 and 20000),
    turns as (select (k - 1) * 5 + i + 1 as n, ['authority', 'applicability', 'cross_section', 'definition', 'numeric_or_date', 'obligation'][k::int] as kind, ['short', 'medium', 'long'][(i % 3 + 1)::int] as bucket from range(1, 7) a(k), range(5) b(i)),
    {SQL_DRAW.format(same='t0.kind = w0.kind')}
    select n::int as candidate_no, kind as question_type, pick.doc_id as document_id, pick.part as part, pick.section as section, pick.bucket as length_bucket from walk where n > 0""")
def quota_sample(spark, sf_dir):
    return sampling.select_candidates(eval_sections(spark, sf_dir), {t: 5 for t in sampling.TYPE_ORDER}, 7)


def _replaceable(spark, sf_dir):
    s = eval_sections(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    return sampling.replaceable(s, documents=d.where("doc_id % 12 = 0").select(F.col("doc_id").alias("document_id")), taken=d.where("doc_id % 22 = 0").select(F.expr(ref("doc_id")).alias("section")), hashes=s.where("document_id % 30 = 1").select("text_hash").distinct())


@query(rf"""with {SQL_TYPED}, h as (select *, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) as hash from typed)
    select doc_id as document_id, section, trim(lower(case when length(heading) - length(replace(heading, ' ', '')) >= 2 then array_to_string(str_split(heading, ' ')[3:], ' ') else heading end)) as title from h
    where doc_id % 7 <> 0 and length(text) between 300 and 5000 and doc_id % 12 <> 0 and doc_id % 22 <> 0 and hash not in (select hash from h where doc_id % 30 = 1)""")
def replacement_pool(spark, sf_dir):
    return _replaceable(spark, sf_dir).select("document_id", "section", sampling.heading_title(F.col("heading")).alias("title"))


@query(rf"""with recursive {SQL_POOL}, strong as (select * from replaceable where case kind when 'applicability' then starts_with(label, 'applicability') or starts_with(label, 'scope') or contains(substr(t, 1, 700), 'applies to')
        when 'obligation' then true when 'definition' then contains(label, 'definition') and contains(' ' || t || ' ', ' means ') else false end),
    pool as (select doc_id, kind, '' as bucket, part, section, sha256('7|replacement-exp-006|' || kind || '|' || doc_id) as key from strong),
    turns as (select unnest([1, 2, 3, 4, 5])::bigint as n, unnest(['applicability', 'applicability', 'obligation', 'obligation', 'definition']) as kind, '' as bucket),
    {SQL_DRAW.format(same='true')}
    select n::int as replacement_no, kind as question_type, pick.doc_id as document_id, pick.part as part, pick.section as section from walk where n > 0""")
def replacement_sample(spark, sf_dir):
    return sampling.sample_replacements(_replaceable(spark, sf_dir), replacement_for="replacement-exp-006", seed=7)


@query(rf"""with {SQL_POOL}, wanted as (select 'title12-exp-001' as candidate_id, doc_id, section, kind from replaceable where kind = 'obligation'
        union all select 'title12-exp-002', doc_id, section, kind from replaceable where kind = 'numeric_or_date' and regexp_matches(t, '\b\d+(?:\.\d+)?\s*(?:percent|days?|months?|years?|calendar days?|business days?)\b')),
    ranked as (select *, row_number() over (partition by candidate_id order by sha256('7|deficit-replacement|' || candidate_id || '|' || kind || '|' || doc_id)) as place from wanted),
    first as (select * from ranked where candidate_id = 'title12-exp-001' and place <= 5),
    second as (select candidate_id, doc_id, section, kind, row_number() over (order by place) as place from ranked where candidate_id = 'title12-exp-002' and doc_id not in (select doc_id from first))
    select candidate_id, place::int as place, doc_id as document_id, section from (select candidate_id, doc_id, section, place from first union all select candidate_id, doc_id, section, place from second where place <= 5)""")
def deficit_shortlists(spark, sf_dir):
    kinds = [("title12-exp-001", "obligation"), ("title12-exp-002", "numeric_or_date")]
    return sampling.deficit_shortlists(_replaceable(spark, sf_dir), spark.createDataFrame(kinds, "candidate_id string, question_type string"), seed=7)


@query()
def review_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return sampling.review_sample(d.select(F.col("doc_id").alias("document_id"), "text", F.sha2(T.plain_lower(F.col("text")), 256).alias("text_hash"), F.expr("doc_id % 9 = 0").alias("truncated"), F.expr("doc_id % 50 = 3").alias("reserved"), F.expr("doc_id % 7 = 1").alias("suspicious_ending")))


@query("""with c as (select length(text) as value from documents where text is not null), o as (select value, row_number() over (order by value) as place, count(*) over () as n from c)
    select share, min(value) as value from o, (values (0.0), (0.25), (0.5), (0.9), (0.95), (1.0)) t(share) where place = round_even((n - 1) * share::double, 0) + 1 group by share""")
def length_percentiles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.length("text").alias("n"))
    return sampling.rounded_rank(d, "n", [0.0, 0.25, 0.5, 0.9, 0.95, 1.0])


SQL_SIDES = r"""official as (select doc_id, text from documents where doc_id % 2 = 0), legacy as (select doc_id, case doc_id % 6 when 0 then replace(text, ' ', '  ') when 1 then text || ' tail' when 2 then regexp_replace(text, '[.]$', '') when 3 then text || ' …(已截断)' else text end as text from documents)"""


def _sides(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    text = F.expr("case doc_id % 6 when 0 then replace(text, ' ', '  ') when 1 then concat(text, ' tail') when 2 then regexp_replace(text, '[.]$', '') when 3 then concat(text, ' …(已截断)') else text end")
    official = d.where("doc_id % 2 = 0").select(F.expr(ref("doc_id")).alias("section"), F.expr("concat('h', doc_id)").alias("heading"), "text")
    return official, d.select(F.col("doc_id").alias("legacy_id"), text.alias("text"))


_SQL_NORM = "trim(regexp_replace(lower(translate(nfc_normalize(text), '“”‘’—–−搂' || chr(160), '\"\"' || chr(39) || chr(39) || '---§ ')), '\\s+', ' ', 'g'))"
SQL_MARKED = rf"""{SQL_SIDES}, o as (select doc_id, text, {_SQL_NORM} as norm, to_json(regexp_extract_all({_SQL_NORM}, '[a-z0-9]+(?:[.''-][a-z0-9]+)*|§'))::varchar as toks from official where text is not null),
    g as (select doc_id, text, {_SQL_NORM} as norm, to_json(regexp_extract_all({_SQL_NORM}, '[a-z0-9]+(?:[.''-][a-z0-9]+)*|§'))::varchar as toks, count(*) over (partition by trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) as same from legacy where text is not null)"""


@query(rf"""with {SQL_MARKED} select doc_id as legacy_id, case when norm in (select norm from o) then 'exact_evidence_but_ambiguous_or_unassigned' when toks in (select toks from o) then 'token_equal_evidence_but_unassigned'
    when regexp_matches(text, '\s*…\(已截断\)$') then 'truncated_without_official_evidence' when same > 1 then 'duplicate_without_official_evidence' else 'no_official_evidence' end as class from g where doc_id % 3 <> 0""")
def legacy_audit(spark, sf_dir):
    official, legacy = _sides(spark, sf_dir)
    return sampling.audit_classes(official, legacy, legacy.where("legacy_id % 3 = 0"))


@query(rf"""with {SQL_MARKED}, e as (select norm, list(doc_id order by doc_id) as ids from g group by norm), t as (select toks, list(doc_id order by doc_id) as ids from g group by toks)
    select {SQL_REF('o.doc_id')} as section, coalesce(e.ids, []) as exact_candidates, coalesce(t.ids, []) as token_candidates, case when o.doc_id % 20 = 0 then 'section without alignment' end as problem from o left join e using (norm) left join t using (toks)""")
def alignment_audit(spark, sf_dir):
    official, legacy = _sides(spark, sf_dir)
    rows = table(spark, sf_dir, "documents").where("doc_id % 2 = 0 and doc_id % 20 <> 0 and text is not null").select(F.expr(ref("doc_id")).alias("section"), F.lit("exact").alias("status"), F.lit("normalized_text_equal").alias("reason"), F.col("doc_id").alias("legacy_id"))
    return corpus.audit_rows(rows, official, legacy).select("section", "exact_candidates", "token_candidates", "problem")


@query("""with k as (select doc_id, case when doc_id % 3 = 0 then 'r' || doc_id else doc_id::varchar end as row_id from documents) select row_id, row_number() over (partition by doc_id % 10 order by try_cast(row_id as bigint) nulls last, row_id) as place from k""")
def mixed_row_order(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("g"), F.expr("case when doc_id % 3 = 0 then concat('r', doc_id) else cast(doc_id as string) end").alias("row_id"))
    return d.select("row_id", F.row_number().over(Window.partitionBy("g").orderBy(*sampling.row_order(F.col("row_id")))).alias("place"))


@query("""select doc_id, concat_ws(' ', case when doc_id % 2 = 0 then '1.' || doc_id end, nullif(source, ''), lang, coalesce(nullif(case when doc_id % 3 = 0 then '' else text end, ''), 'chunk ' || doc_id)) as item,
    case when doc_id % 3 = 0 then '' else coalesce(text, 'chunk ' || doc_id) end as body, case when doc_id % 5 = 0 then 'missing chunk' when doc_id % 7 = 0 then 'chunk_id is no number' end as issue from documents where doc_id % 4 <> 3""")
def lexical_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("*", F.expr("case when doc_id % 3 = 0 then '' else text end").alias("t"), F.expr("concat('chunk ', doc_id)").alias("c"))
    d = d.withColumns({"source_file": F.expr("case when doc_id % 4 = 3 then 'other' else 'a' end"), "row_id": F.col("doc_id"), "chunk_id": F.expr("case when doc_id % 7 = 0 then 'x' else '1' end"), "chunk": F.expr("case when doc_id % 5 <> 0 then 'c' end")})
    d = corpus.split_records(d, "a")
    item = T.item_text(F.expr("case when doc_id % 2 = 0 then concat('1.', doc_id) end"), F.col("source"), F.col("lang"), F.lit(None), F.col("t"), F.col("c"))
    return d.select("doc_id", item.alias("item"), T.item_body(F.col("t"), F.col("c")).alias("body"), "issue")


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by sha256('20250901|' || doc_id)) as n from documents) where n <= 3")
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    names = [r.source for r in d.select("source").distinct().collect()]
    return sampling.stratified(d, {n: 3 for n in names if n is not None}, by="source", key="doc_id", seed="20250901").select("source", "doc_id")
