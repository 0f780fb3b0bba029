"""Registered queries of nested payloads, annotations and the judge's second pass."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeflow.functions import text as T
from citeflow.operators import agent, evaluation, payloads, retrieval
from citeflow.operators.tables import new_folder, stored
from citeflow.plans.queries import SQL_BM25, SQL_CONTEXT, SQL_EVAL, SQL_REF, SQL_SECTIONS, VERSION, context_rows, gold, query, questions, ref, sections, table
from citeflow.sources import readers

SQL_PAYLOADS = f"""{SQL_EVAL}, shown as (select qid, list(c.section order by c.rank) as top_sections, list(c.section || ':' || source order by c.rank) as labels, list(substr(s.text, 1, 260) order by c.rank) as previews
        from context c join sections s on s.section = c.section where c.rank <= 10 group by qid)"""


def _payloads(spark, sf_dir):
    asked = gold(spark, sf_dir).join(questions(spark, sf_dir).withColumnRenamed("qid", "question_id"), "question_id").withColumn("question_type", F.when(F.col("question_type") == "cross_section", "cross_section"))
    texts = sections(spark, sf_dir).select("section", "text", "source_url")
    hits = context_rows(spark, sf_dir).withColumnsRenamed({"qid": "question_id", "source": "retrieval_source"}).join(texts, "section")
    return payloads.question_payloads(asked, hits)


@query(f"""with {SQL_PAYLOADS} select question_id, question_type, complete_rank as first_complete_rank, round(recall_at_10, 6) as recall_at_10, coalesce(top_sections, []) as top_sections, coalesce(labels, []) as labels, coalesce(previews, []) as previews
    from per left join shown on shown.qid = question_id""")
def question_payloads(spark, sf_dir):
    p = _payloads(spark, sf_dir)
    labels = F.transform("top_hits", lambda h: F.concat(h["section"], F.lit(":"), h["retrieval_source"]))
    return p.select("question_id", "question_type", "first_complete_rank", F.round("recall_at_10", 6).alias("recall_at_10"), F.col("top_hits")["section"].alias("top_sections"), labels.alias("labels"), F.col("top_hits")["text_preview"].alias("previews"))


@query(f"""with {SQL_PAYLOADS}, f as (select min(qid) as lo, max(qid) as hi from questions) select question_id, complete_rank as first_complete_rank, round(recall_at_10, 6) as recall_at_10, coalesce(top_sections, []) as top_sections, coalesce(labels, []) as labels
    from per left join shown on shown.qid = question_id join f on question_id in (lo, hi)""")
def focus_questions(spark, sf_dir):
    """The first and the last question, as a report on two of them shows it."""
    ends = questions(spark, sf_dir).agg(F.min("qid"), F.max("qid")).first()
    return payloads.focus(_payloads(spark, sf_dir), sorted(set(ends))).withColumn("recall_at_10", F.round("recall_at_10", 6))


@query("""with a as (select doc_id as question_id, case doc_id % 3 when 0 then 'em_or_alias' when 1 then 'contains_all' else 'evidence_groups_and_contains' end as metric_policy, [lang, upper(lang)] as acceptable_answers, case when doc_id % 2 = 0 then [source] else [] end as must_contain from documents)
    select question_id, metric_policy, acceptable_answers, must_contain, count(*) over (partition by metric_policy) as policy_count from a""")
def annotated_records(spark, sf_dir):
    """All documents as records, annotated; the counts by policy come from the pass that annotates."""
    d = table(spark, sf_dir, "documents")
    records = d.select(F.col("doc_id").alias("question_id"), F.lit("old").alias("metric_policy"))
    policy = F.expr("case doc_id % 3 when 0 then 'em_or_alias' when 1 then 'contains_all' else 'evidence_groups_and_contains' end")
    said = d.select(F.col("doc_id").alias("question_id"), policy.alias("metric_policy"), F.array("lang", F.upper("lang")).alias("acceptable_answers"), F.expr("case when doc_id % 2 = 0 then array(source) else cast(array() as array<string>) end").alias("must_contain"))
    rows, counts = payloads.annotate(records, said)
    number = F.create_map(*[F.lit(x) for p, n in counts.items() for x in (p, n)])
    return rows.withColumn("policy_count", number[F.col("metric_policy")].cast("long"))


@query(f"""select doc_id, case when doc_id % 3 = 0 then [{SQL_REF('doc_id')}] when doc_id % 3 = 1 then [{SQL_REF('doc_id + 1')}] else [] end as expected_sections from documents""")
def questions_to_ask(spark, sf_dir):
    no = "cast(array() as array<string>)"
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("question_id"), F.col("text").alias("question"),
        F.expr(f"case when doc_id % 3 = 0 then array({ref('doc_id')}) when doc_id % 2 = 0 then {no} end").alias("expected_sections"),
        F.expr(f"case when doc_id % 3 <> 2 then array({ref('doc_id + 1')}) end").alias("acceptable_sections"),
    )
    return payloads.questions_to_ask(d).select(F.col("question_id").alias("doc_id"), "expected_sections")


def _model(prompts: list[str]) -> list[str]:
    """A judge that answers in prose for two ids of five, and repairs one of these two when it is asked to."""
    out = []
    for p in prompts:
        number = int(re.search(r"case (\d+)", p)[1])
        scores = {"answer_relevance": 1 + number % 5, "faithfulness": 2, "citation_support": 3, "legal_caution": 4, "overall": 5, "pass": number % 2 == 0, "issues": []}
        prose = number % 5 == 0 if p.startswith("Write") else number % 5 < 2
        out.append(f"I judge case {number} as fine." if prose else json.dumps(scores))
    return out


@query("""select doc_id, case when doc_id % 5 = 0 then null else (1 + doc_id % 5)::int end as answer_relevance, case when doc_id % 5 = 0 then null else doc_id % 2 = 0 end as passed, case when doc_id % 5 < 2 then 2 else 1 end::int as attempts from labels""")
def judge_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("Judge case "), "doc_id").alias("prompt"))
    return payloads.judged(rows, _model).select("doc_id", "scores.answer_relevance", "scores.passed", "attempts")


SQL_RUNS = f"""{SQL_CONTEXT}, fetch0 as (select * from (select qid, section, source, row_number() over (partition by qid order by (source <> 'semantic') desc, rank, section) as fetch_rank from context where rank <= 10) where fetch_rank = 1 and source <> 'semantic'),
    checked as (select f.qid, section, version_date = '2025-09-01' and source_url = 'https://www.ecfr.gov/on/' || version_date || '/title-12/section-' || section and safe_for_citation as ok from fetch0 f join sections using (section)),
    steps as (select qid, 0 as phase, 'search_regulations' as action, 'completed' as status, null as section from questions
        union all select qid, 1, 'fetch_section', 'completed', section from fetch0
        union all select qid, 2, 'verify_citation', case when ok then 'completed' else 'failed' end, section from checked
        union all select c.qid, 3, 'final_answer', case when bool_or(coalesce(ok, false)) or (count(k.qid) = 0 and count(*) > 0) then 'completed' else 'insufficient_evidence' end, null from context c left join checked k on k.qid = c.qid group by c.qid),
    numbered as (select *, row_number() over (partition by qid order by phase) as step_number from steps)"""


def _runs(spark, sf_dir, max_steps=3):
    """Runs that may fetch nothing but do fetch a cited section, and so can exceed their steps."""
    evidence = context_rows(spark, sf_dir)
    fetched = stored(agent.sections_to_fetch(evidence, 0), "fetched")
    checked = stored(agent.verify(fetched, sections(spark, sf_dir), version=VERSION), "checked")
    answers = agent.final_answers(questions(spark, sf_dir), evidence, fetched, checked)
    steps = agent.run_steps(questions(spark, sf_dir), evidence, fetched, checked, answers, max_steps=max_steps, most=0).checkpoint()
    return evidence, steps, agent.limited_answers(answers, evidence, steps)


@query(f"with {SQL_RUNS} select qid, step_number, action, status, section from numbered where step_number <= 3")
def agent_steps(spark, sf_dir):
    return _runs(spark, sf_dir)[1]


@query(f"""with {SQL_RUNS}, r as (select qid, least(count(*), 3) as steps, count(*) > 3 as over, max(case when action = 'final_answer' then status end) as ended from numbered group by qid),
    t as (select qid, steps, case when over then 'max_steps_exceeded' when ended is null then 'insufficient_evidence' else ended end as termination from r)
    select count(*) as runs, round(avg((termination = 'completed')::int), 6) as completed_rate, round(avg((termination = 'max_steps_exceeded')::int), 6) as exceeded_rate, round(avg(steps), 6) as avg_steps from t""")
def agent_rates(spark, sf_dir):
    """How runs end, and how many steps they take."""
    rows = _runs(spark, sf_dir)[2].select((F.col("termination") == "completed").alias("completed"), (F.col("termination") == "max_steps_exceeded").alias("exceeded"), "steps")
    return evaluation.process_rates(rows, ["completed", "exceeded"])


SQL_ABLATION = f"""{SQL_SECTIONS}, gold as (select qid as question_id, case when qid % 3 = 0 then 'cross_section' else 'single_section' end as question_type,
        case when qid % 3 = 0 then [[{SQL_REF('qid * 4')}], [{SQL_REF('qid * 4 + 1')}, {SQL_REF('qid * 4 + 2')}]] else [[{SQL_REF('qid * 4')}, {SQL_REF('qid + 1')}]] end as groups from questions),
    g as (select question_id, question_type, unnest(groups) as secs, generate_subscripts(groups, 1) as no from gold),
    named as (select question_id, list(heading order by no, turn) as headings from (select question_id, no, turn, heading from (select question_id, no, unnest(secs) as section, generate_subscripts(secs, 1) as turn from g) join sections using (section)) group by question_id),
    asked0 as (select qid || ':baseline' as qid, question from questions
        union all select qid || ':query_with_heading', question || coalesce(chr(10) || 'Relevant section heading: ' || array_to_string(list_filter(headings, lambda v, i: list_position(headings, v) = i), '; '), '') from questions left join named on question_id = qid),
    {SQL_BM25},
    plain as (select split_part(qid, ':', 2) as variant, split_part(qid, ':', 1)::bigint as question_id, rank, section from bm join sections s on bm.doc = s.doc_id where rank <= 10),
    mets as (select variant, g.question_id, g.no, p.rank from g join plain p on p.question_id = g.question_id and list_contains(g.secs, p.section) where g.question_type = 'cross_section'),
    adds as (select f.variant, g.question_id, f.after as rank, g.no as turn, g.secs[1] as section from g join (select variant, question_id, min(rank) as after from mets group by all) f using (question_id)
        where not exists (select 1 from mets m where m.variant = f.variant and m.question_id = g.question_id and m.no = g.no)),
    more as (select case variant when 'baseline' then 'cross_reference_expansion' else 'combined' end as variant, question_id, section, row_number() over (partition by variant, question_id order by rank, turn) as rank
        from (select variant, question_id, rank, 0 as turn, section from plain union all select * from adds)),
    every as (select variant, question_id, section, rank from plain union all select variant, question_id, section, rank from more),
    names as (select unnest(['baseline', 'query_with_heading', 'cross_reference_expansion', 'combined']) as variant),
    gr as (select n.variant, g.question_id, g.no, min(e.rank) as first from names n cross join g left join every e on e.variant = n.variant and e.question_id = g.question_id and list_contains(g.secs, e.section) group by all),
    per as (select variant, question_id, case when count(first) = count(*) then max(first) end as complete_rank, sum(case when first <= 10 then 1 else 0 end) / count(*) as recall_at_10 from gr group by all)"""


@query(f"""with {SQL_ABLATION} select variant, count(*) as questions, round(avg(case when complete_rank <= 1 then 1.0 else 0 end), 6) as hit_at_1, round(avg(case when complete_rank <= 10 then 1.0 else 0 end), 6) as hit_at_10,
    round(avg(recall_at_10), 6) as recall_at_10, round(avg(case when complete_rank <= 10 then 1.0 / complete_rank else 0 end), 6) as mrr from per group by variant""")
def ablation_variants(spark, sf_dir):
    """The four variants of the ablation: with and without headings in the query, with and without expansion."""
    g, asked = gold(spark, sf_dir), questions(spark, sf_dir)
    heads = g.select("question_id", F.posexplode("groups").alias("no", "g")).select("question_id", "no", F.posexplode("g").alias("turn", "section"))
    heads = heads.join(sections(spark, sf_dir).select("section", "heading"), "section").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("no", "turn", "heading")))["heading"].alias("headings"))
    named = asked.join(heads, F.col("qid") == F.col("question_id"), "left").select("qid", T.query_text(F.col("question"), F.col("headings")).alias("question"))
    tagged = lambda d, name: d.select(F.concat(F.col("qid").cast("string"), F.lit(f":{name}")).alias("qid"), "question")
    hits = retrieval.bm25(table(spark, sf_dir, "documents"), tagged(asked, "baseline").unionByName(tagged(named, "query_with_heading")))
    found = hits.join(sections(spark, sf_dir).select(F.col("doc_id").alias("doc"), "section"), "doc")
    found = found.select(F.split_part("qid", F.lit(":"), F.lit(2)).alias("variant"), F.split_part("qid", F.lit(":"), F.lit(1)).cast("long").alias("question_id"), "rank", "section").checkpoint()
    rows = found
    for name, more in (("baseline", "cross_reference_expansion"), ("query_with_heading", "combined")):
        expanded = evaluation.gold_expansion(g, found.where(F.col("variant") == name).drop("variant"))
        rows = rows.unionByName(expanded.select(F.lit(more).alias("variant"), "question_id", "rank", "section"))
    return evaluation.by_variant(g, rows).select("variant", "questions", "hit_at_1", "hit_at_10", "recall_at_10", "mrr")


@query(f"""with {SQL_EVAL} select per.question_id, c.rank, c.section, c.source as retrieval_source, substr(s.text, 1, 260) as text_preview, coalesce(c.rank >= complete_rank, false) as is_complete_hit_at_rank
    from per join context c on c.qid = per.question_id and c.rank <= 10 join sections s on s.section = c.section""")
def saved_rankings(spark, sf_dir):
    texts = sections(spark, sf_dir).select("section", "text")
    hits = context_rows(spark, sf_dir).withColumnsRenamed({"qid": "question_id", "source": "retrieval_source"}).join(texts, "section")
    return payloads.ranking_rows(gold(spark, sf_dir), hits).select("question_id", "rank", "section", "retrieval_source", "text_preview", "is_complete_hit_at_rank")


@query(f"""with asked0 as (select item_id as qid, text as question from benchmark), {SQL_BM25} select qid, rank, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as text,
        '{{"section":"' || {SQL_REF('doc_id')} || '"' || case when doc_id % 4 = 0 then '' else ',"heading":"' || source || '"' end || ',"title":12,"retrieval_source":"lexical"}}' as metadata
    from bm join documents on doc = doc_id where rank <= 10 and doc_id % 5 <> 0""")
def search_hits(spark, sf_dir):
    """Lexical hits with their items' text and those of their fields that are there; blank items are no hits."""
    d = table(spark, sf_dir, "documents").where("source is not null")
    items = d.select(F.col("doc_id").alias("item"), F.expr("case when doc_id % 5 = 0 then ' ' else text end").alias("text"), F.expr(ref("doc_id")).alias("section"), F.expr("case when doc_id % 4 <> 0 then source end").alias("heading"), F.lit(12).alias("title"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    found = retrieval.bm25(table(spark, sf_dir, "documents"), asked).withColumnRenamed("doc", "item")
    return payloads.hits_from_items(found, items, ["section", "heading", "title", "absent"], source="lexical").select("qid", "rank", "text", "metadata")


@query(f"""with {SQL_SECTIONS}, u as (select doc_id, section, heading, case when doc_id % 2 = 0 then version_date end as version_date, case when doc_id % 3 = 0 then 'development' else 'test' end as split from sections)
    select doc_id, section, heading, version_date, lower(section) as section_key from u where split = 'development'""")
def json_sections(spark, sf_dir):
    """Sections as JSON lines of two files with different columns and as an array inside a document, read back with
    unique keys, as one table, the development split alone."""
    s = sections(spark, sf_dir).withColumn("split", F.expr("case when doc_id % 3 = 0 then 'development' else 'test' end"))
    wide, narrow = new_folder(spark, "wide"), new_folder(spark, "narrow")
    fields = ["doc_id", "section", "heading", "split"]
    readers.write_json_rows(s.where("doc_id % 2 = 0").select(*fields, "version_date"), wide)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("file")
    s.where("doc_id % 2 = 1").groupBy(block).agg(F.collect_list(F.struct(*fields)).alias("records")).write.partitionBy("file").json(narrow)
    kinds = StructType.fromDDL("doc_id long, section string, heading string, split string, version_date string")
    arrays = spark.read.option("recursiveFileLookup", True).schema("records array<struct<doc_id:bigint,section:string,heading:string,split:string>>").json(narrow).select(F.inline("records"))
    both = readers.union_files([readers.read_sections(spark, wide, kinds), arrays.withColumn("section_key", T.section_key(F.col("section")))])
    return readers.prefer_split(both).select("doc_id", "section", "heading", "version_date", "section_key")
