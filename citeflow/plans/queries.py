"""Registered queries over the supplied tables, with the SQL that checks them.

Documents stand in for sections: their section number, heading, version and citing sentence are derived
from the row alone, alike in Spark and SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.functions import text as T
from citeflow.operators import agent, corpus, evaluation, families, retrieval
from citeflow.operators.tables import stored

VERSION = "2025-09-01"
SECTION = "concat(cast(doc_id div 50 + 1 as string), '.', cast(doc_id as string))"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref(n: str) -> str:
    return f"concat(cast(({n}) div 50 + 1 as string), '.', cast(({n}) as string))"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.expr(SECTION).alias("section"),
        F.expr(f"concat('§ ', {SECTION}, ' ', source)").alias("heading"),
        F.expr(f"concat(text, ' See § ', {ref('doc_id + 1')}, '(a)(1), and 12 CFR ', {ref('doc_id * 3 + 2')}, '.')").alias("text"),
        F.expr("case when doc_id % 7 = 0 then '2024-01-01' else '2025-09-01' end").alias("version_date"),
        F.expr(f"concat('https://www.ecfr.gov/on/2025-09-01/title-12/section-', {SECTION})").alias("source_url"),
        F.expr("doc_id % 5 <> 0").alias("safe_for_citation"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select(F.col("doc_id").alias("item"), "section", F.concat("section", F.lit(":chunk-0001")).alias("chunk_id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.expr(f"concat(text, case when item_id % 2 = 0 then concat(' 12 CFR ', {ref('item_id * 4')}, ' and § ', {ref('item_id * 4 + 3')}) else '' end)").alias("question"))


SQL_REF = lambda n: f"(({n}) // 50 + 1) || '.' || ({n})"
SQL_SECTIONS = f"""
    sections as (
        select doc_id, {SQL_REF('doc_id')} as section, '§ ' || {SQL_REF('doc_id')} || ' ' || source as heading,
               text || ' See § ' || {SQL_REF('doc_id + 1')} || '(a)(1), and 12 CFR ' || {SQL_REF('doc_id * 3 + 2')} || '.' as text,
               case when doc_id % 7 = 0 then '2024-01-01' else '2025-09-01' end as version_date,
               'https://www.ecfr.gov/on/2025-09-01/title-12/section-' || {SQL_REF('doc_id')} as source_url,
               doc_id % 5 <> 0 as safe_for_citation
        from documents
    ), questions as (
        select item_id as qid, text || case when item_id % 2 = 0
               then ' 12 CFR ' || {SQL_REF('item_id * 4')} || ' and § ' || {SQL_REF('item_id * 4 + 3')} else '' end as question
        from benchmark
    )"""
SQL_TOKENS = r"regexp_extract_all({}, '[a-z0-9]+(?:\.[a-z0-9-]+)*')"
SQL_BM25 = f"""
    toks as (select doc_id as doc, {SQL_TOKENS.format('lower(text)')} as t from documents),
    lens as (select doc, len(t) as doc_len from toks),
    whole as (select count(*) as n, avg(doc_len) as avg_len from lens),
    post as (select term, doc, count(*) as tf from (select doc, unnest(t) as term from toks) group by all),
    dfs as (select term, count(*) as df from post group by term),
    asked as (select qid, term, count(*) as times from (select qid, unnest({SQL_TOKENS.format('lower(question)')}) as term from asked0) group by all),
    scored as (
        select qid, post.doc, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))) as score
        from asked join dfs using (term) join post using (term) join lens on lens.doc = post.doc cross join whole
        group by qid, post.doc
    ), bm as (
        select qid, doc, score, row_number() over (partition by qid order by round(score, 9) desc, doc) as rank from scored
    )"""


@query(f"with asked0 as (select item_id as qid, text as question from benchmark), {SQL_BM25} select qid, rank, doc, round(score, 6) as score from bm where rank <= 10")
def bm25_topk(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return retrieval.bm25(table(spark, sf_dir, "documents"), asked).select("qid", "rank", "doc", F.round("score", 6).alias("score"))


@query(f"with toks as (select doc_id, {SQL_TOKENS.format('lower(text)')} as t from documents) select term, count(distinct doc_id) as df, count(*) as cf from (select doc_id, unnest(t) as term from toks) group by term")
def bm25_df_stats(spark, sf_dir):
    _, postings = retrieval.term_statistics(table(spark, sf_dir, "documents"))
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


SQL_DENSE = """
    sims as (
        select q.vec_id as qid, v.vec_id as doc, q.label as ql, v.label as vl, list_dot_product(q.embedding::double[], v.embedding::double[]) as score
        from embeddings q, embeddings v where q.vec_id % 50 = 0
    ), dn as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc) as rank from sims)"""


def _dense(spark, sf_dir, k=10):
    v = table(spark, sf_dir, "embeddings")
    return retrieval.dense(v, v.where("vec_id % 50 = 0"), k=k)


@query(f"with {SQL_DENSE} select qid, rank, doc, round(score, 6) as score from dn where rank <= 10")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir).select("qid", "rank", "doc", F.round("score", 6).alias("score"))


@query(f"""with {SQL_DENSE}, f as (select qid, min(rank) filter (where vl = ql and doc <> qid) as first from dn where rank <= 10 group by qid)
    select count(*) as questions, round(avg(case when first <= 1 then 1.0 else 0 end), 6) as hit_at_1, round(avg(case when first <= 5 then 1.0 else 0 end), 6) as hit_at_5,
           round(avg(case when first <= 10 then 1.0 else 0 end), 6) as hit_at_10, round(avg(coalesce(1.0 / first, 0)), 6) as mrr from f""")
def dense_eval_hit_mrr(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    r = _dense(spark, sf_dir).join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid").join(labels.select(F.col("vec_id").alias("doc"), F.col("label").alias("vl")), "doc")
    first = r.groupBy("qid").agg(F.min(F.when((F.col("ql") == F.col("vl")) & (F.col("doc") != F.col("qid")), F.col("rank"))).alias("first"))
    hit = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_at_{k}")
    return first.agg(F.count(F.lit(1)).alias("questions"), hit(1), hit(5), hit(10), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query(f"""with {SQL_SECTIONS} select doc_id, list_distinct_ordered as refs from (select doc_id, list_filter(x, lambda v, i: list_position(x, v) = i) as list_distinct_ordered
    from (select doc_id, regexp_extract_all(lower(text), '(?:12\\s+cfr\\s+|§+\\s*)([0-9]+[a-z]?(?:\\.[0-9a-z-]+)+)', 1) as x from sections))""")
def citation_extract(spark, sf_dir):
    return sections(spark, sf_dir).select("doc_id", T.section_references(F.col("text")).alias("refs"))


SQL_EXPLICIT = r"""
    refs as (select qid, unnest(x) as key, generate_subscripts(x, 1) - 1 as ref_pos from (
        select qid, regexp_extract_all(lower(question), '(?:12\s+cfr\s+|§+\s*)([0-9]+[a-z]?(?:\.[0-9a-z-]+)+)', 1) as x from questions)),
    explicit as (select qid, min(ref_pos) as ref_pos, section, any_value(text) as text from refs join sections on key = section group by qid, section)"""


@query(f"with {SQL_SECTIONS}, {SQL_EXPLICIT} select qid, ref_pos, section from explicit")
def explicit_hits(spark, sf_dir):
    return retrieval.explicit_hits(questions(spark, sf_dir), chunks(spark, sf_dir)).select("qid", F.col("ref_pos").cast("long").alias("ref_pos"), "section")


def _lexical(spark, sf_dir):
    """The ten best documents of each question, written once."""
    return retrieval.bm25(table(spark, sf_dir, "documents"), questions(spark, sf_dir))


def _semantic(spark, sf_dir, hits=None):
    hits = (_lexical(spark, sf_dir) if hits is None else hits).where("rank <= 5")
    found = hits.join(sections(spark, sf_dir).select(F.col("doc_id").alias("doc"), "section", "text"), "doc").select("qid", "rank", "section", F.concat("section", F.lit(":chunk-0001")).alias("chunk_id"), "text")
    return stored(found, "semantic")


SQL_CONTEXT = f"""{SQL_SECTIONS}, asked0 as (select * from questions), {SQL_BM25}, {SQL_EXPLICIT},
    semantic as (select qid, rank, section, s.text from bm join sections s on bm.doc = s.doc_id where rank <= 5),
    xrefs as (select qid, ref_pos, unnest(x) as key, generate_subscripts(x, 1) as in_text from (
        select qid, ref_pos, regexp_extract_all(lower(text), '(?:12\\s+cfr\\s+|§+\\s*)([0-9]+[a-z]?(?:\\.[0-9a-z-]+)+)', 1) as x from explicit)),
    fresh as (select qid, key, min(ref_pos * 100000 + in_text) as pos from xrefs x
        where not exists (select 1 from refs r where r.qid = x.qid and r.key = x.key) and not exists (select 1 from semantic s where s.qid = x.qid and s.section = x.key)
        group by qid, key),
    taken as (select * from (select *, row_number() over (partition by qid order by pos, key) as n from fresh) where n <= 5),
    hits as (
        select qid, 0 as tier, ref_pos as a, section, 'explicit_citation' as source from explicit
        union all select qid, 1, n, section, 'cross_reference' from taken join sections on key = section
        union all select qid, 2, rank, section, 'semantic' from semantic),
    firsts as (select * from (select *, row_number() over (partition by qid, section order by tier, a) as c from hits) where c = 1),
    context as (select qid, row_number() over (partition by qid order by tier, a) as rank, section, source from firsts)"""


@query(f"with {SQL_CONTEXT} select qid, rank, section, source from context where rank <= 10")
def context_search(spark, sf_dir):
    found = retrieval.context_search(questions(spark, sf_dir), chunks(spark, sf_dir), _semantic(spark, sf_dir))
    return found.select("qid", "rank", "section", "source")


@query(f"with {SQL_CONTEXT} select qid, n as ref_pos, section from taken join sections on key = section")
def cross_ref_expand(spark, sf_dir):
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir)
    found = retrieval.cross_references(q, retrieval.explicit_hits(q, c), _semantic(spark, sf_dir), c)
    return found.select("qid", F.col("ref_pos").cast("long").alias("ref_pos"), "section")


@query(f"""with {SQL_CONTEXT}, lists as (
        select qid, 0 as list_no, rank, section, source from context where rank <= 10
        union all select qid, 1, rank, section, 'lexical' from bm join sections s on bm.doc = s.doc_id where rank <= 10),
    fused as (select qid, section, sum(1.0 / (60 + rank)) as score, min(case source when 'explicit_citation' then 0 when 'cross_reference' then 1 else 2 end) as level, min(rank) as first from lists group by qid, section),
    ranked as (select *, row_number() over (partition by qid order by level, round(score, 12) desc, first, section) as rank from fused)
    select qid, rank, section as doc, round(score, 9) as score from ranked where rank <= 10""")
def rrf_hybrid(spark, sf_dir):
    hits = _lexical(spark, sf_dir)
    context = context_rows(spark, sf_dir, hits).select("qid", F.lit(0).alias("list_no"), "rank", F.col("section").alias("doc"), "source")
    lexical = hits.join(sections(spark, sf_dir).select(F.col("doc_id").alias("doc"), "section"), "doc")
    lexical = lexical.select("qid", F.lit(1).alias("list_no"), "rank", F.col("section").alias("doc"), F.lit("lexical").alias("source"))
    return retrieval.fuse(context.unionByName(lexical)).select("qid", "rank", "doc", F.round("score", 9).alias("score"))


def context_rows(spark, sf_dir, hits=None):
    return stored(retrieval.context_search(questions(spark, sf_dir), chunks(spark, sf_dir), _semantic(spark, sf_dir, hits)), "context")


SQL_FETCH = f"""{SQL_CONTEXT}, fetched as (
        select * from (select qid, section, row_number() over (partition by qid order by (source <> 'semantic') desc, rank, section) as fetch_rank from context where rank <= 10) where fetch_rank <= 2),
    verified as (select f.*, version_date, version_date = '2025-09-01' as v, source_url = 'https://www.ecfr.gov/on/' || version_date || '/title-12/section-' || section as u, safe_for_citation as s
        from fetched f join sections using (section))"""


@query(f"with {SQL_FETCH} select qid, section, v and u and s as verified, list_filter([case when not v then 'version_matches' end, case when not u then 'source_url_matches' end, case when not s then 'safe_for_citation' end], lambda x: x is not null) as issues from verified")
def verify_citation(spark, sf_dir):
    fetched = agent.sections_to_fetch(context_rows(spark, sf_dir))
    return agent.verify(fetched, sections(spark, sf_dir), version=VERSION).select("qid", "section", "verified", "issues")


@query(f"""with {SQL_FETCH}, c as (select qid, string_agg('12 CFR ' || section || ' (' || version_date || ')', ', ' order by fetch_rank) as cs from verified where v and u and s group by qid)
    select questions.qid, case when cs is null and not exists (select 1 from context c where c.qid = questions.qid) then 'Insufficient information in the provided evidence.' when cs is null then 'Insufficient information in the verified evidence.' else 'Relevant evidence was found in ' || cs || '. Use the cited fixed-snapshot sections to answer the question.' end as answer,
           case when cs is null then 'insufficient_evidence' else 'completed' end as termination from questions left join c using (qid)""")
def answer_batch(spark, sf_dir):
    evidence, fetched, checked = answered(spark, sf_dir)
    return agent.final_answers(questions(spark, sf_dir), evidence, fetched, checked).select("qid", "answer", "termination")


def answered(spark, sf_dir):
    """Evidence, fetched sections and their checks; written once, as each is read several times."""
    evidence = context_rows(spark, sf_dir)
    fetched = stored(agent.sections_to_fetch(evidence), "fetched")
    return evidence, fetched, stored(agent.verify(fetched, sections(spark, sf_dir), version=VERSION), "checked")


SQL_EVAL = f"""{SQL_CONTEXT}, gold as (
        select qid as question_id, case when qid % 3 = 0 then 'cross_section' else 'single_section' end as question_type,
               case when qid % 3 = 0 then [[{SQL_REF('qid * 4')}], [{SQL_REF('qid * 4 + 1')}, {SQL_REF('qid * 4 + 2')}]] else [[{SQL_REF('qid * 4')}, {SQL_REF('qid + 1')}]] end as groups from questions),
    g as (select question_id, question_type, unnest(groups) as secs, generate_subscripts(groups, 1) as no from gold),
    gr as (select g.question_id, g.question_type, g.no, min(rank) as first from g left join context c on c.qid = g.question_id and list_contains(g.secs, c.section) and c.rank <= 10 group by all),
    per as (select question_id, question_type, case when count(first) = count(*) then max(first) end as complete_rank, sum(case when first <= 1 then 1 else 0 end) / count(*) as recall_at_1,
            sum(case when first <= 5 then 1 else 0 end) / count(*) as recall_at_5, sum(case when first <= 10 then 1 else 0 end) / count(*) as recall_at_10, count(first) as found, count(*) as n from gr group by all)"""


def gold(spark, sf_dir):
    g = F.expr(f"case when qid % 3 = 0 then array(array({ref('qid * 4')}), array({ref('qid * 4 + 1')}, {ref('qid * 4 + 2')})) else array(array({ref('qid * 4')}, {ref('qid + 1')})) end")
    return questions(spark, sf_dir).select(F.col("qid").alias("question_id"), F.expr("case when qid % 3 = 0 then 'cross_section' else 'single_section' end").alias("question_type"), g.alias("groups"))


@query(f"with {SQL_EVAL} select question_id, question_type, complete_rank, round(recall_at_1, 6) as recall_at_1, round(recall_at_5, 6) as recall_at_5, round(recall_at_10, 6) as recall_at_10 from per")
def first_complete_rank(spark, sf_dir):
    m = evaluation.question_metrics(gold(spark, sf_dir), context_rows(spark, sf_dir).withColumnRenamed("qid", "question_id"))
    return m.select("question_id", "question_type", "complete_rank", *[F.round(f"recall_at_{k}", 6).alias(f"recall_at_{k}") for k in (1, 5, 10)])


@query(f"""with {SQL_EVAL} select count(*) as questions, round(avg(case when complete_rank <= 1 then 1.0 else 0 end), 6) as hit_at_1, round(avg(case when complete_rank <= 5 then 1.0 else 0 end), 6) as hit_at_5,
    round(avg(case when complete_rank <= 10 then 1.0 else 0 end), 6) as hit_at_10, round(avg(recall_at_1), 6) as recall_at_1, round(avg(recall_at_5), 6) as recall_at_5, round(avg(recall_at_10), 6) as recall_at_10,
    round(avg(coalesce(1.0 / complete_rank, 0)), 6) as mrr from per""")
def eval_summary(spark, sf_dir):
    return evaluation.summary(evaluation.question_metrics(gold(spark, sf_dir), context_rows(spark, sf_dir).withColumnRenamed("qid", "question_id")))


SQL_ACTION = "case reason " + " ".join(f"when '{k}' then '{v}'" for k, v in evaluation.ACTIONS.items()) + " end"


@query(f"""with {SQL_EVAL}, near as (select distinct gold.question_id from gold, context c where c.qid = gold.question_id and c.rank <= 10 and list_contains(list_transform(flatten(groups), lambda s: split_part(s, '.', 1)), split_part(c.section, '.', 1)))
    select question_id, reason, {SQL_ACTION} as action, found_groups from (
    select question_id, case when question_type = 'cross_section' and found > 0 then 'cross_section_retrieval_design_issue' when question_type = 'cross_section' then 'cross_section_ranking_issue'
           when question_id in (select question_id from near) then 'same_part_ranking_issue' else 'ranking_issue' end as reason, found as found_groups from per where found < n)""")
def failure_reasons(spark, sf_dir):
    return evaluation.failure_reasons(gold(spark, sf_dir), context_rows(spark, sf_dir).withColumnRenamed("qid", "question_id"))


SQL_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(f"select sha256({SQL_NORM}) as hash, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def text_fingerprint_dups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.plain_lower(F.col("text")), 256).alias("hash"))
    return d.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), '§', ' section '), '\s+', ' ', 'g'), '[!-#%-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')) as answer from documents""")
def normalize_answer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.answer_key(F.col("text")).alias("answer"))


# Quotes and dashes that are one.
SQL_CONSERVATIVE = "trim(regexp_replace(lower(translate({}, '“”‘’—–−搂' || chr(160), '\"\"' || chr(39) || chr(39) || '---§ ')), '\\s+', ' ', 'g'))"


@query(rf"""with c as (select doc_id, {SQL_CONSERVATIVE.format('nfc_normalize(text)')} as t from documents) select doc_id, sha256(t) as fingerprint, len(regexp_extract_all(t, '[a-z0-9]+(?:[.''-][a-z0-9]+)*|§'))::int as n_tokens from c""")
def content_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"), F.size(T.content_tokens(F.col("text"))).alias("n_tokens"))


def legacy_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    ids = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 500).cast("int"))).alias("chunk_id")
    c = d.select(F.col("doc_id").alias("row_id"), ids, "text").select("row_id", "chunk_id", F.substring("text", F.col("chunk_id") * 500 + 1, F.lit(500)).alias("chunk"))
    return c.where(~((F.col("row_id") % 11 == 0) & (F.col("chunk_id") == 1)))


SQL_LEGACY = """legacy as (select * from (select doc_id as row_id, unnest(generate_series(0, (length(text) - 1) // 500)) as chunk_id, text from documents where length(text) > 0) where not (row_id % 11 = 0 and chunk_id = 1)),
    parts as (select row_id, chunk_id, substr(text, chunk_id * 500 + 1, 500) as chunk from legacy),
    docs as (select row_id, string_agg(chunk, '' order by chunk_id) as text, count(*) as chunk_count, max(chunk_id) as last, list(chunk_id order by chunk_id) as ids, list(length(chunk) order by chunk_id) as lens from parts group by row_id)"""


@query(f"with {SQL_LEGACY} select row_id, chunk_count, sha256(text) as text_sha256, list_filter(generate_series(0, last), lambda x: not list_contains(ids, x)) as missing_ids, list_aggregate(lens[:-2], 'min') is null or list_aggregate(lens[:-2], 'min') = 500 as round_trip from docs")
def recover_documents(spark, sf_dir):
    return corpus.recover_documents(legacy_chunks(spark, sf_dir)).select("row_id", "chunk_count", "text_sha256", "missing_ids", "round_trip")


@query(rf"""with {SQL_LEGACY}, d as (select row_id, chunk_count, text, len(list_filter(generate_series(0, last), lambda x: not list_contains(ids, x))) as missing, len(ids) - len(list_distinct(ids)) as doubled,
        len(list_filter(lens[:-2], lambda n: n <> 500)) as odd, lens[-1] between 1 and 500 as tail_fits, regexp_replace(text, '\s*…\(已截断\)$', '') as body from docs),
    groups as (select count(*) as duplicate_groups from (select 1 from d group by trim(regexp_replace(lower(text), '\s+', ' ', 'g')) having count(*) > 1)),
    m as (select count(*) as documents, sum(chunk_count)::bigint as chunks, count_if(missing > 0) as with_missing, count_if(doubled > 0) as with_duplicates, count_if(not (odd = 0 and tail_fits)) as round_trip_failures,
        count_if(length(trim(text)) = 0) as empty_documents, count_if(regexp_matches(text, '\s*…\(已截断\)$')) as truncated_documents, count_if(regexp_matches(body, '[㐀-鿿�]')) as cjk_documents,
        count_if(length(trim(body)) > 0 and not regexp_matches(trim(body), '[.!?;:)\]"''”’]$')) as suspicious_endings, sum(odd)::bigint as nonstandard_chunks from d)
    select *, case when with_missing + with_duplicates + round_trip_failures + empty_documents = 0 then 'GO' else 'NO_GO' end as gate from m, groups""")
def recover_metrics(spark, sf_dir):
    return corpus.recovery_metrics(corpus.recover_documents(legacy_chunks(spark, sf_dir)))


@query(f"with {SQL_LEGACY} select row_id, len(missing_ids) as missing from (select row_id, list_filter(generate_series(0, last), lambda x: not list_contains(ids, x)) as missing_ids from docs) where len(missing_ids) > 0")
def chunk_sequence_issues(spark, sf_dir):
    d = corpus.recover_documents(legacy_chunks(spark, sf_dir))
    return d.where(F.size("missing_ids") > 0).select("row_id", F.size("missing_ids").cast("long").alias("missing"))


def _aligned(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    # The legacy side: upper case, a final full stop lost, cut with a marker, a word inserted, or absent.
    text = F.expr("""case doc_id % 6 when 0 then upper(text) when 1 then regexp_replace(text, '[.]$', '') when 2 then text
                     when 3 then case when length(text) > 1500 then concat(substring(text, 1, 1200), ' …(已截断)') else text end
                     when 4 then concat(substring(text, 1, length(text) div 2), ' not ', substring(text, length(text) div 2 + 1)) else text end""")
    legacy = d.where("doc_id % 6 <> 5").select(F.col("doc_id").alias("legacy_id"), text.alias("text"))
    return corpus.align(sections_plain(spark, sf_dir), legacy)


def sections_plain(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.expr(SECTION).alias("section"), "text")


@query()
def align_cascade(spark, sf_dir):
    return _aligned(spark, sf_dir)


@query()
def align_status_histogram(spark, sf_dir):
    return _aligned(spark, sf_dir).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


#: The chunker as a recursion over each text: where the next chunk starts follows from where this one ends.
SQL_CHUNKS = r"""recursive d as (select doc_id, text, length(text) as size, list_transform(string_split(text, chr(10)), lambda x: length(x) + 1) as steps from documents where length(text) > 0),
    b as (select doc_id, text, size, list_transform(range(1, len(steps)), lambda i: list_sum(steps[1:i])::bigint) as breaks from d),
    walk as (
        select doc_id, text, size, breaks, 0::bigint as pos, 0::bigint as stop, '' as kind, 0 as n from b
        union all
        select doc_id, text, size, breaks, case when stop = size then size else greatest(coalesce(list_min(list_filter(breaks, lambda x: x >= back and x < stop)), back), 0) end, stop, kind, n from (
            select *, greatest(pos + 1, stop - 150) as back from (
                select doc_id, text, size, breaks, pos, n + 1 as n,
                       case when pos + 1200 >= size then size when last >= pos + 720 then last else pos + 1200 end as stop,
                       case when pos + 1200 >= size then 'document_end' when last >= pos + 720 then 'paragraph' else 'hard' end as kind
                from (select *, coalesce(list_max(list_filter(breaks, lambda x: x <= pos + 1200)), -1) as last from walk where pos < size)))),
    starts as (select *, lag(pos) over (partition by doc_id order by n) as start from walk),
    cut as (select doc_id, n, start + length(body) - length(ltrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as char_start, start + length(body) - length(ltrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) + length(trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as char_end, kind as boundary_type, trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as text
        from (select *, substr(text, start + 1, stop - start) as body from starts where n > 0) where length(trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0),
    chunks as (select doc_id as document_id, row_number() over w - 1 as chunk_index, count(*) over (partition by doc_id) as chunk_count, char_start, char_end, boundary_type, text,
        coalesce(lag(char_end) over w > char_start, false) as has_overlap_before from cut window w as (partition by doc_id order by n))"""


@query(f"""with {SQL_CHUNKS} select document_id, chunk_index::int as chunk_index, char_start::int as char_start, char_end::int as char_end, boundary_type, text,
    document_id || ':chunk-' || case when chunk_index + 1 < 10000 then lpad((chunk_index + 1)::varchar, 4, '0') else (chunk_index + 1)::varchar end as chunk_id, chunk_count, has_overlap_before from chunks""")
def chunk_spans(spark, sf_dir):
    return corpus.chunk_documents(table(spark, sf_dir, "documents"), id_col="doc_id")


@query(f"""with {SQL_CHUNKS}, c as (select k.*, p.text as parent, coalesce(max(char_end) over (partition by document_id order by char_start, char_end rows between unbounded preceding and 1 preceding), 0) as reach from chunks k left join documents p on p.doc_id = document_id)
    select count(*) as chunks, count_if(parent is null) as orphans, count_if(length(trim(text)) = 0) as empty, count_if(length(text) > 1200) as too_long,
           count_if(substr(parent, char_start + 1, char_end - char_start) <> text) as not_slice, count_if(char_start > reach and regexp_matches(substr(parent, reach + 1, char_start - reach), '\\S')) as gaps,
           count(*) - count(distinct document_id || ':' || chunk_index) as doubled_ids from c""")
def chunk_validate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return corpus.validate_chunks(d, corpus.chunk_documents(d, id_col="doc_id"), most=1200, id_col="doc_id")


@query(f"""with {SQL_CHUNKS} select boundary_type, count(*) as chunks, min(length(text))::int as shortest, floor(median(length(text)))::bigint as median, quantile_disc(length(text), 0.95)::double as p95, max(length(text))::int as longest from chunks group by boundary_type""")
def chunk_length_stats(spark, sf_dir):
    c = corpus.chunk_documents(table(spark, sf_dir, "documents"), id_col="doc_id").withColumn("n", F.length("text"))
    return c.groupBy("boundary_type").agg(F.count(F.lit(1)).alias("chunks"), F.min("n").alias("shortest"), F.floor(F.median("n")).cast("long").alias("median"), corpus.nearest_rank("n", 0.95).alias("p95"), F.max("n").alias("longest"))


@query(r"""with s as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as body from documents), b as (select item_id as qid, trim(regexp_replace(text, '\s+', ' ', 'g')) as ev from benchmark),
    w as (select qid, size, unnest(case when length(ev) <= size then [ev] else list_distinct([substr(ev, least(floor(length(ev) * 0.2)::int, length(ev) - size) + 1, size), substr(ev, least(floor(length(ev) * 0.4)::int, length(ev) - size) + 1, size), substr(ev, least(floor(length(ev) * 0.6)::int, length(ev) - size) + 1, size)]) end) as win
          from b, (values (160), (120), (80)) t(size)),
    m as (select distinct qid, size, doc_id from w join s on contains(body, win) where length(win) > 0), best as (select qid, doc_id from m qualify size = max(size) over (partition by qid)),
    h as (select qid, count(distinct doc_id) as n from best group by qid)
    select b.qid, case when coalesce(n, 0) = 1 then 'auto_labeled' when coalesce(n, 0) > 1 then 'review_required' else 'unmatched' end as status, coalesce(n, 0) as candidates from b left join h using (qid)""")
def window_label(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("evidence"))
    return corpus.window_labels(asked, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section"), "text")).select("qid", "status", F.col("candidates").cast("long").alias("candidates"))


def _typed(spark, sf_dir):
    extra = F.expr("""case doc_id % 5 when 0 then ' Bank means a bank. Loan means a loan.' when 1 then ' It must act and shall report within 30 days.'
                      when 2 then ' This part applies to banks on January 5, 2020.' when 3 then ' See § 1.2 and § 3.4-a.' else '' end""")
    head = F.expr("case doc_id % 4 when 0 then '§ 1.1 Definitions' when 1 then '§ 2.3 Authority and scope' else '§ 4.5 Other' end")
    return table(spark, sf_dir, "documents").select("doc_id", head.alias("heading"), F.concat("text", extra).alias("text"))


@query(r"""with s as (select doc_id, lower(case doc_id % 4 when 0 then '§ 1.1 Definitions' when 1 then '§ 2.3 Authority and scope' else '§ 4.5 Other' end) as h,
           lower(text || case doc_id % 5 when 0 then ' Bank means a bank. Loan means a loan.' when 1 then ' It must act and shall report within 30 days.'
                 when 2 then ' This part applies to banks on January 5, 2020.' when 3 then ' See § 1.2 and § 3.4-a.' else '' end) as t from documents)
    select doc_id, list_filter([
        case when contains(h, 'applicability') or contains(h, 'scope') or contains(substr(t, 1, 1000), 'applies to') then 'applicability' end,
        case when starts_with(trim(regexp_replace(h, '^§\s*\S+\s*', '')), 'authority') or starts_with(t, 'authority.') or contains(substr(t, 1, 500), '(a) authority.') or contains(substr(t, 1, 500), 'this part is issued pursuant to') then 'authority' end,
        case when len(list_distinct(regexp_extract_all(t, '§+\s*([0-9]+[a-z]?(?:\.[0-9a-z-]+)+)', 1))) >= 2 then 'cross_section' end,
        case when contains(h, 'definition') or (length(t) <= 3000 and len(regexp_extract_all(t, '\bmeans\b')) >= 2) then 'definition' end,
        case when regexp_matches(t, '\b\d+(?:\.\d+)?\s*(?:%|percent|days?|months?|years?)\b') or regexp_matches(t, '\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}(?:,\s+\d{4})?\b') then 'numeric_or_date' end,
        case when len(regexp_extract_all(t, '\b(?:must|shall|required to|may not)\b')) >= 2 then 'obligation' end], lambda x: x is not null) as types,
        case when length(t) <= 900 then 'short' when length(t) <= 3000 then 'medium' else 'long' end as bucket from s""")
def classify_sections(spark, sf_dir):
    return _typed(spark, sf_dir).select("doc_id", T.section_types(F.col("heading"), F.col("text")).alias("types"), T.length_bucket(F.length("text")).alias("bucket"))


@query(f"with {SQL_SECTIONS} select bucket, rank, section from (select *, row_number() over (partition by bucket order by sha256('seed|' || section)) as rank from (select section, case when length(text) <= 900 then 'short' when length(text) <= 3000 then 'medium' else 'long' end as bucket from sections where length(text) between 300 and 5000)) where rank <= 5")
def hash_shortlist(spark, sf_dir):
    return corpus.shortlist(sections(spark, sf_dir), "seed")


def _pairs(spark, sf_dir):
    return families.similar_pairs(table(spark, sf_dir, "documents"), id_col="doc_id")


SQL_PAIRS = """sets as (select doc_id as id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) as words from documents),
    reps as (select min(id) as id, words from sets where len(words) > 0 group by words),
    near as (select x.id as a, y.id as b, len(list_intersect(x.words, y.words)) as met, len(x.words) + len(y.words) as n from reps x join reps y on x.id < y.id and least(len(x.words), len(y.words)) >= 0.78 * greatest(len(x.words), len(y.words)) - 1e-9),
    pairs as (select a, b, met / (n - met) as jaccard from near where met / (n - met) >= 0.78
        union all select r.id, s.id, 1.0 from sets s join reps r using (words) where s.id <> r.id)"""


@query(f"with {SQL_PAIRS} select a, b, jaccard from pairs")
def jaccard_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


def _families(spark, sf_dir):
    return families.families(table(spark, sf_dir, "documents"), _pairs(spark, sf_dir), id_col="doc_id")


SQL_FAMILIES = f"""recursive {SQL_PAIRS}, edges as (select a, b from pairs union select b, a from pairs),
    reach as (select id, id as root from sets union select r.id, e.b from reach r join edges e on e.a = r.root),
    fam as (select id, min(root) as root, 'family-' || substr(sha256('0|' || min(root)), 1, 12) as family from reach group by id)"""


@query(f"with {SQL_FAMILIES} select id, root, family from fam")
def equivalence_families(spark, sf_dir):
    return _families(spark, sf_dir)


@query(f"with {SQL_FAMILIES} select id, family, case when ('0x' || substr(sha256('0|' || family), 1, 8))::ubigint / 4294967296.0::double < 0.5 then 'held_out' else 'development' end as split from fam")
def split_assignment(spark, sf_dir):
    return families.split_families(_families(spark, sf_dir))


SQL_ANSWERS = r"""a as (select doc_id, case doc_id % 3 when 0 then 'em_or_alias' when 1 then 'contains_all' else 'evidence_groups_and_contains' end as policy, lower(lang || ' ' || source || ' ' || n_chars) as answer,
    [lang, lower(lang || ' ' || source || ' ' || n_chars) ] as aliases, [source, case when doc_id % 4 = 0 then 'zzz' else lang end] as terms, [[source, 'x'], [case when doc_id % 5 = 0 then 'none' else lang end]] as groups, [source, lang] as cited from documents),
    s as (select *, list_filter(terms, lambda t: not contains(answer, t)) as missing_terms, list_filter(groups, lambda g: not list_has_any(g, cited)) as missing_groups from a)"""


@query(f"with {SQL_ANSWERS} select doc_id, len(missing_terms) as missing_terms, len(missing_groups) as missing_groups, case policy when 'em_or_alias' then true when 'contains_all' then len(missing_terms) = 0 else len(missing_terms) = 0 and len(missing_groups) = 0 end as passed from s")
def answer_policy(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    said = F.concat_ws(" ", "lang", "source", F.col("n_chars").cast("string"))
    rows = d.select(
        "doc_id", F.expr("case doc_id % 3 when 0 then 'em_or_alias' when 1 then 'contains_all' else 'evidence_groups_and_contains' end").alias("policy"), said.alias("answer"),
        F.array("lang", F.upper(said)).alias("aliases"), F.expr("array(source, case when doc_id % 4 = 0 then 'zzz' else lang end)").alias("terms"),
        F.expr("array(array(source, 'x'), array(case when doc_id % 5 = 0 then 'none' else lang end))").alias("groups"), F.array("source", "lang").alias("cited"),
    )
    return evaluation.score_answers(rows).select("doc_id", F.size("missing_terms").cast("long").alias("missing_terms"), F.size("missing_groups").cast("long").alias("missing_groups"), "passed")


@query("select count(*) as runs, round(avg(quality), 6) as good_rate, round(avg(toxic), 6) as bad_rate, round(avg(doc_id % 7), 6) as avg_steps from labels")
def process_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"), (F.col("doc_id") % 7).alias("steps"))
    return evaluation.process_rates(rows, ["good", "bad"])


@query("select conv_id, count(*) as steps, count(*) <= 8 as within_budget, min(turn) as first_turn, max(turn) as last_turn from conversations group by conv_id")
def step_accounting(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("steps"), (F.count(F.lit(1)) <= 8).alias("within_budget"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query(f"with {SQL_SECTIONS} select doc_id, 'ecfr:title-12:section-' || section || ':version-' || version_date as document_id, '12 CFR § ' || section || ' | ' || heading || chr(10) || text as embedding_text, sha256(text) as text_sha256, safe_for_citation from sections")
def canonical_corpus(spark, sf_dir):
    s = sections(spark, sf_dir)
    return s.select("doc_id", T.document_id(F.col("section"), F.col("version_date")).alias("document_id"), T.embedding_text(F.col("section"), F.col("heading"), F.col("text")).alias("embedding_text"), F.sha2("text", 256).alias("text_sha256"), "safe_for_citation")


# What a judge might say: fenced or after words, scores in and out of range, a missing one, issues of either kind.
def judged(spark, sf_dir):
    score = "cast((doc_id + {}) % 6 as string)"
    five = ", ".join(f"'\"{n}\": ', {score.format(i * (1 if n == 'overall' else 0) + 1)}, ', '" if n == "overall" else f"'\"{n}\": ', cast(3 + (doc_id + {i}) % 3 as string), ', '" for i, n in enumerate(T.SCORES))
    issues = "case doc_id % 3 when 0 then ', \"issues\": \"one\"' when 1 then ', \"issues\": [\"one\", \"two\"]' else '' end"
    body = f"concat('{{', {five}, '\"pass\": ', case when quality = 1 then 'true' else 'false' end, {issues}, '}}')"
    said = f"case doc_id % 4 when 0 then concat('```json\\n', {body}, '\\n```') when 1 then concat('My view: ', {body}, ' Done.') when 2 then {body} else concat('no object', doc_id) end"
    return table(spark, sf_dir, "labels").select("doc_id", T.judge_scores(F.expr(said)).alias("j"))


SQL_JUDGED = """j as (select doc_id, case when doc_id % 4 <> 3 and (doc_id + 5) % 6 between 1 and 5 then true end as ok, 3 + doc_id % 3 as answer_relevance, 3 + (doc_id + 1) % 3 as faithfulness, 3 + (doc_id + 2) % 3 as citation_support,
    3 + (doc_id + 3) % 3 as legal_caution, (doc_id + 5) % 6 as overall, quality = 1 as passed, case doc_id % 3 when 0 then ['one'] when 1 then ['one', 'two'] else [] end as issues from labels)"""


@query(f"with {SQL_JUDGED} select doc_id, case when ok then answer_relevance end::int as answer_relevance, case when ok then overall end::int as overall, case when ok then passed end as passed, case when ok then issues end as issues from j")
def judge_parse(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", "j.answer_relevance", "j.overall", "j.passed", "j.issues")
