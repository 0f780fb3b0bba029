"""The queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeflow.llm import ann, exact_dedup, filter_audit, html_extract, langid, licenses, mixing, ngram_join, packing, pii, prefix_trie, tokenbin, warc
from citeflow.llm.tokens import WORD_BPE


def tokenizer_path() -> str:
    """Where the word-level BPE file is installed."""
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path()))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.shard_report(_table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path())


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


_OPERATORS = (
    op1_html_wrapper, op2_warc_revisits, op3_license_scan, op4_packing, op5_ngram_join, op6_language_id, op7_source_mix, op8_exact_dedup, op9_token_shards, op10_nearest,
    op11_personal_data, op12_filter_audit, op13_prefix_trie,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_revisits": """
        with p as (
            select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
            from pages
        ), o as (
            select *, max(page_id) over (partition by payload_digest, payload_bytes) as original from p
        )
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id <> original then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id <> original then original end as refers_to
        from o
    """,
    "op7_source_mix": r"""
        with d as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                   md5('7|' || doc_id) as key
            from documents
        ), s as (
            select source, sum(size)::bigint as source_size from d group by source
        ), w as (
            select *, ([3, 1, 2])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
                   source_size * 2.0::double as cap
            from s
        ), r as (
            select *, cap / weight as ratio from w
        ), l as (
            select *,
                   (sum(source_size) over ())::bigint * 1.5::double
                     - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
                   (sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following))::bigint as weights
            from r
        ), f as (
            select rest as free_rest, weights as free_weights from l where weight * rest / weights <= cap
            order by ratio, source nulls last limit 1
        ), t as (
            select source, source_size,
                   case when free_weights is null or weight * free_rest / free_weights > cap then cap
                        else weight * free_rest / free_weights end as target
            from l left join f on true
        ), c as (
            select d.doc_id, d.size, t.source_size, t.target,
                   coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size
                            rows between unbounded preceding and 1 preceding), 0)::bigint as before,
                   floor(t.target + 0.5)::bigint as budget
            from d join t on d.source is not distinct from t.source
        )
        select doc_id, size, source_size, target,
               case when source_size = 0 then 0
                    else (budget // source_size) * size
                         + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) end::bigint as taken
        from c
    """,
    "op8_exact_dedup": """
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
        from documents
        window g as (partition by coalesce(text, ''))
    """,
    "op12_filter_audit": r"""
        with w as (
            select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
            from documents
        ), f as (
            select w.part, coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic,
                   map {'A': len(words) < 50,
                        'B': 100 * len(list_distinct(words)) < 65 * len(words),
                        'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t),
                        'D': regexp_matches(t, '[#$%&*|]'),
                        'E': w.doc_id > min(w.doc_id) over (partition by t)} as fails
            from w left join labels l on w.doc_id = l.doc_id
        ), x as (
            select unnest(['A', 'B', 'C', 'D', 'E']) as x
        ), o as (
            select a.x || b.x || c.x || d.x || e.x as filter_order
            from x a, x b, x c, x d, x e
            where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), s as (
            select filter_order, step::int as step, substr(filter_order, step::int, 1) as letter,
                   list_filter(string_split(filter_order, ''), lambda v, i: i < step) as earlier
            from o, range(1, 6) r(step)
        ), c as (
            select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
            from f group by part, fails
        ), r as (
            select part, filter_order, step, letter, n, good, toxic, fails[letter] as failing,
                   len(list_filter(earlier, lambda v: fails[v])) > 0 as gone,
                   len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda v: fails[v])) as all_fails
            from c, s
        ), g as (
            select part, filter_order, step, letter,
                   coalesce(sum(n) filter (where not gone and not failing), 0)::bigint as kept,
                   coalesce(sum(n) filter (where not gone and failing), 0)::bigint as removed,
                   coalesce(sum(n) filter (where gone and failing), 0)::bigint as redundant,
                   coalesce(sum(n) filter (where failing and all_fails = 1), 0)::bigint as unique_fails,
                   coalesce(sum(good) filter (where not gone and failing), 0)::bigint as good_lost,
                   coalesce(sum(toxic) filter (where not gone and failing), 0)::bigint as toxic_lost
            from r group by part, filter_order, step, letter
        )
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) over (partition by part, letter))::bigint as shapley
        from g
    """,
    "op13_prefix_trie": """
        with t as (
            select conv_id, conv_id - conv_id % 5 as base, coalesce(role, '') as role, coalesce(text, '') as text,
                   row_number() over (partition by conv_id order by turn nulls first,
                       sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
            from conversations where conv_id is not null
        ), c as (
            select conv_id, conv_id - conv_id % 5 as base,
                   xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::varchar, ''),
                           lambda x: [ord(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
                       lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 9 as h
            from t group by conv_id
        ), u as (
            select c.conv_id, t.pos, 0 as own, role, text from c join t on t.conv_id = c.base where t.pos <= c.h
            union all
            select c.conv_id, t.pos, 1 as own, role, text from c join t using (conv_id) where t.pos > c.h
        ), v as (
            select conv_id, sha256(role || chr(1) || text) as d, strlen(text) as bytes,
                   row_number() over (partition by conv_id order by own, pos) as depth
            from u
        ), k as (
            select conv_id, depth, bytes, sha256(string_agg(d, '') over (partition by conv_id order by depth)) as key,
                   sha256(coalesce(string_agg(d, '') over (partition by conv_id order by depth rows between unbounded preceding and 1 preceding), '')) as parent
            from v
            union all
            select conv_id, 0, 0, sha256(''), null from c
        ), e as (
            select *, depth = max(depth) over (partition by conv_id) as last from k
        ), n as (
            select key, any_value(parent) as parent, any_value(depth) as depth, any_value(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs,
                   sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where last), '')) as ends_sha256
            from e group by key
        ), p as (
            select n.*, q.conv_id as parent_conv_id, (select count(*) from n z where z.parent = n.key) as n_children
            from n left join n q on n.parent = q.key
        ), s as (
            select k.key, sum((p.n_children = 0)::int)::bigint as n_leaves, sum((p.n_convs - 1) * p.bytes)::bigint as saved_tokens
            from p join k on k.conv_id = p.conv_id and k.depth <= p.depth
            group by k.key
        )
        select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from p join s using (key)
    """,
}
