"""Registered queries of the corpus operators, with their checking SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    bpe_count,
    conversations,
    divergence,
    html_tree,
    licences,
    mixing,
    packing,
    pieces,
    quality,
    simhash,
    sketch,
    token_store,
    urls,
)
from barloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op2_document_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.edited_likeness(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        sketch.as_text(F.col("sketch")).alias("fingerprint"),
        sketch.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@_query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe_count.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


# The rules that the query judges by (verdict, host, path).
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

_URL_SQL = """
with parts as (
  select page_id,
         case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest
  from pages
), urls as (
  select page_id,
         translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from parts
), rules(says, r_host, r_path) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), judged as (
  select host, path, arg_max(r_host || r_path, length(r_host || r_path)) as rule,
         arg_max(says, length(r_host || r_path)) as says
  from (select distinct host, path from urls) u, rules
  where (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
  group by host, path
)
select page_id, host, path, rule, coalesce(says, 'allow') as verdict
from urls left join judged using (host, path)
"""


@_query("op4_url_filters", _URL_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES), default="allow")


@_query("op5_mixing_sources")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.schedule(_table(spark, sf_dir, "documents"), mixing.cycle(3, 1, 2), share=1.5, repeats=2)
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@_query("op6_token_store")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    store = token_store.write_store(docs, scratch_path(spark, "token-store"), vocabulary, end_id=1)
    return store.lookup(docs, "doc_id")


@_query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@_query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(_table(spark, sf_dir, "pages"))


@_query("op10_license_scans")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.array_join("licences", ",").alias("licences"),
        "n_licences",
        "n_unknown",
        F.array_join("lines", ",").alias("lines"),
    )


_DIVERGENCE_SQL = r"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text
  from documents
), found as (
  select r, lang, source, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from docs
), kept as (
  select lang, term from found group by lang, term having count(distinct r) >= 30
), counts as (
  select lang, source, term, count(*) as c from found join kept using (lang, term) group by lang, source, term
), langs as (
  select lang, count(distinct term) as v, sum(c) as n from counts group by lang
), groups as (
  select g.lang, g.source, coalesce(v, 0) as v, coalesce(l.n, 0) as lang_n, coalesce(t.n, 0) as n
  from (select distinct lang, source from docs) g left join langs l using (lang)
  left join (select lang, source, sum(c) as n from counts group by lang, source) t using (lang, source)
), freq as (
  select g.lang, g.source, k.term, coalesce(c, 0) as c,
         1 + (1000000000::hugeint * (coalesce(c, 0) + 5)) // (n + 5 * v) as p,
         1 + (1000000000::hugeint * (sum(coalesce(c, 0)) over (partition by g.lang, k.term) + 5)) // (lang_n + 5 * v) as q
  from groups g join kept k using (lang) left join counts using (lang, source, term)
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(d.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
    from freq x join freq y on x.lang = y.lang and x.term = y.term group by all
  ) d on d.lang = a.lang and d.source = a.source and d.item = b.source
), listed as (
  select lang, source, 'pair' as part, item, value from pairs
  union all
  select lang, source, 'term', term, p - q from freq where c > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from listed
)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""


@_query("op11_source_divergence", _DIVERGENCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"), min_docs=30, prior=5, top=50)


_CONVERSATION_SQL = r"""
with recursive read as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint) as key
  from conversations
), drawn as (
  select *, xor(list_reduce(list_concat([4294967295::bigint], key),
                  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))),
                4294967295) % 20 as draw
  from read
), damaged as (
  select conv_id, turn, case when draw = 4 then 'user' else role end as role,
         case when draw = 1 then '' when draw = 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case when draw = 3 then 2 else 1 end)) as copy
  from drawn where draw <> 0
), placed as (
  select *, translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') as bare,
         row_number() over along as pos,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
         left(lag(role) over along, 1) || left(role, 1) as pair
  from damaged window along as (partition by conv_id order by turn nulls first, role, sha256(text), copy)
), marked as (
  select *, case when bare = '' then 'blank' when again then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from placed
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from marked group by conv_id
), walk as (
  select conv_id, n + 1 as pos, {'c': 0, 'a': '', 'l': []::varchar[]} as b,
         {'c': 6, 'a': 'II', 'l': ['user:', 'assistant:']} as s, {'c': 3, 'a': 'I', 'l': ['assistant:']} as u,
         {'c': 0, 'a': '', 'l': []::varchar[]} as a
  from counts
  union all
  select conv_id, pos,
         list_min([b0, {'c': u1.c + 3, 'a': 'I' || u1.a, 'l': list_prepend('user:', u1.l)}]),
         list_min([s0, {'c': u1.c + 3, 'a': 'I' || u1.a, 'l': list_prepend('user:', u1.l)}]),
         u1, list_min([a0, {'c': u0.c + 3, 'a': 'I' || u0.a, 'l': list_prepend('user:', u0.l)}])
  from (
    select *, list_min([u0, {'c': a0.c + 3, 'a': 'I' || a0.a, 'l': list_prepend('assistant:', a0.l)}]) as u1
    from (
      select conv_id, pos,
             list_min([{'c': b.c + 4, 'a': 'D' || b.a, 'l': b.l}, case when keep and who = '' then {'c': b.c + more, 'a': 'K' || b.a, 'l': list_prepend(line, b.l)} end, case when keep and who = 's' then {'c': s.c + more, 'a': 'K' || s.a, 'l': list_prepend(line, s.l)} end,
                       ku, ru]) as b0,
             list_min([{'c': s.c + 4, 'a': 'D' || s.a, 'l': s.l}, case when keep and who = '' then {'c': s.c + more, 'a': 'K' || s.a, 'l': list_prepend(line, s.l)} end, ku, ru]) as s0,
             list_min([{'c': u.c + 4, 'a': 'D' || u.a, 'l': u.l}, case when keep and who = '' then {'c': u.c + more, 'a': 'K' || u.a, 'l': list_prepend(line, u.l)} end, case when keep and who = 'a' then {'c': a.c + more, 'a': 'K' || a.a, 'l': list_prepend(line, a.l)} end,
                       case when keep then {'c': a.c + more + 3, 'a': 'R' || a.a, 'l': list_prepend('assistant:' || text, a.l)} end]) as u0,
             list_min([{'c': a.c + 4, 'a': 'D' || a.a, 'l': a.l}, case when keep and who = '' then {'c': a.c + more, 'a': 'K' || a.a, 'l': list_prepend(line, a.l)} end, ku, ru]) as a0
      from (
        select w.conv_id, m.pos, w.b, w.s, w.u, w.a, m.text, left(m.role, 1) as who, m.role || ':' || m.text as line,
               m.fault not in ('blank', 'duplicate') as keep, case when m.fault = 'truncated' then 3 else 0 end as more,
               case when keep and who = 'u' then {'c': w.u.c + more, 'a': 'K' || w.u.a, 'l': list_prepend(line, w.u.l)} end as ku,
               case when keep then {'c': w.u.c + more + 3, 'a': 'R' || w.u.a, 'l': list_prepend('user:' || m.text, w.u.l)} end as ru
        from walk w join marked m on m.conv_id is not distinct from w.conv_id and m.pos = w.pos - 1
      )
    )
  )
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(w.b.c, 0)::bigint as cost,
       coalesce(w.b.a, '') as audit, sha256(coalesce(array_to_string(w.b.l, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id
left join walk w on w.conv_id is not distinct from o.conv_id and w.pos = 1
"""


@_query("op12_conversation_repair", _CONVERSATION_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return conversations.audited(turns, conversations.damaged(turns))


@_query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
