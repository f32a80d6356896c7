"""The jobs as queries over the driver tables, with the SQL of what they leave."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import chunk_refresh, retrieval_report
from marlquarry.functions.lineage import shared_folder
from marlquarry.plans.doc_oracles import CHILDREN, SPACE
from marlquarry.plans.rank_queries import BASE, K, ORACLES as RANKED, per_query_sql

HERE = os.path.dirname(os.path.abspath(__file__))


def job1_chunk_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "job1")
    cfg = chunk_refresh.RefreshConfig.read(os.path.join(HERE, "chunk_refresh.json"))
    for _ in range(2):
        # A stream's path is a folder or a pattern; the table may be one file.
        found = chunk_refresh.refresh(spark, f"{sf_dir}/documents.parquet*", f"{folder}/out", f"{folder}/mark", cfg)
    return found


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "job2")
    cfg = retrieval_report.ReportConfig.read(os.path.join(HERE, "retrieval_report.json"))
    for _ in range(2):
        found = retrieval_report.report(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{sf_dir}/labels.parquet", f"{folder}/out", cfg)
    return found


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_chunk_refresh, job2_retrieval_report)}

_PATHS = f"""regexp_matches(replace(text, '/', '\\'), '([A-Za-z]:[\\\\/]|\\\\\\\\[^\\\\/]+[\\\\/][^\\\\/]+)') or regexp_matches(text, '(?i)(^|{SPACE[:-1]})/(home|users|mnt|var|tmp|private|runner|workspace|root)/')"""
_SECRETS = "regexp_matches(lower(text), 'sk-|api_key=|apikey=|ghp_|github_pat_|hf_|xoxb-|bearer |password=|token=|secret=')"

CHUNKS_SQL = f"""with recursive {CHILDREN}, own as (select *, printf('doc-%d-p%06d-%02d', doc_id, parent_no, part_no) as parent_id from ch),
x as (select *, printf('%s-c%04d', parent_id, child_no) as chunk_id, unnest(ids) as block_id, generate_subscripts(ids, 1) as place from own),
j as (select x.doc_id, chunk_id, parent_id, x.n_blocks, x.text_length, string_agg(text, chr(10) order by place) as text,
  sha256(string_agg(text_hash || ':' || blocks.text_length, '|' order by place)) as text_hash, bool_or(contains(text, '�')) as broken, bool_or(element_type = 'table') as tabled
  from x join blocks using (block_id) group by all)
select j.doc_id, chunk_id, parent_id, source, cast(n_blocks as int) as n_blocks, text_length, list_filter([case when broken then 'replacement_character' end, case when tabled then 'has_table' end], lambda y: y is not null) as quality_flags,
  not ({_PATHS.replace('text', 'j.text')}) and not {_SECRETS.replace('text', 'j.text')} as public_allowed, j.text, text_hash, lang
from j join documents d using (doc_id)"""

_RERANKED = RANKED["rerank_scorer"].split(f"with {BASE} ", 1)[1]
_METRICS = ("hit_1", "hit_3", "hit_5", "rr", "ndcg")


def _run(name: str) -> str:
    return f"""select '{name}' as method, jq.query_id, expected, {', '.join(_METRICS)}, (select count(*) from r_{name} r where r.query_id = jq.query_id and rank <= {K}) as n_hits
from jq left join {per_query_sql(f'r_{name}')} m using (query_id)"""


REPORT_SQL = f"""with {BASE}, w as (select * from bm where rank <= 30), o as ({_RERANKED.replace('where rank <= 5', 'where rank <= 30')}),
r_bm25 as (select query_id, doc_id, rank from w where rank <= 5), r_rerank as (select query_id, doc_id, rank from o where rank <= 5),
u as (select query_id, doc_id, w.rank as ar, o.rank as br, round(1.0 / (60 + w.rank) + 1.0 / (60 + o.rank), 6) as score from w join o using (query_id, doc_id)),
r_rrf as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, least(ar, br), ar, br, doc_id) as rank from u qualify rank <= 5),
a as ({' union all '.join(_run(n) for n in ('bm25', 'rerank', 'rrf'))}),
p as (select a.method, query_id, a.expected, {', '.join(f'round(a.{m}, 6) as {m}' for m in _METRICS)}, round(a.rr - b.rr, 6) as delta_rr, round(a.ndcg - b.ndcg, 6) as delta_ndcg, a.n_hits
  from a join (select * from a where method = 'bm25') b using (query_id)),
s as (select method, count(*) filter (expected = 'retrieve') as n_queries, {', '.join(f"round(coalesce(avg({c}), 0), 6) as {n}" for n, c in zip(('recall_1', 'recall_3', 'recall_5', 'mrr', 'ndcg_5', 'delta_mrr', 'delta_ndcg_5'), (*_METRICS, 'delta_rr', 'delta_ndcg'), strict=True))},
  count(*) filter (delta_ndcg > 0) as improved, count(*) filter (delta_ndcg < 0) as regressed, count(*) filter (expected = 'abstain' and n_hits > 0) as abstain_with_candidates from p group by method)
select p.*, s.* exclude (method), case when method = 'bm25' then 'baseline' when delta_ndcg_5 >= 0.01 and delta_mrr >= -0.01 then 'adopt' else 'keep_baseline' end as decision from p join s using (method)"""

ORACLES: dict[str, str] = {"job1_chunk_refresh": CHUNKS_SQL, "job2_retrieval_report": REPORT_SQL}
