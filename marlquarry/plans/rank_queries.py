"""Queries on ranking and its metrics, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlquarry.functions.lineage import shared_folder
from marlquarry.operators import encoding as V
from marlquarry.operators import metrics as M
from marlquarry.operators import retrieval as R
from marlquarry.plans import inputs as I

K = 5
CANDIDATES = 50


def _bm25(spark: SparkSession, sf: str, k: int = K, pad: bool = False) -> DataFrame:
    return R.bm25_topk(I.documents(spark, sf), I.passages(spark, sf), k, pad)


def _dense(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    return R.dense_topk(I.doc_vectors(spark, sf), I.query_vectors(spark, sf), k)


def _per_query(spark: SparkSession, sf: str, ranked: DataFrame, variant: str = "standard", rel: DataFrame | None = None) -> DataFrame:
    rel = rel if rel is not None else I.relevance(spark, sf)
    return M.per_query(ranked, rel, I.judged_queries(spark, sf, rel), K, variant)


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.token_stats(I.documents(spark, sf))


def document_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return R.document_frequencies(I.documents(spark, sf))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf)


def bm25_zero_pad(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, pad=True)


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense_topk(e.select(F.col("vec_id").alias("doc_id"), "embedding"), queries, K)


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse_rrf(_bm25(spark, sf, CANDIDATES), _dense(spark, sf, CANDIDATES), K)


def hybrid_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse_weighted(_bm25(spark, sf, CANDIDATES), _dense(spark, sf, CANDIDATES), K)


def rerank_scorer(spark: SparkSession, sf: str) -> DataFrame:
    return R.rerank(_bm25(spark, sf, 30), I.passages(spark, sf), I.documents(spark, sf), R.overlap_scorer, K)


PLACES = ("the", "src", "haven")
STORY = ("tion", "ing", "ble", "zz")


def context_boost(spark: SparkSession, sf: str) -> DataFrame:
    return R.context_boost(_bm25(spark, sf, 20), I.documents(spark, sf), PLACES, STORY, K)


def _token_vectors(spark: SparkSession, sf: str, key: str) -> DataFrame:
    v = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16))
    return I.table(spark, sf, "embeddings").select(F.col("vec_id").alias(key), v.alias("vectors"))


def maxsim(spark: SparkSession, sf: str) -> DataFrame:
    ranked = dense_topk(spark, sf).drop("score")
    return R.late_interaction(ranked, _token_vectors(spark, sf, "query_id"), _token_vectors(spark, sf, "doc_id"), K)


def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = R.tfidf(I.documents(spark, sf).select("doc_id", "text"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("max_weight"), F.round(F.sum("weight"), 4).alias("sum_weight"))


def svd_dense(spark: SparkSession, sf: str) -> DataFrame:
    v = R.svd_texts(I.documents(spark, sf).select("doc_id", "text"))
    return v.select("doc_id", F.size("embedding").alias("dim"), "embedding")


def encode_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of documents of which some were edited, some are gone and some came since the table's first batch; only new texts are encoded."""
    docs = I.documents(spark, sf).select("doc_id", "text")
    folder = shared_folder(spark, "vectors")
    V.refresh_vectors(docs.filter("doc_id % 25 <> 4"), folder, "first")
    edited = F.when(F.pmod("doc_id", F.lit(10)) == 0, F.concat("text", F.lit(" (edited)"))).when(F.pmod("doc_id", F.lit(10)) == 1, F.lit("the same")).otherwise(F.col("text"))
    found = V.refresh_vectors(docs.filter("doc_id % 25 <> 3").withColumn("text", edited), folder, "second")
    signs = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, F.concat(i.cast("string"), F.lit("+"))).when(x < 0, F.concat(i.cast("string"), F.lit("-")))), lambda x: x.isNotNull())
    return found.select("doc_id", "fresh", F.array_join(signs, ",").alias("signs"), (F.abs(F.sqrt(R.dot(F.col("embedding"), F.col("embedding"))) - 1) < 1e-4).alias("unit"))


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    return I.qrels(spark, sf)


def ir_per_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = _per_query(spark, sf, _bm25(spark, sf, pad=True))
    return rows.select("query_id", "hit_1", "hit_3", "hit_5", F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"), "overflow")


def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.summarize(_per_query(spark, sf, _bm25(spark, sf, pad=True)))


def ir_metrics_unique(spark: SparkSession, sf: str) -> DataFrame:
    return M.summarize(_per_query(spark, sf, _bm25(spark, sf, pad=True), "unique"))


def ir_metrics_binary(spark: SparkSession, sf: str) -> DataFrame:
    return M.summarize(_per_query(spark, sf, _bm25(spark, sf, pad=True), "binary"))


def ir_metrics_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = _per_query(spark, sf, _bm25(spark, sf, pad=True))
    kind = F.concat(F.lit("type_"), F.pmod("query_id", F.lit(4)).cast("string"))
    return M.breakdown(rows.withColumn("query_type", kind), "query_type")


def abstain_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.abstain_counts(_bm25(spark, sf), I.judged_queries(spark, sf, I.relevance(spark, sf)))


def _runs(spark: SparkSession, sf: str, rel: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    rel = rel if rel is not None else I.relevance(spark, sf)
    return _per_query(spark, sf, _bm25(spark, sf), rel=rel), _per_query(spark, sf, _dense(spark, sf), rel=rel)


def metric_deltas(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _runs(spark, sf)
    runs = M.summarize(a).withColumn("run_label", F.lit("bm25")).unionByName(M.summarize(b).withColumn("run_label", F.lit("dense")))
    return M.deltas(runs, "bm25")


def paired_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.paired(*_runs(spark, sf))
    return rows.select("query_id", *(F.round(c, 6).alias(c) for c in rows.columns if c != "query_id"))


def metric_facts(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _runs(spark, sf)
    return M.long_facts(M.paired(a, b).select("query_id", "a_hit_5", "b_hit_5", "delta_hit_5"))


def hit_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rel = I.relevance(spark, sf)
    return M.hit_overlap(*_runs(spark, sf, rel), I.judged_queries(spark, sf, rel))


def overlap_summary(spark: SparkSession, sf: str) -> DataFrame:
    return M.overlap_summary(hit_overlap(spark, sf))


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    values = M.paired(*_runs(spark, sf)).select("query_id", F.col("delta_rr").alias("value"))
    return M.bootstrap_ci(values)


def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The interval of the mean value of purchases, among the table's events."""
    return M.bootstrap_interval(I.table(spark, sf, "events").filter("event_type = 'purchase'").select(F.round("value", 2).alias("value")))


def grain_coverage(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.documents(spark, sf)
    grains = docs.select("doc_id", F.concat("source", F.lit(":"), "lang").alias("parent_id"), F.col("source").alias("root_id"))
    rel = I.relevance(spark, sf)
    targets = rel.join(grains, "doc_id").select("query_id", "doc_id", "parent_id", "root_id")
    return M.grain_coverage(_bm25(spark, sf, 20), grains, targets, I.judged_queries(spark, sf, rel))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return M.latency_percentiles(I.table(spark, sf, "events"), "event_type", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        token_stats, document_frequencies, bm25_topk, bm25_zero_pad, dense_topk, hybrid_rrf, hybrid_weighted, rerank_scorer, context_boost, maxsim,
        tfidf_weights, svd_dense, encode_edits, qrels, ir_per_query, ir_metrics, ir_metrics_unique, ir_metrics_binary, ir_metrics_by_group, abstain_counts,
        metric_deltas, paired_metrics, metric_facts, hit_overlap, overlap_summary, bootstrap_ci, bootstrap_interval, grain_coverage, latency_percentiles,
    )
}

TOK = "list_transform(regexp_extract_all({}, '[0-9A-Za-z가-힣]+'), lambda x: lower(x))"
DOT = "list_dot_product({}::double[], {}::double[])"

BASE = f"""
toks as (select doc_id, {TOK.format("coalesce(text, '')")} as t from documents),
vocab as (select tok, count(*) as df from (select unnest(list_distinct(t)) as tok from toks) group by tok),
corpus as (select count(*) as n, avg(len(t)) as avgdl from toks),
raw_idf as (select tok, ln(n - df + 0.5) - ln(df + 0.5) as raw from vocab, corpus),
idf as (select tok, case when raw < 0 then 0.25 * (select avg(raw) from raw_idf) else raw end as idf from raw_idf),
qt as (select item_id as query_id, tok, count(*) as qtf from (select item_id, unnest({TOK.format("text")}) as tok from benchmark) group by all),
tf as (select doc_id, dl, tok, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as tok from toks) where tok in (select tok from qt) group by all),
scores as (select query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
  from qt join tf using (tok) join idf using (tok), corpus group by all),
bm as (select query_id, doc_id, round(score, 6) as score,
  cast(row_number() over (partition by query_id order by round(score, 8) desc, doc_id desc) as int) as rank from scores),
dv as (select e.vec_id as doc_id, embedding as v from embeddings e where vec_id in (select doc_id from documents)),
qv as (select e.vec_id as query_id, embedding as v from embeddings e where vec_id in (select item_id from benchmark)),
dsc as (select query_id, doc_id, {DOT.format("qv.v", "dv.v")} as score from qv, dv),
dn as (select query_id, doc_id, round(score, 6) as score,
  cast(row_number() over (partition by query_id order by round(score, 8) desc, doc_id desc) as int) as rank from dsc),
rel as (select b.item_id as query_id, d.doc_id, case when quality = 1 then 2 else 1 end as grade
  from benchmark b join documents d on contains(d.text, b.text) left join (select doc_id, max(quality) as quality from labels group by doc_id) l using (doc_id)),
jq as (select item_id as query_id, case when item_id in (select query_id from rel) then 'retrieve' else 'abstain' end as expected from benchmark),
short as (select item_id as query_id, coalesce(n, 0) as n from benchmark left join (select query_id, count(*) as n from bm where rank <= 5 group by 1) c on item_id = c.query_id
  where coalesce(n, 0) < 5),
pad as (select query_id, doc_id, 0.0::double as score, cast(n + row_number() over (partition by query_id order by doc_id desc) as int) as rank
  from short, (select doc_id from documents order by doc_id desc limit 10) l where not exists (select 1 from bm where bm.query_id = short.query_id and bm.doc_id = l.doc_id and bm.rank <= 5)),
full5 as (select * from bm where rank <= 5 union all select * from pad where rank <= 5)
"""


def per_query_sql(run: str, ideal: str = "rel", ndcg: str = "coalesce(dcg / nullif(idl, 0), 0)") -> str:
    """CTE text of per-query metrics of a run of five ranks."""
    return f"""(select query_id, coalesce(h1, 0)::double as hit_1, coalesce(h3, 0)::double as hit_3, coalesce(h5, 0)::double as hit_5, coalesce(1.0 / f, 0)::double as rr, {ndcg} as ndcg
from jq left join (select r.query_id, max(case when rank <= 1 and grade > 0 then 1 else 0 end) as h1, max(case when rank <= 3 and grade > 0 then 1 else 0 end) as h3,
  max(case when rank <= 5 and grade > 0 then 1 else 0 end) as h5, min(case when grade > 0 then rank end) as f,
  sum(case when grade > 0 then (pow(2.0, grade) - 1) / log2(rank + 1) else 0 end) as dcg from (select * from {run} where rank <= 5) r left join rel using (query_id, doc_id) group by 1) m using (query_id)
left join (select query_id, sum((pow(2.0, grade) - 1) / log2(place + 1)) as idl from
  (select *, row_number() over (partition by query_id order by grade desc, doc_id) as place from {ideal}) where place <= 5 group by 1) i using (query_id)
where expected = 'retrieve')"""


MEANS = "round(coalesce(avg(hit_1), 0), 6) as recall_1, round(coalesce(avg(hit_3), 0), 6) as recall_3, round(coalesce(avg(hit_5), 0), 6) as recall_5, round(coalesce(avg(rr), 0), 6) as mrr, round(coalesce(avg(ndcg), 0), 6) as ndcg_5"
PQ = per_query_sql("full5")
A, B = per_query_sql("bm"), per_query_sql("dn")
METRICS = ("hit_1", "hit_3", "hit_5", "rr", "ndcg")
FUSE = "row_number() over (partition by query_id order by score desc, least(coalesce(ar, 51), coalesce(br, 51)), coalesce(ar, 51), coalesce(br, 51), doc_id)"


def _fused(score: str, a: str, b: str) -> str:
    return f"""with {BASE} select query_id, doc_id, score, rank from (select *, cast({FUSE} as int) as rank from (select coalesce(a.query_id, b.query_id) as query_id,
coalesce(a.doc_id, b.doc_id) as doc_id, a.rank as ar, b.rank as br, round({score}, 6) as score
from {a} a full join {b} b on a.query_id = b.query_id and a.doc_id = b.doc_id)) where rank <= 5"""


def _scaled(run: str) -> str:
    return f"""(select query_id, doc_id, rank, case when hi = lo then case when hi > 0 then 1.0 else 0.0 end else round((score - lo) / nullif(hi - lo, 0), 6) end as score
from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from {run} where rank <= 50))"""


_QTOK, _DTOK = TOK.format("b.text"), TOK.format("substr(d.text, 1, 1800)")
_HITS = lambda terms: " + ".join(f"contains(lower(d.text), '{t}')::int" for t in terms)

ORACLES: dict[str, str] = {
    "token_stats": f"select doc_id, cast(len(t) as bigint) as n_tokens, cast(len(list_distinct(t)) as bigint) as n_distinct from (select doc_id, {TOK.format('text')} as t from documents)",
    "document_frequencies": f"with {BASE} select tok as token, df from vocab",
    "bm25_topk": f"with {BASE} select * from bm where rank <= 5",
    "bm25_zero_pad": f"with {BASE} select * from full5",
    "dense_topk": f"""select query_id, doc_id, round(score, 6) as score, rank from (select *, cast(row_number() over (partition by query_id order by round(score, 8) desc, doc_id desc) as int) as rank
from (select q.vec_id as query_id, d.vec_id as doc_id, {DOT.format('q.embedding', 'd.embedding')} as score from embeddings q, embeddings d where q.vec_id % 100 = 0)) where rank <= 5""",
    "hybrid_rrf": _fused("coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0)", "(select * from bm where rank <= 50)", "(select * from dn where rank <= 50)"),
    "hybrid_weighted": _fused("0.5 * coalesce(a.score, 0) + 0.5 * coalesce(b.score, 0) + 1e-10", _scaled("bm"), _scaled("dn")),
    "rerank_scorer": f"""with {BASE} select query_id, doc_id, round(score, 6) as score, base_rank, rank from (select *, cast(row_number() over (partition by query_id order by score desc, base_rank, doc_id) as int) as rank
from (select query_id, bm.doc_id, bm.rank as base_rank, len(list_intersect(list_distinct({_QTOK}), {_DTOK})) / len(list_distinct({_QTOK}))::double as score
from bm join benchmark b on b.item_id = query_id join documents d on d.doc_id = bm.doc_id where bm.rank <= 30)) where rank <= 5""",
    "context_boost": f"""with {BASE} select query_id, doc_id, score, base_rank, rank from (select *, cast(row_number() over (partition by query_id order by score desc, base_rank, doc_id) as int) as rank
from (select query_id, bm.doc_id, bm.rank as base_rank, round(bm.score + least(0.05::double * ({_HITS(PLACES)}), 0.10::double) + least(0.02::double * ({_HITS(STORY)}), 0.06::double), 6) as score
from bm join documents d on d.doc_id = bm.doc_id where bm.rank <= 20)) where rank <= 5""",
    "maxsim": f"""with top as (select query_id, doc_id, rank as base_rank from (select *, row_number() over (partition by query_id order by round(score, 8) desc, doc_id desc) as rank
from (select q.vec_id as query_id, d.vec_id as doc_id, {DOT.format('q.embedding', 'd.embedding')} as score from embeddings q, embeddings d where q.vec_id % 100 = 0)) where rank <= 5),
s as (select query_id, doc_id, base_rank, i, max({DOT.format('q.embedding[i * 16 + 1 : i * 16 + 16]', 'd.embedding[j * 16 + 1 : j * 16 + 16]')}) as best from top join embeddings q on q.vec_id = query_id
join embeddings d on d.vec_id = doc_id, range(4) a(i), range(4) b(j) group by all),
m as (select query_id, doc_id, base_rank, sum(best) / 4 as score from s group by all)
select query_id, doc_id, round(score, 6) as score, cast(base_rank as int) as base_rank, cast(row_number() over (partition by query_id order by round(score, 8) desc, base_rank, doc_id) as int) as rank from m""",
    "tfidf_weights": f"""with t as (select doc_id, {TOK.format('text')} as t from documents),
c as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from t union all select doc_id, t[i] || ' ' || t[i + 1] from (select doc_id, t, unnest(range(1, len(t))) as i from t)) group by all),
v as (select term, count(*) as df from c group by term order by sum(tf) desc, term limit 50000), n as (select count(*) as n from documents),
r as (select doc_id, term, tf * (ln((1 + n) / (1 + df)::double) + 1) as raw from c join v using (term), n), w as (select doc_id, raw / sqrt(sum(raw * raw) over (partition by doc_id)) as weight from r)
select doc_id, count(*) as n_terms, round(max(weight), 6) as max_weight, round(sum(weight), 4) as sum_weight from w group by doc_id""",
    "encode_edits": f"""with f as (select text from documents where doc_id % 25 <> 4),
s as (select doc_id, case when doc_id % 10 = 0 then text || ' (edited)' when doc_id % 10 = 1 then 'the same' else text end as text from documents where doc_id % 25 <> 3),
w as (select doc_id, ('0x' || substr(md5(unnest({TOK.format("'passage: ' || text")})), 1, 8))::bigint as h from s),
c as (select doc_id, h % 64 as place, sum(1 - 2 * (h // 64 % 2)) as n from w group by all having sum(1 - 2 * (h // 64 % 2)) <> 0),
g as (select doc_id, string_agg(place || case when n > 0 then '+' else '-' end, ',' order by place) as signs from c group by doc_id)
select doc_id, coalesce(s.text not in (select text from f), true) as fresh, coalesce(signs, '') as signs, signs is not null as unit from s left join g using (doc_id)""",
    "qrels": f"with {BASE} select query_id, doc_id, grade from rel",
    "ir_per_query": f"with {BASE} select query_id, hit_1, hit_3, hit_5, round(rr, 6) as rr, round(ndcg, 6) as ndcg, ndcg > 1 as overflow from {PQ}",
    "ir_metrics": f"with {BASE} select count(*) as n_queries, {MEANS} from {PQ}",
    "ir_metrics_unique": f"with {BASE} select count(*) as n_queries, {MEANS} from {per_query_sql('full5', '(select query_id, doc_id, max(grade) as grade from rel group by all)')}",
    "ir_metrics_binary": f"with {BASE} select count(*) as n_queries, {MEANS} from {per_query_sql('full5', ndcg='case when f <= 5 then 1.0 / log2(f + 1.0) else 0.0 end')}",
    "ir_metrics_by_group": f"""with {BASE} select coalesce(query_type, 'all') as query_type, count(*) as n_queries, {MEANS} from (select *, 'type_' || (query_id % 4) as query_type from {PQ})
group by grouping sets ((query_type), ())""",
    "abstain_counts": f"""with {BASE} select sum(case when expected = 'retrieve' and f is null then 1 else 0 end)::bigint as missing_count, sum(case when expected = 'abstain' and f then 1 else 0 end)::bigint as abstain_with_candidate_count
from jq left join (select distinct query_id, true as f from bm) using (query_id)""",
    "metric_deltas": f"""with {BASE}, r as (select 'bm25' as run_label, {MEANS} from {A} union all select 'dense', {MEANS} from {B})
select r.run_label, {', '.join(f'round(r.{m} - b.{m}, 6) as delta_{m}' for m in ('recall_1', 'recall_3', 'recall_5', 'mrr', 'ndcg_5'))} from r, (select * from r where run_label = 'bm25') b""",
    "paired_metrics": f"""with {BASE} select query_id, {', '.join(f'round(a.{m}, 6) as a_{m}, round(b.{m}, 6) as b_{m}, round(b.{m} - a.{m}, 6) as delta_{m}' for m in METRICS)} from {A} a join {B} b using (query_id)""",
    "metric_facts": f"""with {BASE}, p as (select query_id, a.hit_5 as a, b.hit_5 as b from {A} a join {B} b using (query_id))
select query_id, 'a_hit_5' as metric, a as value from p union all select query_id, 'b_hit_5', b from p union all select query_id, 'delta_hit_5', b - a from p""",
    "hit_overlap": f"""with {BASE} select query_id, case when expected = 'abstain' then 'abstain' when a.hit_5 > 0 and b.hit_5 > 0 then 'both_hit' when a.hit_5 > 0 then 'bm25_only' when b.hit_5 > 0 then 'dense_only' else 'both_fail' end as hit_group
from jq left join {A} a using (query_id) left join {B} b using (query_id)""",
    "overlap_summary": f"""with {BASE}, g as (select case when expected = 'abstain' then 'abstain' when a.hit_5 > 0 and b.hit_5 > 0 then 'both_hit' when a.hit_5 > 0 then 'bm25_only' when b.hit_5 > 0 then 'dense_only' else 'both_fail' end as g
from jq left join {A} a using (query_id) left join {B} b using (query_id))
select {', '.join(f"count(*) filter (g = '{x}') as {x}" for x in ('both_hit', 'both_fail', 'abstain', 'bm25_only', 'dense_only'))}, count(*) filter (g <> 'abstain') as answerable,
round(coalesce(count(*) filter (g in ('both_hit', 'bm25_only', 'dense_only')) / nullif(count(*) filter (g <> 'abstain'), 0)::double, 0), 6) as oracle_union_recall from g""",
    "bootstrap_ci": f"""with {BASE}, v as (select query_id, round(b.rr - a.rr, 6) as value from {A} a join {B} b using (query_id)),
l as (select value, row_number() over (order by value, query_id) - 1 as place from v), n as (select count(*) as n from v),
d as (select i, ((((((i * 7919 + j * 104729 + 42) % 2147483648) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648) // 65536 % n as place from range(10000) a(i), n, range((select n from n)) b(j)),
m as (select i, avg(value) as m from d join l using (place) group by i)
select round(avg(value), 6) as mean, count(*) as n, (select round(quantile_cont(m, 0.025), 6) from m) as ci_low, (select round(quantile_cont(m, 0.975), 6) from m) as ci_high from v""",
    "grain_coverage": f"""with {BASE}, g as (select doc_id, source || ':' || lang as parent_id, source as root_id from documents),
t as (select distinct query_id, doc_id, parent_id, root_id from rel join g using (doc_id)), h as (select query_id, doc_id, parent_id, root_id, rank from bm join g using (doc_id) where rank <= 20),
c as (select query_id, min(rank) as child_rank from h join t using (query_id, doc_id) group by 1), p as (select h.query_id, min(rank) as parent_rank from h join t on h.query_id = t.query_id and h.parent_id = t.parent_id group by 1),
r as (select h.query_id, min(rank) as doc_rank from h join t on h.query_id = t.query_id and h.root_id = t.root_id group by 1)
select query_id, child_rank, parent_rank, doc_rank, array_to_string(list_filter([case when child_rank is null then 'child_miss' end, case when parent_rank is null then 'parent_miss' end, case when doc_rank is null then 'doc_miss' end,
case when child_rank > 1 then 'late_child' end, case when doc_rank is not null and parent_rank is null then 'doc_only' end], lambda x: x is not null), ',') as tags
from jq left join c using (query_id) left join p using (query_id) left join r using (query_id) where expected = 'retrieve'""",
    "latency_percentiles": """select event_type, count(*) as n, round(list_sort(list(value))[cast(round_even((count(*) - 1) * 0.5, 0) as int) + 1], 6) as p50_nearest,
round(list_sort(list(value))[cast(round_even((count(*) - 1) * 0.95, 0) as int) + 1], 6) as p95_nearest, round(quantile_cont(value, 0.5), 6) as p50_linear, round(quantile_cont(value, 0.95), 6) as p95_linear from events group by event_type""",
}
