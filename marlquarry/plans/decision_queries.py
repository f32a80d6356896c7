"""Queries on gates, decisions and comparisons, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlquarry.functions.lineage import written
from marlquarry.operators import decisions as D
from marlquarry.operators import evidence as E
from marlquarry.operators import metrics as M
from marlquarry.operators import quality as Q
from marlquarry.operators import routing as R
from marlquarry.plans import doc_queries as Doc
from marlquarry.plans import inputs as I
from marlquarry.plans import rank_queries as K
from marlquarry.plans.doc_oracles import CLASSIFIED, FLAG, GUARDED, ORACLES as DOC, PACK0, TURNS
from marlquarry.plans.rank_queries import A, B, BASE, MEANS, ORACLES as RANK, _fused, _scaled, per_query_sql


def overlap_decision(spark: SparkSession, sf: str) -> DataFrame:
    return D.overlap_decision(K.overlap_summary(spark, sf)).select("oracle_union_recall", "decision")


def locked_decision(spark: SparkSession, sf: str) -> DataFrame:
    """The paired run as it is, with a slower tail, and with each of the counters that stop it."""
    from functools import reduce

    cases = spark.range(7).select(F.when(F.col("id") == 1, 51.0).otherwise(50.0).alias("p95_delta_ms"), *((F.col("id") == k + 2).cast("int").alias(c) for k, c in enumerate(D.STOPS)))
    row = K.bootstrap_ci(spark, sf).select("mean", "ci_low", "ci_high")
    runs = [row, row.selectExpr("abs(mean) + 1 as mean", "abs(ci_low) + 0.5 as ci_low", "abs(ci_high) + 2 as ci_high"), row.selectExpr("-1 - abs(mean) as mean", "-2 - abs(ci_low) as ci_low", "-0.5 - abs(ci_high) as ci_high")]
    rows = reduce(DataFrame.unionByName, (r.withColumn("shift", F.lit(k)) for k, r in enumerate(runs)))
    made = D.locked_decision(rows.join(F.broadcast(cases)))
    return made.select("shift", F.expr("concat_ws('', %s)" % ", ".join(D.STOPS)).alias("stops"), "p95_delta_ms", "interval_tag", "decision")


#: What is asked with a passage, by its number modulo five.
ASKS = ("두 사건의 관계와 갈등은 어떻게 이어졌나요?", "이 일대의 관계 전체 요약", "이 관계의 배경", "이 전각의 이름", "오늘 예약")


def _shadow_rows(spark: SparkSession, sf: str) -> DataFrame:
    from marlquarry.plans import methods

    rel = I.relevance(spark, sf)
    queries = I.judged_queries(spark, sf, rel)
    ask = F.element_at(F.array(*(F.lit(a) for a in ASKS)), (F.pmod("query_id", F.lit(5)) + 1).cast("int"))
    asked = queries.select("query_id", ask.alias("query_text"), F.lit(2).alias("n_places"), F.lit(False).alias("has_context"))
    kind = F.when(F.pmod("query_id", F.lit(5)).isin(0, 2), "relationship").when(F.pmod("query_id", F.lit(11)) == 0, "overview").otherwise("place_fact")
    typed = R.guard(R.classify(asked)).select("query_id", kind.alias("query_type"), "predicted", "guarded", "guard_applied")
    x = methods.Inputs(I.documents(spark, sf), queries, I.doc_vectors(spark, sf), I.query_vectors(spark, sf))
    return methods.shadow_rows(x, rel, typed)


def shadow_run(spark: SparkSession, sf: str) -> DataFrame:
    return _shadow_rows(spark, sf)


def shadow_summary(spark: SparkSession, sf: str) -> DataFrame:
    from marlquarry.plans import methods

    return methods.shadow_summary(_shadow_rows(spark, sf))


def shadow_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Each query type's deltas as those of a shadow run."""
    rows = type_deltas(spark, sf).select("query_type", "n", "delta")
    cases = spark.range(6).select("id", F.when(F.col("id") == 0, 1).otherwise(0).alias("false_route_count"), F.when(F.col("id") == 1, 50.5).otherwise(12.0).alias("p95_delta_ms"))
    rows = rows.join(F.broadcast(cases)).withColumn("relationship_recall_delta", F.when(F.col("id") == 2, F.lit(None)).otherwise(F.col("delta") + F.col("id") / 10))
    rows = rows.withColumn("mrr_delta", F.coalesce("delta", F.lit(0.0)) + 0.05).withColumn("ndcg_delta", F.when(F.col("id") == 4, -0.02).otherwise(F.lit(-0.01)))
    return D.shadow_decision(rows).select("query_type", "id", "decision")


def type_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.M.paired(*K._runs(spark, sf)).withColumn("query_type", F.concat(F.lit("type_"), F.pmod("query_id", F.lit(4)).cast("string")))
    types = spark.createDataFrame([(f"type_{i}",) for i in range(5)], "query_type string")
    return D.type_deltas(rows, types, "rr")


def rank_movement(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (r.select("query_id", "doc_id", F.col("rank").alias(n)) for r, n in ((K._bm25(spark, sf), "a"), (K.hybrid_rrf(spark, sf), "b")))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    return both.groupBy(D.rank_movement(F.col("a"), F.col("b")).alias("movement")).agg(F.count("*").alias("n"))


def _guarded(spark: SparkSession, sf: str) -> DataFrame:
    expected = F.when(F.pmod("query_id", F.lit(2)) == 0, "relationship").otherwise("place_fact")
    return R.guard(R.classify(Doc._turns(spark, sf))).withColumn("expected", expected)


def guard_effect(spark: SparkSession, sf: str) -> DataFrame:
    return D.guard_effect(_guarded(spark, sf))


def failure_tags(spark: SparkSession, sf: str) -> DataFrame:
    return R.failure_tags(_guarded(spark, sf))


def failure_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.failure_summary(failure_tags(spark, sf))


def score_margins(spark: SparkSession, sf: str) -> DataFrame:
    return D.runner_up(R.classify(Doc._turns(spark, sf)), R.TYPES)


def answer_contract(spark: SparkSession, sf: str) -> DataFrame:
    ranked, corpus, _, queries = Doc._evidence(spark, sf)
    drafts = queries.select("query_id", F.lit("an answer").alias("answer"), F.when(F.pmod("query_id", F.lit(2)) == 0, F.array(F.lit(2), F.lit(9))).alias("selected"))
    made = D.answer_contract(Q.assemble_answers(E.pack(ranked, corpus, E.POLICIES[0]), drafts))
    return made.withColumn("failures", F.array_join("failures", ","))


def evidence_movement(spark: SparkSession, sf: str) -> DataFrame:
    ranked, corpus, targets, queries = Doc._evidence(spark, sf)
    state = F.when(F.col("child_covered") | F.col("parent_covered"), "direct").when(F.col("doc_covered"), "doc_only").otherwise("miss")
    side = lambda p, n: E.pack_metrics(E.pack(ranked, corpus, p), targets, queries).select("query_id", state.alias(f"{n}_state"), F.when(F.col("order_proxy") > 0, F.round(1 / F.nullif("order_proxy", F.lit(0.0)))).alias(f"{n}_first"))
    return D.evidence_movement(side(E.POLICIES[0], "a").join(side(E.POLICIES[4], "b"), "query_id"))


def request_reuse(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (r.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("ids")).withColumn("run_label", F.lit(n)) for r, n in ((K._bm25(spark, sf), "a"), (K.hybrid_rrf(spark, sf), "b")))
    return Q.reuse_by_fingerprint(a.unionByName(b), ["ids"])


def prompt_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts that choose evidence of real packs by the number of their query."""
    ranked, corpus, _, queries = Doc._evidence(spark, sf)
    of = lambda n: F.pmod("query_id", F.lit(n))
    kinds = F.array(*(F.lit(t) for t in ("place_fact", "place_story", "relationship", "overview", "route_context", "voice_followup")))
    abstains = F.col("expected") == "abstain"
    ranks = F.when(of(3) == 0, F.array(F.lit(1))).when(of(3) == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(9)))
    drafts = queries.select(
        "query_id", F.when(abstains, "no_answer").otherwise(F.element_at(kinds, (of(6) + 1).cast("int"))).alias("query_type"), "expected", F.when(of(4) == 1, Q.ROUTER).otherwise("v2_balanced").alias("policy_id"),
        F.when(abstains, of(13) == 0).otherwise(of(11) != 0).alias("has_draft"), ranks.alias("ranks"), F.when(of(2) == 0, "multi_evidence").alias("coverage_intent"), F.when(of(5) == 0, "high").otherwise("low").alias("risk"),
    )
    return Q.prompt_policy(drafts, E.pack(ranked, corpus, E.POLICIES[0]))


def prompt_policy_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Q.prompt_policy_summary(prompt_policy(spark, sf))


def policy_floor(spark: SparkSession, sf: str) -> DataFrame:
    ranked, corpus, _, queries = Doc._evidence(spark, sf)
    n = E.pack(ranked, corpus, E.POLICIES[0]).groupBy("query_id").agg(F.count("*").alias("n_evidence"))
    packs = queries.select("query_id", "query_type").join(n, "query_id", "left").fillna(0, ["n_evidence"])
    return Q.policy_floor(packs, spark.createDataFrame([("place_fact", 2)], "query_type string, floor int"))


def expected_behaviour(spark: SparkSession, sf: str) -> DataFrame:
    ranked, corpus, _, queries = Doc._evidence(spark, sf)
    found = E.pack(ranked, corpus, E.POLICIES[0]).select("query_id").distinct().withColumn("f", F.lit(True))
    rows = queries.join(found, "query_id", "left").withColumn("abstained", F.col("f").isNull())
    return D.expected_behaviour(rows).groupBy("behaviour").agg(F.count("*").alias("n"))


def method_comparison(spark: SparkSession, sf: str) -> DataFrame:
    from marlquarry.plans import methods

    rel = I.relevance(spark, sf)
    x = methods.Inputs(I.documents(spark, sf), I.judged_queries(spark, sf, rel), I.doc_vectors(spark, sf), I.query_vectors(spark, sf))
    return methods.compare(x, rel, ["bm25", "dense", "hybrid_rrf"])


def strategy_summary(spark: SparkSession, sf: str) -> DataFrame:
    rel = I.relevance(spark, sf)
    asked = I.judged_queries(spark, sf, rel)
    grains = Doc._grains(spark, sf)
    targets = rel.join(grains, "doc_id").select("query_id", "doc_id", "parent_id", "root_id")
    # The fused list begins from both others, of which each is worked out once; 20 ranks are the longer lists' beginning.
    lexical, dense = written(K._bm25(spark, sf, K.CANDIDATES), "lexical-list"), written(K._dense(spark, sf, K.CANDIDATES), "dense-list")
    made = None
    for name, ranked, ms in (("bm25", lexical.filter("rank <= 20"), 20.0), ("dense", dense.filter("rank <= 20"), 30.0), ("hybrid_rrf", K.R.fuse_rrf(lexical, dense, K.K), 130.0)):
        own = M.grain_coverage(ranked, grains, targets, asked).join(M.per_query(ranked, rel, asked).select("query_id", "rr", "ndcg"), "query_id")
        own = own.withColumns({"strategy_id": F.lit(name), "latency_ms": F.lit(ms), "hard_case": F.contains("tags", F.lit("child_miss"))})
        made = own if made is None else made.unionByName(own)
    return D.strategy_summary(made)


def strategy_choice(spark: SparkSession, sf: str) -> DataFrame:
    return D.select_strategy(strategy_summary(spark, sf), "bm25")


def hard_case_causes(spark: SparkSession, sf: str) -> DataFrame:
    ranked, corpus, targets, queries = Doc._evidence(spark, sf)
    rows = E.pack_metrics(E.pack(ranked, corpus, E.POLICIES[0]), targets, queries).join(queries.select("query_id", "query_type"), "query_id")
    first = F.when(F.col("order_proxy") > 0, F.round(1 / F.col("order_proxy")).cast("int"))
    rows = rows.withColumns({"pack_rank": first, "retrieval_rank": first, "recoverable": F.lit(True), "rewritten": F.col("query_type") == "voice_followup"})
    rows = rows.withColumns({"correctness_regression": F.col("duplicate_parent_rate") > 0.3, "unsupported_regression": F.col("n_items") < 3})
    lacking = F.when(F.col("n_items") > 0, F.col("n_items") - 4)
    return D.hard_case_causes(rows.withColumns({"citation_count": lacking, "citation_precision": F.col("duplicate_doc_rate") * -1, "citation_recall": F.lit(None).cast("double")}))


def corpus_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return D.fingerprints(I.passages(spark, sf), I.documents(spark, sf).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        overlap_decision, locked_decision, shadow_run, shadow_summary, shadow_decision, type_deltas, rank_movement, guard_effect, failure_tags, failure_summary, score_margins, answer_contract, evidence_movement,
        request_reuse, policy_floor, prompt_policy, prompt_policy_summary, expected_behaviour, method_comparison, strategy_summary, strategy_choice, hard_case_causes, corpus_fingerprint,
    )
}

RRF = RANK["hybrid_rrf"].removeprefix(f"with {BASE} ")
_EXPECTED = "case when query_id % 2 = 0 then 'relationship' else 'place_fact' end"
_TAGS = FLAG(
    wrong_type="e <> predicted",
    false_hybrid="predicted = 'relationship' and e <> 'relationship'",
    missed_hybrid="predicted <> 'relationship' and e = 'relationship'",
    false_abstain="predicted = 'no_answer' and e <> 'no_answer'",
    missed_abstain="predicted <> 'no_answer' and e = 'no_answer'",
    low_confidence="confidence < 0.6",
    fallback="fallback_used",
)
_FT = f"with {GUARDED}, ft as (select query_id, {_TAGS} as tags from (select *, {_EXPECTED} as e from gy))"

ORACLES: dict[str, str] = {
    "overlap_decision": f"""with o as ({RANK["overlap_summary"]}) select oracle_union_recall, case when dense_only > 0 and round(oracle_union_recall - coalesce((both_hit + bm25_only) / nullif(answerable, 0)::double, 0), 6) > 0 then 'proceed_to_hybrid_rrf' else 'stop_d0_hybrid' end as decision from o""",
    "locked_decision": f"""with o as ({RANK["bootstrap_ci"]}), r as (select 0 as shift, mean, ci_low, ci_high from o union all select 1, abs(mean) + 1, abs(ci_low) + 0.5, abs(ci_high) + 2 from o union all select 2, -1 - abs(mean), -2 - abs(ci_low), -0.5 - abs(ci_high) from o),
c as (select i, case when i = 1 then 51.0 else 50.0 end::double as p95_delta_ms, case when i < 2 then '00000' else repeat('0', i::int - 2) || '1' || repeat('0', 6 - i::int) end as stops from range(7) t(i))
select shift, stops, p95_delta_ms, case when mean > 0 and ci_low > 0 then 'positive_ci_excludes_zero' when mean < 0 and ci_high < 0 then 'negative_ci_excludes_zero' else 'ci_includes_zero' end as interval_tag,
case when i >= 2 then 'blocked_by_stop_condition' when mean > 0 and ci_low > 0 and p95_delta_ms <= 50 then 'support_relationship_route_candidate' else 'keep_shadow_without_locked_improvement_claim' end as decision from r, c""",
    "type_deltas": f"""with {BASE}, p as (select 'type_' || (query_id % 4) as query_type, a.rr as x, b.rr as y from {A} a join {B} b using (query_id)), t as (select 'type_' || i as query_type from range(5) r(i)),
o as (select query_type, count(*) as n, round(avg(x), 6) as a, round(avg(y), 6) as b, round(avg(y - x), 6) as delta from p group by 1) select query_type, coalesce(n, 0) as n, a, b, delta from t left join o using (query_type)""",
    "rank_movement": f"""with {BASE}, a as (select query_id, doc_id, rank as a from bm where rank <= 5), b as (select query_id, doc_id, rank as b from ({RRF})), m as (select a, b from a full join b using (query_id, doc_id))
select case when a is null then 'new' when b is null then 'lost' when b < a then 'up' when b > a then 'down' else 'same' end as movement, count(*) as n from m group by 1""",
    "guard_effect": f"""with {GUARDED}, r as (select {_EXPECTED} as e, predicted as p, guarded as g from gy)
select count(*) as n, round(avg((e = p)::int), 6) as accuracy_before, round(avg((e = g)::int), 6) as accuracy_after, count(*) filter (p = 'relationship' and e <> 'relationship') as false_hybrid_before,
count(*) filter (g = 'relationship' and e <> 'relationship') as false_hybrid_after, count(*) filter (e = 'no_answer' and p = 'no_answer' and g <> 'no_answer') as no_answer_regression from r""",
    "failure_tags": f"{_FT} select query_id, tags from ft",
    "failure_summary": f"{_FT} select tag, count(*) as n from (select unnest(case when tags = '' then ['none'] else string_split(tags, ',') end) as tag from ft) group by 1",
    "score_margins": f"with {CLASSIFIED} select query_id, o[1].t as first, o[2].t as second, round(o[2].neg - o[1].neg, 6) as margin from cls",
    "answer_contract": f"""{PACK0}, s as (select query_id, (select count(*) from packed p where p.query_id = eq.query_id) as n, (select count(*) from packed p where p.query_id = eq.query_id and pack_rank in (2, 9)) as c from eq),
t as (select n = 0 as ab, case when query_id % 2 = 0 then c else n end as cited, case when query_id % 2 = 0 then 2 - c else 0 end as unknown from s),
m as (select count(*) as answer_count, count(*) filter (ab) as abstain_count, count(*) filter (not ab and cited = 0) as uncited_answer_count, count(*) filter (ab and cited > 0) as cited_abstention_count, sum(unknown)::bigint as unknown_citation_count from t)
select *, {FLAG(uncited_answer_count='uncited_answer_count > 0', cited_abstention_count='cited_abstention_count > 0', unknown_citation_count='unknown_citation_count > 0')} as failures,
(uncited_answer_count = 0 and cited_abstention_count = 0 and unknown_citation_count = 0) as passed from m""",
    "request_reuse": f"""with {BASE}, a as (select query_id, string_agg(doc_id::varchar, ',' order by rank) as ids from bm where rank <= 5 group by 1), b as (select query_id, string_agg(doc_id::varchar, ',' order by rank) as ids from ({RRF}) group by 1)
select query_id, 'a' as run_label, false as reused from a union all select b.query_id, 'b', coalesce(a.ids = b.ids, false) from b left join a using (query_id)""",
    "policy_floor": f"""{PACK0}, n as (select query_id, query_type, (select count(*) from packed p where p.query_id = eq.query_id) as n_evidence from eq) select query_id, query_type, n_evidence, n_evidence >= case when query_type = 'place_fact' then 2 else 0 end as floor_met from n""",
    "expected_behaviour": f"""{PACK0}, n as (select expected, not exists (select 1 from packed p where p.query_id = eq.query_id) as ab from eq)
select case when (expected = 'abstain') = ab then 'met' when ab then 'abstained_unexpectedly' else 'answered_unexpectedly' end as behaviour, count(*) as n from n group by 1""",
    "method_comparison": f"""with {BASE}, rf as ({RRF}) select 'bm25' as run_label, count(*) as n_queries, {MEANS} from {A} union all select 'dense', count(*), {MEANS} from {B} union all select 'hybrid_rrf', count(*), {MEANS} from {K.per_query_sql("rf")}""",
}

ORACLES["shadow_decision"] = f"""with d as ({ORACLES["type_deltas"]}), c as (select *, i as id, case when i = 2 then null else delta + i / 10 end as rel, coalesce(delta, 0) + 0.05 as mrr, case when i = 4 then -0.02 else -0.01 end as ndcg, case when i = 1 then 50.5 else 12 end as ms from d, range(6) t(i))
select query_type, id, case when id = 0 then 'reject_active_route_for_now' when rel is null or rel <= 0 or mrr < -0.01 or ndcg < -0.01 or ms > 50 then 'keep_shadow_only' else 'ready_for_active_route_dry_run_contract' end as decision from c"""

ORACLES["citation_summary"] = f"""with c as ({DOC["citation_eval"]}) select coalesce(expected, 'all') as expected, count(*) as n, round(avg(case when expected = 'retrieve' then citation_precision end), 6) as precision,
round(avg(case when expected = 'retrieve' then citation_recall end), 6) as recall, round(avg(abstention_correct::int), 6) as abstention_accuracy, count(*) filter (unsupported_claim) as unsupported_count from c group by grouping sets ((expected), ())"""


def _strategy(name: str, run: str, metrics: str, ms: float) -> str:
    least = lambda key, of: f"(select min(rank) from {run} x join g using (doc_id) join tg on tg.query_id = x.query_id and tg.{key} = g.{key} where x.query_id = jq.query_id and rank <= 20) as {of}"
    return f"select '{name}' as strategy_id, query_id, {least('doc_id', 'c')}, {least('parent_id', 'p')}, {least('root_id', 'd')}, rr, ndcg, {ms}::double as ms from jq join {metrics} using (query_id) where expected = 'retrieve'"


_STRATEGIES = f"""with {BASE}, rf as ({RRF}), g as (select doc_id, source || ':' || lang as parent_id, source as root_id from documents), tg as (select distinct query_id, doc_id, parent_id, root_id from rel join g using (doc_id)),
r as ({_strategy('bm25', 'bm', A, 20)} union all {_strategy('dense', 'dn', B, 30)} union all {_strategy('hybrid_rrf', 'rf', K.per_query_sql('rf'), 130)}),
w as (select *, coalesce(c <= 5, false) as ci, coalesce(p <= 5, false) as pi, coalesce(d <= 5, false) as di from r),
s as (select strategy_id, count(*) as n_queries, {', '.join(f"round(avg(coalesce({g[0]} <= {n}, false)::int), 6) as {g}_recall_{n}" for g in ('child', 'parent') for n in (1, 3, 5))}, round(avg(di::int), 6) as doc_recall_5, round(avg((ci or pi)::int), 6) as child_or_parent_recall,
count(*) filter (di and not ci and not pi) as doc_only_count, count(*) filter (not di and not ci and not pi) as full_miss_count, count(*) filter (c is null) as hard_case_count, round(avg(rr), 6) as mrr, round(avg(ndcg), 6) as ndcg_5, max(ms) as p95_ms from w group by 1)"""
ORACLES["strategy_summary"] = f"{_STRATEGIES} select * from s"
ORACLES["strategy_choice"] = f"""{_STRATEGIES}, a as (select * from s where strategy_id = 'bm25'), b as (select * from s where strategy_id <> 'bm25' order by child_or_parent_recall desc, doc_only_count, full_miss_count, mrr desc, ndcg_5 desc, p95_ms, strategy_id limit 1),
m as (select b.strategy_id as best_id, round(b.child_or_parent_recall - a.child_or_parent_recall, 6) as recall_delta, round(b.p95_ms - a.p95_ms, 6) as p95_delta, (b.doc_only_count < a.doc_only_count or b.full_miss_count < a.full_miss_count) as fewer, b.p95_ms - a.p95_ms <= greatest(100, a.p95_ms) as quick from a, b),
v as (select *, case when recall_delta > 0 and quick then 'adopt_candidate' when fewer and quick then 'needs_more_diagnosis' else 'reject_candidates' end as decision from m)
select best_id, case when decision = 'reject_candidates' then 'bm25' else best_id end as selected_id, recall_delta, p95_delta, decision from v"""
ORACLES["hard_case_causes"] = f"""with m as ({DOC["pack_metrics"]}), x as (select *, query_id % 3 = 0 as rw, case when order_proxy > 0 then round(1 / order_proxy)::int end as f, child_covered as c, parent_covered as p, doc_covered as d, duplicate_parent_rate > 0.3 as worse, n_items < 3 as few from m)
select query_id, case when c and p and d and (worse or few) then 'generation_contract_candidate' when not (c or p or d) then 'retrieval_or_packing_miss' when not c then 'target_grain_mismatch' else 'monitor_only' end as cause,
concat_ws(',', case when c then 'target_child_in_pack' end, case when p then 'target_parent_in_pack' end, case when d then 'target_doc_in_pack' end, 'target_retrieval_rank_' || f, 'target_pack_rank_' || f, 'citation_recoverable', case when rw then 'query_rewrite_changed' else 'query_rewrite_not_changed' end,
case when worse then 'generation_correctness_regression' end, case when few then 'generation_unsupported_regression' end, case when n_items between 1 and 3 then 'v2_citation_count_reduction' end, case when duplicate_doc_rate > 0 then 'v2_precision_regression' end) as tags from x"""

_ASKED = "(values " + ", ".join(f"({i}, '{a}')" for i, a in enumerate(ASKS)) + ") as v(i, ask)"
_SIDE = lambda n, run: f"{n} as (select jq.query_id, coalesce(hit_1, 0) as {n}_hit_1, coalesce(hit_3, 0) as {n}_hit_3, coalesce(hit_5, 0) as {n}_hit_5, round(coalesce(rr, 0), 6) as {n}_rr, round(coalesce(ndcg, 0), 6) as {n}_ndcg, case when rr > 0 then round(1 / rr)::int end as {n}_relevant_rank, (select count(*) from {run} r where r.query_id = jq.query_id and rank <= 5) as {n}_candidate_count from jq left join {per_query_sql(run)} m using (query_id))"
SHADOW = f"""with {BASE}, turns as (select query_id, ask as query_text, 2 as n_places, false as has_context, null as user_context from jq join {_ASKED} on i = query_id % 5),
{GUARDED.replace(TURNS + ', ', '')},
hy as ({_fused("0.5 * coalesce(a.score, 0) + 0.5 * coalesce(b.score, 0) + 1e-10", _scaled("bm"), _scaled("dn")).replace(f'with {BASE} ', '')}),
rt as (select query_id, expected, case when query_id % 5 in (0, 2) then 'relationship' when query_id % 11 = 0 then 'overview' else 'place_fact' end as query_type, predicted, guarded, guard_applied, expected = 'retrieve' and guarded = 'relationship' as candidate_route_applied from jq join gy using (query_id)),
br as (select query_id, doc_id, rank from dn where rank <= 5 and query_id in (select query_id from rt where expected = 'retrieve')),
sr as (select * from br where query_id not in (select query_id from rt where candidate_route_applied) union all select query_id, doc_id, rank from hy where query_id in (select query_id from rt where candidate_route_applied)),
{_SIDE('baseline', 'br')}, {_SIDE('shadow', 'sr')},
sh as (select rt.* exclude (guard_applied), baseline.* exclude (query_id), shadow.* exclude (query_id), case when predicted <> 'relationship' then 'not_applicable' when not guard_applied then 'allow' when guarded = 'relationship' then 'fallback' else 'block' end as guard_decision,
  case when expected <> 'retrieve' then 'no_answer_abstain' when candidate_route_applied then 'safe_relationship_shadow_route' when predicted = 'relationship' and guard_applied and guarded <> 'relationship' then 'blocked_by_relationship_guard' else 'fallback_to_default_route' end as decision_reason_tag,
  candidate_route_applied and query_type <> 'relationship' as false_hybrid_route, not candidate_route_applied and query_type = 'relationship' as missed_hybrid_route, expected <> 'retrieve' and shadow_candidate_count > 0 as no_answer_candidate_route
  from rt join baseline using (query_id) join shadow using (query_id))"""
ORACLES["shadow_run"] = f"{SHADOW} select * from sh"
_GAIN = lambda m, n, when="expected = 'retrieve'": f"round(round(coalesce(avg(shadow_{m}) filter ({when}), 0), 6) - round(coalesce(avg(baseline_{m}) filter ({when}), 0), 6), 6) as {n}_delta"
ORACLES["shadow_summary"] = f"""{SHADOW}, su as (select count(*) as query_count, count(*) filter (expected = 'retrieve') as answerable_query_count, count(*) filter (baseline_candidate_count > 0) as baseline_run_count, count(*) filter (shadow_candidate_count > 0) as shadow_run_count,
count(*) filter (candidate_route_applied) as routed_count, count(*) filter (decision_reason_tag = 'blocked_by_relationship_guard') as blocked_by_guard_count, count(*) filter (decision_reason_tag = 'fallback_to_default_route') as fallback_default_count,
count(*) filter (false_hybrid_route) as false_route_count, count(*) filter (missed_hybrid_route) as missed_route_count, count(*) filter (no_answer_candidate_route) as no_answer_candidate_route_count,
{_GAIN('hit_1', 'recall_1')}, {_GAIN('hit_3', 'recall_3')}, {_GAIN('hit_5', 'recall_5')}, {_GAIN('rr', 'mrr')}, {_GAIN('ndcg', 'ndcg')}, {_GAIN('hit_5', 'relationship_recall', "expected = 'retrieve' and query_type = 'relationship'")} from sh)
select *, case when false_route_count > 0 then 'reject_active_route_for_now' when relationship_recall_delta <= 0 or mrr_delta < -0.01 or ndcg_delta < -0.01 then 'keep_shadow_only' else 'ready_for_active_route_dry_run_contract' end as decision from su"""

ORACLES["prompt_policy"] = f"""{PACK0}, dr as (select query_id, expected = 'abstain' as ab, case when expected = 'abstain' then 'no_answer' else ['place_fact', 'place_story', 'relationship', 'overview', 'route_context', 'voice_followup'][(query_id % 6 + 1)::int] end as query_type,
  case when query_id % 4 = 1 then 'v2_repair_query_type_router' else 'v2_balanced' end as policy_id, case when expected = 'abstain' then query_id % 13 = 0 else query_id % 11 <> 0 end as dd, case when query_id % 3 = 0 then [1] when query_id % 3 = 1 then [1, 2] else [1, 9] end as ranks,
  query_id % 2 = 0 as multi, query_id % 5 <> 0 as low, (select count(distinct pack_rank) from packed p where p.query_id = eq.query_id) as av from eq),
dx as (select *, case query_type when 'place_fact' then 1 when 'route_context' then 1 when 'no_answer' then 0 else 2 end as mn, not ab and dd as ju from dr),
dy as (select *, case when ju then len(list_filter(ranks, lambda x: x > av)) else 0 end as bad, case when ju then len(ranks) else 0 end as sel from dx),
dz as (select *, case when ab then dd or av > 0 else not dd or sel < mn end as fl, ju and mn >= 2 and not multi as it, ju and policy_id = 'v2_repair_query_type_router' and query_type = 'place_story' as story from dy),
dw as (select *, case when ju then (fl or it) and low else not ab end as ri, case when ab then case when fl then 'fail' else 'pass' end when not dd or bad > 0 then 'fail' when story then 'fallback_required' when fl or it then case when query_type in ('place_story', 'relationship', 'voice_followup') then 'fallback_required' else 'fail' end else 'pass' end as status,
  {FLAG(unexpected_draft_for_abstain='ab and dd', abstain_with_evidence='ab and av > 0', no_answer_abstain_path='ab and not fl', missing_draft='not ab and not dd', invalid_evidence_rank='bad > 0', evidence_floor_violation='not ab and fl', coverage_intent_violation='it', unsupported_risk_too_low='ju and (fl or it) and low', v1_fallback_required='story', monitor_only_query_type='story')} as tags from dz)
select query_id, query_type, policy_id, status, sel::int as selected_count, mn as min_required, av::int as available_count, bad::int as invalid_rank_count, fl as evidence_floor_violation, it as coverage_intent_violation, ri as unsupported_risk_violation,
not ab and query_type in ('place_story', 'relationship', 'voice_followup') as fallback_allowed, case when tags = '' then 'policy_pass' else tags end as tags from dw"""
ORACLES["prompt_policy_summary"] = f"""select count(*) as row_count, count(distinct query_type) as query_type_count, count(distinct policy_id) as policy_count, count(*) filter (status = 'pass') as pass_count, count(*) filter (status = 'fallback_required') as fallback_required_count, count(*) filter (status = 'fail') as fail_count,
sum(invalid_rank_count)::bigint as invalid_rank_count, count(*) filter (evidence_floor_violation) as evidence_floor_violation_count, count(*) filter (coverage_intent_violation) as coverage_intent_violation_count, count(*) filter (unsupported_risk_violation) as unsupported_risk_violation_count,
count(*) filter (query_type = 'no_answer' and status = 'pass') as no_answer_pass_count, case when count(*) filter (status = 'fail') = 0 then 'ready_for_repaired_prompt_dry_run' else 'reject_repaired_prompt_policy' end as decision from ({ORACLES["prompt_policy"]})"""
