"""Named retrieval methods and experiments over several of them: one plan tagged by run_label."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlquarry.functions.lineage import written
from marlquarry.operators import decisions as D
from marlquarry.operators import graph as G
from marlquarry.operators import metrics as M
from marlquarry.operators import retrieval as R


@dataclass(frozen=True)
class Inputs:
    """docs: doc_id, text (group_id for trees); queries: query_id, query_text, expected. Vectors and generated texts are
    given as data, so encoders and language models stay outside."""

    docs: DataFrame
    queries: DataFrame
    doc_vectors: DataFrame | None = None
    query_vectors: DataFrame | None = None
    generated: DataFrame | None = None
    rewritten: DataFrame | None = None
    k: int = 5
    candidate_k: int = 50
    hints: tuple[str, ...] = ("because", "between", "both", "and")
    places: tuple[str, ...] = ()
    story: tuple[str, ...] = ()
    scorer: Callable = field(default=R.overlap_scorer)
    #: Lists of candidate_k that several methods begin from, where they are worked out already.
    lexical: DataFrame | None = None
    dense: DataFrame | None = None

    def answerable(self) -> DataFrame:
        """Queries that may be searched; the rest are left out before any scoring."""
        return self.queries.filter("coalesce(expected, 'retrieve') <> 'abstain'")


def _bm25(x: Inputs, k: int | None = None, queries: DataFrame | None = None) -> DataFrame:
    k = k or x.k
    if x.lexical is not None and queries is None and k <= x.candidate_k:
        return x.lexical.filter(F.col("rank") <= k)
    return R.bm25_topk(x.docs, queries if queries is not None else x.queries, k)


def _dense(x: Inputs, k: int | None = None) -> DataFrame:
    k = k or x.k
    if x.dense is not None and k <= x.candidate_k:
        return x.dense.filter(F.col("rank") <= k)
    return R.dense_topk(x.doc_vectors, x.query_vectors, k)


def _sides(x: Inputs) -> tuple[DataFrame, DataFrame]:
    return _bm25(x, x.candidate_k), _dense(x, x.candidate_k)


def _weighted(alpha: float) -> Callable[[Inputs], DataFrame]:
    return lambda x: R.fuse_weighted(*_sides(x), x.k, alpha, x.candidate_k)


METHODS: dict[str, Callable[[Inputs], DataFrame]] = {
    "bm25": _bm25,
    "bm25_padded": lambda x: R.bm25_topk(x.docs, x.queries, x.k, True),
    "dense": _dense,
    "hybrid_rrf": lambda x: R.fuse_rrf(*_sides(x), x.k, 60, x.candidate_k),
    "hybrid_weighted_03": _weighted(0.3),
    "hybrid_weighted_05": _weighted(0.5),
    "hybrid_weighted_07": _weighted(0.7),
    "rerank_bm25_20": lambda x: R.rerank(_bm25(x, 20), x.queries, x.docs, x.scorer, x.k),
    "rerank_bm25_30": lambda x: R.rerank(_bm25(x, 30), x.queries, x.docs, x.scorer, x.k),
    "rerank_bm25_50": lambda x: R.rerank(_bm25(x, 50), x.queries, x.docs, x.scorer, x.k),
    "rerank_hybrid_30": lambda x: R.rerank(R.fuse_weighted(*_sides(x), 30, 0.5, x.candidate_k), x.queries, x.docs, x.scorer, x.k),
    "context_boost": lambda x: R.context_boost(_bm25(x, 20), x.docs, x.places or ("",), x.story or ("",), x.k),
    "generated_bm25": lambda x: _bm25(x, queries=R.expand_query(x.answerable().withColumn("expected_behavior", F.col("expected")), x.generated)),
    "rewritten_bm25": lambda x: _bm25(x, queries=x.queries.drop("query_text").join(x.rewritten.select("query_id", F.col("rewritten").alias("query_text")), "query_id")),
    "graph_entity_path": lambda x: G.graph_rank(x.docs, x.queries, _bm25(x, 20), "entity_path", x.hints, x.k),
    "graph_community_hint": lambda x: G.graph_rank(x.docs, x.queries, _bm25(x, 20), "community_hint", x.hints, x.k),
    "tree_parent_summary": lambda x: G.tree_rank(x.docs, x.queries, _bm25(x, 20), "parent_summary", k=x.k),
    "tree_summary_node": lambda x: G.tree_rank(x.docs, x.queries, _bm25(x, 20), "summary_node", k=x.k),
}


#: Methods that don't begin from the lexical list of all queries, and those that begin from the dense one.
NO_LEXICAL = ("dense", "bm25_padded", "generated_bm25", "rewritten_bm25")
DENSE = ("dense", "hybrid_rrf", "hybrid_weighted_03", "hybrid_weighted_05", "hybrid_weighted_07", "rerank_hybrid_30")


def shared(x: Inputs, names: list[str]) -> Inputs:
    """x with the lists that more than one of the named methods begin from, each worked out once; a shorter list is a longer one's beginning."""
    k = x.candidate_k
    if x.lexical is None and sum(n not in NO_LEXICAL for n in names) > 1:
        x = replace(x, lexical=written(R.bm25_topk(x.docs, x.queries, k), "lexical-list"))
    if x.dense is None and sum(n in DENSE for n in names) > 1:
        x = replace(x, dense=written(R.dense_topk(x.doc_vectors, x.query_vectors, k), "dense-list"))
    return x


def run(inputs: Inputs, names: list[str]) -> DataFrame:
    """query_id, doc_id, score, rank and run_label of every named method."""
    made, inputs = None, shared(inputs, names)
    for name in names:
        own = METHODS[name](inputs).select("query_id", "doc_id", "score", "rank", F.lit(name).alias("run_label"))
        made = own if made is None else made.unionByName(own)
    return made


def compare(inputs: Inputs, qrels: DataFrame, names: list[str]) -> DataFrame:
    """Mean metrics of every named method."""
    made, inputs = None, shared(inputs, names)
    for name in names:
        own = M.summarize(M.per_query(METHODS[name](inputs), qrels, inputs.queries, inputs.k)).withColumn("run_label", F.lit(name))
        made = own if made is None else made.unionByName(own)
    return made


def only(x: Inputs, queries: DataFrame) -> Inputs:
    """x for queries (query_id) alone: the methods then score no others."""
    keep = queries.select("query_id")
    vectors = x.query_vectors.join(keep, "query_id", "left_semi") if x.query_vectors is not None else None
    return replace(x, queries=x.queries.join(keep, "query_id", "left_semi"), query_vectors=vectors, lexical=None, dense=None)


#: The method of each execution mode; to abstain is to have none.
MODES: dict[str, str] = {"dense": "dense", "hybrid_weighted": "hybrid_weighted_05"}


def routed(x: Inputs, routes: DataFrame) -> DataFrame:
    """Results of each query by the method of its execution mode (query_id, execution_mode); each method gets its own queries only, and
    one that no query takes doesn't run."""
    taken = {r[0] for r in routes.select("execution_mode").distinct().collect()}
    made = x.queries.sparkSession.createDataFrame([], f"query_id {x.queries.schema['query_id'].dataType.simpleString()}, doc_id {x.docs.schema['doc_id'].dataType.simpleString()}, score double, rank int")
    for mode, name in MODES.items():
        if mode not in taken:
            continue
        own = METHODS[name](only(x, routes.filter(F.col("execution_mode") == mode))).select("query_id", "doc_id", "score", "rank")
        made = made.unionByName(own)
    return made


#: The policy that is tried in the shadow of the default one.
CANDIDATE = "relationship"


def shadow_rows(x: Inputs, qrels: DataFrame, typed: DataFrame) -> DataFrame:
    """One row per query: how the default route and a shadow route fare, and whether the shadow's was the right one.

    x.queries: query_id, query_text, expected. typed: query_id, query_type (the true one), predicted, guarded, guard_applied. The default route
    is dense for all that expect an answer; the shadow takes queries that the guard leaves as relationships to weighted fusion, and has
    the default's results for the others, which are not searched again.
    """
    rows = x.queries.select("query_id", "expected").join(typed, "query_id")
    answered = F.col("expected") == "retrieve"
    candidate = answered & (F.col("guarded") == CANDIDATE)
    rows = written(rows.withColumn("candidate_route_applied", F.coalesce(candidate, F.lit(False))), "shadow-routes")
    base = written(routed(x, rows.filter(answered).select("query_id", F.lit("dense").alias("execution_mode"))), "shadow-base")
    tried = rows.filter("candidate_route_applied").select("query_id", F.lit("hybrid_weighted").alias("execution_mode"))
    shadow = base.join(tried.select("query_id"), "query_id", "left_anti").unionByName(routed(x, tried))

    def side(ranked: DataFrame, name: str) -> DataFrame:
        scored = M.per_query(ranked, qrels, x.queries, x.k)
        counts = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
        both = x.queries.select("query_id").join(scored, "query_id", "left").join(counts, "query_id", "left").fillna(0)
        first = F.when(F.col("rr") > 0, F.round(1 / F.col("rr")).cast("int"))
        metrics = (F.round(c, 6).alias(f"{name}_{c}") for c in ("hit_1", "hit_3", "hit_5", "rr", "ndcg"))
        return both.select("query_id", F.col("n").alias(f"{name}_candidate_count"), first.alias(f"{name}_relevant_rank"), *metrics)

    made = rows.join(side(base, "baseline"), "query_id").join(side(shadow, "shadow"), "query_id")
    relation = F.col("predicted") == CANDIDATE
    guard = F.when(~relation, "not_applicable").when(~F.col("guard_applied"), "allow").when(F.col("guarded") == CANDIDATE, "fallback").otherwise("block")
    tag = F.when(~answered, "no_answer_abstain").when(F.col("candidate_route_applied"), "safe_relationship_shadow_route").when(F.col("guard_decision") == "block", "blocked_by_relationship_guard")
    made = made.withColumn("guard_decision", guard)
    return made.withColumns(
        {
            "decision_reason_tag": tag.otherwise("fallback_to_default_route"),
            "false_hybrid_route": F.col("candidate_route_applied") & (F.col("query_type") != CANDIDATE),
            "missed_hybrid_route": ~F.col("candidate_route_applied") & (F.col("query_type") == CANDIDATE),
            "no_answer_candidate_route": ~answered & (F.col("shadow_candidate_count") > 0),
        }
    ).drop("guard_applied")


def shadow_summary(rows: DataFrame) -> DataFrame:
    """One row: counts of routes and guards, the shadow's gains in mean metrics, and the decision. The latency isn't measured here; pass 0."""
    answered = F.col("expected") == "retrieve"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    mean = lambda c, when=answered: F.round(F.coalesce(F.avg(F.when(when, F.col(c))), F.lit(0.0)), 6)
    gain = lambda m, when=answered: F.round(mean(f"shadow_{m}", when) - mean(f"baseline_{m}", when), 6)
    relation = answered & (F.col("query_type") == CANDIDATE)
    made = rows.agg(
        F.count("*").alias("query_count"),
        n(answered).alias("answerable_query_count"),
        n(F.col("baseline_candidate_count") > 0).alias("baseline_run_count"),
        n(F.col("shadow_candidate_count") > 0).alias("shadow_run_count"),
        n(F.col("candidate_route_applied")).alias("routed_count"),
        n(F.col("decision_reason_tag") == "blocked_by_relationship_guard").alias("blocked_by_guard_count"),
        n(F.col("decision_reason_tag") == "fallback_to_default_route").alias("fallback_default_count"),
        n(F.col("false_hybrid_route")).alias("false_route_count"),
        n(F.col("missed_hybrid_route")).alias("missed_route_count"),
        n(F.col("no_answer_candidate_route")).alias("no_answer_candidate_route_count"),
        *(gain(m).alias(f"{name}_delta") for name, m in (("recall_1", "hit_1"), ("recall_3", "hit_3"), ("recall_5", "hit_5"), ("mrr", "rr"), ("ndcg", "ndcg"))),
        F.when(F.count_if(F.col("query_type") == CANDIDATE) > 0, gain("hit_5", relation)).alias("relationship_recall_delta"),
    )
    return D.shadow_decision(made.withColumn("p95_delta_ms", F.lit(0.0))).drop("p95_delta_ms")
