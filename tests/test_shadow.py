"""Routed retrieval and the shadow run."""

from __future__ import annotations

import pytest

from marlquarry.plans import methods as M

VECTORS = "{} long, embedding array<float>"


@pytest.fixture
def inputs(spark):
    docs = spark.createDataFrame([(1, "amber river"), (2, "birch wood"), (3, "cedar hill")], "doc_id long, text string")
    asked = [(10, "amber", "retrieve"), (11, "birch", "retrieve"), (12, "cedar", "retrieve"), (13, "amber", "abstain")]
    # By vectors, every query is nearest to document 3.
    return M.Inputs(
        docs,
        spark.createDataFrame(asked, "query_id long, query_text string, expected string"),
        spark.createDataFrame([(1, [0.1, 0.0]), (2, [0.2, 0.0]), (3, [1.0, 0.0])], VECTORS.format("doc_id")),
        spark.createDataFrame([(q, [1.0, 0.0]) for q in (10, 11, 12, 13)], VECTORS.format("query_id")),
    )


def test_each_method_gets_its_own_queries(spark, inputs, monkeypatch):
    asked = {}

    def watched(name, method):
        def run(x):
            asked[name] = sorted(r.query_id for r in x.queries.select("query_id").collect()), sorted(r.query_id for r in x.query_vectors.select("query_id").collect())
            return method(x)

        return run

    monkeypatch.setattr(M, "METHODS", {n: watched(n, m) for n, m in M.METHODS.items()})
    routes = spark.createDataFrame([(10, "dense"), (11, "hybrid_weighted"), (13, "abstain")], "query_id long, execution_mode string")
    found = {r.query_id for r in M.routed(inputs, routes).collect()}
    assert found == {10, 11} and asked == {"dense": ([10], [10]), "hybrid_weighted_05": ([11], [11])}
    asked.clear()
    assert M.routed(inputs, routes.filter("execution_mode = 'abstain'")).collect() == [] and asked == {}


def test_shadow_rows_and_summary(spark, inputs):
    qrels = spark.createDataFrame([(10, 1, 1), (11, 2, 1), (12, 3, 1)], "query_id long, doc_id long, grade int")
    typed = [(10, "relationship", "relationship", "relationship", False), (11, "place_fact", "relationship", "overview", True), (12, "relationship", "place_fact", "place_fact", False), (13, "no_answer", "relationship", "relationship", False)]
    schema = "query_id long, query_type string, predicted string, guarded string, guard_applied boolean"
    rows = M.shadow_rows(inputs, qrels, spark.createDataFrame(typed, schema))
    got = {r.query_id: r for r in rows.collect()}
    assert [got[q].decision_reason_tag for q in (10, 11, 12, 13)] == ["safe_relationship_shadow_route", "blocked_by_relationship_guard", "fallback_to_default_route", "no_answer_abstain"]
    assert [got[q].guard_decision for q in (10, 11, 12, 13)] == ["allow", "block", "not_applicable", "allow"]
    # Query 10's own word lifts document 1 in the fusion, where it ties with document 3 and has the better first list; the others keep the default's results.
    assert (got[10].baseline_relevant_rank, got[10].shadow_relevant_rank) == (3, 1)
    assert (got[11].baseline_relevant_rank, got[11].shadow_relevant_rank) == (2, 2) and (got[12].missed_hybrid_route, got[10].missed_hybrid_route) == (True, False)
    assert (got[13].baseline_candidate_count, got[13].shadow_candidate_count, got[13].no_answer_candidate_route) == (0, 0, False)
    s = M.shadow_summary(rows).first()
    assert (s.query_count, s.answerable_query_count, s.routed_count, s.false_route_count, s.missed_route_count) == (4, 3, 1, 0, 1)
    assert s.mrr_delta == pytest.approx(2 / 9, abs=2e-6) and s.decision == "keep_shadow_only"
    false = [(q, "place_fact", p, g, a) for q, _, p, g, a in typed]
    assert M.shadow_summary(M.shadow_rows(inputs, qrels, spark.createDataFrame(false, schema))).first().decision == "reject_active_route_for_now"
    none = M.shadow_summary(M.shadow_rows(inputs, qrels, spark.createDataFrame([], schema))).first()
    assert (none.query_count, none.mrr_delta, none.relationship_recall_delta) == (0, 0, None)
