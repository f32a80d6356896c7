"""Records of generated answers, by hand."""

from __future__ import annotations

from marlquarry.operators import quality as Q

ANSWERS = "query_id long, abstained boolean, citations array<struct<pack_rank int, doc_id long, parent_id string, root_id string>>, answer string, spoken_answer string, risk string, place_ids array<string>"
GOOD = "An answer that says enough."


def test_generation_records_and_summary(spark):
    hit, miss = (1, 5, "p", "r"), (1, 9, "x", "y")
    answers = [
        (1, False, [hit], GOOD, GOOD, "low", ["a"]),
        (2, False, [miss], GOOD, GOOD, "low", ["a"]),
        (3, False, [hit], GOOD, GOOD, "high", ["a"]),
        (4, True, [], None, "There is nothing on that.", "low", []),
        (5, False, [hit], GOOD, "Two\nlines of speech here", "low", None),
        (6, False, [hit, miss], "Too short.", GOOD, None, ["b", "a"]),
        (7, True, [], None, None, None, None),
        (8, False, [], GOOD, GOOD, "low", []),
    ]
    targets = spark.createDataFrame([(q, 5, "p", "r") for q in (1, 2, 3, 5, 6, 7, 8)], "query_id long, doc_id long, parent_id string, root_id string")
    asked = [(q, "abstain" if q == 4 else "retrieve", "story" if q > 5 else "fact", ["a", "c"] if q in (1, 2, 3, 6) else []) for q in range(1, 10)]
    queries = spark.createDataFrame(asked, "query_id long, expected string, query_type string, place_ids array<string>")
    records = Q.generation_records(spark.createDataFrame(answers, ANSWERS), targets, queries)
    got = {r.query_id: r for r in records.collect()}
    assert {q: (r.correct_with_evidence, r.unsupported_claim, r.usefulness) for q, r in got.items()} == {
        1: (True, False, 1.0), 2: (False, True, 0.0), 3: (False, True, 0.0), 4: (False, False, 1.0), 5: (True, False, 0.0), 6: (True, False, 0.0), 7: (False, False, 0.0), 8: (False, True, 0.0), 9: (False, False, 0.0),
    }
    assert (got[1].place_relevance, got[2].place_relevance, got[4].place_relevance, got[5].place_relevance) == (0.5, 0.5, 1.0, 1.0)
    assert (got[5].spoken_naturalness, got[4].spoken_naturalness, got[9].spoken_naturalness, got[6].citation_precision) == (0.0, 1.0, 0.0, 0.5)
    assert got[9].abstained and not got[9].abstention_correct and got[7].answer_fingerprint == got[9].answer_fingerprint != got[1].answer_fingerprint
    s = {r.query_type: r for r in Q.generation_summary(records).collect()}
    assert set(s) == {"all", "fact", "story"} and (s["all"].eval_count, s["all"].answerable_count, s["all"].no_answer_count, s["all"].abstained_count) == (9, 8, 1, 3)
    assert s["all"].correct_with_evidence_rate == 0.375 and s["all"].unsupported_claim_rate == round(3 / 9, 6) and (s["all"].missing_citation_count, s["all"].unsupported_high_count) == (1, 1)
    assert Q.generation_summary(records.limit(0)).collect() == []


def test_prompt_policies(spark):
    drafts = [
        (1, "place_fact", "retrieve", "p", True, [1], None, "low"),
        (2, "overview", "retrieve", "p", True, [1], "multi_evidence", "low"),
        (3, "relationship", "retrieve", "p", True, [1, 2], "one", "high"),
        (4, "place_story", "retrieve", Q.ROUTER, True, [1, 2], "multi_evidence", "low"),
        (5, "place_story", "retrieve", Q.ROUTER, True, [1, 7], "multi_evidence", "low"),
        (6, "overview", "retrieve", "p", False, None, None, None),
        (7, "no_answer", "abstain", "p", False, None, None, None),
        (8, "no_answer", "abstain", "p", True, [1], None, "low"),
    ]
    schema = "query_id long, query_type string, expected string, policy_id string, has_draft boolean, ranks array<int>, coverage_intent string, risk string"
    packs = spark.createDataFrame([(q, r) for q in (1, 2, 3, 4, 5, 8) for r in (1, 2)], "query_id long, pack_rank int")
    rows = Q.prompt_policy(spark.createDataFrame(drafts, schema), packs)
    assert {r.query_id: (r.status, r.tags) for r in rows.collect()} == {
        1: ("pass", "policy_pass"),
        2: ("fail", "evidence_floor_violation,unsupported_risk_too_low"),
        3: ("fallback_required", "coverage_intent_violation"),
        4: ("fallback_required", "v1_fallback_required,monitor_only_query_type"),
        5: ("fail", "invalid_evidence_rank,v1_fallback_required,monitor_only_query_type"),
        6: ("fail", "missing_draft,evidence_floor_violation"),
        7: ("pass", "no_answer_abstain_path"),
        8: ("fail", "unexpected_draft_for_abstain,abstain_with_evidence"),
    }
    s = Q.prompt_policy_summary(rows).first()
    assert (s.row_count, s.pass_count, s.fallback_required_count, s.fail_count, s.invalid_rank_count, s.no_answer_pass_count, s.decision) == (8, 2, 2, 4, 1, 1, "reject_repaired_prompt_policy")
    none = Q.prompt_policy_summary(rows.limit(0)).first()
    assert (none.row_count, none.decision) == (0, "ready_for_repaired_prompt_dry_run")
