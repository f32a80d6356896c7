"""Gates, decisions, readiness and paired comparisons of runs: small aggregates and ordered choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlquarry.functions.scalars import flags, pct_nearest, ratio, set_fingerprint


def gate(summary: DataFrame, zero: list[str], **fails: Column) -> DataFrame:
    """summary with failures: counters that must be 0 and further conditions that hold."""
    names = flags(**{c: F.col(c) > 0 for c in zero}, **fails)
    return summary.withColumn("failures", names).withColumn("passed", F.size("failures") == 0)


def invariants(runs: DataFrame) -> DataFrame:
    """failures of a comparison: run labels must differ; dataset, corpus and k must agree."""
    made = runs.agg(
        (F.count("*") - F.countDistinct("run_label")).alias("repeated"), F.countDistinct("dataset").alias("datasets"), F.countDistinct("corpus").alias("corpora"), F.countDistinct("top_k").alias("ks")
    )
    return made.select(flags(duplicate_run_label=F.col("repeated") > 0, dataset_mismatch=F.col("datasets") > 1, corpus_mismatch=F.col("corpora") > 1, top_k_mismatch=F.col("ks") > 1).alias("failures"))


def fingerprints(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Order-insensitive fingerprints of a dataset and a corpus."""
    q = set_fingerprint(queries, queries.columns).withColumnRenamed("fingerprint", "dataset")
    return q.join(set_fingerprint(docs, docs.columns).withColumnRenamed("fingerprint", "corpus"))


def overlap_decision(summary: DataFrame) -> DataFrame:
    """Whether fusing is worth a trial: the dense list alone hits something, and the union of both recalls more than BM25."""
    bm25 = (F.col("both_hit") + F.col("bm25_only")) / F.nullif(F.col("answerable"), F.lit(0))
    delta = F.round(F.col("oracle_union_recall") - F.coalesce(bm25, F.lit(0.0)), 6)
    go = (F.col("dense_only") > 0) & (delta > 0)
    return summary.withColumn("decision", F.when(go, "proceed_to_hybrid_rrf").otherwise("stop_d0_hybrid"))


#: Counters that stop a locked comparison, and the most milliseconds by which p95 may grow.
STOPS = ("target_resolvability_fail_count", "false_hybrid_route_count", "no_answer_candidate_route_count", "active_route_applied_count", "live_call_count")
MAX_P95_DELTA_MS = 50.0


def locked_decision(row: DataFrame) -> DataFrame:
    """row: STOPS, mean, ci_low, ci_high (of a paired delta), p95_delta_ms; with the interval's tag and the decision."""
    stopped = F.lit(False)
    for name in STOPS:
        stopped = stopped | (F.col(name) > 0)
    better = (F.col("mean") > 0) & (F.col("ci_low") > 0)
    worse = (F.col("mean") < 0) & (F.col("ci_high") < 0)
    tag = F.when(better, "positive_ci_excludes_zero").when(worse, "negative_ci_excludes_zero").otherwise("ci_includes_zero")
    supported = better & (F.col("p95_delta_ms") <= MAX_P95_DELTA_MS)
    choice = F.when(stopped, "blocked_by_stop_condition").when(supported, "support_relationship_route_candidate").otherwise("keep_shadow_without_locked_improvement_claim")
    return row.withColumn("interval_tag", tag).withColumn("decision", choice)


#: The most by which MRR and nDCG may fall in a shadow run.
LEAST_MRR_DELTA = LEAST_NDCG_DELTA = -0.01


def shadow_decision(row: DataFrame) -> DataFrame:
    """row: false_route_count, relationship_recall_delta (null without such queries), mrr_delta, ndcg_delta, p95_delta_ms."""
    keep = (
        (F.coalesce("relationship_recall_delta", F.lit(0.0)) <= 0)
        | (F.col("mrr_delta") < LEAST_MRR_DELTA)
        | (F.col("ndcg_delta") < LEAST_NDCG_DELTA)
        | (F.col("p95_delta_ms") > MAX_P95_DELTA_MS)
    )
    choice = F.when(F.col("false_route_count") > 0, "reject_active_route_for_now").when(keep, "keep_shadow_only").otherwise("ready_for_active_route_dry_run_contract")
    return row.withColumn("decision", choice)


def type_deltas(pairs: DataFrame, types: DataFrame, metric: str) -> DataFrame:
    """query_type, n and mean baseline, candidate and delta over paired rows; types without pairs have n 0."""
    own = pairs.groupBy("query_type").agg(F.count("*").alias("n"), F.round(F.avg(f"a_{metric}"), 6).alias("a"), F.round(F.avg(f"b_{metric}"), 6).alias("b"), F.round(F.avg(F.col(f"b_{metric}") - F.col(f"a_{metric}")), 6).alias("delta"))
    return types.join(own, "query_type", "left").fillna(0, ["n"])


def strategy_summary(rows: DataFrame, k: int = 5) -> DataFrame:
    """Per strategy: recall of targets by grain and rank, what only the document or nothing covers in k ranks, and mean metrics.

    rows: strategy_id, child_rank, parent_rank, doc_rank (null: not found), rr, ndcg, hard_case, latency_ms. The p95 sorts the
    latencies of a strategy's queries in one row.
    """
    within = lambda grain, n: F.coalesce(F.col(f"{grain}_rank") <= n, F.lit(False))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    child, parent, doc = (within(g, k) for g in ("child", "parent", "doc"))
    recalls = [share(within(g, n)).alias(f"{g}_recall_{n}") for g in ("child", "parent") for n in (1, 3, 5)]
    return rows.groupBy("strategy_id").agg(
        F.count("*").alias("n_queries"), *recalls, share(within("doc", 5)).alias("doc_recall_5"), share(child | parent).alias("child_or_parent_recall"),
        F.count_if(doc & ~child & ~parent).alias("doc_only_count"), F.count_if(~doc & ~child & ~parent).alias("full_miss_count"), F.count_if("hard_case").alias("hard_case_count"),
        F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg_5"), F.round(pct_nearest("latency_ms", 0.95), 6).alias("p95_ms"),
    )


def select_strategy(summaries: DataFrame, baseline: str) -> DataFrame:
    """One row: the best strategy but the baseline, its deltas, what is kept and why. Ties go to the lesser id.

    Adopted if direct recall rises, diagnosed further if only fewer queries are missed, in either case if the p95 is no more
    than 100 ms, or the baseline's own p95, above the baseline's.
    """
    own = F.col("strategy_id") == baseline
    order = F.struct((-F.col("child_or_parent_recall")).alias("r"), "doc_only_count", "full_miss_count", (-F.col("mrr")).alias("m"), (-F.col("ndcg_5")).alias("g"), "p95_ms", "strategy_id")
    base = F.struct("child_or_parent_recall", "doc_only_count", "full_miss_count", "p95_ms")
    x = summaries.agg(F.min(F.when(~own, order)).alias("best"), F.min(F.when(own, base)).alias("base"))
    recall = F.round(-F.col("best.r") - F.col("base.child_or_parent_recall"), 6)
    p95 = F.round(F.col("best.p95_ms") - F.col("base.p95_ms"), 6)
    fewer = (F.col("best.doc_only_count") < F.col("base.doc_only_count")) | (F.col("best.full_miss_count") < F.col("base.full_miss_count"))
    quick = F.col("p95_delta") <= F.greatest(F.lit(100.0), F.col("base.p95_ms"))
    made = x.withColumns({"best_id": F.col("best.strategy_id"), "recall_delta": recall, "p95_delta": p95})
    made = made.withColumn("decision", F.when((F.col("recall_delta") > 0) & quick, "adopt_candidate").when(fewer & quick, "needs_more_diagnosis").otherwise("reject_candidates"))
    kept = F.when(F.col("decision") == "reject_candidates", baseline).otherwise(F.col("best_id"))
    return made.select("best_id", kept.alias("selected_id"), "recall_delta", "p95_delta", "decision")


def hard_case_causes(rows: DataFrame) -> DataFrame:
    """query_id, the likely cause of a hard case and its diagnostic tags.

    rows: query_id, child_covered, parent_covered, doc_covered, retrieval_rank, pack_rank (null: none), recoverable, rewritten,
    correctness_regression, unsupported_regression, and deltas citation_count, citation_precision, citation_recall (null: no answer).
    """
    child, parent, doc = (F.col(f"{g}_covered") for g in ("child", "parent", "doc"))
    worse = F.col("correctness_regression") | F.col("unsupported_regression")
    cause = (
        F.when(child & parent & doc & worse, "generation_contract_candidate")
        .when(~(child | parent | doc), "retrieval_or_packing_miss")
        .when(~child, "target_grain_mismatch")
        .otherwise("monitor_only")
    )
    covered = flags(target_child_in_pack=child, target_parent_in_pack=parent, target_doc_in_pack=doc)
    ranks = F.array(*(F.concat(F.lit(f"target_{n}_"), F.col(n).cast("string")) for n in ("retrieval_rank", "pack_rank")))
    rest = flags(
        citation_recoverable=F.col("recoverable"),
        query_rewrite_changed=F.col("rewritten"),
        query_rewrite_not_changed=~F.col("rewritten"),
        generation_correctness_regression=F.col("correctness_regression"),
        generation_unsupported_regression=F.col("unsupported_regression"),
        v2_citation_count_reduction=F.col("citation_count") < 0,
        v2_precision_regression=F.col("citation_precision") < 0,
        v2_recall_regression=F.col("citation_recall") < 0,
    )
    return rows.select("query_id", cause.alias("cause"), F.array_join(F.concat(covered, F.array_compact(ranks), rest), ",").alias("tags"))


def generation_costs(rows: DataFrame) -> DataFrame:
    """Calls, tokens, cost and latency of generated queries, and whether to adopt them.

    rows: called, tokens_in, tokens_out, price_in, price_out (per million), latency_ms, a_recall, b_recall, a_mrr, b_mrr.
    """
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    made = rows.agg(
        F.count_if("called").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum(cost), 6).alias("cost"), pct_nearest("latency_ms", 0.95).alias("p95_ms"),
        F.round(F.avg(F.col("b_recall") - F.col("a_recall")), 6).alias("delta_recall"), F.round(F.avg(F.col("b_mrr") - F.col("a_mrr")), 6).alias("delta_mrr"),
    )
    return made.withColumn("decision", F.when((F.col("delta_recall") > 0) & (F.col("delta_mrr") >= 0), "adopt").when(F.col("delta_recall") > 0, "trade_off").otherwise("reject"))


def evidence_movement(pairs: DataFrame) -> DataFrame:
    """Counts of queries whose best evidence (direct, doc_only or miss) moved; pairs: a_state, b_state, a_first, b_first."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a, b = F.col("a_state"), F.col("b_state")
    return pairs.agg(
        n(F.col("b_first") < F.col("a_first")).alias("improved"), n(F.col("b_first") > F.col("a_first")).alias("regressed"),
        n((a == "doc_only") & (b == "direct")).alias("doc_only_to_direct"), n((a == "direct") & (b == "doc_only")).alias("direct_to_doc_only"), n((a == "direct") & (b == "miss")).alias("direct_to_miss"),
    )


def rank_movement(a: Column, b: Column) -> Column:
    """new, lost, up, down, same or absent."""
    return F.when(a.isNull() & b.isNull(), "absent").when(a.isNull(), "new").when(b.isNull(), "lost").when(b < a, "up").when(b > a, "down").otherwise("same")


def recoverability(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Share of children all of whose cited blocks exist with a source file and inside the child's pages. citations: child_id,
    block_id, page_start, page_end; blocks: block_id, page, source_file."""
    rows = citations.join(blocks, "block_id", "left")
    good = F.coalesce((F.col("source_file") != "") & F.col("page").between(F.col("page_start"), F.col("page_end")), F.lit(False))
    own = rows.groupBy("child_id").agg(F.bool_and(good).alias("ok"))
    return own.agg(F.count("*").alias("child_count"), F.round(ratio(F.count_if("ok"), F.count("*"), 1.0), 6).alias("recoverability"))


def best_run(runs: DataFrame, *order: Column) -> DataFrame:
    """The first run by the given keys, then by label."""
    return runs.withColumn("place", F.row_number().over(Window.orderBy(*order, "run_label"))).filter("place = 1").drop("place")


def failure_summary(tagged: DataFrame) -> DataFrame:
    """tag and n of comma-joined tags; rows without any count as 'none'."""
    tag = F.explode(F.when(F.col("tags") == "", F.array(F.lit("none"))).otherwise(F.split("tags", ",")))
    return tagged.select(tag.alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def runner_up(classified: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """query_id, first and second type by score (ties by the order of types) and their margin."""
    order = F.array_sort(F.array(*(F.struct((-F.col(f"s_{t}")).alias("neg"), F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(types))))
    rows = classified.select("query_id", order.alias("o"))
    return rows.select("query_id", F.col("o")[0]["t"].alias("first"), F.col("o")[1]["t"].alias("second"), F.round(F.col("o")[1]["neg"] - F.col("o")[0]["neg"], 6).alias("margin"))


def guard_effect(rows: DataFrame) -> DataFrame:
    """Accuracy before and after a guard, false hybrid routes, and abstentions that it lost. rows: expected, predicted, guarded."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    e, p, g = F.col("expected"), F.col("predicted"), F.col("guarded")
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg((e == p).cast("double")), 6).alias("accuracy_before"), F.round(F.avg((e == g).cast("double")), 6).alias("accuracy_after"),
        n((p == "relationship") & (e != "relationship")).alias("false_hybrid_before"), n((g == "relationship") & (e != "relationship")).alias("false_hybrid_after"),
        n((e == "no_answer") & (p == "no_answer") & (g != "no_answer")).alias("no_answer_regression"),
    )


def answer_contract(answers: DataFrame) -> DataFrame:
    """Counters of answers (abstained, citations, unknown) and failed gates: an answer must cite, an abstention must not."""
    cited = F.size("citations") > 0
    made = answers.agg(
        F.count("*").alias("answer_count"), F.count_if("abstained").alias("abstain_count"), F.count_if(~F.col("abstained") & ~cited).alias("uncited_answer_count"),
        F.count_if(F.col("abstained") & cited).alias("cited_abstention_count"), F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown_citation_count"),
    )
    return gate(made, ["uncited_answer_count", "cited_abstention_count", "unknown_citation_count"])


def policy_deltas(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """By query type: mean deltas of metrics over paired queries, and the largest latency of each side (a maximum, no percentile)."""
    side = lambda x, n: x.select("query_id", *([] if n == "b" else ["query_type"]), *(F.col(m).alias(f"{n}_{m}") for m in [*metrics, "latency_ms"]))
    rows = side(a, "a").join(side(b, "b"), "query_id")
    return rows.groupBy("query_type").agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(f"b_{m}") - F.col(f"a_{m}")), 6).alias(f"delta_{m}") for m in metrics), F.max("a_latency_ms").alias("a_max_ms"), F.max("b_latency_ms").alias("b_max_ms"))


def buckets(rows: DataFrame, mapping: dict[str, str], column: str, other: str = "other") -> DataFrame:
    """Rows by the bucket that mapping gives column's value."""
    name = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), F.col(column)), F.lit(other)) if mapping else F.lit(other)
    return rows.groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))


def target_audit(targets: DataFrame, children: DataFrame) -> DataFrame:
    """Per target (query_id, child_id, parent_id): whether the child exists, lies in the parent, has refs, valid pages and a fit length."""
    own = children.select("child_id", F.col("parent_id").alias("own_parent"), "n_blocks", "text_length", "page_start", "page_end")
    rows = targets.join(own, "child_id", "left")
    tags = flags(
        missing_child=F.col("own_parent").isNull(),
        wrong_parent=F.col("own_parent") != F.col("parent_id"),
        no_refs=F.col("n_blocks") == 0,
        bad_pages=F.col("page_end") < F.col("page_start"),
        too_short=F.col("text_length") < 20,
        too_long=F.col("text_length") > 1100,
    )
    return rows.select("query_id", "child_id", F.array_join(tags, ",").alias("tags"))


def expected_behaviour(rows: DataFrame) -> DataFrame:
    """met, answered_unexpectedly or abstained_unexpectedly; rows: expected, abstained."""
    right = (F.col("expected") == "abstain") == F.col("abstained")
    return rows.withColumn("behaviour", F.when(right, "met").when(F.col("abstained"), "abstained_unexpectedly").otherwise("answered_unexpectedly"))


def split_readiness(items: DataFrame, types: list[str], splits: dict[str, int]) -> DataFrame:
    """query_type with the shortfall of each split against its target."""
    have = items.groupBy("query_type").pivot("split", list(splits)).count()
    domain = items.sparkSession.createDataFrame([(t,) for t in types], "query_type string")
    rows = domain.join(have, "query_type", "left").fillna(0)
    return rows.select("query_type", *(F.col(s) for s in splits), *(F.greatest(F.lit(n) - F.col(s), F.lit(0)).alias(f"{s}_shortfall") for s, n in splits.items()))
