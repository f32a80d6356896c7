"""Profiles of evaluation sets, catalogs, scores, answers and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlquarry.functions.scalars import flags, nearest_percentiles


def dataset_profile(items: DataFrame, *columns: str) -> DataFrame:
    """Counts of every combination of columns and of each prefix of them: dimensions joined by '/', 'all' for none."""
    made = items.rollup(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    names = [F.when(F.expr(f"(g div {2 ** (len(columns) - 1 - i)}) % 2 = 0"), F.coalesce(F.col(c).cast("string"), F.lit("(none)"))) for i, c in enumerate(columns)]
    return made.select(F.coalesce(F.nullif(F.concat_ws("/", *names), F.lit("")), F.lit("all")).alias("cell"), "n")


def shortfall(items: DataFrame, domain: DataFrame, keys: list[str], target: int) -> DataFrame:
    """For each cell of a fixed domain: how many items it has and lacks."""
    have = items.groupBy(*keys).agg(F.count("*").alias("n"))
    return domain.join(have, keys, "left").fillna(0, ["n"]).withColumn("shortfall", F.greatest(F.lit(target) - F.col("n"), F.lit(0)))


def subset(items: DataFrame, wanted: dict[str, list], order: list[str]) -> DataFrame:
    """Items whose columns hold one of the wanted values, in a fixed order. ValueError where there are none."""
    made = items
    for column, values in wanted.items():
        made = made.filter(F.col(column).isin(*values))
    if made.isEmpty():
        raise ValueError(f"no item has the wanted {', '.join(wanted)}")
    return made.orderBy(*order)


def input_faults(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """One row of counts over both sides (query_id, query_type): ids on one side only, ids of another type than their query, ids held more than once; passed if none.

    Sides are grouped by id before they meet, so repeated ids make no pairs.
    """
    side = lambda df, n: df.groupBy("query_id").agg(F.count("*").alias(n), F.min("query_type").alias(f"{n}_low"), F.max("query_type").alias(f"{n}_high"))
    both = side(queries, "q").join(side(answers, "a"), "query_id", "full")
    other = ~(F.col("q_low").eqNullSafe(F.col("a_low")) & F.col("q_high").eqNullSafe(F.col("a_high")))
    met = F.col("q").isNotNull() & F.col("a").isNotNull()
    made = both.agg(
        F.count_if(~met).alias("unmatched_ids"),
        F.count_if(met & other).alias("type_mismatches"),
        F.count_if((F.coalesce("q", F.lit(0)) > 1) | (F.coalesce("a", F.lit(0)) > 1)).alias("repeated_ids"),
    )
    return made.withColumn("passed", (F.col("unmatched_ids") == 0) & (F.col("type_mismatches") == 0) & (F.col("repeated_ids") == 0))


# Fixed values of the benchmark: types of queries, items of each type and the state of review by split, items by expected behaviour.
RUBRIC_TYPES = ("place_fact", "place_story", "relationship", "overview", "route_context", "voice_followup", "no_answer")
RUBRIC_SPLITS = {"dev": (10, "reviewed"), "test": (5, "locked")}
RUBRIC_BEHAVIOURS = {"retrieve": 90, "abstain": 15}


def benchmark_rubric(items: DataFrame) -> DataFrame:
    """One row: n_items, the comma-joined failures against the exact counts of the benchmark, and passed.

    items: split, query_type, review_status, expected, requires_context, user_context, n_child_targets. A null state is a wrong one.
    Cells of split and type are counted first, so the last step sees a handful of rows.
    """
    states = F.lit(False)
    for split, (_, state) in RUBRIC_SPLITS.items():
        states = states | ((F.col("split") == split) & ~F.col("review_status").eqNullSafe(F.lit(state)))
    bare = F.col("requires_context") & (F.trim(F.coalesce("user_context", F.lit(""))) == "")
    cells = items.groupBy("split", "query_type").agg(
        F.count("*").alias("n"),
        F.count_if(states).alias("wrong_state"),
        *(F.count_if(F.col("expected") == b).alias(b) for b in RUBRIC_BEHAVIOURS),
        F.count_if(bare).alias("bare"),
        F.count_if((F.col("expected") == "retrieve") & (F.coalesce("n_child_targets", F.lit(0)) == 0)).alias("no_child"),
    )
    total = lambda c, where=F.lit(True): F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    wrong = {"private_benchmark_query_count_mismatch": total("n") != len(RUBRIC_TYPES) * sum(n for n, _ in RUBRIC_SPLITS.values())}
    for split, (each, _) in RUBRIC_SPLITS.items():
        wrong[f"private_benchmark_{split}_query_count_mismatch"] = total("n", F.col("split") == split) != each * len(RUBRIC_TYPES)
    for split, (_, state) in RUBRIC_SPLITS.items():
        wrong[f"private_benchmark_{split}_status_not_{state}"] = total("wrong_state", F.col("split") == split) > 0
    for split, (each, _) in RUBRIC_SPLITS.items():
        exact = (F.col("split") == split) & F.col("query_type").isin(*RUBRIC_TYPES) & (F.col("n") == each)
        wrong[f"private_benchmark_{split}_query_type_count_mismatch"] = F.count_if(exact) != len(RUBRIC_TYPES)
    answers = F.lit(False)
    for behaviour, n in RUBRIC_BEHAVIOURS.items():
        answers = answers | (total(behaviour) != n)
    wrong["private_benchmark_answerability_distribution_mismatch"] = answers
    wrong["requires_context_without_user_context"] = total("bare") > 0
    wrong["answerable_without_child_target"] = total("no_child") > 0
    made = cells.agg(total("n").alias("n_items"), F.array_join(flags(**wrong), ",").alias("failures"))
    return made.withColumn("passed", F.col("failures") == "")


def resolvability(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct ids of refs that known has, and that it lacks."""
    ids = refs.select(key).distinct()
    there = known.select(key).distinct().withColumn("there", F.lit(True))
    rows = ids.join(there, key, "left")
    return rows.agg(F.count("*").alias("ref_count"), F.count_if(F.col("there")).alias("resolved_count"), F.count_if(F.col("there").isNull()).alias("missing_count"))


def manifest(df: DataFrame, key: str) -> DataFrame:
    """Rows, repeated keys and null cells of a table."""
    nulls: Column = F.lit(0)
    for c in df.columns:
        nulls = nulls + F.col(c).isNull().cast("int")
    return df.agg(F.count("*").alias("row_count"), (F.count(key) - F.countDistinct(key)).alias("duplicate_key_count"), F.sum(nulls).alias("null_count"))


def catalog_quality(places: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """Extra values of repeated ids and aliases, relations to unknown places or to themselves, and places without any."""
    extra = lambda df, c: df.groupBy(c).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    ids = places.select("place_id").distinct()
    unknown = edges.join(ids.withColumnRenamed("place_id", "target"), "target", "left_anti").agg(F.count("*").alias("unknown_target_count"))
    itself = edges.agg(F.count_if(F.col("place_id") == F.col("target")).alias("self_relation_count"))
    linked = edges.select("place_id").union(edges.select("target")).distinct().toDF("place_id")
    alone = ids.join(linked, "place_id", "left_anti").agg(F.count("*").alias("isolated_place_count"))
    return (
        extra(places, "place_id").withColumnRenamed("n", "duplicate_place_count").join(extra(aliases, "alias").withColumnRenamed("n", "duplicate_alias_count")).join(unknown).join(itself).join(alone)
    )


def score_aggregates(scores: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, least, largest, median and population deviation by group; the deviation of one value is null."""
    made = scores.groupBy(by).agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), 6).alias("mean"),
        F.min(value).alias("least"),
        F.max(value).alias("largest"),
        F.when(F.count(value) > 1, F.round(F.stddev_pop(value), 6)).alias("stddev"),
    )
    middle = nearest_percentiles(scores, [by], value, {"p50": 0.5}).withColumnRenamed(by, "_by")
    return made.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def score_decision(rows: DataFrame, accept: float, reject: float, expected: int) -> DataFrame:
    """missing, invalid, incomplete, reject, accept or pending, in that order; rows: n, least, largest, mean."""
    choice = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "missing")
        .when((F.col("least") < 0) | (F.col("largest") > 5), "invalid")
        .when(F.col("n") < expected, "incomplete")
        .when(F.col("mean") < reject, "reject")
        .when(F.col("mean") >= accept, "accept")
        .otherwise("pending")
    )
    return rows.withColumn("decision", choice)


def evidence_id(rank: Column, *parts: Column) -> Column:
    """ev-, the rank in two digits and eight digits of a hash."""
    return F.concat(F.lit("ev-"), F.lpad(rank.cast("string"), 2, "0"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 8))


def assemble_answers(packs: DataFrame, drafts: DataFrame) -> DataFrame:
    """Answers of drafts (query_id, answer, selected array<int> or null) with citations from packs.

    No evidence makes an abstention. Without a selection all evidence is cited; else the selected ranks in their order.
    unknown counts selected ranks that the pack lacks.
    """
    lists = packs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pack_rank").cast("int").alias("pack_rank"), "doc_id", "parent_id", "root_id"))).alias("ev"))
    rows = drafts.join(lists, "query_id", "left").withColumn("ev", F.coalesce("ev", F.expr("slice(array(named_struct('pack_rank', 0, 'doc_id', cast(null as long), 'parent_id', cast(null as string), 'root_id', cast(null as string))), 1, 0)")))
    chosen = F.transform("selected", lambda r: F.try_element_at(F.filter("ev", lambda e: e["pack_rank"] == r), F.lit(1)))
    abstained = F.size("ev") == 0
    cites = F.when(F.col("selected").isNull(), F.col("ev")).otherwise(F.filter(chosen, lambda x: x.isNotNull()))
    return rows.select(
        "query_id",
        abstained.alias("abstained"),
        F.when(~abstained, F.col("answer")).alias("answer"),
        cites.alias("citations"),
        F.coalesce(F.size("selected") - F.size(F.filter(chosen, lambda x: x.isNotNull())), F.lit(0)).alias("unknown"),
    )


def citation_scores(answers: DataFrame, targets: DataFrame, queries: DataFrame) -> DataFrame:
    """Precision and recall of citations against typed targets, and whether abstention was right.

    answers: query_id, abstained, citations; targets: query_id, doc_id, parent_id, root_id; queries: query_id, expected. Without
    targets precision is 1 and recall 1 only for an abstention.
    """
    typed = F.array(F.concat(F.lit("child:"), F.col("doc_id").cast("string")), F.concat(F.lit("parent:"), F.col("parent_id").cast("string")), F.concat(F.lit("doc:"), F.col("root_id").cast("string")))
    refs = targets.select("query_id", F.explode(typed).alias("ref")).groupBy("query_id").agg(F.collect_set("ref").alias("targets"))
    own = lambda c: F.array(F.concat(F.lit("child:"), c["doc_id"].cast("string")), F.concat(F.lit("parent:"), c["parent_id"].cast("string")), F.concat(F.lit("doc:"), c["root_id"].cast("string")))
    rows = queries.join(answers, "query_id", "left").join(refs, "query_id", "left")
    rows = rows.withColumn("abstained", F.coalesce("abstained", F.lit(True))).withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    n = F.coalesce(F.size("citations"), F.lit(0))
    good = F.size(F.filter("citations", lambda c: F.arrays_overlap(own(c), F.col("targets"))))
    covered = F.size(F.array_intersect(F.flatten(F.transform("citations", own)), F.col("targets")))
    precision = F.when(F.col("abstained"), F.when(n == 0, 1.0).otherwise(0.0)).when(n == 0, 0.0).when(F.size("targets") == 0, 1.0).otherwise(good / F.nullif(n, F.lit(0)))
    recall = F.when(F.size("targets") == 0, F.when(F.col("abstained"), 1.0).otherwise(0.0)).otherwise(F.coalesce(covered, F.lit(0)) / F.nullif(F.size("targets"), F.lit(0)))
    right = F.col("abstained") == (F.col("expected") == "abstain")
    return rows.select(
        "query_id", "expected", n.alias("n_citations"), F.round(precision, 6).alias("citation_precision"), F.round(recall, 6).alias("citation_recall"), right.alias("abstention_correct"),
        (~F.col("abstained") & (F.col("expected") == "retrieve") & (precision == 0)).alias("unsupported_claim"),
    )


def citation_summary(rows: DataFrame) -> DataFrame:
    """Means by expected behaviour and in all; citation means count retrieve queries only."""
    answerable = F.col("expected") == "retrieve"
    made = rows.groupingSets([["expected"], []], "expected").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(answerable, F.col("citation_precision"))), 6).alias("precision"),
        F.round(F.avg(F.when(answerable, F.col("citation_recall"))), 6).alias("recall"),
        F.round(F.avg(F.col("abstention_correct").cast("double")), 6).alias("abstention_accuracy"),
        F.count_if("unsupported_claim").alias("unsupported_count"),
        F.grouping("expected").alias("g"),
    )
    return made.withColumn("expected", F.when(F.col("g") == 1, "all").otherwise(F.col("expected"))).drop("g")


def spoken_naturalness(text: Column, abstained: Column) -> Column:
    """1 for one plain line of a length that can be said, else 0."""
    t = F.trim(F.coalesce(text, F.lit("")))
    plain = ~t.rlike(r"[\n\r\[\]]") & ~F.contains(t, F.lit("http://")) & ~F.contains(t, F.lit("https://"))
    fits = F.when(abstained, F.length(t).between(10, 160)).otherwise(F.length(t).between(15, 260))
    return F.when((t != "") & plain & fits, 1.0).otherwise(0.0)


#: The risk that stands for an unsupported claim, and the least and most characters of a useful answer.
HIGH, ANSWER_LEAST, ANSWER_MOST = "high", 20, 1200


def generation_records(answers: DataFrame, targets: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query: how an answer cites, whether it is right, and whether a guide could use it.

    answers: query_id, abstained, citations, answer, spoken_answer, risk, place_ids; targets as in citation_scores(); queries: query_id,
    expected, query_type, place_ids. A query without an answer counts as abstained. An answer is correct with evidence if it was expected,
    cites a target, and isn't of high risk; it is an unsupported claim if of high risk or, where one was expected, citing no target.
    """
    none = F.array().cast("array<string>")
    asked = queries.select("query_id", "query_type", F.array_distinct(F.coalesce("place_ids", none)).alias("wanted"))
    given = answers.select("query_id", F.coalesce("abstained", F.lit(True)).alias("ab"), "answer", "spoken_answer", "risk", F.coalesce("place_ids", none).alias("places"), F.transform("citations", lambda c: c["doc_id"].cast("string")).alias("cited"))
    rows = citation_scores(answers, targets, queries.select("query_id", "expected")).drop("unsupported_claim").join(asked, "query_id").join(given, "query_id", "left").fillna(True, ["ab"])
    retrieve, high = F.col("expected") == "retrieve", F.coalesce(F.col("risk") == HIGH, F.lit(False))
    text = F.trim(F.coalesce("answer", F.lit("")))
    relevance = F.when(F.size("wanted") == 0, 1.0).when(F.col("ab"), 0.0).otherwise(F.round(F.coalesce(F.size(F.array_intersect("wanted", "places")), F.lit(0)) / F.greatest(F.size("wanted"), F.lit(1)), 6))
    rows = rows.withColumns({
        "correct_with_evidence": retrieve & ~F.col("ab") & (F.col("n_citations") > 0) & (F.col("citation_precision") > 0) & (F.col("citation_recall") > 0) & ~high,
        "place_relevance": relevance,
        "spoken_naturalness": spoken_naturalness(F.col("spoken_answer"), F.col("ab")),
        "unsupported_claim": ~F.col("ab") & (high | (retrieve & (F.col("citation_precision") == 0))),
        "high_risk": high,
    })
    useful = F.col("correct_with_evidence") & (F.col("place_relevance") > 0) & (F.col("spoken_naturalness") > 0) & ~F.col("unsupported_claim") & F.length(text).between(ANSWER_LEAST, ANSWER_MOST)
    digest = F.sha2(F.concat_ws("\x1f", F.coalesce("answer", F.lit("")), F.coalesce("spoken_answer", F.lit("")), F.array_join(F.coalesce("cited", none), ",")), 256)
    return rows.select(
        "query_id", "query_type", "expected", F.col("ab").alias("abstained"), "n_citations", "citation_precision", "citation_recall", "abstention_correct", "correct_with_evidence", "place_relevance", "spoken_naturalness",
        F.when(F.col("expected") == "abstain", F.col("abstention_correct") & ~F.col("unsupported_claim")).otherwise(useful).cast("double").alias("usefulness"), "unsupported_claim", "high_risk",
        F.length(F.coalesce("answer", F.lit(""))).alias("answer_chars"), F.length(F.coalesce("spoken_answer", F.lit(""))).alias("spoken_chars"), F.substring(digest, 1, 16).alias("answer_fingerprint"),
    )


def generation_summary(records: DataFrame) -> DataFrame:
    """Means and counts by query type and, as 'all', over all. Citation means and correctness look at queries that expect an answer.
    Without records there are no rows."""
    retrieve = F.col("expected") == "retrieve"
    mean = lambda c, when=F.lit(True): F.round(F.coalesce(F.avg(F.when(when, F.col(c).cast("double"))), F.lit(0.0)), 6)
    made = records.groupingSets([["query_type"], []], "query_type").agg(
        F.count("*").alias("eval_count"),
        F.count_if(retrieve).alias("answerable_count"),
        F.count_if(F.col("expected") == "abstain").alias("no_answer_count"),
        F.count_if(~F.col("abstained")).alias("answered_count"),
        F.count_if("abstained").alias("abstained_count"),
        mean("correct_with_evidence", retrieve).alias("correct_with_evidence_rate"),
        *(mean(c, retrieve).alias(c) for c in ("citation_precision", "citation_recall")),
        *(mean(c).alias(c) for c in ("place_relevance", "usefulness", "spoken_naturalness")),
        mean("unsupported_claim").alias("unsupported_claim_rate"),
        mean("abstention_correct").alias("abstention_accuracy"),
        F.count_if(retrieve & ~F.col("abstained") & (F.col("n_citations") == 0)).alias("missing_citation_count"),
        F.count_if("high_risk").alias("unsupported_high_count"),
        F.grouping("query_type").alias("g"),
    )
    return made.withColumn("query_type", F.when(F.col("g") == 1, "all").otherwise(F.col("query_type"))).drop("g")


def tradeoff_tags(pairs: DataFrame) -> DataFrame:
    """Paired rows with tags of what changed and the surface where a loss lies.

    pairs: query_id, query_type and candidate less baseline as d_precision, d_recall, d_citations, d_correct, d_unsupported, d_ms.
    """
    d = lambda name: F.col(f"d_{name}")
    tags = flags(
        no_answer_regression=(F.col("query_type") == "no_answer") & ((d("unsupported") > 0) | (d("citations") != 0)),
        correctness_regression=d("correct") < 0,
        unsupported_claim_regression=d("unsupported") > 0,
        precision_gain=d("precision") > 0,
        precision_regression=d("precision") < 0,
        recall_regression=d("recall") < 0,
        citation_count_reduction=d("citations") < 0,
        evidence_over_pruning_risk=(d("citations") <= -3) & ((d("recall") < 0) | (d("correct") < 0)),
        latency_improvement=d("ms") < 0,
        latency_regression=d("ms") > 0,
    )
    rows = pairs.withColumn("t", F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("no_metric_change"))))
    any_of = lambda *names: F.arrays_overlap("t", F.array(*map(F.lit, names)))
    surface = (
        F.when(any_of("correctness_regression", "unsupported_claim_regression"), "generation_contract_candidate")
        .when(any_of("precision_regression", "recall_regression", "evidence_over_pruning_risk"), "citation_selection")
        .when(any_of("latency_regression"), "latency_cost")
        .otherwise("no_regression")
    )
    return rows.select("query_id", F.array_join("t", ",").alias("tags"), surface.alias("surface"))


def regression_tags(pairs: DataFrame) -> DataFrame:
    """query_id and tags of what a candidate's generation input gains and loses.

    pairs: a_ and b_ (baseline and candidate) of direct, correct (booleans), precision, recall, order, ms.
    """
    a, b = (lambda name: F.col(f"a_{name}")), (lambda name: F.col(f"b_{name}"))
    first = {
        "direct_ready_gain": b("direct") & ~a("direct"),
        "direct_ready_loss": a("direct") & ~b("direct"),
        "citation_precision_regression": b("precision") < a("precision"),
        "citation_recall_gain": b("recall") > a("recall"),
        "citation_recall_regression": b("recall") < a("recall"),
        "correctness_gain": b("correct") & ~a("correct"),
        "correctness_regression": a("correct") & ~b("correct"),
        "evidence_order_regression": b("order") < a("order"),
        "latency_improved": b("ms") < a("ms"),
    }
    mixed = (first["direct_ready_gain"] | first["citation_recall_gain"]) & (first["citation_precision_regression"] | first["correctness_regression"])
    tags = flags(**first, mixed_tradeoff=mixed, guardrail_required=first["correctness_regression"] | first["direct_ready_loss"])
    return pairs.select("query_id", F.array_join(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("no_material_change"))), ",").alias("tags"))


#: The least order of evidence, the most that it may fall, and the most by which repeated parents may grow.
MIN_ORDER, MAX_ORDER_DROP, MAX_DUPLICATE_DELTA = 0.4, -0.5, 0.2


def guardrail_routes(pairs: DataFrame) -> DataFrame:
    """Whether a candidate's evidence may replace the baseline's for a query: reasons, and the route that they lead to.

    pairs: query_id, a_ and b_ (baseline and candidate) of direct, correct (booleans), precision, recall, order, duplicates, and
    of the candidate b_doc (covered), b_buildable, b_truncated (count), b_over_budget.
    """
    a, b = (lambda name: F.col(f"a_{name}")), (lambda name: F.col(f"b_{name}"))
    recall_gain = b("recall") > a("recall")
    against = flags(
        candidate_direct_missing=~b("direct"),
        no_candidate_gain=a("direct") & ~recall_gain,
        doc_coverage_loss=~b("doc"),
        context_unstable=~b("buildable") | (b("truncated") > 0) | b("over_budget"),
        correctness_regression=a("correct") & ~b("correct"),
        precision_regression_without_recall_gain=(b("precision") < a("precision")) & ~recall_gain,
        low_evidence_order=b("order") < MIN_ORDER,
        evidence_order_drop=b("order") - a("order") < MAX_ORDER_DROP,
        duplicate_parent_over_limit=b("duplicates") - a("duplicates") > MAX_DUPLICATE_DELTA,
    )
    gains = flags(direct_ready_gain=b("direct") & ~a("direct"), citation_recall_gain=recall_gain)
    rows = pairs.select("query_id", against.alias("against"), gains.alias("gains"))
    any_of = lambda *names: F.arrays_overlap("against", F.array(*map(F.lit, names)))
    costly = any_of("precision_regression_without_recall_gain", "low_evidence_order", "evidence_order_drop", "duplicate_parent_over_limit")
    route = (
        F.when(F.size("against") == 0, "use_candidate_direct_gain")
        .when(any_of("correctness_regression"), "use_baseline_correctness_guardrail")
        .when(any_of("doc_coverage_loss"), "use_baseline_doc_guardrail")
        .when(costly & (F.size("gains") > 0), "manual_review_required")
        .when(costly, "use_baseline_precision_guardrail")
        .otherwise("use_baseline_no_candidate_gain")
    )
    reasons = F.when(F.size("against") == 0, F.array(F.lit("candidate_passed_guardrail"))).otherwise(F.concat("against", "gains"))
    return rows.select("query_id", F.array_join(reasons, ",").alias("block_reasons"), route.alias("route"), (F.size("against") > 0).alias("blocked"))


def reuse_by_fingerprint(requests: DataFrame, columns: list[str]) -> DataFrame:
    """query_id, run_label, reused: a request whose input equals an earlier run's for the same query is answered from it."""
    mark = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    w = Window.partitionBy("query_id", "mark").orderBy("run_label")
    return requests.withColumn("mark", mark).select("query_id", "run_label", (F.row_number().over(w) > 1).alias("reused"))


def policy_floor(packs: DataFrame, floors: DataFrame) -> DataFrame:
    """query_type, query_id, n_evidence and whether it reaches the type's floor; types without a floor pass."""
    rows = packs.join(floors, "query_type", "left")
    return rows.select("query_id", "query_type", "n_evidence", (F.col("n_evidence") >= F.coalesce("floor", F.lit(0))).alias("floor_met"))


#: Evidence that an answer of each query type must use at least, types that may fall back to the first policy, and the
#: policy under which stories always do.
LEAST_EVIDENCE = {"place_fact": 1, "place_story": 2, "relationship": 2, "overview": 2, "route_context": 1, "voice_followup": 2, "no_answer": 0}
MAY_FALL_BACK = ("place_story", "relationship", "voice_followup")
ROUTER = "v2_repair_query_type_router"


def prompt_policy(drafts: DataFrame, packs: DataFrame) -> DataFrame:
    """One row per draft: whether it uses evidence as its query type demands, and whether it passes, falls back or fails.

    drafts: query_id, query_type, expected, policy_id, has_draft, ranks (an array), coverage_intent, risk; packs: query_id, pack_rank. A query that
    expects no answer must have neither draft nor evidence. An unknown query type demands nothing.
    """
    available = packs.filter("pack_rank is not null").groupBy("query_id").agg(F.collect_set(F.col("pack_rank").cast("int")).alias("available"))
    least = F.coalesce(*(F.when(F.col("query_type") == t, F.lit(n)) for t, n in LEAST_EVIDENCE.items()), F.lit(0))
    rows = drafts.join(available, "query_id", "left").withColumns({"available": F.coalesce("available", F.array().cast("array<int>")), "min_required": least, "ranks": F.coalesce("ranks", F.array().cast("array<int>"))})
    abstains, drafted = F.col("expected") == "abstain", F.coalesce("has_draft", F.lit(False))
    judged = ~abstains & drafted
    invalid = F.when(judged, F.size(F.filter("ranks", lambda r: ~F.array_contains(F.col("available"), r)))).otherwise(0)
    selected = F.when(judged, F.size("ranks")).otherwise(0)
    faulty = abstains & (drafted | (F.size("available") > 0))
    floor = F.when(abstains, faulty).otherwise(~drafted | (selected < F.col("min_required")))
    intent = judged & (F.col("min_required") >= 2) & (F.coalesce("coverage_intent", F.lit("")) != "multi_evidence")
    risk = F.when(judged, (floor | intent) & (F.coalesce("risk", F.lit("")) == "low")).otherwise(~abstains)
    rows = rows.withColumns({"invalid_rank_count": invalid, "selected_count": selected, "evidence_floor_violation": floor, "coverage_intent_violation": intent, "unsupported_risk_violation": risk})
    story = judged & (F.col("policy_id") == ROUTER) & (F.col("query_type") == "place_story")
    short = F.col("evidence_floor_violation") | F.col("coverage_intent_violation")
    may = F.col("query_type").isin(*MAY_FALL_BACK)
    status = (
        F.when(abstains, F.when(faulty, "fail").otherwise("pass")).when(~drafted, "fail").when(F.col("invalid_rank_count") > 0, "fail").when(story, "fallback_required")
        .when(short, F.when(may, "fallback_required").otherwise("fail")).otherwise("pass")
    )
    tags = flags(
        unexpected_draft_for_abstain=abstains & drafted,
        abstain_with_evidence=abstains & (F.size("available") > 0),
        no_answer_abstain_path=abstains & ~faulty,
        missing_draft=~abstains & ~drafted,
        invalid_evidence_rank=F.col("invalid_rank_count") > 0,
        evidence_floor_violation=~abstains & F.col("evidence_floor_violation"),
        coverage_intent_violation=F.col("coverage_intent_violation"),
        unsupported_risk_too_low=judged & F.col("unsupported_risk_violation"),
        v1_fallback_required=story,
        monitor_only_query_type=story,
    )
    return rows.select(
        "query_id", "query_type", "policy_id", status.alias("status"), "selected_count", "min_required", F.size("available").alias("available_count"), "invalid_rank_count", "evidence_floor_violation",
        "coverage_intent_violation", "unsupported_risk_violation", (~abstains & may).alias("fallback_allowed"), F.when(F.size(tags) == 0, "policy_pass").otherwise(F.array_join(tags, ",")).alias("tags"),
    )


def prompt_policy_summary(rows: DataFrame) -> DataFrame:
    """One row: counts of the outcomes and of each violation, and whether the policy is ready for a dry run."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    made = rows.agg(
        F.count("*").alias("row_count"),
        F.countDistinct("query_type").alias("query_type_count"),
        F.countDistinct("policy_id").alias("policy_count"),
        is_("pass").alias("pass_count"),
        is_("fallback_required").alias("fallback_required_count"),
        is_("fail").alias("fail_count"),
        F.coalesce(F.sum("invalid_rank_count"), F.lit(0)).alias("invalid_rank_count"),
        *(F.count_if(c).alias(f"{c}_count") for c in ("evidence_floor_violation", "coverage_intent_violation", "unsupported_risk_violation")),
        F.count_if((F.col("query_type") == "no_answer") & (F.col("status") == "pass")).alias("no_answer_pass_count"),
    )
    return made.withColumn("decision", F.when(F.col("fail_count") == 0, "ready_for_repaired_prompt_dry_run").otherwise("reject_repaired_prompt_policy"))
