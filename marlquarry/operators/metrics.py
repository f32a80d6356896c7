"""Retrieval metrics, paired comparisons, intervals and gates.

qrels has query_id, doc_id and grade; queries has query_id and expected ('retrieve' or 'abstain'). Percentile, DCG and nDCG
variants are named: 'standard' keeps duplicate targets in the ideal list, 'unique' takes the best grade of each, 'clipped'
is at most 1, 'binary' looks at the first hit only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlquarry.functions.scalars import dcg_gain, flags, nearest_percentiles


def ideal_dcg(qrels: DataFrame, k: int = 5, variant: str = "standard") -> DataFrame:
    rows = qrels.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade")) if variant == "unique" else qrels
    w = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id")
    best = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return best.groupBy("query_id").agg(F.sum(dcg_gain(F.col("grade"), F.col("place"))).alias("ideal"))


def per_query(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 5, variant: str = "standard") -> DataFrame:
    """hit_1, hit_3, hit_5, rr and ndcg of each retrieve query; a missing result counts 0. overflow marks nDCG above 1."""
    grades = qrels.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))
    judged = ranked.filter(F.col("rank") <= k).join(grades, ["query_id", "doc_id"], "left").withColumn("g", F.coalesce("grade", F.lit(0)))
    hit = lambda n: F.max(F.when((F.col("rank") <= n) & (F.col("g") > 0), 1.0).otherwise(0.0))
    own = judged.groupBy("query_id").agg(
        hit(1).alias("hit_1"),
        hit(3).alias("hit_3"),
        hit(5).alias("hit_5"),
        F.min(F.when(F.col("g") > 0, F.col("rank"))).alias("first"),
        F.sum(dcg_gain(F.col("g"), F.col("rank"))).alias("dcg"),
    )
    rows = queries.filter("expected = 'retrieve'").select("query_id").join(own, "query_id", "left").join(ideal_dcg(qrels, k, variant), "query_id", "left")
    if variant == "binary":
        ndcg: Column = F.when(F.col("first") <= k, 1.0 / F.log2(F.col("first") + 1.0)).otherwise(0.0)
    else:
        ndcg = F.coalesce(F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0)), F.lit(0.0))
    if variant == "clipped":
        ndcg = F.least(ndcg, F.lit(1.0))
    return rows.select(
        "query_id",
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("hit_1", "hit_3", "hit_5")),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        ndcg.alias("ndcg"),
        (ndcg > 1).alias("overflow"),
    )


MEANS = {"recall_1": "hit_1", "recall_3": "hit_3", "recall_5": "hit_5", "mrr": "rr", "ndcg_5": "ndcg"}


def summarize(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of per_query() rows; by: grouping columns, totals come from summarize(rows)."""
    aggs = [F.count("*").alias("n_queries"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n) for n, c in MEANS.items())]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def breakdown(rows: DataFrame, column: str) -> DataFrame:
    """The same by a column and in all, in one pass; the total has 'all' there."""
    aggs = [F.count("*").alias("n_queries"), *(F.round(F.avg(c), 6).alias(n) for n, c in MEANS.items())]
    made = rows.groupingSets([[column], []], column).agg(*aggs, F.grouping(column).alias("g"))
    return made.withColumn(column, F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col(column))).drop("g")


def abstain_counts(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Retrieve queries without results, and abstain queries that got candidates."""
    found = queries.join(ranked.select("query_id").distinct().withColumn("found", F.lit(True)), "query_id", "left")
    return found.agg(
        F.sum(F.when((F.col("expected") == "retrieve") & F.col("found").isNull(), 1).otherwise(0)).alias("missing_count"),
        F.sum(F.when((F.col("expected") == "abstain") & F.col("found"), 1).otherwise(0)).alias("abstain_with_candidate_count"),
    )


def deltas(summary: DataFrame, baseline: str) -> DataFrame:
    """Each run's means less those of the run that baseline names; summary has run_label."""
    base = summary.filter(F.col("run_label") == baseline).select(*(F.col(m).alias(f"base_{m}") for m in MEANS)).limit(1)
    return summary.join(base).select("run_label", *(F.round(F.col(m) - F.col(f"base_{m}"), 6).alias(f"delta_{m}") for m in MEANS))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """per_query() rows of two runs side by side, with deltas b - a."""
    metrics = list(MEANS.values())
    side = lambda x, n: x.select("query_id", *(F.col(m).alias(f"{n}_{m}") for m in metrics))
    both = side(a, "a").join(side(b, "b"), "query_id")
    return both.select("*", *(F.round(F.col(f"b_{m}") - F.col(f"a_{m}"), 6).alias(f"delta_{m}") for m in metrics))


def long_facts(pairs: DataFrame) -> DataFrame:
    """query_id, metric and value for each metric of paired(): one row to a fact."""
    return pairs.unpivot("query_id", [c for c in pairs.columns if c != "query_id"], "metric", "value")


def hit_overlap(a: DataFrame, b: DataFrame, queries: DataFrame, names: tuple[str, str] = ("bm25", "dense")) -> DataFrame:
    """query_id and hit_group: both_hit, one of the two alone, both_fail, or abstain."""
    hit = lambda x, n: x.select("query_id", (F.col("hit_5") > 0).alias(n))
    rows = queries.join(hit(a, "x"), "query_id", "left").join(hit(b, "y"), "query_id", "left").fillna(False, ["x", "y"])
    group = (
        F.when(F.col("expected") == "abstain", "abstain")
        .when(F.col("x") & F.col("y"), "both_hit")
        .when(F.col("x"), f"{names[0]}_only")
        .when(F.col("y"), f"{names[1]}_only")
        .otherwise("both_fail")
    )
    return rows.select("query_id", group.alias("hit_group"))


def overlap_summary(groups: DataFrame) -> DataFrame:
    """Counts of each group and the recall of an oracle that takes the better list."""
    n = lambda *g: F.sum(F.when(F.col("hit_group").isin(*g), 1).otherwise(0))
    made = groups.agg(
        *(F.count_if(F.col("hit_group").endswith(g)).alias(name) for g, name in (("both_hit", "both_hit"), ("both_fail", "both_fail"), ("abstain", "abstain"))),
        n("bm25_only").alias("bm25_only"),
        n("dense_only").alias("dense_only"),
        F.sum(F.when(F.col("hit_group") != "abstain", 1).otherwise(0)).alias("answerable"),
    )
    union = (F.col("both_hit") + F.col("bm25_only") + F.col("dense_only")) / F.nullif(F.col("answerable"), F.lit(0))
    return made.withColumn("oracle_union_recall", F.round(F.coalesce(union, F.lit(0.0)), 6))


def bootstrap_ci(values: DataFrame, resamples: int = 10_000, seed: int = 42, multiplier: int = 1_103_515_245) -> DataFrame:
    """Mean of values (value) and the 2.5 and 97.5 percentiles of resampled means, interpolated.

    Draw j of resample i takes the value at an arithmetic hash of i, j and seed, so SQL anywhere repeats it. Values must
    be few, one per query: their numbered list is joined with resamples * n draws on the number.
    """
    spark = values.sparkSession
    w = Window.orderBy("value", "query_id")
    listed = values.withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    n = values.agg(F.count("*").alias("n"))
    draws = spark.range(resamples).withColumnRenamed("id", "i").join(n).select("i", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("j"))
    x = (F.col("i") * 7919 + F.col("j") * 104729 + seed) % 2147483648
    for _ in range(2):
        x = (x * multiplier + 12345) % 2147483648
    draws = draws.select("i", (F.floor(x / 65536) % F.col("n")).cast("long").alias("place"))
    means = draws.join(listed, "place").groupBy("i").agg(F.avg("value").alias("m"))
    interval = means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("ci_low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("ci_high"))
    return values.agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n")).join(interval)


def _resampled(seed: int, n: int, totals: list[int], step: int):
    """Sums of one range of values over the draws that each of a block of resamples takes from it."""

    def run(key: tuple, hist: pa.Table) -> pa.Table:
        part, block = key[0].as_py(), key[1].as_py()
        hist = hist.sort_by("value")
        values, share = hist["value"].to_numpy(), hist["c"].to_numpy() / totals[part]
        weights = np.array(totals) / n
        sums = []
        for i in range(block * step, (block + 1) * step):
            # A resample's draws depend on the seed, its number and the range alone.
            own = np.random.Generator(np.random.Philox(key=[seed, i])).multinomial(n, weights)[part]
            taken = np.random.Generator(np.random.Philox(key=[seed + 1 + part, i])).multinomial(own, share)
            sums.append(float(taken @ values))
        return pa.table([pa.array(range(block * step, (block + 1) * step), pa.int64()), pa.array(sums, pa.float64())], names=["i", "s"])

    return run


def bootstrap_interval(values: DataFrame, resamples: int = 10_000, seed: int = 42, most: int = 50_000, step: int = 500) -> DataFrame:
    """mean, n, ci_low, ci_high: the mean of values (value) and the 2.5 and 97.5 percentiles of resampled means, interpolated.

    A resample of n draws is a multinomial count of the distinct values, so it costs a draw for each of these and not one for
    each row. Distinct values are dealt to ranges of about `most`; a resample's draws fall to the ranges by a multinomial too, and each range
    counts its own, which together is the same. Rows made: resamples for each range. Draws come from counters, so any task, and a task that
    runs again, makes the same. Null values are left out; without values the interval is null.
    """
    if resamples % step:
        raise ValueError("resamples must be a multiple of step")
    hist = values.filter("value is not null").groupBy(F.col("value").cast("double").alias("value")).agg(F.count("*").alias("c"))
    ranges = max(1, -(-hist.count() // most))
    hist = hist.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(ranges)).cast("int"))
    found = {r["part"]: r["n"] for r in hist.groupBy("part").agg(F.sum("c").alias("n")).collect()}
    totals = [found.get(p, 0) for p in range(ranges)]
    blocks = hist.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(resamples // step - 1))))
    means = blocks.groupBy("part", "block").applyInArrow(_resampled(seed, sum(totals), totals, step), "i long, s double").groupBy("i").agg((F.sum("s") / max(1, sum(totals))).alias("m"))
    ends = means.agg(*(F.round(F.percentile("m", F.lit(p)), 6).alias(c) for c, p in (("ci_low", 0.025), ("ci_high", 0.975))))
    return values.agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n")).join(ends)


def latency_percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """p50 and p95 of value by group, nearest-rank and interpolated."""
    linear = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50_linear"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95_linear")
    )
    near = nearest_percentiles(rows, [by], value, {"p50_nearest": 0.5, "p95_nearest": 0.95}).withColumnRenamed(by, "_by")
    made = linear.join(near, F.col(by).eqNullSafe(F.col("_by")), "left")
    return made.select(by, "n", *(F.round(c, 6).alias(c) for c in ("p50_nearest", "p95_nearest")), "p50_linear", "p95_linear")


def grain_coverage(ranked: DataFrame, grains: DataFrame, targets: DataFrame, queries: DataFrame) -> DataFrame:
    """Least rank at which a result matches a target at child, parent and document grain, and tags of what was missed.

    grains: doc_id, parent_id, root_id; targets: query_id with the same three.
    """
    rows = ranked.select("query_id", "doc_id", "rank").join(grains, "doc_id")
    out = queries.filter("expected = 'retrieve'").select("query_id")
    for grain, name in (("doc_id", "child"), ("parent_id", "parent"), ("root_id", "doc")):
        hit = rows.select("query_id", grain, "rank").join(targets.select("query_id", grain).distinct(), ["query_id", grain]).groupBy("query_id").agg(F.min("rank").alias(f"{name}_rank"))
        out = out.join(hit, "query_id", "left")
    tags = flags(
        child_miss=F.col("child_rank").isNull(),
        parent_miss=F.col("parent_rank").isNull(),
        doc_miss=F.col("doc_rank").isNull(),
        late_child=F.col("child_rank") > 1,
        doc_only=F.col("doc_rank").isNotNull() & F.col("parent_rank").isNull(),
    )
    return out.withColumn("tags", F.array_join(tags, ","))


def greedy_block_gains(candidates: Column, gold: Column) -> Column:
    """Gains of rank-ordered candidates (arrays of blocks), each taking the best unused gold target that it contains.

    gold: array of struct(grade, blocks). Ties of grade go to the first target. A fold over the few candidates of a query.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("gains"))

    def step(state: Column, blocks: Column) -> Column:
        fits = F.filter(
            F.transform(gold, lambda g, i: F.struct((-g["grade"]).alias("k"), i.alias("i"), (F.size(F.array_except(g["blocks"], blocks)) == 0).alias("in"))),
            lambda e: e["in"] & ~F.array_contains(state["used"], e["i"]),
        )
        best = F.array_min(fits)
        return F.struct(
            F.when(best.isNull(), state["used"]).otherwise(F.array_append(state["used"], best["i"])).alias("used"),
            F.array_append(state["gains"], F.coalesce(-best["k"], F.lit(0)).cast("int")).alias("gains"),
        )

    return F.aggregate(candidates, start, step, lambda s: s["gains"])


def promotion_gate(runs: DataFrame, baseline: str) -> DataFrame:
    """Per run: recoverability of .99, p95 of 2,500 ms at most, no recall lost in any type, and .03 gained in some metric.

    runs: run_label, query_type, recall_5, mrr, ndcg_5, recoverability, p95_ms.
    """
    base = runs.filter(F.col("run_label") == baseline).select("query_type", *(F.col(c).alias(f"b_{c}") for c in ("recall_5", "mrr", "ndcg_5")))
    rows = runs.filter(F.col("run_label") != baseline).join(base, "query_type")
    gain = F.greatest(*(F.avg(F.col(c) - F.col(f"b_{c}")) for c in ("recall_5", "mrr", "ndcg_5")))
    made = rows.groupBy("run_label").agg(
        F.min("recoverability").alias("recoverability"),
        F.max("p95_ms").alias("p95_ms"),
        F.bool_and(F.col("recall_5") >= F.col("b_recall_5")).alias("no_regression"),
        F.round(gain, 6).alias("gain"),
    )
    failed = flags(
        recoverability=F.col("recoverability") < 0.99, latency=F.col("p95_ms") > 2500, regression=~F.col("no_regression"), gain=F.col("gain") < 0.03
    )
    return made.withColumn("failures", F.array_join(failed, ",")).withColumn("promoted", F.col("failures") == "")
