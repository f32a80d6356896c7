"""Packing evidence for a query under a budget of characters.

candidates: query_id, query_type, expected, doc_id (the child), parent_id, root_id, score, rank, text_length. Siblings come from
corpus: parent_id, root_id, doc_id, place (order within the parent), text_length. A query's few candidates make one array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackPolicy:
    budget: int = 4200
    items: int = 5
    expanded_items: int = 7
    voice_budget: int = 2600
    voice_items: int = 3
    window: int = 1
    parent_penalty: float = 0.25
    doc_penalty: float = 0.10


POLICIES = ("P0_rank_order", "P1_parent_expansion", "P2_best_first_with_parent", "P3_mmr_diversity", "P4_voice_compact")
_ITEM = ("doc_id", "parent_id", "root_id", "rank", "score", "text_length")


def _siblings(heads: DataFrame, corpus: DataFrame, window: int) -> DataFrame:
    """Each head with its neighbours in the parent, in the parent's order; they take its rank and score."""
    own = corpus.select("doc_id", "parent_id", F.col("place").alias("own_place"))
    near = corpus.select("parent_id", F.col("doc_id").alias("near_id"), "place", F.col("text_length").alias("near_length"))
    kept = ["query_id", "query_type", "expected", "parent_id", "root_id", "rank", "score", "ord"]
    made = heads.join(own, ["doc_id", "parent_id"]).join(near, "parent_id").filter(F.col("place").between(F.col("own_place") - window, F.col("own_place") + window))
    found = made.select(*kept, F.col("near_id").alias("doc_id"), F.col("near_length").alias("text_length"), "place")
    alone = heads.join(own, ["doc_id", "parent_id"], "left_anti").select(*kept, "doc_id", "text_length", F.lit(0).alias("place"))
    return found.unionByName(alone)


def ordered(candidates: DataFrame, corpus: DataFrame, policy: str, cfg: PackPolicy) -> DataFrame:
    """candidates with ord, the place in which the policy offers them; a child is offered once."""
    if policy == "P1_parent_expansion":
        rows = _siblings(candidates.withColumn("ord", F.col("rank")), corpus, cfg.window)
    elif policy == "P2_best_first_with_parent":
        w = Window.partitionBy("query_id", "parent_id")
        groups = candidates.withColumn("best", F.max("score").over(w)).withColumn("first", F.min("rank").over(w)).filter("rank = first")
        rows = _siblings(groups.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "first"))), corpus, cfg.window)
    else:
        rows = candidates.withColumn("ord", F.col("rank")).withColumn("place", F.lit(0))
        if policy == "P4_voice_compact":
            w = Window.partitionBy("query_id", "parent_id").orderBy("rank")
            rows = rows.withColumn("n", F.row_number().over(w)).filter("query_type <> 'voice_followup' or n = 1").drop("n")
    once = Window.partitionBy("query_id", "doc_id").orderBy("ord", "place")
    return rows.withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n")


def _mmr(items: Column, cfg: PackPolicy) -> Column:
    """Items in the order of scaled score less penalties for parents and documents already taken; ties to the better rank."""
    low, high = F.array_min(F.transform(items, lambda x: x["score"])), F.array_max(F.transform(items, lambda x: x["score"]))
    span = F.greatest(high - low, F.lit(1e-9))

    def step(taken: Column, _: Column) -> Column:
        left = F.filter(items, lambda x: ~F.exists(taken, lambda y: y["doc_id"] == x["doc_id"]))
        worth = F.transform(
            left,
            lambda x: F.struct(
                (
                    (x["score"] - low) / span
                    - cfg.parent_penalty * F.exists(taken, lambda y: y["parent_id"] == x["parent_id"]).cast("double")
                    - cfg.doc_penalty * F.exists(taken, lambda y: y["root_id"] == x["root_id"]).cast("double")
                ).alias("worth"),
                (-x["rank"]).alias("neg"),
                x.alias("item"),
            ),
        )
        return F.array_append(taken, F.array_max(worth)["item"])

    return F.aggregate(items, F.slice(items, 1, 0), step)


def _greedy(items: Column, budget: Column, most: Column) -> Column:
    """Items that fit, in order: one that doesn't is skipped, the first is always taken."""
    none = F.slice(items, 1, 0)

    def step(state: Column, x: Column) -> Column:
        size = F.size(state["taken"])
        fits = (size < most) & ((size == 0) | (state["used"] + x["text_length"] <= budget))
        return F.struct(F.when(fits, F.array_append(state["taken"], x)).otherwise(state["taken"]).alias("taken"), F.when(fits, state["used"] + x["text_length"]).otherwise(state["used"]).alias("used"))

    return F.aggregate(items, F.struct(none.alias("taken"), F.lit(0).cast("long").alias("used")), step, lambda s: s["taken"])


def pack(candidates: DataFrame, corpus: DataFrame, policy: str, cfg: PackPolicy | None = None) -> DataFrame:
    """Packed evidence: query_id, pack_rank, doc_id, parent_id, root_id, rank, score, text_length, clipped. Abstaining queries get none."""
    cfg = cfg or PackPolicy()
    rows = ordered(candidates.filter("expected <> 'abstain'"), corpus, policy, cfg)
    item = F.struct("ord", "place", *(F.col(c).cast("long").alias(c) if c in ("rank", "text_length") else F.col(c) for c in _ITEM))
    lists = rows.groupBy("query_id", "query_type").agg(F.array_sort(F.collect_list(item)).alias("items"))
    voice = (F.col("query_type") == "voice_followup") if policy == "P4_voice_compact" else F.lit(False)
    budget = F.when(voice, cfg.voice_budget).otherwise(cfg.budget)
    most = F.when(voice, cfg.voice_items).otherwise(cfg.expanded_items if policy == "P1_parent_expansion" else cfg.items)
    if policy == "P3_mmr_diversity":
        lists = lists.withColumn("items", _mmr(F.col("items"), cfg))
    packed = lists.select("query_id", budget.alias("budget"), F.posexplode(_greedy(F.col("items"), budget, most)).alias("p", "x"))
    return packed.select(
        "query_id", (F.col("p") + 1).alias("pack_rank"), *(F.col(f"x.{c}").alias(c) for c in _ITEM), ((F.col("p") == 0) & (F.col("x.text_length") > F.col("budget"))).alias("clipped")
    )


def pack_metrics(packs: DataFrame, targets: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: items, characters, coverage of targets at each grain, 1 / place of the first relevant item, duplicate rates.

    targets: query_id, doc_id, parent_id, root_id. Queries without evidence have zeros.
    """
    grains = ("doc_id", "parent_id", "root_id")
    rows = packs
    for g in grains:
        rows = rows.join(targets.select("query_id", g).distinct().withColumn(f"hit_{g}", F.lit(True)), ["query_id", g], "left")
    rows = rows.withColumn("hit", F.coalesce(*(F.col(f"hit_{g}") for g in grains), F.lit(False)))
    dup = lambda c: F.round(1 - F.countDistinct(c) / F.count("*"), 6)
    made = rows.groupBy("query_id").agg(
        F.count("*").alias("n_items"),
        F.sum("text_length").alias("chars"),
        *(F.coalesce(F.bool_or(f"hit_{g}"), F.lit(False)).alias(f"{n}_covered") for g, n in zip(grains, ("child", "parent", "doc"), strict=True)),
        F.min(F.when(F.col("hit"), F.col("pack_rank"))).alias("first"),
        dup("parent_id").alias("duplicate_parent_rate"),
        dup("root_id").alias("duplicate_doc_rate"),
    )
    out = queries.select("query_id").join(made, "query_id", "left").withColumn("order_proxy", F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6)).drop("first")
    return out.fillna(0, ["n_items", "chars", "duplicate_parent_rate", "duplicate_doc_rate"]).fillna(False, ["child_covered", "parent_covered", "doc_covered"])


def public_rows(packs: DataFrame, metrics: DataFrame, comparison_id: str, policy: str) -> DataFrame:
    """A row for each packed item, without texts; a query without evidence has one row, its item null, no characters, recoverable.

    metrics: query_id, query_type and what pack_metrics gives. An item is recoverable if its ids of all three grains are there.
    """
    item = packs.select(
        "query_id", "pack_rank", F.col("rank").alias("source_rank"), F.col("doc_id").alias("child_id"), "parent_id", F.col("root_id").alias("doc_id"), F.col("text_length").alias("estimated_chars"),
        (F.col("doc_id").isNotNull() & F.col("parent_id").isNotNull() & F.col("root_id").isNotNull()).alias("citation_recoverable"),
    )
    covered = ("child", "parent", "doc")
    of_pack = metrics.select("query_id", "query_type", *(F.col(f"{c}_covered").alias(f"target_{c}_covered") for c in covered))
    made = of_pack.join(item, "query_id", "left").fillna(0, ["estimated_chars"]).fillna(True, ["citation_recoverable"])
    return made.withColumns({"comparison_id": F.lit(comparison_id), "policy_id": F.lit(policy)})


def pack_summary(metrics: DataFrame) -> DataFrame:
    """By policy, and by policy and query type, in one pass; metrics has policy and query_type."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    made = metrics.groupingSets([["policy"], ["policy", "query_type"]], "policy", "query_type").agg(
        F.count("*").alias("n_queries"), share("child_covered"), share("parent_covered"), share("doc_covered"), share("order_proxy"), F.sum("chars").alias("chars"), F.grouping("query_type").alias("g")
    )
    return made.withColumn("query_type", F.when(F.col("g") == 1, "all").otherwise(F.col("query_type"))).drop("g")


def pack_deltas(summary: DataFrame, baseline: str) -> DataFrame:
    """policy and what each policy's totals in pack_summary() are above the baseline policy's. A row for each policy, so few."""
    shares = ("child_covered", "parent_covered", "doc_covered", "order_proxy", "chars")
    total = summary.filter("query_type = 'all'")
    base = total.filter(F.col("policy") == baseline).select(*(F.col(c).alias(f"b_{c}") for c in shares))
    return total.join(F.broadcast(base)).select("policy", *(F.round(F.col(c) - F.col(f"b_{c}"), 6).alias(f"delta_{c}") for c in shares))


def evidence_context(packs: DataFrame, texts: DataFrame, limit: int = 4200) -> DataFrame:
    """query_id and the context that its evidence makes: header and text of each item, joined by blank lines, within limit.

    An item that doesn't fit ends in '...'; what comes after it is left out.
    """
    rows = packs.join(texts.select("doc_id", F.trim("text").alias("text")), "doc_id").filter("text <> ''")
    part = F.concat(F.format_string("[evidence:%d] child_id=%s doc_id=%s\n", F.col("pack_rank"), F.col("doc_id").cast("string"), F.col("root_id").cast("string")), F.col("text"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pack_rank", part.alias("part")))).alias("items"))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(limit).alias("left"))

    def step(s: Column, x: Column) -> Column:
        own = F.when(F.length(x["part"]) > s["left"], F.concat(F.rtrim(F.substr(x["part"], F.lit(1), F.greatest(s["left"] - 3, F.lit(0)))), F.lit("..."))).otherwise(x["part"])
        more = s["left"] > 0
        return F.struct(F.when(more, F.array_append(s["parts"], own)).otherwise(s["parts"]).alias("parts"), F.when(more, s["left"] - F.length(own) - 2).otherwise(s["left"]).alias("left"))

    return lists.select("query_id", F.array_join(F.aggregate("items", start, step, lambda s: s["parts"]), "\n\n").alias("context"))


def input_stats(packs: DataFrame, texts: DataFrame, limit: int = 4200) -> DataFrame:
    """What evidence_context() would hold, without the texts: characters, items with text, and whether one was cut."""
    rows = packs.join(texts.select("doc_id", F.length(F.trim("text")).alias("n")), "doc_id").filter("n > 0")
    head = F.length(F.format_string("[evidence:%d] child_id=%s doc_id=%s\n", F.col("pack_rank"), F.col("doc_id").cast("string"), F.col("root_id").cast("string")))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pack_rank", (head + F.col("n")).alias("n")))).alias("items"))
    start = F.struct(F.lit(limit).alias("left"), F.lit(0).alias("chars"), F.lit(0).alias("cut"))

    def step(s: Column, x: Column) -> Column:
        over = x["n"] > s["left"]
        more = (s["left"] > 0) & (s["cut"] == 0)
        return F.struct(
            F.when(more, F.when(over, F.lit(0)).otherwise(s["left"] - x["n"] - 2)).otherwise(s["left"]).alias("left"),
            F.when(more, s["chars"] + F.least(x["n"], s["left"])).otherwise(s["chars"]).alias("chars"),
            F.when(more & over, F.lit(1)).otherwise(s["cut"]).alias("cut"),
        )

    done = lists.select("query_id", F.size("items").alias("n_text"), F.aggregate("items", start, step).alias("s"))
    return done.select("query_id", "n_text", F.col("s.chars").alias("context_chars"), F.col("s.cut").alias("truncated"))
