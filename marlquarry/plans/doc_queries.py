"""Queries on documents, chunks, evidence, routing, quality, speech, graphs and windows, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlquarry.functions import scalars as S
from marlquarry.functions.lineage import shared_folder, written
from marlquarry.operators import artifacts as A
from marlquarry.operators import chunking as C
from marlquarry.operators import evidence as E
from marlquarry.operators import graph as G
from marlquarry.operators import normalize as N
from marlquarry.operators import quality as Q
from marlquarry.operators import rewriting as X
from marlquarry.operators import routing as R
from marlquarry.operators import speech as V
from marlquarry.plans import inputs as I
from marlquarry.plans import rank_queries as K
from marlquarry.streaming import windows as W

HINTS = ("the", "and", "of", "tion")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return N.line_blocks(I.documents(spark, sf))


def normalize_pages(spark: SparkSession, sf: str) -> DataFrame:
    text = N.element_text(F.col("html"))
    return I.table(spark, sf, "pages").select("page_id", F.sha2(text, 256).alias("text_hash"), F.char_length(text).cast("long").alias("text_length"), N.page_number(F.regexp_extract("url", "[^/]*$", 0)).cast("long").alias("page_number"))


def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    return N.html_elements(I.table(spark, sf, "pages")).select("page_id", F.col("ord").cast("long").alias("ord"), "tag", "text_length")


def page_offsets(spark: SparkSession, sf: str) -> DataFrame:
    counts = I.lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("page_count"))
    return N.page_offsets(counts)


def block_quality(spark: SparkSession, sf: str) -> DataFrame:
    return N.block_quality(blocks(spark, sf))


def parser_quality(spark: SparkSession, sf: str) -> DataFrame:
    expected = I.documents(spark, sf).select("doc_id", F.size(F.split("text", "\n")).alias("expected_pages"))
    rows = blocks(spark, sf).withColumn("page_global", F.col("element_index"))
    return N.parser_quality(rows, expected)


def leak_scan(spark: SparkSession, sf: str) -> DataFrame:
    made = I.documents(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame(I.LEAKY, "doc_id long, text string"))
    return N.leak_flags(made, "doc_id", "text")


def line_leaks(spark: SparkSession, sf: str) -> DataFrame:
    told = spark.createDataFrame(I.LEAKY, "doc_id long, text string").unionByName(spark.createDataFrame(I.TOLD, "doc_id long, text string"))
    return N.line_leaks(I.documents(spark, sf).select("doc_id", "text").unionByName(told), "doc_id", "text")


def consecutive_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return N.consecutive_blocks(I.lines(spark, sf))


def artifact_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in up to 40 levels of objects and lists, turns as result rows, and strings with known leaks."""
    docs, level = I.documents(spark, sf), F.pmod("doc_id", F.lit(41)).cast("int")
    whole = {"ignoreNullFields": "false"}
    inner = F.to_json(F.struct(F.lit(1).alias("rank"), "source", F.struct("lang", "n_chars").alias("meta"), F.split("text", "\n").alias("lines")), whole)
    nested = docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("artifact_id"), F.concat(F.expr("repeat('{\"in\":[', cast(pmod(doc_id, 41) as int))"), inner, F.repeat(F.lit("]}"), level)).alias("payload"))
    row = lambda name: F.to_json(F.struct(F.array(F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "role", F.col("text").alias(name))).alias("results"), F.array("role").alias("raw_text")), whole)
    turns = I.table(spark, sf, "conversations").select(F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.when(F.pmod("turn", F.lit(2)) == 0, row("answer")).otherwise(row("note")))
    told = spark.createDataFrame(I.LEAKY, "doc_id long, text string").select(F.concat(F.lit("told:"), F.col("doc_id").cast("string")), F.to_json(F.struct(F.col("text").alias("value")), whole))
    cut = spark.createDataFrame([("cut", '{"a": ["b"')], "artifact_id string, payload string")
    blocks = N.consecutive_blocks(I.lines(spark, sf)).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("artifact_id"), "n_blocks")
    return A.artifact_quality(nested.union(turns).union(told).union(cut), blocks)


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return N.stratified_first(I.documents(spark, sf).select("doc_id", "source"), "source", "doc_id", 3)


def parent_segments(spark: SparkSession, sf: str) -> DataFrame:
    return C.parent_segments(blocks(spark, sf), C.ChunkPolicy())


def child_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.chunks(blocks(spark, sf), C.ChunkPolicy()).filter("child_no >= 0")
    return C.assemble(rows, blocks(spark, sf))


def child_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.chunks(blocks(spark, sf), C.ChunkPolicy()).filter("child_no >= 0")
    return rows.select("child_id", "parent_id", "doc_id", "n_blocks", "text_length")


def _report_blocks(spark: SparkSession, sf: str) -> DataFrame:
    made = blocks(spark, sf).join(I.documents(spark, sf).select("doc_id", "source"), "doc_id")
    refs = F.when(F.pmod("doc_id", F.lit(97)) == 5, F.array().cast("array<string>")).otherwise(F.array("block_id"))
    return made.withColumns({"element_refs": refs, "source_file": F.when(F.pmod("doc_id", F.lit(101)) != 7, F.col("source"))})


def chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the documents' chunks, in which a few are spoilt in each way that it counts."""
    of = lambda n: F.pmod("doc_id", F.lit(n))
    rows = C.chunks(blocks(spark, sf), C.ChunkPolicy()).withColumns({"page_start": F.lit(1), "page_end": F.when(of(89) == 3, 0).otherwise(1)})
    rows = rows.filter(~((F.col("child_no") < 0) & (of(83) == 1)))
    strange = F.when(of(73) == 4, F.array(F.lit("lost"))).when(of(71) == 5, F.array(F.format_string("block-%d-00000", F.col("doc_id") + 1))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("block_ids", F.when(F.col("child_no") == 0, F.concat("block_ids", strange)).otherwise(F.col("block_ids")))
    again = rows.filter((F.col("child_no") == 0) & (of(79) == 2))
    return C.chunk_report(_report_blocks(spark, sf), rows.unionByName(again), C.ChunkPolicy(), {"private_path_leakage_count": 2})


def chunk_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the documents' chunks as they are."""
    whole = blocks(spark, sf).withColumns({"element_refs": F.array("block_id"), "source_file": F.lit("documents")})
    rows = C.chunks(whole, C.ChunkPolicy()).withColumns({"page_start": F.lit(1), "page_end": F.lit(1)})
    return C.chunk_report(whole, rows, C.ChunkPolicy())


def chunk_ablation(spark: SparkSession, sf: str) -> DataFrame:
    rel = I.relevance(spark, sf)
    return C.ablation(blocks(spark, sf), I.judged_queries(spark, sf, rel), rel)


def _grains(spark: SparkSession, sf: str) -> DataFrame:
    return I.documents(spark, sf).select("doc_id", F.concat("source", F.lit(":"), "lang").alias("parent_id"), F.col("source").alias("root_id"), F.length("text").alias("text_length"))


def _evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rel = I.relevance(spark, sf)
    kind = F.when(F.pmod("query_id", F.lit(3)) == 0, "voice_followup").otherwise("place_fact")
    queries = I.judged_queries(spark, sf, rel).select("query_id", "expected", kind.alias("query_type"))
    grains = _grains(spark, sf)
    # A few rows for each query, which every policy reads.
    ranked = written(K._bm25(spark, sf, 20).join(grains, "doc_id").join(queries, "query_id"), "candidates")
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("doc_id"))
    return ranked, grains.withColumn("place", place), rel.join(grains, "doc_id").select("query_id", "doc_id", "parent_id", "root_id"), queries


def _pack(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ranked, corpus, _, _ = _evidence(spark, sf)
        return E.pack(ranked, corpus, policy).select("query_id", "pack_rank", "doc_id", "parent_id", "rank", "text_length", "clipped")

    return run


def pack_metrics(spark: SparkSession, sf: str) -> DataFrame:
    ranked, corpus, targets, queries = _evidence(spark, sf)
    return E.pack_metrics(E.pack(ranked, corpus, E.POLICIES[0]), targets, queries)


def public_pack_rows(spark: SparkSession, sf: str) -> DataFrame:
    ranked, corpus, targets, queries = _evidence(spark, sf)
    packs = E.pack(ranked, corpus, E.POLICIES[0])
    metrics = E.pack_metrics(packs, targets, queries).join(queries.select("query_id", "query_type"), "query_id")
    return E.public_rows(packs, metrics, "first", E.POLICIES[0])


def pack_summary(spark: SparkSession, sf: str) -> DataFrame:
    ranked, corpus, targets, queries = _evidence(spark, sf)
    made = None
    for policy in E.POLICIES:
        own = E.pack_metrics(E.pack(ranked, corpus, policy), targets, queries).join(queries.select("query_id", "query_type"), "query_id").withColumn("policy", F.lit(policy))
        made = own if made is None else made.unionByName(own)
    return E.pack_summary(made)


def pack_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return E.pack_deltas(pack_summary(spark, sf), E.POLICIES[0])


def evidence_context(spark: SparkSession, sf: str) -> DataFrame:
    ranked, corpus, _, _ = _evidence(spark, sf)
    made = E.evidence_context(E.pack(ranked, corpus, E.POLICIES[0]), I.documents(spark, sf))
    return made.select("query_id", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("digest"))


def evidence_stats(spark: SparkSession, sf: str) -> DataFrame:
    ranked, corpus, _, _ = _evidence(spark, sf)
    return E.input_stats(E.pack(ranked, corpus, E.POLICIES[0]), I.documents(spark, sf))


def citation_eval(spark: SparkSession, sf: str) -> DataFrame:
    ranked, corpus, targets, queries = _evidence(spark, sf)
    drafts = queries.select("query_id", F.lit("an answer").alias("answer"), F.when(F.pmod("query_id", F.lit(2)) == 0, F.array(F.lit(2), F.lit(1))).alias("selected"))
    answers = Q.assemble_answers(E.pack(ranked, corpus, E.POLICIES[0]), drafts)
    return Q.citation_scores(answers, targets, queries.select("query_id", "expected"))


def citation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Q.citation_summary(citation_eval(spark, sf))


def generation_record(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that are the passages asked with, spoken as their first sentences, and cite packed evidence."""
    ranked, corpus, targets, queries = _evidence(spark, sf)
    told = I.passages(spark, sf).select("query_id", "query_text")
    chosen = F.when(F.pmod("query_id", F.lit(2)) == 0, F.array(F.lit(2), F.lit(1)))
    drafts = queries.join(told, "query_id").select("query_id", F.col("query_text").alias("answer"), chosen.alias("selected"))
    answers = Q.assemble_answers(E.pack(ranked, corpus, E.POLICIES[0]), drafts).join(told, "query_id")
    answers = answers.withColumns({
        "spoken_answer": F.concat(F.substring_index("query_text", ".", 1), F.lit(".")), "risk": F.when(F.pmod("query_id", F.lit(7)) == 0, "high").otherwise("low"),
        "place_ids": F.slice(F.transform("citations", lambda c: c["root_id"]), 1, 1),
    })
    places = targets.groupBy("query_id").agg(F.array_distinct(F.array(F.min("root_id"), F.max("root_id"))).alias("p"))
    wanted = F.when(F.pmod("query_id", F.lit(5)) != 0, F.col("p"))
    return Q.generation_records(answers, targets, queries.join(places, "query_id", "left").select("query_id", "expected", "query_type", wanted.alias("place_ids")))


def generation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Q.generation_summary(generation_record(spark, sf))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.select("conv_id", "turn", "role", "text", F.lag("text").over(w).alias("user_context")).filter("role = 'user'")
    rows = rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query_text"), F.pmod("turn", F.lit(3)).alias("n_places"), (F.col("turn") > 0).alias("has_context"), "user_context"
    )
    asked = spark.createDataFrame(I.QUESTIONS, "query_id long, query_text string, n_places int, user_context string")
    return rows.unionByName(asked.withColumn("has_context", F.col("user_context").isNotNull()))


def classify_turns(spark: SparkSession, sf: str) -> DataFrame:
    made = R.classify(_turns(spark, sf))
    return made.select("query_id", "predicted", "confidence", "fallback_used")


def guard_turns(spark: SparkSession, sf: str) -> DataFrame:
    return R.guard(R.classify(_turns(spark, sf))).select("query_id", "predicted", "guarded", "guard_applied", "guard_reasons")


def route_turns(spark: SparkSession, sf: str) -> DataFrame:
    made = R.route(R.guard(R.classify(_turns(spark, sf))))
    return made.groupBy("guarded", "execution_mode").agg(F.count("*").alias("n"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with the type that the rules give them, whether they expect an answer, and places that some are given."""
    given = F.when(F.col("n_places") > 0, F.array(F.concat(F.lit("n"), F.pmod("query_id", F.lit(30)).cast("string")), F.lit("bukchon"))).otherwise(F.array().cast("array<string>"))
    typed = R.classify(_turns(spark, sf))
    return typed.select("query_id", F.col("predicted").alias("query_type"), "query_text", "user_context", F.when(F.pmod("query_id", F.lit(17)) == 0, "abstain").otherwise("retrieve").alias("expected"), given.alias("place_ids"))


def rewrite_followups(spark: SparkSession, sf: str) -> DataFrame:
    return X.rewrite_queries(_asked(spark, sf), I.places(spark, sf))


def rewrite_summary(spark: SparkSession, sf: str) -> DataFrame:
    made = rewrite_followups(spark, sf).withColumns({"invalid": F.col("rewritten") == "", "abstains": F.col("rules") == "no_answer_guard"})
    return R.rewrite_summary(made)


def name_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in whose whole text the longest word of a benchmark passage stands as a name."""
    longest = F.array_max(F.transform(S.tokens("text"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    names = I.table(spark, sf, "benchmark").select("item_id", longest.alias("name"))
    texts = I.documents(spark, sf).select("doc_id", X.lookup_text(F.col("text")).alias("text"))
    return X.mentions(texts, names, "doc_id").join(names, "name").select("doc_id", "item_id", "name")


def _label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "labels").join(I.documents(spark, sf).select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", F.col("quality").cast("string").alias("expected"), F.when(F.length("text") > 1000, "1").otherwise("0").alias("predicted"))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return R.confusion(_label_pairs(spark, sf))


def class_prf(spark: SparkSession, sf: str) -> DataFrame:
    return R.class_scores(_label_pairs(spark, sf), spark.createDataFrame([("0",), ("1",), ("2",)], "label string"))


def label_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.label_summary(_label_pairs(spark, sf), spark.createDataFrame([("0",), ("1",), ("2",)], "label string"))


def tradeoff_tags(spark: SparkSession, sf: str) -> DataFrame:
    d = lambda c: F.col(f"b_{c}") - F.col(f"a_{c}")
    of = lambda n: F.pmod("query_id", F.lit(n))
    pairs = K.M.paired(*K._runs(spark, sf)).select(
        "query_id", F.when(of(5) == 0, "no_answer").otherwise("place_fact").alias("query_type"), d("hit_1").alias("d_precision"), d("hit_5").alias("d_recall"), d("hit_3").alias("d_correct"),
        (of(7) - 4).alias("d_citations"), F.when(of(6) == 0, 1).otherwise(0).alias("d_unsupported"), (of(3) - 1).alias("d_ms"),
    )
    return Q.tradeoff_tags(pairs)


def _two_packs(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of the first policy and of the parent-boosting one, side by side; covered targets stand for what answers cite."""
    ranked, corpus, targets, queries = _evidence(spark, sf)

    def side(policy: str, n: str) -> DataFrame:
        m = E.pack_metrics(E.pack(ranked, corpus, policy), targets, queries)
        named = {"direct": F.col("child_covered") | F.col("parent_covered"), "doc": F.col("doc_covered"), "correct": F.col("child_covered"), "precision": F.col("child_covered").cast("double"), "recall": F.round(1 - F.col("duplicate_doc_rate"), 6)}
        named |= {"order": F.col("order_proxy"), "duplicates": F.col("duplicate_parent_rate"), "buildable": F.col("n_items") > 0, "truncated": F.pmod("query_id", F.lit(11)) - 9, "over_budget": F.col("chars") > 4200, "ms": F.col("n_items")}
        return m.select("query_id", *(c.alias(f"{n}_{k}") for k, c in named.items()))

    return side(E.POLICIES[0], "a").join(side(E.POLICIES[2], "b"), "query_id")


def guardrail_routes(spark: SparkSession, sf: str) -> DataFrame:
    return Q.guardrail_routes(_two_packs(spark, sf))


def regression_tags(spark: SparkSession, sf: str) -> DataFrame:
    return Q.regression_tags(_two_packs(spark, sf))


def postings_expand(spark: SparkSession, sf: str) -> DataFrame:
    return G.expand(written(G.postings(I.documents(spark, sf)), "postings"), written(G.query_tokens(I.passages(spark, sf)), "tokens"))


def graph_score(spark: SparkSession, sf: str) -> DataFrame:
    return G.graph_rank(I.documents(spark, sf), I.passages(spark, sf), K._bm25(spark, sf, 20), "entity_path", HINTS)


def graph_community(spark: SparkSession, sf: str) -> DataFrame:
    return G.graph_rank(I.documents(spark, sf), I.passages(spark, sf), K._bm25(spark, sf, 20), "community_hint", HINTS)


def _tree(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = I.documents(spark, sf).withColumn("parent_id", F.concat("source", F.lit(":"), "lang")).withColumn("root_id", F.col("source"))
        return G.tree_rank(docs, I.passages(spark, sf), K._bm25(spark, sf, 20), strategy, HINTS)

    return run


def _heard(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of conversation turns that follow each other, and a few of Korean."""
    rows = I.table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("reference"), F.lead("text").over(w).alias("heard"))
    return pairs.filter("heard is not null").unionByName(spark.createDataFrame(I.SPOKEN, "pair_id long, reference string, heard string"))


def wer_cer(spark: SparkSession, sf: str) -> DataFrame:
    return V.error_rates(_heard(spark, sf))


def cer(spark: SparkSession, sf: str) -> DataFrame:
    return _heard(spark, sf).select("pair_id", F.round(V.character_error(F.col("reference"), F.col("heard")), 6).alias("cer"))


def char_f1(spark: SparkSession, sf: str) -> DataFrame:
    return V.character_f1(_heard(spark, sf), "pair_id")


def speech_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _heard(spark, sf).select("pair_id", F.round(V.sequence_ratio("reference", "heard"), 6).alias("ratio"))


def score_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "labels").join(I.documents(spark, sf).select("doc_id", "source"), "doc_id")
    return Q.score_aggregates(rows, "source", "quality")


def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    return Q.dataset_profile(I.documents(spark, sf), "source", "lang")


def dataset_shortfall(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.documents(spark, sf)
    domain = docs.select("source").distinct().join(docs.select("lang").distinct())
    return Q.shortfall(docs, domain, ["source", "lang"], 12)


def order_subset(spark: SparkSession, sf: str) -> DataFrame:
    wanted = {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}
    return Q.subset(I.table(spark, sf, "orders"), wanted, ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "o_orderpriority")


def input_faults(spark: SparkSession, sf: str) -> DataFrame:
    asked = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_acctbal") > 0, "F").otherwise("O").alias("query_type"))
    return Q.input_faults(asked, I.table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderstatus").alias("query_type")))


def benchmark_rubric(spark: SparkSession, sf: str) -> DataFrame:
    items = I.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "test").otherwise("dev").alias("split"),
        F.lit("overview").alias("query_type"),
        F.when(F.col("o_orderstatus") == "F", "locked").otherwise(F.col("o_orderpriority")).alias("review_status"),
        F.lit("retrieve").alias("expected"),
        (F.col("o_totalprice") < 0).alias("requires_context"),
        F.lit(None).cast("string").alias("user_context"),
        F.lit(1).alias("n_child_targets"),
    )
    return Q.benchmark_rubric(items)


def resolvability(spark: SparkSession, sf: str) -> DataFrame:
    return Q.resolvability(I.table(spark, sf, "labels"), I.documents(spark, sf), "doc_id")


def table_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return Q.manifest(I.table(spark, sf, "orders"), "o_orderkey")


def catalog_quality(spark: SparkSession, sf: str) -> DataFrame:
    nation = I.table(spark, sf, "nation")
    places = nation.select(F.col("n_nationkey").alias("place_id"))
    aliases = nation.select(F.col("n_nationkey").alias("place_id"), F.substring("n_name", 1, 2).alias("alias"))
    edges = nation.select(F.col("n_nationkey").alias("place_id"), (F.col("n_regionkey") * 7).alias("target"))
    return Q.catalog_quality(places, aliases, edges)


def event_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return W.tumbling(I.table(spark, sf, "events"))


def event_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return W.sliding(I.table(spark, sf, "events"))


def event_session(spark: SparkSession, sf: str) -> DataFrame:
    return W.sessions(I.table(spark, sf, "events"))


def event_session_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The sessions as a stream writes them: one run takes the events, the next, from the same checkpoint, closes what is open."""
    folder, events = shared_folder(spark, "sessions"), f"{sf}/events.parquet*"
    paths = events, f"{folder}/ticks", f"{folder}/out", f"{folder}/mark"
    W.stream_sessions(spark, *paths)
    W.close_sessions(spark, *paths[:2])
    kind = I.table(spark, sf, "events").schema["ts"].dataType
    found = W.stream_sessions(spark, *paths)
    return found.select("user_id", F.col("session_start").cast(kind).alias("session_start"), F.col("session_end").cast(kind).alias("session_end"), "n")


def event_as_of(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "events")
    left = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return W.as_of(left, right, "user_id", "last_value").select("event_id", "last_value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalize_pages, page_elements, page_offsets, block_quality, parser_quality, leak_scan, line_leaks, consecutive_blocks, artifact_quality, stratified_sample, parent_segments,
        child_chunks, child_groups, chunk_quality, chunk_report, chunk_ablation, pack_metrics, public_pack_rows, pack_summary, pack_deltas, evidence_context, evidence_stats, citation_eval, citation_summary, generation_record, generation_summary,
        classify_turns, guard_turns, route_turns, rewrite_followups, rewrite_summary, name_mentions, confusion_matrix, class_prf, label_summary, tradeoff_tags, guardrail_routes, regression_tags, postings_expand, graph_score,
        graph_community, wer_cer, cer, char_f1, speech_ratio, score_aggregates, dataset_profile, dataset_shortfall, order_subset, input_faults, benchmark_rubric, resolvability, table_manifest,
        catalog_quality, event_tumbling, event_sliding, event_session, event_session_stream, event_as_of,
    )
} | {"tree_parent": _tree("parent_summary"), "tree_summary": _tree("summary_node")} | {f"evidence_pack_p{k}": _pack(p) for k, p in enumerate(E.POLICIES)}

from marlquarry.plans.doc_oracles import ORACLES  # noqa: E402,F401
