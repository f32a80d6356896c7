"""Compare retrieval methods over a corpus and report whether a candidate may replace the baseline.

    python jobs/retrieval_report.py --documents D --queries Q --labels L --output OUT [--config jobs/retrieval_report.json]

The methods rank the documents for every query. Documents that contain a query's passage are relevant to it. OUT/queries holds
each query's hits, reciprocal rank and nDCG by method, OUT/summary their means, their gains on the baseline and the decision, both
partitioned by method. A run overwrites the partitions of its own methods, whole: run again it leaves the same rows, and what other
runs have written of other methods stays.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from dataclasses import dataclass

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from marlquarry.functions.lineage import written  # noqa: E402
from marlquarry.operators import metrics as M  # noqa: E402
from marlquarry.operators import retrieval as R  # noqa: E402

log = logging.getLogger("retrieval_report")

QUERIES = "query_id long, expected string, hit_1 double, hit_3 double, hit_5 double, rr double, ndcg double, delta_rr double, delta_ndcg double, n_hits long, method string"
SUMMARY = (
    "n_queries long, recall_1 double, recall_3 double, recall_5 double, mrr double, ndcg_5 double, delta_mrr double, delta_ndcg_5 double, "
    "improved long, regressed long, abstain_with_candidates long, decision string, method string"
)


@dataclass(frozen=True)
class ReportConfig:
    """methods: names in METHODS, of which baseline is one. least_gain: the least gain of nDCG that counts; worst_loss: the most
    MRR that a method may lose. candidates: documents that a reranker looks at."""

    methods: tuple[str, ...] = ("bm25", "rerank", "rrf")
    baseline: str = "bm25"
    k: int = 5
    candidates: int = 30
    least_gain: float = 0.01
    worst_loss: float = 0.01

    def __post_init__(self) -> None:
        unknown = {*self.methods, self.baseline} - set(METHODS)
        if unknown or self.baseline not in self.methods:
            raise ValueError(f"methods must be of {sorted(METHODS)} and hold the baseline: {sorted(unknown) or self.baseline}")

    @classmethod
    def read(cls, path: str) -> ReportConfig:
        with open(path, encoding="utf-8") as f:
            return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.load(f).items()})


def _rerank(wide: DataFrame, docs: DataFrame, queries: DataFrame, cfg: ReportConfig) -> DataFrame:
    return R.rerank(wide, queries, docs, R.overlap_scorer, cfg.k)


def _rrf(wide: DataFrame, docs: DataFrame, queries: DataFrame, cfg: ReportConfig) -> DataFrame:
    """The lexical list fused with the same documents in the order of the share of the query's words that they hold."""
    other = R.rerank(wide, queries, docs, R.overlap_scorer, cfg.candidates)
    return R.fuse_rrf(wide, other, cfg.k, candidate_k=cfg.candidates)


#: From the wide lexical list, documents and queries to the best k.
METHODS = {"bm25": lambda wide, docs, queries, cfg: wide.filter(F.col("rank") <= cfg.k), "rerank": _rerank, "rrf": _rrf}


def grades(docs: DataFrame, queries: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, doc_id, grade: 2 where a containing document is labelled of good quality, else 1."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return R.containment(docs, queries).join(good, "doc_id", "left").select("query_id", "doc_id", F.when(F.col("quality") == 1, 2).otherwise(1).alias("grade"))


def per_query(spark: SparkSession, documents: str, queries: str, labels: str, cfg: ReportConfig) -> DataFrame:
    """Rows of QUERIES but the deltas, for every method; queries that no document answers are to be abstained from."""
    docs = spark.read.parquet(documents).select("doc_id", "text").filter("doc_id is not null")
    asked = spark.read.parquet(queries).select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")).filter("query_id is not null")
    log.info("read %d documents below %s and %d queries below %s", docs.count(), documents, asked.count(), queries)
    rel = written(grades(docs, asked, spark.read.parquet(labels)), "report-grades")
    judged = asked.join(rel.select("query_id").distinct().withColumn("r", F.lit(True)), "query_id", "left")
    judged = judged.select("query_id", F.when(F.col("r"), "retrieve").otherwise("abstain").alias("expected"))
    # The lexical list is ranked once; all methods start from it.
    wide = written(R.bm25_topk(docs, asked, cfg.candidates), "report-lexical")
    made = None
    for name in cfg.methods:
        ranked = METHODS[name](wide, docs, asked, cfg).select("query_id", "doc_id", "score", "rank")
        hits = ranked.groupBy("query_id").agg(F.count("*").alias("n_hits"))
        scored = M.per_query(ranked, rel, judged, cfg.k).select("query_id", *M.MEANS.values())
        own = judged.join(scored, "query_id", "left").join(hits, "query_id", "left").fillna(0, ["n_hits"]).withColumn("method", F.lit(name))
        made = own if made is None else made.unionByName(own)
    return made


def compared(rows: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Rows with each query's gain on the baseline."""
    base = rows.filter(F.col("method") == cfg.baseline).select("query_id", F.col("rr").alias("b_rr"), F.col("ndcg").alias("b_ndcg"))
    gain = lambda c: F.round(F.col(c) - F.col(f"b_{c}"), 6).alias(f"delta_{c}")
    own = [F.round(c, 6).alias(c) for c in M.MEANS.values()]
    return rows.join(base, "query_id").select("query_id", "expected", *own, gain("rr"), gain("ndcg"), "n_hits", "method")


def summary(rows: DataFrame, cfg: ReportConfig) -> DataFrame:
    """A row for each method. A candidate is adopted that gains enough nDCG and doesn't lose too much of the reciprocal rank."""
    answered = F.col("expected") == "retrieve"
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(answered, F.col(c))), F.lit(0.0)), 6)
    made = rows.groupBy("method").agg(
        F.count_if(answered).alias("n_queries"),
        *(mean(c).alias(n) for n, c in M.MEANS.items()),
        mean("delta_rr").alias("delta_mrr"),
        mean("delta_ndcg").alias("delta_ndcg_5"),
        F.count_if(answered & (F.col("delta_ndcg") > 0)).alias("improved"),
        F.count_if(answered & (F.col("delta_ndcg") < 0)).alias("regressed"),
        F.count_if(~answered & (F.col("n_hits") > 0)).alias("abstain_with_candidates"),
    )
    adopt = (F.col("delta_ndcg_5") >= cfg.least_gain) & (F.col("delta_mrr") >= -cfg.worst_loss)
    decision = F.when(F.col("method") == cfg.baseline, "baseline").when(adopt, "adopt").otherwise("keep_baseline")
    return made.withColumn("decision", decision)


def _overwrite(rows: DataFrame, schema: str, path: str) -> DataFrame:
    """Write the partitions of rows' methods anew; the whole table as it stands."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path)
    return spark.read.schema(schema).parquet(path)


def report(spark: SparkSession, documents: str, queries: str, labels: str, output: str, cfg: ReportConfig | None = None) -> DataFrame:
    """Write both tables and return OUT/queries with its method's row of OUT/summary."""
    cfg = cfg or ReportConfig()
    rows = _overwrite(compared(per_query(spark, documents, queries, labels, cfg), cfg), QUERIES, f"{output}/queries")
    own = rows.filter(F.col("method").isin(*cfg.methods))
    total = _overwrite(summary(own, cfg), SUMMARY, f"{output}/summary")
    for r in total.filter(F.col("method").isin(*cfg.methods)).orderBy("method").collect():
        log.info("%s: %d queries, nDCG %.6f (%+.6f), MRR %.6f (%+.6f): %s", r.method, r.n_queries, r.ndcg_5, r.delta_ndcg_5, r.mrr, r.delta_mrr, r.decision)
    log.info("wrote %d rows to %s", rows.count(), output)
    return rows.join(total, "method")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "queries", "labels", "output"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config", default=os.path.join(ROOT, "jobs", "retrieval_report.json"))
    told = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    spark = SparkSession.builder.appName("retrieval_report").getOrCreate()
    try:
        report(spark, told.documents, told.queries, told.labels, told.output, ReportConfig.read(told.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
