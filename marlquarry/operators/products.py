"""The best few entries of each row of a product of two sparse matrices, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlquarry.functions.lineage import written

#: Sums are ordered at this many digits, so that equal terms in another order still tie.
ORDER_DIGITS = 8
#: Queries, about, that one task takes, and entries of the right side, about, of a block of queries and a range of items. A worker holds one
#: such share at a time, in some twenty arrays, so these bound its memory at any size of the tables.
BLOCK, RANGE = 256, 250_000
#: Products that are summed at once.
STEP = 1 << 20


def best_items(k: int, last_first: bool, width: int, step: int):
    """For a block of queries and a range of items: the k best items of each query, and their sums."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        term, item = (pc.dictionary_encode(right[c].combine_chunks()) for c in ("term", "item"))
        at = pc.index_in(left["term"].combine_chunks(), term.dictionary)
        left, at = left.filter(pc.is_valid(at)), np.asarray(at.drop_null())
        ids, query = np.unique(left["query_id"].to_numpy(), return_inverse=True)
        # The queries of a term, and the terms of an item, are ranges; items in the order that settles ties.
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(term.dictionary) + 1))
        query, weight = query[order], left["w"].to_numpy()[order]
        by_name = np.asarray(pc.sort_indices(item.dictionary))
        by_name = by_name[::-1] if last_first else by_name
        place = np.empty(len(by_name), dtype=np.int64)
        place[by_name] = np.arange(len(by_name))
        place = place[np.asarray(item.indices)]
        order = np.argsort(place, kind="stable")
        terms, own, ends = np.asarray(term.indices)[order], right["w"].to_numpy()[order], np.searchsorted(place[order], np.arange(len(by_name) + 1))
        cost = np.concatenate(([0], np.cumsum(first[terms + 1] - first[terms])))[ends]
        positive = (weight.min(initial=1.0) > 0) and (own.min(initial=1.0) > 0)

        best_q, best_p, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(ids), -np.inf)
        start = 0
        while start < len(by_name) and len(ids):
            stop = max(start + 1, min(int(np.searchsorted(cost, cost[start] + step, side="right")) - 1, start + max(1, step // len(ids))))
            part = slice(ends[start], ends[stop])
            size = first[terms[part] + 1] - first[terms[part]]
            each = np.repeat(first[terms[part]] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            cell = np.repeat(np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1])), size) * len(ids) + query[each]
            sums = np.round(np.bincount(cell, weight[each] * np.repeat(own[part], size), (stop - start) * len(ids)), ORDER_DIGITS)
            # Items that come later lose ties, so only greater sums than the k-th best so far can still enter.
            enters = sums.reshape(-1, len(ids)) > least
            enters &= (sums > 0 if positive else np.bincount(cell, minlength=len(sums)) > 0).reshape(enters.shape)
            p, q = np.nonzero(enters)
            best_q, best_p, best_s = np.concatenate((best_q, q)), np.concatenate((best_p, p + start)), np.concatenate((best_s, sums.reshape(enters.shape)[p, q]))
            order = np.lexsort((best_p, -best_s, best_q))
            rank = np.arange(len(order)) - np.searchsorted(best_q[order], best_q[order])
            order = order[rank < k]
            best_q, best_p, best_s = best_q[order], best_p[order], best_s[order]
            full = rank[rank < k] == k - 1
            least[best_q[full]] = best_s[full]
            start = stop
        names = item.dictionary.take(pa.array(by_name[best_p]))
        given = [pa.array([x.as_py()] * len(best_q), x.type) for x in key[2 : 2 + width]]
        return pa.Table.from_arrays([*given, pa.array(ids[best_q]), names, pa.array(best_s)], names=[*(f"by{i}" for i in range(width)), "query_id", "item", "score"])

    return run


def top_products(queries: DataFrame, items: DataFrame, k: int, by: tuple[str, ...] = (), last_first: bool = True) -> DataFrame:
    """by, query_id, item, score: the k items with the greatest sums, over shared terms, of the products of both weights.

    queries: query_id, term, w; items: by, item, term, w, each pair of item and term once; by parts the items into corpora that are ranked
    apart. Of equal sums the greater item comes first, or the lesser one. A task takes a block of queries and a range of items, whole, and
    returns the range's best, so that no pair of query and item is shuffled. Both sides are written first, for their sizes.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.select("query_id").distinct().count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    left = written(queries.select("query_id", "term", F.col("w").cast("double").alias("w"), block.alias("block")), "product-queries")
    right = items.select(*by, "item", "term", F.col("w").cast("double").alias("w")).join(left.select("block", "term").distinct(), "term")
    right = written(right, "product-items")
    # As many ranges as keep a share small and all cores at work.
    ranges = max(-(-right.count() // (blocks * RANGE)), -(-spark.sparkContext.defaultParallelism // blocks))
    spread = right.withColumn("range", F.pmod(F.xxhash64("item"), F.lit(ranges)).cast("int")).groupBy("block", "range", *by)
    dealt = left.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    if by:
        corpora = right.select(F.col("block").alias("b"), *(F.col(c).alias(f"b_{c}") for c in by)).distinct()
        dealt = dealt.join(corpora, F.col("block") == F.col("b")).withColumnsRenamed({f"b_{c}": c for c in by})
    dealt = dealt.groupBy("block", "range", *by)
    kinds = {c: t for c, t in right.dtypes} | dict(left.dtypes)
    schema = ", ".join([*(f"by{i} {kinds[c]}" for i, c in enumerate(by)), f"query_id {kinds['query_id']}", f"item {kinds['item']}", "score double"])
    found = dealt.cogroup(spread).applyInArrow(best_items(k, last_first, len(by), STEP), schema)
    found = found.withColumnsRenamed({f"by{i}": c for i, c in enumerate(by)})
    w = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), F.desc("item") if last_first else F.asc("item"))
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
