"""Postings, token neighbourhoods, and ranking by graphs and trees of documents.

Caps on postings are part of graph ranking: documents per term in id order, neighbours and pool by explicit keys. Tree ranking has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlquarry.functions.lineage import written
from marlquarry.functions.scalars import GRAPH_TOKEN, graph_tokens

#: Fixed values of graph ranking: documents per term, neighbours, pool, tokens of a query, words that are no tokens, and words
#: that speak of relations.
DOCS_PER_TERM, NEIGHBOURS, POOL, QUERY_TOKENS = 350, 24, 120, 14
STOPWORDS = (
    "그리고", "그러나", "그래서", "대한", "대해", "무엇", "어떤", "어떻게", "왜", "있어", "있는", "했다", "한다", "관련", "관계", "설명", "알려", "말해", "차이", "영향", "이유", "사이",
    "history", "docent",
)
RELATION_HINTS = ("권력", "정치", "왕", "왕조", "신하", "궁궐", "도성", "천도", "개혁", "전쟁", "제도", "사건", "인물", "장소", "한양", "조선")
#: Fixed values of tree ranking: neighbours, tokens of a query, words that are no tokens, and words of narration.
TREE_NEIGHBOURS, TREE_TOKENS = 32, 18
TREE_STOPWORDS = (
    "그리고", "그러나", "그래서", "대한", "대해", "무엇", "어떤", "어떻게", "왜", "있어", "있는", "했다", "한다", "관련", "설명", "알려", "말해", "이야기", "근거", "짧게", "서울", "한양", "관광", "도슨트",
    "history", "docent",
)
NARRATIVE_HINTS = ("배경", "사건", "일화", "인물", "정치", "왕", "궁궐", "도성", "변화", "문화", "제도", "생활", "조선", "근대", "광화문", "경복궁", "종로", "북촌")


def postings(docs: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """token, doc_id."""
    return docs.select(F.explode(graph_tokens("text", stopwords)).alias("token"), "doc_id")


def query_tokens(queries: DataFrame, stopwords: tuple[str, ...] = STOPWORDS, most: int = QUERY_TOKENS) -> DataFrame:
    """query_id, token: the `most` most frequent tokens of a query, its context and its places; of equal ones the first.

    queries: query_id, query_text and, where there are such, user_context and place_ids (an array).
    """
    parts = ["query_text", *(c for c in ("user_context",) if c in queries.columns)]
    text = F.concat_ws(" ", *parts, *([F.array_join("place_ids", " ")] if "place_ids" in queries.columns else []))
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({GRAPH_TOKEN})"), F.lit(1)), lambda x: F.lower(x))
    rows = queries.select("query_id", F.posexplode(found).alias("at", "token")).filter(~F.col("token").rlike("^[0-9]+$") & ~F.col("token").isin(*stopwords))
    counts = rows.groupBy("query_id", "token").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "at"))
    return counts.withColumn("place", place).filter(F.col("place") <= most).select("query_id", "token")


def capped(post: DataFrame, wanted: DataFrame, most: int = DOCS_PER_TERM) -> DataFrame:
    """Postings of wanted tokens, the first `most` documents of each. Each task first keeps its own first ones."""
    w = Window.partitionBy("token").orderBy("doc_id")
    own = post.join(wanted.select("token").distinct(), "token", "left_semi")
    return own.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("place")


#: Queries, about, whose owners meet a range of tokens in one task, and their owners, about, of which a single query may have more.
BLOCK, MET = 256, 1 << 21
#: Postings, about, of a block and a range of tokens.
RANGE = 250_000
#: Products of postings and queries that are summed at once.
STEP = 1 << 20


def _block_product(most: int):
    """The `most` best tokens of each query of a block within a range of tokens, by the sums of weights over shared owners.

    One side: query_id, owner and in how many of the query's tokens the owner stands; the other: token, owner.
    """

    def run(key: tuple, met: pa.Table, lists: pa.Table) -> pa.Table:
        owner, token = (pc.dictionary_encode(lists[c].combine_chunks()) for c in ("owner", "token"))
        at = pc.index_in(met["owner"].combine_chunks(), owner.dictionary)
        met, at = met.filter(pc.is_valid(at)), np.asarray(at.drop_null())
        ids, query = np.unique(met["query_id"].to_numpy(), return_inverse=True)
        # Queries of each owner, and owners of each token, as ranges; tokens in their order, so that of equal sums the lesser comes first.
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(owner.dictionary) + 1))
        query, weight = query[order], met["m"].to_numpy()[order].astype(float)
        by_name = np.asarray(pc.sort_indices(token.dictionary))
        rank = np.empty(len(by_name), dtype=np.int64)
        rank[by_name] = np.arange(len(by_name))
        place = rank[np.asarray(token.indices)]
        order = np.argsort(place, kind="stable")
        owned, ends = np.asarray(owner.indices)[order], np.searchsorted(place[order], np.arange(len(by_name) + 1))
        cost = np.concatenate(([0], np.cumsum(first[owned + 1] - first[owned])))[ends]

        def sums(start: int, stop: int) -> np.ndarray:
            """Tokens by queries."""
            own = owned[ends[start] : ends[stop]]
            size = first[own + 1] - first[own]
            each = np.repeat(first[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            row = np.repeat(np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1])), size)
            return np.bincount(row * len(ids) + query[each], weight[each], (stop - start) * len(ids)).reshape(stop - start, len(ids))

        best_n, best_t = np.zeros((0, len(ids))), np.zeros((0, len(ids)), dtype=np.int64)
        start = 0
        while start < len(by_name) and len(ids):
            stop = max(start + 1, min(int(np.searchsorted(cost, cost[start] + STEP, side="right")) - 1, start + STEP // len(ids)))
            n = sums(start, stop)
            if stop - start > 4 * most:
                top = np.sort(np.argpartition(-n * (stop - start) + np.arange(stop - start)[:, None], most, axis=0)[:most], axis=0)
            else:
                top = np.broadcast_to(np.arange(stop - start)[:, None], n.shape)
            best_n, best_t = np.concatenate((best_n, np.take_along_axis(n, top, 0))), np.concatenate((best_t, top + start))
            top = np.argsort(-best_n, axis=0, kind="stable")[:most]
            best_n, best_t = np.take_along_axis(best_n, top, 0), np.take_along_axis(best_t, top, 0)
            start = stop
        row, column = np.nonzero(best_n)
        names = token.dictionary.take(pa.array(by_name[best_t[row, column]]))
        return pa.table([pa.array(ids[column], pa.int64()), names, pa.array(best_n[row, column].astype(np.int64))], names=["query_id", "token", "n"])

    return run


def nearest(parts: list[tuple[DataFrame, DataFrame, str]], qt: DataFrame, most: int, tokens: int = QUERY_TOKENS) -> DataFrame:
    """query_id, token, n: the `most` tokens that most often stand with a query's tokens, ties in token order.

    parts: postings, those of them that lead from a query's tokens to owners, and the owner's name; tokens: the most tokens of a query. n sums over the
    query's tokens and the parts. This is a product of two sparse matrices, queries by owners and owners by tokens, of which the best few of each row are
    kept: each task takes a block of queries and a range of tokens, whole, and the ranges' best meet in one window. The queries' own
    tokens are left out after that, so that each range returns that many more.
    """
    met = None
    lists = None
    for k, (post, led, owner) in enumerate(parts):
        key = F.concat(F.lit(f"{k}:"), F.col(owner).cast("string"))
        one = qt.join(led, "token").groupBy("query_id", key.alias("owner")).agg(F.count("*").alias("m"))
        own = post.select("token", key.alias("owner"))
        met, lists = (one, own) if met is None else (met.unionByName(one), lists.unionByName(own))
    met = written(met, "graph-met")
    blocks = max(1, -(-qt.select("query_id").distinct().count() // BLOCK), -(-met.count() // MET))
    met = met.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    lists = written(lists.join(met.select("block", "owner").distinct(), "owner"), "graph-lists")
    # As many ranges as keep a share small and all cores at work.
    ranges = max(-(-lists.count() // (blocks * RANGE)), -(-qt.sparkSession.sparkContext.defaultParallelism // blocks))
    left = met.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).groupBy("block", "range")
    right = lists.withColumn("range", F.pmod(F.xxhash64("token"), F.lit(ranges)).cast("int")).groupBy("block", "range")
    found = left.cogroup(right).applyInArrow(_block_product(most + tokens), "query_id long, token string, n long")
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "token")
    return found.join(qt, ["query_id", "token"], "left_anti").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("place")


def expand(post: DataFrame, qt: DataFrame) -> DataFrame:
    """query_id, token, n: the tokens that most often share a document with a query's tokens, ties in token order."""
    return nearest([(post, capped(post, qt), "doc_id")], qt, NEIGHBOURS)


def baseline_scores(ranked: DataFrame) -> DataFrame:
    """Scores scaled to 0 .. 1 within a query and at least 1 / (rank + 1); equal scores are 1 / rank."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high - low < 1e-9, 1.0 / F.col("rank")).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)))
    return ranked.select("query_id", "doc_id", F.greatest(scaled, 1.0 / (F.col("rank") + 1)).alias("base"))


def graph_rank(docs: DataFrame, queries: DataFrame, ranked: DataFrame, strategy: str, hints: tuple[str, ...] = RELATION_HINTS, k: int = 5) -> DataFrame:
    """Rescore the baseline's documents and a pool of POOL others by shared tokens, pairs of them and relation words.

    strategy: 'entity_path' weighs direct tokens and pairs, 'community_hint' direct and expanded tokens. Scores are ordered at
    nine digits and shown at six.
    """
    # A few rows for each query, which all steps below use.
    post, qt, ranked = written(postings(docs), "graph-postings"), written(query_tokens(queries), "graph-tokens"), written(ranked, "graph-base")
    near = written(expand(post, qt).select("query_id", "token"), "graph-near")
    weighted = qt.withColumn("w", F.lit(3)).unionByName(near.withColumn("w", F.lit(1)))
    found = weighted.join(capped(post, weighted), "token").groupBy("query_id", "doc_id").agg(F.sum("w").alias("s"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "doc_id"))
    pool = found.withColumn("place", place).filter(F.col("place") <= POOL).select("query_id", "doc_id").unionByName(ranked.select("query_id", "doc_id")).distinct()
    # Own tokens weigh 3, neighbours 1: one meeting of pool, tokens and postings counts both.
    hit = pool.join(weighted, "query_id").join(post, ["doc_id", "token"]).groupBy("query_id", "doc_id").agg(F.count_if(F.col("w") == 3).alias("direct"), F.count("*").alias("expanded"))
    rows = pool.join(hit, ["query_id", "doc_id"], "left").fillna(0, ["direct", "expanded"])
    related = post.filter(F.col("token").isin(*hints)).groupBy("doc_id").agg(F.count("*").alias("related"))
    rows = rows.join(related, "doc_id", "left").fillna(0, ["related"]).join(baseline_scores(ranked), ["query_id", "doc_id"], "left").fillna(0.0, ["base"])
    sizes = weighted.groupBy("query_id").agg(F.count_if(F.col("w") == 3).alias("nq"), F.count("*").alias("ne"))
    rows = rows.join(sizes, "query_id")
    pairs = lambda n: n * (n - 1) / 2
    direct, wide = F.col("direct") / F.greatest("nq", F.lit(1)), F.col("expanded") / F.greatest("ne", F.lit(1))
    pair = pairs(F.col("direct")) / F.greatest(pairs(F.col("nq")), F.lit(1.0))
    related_share = F.least(F.col("related") / 4, F.lit(1.0))
    score: Column
    if strategy == "entity_path":
        score = 0.52 * F.col("base") + 0.24 * direct + 0.18 * pair + 0.06 * related_share
    elif strategy == "community_hint":
        score = 0.46 * F.col("base") + 0.18 * direct + 0.26 * wide + 0.10 * related_share
    else:
        raise ValueError(strategy)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    rows = rows.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return rows.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


#: Weights of the baseline, of direct and expanded tokens and of narration in a group's score.
TREE_WEIGHTS = {"parent_summary": (0.48, 0.32, 0.16, 0.04), "summary_node": (0.38, 0.30, 0.22, 0.07)}
#: The same for a document within its group, and what a group of whole documents has more.
CHILD_WEIGHTS, DOC_BONUS = (0.50, 0.32, 0.13, 0.05), 0.03


#: Chunks, about, of a group whose tokens meet a block of queries in one task, and cells of chunks by tokens that it looks at together.
CHUNKS, CELLS = 2048, 1 << 21


def _best_chunks(weights: tuple[float, ...], full: int, most: int, shared: bool = False):
    """For the queries of a block that chose a group, and a range of its chunks: what each query's best chunks hold.

    One side: query_id, gr, own and near tokens, and the baseline's chunks of the query; the other: doc_id, hints, tokens, and what the value has more. The
    `most` best are found without the baseline's part of the value, and the baseline's chunks are given besides: that part is never negative, so no other
    can be among the best with it. shared: only chunks that share a token with the query are among the best.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = lambda t, c: (t[c].combine_chunks().flatten(), np.repeat(np.arange(t.num_rows), pc.list_value_length(t[c]).fill_null(0).to_numpy()))
        (own, q_own), (near, q_near), (held, row) = flat(left, "own"), flat(left, "near"), flat(right, "tokens")
        terms = pc.unique(pa.chunked_array([own, near], pa.string()))
        # One sum tells both counts: own tokens weigh OWN and 1, neighbours 1.
        weight = np.zeros((len(terms), left.num_rows), dtype=np.float32)
        weight[np.asarray(pc.index_in(own, terms)), q_own] = OWN + 1
        weight[np.asarray(pc.index_in(near, terms)), q_near] = 1
        term = pc.index_in(held, terms)
        met = np.asarray(pc.is_valid(term))
        row, term = row[met], np.asarray(term.drop_null())
        names = right["doc_id"].combine_chunks()
        # Places of ids in falling order break ties of values.
        place = np.empty(len(names), dtype=np.int64)
        place[np.asarray(pc.sort_indices(names))[::-1]] = np.arange(len(names))
        hints, plus = right["hints"].to_numpy(), right["plus"].to_numpy()
        nq = np.bincount(q_own, minlength=left.num_rows)
        ne = nq + np.bincount(q_near, minlength=left.num_rows)
        listed, q_listed = flat(left, "listed")
        listed = pc.index_in(listed, names)
        q_listed, listed = q_listed[np.asarray(pc.is_valid(listed))], np.asarray(listed.drop_null())

        _, d, w, h = weights
        rows, columns, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, CELLS // max(1, len(terms), left.num_rows))
        for start in range(0, len(names) if left.num_rows else 0, step):
            n = min(step, len(names) - start)
            part = slice(*np.searchsorted(row, (start, start + n)))
            x = np.zeros((n, len(terms)), dtype=np.float32)
            x[row[part] - start, term[part]] = 1
            both = (x @ weight).astype(np.int64)
            value = d * (both // OWN / np.maximum(nq, 1)) + w * (both % OWN / np.maximum(ne, 1)) + h * np.minimum(hints[start : start + n] / full, 1.0)[:, None]
            shown = np.where(both > 0 if shared else True, np.round(value + plus[start : start + n, None], 9), -np.inf)
            least = -np.partition(-shown, most - 1, axis=0)[most - 1] if n > most else -np.inf
            at, column = np.nonzero((shown >= least) & (shown > -np.inf))
            order = np.lexsort((place[at + start], -shown[at, column], column))
            at, column = at[order], column[order]
            best = np.arange(len(at)) - np.searchsorted(column, column) < most
            own_part = (listed >= start) & (listed < start + n)
            at, column = np.concatenate((at[best], listed[own_part] - start)), np.concatenate((column[best], q_listed[own_part]))
            rows.append(at + start)
            columns.append(column)
            sums.append(both[at, column])
        rows, columns, sums = (np.concatenate(x) for x in (rows, columns, sums))
        made = [left["query_id"].combine_chunks().take(pa.array(columns)), left["gr"].combine_chunks().take(pa.array(columns)), names.take(pa.array(rows))]
        return pa.Table.from_arrays([*made, pa.array(sums // OWN), pa.array(sums % OWN), pa.array(hints[rows])], names=["query_id", "gr", "doc_id", "direct", "wide", "hints"])

    return run


#: More than a query has tokens.
OWN = 1024


def _told(every: DataFrame) -> DataFrame:
    """query_id, own, near: each query's tokens as two lists."""
    return every.groupBy("query_id").agg(F.collect_list(F.when(F.col("w") == 3, F.col("token"))).alias("own"), F.collect_list(F.when(F.col("w") == 1, F.col("token"))).alias("near"))


def _none(c: str, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)


def best_groups(held: DataFrame, facts: DataFrame, every: DataFrame, base: DataFrame, weights: tuple[float, ...], full: int, most: int, kinds: int) -> DataFrame:
    """query_id, kind, group_id, direct, wide: of all groups that share a token with a query, those among which its `most` best are, and the baseline's.

    held: kind, group_id, token; facts: kind (from 0 to kinds), group_id, hints, plus (what the value has more); every: query_id, token, w; base: query_id,
    group_id. A task takes a block of queries and a range of groups with those of the block's tokens that they hold, so that every group is looked at and
    no pair of query and group is shuffled but the few that are returned.
    """
    blocks = max(1, -(-every.select("query_id").distinct().count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    listed = base.groupBy("query_id").agg(F.collect_set("group_id").alias("listed"))
    asked = _told(every).join(listed, "query_id", "left").select("query_id", block, "own", "near", _none("listed", "string"))
    met = held.join(every.select(block, "token").distinct(), "token").groupBy("block", "kind", "group_id").agg(F.collect_list("token").alias("tokens"))
    met = written(met.join(facts.select("kind", "group_id", F.col("hints").cast("long").alias("hints"), "plus"), ["kind", "group_id"]), "tree-met")
    # As many ranges as keep a share small and all cores at work.
    size = met.agg(F.sum(F.size("tokens")).alias("n")).first().n or 0
    ranges = max(-(-size // (blocks * RANGE)), -(-every.sparkSession.sparkContext.defaultParallelism // (blocks * kinds)))
    keys, upto = ("block", "kind", "range"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = written(asked, "tree-told").withColumn("kind", upto(kinds)).withColumn("range", upto(ranges)).withColumn("gr", F.col("kind")).groupBy(*keys)
    right = met.withColumn("range", F.pmod(F.xxhash64("group_id"), F.lit(ranges)).cast("int")).select(*keys, F.col("group_id").alias("doc_id"), "hints", "plus", "tokens").groupBy(*keys)
    kind = every.schema["query_id"].dataType.simpleString()
    found = left.cogroup(right).applyInArrow(_best_chunks(weights, full, most, True), f"query_id {kind}, gr int, doc_id string, direct long, wide long, hints long")
    return found.select("query_id", F.col("gr").alias("kind"), F.col("doc_id").alias("group_id"), "direct", "wide").distinct()


def best_chunks(texts: DataFrame, groups: DataFrame, every: DataFrame, base: DataFrame, weights: tuple[float, ...], full: int, most: int) -> DataFrame:
    """query_id, gr, doc_id, direct, wide, hints: chunks of chosen groups among which the `most` best of each query and group are.

    texts: doc_id, kind, group_id, tokens, hints; groups: query_id, kind, group_id, gr, size; every: query_id, token, w; base: query_id, doc_id. A task takes a
    block of the queries that chose a group, and a range of the group's chunks with their tokens, whole, so that no pair of query and chunk is shuffled
    but the few that are returned.
    """
    blocks = max(1, -(-groups.select("query_id").distinct().count() // BLOCK))
    listed = base.groupBy("query_id").agg(F.collect_list("doc_id").alias("listed"))
    ids = texts.schema["doc_id"].dataType.simpleString()
    asked = groups.join(_told(every), "query_id", "left").join(listed, "query_id", "left").select(
        "query_id", "kind", "group_id", "gr", _none("own", "string"), _none("near", "string"), _none("listed", ids),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.ceil(F.col("size") / CHUNKS).cast("int").alias("ranges"),
    )
    asked = written(asked, "tree-asked")
    # As many rows as blocks have chosen groups.
    chosen = written(asked.select("block", "kind", "group_id", "ranges").distinct(), "tree-chosen")
    keys = ("block", "kind", "group_id", "range")
    left = asked.withColumn("range", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1))).groupBy(*keys)
    right = texts.join(chosen, ["kind", "group_id"]).withColumn("range", F.pmod(F.xxhash64("doc_id"), F.col("ranges")).cast("int"))
    right = right.select(*keys, "doc_id", "tokens", "hints", F.lit(0.0).alias("plus")).groupBy(*keys)
    query, gr = (groups.schema[c].dataType.simpleString() for c in ("query_id", "gr"))
    return left.cogroup(right).applyInArrow(_best_chunks(weights, full, most), f"query_id {query}, gr {gr}, doc_id {ids}, direct long, wide long, hints int")


def tree_rank(docs: DataFrame, queries: DataFrame, ranked: DataFrame, strategy: str = "parent_summary", hints: tuple[str, ...] = NARRATIVE_HINTS, k: int = 5) -> DataFrame:
    """Rank groups of chunks, take the best of each, then fill from the baseline; a chunk is listed once.

    docs: doc_id, text, parent_id, root_id. Groups are the parents; 'summary_node' adds the roots, as 'doc::' groups, and takes two
    chunks of a group instead of one. A group's tokens are those of its chunks; every group that shares one with the query or its neighbours is a
    candidate, and its score is weighed as in TREE_WEIGHTS, less min(.02 * log20(size), .10). Scores are ordered at nine digits and shown at six.
    """
    if strategy not in TREE_WEIGHTS:
        raise ValueError(strategy)
    roots, ranked = strategy == "summary_node", written(ranked, "tree-base")
    own = docs.select("doc_id", "text", F.col("parent_id").cast("string").alias("parent"), F.concat(F.lit("doc::"), F.col("root_id").cast("string")).alias("root"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("parent").alias("group_id")), *([F.struct(F.lit(1).alias("kind"), F.col("root").alias("group_id"))] if roots else []))
    member = own.select("doc_id", F.inline(kinds))
    # Tokens of chunks and of groups are read by several steps; a chunk's are one row, and come with its groups, so that these need no join.
    found = own.withColumn("tokens", graph_tokens("text", TREE_STOPWORDS)).select("doc_id", "parent", "root", "tokens")
    texts = written(found, "tree-texts").withColumn("hints", F.size(F.filter("tokens", lambda x: x.isin(*hints)))).select("doc_id", F.inline(kinds), "tokens", "hints")
    held = written(texts.select("kind", "group_id", F.explode("tokens").alias("token")).distinct(), "tree-groups")
    qt = written(query_tokens(queries, TREE_STOPWORDS, TREE_TOKENS), "tree-tokens")

    of = [held.filter(F.col("kind") == kind) for kind in range(1 + roots)]
    near = nearest([(x, x, "group_id") for x in of], qt, TREE_NEIGHBOURS, TREE_TOKENS).select("query_id", "token")
    # At most TREE_TOKENS + TREE_NEIGHBOURS rows for a query; used by each of the steps below, as the baseline's few rows are.
    every = written(qt.withColumn("w", F.lit(3)).unionByName(near.withColumn("w", F.lit(1))), "tree-every")
    base = baseline_scores(ranked)
    group_base = written(base.join(member, "doc_id").groupBy("query_id", "kind", "group_id").agg(F.max("base").alias("base")), "tree-group-base")
    sizes = every.groupBy("query_id").agg(F.count_if(F.col("w") == 3).alias("nq"), F.count("*").alias("ne"))

    def scored(rows: DataFrame, bases: DataFrame, keys: list[str], weights: tuple[float, ...], full: int) -> DataFrame:
        """rows (query_id, keys, direct, wide, hints) with value."""
        out = rows.join(bases, ["query_id", *keys], "left").join(sizes, "query_id", "left")
        out = out.fillna(0, ["direct", "wide", "hints", "nq", "ne"]).fillna(0.0, ["base"])
        at = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
        b, d, w, h = weights
        return out.withColumn("value", b * F.col("base") + d * at("direct", "nq") + w * at("wide", "ne") + h * F.least(F.col("hints") / full, F.lit(1.0)))

    key = ["kind", "group_id"]
    hinted = held.filter(F.col("token").isin(*hints)).groupBy(*key).agg(F.count("*").alias("hints"))
    penalty = F.least(F.log(F.col("size").cast("double")) / F.log(F.lit(20.0)) * 0.02, F.lit(0.10))
    facts = member.groupBy(*key).agg(F.count("*").alias("size")).join(hinted, key, "left").fillna(0, ["hints"])
    # A row for each group.
    facts = written(facts.withColumn("plus", F.col("kind") * DOC_BONUS - penalty), "tree-facts")
    # All groups that share a token with a query, and the baseline's, are its candidates; those that can be among its best come back.
    shared = written(best_groups(held, facts, every, group_base, TREE_WEIGHTS[strategy], 7, k * (1 + roots), 1 + roots), "tree-shared")
    pool = group_base.select("query_id", *key).unionByName(shared.select("query_id", *key)).distinct()
    groups = scored(pool.join(shared, ["query_id", *key], "left").join(facts, key), group_base, key, TREE_WEIGHTS[strategy], 7)
    groups = groups.withColumn("gs", F.round(F.col("value") + F.col("kind") * DOC_BONUS - penalty, 9))
    groups = groups.withColumn("gr", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gs"), F.desc("group_id"))))
    # k groups with a chunk each fill the list, and a chunk lies in two groups at most.
    groups = written(groups.filter(F.col("gr") <= k * (1 + roots)).select("query_id", *key, "gr", "gs", "size"), "tree-ranked")
    near_best = best_chunks(texts.filter("doc_id is not null"), groups, every, base, CHILD_WEIGHTS, 5, 1 + roots).distinct()
    chunks = scored(near_best, base, ["doc_id"], CHILD_WEIGHTS, 5).select("query_id", "gr", "doc_id", F.round("value", 9).alias("cs"))
    rows = chunks.join(groups.select("query_id", "gr", "gs"), ["query_id", "gr"])
    rows = rows.withColumn("c", F.row_number().over(Window.partitionBy("query_id", "gr").orderBy(F.desc("cs"), F.desc("doc_id")))).filter(F.col("c") <= 1 + roots)
    first = F.min_by(F.struct("gr", "c", F.round(F.col("gs") + 0.25 * F.col("cs"), 9).alias("score")), F.struct("gr", "c"))
    picked = rows.groupBy("query_id", "doc_id").agg(first.alias("f")).select("query_id", "doc_id", "f.score", (F.col("f.gr") * 10 + F.col("f.c")).alias("place"))
    rest = ranked.select("query_id", "doc_id", "score", (F.col("rank") + 1000).alias("place")).join(picked.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    made = picked.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    return made.filter(F.col("rank") <= k).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
