"""Ranking of documents for many queries at once: lexical, dense, fused and reranked lists.

A ranking has query_id, doc_id, score and rank from 1. Ties are broken by explicit keys; list scores are rounded to six
digits after ordering, as fusion expects.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlquarry.functions.lineage import written
from marlquarry.functions.scalars import TOKEN, tokens
from marlquarry.functions.terms import cutter, frequencies, slices, term_counts
from marlquarry.operators import products, svd
from marlquarry.operators.products import ORDER_DIGITS


def searchable_text(*parts: Column) -> Column:
    """Non-empty parts, one to a line."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")


def top_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """rank 1 .. k within query_id; default order: score down, doc_id down."""
    keys = order or (F.round("score", ORDER_DIGITS).desc(), F.col("doc_id").desc())
    w = Window.partitionBy("query_id").orderBy(*keys)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def token_stats(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and n_distinct of docs (doc_id, text)."""
    t = docs.select("doc_id", tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def document_frequencies(docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, token and df, the number of documents that hold it."""
    # The filter holds for every token; with it all uses of the counts have one plan, and one exchange.
    return docs.select(*by, F.explode(F.array_distinct(tokens("text"))).alias("token")).filter("token is not null").groupBy(*by, "token").agg(F.count("*").alias("df"))


#: Queries, about, and tokens of documents, about, that meet in one task. These bound what a worker holds.
BLOCK, TOKENS = 1024, 500_000


def _lexical(k: int, width: int, k1: float, b: float):
    """For a block of queries and a range of documents: each query's k best, from the texts."""
    best = products.best_items(k, True, width, products.STEP)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        token = left["tokens"].combine_chunks().flatten()
        names = pc.unique(token)
        place = {x: i for i, x in enumerate(names.to_pylist())}
        asked = pa.table({"query_id": left["query_id"].combine_chunks().take(pa.array(np.repeat(np.arange(left.num_rows), pc.list_value_length(left["tokens"]).to_numpy()))), "term": token, "w": left["ws"].combine_chunks().flatten()})
        cut = cutter(TOKEN)
        ids = right["doc_id"].combine_chunks()
        found: dict[tuple, list] = {}
        for start, stop in slices(right["text"].combine_chunks()):
            for at, (doc_id, text) in enumerate(zip(ids.slice(start, stop - start).to_pylist(), right["text"].slice(start, stop - start).to_pylist(), strict=True), start):
                own = cut(text)
                counts = Counter(filter(place.__contains__, own))
                # Rows of one id and length count as one.
                same = found.setdefault((doc_id, len(own)), [at, [], []])
                if same[1]:
                    counts.update({names[t].as_py(): n for t, n in zip(same[1], same[2], strict=True)})
                same[1:] = [place[x] for x in counts], [*counts.values()]
        rows = list(found.values())
        size = [len(x[1]) for x in rows]
        dl = np.repeat(np.array([n for _, n in found], dtype=float), size)
        term = pa.array(np.fromiter(chain.from_iterable(x[1] for x in rows), np.int32, sum(size)))
        tf = np.fromiter(chain.from_iterable(x[2] for x in rows), float, sum(size))
        avgdl = left["avgdl"][0].as_py() if left.num_rows else 1.0
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) if len(tf) else tf
        item = ids.take(pa.array(np.repeat(np.array([x[0] for x in rows], dtype=np.int64), size)))
        return best(key, asked, pa.table({"item": item, "term": pa.DictionaryArray.from_arrays(term, names), "w": pa.array(weight)}))

    return run


def _asked(counts: DataFrame, queries: DataFrame, by: tuple[str, ...], epsilon: float) -> tuple[DataFrame, DataFrame, int]:
    """Each query's tokens with their weights in each corpus, by blocks of queries; the corpora's sizes; and the number of blocks. counts: of frequencies()."""
    meet = lambda x, y: x.join(y, [*by]) if by else x.join(y)
    corpus = counts.filter("token = ''").select(*by, F.col("df").alias("n_docs"), "length", (F.col("length") / F.col("df")).alias("avgdl"))
    vocabulary = meet(counts.filter("token <> ''").select(*by, "token", "df"), corpus)
    vocabulary = vocabulary.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = vocabulary.groupBy(*by).agg(F.avg("raw").alias("mean_idf"))
    q = queries.select("query_id", F.explode(tokens("query_text")).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    idf = meet(vocabulary.join(q.select("token").distinct(), "token", "left_semi"), mean).select(
        *by, "token", "avgdl", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf")
    )
    blocks = max(1, -(-queries.select("query_id").distinct().count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    pair = F.collect_list(F.struct("token", (F.col("qtf") * F.col("idf")).alias("w")))
    asked = q.join(idf, "token").groupBy(*by, "query_id").agg(pair.alias("x"), F.max("avgdl").alias("avgdl"))
    asked = written(asked.select(*by, block, "query_id", F.col("x.token").alias("tokens"), F.col("x.w").alias("ws"), "avgdl"), "lexical-queries")
    return asked, corpus, blocks


def bm25_best(docs: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...] = (), k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """by, query_id, doc_id, score, rank of the k best documents of each query that share a token with it; ties: doc_id down.

    by: columns of docs that part it into corpora. idf is ln(N - df + .5) - ln(df + .5); negative ones become epsilon times the mean idf of
    the vocabulary. A query token that occurs n times counts n times. Texts are shuffled once for each block of queries, as they are: a
    task cuts and counts a range of them, meets it with the block and returns the range's best.
    """
    meet = lambda x, y: x.join(y, [*by]) if by else x.join(y)
    asked, corpus, blocks = _asked(written(frequencies(docs, by), "lexical-counts"), queries, by, epsilon)
    # A row for each corpus. As many ranges as keep a share small and all cores at work.
    least = -(-docs.sparkSession.sparkContext.defaultParallelism // blocks)
    corpora = written(corpus.select(*by, F.greatest(F.ceil(F.col("length") / TOKENS), F.lit(least)).cast("int").alias("ranges")), "lexical-corpora")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keys = ("block", "range", *by)
    left = meet(asked, corpora).withColumn("range", every(F.col("ranges"))).select(*keys, "query_id", "tokens", "ws", "avgdl").groupBy(*keys)
    texts = meet(docs.select(*by, "doc_id", F.col("text").cast("string").alias("text")), corpora).withColumn("range", F.pmod(F.xxhash64("doc_id"), F.col("ranges")).cast("int"))
    right = texts.withColumn("block", every(F.lit(blocks))).select(*keys, "doc_id", "text").groupBy(*keys)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = ", ".join([*(f"by{i} {kind(docs, c)}" for i, c in enumerate(by)), f"query_id {kind(queries, 'query_id')}", f"item {kind(docs, 'doc_id')}", "score double"])
    found = left.cogroup(right).applyInArrow(_lexical(k, len(by), k1, b), schema)
    found = found.select(*(F.col(f"by{i}").alias(c) for i, c in enumerate(by)), "query_id", F.col("item").alias("doc_id"), "score")
    w = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Bytes of texts, about, whose parts are counted at once.
SLICE = 4 << 20


class _Parts:
    """Tokens of documents' lines as numbers, each line cut once, and of each part its corpus, its key and its lines. docs: texts, parts."""

    def __init__(self, docs: pa.Table, wanted: pa.Array | None = None):
        cut, lists = cutter(TOKEN), lambda x: (pc.list_value_length(x).to_numpy(), x.flatten())
        (per_doc, line), (many, part) = (lists(docs[c].combine_chunks()) for c in ("texts", "parts"))
        found = [cut(x) for x in line.to_pylist()]
        self.length = np.fromiter(map(len, found), np.int64, len(found))
        token = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        self.names, code, row = token.dictionary, np.asarray(token.indices).astype(np.int64), np.repeat(np.arange(len(found)), self.length)
        if wanted is not None:
            kept = np.asarray(pc.is_in(self.names, value_set=wanted))[code]
            code, row = code[kept], row[kept]
        # Each line's distinct tokens, and how often they stand in it.
        pair, self.tf = np.unique(row * max(1, len(self.names)) + code, return_counts=True)
        row, self.code = np.divmod(pair, max(1, len(self.names)))
        self.first = np.searchsorted(row, np.arange(len(found) + 1))
        self.corpus, self.key = (pc.struct_field(part, c) for c in ("variant", "key"))
        size, spot = lists(pc.struct_field(part, "spots"))
        before = np.repeat(np.cumsum(per_doc) - per_doc, many)
        self.line, self.start = np.asarray(spot) + np.repeat(before, size), np.concatenate(([0], np.cumsum(size)))

    def of(self, corpus: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys and lengths of a corpus' parts, and part, token and count, by part, of what they hold."""
        own = np.flatnonzero(np.asarray(pc.equal(self.corpus, corpus)))
        each = lambda first, size: np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        size = self.start[own + 1] - self.start[own]
        line, part = self.line[each(self.start[own], size)], np.repeat(np.arange(len(own)), size)
        length = np.bincount(part, self.length[line], len(own))
        size = self.first[line + 1] - self.first[line]
        at, n = each(self.first[line], size), max(1, len(self.names))
        # A token may stand in several of a part's lines.
        pair = np.repeat(part, size) * n + self.code[at]
        order = np.argsort(pair, kind="stable")
        pair, first = pair[order], np.flatnonzero(np.diff(pair[order], prepend=-1))
        tf = np.add.reduceat(self.tf[at][order], first) if len(first) else np.zeros(0, np.int64)
        return self.key.take(pa.array(own)), length, *np.divmod(pair[first], n), tf


def _part_frequencies(docs: DataFrame, corpora: list[str]) -> DataFrame:
    """frequencies() of parts: variant, token, df, length. A token's numbers in all corpora are one row until they are summed."""
    columns = [f"n{i}" for i in range(len(corpora))]

    def run(batches):
        for batch in batches:
            texts = batch.column("texts")
            size = pc.fill_null(pc.binary_length(texts.flatten()), 0).to_numpy().astype(np.int64)
            share, start = np.concatenate(([0], np.cumsum(size)))[np.cumsum(pc.list_value_length(texts).to_numpy())] // SLICE, 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(share, share[start], side="right"))
                held = _Parts(pa.Table.from_batches([batch.slice(start, stop - start)]))
                df = np.zeros((len(corpora), len(held.names) + 2), dtype=np.int64)
                for own, corpus in zip(df, corpora, strict=True):
                    key, length, _, code, _ = held.of(corpus)
                    own[:-2], own[-2], own[-1] = np.bincount(code, minlength=len(held.names)), len(key), length.sum()
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([held.names, pa.array(["", " "])]), *map(pa.array, df)], names=["token", *columns])
                start = stop

    counts = docs.select("texts", "parts").mapInArrow(run, f"token string, {', '.join(f'{c} long' for c in columns)}")
    counts = counts.groupBy("token").agg(*(F.sum(c).alias(c) for c in columns)).unpivot(["token"], columns, "n", "df")
    name = F.create_map(*(F.lit(x) for pair in zip(columns, corpora, strict=True) for x in pair))
    counts = counts.filter("df > 0").select(name[F.col("n")].alias("variant"), "token", "df")
    # The token ' ' tells how many tokens there are, and goes to the token ''.
    token = F.when(F.col("token") == " ", "").otherwise(F.col("token"))
    total = F.col("token") == " "
    return counts.groupBy("variant", token.alias("token")).agg(F.sum(F.when(total, 0).otherwise(F.col("df"))).alias("df"), F.sum(F.when(total, F.col("df")).otherwise(0)).alias("length"))


def _lexical_parts(k: int, k1: float, b: float):
    """For a block of queries and a range of documents: each query's k best parts in each corpus."""
    best = products.best_items(k, True, 0, products.STEP)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"variant": pa.array([], pa.string()), "query_id": left["query_id"].slice(0, 0), "item": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        held = _Parts(right, pc.unique(left["tokens"].combine_chunks().flatten()))
        made = [empty]
        for corpus in pc.unique(left["variant"]).to_pylist():
            own = left.filter(pc.equal(left["variant"], corpus))
            asked = pa.table({"query_id": own["query_id"].combine_chunks().take(pa.array(np.repeat(np.arange(own.num_rows), pc.list_value_length(own["tokens"]).to_numpy()))), "term": own["tokens"].combine_chunks().flatten(), "w": own["ws"].combine_chunks().flatten()})
            name, length, part, code, tf = held.of(corpus)
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[part] / own["avgdl"][0].as_py()))
            item, term = (pa.DictionaryArray.from_arrays(pa.array(x.astype(np.int32)), names) for x, names in ((part, name), (code, held.names)))
            found = best(key, asked, pa.table({"item": item, "term": term, "w": pa.array(weight)}))
            made.append(found.add_column(0, "variant", pa.array([corpus] * found.num_rows, pa.string())).cast(empty.schema))
        return pa.concat_tables(made)

    return run


def bm25_parts(docs: DataFrame, corpora: list[str], queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """variant, query_id, key, score, rank: bm25_best() by corpus, over parts of documents.

    docs: doc_id, once each, texts (lines without line breaks, as an array) and parts (an array of variant, key and spots: its lines' places, from 0), in the
    named corpora. Parts of all corpora share lines, so that a document is shuffled once for each block of queries and a line is cut once in a task, not once for
    each part that holds it.
    """
    docs = written(docs, "lexical-parts")
    asked, corpus, blocks = _asked(written(_part_frequencies(docs, corpora), "lexical-counts"), queries, ("variant",), epsilon)
    # As many ranges as keep each corpus' share small and all cores at work.
    most = corpus.agg(F.max("length").alias("n")).first().n or 0
    ranges = max(1, -(-most // TOKENS), -(-docs.sparkSession.sparkContext.defaultParallelism // blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("range", every(ranges)).groupBy("block", "range")
    right = docs.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int")).withColumn("block", every(blocks)).select("block", "range", "texts", "parts").groupBy("block", "range")
    kind = queries.schema["query_id"].dataType.simpleString()
    found = left.cogroup(right).applyInArrow(_lexical_parts(k, k1, b), f"variant string, query_id {kind}, item string, score double").withColumnRenamed("item", "key")
    w = Window.partitionBy("variant", "query_id").orderBy(F.desc("score"), F.desc("key"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pad_zero(ranked: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Fill lists of fewer than k hits with zero-score documents, largest id first. At most 2 k documents take part."""
    last = docs.select("doc_id").orderBy(F.col("doc_id").desc()).limit(2 * k)
    short = queries.select("query_id").join(ranked.groupBy("query_id").agg(F.max("rank").alias("n")), "query_id", "left").fillna(0, ["n"]).filter(F.col("n") < k)
    extra = short.join(last).join(ranked.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.col("doc_id").desc())
    extra = extra.withColumn("rank", F.col("n") + F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "doc_id", "score", "rank").unionByName(extra.select("query_id", "doc_id", F.lit(0.0).alias("score"), F.col("rank").cast("int")))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 5, pad: bool = False) -> DataFrame:
    """The k best documents of every query; with pad every list is full."""
    ranked = bm25_best(docs, queries, k).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
    # Filling reads the lists three times, and each would rank anew.
    return pad_zero(written(ranked, "lexical-ranked"), docs, queries, k) if pad else ranked


def _term_weights(counts: DataFrame, docs: DataFrame, max_features: int) -> DataFrame:
    """term, idf, df of the most frequent terms of counts (a row for each document and term), written."""
    terms = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(max_features)
    size = docs.agg(F.count("*").alias("n_docs"))
    return written(terms.join(size).select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"), "df"), "tfidf-terms")


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count())


def _counted(docs: DataFrame, n: int) -> DataFrame:
    counts = term_counts(docs, ("doc_id",), n=n).filter("token <> ''").select("doc_id", F.col("token").alias("term"), "tf")
    # A row's terms are counted where it lies; only where an id has several rows do their counts meet.
    return counts.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")) if _repeats(docs) else counts


def tfidf(docs: DataFrame, n: int = 2, max_features: int = 50_000) -> DataFrame:
    """doc_id, term, weight: smooth idf over 1..n-grams of the most frequent terms, rows of unit length.

    Terms are ranked by their total count, ties by term; idf is ln((1 + N) / (1 + df)) + 1.
    """
    counts = _counted(docs, n)
    idf = _term_weights(counts, docs, max_features).select("term", "idf")
    # At most max_features rows meet the terms where these are counted; only kept terms are shuffled, once, to their documents.
    raw = counts.join(F.broadcast(idf), "term").select("doc_id", F.struct("term", (F.col("tf") * F.col("idf")).alias("raw")).alias("x"))
    rows = raw.groupBy("doc_id").agg(F.collect_list("x").alias("xs"), F.sqrt(F.sum(F.col("x.raw") ** 2)).alias("norm"))
    return rows.select("doc_id", "norm", F.inline("xs")).select("doc_id", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def svd_vectors(weights: DataFrame, dim: int = 128, docs: DataFrame | None = None) -> DataFrame:
    """doc_id and a unit vector for each document of weights (doc_id, term, weight), by truncated SVD.

    docs: documents of which each gets a row; those without a weight have a vector of zeros. The vectors have dim numbers, or
    one fewer than there are terms or documents; components without a singular value are zero.
    """
    terms = weights.groupBy("term").agg(F.count("*").alias("df"))
    terms = written(terms.select("term", (F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).alias("column")), "svd-terms")
    size = terms.count()
    rows = weights.join(terms, "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("column", "weight"))).alias("x"))
    matrix = written(svd.packed(rows), "svd-rows")
    width = max(1, min(dim, size - 1, (docs.select("doc_id").distinct() if docs is not None else matrix).count() - 1))
    found = svd.unit_rows(matrix, svd.right_vectors(matrix, size, width) if size else np.zeros((0, 0)), width)
    if docs is None:
        return found
    zeros = F.array_repeat(F.lit(0.0), width)
    return docs.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("embedding", zeros).alias("embedding"))


def svd_texts(docs: DataFrame, dim: int = 128, n: int = 2, max_features: int = 50_000) -> DataFrame:
    """svd_vectors(tfidf(docs, n, max_features), dim, docs), where a text becomes a row of the matrix where it lies.

    The terms, at most max_features of them, go along with the tasks; weights are shuffled only where an id has several texts.
    """
    if _repeats(docs):
        return svd_vectors(tfidf(docs, n, max_features), dim, docs)
    idf = _term_weights(_counted(docs, n), docs, max_features).orderBy(F.desc("df"), "term").toArrow()
    told = docs.sparkSession.sparkContext.broadcast((idf["term"].to_pylist(), idf["idf"].to_numpy()))

    def run(batches):
        own_tokens, (terms, weight) = cutter(TOKEN), told.value
        place = {x: i for i, x in enumerate(terms)}
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                column, tf, size = [], [], []
                for text in batch.column("text").slice(start, stop - start).to_pylist():
                    found = own_tokens(text)
                    runs = (map(" ".join, zip(*(found[i:] for i in range(k)))) for k in range(2, n + 1) if len(found) >= n)
                    counts = Counter(filter(None.__ne__, map(place.get, chain(found, *runs))))
                    column.extend(counts)
                    tf.extend(counts.values())
                    size.append(len(counts))
                cut, at = np.concatenate(([0], np.cumsum(size, dtype=np.int64))), np.array(column, dtype=np.int32)
                raw = np.array(tf, dtype=float) * weight[at] if len(at) else np.zeros(0)
                row = np.repeat(np.arange(stop - start), size)
                raw /= np.sqrt(np.bincount(row, raw**2, stop - start))[row]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), svd.as_bytes(at, cut), svd.as_bytes(raw, cut)], names=["doc_id", "column", "weight"])

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {svd.ROW}"
    matrix = written(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, kind), "svd-rows")
    width = max(1, min(dim, idf.num_rows - 1, matrix.count() - 1))
    return svd.unit_rows(matrix, svd.right_vectors(matrix, idf.num_rows, width) if idf.num_rows else np.zeros((0, 0)), width)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _vectors(table: pa.Table) -> np.ndarray:
    """The table's embeddings as rows of a matrix."""
    flat = np.asarray(table["embedding"].combine_chunks().flatten(), dtype=np.float64)
    return flat.reshape(table.num_rows, len(flat) // max(1, table.num_rows))


#: Scores that are looked at together.
SCORES = 1 << 19


def dense_topk(docs: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """Exact dot-product top-k of queries (query_id, embedding) over docs (doc_id, embedding), block by block.

    Each block of about query_block queries meets each range of about block documents once, in a group of its own, so a worker holds one pair of
    blocks at a time whatever the tables' sizes; a pair gives k a query, and the lists meet in one window. Neither side passes through the driver.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, q, d = left["query_id"].combine_chunks(), _vectors(left), _vectors(right)
        names = right["doc_id"].combine_chunks()
        # Places of ids in falling order break ties of scores.
        place = np.empty(len(names), dtype=np.int64)
        place[np.asarray(pc.sort_indices(names))[::-1]] = np.arange(len(names))
        rows, columns, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        step = max(1, SCORES // max(1, len(names)))
        for at in range(0, len(ids) if len(names) else 0, step):
            scores = q[at : at + step] @ d.T
            shown = np.round(scores, ORDER_DIGITS)
            # All that reach the k-th best score, ties and all, are ordered.
            least = -np.partition(-shown, k - 1, axis=1)[:, k - 1 : k] if len(names) > k else -np.inf
            row, column = np.nonzero(shown >= least)
            order = np.lexsort((place[column], -shown[row, column], row))
            row, column = row[order], column[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            rows.append(row[best] + at)
            columns.append(column[best])
            found.append(scores[row[best], column[best]])
        made = [ids.take(pa.array(np.concatenate(rows))), names.take(pa.array(np.concatenate(columns))), pa.array(np.concatenate(found))]
        return pa.Table.from_arrays(made, names=["query_id", "doc_id", "score"])

    kind = queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    given = lambda df, key, label: written(df.select(key, "embedding").filter(f"embedding is not null and {key} is not null"), label)
    left, right = given(queries, "query_id", "dense-queries"), given(docs, "doc_id", "dense-docs")
    blocks = max(1, -(-left.count() // query_block))
    # As many ranges as keep a pair small and all cores at work.
    ranges = max(1, -(-right.count() // block), -(-docs.sparkSession.sparkContext.defaultParallelism // blocks))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("block", part("query_id", blocks)).withColumn("range", every(ranges)).groupBy("block", "range")
    right = right.withColumn("range", part("doc_id", ranges)).withColumn("block", every(blocks)).groupBy("block", "range")
    near = left.cogroup(right).applyInArrow(run, f"query_id {kind[0]}, doc_id {kind[1]}, score double")
    return top_k(near, k).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    side = lambda x, n: x.select("query_id", "doc_id", F.col("score").alias(f"{n}_score"), F.col("rank").alias(f"{n}_rank"))
    return side(a, "a").join(side(b, "b"), ["query_id", "doc_id"], "full_outer")


def _fused(both: DataFrame, k: int, missing: int) -> DataFrame:
    """Order: score, the better rank, the first list's rank, the second's, id; a missing rank is `missing`."""
    a, b = F.coalesce("a_rank", F.lit(missing)), F.coalesce("b_rank", F.lit(missing))
    return top_k(both, k, F.col("score").desc(), F.least(a, b), a, b, F.col("doc_id")).select("query_id", "doc_id", "score", "rank")


def fuse_rrf(lexical: DataFrame, dense: DataFrame, k: int = 5, rrf_k: int = 60, candidate_k: int = 50) -> DataFrame:
    """Reciprocal-rank fusion; a side without the document adds nothing."""
    part = lambda c: F.coalesce(1.0 / (F.lit(float(rrf_k)) + F.col(c)), F.lit(0.0))
    both = _both(lexical, dense).withColumn("score", F.round(part("a_rank") + part("b_rank"), 6))
    return _fused(both, k, candidate_k + 1)


def min_max(ranked: DataFrame) -> DataFrame:
    """Scores scaled to 0 .. 1 within a query; a constant list is 1 where positive, else 0."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high == low, F.when(high > 0, 1.0).otherwise(0.0)).otherwise(F.round((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)), 6))
    return ranked.withColumn("score", scaled)


def fuse_weighted(lexical: DataFrame, dense: DataFrame, k: int = 5, alpha: float = 0.5, candidate_k: int = 50) -> DataFrame:
    """(1 - alpha) of the scaled lexical score plus alpha of the scaled dense one; a missing side counts 0."""
    both = _both(min_max(lexical), min_max(dense))
    # The small term rounds decimal ties up whatever their binary form is.
    score = F.round((1 - alpha) * F.coalesce("a_score", F.lit(0.0)) + alpha * F.coalesce("b_score", F.lit(0.0)) + 1e-10, 6)
    return _fused(both.withColumn("score", score), k, candidate_k + 1)


def rerank(ranked: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Callable[[Column, Column], Column], k: int = 5, passage: int = 1800) -> DataFrame:
    """Order candidates anew by scorer(query_text, passage) - a column expression or pandas UDF -, then base rank, then id."""
    pairs = ranked.select("query_id", "doc_id", F.col("rank").alias("base_rank"))
    pairs = pairs.join(queries.select("query_id", "query_text"), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    scored = pairs.withColumn("score", scorer(F.col("query_text"), F.substring("text", 1, passage)))
    return top_k(scored, k, F.col("score").desc(), F.col("base_rank"), F.col("doc_id")).select(
        "query_id", "doc_id", F.round("score", 6).alias("score"), "base_rank", "rank"
    )


def overlap_scorer(query: Column, passage: Column) -> Column:
    """Share of the query's distinct tokens that the passage holds: a deterministic stand-in for a neural scorer."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.size(F.array_intersect(q, tokens(passage))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def maxsim(q: Column, d: Column) -> Column:
    """Mean over query token vectors of the largest dot product with a document token vector."""
    best = F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: dot(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(-1e6))) / F.greatest(F.size(q), F.lit(1))


def late_interaction(ranked: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame, k: int = 5) -> DataFrame:
    """Rerank by MaxSim of token vectors (query_id, vectors) and (doc_id, vectors); ties by base rank, then id."""
    pairs = ranked.select("query_id", "doc_id", F.col("rank").alias("base_rank"))
    pairs = pairs.join(query_tokens.withColumnRenamed("vectors", "q"), "query_id").join(doc_tokens.withColumnRenamed("vectors", "d"), "doc_id")
    scored = pairs.withColumn("score", maxsim(F.col("q"), F.col("d")))
    return top_k(scored, k, F.round("score", ORDER_DIGITS).desc(), F.col("base_rank"), F.col("doc_id")).select(
        "query_id", "doc_id", F.round("score", 6).alias("score"), "base_rank", "rank"
    )


def _hits(text: Column, terms: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(F.lower(text), t)))


def context_boost(ranked: DataFrame, docs: DataFrame, places: tuple[str, ...], story: tuple[str, ...], k: int = 5) -> DataFrame:
    """Scores plus .05 for each place term in the text, .10 at most, and .02 for each story term, .06 at most."""
    pairs = ranked.select("query_id", "doc_id", F.col("rank").alias("base_rank"), F.col("score").alias("base_score")).join(docs.select("doc_id", "text"), "doc_id")
    boost = F.least(0.05 * _hits(F.col("text"), places), F.lit(0.10)) + F.least(0.02 * _hits(F.col("text"), story), F.lit(0.06))
    scored = pairs.withColumn("score", F.round(F.col("base_score") + boost, 6))
    return top_k(scored, k, F.col("score").desc(), F.col("base_rank"), F.col("doc_id")).select("query_id", "doc_id", "score", "base_rank", "rank")


def expand_query(queries: DataFrame, generated: DataFrame) -> DataFrame:
    """Query text with a generated passage under it (query_id, generated); queries that expect no answer stay as they are."""
    found = queries.join(generated, "query_id", "left")
    text = F.when((F.coalesce("expected_behavior", F.lit("retrieve")) == "abstain") | F.col("generated").isNull(), F.col("query_text"))
    return found.withColumn("query_text", text.otherwise(F.concat_ws("\n", "query_text", "generated"))).drop("generated")


def result_rows(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Every query's hits; a query without any has one row with null rank."""
    return queries.select("query_id").join(ranked, "query_id", "left")


def containment(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id of documents whose text contains the query's text.

    A query's longest token but its first and last lies whole in such a document, so pairs meet on that token; only queries
    of fewer than three tokens are compared with every document.
    """
    q = queries.select("query_id", "query_text", tokens("query_text").alias("t")).filter("query_text <> ''")
    inner = F.slice("t", 2, F.greatest(F.size("t") - 2, F.lit(0)))
    key = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    q = q.withColumn("token", F.when(F.size("t") >= 3, key)).drop("t")
    d = docs.select("doc_id", "text")
    wanted = q.filter("token is not null")
    met = term_counts(d).select("doc_id", "token").join(wanted.select("token", "query_id"), "token")
    pairs = met.select("doc_id", "query_id").join(d, "doc_id").join(wanted.select("query_id", "query_text"), "query_id")
    short = d.join(q.filter("token is null").select("query_id", "query_text"), F.expr("contains(text, query_text)"))
    return pairs.filter("contains(text, query_text)").select("query_id", "doc_id").unionByName(short.select("query_id", "doc_id"))
