"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word prefixes is trained with numpy from confirmed toxic texts and
unlabelled texts. The risk of the negatives is that of the unlabelled less the share of the positives in them, and
is kept from going below zero (the non-negative estimator of Kiryo et al., 2017).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlquarry.llm.textvec import U64, Words, chunks

#: Bytes of punctuation that are cut from the ends of words.
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[ord(c) for c in ".,;:!?\"'()[]{}<>*_-"]] = True
#: What turns a prefix's feature into that of a second and a third word with it.
_LEVELS = (0, 0x555555, 0xAAAAAA)


@dataclass(frozen=True)
class PuConfig:
    """positives, unlabelled: most sample rows that training gathers (its documented bound). The class prior is the toxic
    share of all labelled training rows unless prior says otherwise."""

    positives: int = 4096
    unlabelled: int = 16384
    bits: int = 24
    prefixes: tuple[int, ...] = (4, 5, 6)
    min_positive_rows: int = 4
    #: Standard deviations by which a feature's positive rows must exceed what the unlabelled foretell.
    min_z: float = 5.2
    steps: int = 400
    rate: float = 0.05
    l2: float = 3e-5
    prior: float | None = None


@dataclass(frozen=True)
class PuModel:
    """ids: the features with a weight, sorted."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    cfg: PuConfig

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the features with a weight, and of the prefixes that have one at any level."""
        mask, some = np.zeros((2, 1 << self.cfg.bits), dtype=bool)
        mask[self.ids] = True
        for x in _LEVELS:
            some[self.ids ^ (x & ((1 << self.cfg.bits) - 1))] = True
        return mask, some

    def scores(self, texts: pa.Array, wanted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        row, feature = features(texts, self.cfg, wanted)
        return _sigmoid(np.bincount(row, self.weights[np.searchsorted(self.ids, feature)], len(texts)) + self.bias)


def features(texts: pa.Array, cfg: PuConfig, wanted: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, by row: hashed words, and hashed word prefixes that one, two or three words share.

    wanted: masks of features to keep, see PuModel.wanted.
    """
    words = Words(texts)
    start, end, rows = words.start.copy(), words.end.copy(), words.rows()
    for _ in range(3):
        move = (end - start > 1) & _PUNCT[words.data[end - 1]]
        end -= move
    for _ in range(2):
        move = (end - start > 1) & _PUNCT[words.data[np.minimum(start, len(words.data) - 1)]] if len(start) else np.zeros(0, bool)
        start += move
    # A word counts once a row: its row and the upper 40 bits of its hash make the key.
    whole = words.span_hash(start, end)
    _, one = np.unique(rows.astype(U64) << U64(40) | whole >> U64(24), return_index=True)
    start, end, rows, whole = start[one], end[one], rows[one], whole[one]
    size, levels = U64(64 - cfg.bits), [x & ((1 << cfg.bits) - 1) for x in _LEVELS]
    features, owners = [(whole >> size).astype(np.int64)], [rows]
    for n in cfg.prefixes:
        longer = end - start > n
        found = ((words.span_hash(start[longer], start[longer] + n) ^ U64(n * 0x9E3779B97F4A7C15 % 2**64)) >> size).astype(np.int64)
        row = rows[longer]
        if wanted is not None:
            keep = wanted[1][found]
            found, row = found[keep], row[keep]
        both, times = np.unique(row << cfg.bits | found, return_counts=True)
        for level, x in enumerate(levels, 1):
            many = both[times >= level]
            features.append((many & ((1 << cfg.bits) - 1)) ^ x)
            owners.append(many >> cfg.bits)
    feature, row = np.concatenate(features), np.concatenate(owners)
    if wanted is not None:
        keep = wanted[0][feature]
        feature, row = feature[keep], row[keep]
    both = np.unique(row << cfg.bits | feature)
    return both >> cfg.bits, both & ((1 << cfg.bits) - 1)


def _sets(cfg: PuConfig, known: np.ndarray | None = None):
    """Feature sets of texts; known: the features to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None
        if known is not None:
            keep = np.zeros(1 << cfg.bits, dtype=bool)
            keep[known] = True
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                row, feature = features(texts, cfg)
                if keep is not None:
                    row, feature = row[keep[feature]], feature[keep[feature]]
                cut = np.searchsorted(row, np.arange(len(texts) + 1))
                packed = [feature[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(packed, pa.binary())], names=["doc_id", "features"])

    return run


def _occurrences(cfg: PuConfig):
    """A row for each feature of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                row, feature = features(texts, cfg)
                positive = batch.column("positive").slice(at, len(texts)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(feature), positive], names=["feature", "positive"])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def frequent(sets: list[np.ndarray], cfg: PuConfig) -> np.ndarray:
    """Features of at least min_positive_rows of the sets."""
    if not sets:
        return np.zeros(0, np.int64)
    ids, times = np.unique(np.concatenate(sets), return_counts=True)
    return ids[times >= cfg.min_positive_rows].astype(np.int64)


def fit(confirmed: list[np.ndarray], drawn: list[np.ndarray], prior: float, cfg: PuConfig) -> PuModel:
    """Train on the feature sets of confirmed toxic texts and of texts drawn from all, which may be toxic as well.

    Only features that confirmed texts have more often than chance would are kept, and their weights are held at 0 or more:
    a text is toxic for what it says, never clean for it, so a toxic passage in a long clean text is not outweighed.
    """
    ids = frequent(confirmed, cfg)
    if not len(ids) or not drawn:
        return PuModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))), prior, cfg)

    def only(sets: list[np.ndarray]) -> list[np.ndarray]:
        places = (np.minimum(np.searchsorted(ids, s), len(ids) - 1) for s in sets)
        return [at[ids[at] == s] for at, s in zip(places, sets, strict=True)]

    confirmed, drawn = only(confirmed), only(drawn)
    count = lambda sets: np.bincount(np.concatenate(sets), minlength=len(ids))
    in_pos = count(confirmed)
    expected = (count(drawn) + 1) / len(drawn) * len(confirmed)
    useful = (in_pos - expected > cfg.min_z * np.sqrt(expected)) & (in_pos > 2 * expected)
    column, n = np.cumsum(useful) - 1, int(useful.sum())
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    flatten = lambda sets: (np.repeat(np.arange(len(sets)), [useful[x].sum() for x in sets]), column[np.concatenate(sets)][useful[np.concatenate(sets)]])
    (own_p, flat_p), (own_u, flat_u) = flatten(confirmed), flatten(drawn)
    n_p, n_u = len(confirmed), len(drawn)
    for step in range(1, cfg.steps + 1):
        z_p = np.bincount(own_p, w[flat_p], n_p) + b
        z_u = np.bincount(own_u, w[flat_u], n_u) + b
        s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        # Derivatives of the logistic losses with respect to the scores; a negative risk under zero is driven back up.
        if negative >= 0:
            d_p, d_u = prior * (s_p - 1) / n_p - prior * s_p / n_p, s_u / n_u
        else:
            d_p, d_u = prior * s_p / n_p, -s_u / n_u
        grad = np.bincount(flat_p, d_p[own_p], n) + np.bincount(flat_u, d_u[own_u], n) + cfg.l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= cfg.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        np.maximum(w, 0, out=w)  # each kept feature speaks for toxicity
        gb = d_p.sum() + d_u.sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        b -= cfg.rate * (mb / (1 - 0.9**step)) / (vb**0.5 / (1 - 0.999**step) ** 0.5 + 1e-8)
    return PuModel(ids[useful], w, b, prior, cfg)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, cfg: PuConfig | None = None) -> PuModel:
    """Fit on a bounded sample: ids in the order of their hash, up to cfg.positives confirmed toxic and cfg.unlabelled others.

    Held-out ids are in neither part. Rows of labels with null ids or null toxic count for nothing; an id is toxic if
    any of its label rows says so. Without toxic rows the model scores every text with the prior.
    """
    cfg = cfg or PuConfig()
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    prior = cfg.prior
    if prior is None:
        prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    prior = min(max(float(prior), 1e-4), 0.5)
    order = F.xxhash64("doc_id")
    toxic = known.filter("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(cfg.positives)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    others = docs.select("doc_id").distinct().filter(~held_out()).orderBy(order, "doc_id").limit(cfg.unlabelled)

    # At most so many ids: a proven bound for the broadcasts and for what the driver gathers.
    picked = lambda ids: docs.join(F.broadcast(ids), "doc_id")
    n_toxic, n_others = toxic.count(), others.count()
    rows = picked(toxic).withColumn("positive", F.lit(True)).unionByName(picked(others).withColumn("positive", F.lit(False)))
    sums = rows.mapInArrow(_occurrences(cfg), "feature long, positive boolean").groupBy("feature")
    sums = sums.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    expected = (F.col("u") + 1) * (n_toxic / max(n_others, 1))
    useful = (F.col("p") >= cfg.min_positive_rows) & (F.col("p") - expected > cfg.min_z * F.sqrt(expected)) & (F.col("p") > 2 * expected)
    known = np.sort(sums.filter(useful).select("feature").toArrow().column(0).to_numpy())

    def gather(ids: DataFrame) -> list[np.ndarray]:
        found = picked(ids).mapInArrow(_sets(cfg, known), "doc_id long, features binary")
        # Rows that repeat an id count once, so at most as many rows as ids reach the driver.
        found = found.groupBy("doc_id").agg(F.min("features").alias("features")).toArrow().sort_by("doc_id")
        return [np.frombuffer(x.as_py(), dtype="<u4") for x in found.column("features")]

    return fit(gather(toxic), gather(others), prior, cfg)


def _scores(model: PuModel, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = model.wanted()
        for batch in batches:
            found = [np.zeros(0)]
            found += [model.scores(texts, wanted) for _, texts in chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.concatenate(found))], names=[*keep, "score"])

    return run


def score(documents: DataFrame, model: PuModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of documents (doc_id, text).

    The score depends on the text alone; null and empty texts get that of a text without known words. Repeated rows
    are scored each; a null doc_id has a null held_out. The model has a fixed size and goes along with the tasks.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.mapInArrow(_scores(model, ["doc_id"]), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, model: PuModel) -> DataFrame:
    """The rows of documents whose text scores under 0.5, with all columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = model.wanted()
        for batch in batches:
            found = [np.zeros(0)]
            found += [model.scores(texts, wanted) for _, texts in chunks(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(found) < 0.5))

    return documents.mapInArrow(run, documents.schema)
