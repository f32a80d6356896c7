"""Mixing sources to target weights by iterative proportional fitting (raking).

Topics are those of a model trained on all documents, or a given column. Tokens are summed in cells of source, language and topic. Raking scales the cells until their sums over each of the
three agree with the target marginals. What a cell should have over what it has is its weight; weights times a
common factor, at most 1, are the probabilities with which documents are drawn. Every value has its own target; few
cells are raked on the driver, many in passes over a table with a row for each value of the longest axis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlquarry.llm.textvec import U64, Words, chunks, mix as mix_bits
from marlquarry.llm.workspace import Workspace

#: Values that have no target of their own, and nulls.
REST = "(rest)"
AXES = ("source", "lang", "topic")


@dataclass(frozen=True)
class MixConfig:
    """targets: for each axis the share of each value; values without a share fall under REST, whose share may be given.
    An axis without targets gets its tokens' shares to the power temperature[axis], over all its values; nulls are one value.

    topic: column that holds a document's topic; without it topics come from a model of so many topics (see train_topics) of all
    documents, whose rounds begin with the centres of at most sample of them. floor: where values have too few tokens for their targets, the budget falls as
    far as they need, but not below this share of all tokens; values that are short even then are drawn whole.

    dense: most cells (of all combinations of values) that are raked on the driver; beyond it the same fit is made over a
    table, and the driver holds the combinations of the two shorter axes. budget: share of all tokens that the draw should hold.
    """

    targets: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    temperature: Mapping[str, float] = field(default_factory=lambda: {"source": 0.7, "lang": 0.7, "topic": 0.5})
    dense: int = 400_000
    topic: str | None = None
    topics: int = 8
    sample: int = 2048
    features: int = 4096
    budget: float = 0.7
    floor: float = 0.3
    rounds: int = 200
    tolerance: float = 1e-9
    seed: int = 20240607


def _bags(texts: pa.Array, cfg: MixConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Row, feature and count of the hashed words of over three bytes."""
    words = Words(texts)
    long = words.end - words.start > 3
    feature = (words.span_hash(words.start[long], words.end[long]) % U64(cfg.features)).astype(np.int64)
    key = words.rows()[long] * cfg.features + feature
    # Short numbers are sorted in half the time.
    key = key.astype(np.int32) if len(texts) * cfg.features < 2**31 else key
    both, times = np.unique(key, return_counts=True)
    row, feature = np.divmod(both, cfg.features)
    return row, feature, times, words


@dataclass(frozen=True)
class Topics:
    """Spherical k-means over hashed words: for each feature its weight, and its share in each of the centres."""

    idf: np.ndarray
    centres: np.ndarray


def fit_topics(bags: list[tuple[np.ndarray, np.ndarray]], cfg: MixConfig) -> Topics | None:
    """Centres of documents (features, counts); the first ones are the documents least like those chosen before."""
    bags = [b for b in bags if len(b[0])]
    if not bags:
        return None
    n = len(bags)
    row, at, times = np.repeat(np.arange(n), [len(f) for f, _ in bags]), np.concatenate([f for f, _ in bags]), np.concatenate([c for _, c in bags])
    idf = np.log((n + 1) / (np.bincount(at, minlength=cfg.features) + 1)) + 1e-3
    x = (1 + np.log(times)) * idf[at]
    x /= np.sqrt(np.bincount(row, x**2, n))[row]
    dense = lambda i: np.bincount(at[row == i], x[row == i], cfg.features)
    near = lambda c: np.bincount(row, x * c[at], n)
    centres = [dense(0)]
    best = near(centres[0])
    while len(centres) < min(cfg.topics, n):
        centres.append(dense(int(best.argmin())))
        best = np.maximum(best, near(centres[-1]))
    of = None
    for _ in range(30):
        found = np.stack([near(c) for c in centres]).argmax(0)
        if of is not None and (found == of).all():
            break
        of = found
        sums = [np.bincount(at, x * (of == k)[row], cfg.features) for k in range(len(centres))]
        centres = [s / np.linalg.norm(s) if s.any() else c for s, c in zip(sums, centres, strict=True)]
    return Topics(idf.astype(np.float32), np.stack(centres, 1).astype(np.float32))


#: Shares of a centre are summed as whole numbers of this fineness, so that no order of rows changes them.
UNIT = 1 << 24
#: Rows that are looked at together in a pass over all documents: few enough that their numbers stay in a core's cache.
ROWS = 256


def _binary(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """For each row the bytes of its numbers, which pass from tables to Python without a step for each number."""
    offsets = pa.py_buffer((cut * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, one after another, and where each row's begin and end."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind), (at - at[0]) // np.dtype(kind).itemsize


def _place(cfg: MixConfig) -> type:
    """The shortest kind of number that holds a feature."""
    return np.uint16 if cfg.features <= 1 << 16 else np.uint32


def _counts(times: np.ndarray, cut: np.ndarray) -> pa.Array:
    """For each row the bytes of its counts: one byte each, or four each in a row where a count needs more."""
    if times.max(initial=0) < 256:
        return _binary(times.astype(np.uint8), cut)
    own = (times[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    return pa.array([x.astype(np.uint8 if x.max(initial=0) < 256 else np.int32).tobytes() for x in own], pa.binary())


def _count(data: bytes, n: int) -> np.ndarray:
    """The n counts of a row of _counts()."""
    return np.frombuffer(data, np.uint8 if len(data) == n else np.int32).astype(np.int64)


def _all_counts(column: pa.Array, cut: np.ndarray) -> np.ndarray:
    """The counts of all rows, whose features begin and end at cut, one after another."""
    times, at = _numbers(column, np.uint8)
    if (at == cut).all():
        return times.astype(np.int64)
    return np.concatenate([_count(x, n) for x, n in zip(column.to_pylist(), np.diff(cut).tolist(), strict=True)])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """ROWS rows at a time."""
    return (batch.slice(start, ROWS) for start in range(0, batch.num_rows, ROWS))


def _summed(bags: DataFrame, step: Callable, size: int) -> np.ndarray:
    """The sum of step(some rows), an array of size whole numbers, over all bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in _parts(batch):
                own += step(part)
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some])], names=["at", "x"])

    out = np.zeros(size, dtype=np.int64)
    for at, x in bags.mapInArrow(run, "at long, x long").groupBy("at").agg(F.sum("x")).collect():
        out[at] = x
    return out


def _nearness(feature: np.ndarray, x: np.ndarray, first: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each centre (a row of centres) its products with the rows of entries that begin at first, none of them empty."""
    if not len(first):
        return np.zeros((len(centres), 0))
    feature, share, own = feature.astype(np.intp), np.empty(len(feature), centres.dtype), np.empty(len(feature))
    out = np.empty((len(centres), len(first)))
    for c, near in zip(centres, out, strict=True):
        # All places are valid; "clip" spares a check and a copy.
        np.multiply(c.take(feature, out=share, mode="clip"), x, out=own)
        np.add.reduceat(own, first, out=near)
    return out


def train_topics(documents: DataFrame, cfg: MixConfig) -> Topics | None:
    """Topics of all documents with an id and a word; None if there are none.

    Weights of features are counted over all of them, and each round of k-means passes over all of them. Only the places where the rounds begin
    are those that fit_topics() finds for the cfg.sample documents whose ids have the least hashes. A round returns sums of whole numbers, a
    number for each feature and topic, so neither their order nor the partitions matter; it ends where no centre turns any more.
    """
    if cfg.topic:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                row, feature, times, _ = _bags(texts, cfg)
                cut = np.searchsorted(row, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays([batch.column("hash").slice(at, len(texts)), _binary(feature.astype(_place(cfg)), cut), _counts(times, cut)], names=["hash", "feature", "times"])

    ws = Workspace(documents.sparkSession, "topics")
    rows = documents.filter("doc_id is not null").select(F.xxhash64(F.col("doc_id").cast("long")).alias("hash"), F.col("text").cast("string").alias("text"))
    bags = ws.table(rows.mapInArrow(run, "hash long, feature binary, times binary").filter("octet_length(feature) > 0"), "bags")
    last = [r[0] for r in bags.select("hash").distinct().orderBy("hash").limit(cfg.sample).collect()][-1:]
    if not last:
        ws.drop("bags")
        return None
    # Rows that repeat an id count once here, so the driver gets cfg.sample bags at most.
    first = bags.filter(F.col("hash") <= last[0]).groupBy("hash").agg(F.min(F.struct("feature", "times")).alias("b")).orderBy("hash").collect()
    own = [(np.frombuffer(r["b"]["feature"], _place(cfg)).astype(np.int64), r["b"]["times"]) for r in first]
    centres = fit_topics([(at, _count(times, len(at))) for at, times in own], cfg).centres.astype(float)

    def seen(part: pa.RecordBatch) -> np.ndarray:
        return np.append(np.bincount(_numbers(part.column("feature"), _place(cfg))[0], minlength=cfg.features), part.num_rows)

    counts = _summed(bags, seen, cfg.features + 1)
    idf = np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 1e-3
    k = centres.shape[1]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                at, cut = _numbers(part.column("feature"), _place(cfg))
                times = _all_counts(part.column("times"), cut)
                row = np.repeat(np.arange(part.num_rows), np.diff(cut))
                x = (1 + np.log(times)) * idf[at]
                x /= np.sqrt(np.bincount(row, x**2, part.num_rows))[row]
                yield pa.RecordBatch.from_arrays([part.column("feature"), _binary(np.rint(x * UNIT).astype(np.int32), cut)], names=["feature", "x"])

    # What no round changes is worked out once, and kept in as few bytes as it needs: each round moves it all.
    weighed = ws.table(bags.select("feature", "times").mapInArrow(weigh, "feature binary, x binary"), "weighed")
    ws.drop("bags")
    for _ in range(30):

        def step(part: pa.RecordBatch, centres: np.ndarray = np.ascontiguousarray(centres.T)) -> np.ndarray:
            at, cut = _numbers(part.column("feature"), _place(cfg))
            x = _numbers(part.column("x"), np.int32)[0].astype(float)
            of = _nearness(at, x, cut[:-1], centres).argmax(0)
            return np.bincount(at * np.int64(k) + np.repeat(of, np.diff(cut)), x, cfg.features * k).astype(np.int64)

        sums = _summed(weighed, step, cfg.features * k).reshape(-1, k).astype(float)
        length = np.sqrt((sums**2).sum(0))
        turned = np.where(length > 0, sums / np.maximum(length, 1.0), centres)
        still = (turned * centres).sum(0).min() > 1 - 1e-5
        centres = turned
        if still:
            break
    ws.drop("weighed")
    return Topics(idf.astype(np.float32), centres.astype(np.float32))


def topics_of(texts: pa.Array, model: Topics | None, cfg: MixConfig) -> tuple[list[str | None], np.ndarray]:
    """The nearest topic (ties: the lower number) and the whitespace tokens of each text; texts without longer words have no topic."""
    row, feature, times, words = _bags(texts, cfg)
    n = len(texts)
    if model is None:
        return [None] * n, np.diff(words.first)
    x = (1 + np.log(times)) * model.idf[feature]
    size = np.bincount(row, minlength=n)
    some = size > 0
    of = np.zeros(n, dtype=np.int64)
    of[some] = _nearness(feature, x, (np.cumsum(size) - size)[some], np.ascontiguousarray(model.centres.T)).argmax(0)
    return [f"t{k}" if c else None for k, c in zip(of.tolist(), some.tolist(), strict=True)], np.diff(words.first)


def draws(doc_id: pa.Array, seed: int) -> np.ndarray:
    """A number in [0, 1) for each id, by id and seed alone; nulls share one."""
    ids = np.asarray(doc_id.fill_null(-(2**63)), dtype=np.int64).view(U64)
    return (mix_bits(mix_bits(ids) + U64(seed)) >> U64(11)).astype(float) / 2.0**53


SEEN = "doc_id long, source string, lang string, topic string, n_tokens long, draw double"


def _seen(documents: DataFrame, model: Topics | None, cfg: MixConfig) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                part = batch.slice(at, len(texts))
                topics, tokens = topics_of(texts, model, cfg)
                topics = part.column("given") if cfg.topic else pa.array(topics, pa.string())
                arrays = [*(part.column(c) for c in ("doc_id", "source", "lang")), topics, pa.array(tokens), pa.array(draws(part.column("doc_id"), cfg.seed))]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SEEN.split(", ")])

    given = (F.col(cfg.topic) if cfg.topic else F.lit(None)).cast("string").alias("given")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")), given)
    return rows.mapInArrow(run, SEEN)


def rake(have: np.ndarray, targets: list[np.ndarray], rounds: int, tolerance: float) -> np.ndarray:
    """Scale the cells of have, in turn along each axis, until their sums agree with targets.

    Targets of values without tokens are dropped and the others scaled to 1, so the fit is to what can be reached.
    """
    fit = have / max(have.sum(), 1e-300)
    wanted = []
    for axis, target in enumerate(targets):
        sums = fit.sum(tuple(a for a in range(fit.ndim) if a != axis))
        t = np.where(sums > 0, target, 0.0)
        wanted.append(t / t.sum() if t.sum() > 0 else sums)
    for _ in range(rounds):
        worst = 0.0
        for axis, target in enumerate(wanted):
            sums = fit.sum(tuple(a for a in range(fit.ndim) if a != axis))
            scale = np.divide(target, sums, out=np.ones_like(target), where=sums > 0)
            worst = max(worst, float(np.abs(sums - target).max(initial=0)))
            fit = fit * scale.reshape([-1 if a == axis else 1 for a in range(fit.ndim)])
        if worst < tolerance:
            break
    return fit


def probabilities(have: np.ndarray, fit: np.ndarray, budget: float) -> np.ndarray:
    """min(1, c * fit / have) with c such that the expected tokens are budget times all, as far as they reach."""
    total = have.sum()
    weight = np.divide(fit * total, have, out=np.zeros_like(fit), where=have > 0)
    low, high = 0.0, 1.0
    while (have * np.minimum(1, high * weight)).sum() < budget * total * (1 - 1e-12) and high < 1e12:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (have * np.minimum(1, mid * weight)).sum() < budget * total else (low, mid)
    return np.minimum(1, high * weight)


def filled(n: np.ndarray, scale: np.ndarray, row: np.ndarray, wanted: np.ndarray, factor: np.ndarray | None = None) -> np.ndarray:
    """For each row the factor f with which the sum of min(n, n * f * scale) over its cells is what is wanted."""
    size = len(wanted)
    sums = np.bincount(row, n, size)
    factor = np.divide(wanted, np.bincount(row, n * scale, size), out=np.zeros(size), where=sums > 0) if factor is None else factor.copy()
    for _ in range(60):
        got = np.bincount(row, n * np.minimum(1, factor[row] * scale), size)
        short = np.divide(wanted, got, out=np.ones(size), where=got > 0)
        if np.abs(short - 1).max(initial=0) < 1e-12:
            break
        factor = np.minimum(factor * short, 1e15)
    return np.where(wanted >= sums * (1 - 1e-12), 1e15, factor)


def reachable(target: np.ndarray, sums: np.ndarray, tokens: float) -> np.ndarray:
    """target * tokens, as far as sums hold it; what is short goes to the other values in proportion."""
    target = np.where(sums > 0, target, 0.0)
    full = np.zeros(len(sums), dtype=bool)
    while True:
        rest = target[~full].sum()
        want = np.where(full, sums, target * ((tokens - sums[full].sum()) / rest if rest > 0 else 0.0))
        over = (want > sums) & ~full
        if not over.any():
            return want
        full |= over


def tokens_to_draw(targets: list[np.ndarray], sums: list[np.ndarray], cfg: MixConfig) -> float:
    """The budget, or less where a value has too few tokens for its target, but not less than the floor."""
    total = sums[0].sum()
    most = min((float((s[t > 0] / t[t > 0]).min()) for t, s in ((np.where(s > 0, t, 0.0), s) for t, s in zip(targets, sums, strict=True)) if (t > 0).any()), default=total)
    return min(cfg.budget * total, max(cfg.floor * total, most))


def bounded(have: np.ndarray, targets: list[np.ndarray], cfg: MixConfig) -> np.ndarray:
    """Probabilities min(1, product of a factor for each value) whose expected sums along each axis agree with targets.

    Raking in which no cell is drawn more than whole: what full cells can't give comes from the others of the same values.
    """
    sums = [have.sum(tuple(a for a in range(have.ndim) if a != k)) for k in range(have.ndim)]
    tokens = tokens_to_draw(targets, sums, cfg)
    wanted = [reachable(t, s, tokens) for t, s in zip(targets, sums, strict=True)]
    at = np.nonzero(have)
    n, factors = have[at], [np.ones(k) for k in have.shape]
    for _ in range(cfg.rounds):
        worst = 0.0
        for axis, want in enumerate(wanted):
            scale = np.prod([np.minimum(f[at[k]], 1e15) for k, f in enumerate(factors) if k != axis], axis=0)
            got = np.bincount(at[axis], n * np.minimum(1, factors[axis][at[axis]] * scale), len(want))
            worst = max(worst, float(np.abs(got - want).max(initial=0)) / max(tokens, 1e-300))
            factors[axis] = filled(n, scale, at[axis], want)
        if worst < cfg.tolerance:
            break
    out = np.zeros(have.shape)
    out[at] = np.minimum(1, np.prod([f[at[k]] for k, f in enumerate(factors)], axis=0))
    return out


def _name(axis: str, cfg: MixConfig) -> Column:
    found, given = F.col(axis).cast("string"), cfg.targets.get(axis)
    return F.when(found.isin(sorted(set(given) - {REST})), found).otherwise(REST) if given else F.coalesce(found, F.lit(REST))


def _target(axis: str, names: list[str], sums: np.ndarray, cfg: MixConfig) -> np.ndarray:
    given = cfg.targets.get(axis)
    target = np.array([float(given.get(v, 0.0)) for v in names]) if given else np.where(sums > 0, sums, 0.0) ** cfg.temperature[axis] * (sums > 0)
    return target / max(target.sum(), 1e-300)


def plan(cells: DataFrame, cfg: MixConfig) -> tuple[dict[str, list[str]], np.ndarray, np.ndarray] | None:
    """Values of each axis, weights and probabilities of all their combinations; None if those are more than cfg.dense.

    cells: source, lang, topic, n_tokens. The driver gets at most cfg.dense values of an axis and cells.
    """
    values: dict[str, list[str]] = {}
    for axis in AXES:
        given = cfg.targets.get(axis)
        found = sorted(given) if given else [r[0] for r in cells.filter(F.col(axis).isNotNull()).select(axis).distinct().limit(cfg.dense).collect()]
        values[axis] = sorted(set(found) - {REST})
    if np.prod([float(len(values[axis]) + 1) for axis in AXES]) > cfg.dense:
        return None
    named = cells.select(*(_name(axis, cfg).alias(axis) for axis in AXES), "n_tokens")
    place = {axis: {v: k for k, v in enumerate([*values[axis], REST])} for axis in AXES}
    have = np.zeros([len(place[axis]) for axis in AXES])
    for row in named.groupBy(*AXES).agg(F.sum("n_tokens").alias("n")).collect():
        have[tuple(place[axis][row[axis]] for axis in AXES)] = row["n"]
    sums = [have.sum(tuple(a for a in range(3) if a != k)) for k in range(3)]
    targets = [_target(axis, list(place[axis]), sums[k], cfg) for k, axis in enumerate(AXES)]
    fit = rake(have, targets, cfg.rounds, cfg.tolerance)
    weight = np.divide(fit * have.sum(), have, out=np.zeros_like(fit), where=have > 0)
    chance = probabilities(have, fit, cfg.budget)
    return values, weight, bounded(have, targets, cfg) if (weight * cfg.budget > 1).any() else chance


CELLS = T.StructType([T.StructField(f"{axis}_cell", T.StringType()) for axis in AXES] + [T.StructField(c, T.DoubleType()) for c in ("weight", "probability")])


def cell_table(spark: SparkSession, values: dict[str, list[str]], weight: np.ndarray, chance: np.ndarray) -> DataFrame:
    named = [[*values[axis], REST] for axis in AXES]
    cells = [(*key, float(weight[at]), float(chance[at])) for key, at in zip(product(*named), np.ndindex(weight.shape), strict=True) if weight[at] > 0]
    return spark.createDataFrame(cells, CELLS)


def rake_table(cells: DataFrame, cfg: MixConfig, ws: Workspace) -> DataFrame:
    """The cells with tokens, their weights and probabilities (CELLS), where they are too many for the driver.

    A row holds the cells of one value of the longest axis, so that its factor is its target over a sum in the row. A pass
    returns the fit's sums over the two other axes, which are then scaled on the driver, until they agree with their targets.
    """
    named = cells.select(*(_name(axis, cfg).alias(axis) for axis in AXES), "n_tokens").filter("n_tokens > 0")
    named = ws.table(named.groupBy(*AXES).agg(F.sum("n_tokens").cast("double").alias("n")), "cells")
    counts = named.agg(*(F.countDistinct(axis).alias(axis) for axis in AXES)).first()
    long = max(AXES, key=lambda axis: counts[axis])
    names, targets, placed = [], [], named
    for axis in (a for a in AXES if a != long):
        rows = sorted(named.groupBy(axis).agg(F.sum("n")).collect())
        names.append([r[0] for r in rows])
        target = _target(axis, names[-1], np.array([r[1] for r in rows]), cfg)
        targets.append(target if target.sum() > 0 else np.array([r[1] for r in rows]) / sum(r[1] for r in rows))
        places = named.sparkSession.createDataFrame(list(zip(names[-1], range(len(rows)), strict=True)), f"{axis} string, at_{axis} int")
        placed = placed.join(places, axis)
    columns = [f"at_{axis}" for axis in AXES if axis != long]
    width = len(names[1])
    flat = (F.col(columns[0]).cast("long") * width + F.col(columns[1])).alias("at")
    held = placed.select(long, flat, "n").groupBy(long).agg(F.collect_list(F.struct("at", "n")).alias("c"), F.sum("n").alias("sum"))
    given = cfg.targets.get(long)
    if given:
        shares = named.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{long} string, target double")
        held = held.join(shares, long, "left").fillna(0.0, ["target"])
    else:
        held = held.withColumn("target", F.col("sum") ** F.lit(cfg.temperature[long]))
    held = ws.table(held.select(F.col(long).alias("value"), "target", "sum", F.col("c.at").alias("at"), F.col("c.n").alias("n")), "values")
    total, wanted = held.agg(F.sum("sum"), F.sum("target")).first()
    aim = (lambda batch: batch.column("target").to_numpy() / wanted) if wanted > 0 else (lambda batch: batch.column("sum").to_numpy() / total)
    factor = np.ones((len(names[0]), width))

    def opened(batch: pa.RecordBatch, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each cell: its row, its place in factor, its tokens, and its fit over its tokens."""
        at, n = batch.column("at").flatten().to_numpy(), batch.column("n").flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("at").offsets.to_numpy()))
        scale = factor.ravel()[at]
        sums = np.bincount(row, n * scale, batch.num_rows)
        return row, at, n, scale * np.divide(aim(batch), sums, out=np.zeros_like(sums), where=sums > 0)[row]

    def summed(step: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
        """The sum of step(batch), an array of size numbers, over all batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(size)
            for batch in batches:
                own += step(batch)
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some])], names=["at", "x"])

        out = np.zeros(size)
        for at, x in held.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x")).collect():
            out[at] = x
        return out

    def margins(factor: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
        def step(batch: pa.RecordBatch) -> np.ndarray:
            _, at, n, per = opened(batch, factor)
            return np.bincount(at, n * per, factor.size)

        return step

    for _ in range(cfg.rounds):
        fit = summed(margins(factor), factor.size).reshape(factor.shape)
        worst = 0.0
        for axis in (0, 1):
            sums = fit.sum(1 - axis)
            worst = max(worst, float(np.abs(sums - targets[axis]).max(initial=0)))
            scale = np.divide(targets[axis], sums, out=np.ones_like(sums), where=sums > 0).reshape((-1, 1) if axis == 0 else (1, -1))
            fit, factor = fit * scale, factor * scale
        if worst < cfg.tolerance:
            break

    if summed(lambda batch: np.array([(opened(batch, factor)[3] * total * cfg.budget > 1).sum()], dtype=float), 1)[0]:
        chance_of = _bounded_table(held, total, wanted, targets, opened, summed, factor, cfg)
    else:
        chance_of = lambda batch, per: np.minimum(1, cfg.budget * total * per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = (np.array(x, dtype=object) for x in names)
        for batch in batches:
            row, at, _, per = opened(batch, factor)
            of = dict(zip((a for a in AXES if a != long), (pa.array(first[at // width], pa.string()), pa.array(second[at % width], pa.string())), strict=True))
            of[long] = batch.column("value").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*(of[axis] for axis in AXES), pa.array(per * total), pa.array(chance_of(batch, per))], names=CELLS.names)

    return ws.table(held.mapInArrow(run, CELLS), "weights")


def _bounded_table(held: DataFrame, total: float, whole: float, targets: list[np.ndarray], opened: Callable, summed: Callable, factor: np.ndarray, cfg: MixConfig) -> Callable:
    """bounded() over the table of rake_table: a row finds its own factor, a pass returns the sums over the two other axes."""
    margins = summed(lambda batch: np.bincount(opened(batch, factor)[1], batch.column("n").flatten().to_numpy(), factor.size), factor.size).reshape(factor.shape)
    sums = [margins.sum(1), margins.sum(0)]
    least = held.filter("target > 0").agg(F.min(F.col("sum") / F.col("target"))).first()[0]
    most = total if least is None else float(least) * whole
    tokens = max(min(tokens_to_draw(targets, sums, cfg), max(most, cfg.floor * total)), 0.0)
    wanted = [reachable(t, s, tokens) for t, s in zip(targets, sums, strict=True)]
    # The rise of all values' targets at which min(target, sum) over the longest axis holds the tokens.
    share = lambda batch: batch.column("target").to_numpy() / whole if whole > 0 else batch.column("sum").to_numpy() / total
    low, high = tokens * 0.5, tokens * 1e12
    for _ in range(5):
        tried = np.geomspace(low, high, 1024)
        got = summed(lambda batch, tried=tried: np.minimum(share(batch)[None, :] * tried[:, None], batch.column("sum").to_numpy()[None, :]).sum(1), 1024)
        k = int(np.searchsorted(np.maximum.accumulate(got), tokens * (1 - 1e-12)))
        low, high = tried[max(0, min(k, 1023) - 1)], tried[min(k, 1023)]
    rise = high

    def cells(batch: pa.RecordBatch, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, at, n, _ = opened(batch, factor)
        scale = scales.ravel()[at]
        want = np.minimum(share(batch) * rise, batch.column("sum").to_numpy())
        return at, n, np.minimum(1, filled(n, scale, row, want)[row] * scale)

    one, two = np.ones(len(wanted[0])), np.ones(len(wanted[1]))
    for _ in range(cfg.rounds):
        scales = np.outer(one, two)
        got = summed(lambda batch, scales=scales: np.bincount((c := cells(batch, scales))[0], c[1] * c[2], scales.size), scales.size).reshape(scales.shape)
        worst = max(float(np.abs(got.sum(1 - k) - wanted[k]).max(initial=0)) for k in (0, 1)) / max(tokens, 1e-300)
        if worst < max(cfg.tolerance, 1e-7):
            break
        one = np.clip(one * np.divide(wanted[0], got.sum(1), out=np.ones_like(one), where=got.sum(1) > 0), 1e-15, 1e15)
        two = np.clip(two * np.divide(wanted[1], got.sum(0), out=np.ones_like(two), where=got.sum(0) > 0) ** 0.5, 1e-15, 1e15)
    scales = np.outer(one, two)
    return lambda batch, per: cells(batch, scales)[2]


def _keyed(rows: DataFrame, cfg: MixConfig) -> DataFrame:
    return rows.select("*", *(_name(axis, cfg).alias(f"{axis}_cell") for axis in AXES))


def mix(documents: DataFrame, cfg: MixConfig | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and selected for every row of documents.

    Needed columns: doc_id, text, source, lang; others are ignored. A null source, language or topic falls under REST.
    Null and empty texts have no tokens: they are never selected for their weight's sake, having none, but drawn with the
    probability of their cell. The draw depends on doc_id and seed alone, so equal rows are drawn together, and rows
    without a doc_id draw one number. An empty table gives no rows.
    """
    cfg = cfg or MixConfig()
    spark = documents.sparkSession
    ws = Workspace(spark, "mixing")
    seen = ws.table(_seen(documents, train_topics(documents, cfg), cfg), "rows")
    planned = plan(_cells(seen), cfg)
    # On the driver the cells have a proven bound, see MixConfig.
    table = F.broadcast(cell_table(spark, *planned)) if planned else rake_table(_cells(seen), cfg, ws)
    keyed = _keyed(seen, cfg)
    out = keyed.join(table, [f"{axis}_cell" for axis in AXES], "left").fillna(0.0, ["weight", "probability"])
    return out.select("doc_id", *AXES, "n_tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("selected"))


def shares(mixed: DataFrame, cfg: MixConfig | None = None) -> DataFrame:
    """Of rows of mix(), for each value of each axis: its tokens, its share of the tokens that the draw is expected to hold,
    and its share by the raked weights, which meet the targets."""
    long = mixed.select(F.explode(F.array(*(F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("value")) for axis in AXES))).alias("x"), "n_tokens", (F.col("n_tokens") * F.col("probability")).alias("e"), (F.col("n_tokens") * F.col("weight")).alias("w"))
    sums = long.groupBy("x.axis", "x.value").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("e").alias("e"), F.sum("w").alias("w"))
    whole = sums.groupBy("axis").agg(F.sum("e").alias("all_e"), F.sum("w").alias("all_w"))
    return sums.join(whole, "axis").select("axis", "value", "n_tokens", (F.col("e") / F.nullif("all_e", F.lit(0.0))).alias("drawn_share"), (F.col("w") / F.nullif("all_w", F.lit(0.0))).alias("raked_share"))


def _cells(seen: DataFrame) -> DataFrame:
    return seen.groupBy(*AXES).agg(F.sum("n_tokens").alias("n_tokens"))


def sample(documents: DataFrame, cfg: MixConfig | None = None) -> DataFrame:
    """The rows of documents that mix() selects, with all their columns.

    Three passes over the texts (topics are trained on words that the first one writes): cells are summed, then each row is kept or not where it lies. Only where the cells are
    too many for the driver do the rows move, to meet them.
    """
    cfg = cfg or MixConfig()
    ws = Workspace(documents.sparkSession, "mixing")
    model = train_topics(documents, cfg)
    cells = ws.table(_cells(_seen(documents, model, cfg)), "sums")
    planned = plan(cells, cfg)
    if not planned:
        return _sample_by_table(documents, rake_table(cells, cfg, ws), model, cfg)
    values, _, chance = planned
    place = [{v: k for k, v in enumerate(values[axis])} for axis in AXES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda axis, found: np.array([place[axis].get(v, len(place[axis])) for v in found], dtype=np.int64)
        for batch in batches:
            topics = _topics(batch, model, cfg)
            cell = (*(at(k, batch.column(axis).cast(pa.string()).to_pylist()) for k, axis in enumerate(AXES[:2])), at(2, topics))
            yield batch.filter(pa.array(draws(batch.column("doc_id").cast(pa.int64()), cfg.seed) < chance[cell]))

    return documents.mapInArrow(run, documents.schema)


def _topics(batch: pa.RecordBatch, model: Topics | None, cfg: MixConfig) -> list[str | None]:
    if cfg.topic:
        return batch.column(cfg.topic).cast(pa.string()).to_pylist()
    return [t for _, texts in chunks(batch.column("text").cast(pa.string())) for t in topics_of(texts, model, cfg)[0]]


def _sample_by_table(documents: DataFrame, table: DataFrame, model: Topics | None, cfg: MixConfig) -> DataFrame:
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(axis).cast(pa.string()) for axis in AXES[:2]]
            more = [*own, pa.array(_topics(batch, model, cfg), pa.string()), pa.array(draws(batch.column("doc_id").cast(pa.int64()), cfg.seed))]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, names=columns), *more], names=["own", *AXES, "draw"])

    kinds = {"source": "string", "lang": "string", "topic": "string", "draw": "double"}
    schema = T.StructType([T.StructField("own", documents.schema)] + [T.StructField(k, T.StringType() if v == "string" else T.DoubleType()) for k, v in kinds.items()])
    keyed = _keyed(documents.mapInArrow(run, schema), cfg)
    return keyed.join(table, [f"{axis}_cell" for axis in AXES]).filter("draw < probability").select("own.*")
