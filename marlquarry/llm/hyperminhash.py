"""Near-duplicate groups by HyperMinHash.

Each document's set of word shingles is hashed once. A shingle's hash picks a bucket, and of the least
value in a bucket the sketch keeps its leading-zero count and a few bits of mantissa, 16 bits in all.
Empty buckets copy a filled one by a fixed random order, the same for all documents, so short texts
have full registers too. Bands of registers give candidates, the collision-corrected estimate drops
those far below the threshold, and the rest are decided on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlquarry.llm.components import connected_components
from marlquarry.llm.textvec import U64, Words, chunks, mix
from marlquarry.llm.workspace import Workspace, split_join


@dataclass(frozen=True)
class DedupConfig:
    """Similarity is percent / 100 at least. A pair at the threshold shares no band with probability
    (1 - t ** rows) ** bands: 7e-9 for 0.85 with 6 and 40, 1e-7 for 0.8 with 5 and 40."""

    shingle: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 40
    mantissa: int = 10
    #: Standard deviations by which an estimate may miss the threshold; registers count as far as the smaller set fills them.
    slack: float = 5.0

    @property
    def registers(self) -> int:
        return self.rows * self.bands


@lru_cache(8)
def _fill_order(m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each register the order in which it looks for a filled one, and the rank of each in that order."""
    rng = np.random.Generator(np.random.PCG64(7919 + m))
    order = np.argsort(rng.random((m, m)), axis=1).astype(np.int32)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(m, dtype=np.int32)[None, :].repeat(m, 0), 1)
    return order, rank


def registers(hashes: np.ndarray, cfg: DedupConfig) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit shingle hashes."""
    m = cfg.registers
    bucket = (hashes >> U64(44)).astype(np.int64) * m >> 20
    value = mix(hashes ^ U64(0x5851F42D4C957F2D))
    least = np.full(m, np.iinfo(np.uint64).max, dtype=U64)
    np.minimum.at(least, bucket, value)
    full = np.zeros(m, dtype=bool)
    full[bucket] = True
    top = np.frexp(np.maximum(least, U64(1)).astype(np.float64))[1]
    top -= (top > 0) & ((least >> np.maximum(top - 1, 0).astype(U64)) == 0)  # a float may have rounded up
    zeros = (64 - top).astype(np.uint16)
    shift = np.maximum(top - 1 - cfg.mantissa, 0).astype(U64)
    out = (zeros << np.uint16(cfg.mantissa)) | ((least >> shift) & U64((1 << cfg.mantissa) - 1)).astype(np.uint16)
    if not full.all():
        empty, have = np.flatnonzero(~full), np.flatnonzero(full)
        order, rank = _fill_order(m)
        pick = order[empty, :16]
        hit = full[pick]
        at = hit.argmax(1)
        source = pick[np.arange(len(empty)), at]
        late = ~hit.any(1)
        if late.any():
            source[late] = have[rank[np.ix_(empty[late], have)].argmin(1)]
        out[empty] = out[source]
    return out


@lru_cache(4096)
def _collision(a: int, b: int, m: int, mantissa: int) -> float:
    """Chance that registers of two disjoint sets of about 1.1 ** a and 1.1 ** b shingles agree."""
    per_a, per_b = max(1.0, 1.1**a / m), max(1.0, 1.1**b / m)
    parts = 1 << mantissa
    low = np.ldexp(parts + np.arange(parts), -mantissa)[None, :] * np.ldexp(1.0, -np.arange(1, 40))[:, None]
    high = low + np.ldexp(1.0, -mantissa - np.arange(1, 40))[:, None]
    chance = lambda n: np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(high, 1 - 1e-16)))
    return float((chance(per_a) * chance(per_b)).sum())


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, cfg: DedupConfig) -> np.ndarray:
    """Collision-corrected Jaccard estimates of paired sketches."""
    share = (a == b).mean(1)
    size = lambda n: np.round(np.log(np.maximum(n, 1)) / np.log(1.1)).astype(int).tolist()
    chance = np.array([_collision(*sorted(x), cfg.registers, cfg.mantissa) for x in zip(size(n_a), size(n_b), strict=True)])
    return (share - chance) / (1 - chance)


def _sketches(cfg: DedupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                sets = Words(texts).shingles(cfg.shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([registers(s, cfg).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "regs"],
                )

    return run


def _matrix(column: pa.Array, cfg: DedupConfig) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), cfg.registers)


def _band_keys(cfg: DedupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _matrix(batch.column("regs"), cfg).reshape(batch.num_rows, cfg.bands, cfg.rows).astype(U64)
            key = np.broadcast_to(mix(np.arange(1, cfg.bands + 1, dtype=U64))[None, :], regs.shape[:2])
            for j in range(cfg.rows):
                key = mix(key + regs[:, :, j])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.reshape(-1).view(np.int64)),
                    pa.array(np.repeat(batch.column("rep").to_numpy(), cfg.bands)),
                    pa.array(np.repeat(batch.column("n").to_numpy(), cfg.bands)),
                ],
                names=["key", "rep", "n"],
            )

    return run


def _near(cfg: DedupConfig):
    least = cfg.percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            got = estimate(_matrix(batch.column("regs_a"), cfg), _matrix(batch.column("regs_b"), cfg), n_a, n_b, cfg)
            filled = np.minimum(np.minimum(n_a, n_b), cfg.registers)
            keep = got >= least - cfg.slack * np.sqrt(least * (1 - least) / filled)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _verified(cfg: DedupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: list[np.ndarray] = []
            for at, texts in chunks(batch.column("text_a")):
                left = Words(texts).shingles(cfg.shingle)
                done = 0
                for sub, others in chunks(batch.column("text_b").slice(at, len(texts))):
                    for k, right in enumerate(Words(others).shingles(cfg.shingle)):
                        one = left[sub + k]
                        both = len(one) + len(right) - len(np.union1d(one, right))
                        hits.append(100 * both >= cfg.percent * (len(one) + len(right) - both))
                        done += 1
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(hits, pa.bool_()))

    return run


def _frame_counts(cfg: DedupConfig):
    """Compares the members of a family with the texts of its frame, which come before them.

    A member's links are the frame's texts that it is similar enough to, by the full sets. Linked members share at least
    need = percent / 100 of either's shingles. What they share within the frame is at most inside, so a member with
    inside < need shares need - inside shingles outside it with its partner, and by the prefix principle one of its
    first size - need + 1 outside shingles in hash order. Other members, and those of large families, give all of theirs.
    subs are the frame texts that lie about as near to a member as its nearest one does: the sets of two linked members
    differ in at most slack shingles, so they have one of these in common.
    """
    part = cfg.percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, frame, union = None, [], np.zeros(0, U64)
        for batch in batches:
            pivots, salts = batch.column("pivot").to_pylist(), batch.column("salt").to_pylist()
            reps, roots, refs, large = (batch.column(c).to_pylist() for c in ("rep", "root", "ref", "large"))
            rows: list[tuple] = []
            outside = [np.zeros(0, U64)]
            for at, texts in chunks(batch.column("text")):
                for k, own in enumerate(Words(texts).shingles(cfg.shingle), at):
                    if (pivots[k], salts[k]) != family:
                        family, frame, union = (pivots[k], salts[k]), [], None
                    if refs[k] is not None:  # sorted: the frame's texts come first
                        frame.append((refs[k], roots[k], own))
                        continue
                    if union is None:
                        union = np.unique(np.concatenate([np.zeros(0, U64), *(x for _, _, x in frame)]))
                    n, need = len(own), -(-cfg.percent * len(own) // 100)
                    slack = int((1 - part) / part * n)
                    shared = np.isin(own, union, assume_unique=True)
                    got, rest, near = int(shared.sum()), own[~shared], own[shared]
                    inside = [int(np.isin(near, x, assume_unique=True).sum()) for _, _, x in frame]
                    links = [(root, ref) for (ref, root, x), i in zip(frame, inside, strict=True) if 100 * i >= cfg.percent * (n + len(x) - i) and ref != reps[k]]
                    subs = [s for s, i in enumerate(inside) if i >= max(inside) - slack]
                    rows.append((pivots[k], reps[k], n, min([roots[k], *(r for r, _ in links)]), got, subs, [ref for _, ref in links]))
                    outside.append(rest if got >= need or large[k] else rest[: n - need + 1])
            columns = list(zip(*rows, strict=True)) or [()] * 7
            arrays = [pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 5, *[pa.list_(pa.int64())] * 2), strict=True)]
            ends = pa.array(np.cumsum([len(x) for x in outside]), pa.int32())
            arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(outside).view(np.int64))))
            yield pa.RecordBatch.from_arrays(arrays, names=["pivot", "rep", "n", "root", "inside", "subs", "links", "outside"])

    return run


#: Members that are compared with one copy of a frame; a larger family has several copies, each in a place of its own.
PLACE = 256
#: Members that may be paired through a shingle outside the frame; one that more of them hold counts as inside it.
CROWD = 256


def _seen(mixed: DataFrame, texts: DataFrame, cfg: DedupConfig, ws: Workspace) -> DataFrame:
    """Members of families (pivot, rep, n, root) after comparison with their frames, see _frame_counts."""
    picks = [F.min_by(F.struct("rep", "root"), F.xxhash64("rep", F.lit(i))).alias(f"r{i}") for i in range(5)]
    sums = mixed.groupBy("pivot").agg(F.count("*").alias("members"), *picks)
    places = F.expr(f"cast(members div {PLACE} + 1 as int)")
    copies = sums.select("pivot", F.array_distinct(F.array(*(f"r{i}" for i in range(5)))).alias("r"), F.explode(F.sequence(F.lit(0), places - 1)).alias("salt"))
    copies = copies.select("pivot", "salt", F.explode("r").alias("r")).select("pivot", "salt", F.col("r.rep").alias("doc_id"), F.col("r.root").alias("root"))
    none = F.lit(None).cast("long")
    frames = copies.join(texts, "doc_id").select("pivot", "salt", F.col("doc_id").alias("ref"), none.alias("rep"), "root", F.lit(False).alias("large"), "text")
    large = sums.filter(f"members > least({PLACE}, {CROWD})").select("pivot", places.alias("places"), (F.col("members") > CROWD).alias("large"))
    salt = F.pmod(F.xxhash64("rep"), F.coalesce("places", F.lit(1)).cast("long")).cast("int")
    placed = split_join(mixed, large, ["pivot"], "left").withColumn("salt", salt).withColumn("large", F.coalesce("large", F.lit(False)))
    rows = placed.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("pivot", "salt", none.alias("ref"), "rep", "root", "large", "text")
    rows = frames.unionByName(rows).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("ref").asc_nulls_last())
    schema = "pivot long, rep long, n long, root long, inside long, subs array<long>, links array<long>, outside array<long>"
    return ws.table(rows.mapInArrow(_frame_counts(cfg), schema), "outside")


def _without_crowds(seen: DataFrame, cfg: DedupConfig) -> DataFrame:
    """seen, where the outside shingles that more than CROWD members hold count as inside, and the others are cut to those needed."""
    each = seen.select("pivot", "rep", F.explode("outside").alias("shingle"))
    crowds = each.groupBy("pivot", "shingle").agg(F.count("*").alias("holders")).filter(f"holders > {CROWD}").select("pivot", "shingle")
    held = split_join(each, crowds, ["shingle", "pivot"]).groupBy("pivot", "rep").agg(F.collect_list("shingle").alias("held"))
    rows = seen.join(held, ["pivot", "rep"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<long>")))
    rows = rows.withColumn("inside", F.col("inside") + F.size("held")).withColumn("outside", F.array_except("outside", "held"))
    need = f"({cfg.percent} * n + 99) div 100"
    return rows.withColumn("outside", F.expr(f"if(inside >= {need}, outside, slice(outside, 1, cast(n - {need} + 1 as int)))")).select(seen.columns)


def _across(mixed: DataFrame, texts: DataFrame, cfg: DedupConfig, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) found on the way, and pairs (a, b) of different roots, out of one bucket, that may be linked.

    mixed: pivot, rep, n, root. Buckets of one pivot are a family. Its members are compared through their shingles outside a
    frame: the texts of a few members, and what more than CROWD of them hold. So what many of a family share, passages or the
    text that its copies derive from, makes no pairs. The frame may be any set: it decides the work, not the result. Pairs that
    share nothing outside it need min(inside) >= percent / (100 + percent) of their sizes together; those are found by
    (size, inside) first, among members that lie near the same text of the frame.
    """
    seen = _seen(mixed, texts, cfg, ws)
    links = seen.select(F.col("rep").alias("a"), F.explode("links").alias("b"))
    seen = _without_crowds(seen, cfg)
    rows = seen.select("pivot", "rep", "n", "root", "inside", F.size("outside").alias("rest"), F.explode("outside").alias("shingle"))
    # A shingle that one root alone has makes no pair.
    shared = rows.groupBy("pivot", "shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").drop("x", "y")
    rows = ws.table(rows.join(shared, ["pivot", "shingle"]), "shared")
    sizes = f"100 * least(n_a, n_b) >= {cfg.percent} * greatest(n_a, n_b)"
    twin = lambda rows, by, names, x: rows.select(*by, *(F.col(c).alias(f"{c}_{x}") for c in names))
    most = "least(inside_a, inside_b) + least(rest_a, rest_b)"
    side = lambda x: twin(rows, ["pivot", "shingle"], ("rep", "n", "root", "inside", "rest"), x)
    # rest is cut for members that lie far from the frame, so the bound on what they share holds for the others only.
    whole = f"100 * least(inside_a, inside_b) >= {cfg.percent} * greatest(n_a, n_b)"
    bound = f"100 * ({most}) >= {cfg.percent} * (n_a + n_b - ({most}))"
    far = side("a").join(side("b"), ["pivot", "shingle"]).filter(f"rep_a < rep_b and root_a <> root_b and {sizes} and (not ({whole}) or {bound})")

    near = seen.filter(f"100 * inside >= {cfg.percent} * n").select("pivot", F.explode("subs").alias("sub"), "rep", "n", "root", "inside")
    kinds = near.groupBy("pivot", "sub", "n", "inside").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    inner = f"100 * least(inside_a, inside_b) >= {cfg.percent} * (n_a + n_b - least(inside_a, inside_b))"
    kind = lambda x: twin(kinds, ["pivot", "sub"], ("n", "inside", "low", "high"), x)
    kinds = kind("a").join(kind("b"), ["pivot", "sub"]).filter(f"{sizes} and {inner} and (low_a <> high_b or high_a <> low_b)")
    kinds = kinds.select("pivot", "sub", "n_a", "inside_a", "n_b", "inside_b")
    pick = lambda x: twin(near, ["pivot", "sub"], ("rep", "n", "root", "inside"), x)
    close = kinds.join(pick("a"), ["pivot", "sub", "n_a", "inside_a"]).join(pick("b"), ["pivot", "sub", "n_b", "inside_b"])
    close = close.filter("rep_a < rep_b and root_a <> root_b")
    ends = lambda pairs: pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    return links, ends(far).unionByName(ends(close)).distinct()


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, cfg: DedupConfig, ws: Workspace, label: str) -> DataFrame:
    """Of candidate pairs (a, b) of representatives, those that the estimates leave and the full sets confirm."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {cfg.percent} * greatest(n_a, n_b)")
    near = ws.table(near.mapInArrow(_near(cfg), "a long, b long"), f"{label}-near")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    full = near.join(side("a"), "a").join(side("b"), "b")
    links = ws.table(full.mapInArrow(_verified(cfg), "a long, b long"), f"{label}-links")
    ws.drop(f"{label}-near")
    return links


def near_duplicates(documents: DataFrame, cfg: DedupConfig | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of documents (doc_id, text; more columns are ignored).

    Two documents are linked if their shingle sets have at least percent / 100 Jaccard similarity; component_id is
    the least doc_id that links reach. Null, empty and blank texts have no shingles and are linked with nothing.
    Rows that repeat a doc_id are one document and should repeat its text; else any one of its texts decides its links. A null
    doc_id is returned with a null component_id, kept, and linked with nothing. An empty table gives no rows.

    Equal sets are joined by their digest first, so a group of copies counts once. In a band's bucket every
    representative is compared with the least one only (a star, linear in the bucket's size). Members of a bucket that
    then lie in different components are compared if they share shingles that a frame of members lacks, or lie so near to
    that frame that they need not (see _across). Both tests are exact, so no link between components is missed.
    """
    cfg = cfg or DedupConfig()
    spark = documents.sparkSession
    ws = Workspace(spark, "near-duplicates")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = ws.table(docs.mapInArrow(_sketches(cfg), "doc_id long, n_shingles long, digest binary, regs binary"), "sketch")
    ws.expect(sketch.count())
    classes = sketch.filter("digest is not null and doc_id is not null").groupBy("digest")
    reps = ws.table(classes.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "reps")

    bands = reps.mapInArrow(_band_keys(cfg), "key long, rep long, n long")
    stars = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot < last").drop("last")
    members = ws.table(split_join(bands, stars, ["key"]), "members")
    first = members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    ids = members.select(F.explode(F.array("rep", "pivot")).alias("doc_id")).distinct()
    texts = ws.table(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    links = _links(first, reps, texts, cfg, ws, "star")
    roots = connected_components(links, ws, "cc-1")

    rooted = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    mixed = ws.table(split_join(rooted, mixed, ["key"], "left_semi").select("pivot", "rep", "n", "root").distinct(), "mixed")
    framed, across = _across(mixed, texts, cfg, ws)
    more = _links(across.join(first, ["a", "b"], "left_anti"), reps, texts, cfg, ws, "across")
    roots = connected_components(links.unionByName(framed).unionByName(more), ws, "cc-2")

    rep_root = reps.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = rep_root.select("digest", F.coalesce("root", "rep").alias("component_id"))
    found = sketch.select("doc_id", "n_shingles", "digest")
    # Rows without shingles have no class to meet, and would all meet in one place.
    empty = found.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = found.filter("digest is not null").join(classes, "digest", "left").select("doc_id", "n_shingles", "component_id").unionByName(empty)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(documents: DataFrame, cfg: DedupConfig | None = None) -> DataFrame:
    """One row for each group of near-duplicates, that of the least doc_id, with all columns of documents.

    Rows that repeat a doc_id count once. Rows without a doc_id all stay.
    """
    gone = near_duplicates(documents, cfg).filter("not kept").select("doc_id").distinct()
    known = documents.filter("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return known.select(documents.columns).unionByName(documents.filter("doc_id is null"))
