"""Names of places in texts, and queries rewritten with the places that they mention."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlquarry.functions.lineage import written
from marlquarry.functions.scalars import flags, norm_space

#: Most names that one automaton holds and that go along with the tasks; more are dealt to several, which texts then visit in turn.
MOST = 100_000
#: Texts, about, that meet a shard of names in one task.
TEXTS = 10_000
WORDS = "0123456789abcdefghijklmnopqrstuvwxyz"

#: What stands before each part of a rewritten query, and the words of intent of each query type that is rewritten.
CONTEXT, PLACES, RELATED, INTENT = "이전 맥락: ", "장소 단서: ", "관련 장소: ", "검색 의도: "
INTENT_TERMS = {
    "place_fact": ("한양", "조선", "역사", "장소"),
    "place_story": ("한양", "조선", "역사 이야기", "관광 설명"),
    "route_context": ("한양", "서울", "동선", "연결"),
    "voice_followup": ("한양", "조선", "이전 맥락", "장소"),
}


@dataclass(frozen=True)
class RewriteConfig:
    max_aliases: int = 4
    max_related: int = 3
    max_context: int = 240


def lookup_text(text: Column) -> Column:
    """Lower case, white space collapsed: how names and texts are compared."""
    return norm_space(F.lower(F.coalesce(text, F.lit(""))))


def _automaton(names: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, (name, any(c in WORDS for c in name)))
    if names:
        found.make_automaton()
    return found


def _names_in(text: str, automaton: ahocorasick.Automaton) -> list[str]:
    """The names that stand in a text, in order of their first end. One with ASCII letters or digits must stand between other characters."""
    if not len(automaton):
        return []
    found: dict[str, None] = {}
    for end, (name, bounded) in automaton.iter(text):
        if name in found:
            continue
        if bounded:
            start = end - len(name)
            if (start >= 0 and text[start] in WORDS) or (end + 1 < len(text) and text[end + 1] in WORDS):
                continue
        found[name] = None
    return list(found)


def mentions(texts: DataFrame, names: DataFrame, key: str = "query_id", most: int = MOST) -> DataFrame:
    """key, name: a row for each of names (name) that stands in a text (key, text), both in lookup_text() form.

    Each text is read once by an automaton of all names. Up to `most` names, counted first, go along with the tasks. More are dealt
    into shards of that size, and texts to as many tasks as there are shards; nothing passes the driver then. Null and
    empty texts and names meet nothing.
    """
    known = names.select("name").filter("name <> ''").distinct()
    n = known.limit(most + 1).count()
    schema = pa.schema([pa.field("name", pa.string())])

    def table(keys: pa.Array, found: list[list[str]]) -> tuple[pa.Array, pa.Array]:
        at = pa.array([i for i, names in enumerate(found) for _ in names], pa.int64())
        return keys.take(at), pa.array([name for names in found for name in names], schema.field(0).type)

    kind = f"{key} {texts.schema[key].dataType.simpleString()}, name string"
    rows = texts.select(key, "text").filter("text <> ''")
    if n <= most:
        listed = [r["name"] for r in known.collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(listed)
            for batch in batches:
                arrays = table(batch.column(0), [_names_in(t.as_py(), automaton) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([*arrays], names=[key, "name"])

        return rows.mapInArrow(run, kind)
    shards = -(-known.count() // most)
    blocks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TEXTS))

    def meet(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        automaton = _automaton(right["name"].to_pylist())
        arrays = table(left[key].combine_chunks(), [_names_in(t.as_py(), automaton) for t in left["text"]])
        return pa.Table.from_arrays([*arrays], names=[key, "name"])

    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.withColumn("block", F.pmod(F.xxhash64(key, "text"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    right = known.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(meet, kind)


def name_index(places: DataFrame) -> DataFrame:
    """name, place_id, at: all names of places in lookup form; `at` is where an index in catalog order first has the name, then the place."""
    terms = places.select("place_id", "ord", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k", "term"))
    own = terms.select(lookup_text(F.col("term")).alias("name"), "place_id", F.struct("ord", "k").alias("own")).filter("name <> ''")
    own = own.groupBy("name", "place_id").agg(F.min("own").alias("own"))
    first = F.min("own").over(Window.partitionBy("name"))
    return own.select("name", "place_id", F.struct(first.alias("first"), F.col("own.ord").alias("ord")).alias("at"))


def places_of(queries: DataFrame, places: DataFrame) -> DataFrame:
    """query_id, place_id, at: the known places that a query is given, in order, then those that its text or context mentions."""
    zero = F.lit(0).cast("long")
    at = lambda kind, a, b, c: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"))
    given = queries.select("query_id", F.posexplode("place_ids").alias("pos", "place_id")).join(places.select("place_id"), "place_id", "left_semi")
    index = name_index(places)
    texts = queries.select("query_id", lookup_text(F.concat_ws(" ", F.nullif("query_text", F.lit("")), F.nullif("user_context", F.lit("")))).alias("text"))
    met = mentions(texts, index.select("name")).join(index, "name")
    rows = given.select("query_id", "place_id", at(0, F.col("pos"), zero, zero).alias("at"))
    rows = rows.unionByName(met.select("query_id", "place_id", at(1, F.col("at.first.ord"), F.col("at.first.k"), F.col("at.ord")).alias("at")))
    return rows.groupBy("query_id", "place_id").agg(F.min("at").alias("at"))


def rewrite_queries(queries: DataFrame, places: DataFrame, cfg: RewriteConfig | None = None) -> DataFrame:
    """query_id, rewritten, changed, places, rules.

    queries: query_id, query_type, query_text, user_context, expected, place_ids (an array). places: place_id, ord (their order), name,
    aliases, related (arrays). Queries that expect no answer, and types without words of intent, pass as they are. Else the text is followed
    by the context, names of the places met, names of the first places related to them (for routes only) and words of intent; a
    part that repeats one before it, whatever its case, is left out.
    """
    cfg = cfg or RewriteConfig()
    # Five steps look at the queries, whose types may be dear to find.
    queries = written(queries.select("query_id", "query_type", "query_text", "user_context", "expected", "place_ids"), "rewrite-queries")
    guarded = (F.col("expected") == "abstain") | (F.col("query_type") == "no_answer")
    types = F.col("query_type").isin(*INTENT_TERMS)
    wanted = queries.filter(~F.coalesce(guarded, F.lit(False)) & types)
    none = F.array().cast("array<string>")
    names = F.slice(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", none))), 1, max(2, cfg.max_aliases))
    own = places.select("place_id", names.alias("names"), F.coalesce("related", none).alias("related"))
    # A query's places are few: those given with it and those that its text can hold.
    met = places_of(wanted, places).join(own, "place_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "place_id", "names", "related"))).alias("p"))
    met = met.join(queries.select("query_id", "query_type"), "query_id")
    ids = F.slice(F.array_distinct(F.flatten(F.transform("p", lambda x: x["related"]))), 1, cfg.max_related)
    near = met.filter("query_type = 'route_context'").select("query_id", F.posexplode(ids).alias("pos", "place_id")).join(places.select("place_id", "name"), "place_id")
    near = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("r"))
    rows = queries.join(met.drop("query_type"), "query_id", "left").join(near, "query_id", "left")
    text = F.regexp_replace(F.coalesce("query_text", F.lit("")), r"(?U)^\s+|\s+$", "")
    context = F.when(F.col("user_context") != "", F.concat(F.lit(CONTEXT), F.rtrim(F.substring(norm_space(F.col("user_context")), 1, cfg.max_context))))
    listed = F.array_join(F.array_distinct(F.flatten(F.transform("p", lambda x: x["names"]))), " ")
    related = F.array_join(F.transform("r", lambda x: x["name"]), " ")
    intent = F.lit(None).cast("string")
    for kind, terms in INTENT_TERMS.items():
        intent = F.when(F.col("query_type") == kind, F.lit(INTENT + " ".join(terms))).otherwise(intent)
    parts = F.array(text, context, F.when(listed != "", F.concat(F.lit(PLACES), listed)), F.when(F.size("r") > 0, F.concat(F.lit(RELATED), related)), intent)
    parts = F.filter(F.transform(parts, lambda x: norm_space(x)), lambda x: x != "")
    once = F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, 1, i), lambda y: F.lower(y) == F.lower(x)))
    rules = flags(
        place_alias_expansion=F.size("p") > 0,
        voice_context_expansion=(F.col("query_type") == "voice_followup") & context.isNotNull(),
        route_related_place_expansion=F.size("r") > 0,
        query_type_intent_terms=intent.isNotNull(),
    )
    stop = F.when(guarded, "no_answer_guard").when(~F.coalesce(types, F.lit(False)), "query_type_passthrough")
    made = F.when(stop.isNotNull(), text).otherwise(F.array_join(once, " "))
    return rows.select(
        "query_id",
        made.alias("rewritten"),
        (made != text).alias("changed"),
        F.coalesce(F.array_join(F.transform("p", lambda x: x["place_id"]), ","), F.lit("")).alias("places"),
        F.coalesce(stop, F.array_join(rules, ",")).alias("rules"),
    )
