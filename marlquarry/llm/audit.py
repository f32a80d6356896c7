"""Audit of how text filters interact, by Walsh-Hadamard sums.

A document's failures are a mask with a bit for each filter. For each part of the corpus and each label the audit sums, over
documents, the parity signs (-1) ** bits(mask & s) of all masks s. The transform is its own inverse up to their number, so the sums give the
number of documents of each mask exactly; what any order of the filters removes, and each filter's share over all orders, follow
from these few cells without another look at a document. Sums merge by addition: parts of a corpus can be audited apart.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlquarry.llm.workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: The filters' letters, in the order of their bits; E, equal texts, is found over the whole table.
FILTERS = "ABCDE"
SAME = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")
_ALL = f"sequence(0, {MASKS - 1})"


def _text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters that look at one text: few words, few different ones, many capitals, symbols."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals > 5 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: numbers of documents by what they fail, several rows of a part and mask.

    Texts are read once; what is shuffled is a digest, a mask and an id for each document. Equal texts share their mask but for the
    last bit, so they are counted by part and label before they meet, and only those of the least doc_id pass it: a group of copies of any
    size is a few rows by then.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1)))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), _text_mask(F.col("t"), F.col("w")).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q"), F.col("toxic").alias("x"))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = known.groupBy("doc_id").agg(flag("q").alias("good"), flag("x").alias("toxic"))
    rows = rows.join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    kinds = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("first"),
    )
    # Read twice below: without a table of its own each branch would read the texts.
    kinds = Workspace(documents.sparkSession, "audit").table(kinds, "kinds")
    least = kinds.groupBy("digest").agg(F.min("least").alias("very_least"))
    kinds = kinds.join(least, "digest")
    same = F.col("known") - F.when(F.col("least") == F.col("very_least"), F.col("first")).otherwise(0)
    kinds = kinds.withColumn("same", F.coalesce(same, F.lit(0)))
    split = F.array(
        F.struct(F.col("mask").bitwiseOR(SAME).alias("mask"), F.col("same").alias("n")),
        F.struct(F.col("mask"), (F.col("n") - F.col("same")).alias("n")),
    )
    return kinds.select("part", "good", "toxic", F.inline(split)).filter("n > 0")


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, label, sums: for each mask s the sum over documents of (-1) ** bits(mask & s), of all, good and toxic ones."""
    weight = {"all": F.col("n"), **{c: F.when(F.col(c), F.col("n")).otherwise(0) for c in LABELS[1:]}}
    each = rows.select("part", "mask", F.inline(F.array(*(F.struct(F.lit(k).alias("label"), w.alias("n")) for k, w in weight.items()))))
    signed = [F.sum(F.when(F.bit_count(F.col("mask").bitwiseAND(s)) % 2 == 0, F.col("n")).otherwise(-F.col("n"))) for s in range(MASKS)]
    return each.groupBy("part", "label").agg(*(c.alias(f"s{s}") for s, c in enumerate(signed))).select("part", "label", F.array(*(f"s{s}" for s in range(MASKS))).alias("sums"))


def mask_cells(sums: DataFrame) -> DataFrame:
    """part, label, cells: the number of documents of each mask, by the inverse transform; the division leaves no rest."""
    total = "aggregate(sums, struct(0L as v, 0 as s), (a, x) -> struct(a.v + if(bit_count(m & a.s) % 2 = 0, x, -x) as v, a.s + 1 as s), a -> a.v)"
    return sums.select("part", "label", F.expr(f"transform({_ALL}, m -> {total} div {MASKS})").alias("cells"))


def evaluate(cells: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the cells alone.

    A part's `passed` numbers say for each set of filters how many documents pass all of it: what a step removes is the difference
    of two of them. A document that fails k filters is removed by each of them in 1/k of the orders.
    """
    passed = f"transform({_ALL}, b -> aggregate({_ALL}, 0L, (a, m) -> a + if(m & b = 0, cells[m], 0L)))"
    of = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c))).alias(f"{label}_{c}")
    parts = cells.withColumn("passed", F.expr(passed)).groupBy("part").agg(of("all", "cells"), *(of(label, "passed") for label in LABELS))
    orders = [*map("".join, permutations(FILTERS))]
    shares = f"transform(sequence(0, {len(FILTERS) - 1}), f -> aggregate({_ALL}, 0L, (a, m) -> a + if(m & shiftleft(1, f) = 0, 0L, all_cells[m] * {factorial(len(FILTERS))} div bit_count(m))))"
    parts = parts.withColumn("shares", F.expr(shares)).withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " ")))
    steps = parts.withColumn("step", F.explode(F.expr(f"sequence(1, {len(FILTERS)})"))).withColumn("f", F.expr(f"instr('{FILTERS}', substr(filter_order, step, 1)) - 1"))
    before = " + ".join(f"if(instr(substr(filter_order, 1, step - 1), '{letter}') > 0, {1 << k}, 0)" for k, letter in enumerate(FILTERS))
    steps = steps.withColumn("before", F.expr(before)).withColumn("bit", F.expr("shiftleft(1, f)"))
    lost = lambda label: f"{label}_passed[before] - {label}_passed[before | bit]"
    return steps.selectExpr(
        "part",
        "filter_order",
        "step",
        "all_passed[before | bit] as kept",
        f"{lost('all')} as removed",
        f"all_passed[0] - all_passed[bit] - ({lost('all')}) as redundant",
        "all_cells[bit] as unique_fails",
        f"{lost('good')} as good_lost",
        f"{lost('toxic')} as toxic_lost",
        "shares[f] as shapley",
    )


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    documents: doc_id, text, source; labels: doc_id, quality, toxic; further columns are ignored. One row, zeros included, for each
    source, each of the 120 orders of the filters and each step. Null texts are empty and null sources are the part '', as empty ones
    are. Repeated rows count each; of rows with one doc_id and one text none is a copy of the other. A row without a doc_id is a copy
    of nothing and has no label. Of several labels of a document one that says 1 is enough; labels of no document are ignored.
    Very long texts are split into words within their task. An empty table of documents gives no rows, one of labels zeros.
    """
    return evaluate(mask_cells(parity_sums(failures(documents, labels))))


def oracle() -> str:
    """filter_audit() in DuckDB SQL by applying each order to the documents' failures; views documents and labels."""
    letters = ", ".join(f"('{x}', {1 << k})" for k, x in enumerate(FILTERS))
    five = range(1, len(FILTERS) + 1)
    orders = " || ".join(f"p{k}.x" for k in five)
    distinct = " and ".join(f"p{j}.x <> p{k}.x" for k in five for j in range(1, k))
    return f"""
with l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
  min(doc_id) over (partition by coalesce(text, '')) as least from documents),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  case when len(w) < 50 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end
  + case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
  + case when least < w.doc_id then 16 else 0 end as mask from w left join l using (doc_id)),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
f as (select * from (values {letters}) as v(x, bit)),
o as (select {orders} as filter_order from {", ".join(f"f as p{k}" for k in five)} where {distinct}),
s as (select filter_order, step, bit, (select coalesce(sum(g.bit), 0) from f as g where position(g.x in substr(filter_order, 1, step - 1)) > 0) as before
  from o, (select unnest(range(1, {len(FILTERS) + 1})) as step) as k, f where x = substr(filter_order, step, 1)),
r as (select part, filter_order, step, bit, sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
  sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end) as removed, sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end) as redundant,
  sum(case when mask = bit then n else 0 end) as unique_fails, sum(case when mask & bit > 0 and mask & before = 0 then good else 0 end) as good_lost,
  sum(case when mask & bit > 0 and mask & before = 0 then toxic else 0 end) as toxic_lost from s, c group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) as shapley from r
"""
