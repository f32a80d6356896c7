"""Quality rules with adaptive thresholds, on built-in functions only.

Each text's measures are compared with upper bounds that its language and source set themselves: quantiles of
mergeable histogram sketches in place of fixed cutoffs. A value's sketch bin is its leading `digits` binary digits, so a bin is
within 2 ** (1 - digits) of its values; sketches are counts and merge by addition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlquarry.llm.workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: The characters that count as symbols, and those that separate words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class QualityConfig:
    """A measure fails above max(centre + spread * (upper - centre), floor), where centre and upper are its group's
    quantiles in percent. Floors, per mille, keep groups without any spread from rejecting on trifles."""

    digits: int = 6
    centre: int = 50
    upper: int = 90
    spread: int = 4
    symbols_floor: int = 100
    lines_floor: int = 300
    repeats_floor: int = 200
    length_floor: int = 12_000


MEASURES = ("symbols", "lines", "repeats", "length")


def _strip(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measures(documents: DataFrame) -> DataFrame:
    """Counts of every row: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t")
    )
    rows = rows.select(
        "*",
        F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1)).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.length(_strip(x, BLANKS)) > 0).alias("l"),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(_strip(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_strip(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") > 3, F.expr("transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))")
        ).otherwise(F.expr("array()").cast("array<long>")).alias("h"),
    )
    # Only texts with a repeated window are sorted: windows by hash and place, then the places of those with an equal neighbour.
    repeated = "size(array_distinct(h)) < size(h)"
    rows = rows.withColumn("s", F.when(F.expr(repeated), F.expr("array_sort(transform(h, (x, i) -> struct(x as x, i as i)))")))
    places = """array_sort(transform(filter(s, (e, k) -> (k > 0 and s[k - 1].x = e.x) or (k + 1 < size(s) and s[k + 1].x = e.x)), e -> e.i))"""
    rows = rows.withColumn("p", F.expr(places))
    # Each place covers three words; of an overlap with the next place only the new words count.
    covered = "aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(3, coalesce(b - a, 3))), 0, (n, x) -> n + x)"
    return rows.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("h", "s", "p")


def rates(counts: DataFrame) -> DataFrame:
    """The compared measures, per mille as whole numbers: symbols and repeated words per word, duplicate lines per line,
    and code points per word."""
    per = lambda a, b: F.coalesce(F.expr(f"1000 * {a} div nullif({b}, 0)"), F.lit(0)).cast("long")
    return counts.select(
        "*",
        per("n_symbols", "n_words").alias("symbols"),
        per("n_dup_lines", "n_lines").alias("lines"),
        per("n_repeat_words", "n_words").alias("repeats"),
        per("word_chars", "n_words").alias("length"),
    )


def sketches(rows: DataFrame, cfg: QualityConfig) -> DataFrame:
    """Counts by language, source, measure and bin; a bin is the value without all but its leading binary digits."""
    long = rows.selectExpr("lang", "source", "stack(4, 'symbols', symbols, 'lines', lines, 'repeats', repeats, 'length', length) as (measure, value)")
    cut = f"greatest(length(bin(value)) - {cfg.digits}, 0)"
    return long.withColumn("bin", F.expr(f"shiftleft(shiftright(value, {cut}), {cut})")).groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def merge(*parts: DataFrame) -> DataFrame:
    """One sketch of what several have counted."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, cfg: QualityConfig) -> DataFrame:
    """lang, source and an upper bound for each measure. A group's sketch has a bounded number of bins."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang", "source", "measure")
    run = sketch.select("*", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bin")))
    quantiles = run.groupBy("lang", "source", "measure").agg(at(cfg.centre).alias("centre"), at(cfg.upper).alias("upper"))
    bound = F.col("centre") + cfg.spread * (F.col("upper") - F.col("centre"))
    floors = {m: getattr(cfg, f"{m}_floor") for m in MEASURES}
    of = lambda m: F.max(F.when(F.col("measure") == m, F.greatest(bound, F.lit(floors[m]))))
    return quantiles.groupBy("lang", "source").agg(*(of(m).alias(f"max_{m}") for m in MEASURES))


def judge(documents: DataFrame, cfg: QualityConfig | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of documents.

    Columns doc_id, text, lang and source are read, others ignored. A null text has no words and fails the base rule.
    Null languages and sources are groups of their own. Repeated rows are judged each and count each in the sketches. An
    empty table gives no rows. kept is false where base_failed, else true if no measure is above its group's bound.
    """
    cfg = cfg or QualityConfig()
    rows = Workspace(documents.sparkSession, "quality").table(rates(measures(documents)), "rows")
    bounds = thresholds(sketches(rows, cfg), cfg).select(F.col("lang").alias("l"), F.col("source").alias("s"), *(f"max_{m}" for m in MEASURES))
    rows = rows.join(bounds, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    within = F.expr(" and ".join(f"{m} <= max_{m}" for m in MEASURES))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & within).alias("kept")
    )


def oracle(cfg: QualityConfig | None = None) -> str:
    """judge() in DuckDB SQL over the view documents."""
    cfg = cfg or QualityConfig()
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    per = lambda a, b: f"coalesce((1000 * {a}) // nullif({b}, 0), 0)"
    union = " union all ".join(f"select lang, source, '{m}' as measure, {m} as value from r" for m in MEASURES)
    cut = f"greatest(length(bin(value)) - {cfg.digits}, 0)"
    bounds = ", ".join(
        f"max(case when measure = '{m}' then greatest(centre + {cfg.spread} * (upper - centre), {getattr(cfg, f'{m}_floor')}) end) as max_{m}" for m in MEASURES
    )
    return f"""
with d as (select doc_id, lang, source, coalesce(text, '') as t, row_number() over () as rid from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w,
  list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {blanks}, '')) > 0) as l from d),
g as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select rid, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)),
p as (select distinct rid, i + o as i from (select rid, i from (select rid, i, count(*) over (partition by rid, s) as c from g) where c > 1), (values (0), (1), (2)) as v(o)),
q as (select rid, count(*) as n_repeat_words from p group by rid),
c as (select w.doc_id, w.lang, w.source, cast(len(w) as bigint) as n_words, cast(length(translate(t, {blanks}, '')) as bigint) as word_chars,
  cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines,
  cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join q using (rid)),
r as (select *, {per("n_symbols", "n_words")} as symbols, {per("n_dup_lines", "n_lines")} as lines, {per("n_repeat_words", "n_words")} as repeats,
  {per("word_chars", "n_words")} as length from c),
k as (select lang, source, measure, (value >> {cut}) << {cut} as bin, count(*) as n from ({union}) group by all),
u as (select *, sum(n) over (partition by lang, source, measure order by bin) as upto, sum(n) over (partition by lang, source, measure) as total from k),
z as (select lang, source, measure, min(case when 100 * upto >= {cfg.centre} * total then bin end) as centre,
  min(case when 100 * upto >= {cfg.upper} * total then bin end) as upper from u group by all),
b as (select lang, source, {bounds} from z group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  (not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and {" and ".join(f"{m} <= max_{m}" for m in MEASURES)}) as kept
from r join b on r.lang is not distinct from b.lang and r.source is not distinct from b.source
"""
