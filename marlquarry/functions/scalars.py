"""Column helpers that all operators share. Variants of one formula are named, never unified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The token patterns of lexical and of graph scoring.
TOKEN = "[0-9A-Za-z가-힣]+"
GRAPH_TOKEN = "[A-Za-z0-9가-힣]{2,}"


def tokens(text: Column | str) -> Column:
    """Lexical tokens, lower-cased after they are cut out; null text has none."""
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
    return F.transform(found, lambda x: F.lower(x))


def graph_tokens(text: Column | str, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct tokens of two characters or more that are not all digits and no stopwords, sorted."""
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(f"({GRAPH_TOKEN})"), F.lit(1))
    lowered = F.transform(found, lambda x: F.lower(x))
    kept = F.filter(lowered, lambda x: ~x.rlike("^[0-9]+$") & ~x.isin(*stopwords)) if stopwords else F.filter(lowered, lambda x: ~x.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(kept))


def norm_space(text: Column) -> Column:
    """Unicode white space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slug(text: Column) -> Column:
    """Lower case, runs of other than letters and digits as '-', empty as 'unknown'."""
    made = F.regexp_replace(F.lower(F.trim(text)), "[^0-9a-z가-힣]+", "-")
    made = F.regexp_replace(made, "^-+|-+$", "")
    return F.when(F.coalesce(made, F.lit("")) == "", "unknown").otherwise(made)


def half_even(x: Column, digits: int = 6) -> Column:
    """Rounding with ties to even; keep the unrounded column for ordering."""
    return F.bround(x, digits)


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole, or empty where whole is 0: 0.0, 1.0 or null by operator."""
    made = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return made if empty is None else F.coalesce(made, F.lit(empty))


def pct_nearest(x: Column | str, p: float) -> Column:
    """Aggregate: the value at place round((n - 1) * p), ties to even, of the sorted values (percentile A)."""
    values = F.array_sort(F.collect_list(x))
    at = F.bround((F.size(values) - 1) * F.lit(float(p))).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(values, at))


def nearest_percentiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float], parts: int = 64) -> DataFrame:
    """by and a column for each of at: the value at place round((n - 1) * p), ties to even, of each group's values (percentile A).

    Values are counted before they meet. Their ranges, by the quantiles of a bounded sample, add up to the places where each begins;
    running sums within the ranges that hold a wanted place find the value. So no group's values are listed in one row, and no
    task orders a whole group. Null values are left out; a group of nulls only has no row.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    sample = sorted(r[0] for r in rows.select(value).filter(F.col(value).isNotNull()).orderBy(F.xxhash64(value, F.monotonically_increasing_id())).limit(16 * parts).collect())
    bounds = sorted({sample[i] for i in range(16, len(sample), 16)})
    part = F.lit(0)
    for bound in bounds:
        part = part + (F.col("_v") >= F.lit(bound)).cast("int")
    dealt = counts.withColumn("_part", part)
    group = Window.partitionBy(*by)
    # At most `parts` rows a group.
    ranges = dealt.groupBy(*by, "_part").agg(F.sum("_c").alias("_n"))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*by, "_part", "_n", before.alias("_before"), F.sum("_n").over(group).alias("_all"))
    wanted = F.array(*(F.struct(F.lit(name).alias("_name"), F.bround((F.col("_all") - 1) * F.lit(float(p))).cast("long").alias("_place")) for name, p in at.items()))
    asked = ranges.select("*", F.inline(wanted)).filter("_place >= _before and _place < _before + _n")
    asked = asked.select(*(F.col(c).alias(f"_asked_{c}") for c in (*by, "_part")), "_before", "_name", "_place")
    rest = dealt.join(asked, [F.col(c).eqNullSafe(F.col(f"_asked_{c}")) for c in (*by, "_part")])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_part", "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = rest.withColumn("_upto", upto).filter("_place < _upto").groupBy(*by, "_name").agg(F.min("_v").alias("_v"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in at))


def pct_linear(x: Column | str, p: float) -> Column:
    """Aggregate: interpolated percentile (percentile B)."""
    return F.percentile(x, F.lit(float(p)))


def dcg_gain(grade: Column, rank: Column) -> Column:
    """(2^grade - 1) / log2(rank + 1) for positive grades, else 0."""
    return F.when(grade > 0, (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)).otherwise(0.0)


def flags(**when: Column) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in when.items())))


def row_fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """Hash of a row's named columns as JSON; nulls are written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def set_fingerprint(df: DataFrame, columns: list[str], length: int = 16) -> DataFrame:
    """One row: a hash of all rows that their order doesn't change. Sums of row hashes, so nothing is collected."""
    h = row_fingerprint(df, columns)
    part = lambda k: F.sum(F.conv(F.substring(h, k, 12), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(F.count("*").alias("n"), part(1).alias("a"), part(13).alias("b"))
    return sums.select(F.substring(F.sha2(F.concat_ws(":", "n", "a", "b"), 256), 1, length).alias("fingerprint"))


def sums_before(rows: DataFrame, key: str, value: str, name: str, parts: int = 64) -> DataFrame:
    """rows with the sum of value over all rows of lesser keys; keys are unique.

    Keys are dealt to ranges by the quantiles of a bounded sample; a range sums within itself, and the sums of the few ranges
    before it are added, so no task orders all rows.
    """
    sample = sorted(r[0] for r in rows.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(16 * parts).collect())
    bounds = [sample[i] for i in range(16, len(sample), 16)]
    part = F.lit(0)
    for bound in bounds:
        part = part + F.coalesce((F.col(key) >= F.lit(bound)).cast("int"), F.lit(0))
    dealt = rows.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most `parts` rows.
    starts = dealt.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_start") + F.col("_own")).alias(name))
