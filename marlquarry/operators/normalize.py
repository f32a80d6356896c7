"""Parsed elements to blocks, leak predicates and quality counters."""

from __future__ import annotations

import html
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlquarry.functions.scalars import flags, norm_space, pct_nearest, slug, sums_before

ELEMENT = "struct<id string, category string, content struct<text string, markdown string, html string>>"
PARSED = f"struct<page_elements map<string, struct<text_elements array<{ELEMENT}>, table_elements array<{ELEMENT}>>>>"
#: Paths of drives and shares (slashes turned first), of POSIX systems, secret markers and the longest public value.
PRIVATE_PATH = r"([A-Za-z]:[\\/]|\\\\[^\\/]+[\\/][^\\/]+)"
POSIX_PATH = r"(?iU)(^|\s)/(home|users|mnt|var|tmp|private|runner|workspace|root)/"
SECRET_MARKERS = ("sk-", "api_key=", "apikey=", "ghp_", "github_pat_", "hf_", "xoxb-", "bearer ", "password=", "token=", "secret=")
LONGEST = 600
#: What a line of a file must not hold. A credential counts if more than quotes follows it.
LINE_LEAKS = (r"[A-Za-z]:\\", r"sk-[A-Za-z0-9]", r"""(?i)(api[_-]?key|apikey|password|token|secret)\s*[:=]\s*(["']+\s+\S|["']*[^\s"'])""")


def strip_tags(text: Column) -> Column:
    """Tags become spaces and the five basic entities their characters; the text of scripts and styles stays."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


@F.pandas_udf(T.StringType())
def unescape_all(text: pd.Series) -> pd.Series:
    """All named and numeric entities, for input that has more than the basic ones."""
    return text.map(html.unescape, na_action="ignore")


def element_text(*candidates: Column) -> Column:
    """The first candidate that is not empty when stripped."""
    return F.coalesce(*(F.nullif(norm_space(strip_tags(c)), F.lit("")) for c in candidates))


def page_number(key: Column) -> Column:
    """A page key as a number, else the first number in it, else 0."""
    return F.coalesce(key.try_cast("int"), F.nullif(F.regexp_extract(key, "[0-9]+", 0), F.lit("")).cast("int"), F.lit(0))


def element_type(category: Column, group: Column) -> Column:
    own = F.nullif(F.lower(F.trim(category)), F.lit(""))
    return F.coalesce(own, F.when(group == "table", "table").otherwise("text"))


def block_id(doc: Column, page: Column, kind: Column, element: Column) -> Column:
    return F.format_string("block-%s-%06d-%s-%s", slug(doc), page, slug(kind), slug(element))


def parse_elements(raw: DataFrame) -> DataFrame:
    """raw (doc_id string, page_offset int, json string) to blocks, one per element with text, in page, group and element order."""
    page = raw.select("doc_id", "page_offset", F.explode(F.from_json("json", PARSED)["page_elements"]).alias("key", "page"))
    groups = None
    for group in ("text", "table"):
        own = page.select("doc_id", "page_offset", "key", F.lit(group).alias("group"), F.posexplode(f"page.{group}_elements").alias("element_index", "e"))
        groups = own if groups is None else groups.unionByName(own)
    local = page_number(F.col("key"))
    rows = groups.select(
        "doc_id",
        local.alias("page_local"),
        (F.col("page_offset") + local).alias("page_global"),
        "group",
        "element_index",
        element_type(F.col("e.category"), F.col("group")).alias("element_type"),
        element_text(F.col("e.content.text"), F.col("e.content.markdown"), F.col("e.content.html")).alias("text"),
        F.col("e.id").alias("element_id"),
        F.col("e.category").alias("category"),
    ).filter("text is not null")
    marks = flags(
        missing_element_id=F.col("element_id").isNull(),
        replacement_character=F.contains(F.col("text"), F.lit("�")),
        missing_category=F.coalesce("category", F.lit("")) == "",
    )
    element = F.coalesce("element_id", F.concat_ws("-", "group", F.col("element_index").cast("string")))
    return rows.select(
        block_id(F.col("doc_id"), F.col("page_global"), F.col("element_type"), element).alias("block_id"),
        "doc_id",
        "page_local",
        "page_global",
        "element_index",
        "element_type",
        "text",
        F.sha2("text", 256).alias("text_hash"),
        F.char_length("text").alias("text_length"),
        marks.alias("quality_flags"),
    )


def page_offsets(pages: DataFrame) -> DataFrame:
    """doc_id, page_offset: pages of all documents before it, in doc_id order. pages has one row per document: doc_id, page_count."""
    return sums_before(pages.select("doc_id", "page_count"), "doc_id", "page_count", "n").select("doc_id", F.col("n").cast("long").alias("page_offset"))


def html_elements(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of pages (page_id, html) in document order: page_id, ord, tag, text, text_length."""
    found = F.expr(r"regexp_extract_all(html, '(?s)<(h1|p|li)>(.*?)</\\1>', 0)")
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "e"))
    text = norm_space(strip_tags(F.col("e")))
    rows = rows.select("page_id", "ord", F.regexp_extract("e", "^<(h1|p|li)>", 1).alias("tag"), text.alias("text"))
    return rows.withColumn("text_length", F.char_length("text").cast("long"))


def text_lines(docs: DataFrame, *columns: str) -> DataFrame:
    """Lines of docs (doc_id, text) with a word: doc_id, columns, line (from 0), text."""
    rows = docs.select("doc_id", *columns, F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return rows.filter(F.trim("text") != "")


def line_blocks(docs: DataFrame, *columns: str) -> DataFrame:
    """Lines of docs (doc_id, text) as blocks, with columns of their documents; one of fewer than 30 characters is a heading, one with '|' a table."""
    text = norm_space(F.col("text"))
    kind = F.when(F.length("text") < 30, "heading1").when(F.contains(F.col("text"), F.lit("|")), "table").otherwise("paragraph")
    rows = text_lines(docs, *columns).withColumn("text", text)
    return rows.select(
        F.format_string("block-%d-%05d", "doc_id", "line").alias("block_id"), "doc_id", F.lit(1).alias("page_local"), F.lit(1).alias("page_global"), F.col("line").alias("element_index"),
        kind.alias("element_type"), "text", F.sha2("text", 256).alias("text_hash"), F.char_length("text").cast("long").alias("text_length"),
        F.when(F.contains(F.col("text"), F.lit("\ufffd")), F.array(F.lit("replacement_character"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"), *columns,
    )


def _once(value: Column, holds: Callable[[Column], Column]) -> Column:
    """holds(value), with value worked out once however often holds looks at it."""
    return F.exists(F.array(value), holds)


def has_private_path(value: Column) -> Column:
    """Any drive, share or home path. Slashes count as backslashes, so 'scheme://' counts as a drive: a known quirk."""
    slashed = F.contains(value, F.lit("/")) | F.contains(value, F.lit("\\"))
    return slashed & (F.translate(value, "/", "\\").rlike(PRIVATE_PATH) | value.rlike(POSIX_PATH))


def has_secret_marker(value: Column) -> Column:
    return _once(F.lower(value), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in SECRET_MARKERS)))


def is_source_like(value: Column, longest: int = LONGEST) -> Column:
    """Text of several lines, or longer than what may be public, without the white space at its ends."""
    long = lambda v: F.contains(v, F.lit("\n")) | F.contains(v, F.lit("\r")) | (F.char_length(v) > longest)
    return long(value) & _once(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), long)


def leak_flags(df: DataFrame, key: str, value: str) -> DataFrame:
    v = F.coalesce(F.col(value), F.lit(""))
    return df.select(key, has_private_path(v).alias("private_path"), has_secret_marker(v).alias("secret_like"), is_source_like(v).alias("source_like"))


def line_leaks(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and number, from 1, of each line of a text that holds a drive path, a key or a credential with a value. Null texts have no lines."""
    rows = df.select(key, F.posexplode(F.split(value, r"\r\n|\r|\n")).alias("place", "line"))
    found = reduce(lambda a, b: a | b, (F.col("line").rlike(p) for p in LINE_LEAKS))
    return rows.filter(found).select(key, (F.col("place") + 1).alias("line_number"))


def roots_in(df: DataFrame, value: str, roots: DataFrame) -> DataFrame:
    """Rows of df that hold one of roots (root), whatever the case and kind of slashes; roots are few."""
    text = F.lower(F.replace(F.col(value), F.lit("\\"), F.lit("/")))
    own = roots.select(F.lower(F.replace(F.col("root"), F.lit("\\"), F.lit("/"))).alias("root"))
    return df.withColumn("_t", text).join(own, F.expr("contains(_t, root)"), "left_semi").drop("_t")


#: What marks a line as code or a table, the least length of a line of prose and its least share of letters.
CODE_MARKERS = ("Path(", " = ", "    ", "{", "}", "```", "|", "report_", "result_", "metric", "contains_", "assert ", "from ", "import ")
PROSE_LEAST, PROSE_LETTERS = 40, 0.3


def prose_line(text: Column) -> Column:
    """Long enough without the white space, quotes and commas at its ends, without a mark of code, and of letters enough."""
    line = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), '^[",]+|[",]+$', "")

    def prose(x: Column) -> Column:
        code = reduce(lambda a, b: a | b, (F.contains(x, F.lit(m)) for m in CODE_MARKERS))
        letters = F.char_length(F.regexp_replace(x, r"[^\p{L}]+", ""))
        return (F.char_length(x) >= PROSE_LEAST) & ~code & (letters / F.greatest(F.char_length(x), F.lit(1)) >= PROSE_LETTERS)

    return (F.char_length(text) >= PROSE_LEAST) & _once(line, prose)


def consecutive_blocks(lines: DataFrame, least: int = 3) -> DataFrame:
    """doc_id and n_blocks: runs of at least `least` lines of prose that follow each other. lines: doc_id, line, text."""
    rows = lines.filter(prose_line(F.col("text")))
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    runs = rows.select("doc_id", island.alias("island")).groupBy("doc_id", "island").agg(F.count("*").alias("n"))
    return runs.filter(F.col("n") >= least).groupBy("doc_id").agg(F.count("*").alias("n_blocks"))


def block_quality(blocks: DataFrame) -> DataFrame:
    """Counters of blocks and the names of failed gates."""
    made = blocks.agg(
        F.count("*").alias("block_count"),
        (F.count("*") - F.countDistinct("block_id")).alias("duplicate_block_id_count"),
        F.count_if(F.col("page_global") < 0).alias("negative_page_global_count"),
        F.count_if(F.coalesce("text_hash", F.lit("")) == "").alias("missing_text_hash_count"),
        F.count_if(F.col("text_length") <= 0).alias("empty_text_count"),
    )
    failed = flags(**{c: F.col(c) > 0 for c in made.columns if c != "block_count"}, no_blocks=F.col("block_count") == 0)
    return made.withColumn("failures", F.array_join(failed, ","))


def parser_quality(blocks: DataFrame, expected: DataFrame) -> DataFrame:
    """By document: blocks, distinct pages, expected pages that are missing, length percentiles and repeated texts."""
    own = blocks.groupBy("doc_id").agg(
        F.count("*").alias("block_count"),
        F.countDistinct("page_global").alias("covered_pages"),
        F.min("text_length").alias("min_length"),
        pct_nearest("text_length", 0.5).alias("p50_length"),
        pct_nearest("text_length", 0.95).alias("p95_length"),
        F.max("text_length").alias("max_length"),
        (F.count("*") - F.countDistinct("text_hash")).alias("duplicate_hash_count"),
    )
    rows = expected.join(own, "doc_id", "left").fillna(0, ["block_count", "covered_pages", "duplicate_hash_count"])
    return rows.withColumn("missing_pages", F.greatest(F.col("expected_pages") - F.col("covered_pages"), F.lit(0)))


def stratified_first(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """The first n rows of each stratum by key."""
    w = Window.partitionBy(stratum).orderBy(key)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).drop("place")


def recover_text(blocks: DataFrame, source: DataFrame) -> DataFrame:
    """blocks with the text of source that agrees in doc_id, page_local, element_id and element_type; the last of several wins."""
    keys = ["doc_id", "page_local", "element_id", "element_type"]
    last = source.groupBy(*keys).agg(F.max_by("text", "ordinal").alias("source_text"))
    return blocks.join(last, keys, "left")


def public_sample(df: DataFrame, key: str, columns: list[str], n: int) -> DataFrame:
    """The first n rows by key with allowed columns only."""
    return df.orderBy(key).limit(n).select(*columns)
