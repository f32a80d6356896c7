"""Readers and writers: folders of files, parser output, JSON lines, Markdown tables, vector caches."""

from __future__ import annotations

import json
from fnmatch import fnmatch
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlquarry.functions.scalars import flags, set_fingerprint
from marlquarry.operators.normalize import has_private_path, has_secret_marker

#: Schemas of the evaluation files and of the catalog, as DDL.
EVAL_ITEM = (
    "dataset_version string, query struct<query_id: string, query_type: string, query_text: string, language: string, expected_behavior: string, user_context: string, public_allowed: boolean>, "
    "judgments array<struct<query_id: string, relevant_child_ids: array<string>, relevant_parent_ids: array<string>, relevant_doc_ids: array<string>, relevance_grade: int, rationale_summary: string, public_allowed: boolean>>, "
    "metadata struct<split: string, difficulty: string, place_ids: array<string>, requires_context: boolean, answerability: string, review_status: string>"
)
RESULT_ROW = "run_id string, method string, query_id string, query_type string, latency_ms double, rank int, retrieval_doc_id string, child_id string, parent_id string, doc_id string, score double"
CATALOG = (
    "places array<struct<place_id: string, canonical_name: string, category: string, aliases: array<struct<alias: string, language: string, alias_type: string>>, related_place_ids: array<string>, "
    "relations: array<struct<target_place_id: string, relation_type: string, rationale: string>>, tour_context_tags: array<string>, source_policy: string, public_allowed: boolean>>"
)


def _empty_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths of files without a byte, which the scan of contents leaves out."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0 and fnmatch(status.getPath().getName(), pattern):
            found.append(status.getPath().toString())
    return found


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, folder, name, size, sha256, extension and content of the files below a folder, by name; empty ones included."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")
    empty = spark.createDataFrame([(p,) for p in _empty_files(spark, folder, pattern)], "path string")
    rows = rows.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.element_at(F.split("path", "/"), -2)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return rows.select("path", parent.alias("folder"), name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), extension.alias("extension"), "content").orderBy("name")


def parser_folders(files: DataFrame) -> DataFrame:
    """By folder: files by extension, empty files, batch files (name ends in _dddd_dddd) and references to private paths."""
    text = F.decode(F.col("content"), "UTF-8")
    counts = files.groupBy("folder", "extension").agg(F.count("*").alias("n")).groupBy("folder").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("extension", "n")))).alias("extensions"))
    rest = files.groupBy("folder").agg(
        F.count("*").alias("file_count"),
        F.count_if(F.col("size") == 0).alias("empty_file_count"),
        F.count_if(F.regexp_replace("name", r"\.[^.]+$", "").rlike(r"_\d{4}_\d{4}$")).alias("batch_file_count"),
        F.count_if((F.col("extension") == ".json") & has_private_path(text)).alias("private_path_count"),
    )
    return rest.join(counts, "folder")


def json_profile(files: DataFrame) -> DataFrame:
    """Per JSON file of an array or object: whether it parses, its keys, records, replacement characters and untitled records."""
    text = F.decode(F.col("content"), "UTF-8")
    rows = files.filter("extension = '.json'").select("path", "size", text.alias("text"), F.try_parse_json(text).alias("v"))
    first = F.coalesce(F.get_json_object("text", "$[0]"), F.col("text"))
    return rows.select(
        "path",
        "size",
        F.col("v").isNotNull().alias("ok"),
        F.coalesce(F.json_array_length("text"), F.lit(1)).alias("records"),
        F.array_sort(F.coalesce(F.json_object_keys(first), F.array().cast("array<string>"))).alias("keys"),
        (F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))).alias("replacement_count"),
        F.size(F.regexp_extract_all("text", F.lit(r'("title"\s*:\s*(""|null))'), F.lit(1))).alias("untitled_count"),
    )


def inventory_report(files: DataFrame, expected_documents: int) -> DataFrame:
    """One row: totals, and warnings where they differ from what is expected."""
    made = files.agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.count_if(F.col("size") == 0).alias("empty_file_count"),
        F.countDistinct("folder").alias("folder_count"), (F.count("sha256") - F.countDistinct("sha256")).alias("duplicate_content_count"),
    )
    warn = flags(unexpected_document_count=F.col("folder_count") != expected_documents, empty_files=F.col("empty_file_count") > 0, duplicate_contents=F.col("duplicate_content_count") > 0)
    return made.withColumn("warnings", warn)


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines by schema. Strict reading fails on the first bad line; else bad lines are rows of nulls with _bad set."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_number and text of lines that are no JSON; for diagnosis, a file is one row."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    return whole.filter((F.trim("line") != "") & F.try_parse_json("line").isNull()).select("path", (F.col("i") + 1).alias("line_number"), "line")


def leaks(df: DataFrame) -> DataFrame:
    """One row: cells of string columns that look like private paths or secrets."""
    cells = [F.col(f.name) for f in df.schema if isinstance(f.dataType, T.StringType)]
    count = lambda test: F.coalesce(F.sum(sum((F.coalesce(test(c), F.lit(False)).cast("int") for c in cells), F.lit(0))), F.lit(0))
    return df.agg(count(has_private_path).alias("private_path_count"), count(has_secret_marker).alias("secret_like_count"))


def write_lines(df: DataFrame, path: str, refuse_leaks: bool = True) -> None:
    """JSON lines with sorted keys and nulls; raises before anything is written if a value looks like a leak."""
    if refuse_leaks:
        found = leaks(df).first()
        if any(found):
            raise ValueError(f"refused to write {path}: {found.asDict()}")
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def eval_tables(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queries and qrels of evaluation items; a judgment's targets are its children if any, else parents, else documents."""
    q = items.select("query.*", "metadata.split", "metadata.difficulty", "metadata.review_status", "metadata.place_ids")
    j = items.select("query.query_id", F.posexplode_outer("judgments").alias("judgment", "j")).filter("j is not null")
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    kind = F.when(some(F.col("j.relevant_child_ids")), "child").when(some(F.col("j.relevant_parent_ids")), "parent").otherwise("doc")
    ids = F.when(kind == "child", F.col("j.relevant_child_ids")).when(kind == "parent", F.col("j.relevant_parent_ids")).otherwise(F.col("j.relevant_doc_ids"))
    return q, j.select("query_id", "judgment", kind.alias("target_kind"), F.explode(ids).alias("target_id"), F.col("j.relevance_grade").alias("grade"))


def corpus(children: DataFrame) -> DataFrame:
    """Retrieval documents: children with text."""
    return children.filter("text is not null and text <> ''").select(F.col("child_id").alias("retrieval_doc_id"), "child_id", "parent_id", "doc_id", F.col("text").alias("search_text"))


def target_inventory(docs: DataFrame) -> DataFrame:
    """kind and id of every child, parent and document that can be a target."""
    one = lambda c, kind: docs.select(F.lit(kind).alias("kind"), F.col(c).alias("id")).distinct()
    return one("child_id", "child").unionByName(one("parent_id", "parent")).unionByName(one("doc_id", "doc"))


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """places, aliases (the name first) and relations of a catalog file."""
    p = spark.read.schema(CATALOG).option("multiLine", "true").json(path).select(F.explode("places").alias("p")).select("p.*")
    names = F.concat(F.array("canonical_name"), F.transform("aliases", lambda a: a["alias"]))
    edges = F.concat(F.coalesce("related_place_ids", F.array().cast("array<string>")), F.transform(F.coalesce("relations", F.array().cast(p.schema["relations"].dataType)), lambda r: r["target_place_id"]))
    return p.select("place_id", "canonical_name", "category"), p.select("place_id", F.posexplode(names).alias("ord", "alias")), p.select("place_id", F.explode(F.array_distinct(edges)).alias("target"))


def markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """line and cells of the rows of Markdown tables; lines of dashes are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    rows = rows.filter(F.trim("text").startswith("|") & ~F.col("text").rlike(r"^[|\s:-]+$"))
    inner = F.regexp_replace(F.trim("text"), r"^\||\|$", "")
    return rows.select("line", F.transform(F.split(inner, r"\|"), lambda x: F.trim(x)).alias("cells"))


def metric_values(table: DataFrame) -> DataFrame:
    """metric and value of two-column rows whose second cell is a number."""
    value = F.get("cells", F.lit(1)).try_cast("double")
    return table.select(F.get("cells", F.lit(0)).alias("metric"), value.alias("value")).filter("value is not null")


def cache_key(docs: DataFrame, config: dict) -> str:
    """Fingerprint of an encoder's configuration and of all documents' ids and texts: edited text has another key."""
    own = set_fingerprint(docs, ["doc_id", "text"]).first()[0]
    spark = docs.sparkSession
    return spark.range(1).select(F.sha2(F.lit(json.dumps(config, sort_keys=True) + own), 256)).first()[0][:16]


def cached_vectors(docs: DataFrame, folder: str, config: dict, encode) -> DataFrame:
    """Vectors (doc_id, embedding) from folder/key=..., made with encode(docs) where they are missing."""
    path = str(PurePosixPath(folder) / f"key={cache_key(docs, config)}") if "://" not in folder else f"{folder.rstrip('/')}/key={cache_key(docs, config)}"
    spark = docs.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        encode(docs).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """rule, key and nothing else for each rule (a condition that must hold) that a row breaks; a null condition is broken."""
    broken = flags(**{name: ~F.coalesce(rule, F.lit(False)) for name, rule in rules.items()})
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def contiguous_ranks(ranked: DataFrame) -> DataFrame:
    """query_id of lists whose ranks are not 1 .. n, each once."""
    made = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    return made.filter("n <> d or low <> 1 or high <> n").select("query_id")
