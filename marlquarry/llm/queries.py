"""The registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlquarry.llm import audit
from marlquarry.llm.audio import media_digests
from marlquarry.llm.hyperminhash import DedupConfig, near_duplicates
from marlquarry.llm.licenses import scan_licenses
from marlquarry.llm.mixing import mix
from marlquarry.llm.order import training_order
from marlquarry.llm.packing import pack
from marlquarry.llm.quality import judge, oracle
from marlquarry.llm.secrets import scan_secrets
from marlquarry.llm.token_counts import count_tokens
from marlquarry.llm.toxicity import score, train
from marlquarry.llm.warc import pages_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), DedupConfig(shingle=3, percent=85, rows=6, bands=40))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_round_trip(_table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return score(documents, train(documents, _table(spark, sf_dir, "labels")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(_table(spark, sf_dir, "documents"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_secret_scan": op4_secret_scan,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_audio": op9_audio,
    "op10_training_order": op10_training_order,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_counts": op12_token_counts,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE32 = UPPER + "234567"

DEDUP_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select distinct doc_id as node, doc_id as root from documents union select r.node, e.b from r join e on e.a = r.root),
c as (select node, min(root) as component_id from r group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from documents join c on node = doc_id left join n using (doc_id)
"""

_DIGITS = " || ".join(f"substr('{BASE32}', 1 + ((('0x' || substr(h, {5 * g + 1}, 5))::int >> {15 - 5 * d}) & 31), 1)" for g in range(8) for d in range(4))
WARC_SQL = f"""
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages), b as (select h, max(page_id) as best from p group by 1)
select page_id, strlen(t) as payload_bytes, {_DIGITS} as payload_digest, case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id < best then best end as refers_to from p join b using (h)
"""

ORACLES: dict[str, str] = {"op1_minhash_dedup": DEDUP_SQL, "op2_warc": WARC_SQL, "op3_quality": oracle(), "op11_filter_audit": audit.oracle()}
