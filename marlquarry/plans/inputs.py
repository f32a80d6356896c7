"""Driver tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlquarry.functions.lineage import written
from marlquarry.operators.normalize import text_lines
from marlquarry.operators.retrieval import containment


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries: query_id, query_text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a passage are relevant to it: grade 2 where labelled of good quality, else 1."""
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pairs = containment(documents(spark, sf_dir), passages(spark, sf_dir))
    return pairs.join(quality, "doc_id", "left").select("query_id", "doc_id", F.when(F.col("quality") == 1, 2).otherwise(1).alias("grade"))


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qrels(), worked out once for all that looks at them."""
    return written(qrels(spark, sf_dir), "qrels")


def judged_queries(spark: SparkSession, sf_dir: str, rel: DataFrame | None = None) -> DataFrame:
    """query_id, query_text, expected: passages that some document contains are to be retrieved, the rest to be abstained from."""
    found = (rel if rel is not None else qrels(spark, sf_dir)).select("query_id").distinct().withColumn("r", F.lit(True))
    return passages(spark, sf_dir).join(found, "query_id", "left").select("query_id", "query_text", F.when(F.col("r"), "retrieve").otherwise("abstain").alias("expected"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return e.join(passages(spark, sf_dir).select("query_id"), "query_id", "left_semi")


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return e.join(documents(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with a word, as blocks: doc_id, source, line (from 0), text."""
    return text_lines(documents(spark, sf_dir), "source")


#: Questions beside the conversations': id, text, places that it names, and the turn before it.
QUESTIONS = [
    (-1, "지금 경복궁 대기 시간이 얼마나 되나요?", 1, None),
    (-2, "광화문에서 북촌으로 걸어서 가는 길을 알려 주세요", 2, None),
    (-3, "두 왕의 갈등은 어떻게 이어졌나요?", 2, None),
    (-4, "이 문에 얽힌 이야기를 관광객에게 짧게 설명해 주세요", 1, None),
    (-5, "이 일대의 큰 흐름을 요약해 주세요", 0, None),
    (-6, "이 전각의 이름은 무슨 의미인가요?", 1, None),
    (-7, "그 사람은 왜 그랬어? 누가 시켰어?", 0, "앞 질문"),
    (-8, "그 사람은 왜 그랬어? 누가 시켰어?", 0, None),
    (-9, "두 장소의 연결을 개괄해 주세요", 2, None),
    (-10, "두 사건이 연결된 이유와 배경이 궁금해요", 2, None),
    (-11, "is there a live crowd count RIGHT  NOW?", 0, None),
    (-12, "alive crowds, rightnow", 0, None),
    (-13, "광장을 지나 동선을 이어갈 때 걸으며 볼 것", 3, None),
    (-14, "천도의 영향을 비교해 줘", 2, "도성"),
    (-15, "거기 " + "아주 " * 12 + "긴 질문인데 뭐가 있어", 0, "도성"),
    (-16, "이 터의 배치는 어떤 관계를 보여 주나요, 전체 권역 요약", 2, None),
    (-17, "", 0, None),
    (-18, "도심 동선과 도심 공간", 1, None),
]

#: Texts with what may not be public, and texts that look like it.
TOLD = [
    (-51, "token: ''"), (-52, "a\nSecret =\n"), (-53, "password = \"\" x"), (-54, "api-key:'v'"), (-55, "token='' '"), (-56, "one\r\nsk-a\rD:\\x"), (-57, "sk- d:/x"), (-58, ""), (-59, "token \nsecret: 1"),
]
LEAKY = [
    (-1, "see C:\\data\\x"), (-2, "see d:/data"), (-3, "\\\\host\\share"), (-4, "//host/share"), (-5, "at /HOME/me"), (-6, "at(/home/me)"), (-7, "/workspace/x"), (-8, "a /runner/ b"), (-9, "https://a.b"),
    (-10, "key sk-abc"), (-11, "the secret password"), (-12, "Password=x"), (-13, "API_KEY=1"), (-14, "api_key: 1"), (-15, "GHP_x"), (-16, "Bearer  x"), (-17, "half_done"), (-18, "  one line \n"), (-19, "two\nlines"),
    (-20, "가" * 600), (-21, "가" * 601), (-22, " " * 700), (-23, "a\rb"), (-24, None), (-25, "xoxb-1 hf_2 github_pat_3"), (-26, "AKIA0000 private key"), (-27, "access_token=1"), (-28, "e:x"),
]

#: Spoken texts beside the conversations': id, what was said, what was heard.
SPOKEN = [
    (-1, "경복궁은 조선의 궁궐입니다", "경복궁은 조선에 궁궐 입니다"), (-2, "광화문", "광화문"), (-3, "북촌 한옥마을 3길", "북촌 하녹마을 삼길"), (-4, "", "무언가"), (-5, "Été à Séoul, 서울", "ete a seoul 서울"), (-6, "한 글자", ""),
]
#: Places beside the nations: id, name, aliases and related places.
PLACES = [
    ("gyeongbokgung", "경복궁", ["Gyeongbokgung", "북궐"], ["gwanghwamun", "bukchon"]),
    ("gwanghwamun", "광화문", ["Gwanghwamun Gate", "문"], ["gyeongbokgung", "nowhere", "bukchon", "jongno"]),
    ("bukchon", "북촌", ["Bukchon", "북촌", "윗마을", "Bukchon Village", "한옥"], ["doseong"]),
    ("doseong", "도성", ["성", "LIVE", "live Crowd"], []),
    ("blank", " ", [""], ["doseong"]),
]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place_id, ord, name, aliases, related: nations, and the few above."""
    own = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("place_id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name"),
        F.array(F.substring(F.lower("n_name"), 1, 3), F.lower("n_name")).alias("aliases"),
        F.array(F.concat(F.lit("n"), F.pmod(F.col("n_nationkey") + 1, F.lit(25)).cast("string")), F.concat(F.lit("n"), F.col("n_regionkey").cast("string"))).alias("related"),
    )
    told = [(i, 100 + k, name, aliases, related) for k, (i, name, aliases, related) in enumerate(PLACES)]
    return own.unionByName(spark.createDataFrame(told, "place_id string, ord long, name string, aliases array<string>, related array<string>"))
