"""Names in texts, and rewritten queries."""

from __future__ import annotations

import random
import re

from marlquarry.operators import rewriting as X

QUERIES = "query_id long, query_type string, query_text string, user_context string, expected string, place_ids array<string>"
PLACES = "place_id string, ord long, name string, aliases array<string>, related array<string>"


def stands(name, text):
    """One name, one text, by its own pattern."""
    if not re.search("[0-9a-z]", name):
        return name in text
    return re.search(rf"(?<![0-9a-z]){re.escape(name)}(?![0-9a-z])", text) is not None


def test_mentions_are_those_of_each_name_alone(spark):
    rng = random.Random(4)
    letters = "ab1 성문-é"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    names = sorted({word(5) for _ in range(60)} | {"", "a", "성"})
    texts = [(i, word(60)) for i in range(200)] + [(1000, None), (1001, ""), (1002, "a" * 100_000 + " a"), (3, "a 성"), (None, "b")]
    want = sorted({(i, n) for i, t in texts for n in names if n and t and stands(n, t)}, key=repr)
    t = spark.createDataFrame(texts, "query_id long, text string").selectExpr("*", "'x' as name")
    n = spark.createDataFrame([(x,) for x in names] + [(None,), ("a",)], "name string").selectExpr("*", "1 as query_id")
    for most in (X.MOST, 7):
        got = sorted({tuple(r) for r in X.mentions(t, n, most=most).collect()}, key=repr)
        assert got == want, most
    assert X.mentions(t, n.limit(0)).collect() == [] and X.mentions(t.limit(0), n).collect() == []


def test_rewritten_queries(spark):
    places = spark.createDataFrame(
        [
            ("palace", 0, "경복궁", ["Gyeongbok", "북궐", "경복궁", "Fourth", "Fifth"], ["gate", "village", "gate", "lost", "river"]),
            ("gate", 1, "광화문", None, ["palace"]),
            ("village", 2, "북촌", ["Old Village"], None),
            ("river", 3, "River", ["old village"], []),
        ],
        PLACES,
    )
    asked = [
        (1, "route_context", "  경복궁에서  북촌으로 ", None, "retrieve", []),
        (2, "place_fact", "who built the OLD  village?", "", "retrieve", ["gate", "nowhere", "village"]),
        (3, "voice_followup", "왜?", "광화문 " + "긴 " * 200, "retrieve", None),
        (4, "no_answer", " 경복궁 ", "x", "retrieve", ["gate"]),
        (5, "place_fact", "경복궁", None, "abstain", []),
        (6, "overview", "경복궁", "ctx", "retrieve", []),
        (7, "place_story", "gyeongboks", "gyeongboks", None, []),
        (8, None, None, None, None, None),
        (9, "place_story", "이전 맥락: A", "a", "retrieve", []),
    ]
    got = {r.query_id: r for r in X.rewrite_queries(spark.createDataFrame(asked, QUERIES).selectExpr("*", "'n' as name", "1 as ord"), places).collect()}
    assert got[1].rewritten == "경복궁에서 북촌으로 장소 단서: 경복궁 Gyeongbok 북궐 Fourth 북촌 Old Village 관련 장소: 광화문 북촌 검색 의도: 한양 서울 동선 연결"
    assert got[1].rules == "place_alias_expansion,route_related_place_expansion,query_type_intent_terms" and got[1].places == "palace,village"
    assert got[2].places == "gate,village,river" and got[2].rewritten == "who built the OLD village? 장소 단서: 광화문 북촌 Old Village River old village 검색 의도: 한양 조선 역사 장소"
    assert got[3].rewritten.startswith("왜? 이전 맥락: 광화문 긴") and got[3].places == "gate" and "voice_context_expansion" in got[3].rules
    assert len(got[3].rewritten.split(" 장소 단서")[0]) == len("왜? 이전 맥락: ") + 239  # the 240th is a space
    assert [(got[i].rewritten, got[i].changed, got[i].places, got[i].rules) for i in (4, 5, 6)] == [("경복궁", False, "", "no_answer_guard"), ("경복궁", False, "", "no_answer_guard"), ("경복궁", False, "", "query_type_passthrough")]
    assert got[7].places == "" and got[7].rules == "query_type_intent_terms"
    assert (got[8].rewritten, got[8].changed) == ("", False)
    assert got[9].rewritten == "이전 맥락: A 검색 의도: 한양 조선 역사 이야기 관광 설명"
    assert X.rewrite_queries(spark.createDataFrame([], QUERIES), places).collect() == []
    assert {r.places for r in X.rewrite_queries(spark.createDataFrame(asked, QUERIES), places.limit(0)).collect()} == {""}


def test_queries_are_typed_once(spark, sf):
    from pyspark.sql import functions as F

    from marlquarry.plans import doc_queries as Doc

    assert "Join" not in Doc._asked(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def typed(text):
        seen.add(1)
        return "route_context"

    asked = spark.createDataFrame([(i, "route_context", "경복궁에서 북촌까지", None, "retrieve", []) for i in range(20)], QUERIES).withColumn("query_type", typed("query_text"))
    places = spark.createDataFrame([("a", 1, "경복궁", ["x"], ["b"]), ("b", 2, "북촌", [], [])], PLACES)
    assert {r.places for r in X.rewrite_queries(asked, places).collect()} == {"a,b"} and seen.value == 20
