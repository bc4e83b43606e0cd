"""Text and time functions, in plans and on the driver."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolith.functions import clock as C
from chronolith.functions import text as T
from chronolith.operators.postings import Query


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


STEMS = [("deployment", "deploy"), ("failed", "fail"), ("process", None), ("cats", None), ("tables", "tabl"), ("running", "runn"), ("glass", None), ("nation", None), ("x1y2z3", None), ("configuracao", "configur"), ("lichkeit", "lich")]


@pytest.mark.parametrize("word,stem", STEMS)
def test_stem_on_driver(word, stem):
    assert T.stem_of(word) == stem


def test_stem_in_plan_is_the_driver_s(spark):
    words = [w for w, _ in STEMS] + ["aaaaings", "weddings", "bessss", "ööööng", "abcde"]
    assert column(spark, words, T.light_stem) == [T.stem_of(w) for w in words]


TEXTS = ["Straße und Größe", "部署失败 yesterday", "Configuração É rápida", "हिन्दी में", "plain ascii_text 42", "ﬁne ＦＵＬＬ", "", "?!", "Привет мир", "カタカナ"]


def test_tokens_in_plan_are_the_driver_s(spark):
    assert column(spark, TEXTS, T.tokens) == [T.token_list(t) for t in TEXTS]
    assert T.token_list("Straße") == ["strasse"]
    assert T.token_list("部署 x") == ["部", "署", "x"]


def test_fold_keeps_marks_of_other_scripts():
    assert T.fold_text("configuração") == "configuracao"
    assert T.fold_text("हिन्दी") == unicodedata.normalize("NFC", "हिन्दी")


def test_normalize_spaces_cjk(spark):
    assert column(spark, ["A部署B", "Straße"], T.normalize_text) == ["a 部  署 b", "strasse"]


def test_query_terms():
    q = Query.parse("Why did the deployment fail?")
    assert [t.text for t in q.terms] == ["deployment", "fail"] and q.phrase == ("why", "did", "the", "deployment", "fail")
    assert [t.text for t in Query.parse("what is this").terms] == ["what", "is", "this"]
    assert [t.text for t in Query.parse("部署失败").terms] == ["部署", "署失", "失败"]
    assert not Query.parse("?!  ...").terms
    assert Query.parse('deployment "x"').expression() == '"deployment" OR "deploy" * OR "x" OR "deployment x"'


def test_join_texts(spark):
    assert column(spark, [[" a ", "", "b"], ["部", "署", "x"], []], T.join_texts, "array<string>") == ["a b", "部署 x", ""]


def test_ends_sentence(spark):
    assert column(spark, ["Yes.", 'He said "no."  ', "and then", "好。", "(why?)"], T.ends_sentence) == [True, True, False, True, True]


def test_estimate_tokens(spark):
    assert column(spark, ["abcdefg", "部署", "部a", ""], T.estimate_tokens) == [2, 2, 2, 0]


def test_stamps(spark):
    values = [0.0, 742.24, 59.96, 3742.5, -1.0]
    assert column(spark, values, C.format_timestamp, "double") == ["0:00.0", "12:22.2", "1:00.0", "1:02:22.5", "0:00.0"]
    assert column(spark, [3742.5], lambda c: C.format_cue_time(c, ","), "double") == ["01:02:22,500"]
    assert column(spark, [3742.9], C.format_clock, "double") == ["01:02:22"]


def test_parse_time(spark):
    assert column(spark, ["90", "1:30", "01:01:30.5", "1:x", "-5", "1:2:3:4"], C.parse_time) == [90.0, 90.0, 3690.5, None, None, None]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=14))
def test_stem_is_a_long_enough_beginning(word):
    stem = T.stem_of(word)
    assert stem is None or word.startswith(stem) and len(stem) >= 4
