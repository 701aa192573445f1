"""Column functions and parsers on literal cases."""

import pytest
from pyspark.sql import functions as F

from quillrank.functions.ids import md5_uniform
from quillrank.functions.text import index_text, last_n, string_list, tokenize
from quillrank.functions.vectors import l2_normalize
from quillrank.sources import raw


def one(spark, col, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(col.alias("r")).first().r


@pytest.mark.parametrize("text, want", [
    ("Don't naïve_x 3D æØå N²", ["don", "naïve", "æøå", "n²"]), ("", []), (None, []), ("THE of 12", []), ("a" * 50_000, ["a" * 50_000]),
])
def test_tokenize(spark, text, want):
    assert one(spark, tokenize("t"), t=("string", text)) == want


def test_tokenize_keeps_stop_words_on_request(spark):
    assert one(spark, tokenize("t", drop_stopwords=False, min_length=1), t=("string", "the a cat")) == ["the", "a", "cat"]
    assert one(spark, tokenize("t", "da"), t=("string", "og katten på")) == ["katten", "på"]


@pytest.mark.parametrize("items, want", [([], []), (["a"], ["a"]), (["a", "b", "c"], ["b", "c"])])
def test_last_n(spark, items, want):
    assert one(spark, last_n("x", 2), x=("array<string>", items)) == want


def test_lists_and_text(spark):
    assert one(spark, string_list("x"), x=("array<string>", None)) == []
    assert one(spark, string_list("x"), x=("array<string>", ["a", None])) == ["a"]
    assert one(spark, index_text("a", "b"), a=("string", None), b=("string", "x")) == " x"


def test_normalise_zero_vector(spark):
    assert one(spark, l2_normalize("v"), v=("array<float>", [0.0, 0.0])) == [0.0, 0.0]
    assert one(spark, l2_normalize("v"), v=("array<float>", [3.0, 4.0])) == pytest.approx([0.6, 0.8])


def test_md5_uniform_is_a_fixed_value(spark):
    import hashlib

    want = int(hashlib.md5(b"17:3:13").hexdigest()[:8], 16) / 2**32
    assert one(spark, md5_uniform("a", "b"), a=("bigint", 17), b=("int", 3)) == want


def test_parse_candidates(spark):
    shown, clicked = raw.parse_candidates("t")
    text = "N1-1 N2-0 N3 -1 A-B-1"
    assert one(spark, shown, t=("string", text)) == ["N1", "N2", "N3", "-1", "A-B"]
    assert one(spark, clicked, t=("string", text)) == ["N1", "A-B"]
    assert one(spark, shown, t=("string", "")) == [] and one(spark, shown, t=("string", None)) == []


@pytest.mark.parametrize("blob, want", [
    ('[{"Label": "A"}, 5, {"Label": ""}, {"x": 1}, {"Label": "B"}, {"Label": "A"}]', ["A", "B"]), ("null", []), ("bad{", []), ("[]", []), (None, []), ("", []),
])
def test_entity_labels(spark, blob, want):
    assert one(spark, raw.entity_labels("b"), b=("string", blob)) == want


def test_parse_time(spark):
    assert str(one(spark, raw.parse_time("t"), t=("string", "11/9/2019 9:05:58 AM"))) == "2019-11-09 09:05:58"
    assert one(spark, raw.parse_time("t", strict=False), t=("string", "soon")) is None
    with pytest.raises(Exception, match="(?i)parse|CANNOT_PARSE"):
        one(spark, raw.parse_time("t"), t=("string", "soon"))


def test_history_lists_must_be_parallel(spark):
    df = spark.createDataFrame([("u", ["a", "b"], [None])], "u string, i array<string>, t array<timestamp_ntz>")
    with pytest.raises(Exception, match="differ in length"):
        raw.history_rows(df, "u", "i", "t", F.lit("s")).collect()
    empty = spark.createDataFrame([("u", None, None), ("v", [], [])], "u string, i array<string>, t array<timestamp_ntz>")
    assert raw.history_rows(empty, "u", "i", "t", F.lit("s")).count() == 0


def test_surrogate_ids_are_dense(spark):
    df = spark.range(1_000).select((F.col("id") * 7919 % 1_000).alias("k"))
    got = raw.surrogate_ids(df.repartition(5), ["k"], "n").collect()
    assert sorted((r.k, r.n) for r in got) == [(i, i) for i in range(1_000)]
