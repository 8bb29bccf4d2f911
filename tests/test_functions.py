import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill import functions as tf
from tidemill.sources.ddl import parse_schema, to_text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    ("text", "delimiter", "n", "want"),
    [("a.b.c", ".", 2, "a.b"), ("a.b.c", ".", -2, "b.c"), ("a.b.c", ".", 0, ""), ("a.b", "", 1, ""), ("abc", "|", 3, "abc"), ("a||b||c", "||", 1, "a"), (None, ".", 0, None)],
)
def test_substring_index(spark, text, delimiter, n, want):
    assert one(spark, tf.substring_index(F.lit(text).cast("string"), delimiter, n)) == (want,)


def test_concat_ws_with_nulls_arrays_and_multisets(spark):
    df = spark.sql("SELECT map('x', 2, 'y', 1) AS m, array('a', null, 'b') AS a, cast(null AS string) AS n, 7 AS i")
    assert df.select(tf.concat_ws("-", "a", "n", F.col("i").cast("string"), "m", multisets=("m",))).first()[0] == "a-b-7-x-x-y"


def test_split_keeps_trailing_empties(spark):
    assert one(spark, tf.split(F.lit("a,b,,"), ",")) == (["a", "b", "", ""],)


def test_url_decode(spark):
    cases = {"a%20b": "a b", "%zz": "%zz", "plain": "plain"}
    for given, want in cases.items():
        assert one(spark, tf.url_decode(F.lit(given))) == (want,)
    assert one(spark, tf.url_decode(F.lit("%C4%E3"), "GBK")) == ("你",)
    assert one(spark, tf.url_decode_times(F.lit("a%2520b"), 2)) == ("a b",)
    assert one(spark, tf.url_decode_times(F.lit("a%25zz"), 3)) == ("a%zz",)


def test_regexp_extract(spark):
    assert one(spark, tf.regexp_extract(F.lit("k=v"), "(k)=(x)?v", 2), tf.regexp_extract(F.lit("k"), "z(.)", 1)) == ("", "")


def test_json(spark):
    j = F.lit('{"a": {"b": [1, 2]}, "n": null, "s": "t"}')
    assert one(spark, tf.get_json_object(j, "$.a.b[1]"), tf.get_json_object(j, "$.n"), tf.get_json_object(F.lit("{bad"), "$.a")) == ("2", None, None)
    assert spark.range(1).select(tf.json_tuple(j, "s", "z")).first() == ("t", None)
    assert len(spark.range(1).select(tf.json_tuple(F.lit(None).cast("string"), "s")).collect()) == 1
    with pytest.raises(ValueError):
        tf.json_tuple(j, "s", "s")
    with pytest.raises(ValueError):
        tf.get_json_object(j, "a")
    r = one(spark, tf.from_json(F.lit('{"a": "12", "b": "x", "c": 1.5}'), "row<a int, b string, c double>"))[0]
    assert (r.a, r.b, r.c) == (12, "x", 1.5)
    assert one(spark, tf.from_json(F.lit("[1, 2]"), "array<int>"), tf.from_json(F.lit('{"k": 1}'), "map<string, int>")) == ([1, 2], {"k": 1})
    assert one(spark, tf.to_json(F.struct(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"))), tf.to_json(F.array(F.lit(1), F.lit(None)))) == ('{"a":1}', "[1,null]")
    assert one(spark, tf.to_json(F.create_map(F.lit("k"), F.lit(2)))) == ('{"k":2}',)


def test_arrays(spark):
    df = spark.sql("SELECT array(3, null, 1, 3) AS a, cast(null AS array<int>) AS n, array(named_struct('x', 2, 'y', 'b'), named_struct('x', 1, 'y', 'z')) AS s")
    r = df.select(tf.size("a"), tf.size("n"), tf.array_distinct("a"), tf.array_contains("a", 9), tf.array_contains("a", 3), tf.array_max("a"), tf.array_min("a"), tf.sort_array("a"), tf.sort_array("a", False), tf.slice_array("a", -2, 2), tf.slice_array("a", 9, 2)).first()
    assert tuple(r) == (4, -1, [3, None, 1], None, True, 3, 1, [None, 1, 3, 3], [3, 3, 1, None], [1, 3], [])
    assert df.select(tf.array_max("s")).first()[0].x == 2
    with pytest.raises(ValueError):
        tf.slice_array("a", 0, 1)
    assert df.select(tf.named_struct(p=F.lit(1)).alias("q")).select("q.p").first()[0] == 1


def test_multisets(spark):
    df = spark.sql("SELECT array('b', 'a', 'b', null) AS a").select(tf.ms_from_array("a").alias("m"))
    assert df.first().m == {"b": 2, "a": 1}
    assert df.select(tf.ms_size("m"), tf.ms_distinct("m")).first() == (2, ["b", "a"])
    assert [r.col for r in tf.ms_explode(df, "m").collect()] == ["b", "b", "a"]
    assert [(r.pos, r.col) for r in tf.ms_posexplode(df, "m").collect()] == [(0, "b"), (1, "b"), (2, "a")]


def test_explode(spark):
    df = spark.sql("SELECT 1 AS i, map('k', 2) AS m, cast(null AS array<int>) AS n")
    assert tf.explode(df, "m").select("key", "value").first() == ("k", 2)
    assert tf.explode(df, "n").count() == 0 and tf.explode(df, "n", outer=True).first().col is None
    assert tf.posexplode(df, "m").select("pos", "key").first() == (0, "k")


def test_dates(spark):
    ts = F.lit("2024-03-04 05:07:08").cast("timestamp")
    assert one(spark, tf.add_days(F.lit("2024-02-28"), 2), tf.add_days(F.lit("x"), 1)) == (dt.date(2024, 3, 1), None)
    assert one(spark, tf.extract_unix_timestamp(ts), tf.extract_unix_timestamp(F.lit("1970-01-01 00:00:01").cast("timestamp_ntz"))) == (1709528828, 1)
    assert one(spark, tf.floor_to(ts, 300), tf.days_since_epoch(ts), tf.second_of_day(ts), tf.day_of_week(ts)) == (dt.datetime(2024, 3, 4, 5, 5), 19786, 18428, 0)


def test_java_method_is_gated(spark):
    assert one(spark, tf.java_method("java.lang.Math", "abs", F.lit(-3)), tf.java_method("java.lang.Integer", "parseInt", F.lit("x"))) == ("3", None)
    with pytest.raises(PermissionError):
        tf.java_method("java.lang.System", "exit", F.lit(1))


def test_register_all(spark):
    names = tf.register_all(spark)
    assert "url_decode_or_same" in names
    assert spark.sql("SELECT url_decode_or_same('%zz'), add_days('x', 1), multiset_elements(map('a', 2)), array_size_or_minus1(null)").first() == ("%zz", None, ["a", "a"], -1)


def test_schema_text():
    s = parse_schema("a int, b row<c string, d array<row<e bigint>>>, f multiset<string>, g timestamp(3), h timestamp_ltz(3), i varchar(20)")
    assert [f.dataType.simpleString() for f in s] == ["int", "struct<c:string,d:array<struct<e:bigint>>>", "map<string,int>", "timestamp_ntz", "timestamp", "string"]
    assert parse_schema(to_text(s)) == s
