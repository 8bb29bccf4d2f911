import datetime as dt
import math

import pytest

from tidemill.functions.registry import register_all
from tidemill.functions.table_functions import named_types, read_as


@pytest.fixture
def sql(spark):
    register_all(spark)
    spark.sql("CREATE OR REPLACE TEMP VIEW given AS SELECT * FROM VALUES (1, 'a', 1, 2.5D), (1, NULL, NULL, 1.0D), (1, 'a', 1, 0.25D), (2, 'b', 3, NULL), (2, 'c', 4, 7.0D), (NULL, 'd', 5, -0.0D), (NULL, NULL, 5, 0.0D) AS t(g, s, k, v)")
    return spark.sql


def kinds(df):
    return dict(df.dtypes)


def test_counts_keep_the_type_of_the_value(sql):
    df = sql("SELECT * FROM value_count(TABLE(given), 'g', 'k')")
    assert kinds(df) == {"g": "int", "counts": "map<int,int>"}
    assert {r.g: r.counts for r in df.collect()} == {1: {1: 2}, 2: {3: 1, 4: 1}, None: {5: 2}}
    df = sql("SELECT * FROM value_count(TABLE(given), keys => 'G', value => 'V', wide => true)")
    assert kinds(df)["counts"] == "map<double,bigint>"
    assert {r.g: r.counts for r in df.collect()} == {1: {2.5: 1, 1.0: 1, 0.25: 1}, 2: {7.0: 1}, None: {0.0: 2}}
    df = sql("SELECT * FROM value_count(TABLE(SELECT g, struct(s, k) AS p FROM given), 'g', 'p')")
    assert {r.g: sum(r.counts.values()) for r in df.collect()} == {1: 3, 2: 2, None: 2}


def test_partial_counts_as_weights(sql):
    df = sql("SELECT * FROM value_count(TABLE(SELECT g, s, k, count(*) AS n FROM given GROUP BY ALL), 'g, k', 's', weight => 'n')")
    assert kinds(df)["counts"] == "map<string,bigint>"
    assert {(r.g, r.k): r.counts for r in df.collect()} == {(1, 1): {"a": 2}, (1, None): {}, (2, 3): {"b": 1}, (2, 4): {"c": 1}, (None, 5): {"d": 1}}


def test_sums_keep_their_types(sql):
    df = sql("SELECT * FROM value_sum(TABLE(given), 'g', 's', 'v')")
    assert kinds(df)["sums"] == "map<string,double>"
    assert {r.g: r.sums for r in df.collect()} == {1: {"a": 2.75}, 2: {"c": 7.0}, None: {"d": 0.0}}
    df = sql("SELECT * FROM value_sum(TABLE(given), 'g', 'v', 'k')")
    assert kinds(df)["sums"] == "map<double,bigint>" and {r.g: r.sums for r in df.collect()}[1] == {2.5: 1, 0.25: 1}
    assert sql("SELECT * FROM value_sum(TABLE(SELECT * FROM given WHERE false), 'g', 's', 'v')").collect() == []


def test_nan_is_one_key(sql):
    for text in ("SELECT * FROM value_count(TABLE(SELECT 1 AS g, x FROM VALUES (double('NaN')), (double('NaN')), (1D) AS t(x)), 'g', 'x')", "SELECT 1 AS g, value_count_double(x) AS counts FROM VALUES (double('NaN')), (double('NaN')), (1D) AS t(x)"):
        assert {("nan" if math.isnan(k) else k): v for k, v in sql(text).first().counts.items()} == {"nan": 2, 1.0: 1}


@pytest.mark.parametrize(
    "text, said",
    [
        ("value_count(TABLE(given), 'g', 'nothing')", "no column nothing"),
        ("value_count(TABLE(given), '', 'k')", "no keys"),
        ("value_count(TABLE(given), 'g', 'k', weight => 'v')", "whole number"),
        ("value_count(TABLE(SELECT g, array(k) AS a FROM given), 'g', 'a')", "keys of a map"),
        ("value_sum(TABLE(given), 'g', 'k', 's')", "added up"),
        ("multiset_explode(TABLE(given), 'k')", "neither"),
        ("json_fields(TABLE(given), 's', 'a DECIMAL')", "simple type"),
        ("json_fields(TABLE(given), 's', 'k INT')", "already"),
        ("json_fields(TABLE(given), 'k', 'a INT')", "text"),
    ],
)
def test_wrong_arguments_are_told_when_planned(sql, text, said):
    with pytest.raises(Exception, match=said):
        sql(f"SELECT * FROM {text}")


def test_elements_of_multisets_and_arrays(sql):
    df = sql("SELECT * FROM multiset_explode(TABLE(SELECT 1 AS id, map(3, 2, 5, 1, 7, 0) AS m UNION ALL SELECT 2, NULL), 'm')")
    assert kinds(df)["col"] == "int" and sorted((r.id, r.col) for r in df.collect()) == [(1, 3), (1, 3), (1, 5)]
    df = sql("SELECT id, pos, col FROM multiset_posexplode(TABLE(SELECT 1 AS id, array(DATE'2024-01-02', NULL) AS a), 'a')")
    assert [tuple(r) for r in df.collect()] == [(1, 0, dt.date(2024, 1, 2)), (1, 1, None)]


def test_fields_of_json_follow_a_literal(sql):
    df = sql("""SELECT * FROM json_fields(TABLE(SELECT * FROM VALUES (1, '{"a": "5", "b": [1, "x"], "c": "true", "d": 2.5}'), (2, 'x'), (3, NULL), (4, '[1]'), (5, '{"a": 1e30, "c": 1}') AS t(i, j)), 'J', 'a INT, b STRING, c BOOLEAN, d DOUBLE')""")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in df.schema] == ["i int", "j string", "a int", "b string", "c boolean", "d double"]
    assert {r.i: (r.a, r.b, r.c, r.d) for r in df.collect()} == {1: (5, '[1,"x"]', True, 2.5), **{i: (None,) * 4 for i in (2, 3, 4, 5)}}


def test_json_values_as_simple_types():
    assert [read_as(v, "tinyint") for v in (127, 128, "5", 5.0, 5.5, True, "x", None)] == [127, None, 5, 5, None, None, None, None]
    assert [read_as(v, "double") for v in ("1.5", True, {}, 2)] == [1.5, None, None, 2.0]
    assert named_types("a INT, b string") == [("a", "int"), ("b", "string")]


def test_aggregates_in_group_by(sql):
    row = sql("SELECT value_count(s) AS s, value_count_int(k) AS i, value_count_wide_double(v) AS d, value_sum_of_doubles(s, v) AS sd, value_sum_int(k, g) AS si, value_count_bigint(CAST(k AS BIGINT) + 9007199254740992, 1) AS b, value_count_int(NULL) AS none FROM given WHERE g = 1")
    assert kinds(row) == {"s": "map<string,int>", "i": "map<int,int>", "d": "map<double,bigint>", "sd": "map<string,double>", "si": "map<int,bigint>", "b": "map<bigint,int>", "none": "map<int,int>"}
    r = row.first()
    assert (r.s, r.i, r.d, r.sd, r.si, r.b, r.none) == ({"a": 2}, {1: 2}, {2.5: 1, 1.0: 1, 0.25: 1}, {"a": 2.75}, {1: 2}, {9007199254740993: 2}, {})


@pytest.mark.parametrize("text", ["value_count(k)", "value_count_int(v)", "value_sum(s, v)", "value_sum_of_doubles(s, k)", "value_sum(s, CAST(v AS DECIMAL(10, 1)))"])
def test_other_types_are_errors_and_never_cast(sql, text):
    with pytest.raises(Exception, match="takes|adds up"):
        sql(f"SELECT {text} FROM given").collect()


def test_sums_beyond_64_bits_are_errors(sql):
    for text in ("SELECT value_sum(s, v) FROM VALUES ('a', 9223372036854775807L), ('a', 9223372036854775807L) AS t(s, v)", "SELECT * FROM value_sum(TABLE(SELECT 1 AS g, * FROM VALUES ('a', 9223372036854775807L), ('a', 1L) AS t(s, v)), 'g', 's', 'v')"):
        with pytest.raises(Exception, match="64 bits"):
            sql(text).collect()
