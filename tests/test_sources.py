import datetime as dt
import io
import time
import urllib.error

import pytest
from pyspark.sql import functions as F

from tidemill.functions.registry import register_all
from tidemill.sources import faker, formats
from tidemill.sources.lookups import FoundCache, RestClient, kv_lookup, named_client
from tidemill.sources.tables import Tables



def now():
    return F.lit("2024-01-01").cast("timestamp")


def test_faker_types_and_determinism(spark):
    small = "#{number.numberBetween '3','9'}"
    columns = {
        "title": ("string", {"expression": "#{superhero.name}", "null-rate": "0.3"}),
        "weight": ("double", {"expression": "#{number.randomDouble '3','10','11'}"}),
        "serial": ("bigint", {"expression": "#{number.numberBetween '9007199254740993','9007199254741993'}"}),
        "part": ("row<label string, size int>", {"label.expression": "p-#{harry_potter.spell}", "size.expression": small}),
        "tags": ("multiset<string>", {"expression": "#{regexify '(red|blue){1}'}", "length": "6"}),
        "rows": ("array<row<size int>>", {"size.expression": small, "length": "4"}),
        "stock": ("map<string, int>", {"key.expression": "#{regexify '[x-z]{1}'}", "value.expression": small, "length": "2"}),
        "seen": ("timestamp(3)", {"expression": "#{date.past '60','30','SECONDS'}"}),
    }
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in columns.items())
    options = {f"fields.{name}.{k}": v for name, (_, held) in columns.items() for k, v in held.items()} | {"number-of-rows": "150"}
    draw = lambda seed: faker.fake(spark, schema, options, seed, now()).collect()
    first = draw(1)
    assert first == draw(1) != draw(2) and len(first) == 150 and 10 < sum(r.title is None for r in first) < 90
    for r in first:
        assert 10 <= r.weight <= 11 and 2**53 < r.serial < 2**53 + 1002 and r.part.label.startswith("p-") and 3 <= r.part["size"] < 9
        assert sum(r.tags.values()) == 6 and set(r.tags) <= {"red", "blue"} and len(r.rows) == 4 and 1 <= len(r.stock) <= 2 and set(r.stock) <= set("xyz")
        assert dt.timedelta(seconds=29.9) < dt.datetime(2024, 1, 1) - r.seen < dt.timedelta(seconds=60.1)
    assert len({x["size"] for r in first for x in r.rows}) == 6
    for bad in ({"number-of-rows": "1"}, {"number-of-rows": "1", "fields.a.expression": "#{no.such}"}):
        with pytest.raises(ValueError):
            faker.fake(spark, "a int", bad)


def test_faker_lookup_and_stream(spark, folder):
    left = spark.createDataFrame([(1,), (2,), (1,)], "k int")
    out = faker.fake_lookup(left, {"k": "id"}, "id int, name string", {"fields.name.expression": "#{superhero.name}#{regexify '[0-9]{6}'}"}).collect()
    names = {r.id: r.name for r in out}
    assert all(names[r.id] == r.name for r in out) and names[1] != names[2]
    stream = faker.fake_stream(spark, "a int", {"fields.a.expression": "#{number.numberBetween '0','5'}", "rows-per-second": "50"})
    assert stream.isStreaming


def test_click_log_late_rows(spark):
    rows = faker.click_log(spark.range(60), "id", now(), late=True).collect()
    assert len(rows) == 60 + 5 * 3  # ticks 0, 5 and 10
    assert min(r.event_time for r in rows) == dt.datetime(2023, 12, 31, 23, 59, 50)


def test_json_decoders(spark):
    lines = ['{"id": "7", "name": "a", "age": 3, "x": 1}', '{"id": 8, "name": {"b": 1}, "age": "z"}', "bad", '{"age": ""}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    flat = formats.decode_json(df, "value", "id int, name string, age int", "flat").collect()
    assert [tuple(r) for r in flat] == [(7, "a", 3), (8, '{"b":1}', None), (None, None, None), (None, None, None)]
    with pytest.raises(Exception):  # noqa: B017
        formats.decode_json(df, "value", "id int", "nested", ignore_errors=False).collect()
    with pytest.raises(Exception, match="is missing"):
        formats.decode_json(df.limit(1), "value", "id int, other int", fail_on_missing=True).collect()
    view = formats.json_view(df.select(F.col("value").cast("binary").alias("value")), "value", "id int", "bytes_view", mode="flat")
    assert view.columns == ["id", "proctime"] and spark.table("bytes_view").count() == 4
    with pytest.raises(TypeError):
        formats.json_view(spark.range(1), "id", "id int", "none")
    assert formats.encode_json(spark.sql("SELECT 1 AS a, cast(null AS int) AS b")).first()[0] == '{"a":1,"b":null}'


def test_csv_edge_cases(spark):
    lines = ["1,aa,20", "3,xxx", "4,xaxas", "5,saxs,23,aa", "7 , aa , 20", "x,y,z"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [tuple(r) for r in formats.decode_csv(df, "value", "id bigint, name string, age int").collect()]
    assert got == [(1, "aa", 20), (3, "xxx", None), (4, "xaxas", None), (5, "saxs", 23), (7, "aa", 20), (None, "y", None)]


def test_protobuf(spark):
    df = spark.createDataFrame([("d", 5, 2), (None, None, None)], "dt string, item_id long, item_type int")
    fields = {1: "dt", 9: "item_id", 10: "item_type"}
    raw = formats.encode_protobuf(df, fields)
    assert [tuple(r) for r in formats.decode_protobuf(raw, "value", fields).collect()] == [("d", 5, 2), ("", 0, 0)]
    assert formats.decode_protobuf(raw, "value", {9: "item_id"}).first() == (5,)
    large = spark.createDataFrame([("d", 2**53 + 1, 2), ("e", None, 1)], "dt string, item_id long, item_type int")
    assert [r.item_id for r in formats.decode_protobuf(formats.encode_protobuf(large, fields), "value", fields).collect()] == [2**53 + 1, 0]
    bad = spark.createDataFrame([(bytearray(b"\xff\xff"),)], "value binary")
    assert formats.decode_protobuf(bad, "value", {9: "item_id"}).first() == (None,)


def test_tables(spark, folder):
    t = Tables(spark)
    path = f"{folder}/in"
    spark.createDataFrame([('{"id": "1", "name": "a"}',), ('{"id": 2}',)], "value string").coalesce(1).write.text(path)
    t.declare("people", "id bigint, name string", {"connector": "mylocalfile", "format": "myjson", "path": path, "cycle-num": "2"}, {"twice": "id * 2"})
    assert sorted((r.id, r.twice) for r in t.read("people").collect()) == [(1, 2), (1, 2), (2, 4), (2, 4)]
    assert spark.sql("SELECT count(*) FROM people").first()[0] == 4
    t.declare("dim", "id bigint, name string", {"connector": "myfilesystem", "format": "myjson", "path": path, "lookup.cache.max-rows": "10"})
    assert t.dimension("dim").join(spark.range(3), {"id": "id"}).count() == 3
    orc = f"{folder}/orc"
    t.declare("out", "id bigint, name string", {"connector": "filesystem", "format": "orc", "path": orc})
    t.insert("out", t.read("dim"))
    t.declare("pruned", "ID bigint", {"connector": "filesystem", "format": "orc", "path": orc})
    assert sorted(r[0] for r in t.read("pruned").collect()) == [1, 2]
    spark.read.orc(orc).toDF("_col0", "_col1").write.orc(f"{folder}/hive")
    t.declare("placed", "key bigint, label string", {"connector": "filesystem", "format": "orc", "path": f"{folder}/hive"})
    assert t.read("placed").columns == ["key", "label"] and t.read("placed").count() == 2
    with pytest.raises(ValueError):
        t.declare("none", "a int", {})
    with pytest.raises(ValueError):
        t.declare("bad", "a int", {"connector": "nowhere"})
        t.read("bad")


def test_datagen(spark):
    df = faker.datagen(spark, "a int, s string, n bigint", {"fields.a.min": "1", "fields.a.max": "3", "fields.s.length": "70", "fields.n.kind": "sequence", "fields.n.start": "5", "fields.n.end": "8"}, 100)
    rows = df.collect()
    assert [r.n for r in rows] == [5, 6, 7, 8] and all(1 <= r.a <= 3 and len(r.s) == 70 for r in rows)


def test_found_cache():
    clock, asked = [0.0], []

    def find(k):
        asked.append(k)
        return {"k": k} if k < 9 else None

    cache = FoundCache(2, 10, lambda: clock[0])
    for k in (1, 1, 9, 9, 2, 3, 1):
        cache.get(k, find)
    assert asked == [1, 9, 9, 2, 3, 1]
    clock[0] = 11
    cache.get(1, find)
    assert asked[-1] == 1 and len(asked) == 7


def test_kv_lookup(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    client = lambda: lambda key: {"name": key.upper(), "v": 5} if key == "a" else None
    out = kv_lookup(left, "k", client, "name string, v int")
    assert sorted((r.n, r.name, r.v) for r in out.collect()) == [(1, "A", 5), (2, None, None), (3, None, None)]
    assert kv_lookup(left, "k", client, "name string", inner=True).count() == 1
    large = spark.createDataFrame([("a", 2**53 + 1), ("b", None)], "k string, n long")
    assert sorted(((r.n, r.v) for r in kv_lookup(large, "k", client, "v int").collect()), key=str) == [(2**53 + 1, 5), (None, None)]


def test_key_value_tables(spark):
    t = Tables(spark)
    left = spark.createDataFrame([("a", 2**53 + 1), ("z", 2), (None, 3)], "k string, name long")
    t.declare("docs", "id string, name string, n bigint", {"connector": "myes", "es.nodes": "http://none", "es.resource": "i"})
    found = t.dimension("docs", lambda: lambda key: {"id": key, "name": "A", "n": 2**53 + 1} if key == "a" else None)
    assert sorted(((r.k, r.name, r.id, r.dim_name, r.n) for r in found.join(left, {"k": "id"}).collect()), key=str) == sorted([("a", 2**53 + 1, "a", "A", 2**53 + 1), ("z", 2, None, None, None), (None, 3, None, None, None)], key=str)
    assert t.dimension("docs") is found and found.join(left, {"k": "id"}, "inner").count() == 1
    t.declare("cells", "rk string, name string, n bigint", {"connector": "myhbase", "table-name": "x", "cf": "f", "fields": "n:g:number"})
    with pytest.raises(ValueError):
        t.dimension("cells")
    cells = t.dimension("cells", lambda: lambda key: {"f:name": b"B", "g:number": b"9007199254740993"} if key == "a" else None)
    assert [(r.rk, r.dim_name, r.n) for r in cells.join(left, {"k": "rk"}, "inner").collect()] == [("a", "B", 2**53 + 1)]
    with pytest.raises(ValueError):
        cells.join(left, {"k": "name"})
    named_client("upper")(lambda options: lambda: lambda key: {"id": key, "name": key.upper() + options["tail"]})
    t.declare("named", "id string, name string", {"connector": "reflect", "client": "upper", "tail": "!"})
    assert [r.dim_name for r in t.dimension("named").join(left, {"k": "id"}, "inner").orderBy("k").collect()] == ["A!", "Z!"]
    t.declare("unknown", "id string", {"connector": "reflect", "client": "os.system"})
    with pytest.raises(ValueError):
        t.dimension("unknown")


def test_paced_and_cyclic_replay(spark, folder):
    spark.createDataFrame([('{"id": 1}',), ('{"id": 2}',), ("",), ('{"id": 3}',)], "value string").coalesce(1).write.text(f"{folder}/in")
    t = Tables(spark)
    t.declare("lines", "id int", {"connector": "mylocalfile", "format": "myjson", "path": f"{folder}/in", "source.sleep": "1 ms", "cycle-num": "2"})
    query = t.stream("lines").writeStream.format("memory").queryName("replayed").option("checkpointLocation", f"{folder}/check").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if spark.table("replayed").count() >= 6:
                break
        assert sorted(r.id for r in spark.table("replayed").collect()) == [1, 1, 2, 2, 3, 3]
    finally:
        query.stop()


def test_sql_names(spark):
    names = register_all(spark)
    assert {"nvl", "value_count", "value_sum", "json_tuple", "extract_unix_timestamp", "slice", "sort_array"} <= set(names)
    rows = spark.sql("SELECT g, value_count(v, 1) AS c, value_sum(v, n) AS s FROM VALUES (1, 'x', 2), (1, 'x', 3), (1, 'y', CAST(NULL AS INT)), (2, CAST(NULL AS STRING), 1) AS t(g, v, n) GROUP BY g ORDER BY g").collect()
    assert [(r.g, r.c, r.s) for r in rows] == [(1, {"x": 2, "y": 1}, {"x": 5}), (2, {}, {})]
    assert spark.sql("SELECT array_size_or_minus1(array(1, 2)), array_size_or_minus1(NULL)").first() == (2, -1)


def test_rest_client_goes_on_to_the_next_host():
    seen = []

    def opener(request, timeout):
        seen.append(request.full_url)
        if "first" in request.full_url:
            raise OSError("down")
        if "none" in request.full_url:
            raise urllib.error.HTTPError(request.full_url, 404, "", {}, io.BytesIO())
        return io.BytesIO(b'{"ok": 1}')

    client = RestClient(["http://first", "http://second"], "u", "p", opener=opener)
    assert client.call("x") == {"ok": 1} and client.call("none") is None
    assert seen == ["http://first/x", "http://second/x", "http://second/none"]
    with pytest.raises(OSError):
        RestClient(["http://first"], opener=opener).call("x")
