import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemill.sinks import batching, databases, documents, files
from tidemill.sinks.tables import write_table
from tidemill.sources.tables import Table
from tidemill.streaming.windows import replay


def rows_in(path, sql="SELECT * FROM t ORDER BY 1"):
    con = sqlite3.connect(path)
    out = con.execute(sql).fetchall()
    con.close()
    return out


def test_insert_sql():
    assert databases.insert_sql("t", ["a", "b"]) == "INSERT INTO t (a,b) VALUES (?,?)"
    assert databases.insert_sql("t", ["a", "b"], True, ["b"]) == "INSERT INTO t (a,b) VALUES (?,?) ON DUPLICATE KEY UPDATE a=VALUES(a),b=IFNULL(b,VALUES(b))"
    assert databases.insert_sql("t", ["a", "b"], True, [], ["a"], "sqlite").endswith("ON CONFLICT (a) DO UPDATE SET b=excluded.b")
    with pytest.raises(ValueError):
        databases.insert_sql("t", ["a"], True, ["z"])
    with pytest.raises(ValueError):
        databases.insert_sql("t", ["a"], True, dialect="sqlite")


def test_upsert_keeps_old_values(spark, folder):
    path = f"{folder}/db"
    sqlite3.connect(path).execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, birthday TEXT)").connection.close()
    schema = "id int, name string, birthday string"
    options = {"connector": "myjdbc", "table-name": "t", "update-mode": "true", "keys": "id", "dialect": "sqlite", "old-val-columns": "birthday", "sink.batch.size": "2"}
    first = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], schema).coalesce(1)
    second = spark.createDataFrame([(1, "A", "y"), (2, "B", "z"), (3, "C", None)], schema).coalesce(1)
    table = Table(first.schema, options)
    for df in (first, second):
        write_table(table, df, connect=lambda: sqlite3.connect(path, timeout=30))
    assert rows_in(path) == [(1, "A", "x"), (2, "B", "z"), (3, "C", None)]
    with pytest.raises(TypeError):
        databases.database_writer(None, "t", spark.sql("SELECT array(1) AS a").schema)


def test_batching_sink_reduces_by_key_and_survives_a_restart(spark, folder):
    source, checkpoint, kv = f"{folder}/in", f"{folder}/check", f"{folder}/kv"
    schema = "id int, name string, age int"
    spark.createDataFrame([(1, "a", 5), (1, "b", 9), (1, "c", 7), (2, "d", None)], schema).coalesce(1).write.parquet(source)
    seen = []
    keyed = batching.KeyedMode.from_options({"sink.keyed.mode": "true", "sink.keyed.mode.keys": "id", "sink.keyed.mode.orderby": "age asc"})

    def run():
        stream = replay(spark, source, spark.read.parquet(source).schema)
        batching.batching_sink(stream, files.kv_writer(kv, ["id"], spark), checkpoint, keyed=keyed, before=seen.append, once=True).awaitTermination()

    run()
    spark.createDataFrame([(2, "e", 1), (3, "f", 2)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted((r.id, r.name) for r in files.read_kv(spark, kv, ["id"]).collect()) == [(1, "b"), (2, "e"), (3, "f")]
    assert len(seen) == 2
    assert batching.KeyedMode.from_options({}) is None
    with pytest.raises(ValueError):
        batching.KeyedMode.from_options({"sink.keyed.mode": "true"})


def test_keyed_mode_by_arrival(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id int, name string, seq int")
    assert batching.KeyedMode(["id"], arrival="seq").reduce(df).first().name == "b"
    assert batching.KeyedMode(["id"]).reduce(df).count() == 1


def test_routes_and_periodic(spark):
    got = {}
    write = batching.routed({"x": lambda b, n: got.update(x=b.count()), "y": lambda b, n: got.update(y=b.count())}, "kind")
    write(spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "kind string"), 0)
    assert got == {"x": 2, "y": 1}
    ran = []
    daily = batching.Periodic(ran.append, lambda now: ["DELETE"], hour=0, minute=0)
    weekly = batching.Periodic(ran.append, lambda now: ["WEEK"], week_day=0)
    monday = 1704067200  # 2024-01-01
    for t in (monday, monday + 600, monday + 3 * 3600, monday + 86400):
        daily(t)
        weekly(t)
    assert ran == [["DELETE"], ["WEEK"], ["DELETE"]]


def test_statements(folder):
    databases.statement_runner(lambda: sqlite3.connect(f"{folder}/db"))(["CREATE TABLE t (a)", "INSERT INTO t VALUES (1)"])
    assert rows_in(f"{folder}/db") == [(1,)]


def test_guarded_script_and_bulk_lines(spark):
    script = documents.guarded_script(["_id", "v", "title"], [("v", True)], "_id")
    assert script["source"] == "if(ctx._source.v == null || ctx._source.v < params.v){ctx._source.v = params.v; ctx._source.title = params.title;}"
    assert "> params.v || ctx._source.title == null" in documents.guarded_script(["v", "title"], [("v", False), ("title", True)])["source"]
    with pytest.raises(ValueError):
        documents.guarded_script(["a"], [("z", True)])
    row = spark.sql("SELECT 'k' AS _id, 1 AS v, named_struct('a', array(1, 2), 'm', map('x', 1)) AS d, cast(null AS int) AS n").first()
    head, body = map(json.loads, documents.bulk_lines(row, "i", "_id"))
    assert head == {"index": {"_index": "i", "_id": "k"}} and body == {"v": 1, "d": {"a": [1, 2], "m": {"x": 1}}, "n": None}
    assert json.loads(documents.bulk_lines(row, "i", "_id", "upsert", ignore_nulls=True)[1])["doc_as_upsert"]
    assert json.loads(documents.bulk_lines(row, "i", "_id", "upsert", {"source": "s"})[1])["script"]["params"]["v"] == 1
    with pytest.raises(ValueError):
        documents.bulk_lines(row, "i", "_id", "delete")


def test_document_and_cells_writers(spark, folder):
    def sender():
        def post(text):
            with open(f"{folder}/bulk", "a") as f:
                f.write(text)

        return post

    documents.document_writer(sender, "i", "id", batch_size=2)(spark.range(5).coalesce(1).withColumn("v", F.lit(1)), 0)
    assert len(open(f"{folder}/bulk").read().splitlines()) == 10

    def putter():
        def put(cells):
            with open(f"{folder}/cells", "a") as f:
                f.write(f"{cells}\n")

        return put

    documents.cells_writer(putter, "k", "cf")(spark.sql("SELECT 'a' AS k, 1 AS v, cast(null AS int) AS n UNION ALL SELECT null, 2, 3").coalesce(1), 0)
    assert open(f"{folder}/cells").read() == "[('a', {'cf:v': b'1'})]\n"


def test_lines_log_and_compaction(spark, folder):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string").coalesce(1)
    write_table(Table(df.schema, {"connector": "mylocalfile", "path": f"{folder}/l"}), df)
    assert sorted(r.value for r in spark.read.text(f"{folder}/l").collect()) == ['{"id":1,"name":"a"}', '{"id":2,"name":null}']
    write_table(Table(df.schema, {"connector": "mylog", "log-level": "print", "sink.insert-only": "false"}), df)

    def say(level, line):
        with open(f"{folder}/log", "a") as f:
            f.write(f"{level} {line}\n")

    files.log_writer("warn", "+U ", say=say)(spark.range(3000).coalesce(1), 0)
    lines = open(f"{folder}/log").read().splitlines()
    assert len(lines) == 3000 and lines[0] == 'warn +U {"id":0}'
    spark.range(100).repartition(10).write.orc(f"{folder}/small")
    assert files.compact(spark, f"{folder}/small", f"{folder}/large") == 1
    assert spark.read.orc(f"{folder}/large").count() == 100 and spark.read.orc(f"{folder}/large").rdd.getNumPartitions() == 1
    files.write_orc(spark.range(4).selectExpr("id", "id % 2 AS dt"), f"{folder}/parts", ["dt"])
    assert sorted(r.id for r in spark.read.orc(f"{folder}/parts").where("dt = 1").collect()) == [1, 3]
    with pytest.raises(ValueError):
        files.log_writer("loud")


def test_row_buffer_flushes_by_size_time_and_close():
    now, out = [0.0], []
    buffer = batching.RowBuffer(out.append, 3, 1000, 100, clock=lambda: now[0])
    for i in range(4):
        buffer.add(i)
    assert out == [[0, 1, 2]]
    now[0] = 1.2
    buffer.add(4)
    assert out[1:] == [[3, 4]]
    now[0] = 2.3
    for i in (5, 6, 7):  # by size; 50 ms later the time is up, but the last flush is too near
        buffer.add(i)
    now[0] = 2.35
    buffer.due = 1.0
    buffer.add(8)
    assert out[2:] == [[5], [6, 7, 8]] or out[2:] == [[5]]
    buffer.close()
    buffer.close()
    assert sorted(x for part in out for x in part) == list(range(9))
    with pytest.raises(ValueError):
        batching.RowBuffer(out.append, 0)

    def fail(rows):
        raise OSError("down")

    with pytest.raises(OSError):
        batching.RowBuffer(fail, 1).add(1)


def test_row_buffer_holds_one_row_of_a_key():
    out = []
    buffer = batching.RowBuffer(out.append, 2, key=lambda r: r[0], replace=lambda new, old: max(new, old))
    for r in ((1, 5), (1, 9), (1, 7), (2, 1), (3, 1)):
        buffer.add(r)
    buffer.close()
    assert out == [[(1, 9), (2, 1)], [(3, 1)]]


def test_buffered_writer(spark, folder):
    def start():
        def flush(rows):
            with open(f"{folder}/out", "a") as f:
                f.write(f"{[r.id for r in rows]}\n")

        return flush

    batching.buffered(start, 2, 60_000)(spark.range(5).coalesce(1), 0)
    assert open(f"{folder}/out").read().splitlines() == ["[0, 1]", "[2, 3]", "[4]"]


def test_queue_sink(spark, folder):
    from pyspark.sql.datasource import DataSource, DataSourceWriter

    class Queue(DataSource):
        @classmethod
        def name(cls):
            return "filequeue"

        def writer(self, schema, overwrite):
            return Writer(self.options)

    class Writer(DataSourceWriter):
        def __init__(self, options):
            self.options = options

        def write(self, rows):
            from pyspark.sql.datasource import WriterCommitMessage

            with open(self.options["kafka.folder"], "a") as f:
                for r in rows:
                    f.write(f"{self.options['topic']} {r.key} {r.value}\n")
            return WriterCommitMessage()

    spark.dataSource.register(Queue)
    df = spark.createDataFrame([(2**53 + 1, "a"), (2, None)], "id long, name string").coalesce(1)
    options = {"connector": "kafka", "topic": "t", "properties.bootstrap.servers": "x:1", "properties.folder": f"{folder}/q", "key.fields": "id"}
    write_table(Table(df.schema, options), df, connect="filequeue")
    write_table(Table(df.schema, options | {"format": "csv", "key.fields": "name"}), df, connect="filequeue")
    assert open(f"{folder}/q").read().splitlines() == ['t 9007199254740993 {"id":9007199254740993,"name":"a"}', 't 2 {"id":2,"name":null}', "t a 9007199254740993,a", "t None 2,"]
    with pytest.raises(ValueError):
        write_table(Table(df.schema, {"connector": "kafka", "topic": "t"}), df)
    with pytest.raises(ValueError):
        write_table(Table(df.schema, options | {"format": "avro"}), df)
