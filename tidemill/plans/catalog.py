"""The queries of the library's own operators, over whole tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import collections as arrays
from tidemill.functions import dates, multiset, reflection, registry, strings, tables
from tidemill.functions import json as js
from tidemill.operators import aggregates, batches, joins, windows
from tidemill.session import SETTINGS
from tidemill.sinks import files
from tidemill.sinks.keyvalue import KeyValueTable
from tidemill.sources import faker, formats
from tidemill.sources.tables import Table, read_files
from tidemill.streaming import changelog, stateful, temporal
from tidemill.streaming.windows import changes, replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Bytes of a row group where a large file is one step of a stream, so that several tasks read it.
BLOCK = 4 << 20


def a_step(spark: SparkSession, path: str, steps: int) -> int:
    """How many of a folder's files make a batch so that all are read in so many batches, however many tasks have written them."""
    return max(1, math.ceil(len(spark.read.parquet(path).inputFiles()) / steps))


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a session on one machine that names none gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="tidemill-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- the flagship: JSON fields, a dimension and tumbling windows ----


@query("""
    SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type,
           count(*) AS n, sum(value) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k, max(length(event_type)) AS type_length
    FROM events GROUP BY ALL""")
def tumble_lookup_json(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    # A dimension of its own: made once, so that counting it does not scan the events again.
    path = scratch(spark, "kinds")
    events.select("event_type").distinct().withColumn("type_length", F.length("event_type")).write.parquet(path)
    kinds = spark.read.parquet(path)
    timed = events.select("ts", "event_type", "value", js.get_json_object("props", "$.k").cast("long").alias("k"))
    joined = joins.lookup_join(timed, kinds, {"event_type": "event_type"}).drop("dim_event_type")
    return windows.tumble(joined, "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)), total=F.sum("value"), max_k=F.max("k"), type_length=F.max("type_length"))


# ---- projection and filter ----


@query("SELECT p_partkey, p_name, p_size, p_size * 2 + 1 AS twice, 'x' AS mark, concat(p_brand, '/', CAST(p_size AS VARCHAR)) AS tag FROM part WHERE p_name LIKE '%a%' AND p_size > 10")
def proj_filter_like(spark, sf_dir):
    part = read(spark, sf_dir, "part").where("p_name LIKE '%a%' AND p_size > 10")
    return part.select("p_partkey", "p_name", "p_size", (F.col("p_size") * 2 + 1).alias("twice"), F.lit("x").alias("mark"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("tag"))


@query("SELECT o_orderpriority AS priority, n FROM (SELECT o_orderpriority, count(*) AS n FROM (SELECT * FROM orders WHERE o_totalprice > 1000) GROUP BY 1) WHERE n > 1")
def derived_table(spark, sf_dir):
    inner = read(spark, sf_dir, "orders").where("o_totalprice > 1000").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return inner.where("n > 1").select(F.col("o_orderpriority").alias("priority"), "n")


@query("SELECT c_custkey, c_name AS name, c_nationkey AS nation, c_nationkey AS first, CAST(NULL AS INTEGER) AS second FROM customer")
def array_struct_access(spark, sf_dir):
    made = read(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("data"), F.array("c_nationkey", F.lit(None)).alias("two"))
    return made.select("c_custkey", "data.name", "data.nation", F.element_at("two", 1).alias("first"), F.element_at("two", 2).alias("second"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(strings.split(F.lower("text"), " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS key, o_totalprice AS price FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'R'")
def union_all(spark, sf_dir):
    a = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    b = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("key"))
    return faker.union_all([a, b])


@query("SELECT event_id, user_id * 3 + length(event_type) AS score FROM events")
def async_enrich(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return batches.async_map(events, lambda r: [{"event_id": r["event_id"], "score": r["user_id"] * 3 + len(r["event_type"])}], "event_id long, score long", capacity=8, ordered=True)


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS doubled FROM orders")
def batch_map_orders(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return batches.batch_map(orders, lambda rows: [{"o_orderkey": r["o_orderkey"], "doubled": round(r["o_totalprice"] * 2, 2)} for r in rows], "o_orderkey long, doubled double", 1000)


@query("SELECT o_orderkey, CAST(o_orderkey + 20 - 10 AS BIGINT) AS a, CAST(o_custkey + 20 - 10 AS BIGINT) AS b FROM orders")
def fn_transform_lambda(spark, sf_dir):
    moved = read(spark, sf_dir, "orders").select("o_orderkey", F.transform(F.array("o_orderkey", "o_custkey"), lambda x: x + 20 - 10).alias("x"))
    return moved.select("o_orderkey", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    return read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def set_except(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).subtract(read(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_nationkey"))


@query("SELECT o_orderkey, greatest(o_orderkey, o_custkey) AS larger, CASE WHEN o_orderkey >= o_custkey THEN 'order' ELSE 'customer' END AS which FROM orders")
def fn_greatest_struct(spark, sf_dir):
    pair = F.greatest(F.struct(F.col("o_orderkey").alias("k"), F.lit("order").alias("which")), F.struct(F.col("o_custkey").alias("k"), F.lit("customer").alias("which")))
    made = read(spark, sf_dir, "orders").select("o_orderkey", pair.alias("g"))
    return made.select("o_orderkey", F.col("g.k").alias("larger"), "g.which")


# ---- joins ----


@query("SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def lookup_join_left(spark, sf_dir):
    dim = read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey")
    return joins.lookup_join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), dim, {"o_custkey": "c_custkey"}).drop("c_custkey")


@query("SELECT n_nationkey, n_name, c_custkey FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_mktsegment = 'BUILDING'")
def lookup_fanout(spark, sf_dir):
    dim = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_nationkey")
    return joins.lookup_join(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), dim, {"n_nationkey": "c_nationkey"}).select("n_nationkey", "n_name", "c_custkey")


@query("SELECT e.event_id, e.user_id, c_name FROM events e LEFT JOIN customer ON (e.user_id = c_custkey) AND length(e.event_type) = c_nationkey")
def lookup_two_keys(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", F.length("event_type").alias("size"))
    dim = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    return joins.lookup_join(events, dim, {"user_id": "c_custkey", "size": "c_nationkey"}).select("event_id", "user_id", "c_name")


@query("""
    SELECT p_partkey, word FROM part, unnest(string_split(p_name, ' ')) AS t(word) WHERE p_size > 25
    UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size <= 25""")
def lateral_explode_left(spark, sf_dir):
    read(spark, sf_dir, "part").createOrReplaceTempView("tidemill_part")
    return spark.sql("SELECT p_partkey, t.word FROM tidemill_part LEFT JOIN LATERAL explode(CASE WHEN p_size > 25 THEN split(p_name, ' ', -1) END) AS t(word) ON TRUE")


@query("SELECT doc_id, pos, col FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS col FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def posexplode_words(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("doc_id", strings.split("text", " ").alias("w"))
    return tables.posexplode(words, "w").select("doc_id", F.col("pos").cast("long").alias("pos"), "col")


def _latest(kind: str) -> str:
    return f"(SELECT user_id, arg_max(value, (ts, event_id)) AS v, max((ts, event_id)) AS t FROM events WHERE event_type = '{kind}' GROUP BY user_id)"


@query(f"SELECT coalesce(a.user_id, b.user_id) AS user_id, a.v AS click_value, b.v AS view_value FROM {_latest('click')} a FULL JOIN {_latest('view')} b ON a.user_id = b.user_id")
def wait_join_batch_2(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    sides = {k: events.where(F.col("event_type") == k).drop("event_type") for k in ("click", "view")}
    return joins.wait_join_batch(sides, "user_id", ["ts", "event_id"]).select("user_id", "click_value", "view_value")


@query(f"""SELECT coalesce(a.user_id, b.user_id, c.user_id) AS user_id, a.v AS click_value, b.v AS view_value, c.v AS purchase_value
    FROM {_latest('click')} a FULL JOIN {_latest('view')} b ON a.user_id = b.user_id FULL JOIN {_latest('purchase')} c ON c.user_id = coalesce(a.user_id, b.user_id)""")
def wait_join_batch_3(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    sides = {k: events.where(F.col("event_type") == k).drop("event_type") for k in ("click", "view", "purchase")}
    return joins.wait_join_batch(sides, "user_id", ["ts", "event_id"]).select("user_id", "click_value", "view_value", "purchase_value")


@query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def inner_join_chain(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").join(read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


# ---- aggregates ----


@query("SELECT event_type, count(*) AS n, sum(value) AS total, max(value) AS largest FROM events GROUP BY event_type")
def group_count_sum_max(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY ALL HAVING count(*) > 2")
def group_two_keys(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")).where("n > 2")


@query("SELECT user_id, event_type AS key, CAST(count(*) AS INTEGER) AS value FROM events GROUP BY user_id, event_type")
def value_count_map(spark, sf_dir):
    return tables.explode(aggregates.value_count(read(spark, sf_dir, "events"), ["user_id"], "event_type"), "counts").select("user_id", "key", "value")


@query("SELECT user_id, event_type AS key, sum(value) AS value FROM events GROUP BY user_id, event_type")
def value_sum_map(spark, sf_dir):
    return tables.explode(aggregates.value_sum(read(spark, sf_dir, "events"), ["user_id"], "event_type", "value"), "sums").select("user_id", "key", "value")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def listagg_sorted(spark, sf_dir):
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(aggregates.listagg("n_name").alias("names"))


@query("SELECT c_nationkey, c_mktsegment AS key, CAST(count(*) AS INTEGER) AS value FROM customer GROUP BY ALL")
def multiset_collect(spark, sf_dir):
    return tables.explode(aggregates.collect_multiset(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment"), "elements").select("c_nationkey", "key", "value")


@query("SELECT c_nationkey, c_mktsegment AS col FROM customer")
def multiset_explode(spark, sf_dir):
    return multiset.ms_explode(aggregates.collect_multiset(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment"), "elements").select("c_nationkey", "col")


@query("SELECT event_type, avg(value) AS mean FROM events GROUP BY event_type")
def my_avg(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(aggregates.my_avg("value").alias("mean"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


# ---- windows ----


@contextmanager
def rocks(spark):
    """The library's state store, for operators that keep state of their own."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, SETTINGS[provider])
    try:
        yield
    finally:
        spark.conf.set(provider, before)


def run_once(spark, stream, name, **options):
    """Run a stream over what is there, into files; gives them as a table."""
    sink = scratch(spark, name)
    with rocks(spark):
        files.exactly_once_files(stream, sink, scratch(spark, "state"), "parquet", once=True, **options).awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


@query("SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, max(o_totalprice) AS largest, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY o_custkey")
def stream_group_changelog(spark, sf_dir):
    """The change log of a GROUP BY over a table that grows in four steps; replayed, it is the GROUP BY."""
    orders, path = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), scratch(spark, "orders")
    orders.repartitionByRange(4, "o_orderkey").write.option("parquet.block.size", BLOCK).parquet(path)
    log = changelog.group_changes(replay(spark, path, orders.schema, files_per_trigger=a_step(spark, path, 4)), ["o_custkey"], {"n": ("count", "*"), "keys": ("sum", "o_orderkey"), "largest": ("max", "o_totalprice"), "kinds": ("count_distinct", "o_orderstatus")})
    return changelog.replayed(run_once(spark, log, "changes"))


@query("""
    SELECT o_orderstatus, count(*) AS customers, max(o_totalprice) AS largest FROM
        (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) GROUP BY o_orderstatus""")
def stream_changelog_of_latest(spark, sf_dir):
    """Two chained operators: the latest order of each customer as a change log, and an aggregate that takes back what a later order replaces."""
    orders, path = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice"), scratch(spark, "orders")
    orders.repartition(4, "o_orderkey").write.parquet(path)
    latest = changelog.latest_changes(replay(spark, path, orders.schema), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    log = changelog.group_changes(latest, ["o_orderstatus"], {"customers": ("count", "*"), "largest": ("max", "o_totalprice")}, op="op")
    return changelog.replayed(run_once(spark, log, "changes"))


@query("""
    SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS largest, len(list_distinct(list(event_type) OVER w)) AS kinds
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW)""")
def over_range_10min(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    frame = windows.over_range(["user_id"], "ts", 600)
    out = windows.rolling(events, ["user_id"], "ts", 600, n=F.count(F.lit(1)), largest=F.max("value"))
    return out.withColumn("kinds", aggregates.count_distinct_over("event_type", frame).cast("long")).select("event_id", "n", "largest", "kinds")


@query("""
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10 SECOND PRECEDING AND CURRENT ROW) AS n10,
           sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS sum1h FROM events""")
def over_two_frames(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return events.select("event_id", F.count(F.lit(1)).over(windows.over_range(["user_id"], "ts", 10)).alias("n10"), F.sum("value").over(windows.over_range(["user_id"], "ts", 3600)).alias("sum1h"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1")
def keyed_top1(spark, sf_dir):
    return windows.keyed_top1(read(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "value asc", "event_id")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_type DESC, value ASC, event_id DESC) = 1")
def keyed_top1_desc(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return windows.keyed_top1(rows, ["user_id", "event_type"], "event_type asc, value desc", "event_id")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS interval_start, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 hour, ts) ORDER BY ts DESC, event_id DESC) = 1")
def throttle_lazy_batch(spark, sf_dir):
    """The newest row of a user in each hour of the grid; the stream's intervals begin at a row's arrival instead."""
    return windows.newest_per_interval(read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "1 hour").select("interval_start", "user_id", "event_id")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def tumble_1h(spark, sf_dir):
    return windows.tumble(read(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)), total=F.sum("value"))


@query("""
    SELECT s AS window_start, s + INTERVAL 1 hour AS window_end, count(*) AS n
    FROM (SELECT unnest([time_bucket(INTERVAL 30 minute, ts), time_bucket(INTERVAL 30 minute, ts) - INTERVAL 30 minute]) AS s FROM events) GROUP BY ALL""")
def hop_1h(spark, sf_dir):
    return windows.hop(read(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", n=F.count(F.lit(1)))


@query("""
    SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 10 minute AS window_end, count(*) AS n FROM (
      SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 minute THEN 1 ELSE 0 END AS fresh FROM events))
    GROUP BY user_id, s""")
def session_10min(spark, sf_dir):
    return windows.session_windows(read(spark, sf_dir, "events"), "ts", "10 minutes", ["user_id"], n=F.count(F.lit(1)))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_100_orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER w AS n, lag(l_quantity) OVER w AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
def row_number_lag(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("n"), F.lag("l_quantity").over(w).alias("before"))


# ---- functions ----


def substring_sql(text: str, delimiter: str, n: int) -> str:
    parts = f"string_split({text}, '{delimiter}')"
    return f"array_to_string({parts}[1:{n}], '{delimiter}')" if n > 0 else f"array_to_string({parts}[greatest(1, len({parts}) - {-n - 1}):], '{delimiter}')"


@query(f"SELECT doc_id, {substring_sql('text', ' ', 2)} AS two, {substring_sql('text', ' ', -2)} AS last, {substring_sql('source', 'rc', 1)} AS word, '' AS none FROM documents")
def fn_substring_index(spark, sf_dir):
    f = strings.substring_index
    return read(spark, sf_dir, "documents").select("doc_id", f("text", " ", 2).alias("two"), f("text", " ", -2).alias("last"), f("source", "rc", 1).alias("word"), f("text", " ", 0).alias("none"))


@query("SELECT p_partkey, concat_ws('-', p_name, p_brand, NULL, CAST(p_size AS VARCHAR)) AS plain, array_to_string([p_brand, p_type], '|') || '|' || p_name AS nested FROM part")
def fn_concat_ws(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", strings.concat_ws("-", "p_name", "p_brand", F.lit(None).cast("string"), F.col("p_size").cast("string")).alias("plain"), strings.concat_ws("|", F.array("p_brand", "p_type"), "p_name").alias("nested"))


@query("SELECT doc_id, CAST(len(p) AS INTEGER) AS n, p[1] AS first, p[-1] AS last FROM (SELECT doc_id, string_split_regex(text || '..', '[.,]') AS p FROM documents)")
def fn_split(spark, sf_dir):
    parts = read(spark, sf_dir, "documents").select("doc_id", strings.split(F.concat("text", F.lit("..")), "[.,]").alias("p"))
    return parts.select("doc_id", F.size("p").alias("n"), F.element_at("p", 1).alias("first"), F.element_at("p", -1).alias("last"))


@query("SELECT page_id, regexp_extract(url, '([a-z]+)://([^/]+)', 2) AS host, regexp_extract(url, 'no(thing)here', 1) AS none FROM pages")
def fn_regexp_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", strings.regexp_extract("url", "([a-z]+)://([^/]+)", 2).alias("host"), strings.regexp_extract("url", "no(thing)here", 1).alias("none"))


@query("SELECT page_id, url AS once, url AS same FROM pages")
def fn_url_decode(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.url_encode("url").alias("encoded"))
    broken = F.concat(F.lit("%zz"), "url")
    return pages.select("page_id", strings.url_decode("encoded").alias("once"), F.substring(strings.url_decode(broken), 4, 1_000_000).alias("same"))


@query("SELECT page_id, url AS twice FROM pages")
def fn_url_decode2(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.url_encode(F.url_encode("url")).alias("encoded"))
    return pages.select("page_id", strings.url_decode_times("encoded", 2).alias("twice"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END, o_orderstatus) AS a, coalesce(CASE WHEN o_totalprice > 100000 THEN o_custkey END, 0) AS b FROM orders")
def fn_nvl(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", strings.nvl(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")), "o_orderstatus").alias("a"), strings.nvl(F.when(F.col("o_totalprice") > 100000, F.col("o_custkey")), F.lit(0)).alias("b"))


@query("SELECT vec_id, CASE WHEN label % 2 = 0 THEN -1 ELSE CAST(len(embedding) AS INTEGER) END AS n FROM embeddings")
def fn_size_null(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", arrays.size(F.when(F.col("label") % 2 != 0, F.col("embedding"))).alias("n"))


@query("SELECT vec_id, embedding[2] AS a, embedding[4] AS b, embedding[-3] AS c FROM embeddings")
def fn_slice(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", arrays.slice_array("embedding", 2, 3).alias("x"), arrays.slice_array("embedding", -3, 3).alias("y"))
    return e.select("vec_id", F.col("x")[0].alias("a"), F.col("x")[2].alias("b"), F.col("y")[0].alias("c"))


@query("SELECT doc_id, CAST(len(list_distinct(w)) AS INTEGER) AS n, array_to_string(list_sort(list_distinct(w)), ' ') AS words FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def fn_array_distinct(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", arrays.array_distinct(strings.split("text", " ")).alias("w"))
    return d.select("doc_id", F.size("w").alias("n"), F.array_join(arrays.sort_array("w"), " ").alias("words"))


@query("SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS has, CAST(NULL AS BOOLEAN) AS unknown FROM documents")
def fn_array_contains(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", arrays.array_contains(strings.split("text", " "), "the").alias("has"), arrays.array_contains(F.array("source", F.lit(None)), "none").alias("unknown"))


@query("SELECT vec_id, list_max(embedding) AS high, list_min(embedding) AS low FROM embeddings")
def fn_array_max_min(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", arrays.array_max("embedding").alias("high"), arrays.array_min("embedding").alias("low"))


@query("SELECT doc_id, array_to_string(list_sort(w), ' ') AS up, array_to_string(list_reverse_sort(w), ' ') AS down FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def fn_sort_array(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", strings.split("text", " ").alias("w"))
    return d.select("doc_id", F.array_join(arrays.sort_array("w"), " ").alias("up"), F.array_join(arrays.sort_array("w", False), " ").alias("down"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def fn_get_json_object(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", js.get_json_object("props", "$.k").alias("k"), js.get_json_object("props", "$.none[0]").alias("missing"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS c0, CAST(NULL AS VARCHAR) AS c1 FROM events")
def fn_json_tuple(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", js.json_tuple("props", "k", "none"))


@query("SELECT event_id, user_id, event_type FROM events")
def fn_to_json(spark, sf_dir):
    made = read(spark, sf_dir, "events").select("event_id", js.to_json(F.struct("user_id", "event_type", F.lit(None).cast("string").alias("none"))).alias("j"))
    return made.select("event_id", js.get_json_object("j", "$.user_id").cast("long").alias("user_id"), js.get_json_object("j", "$.event_type").alias("event_type"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_from_json(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", js.from_json("props", "row<k bigint>").alias("r")).select("event_id", "r.k")


@query("SELECT c_custkey, c_name AS name, c_acctbal AS balance FROM customer")
def fn_named_struct(spark, sf_dir):
    made = read(spark, sf_dir, "customer").select("c_custkey", arrays.named_struct(name=F.col("c_name"), balance=F.col("c_acctbal")).alias("s"))
    return made.select("c_custkey", "s.name", "s.balance")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 7 AS DATE) AS later, CAST(NULL AS DATE) AS none FROM orders")
def fn_date_add(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.add_days(F.col("o_orderdate").cast("date"), 7).alias("later"), dates.add_days(F.lit("no date"), 1).alias("none"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def fn_extract_unix_ts(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", dates.extract_unix_timestamp("ts").alias("seconds"))


@query("""
    SELECT event_id, time_bucket(INTERVAL 5 minute, ts) AS five, date_trunc('hour', ts) AS hour, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS days,
           CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS second_of_day, CAST((isodow(ts) - 1) AS INTEGER) AS weekday FROM events""")
def fn_epoch_floor(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", dates.floor_to("ts", 300).alias("five"), dates.floor_to("ts", 3600).alias("hour"), dates.days_since_epoch("ts").alias("days"), dates.second_of_day("ts").alias("second_of_day"), dates.day_of_week("ts").alias("weekday"))


@query("SELECT o_orderkey, CAST(o_orderkey + o_custkey AS BIGINT) AS total FROM orders")
def fn_java_method(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", reflection.java_method("java.lang.Math", "addExact", F.col("o_orderkey"), F.col("o_custkey")).cast("long").alias("total"))


@query("""
    SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'O') AS INTEGER) AS open_orders, CAST(sum(o_custkey) FILTER (o_orderstatus = 'F') AS BIGINT) AS filled_keys, count(DISTINCT o_orderstatus) AS kinds,
           CAST(count(*) FILTER (o_custkey % 4 = 1) AS INTEGER) AS ones, count(*) FILTER (CAST(o_orderdate AS DATE) = DATE '1996-01-02') AS on_day, sum(o_totalprice) FILTER (o_custkey % 4 = 3) AS price_of_threes
    FROM orders GROUP BY 1""")
def sql_value_maps(spark, sf_dir):
    """value_count and value_sum in GROUP BY: strings, nullable whole numbers and dates as keys, sums of whole numbers and doubles."""
    registry.register_all(spark)
    read(spark, sf_dir, "orders").createOrReplaceTempView("tidemill_orders")
    return spark.sql("""
        SELECT o_orderpriority, coalesce(try_element_at(value_count(o_orderstatus), 'O'), 0) AS open_orders, try_element_at(value_sum(o_orderstatus, o_custkey), 'F') AS filled_keys,
               CAST(map_size_or_minus1(value_count(o_orderstatus)) AS BIGINT) AS kinds, coalesce(try_element_at(value_count_bigint(nullif(o_custkey % 4, 0)), 1L), 0) AS ones,
               coalesce(try_element_at(value_count_wide_date(CAST(o_orderdate AS DATE)), DATE'1996-01-02'), 0L) AS on_day, try_element_at(value_sum_of_doubles_bigint(nullif(o_custkey % 4, 0), o_totalprice), 3L) AS price_of_threes
        FROM tidemill_orders GROUP BY o_orderpriority""")


@query("SELECT l_returnflag, CAST(nullif(l_linenumber % 4, 0) AS INTEGER) AS k, count(*) AS n FROM lineitem WHERE l_linenumber % 4 <> 0 GROUP BY ALL")
def sql_value_count_table(spark, sf_dir):
    """value_count as a table function: nullable INT keys stay INT; partial counts are taken before the shuffle."""
    registry.register_all(spark)
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("tidemill_lines")
    return spark.sql("""
        SELECT l_returnflag, k, n FROM value_count(TABLE(SELECT l_returnflag, nullif(l_linenumber % 4, 0) AS k, count(*) AS n FROM tidemill_lines GROUP BY ALL), 'l_returnflag', 'k', weight => 'n')
        LATERAL VIEW explode(counts) AS k, n""")


@query("""
    SELECT l_shipmode_like AS ship, k, round(sum(v), 2) AS total FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_like, nullif(l_quantity, 7) AS k, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS v FROM lineitem)
    WHERE k IS NOT NULL AND v IS NOT NULL GROUP BY ALL""")
def sql_value_sum_table(spark, sf_dir):
    """value_sum as a table function: DOUBLE keys and sums, pairs with nulls left out, sums by key before the shuffle."""
    registry.register_all(spark)
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("tidemill_lines")
    return spark.sql("""
        SELECT ship, k, round(total, 2) AS total FROM value_sum(TABLE(SELECT l_returnflag || l_linestatus AS ship, nullif(l_quantity, 7D) AS k, sum(CASE WHEN l_linenumber <> 2 THEN l_extendedprice END) AS v
                                                                   FROM tidemill_lines GROUP BY ALL), 'ship', 'k', 'v') LATERAL VIEW explode(sums) AS k, total""")


@query("SELECT user_id, event_type AS kind, count(*) AS n, count(*) AS places FROM events GROUP BY ALL")
def sql_multiset_table(spark, sf_dir):
    """A multiset from SQL and back: value_count as a table function, then posexplode, with elements as often as they count, side by side."""
    registry.register_all(spark)
    read(spark, sf_dir, "events").createOrReplaceTempView("tidemill_events")
    return spark.sql("""
        SELECT user_id, col AS kind, count(*) AS n, CAST(max(pos) - min(pos) + 1 AS BIGINT) AS places FROM multiset_posexplode(TABLE(
            SELECT user_id, counts FROM value_count(TABLE(SELECT user_id, event_type, count(*) AS n FROM tidemill_events GROUP BY ALL), 'user_id', 'event_type', weight => 'n')), 'counts') GROUP BY user_id, col""")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def sql_json_fields(spark, sf_dir):
    """A table function whose columns follow from a literal: named fields of JSON with their types."""
    registry.register_all(spark)
    read(spark, sf_dir, "events").createOrReplaceTempView("tidemill_events")
    return spark.sql("SELECT event_id, k, none FROM json_fields(TABLE(SELECT event_id, props FROM tidemill_events), 'props', 'k BIGINT, none STRING')")


@query("""
    SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, time_bucket(INTERVAL 5 minute, ts) AS five, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS days,
           CAST(len(string_split(event_type, '_')) AS INTEGER) AS parts, -1 AS none, CAST(CAST(ts AS DATE) + 3 AS DATE) AS later, event_type AS decoded FROM events""")
def sql_functions(spark, sf_dir):
    """The library's scalar functions by their SQL names."""
    registry.register_all(spark)
    read(spark, sf_dir, "events").createOrReplaceTempView("tidemill_events")
    return spark.sql("""SELECT event_id, extract_unix_timestamp(ts) AS seconds, floor_minutes(ts, 5) AS five, days_since_epoch(ts) AS days, array_size_or_minus1(split(event_type, '_')) AS parts,
                               array_size_or_minus1(NULL) AS none, add_days(CAST(CAST(ts AS DATE) AS STRING), 3) AS later, url_decode_or_same(event_type) AS decoded FROM tidemill_events""")


# ---- formats, sources and sinks ----


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def json_roundtrip(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = scratch(spark, "json")
    files.encode_lines(orders, "json").write.text(path)
    table = Table(orders.schema, {"connector": "filesystem", "format": "myjson", "path": path})
    return read_files(spark, table)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_roundtrip(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    path = scratch(spark, "csv")
    files.encode_lines(customers, "csv").write.text(path)
    return read_files(spark, Table(customers.schema, {"connector": "filesystem", "format": "csv", "path": path}))


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def orc_roundtrip(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    path = scratch(spark, "orc")
    files.write_orc(orders, path, ["o_orderstatus"])
    return read_files(spark, Table(orders.select("o_orderkey", "o_orderpriority").schema, {"connector": "filesystem", "format": "orc", "path": path}))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def compaction(spark, sf_dir):
    path, target = scratch(spark, "small"), scratch(spark, "large")
    read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").repartition(8).write.orc(path)
    files.compact(spark, path, target)
    return spark.read.orc(target)


@query("SELECT event_id, user_id, event_type FROM events")
def json_log_decode(spark, sf_dir):
    lines = formats.encode_json(read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), "user_id", "event_type"))
    return formats.decode_json(lines, "value", "event_id bigint, user_id bigint, event_type string", "flat")


@query("SELECT CAST(event_id AS VARCHAR) AS dt, event_type AS bs, user_id AS item_id, CAST(user_id % 7 AS INTEGER) AS item_type FROM events")
def protobuf_roundtrip(spark, sf_dir):
    fields = {1: "dt", 2: "bs", 9: "item_id", 10: "item_type"}
    rows = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("dt"), F.col("event_type").alias("bs"), F.col("user_id").alias("item_id"), (F.col("user_id") % 7).cast("int").alias("item_type"))
    return formats.decode_protobuf(formats.encode_protobuf(rows, fields), "value", fields)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY s_acctbal DESC) = 1")
def kv_table_upsert(spark, sf_dir):
    suppliers, path = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), scratch(spark, "kv")
    write = files.kv_writer(path, ["s_suppkey"], spark)
    write(suppliers.withColumn("s_acctbal", F.lit(0.0)), 0)
    write(suppliers, 1)
    return files.read_kv(spark, path, ["s_suppkey"])


@query("""
    SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) WHERE o_orderstatus <> 'F'""")
def kv_table_changes(spark, sf_dir):
    """Upserts and deletions in nine batches that come in no order: an order column guards the rows, runs are merged in levels."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_orderstatus") == "F").alias("gone"))
    table = KeyValueTable(spark, scratch(spark, "kv"), ["o_custkey"], order="o_orderkey", gone="gone")
    for number in range(9):
        table.write(orders.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(9)) == number), number)
    return table.read()


@query("""
    SELECT 1000 AS n, 0 AS strange_ids, true AS a_fifth_unnamed, 0 AS levels_outside, 20 AS levels, 0 AS scores_outside, 0 AS times_outside, 0 AS ages_outside, 0 AS without_data""")
def faker_scan(spark, sf_dir):
    """What drawn rows keep to: their number, ranges and share of nulls.  The draws themselves depend on the seed only."""
    options = {
        "number-of-rows": "1000", "fields.id.expression": "#{regexify '(1|2){1}'}", "fields.name.expression": "#{superhero.name}", "fields.name.null-rate": "0.2",
        "fields.level.expression": "#{number.numberBetween '0','20'}", "fields.score.expression": "#{number.numberBetween '60','100'}", "fields.at.expression": "#{date.past '15','5','SECONDS'}",
        "fields.data.name.expression": "#{harry_potter.spell}", "fields.data.age.expression": "#{number.numberBetween '20','30'}",
    }
    rows = faker.fake(spark, "id string, name string, level int, score double, at timestamp, data row<name string, age int>", options, 7, F.lit("2024-01-01").cast("timestamp"))
    outside = lambda c, name: F.coalesce(F.count_if(~F.coalesce(c, F.lit(False))), F.lit(0)).cast("int").alias(name)
    unnamed = F.count_if(F.col("name").isNull()) / F.count(F.lit(1))
    return rows.agg(
        F.count(F.lit(1)).cast("int").alias("n"), outside(F.col("id").isin("1", "2"), "strange_ids"), unnamed.between(0.15, 0.25).alias("a_fifth_unnamed"),
        outside(F.col("level").between(0, 19), "levels_outside"), F.count_distinct("level").cast("int").alias("levels"), outside(F.col("score").between(60, 100), "scores_outside"),
        outside(F.col("at").between(F.expr("timestamp'2023-12-31 23:59:44.9'"), F.expr("timestamp'2023-12-31 23:59:55.1'")), "times_outside"),
        outside(F.col("data.age").between(20, 29), "ages_outside"), outside(F.length("data.name") > 0, "without_data"),
    )


@query("SELECT CAST(p AS INTEGER) AS page_id, 1 AS cnt, CAST(1636300800 + i AS BIGINT) AS time_long FROM (SELECT 0 AS p, unnest(range(5000)) AS i)")
def datagen_sequence(spark, sf_dir):
    options = {"fields.page_id.min": "0", "fields.page_id.max": "0", "fields.cnt.min": "1", "fields.cnt.max": "1", "fields.time_long.kind": "sequence", "fields.time_long.start": "1636300800", "fields.time_long.end": "1636387200"}
    return faker.datagen(spark, "page_id int, cnt int, time_long bigint", options, 5000)


# ---- streams, run over all there is ----


@query("""
    SELECT * FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    WHERE window_start + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 5 second FROM events)""")
def stream_tumble_1h(spark, sf_dir):
    """Event-time windows of a stream in append mode: what the watermark has closed."""
    events = read(spark, sf_dir, "events").select("ts", "event_type", "value")
    path, name = scratch(spark, "events"), f"tumble_{uuid.uuid4().hex}"
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    stream = replay(spark, path, events.schema, files_per_trigger=1000)
    out = windows.tumble(stream, "ts", "1 hour", ["event_type"], "5 seconds", n=F.count(F.lit(1))).drop("window_end")
    sink = scratch(spark, name)
    files.exactly_once_files(out, sink, scratch(spark, "state"), "parquet", once=True).awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


@query("SELECT user_id, count(*) AS n, max(value) AS largest FROM events GROUP BY user_id")
def stream_group_updates(spark, sf_dir):
    """Unbounded groups in update mode, upserted into a key-value table."""
    from tidemill.sinks.batching import batching_sink

    events = read(spark, sf_dir, "events").select("user_id", "value")
    path, kv = scratch(spark, "events"), scratch(spark, "kv")
    events.repartition(3).write.parquet(path)
    counts = replay(spark, path, events.schema).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"))
    batching_sink(counts, files.kv_writer(kv, ["user_id"], spark), scratch(spark, "state"), once=True, mode="update").awaitTermination()
    return files.read_kv(spark, kv, ["user_id"])


@query("""
    SELECT * FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL)
    WHERE window_end <= (SELECT max(ts) - INTERVAL 5 second FROM events)""")
def watermark_drop(spark, sf_dir):
    """A stream that stops and, started again, finds all rows once more, thirty days late: the watermark drops them."""
    events = read(spark, sf_dir, "events").select("ts", "event_type")
    path, sink, state = (scratch(spark, name) for name in ("late", "late-out", "state"))
    late = events.withColumn("ts", F.col("ts") - F.expr("INTERVAL 30 DAYS"))
    for part in (events, late):
        part.repartitionByRange(4, "ts").write.mode("append").parquet(path)
        stream = replay(spark, path, events.schema, files_per_trigger=1000)
        out = windows.tumble(stream, "ts", "1 hour", ["event_type"], "5 seconds", n=F.count(F.lit(1)))
        files.exactly_once_files(out, sink, state, "parquet", once=True).awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


@contextmanager
def rocks(spark):
    """The library's state store, for operators that keep state of their own."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, SETTINGS[provider])
    try:
        yield
    finally:
        spark.conf.set(provider, before)


def run_once(spark, stream, name, **options):
    """Run a stream over what is there, into files; gives them as a table."""
    sink = scratch(spark, name)
    with rocks(spark):
        files.exactly_once_files(stream, sink, scratch(spark, "state"), "parquet", once=True, **options).awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


@query("SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, max(o_totalprice) AS largest, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY o_custkey")
def stream_group_changelog(spark, sf_dir):
    """The change log of a GROUP BY over a table that grows in four steps; replayed, it is the GROUP BY."""
    orders, path = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), scratch(spark, "orders")
    orders.repartitionByRange(4, "o_orderkey").write.option("parquet.block.size", BLOCK).parquet(path)
    log = changelog.group_changes(replay(spark, path, orders.schema, files_per_trigger=a_step(spark, path, 4)), ["o_custkey"], {"n": ("count", "*"), "keys": ("sum", "o_orderkey"), "largest": ("max", "o_totalprice"), "kinds": ("count_distinct", "o_orderstatus")})
    return changelog.replayed(run_once(spark, log, "changes"))


@query("""
    SELECT o_orderstatus, count(*) AS customers, max(o_totalprice) AS largest FROM
        (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) GROUP BY o_orderstatus""")
def stream_changelog_of_latest(spark, sf_dir):
    """Two chained operators: the latest order of each customer as a change log, and an aggregate that takes back what a later order replaces."""
    orders, path = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice"), scratch(spark, "orders")
    orders.repartition(4, "o_orderkey").write.parquet(path)
    latest = changelog.latest_changes(replay(spark, path, orders.schema), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    log = changelog.group_changes(latest, ["o_orderstatus"], {"customers": ("count", "*"), "largest": ("max", "o_totalprice")}, op="op")
    return changelog.replayed(run_once(spark, log, "changes"))


@query("""
    SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS largest, count(DISTINCT event_type) OVER w AS kinds FROM events
    WHERE ts <= (SELECT max(ts) - INTERVAL 5 second FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10 minute PRECEDING AND CURRENT ROW)""")
def stream_over_range(spark, sf_dir):
    """A rolling frame on event time, over a stream: what the watermark has passed.  Its state needs the library's state store."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    path = scratch(spark, "frames")
    events.repartitionByRange(4, "ts").write.parquet(path)
    stream = replay(spark, path, events.schema, files_per_trigger=1000)
    out = stateful.rolling_stream(stream, "user_id", "ts", 600, {"n": ("count", "*"), "largest": ("max", "value"), "kinds": ("count_distinct", "event_type")})
    rows = run_once(spark, out, "frames-out")
    return rows.select(F.get_json_object("row", "$.event_id").cast("long").alias("event_id"), "n", "largest", "kinds")


@query("""
    SELECT CASE WHEN a.c_custkey IS NULL THEN '+I' WHEN b.c_custkey IS NULL THEN '-D' ELSE u.op END AS op, coalesce(CASE WHEN u.op = '-U' OR b.c_custkey IS NULL THEN a.c_custkey ELSE b.c_custkey END, a.c_custkey) AS c_custkey,
           CASE WHEN a.c_custkey IS NULL THEN b.c_acctbal WHEN b.c_custkey IS NULL THEN a.c_acctbal WHEN u.op = '-U' THEN a.c_acctbal ELSE b.c_acctbal END AS c_acctbal
    FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0) a
    FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0) b ON a.c_custkey = b.c_custkey
    JOIN (SELECT unnest(['-U', '+U']) AS op) u ON (a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL AND a.c_acctbal <> b.c_acctbal) OR ((a.c_custkey IS NULL OR b.c_custkey IS NULL) AND u.op = '+U')""")
def table_changes(spark, sf_dir):
    """The change log between two states of a table, with both halves of updates."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    after = rows.where("c_custkey % 5 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return changes(rows.where("c_custkey % 3 <> 0"), after, ["c_custkey"])


@query("""
    WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events),
    facts AS (SELECT * FROM e WHERE event_type <> 'purchase'),
    versions AS (SELECT user_id, ms, arg_max(value, event_id) AS value FROM e WHERE event_type = 'purchase' GROUP BY user_id, ms),
    passed AS (SELECT least((SELECT max(ms) FROM facts), (SELECT max(ms) FROM versions)) - 5000 AS upto)
    SELECT f.event_id, f.user_id, v.ms AS since_ms, v.value AS held FROM (SELECT * FROM facts, passed WHERE ms <= upto) f ASOF LEFT JOIN versions v ON f.user_id = v.user_id AND f.ms >= v.ms""")
def stream_temporal_join(spark, sf_dir):
    """Every other event with the purchase of its user that was the latest at its own time: two streams, versions kept as state."""
    events, paths = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type"), []
    for name, rows in (("facts", events.where("event_type <> 'purchase'")), ("versions", events.where("event_type = 'purchase'"))):
        paths.append(scratch(spark, name))
        rows.repartitionByRange(4, "ts").write.parquet(paths[-1])
    facts, versions = (replay(spark, p, events.schema, files_per_trigger=1000) for p in paths)
    rows = run_once(spark, temporal.temporal_join(facts, versions, "user_id", "ts", "ts", seq="event_id"), "joined")
    return rows.select(F.get_json_object("row", "$.event_id").cast("long").alias("event_id"), "user_id", "since_ms", F.get_json_object("version", "$.value").cast("double").alias("held"))
