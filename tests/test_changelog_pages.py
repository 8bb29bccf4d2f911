"""Change logs whose keys' states stand in pages, and rows that come packed."""

import math
import random
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_changelog_cost import Handle, frame
from tidemill.streaming import changelog
from tidemill.streaming.windows import collect_stream, replay


def paged(back):
    handle, kinds = Handle(), {"n": T.LongType(), "high": T.DoubleType()}
    processor = changelog._PagedGroup(["k"], "key0 double", {"n": ("count", "*"), "high": ("max", "v")}, {"v": T.DoubleType()}, kinds, True, back)
    processor.init(handle)
    return handle, processor


def given(processor, pdf):
    return [tuple(r) for out in processor.handleInputRows((0,), iter([pdf]), None) for r in out.itertuples(index=False)]


def test_many_keys_of_a_group_share_reads_and_writes():
    handle, processor = paged(False)
    keys = [float(i) for i in range(3000)]
    assert given(processor, frame(keys, keys)) == [("+I", k, 1, k) for k in keys]
    handle.maps[0].calls = 0
    assert len(given(processor, frame(keys, [5000.0] * 3000))) == 6000
    assert handle.maps[0].calls < 300  # two for each key before
    handle.maps[0].calls = 0
    assert given(processor, frame([7.0], [1.0])) == [("-U", 7.0, 2, 5000.0), ("+U", 7.0, 3, 5000.0)]
    assert handle.maps[0].calls == 3  # how many pages there are, the page, and the page again


def test_pages_match_brute_force_as_keys_come_and_go():
    handle, processor = paged(True)
    rng, held, log, table = random.Random(3), [], [], {}
    for step in range(14):
        keys = [math.nan if rng.random() < 0.01 else float(rng.randint(0, 900)) for _ in range(400 if step < 9 else 0)]
        new = [(k, float(rng.randint(0, 50))) for k in keys]
        rng.shuffle(held)
        gone = [held.pop() for _ in range(min(len(held), 100 if step < 9 else 900))]
        held += new
        log = given(processor, frame([k for k, _ in new + gone], [v for _, v in new + gone], ["+I"] * len(new) + ["-D"] * len(gone)))
        for op, key, *row in log:
            if op in ("+I", "+U"):
                table[str(key)] = tuple(row)
            elif op == "-D":
                assert table.pop(str(key)) == tuple(row)
            else:
                assert table[str(key)] == tuple(row)
        want = {}
        for k, v in held:
            want.setdefault(str(k), []).append(v)
        assert table == {k: (len(v), max(v)) for k, v in want.items()}
    assert not held and not handle.maps[0].held and not handle.maps[1].held


def test_packed_rows_are_the_rows():
    at = datetime(2024, 3, 31, 12, 0, 0, 5)
    rows = [(i % 3, 2**62 + i if i % 4 else None, [math.nan, -0.0, None, 1.5][i % 4], [None, "a", "ü"][i % 3], at + timedelta(days=i), i % 2 == 0) for i in range(40)]
    names = ["row_group", "key0", "value0", "value1", "value2", "value3"]
    types = [pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.timestamp("us", "Europe/Berlin"), pa.bool_()]
    arrays = [pa.array([r[i] for r in rows], t) if i != 4 else pa.compute.assume_timezone(pa.array([r[i] for r in rows], pa.timestamp("us")), "Europe/Berlin") for i, t in enumerate(types)]
    packed = pa.Table.from_batches(changelog._pack(iter(pa.Table.from_arrays(arrays, names).to_batches(7)))).to_pandas()
    assert packed["row_group"].tolist() == [0, 1, 2]
    for group, pdf in packed.groupby("row_group"):
        columns = changelog._columns([pdf], names[1:])
        assert repr(list(zip(*(columns[c] for c in names[1:])))) == repr([(*r[1:2], r[2] + 0.0 if r[2] is not None else None, *r[3:]) for r in rows if r[0] == group])


def test_states_by_key_give_the_same_table(spark, folder):
    schema = "g long, at timestamp, v double"
    for step in range(3):
        spark.range(step * 700, step * 700 + 1400, 1, 1).selectExpr("nullif(id % 1000, 7) as g", "timestamp_seconds(id % 90) as at", "if(id % 50 = 0, null, cast(id as double)) as v").write.mode("append").parquet(f"{folder}/in")
    tables = []
    for i, options in enumerate(({}, {"by_key": True}, {"groups": 3})):
        log = changelog.group_changes(replay(spark, f"{folder}/in", schema), ["g"], {"n": ("count", "*"), "last": ("max", "at"), "mean": ("avg", "v"), "kinds": ("count_distinct", "v")}, **options)
        collect_stream(log, f"pages_{i}", f"{folder}/check{i}").awaitTermination()
        tables.append(sorted((tuple(r) for r in changelog.replayed(spark.table(f"pages_{i}")).collect()), key=str))
    rows = spark.read.schema(schema).parquet(f"{folder}/in")
    want = rows.groupBy("g").agg(F.count("*"), F.max("at"), F.avg("v"), F.count_distinct("v")).collect()
    assert tables[0] == tables[1] == tables[2] == sorted((tuple(r) for r in want), key=str)


def test_a_table_grows_in_as_many_steps_however_many_files_it_has(spark, folder):
    from tidemill.plans.catalog import a_step

    for files, step in ((1, 1), (4, 1), (9, 3), (16, 4)):
        spark.range(0, 100, 1, files).write.parquet(f"{folder}/{files}")
        assert a_step(spark, f"{folder}/{files}", 4) == step
