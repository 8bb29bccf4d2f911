import datetime as dt
import json
import random

import pytest

from tidemill.streaming import temporal
from tidemill.streaming.windows import collect_stream, replay

BASE = dt.datetime(2024, 1, 1)
MS = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp() * 1000)
FACTS, VERSIONS = "id int, k string, ts timestamp", "k string, since timestamp, v int, n int, gone boolean"


def at(s):
    return BASE + dt.timedelta(seconds=s)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def join(spark, folder):
    """Rows of both sides in so many batches; (id, since in seconds, v) of what leaves."""

    def run(name, batches, **options):
        for i, (facts, versions) in enumerate(batches):
            put(spark, f"{folder}/{name}-f", [(i_, k, at(s)) for i_, k, s in facts], FACTS)
            put(spark, f"{folder}/{name}-v", [(k, at(s), v, n, gone) for k, s, v, n, gone in versions], VERSIONS)
            out = temporal.temporal_join(replay(spark, f"{folder}/{name}-f", FACTS, files_per_trigger=100), replay(spark, f"{folder}/{name}-v", VERSIONS, files_per_trigger=100), "k", "ts", "since", **options)
            # One run after the other: each goes on from the checkpoint.
            query = out.writeStream.format("parquet").option("path", f"{folder}/{name}-o").option("checkpointLocation", f"{folder}/{name}-c").trigger(availableNow=True).start()
            query.awaitTermination()
        rows = spark.read.schema(out.schema).parquet(f"{folder}/{name}-o").collect()
        return sorted((json.loads(r.row)["id"], None if r.since_ms is None else (r.since_ms - MS) / 1000, json.loads(r.version)["v"] if r.version else None) for r in rows)

    return run


END = ([(99, "end", 900)], [("end", 901, 0, 0, False)])


def test_rows_meet_the_version_of_their_own_time(join):
    facts = [(1, "a", 5), (2, "a", 10), (3, "a", 19), (4, "a", 20), (5, "b", 50), (6, "c", 1), (7, None, 7)]
    versions = [("a", 10, 1, 0, False), ("a", 20, 2, 0, False), ("a", 20, 3, 1, False), ("b", 1, 9, 0, False), (None, 1, 8, 0, False)]
    want = [(1, None, None), (2, 10.0, 1), (3, 10.0, 1), (4, 20.0, 3), (5, 1.0, 9), (6, None, None), (7, None, None)]
    assert join("left", [(facts, versions), END], seq="n") == want
    assert join("inner", [(facts, versions), END], seq="n", how="inner") == [w for w in want if w[2] is not None]


def test_rows_wait_for_versions_that_come_after_them(join):
    # The second batch brings a version that held already when the first batch's row happened.
    assert join("wait", [([(1, "a", 100)], [("a", 10, 1, 0, False)]), ([(2, "a", 103)], [("a", 99, 2, 0, False)]), END]) == [(1, 99.0, 2), (2, 99.0, 2)]


def test_late_versions_serve_the_rows_that_still_come(join):
    first = ([(1, "a", 100), (9, "x", 200)], [("a", 10, 1, 0, False), ("x", 200, 0, 0, False)])
    # By now the watermark is at 195: row 1 has left.  The version of 50 is late, that of 5 is superseded, row 2 is late itself.
    second = ([(2, "a", 60), (3, "a", 300)], [("a", 50, 7, 0, False), ("a", 5, 8, 0, False)])
    assert join("late", [first, second, END]) == [(1, 10.0, 1), (3, 50.0, 7), (9, 200.0, 0)]


def test_deletions_and_limited_validity(join):
    batch = ([(1, "a", 15), (2, "a", 25), (3, "a", 45), (4, "b", 15), (5, "b", 31)], [("a", 10, 1, 0, False), ("a", 20, 1, 0, True), ("a", 40, 2, 0, False), ("b", 10, 5, 0, None)])
    assert join("gone", [batch, END], deleted="gone", valid_seconds=20) == [(1, 10.0, 1), (2, None, None), (3, 40.0, 2), (4, 10.0, 5), (5, None, None)]


def test_random_rows_match_brute_force(join):
    rng = random.Random(4)
    facts = [(i, rng.choice("abc"), rng.randint(0, 300)) for i in range(80)]
    versions = [(rng.choice("abc"), t, i, i, rng.random() < 0.2) for i, t in enumerate(rng.sample(range(300), 40))]
    want = []
    for i, k, s in facts:
        held = max(((t, v, gone) for kk, t, v, _, gone in versions if kk == k and t <= s), default=None)
        want.append((i, float(held[0]), held[1]) if held and not held[2] else (i, None, None))
    assert join("random", [(facts, versions), END], deleted="gone") == sorted(want)


def test_unknown_joins(spark):
    with pytest.raises(ValueError):
        temporal.temporal_join(spark.range(1), spark.range(1), "id", "id", "id", how="full")
