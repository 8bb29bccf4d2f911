import random

import pytest

from tidemill.sinks.keyvalue import KeyValueTable

SCHEMA = "k string, n int, v string, at long, gone boolean"


def test_updates_and_deletions_match_a_dict(spark, folder):
    rng = random.Random(2)
    for order in (None, "at"):
        table, want = KeyValueTable(spark, f"{folder}/{order}", ["k", "n"], order, "gone", fanout=3), {}
        for number in range(8):
            keys = rng.sample([(k, n) for k in ("a", "b", None) for n in range(4)], 5)
            rows = [(k, n, f"{number}-{k}", rng.randint(0, 20), rng.random() < 0.3) for k, n in keys]
            assert table.write(spark.createDataFrame(rows, SCHEMA), number)
            for k, n, v, at, gone in rows:
                held = want.get((k, n))
                if order is None or held is None or at >= held[1]:
                    want[k, n] = (v, at, gone)
        got = {(r.k, r.n): (r.v, r["at"]) for r in table.read().collect()}
        assert got == {key: (v, at) for key, (v, at, gone) in want.items() if not gone}
        assert len(table.manifest()["runs"]) <= 2 * 3  # no more than two of each of the levels 0 to 2


def test_a_batch_counts_once_and_readers_keep_their_version(spark, folder):
    table = KeyValueTable(spark, f"{folder}/t", ["k"])
    frame = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    with pytest.raises(ValueError):
        table.read()
    assert table.write(frame((1, "a"), (2, "b")), 0) and not table.write(frame((1, "again")), 0)
    before = table.read()
    assert table.write(frame((1, "c"), (None, "n")), 5) and not table.write(frame((1, "old")), 3)
    assert sorted((r.k, r.v) for r in before.collect()) == [(1, "a"), (2, "b")]
    assert sorted(((r.k, r.v) for r in table.read().collect()), key=str) == [(1, "c"), (2, "b"), (None, "n")]
    assert sorted((r.k, r.v) for r in table.read(version=1).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        table.write(spark.createDataFrame([(1,)], "k int"), 6)
    with pytest.raises(RuntimeError):
        table._publish({"version": 2, "batch": 9, "runs": [], "schema": None})


def test_runs_that_cannot_hold_a_key_are_not_opened(spark, folder, monkeypatch):
    table = KeyValueTable(spark, f"{folder}/t", ["k"], fanout=10)
    for i in range(4):
        table.write(spark.createDataFrame([(10 * i + j, f"v{i}") for j in range(5)], "k long, v string"), i)
    opened = []
    inner = KeyValueTable._read
    monkeypatch.setattr(KeyValueTable, "_read", lambda self, runs, schema: opened.append(len(runs)) or inner(self, runs, schema))
    assert sorted(r.k for r in table.read(12, 21).collect()) == [12, 13, 14, 20, 21]
    assert table.read(5, 9).collect() == [] and table.read(low=33).count() == 2 and table.read().count() == 20
    assert opened == [2, 1, 4]


def test_old_versions_and_their_runs_go(spark, folder):
    import os

    table = KeyValueTable(spark, f"{folder}/t", ["k"], fanout=2)
    for i in range(7):
        table.write(spark.createDataFrame([(i % 3, i)], "k int, v int"), i)
    assert table.versions() == [5, 6, 7]
    runs = {r["name"] for v in table.versions() for r in table.manifest(v)["runs"]}
    assert {n for n in os.listdir(f"{folder}/t") if n.startswith("run-")} == runs
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(0, 6), (1, 4), (2, 5)]
