import os
import sqlite3
from collections import Counter

import pytest

from tidemill.sinks import transactional
from tidemill.streaming.windows import replay

SCHEMA = "id long, name string, score double"


@pytest.fixture
def base(spark, folder):
    path = f"{folder}/base.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE people (id BIGINT, name TEXT, score DOUBLE PRECISION)")
    con.commit()
    con.close()
    return path


def connecting(path):
    def connect():
        import sqlite3

        return sqlite3.connect(path, timeout=60)

    return connect


def rows_of(path, table="people"):
    con = sqlite3.connect(path)
    try:
        return Counter(con.execute(f"SELECT * FROM {table}").fetchall())
    finally:
        con.close()


def put(spark, folder, lo, hi):
    spark.range(lo, hi).selectExpr("id", "concat('n', id % 3) AS name", "id / 2 AS score").repartition(3).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, path, connect=None, **options):
    stream = replay(spark, f"{folder}/in", SCHEMA, files_per_trigger=2)
    transactional.epoch_sink(stream, connect or connecting(path), "people", f"{folder}/check", once=True, batch_size=7, **options).awaitTermination()


WANT = lambda lo, hi: Counter((i, f"n{i % 3}", i / 2) for i in range(lo, hi))


def test_rows_come_once_though_batches_are_run_again(spark, folder, base):
    put(spark, folder, 0, 40)
    run(spark, folder, base)
    assert rows_of(base) == WANT(0, 40)
    # A driver that was lost after the database had committed: Spark does not know of its last batches and runs them again.
    commits = f"{folder}/check/commits"
    for name in os.listdir(commits):
        if name.strip(".").split(".")[0].isdigit():
            os.remove(f"{commits}/{name}")
    put(spark, folder, 40, 50)
    run(spark, folder, base)
    assert rows_of(base) == WANT(0, 50)
    assert not rows_of(base, "people_staged") and [(q, e >= 2) for q, e in rows_of(base, "tidemill_epochs")] == [("people", True)]


def test_a_task_that_fails_half_way_leaves_nothing(spark, folder, base):
    put(spark, folder, 0, 60)
    flag = f"{folder}/failed"

    def failing():
        import os
        import sqlite3

        class Once(sqlite3.Connection):
            calls = 0

            def commit(self):
                super().commit()
                Once.calls += 1
                if Once.calls == 2 and not os.path.exists(flag):
                    open(flag, "w").close()
                    raise OSError("the connection is gone")

        return sqlite3.connect(base, timeout=60, factory=Once)

    with pytest.raises(Exception, match="gone"):
        run(spark, folder, base, failing)
    assert os.path.exists(flag)
    run(spark, folder, base)
    assert rows_of(base) == WANT(0, 60) and not rows_of(base, "people_staged")


def test_an_epoch_is_committed_once_and_staged_rows_of_others_stay_out(base):
    target = transactional.Target(connecting(base), "people", ["id", "name", "score"], ["BIGINT", "TEXT", "DOUBLE PRECISION"], "q")
    target.prepare()
    rows = [{"id": 1, "name": "a", "score": None}]
    assert target.stage(iter(rows), "t1") == 1 and target.stage(iter(rows * 2), "lost") == 2
    assert target.commit(0, ["t1"]) and rows_of(base) == Counter({(1, "a", None): 1})
    target.stage(iter(rows), "t2")
    assert not target.commit(0, ["t2"]) and rows_of(base) == Counter({(1, "a", None): 1}) and not rows_of(base, "people_staged")
    target.stage(iter(rows), "t3")
    assert target.commit(1, ["t3"]) and rows_of(base) == Counter({(1, "a", None): 2})


def test_unsupported_types(spark, folder):
    with pytest.raises(TypeError):
        transactional.epoch_sink(spark.range(1).selectExpr("array(id) AS a"), None, "people", folder)
