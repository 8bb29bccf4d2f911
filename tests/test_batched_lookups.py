import io
import json

import pytest
from pyspark.sql import functions as F

from tidemill.sources import lookups
from tidemill.sources.lookups import FoundCache, Many, find_all, kv_lookup


def counted(folder):
    """A client that notes how many keys each request asks for; odd keys are found."""
    path = f"{folder}/asked"

    def start():
        def many(keys):
            with open(path, "a") as f:
                f.write(f"{len(keys)}\n")
            return {k: {"name": f"n{k}"} for k in keys if k % 2}

        return Many(many)

    return path, start


def test_distinct_keys_are_asked_for_together(spark, folder):
    path, client = counted(folder)
    left = spark.range(1000).select(F.when(F.col("id") % 10 < 9, F.col("id") % 100).alias("k")).coalesce(1)
    out = kv_lookup(left, "k", client, "name string", batch_size=40)
    rows = out.collect()
    assert len(rows) == 1000 and {(r.k, r.name) for r in rows} == {(k, f"n{k}" if k % 2 else None) for k in range(100) if k % 10 < 9} | {(None, None)}
    asked = [int(x) for x in open(path)]
    assert sum(asked) == 90 and len(asked) == 3 and max(asked) <= 40
    assert kv_lookup(left, "k", client, "name string", inner=True).count() == sum(r.name is not None for r in rows)


def test_a_worker_keeps_what_it_has_found_for_its_later_tasks(spark, folder):
    path, client = counted(folder)
    left = spark.range(0, 200, 1, 1).select((F.col("id") % 50 * 2 + 1).alias("k"))
    out = kv_lookup(left, "k", client, "name string")
    for _ in range(3):
        assert out.where("name is null").count() == 0
    asked = [int(x) for x in open(path)]
    assert 50 <= sum(asked) < 150  # one worker asks once; there may be two


def test_find_all_asks_only_for_what_the_cache_has_not():
    asked, cache = [], FoundCache(100, 10)
    find = Many(lambda keys: asked.append(list(keys)) or {k: {"v": k} for k in keys if k != 7})
    assert find_all([1, None, 2, 1, 7], find, cache, 2, None) == {1: {"v": 1}, 2: {"v": 2}, 7: None}
    assert find_all([2, 7, 8], find, cache, 2, None) == {2: {"v": 2}, 7: None, 8: {"v": 8}}
    assert asked == [[1, 2], [7], [7, 8]] and find(9) == {"v": 9}
    single = []
    assert find_all(["a", "a", "b"], lambda k: single.append(k) or {"v": k}, FoundCache(), 5, None)["a"] == {"v": "a"} and single == ["a", "b"]


def test_documents_come_with_one_request(monkeypatch):
    bodies = []

    def opener(request, timeout):
        bodies.append((request.full_url, json.loads(request.data)))
        return io.BytesIO(json.dumps({"docs": [{"_id": "1", "found": True, "_source": {"v": 5}}, {"_id": "2", "found": False}]}).encode())

    inner = lookups.RestClient
    monkeypatch.setattr(lookups, "RestClient", lambda hosts, **auth: inner(hosts, opener=opener, **auth))
    find = lookups.document_client(["http://one"], "people")()
    assert find.many([1, 2]) == {1: {"v": 5}} and find(1) == {"v": 5}
    assert bodies[0] == ("http://one/people/_mget", {"ids": ["1", "2"]})


def test_bounds_are_checked(spark):
    with pytest.raises(ValueError):
        kv_lookup(spark.range(1), "id", lambda: None, "v int", batch_size=0)
