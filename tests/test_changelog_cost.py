"""Change logs with states kept in dicts: what a key costs, and long sets."""

import math
import random

import pandas as pd
from pyspark.sql import types as T

from tidemill.streaming import changelog


class Map:
    def __init__(self):
        self.held, self.calls = {}, 0

    def getValue(self, k):  # noqa: N802
        self.calls += 1
        return self.held.get(k)

    def updateValue(self, k, v):  # noqa: N802
        self.calls += 1
        self.held[k] = v

    def removeKey(self, k):  # noqa: N802
        self.calls += 1
        self.held.pop(k, None)


class Handle:
    def __init__(self):
        self.maps = []

    def getMapState(self, *_):  # noqa: N802
        self.maps.append(Map())
        return self.maps[-1]


def frame(keys, values, ops=None):
    out = pd.DataFrame({"key0": keys, "null_key0": [False] * len(keys), "value0": values, "null_value0": [False] * len(keys)})
    return out.assign(row_op=ops or ["+I"] * len(keys))


def given(processor, pdf):
    return [tuple(r) for out in processor.handleInputRows((0,), iter([pdf]), None) for r in out.itertuples(index=False)]


def test_the_latest_row_of_a_key_costs_one_read_and_one_write():
    handle, processor = Handle(), changelog._Latest(["k"], "key0 long", ["v"], ["v"], "v double", True)
    processor.init(handle)
    keys = list(range(500)) * 3
    assert given(processor, frame(keys, [float(i) for i in range(1500)])) == [("+I", k, 1000.0 + k) for k in range(500)]
    assert handle.maps[0].calls == 1000
    assert given(processor, frame([7, 8], [5000.0, 1.0])) == [("-U", 7, 1007.0), ("+U", 7, 5000.0)]
    assert handle.maps[0].calls == 1003


def group(aggregates, back):
    kinds = {"high": T.DoubleType(), "low": T.DoubleType(), "kinds": T.LongType(), "n": T.LongType(), "total": T.DoubleType()}
    handle, processor = Handle(), changelog._Group(["k"], "key0 long", aggregates, {"v": T.DoubleType()}, {c: kinds[c] for c in aggregates}, True, back)
    processor.init(handle)
    return handle, processor


def test_long_sets_are_dealt_over_parts_and_match_brute_force():
    handle, processor = group({"n": ("count", "*"), "low": ("min", "v"), "high": ("max", "v"), "kinds": ("count_distinct", "v"), "total": ("sum", "v")}, True)
    rng, held, log = random.Random(5), [], []
    for step in range(12):
        new = [math.nan if rng.random() < 0.01 else float(rng.randint(0, 4000)) for _ in range(900 if step < 8 else 0)]
        rng.shuffle(held)
        gone = [held.pop() for _ in range(min(len(held), 200 if step < 8 else 1500))]
        if step < 11 and held:  # the ends go, too
            gone.append(held.pop(held.index(max(held, key=lambda v: -1 if v != v else v))))
        held += new
        log += given(processor, frame([1] * (len(new) + len(gone)), new + gone, ["+I"] * len(new) + ["-D"] * len(gone)))
        if not held:
            break
        kinds, real = {str(v) for v in held}, [v for v in held if v == v]
        op, key, n, low, high, several, total = log[-1]
        assert (key, n, several) == (1, len(held), len(kinds))
        assert low == (min(real) if real else low) and (math.isnan(high) if len(real) < len(held) else high == max(real))
        assert math.isnan(total) if len(real) < len(held) else total == math.fsum(real)
        assert max(len(p[0]) for p in handle.maps[1].held.values()) <= 4 * changelog.PART
    given(processor, frame([1] * len(held), held, ["-D"] * len(held)))
    assert not handle.maps[0].held and not handle.maps[1].held
    assert {op for op, *_ in log} <= {"+I", "-U", "+U", "-D"}


def test_a_short_group_costs_one_read_and_one_write():
    handle, processor = group({"n": ("count", "*"), "high": ("max", "v"), "kinds": ("count_distinct", "v")}, False)
    keys = [i % 100 for i in range(700)]
    assert given(processor, frame(keys, [float(i) for i in range(700)])) == [("+I", k, 7, 600.0 + k, 7) for k in range(100)]
    assert handle.maps[0].calls == 200 and handle.maps[1].calls == 0
    assert given(processor, frame([3], [3.0])) == [("-U", 3, 7, 603.0, 7), ("+U", 3, 8, 603.0, 7)]
