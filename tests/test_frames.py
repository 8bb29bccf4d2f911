"""Rolling frames against brute force, and what a row costs, with states kept in dicts."""

import json
import math
import random

from tidemill.streaming import stateful

ALL = {"n": ("count", "*"), "held": ("count", "v"), "kinds": ("count_distinct", "s"), "total": ("sum", "v"), "mean": ("avg", "v"), "whole": ("sum", "w"), "high": ("max", "v"), "low": ("min", "w"), "one": ("first", "s"), "end": ("last", "s"), "list": ("collect", "w"), "set": ("collect_distinct", "s"), "text": ("listagg", "s")}
KINDS = {"v": "double", "w": "bigint", "s": "string"}


class Map:
    def __init__(self, cost):
        self.held, self.cost = {}, cost

    def containsKey(self, k):  # noqa: N802
        self.cost[0] += 1
        return k in self.held

    def getValue(self, k):  # noqa: N802
        self.cost[0] += 1
        return self.held[k]

    def updateValue(self, k, v):  # noqa: N802
        self.cost[0] += 1
        self.held[k] = v

    def removeKey(self, k):  # noqa: N802
        self.cost[0] += 1
        del self.held[k]


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.cost = [0]
        self.maps = []

    def getMapState(self, *_):  # noqa: N802
        self.maps.append(Map(self.cost))
        return self.maps[-1]

    def getValueState(self, *_):  # noqa: N802
        return Value()


def brute(rows):
    of = lambda c: [r[c] for r in rows if r.get(c) is not None]
    v, w, s = of("v"), of("w"), of("s")
    total = math.fsum(v) if v else None
    return {"n": len(rows), "held": len(v), "kinds": len(set(s)), "total": total, "mean": total / len(v) if v else None, "whole": sum(w) if w else None, "high": max(v, default=None), "low": min(w, default=None), "one": s[0] if s else None, "end": s[-1] if s else None, "list": w, "set": list(dict.fromkeys(s)), "text": ",".join(s)}


def test_frames_match_brute_force():
    rng = random.Random(3)
    for span in (0, 1, 7, 60, 10**6):
        handle = Handle()
        frame, past, at = stateful._Frame(handle, ALL, KINDS), [], 0
        for _ in range(250):
            at += rng.choice([1, 1, 2, 5, 30])
            rows = [{k: x for k, x in (("v", rng.choice([None, rng.uniform(-1e9, 1e9), 0.1])), ("w", rng.choice([None, rng.randint(-(2**60), 2**60)])), ("s", rng.choice([None, "a", "b", "c"]))) if x is not None} for _ in range(rng.randint(1, 3))]
            frame.load()
            frame.drop(at - span)
            frame.add(at, [json.dumps(r) for r in rows])
            past = [(t, r) for t, r in past if t >= at - span] + [(at, r) for r in rows]
            assert frame.results() == brute([r for _, r in past])
            frame.save()
        frame.load()
        frame.drop(at + 1)
        frame.save()
        assert not frame.state.exists() and not any(m.held for m in handle.maps)


def test_a_row_costs_the_same_in_long_frames():
    costs = {}
    for span in (10, 1000):
        handle = Handle()
        frame = stateful._Frame(handle, {n: a for n, a in ALL.items() if stateful.FRAME_FUNCTIONS[a[0]][0] != "list"}, KINDS)
        for at in range(4000):
            frame.load()
            frame.drop(at - span)
            frame.add(at, [json.dumps({"v": at * 0.7 % 1, "w": at * 7919 % 1000, "s": str(at % 5)})])
            frame.results()
            frame.save()
        costs[span] = handle.cost[0] / 4000
    assert costs[1000] < 1.1 * costs[10] < 25


def test_times_that_come_and_go_between_load_and_save_cost_the_state_nothing():
    handle = Handle()
    frame = stateful._Frame(handle, ALL, KINDS)
    frame.load()
    for at in range(1000):
        frame.drop(at - 5)
        frame.add(at, [json.dumps({"v": at * 0.5, "w": at, "s": str(at % 3)})])
    frame.save()
    assert handle.cost[0] <= 20 and len(handle.maps[0].held) == 6
