"""The temporal join with states kept in dicts: what a key's waiting rows cost."""

import pandas as pd

from tests.test_changelog_cost import Map
from tests.test_waiting import Handle as Lists
from tidemill.streaming import temporal


class Versions(Map):
    reads = 0

    def exists(self):
        return bool(self.held)

    def iterator(self):
        self.reads += 1
        return iter(self.held.items())


class Handle(Lists):
    def getMapState(self, *_):  # noqa: N802
        self.versions = Versions()
        return self.versions


class At:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


def test_all_rows_that_are_due_leave_together():
    handle, join = Handle(), temporal._AsOf("k", False, None)
    join.init(handle)
    rows = [(True, t, f"f{t}", 0, False) for t in range(1, 300)] + [(False, t, f"v{t}", 0, t == 200) for t in (100, 200, 250, 900)]
    join.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["fact", "time_ms", "row", "seq", "gone"])]), At(0))
    assert handle.timers == [1] and handle.set == 1
    handle.timers.clear()
    (out,) = join.handleExpiredTimer(("a",), At(290), None)
    want = [(t, f"f{t}", None if t < 100 or 200 <= t < 250 else 100 if t < 200 else 250) for t in range(1, 291)]
    assert [(r.time_ms, r.row, r.since_ms) for r in out.itertuples()] == want
    assert handle.versions.reads == 1 and sorted(handle.versions.held) == [(250,), (900,)] and handle.timers == [291]
