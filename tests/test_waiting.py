"""Rows that wait for the watermark, with states kept in lists: one timer a key."""

from tidemill.streaming import stateful
from tests.test_frames import Value


class List:
    def __init__(self):
        self.held = []

    def exists(self):
        return bool(self.held)

    def get(self):
        return iter(self.held)

    def put(self, rows):
        self.held = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.held += rows

    def clear(self):
        self.held = []


class Handle:
    def __init__(self):
        self.timers, self.set = [], 0

    def getListState(self, *_):  # noqa: N802
        return List()

    def getValueState(self, *_):  # noqa: N802
        return Value()

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)
        self.set += 1

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def test_many_rows_set_one_timer_and_leave_by_time():
    handle = Handle()
    waiting = stateful.Waiting(handle)
    waiting.add([(at, str(at)) for at in range(500, 100, -1)])
    waiting.add([(50, "a"), (50, "b")])
    assert handle.timers == [50] and handle.set == 2
    handle.timers.clear()  # it has expired
    assert waiting.due(110) == [(50, ["a", "b"]), *((at, [str(at)]) for at in range(101, 111))]
    assert handle.timers == [111]
    handle.timers.clear()
    assert len(waiting.due(500)) == 390 and not handle.timers and not waiting.rows.exists()
