import time

import pytest

from tidemill.sources import replay


@pytest.fixture
def lines(folder):
    import os

    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/a.txt", "wb") as f:
        f.write("".join(f"a{i}\n" for i in range(300)).encode() + "\n\r\nä😀\r\nlast of a".encode())
    with open(f"{folder}/in/b.txt", "wb") as f:
        f.write(b"b0\n" + b"x" * 200_000 + b"\nb2\n")
    open(f"{folder}/in/_SUCCESS", "w").close()
    return f"{folder}/in", [*(f"a{i}" for i in range(300)), "ä😀", "last of a", "b0", "x" * 200_000, "b2"]


def test_lines_from_any_place(lines):
    path, want = lines
    every = list(replay.lines_from(path, replay.START, 2, None))
    assert [x for x, _ in every] == want * 2 and [o["rows"] for _, o in every] == list(range(1, 2 * len(want) + 1))
    for i in (0, 1, 299, 300, 301, 302, 303, len(want) - 1, len(want), len(every) - 1):
        rest = list(replay.lines_from(path, every[i][1], 2, None))
        assert rest == every[i + 1 :]
    assert [x for x, _ in replay.lines_from(path, every[1][1], None, 5)] == ["a2", "a3", "a4"]
    with pytest.raises(FileNotFoundError):
        list(replay.lines_from(path + "/none", replay.START, 1, None))


def test_nothing_to_replay_ends(tmp_path):
    (tmp_path / "empty.txt").write_text("\n\n")
    assert list(replay.lines_from(str(tmp_path), replay.START, None, None)) == []


def test_a_restarted_replay_goes_on_at_its_line(spark, folder, lines):
    path, want = lines
    start = lambda: replay.replay_lines(spark, path, 25, cycles=1).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").start()
    found = lambda: [r.value for r in spark.read.schema("value string").parquet(f"{folder}/out").collect()]
    n = []
    for share in (0.2, 1):
        query = start()
        try:
            end = time.time() + 60
            while time.time() < end:
                time.sleep(0.3)
                if query.lastProgress and len(found()) >= share * len(want):
                    break
        finally:
            query.stop()
        n.append(len(found()))
    assert 0 < n[0] < n[1] == len(want)
    assert sorted(found()) == sorted(want)
