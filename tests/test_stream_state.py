"""State of streams is exchanged with the store once a group, not once a row."""

from types import SimpleNamespace

import pandas as pd
import pytest

from pulseframe.streaming import retract, timeouts

START_US = 1_704_067_200_000_000


class _Handle:
    """A state store that counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        pytest.fail("a map is asked for each of its keys")

    def _count(self):
        self.calls += 1

    def get(self):
        self._count()
        return self.value

    def exists(self):
        self._count()
        return self.value is not None

    def update(self, value):
        self._count()
        self.value = value

    def clear(self):
        self._count()
        self.value = None

    def listTimers(self):
        self._count()
        return iter(list(self.timers))

    def registerTimer(self, at):
        self._count()
        self.timers.add(at)

    def deleteTimer(self, at):
        self._count()
        self.timers.discard(at)


def _at(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def _started(processor):
    handle = _Handle()
    processor.init(handle)
    return handle


def _rows(frames):
    return [r for f in frames for r in f.itertuples(index=False)]


def test_uploads_of_a_shard_are_read_and_written_once():
    uploads = timeouts._Uploads(300, 1_000)
    handle = _started(uploads)
    reports = lambda *rows: iter([pd.DataFrame(rows, columns=["task_id", "status", "at"])])
    starts = reports(*((f"t{i}", "pending", START_US + i) for i in range(500)))
    assert _rows(uploads.handleInputRows((0,), starts, _at(0))) == []
    assert handle.calls <= 3 and handle.timers == {START_US // 1_000 + 300_000}
    handle.calls = 0
    ends = reports(*((f"t{i}", "completed", START_US + 5_000_000) for i in range(499)))
    out = _rows(uploads.handleInputRows((0,), ends, _at(0)))
    assert {r.task_id for r in out} == {f"t{i}" for i in range(499)} and {r.status for r in out} == {"completed"}
    assert handle.calls <= 5
    # the last one times out, and all are forgotten at last
    late = START_US // 1_000 + 301_000
    assert [tuple(r) for r in _rows(uploads.handleExpiredTimer((0,), _at(late), None))] == [("t499", "timeout", START_US + 499, 300_000_000)]
    assert _rows(uploads.handleExpiredTimer((0,), _at(late + 10_000), None)) == []
    assert handle.value is None


def test_versions_of_a_shard_are_read_and_written_once():
    samples = retract._Samples()
    handle = _started(samples)
    versions = lambda *rows: iter([pd.DataFrame(
        [("u", f"s{i}", n, START_US + i, "steps", value, dead) for i, n, value, dead in rows],
        columns=["user_id", "hk_uuid", "ordinal", "at", "metric_type", "value", "dead"])])
    all_of_them = [(i, 1, 1.0, False) for i in range(500)]
    first = _rows(samples.handleInputRows((0,), versions(*all_of_them), _at(0)))
    assert [r.sign for r in first] == [1] * 500 and handle.calls <= 3
    handle.calls = 0
    assert _rows(samples.handleInputRows((0,), versions(*all_of_them), _at(0))) == []
    again = _rows(samples.handleInputRows((0,), versions((3, 2, 4.0, False), (4, 2, 1.0, True)), _at(0)))
    assert [(r.sign, r.value) for r in again] == [(-1, 1.0), (1, 4.0), (-1, 1.0)] and handle.calls <= 4
    cut = (START_US + 300) // 1_000 + 1
    assert _rows(samples.handleExpiredTimer((0,), _at(cut), None)) == [] and handle.value is None
