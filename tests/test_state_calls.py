"""How often a user's state is called in a batch: calls take longer than the work between them."""

import numpy as np
import pandas as pd

from wardspan.streaming import arrivals


class Calls:
    """A state in memory that counts what is asked of it."""

    def __init__(self):
        self.n, self.states = 0, {}

    def state(self, name, *_):
        return self.states.setdefault(name, State(self))

    getValueState = getMapState = state

    def registerTimer(self, _):
        self.n += 1

    deleteTimer = registerTimer

    def listTimers(self):
        self.n += 1
        return iter(())


class State:
    def __init__(self, calls):
        self.calls, self.kept = calls, {}

    def called(self):
        self.calls.n += 1

    def get(self):
        self.called()
        return self.kept.get(())

    def update(self, value):
        self.called()
        self.kept[()] = value

    def getValue(self, key):
        self.called()
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.called()
        self.kept[key] = value

    def removeKey(self, key):
        self.called()
        self.kept.pop(key, None)

    def iterator(self):
        self.called()
        return iter(list(self.kept.items()))


class Clock:
    getCurrentProcessingTimeInMs = getCurrentWatermarkInMs = lambda self: 0


def test_events_of_many_hours_and_values_take_few_calls():
    handle, n = Calls(), 300
    user = arrivals.UserHistory(["value"], 24, 500)
    user.init(handle)
    times = np.sort(np.random.default_rng(1).integers(0, 600 * arrivals.HOUR, 3 * n))
    counts = np.ones((3 * n, 2), np.int64)
    for k in range(3):
        part = slice(k * n, k * n + n)
        at = times[part]
        keys = {f"key_{kind}": [f"{kind}{i % 40}" for i in range(n)] for kind in arrivals.KINDS}
        rows = pd.DataFrame({"user": "u", "at": at, "tie": range(n), "event": "{}", "counts": list(counts[part]), "keys": [list(x) for x in zip(*keys.values())], "events": 1, "value": 1} | keys)
        out = pd.concat(user.handleInputRows(("u",), iter([rows.iloc[: n // 2], rows.iloc[n // 2 :]]), Clock()))
        inside = [x[-1] for x in out["told"]]
        assert inside == [int(((times >= t - 24 * arrivals.HOUR) & (times <= t)).sum()) for t in at]
    assert handle.n <= 3 * 12


def test_a_busy_hour_is_a_block_of_its_own():
    handle = Calls()
    user = arrivals.UserHistory([], 24, 500)
    user.init(handle)
    at = np.concatenate([np.arange(10) * arrivals.HOUR, 10 * arrivals.HOUR + np.arange(5000), np.arange(11, 20) * arrivals.HOUR])
    user.store(at, np.ones((len(at), 1), np.int64), {})
    assert sorted(k for (k,) in handle.states["hours"].kept) == [9, 10, 19]


def test_alerts_take_two_calls():
    handle, n = Calls(), 200
    state = arrivals.RecentAlerts(60 * 60_000_000, 1000)
    state.init(handle)
    rows = pd.DataFrame({"user": "u", "alert_type": "a", "severity": "High", "event_id": "1", "at": np.arange(n) * 10 * 60_000_000, "tie": 0, "is_change": False, "active": True, "alert_id": range(n)})
    fired = pd.concat(state.handleInputRows(("u", "a"), iter([rows]), Clock()))
    assert fired["alert_id"].tolist() == list(range(0, n, 7)) and handle.n <= 2


def test_a_users_numbers_and_keys_take_two_calls():
    handle = Calls()
    user = arrivals.UserHistory([], 24, 500)
    user.init(handle)
    for k in range(3):
        at = k * 100 * arrivals.HOUR + np.arange(20)
        rows = pd.DataFrame({"user": "u", "at": at, "tie": range(20), "event": "{}", "counts": [np.ones(1, np.int64)] * 20, "keys": [["a", "1", "US"]] * 20})
        before, out = handle.n, next(user.handleInputRows(("u",), iter([rows]), Clock()))
        assert [x[0] for x in out["told"]] == list(range(20 * k + 1, 20 * k + 21)) and sum(x[1] for x in out["told"]) == (k == 0)
        assert handle.n - before <= 6  # the total with the keys, two; blocks, their times and their timer, up to four


def test_alerts_of_many_users_share_a_state_and_are_apart():
    def rows_of(user, kind, minutes, first):
        at = np.array(minutes, np.int64) * 60_000_000
        return pd.DataFrame({"user": user, "alert_type": kind, "severity": "High", "event_id": "1", "at": at, "tie": 0, "is_change": False, "active": True, "alert_id": range(first, first + len(at))})

    class Later(Clock):
        getCurrentProcessingTimeInMs = lambda self: 2000

    handle = Calls()
    state = arrivals.RecentAlerts(60 * 60_000_000, 1000)
    state.init(handle)
    one = pd.concat([rows_of("u", "a", [0, 30, 61], 0), rows_of("v", "a", [10, 60], 10), rows_of("u", "b", [70], 20), rows_of(None, "a", [5, 6], 30)], ignore_index=True).sample(frac=1, random_state=1)
    fired = next(state.handleInputRows((7,), iter([one.reset_index(drop=True)]), Clock()))
    assert sorted(fired["alert_id"]) == [0, 2, 10, 20, 30] and handle.n == 2
    two = pd.concat([rows_of("u", "a", [100, 122], 3), rows_of("v", "a", [70, 71], 12)], ignore_index=True)
    two.loc[len(two)] = {"user": "u", "alert_type": "a", "at": 110 * 60_000_000, "tie": 0, "is_change": True, "active": False, "alert_id": 2}
    two.loc[len(two)] = {**rows_of("u", "a", [111], 5).iloc[0]}
    fired = next(state.handleInputRows((7,), iter([two]), Clock()))
    assert sorted(fired["alert_id"]) == [5, 13] and handle.n == 4
    assert next(state.handleInputRows((7,), iter([rows_of("u", "b", [71], 21)]), Later()))["alert_id"].tolist() == [21]  # what was idle is gone
    assert handle.states["alerts"].kept[()][3] == [21]
