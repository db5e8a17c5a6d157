"""Announcements of a bucket: the state's calls are counted, and random moves are held against a plain walk."""

import random
from types import SimpleNamespace

import pandas as pd

from notelake.streaming import stateful


class State:
    """Map states, timers and the clock of one key; every call of a state is counted."""

    def __init__(self):
        self.maps, self.timers, self.calls, self.now = {}, set(), 0, 0

    def getMapState(self, name, *_):  # noqa: N802
        kept = self.maps.setdefault(name, {})

        def counted(f):
            def call(*args):
                self.calls += 1
                return f(*args)

            return call

        return SimpleNamespace(exists=counted(lambda: bool(kept)), containsKey=counted(kept.__contains__), getValue=counted(kept.__getitem__), updateValue=counted(kept.__setitem__), removeKey=counted(kept.pop))

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def told(frames):
    return [(int(i), round(at.timestamp() * 1000)) for f in frames for i, at in zip(f["memory_id"], f["expired_at"], strict=True)]


def machine():
    state, m = State(), stateful._Expiry()
    m.init(state)
    return state, m


def test_what_is_over_costs_a_bucket_one_call():
    state, m = machine()
    state.now = 10_000
    rows = pd.DataFrame({"memory_id": range(5_000), "ends": range(5_000), "updated_at": range(5_000)})
    assert told(m.handleInputRows((0,), iter([rows[:2_000], rows[2_000:]]), state)) == [(i, i) for i in range(5_000)]
    assert state.calls == 1 and not state.timers and not any(state.maps.values())


def test_moves_and_timers_are_those_of_a_plain_walk():
    rnd, (state, m) = random.Random(5), machine()
    ends, got, want = {}, [], []
    for step in range(60):
        state.now = step * 10
        rows = [(rnd.randrange(25), state.now + rnd.randrange(-10, 60, 5), rnd.randrange(4), n) for n in range(rnd.randrange(1, 12))]
        got += told(m.handleInputRows((0,), iter([pd.DataFrame([r[:3] for r in rows], columns=["memory_id", "ends", "updated_at"])]), state))
        for i in {r[0] for r in rows}:
            at = max((r for r in rows if r[0] == i), key=lambda r: r[2:])[1]
            ends.pop(i, None)
            if at <= state.now:
                want.append((i, at))
            else:
                ends[i] = at
        assert state.timers == set(ends.values())
        for at in sorted(t for t in state.timers if t <= state.now + 5):
            state.timers.remove(at)
            got += told(m.handleExpiredTimer((0,), state, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)))
            want += [(i, at) for i in list(ends) if ends[i] == at and ends.pop(i)]
        assert {k[0]: v[0] for k, v in state.maps["ends"].items()} == ends
    assert sorted(got) == sorted(want) and len(got) > 100
