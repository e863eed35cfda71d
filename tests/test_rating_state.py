"""State of streamed ratings: what it says after many batches, and how many calls it takes."""

import datetime as dt
import random

import pandas as pd

from reelsift.streaming import jobs


class State:
    """Stands for a value, a list or a map of the handle, and counts the calls."""

    def __init__(self):
        self.rows, self.calls = None, 0

    def exists(self):
        return self.rows is not None

    def get(self):
        return iter(self.rows) if isinstance(self.rows, list) else self.rows

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def appendList(self, rows):  # noqa: N802
        self.calls, self.rows = self.calls + 1, [*(self.rows or []), *rows]

    def update(self, row):
        self.calls, self.rows = self.calls + 1, row

    def clear(self):
        self.calls, self.rows = self.calls + 1, None


class Handle:
    def __init__(self):
        self.states = []

    def getListState(self, *_):  # noqa: N802
        self.states.append(State())
        return self.states[-1]

    getValueState = getListState  # noqa: N815


def test_latest_of_many_batches_by_few_calls():
    r, seen, gone, handle = random.Random(5), {}, set(), Handle()
    processor = jobs.LatestRating()
    processor.init(handle)
    for n in range(80):
        rows = []
        for _ in range(r.randrange(1, 60)):
            e, at = r.randrange(400), None if r.random() < 0.05 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(200))
            undone, other = dt.datetime(2024, 2, 1) if r.random() < 0.3 else None, r.randrange(400) if r.random() < 0.4 and n > 40 else None
            rows.append((e, 7, r.choice("abc") if r.random() < 0.9 else None, at, undone, other))
            seen[e] = (jobs.OLDEST if at is None else int(pd.Timestamp(at).value // 1000), e, rows[-1][2], undone)
            gone |= {other} - {None}
        frame = pd.DataFrame(rows, columns=["event_id", "target_id", "rating", "created_at", "undone_at", "supersedes_event_id"]).astype({"created_at": "datetime64[ns]", "undone_at": "datetime64[ns]", "supersedes_event_id": "float64"})
        got = pd.concat(processor.handleInputRows((7,), iter([frame.iloc[:9], frame.iloc[9:]]), None))
        want = max((x[:2] for x in seen.values() if x[3] is None and x[1] not in gone), default=None)
        assert got["late"].tolist() == [False]
        assert (got["event_id"].isna().all() if want is None else got["event_id"].tolist() == [want[1]] and got["rating"].fillna("").tolist() == [seen[want[1]][2] or ""])
    assert sum(s.calls for s in handle.states) <= 2 * 80
    assert all(len(s.rows or []) <= 33 for s in handle.states)
