"""State of vehicles that are taken in groups."""

import pandas as pd

from roadpulse.streaming.processors import FateProcessor, ThinProcessor


class _List:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)


class _Handle:
    def __init__(self):
        self.lists = _List()

    def getListState(self, name, schema, ttl=None):
        return self.lists


def test_vehicles_of_a_group_keep_marks_of_their_own():
    """Two vehicles in one call, over two batches; rows without a vehicle are a vehicle of their own."""
    handle, columns = _Handle(), ["event_id", "suid", "utc"]
    fates = FateProcessor(columns)
    fates.init(handle)
    batch = lambda *rows: [pd.DataFrame(list(rows), columns=columns)]
    told = lambda key, rows: {r.event_id: (r.fate, None if pd.isna(r.seen) else r.seen) for out in fates.handleInputRows((key,), rows, None) for r in out.itertuples()}
    assert told(7, batch((1, 5, 100), (2, 6, 10), (3, 5, 104), (4, 6, 20))) == {
        1: ("kept", None), 2: ("kept", None), 3: ("thinned", 100), 4: ("kept", 10)}
    assert told(7, batch((5, 6, 50), (6, 5, 90), (7, 5, 115))) == {5: ("kept", 20), 6: ("out_of_order", 104), 7: ("kept", 104)}
    handle.lists.rows = []
    assert told(None, batch((8, None, 10), (9, None, 12))) == {8: ("kept", None), 9: ("thinned", 10)}
    assert handle.lists.rows == [(None, 10, 12)]


def test_vehicles_of_a_group_are_thinned_on_their_own():
    handle, columns = _Handle(), ["event_id", "suid", "utc"]
    thin = ThinProcessor(columns)
    thin.init(handle)
    kept = lambda key, *rows: sorted(i for out in thin.handleInputRows((key,), [pd.DataFrame(list(rows), columns=columns)], None) for i in out["event_id"])
    assert kept(7, (1, 5, 100), (2, 6, 10), (3, 5, 104), (4, 6, 20)) == [1, 2, 4]
    assert kept(7, (5, 6, 29), (6, 5, 90), (7, 5, 110), (8, 8, 1)) == [7, 8]
    handle.lists.rows = []
    assert kept(None, (9, None, 10), (10, None, 12)) == [9]
