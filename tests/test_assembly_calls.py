"""A window that comes at once is put together without asking the state for its chunks."""

import pandas as pd

from tracelake.streaming.chunks import Assembly


class State:
    def __init__(self):
        self.value, self.parts, self.asked = None, {}, 0

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        self.parts = {}

    def containsKey(self, k):
        self.asked += 1
        return k in self.parts

    def getValue(self, k):
        self.asked += 1
        return self.parts[k]

    def updateValue(self, k, v):
        self.parts[k] = v

    def iterator(self):
        self.asked += 1
        return iter(self.parts.items())


def test_few_questions():
    made, state = Assembly(False, None), State()
    made.known = made.parts = state
    rows = lambda *x: pd.DataFrame([(1, k, k == 4, [float(k)], 0) for k in x], columns=["epoch", "chunk_seq", "last", "values", "at_ms"])
    got = list(made.handleInputRows((7,), iter([rows(1, 0), rows(2, 0)]), None))
    assert state.asked == 0 and got[0]["values"][0] == [0.0, 1.0, 2.0] and not got[0]["complete"][0]
    got = list(made.handleInputRows((7,), iter([rows(4, 1, 3)]), None))
    assert got[0]["values"][0] == [0.0, 1.0, 2.0, 3.0, 4.0] and got[0]["complete"][0] and state.asked <= 4
