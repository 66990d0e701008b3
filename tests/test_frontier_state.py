"""Calls of the state of a URL in the crawl frontier."""

import pandas as pd
import pytest

from websift.streaming import frontier as FR


class _State:
    def __init__(self, value=None):
        self.value, self.calls = value, []

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value


@pytest.mark.parametrize("value, at, calls", [(None, 5, ["exists", "update"]), ((5, None, None), 7, ["exists", "get"])])
def test_a_url_writes_its_state_only_when_changed(value, at, calls):
    p = FR.FrontierProcessor(1000)
    p.state = _State(value)
    list(p.handleInputRows(("u",), iter([pd.DataFrame({"at_ms": [at], "kind": [FR.FOUND]})]), None))
    assert p.state.calls == calls and p.state.value == (5, None, None)
