import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from litprops.session import local_session

    return local_session(cpus=int(os.environ.get("TEST_CPUS", "8")), memory="8g")


@pytest.fixture()
def heavy(monkeypatch):
    """Make every key above three rows a heavy one, so that small fixtures take the paths meant for hot keys."""
    from litprops.operators import baseline, graph, spread

    for module in (spread, baseline, graph):
        monkeypatch.setattr(module, "HEAVY_ROWS", 3)


def rows(df, *order):
    """Rows as plain tuples, ordered."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
