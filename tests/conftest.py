import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortica.session import build_session, ensure_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=8, shuffle_partitions=4, memory="6g")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture()
def rows():
    """Collect a DataFrame as a list of plain tuples in a given column order."""
    def collect(df, *columns, order=None):
        out = [tuple(r[c] for c in columns) for r in df.collect()]
        return sorted(out, key=order or repr)
    return collect
