import pytest

from skein.operators.ordering import prepare
from skein.schema import conform_events
from skein.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make(spark):
    """Event table from {session: [(id, tool, parents), ...]} in recorded order."""

    def build(sessions):
        rows = []
        for sid, nodes in sessions.items():
            for i, (eid, tool, parents) in enumerate(nodes):
                rows.append((sid, eid, parents or None, tool, f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}", i))
        df = spark.createDataFrame(
            rows,
            "session_id string, event_id string, parent_event_id string, tool_name string, timestamp string, ingest_seq bigint",
        )
        return prepare(conform_events(df))

    return build
