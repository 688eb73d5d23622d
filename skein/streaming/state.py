"""State of one session between micro-batches: open calls, the last event, and when they end.

These classes travel with the task; they use nothing of this package.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _ordered(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    parts = list(rows)
    df = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    return df if df[by].is_monotonic_increasing else df.sort_values(by, kind="stable", ignore_index=True)


def _plain(values: pd.Series) -> list:
    """Values as Python objects, None where there is none."""
    return values.astype(object).where(values.notna(), None).tolist() if values.hasnans else values.tolist()


class Pairing(StatefulProcessor):
    """Before-records wait per tool (map state); the last completed call is a value state.

    ``ttl_ms`` ends a wait: by event time with a timer per wait, which fires as the watermark
    passes it even if the session stays silent, or by processing time with the state's own TTL.
    """

    COLUMNS = ("session_id", "event_id", "parent_event_id", "tool_name", "tool_input", "tool_output", "timestamp", "duration_ms", "agent")

    def __init__(self, ttl_ms: int | None, by_event_time: bool):
        self.ttl_ms, self.by_event_time = ttl_ms, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        own = None if self.by_event_time else self.ttl_ms
        self.handle = handle
        self.last = handle.getValueState("last", "event_id string")
        self.open = handle.getMapState("open", "tool string", "arrived bigint, parent string", own)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session = key[0]
        df = _ordered(rows, "line_no")
        last = self.last.get()[0] if self.last.exists() else None
        waiting = {tool[0]: tuple(w) for tool, w in self.open.iterator()} if self.open.exists() else {}
        # Per tool the record before: is it a before-record, when it came, what was completed then.
        before = {tool: (True, arrived, parent) for tool, (arrived, parent) in waiting.items()}
        found, seen, begun = [], set(), last
        fields = ("hook_event_name", "line_no", "arrived_ms", "tool_name", "tool_input", "tool_output", "timestamp", "agent")
        for hook, line, arrived, tool, given, told, at, agent in zip(*(_plain(df[c]) for c in fields), strict=True):
            pre = hook == "PreToolUse"
            opened, since, parent = before.get(tool, (False, None, None))
            before[tool] = (pre, arrived, last)
            seen.add(tool)
            if pre or not opened:
                continue
            wait = None if arrived is None or since is None else float(arrived - since)
            if self.ttl_ms is None or (wait is not None and wait <= self.ttl_ms):
                last = f"{session}:{-1 if line is None else int(line)}"
                found.append((session, last, parent, tool, given, told, at, wait, agent))
        if last != begun:
            self.last.update((last,))
        for tool in seen:
            pre, arrived, parent = before[tool]
            if pre:
                self.open.updateValue((tool,), (None if arrived is None else int(arrived), parent))
                if self.by_event_time and self.ttl_ms is not None and arrived is not None:
                    self.handle.registerTimer(int(arrived) + self.ttl_ms)
            elif tool in waiting:
                self.open.removeKey((tool,))
        yield pd.DataFrame(found, columns=list(self.COLUMNS), dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        old = [tool for tool, (arrived, _) in self.open.iterator() if arrived + self.ttl_ms <= now]
        for tool in old:
            self.open.removeKey(tool)
        return iter([])

    def close(self) -> None:
        pass


class Chaining(StatefulProcessor):
    """The last event of a session is the parent of the next; ``idle_ms`` of silence ends the chain."""

    def __init__(self, columns: list[str], idle_ms: int | None):
        self.columns, self.idle_ms = columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "event_id string", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _ordered(rows, "ingest_seq")
        last = self.last.get()[0] if self.last.exists() else None
        before = df.event_id.shift()
        before.iloc[0] = last
        given = df.parent_event_id.where(df.parent_event_id.fillna("") != "")
        fresh = df.new_group.fillna(False).astype(bool)
        parent = given.where(given.notna() | fresh, before)
        self.last.update((df.event_id.iloc[-1],))
        yield df.assign(parent_event_id=parent.where(parent.notna(), None))[self.columns]

    def close(self) -> None:
        pass
