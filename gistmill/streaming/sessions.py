"""Sessions as streams with keyed state: who a session belongs to, windows of its messages, and windows dealt into jobs.

Each function gives a stream the same rows as its batch counterpart in ``operators.curation`` gives for the rows arrived so far, however the
stream is cut into batches; a restart goes on from the checkpoint.  State is a few numbers for each session, and the open window's ids.
Arrival order is kept by session only: within a batch by id, and between batches by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gistmill.operators.curation import JOB, WINDOW

IDENTITY = "session_id long, id long, user_id long, agent string, reason string"
WINDOWS = "queue string, session_id long, win long, n long, first_id long, last_id long, done long, reason string"
JOBS = f"{WINDOWS}, job long"


class _Identity(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "user_id long, agent string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("id", kind="stable")
        if not self.first.exists():
            self.first.update((int(batch.user_id.iloc[0]), str(batch.agent.iloc[0])))
        user, agent = self.first.get()
        reason = [None if u == user and a == agent else "other_user" if u != user else "other_agent" for u, a in zip(batch.user_id, batch.agent, strict=True)]
        yield batch.assign(reason=pd.Series(reason, index=batch.index, dtype="object"))[["session_id", "id", "user_id", "agent", "reason"]]

    def close(self) -> None:
        pass


def identified(events: DataFrame) -> DataFrame:
    """The events (session_id, id, user_id, agent) with ``reason``: what is other than the session said at first sight; null where all agrees."""
    keyed = events.select("session_id", "id", "user_id", "agent").groupBy("session_id")
    return keyed.transformWithStateInPandas(_Identity(), IDENTITY, "Append", "None")


class _Windows(StatefulProcessor):
    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "id long")
        self.next = handle.getValueState("next", "win long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ids = [r[0] for r in self.open.get()] if self.open.exists() else []
        win = self.next.get()[0] if self.next.exists() else 0
        out = []
        batch = pd.concat(list(rows)).sort_values("id", kind="stable")
        for at, closes, urgent in zip(batch.id.tolist(), batch.closes.tolist(), batch.urgent.tolist(), strict=True):
            if not closes:
                ids.append(at)
            reason = "closed" if closes else "full" if len(ids) == self.size else "remember" if urgent else None
            if reason and ids:
                out.append((key[0], key[1], win, len(ids), ids[0], ids[-1], at, reason))
                ids, win = [], win + 1
        self.open.clear()
        if ids:
            self.open.put([(i,) for i in ids])
        self.next.update((win,))
        if out:
            yield pd.DataFrame(out, columns=["queue", "session_id", "win", "n", "first_id", "last_id", "done", "reason"])

    def close(self) -> None:
        pass


def windows(events: DataFrame, size: int = WINDOW) -> DataFrame:
    """Windows of ``size`` messages of each session of events (queue, session_id, id, closes, urgent); earlier ones behind an urgent message, and what is open when the session closes."""
    keyed = events.select("queue", "session_id", "id", "closes", "urgent").groupBy("queue", "session_id")
    return keyed.transformWithStateInPandas(_Windows(size), WINDOWS, "Append", "None")


class _Jobs(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had = self.count.get()[0] if self.count.exists() else 0
        batch = pd.concat(list(rows)).sort_values(["done", "session_id", "win"], kind="stable")
        self.count.update((had + len(batch),))
        yield batch.assign(job=[(had + i) // self.most for i in range(len(batch))])

    def close(self) -> None:
        pass


def jobs(done: DataFrame, most: int = JOB) -> DataFrame:
    """The windows of a stream of windows with ``job``: ``most`` of a queue's windows, in the order in which they were done, to each."""
    return done.groupBy("queue").transformWithStateInPandas(_Jobs(most), JOBS, "Append", "None")
