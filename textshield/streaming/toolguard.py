"""The session part of the tool guard over a stream: the batch's transition function behind keyed state.

Order: the events of a micro-batch are taken in order of time and seq; one that comes in a later micro-batch than events
after it is judged when it comes, with its own time. A session's events of one micro-batch are held together, so the
source's limit for a micro-batch (maxFilesPerTrigger and the like) bounds what a hot session takes. State is one row for
each session: the calls of its last minute. With a timeout, sessions without events for that long are forgotten (a
tainted one never is).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textshield.operators import toolguard as G

STATE = T.StructType([T.StructField("micros", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("tainted", T.BooleanType()), T.StructField("source", T.StringType())])


def verdict_stream(assessed: DataFrame, config: G.ToolGuardConfig = G.ToolGuardConfig(), idle: str | None = None) -> DataFrame:
    """Verdicts of the calls of a streaming table of assessed events (toolguard.assess_events works on streams as it is)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        micros, keys, tainted, source = state.get if state.exists else ([], [], False, None)
        session = G.Session(deque(zip(micros, keys, strict=True)), tainted, source)
        if state.hasTimedOut:
            if not session.tainted:
                state.remove()
            return
        rows = [r for f in frames for r in f.itertuples(index=False)]
        out = []
        for r in sorted(rows, key=lambda r: (r.micros, r.seq)):
            own = [(f["category"], f["severity"], f["message"]) for f in (r.own if r.own is not None else [])]
            v = G.step(session, config, r.kind, int(r.micros), r.tool, r.risk, r.call_key, own, bool(r.injected))
            if v:
                out.append((key[0], int(r.seq), v[0], v[1], v[2], len(v[2])))
        state.update(([m for m, _ in session.calls], [k for _, k in session.calls], session.tainted, session.source))
        if idle and not session.tainted:
            state.setTimeoutDuration(idle)
        if out:
            yield pd.DataFrame(out, columns=G.VERDICT.names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return G.slim(assessed).groupBy("session_id").applyInPandasWithState(run, G.VERDICT, STATE, "append", timeout)
