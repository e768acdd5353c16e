"""Streaming forms of R1-R6: the same rows as the batch forms, from readStream.

Rows of a run must come in order over micro-batches (as a log does); inside one they may come in any. Forms in update mode give
a run's row again whenever it changes: the last one counts. A run that is silent for longer than ``ttl`` of event time has ended: its state leaves
the store, and what came later would start anew. Rows more than LATENESS behind the latest are late and dropped, as the watermark has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runs import MOVES, REOPEN, TERMINAL, agent_of, shortened, tokens_of

LATENESS = "1 hour"
#: Milliseconds of event time after which a silent run's state goes: 30 days.
TTL = 30 * 24 * 3600 * 1000


def _keyed(events: DataFrame, keys: list[str], fold: Callable, out: str, state: str, mode: str, ttl: int = TTL) -> DataFrame:
    """``fold(key, rows in order, state or None)`` gives the result's rows and the new state; ``events`` has created_at."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames))
        rows = rows.sort_values("seq" if "seq" in rows else ["created_at", "arrival"])
        result, new = fold(key, rows, held.get if held.exists else None)
        held.update(new)
        latest = int(rows["created_at"].max().timestamp() * 1000)
        held.setTimeoutTimestamp(max(latest, held.getCurrentWatermarkMs()) + ttl)
        yield result

    stamped = events.withWatermark("created_at", LATENESS)
    return stamped.groupBy(*keys).applyInPandasWithState(run, out, state, mode, GroupStateTimeout.EventTimeTimeout)


def _numbers(values: list) -> pd.Series:
    return pd.array([pd.NA if v is None else v for v in values], "Int64")


def sequence_events(events: DataFrame) -> DataFrame:
    """A counter per run in keyed state."""

    def number(key: tuple, rows: pd.DataFrame, state: tuple | None):
        n = state[0] if state else 0
        rows["seq"] = range(n, n + len(rows))
        return rows[["run_id", "arrival", "event_type", "step_id", "tokens", "created_at", "seq"]], (n + len(rows),)

    schema = "run_id string, arrival long, event_type string, step_id string, tokens long, created_at timestamp, seq long"
    return _keyed(events.select("run_id", "arrival", "event_type", "step_id", "tokens", "created_at"), ["run_id"], number, schema, "n long", "append")


def replay(events: DataFrame, after: int) -> DataFrame:
    """R2: events after a sequence number, each (run, seq) once within the watermark."""
    return events.where(F.col("seq") > after).withWatermark("created_at", LATENESS).dropDuplicatesWithinWatermark(["run_id", "seq"])


def run_status(events: DataFrame) -> DataFrame:
    """Keyed state per run: attempts, the last one's first terminal event and last move, agent, last seq, first error."""

    def fold(key: tuple, rows: pd.DataFrame, state: tuple | None):
        attempts, end, move, agent, last, error = state or (0, "", "", None, -1, -1)
        for row in rows.itertuples():
            if row.event_type in REOPEN:
                attempts, end, move = attempts + 1, "", ""
            if row.event_type in TERMINAL and not end:
                end = row.event_type
            if row.event_type in MOVES:
                move, agent = row.event_type, row.agent_ if isinstance(row.agent_, str) else None
            if row.event_type == "run_failed" and error < 0:
                error = row.seq
            last = max(last, row.seq)
        status = {"run_completed": "completed", "run_failed": "failed", "run_cancelled": "cancelled"}.get(end, "paused" if move == "run_paused" else "running")
        out = pd.DataFrame({"run_id": [key[0]], "status": [status], "current_agent": [agent], "attempts": [attempts], "last_seq": [last], "first_error_seq": _numbers([error if error >= 0 else None])})
        return out, (attempts, end, move, agent, last, error)

    rows = events.select("run_id", "seq", "event_type", "created_at", agent_of(events).alias("agent_"))
    schema = "run_id string, status string, current_agent string, attempts long, last_seq long, first_error_seq long"
    return _keyed(rows, ["run_id"], fold, schema, "attempts long, end string, move string, agent string, last long, error long", "update")


def pair_steps(events: DataFrame) -> DataFrame:
    """The open starts of a run's steps in its keyed state; a step's next event closes or replaces its own. All columns of the batch form.

    The key is the run, as in the other forms: a run has many steps of few events each. A closed step leaves the state.
    """

    def fold(key: tuple, rows: pd.DataFrame, state: tuple | None):
        opened = dict(zip(state[0], zip(*state[1:]))) if state else {}
        found = []
        for step, kind, seq, at, agent, error, summary in zip(*(rows[c].tolist() for c in ("step_id", "event_type", "seq", "micros", "agent_", "is_error", "summary"))):
            start = opened.pop(step, None)
            if kind == "agent_started":
                opened[step] = (seq, at, agent if isinstance(agent, str) else None)
            elif start is not None:
                found.append((*key, step, start[2], start[0], seq, at - start[1], bool(error), summary))
        held = [list(x) for x in zip(*((step, *start) for step, start in opened.items()))] or [[], [], [], []]
        return pd.DataFrame(found, columns=[c.split()[0] for c in PAIRED.split(", ")]), tuple(held)

    has = lambda c, otherwise: F.col(c) if c in events.columns else otherwise
    rows = events.where(F.col("event_type").isin("agent_started", "agent_completed") & F.col("step_id").isNotNull())
    rows = rows.select("run_id", "step_id", "event_type", "seq", "created_at", F.unix_micros("created_at").alias("micros"), agent_of(events).alias("agent_"), F.coalesce(has("is_error", F.lit(False)), F.lit(False)).alias("is_error"), shortened(has("summary", F.lit(None).cast("string"))).alias("summary"))
    return _keyed(rows, ["run_id"], fold, PAIRED, "steps array<string>, seqs array<long>, ats array<long>, agents array<string>", "append")


PAIRED = "run_id string, step_id string, agent string, start_seq long, end_seq long, duration_us long, is_error boolean, summary string"


def usage_totals(events: DataFrame, budget: int = 2_000_000, cumulative: bool = False) -> DataFrame:
    """Calls, tokens and the event at which the budget ran out, in keyed state per run; tokens as the batch form reads them."""

    def fold(key: tuple, rows: pd.DataFrame, state: tuple | None):
        calls, total, gone = state or (0, 0, -1)
        for row in rows.itertuples():
            if pd.notna(row.t_):
                calls, total = calls + 1, int(row.t_) + (0 if cumulative else total)
            if total > budget and gone < 0:
                gone = row.seq
        out = pd.DataFrame({"run_id": [key[0]], "calls": [calls], "total": _numbers([total if calls else None]), "exhausted_at": _numbers([gone if gone >= 0 else None])})
        return out, (calls, total, gone)

    rows = events.select("run_id", "seq", "created_at", tokens_of(events).alias("t_"))
    return _keyed(rows, ["run_id"], fold, "run_id string, calls long, total long, exhausted_at long", "calls long, total long, gone long", "update")


def stalled_runs(events: DataFrame, idle: int = 600, total: int = 3600) -> DataFrame:
    """Longest silence and length of each run, in keyed state."""

    def fold(key: tuple, rows: pd.DataFrame, state: tuple | None):
        low, high, last, gap = state or (None, None, None, None)
        for now in rows["second"]:
            now = int(now)
            if last is not None:
                gap = now - last if gap is None else max(gap, now - last)
            low, high, last = now if low is None else min(low, now), now if high is None else max(high, now), now
        out = pd.DataFrame({"run_id": [key[0]], "longest_gap": _numbers([gap]), "length": [high - low], "stalled": [(gap or 0) > idle], "overlong": [high - low > total]})
        return out, (low, high, last, gap)

    rows = events.select("run_id", "seq", "created_at", F.unix_seconds("created_at").alias("second"))
    return _keyed(rows, ["run_id"], fold, "run_id string, longest_gap long, length long, stalled boolean, overlong boolean", "low long, high long, last long, gap long", "update")
