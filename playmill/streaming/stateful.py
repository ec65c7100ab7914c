"""The validator over a stream with typed state: a value of counters, context and snapshot, and a value of patterns.

The state of a run is bounded (twenty plays, some fifty patterns) and lives in RocksDB, where the state data source
reads it back.  A call on state, a small frame and a cell of a row each cost as much as the fold of a play, so a variable
is read and written once a run and delivery, and plays and verdicts pass as JSON.  A run that has been silent for
``idle`` is forgotten by a timer; the variables also carry that as their time to live, so nothing outlives a lost timer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import fields

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from playmill.streaming.replay import PROVIDER, ROCKSDB
from playmill.streaming.validator import JUDGED, OUT, PLAYED, Limits, State, judged

SCALARS = [f.name for f in fields(State) if f.name not in ("patterns", "context", "snapshot", "words")]
KINDS = {"last_seq": "long", "ended": "boolean"}
#: Plays column by column, which is quicker to hand over than a row a play.
PLAYS = {"seq": "array<bigint>", "quarter": "array<int>", "seconds": "array<int>", "description": "array<string>"}
HELD = f"struct<{', '.join(f'{n}:{kind}' for n, kind in PLAYS.items())}>"
CONTEXT = ", ".join(f"{n} {KINDS.get(n, 'int')}" for n in SCALARS) + f", held {HELD}, snapshot {HELD}"
SAID = f"array<struct<{OUT.split(', ', 1)[1].replace(' ', ':').replace(',:', ', ')}>>"


def _columns(plays: list[list]) -> tuple[list, ...]:
    return tuple(map(list, zip(*plays))) if plays else tuple([] for _ in PLAYS)


def _rows(columns: Sequence[list]) -> list[list]:
    return [list(p) for p in zip(*columns)]


class ValidatorProcessor(StatefulProcessor):
    """Folds each run's plays, in the order of their seq inside a batch, over the state of earlier batches."""

    def __init__(self, limits: Limits, idle_ms: int | None):
        self.limits, self.idle = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.context = handle.getValueState("context", CONTEXT, self.idle)
        self.patterns = handle.getValueState("patterns", "held map<string, int>", self.idle)
        self.verdicts = Row("run_id", "said")

    def _loaded(self) -> State:
        kept = self.context.get()
        if kept is None:
            return State()
        (*counters, held, snapshot), seen = kept, self.patterns.get()
        return State(**dict(zip(SCALARS, counters)), patterns=dict(seen[0]) if seen else {}, context=_rows(held), snapshot=None if snapshot is None else _rows(snapshot))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s = self._loaded()
        seen = dict(s.patterns)
        plays = sorted(([play.get(c) for c in PLAYED] for play in (json.loads(r[1]) for r in rows)), key=lambda p: p[0])
        said = json.dumps([dict(zip(JUDGED, v)) for v in judged(plays, s, self.limits)])
        self.context.update((*[getattr(s, n) for n in SCALARS], _columns(s.context), None if s.snapshot is None else _columns(s.snapshot)))
        if s.patterns != seen:
            self.patterns.update((s.patterns,))
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        return iter([self.verdicts(key[0], said)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.context, self.patterns):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def validate_stream(plays: DataFrame, lim: Limits | None = None, idle: str | None = None) -> DataFrame:
    """Verdicts of a stream of plays; runs silent for ``idle`` ("2 hours") are forgotten.

    With ``idle`` a stream always asks for another batch, so it needs the trigger ``once`` or a steady one to end or rest.
    Typed state needs RocksDB, so the session's provider of state stores is set to it.
    """
    plays.sparkSession.conf.set(PROVIDER, ROCKSDB)
    pause = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    processor = ValidatorProcessor(lim or Limits(), pause)
    played = F.to_json(F.struct(*[c for c in PLAYED if c in plays.columns])).alias("play")
    said = plays.select("run_id", played).groupBy("run_id").transformWithState(processor, f"{OUT.split(', ')[0]}, said string", "append", "ProcessingTime" if pause else "None")
    return said.select("run_id", F.inline(F.from_json("said", SAID)))
