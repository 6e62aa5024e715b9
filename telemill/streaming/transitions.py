"""Transitions and step counts on streams.

Steps follow each other by number, whatever the distance, as in the batch operators. A stream can tell which step comes next once
the watermark has passed it; the state holds only steps that still wait for that.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from telemill.functions.timegrid import micros

BLOCK = 10_000  # step numbers of an episode that share a state

# what the first stage tells: a step with its successor (or none), a block's first and newest step, a step nothing followed in its block
DONE, HEAD, TAIL, EXPIRED = range(4)
# the workers that keep the state need not have this module on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINKS = -(1 << 63)  # the second stage's part for messages between blocks; no block has that number


def _values(row) -> tuple:
    """A nested row's values; workers are handed such rows in more than one form."""
    return tuple(row.values()) if isinstance(row, dict) else tuple(row)


class _Blocks(StatefulProcessor):
    """Pairs the steps of one block of an episode, and reports the block's edges.

    The state has a row per run of steps that follow each other without a gap and are done: its first step and the number and time up to which
    it goes, by which steps that come again are known; and a row per step that still waits for the one after it.
    """

    def __init__(self, gap: int, held: StructType, ahead: list[int]):
        self.gap, self.held, self.ahead = gap, held, ahead

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.held)
        self.edges = handle.getValueState("edges", "head boolean, tail bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._settled(key, [(r["_step"], r["_us"], False, _values(r["_row"]), r["_step"], r["_us"]) for r in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settled(key, [], timerValues)

    def close(self) -> None:
        pass

    def _settled(self, key, new: list[tuple], timers) -> Iterator[Row]:
        block = key[1]

        def told(kind, step, us, row, after=(None, None)):
            return Row(_kind=kind, _episode=key[0], _part=block if kind == DONE else LINKS, _step=step, _us=us, _row=row, _next=after[0], _next_us=after[1])

        if block is None:  # steps without a number have no place in the order
            yield from (told(DONE, None, us, row) for _, us, _, row, _, _ in new)
            return
        mark = timers.getCurrentWatermarkInMs() * 1000
        before = [(step, us, done, _values(row), through, until) for step, us, done, row, through, until in self.waiting.get()] if self.waiting.exists() else []
        before.sort()
        if before and new:  # of a step that came before the first row counts
            first = [e[0] for e in before]
            at = lambda step: before[max(bisect_right(first, step) - 1, 0)]
            new = [e for e in new if not at(e[0])[0] <= e[0] <= at(e[0])[4]]
        known = {e[0]: e for e in (*new, *before)}
        steps = [known[s] for s in sorted(known)]
        head, tail = self.edges.get() if self.edges.exists() else (False, None)
        out, kept, newest = [], [], None
        for k, (step, us, done, row, through, until) in enumerate(steps):
            after = steps[k + 1] if k + 1 < len(steps) else None
            final = us <= mark  # no earlier step can come any more
            over = us + self.gap <= mark  # nor any later one that is near enough
            if not done and after is not None and (after[0] == step + 1 or after[1] <= mark or over):
                out.append(told(DONE, step, us, row, self._next(after[3], after[1], us)))
                done = True
            if final:
                newest = (step, us, row, done)
                if not head:
                    out.append(told(HEAD, step, us, row))
                    head = True
            if over and after is None and not done:
                out.append(told(EXPIRED, step, us, row))
            elif done and kept and kept[-1][2] and kept[-1][4] + 1 == step:  # the run goes on
                kept[-1] = (*kept[-1][:4], through, until)
            else:
                kept.append((step, us, done, row, through, until))
        # numbers of a run are known until none of them can come again
        kept = [e for e in kept if not (e[2] and e[5] <= mark)]
        if newest is not None and not newest[3] and newest[0] != tail:
            out.append(told(TAIL, *newest[:3]))
            tail = newest[0]
        if kept:
            self.waiting.put(kept)
            self.edges.update((head, tail))
            due = min(us if us > mark else until if done else us + self.gap for _, us, done, _, _, until in kept)
            due = -(-due // 1000)
            # a timer that has run out is still listed while it is handled
            if not any(mark < t * 1000 <= due * 1000 for t in self.handle.listTimers()):
                self.handle.registerTimer(due)
        elif before:
            self.waiting.clear()
            self.edges.clear()
        yield from out

    def _next(self, row: tuple, us: int, since: int) -> tuple:
        return (tuple(row[i] for i in self.ahead), us) if us - since <= self.gap else (None, None)


class _Links(StatefulProcessor):
    """Pairs a block's newest step with the first step of the next block that has any; rows that are done pass through."""

    def __init__(self, gap: int, held: StructType, ahead: list[int]):
        self.gap, self.held, self.ahead = gap, held, ahead

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", self.held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[1] != LINKS:
            yield from (Row(_row=_values(r["_row"]), _us=r["_us"], _next=None if r["_next"] is None else _values(r["_next"]), _next_us=r["_next_us"]) for r in rows)
            return
        last = self.last.get() if self.last.exists() else None
        last = last and (*last[:3], _values(last[3]))
        # what ran out does so only after all firsts and newest steps of the batch are known
        for r in sorted(rows, key=lambda r: (r["_kind"] == EXPIRED, r["_step"], r["_kind"])):
            kind, step, us = r["_kind"], r["_step"], r["_us"]
            if kind == TAIL:
                last = (step, us, False, _values(r["_row"]))
            elif kind == HEAD:
                if last is not None and not last[2] and step > last[0]:
                    near = us - last[1] <= self.gap
                    row = _values(r["_row"])
                    yield Row(_row=last[3], _us=last[1], _next=tuple(row[i] for i in self.ahead) if near else None, _next_us=us if near else None)
                    last = (*last[:2], True, last[3])
            elif last is not None and last[0] == step:
                if not last[2]:
                    yield Row(_row=last[3], _us=last[1], _next=None, _next_us=None)
                last = None
        if last is not None:
            self.last.update(last)
        elif self.last.exists():
            self.last.clear()

    def close(self) -> None:
        pass


def _followed(steps: DataFrame, columns: Sequence[str], max_gap: str, delay: str, ts: str, block: int) -> DataFrame:
    """``(_row, _us, _next, _next_us)``: every step with ``columns`` of the one after it, or with NULL when none came within ``max_gap``.

    The time travels as a number beside the other columns, whose conversion is the greater part of the work.
    """
    row = StructType([f for f in steps.schema.fields if f.name != ts])
    ahead = [row.fieldNames().index(c) for c in columns if c != ts] or [row.fieldNames().index("step")]
    gap = micros(max_gap)
    packed = steps.withWatermark(ts, delay).select(
        F.col("episode").alias("_episode"), F.expr(f"(step - pmod(step, {block}L)) div {block}L").alias("_block"), ts,
        F.col("step").cast("bigint").alias("_step"), F.unix_micros(ts).alias("_us"), F.struct(*row.fieldNames()).alias("_row"),
    )
    held = StructType.fromDDL("step bigint, us bigint, done boolean").add("row", row)
    runs = StructType([*held.fields, *StructType.fromDDL("through bigint, until bigint").fields])
    both = StructType().add("_row", row).add("_us", "long").add("_next", StructType([row.fields[i] for i in ahead])).add("_next_us", "long")
    told = StructType.fromDDL("_kind int").add("_episode", steps.schema["episode"].dataType).add("_part", "long").add("_step", "long")
    told = StructType([*told.fields, both["_us"], both["_row"], both["_next"], both["_next_us"]])
    blocks = packed.groupBy("_episode", "_block").transformWithState(_Blocks(gap, runs, ahead), told, "Append", "EventTime")
    return blocks.groupBy("_episode", "_part").transformWithState(_Links(gap, held, ahead), both, "Append", "None")


def _step_columns(steps: DataFrame, ts: str) -> list[Column]:
    return [F.timestamp_micros("_us").alias(ts) if c == ts else F.col(f"_row.{c}") for c in steps.columns]


def stream_transitions(
    steps: DataFrame, columns: Sequence[str], max_gap: str, delay: str = "5 minutes", ts: str = "ts", block: int = BLOCK
) -> DataFrame:
    """Each step with ``next_<column>`` of the step after it, in any order of arrival and across missing numbers.

    ``steps`` is a stream ``(episode, step, ts, ...)`` in which later steps have later times; of a step that comes twice one row
    counts. The state is kept per episode and block of step numbers, so a very long episode is spread over tasks; a block
    hands its newest step on to the next one that has any. A pair leaves at once when the numbers follow each other in a block, else when the
    watermark has passed the later step. Steps wait until the watermark has passed ``max_gap`` after them; then they
    are forgotten and ``stream_unpaired_steps`` reports them. Needs the RocksDB state store.
    """
    found = _followed(steps, columns, max_gap, delay, ts, block).where(F.col("_next").isNotNull())
    following = [(F.timestamp_micros("_next_us") if c == ts else F.col(f"_next.{c}")).alias(f"next_{c}") for c in columns]
    return found.select(*_step_columns(steps, ts), *following)


def stream_unpaired_steps(steps: DataFrame, max_gap: str, delay: str = "5 minutes", ts: str = "ts", block: int = BLOCK) -> DataFrame:
    """Steps that ``stream_transitions`` leaves out: no later one came within ``max_gap``, or they have no number.

    A step is reported once the watermark has passed ``max_gap`` after it; an episode's last step is one of them.
    """
    return _followed(steps, [], max_gap, delay, ts, block).where(F.col("_next").isNull()).select(*_step_columns(steps, ts))


def stream_step_counts(steps: DataFrame, delay: str = "5 minutes", ts: str = "ts", width: str = "1 day") -> DataFrame:
    """Running number of steps per episode and ``width`` of time ``(episode, since, steps)``, for update mode.

    Counts are combined before the shuffle. The state of a width is dropped once the watermark has passed it: its count is final then, and later steps
    for it are late. ``sinks.latest_counts`` adds them up to running totals per episode.
    """
    return steps.withWatermark(ts, delay).groupBy("episode", F.window(ts, width).alias("_w")).agg(F.count("*").alias("steps")).select(
        "episode", F.col("_w.start").alias("since"), "steps"
    )
