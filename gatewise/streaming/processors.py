"""Stateful processors: rows of a key are held until the watermark passes them, then folded in order."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gatewise.functions import machines as M


def set_timer(handle: StatefulProcessorHandle, at_us: int | None, timer_values) -> None:
    """Leave the key one timer, for the next thing due, or none. Rounded up to the millisecond."""
    at = None if at_us is None else max(-(-at_us // 1000), timer_values.getCurrentWatermarkInMs() + 1)
    armed = {t if isinstance(t, int) else int(t[0]) for t in handle.listTimers()}
    for old in armed - {at}:
        handle.deleteTimer(old)
    if at is not None and at not in armed:
        handle.registerTimer(at)


class HeldRows:
    """Rows (us, seq, body) of a key that wait for the watermark, as one compressed text for each hour of a batch. Hours are
    read one by one, so Python holds the rows of an hour and the texts of the others."""

    HOUR_US = 3_600_000_000

    def __init__(self, handle: StatefulProcessorHandle):
        self.texts = handle.getListState("held", "hour long, least long, body string")
        self.least: int | None = None  # time of the first row left by ``due``

    def _packed(self, rows: list) -> tuple[int, int, str]:
        return rows[0][0] // self.HOUR_US, min(r[0] for r in rows), base64.b64encode(zlib.compress(json.dumps(rows).encode(), 1)).decode()

    def add(self, rows: list) -> None:
        hours: dict[int, list] = {}
        for r in rows:
            hours.setdefault(r[0] // self.HOUR_US, []).append(r)
        if hours:
            self.texts.appendList([self._packed(part) for part in hours.values()])

    def due(self, passed: int) -> Iterator[list]:
        """Rows up to ``passed`` hour by hour, in order of (us, seq, body). Read to the end, what is due has gone."""
        hours: dict[int, list] = {}
        left, taken = [], False
        for text in self.texts.get():
            if text[1] <= passed:
                hours.setdefault(text[0], []).append(text[2])
            else:
                left.append(tuple(text))
        for hour in sorted(hours):
            rows = sorted(r for body in hours.pop(hour) for r in json.loads(zlib.decompress(base64.b64decode(body))))
            later = [r for r in rows if r[0] > passed]
            if later:
                left.append(self._packed(later))
            taken = True
            yield rows[: len(rows) - len(later)]
        self.least = min((text[1] for text in left), default=None)
        if taken:
            if left:
                self.texts.put(left)
            else:
                self.texts.clear()


class OrderedFold(StatefulProcessor):
    """Folds a key's rows by (ts, seq) with a step function of ``gatewise.functions.machines``.

    Input columns: the key, ``us`` (event time in microseconds), ``seq`` and the step's own fields.
    Late rows never arrive here: Spark drops what is older than the watermark. State is the rows not
    yet passed by the watermark plus one small JSON text per key; with ``idle_s`` the text goes once the
    watermark is that far past the key's last row.
    """

    def __init__(self, key: str, step, config: dict, fields: tuple[str, ...], columns: list[str], clock: bool, idle_s: float | None = None,
                 own: dict[str, dict] | None = None):
        self.key, self.step, self.config = key, step, config
        self.fields, self.columns, self.clock = fields, columns, clock
        self.own = own or {}  # settings of single keys
        self.idle_us = None if idle_s is None else round(idle_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "body string")
        self.held = HeldRows(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            fresh = []
            for r in pdf[["us", "seq", *self.fields]].itertuples(index=False):
                body = {}
                for name, v in zip(self.fields, r[2:]):
                    if hasattr(v, "tolist"):
                        v = v.tolist()
                    if isinstance(v, float) and v != v:
                        v = None
                    body[name] = v
                fresh.append((int(r[0]), int(r[1]), json.dumps(body)))
            self.held.add(fresh)
        yield from self._drain(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._drain(key, timerValues)

    def _drain(self, key, timerValues) -> Iterator[pd.DataFrame]:
        config = self.config | self.own.get(key[0], {})
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        stored = self.machine.get() if self.machine.exists() else None
        state, last = json.loads(stored[0]) if stored else (None, 0)
        moved = False
        for due in self.held.due(passed):
            out, state = self.step(state, [{"ts": us, "seq": seq, **json.loads(body)} for us, seq, body in due], config)
            last, moved = max(last, due[-1][0]), True
            yield from self._told(key, out)
        if self.clock and passed > 0 and (state or moved):
            out, state = self.step(state, [{"ts": passed, "kind": M.CLOCK, "loops": None}], config)
            moved = True
            yield from self._told(key, out)
        if moved:
            self.machine.update((json.dumps([state, last]),))
        left = self.held.least
        wake = [] if left is None else [left]
        if self.clock and state:
            if state["times"]:
                wake.append(state["times"][0] + config["max_us"])
            elif state["anchor"] is not None:
                wake.append(state["anchor"] + config["debounce_us"])
        if self.idle_us is not None and left is None and self.machine.exists():
            if passed >= last + self.idle_us:
                self.machine.clear()
            else:
                wake.append(last + self.idle_us)
        set_timer(self.handle, min(wake) if wake else None, timerValues)

    def _told(self, key, out: list) -> Iterator[pd.DataFrame]:
        if out:
            pdf = pd.DataFrame(out)
            pdf.insert(0, self.key, key[0])
            for c in self.columns:
                if c not in pdf:
                    pdf[c] = None
            yield pdf[self.columns].astype(object)


class LevelFold(StatefulProcessor):
    """Last known level of each loop after every row of a lane, for all rows of an hour together.

    Input columns: the key, ``us``, ``seq`` and for each loop ``level0``, ``level1``, ..: 1, 0, or -1 where the row does not
    tell. State is the rows not yet passed by the watermark, as one compressed block of numbers for each hour of a batch,
    and the present levels.
    """

    def __init__(self, key: str, n_loops: int):
        self.key, self.n_loops = key, n_loops

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getValueState("levels", "levels string")
        self.blocks = handle.getListState("blocks", "hour long, least long, body string")

    def _packed(self, rows: np.ndarray) -> tuple[int, int, str]:
        return int(rows[0, 0]) // HeldRows.HOUR_US, int(rows[:, 0].min()), base64.b64encode(zlib.compress(rows.tobytes(), 1)).decode()

    def _rows(self, body: str) -> np.ndarray:
        return np.frombuffer(zlib.decompress(base64.b64decode(body)), np.int64).reshape(-1, 2 + self.n_loops)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["us", "seq", *(f"level{i}" for i in range(self.n_loops))]
        for pdf in rows:
            fresh = np.stack([pdf[c].astype("int64").to_numpy() for c in names], axis=1)
            hour = fresh[:, 0] // HeldRows.HOUR_US
            order = np.argsort(hour, kind="stable")
            parts = np.split(fresh[order], np.flatnonzero(np.diff(hour[order])) + 1)
            if len(fresh):
                self.blocks.appendList([self._packed(part) for part in parts])
        yield from self._pass(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._pass(key, timerValues)

    def _pass(self, key, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        hours: dict[int, list[str]] = {}
        left, taken = [], False
        for block in self.blocks.get():
            if block[1] <= passed:
                hours.setdefault(block[0], []).append(block[2])
            else:
                left.append(tuple(block))
        stored = self.levels.get()[0] if self.levels.exists() else "0" * self.n_loops
        known = np.array([int(c) for c in stored], np.int64)
        for hour in sorted(hours):
            rows = np.concatenate([self._rows(body) for body in hours.pop(hour)])
            rows = rows[np.lexsort(rows.T[::-1])]
            n, taken = int(np.searchsorted(rows[:, 0], passed, "right")), True
            if n < len(rows):
                left.append(self._packed(rows[n:]))
            told = np.vstack([known, rows[:n, 2:]])
            at = np.maximum.accumulate(np.where(told >= 0, np.arange(n + 1)[:, None], 0), axis=0)
            told = np.take_along_axis(told, at, axis=0)
            known = told[-1]
            if n:
                text = np.ascontiguousarray((told[1:] + ord("0")).astype(np.uint8)).view(f"S{self.n_loops}").ravel().astype(str)
                yield pd.DataFrame({self.key: [key[0]] * n, "seq": rows[:n, 1], "vector": text.astype(object)})
        if taken:
            self.levels.update(("".join(map(str, known.tolist())),))
            if left:
                self.blocks.put(left)
            else:
                self.blocks.clear()
        set_timer(self.handle, min((block[1] for block in left), default=None), timerValues)


class DebounceTimers(StatefulProcessor):
    """One event-time timer per lane: armed when loop 0 engages, cancelled when it releases before the debounce is over.

    Input columns: the lane, ``us``, ``seq`` and ``on``. Rows wait until the watermark passes them and are then
    read in order; a timer that ran out before a row counts before it. State is the rows not yet passed, the present
    level and the time of the engagement that armed the timer.
    """

    def __init__(self, key: str, wait_us: int):
        self.key, self.wait_us = key, wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "level boolean, armed long")
        self.held = HeldRows(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.held.add([(int(us), int(seq), bool(on is True or on == 1)) for us, seq, on in pdf[["us", "seq", "on"]].itertuples(index=False)])
        yield from self._pass(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._pass(key, timerValues)

    def _pass(self, key, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        on, armed = self.level.get() if self.level.exists() else (False, None)
        for due in chain(self.held.due(passed), [[(passed, 0, None)]]):
            entries = []
            for us, _, level in due:
                if armed is not None and armed + self.wait_us <= us:
                    entries.append(armed)
                    armed = None
                if level is not None and level != on:  # without one: the watermark itself
                    on, armed = level, us if level else None
            if entries:
                yield pd.DataFrame({self.key: [key[0]] * len(entries), "engaged": entries}).astype(object)
        self.level.update((on, armed))
        left = self.held.least
        wake = ([] if left is None else [left]) + ([armed + self.wait_us] if armed is not None else [])
        set_timer(self.handle, min(wake) if wake else None, timerValues)
