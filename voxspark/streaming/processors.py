"""Stateful processors: typed state, as a record, lists and maps of a key.

A processor asks a handle for its states.  In transformWithState that is the store, asked entry by entry; GroupHandle
holds the states of one group, which come and go with its rows (applyInPandasWithState), so that
many small groups cost no calls to the store of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.audio import Segmenter
from ..operators.segments import SeamFold

PREVIEW_LEAST_MS, PREVIEW_VOICED_MS, PREVIEW_SILENCE_MS = 300, 400, 320
SEGMENT = "session_id long, kind string, seg_idx long, start_sample long, end_sample long, forced boolean"
_NAMES = ["session_id", "kind", "seg_idx", "start_sample", "end_sample", "forced"]
#: Of the open segment; due is the number of the next chunk, pending the decodes that haven't come back.
_OPEN = "rate int, open long, begin long, seg_idx long, voiced long, silence long, peak double, carry array<float>, due long, previewed long, pending int, ended boolean, timer long"
_CHUNK = "rate int, samples array<float>, stop boolean, abort boolean, decoded boolean"


def _typed(schema: str) -> str:
    return schema.replace(", ", ",").replace(" ", ":")


#: The same in one row, for applyInPandasWithState.
SEGMENT_STATE = f"record struct<{_typed(_OPEN)}>, windows array<struct<start:long,rms:double>>, early array<struct<chunk_idx:long,{_typed(_CHUNK)}>>, timer long"


class Held:
    """A value, list or map of one group, in memory while its rows are handled."""

    def __init__(self, v=None) -> None:
        self.v = v

    def exists(self) -> bool:
        return bool(self.v)

    def get(self):
        return self.v

    def update(self, v: tuple) -> None:
        self.v = v

    def clear(self) -> None:
        self.v = None

    def appendList(self, v: list) -> None:
        self.v = [*(self.v or ()), *v]

    def getValue(self, key: tuple):
        return (self.v or {}).get(key)

    def updateValue(self, key: tuple, v: tuple) -> None:
        self.v = self.v or {}
        self.v[key] = v

    def removeKey(self, key: tuple) -> None:
        del self.v[key]

    def iterator(self):
        return iter((self.v or {}).items())


class HeldList(Held):
    def get(self) -> Iterator:
        return iter(self.v or ())


class GroupHandle:
    """The states of one group, by names in the columns of its GroupState (maps are lists of entries), and its timer in the last one."""

    def __init__(self, group, names: list[str]) -> None:
        self.group, self.names = group, names
        *values, self.timer = group.get if group.exists else [None] * (len(names) + 1)
        self.loaded, self.states = dict(zip(names, values, strict=True)), {}

    def _state(self, name: str, of=lambda v: v, held: type[Held] = Held) -> Held:
        v = self.loaded[name]
        return self.states.setdefault(name, held(None if v is None else of(v)))

    def getValueState(self, name: str, schema: str, ttl: int | None = None) -> Held:
        return self._state(name)

    def getListState(self, name: str, schema: str, ttl: int | None = None) -> Held:
        return self._state(name, list, HeldList)

    def getMapState(self, name: str, key: str, schema: str, ttl: int | None = None) -> Held:
        return self._state(name, lambda v: {(e[0],): tuple(e[1:]) for e in v})

    def registerTimer(self, at: int) -> None:
        self.timer = at

    def deleteTimer(self, at: int) -> None:
        self.timer = None

    def getExpiryTimeInMs(self) -> int:
        return self.timer

    def getCurrentWatermarkInMs(self) -> int:
        return self.group.getCurrentWatermarkMs()

    def save(self) -> None:
        values = []
        for name in self.names:
            v = self.states[name].v or None
            values.append([(*k, *e) for k, e in v.items()] if isinstance(v, dict) else v)
        if any(v is not None for v in values):
            self.group.update((*values, self.timer))
            if self.timer:
                self.group.setTimeoutTimestamp(max(self.timer, self.getCurrentWatermarkInMs() + 1))
        elif self.group.exists:
            self.group.remove()


def group_handler(processor: StatefulProcessor, names: list[str], ttl_ms: int | None = None):
    """The processor as a function of applyInPandasWithState; ttl_ms: a state goes so long after its last rows."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut and ttl_ms:
            group.remove()
            return
        handle = GroupHandle(group, names)
        processor.init(handle)
        if group.hasTimedOut:
            yield from processor.handleExpiredTimer(key, handle, handle)
        else:
            yield from processor.handleInputRows(key, rows, handle)
        handle.save()
        if ttl_ms:
            group.setTimeoutDuration(ttl_ms)

    return run


def _flag(row: tuple, at: int) -> bool:
    return at < len(row) and row[at] is not None and bool(row[at])


class SegmentProcessor(StatefulProcessor):
    """One session's chunks to closed segments, previews and its end.

    State: counters of the open segment (a value), its window energies (a list that grows by a
    chunk's windows, 28 s of them at most), and chunks that came before their turn (a map by number).
    A stop row closes the tail and gives a row of kind "stop"; an abort row drops what is open and gives
    nothing; where the watermark passes the last row by idle_ms, what waits is taken in order, gaps or not, the tail
    closes, and a row of kind "idle" comes out.  Rows of a session that has ended are left out as long as its record
    is kept: until that time with idle_ms, else for good.
    """

    def __init__(self, idle_ms: int | None, preview_ms: int | None) -> None:
        self.idle_ms, self.preview_ms = idle_ms, preview_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", _OPEN)
        self.windows = handle.getListState("windows", "start long, rms double")
        self.early = handle.getMapState("early", "chunk_idx long", _CHUNK)

    def _load(self) -> None:
        self.due = self.previewed = self.pending = self.timer = self.stored = 0
        self.ended, self.s = False, None
        if (r := self.record.get() if self.record.exists() else None) is not None:
            rate, open_, begin, index, voiced, silence, peak, carry, self.due, self.previewed, self.pending, self.ended, self.timer = r
            if rate and not self.ended:
                self.s = s = Segmenter(rate)
                s.open, s.begin, s.index, s.voiced, s.silence, s.peak = open_, begin, index, voiced, silence, peak
                s.carry, s.seen = np.asarray(carry, np.float32), [(a, e) for a, e in self.windows.get()]
                self.stored = len(s.seen)

    def _save(self) -> None:
        s = self.s
        if self.ended or s is None:
            self.windows.clear()
            record = (s.rate if s else 0, 0, 0, 0, 0, 0, 0.0, [], self.due, 0, 0, self.ended, self.timer)
        else:
            if self.stored < 0:  # a segment has closed
                self.windows.clear()
                self.stored = 0
            if len(s.seen) > self.stored:
                self.windows.appendList(s.seen[self.stored:])
            record = (s.rate, s.open, s.begin, s.index, s.voiced, s.silence, float(s.peak), s.carry.tolist(), self.due, self.previewed, self.pending, False, self.timer)
        self.record.update(record)

    def _take(self, chunk: tuple) -> list[tuple]:
        """Rows that one chunk in its turn gives."""
        rate, samples, *flags = chunk
        self.s = s = self.s or Segmenter(rate)
        if _flag(flags, 1):
            self.ended = True
            return []
        out: list[tuple] = []
        if _flag(flags, 2):
            self.pending = max(0, self.pending - 1)
        if samples is not None and len(samples):
            closed = s.push(np.asarray(samples, np.float32))
            out = [("segment", *c) for c in closed]
            if closed or s.open < self.previewed or len(s.seen) < self.stored:
                self.previewed = 0
            if s.begin != self.began:  # closed, or dropped as without voice
                self.began, self.stored, self.previewed = s.begin, -1, 0
            self.pending += len(closed)
            if self.preview_ms and not closed and self.pending == 0 and s.voiced >= PREVIEW_VOICED_MS and s.silence < PREVIEW_SILENCE_MS:
                if (s.open - self.previewed) / s.rate * 1000 >= max(PREVIEW_LEAST_MS, self.preview_ms):
                    out.append(("preview", s.index, s.begin, s.begin + s.open, False))
                    self.previewed, self.pending = s.open, self.pending + self.waits
        if _flag(flags, 0):
            out += self._end("stop")
        return out

    def _end(self, kind: str) -> list[tuple]:
        s, self.ended = self.s, True
        out = [("segment", *c) for c in s.finish()]
        return [*out, (kind, s.index, None, s.begin + s.open, None)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        came, last, out = {}, 0, []
        self.waits = 0
        for pdf in rows:
            self.waits = int("decoded" in pdf)
            decoded = pdf["decoded"] if self.waits else [None] * len(pdf)
            came |= {int(r.chunk_idx): (int(r.sample_rate), r.samples, r.stop, r.abort, d) for r, d in zip(pdf.itertuples(), decoded, strict=True)}
            if self.idle_ms is not None:
                last = max(last, int(pdf["ts"].max().timestamp() * 1000))
        self.began = self.s.begin if self.s else 0
        waiting = self.early.exists()
        while not self.ended:
            chunk = came.pop(self.due, None)
            if chunk is None and waiting and (chunk := self.early.getValue((self.due,))) is not None:
                self.early.removeKey((self.due,))
            if chunk is None:
                break
            self.due += 1
            out += self._take(chunk)
        if self.ended:
            self.early.clear()
        else:
            if not self.waits or not self.preview_ms:
                self.pending = 0
            for k, (rate, x, *flags) in came.items():
                if k > self.due:
                    self.early.updateValue((k,), (rate, None if x is None else [float(v) for v in x], *(None if f is None else bool(f) for f in flags)))
        if self.idle_ms is not None and last + self.idle_ms > self.timer:
            if self.timer:
                self.handle.deleteTimer(self.timer)
            self.timer = max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(self.timer)
        self._save()
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out: list[tuple] = []
        if expiredTimerInfo.getExpiryTimeInMs() == self.timer:
            if not self.ended:
                self.waits, self.began = 0, self.s.begin if self.s else 0
                for _, chunk in sorted(((k[0], tuple(v)) for k, v in self.early.iterator()), key=lambda x: x[0]) if self.early.exists() else ():
                    out += self._take(chunk)
                    if self.ended:
                        break
                if self.s and not self.ended:
                    out += self._end("idle")
            self.record.clear()
            self.windows.clear()
            self.early.clear()
        if out:
            yield self._rows(key, out)

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame([(key[0], *o) for o in out], columns=_NAMES)
        return df.astype({c: "Int64" for c in ("session_id", "seg_idx", "start_sample", "end_sample")} | {"forced": "boolean"})

    def close(self) -> None:
        pass


PARTIAL = "session_id long, segments long, settled string, tail string"
PARTIAL_STATE = "fold struct<tail:string,segments:long,due:long,forced:boolean>, early array<struct<seg_idx:long,text:string,forced_split:boolean>>, timer long"


class PartialProcessor(StatefulProcessor):
    """One session's segments to its running text, by a fold whose state is the text's end.

    State: the end of the text that a later segment can still change (some thousand characters, however many segments
    there are), and segments that came before their turn.  A row gives the text that is settled now and wasn't before,
    and the end as it stands: all settled parts in order and the last end are the text.  ttl_ms: the state of a
    session that gets no segment for so long is dropped.
    """

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.fold = handle.getValueState("fold", "tail string, segments long, due long, forced boolean", self.ttl_ms)
        self.early = handle.getMapState("early", "seg_idx long", "text string, forced boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail, segments, due, forced = self.fold.get() if self.fold.exists() else ("", 0, 0, False)
        fold, settled, before = SeamFold(tail, forced), [], segments
        came = {int(r.seg_idx): (r.text, r.forced_split is not None and bool(r.forced_split)) for pdf in rows for r in pdf.itertuples()}
        waiting = self.early.exists()
        while True:
            part = came.pop(due, None)
            if part is None and waiting and (part := self.early.getValue((due,))) is not None:
                self.early.removeKey((due,))
            if part is None:
                break
            due, segments = due + 1, segments + 1
            settled += fold.push(*part)
        for k, part in came.items():
            if k > due:
                self.early.updateValue((k,), part)
        self.fold.update((fold.tail, segments, due, fold.forced))
        if segments > before:
            yield pd.DataFrame({"session_id": [key[0]], "segments": [segments], "settled": ["".join(settled)], "tail": [fold.tail]})

    def close(self) -> None:
        pass


PROPOSAL = "run_id long, event_id long, proposed_ms long, outcome string"


class ProposalProcessor(StatefulProcessor):
    """One run's stages to proposals that time out or that a newer one replaces; state: the proposal that waits."""

    def __init__(self, seconds: int) -> None:
        self.wait = seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "event_id long, at long")

    def _clear(self, at: int) -> None:
        self.handle.deleteTimer(at + self.wait)
        self.held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        out = []
        for r in sorted((r for pdf in rows for r in pdf.itertuples()), key=lambda r: (r.ts, r.event_id)):
            at = r.ts.value // 1_000_000
            if held is not None:
                if at - held[1] > self.wait:
                    out.append((key[0], *held, "cancelled"))
                elif r.stage == "confirm":
                    out.append((key[0], *held, "declined"))
                self._clear(held[1])
            held = (int(r.event_id), at) if r.stage == "confirm" else None
        if held is not None:
            self.held.update(held)
            self.handle.registerTimer(held[1] + self.wait)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        out = []
        if held is not None and held[1] + self.wait == expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], *held, "cancelled"))
            self.held.clear()
        yield self._rows(out)

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["run_id", "event_id", "proposed_ms", "outcome"]).astype({c: "int64" for c in ("run_id", "event_id", "proposed_ms")})

    def close(self) -> None:
        pass
