"""Chunks of many clips in order, with lost, late and repeated ones told apart: a stateful processor around a kernel.

A kernel turns the chunks of one clip, in order, into rows: step(samples) gives what
they complete, flush() what is left at the end. The processor keeps the kernel's
numbers and samples as typed state, holds chunks that came before their turn, and
writes what it can't use as rejects beside the rows:

* repeated: a chunk that was taken, or waits, already
* gap: chunks `seq` to `until` that did not come within `patience` of a later one; what
  is there is flushed, and the clip goes on as a new segment from the later chunk
* late: a chunk of such a gap that came after all
* unfinished: a clip without its last chunk from which nothing came for `idle`; flushed
* after_end: a chunk behind the last one

Time is that of the column ts; without one nothing expires, so gaps are waited for and
ends are kept. Chunks older than the watermark never reach an operator, so ts should be
the time of arrival (as a broker stamps it), not of recording. A clip's state is what
its kernel needs, chunks that wait at most `patience`, and, for `patience` after its
end, a mark of that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..config import check

#: Gaps of a clip that are remembered to call their chunks late; those of earlier gaps are called repeated.
GAPS = 16
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Clip:
    """The state of one clip: its segment, the next chunk, when it is looked at again, and the kernel's own."""

    segment: int = 0
    seq: int = 0
    ended: bool = False
    since: int = 0  # when something last came
    opened: int = -1  # when the first chunk behind a gap came
    timer: int = -1
    waiting: int = 0
    lost: list[int] = field(default_factory=list)
    numbers: list[int] = field(default_factory=list)
    values: bytes = b""

    DDL = "segment bigint, seq bigint, ended boolean, since bigint, opened bigint, timer bigint, waiting bigint, lost array<bigint>, numbers array<bigint>, values binary"

    def state(self) -> tuple:
        return (self.segment, self.seq, self.ended, self.since, self.opened, self.timer, self.waiting, self.lost, self.numbers, self.values)

    def was_lost(self, seq: int) -> bool:
        return any(a <= seq <= b for a, b in zip(self.lost[::2], self.lost[1::2], strict=True))


class Ordered(StatefulProcessor):
    def __init__(self, kernel, columns: list[str], patience: int, idle: int, event_time: bool):
        self.kernel, self.columns, self.patience, self.idle, self.event_time = kernel, columns, patience, idle, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.clip = handle.getValueState("clip", Clip.DDL)
        self.early = handle.getMapState("early", "seq bigint", "samples binary, last boolean, ts bigint")

    def close(self) -> None:
        pass

    def _load(self) -> Clip:
        if (s := self.clip.get()) is not None:  # each call of the state is a message
            clip = Clip(*(int(v) if i in (0, 1, 3, 4, 5, 6) else v for i, v in enumerate(s)))
            clip.lost, clip.numbers = list(map(int, clip.lost)), list(map(int, clip.numbers))
            self.kernel.load(clip.numbers, np.frombuffer(clip.values, float))
            return clip
        self.kernel.load(*self.kernel.fresh())
        return Clip()

    def _save(self, clip: Clip, now: int) -> None:
        """Write the state and move the clip's one timer to when it is next looked at."""
        numbers, values = self.kernel.dump()
        clip.numbers, clip.values = [int(v) for v in numbers], np.ascontiguousarray(values, float).tobytes()
        if not self.event_time:
            self.clip.update(clip.state())
            return
        due = clip.opened + self.patience if clip.waiting else max(clip.since, now) + (self.patience if clip.ended else self.idle)
        if due != clip.timer:
            if clip.timer >= 0:
                self.handle.deleteTimer(clip.timer)
            self.handle.registerTimer(due)
            clip.timer = due
        self.clip.update(clip.state())

    def _drain(self, clip: Clip, fresh: dict[int, tuple], out: list) -> None:
        """Take chunks in order, from those that just came and those that waited, as far as they go."""
        while not clip.ended:
            parts, last = [], False
            while not last and clip.seq in fresh:  # those that follow each other at once
                samples, last, _ = fresh.pop(clip.seq)
                parts.append(samples)
                clip.seq += 1
            if parts:
                samples = np.concatenate(parts)
            elif clip.waiting and self.early.containsKey((clip.seq,)):
                samples, last, _ = self.early.getValue((clip.seq,))
                self.early.removeKey((clip.seq,))
                samples, clip.waiting, clip.seq = np.frombuffer(samples, float), clip.waiting - 1, clip.seq + 1
            else:
                break
            out += [(clip.segment, *row, None, None, None) for row in self.kernel.step(samples)]
            clip.opened = -1
            if last:
                self._end(clip, out)
        if clip.ended:
            beyond = list(fresh) + ([int(k[0]) for k in self.early.keys()] if clip.waiting else [])  # noqa: SIM118  a state, not a dictionary
            out += [self._reject(clip, "after_end", seq) for seq in sorted(beyond)]
            fresh.clear()
            if clip.waiting:
                self.early.clear()
                clip.waiting = 0

    def _end(self, clip: Clip, out: list) -> None:
        out += [(clip.segment, *row, None, None, None) for row in self.kernel.flush()]
        clip.ended = True
        self.kernel.load(*self.kernel.fresh())

    def _reject(self, clip: Clip, kind: str, seq: int, until: int | None = None) -> tuple:
        return (clip.segment, *[None] * (len(self.columns) - 6), kind, seq, seq if until is None else until)

    def _table(self, key: tuple, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(*key, *row) for row in out], columns=self.columns, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clip, out, fresh = self._load(), [], {}
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else 0
        for df in rows:
            for seq, samples, last, ts in zip(df["seq"].tolist(), df["samples"], df["last"].tolist(), df["at"].tolist() if self.event_time else [0] * len(df), strict=True):
                clip.since = max(clip.since, int(ts))
                if clip.ended:
                    out.append(self._reject(clip, "after_end", seq))
                elif seq < clip.seq:
                    out.append(self._reject(clip, "late" if clip.was_lost(seq) else "repeated", seq))
                elif seq in fresh or (clip.waiting and self.early.containsKey((seq,))):
                    out.append(self._reject(clip, "repeated", seq))
                else:
                    fresh[seq] = (np.asarray(samples, float), bool(last), int(ts))
        self._drain(clip, fresh, out)
        for seq, (samples, last, ts) in fresh.items():
            self.early.updateValue((seq,), (samples.tobytes(), last, ts))
            clip.opened = ts if clip.opened < 0 else min(clip.opened, ts)
        clip.waiting += len(fresh)
        if clip.waiting and clip.opened < 0:  # a further gap behind the one that closed
            clip.opened = clip.since
        self._save(clip, max(now, 0))
        yield from self._table(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clip, out = self._load(), []
        if clip.ended:
            self.clip.clear()
            return
        now = timerValues.getCurrentWatermarkInMs()
        clip.timer = -1
        if clip.waiting:
            first = min(int(k[0]) for k in self.early.keys())  # noqa: SIM118
            out.append(self._reject(clip, "gap", clip.seq, first - 1))
            out += [(clip.segment, *row, None, None, None) for row in self.kernel.flush()]
            clip.lost = [*clip.lost, clip.seq, first - 1][-2 * GAPS :]
            clip.segment, clip.seq = clip.segment + 1, first
            self.kernel.load(*self.kernel.fresh())
            self._drain(clip, {}, out)
            if clip.waiting:
                clip.opened = max(now, 0)
        else:
            out.append(self._reject(clip, "unfinished", clip.seq))
            self._end(clip, out)
        self._save(clip, max(now, 0))
        yield from self._table(key, out)


def _milliseconds(text: str) -> int:
    n, unit = text.split()
    return int(float(n) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


def ordered(chunks: DataFrame, kernel, patience: str = "10 minutes", idle: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """The kernel's rows of each clip and segment, and the rejects: (clip_id, channel, segment, the kernel's columns, reject, seq, until).

    chunks: (clip_id, channel, seq, samples, last, and ts or none), seq from 0. `delay`
    is the watermark's, where chunks have none yet.
    """
    conf = chunks.sparkSession.conf.get(PROVIDER, "")
    check(not chunks.isStreaming or conf.endswith("RocksDBStateStoreProvider"), f"set {PROVIDER} to {ROCKSDB}: typed states and timers need it")
    event_time, kinds = "ts" in chunks.columns, dict(chunks.dtypes)
    rows = chunks.withColumn("samples", F.col("samples").cast("array<double>"))
    if event_time:
        rows = rows.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))
    rows = rows.select("clip_id", "channel", "seq", "samples", "last", *(["ts", "at"] if event_time else []))
    schema = T.StructType.fromDDL(f"clip_id {kinds['clip_id']}, channel {kinds['channel']}, segment bigint, {kernel.columns}, reject string, seq bigint, until bigint")
    made = Ordered(kernel, schema.names, _milliseconds(patience), _milliseconds(idle), event_time)
    return rows.groupBy("clip_id", "channel").transformWithStateInPandas(made, schema, "append", "EventTime" if event_time else "None")


def taken(rows: DataFrame) -> DataFrame:
    """What the kernel made, of an ordered stream or of the table it was written to."""
    return rows.where("reject IS NULL").drop("reject", "seq", "until")


def rejects(rows: DataFrame) -> DataFrame:
    """The chunks that were lost or not used: (clip_id, channel, segment, reject, seq, until)."""
    return rows.where("reject IS NOT NULL").select("clip_id", "channel", "segment", "reject", "seq", "until")
