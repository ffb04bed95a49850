"""Per-device state kept in Python: what one time bin hands to the next."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Send these classes to the workers by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    frames = list(rows)
    return (pd.concat(frames) if len(frames) > 1 else frames[0]).sort_values(list(by))


class CarryPrevious(StatefulProcessor):
    """Gives the first sample of each bin its predecessor, the last sample of an earlier bin."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        samples = in_order(rows, "ts", "event_id")
        # In order, the row before a first sample is the last sample of the bin before.
        carried = samples["value"].shift(1)
        known = self.last.get()
        if known is not None:
            carried.iloc[0] = known[0]
        self.last.update((float(samples["value"].iloc[-1]),))
        yield pd.DataFrame(
            {
                "device": samples["device"],
                "ts": samples["ts"],
                "event_id": samples["event_id"],
                "value": samples["value"],
                "previous": samples["previous"].where(~samples["is_first"], carried),
            }
        )

    def close(self) -> None:
        pass


class CarryNewest(StatefulProcessor):
    """Keeps the newest ``n`` whole values of a device and reports their average."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "samples ARRAY<BIGINT>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bins = in_order(rows, "bin_end")
        known = self.kept.get()
        # Each bin brings its newest values, oldest first.
        arrived = [int(v) for values in bins["newest"] for v in values]
        kept = [*(known[0] if known is not None else []), *arrived][-self.n :]
        self.kept.update((kept,))
        total = sum(kept)
        # Cut toward zero, also below zero.
        average = abs(total) // self.n * (1 if total >= 0 else -1)
        full = len(kept) == self.n
        yield pd.DataFrame(
            {
                "device": [key[0]],
                "as_of": [bins["bin_end"].iloc[-1]],
                "n": [len(kept)],
                "average": pd.array([average if full else None], dtype="Int64"),
            }
        )

    def close(self) -> None:
        pass


class DeviceFacts(StatefulProcessor):
    """What standing questions need of a device: nothing that grows with its history.

    ``newest`` is how many samples of each type to keep; ``watched`` has (anchor type, type, microseconds): events of the
    type are kept that lie so far before the newest anchor, or so far before what may still come. Events may
    come in any order that the watermark allows.
    """

    STATE = (
        "last MAP<STRING, BIGINT>, "
        "newest ARRAY<STRUCT<event_type: STRING, at: BIGINT, event_id: BIGINT, whole: BIGINT>>, "
        "recent ARRAY<STRUCT<event_type: STRING, at: BIGINT, event_id: BIGINT>>"
    )

    def __init__(self, newest: dict[str, int], watched: list[tuple[str, str, int]]):
        self.newest, self.watched = newest, watched
        self.kinds = {kind for _, kind, _ in watched}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getValueState("facts", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.facts.get()
        last = dict(known[0]) if known is not None else {}
        samples = [tuple(s) for s in known[1]] if known is not None else []
        recent = [tuple(s) for s in known[2]] if known is not None else []
        n = 0
        for frame in rows:
            n += len(frame)
            for kind, at, event_id, whole in zip(frame["event_type"], frame["at"], frame["event_id"], frame["whole"]):
                at, event_id = int(at), int(event_id)
                last[kind] = max(last.get(kind, at), at)
                if whole is not None and kind in self.newest:
                    samples.append((kind, at, event_id, int(whole)))
                if kind in self.kinds:
                    recent.append((kind, at, event_id))
        self.facts.update((last, self._newest(samples), self._recent(recent, last, timerValues)))
        yield pd.DataFrame({"device": [key[0]], "n": [n]})

    def _newest(self, samples: list[tuple]) -> list[tuple]:
        kept, counts = [], dict.fromkeys(self.newest, 0)
        for s in sorted(samples, key=lambda s: s[1:3], reverse=True):
            if counts[s[0]] < self.newest[s[0]]:
                counts[s[0]] += 1
                kept.append(s)
        return kept

    def _recent(self, recent: list[tuple], last: dict[str, int], timerValues) -> list[tuple]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1_000
        spans = []
        for anchor, kind, within in self.watched:
            spans.append((kind, watermark - within, None))
            if anchor in last:
                spans.append((kind, last[anchor] - within, last[anchor]))
        return [
            e for e in recent if any(e[0] == k and e[1] >= low and (high is None or e[1] <= high) for k, low, high in spans)
        ]

    def close(self) -> None:
        pass


class CountSilence(StatefulProcessor):
    """The stages of each device's silences, by timers on event time; any event starts the count anew.

    ``steps`` are (microseconds of silence, status, ticks lost), in order.
    """

    def __init__(self, steps: list[tuple[int, str, int]]):
        self.steps = steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "at BIGINT, given INT")

    def _rows(self, device, found: list[tuple[int, int]]) -> pd.DataFrame:
        """Rows of (time of the last event, step)."""
        at = pd.Series([a for a, _ in found], dtype="int64")
        after = pd.Series([self.steps[k][0] for _, k in found], dtype="int64")
        return pd.DataFrame(
            {
                "device": pd.Series([device] * len(found), dtype="int64"),
                "last_at": at,
                "since_at": at + after,
                "status": pd.Series([self.steps[k][1] for _, k in found], dtype="object"),
                "lost_time": pd.Series([self.steps[k][2] for _, k in found], dtype="int32"),
            }
        )

    def _expiry(self, at: int, step: int) -> int:
        """When a step is due, in whole milliseconds and not too early."""
        return -(-(at + self.steps[step][0]) // 1_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        last, given = (known[0], known[1]) if known is not None else (None, 0)
        times = sorted(int(t) for frame in rows for t in frame["at"])
        found = []
        for at in times:
            if last is not None and at <= last:
                continue
            while last is not None and given < len(self.steps) and last + self.steps[given][0] <= at:
                found.append((last, given))
                given += 1
            last, given = at, 0
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None:
            self.state.update((last, given))
            if given < len(self.steps):
                self.handle.registerTimer(self._expiry(last, given))
        yield self._rows(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, given = self.state.get()
        now, found = timerValues.getCurrentWatermarkInMs(), []
        while given < len(self.steps) and self._expiry(last, given) <= now:
            found.append((last, given))
            given += 1
        self.state.update((last, given))
        if given < len(self.steps):
            self.handle.registerTimer(self._expiry(last, given))
        yield self._rows(key[0], found)

    def close(self) -> None:
        pass
