"""Work items as a stateful stream, by the rules of operators.work.

Commands wait in the state until the watermark has passed their time, and are then taken in the order of (at, id): so the rows don't
depend on how the stream was cut into micro-batches, and equal those of a replay of the same commands. Event-time timers wake
an item for its waiting commands and for its next stale time. A command that comes when the watermark has passed its time is
told as `late` and changes nothing; one that has the time and id of a waiting one is that one again and counts once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import work

_ITEM = "status string, token string, retries int, since double, handed boolean, error string"
_COMMAND = "kind string, token string, outcome string"


class WorkItems(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", _ITEM)
        self.waiting = handle.getMapState("waiting", "at double, id long", _COMMAND)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, late = timerValues.getCurrentWatermarkInMs() / 1000, []
        now = self._read()
        for batch in rows:
            for number, at, kind, token, outcome in zip(batch["id"], batch["at"], batch["kind"], batch["token"], batch["outcome"], strict=True):
                if at <= passed:
                    late.append((int(key[0]), int(number), float(at), "late", False, now.status, now.token, now.retries, now.error))
                else:
                    self.waiting.updateValue((float(at), int(number)), (kind, work.none(token), work.none(outcome)))
        self._wake(now)
        yield work.frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, now, out = timerValues.getCurrentWatermarkInMs() / 1000, self._read(), []
        ready = sorted(tuple(k) for k in self.waiting.keys() if k[0] <= passed)
        for at, number in ready:
            now, told = work.run(int(key[0]), now, number, at, *self.waiting.getValue((at, number)))
            out += told
            self.waiting.removeKey((at, number))
        now, told = work.advanced(int(key[0]), now, passed)
        self.item.update((now.status, now.token, now.retries, now.since, now.handed, now.error))
        self._wake(now)
        yield work.frame(out + told)

    def _read(self) -> work.Item:
        return work.Item(*self.item.get()) if self.item.exists() else work.Item()

    def _wake(self, now: work.Item) -> None:
        """One timer, at the next time at which anything happens."""
        times = [k[0] for k in self.waiting.keys()]
        if (due := now.due()) is not None:
            times.append(due)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if times:
            self.handle.registerTimer(int(min(times) * 1000) + 1)

    def close(self) -> None: ...


def work_items(commands: DataFrame, late: str) -> DataFrame:
    """commands: stream of (item, id, at, kind, token, outcome). `late` is how far commands may lag behind the newest one. Needs the
    RocksDB state store provider."""
    timed = commands.withColumn("time", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("time", late)
    return timed.groupBy("item").transformWithStateInPandas(WorkItems(), work.OUTPUT, "append", "EventTime")
