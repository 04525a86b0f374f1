"""Work items: queued, running, and succeeded, partial or failed, with claims by token, bounded retries and timers.

A command (item, id, at in seconds, kind, token) is one of

    submit   queues an item that isn't there or is over
    claim    a queued item runs from now on, and is the token's
    retry    its holder gives a running item back; the fourth time it has failed (collection_unavailable)
    finish   its holder ends a running item with the outcome that the command names
    drop     a queued item that was never handed out has failed (collection_unavailable)

Anything else is rejected and changes nothing. Two timers act by themselves: an item that has run for 1800 s is queued again
without a holder, and one that has been queued for 300 s without being handed out is handed out. They act at their due
time, before a command of that time or later. Every command and every timer gives one row, so a log explains each state.

`advanced` and `step` are the rules; `replayed` runs them over a table, `millrace.streaming.work` over a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE_QUEUED, STALE_RUNNING, RETRIES = 300, 1800, 3
OVER = ("succeeded", "partial", "failed")
OUTPUT = "item long, id long, at double, kind string, applied boolean, status string, token string, retries int, error string"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


@dataclass(frozen=True)
class Item:
    """status is None for an item that isn't there; since: when it was queued or began to run; handed: whether it was handed out."""

    status: str | None = None
    token: str | None = None
    retries: int = 0
    since: float = 0.0
    handed: bool = False
    error: str | None = None

    def due(self) -> float | None:
        """When the next timer acts."""
        if self.status == "running":
            return self.since + STALE_RUNNING
        if self.status == "queued" and not self.handed:
            return self.since + STALE_QUEUED
        return None


def _row(item: int, number: int | None, at: float, kind: str, applied: bool, now: Item) -> tuple:
    return item, number, at, kind, applied, now.status, now.token, now.retries, now.error


def advanced(item: int, now: Item, until: float) -> tuple[Item, list[tuple]]:
    """The item after all timers due by then, and their rows."""
    rows = []
    while (due := now.due()) is not None and due <= until:
        if now.status == "running":
            now, kind = replace(now, status="queued", token=None, since=due, handed=False), "requeued"
        else:
            now, kind = replace(now, handed=True), "handed out"
        rows.append(_row(item, None, due, kind, True, now))
    return now, rows


def step(now: Item, at: float, kind: str, token: str | None, outcome: str | None) -> Item | None:
    """The item after a command; None if it is rejected."""
    holds = now.status == "running" and token is not None and token == now.token
    if kind == "submit" and (now.status is None or now.status in OVER):
        return Item("queued", since=at)
    if kind == "claim" and now.status == "queued" and token is not None:
        return replace(now, status="running", token=token, since=at, handed=True)
    if kind == "retry" and holds:
        if now.retries == RETRIES:
            return replace(now, status="failed", error="collection_unavailable")
        return replace(now, status="queued", token=None, retries=now.retries + 1, since=at, handed=False)
    if kind == "finish" and holds and outcome in OVER:
        return replace(now, status=outcome)
    if kind == "drop" and now.status == "queued" and not now.handed:
        return replace(now, status="failed", error="collection_unavailable")
    return None


def run(item: int, now: Item, number: int, at: float, kind: str, token: str | None, outcome: str | None) -> tuple[Item, list[tuple]]:
    """Timers due, then the command."""
    now, rows = advanced(item, now, at)
    after = step(now, at, kind, token, outcome)
    rows.append(_row(item, number, at, kind, after is not None, after or now))
    return after or now, rows


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    return out.astype({"id": "Int64", "item": "int64", "at": "float64", "retries": "int32"})


def none(x):
    """Pandas' missing values as None."""
    return x if isinstance(x, str) else None


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    here, now = None, Item()
    for rows in batches:
        out: list[tuple] = []
        for item, number, at, kind, token, outcome in zip(rows["item"], rows["id"], rows["at"], rows["kind"], rows["token"], rows["outcome"], strict=True):
            if here != item:
                if here is not None:
                    out += advanced(here, now, float("inf"))[1]
                here, now = item, Item()
            now, told = run(int(item), now, int(number), float(at), kind, none(token), none(outcome))
            out += told
        yield frame(out)
    if here is not None:
        yield frame(advanced(here, now, float("inf"))[1])


def replayed(log: DataFrame) -> DataFrame:
    """Rows of all commands (item, id, at, kind, token, outcome) and timers, in the order of (at, id) of each item. An item's commands
    pass one task in batches, however many there are; its timers run out at the end."""
    return log.repartition("item").sortWithinPartitions("item", "at", "id").mapInPandas(_replay, OUTPUT)


def commands(events: DataFrame) -> DataFrame:
    """Events of users as commands on one of 40 items: an example log, in which tokens collide, commands repeat and timers run out."""
    kinds = {"signup": "submit", "view": "claim", "error": "retry", "purchase": "finish", "click": "submit"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("drop"))
    kind = F.when((F.col("event_id") % 11 == 0), "drop").otherwise(kind)
    outcome = F.element_at(F.array(F.lit("succeeded"), F.lit("partial"), F.lit("failed")), (F.col("event_id") % 3 + 1).cast("int"))
    return events.select(
        (F.col("user_id") % 40).alias("item"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), kind.alias("kind"),
        (F.col("event_id") % 2).cast("string").alias("token"), F.when(kind == "finish", outcome).alias("outcome"),
    )
