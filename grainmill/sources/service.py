"""A service asked from tasks: a budget of requests, tries again after failures, and a log of every attempt.

Each attempt carries a key made of the row's id and the attempt's number. A task that Spark runs again, or twice at once, sends the same keys, by which a
service knows a request it has answered; the log is written before anything else reads it, so that later stages never ask.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from grainmill import scratch

LOG = "attempt int, key string, status string, response string"


class Failed(Exception):
    """A request that may be tried again."""


class Budget:
    """At most ``rate`` requests a second in this task, evenly apart; no limit for 0."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.due = 1 / rate if rate else 0.0, clock, sleep, 0.0

    def wait(self, least: float = 0.0) -> None:
        now = self.clock()
        at = max(now + least, self.due)
        if at > now:
            self.sleep(at - now)
        self.due = at + self.gap


def request_key(row_id: object, attempt: int, salt: str = "") -> str:
    return hashlib.sha256(f"{salt}:{row_id}:{attempt}".encode()).hexdigest()


def pause(key: str, attempt: int, first: float, most: float) -> float:
    """Seconds before an attempt: twice as long each time, spread by the key over the upper half, so that tasks do not ask all at once."""
    return min(most, first * 2 ** (attempt - 2)) * (0.5 + int(key[:8], 16) / 2**33) if attempt > 1 else 0.0


def ask(
    pending: DataFrame, id_col: str, connect: Callable[[], Callable[[str, dict], str]], attempts: int = 3, rate: float = 0.0, first_pause: float = 0.5, most_pause: float = 30.0, salt: str = ""
) -> DataFrame:
    """The log: ``id_col`` and each attempt's number, key, ``status`` (``ok`` or ``error``) and response or error text, a written table.

    ``connect`` makes the client once a task; the client takes a key and a row and raises :class:`Failed` for what may be tried again. ``rate`` is a task's
    share of requests a second. Other errors end the task, and Spark runs it again.
    """
    kind = pending.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, budget = None, Budget(rate)
        for batch in batches:
            client = client or connect()
            log = []
            for row in batch.to_dict("records"):
                for attempt in range(1, attempts + 1):
                    key = request_key(row[id_col], attempt, salt)
                    budget.wait(pause(key, attempt, first_pause, most_pause))
                    try:
                        log.append((row[id_col], attempt, key, "ok", client(key, row)))
                        break
                    except Failed as e:
                        log.append((row[id_col], attempt, key, "error", str(e)))
            yield pd.DataFrame(log, columns=[id_col, "attempt", "key", "status", "response"])

    return scratch.materialize(pending.mapInPandas(run, f"{id_col} {kind}, {LOG}"), "service-log")
