"""Histories of conversations whose turns arrive over several batches, as state by conversation.

A question is a user's turn, and the assistant's turn that follows it is its answer; a blank question is not kept, a second question takes the place of one that
has no answer yet, and an answer without a question is none. The state is a list of the answered questions and one row with the open
question and the last turn seen. Turns are taken in order within a batch; turns that are not beyond the last one seen came before, as when a batch is
sent again, and change nothing. A batch is read turn by turn, the history of a conversation only to tell it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from grainmill.functions.text import strip

HISTORY = "history array<struct<question:string,answer:string>>"
#: State in lists needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Histories(StatefulProcessor):
    """``key`` and the whole ``history`` of each conversation that a batch has turns of."""

    def __init__(self, key: str, without_report: str | None = None):
        self.key, self.without_report = key, without_report

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getListState("pairs", "question string, answer string")
        self.open = handle.getValueState("open", "question string, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        question, last = self.open.get() if self.open.exists() else (None, None)
        turns = pd.concat(list(rows)).sort_values("turn", kind="stable")  # of one conversation and batch
        for turn, role, text in zip(turns["turn"], turns["role"], turns["said"], strict=True):
            if last is not None and turn <= last:
                continue
            last = int(turn)
            if role == "user":
                question = text or None
            elif role == "assistant" and question is not None:
                self.pairs.appendValue((question, text if self.without_report is None else self.without_report))
                question = None
        self.open.update((question, last))
        told = [{"question": q, "answer": a} for q, a in self.pairs.get()]
        yield pd.DataFrame({self.key: [key[0]], "history": [told]})

    def close(self) -> None:
        pass


def follow(turns: DataFrame, key: str, without_report: str | None = None) -> DataFrame:
    """The history of a stream of turns with ``key``, ``turn``, ``role`` and ``text``, in update mode.

    Rows without a key or a turn are left out. If ``without_report`` is given, it is every answer.
    """
    own = turns.where(F.col(key).isNotNull() & F.col("turn").isNotNull())
    said = F.when(strip(F.coalesce("text", F.lit(""))) == "", F.lit("")).otherwise(F.col("text"))
    own = own.select(key, F.col("turn").cast("long").alias("turn"), "role", F.when(F.col("role") == "user", said).otherwise(F.col("text")).alias("said"))
    kind = turns.schema[key].dataType.simpleString()
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own.groupBy(key).transformWithStateInPandas(Histories(key, without_report), f"{key} {kind}, {HISTORY}", "Update", "None")
