"""Texts as token ids by any encoder, which a Python worker makes once and keeps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators import records

#: Encoders of this worker, by name.
_MADE: dict[str, Callable[[Sequence[str]], Sequence[Sequence[int]]]] = {}


def resource(name: str, make: Callable[[], Callable]) -> Callable:
    """What ``make`` gives, made once in this process under its name."""
    if name not in _MADE:
        _MADE[name] = make()
    return _MADE[name]


def encode(text: Column, name: str, make: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[int]]]]) -> Column:
    """Token ids of a text, null as the empty text; ``make`` gives a function from texts to ids and runs once a worker."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = resource(name, make)
        for texts in batches:
            yield pd.Series([list(ids) for ids in encoder(["" if t is None else t for t in texts])], dtype=object)

    return run(text)


def training_rows(df: DataFrame, prompt: str, response: str, batch: str, name: str, make: Callable, most: int, end: int | None = None, pad_id: int = 0, left: bool = False) -> DataFrame:
    """Texts of prompts and responses to ``input_ids``, ``labels`` and ``attention_mask`` padded by batch; the other columns stay."""
    ids = df.withColumns({prompt: encode(F.col(prompt), name, make), response: encode(F.col(response), name, make)})
    ids = ids.withColumns({prompt: records.truncate(F.col(prompt), most, None), response: records.truncate(F.col(response), most, end)})
    return records.collate(ids, batch, prompt, response, pad_id, left).drop(prompt, response)
