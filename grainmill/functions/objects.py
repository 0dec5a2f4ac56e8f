"""All JSON objects of a text, as a table function to be joined laterally."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.jsonx import object_spans


class Objects:
    """``place`` (from 0), ``start``, ``length`` (in code points) and ``object`` of each outermost ``{...}`` run that parses as an object.

    With ``outer``, a text without any gives a row of nulls.
    """

    def eval(self, text: str | None, outer: bool) -> Iterator[tuple[int | None, int | None, int | None, str | None]]:
        place = 0
        for start, end in object_spans(text or ""):
            try:
                if not isinstance(json.loads(text[start:end]), dict):
                    continue
            except (ValueError, RecursionError):
                continue
            yield place, start, end - start, text[start:end]
            place += 1
        if outer and not place:
            yield None, None, None, None


json_objects = F.udtf(Objects, returnType="place int, start int, length int, object string", useArrow=True)


def explode_objects(df: DataFrame, text: Column, outer: bool = False) -> DataFrame:
    """A row for each object of each text, with the columns of :class:`Objects`; ``outer`` keeps rows without an object.

    ``df`` must not have columns of these names.
    """
    return df.lateralJoin(json_objects(text.outer(), F.lit(outer)))
