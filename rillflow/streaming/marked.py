"""Watermarks that move with each row of a key, as a stateful processor: rows are held until a later row lets them go, in order of their times.

Spark's own watermark moves between micro-batches and is one for the stream. ``operators.lateness.released`` is the form over a table; both give the same rows for the same arrival order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NONE = np.iinfo(np.int64).min
OUT = ["row", "late", "released_by"]


class HeldRows(StatefulProcessor):
    """State of a key: its watermark, and the rows (time, arrival, content) that it hasn't reached."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "mark long")
        self.held = handle.getListState("held", "t long, a long, row string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark passes
        new = pd.concat(list(rows)).sort_values("a", kind="stable")
        before = self.mark.get()[0] if self.mark.exists() else NONE
        marks = new["mark"].fillna(NONE).astype("int64").to_numpy()
        mark = np.maximum.accumulate(np.concatenate([[before], marks]))[1:]
        t, a, row = new["t"].to_numpy("int64"), new["a"].to_numpy("int64"), new["row"].to_numpy()
        late = t <= mark
        out = [(key[0], r, True, None) for r in row[late]]
        fresh = [(int(x), int(y), z) for x, y, z in zip(t[~late], a[~late], row[~late])]
        if mark[-1] > before:
            waiting = [*(tuple(x) for x in self.held.get()), *fresh]
            free = sorted((int(a[np.searchsorted(mark, x[0])]), *x) for x in waiting if x[0] <= mark[-1])
            out += [(key[0], r, False, by) for by, _, _, r in free]
            rest = [x for x in waiting if x[0] > mark[-1]]
            self.held.put(rest) if rest else self.held.clear()
            self.mark.update((int(mark[-1]),))
        elif fresh:
            self.held.appendList(fresh)
        frame = pd.DataFrame(out, columns=["key", *OUT])
        frame["released_by"] = frame["released_by"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def released(df: DataFrame, key: str, ts: str, arrival: str, mark: Column) -> DataFrame:
    """Rows of a stream with late and released_by, which come when a row of their key, ``released_by`` by its ``arrival``, moves the key's watermark to their time or beyond.

    ``mark`` is the watermark that a row announces, as a timestamp, or null: ``marked_by`` for rows of a kind, ``trailing`` for each row. It holds
    for the rows after it. A row at or before the watermark is late and comes at once. Rows of a micro-batch are taken in order of ``arrival`` (a whole number), whatever their order in it; rows with a null time are left out. A key's state is its
    watermark and the rows that wait; rows that nothing releases stay there.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = df.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), micros(F.col(ts)).alias("t"), F.col(arrival).cast("long").alias("a"), micros(mark).alias("mark"), F.to_json(F.struct(*df.columns)).alias("row"))
    schema = f"key {dict(df.dtypes)[key]}, row string, late boolean, released_by long"
    out = rows.groupBy("key").transformWithStateInPandas(HeldRows("key"), outputStructType=schema, outputMode="Append", timeMode="None")
    return out.select(F.from_json("row", df.schema).alias("x"), "late", "released_by").select("x.*", "late", "released_by")


def marked_by(kind: Column, ts: str) -> Column:
    """Punctuated: a row of which ``kind`` is true announces that rows before its time are complete."""
    return F.when(kind, F.col(ts) - F.expr("interval '0.001' second"))


def trailing(ts: str, delay: str) -> Column:
    """Bounded disorder, row by row: each row announces its time less ``delay`` and 1 ms."""
    return F.col(ts) - F.expr(f"interval {delay}") - F.expr("interval '0.001' second")
