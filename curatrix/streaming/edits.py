"""Debounced edits: a stream of keystroke-like edits becomes one write a track, once it has been quiet for a while.

Edits are rows (id, seq, ts, text).  A track's state holds its newest edit (by seq: late and repeated ones never replace a newer one), and a timer set QUIET
seconds of event time behind it; when the watermark passes the timer, or an edit arrives that was made after it, one row is written.  An edit that repeats the text last written gives none.  The state of a
track is one row, so keys of any heat are handled edit by edit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from curatrix.packing import ship

#: Seconds without an edit after which the newest is written.
QUIET = 2.0
WRITTEN = "id string, text string, seq long, edits long"
_STATE = "text string, seq long, due long, edits long, written string, done long"


class Debounce(StatefulProcessor):
    """Keeps a track's newest edit until it is due. ``done``: the seq of the last written edit, so that a repeat of it is no edit."""

    def __init__(self, quiet: float = QUIET):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("edit", _STATE)

    def _now(self) -> tuple:
        return tuple(self.state.get() or (None, -1, -1, 0, None, -1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        text, seq, due, edits, written, done = self._now()
        old, quiet, made = due, int(self.quiet * 1000), []
        own = pd.concat(list(rows))
        if own["ts"].isna().any():
            raise ValueError("an edit without time")
        own = own.iloc[np.lexsort((own["seq"].to_numpy(), own["ts"].to_numpy()))]
        times = own["ts"].to_numpy("datetime64[us]").astype("int64") // 1000
        for at, n, t in zip(times.tolist(), own["seq"].tolist(), own["text"].tolist(), strict=True):
            if n <= max(seq, done):
                continue
            if seq > done and at >= due:  # the one before had rested when this one was made
                if text != written:
                    made.append((text, seq, edits))
                written, done, edits = text, seq, 0
            text, seq, edits, due = t, int(n), edits + 1, max(due, at + quiet)
        if due != old:
            if old >= 0:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
        self.state.update((text, seq, due, edits, written, done))
        yield from self._frame(key, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        text, seq, _, edits, written, done = self._now()
        made = [(text, seq, edits)] if seq > done and text != written else []
        self.state.update((text, seq, -1, 0, text if made else written, max(seq, done)))
        yield from self._frame(key, made)

    def _frame(self, key, made: list[tuple]) -> Iterator[pd.DataFrame]:
        """All writes of a call as one frame, for a frame costs more than a row."""
        if made:
            frame = pd.DataFrame(made, columns=["text", "seq", "edits"])
            frame.insert(0, "id", key[0])
            yield frame

    def close(self) -> None:
        pass


def debounced(edits: DataFrame, quiet: float = QUIET, late: str = "10 seconds") -> DataFrame:
    """id, text, seq and the number of edits that each write stands for. edits: id, seq, ts (event time), text.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    ship(edits.sparkSession)
    own = edits.select("id", "seq", "ts", "text").withWatermark("ts", late)
    return own.groupBy("id").transformWithStateInPandas(Debounce(quiet), outputStructType=WRITTEN, outputMode="Append", timeMode="EventTime")
