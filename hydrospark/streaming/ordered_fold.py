"""Per-key folds over streams, in event order, with a reorder buffer.

``fold_stream`` runs a small step function over the rows of each key in the
order of some long columns (time first). Rows wait in a list state until the
key's own newest time is ``wait_seconds`` ahead, so each device is judged by its
own clock and a fast clock silences nobody else. A row that comes when a later
one has been folded cannot be folded any more; it leaves the same query with
``late`` set. So every row of the input leaves once, in one way or the other,
whatever the batches.

State is kept by ``transformWithStateInPandas`` in RocksDB: a JSON text per key
and the rows that wait. Memory of a task is one key's share of a micro-batch and
its waiting rows; the source's own option bounds a micro-batch (see
``pipeline.payload_stream``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Stands for a null in the order of rows.
_NULL = -(1 << 62)


def use_state_store(spark: SparkSession) -> None:
    """The state store that the folds need; streams started later use it."""
    spark.conf.set(_PROVIDER, ROCKSDB)


def _processor(step: Callable, n_order: int, wait_us: int, idle_ms: int | None, out_keys: Sequence[str]):
    # Nested, so that it is pickled by value and executors need this package for nothing.
    import json

    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    _NO_TIME = _NULL

    class Fold(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.fold = handle.getValueState("fold", "value string")
            self.held = handle.getListState("held", "value string")

        def _load(self):
            if self.fold.exists():
                return json.loads(self.fold.get()[0])
            return {"state": None, "last": None, "newest": None}

        def _frame(self, key, out):
            cols = {c: [key[i]] * len(out) for i, c in enumerate(out_keys)}
            return pd.DataFrame({**cols, "late": [x[0] for x in out], "out": [x[1] for x in out]})

        def _release(self, fold, rows, out):
            for order, row in rows:
                fold["state"], made = step(fold["state"], row)
                fold["last"] = order
                out.extend((False, json.dumps(m)) for m in made)

        def handleInputRows(self, key, rows, timerValues):
            fold, out = self._load(), []
            waiting = [json.loads(x[0]) for x in self.held.get()] if wait_us else []
            for pdf in rows:
                if pdf.empty:  # a frame without columns closes the rows of a key
                    continue
                orders = list(zip(*(pdf[f"order_{i}"].tolist() for i in range(n_order))))
                for order, text in zip(orders, pdf["row_text"]):
                    if order[0] == _NO_TIME or fold["last"] is not None and list(order) < fold["last"]:
                        out.append((True, text))
                    else:
                        waiting.append([list(order), json.loads(text)])
            waiting.sort(key=lambda x: x[0])
            if waiting:
                fold["newest"] = max(waiting[-1][0][0], fold["newest"] if fold["newest"] is not None else waiting[-1][0][0])
            ready = [x for x in waiting if x[0][0] <= fold["newest"] - wait_us]
            self._release(fold, ready, out)
            self.fold.update((json.dumps(fold),))
            if wait_us:
                self.held.put([(json.dumps(x),) for x in waiting[len(ready):]])
                if idle_ms is not None:
                    for t in list(self.handle.listTimers()):
                        self.handle.deleteTimer(t)
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)
            if out:
                yield self._frame(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            fold, out = self._load(), []
            self._release(fold, [json.loads(x[0]) for x in self.held.get()], out)
            self.held.clear()
            self.fold.update((json.dumps(fold),))
            if out:
                yield self._frame(key, out)

        def handleInitialState(self, key, initialState, timerValues):
            for text in initialState["state_text"]:
                self.fold.update((json.dumps({"state": json.loads(text), "last": None, "newest": None}),))

        def close(self):
            pass

    return Fold()


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def fold_stream(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], step: Callable, out_schema: str,
                wait_seconds: float = 0, idle_seconds: float | None = None,
                initial: DataFrame | None = None) -> DataFrame:
    """(keys..., late, out, row): what ``step(state, row)`` makes of each key's
    rows, ``state`` being any JSON value (None at first) and ``row`` a dict of
    the row's columns (times as microseconds, absent when null). ``out`` holds a
    made row in ``out_schema``; of a late row ``row`` holds the input instead.

    ``order`` are long columns (nulls first), the first one a time in
    microseconds; rows without a time cannot be placed and are late. With
    ``wait_seconds`` rows wait for that much event time of their key; after
    ``idle_seconds`` without rows of the key they are released all the same
    (continuous triggers; rows that wait when a drained query stops stay in its
    checkpoint). Without it a micro-batch is the buffer. ``initial`` has the keys
    and a JSON text ``state_text`` per key for the first batch of a new query."""
    spark = rows.sparkSession
    use_state_store(spark)
    plain = [micros(F.col(n)).alias(n) if t.startswith("timestamp") else F.col(n) for n, t in rows.dtypes]
    coded = rows.select(*keys, *[F.coalesce(c.cast("long"), F.lit(_NULL)).alias(f"order_{i}") for i, c in enumerate(order)],
                        F.to_json(F.struct(*plain)).alias("row_text"))
    kinds = dict(rows.dtypes)
    out = coded.groupBy(*keys).transformWithStateInPandas(
        _processor(step, len(order), int(wait_seconds * 1e6), None if idle_seconds is None else int(idle_seconds * 1e3),
                   list(keys)),
        ", ".join(f"{k} {kinds[k]}" for k in keys) + ", late boolean, out string", "append",
        "None" if idle_seconds is None else "ProcessingTime",
        initialState=None if initial is None else initial.groupBy(*keys))
    long_times = ", ".join(f"`{n}` {'long' if t.startswith('timestamp') else t}" for n, t in rows.dtypes)
    return out.select(*keys, "late", F.when(~F.col("late"), F.from_json("out", out_schema)).alias("out"),
                      F.when(F.col("late"), F.from_json("out", long_times)).alias("row"))
