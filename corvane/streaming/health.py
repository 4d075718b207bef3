"""Health of stores as keyed state: a failure is remembered until a success clears it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_health(events: DataFrame) -> DataFrame:
    """Batch twin: the last event of each store decides: events(store, seq, ok)."""
    return events.groupBy("store").agg(F.max_by("ok", "seq").alias("ok"), F.max("seq").alias("seq"))


def track_health(events: DataFrame) -> DataFrame:
    """Stream of events(store, seq, ok) to updates (store, ok, seq); state is one row for each store."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, ok = state.get if state.exists else (-1, True)
        for pdf in batches:
            last = pdf.loc[pdf["seq"].idxmax()]
            if last["seq"] > seq:
                seq, ok = int(last["seq"]), bool(last["ok"])
        state.update((seq, ok))
        yield pd.DataFrame({"store": [key[0]], "ok": [ok], "seq": [seq]})

    return events.groupBy("store").applyInPandasWithState(update, "store string, ok boolean, seq long", "seq long, ok boolean", "update", GroupStateTimeout.NoTimeout)
