"""The expression log kept from a stream of events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.operators.history import LIMIT, apply_event

OUT = "user string, items string"


def keep_history(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """events: a stream of (user, seq, action, expr, name). After each batch, each user's list so far as JSON (update
    mode). A batch's rows are applied in the order of seq; rows of an earlier seq in a later batch in that of arrival."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        items = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for r in rows.itertuples(index=False):
            items = apply_event(items, r.action, r.expr, r.name, limit)
        state.update((json.dumps(items),))
        yield pd.DataFrame({"user": [key[0]], "items": [json.dumps(items)]})

    typed = events.select(F.col("user").cast("string").alias("user"), "seq", "action", "expr", "name")
    return typed.groupBy("user").applyInPandasWithState(run, OUT, "items string", "update", "NoTimeout")
