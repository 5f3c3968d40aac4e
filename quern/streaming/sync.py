"""Stateful record sync: a base and a stream of field sets make the current record."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.shipping import ship

STATE = "record string, last long"


def _advance(key, frames, state: GroupState):
    """Ops by seq; those at or below the last applied one are replays and change nothing."""
    record, last = state.get if state.exists else ("{}", -1)
    fields = json.loads(record)
    rows = pd.concat(list(frames), ignore_index=True).sort_values("seq", kind="stable")
    applied = 0
    for seq, name, value in zip(rows["seq"].tolist(), rows["field"].tolist(), rows["value"].tolist(), strict=True):
        if seq <= last:
            continue
        last, applied = seq, applied + 1
        if value is None or value == "":
            fields.pop(name, None)
        else:
            fields[name] = value
    record = json.dumps(fields, sort_keys=True, separators=(",", ":"))
    state.update((record, last))
    yield pd.DataFrame({"id": [key[0]], "last": [last], "applied": [applied], "record": [record]})


def sync(ops: DataFrame) -> DataFrame:
    """Current record (JSON) after each batch, from a stream of (id long, seq long, field string, value string).

    An empty or null value clears its field.  State is one record an id.
    """
    ship(ops.sparkSession)
    return ops.groupBy("id").applyInPandasWithState(_advance, "id long, last long, applied long, record string", STATE, "update", GroupStateTimeout.NoTimeout)
