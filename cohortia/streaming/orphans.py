"""Extension: orphan references over a stream, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "campo string, codigo string, pendientes bigint"
EVENT = "campo string, codigo string, tipo string, dia int, hasta int, n bigint"
STATE = "spans string, waiting string"


def pending_stream(events: DataFrame) -> DataFrame:
    """Pending orphans per (campo, codigo) after each micro-batch.

    events: campo, codigo, tipo (REF, ALTA, BAJA), dia, hasta. ALTA adds a validity span [dia, hasta], BAJA removes it, REF is
    a reference on dia. The state of a key is its spans and the number of references per day, so it is bounded by the
    calendar, not by the number of references. References are counted per day in each task before they are shuffled, so
    a code with a third of all rows is a few rows per task.
    """
    import json

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans, refs = (json.loads(state.get[0]), json.loads(state.get[1])) if state.exists else ([], {})
        for f in frames:
            for kind, day, until, n in zip(f["tipo"], f["dia"], f["hasta"], f["n"]):
                span = [None if pd.isna(day) else int(day), None if pd.isna(until) else int(until)]
                if kind == "ALTA" and span not in spans:
                    spans.append(span)
                elif kind == "BAJA" and span in spans:
                    spans.remove(span)
                elif kind == "REF":
                    at = "" if span[0] is None else str(span[0])
                    refs[at] = refs.get(at, 0) + int(n)
        state.update((json.dumps(spans), json.dumps(refs)))
        inside = lambda d: any((a is None or a <= d) and (b is None or d <= b) for a, b in spans)
        waiting = sum(n for d, n in refs.items() if not (bool(spans) if d == "" else inside(int(d))))
        yield pd.DataFrame({"campo": [key[0]], "codigo": [key[1]], "pendientes": [waiting]})

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            counted = f[f["tipo"] == "REF"].groupby(["campo", "codigo", "dia"], dropna=False).size().rename("n").reset_index()
            counted["tipo"], counted["hasta"] = "REF", None
            yield pd.concat([f[f["tipo"] != "REF"].assign(n=1), counted])[["campo", "codigo", "tipo", "dia", "hasta", "n"]]

    counted = events.select("campo", "codigo", "tipo", "dia", "hasta").mapInPandas(combine, EVENT)
    return counted.groupBy("campo", "codigo").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
