"""The reduction of an unbounded line stream, with one fold per stream as state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logdistill.operators.kernel import Options, Reducer
from logdistill.plans.distill import scored

OUTPUT = "stream_id string, out_no long, text string, score double"


def reduce_stream(lines: DataFrame, options: Options | None = None, idle: str = "1 minute") -> DataFrame:
    """Reduced lines of a streaming DataFrame(stream_id, line_no, value).

    Lines of a micro-batch are put in order; later batches must hold later lines.
    A stream ends when nothing comes for ``idle`` (pending groups and the PEM
    warning go out then), or with a row whose value is null. Passes that need the
    whole output and boosts of running source counts belong to batch jobs. Idle
    time is processing time, for which Spark keeps running batches without data:
    start the query with a processing-time trigger or ``once``; with
    ``availableNow`` it doesn't end.
    """
    o = options or Options()
    if o.collapse_blocks is not None or o.max_tokens is not None or o.multiline != "off":
        raise ValueError("block, budget and multiline passes need the whole stream")
    wait = int(idle.split()[0]) * {"s": 1000, "m": 60_000, "h": 3_600_000}[idle.split()[1][0]]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, sent = pickle.loads(state.get[0]) if state.exists else (Reducer(o), 0)
        ended = state.hasTimedOut
        if not ended:
            pdf = pd.concat(list(batches)).sort_values("line_no")
            for r in pdf.to_dict("records"):
                row = {k: None if v is None or (isinstance(v, float) and v != v) else v for k, v in r.items()}
                if row["value"] is None:
                    ended = True
                    break
                fold.push(SimpleNamespace(**row))
        if ended:
            fold.close()
        out, fold.out, fold.decisions = fold.out, [], []
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps((fold, sent + len(out))),))
            state.setTimeoutDuration(wait)
        told = pd.DataFrame({"stream_id": [key[0]] * len(out), "out_no": range(sent, sent + len(out)), "text": [t for t, _ in out], "score": [float(s) for _, s in out]})
        yield told.astype({"stream_id": object, "text": object})

    return scored(lines, o, sources=False).groupBy("stream_id").applyInPandasWithState(
        step, OUTPUT, "fold binary", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def run_with_timeout(query, seconds: float) -> bool:
    """Waits for a streaming query; stops it and returns True if it takes longer."""
    if query.awaitTermination(seconds):
        return False
    query.stop()
    return True
