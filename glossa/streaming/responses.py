"""Responses that may still be shown: a view's newest request wins, what comes late or twice is dropped.

A view numbers its requests; the response to one is taken if no newer request was made up to then, once. On a stream, rows
of a view may come out of order: they wait until the watermark has passed them, so that all that happened before is known,
and are then decided in the order of their times. What a view must remember is two numbers and what still waits; it is
forgotten after a time without rows, and responses to a forgotten request are late by definition.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REQUEST, RESPONSE = "request", "response"
_STATE = "newest long, answered long, waiting array<struct<number:long,kind:string,at:timestamp,body:string>>"


def accepted(rows: DataFrame) -> DataFrame:
    """(view, number, at, body) of a finished log (view, number, kind, at, body): one window pass. A request counts before
    a response of the same time; of responses to one request at one time the least body counts."""
    order = [F.col("at"), F.col("kind") != REQUEST, F.col("number"), F.col("body")]
    sofar = Window.partitionBy("view").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    newest = F.max(F.when(F.col("kind") == REQUEST, F.col("number"))).over(sofar)
    right = rows.withColumn("__newest", newest).filter((F.col("kind") == RESPONSE) & (F.col("number") == F.col("__newest")))
    first = Window.partitionBy("view", "number").orderBy("at", "body")
    return right.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select("view", "number", "at", "body")


def _decider(idle_ms: int):
    def decide(key, batches, state: GroupState):
        newest, answered, waiting = state.get if state.exists else (None, None, [])
        rows = [(r["number"], r["kind"], r["at"], r["body"]) for r in waiting] if waiting else []
        for batch in batches:
            rows += list(batch[["number", "kind", "at", "body"]].itertuples(index=False, name=None))
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        rows.sort(key=lambda r: (r[2], r[1] != REQUEST, r[0], r[3] or ""))
        out, left = [], []
        for number, kind, at, body in rows:
            if pd.Timestamp(at) > mark:
                left.append((int(number), kind, pd.Timestamp(at).to_pydatetime(), body))
            elif kind == REQUEST:
                newest = number if newest is None else max(newest, number)
            elif number == newest and number != answered:
                answered = number
                out.append((key[0], number, at, body))
        if state.hasTimedOut and not left:
            state.remove()
        else:
            state.update((None if newest is None else int(newest), None if answered is None else int(answered), left))
            first = min((pd.Timestamp(r[2]) for r in left), default=mark + pd.Timedelta(milliseconds=idle_ms))
            state.setTimeoutTimestamp(max(int(first.value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["view", "number", "at", "body"])

    return decide


def latest_only(stream: DataFrame, delay: str, idle_ms: int = 86_400_000) -> DataFrame:
    """The accepted rows of a stream (view, number, kind, at, body) whose rows are at most `delay` out of order; later ones are
    dropped. A view without rows for idle_ms is forgotten."""
    told = stream.select("view", "number", "kind", "at", "body").withWatermark("at", delay)
    return told.groupBy("view").applyInPandasWithState(_decider(idle_ms), "view long, number long, at timestamp, body string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
