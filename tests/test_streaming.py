"""States and responses kept up from streams: replays, failed writes, disorder and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.streaming import responses, state

KEY, ORDER = ["user"], ["ts", "n"]
SCHEMA = "user string, ts int, n int, state string, other int"


def newest(rows):
    out = {}
    for user, ts, n, value, _ in rows:
        out[user] = max(out.get(user, (ts, n, value)), (ts, n, value))
    return {u: v for u, (_, _, v) in out.items()}


def held(spark, path, fanin=state.FANIN):
    return {r.user: r.state for r in state.saved(spark, path, KEY, ORDER, "state", fanin).collect()}


@pytest.mark.parametrize("fanin", [2, 3, 4])
def test_runs_hold_all_batches(fanin):
    kept = set()
    for number in range(200):
        run, parts = state.folded_by(number, fanin)
        assert set(parts) <= kept
        kept = (kept - set(parts)) | {run}
        assert sorted(kept) == state.spans(number + 1, fanin)
        assert len(kept) <= 1 + (fanin - 1) * 8


def test_a_batch_costs_its_own_rows():
    """All batches of one size: each row is written once for every power of FANIN."""
    written = sum(run[1] - run[0] for run, _ in (state.folded_by(n) for n in range(256)))
    assert written == 256 * 4


def test_replays_and_failed_writes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"u{rng.randrange(40)}", rng.randrange(50), k, f"s{k}", k) for k in range(300)]
    path = str(tmp_path / "states")
    save = state.saver(path, KEY, ORDER, "state", 2)
    with pytest.raises(Exception, match="states"):
        state.saved(spark, path, KEY, ORDER, "state", 2)
    for number in range(12):
        batch = spark.createDataFrame(rows[number * 25 : (number + 1) * 25], SCHEMA)
        if number % 5 == 3:
            before = held(spark, path, 2)
            with pytest.raises(Exception, match="lost"):
                save(batch.withColumn("state", F.when(F.col("n") % 25 == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("state"))), number)
            assert held(spark, path, 2) == before == newest(rows[: number * 25])
        save(batch, number)
        assert held(spark, path, 2) == newest(rows[: (number + 1) * 25])
        if number % 4 == 1:
            save(batch, number)
            assert held(spark, path, 2) == newest(rows[: (number + 1) * 25])


def test_autosave(spark, tmp_path):
    rows = [("u", 1, 1, "x", 0), ("u", 2, 1, "y", 0), ("v", 1, 1, "z", 0), ("u", 1, 2, "late", 0), ("v", 3, 1, "w", 0), (None, 1, 1, None, 0)]
    for k in range(0, 6, 2):
        spark.createDataFrame(rows[k : k + 2], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second finds nothing new
        q = state.autosave(stream, str(tmp_path / "out"), str(tmp_path / "cp"), KEY, ORDER, "state").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert held(spark, str(tmp_path / "out")) == {"u": "y", "v": "w", None: None}


RESPONSES = "view long, number long, kind string, at timestamp, body string"


def rows_of(spark, events):
    return spark.createDataFrame([(v, n, k, t, b) for v, n, k, t, b in events], "view long, number long, kind string, t long, body string").select("view", "number", "kind", F.timestamp_seconds("t").alias("at"), "body")


def plain(events):
    out, newest_, done = set(), {}, set()
    for v, n, k, t, b in sorted(events, key=lambda e: (e[3], e[2] != "request", e[1], e[4] or "")):
        if k == "request":
            newest_[v] = max(newest_.get(v, n), n)
        elif newest_.get(v) == n and (v, n) not in done:
            done.add((v, n))
            out.add((v, n, t, b))
    return out


def test_latest_response_wins(spark):
    events = [(1, 1, "request", 10, ""), (1, 1, "response", 12, "a"), (1, 1, "response", 13, "again"), (1, 2, "request", 20, ""), (1, 3, "request", 21, ""), (1, 2, "response", 22, "late"), (1, 3, "response", 23, "b"), (2, 1, "response", 5, "unasked"), (2, 1, "request", 6, ""), (2, 2, "request", 9, ""), (2, 1, "response", 9, "same time")]
    got = {(r.view, r.number, int(r.at.timestamp()), r.body) for r in responses.accepted(rows_of(spark, events)).collect()}
    assert got == plain(events) == {(1, 1, 12, "a"), (1, 3, 23, "b")}


def test_streamed_responses_out_of_order(spark, tmp_path):
    rng = random.Random(3)
    events = []
    for view in range(12):
        t = 1000
        for number in range(1, 40):
            t += rng.randrange(1, 40)
            events.append((view, number, "request", t, ""))
            for k in range(rng.choice([0, 1, 1, 2])):
                events.append((view, number, "response", t + rng.randrange(0, 60), f"b{k}"))
    came = sorted(events, key=lambda e: e[3] + rng.randrange(0, 50))
    files = [came[k : k + 200] for k in range(0, len(came), 200)] + [[(-1, 0, "request", 10**6, "")]]
    for part in files:
        rows_of(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows_of(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = responses.latest_only(stream, "50 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = [(r.view, r.number, int(r.at.timestamp()), r.body) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(events)
    rows = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert rows <= 1  # views without rows are forgotten
