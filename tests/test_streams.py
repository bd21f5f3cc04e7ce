"""Streams whose events arrive out of order, in large groups and over several micro-batches."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from prunescan.operators import membership
from prunescan.plans import catalogue
from prunescan.streaming import streams


def written(folder, rows, schema, files):
    """Rows in shuffled order, dealt over files."""
    rows = list(rows)
    random.Random(4).shuffle(rows)
    for i in range(files):
        pq.write_table(pa.Table.from_pylist(rows[i::files], schema), f"{folder}/part-{i:02}.parquet")
    return str(folder)


def members(events):
    out: dict = {}
    for e in sorted(events, key=lambda e: e["seq"]):
        own = out.setdefault(e["cluster"], set())
        if e["kind"] == "Snapshot":
            own.clear()
            own.update(e["members"])
        elif e["kind"] == "Joined":
            own.add(e["node"])
        else:
            own.discard(e["node"])
    return {(c, n) for c, own in out.items() for n in own}


@pytest.mark.parametrize("files_per_trigger", [None, 2])
def test_membership_of_a_stream_in_any_order(spark, tmp_path, files_per_trigger):
    rng, events = random.Random(1), []
    for seq in range(30_000):
        kind = rng.choices(["Joined", "Left", "Snapshot"], [50, 50, 0.02])[0]
        events.append({"cluster": seq % 2, "seq": seq, "kind": kind, "node": None if kind == "Snapshot" else f"n{rng.randrange(40)}", "members": ["n1", "n2", "x"] if kind == "Snapshot" else None})
    schema = pa.schema({"cluster": pa.int64(), "seq": pa.int64(), "kind": pa.string(), "node": pa.string(), "members": pa.list_(pa.string())})
    stream = streams.read_stream(spark, written(tmp_path, events, schema, 6), files_per_trigger)
    state = streams.run_available(membership.latest(stream), spark.conf.get("spark.checkpoint.dir"), "update")
    got = membership.fold(state).collect()
    assert len(got) == len(members(events)) and {tuple(r) for r in got} == members(events)


@pytest.mark.parametrize("files_per_trigger", [None, 2])
def test_the_earliest_of_equal_requests_in_any_order(spark, tmp_path, files_per_trigger):
    rng = random.Random(2)
    rows = [{"user": rng.choice([None, *range(200)]), "ts": rng.randrange(10**9), "id": i} for i in range(20_000)]
    rows += [{"user": 1000, "ts": None, "id": -1}, {"user": 1001, "ts": None, "id": -2}, {"user": 1001, "ts": 5, "id": -3}]
    schema = pa.schema({"user": pa.int64(), "ts": pa.timestamp("us"), "id": pa.int64()})
    stream = streams.read_stream(spark, written(tmp_path, rows, schema, 6), files_per_trigger)
    state = streams.run_available(streams.earliest(stream, ["user"], "ts"), spark.conf.get("spark.checkpoint.dir"), "update")
    got = [(r.user, r.id) for r in streams.earliest(state, ["user"], "ts").collect()]
    want = {}
    for r in sorted(rows, key=lambda r: (r["ts"] is None, r["ts"] or 0)):
        want.setdefault(r["user"], r["id"])
    assert len(got) == len(want) and dict(got) == want


def test_the_registered_stream_of_first_requests(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"event_id": i, "ts": rng.randrange(10**15), "user_id": i % 50, "event_type": "click", "value": 1.0, "props": "{}"} for i in range(20_000)]
    schema = pa.schema({"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64(), "props": pa.string()})
    (tmp_path / "events.parquet").mkdir()
    written(tmp_path / "events.parquet", rows, schema, 5)
    got = spark.createDataFrame([], "user_id long, ts timestamp_ntz").unionByName(catalogue.QUERIES["stream_dedupe"](spark, str(tmp_path)))
    least = {u: min(r["ts"] for r in rows if r["user_id"] == u) for u in range(50)}
    assert {r.user_id: r.us for r in got.selectExpr("user_id", "unix_micros(cast(ts as timestamp)) AS us").collect()} == least
