"""Cool-downs by successor pointers, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from courierlens.operators import scenes, temporal
from courierlens.operators.cooldown import taken


def by_hand(rows, seconds, gap=None):
    """Ids that go through, of (key, t, id, reset)."""
    last, before, out = {}, {}, []
    for key, u, i, reset in sorted(((k, round(t * 1_000_000), i, x) for k, t, i, x in rows), key=lambda r: (r[1], r[2])):
        if key not in last or reset or u - before[key] >= (gap or seconds) * 1_000_000 or u - last[key] >= seconds * 1_000_000:
            out.append(i)
            last[key] = u
        before[key] = u
    return sorted(out)


@pytest.mark.parametrize(("seconds", "gap", "resets"), [(10, None, False), (10, 3, False), (7.5, None, True), (1, 1, True)])
def test_taken_equals_a_loop(spark, seconds, gap, resets):
    r = random.Random(seconds * 7 + resets)
    rows, t = [], dict.fromkeys(("a", "b", None), 1e9)
    for i in range(400):
        key = r.choice(["a", "a", "a", "b", None])
        t[key] += r.choice([0, 0, 0.5, 1, 2, 2.5, 4, 9.75, 10, 35])
        rows.append((key, t[key], i, resets and r.random() < 0.05))
    df = spark.createDataFrame(rows, "k string, t double, id long, reset boolean").repartition(3)
    found = taken(df, ["k"], seconds, gap, F.col("reset") if resets else None)
    assert found.columns == ["k", "t", "id", "reset"]
    assert sorted(x.id for x in found.collect()) == by_hand(rows, seconds, gap)
    assert taken(df.limit(0), ["k"], seconds).collect() == []


def test_a_key_with_an_event_each_second_of_a_week(spark):
    n = 7 * 86_400
    incidents = spark.range(n).select(F.lit("u").alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.col("id").alias("incident_id"))
    found = sorted(r.incident_id for r in temporal.volume_anomaly(incidents).collect())
    assert found == list(range(4, n, 1800))


def test_versions_that_are_analysed(spark):
    rows = [(0, "Active"), (10, "Active"), (31, "Active"), (40, "Completed"), (45, "Completed"), (69, "Active"), (70, "Timeout"), (71, "Active")]
    events = spark.createDataFrame([("s", i, t, s) for i, (t, s) in enumerate(rows)] + [("t", 100, 5, "Completed"), (None, 200, 1, None)], "session_id string, seq long, t long, status string")
    found = scenes.reanalysis(events.withColumn("ts", F.timestamp_seconds("t")))
    # the first, one after the window, the one that finishes, and one a window after that
    assert sorted(r.seq for r in found.collect()) == [0, 2, 3, 6, 100, 200]


def test_an_upload_ends_when_idle_or_old(spark):
    uri = "/up?composeId=c%3A1&attachmentId=1&offset="
    chunks = [(i, "ip", f"{uri}{i}", t, str(i)) for i, t in enumerate([0, 100, 200, 300, 400, 500, 599, 600, 700, 1000])]
    rows = spark.createDataFrame(chunks, "chunk_id long, client_ip string, uri string, t long, data string").withColumn("ts", F.timestamp_seconds("t"))
    found = temporal.reassembled(rows).orderBy("started").collect()
    assert [r.data for r in found] == ["0123456", "78", "9"] and [r.n_chunks for r in found] == [7, 2, 1]


def test_the_key_of_a_repeat_is_short_and_known_events_are_written_once(spark, monkeypatch):
    """One digest for all key columns, nulls included; of the chains each round writes only what it finds."""
    from courierlens.operators import cooldown

    seen = []
    monkeypatch.setattr(cooldown, "written", lambda df, name, f=cooldown.written: seen.append((name, out := f(df, name), out.count())) or out)
    rows = [(i, "ip" if i % 2 else None, "GET", "/u?x=1&offset=" + str(i), None, 10 * i, None) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id long, client_ip string, method string, uri string, filename string, t long, none void").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted(r.session_id for r in temporal.dedup_sessions(df.drop("none"), 60).collect())
    assert got == sorted(by_hand([(r[1], float(r[5]), r[0], False) for r in rows], 60))
    assert all(x.schema["_key"].dataType.simpleString() == "struct<_k:binary>" for _, x, _ in seen)
    assert sum(n for name, _, n in seen if name == "known") == len(got)
    assert sorted(r.session_id for r in temporal.dedup_sessions(df, 60).collect()) == got
