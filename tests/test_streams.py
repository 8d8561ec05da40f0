"""Streaming forms against their batch forms, over several micro-batches and a restart."""

import os
import random
from datetime import datetime, timedelta
from functools import partial

import pytest
from pyspark.sql import functions as F

from courierlens.operators import scenes, temporal
from courierlens.streaming import processors, state
from courierlens.streaming import scenes as scene_table

START = datetime(2024, 5, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    processors.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def write(spark, rows, schema, folder, number):
    """One file of the source; its time says that it comes after the ones before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    for name in os.listdir(folder):
        if name.endswith(".parquet") and not name.startswith("part-seen"):
            new = f"{folder}/part-seen-{number}.parquet"
            os.rename(f"{folder}/{name}", new)
            os.utime(new, (1_700_000_000 + number, 1_700_000_000 + number))


def streamed(spark, tmp_path, parts, schema, form):
    """What comes out of three micro-batches, the last one after a restart from the checkpoint."""
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = form(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(240)

    for i, part in enumerate(parts):
        write(spark, part, schema, source, i)
        if i >= len(parts) - 2:
            run()
    return spark.read.parquet(sink)


def cut(rows, late=0):
    """Rows by time in three parts; some of each part come with the next one."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    n, r = len(rows), random.Random(4)
    place = [min(2, i * 3 // n + (late and r.random() < 0.2 and i * 3 % n > n - 3 * late)) for i in range(n)]
    return [[x for x, p in zip(rows, place, strict=True) if p == k] for k in range(3)]


ENTITY = "entity_key long, ts timestamp, seq long, risk double, u_final double, k_conflict double"


@pytest.mark.parametrize("name", ["cusum", "hawkes", "hmm_phase"])
def test_entities(spark, tmp_path, name):
    r = random.Random(8)
    rows = [(i % 4, START + timedelta(minutes=i * 7 + r.randrange(5)), i, r.random() ** 3, r.random(), r.random()) for i in range(160)]
    form = partial(getattr(processors, name), ttl_ms=None)
    found = {(x.entity_key, x.seq): x for x in streamed(spark, tmp_path, cut(rows), ENTITY, form).collect()}
    events = spark.createDataFrame(rows, ENTITY)
    assert len(found) == len(rows)
    if name == "cusum":
        for x in temporal.cusum(events).collect():
            got = found[x.entity_key, x.seq]
            assert abs(got.s_plus - x.s_plus) < 1e-9 and abs(got.s_minus - x.s_minus) < 1e-9 and got.alarm == x.alarm
        return
    last = {k: max((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))[2] for k in range(4)}
    for x in getattr(temporal, name)(events).collect():
        got = found[x.entity_key, last[x.entity_key]]
        if name == "hawkes":
            assert got.n == x.n and got.burst == x.burst and all(abs(got[c] - x[c]) < 1e-9 for c in ("mu", "intensity", "ratio"))
        else:
            assert got.phase == x.phase and abs(got.risk - x.risk) < 1e-9 and all(abs(a - b) < 1e-9 for a, b in zip(got.posterior, x.posterior, strict=True))


END = START + timedelta(days=30)


def same(found, want, columns):
    key = lambda df: sorted(tuple(x[c] for c in columns) for x in df.collect())
    assert key(found) == key(want)
    return len(key(want))


def test_volume_with_late_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(i % 2, START + timedelta(seconds=20 * i + r.choice([0, 0, 300])), i) for i in range(900)]
    schema = "user_id long, ts timestamp, incident_id long"
    parts = cut(rows, late=20)
    parts[2] = [*parts[2], (99, END, 9999)]  # moves the watermark beyond all rows
    found = streamed(spark, tmp_path, parts, schema, lambda s: processors.volume_anomaly(s, late="20 minutes"))
    assert same(found.filter("user_id < 9"), temporal.volume_anomaly(spark.createDataFrame(rows, schema)), ["user_id", "incident_id", "in_window", "severity"]) > 10


def test_compliance_with_late_rows(spark, tmp_path):
    r = random.Random(5)
    rows = [(i % 3, START + timedelta(minutes=11 * i), i, r.choice([1, 2, 3, 3, 4]), r.randrange(30)) for i in range(600)]
    schema = "user_id long, ts timestamp, incident_id long, level int, item_count int"
    parts = cut(rows, late=5)
    parts[2] = [*parts[2], (99, END, 9999, 4, 1)]
    found = streamed(spark, tmp_path, parts, schema, lambda s: processors.jrt_compliance(s, late="6 hours"))
    assert same(found, temporal.jrt_compliance(spark.createDataFrame(rows, schema)), ["user_id", "incident_id", "rule", "total"]) > 10


def test_versions_with_late_rows(spark, tmp_path):
    r = random.Random(6)
    rows = [(i % 5, START + timedelta(seconds=7 * i), i, r.choice(["Active"] * 9 + ["Completed", "Timeout"])) for i in range(300)]
    schema = "session_id long, ts timestamp, seq long, status string"
    parts = cut(rows, late=20)
    parts[2] = [*parts[2], (99, END, 9999, "Active")]
    found = streamed(spark, tmp_path, parts, schema, lambda s: processors.reanalysis(s, late="20 minutes"))
    assert same(found.filter("session_id < 9"), scenes.reanalysis(spark.createDataFrame(rows, schema)), ["session_id", "seq"]) > 20


def test_uploads_with_late_chunks(spark, tmp_path):
    r = random.Random(9)
    rows, t = [], START
    for i in range(200):
        t += timedelta(seconds=r.choice([5, 20, 60, 119, 121, 300]))
        rows.append((f"ip{i % 2}", t, i, f"/up?composeId=c%3A{i % 2}&attachmentId=7&offset={r.randrange(6)}", f"<{i}>"))
    schema = "client_ip string, ts timestamp, chunk_id long, uri string, data string"
    parts = cut(rows, late=5)
    parts[2] = [*parts[2], ("ip9", END, 9999, "/up?composeId=z&attachmentId=1", "end")]
    found = streamed(spark, tmp_path, parts, schema, lambda s: processors.reassembled(s, late="30 minutes"))
    assert same(found, temporal.reassembled(spark.createDataFrame(rows, schema)), ["client_ip", "compose_id", "attachment_id", "started", "n_chunks", "size", "data"]) > 20


def test_scenes_are_the_same_when_a_batch_is_repeated(spark, tmp_path):
    path = str(tmp_path / "scenes")
    schema = "scene_type string, actor string, severity string, first_seen timestamp, last_seen timestamp, mails long"
    row = lambda actor, severity, day, mails: ("bulk", actor, severity, START + timedelta(days=day), START + timedelta(days=day), mails)
    merge = scene_table.merged(path, lambda batch: batch)
    batches = [[row("a", "high", 0, 5), row("b", "medium", 0, 3)], [row("a", "medium", 1, 2), row("c", "critical", 1, 9)], [row("c", "high", 4, 1)]]
    want = None
    for i, rows in enumerate(batches):
        merge(spark.createDataFrame(rows, schema), i)
        before = sorted(scene_table.scenes(spark, path).collect())
        merge(spark.createDataFrame(rows, schema), i)  # as after a failure before the commit
        assert sorted(scene_table.scenes(spark, path).collect()) == before != want
        want = before
    found = {x.actor: (x.severity, x.status, x.mails, x.first_seen) for x in scene_table.scenes(spark, path).collect()}
    assert found == {"a": ("high", "resolved", 7, START), "b": ("medium", "resolved", 3, START), "c": ("critical", "blocked", 10, START + timedelta(days=1))}
    for i in range(3, 8):
        merge(spark.createDataFrame([], schema), i)
    assert scene_table.versions(spark, path) == [5, 6, 7]


def test_scenes_of_a_stream(spark, tmp_path):
    schema = "sender string, ts timestamp, id long"
    find = lambda batch: batch.groupBy(F.lit("bulk").alias("scene_type"), F.col("sender").alias("actor")).agg(F.lit("medium").alias("severity"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("mails"))
    for i in range(3):
        write(spark, [("s", START + timedelta(hours=i), i), ("t", START + timedelta(hours=i), 10 + i)][: 2 - i // 2], schema, str(tmp_path / "in"), i)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(scene_table.merged(str(tmp_path / "table"), find)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {(x.actor, x.mails, x.status) for x in scene_table.scenes(spark, str(tmp_path / "table")).collect()} == {("s", 3, "active"), ("t", 2, "active")}


def test_messages_and_counts_of_a_stream(spark, tmp_path):
    rows = [("a", START, 1, " <M@X> "), ("b", START + timedelta(minutes=1), 2, "m@x"), ("c", START + timedelta(minutes=2), 3, None), ("d", START + timedelta(minutes=3), 4, ""), ("f", START + timedelta(hours=2), 5, "other"), ("e", START + timedelta(hours=3), 6, "m@x")]
    schema = "id string, started_at timestamp, seq long, message_id string"
    found = streamed(spark, tmp_path, [rows[:2], rows[2:4], rows[4:5], rows[5:]], schema, state.message_dedup)
    assert sorted(x.id for x in found.collect()) == ["a", "c", "d", "e", "f"]
