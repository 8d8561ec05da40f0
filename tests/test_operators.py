"""Operators on hand-made rows: relays, rules, recurrences, DLP, streams."""

import datetime as dt
import math

from pyspark.sql import functions as F

from courierlens.operators import dlp, fusion, relational, temporal, text, training
from courierlens.schemas import severity_step, threat_level
from courierlens.sources import indicators, sessions
from courierlens.streaming import state

T = dt.datetime(2024, 1, 1)


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


def test_ladders(spark):
    rows = spark.createDataFrame([(0.0, "info"), (0.15, "low"), (0.4, "medium"), (0.65, "high"), (0.85, "critical"), (None, None)], "s double, v string")
    got = rows.select(threat_level(F.col("s")), severity_step(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("safe", "low"), ("low", "medium"), ("medium", "high"), ("high", "critical"), ("critical", "critical"), (None, None)]


def test_hops_end_at_the_last_delivery(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = [(1, "a", "b", "f", ["r"], at(0)), (2, "b", "c", "f", ["r"], at(60)), (3, "c", "d", "f", ["r"], at(120)), (4, "b", "x", "g", ["r"], at(60)), (5, "b", "y", "f", ["r"], at(900)), (6, "q", "a", None, ["r"], at(0)), (7, "a", "z", None, ["r"], at(1))]
    df = spark.createDataFrame(rows, "session_id long, client_ip string, server_ip string, mail_from string, recipients array<string>, started_at timestamp")
    assert {(r.session_id, r.next_id) for r in relational.hops(df).collect()} == {(1, 2), (2, 3), (6, 7)}
    assert {r.session_id: r.terminal_id for r in relational.terminal_hop(df).collect()} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5, 6: 7, 7: 7}


def test_hops_end_at_the_last_delivery_whatever_the_ids(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = [(9, "a", "b", "f", ["r"], at(0)), (4, "b", "c", "f", ["r"], at(60)), (2, "c", "d", "f", ["r"], at(120)), (5, "p", "q", "f", ["r"], at(0)), (6, "q", "p", "f", ["r"], at(0))]
    df = spark.createDataFrame(rows, "session_id long, client_ip string, server_ip string, mail_from string, recipients array<string>, started_at timestamp")
    assert {r.session_id: r.terminal_id for r in relational.terminal_hop(df).collect()} == {9: 2, 4: 2, 2: 2, 5: 6, 6: 6}


def test_relay_gaps(spark):
    schema = "session_id long, message_id string, mail_from string, recipients array<string>, started_at timestamp"
    first = spark.createDataFrame([(1, "m1", "f", ["A", "b"], at(0)), (2, "m2", "f", ["x"], at(0))], schema)
    second = spark.createDataFrame([(11, "m1", "f", ["b", "a"], at(10)), (12, "m9", "f", ["B", "a"], at(10)), (13, "m8", "g", ["q"], at(10)), (14, "m2", "f", ["x"], at(100))], schema)
    assert {r.session_id: r.gap for r in relational.relay_gaps(second, first).collect()} == {12: "same_envelope_other_id", 13: "none", 14: "none"}


def test_many_rules_all_count(spark):
    lists = [[], ["a"], ["b", "a"], ["a", "b", "c"], ["a", None], None]
    verdicts = spark.createDataFrame([(i, i % 4, c, m, d) for i, (c, m, d) in enumerate((c, m, d) for c in lists for m in lists for d in ("inbound", "outbound", None))] + [(0, 0, [], [], "inbound")], "session_id long, level_rank int, categories array<string>, modules array<string>, direction string")
    kinds = [(c, m, d) for c in lists for m in lists for d in ([], ["inbound"], ["outbound", "inbound"])]
    schema = "rule_id int, priority int, min_rank int, categories array<string>, modules array<string>, directions array<string>, action string"
    rules = spark.createDataFrame([(i, i, i % 3, *k, "log") for i, k in enumerate(kinds)] + [(0, 0, 0, [], [], [], "log")], schema)
    few, many = (sorted(map(tuple, relational.disposition(verdicts, rules, **k).collect())) for k in ({}, {"most": 10}))
    assert few == many and len(few) > 1000
    beyond = spark.range(10_050).selectExpr("cast(id as int) rule_id", "0 priority", "0 min_rank", "array('a') categories", "cast(array() as array<string>) modules", "array('inbound') directions", "'log' action")
    one = spark.createDataFrame([(1, 0, ["a"], [], "inbound")], verdicts.schema)
    assert relational.disposition(one, beyond).count() == 10_050


def test_rules_and_addresses(spark):
    verdicts = spark.createDataFrame([(1, 3, ["phishing"], ["m"], "inbound"), (2, 1, [], [], "outbound")], "session_id long, level_rank int, categories array<string>, modules array<string>, direction string")
    rules = spark.createDataFrame([(1, 10, 2, ["phishing"], [], [], "quarantine"), (2, 20, 0, [], [], ["outbound"], "log"), (3, 30, 3, ["malware"], [], [], "block")], "rule_id int, priority int, min_rank int, categories array<string>, modules array<string>, directions array<string>, action string")
    assert {(r.session_id, r.action) for r in relational.disposition(verdicts, rules).collect()} == {(1, "quarantine"), (2, "log")}
    ips = spark.createDataFrame([(["from a [10.0.0.1] by b", "from c [8.8.4.4] by d"],), (["from a [192.168.1.1]"],), ([],)], "h array<string>")
    assert [r[0] for r in ips.select(relational.external_ip(F.col("h"))).collect()] == ["8.8.4.4", None, None]
    hosts = spark.createDataFrame([("a.b.com",), ("b.com",), ("xb.com",)], "host string")
    rules = spark.createDataFrame([("*.b.com",), ("b.com",)], "rule string")
    assert {tuple(r) for r in relational.policy_matches(hosts, rules).collect()} == {("a.b.com", "*.b.com"), ("b.com", "b.com")}


def test_masses_keep_their_sum(spark):
    rows = spark.createDataFrame([(i % 7, i, ((i * 37) % 101) / 100, ((i * 53) % 97) / 100) for i in range(60)], "k int, i int, score double, confidence double")
    e = fusion.evidence(rows, "k", ("i", "score", "confidence"))
    got = e.select(fusion.dempster(F.col("items.m")).alias("d"), fusion.conjunctive(F.col("items.m")).alias("t"), fusion.murphy(F.col("items.m")).alias("m"), fusion.weight_cap(F.col("items.score")).alias("w")).collect()
    for r in got:
        assert abs(r.d.b + r.d.d + r.d.u - 1) < 1e-9 and abs(r.m.b + r.m.d + r.m.u - 1) < 1e-9
        assert abs(r.t.b + r.t.d + r.t.u + r.t.e - 1) < 1e-9 and abs(sum(r.w) - 1) < 1e-9 and max(r.w) <= 0.4 + 1e-6


def test_recurrences_equal_plain_loops(spark):
    rows = [(k, i, at(i * (700 + 100 * k)), ((i * 31 + k * 7) % 50) / 50, 0.3, 0.0) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "entity_key long, seq long, ts timestamp, risk double, u_final double, k_conflict double")
    got = {r.entity_key: r for r in temporal.hawkes(df).collect()}
    phases = {r.entity_key: r for r in temporal.hmm_phase(df).collect()}
    for k in range(3):
        n, mu, last, past, inten = 0, 0.5, 0.0, [], 0.5
        p, before = list(temporal.PHASE_START), None
        for _, _, t, x, u, c in [r for r in rows if r[0] == k]:
            h = t.replace(tzinfo=dt.timezone.utc).timestamp() / 3600
            heat = sum(0.8 * r**1.5 * math.exp(-2 * (h - s)) for s, r in past)
            inten = mu + heat
            if n > 3:
                mu = max(0.01, mu * 0.995 + 0.005 * min(100, 1 / max(0.001, h - last)))
            past = [(s, r) for s, r in [*past, (h, x)][-100:] if h - s <= 5 * math.log(2) / 2]
            n, last = n + 1, h
            gap = min(720, 48.0 if before is None else h - before)
            steady, calm = math.exp(-((gap - 24) ** 2) / 200), 1 - min(c, 0.5) * 2
            e = [0.1 + (1 - x) * 0.7 + (1 - u) * 0.15 + calm * 0.05, 0.05 + (x * 0.3 + 0.3) * u * 0.5 + steady * 0.15, 0.05 + (1 - x) * 0.2 + 0.3 + u * 0.2 + (x * 0.2 + 0.05), 0.02 + x * 0.6 + (1 - calm) * 0.2 + (1 - u) * 0.03, 0.02 + x * 0.5 + (1 - u) * 0.25 + (1 - steady) * 0.1]
            p = [sum(p[i] * temporal.PHASE_MOVES[i][j] for i in range(5)) * e[j] for j in range(5)]
            p, before = [v / sum(p) for v in p], h
        assert abs(got[k].mu - mu) < 1e-9 and abs(got[k].intensity - inten) < 1e-6
        assert all(abs(a - b) < 1e-9 for a, b in zip(phases[k].posterior, p, strict=True))


def test_dlp_checksums(spark):
    rows = spark.createDataFrame([(1, "pay 4539578763621486 or 4539578763621487 now"), (2, "IBAN DE89370400440532013000 and DE89370400440532013001"), (3, None), (4, 'secret = "abcdef0123456789abcd" mail a.b@example.com noreply@example.com A.b@example.com')], "doc_id long, text string")
    got = {(r.doc_id, r["class"]): r for r in dlp.dlp_findings(rows).collect()}
    assert set(got) == {(1, "credit_card"), (2, "iban"), (4, "credential_leak")}
    assert got[1, "credit_card"].samples == ["45***86"]


def test_lookalikes(spark):
    d = spark.createDataFrame([("paypa1.com",), ("paypal.net",), ("paypai.com",), ("paypal-login.com",), ("other.com",)], "domain string")
    p = spark.createDataFrame([("paypal.com",)], "domain string")
    assert {r.domain: r.kind for r in text.lookalikes(d, p).collect()} == {"paypa1.com": "homoglyph", "paypal.net": "tld_swap", "paypai.com": "edit_distance", "paypal-login.com": "affix"}


def test_folds_are_even(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(300)], "doc_id long, label int")
    counts = training.folds(df, 5).groupBy("label", "fold").count().collect()
    assert len(counts) == 15 and all(r["count"] == 20 for r in counts)


def test_indicator_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text("indicator,ioc_type,verdict,confidence,source,attack_type\nEvil.com,domain,malicious,0.9,feed,\nx,ip,malicious,0.5,feed,\nbad.com,domain,unknown,,feed,\n")
    good, bad = indicators.read_csv(spark, str(tmp_path / "in.csv"))
    assert [r.indicator for r in good.collect()] == ["evil.com"] and {r.error for r in bad.collect()} == {"not an address", "unknown verdict"}
    indicators.write_csv(good, str(tmp_path / "out"))
    assert indicators.read_csv(spark, str(tmp_path / "out"))[0].count() == 1


def test_exported_lines_are_what_the_file_holds(spark, tmp_path):
    rows = spark.createDataFrame([("a.example", "domain", 'x "y", z', "malicious", 0.5), ("b.example", "domain", None, "suspicious", 1.0), ("c.example", "domain", "s", "clean", 0.1)], "indicator string, ioc_type string, source string, verdict string, confidence double")
    indicators.write_csv(rows.coalesce(1), str(tmp_path / "out"), ("malicious", "suspicious"))
    lines = [x for f in (tmp_path / "out").glob("part-*.csv") for x in f.read_text().splitlines()]
    assert lines[0] == '"indicator","ioc_type","source","verdict","confidence"'
    assert sorted(lines[1:]) == sorted(r.line for r in indicators.exported(rows, ("malicious", "suspicious")).collect()) and len(lines) == 3
    assert lines[1] == '"a.example","domain","x ""y"", z","malicious","0.5"'


def test_message_ids(spark):
    rows = spark.createDataFrame([(1, " <M@x> "), (2, "m@X"), (3, None), (4, ""), (5, "<>"), (6, "< m@x >"), (7, "n")], "i long, message_id string")
    assert sorted(r.i for r in relational.first_of_message(rows, "message_id", "i").collect()) == [1, 3, 4, 5, 7]


def test_samples_are_bounded(spark):
    rows = spark.createDataFrame([("a", str(i % 7)) for i in range(50)] + [("b", None)], "k string, v string")
    from courierlens.operators.campaigns import sampled

    assert [tuple(r) for r in sampled(rows, "k", "v", 3, "n", "s").collect()] == [("a", 7, ["0", "1", "2"])]


def test_sessions_from_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "mail_from": "A@X.org", "content": {"headers": [{"name": "Message-ID", "value": "<m>"}]}}\nnot json\n{"subject": "no id"}\n')
    good, dead = sessions.decoded(sessions.lines(spark, str(tmp_path)))
    row = sessions.analyzable(sessions.derived(good)).collect()
    assert [(r.sender_domain, r.message_id) for r in row] == [("x.org", "<m>")] and dead.count() == 2


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k, i, at(i * 60), ((i * 31 + k) % 50) / 50) for k in range(3) for i in range(20)]
    schema = "entity_key long, seq long, ts timestamp, risk double"
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = state.entity_state(stream).writeStream.outputMode("update").format("memory").queryName("risk").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.entity_key: r.memory for r in temporal.entity_risk(spark.createDataFrame(rows, schema)).collect()}
    got = {r.entity_key: r for r in spark.table("risk").orderBy("n").collect()}
    assert all(abs(got[k].memory - want[k]) < 1e-9 and got[k].n == 20 for k in want)


def test_chunks(spark):
    rows = spark.createDataFrame([("i", "u", at(0), 5, "world"), ("i", "u", at(10), 0, "hello"), ("i", "u", at(500), 0, "again")], "ip string, upload_id string, ts timestamp, offset int, data string")
    assert sorted(r.data for r in state.chunk_sessions(rows).collect()) == ["again", "helloworld"]
