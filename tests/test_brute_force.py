"""Queries without SQL, against plain Python over the smallest tables."""

import math
import struct

import pandas as pd
import xxhash

from courierlens.operators.fusion import CORRELATION
from courierlens.plans import QUERIES
from courierlens.plans.fixtures import fx

FOLDER = "/root/testdata/sf0.001"


def dempster(masses):
    b, d, u, k = 0.0, 0.0, 1.0, 0.0
    for y in masses:
        c = b * y[1] + d * y[0]
        if c >= 1 - 1e-12:
            b, d, u, k = 0.0, 0.0, 1.0, 1.0
        else:
            b, d, u, k = (b * y[0] + b * y[2] + u * y[0]) / (1 - c), (d * y[1] + d * y[2] + u * y[1]) / (1 - c), u * y[2] / (1 - c), 1 - (1 - k) * (1 - c)
    return b, d, u, k


def open_world(masses):
    b, d, u, e = 0.0, 0.0, 1.0, 0.0
    for y in masses:
        parts = b * y[0] + b * y[2] + u * y[0], d * y[1] + d * y[2] + u * y[1], u * y[2], b * y[1] + d * y[0] + e * sum(y) + y[3] * (b + d + u)
        b, d, u, e = (p / sum(parts) for p in parts)
    return b, d, u, e


def murphy(masses):
    def near(x, y):
        b, d, u = (p - q for p, q in zip(x, y, strict=True))
        return 1 - math.sqrt(max(0.0, 0.5 * (b * b + d * d + u * u + b * u + d * u)))

    w = [sum(near(x, y) for y in masses) - 1 for x in masses]
    if sum(w) <= 1e-8 or any(x / sum(w) > 0.99 for x in w):
        w = [1.0] * len(masses)
    mean = tuple(sum(m[i] * x for m, x in zip(masses, w, strict=True)) / sum(w) for i in range(3)) if masses else None
    return dempster([mean] * len(masses))


def cautious(x, y):
    parts = max(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3])
    return tuple(p / sum(parts) for p in parts)


def by_session(spark):
    rows = fx(spark, FOLDER, "fx_module_results").toPandas().sort_values(["session_id", "module_n", "part_n", "supp_n", "score", "confidence"])
    out = {}
    for r in rows.itertuples():
        out.setdefault(r.session_id, []).append(r)
    return out


def engines(rows):
    per = {}
    for r in rows:
        per.setdefault(int(r.module_n) - 1, []).append((r.score * r.confidence, (1 - r.score) * r.confidence, 1 - r.confidence))
    fused = {e: dempster(m)[:3] for e, m in sorted(per.items())}
    return {e: m for e, m in fused.items() if m[2] <= 1 - 1e-9}


def near(a, b):
    return abs(a - b) < 2e-6


def test_grouped_fusion(spark):
    got = {r.session_id: r for r in QUERIES["grouped_fusion"](spark, FOLDER).collect()}
    for s, rows in by_session(spark).items():
        e = engines(rows)
        if not e:
            continue
        t, o = murphy([m for i, m in e.items() if i < 4]), dempster([m for i, m in e.items() if i >= 4])
        want = cautious((*t[:3], 0.0), (*o[:3], 0.0))
        assert all(near(got[s][c], w) for c, w in zip("bdu", want, strict=False)) and near(got[s].cross_conflict, t[0] * o[1] + t[1] * o[0])
    assert len(got) > 100


def test_verdict_by_engines(spark):
    got = {r.session_id: r for r in QUERIES["verdict_ds_murphy"](spark, FOLDER).collect()}
    for s, rows in by_session(spark).items():
        e = engines(rows)
        if not e:
            continue
        cut = {}
        for i, m in e.items():
            rho = max((CORRELATION[i][j] for j in e if j != i), default=0.0)
            a = 1 - rho if rho >= 0.1 else 1.0
            cut[i] = (m[0] * a, m[1] * a, 1 - (m[0] + m[1]) * a)
        b, _, u, k = murphy(list(cut.values()))
        risk, support = b + 0.3 * u, sum(m[0] > 0.05 for m in e.values())
        beliefs = [r.score * r.confidence for r in rows]
        sure, n = max((x for x, r in zip(beliefs, rows, strict=True) if r.confidence >= 0.80), default=0.0), sum(x > 0.10 for x in beliefs)
        boost = 1 + 0.15 * (n - 2) if n >= 3 else 1.0
        if sure >= 0.20:
            risk = max(risk, 0.15, min(0.90, sure * boost) * (0.30, 0.30, 0.50, 0.75, 1.0)[min(support, 4)])
        if n >= 2:
            risk = max(risk, 0.15, min(0.90, 0.40 * boost) * (0.50, 0.50, 0.75, 1.0)[min(support, 3)])
        assert near(got[s].risk, risk) and near(got[s].conflict, k), (s, got[s], risk, k)
    assert len(got) > 100


def test_verdict_in_the_open_world(spark):
    got = {r.session_id: r for r in QUERIES["verdict_tbm"](spark, FOLDER).collect()}
    for s, rows in by_session(spark).items():
        e = engines(rows)
        if not e:
            continue
        opened = {i: (*(0.99 * x for x in m), 0.01) for i, m in e.items()}
        t, o = (open_world([m for i, m in opened.items() if keep(i)]) for keep in (lambda i: i < 4, lambda i: i >= 4))
        b, _, u, _ = cautious(t, o)
        assert near(got[s].risk, b + 0.3 * u) and near(got[s].novelty, 1 - (1 - t[3]) * (1 - o[3])), s
    assert len(got) > 100


def added(values):
    """A plain running sum: the built-in one corrects its rounding, which decides ties here."""
    total = 0.0
    for v in values:
        total += v
    return total


def test_weights_are_capped(spark):
    got = {r.session_id: r.weights for r in QUERIES["weight_cap"](spark, FOLDER).collect()}
    for s, rows in by_session(spark).items():
        w = [r.score for r in sorted(rows, key=lambda r: (r.module_n, r.part_n, r.supp_n, r.score))]
        for _ in range(max(len(w), 1)):
            limit = 0.4 * added(w)
            over, free = added(max(x - limit, 0.0) for x in w), added(x for x in w if x <= limit)
            more = over / free if free > 0 else 0.0
            w = [limit if x > limit else x + x * more for x in w]
        total = sum(w)
        assert all(near(x, y / total if total > 0 else y) for x, y in zip(got[s], w, strict=True)), s
    assert len(got) > 100


def hash64(*values):
    """Spark's xxhash64 of longs, ints and strings: each value's hash seeds the next."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q" if isinstance(v, int) else "<i", v if isinstance(v, int) else v[0])
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h - 2**64 if h >= 2**63 else h


def samples():
    labels, docs = (pd.read_parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "documents"))
    both = labels.merge(docs, on="doc_id")
    return {int(r.doc_id): (int(r.quality + 2 * r.toxic), r.text) for r in both.itertuples()}


def test_folds_are_dealt_by_the_order_of_a_hash(spark):
    got = {r.doc_id: (r.label, r.fold) for r in QUERIES["stratified_folds"](spark, FOLDER).collect()}
    per = {}
    for i, (label, _) in samples().items():
        h = hash64(i)
        per.setdefault(label, []).append((h % 256, h, i))
    k = max(2, min(5 if sum(map(len, per.values())) >= 60 else 3, min(map(len, per.values()))))
    want = {i: (label, n % k) for label, rows in per.items() for n, (_, _, i) in enumerate(sorted(rows))}
    assert got == want


def test_rare_labels_get_copies(spark):
    rows = samples()
    counts = {}
    for label, _ in rows.values():
        counts[label] = counts.get(label, 0) + 1
    want = set()
    for i, (label, text) in rows.items():
        want.add((i, label, 0, text))
        target = max(10, max(counts.values()) // 4)
        for c in range(1, (math.ceil((target - counts[label]) / counts[label]) if counts[label] < target else 0) + 1):
            want.add((i, label, c, " ".join(w for k, w in enumerate(text.split(" ")) if hash64(i, (c,), (k,), w) % 10 != 0)))
    got = [tuple(r) for r in QUERIES["augment_rare"](spark, FOLDER).select("doc_id", "label", "copy", "text").collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_busy_entity_is_averaged_like_any_other(spark):
    """One entity with 300,000 events: the sums by the hour equal the plain recurrence."""
    from pyspark.sql import functions as F

    from courierlens.operators import temporal

    n = 300_000
    events = spark.range(n).select(F.lit(1).alias("entity_key"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), (F.pmod(F.col("id") * 7919, F.lit(1000)) / 1000.0).alias("risk"))
    x = [(i * 7919) % 1000 / 1000.0 for i in range(n)]
    fast = slow = memory = x[0]
    for v in x[1:]:
        fast, slow, memory = 0.95 * fast + 0.05 * v, 0.995 * slow + 0.005 * v, 0.92 * memory + 0.08 * v
    a, b = temporal.dual_ewma(events).first(), temporal.entity_risk(events).first()
    assert a.n == n and abs(a.fast - fast) < 1e-9 and abs(a.slow - slow) < 1e-9 and abs(b.memory - memory) < 1e-9
