"""Joins on near names and near times, against comparing everything."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from courierlens.operators import relational, scenes, text

START = datetime(2024, 6, 1)


def apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def folded(name):
    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w")):
        name = name.replace(a, b)
    return name.translate(str.maketrans("0135789|", "olesbtgl"))


def kind(base, tld, pbase, ptld):
    near, longest = apart(base, pbase), max(len(base), len(pbase))
    if base != pbase and folded(base) == folded(pbase):
        return 0.95, "homoglyph"
    if base == pbase:
        return (0.90, "tld_swap") if tld != ptld else None
    if 1 <= near <= (1 if longest <= 6 else 2 if longest <= 12 else 3) and len(pbase) >= 4:
        return {1: 0.85, 2: 0.75}.get(near, 0.65), "edit_distance"
    if len(pbase) >= 4 and (base.startswith(pbase) or base.endswith(pbase)):
        return 0.70, "affix"
    return None


def changed(r, name, times):
    for _ in range(times):
        k, c = r.randrange(len(name)), r.choice("abcmn01")
        name = r.choice([name[:k] + name[k + 1 :], name[:k] + c + name[k:], name[:k] + c + name[k + 1 :]]) or "abc"
    return name


def test_lookalikes_equal_comparing_all(spark):
    r = random.Random(12)
    models = ["ebay.com", "bank.org", "paypal.com", "modern.com", "clear.net", "microsoft.com", "international-bank.com", "abc.com", "ourcompany1.net", "averyveryverylongname.org"]
    names = {f"{changed(r, p.split('.')[0], r.randrange(0, 5))}.{r.choice(['com', 'net'])}" for p in models for _ in range(60)}
    names |= {f"{p.split('.')[0]}-login.com" for p in models} | {f"my{p}" for p in models} | set(models) | {"rnodern.com", "c1ear.com", "paypa1.com"}
    found = {x.domain: (x.score, x.protected, x.kind) for x in text.lookalikes(spark.createDataFrame([(n,) for n in names], "domain string"), spark.createDataFrame([(p,) for p in models], "domain string")).collect()}
    want = {}
    for n in names:
        base, tld = n.rsplit(".", 1)
        every = [(k[0], p, k[1]) for p in models if p != n and len(base) >= 3 and (k := kind(base, tld, *p.rsplit(".", 1)))]
        if every:
            want[n] = max(every)
    assert found == want and len({k for _, _, k in want.values()}) == 4


def test_candidates_grow_with_the_names_only(spark):
    r = random.Random(2)
    models = spark.createDataFrame([("ebay",), ("bank",), ("paypal",), ("microsoft",), ("international-bank",)], "pbase string")
    counts = []
    for n in (1000, 4000):
        names = [("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 20))),) for _ in range(n)]
        counts.append(text.candidates(spark.createDataFrame(names, "base string"), models).count())
    assert max(counts) <= 60  # by chance, of 5 x 4000 pairs


def test_typos_of_many_brands(spark):
    r = random.Random(4)
    brands = ["".join(r.choice("abcdef") for _ in range(r.randrange(4, 9))) for _ in range(1500)]
    words = [changed(r, r.choice(brands), r.randrange(0, 4)) for _ in range(200)] + ["abc"]
    found = {x.word: (x.distance, x.brand) for x in scenes.typos(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(b,) for b in brands], "brand string")).collect()}
    want = {w: min((d, b) for d, b in near) for w in set(words) if len(w) >= 4 and (near := [(d, b) for b in set(brands) if abs(len(b) - len(w)) <= 2 and 1 <= (d := apart(w, b)) <= 2])}
    assert found == want


SESSIONS = "session_id long, server_ip string, client_ip string, mail_from string, recipients array<string>, started_at timestamp, message_id string"


def relays(n):
    r, t, out = random.Random(n), START, []
    for i in range(n):
        t += timedelta(seconds=r.choice([0, 0, 1, 30, 100, 179.5]))
        out.append((i, f"h{r.randrange(3)}", f"h{r.randrange(3)}", r.choice(["a", None]), r.choice([["x"], ["x", "Y"], None]), t, r.choice(["m1", "m2", "m3", None])))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seconds", [60, 180])
def test_hops_equal_comparing_all(spark, seconds):
    rows = relays(160)
    df = spark.createDataFrame(rows, SESSIONS)
    pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[2] and a[3] == b[3] and a[4] == b[4] and timedelta(0) <= b[5] - a[5] <= timedelta(seconds=seconds)}
    assert {tuple(x) for x in relational.hops(df, seconds).collect()} == pairs and len(pairs) > 15
    at = {a[0]: a[5] for a in rows}
    onward = {}
    for a, b in pairs:
        if (at[b], b) > (at[a], a):
            onward[a] = min(onward.get(a, (at[b], b)), (at[b], b))

    def end(i):
        return end(onward[i][1]) if i in onward else i

    assert {x.session_id: x.terminal_id for x in relational.terminal_hop(df, seconds).collect()} == {a[0]: end(a[0]) for a in rows}


def test_gaps_equal_comparing_all(spark):
    rows = relays(200)
    second, first = [x for x in rows if x[0] % 2], [x for x in rows if not x[0] % 2]
    found = {x.session_id: x.gap for x in relational.relay_gaps(spark.createDataFrame(second, SESSIONS), spark.createDataFrame(first, SESSIONS), 60).collect()}
    low = lambda x: None if x is None else sorted(y.lower() for y in x)
    want = {}
    for s in second:
        near = [f for f in first if abs(s[5] - f[5]) <= timedelta(seconds=60)]
        if not any(f[6] == s[6] is not None for f in near):
            want[s[0]] = "same_envelope_other_id" if any(f[6] is not None and f[3] == s[3] and low(f[4]) == low(s[4]) is not None for f in near) else "none"
    assert found == want and set(want.values()) == {"none", "same_envelope_other_id"}


def test_a_busy_relay_with_one_envelope(spark):
    n = 300_000
    sessions = spark.range(n).select(
        F.col("id").alias("session_id"), F.lit("h").alias("server_ip"), F.lit("h").alias("client_ip"), F.lit("a").alias("mail_from"), F.array(F.lit("x")).alias("recipients"), F.timestamp_seconds(F.lit(1_700_000_000) + 100 * F.col("id")).alias("started_at")
    )
    found = relational._next_hops(sessions, 180)
    assert found.filter("to = session_id + 1").count() == n - 1 == found.count()
    assert relational.hops(sessions, 180).count() == n - 1
