"""Streaming forms of the temporal operators, with state per key.

``cusum``, ``hawkes`` and ``hmm_phase`` take the rows of each micro-batch in
order as they come, and keep a few numbers of each entity (and at most a
hundred events); state that was not brought up to date for ``ttl_ms`` goes. Such
time-outs go by the clock, and a stream that waits for them never runs out of
batches: pass ``None`` for runs over what is available. The others are
held to event time: a row waits in state until the watermark has passed it, so
late rows within the watermark's delay fall into place, and what comes out is
what the batch form gives.

Streams need the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from courierlens.operators import temporal

#: Milliseconds after which the unused state of an entity goes.
TTL_MS = 90 * 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one key in one micro-batch, by time and id."""
    return pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")


def _hours(at: pd.Timestamp) -> float:
    return at.value / 3.6e12


class _PerEntity(StatefulProcessor):
    """One value of state for an entity, brought up to date by each of its rows."""

    schema: str
    told: tuple[str, ...]

    def __init__(self, ttl_ms: int | None = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.schema, self.ttl_ms)

    def close(self) -> None:
        pass

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row) -> tuple[tuple, tuple]:
        """The state after a row, and what comes out for it."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        state = tuple(self.value.get()) if self.value.exists() else self.start()
        ids, out = [], []
        for row in _in_order(rows).itertuples(index=False):
            state, told = self.step(state, row)
            ids.append(row.seq)
            out.append(told)
        self.value.update(state)
        yield pd.DataFrame({"entity_key": [key[0]] * len(ids), "seq": ids} | dict(zip(self.told, zip(*out, strict=True), strict=True)))


class _Cusum(_PerEntity):
    schema, told = "n long, total double, squares double, up double, down double", ("s_plus", "s_minus", "alarm")

    def start(self):
        return 0, 0.0, 0.0, 0.0, 0.0

    def step(self, state, row):
        n, total, squares, up, down = state
        n, total, squares = n + 1, total + row.risk, squares + row.risk * row.risk
        warm = n >= temporal.WARM_UP
        mu = total / n if warm else 0.10
        sigma = math.sqrt(max(1e-10, squares / n - mu * mu)) if warm else 0.10
        up, down = max(0.0, up + row.risk - mu - sigma / 2), max(0.0, down + mu - row.risk - sigma / 2)
        return (n, total, squares, up, down), (up, down, warm and max(up, down) > 4 * sigma)


class _Phase(_PerEntity):
    schema, told = "p array<double>, last double", ("posterior", "phase", "risk")

    def start(self):
        return list(temporal.PHASE_START), None

    def step(self, state, row):
        before, last = list(state[0]), state[1]
        now = _hours(row.ts)
        gap = min(max(temporal.FIRST_GAP if last is None else now - last, 0.0), 720.0)
        r, u, k = (min(max(x, 0.0), 1.0) for x in (row.risk, row.u_final, row.k_conflict))
        calm, steady = 1 - min(k, 0.5) * 2, math.exp(-((gap - 24) ** 2) / 200)
        likely = (
            0.1 + (1 - r) * 0.7 + (1 - u) * 0.15 + calm * 0.05, 0.05 + (r * 0.3 + 0.3) * u * 0.5 + steady * 0.15, 0.4 + (1 - r) * 0.2 + u * 0.2 + r * 0.2,
            0.02 + r * 0.6 + (1 - calm) * 0.2 + (1 - u) * 0.03, 0.02 + r * 0.5 + (1 - u) * 0.25 + (1 - steady) * 0.1,
        )
        raw = [sum(b * m[j] for b, m in zip(before, temporal.PHASE_MOVES, strict=True)) * e for j, e in enumerate(likely)]
        p = [x / sum(raw) for x in raw]
        return (p, now), (p, max(range(5), key=lambda i: (p[i], -i)), sum(a * b for a, b in zip(p, temporal.PHASE_RISK, strict=True)))


class _Hawkes(StatefulProcessor):
    """A base rate in a value, and the recent events in a list."""

    def __init__(self, ttl_ms: int | None = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rate = handle.getValueState("rate", "n long, mu double", self.ttl_ms)
        self.recent = handle.getListState("recent", "t double, r double", self.ttl_ms)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        n, mu = self.rate.get() if self.rate.exists() else (0, temporal.BASE_RATE)
        events = [tuple(x) for x in self.recent.get()] if self.recent.exists() else []
        out = []
        for row in _in_order(rows).itertuples(index=False):
            now = _hours(row.ts)
            intensity = mu + sum(0.8 * r**1.5 * math.exp(-2 * (now - t)) for t, r in events)
            if n > 3:
                mu = max(0.01, 0.995 * mu + 0.005 * min(100.0, 1 / max(0.001, now - events[-1][0])))
            n += 1
            events = [(t, r) for t, r in [*events, (now, row.risk)][-temporal.KEEP :] if t >= now - temporal.MEMORY]
            ratio = intensity / max(mu, 0.01)
            out.append((key[0], row.seq, n, mu, intensity, ratio, ratio > 3))
        self.rate.update((n, mu))
        self.recent.put(events)
        yield pd.DataFrame(out, columns=["entity_key", "seq", "n", "mu", "intensity", "ratio", "burst"])


def _entities(stream: DataFrame, processor: _PerEntity | _Hawkes, schema: str) -> DataFrame:
    mode = "None" if processor.ttl_ms is None else "ProcessingTime"
    return stream.groupBy("entity_key").transformWithStateInPandas(processor, f"entity_key long, seq long, {schema}", "Append", mode)


def cusum(stream: DataFrame, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """Both sums and the alarm after each row (entity_key, ts, seq, risk)."""
    return _entities(stream, _Cusum(ttl_ms), "s_plus double, s_minus double, alarm boolean")


def hawkes(stream: DataFrame, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """Base rate, intensity and burst after each row (entity_key, ts, seq, risk)."""
    return _entities(stream, _Hawkes(ttl_ms), "n long, mu double, intensity double, ratio double, burst boolean")


def hmm_phase(stream: DataFrame, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """Posterior, phase and risk after each row (entity_key, ts, seq, risk, u_final, k_conflict)."""
    return _entities(stream, _Phase(ttl_ms), "posterior array<double>, phase int, risk double")


class _InOrder(StatefulProcessor):
    """Takes a key's rows in order of event time, each once the watermark has passed it.

    Rows wait in a list; a timer at the time of the row brings them out.
    """

    #: The columns (t long in microseconds, id long, ...) that wait, the state, and what comes out besides the key.
    waits: str
    schema: str
    told: tuple[str, ...]

    def __init__(self, keys: tuple[str, ...]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.value = handle.getValueState("state", self.schema)
        self.fields = [c.split(" ")[0] for c in self.waits.split(", ")]

    def close(self) -> None:
        pass

    def start(self) -> tuple:
        raise NotImplementedError

    def together(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        """The state after rows of one time, by id, and what comes out."""
        raise NotImplementedError

    def passed(self, state: tuple, now: int) -> tuple[tuple, list[tuple]]:
        """The state, and what comes out, when the watermark is at now and no row up to it is left."""
        return state, []

    def due(self, state: tuple) -> int | None:
        """When passed() has something to do."""
        return None

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        # plain objects: Arrow-backed strings of pandas come in chunks, which Spark does not take
        return pd.DataFrame([(*key, *x) for x in out], columns=[*self.keys, *self.told], dtype=object)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        new = [row for frame in rows for row in frame[self.fields].itertuples(index=False, name=None)]
        self.waiting.appendList(new)
        for at in {-(-row[0] // 1000) for row in new}:
            self.handle.registerTimer(at)
        yield self._frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        ready, out = sorted(x for x in rows if x[0] <= now), []
        later = [x for x in rows if x[0] > now]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        state = tuple(self.value.get()) if self.value.exists() else self.start()
        while ready:
            n = sum(1 for x in ready if x[0] == ready[0][0])
            state, told = self.together(state, ready[:n])
            ready, out = ready[n:], out + told
        state, told = self.passed(state, now)
        if (at := self.due(state)) is not None and at > now:
            self.handle.registerTimer(-(-at // 1000))
        self.value.update(state)
        yield self._frame(key, out + told)


class _Window:
    """Sums of the last seconds over (times, amounts) in order."""

    @staticmethod
    def add(times: list[int], amounts: list[int], t: int, amount: int, length: int) -> tuple[list[int], list[int]]:
        kept = [i for i, x in enumerate(times) if x > t - length]
        return [times[i] for i in kept] + [t], [amounts[i] for i in kept] + [amount]


class _Volume(_InOrder):
    waits, schema, told = "t long, id long", "times array<long>, counts array<long>, alerted long", ("id", "in_window", "severity")

    def __init__(self, keys, seconds: int, least: int, cool_down: int):
        super().__init__(keys)
        self.length, self.least, self.pause = seconds * 1_000_000, least, cool_down * 1_000_000

    def start(self):
        return [], [], None

    def together(self, state, rows):
        t = rows[0][0]
        times, counts = _Window.add(list(state[0]), list(state[1]), t, len(rows), self.length)
        n, alerted = sum(counts), state[2]
        if n < self.least or alerted is not None and t - alerted < self.pause:
            return (times, counts, alerted), []
        severity = "critical" if n >= 3 * self.least else "high" if n >= 2 * self.least else "medium"
        return (times, counts, t), [(rows[0][1], n, severity)]


class _Compliance(_InOrder):
    waits, schema, told = "t long, id long, level int, items long", "times array<long>, every array<long>, top array<long>, alerted3 long, alerted4 long", ("id", "rule", "total")

    def __init__(self, keys, seconds: int, least4: int, least3: int, cool_down: int):
        super().__init__(keys)
        self.length, self.least4, self.least3, self.pause = seconds * 1_000_000, least4, least3, cool_down * 1_000_000

    def start(self):
        return [], [], [], None, None

    def together(self, state, rows):
        t = rows[0][0]
        times, every = _Window.add(list(state[0]), list(state[1]), t, sum(x[3] for x in rows), self.length)
        _, top = _Window.add(list(state[0]), list(state[2]), t, sum(x[3] for x in rows if x[2] >= 4), self.length)
        alerted, out = {3: state[3], 4: state[4]}, []
        for level, total, least in ((4, sum(top), self.least4), (3, sum(every), self.least3)):
            own = [x for x in rows if x[2] >= level]
            if own and total >= least and (alerted[level] is None or t - alerted[level] >= self.pause):
                alerted[level] = t
                out.append((own[0][1], f"level{level}", total))
        return (times, every, top, alerted[3], alerted[4]), out


class _Gate(_InOrder):
    waits, schema, told = "t long, id long, done boolean", "last long, done boolean", ("id",)

    def __init__(self, keys, seconds: int):
        super().__init__(keys)
        self.pause = seconds * 1_000_000

    def start(self):
        return None, False

    def together(self, state, rows):
        (last, done), out = state, []
        for t, i, finishes in rows:
            if last is None or t - last >= self.pause or finishes and not done:
                last, out = t, [*out, (i,)]
            done = done or bool(finishes)
        return (last, done), out


class _Upload(_InOrder):
    waits = "t long, id long, offset long, data string"
    schema = "started long, last long, offsets array<long>, parts array<string>, n_chunks long, size long"
    told = ("started", "n_chunks", "size", "data")

    def __init__(self, keys, idle: int, age: int):
        super().__init__(keys)
        self.idle, self.age = idle * 1_000_000, age * 1_000_000

    def start(self):
        return None, None, [], [], 0, 0

    def _whole(self, state) -> list[tuple]:
        started, _, offsets, parts, n, size = state
        if started is None:
            return []
        data = "".join(x for _, x in sorted(zip(offsets, parts, strict=True)))
        return [(pd.Timestamp(started, unit="us"), n, size, data)]

    def together(self, state, rows):
        out = []
        for t, _, offset, data in rows:
            if state[0] is None or t - state[1] >= self.idle or t - state[0] >= self.age:
                out += self._whole(state)
                state = (t, t, [], [], 0, 0)
            at = dict(zip(state[2], state[3], strict=True)) | {offset: data}
            state = (state[0], t, list(at), list(at.values()), state[4] + 1, state[5] + len(data.encode()))
        return state, out

    def passed(self, state, now):
        if state[0] is not None and now - state[1] >= self.idle:
            return self.start(), self._whole(state)
        return state, []

    def due(self, state):
        return None if state[0] is None else state[1] + self.idle


def _timed(stream: DataFrame, keys: tuple[str, ...], processor: _InOrder, schema: str, at: str, late: str) -> DataFrame:
    typed = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    return stream.withWatermark(at, late).groupBy(*keys).transformWithStateInPandas(processor, f"{typed}, {schema}", "Append", "EventTime")


def volume_anomaly(incidents: DataFrame, key: str = "user_id", id_: str = "incident_id", seconds: int = 600, least: int = 5, cool_down: int = 1800, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, id, in_window, severity), as the batch form gives it."""
    rows = incidents.selectExpr(key, at, f"unix_micros(cast({at} as timestamp)) as t", f"cast({id_} as bigint) as id")
    return _timed(rows, (key,), _Volume((key,), seconds, least, cool_down), "id long, in_window long, severity string", at, late).withColumnRenamed("id", id_)


def jrt_compliance(items: DataFrame, key: str = "user_id", id_: str = "incident_id", seconds: int = 86_400, least4: int = 50, least3: int = 500, cool_down: int = 3600, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, id, rule, total), as the batch form gives it."""
    rows = items.filter("level >= 3").selectExpr(key, at, f"unix_micros(cast({at} as timestamp)) as t", f"cast({id_} as bigint) as id", "cast(level as int) as level", "cast(item_count as bigint) as items")
    return _timed(rows, (key,), _Compliance((key,), seconds, least4, least3, cool_down), "id long, rule string, total long", at, late).withColumnRenamed("id", id_)


def reanalysis(events: DataFrame, key: str = "session_id", id_: str = "seq", seconds: int = 30, finished: tuple[str, ...] = ("Completed", "Timeout"), at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, id) of the versions that are analysed, as the batch form gives them."""
    done = ", ".join(f"'{s}'" for s in finished)
    rows = events.selectExpr(key, at, f"unix_micros(cast({at} as timestamp)) as t", f"cast({id_} as bigint) as id", f"coalesce(status in ({done}), false) as done")
    return _timed(rows, (key,), _Gate((key,), seconds), "id long", at, late).withColumnRenamed("id", id_)


def reassembled(chunks: DataFrame, idle: int = 120, age: int = 600, at: str = "ts", id_: str = "chunk_id", late: str = "10 minutes") -> DataFrame:
    """Uploads, as the batch form gives them; one comes out when it is idle or the next one of its ids begins."""
    keys = tuple(temporal.UPLOAD)
    rows = temporal.upload_chunks(chunks, at, id_).selectExpr(*keys, at, f"unix_micros(cast({at} as timestamp)) as t", "cast(id as bigint) as id", "offset", "data")
    return _timed(rows, keys, _Upload(keys, idle, age), "started timestamp, n_chunks long, size long, data string", at, late)
