"""Streaming forms: event time, watermarks, and state per key; each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from courierlens.operators.relational import message_key


def first_seen(stream: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed the window."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def message_dedup(stream: DataFrame, at: str = "started_at", within: str = "1 hour") -> DataFrame:
    """One session for each Message-ID, trimmed, without brackets, in lower case; those without one pass."""
    key = F.coalesce(F.concat(F.lit("m:"), message_key(F.col("message_id"))), F.concat(F.lit("i:"), F.col("id").cast("string")))
    return first_seen(stream.withColumn("_key", key), ["_key"], at, within).drop("_key")


def incident_counts(stream: DataFrame, at: str = "ts", key: str = "user_id", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Incidents of each user in fixed windows of event time; late rows count until the watermark passes."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count(F.lit(1)).alias("n"), F.max("severity_rank").alias("worst")).select(F.col("window.start").alias("start"), key, "n", "worst")


RISK_SCHEMA = "entity_key long, n long, memory double, fast double, slow double"


def entity_state(stream: DataFrame) -> DataFrame:
    """Risk memory and both averages of each entity, after each batch of its rows (entity_key, ts, seq, risk).

    The state is four numbers per entity. Rows of one batch are taken in order;
    rows of a later batch count as later.
    """

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, memory, fast, slow = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        for x in rows["risk"]:
            if n == 0:
                memory = fast = slow = float(x)
            else:
                memory, fast, slow = 0.92 * memory + 0.08 * x, 0.95 * fast + 0.05 * x, 0.995 * slow + 0.005 * x
            n += 1
        state.update((n, memory, fast, slow))
        yield pd.DataFrame({"entity_key": [key[0]], "n": [n], "memory": [memory], "fast": [fast], "slow": [slow]})

    return stream.groupBy("entity_key").applyInPandasWithState(update, RISK_SCHEMA, "n long, memory double, fast double, slow double", "update", GroupStateTimeout.NoTimeout)


def chunk_sessions(chunks: DataFrame, idle: str = "120 seconds", late: str = "600 seconds") -> DataFrame:
    """Uploads put together from chunks (ip, upload_id, ts, offset, data): a session ends after an idle time; works on batches and streams."""
    source = chunks.withWatermark("ts", late) if chunks.isStreaming else chunks
    grouped = source.groupBy("ip", "upload_id", F.session_window("ts", idle)).agg(F.sort_array(F.collect_set(F.struct("offset", "data"))).alias("parts"))
    return grouped.select("ip", "upload_id", F.col("session_window.start").alias("start"), F.size("parts").alias("n_chunks"), F.array_join(F.transform("parts", lambda p: p["data"]), "").alias("data"))
