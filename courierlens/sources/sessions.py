"""Reading captured mail sessions: files or a stream of JSON, split into good rows and dead letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_pair = StructType([StructField("name", StringType()), StructField("value", StringType())])
_attachment = StructType([StructField("filename", StringType()), StructField("content_type", StringType()), StructField("size", LongType()), StructField("hash", StringType())])
_link = StructType([StructField("url", StringType()), StructField("text", StringType()), StructField("suspicious", BooleanType())])
CONTENT = StructType([StructField("headers", ArrayType(_pair)), StructField("body_text", StringType()), StructField("body_html", StringType()), StructField("attachments", ArrayType(_attachment)), StructField("links", ArrayType(_link)), StructField("raw_size", LongType()), StructField("is_complete", BooleanType()), StructField("is_encrypted", BooleanType())])
SESSION = StructType([
    StructField("id", StringType()), StructField("protocol", StringType()), StructField("client_ip", StringType()), StructField("server_ip", StringType()), StructField("client_port", IntegerType()), StructField("server_port", IntegerType()),
    StructField("started_at", TimestampType()), StructField("ended_at", TimestampType()), StructField("status", StringType()), StructField("packet_count", IntegerType()), StructField("total_bytes", LongType()),
    StructField("mail_from", StringType()), StructField("rcpt_to", ArrayType(StringType())), StructField("subject", StringType()), StructField("content", CONTENT), StructField("message_id", StringType()),
])


def lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The raw lines of a folder, as a column ``value``; new files arrive as a stream."""
    return spark.readStream.text(path) if stream else spark.read.text(path)


def decoded(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, dead letters): rows that parse and have an id, and the text of all others. Works on batches and streams."""
    schema = StructType([*SESSION.fields, StructField("_corrupt", StringType())])
    rows = raw.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("s"))
    bad = F.col("s").isNull() | F.col("s._corrupt").isNotNull() | F.col("s.id").isNull()
    return rows.filter(~bad).select("s.*").drop("_corrupt"), rows.filter(bad).select("value")


def derived(sessions: DataFrame) -> DataFrame:
    """sessions with the sender's domain, and the Message-ID taken from the headers where it is missing; NUL characters go."""
    header = F.get(F.filter("content.headers", lambda h: F.lower(h["name"]) == "message-id"), F.lit(0))["value"]
    clean = lambda c: F.replace(F.col(c), F.lit("\x00"), F.lit(""))
    return sessions.withColumns({"mail_from": clean("mail_from"), "subject": clean("subject")}).withColumns({
        "sender_domain": F.lower(F.nullif(F.regexp_extract("mail_from", "@(.*)$", 1), F.lit(""))),
        "message_id": F.coalesce("message_id", header),
    })


def analyzable(sessions: DataFrame) -> DataFrame:
    """Sessions that are not encrypted and have a body, attachments or headers."""
    some = lambda c: F.coalesce(F.size(f"content.{c}") > 0, F.lit(False))
    body = F.coalesce(F.length("content.body_text"), F.length("content.body_html"), F.lit(0)) > 0
    return sessions.filter(~F.coalesce(F.col("content.is_encrypted"), F.lit(False)) & (body | some("attachments") | some("headers")))


def merged(versions: DataFrame, latest: Sequence[str], known: Sequence[str], body: Sequence[str] = (), key: str = "id", order: Sequence[str] = ("version",)) -> DataFrame:
    """Re-published sessions, one row per key and ``versions``.

    The last value wins for the latest columns; for the known ones and the
    body a null (for the body, also an empty text) never replaces a value.
    """
    place = F.struct(*order)
    there = lambda c: F.when(F.col(c).isNotNull(), place)
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", place)
    picks = [*(F.max_by(c, place).alias(c) for c in latest), *(F.max_by(c, there(c)).alias(c) for c in known), *(F.max_by(c, filled(c)).alias(c) for c in body)]
    return versions.groupBy(key).agg(*picks, F.count(F.lit(1)).alias("versions"))
