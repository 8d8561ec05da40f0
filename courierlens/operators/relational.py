"""Session, verdict and incident questions: filters, joins and aggregates.

All are declarative DataFrame plans. "Now" is always a parameter or the
greatest event time, never the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierlens.schemas import severity_step, threat_level
from courierlens.shared import cut

DAY = "INTERVAL 24 HOURS"


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of rows in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def search(df: DataFrame, equal: dict[str, object] | None = None, within: dict[str, Sequence] | None = None, since: tuple[str, Column] | None = None, like: tuple[Sequence[str], str] | None = None) -> DataFrame:
    """Rows that meet every given condition; of the text condition, any column may meet it."""
    for c, v in (equal or {}).items():
        df = df.filter(F.col(c) == v)
    for c, vs in (within or {}).items():
        df = df.filter(F.col(c).isin(*vs))
    if since:
        df = df.filter(F.col(since[0]) >= since[1])
    if like:
        hit = F.lit(False)
        for c in like[0]:
            hit = hit | F.coalesce(F.col(c).contains(like[1]), F.lit(False))
        df = df.filter(hit)
    return df


def with_total(df: DataFrame, of: DataFrame) -> DataFrame:
    """df with the row count of another table beside each row; the count is a scalar, so nothing moves."""
    return df.withColumn("total", of.agg(F.count(F.lit(1)).alias("n")).scalar())


def with_verdict(sessions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Sessions with the level of their verdict, null without one."""
    return sessions.join(verdicts.select("session_id", threat_level(F.col("risk")).alias("level")), "session_id", "left")


def without_verdict(sessions: DataFrame, verdicts: DataFrame, statuses: Sequence[str] = ("Completed",)) -> DataFrame:
    """Finished sessions that nothing has judged yet."""
    return sessions.filter(F.col("status").isin(*statuses)).join(verdicts.select("session_id"), "session_id", "left_anti")


def first_contacts(sessions: DataFrame, internal: Sequence[str] = (), public: Sequence[str] = (), max_senders: int = 10) -> DataFrame:
    """The earliest session of each outside sender domain that few different senders use."""
    outside = sessions.filter(~F.col("sender_domain").isin(*internal, *public)) if (*internal, *public) else sessions
    per = outside.groupBy("sender_domain").agg(F.min(F.struct("started_at", "session_id")).alias("f"), F.count_distinct("sender_local").alias("senders"))
    return per.filter(F.col("senders") < max_senders).select("sender_domain", F.col("f.session_id").alias("session_id"), F.col("f.started_at").alias("started_at"), "senders")


def message_key(message_id: Column) -> Column:
    """A Message-ID as it is compared: trimmed, without brackets, in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(F.trim(message_id), "^<|>$", ""))), F.lit(""))


def first_of_message(rows: DataFrame, message_id: str, *order: str) -> DataFrame:
    """The first row of each Message-ID in an order; rows without one all stay."""
    key = message_key(F.col(message_id))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_first", F.when(key.isNull(), True).otherwise(first == 1)).filter("_first").drop("_first")


def related(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """Pairs of different rows under one key; meant for keys of few rows each, such as the hops of one message."""
    a, b = rows.select(key, F.col(id_).alias("id")), rows.select(key, F.col(id_).alias("other_id"))
    return a.join(b, key).filter("id <> other_id")


def last_known(rows: DataFrame, key: str, value: str, order: str, id_: str, seconds: int) -> DataFrame:
    """rows with the latest non-null value of their key in the time before them, theirs included."""
    w = Window.partitionBy(key).orderBy(F.col("_t")).rangeBetween(-seconds * 1_000_000, 0)
    # ties of time are settled by the id: the largest one counts as the latest
    micros = rows.withColumn("_t", F.unix_micros(F.col(order).cast("timestamp")))
    best = F.max(F.when(F.col(value).isNotNull(), F.struct("_t", id_, value))).over(w)
    return micros.withColumn("known", F.coalesce(F.col(value), best[value])).drop("_t")


def _bucket(at: Column, seconds: int) -> Column:
    """The number of the stretch of so many seconds that a time falls into."""
    micros = F.unix_micros(at.cast("timestamp"))
    return F.call_function("div", micros - F.pmod(micros, F.lit(seconds * 1_000_000)), F.lit(seconds * 1_000_000))


def _envelope() -> Column:
    return F.struct("mail_from", "recipients")


def hops(sessions: DataFrame, seconds: int = 180) -> DataFrame:
    """(session_id, next_id): relay hops from a server onwards, of the same envelope, soon after.

    What comes soon after falls into the same stretch of time or the next, so
    a busy relay meets two stretches of itself and not all.
    """
    own = _bucket(F.col("started_at"), seconds)
    a = sessions.select("session_id", F.col("server_ip").alias("ip"), _envelope().alias("e"), "started_at", F.explode(F.array(own, own + 1)).alias("stretch"))
    b = sessions.select(F.col("session_id").alias("next_id"), F.col("client_ip").alias("ip"), _envelope().alias("e"), F.col("started_at").alias("t2"), own.alias("stretch"))
    soon = (F.col("t2") >= F.col("started_at")) & (F.col("t2") <= F.col("started_at") + F.make_dt_interval(secs=F.lit(seconds)))
    return a.join(b, ["ip", "e", "stretch"]).filter(soon & (F.col("next_id") != F.col("session_id"))).select("session_id", "next_id")


def _next_hops(sessions: DataFrame, seconds: int) -> DataFrame:
    """(session_id, to): the earliest hop onwards of each session, by one pass over each stretch of a relay's time."""
    micros, own = F.unix_micros(F.col("started_at").cast("timestamp")), _bucket(F.col("started_at"), seconds)
    arrive = sessions.select(F.col("client_ip").alias("ip"), _envelope().alias("e"), own.alias("stretch"), micros.alias("u"), F.col("session_id").alias("id"), F.lit(0).alias("asks"))
    leave = sessions.select(F.col("server_ip").alias("ip"), _envelope().alias("e"), F.explode(F.array(own, own + 1)).alias("stretch"), micros.alias("u"), F.col("session_id").alias("id"), F.lit(1).alias("asks"))
    back = Window.partitionBy("ip", "e", "stretch").orderBy(F.desc("u"), F.desc("id"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.last(F.when(F.col("asks") == 0, F.struct("u", "id")), ignorenulls=True).over(back)
    met = arrive.unionByName(leave).filter("ip is not null").withColumn("n", later).filter((F.col("asks") == 1) & (F.col("n.u") - F.col("u") <= seconds * 1_000_000))
    return met.groupBy(F.col("id").alias("session_id")).agg(F.min("n").alias("n")).select("session_id", F.col("n.id").alias("to"))


def terminal_hop(sessions: DataFrame, seconds: int = 180, rounds: int = 16) -> DataFrame:
    """(session_id, terminal_id): where a message's hops end, taking the earliest next hop and visiting no session twice.

    Doubling: each round replaces the hop by the hop's hop, so ``rounds``
    covers chains of 2**rounds hops; hops go forward in time, or in id at one
    time, so there are no cycles.
    """
    onward = _next_hops(sessions, seconds)
    at = sessions.select("session_id").join(onward, "session_id", "left").select("session_id", F.coalesce("to", "session_id").alias("to"))
    for _ in range(rounds):
        ahead = at.select(F.col("session_id").alias("to"), F.col("to").alias("further"))
        following = cut(at.join(ahead, "to").select("session_id", F.col("further").alias("to")))
        moved = following.join(at.withColumnRenamed("to", "was"), "session_id").filter("to <> was").limit(1).count()
        at = following
        if not moved:
            return at.withColumnRenamed("to", "terminal_id")
    raise ValueError(f"a chain has more than 2**{rounds} hops")


def relay_gaps(second: DataFrame, first: DataFrame, seconds: int = 30) -> DataFrame:
    """Second-hop messages without a first hop of their id nearby, and whether one of the same envelope exists."""
    near = F.abs(F.unix_micros(F.col("started_at").cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))) <= seconds * 1_000_000
    own = _bucket(F.col("started_at"), seconds)
    sorted_ = F.array_sort(F.transform("recipients", F.lower))
    # what is nearby lies in the same stretch of time or one beside it
    f = first.select(F.col("message_id").alias("m"), F.col("mail_from").alias("ff"), sorted_.alias("fr"), F.col("started_at").alias("t"), F.explode(F.array(own - 1, own, own + 1)).alias("fs"))
    rows = second.withColumn("_s", own)
    gaps = rows.join(f, (F.col("message_id") == F.col("m")) & (F.col("_s") == F.col("fs")) & near, "left_anti")
    same = F.col("mail_from").eqNullSafe(F.col("ff")) & (sorted_ == F.col("fr")) & (F.col("_s") == F.col("fs"))
    envelope = gaps.join(f.filter("m is not null"), same & near, "left_semi").select("session_id").distinct().withColumn("hit", F.lit(1))
    return gaps.join(envelope, "session_id", "left").select("session_id", F.when(F.col("hit") == 1, "same_envelope_other_id").otherwise("none").alias("gap"))


def suffixes(host: Column) -> Column:
    """A host and every domain above it."""
    parts = F.split(F.lower(host), "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def policy_matches(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rule): hosts under exact rules, or under ``*.suffix`` rules, which never match the apex; an equi-join on suffixes."""
    each = hosts.select("host", F.posexplode(suffixes(F.col("host"))).alias("depth", "suffix"))
    r = rules.select("rule", F.lower(F.regexp_replace("rule", "^\\*\\.", "")).alias("suffix"), F.col("rule").startswith("*.").alias("wild"))
    return each.join(r, "suffix").filter((F.col("wild") & (F.col("depth") > 0)) | (~F.col("wild") & (F.col("depth") == 0))).select("host", "rule").distinct()


def off_hours(df: DataFrame, at: str = "ts", severity: str = "severity", start: int = 9, end: int = 18, utc_offset: int = 8) -> DataFrame:
    """The severity, one step up at weekends or outside [start, end) of the local time."""
    local = F.col(at) + F.make_dt_interval(hours=F.lit(utc_offset))
    off = F.dayofweek(local).isin(1, 7) | (F.hour(local) < start) | (F.hour(local) >= end)
    return df.withColumn("off_hours", off).withColumn("raised", F.when(off, severity_step(F.col(severity))).otherwise(F.col(severity)))


def direction(sender_domain: Column, rcpt_domains: Column, internal: Sequence[str]) -> Column:
    """inbound, outbound or internal, by which side is ours."""
    own = F.array(*map(F.lit, internal))
    from_us = F.array_contains(own, sender_domain)
    to_them = F.exists(rcpt_domains, lambda d: ~F.array_contains(own, d))
    return F.when(~from_us, "inbound").when(to_them, "outbound").otherwise("internal")


PRIVATE = "^(10\\.|127\\.|192\\.168\\.|169\\.254\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|0\\.)"


def external_ip(received: Column) -> Column:
    """The first bracketed public IPv4 address of an array of Received headers."""
    found = F.flatten(F.transform(received, lambda h: F.regexp_extract_all(h, F.lit("\\[(\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3})\\]"), 1)))
    return F.get(F.filter(found, lambda ip: ~ip.rlike(PRIVATE)), F.lit(0))


def disposition(verdicts: DataFrame, rules: DataFrame, most: int = 10_000, salts: int = 64) -> DataFrame:
    """(session_id, rule_id, action): rules whose every condition holds; an empty list means any.

    Up to ``most`` rules are broadcast. More are joined by one key per listed
    category, module and direction, or any; keys without a category and a module
    are few, and so are dealt over ``salts``.
    """
    out = ("v.session_id", "r.rule_id", "r.priority", "r.action")
    if rules.limit(most + 1).count() <= most:
        v, r = verdicts.alias("v"), F.broadcast(rules).alias("r")
        any_of = lambda have, want: (F.size(want) == 0) | F.arrays_overlap(have, want)
        holds = (F.col("v.level_rank") >= F.col("r.min_rank")) & any_of(F.col("v.categories"), F.col("r.categories")) & any_of(F.col("v.modules"), F.col("r.modules")) & ((F.size("r.directions") == 0) | F.array_contains(F.col("r.directions"), F.col("v.direction")))
        return v.join(r, holds).select(*out)
    anything = F.array(F.lit(""))
    marked = lambda values: F.transform(F.array_distinct(F.array_compact(values)), lambda x: F.concat(F.lit("="), x))
    wanted = lambda c: F.when(F.size(c) == 0, anything).otherwise(marked(F.col(c)))
    had = lambda values: F.concat(anything, F.coalesce(marked(values), F.array().cast("array<string>")))
    wide = (F.col("c") == "") & (F.col("m") == "")

    def keyed(df: DataFrame, **lists: Column) -> DataFrame:
        for name, values in lists.items():
            df = df.withColumn(f"{name}s", values).withColumn(name, F.explode(f"{name}s"))
        return df

    v = keyed(verdicts, c=had(F.col("categories")), m=had(F.col("modules")), d=had(F.array("direction")))
    v = v.withColumn("salt", F.when(wide, F.pmod(F.xxhash64("session_id"), F.lit(salts))).otherwise(0).cast("long"))
    r = keyed(rules, c=wanted("categories"), m=wanted("modules"), d=wanted("directions"))
    r = r.withColumn("salt", F.explode(F.when(wide, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    v, r = v.alias("v"), r.alias("r")
    # of several keys that a verdict and a rule share, one counts
    same = F.col("v.salt") == F.col("r.salt")
    for k in ("c", "m", "d"):
        same &= (F.col(f"v.{k}") == F.col(f"r.{k}")) & (F.col(f"r.{k}") == F.get(F.array_intersect(f"r.{k}s", f"v.{k}s"), F.lit(0)))
    return v.join(r.hint("shuffle_merge"), same & (F.col("v.level_rank") >= F.col("r.min_rank"))).select(*out)
