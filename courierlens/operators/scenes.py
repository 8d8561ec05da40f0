"""Campaign scenes and admission: lifecycle upserts, gates and impersonation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.operators.cooldown import taken
from courierlens.operators.text import deletions
from courierlens.schemas import SEVERITIES, rank

_PLACE = {s: i for i, s in enumerate(SEVERITIES)}


def lifecycle(old: DataFrame, found: DataFrame, now, quiet_hours: int = 24, block_at: str = "critical") -> DataFrame:
    """Scenes (scene_type, actor, severity, status, first_seen, last_seen, mails) after a round of findings.

    A found scene is opened or brought up to date and only ever escalates; one
    that was not found and has been quiet is resolved; critical ones are blocked.
    """
    o = old.select("scene_type", "actor", *(F.col(c).alias(f"o_{c}") for c in ("severity", "status", "first_seen", "last_seen", "mails")))
    n = found.select("scene_type", "actor", *(F.col(c).alias(f"n_{c}") for c in ("severity", "first_seen", "last_seen", "mails")))
    both = o.join(n, ["scene_type", "actor"], "full_outer")
    worse = F.coalesce(rank(F.col("n_severity"), _PLACE), F.lit(-1)) >= F.coalesce(rank(F.col("o_severity"), _PLACE), F.lit(-1))
    severity = F.when(worse, F.col("n_severity")).otherwise(F.col("o_severity"))
    last = F.coalesce(F.greatest("o_last_seen", "n_last_seen"), "o_last_seen", "n_last_seen")
    quiet = F.col("n_last_seen").isNull() & (F.col("o_last_seen") < now - F.make_dt_interval(hours=F.lit(quiet_hours)))
    status = F.when(quiet, "resolved").when(severity == block_at, "blocked").when(F.col("n_last_seen").isNotNull(), "active").otherwise(F.col("o_status"))
    return both.select("scene_type", "actor", severity.alias("severity"), status.alias("status"), F.least("o_first_seen", "n_first_seen").alias("first_seen"), last.alias("last_seen"), F.coalesce("n_mails", "o_mails").alias("mails"))


def impersonation(senders: DataFrame, lookalikes: DataFrame, least: int = 3) -> DataFrame:
    """Scenes of look-alike senders: (actor, protected, kind, mails, recipients, severity)."""
    hits = senders.join(lookalikes, senders["sender_domain"] == lookalikes["domain"]).filter(F.col("mails") >= least)
    strong = F.col("kind").isin("homoglyph", "tld_swap")
    severity = F.when(strong & (F.col("mails") >= 10), "critical").when(strong, "high").when(F.col("mails") >= 10, "high").otherwise("medium")
    return hits.select(F.col("sender_domain").alias("actor"), "protected", "kind", "mails", "recipients", severity.alias("severity"))


def admitted(sessions: DataFrame, servers: Sequence[str], trusted_domains: DataFrame, trusted_ips: DataFrame) -> DataFrame:
    """Sessions with headers, delivered to one of our servers if any are named, and not trusted by both domain and address."""
    some = sessions.filter(F.size("headers") > 0)
    ours = some.filter(F.col("server_ip").isin(*servers)) if servers else some
    d, i = trusted_domains.select(F.col("domain").alias("sender_domain")).distinct().withColumn("_d", F.lit(True)), trusted_ips.select(F.col("ip").alias("client_ip")).distinct().withColumn("_i", F.lit(True))
    marked = ours.join(d, "sender_domain", "left").join(i, "client_ip", "left")
    return marked.filter("_d is null or _i is null").select(*sessions.columns)


def reanalysis(events: DataFrame, key: str = "session_id", at: str = "ts", id_: str = "seq", seconds: int = 30, finished: Sequence[str] = ("Completed", "Timeout")) -> DataFrame:
    """Versions of a session that are analysed: the first, later ones outside the window of the last, and the one that finishes it."""
    rows = events.select(key, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"), F.col(id_).alias("id"), F.col("status").isin(*finished).alias("done"))
    # up to the first finished version one chain of cool-downs, and from it on another one
    end = rows.filter("done").groupBy(F.col(key).alias("_of")).agg(F.min(F.struct("t", "id")).alias("_end"))
    marked = rows.join(end, F.col(key).eqNullSafe(F.col("_of")), "left").withColumn("finishes", F.struct("t", "id") == F.col("_end"))
    return taken(marked.select(key, "t", "id", "finishes"), [key], seconds, resets=F.col("finishes")).select(key, F.col("id").alias(id_))


def scene_counts(scenes: DataFrame, now, statuses: Sequence[str] = ("active", "blocked", "resolved")) -> DataFrame:
    """For each scene type: scenes by status, and those seen in the last day."""
    recent = F.col("last_seen") >= now - F.expr("INTERVAL 24 HOURS")
    return scenes.groupBy("scene_type").agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses), F.count_if(recent).alias("last_24h"))


def typos(words: DataFrame, brands: DataFrame, most: int = 2) -> DataFrame:
    """(word, brand, distance): distinct words of four letters or more close to, but not the same as, one of the brands (brand); the nearest one.

    A word and a brand within so many edits share what is left of them after as
    many deletions, so an equi-join brings them together, however many there are.
    """
    w = words.select("word").distinct().filter(F.length("word") >= 4)
    own = w.select("word", F.explode(deletions(F.col("word"), most)).alias("left"))
    met = own.join(brands.select("brand").distinct().select("brand", F.explode(deletions(F.col("brand"), most)).alias("left")), "left").select("word", "brand").distinct()
    near = met.withColumn("distance", F.levenshtein("word", "brand", most)).filter("distance >= 1")
    best = near.groupBy("word").agg(F.min(F.struct("distance", "brand")).alias("b"))
    return best.select("word", "b.brand", F.col("b.distance").cast("int").alias("distance"))
