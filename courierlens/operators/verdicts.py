"""Verdicts composed of the fusion rules: engine fusion with breakers, the open world, and evidence clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.functions.arrays import bound
from courierlens.operators import fusion as op

#: Fixed values of the evidence clusters: cap of the score, scale of the confidence, scale of the threat.
CLUSTERS = {
    "inherited_gateway_prior": (0.35, 0.45, 0.45),
    "delivery_integrity": (0.40, 0.55, 0.55),
    "sender_identity_authenticity": (0.85, 0.82, 1.0),
    "link_and_html_deception": (0.90, 0.86, 1.0),
    "payload_malware": (0.95, 0.92, 1.05),
    "external_reputation_ioc": (0.75, 0.72, 0.85),
    "social_engineering_intent": (0.78, 0.76, 0.92),
    "business_sensitivity": (0.45, 0.50, 0.45),
}


#: Pairs of categories that are worse together, and evidence that no alignment excuses.
DANGEROUS_PAIRS = (("external_impersonation", "nonsensical_spam"), ("external_impersonation", "phishing"), ("phishing", "spoofing"), ("phishing", "malware"), ("phishing", "nonsensical_spam"))
HARD_MODULES = ("link_scan", "link_content", "link_reputation", "attach_hash", "av_eml_scan", "av_attach_scan", "sandbox_scan", "yara_scan")
HARD_CATEGORIES = ("phishing", "account_security_phishing", "targeted_credential_phishing", "ioc_ip_hit", "sender_ip_malicious", "malware_hash", "virus_detected", "suspicious_params")


def circumstances(results: DataFrame, alignment: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, paired, discount) of results (key, module, rank, categories): a dangerous pair, and what a sender's alignment takes off."""
    each = results.filter("rank > 0").select(key, "module", F.explode_outer("categories").alias("category"))
    hard = F.col("module").isin(*HARD_MODULES) | F.coalesce(F.col("category").isin(*HARD_CATEGORIES), F.lit(False))
    per = each.groupBy(key).agg(F.collect_set("category").alias("c"), F.count_distinct("module").alias("n"), F.bool_or(hard).alias("hard"))
    pair = F.lit(False)
    for a, b in DANGEROUS_PAIRS:
        pair |= F.array_contains("c", a) & F.array_contains("c", b)
    known = alignment.select(key, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("alignment", F.lit(0.0)))).alias("a"))
    rows = results.select(key).distinct().join(per.select(key, pair.alias("paired"), "n", "hard"), key, "left").join(known, key, "left")
    excused = (F.coalesce("n", F.lit(0)) <= 1) & ~F.coalesce("hard", F.lit(False))
    return rows.select(key, F.coalesce("paired", F.lit(False)).alias("paired"), F.when(excused, 1 - 0.40 * F.coalesce("a", F.lit(0.0))).otherwise(1.0).alias("discount"))


def with_circumstances(scores: DataFrame, around: DataFrame, key: str = "session_id", additive: bool = False) -> DataFrame:
    """(key, score) raised for a dangerous pair, by a quarter of the headroom or by .20, then discounted."""
    more = F.least(F.lit(1.0), F.col("score") + 0.20) if additive else F.col("score") + (1 - F.col("score")) * 0.25
    return scores.join(around, key).select(key, (F.when(F.col("paired"), more).otherwise(F.col("score")) * F.col("discount")).alias("score"))


def weighted_max(results: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, score) of results (key, module, pillar, rank from 0 to 4, weight, confidence): the strongest one, raised by how many pillars and modules speak."""
    flagged = F.col("rank") > 0
    top = F.max(F.col("rank") / 4.0 * F.col("weight") * F.col("confidence"))
    rows = results.groupBy(key).agg(top.alias("top"), F.count_distinct(F.when(flagged, F.col("pillar"))).alias("pillars"), F.count_distinct(F.when(flagged, F.col("module"))).alias("modules"))
    pillars = F.when(F.col("pillars") >= 3, 0.25).when(F.col("pillars") == 2, 0.15).otherwise(0.0)
    modules = F.when(F.col("modules") >= 4, 0.15).when(F.col("modules") == 3, 0.10).otherwise(0.0)
    return rows.select(key, F.least(F.lit(1.0), F.col("top") + pillars + modules).alias("score"))


def _of_cluster(cluster: Column, place: int) -> Column:
    out = F.lit(None).cast("double")
    for name, values in CLUSTERS.items():
        out = F.when(cluster == name, values[place]).otherwise(out)
    return out


def _steps(x: Column, *values: float) -> Column:
    """values[x - 1], the first one from below and the last one from above."""
    out = F.lit(values[0])
    for i, v in enumerate(values[1:], 2):
        out = F.when(x >= i, v).otherwise(out)
    return out


def engine_verdict(engines: DataFrame, modules: DataFrame, key: str = "session_id", factor: float = 1.0) -> DataFrame:
    """(key, risk, conflict): engines (key, items of engine and m) by Murphy's rule after discounts, with two floors.

    modules (key, b, confidence) give the floors: the belief of one sure module,
    and several modules that agree; both weigh how many engines support them.
    """
    fused = engines.select(key, op.murphy(op.correlation_discount(F.col("items"))).alias("r"), F.size(F.filter("items", lambda x: x["m"]["b"] > 0.05)).alias("support"))
    signs = modules.groupBy(key).agg(F.max(F.when(F.col("confidence") >= 0.80, F.col("b"))).alias("sure"), F.count_if(F.col("b") > 0.10).alias("n"))
    rows = fused.join(signs, key).withColumn("risk", F.col("r.b") + op.ETA * F.col("r.u"))
    boost = F.when(F.col("n") >= 3, 1 + 0.15 * (F.col("n") - 2)).otherwise(1.0)
    capped = lambda x: F.least(F.lit(0.90), x * boost)
    breaker = F.when(F.col("sure") >= 0.20, F.greatest(F.lit(0.15), capped(F.col("sure") * factor) * _steps(F.col("support"), 0.30, 0.50, 0.75, 1.0)))
    agree = F.when(F.col("n") >= 2, F.greatest(F.lit(0.15), capped(F.lit(0.40)) * _steps(F.col("support"), 0.50, 0.75, 1.0)))
    return rows.select(key, F.greatest("risk", breaker, agree).alias("risk"), F.col("r.k").alias("conflict"))


def open_world_verdict(engines: DataFrame, key: str = "session_id", epsilon: float = 0.01, technical: int = 4) -> DataFrame:
    """(key, risk, novelty): a small openness is put into every mass; technical engines and the others are combined apart, then cautiously."""
    opened = F.transform("items", lambda x: F.struct(x["engine"].alias("engine"), op.mass(x["m"]["b"] * (1 - epsilon), x["m"]["d"] * (1 - epsilon), x["m"]["u"] * (1 - epsilon), F.lit(epsilon)).alias("m")))
    rows = engines.select(key, opened.alias("o"))
    part = lambda keep: op.conjunctive(F.transform(F.filter("o", keep), lambda x: x["m"]))
    both = rows.select(key, part(lambda x: x["engine"] < technical).alias("t"), part(lambda x: x["engine"] >= technical).alias("s"))
    novelty = 1 - (1 - F.col("t.e")) * (1 - F.col("s.e"))
    return both.select(key, op.cautious(F.col("t"), F.col("s")).alias("r"), novelty.alias("novelty")).select(key, op.risk(F.col("r")).alias("risk"), "novelty")


def clusters(findings: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, cluster, score, confidence) from findings (key, cluster, family, module, score, weight, confidence).

    A family counts by its strongest finding; families add up by noisy-or.
    """
    family = findings.groupBy(key, "cluster", "family").agg(F.max(F.least(F.lit(1.0), F.col("score") * F.col("weight"))).alias("f"), F.max("confidence").alias("c"), F.collect_set("module").alias("m"))
    per = family.groupBy(key, "cluster").agg(op.noisy_or(F.col("f")).alias("s"), F.count(F.lit(1)).alias("families"), F.max("c").alias("c"), F.size(F.array_distinct(F.flatten(F.collect_list("m")))).alias("modules"))
    score = F.least(F.col("s") + 0.04 * F.least(F.lit(3), F.col("families") - 1), _of_cluster(F.col("cluster"), 0))
    confidence = F.least(F.lit(0.95), F.greatest(F.lit(0.20), F.col("c") * _of_cluster(F.col("cluster"), 1) + 0.03 * F.least(F.lit(3), F.col("modules") - 1)))
    return per.select(key, "cluster", score.alias("score"), confidence.alias("confidence"))


def cluster_verdict(per: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, risk, confidence, n_clusters): the weighted mean of the clusters' masses combined with itself, and its floors."""
    threat = F.least(F.lit(1.0), F.col("score") * _of_cluster(F.col("cluster"), 2))
    live = per.filter("score >= 0.05").withColumns({"m": op.bpa(threat, F.col("confidence")), "w": F.greatest(F.lit(0.05), threat * F.col("confidence"))})
    total = F.sum("w")
    mean = lambda c: F.sum(F.col(f"m.{c}") * F.col("w")) / total
    rows = live.groupBy(key).agg(
        op.mass(mean("b"), mean("d"), mean("u")).alias("m"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("c"), F.count_if(F.col("score") >= 0.15).alias("agree"),
        F.max(F.when((F.col("score") >= 0.55) & (F.col("confidence") >= 0.70), F.greatest(F.lit(0.40), 0.8 * F.col("score")))).alias("breaker"),
    )
    again = bound(F.col("m"), lambda m: op.dempster(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda _: m)))
    risk = rows.withColumn("r", again).withColumn("risk", op.risk(F.col("r")))
    floor = F.when(F.col("agree") >= 3, F.least(F.lit(0.55), 0.35 + 0.05 * (F.col("agree") - 2)))
    return risk.select(key, F.least(F.lit(0.99), F.greatest(F.lit(0.0), "risk", "breaker", floor)).alias("risk"), F.greatest(F.lit(0.55), "c").alias("confidence"), F.col("n").alias("n_clusters"))
