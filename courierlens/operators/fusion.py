"""Evidence fusion: belief masses (b, d, u, and e for the open world) and their combination rules.

A session has few pieces of evidence and there are many sessions, so each rule
is a fold over the session's sorted array, in the JVM, after one grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.functions.arrays import bound

#: Weight of uncertainty in a risk; weights of the five pillars; pairwise correlations of the eight engines.
ETA = 0.30
PILLAR_WEIGHTS = (1.0, 1.0, 0.8, 1.0, 0.7)
CORRELATION = (
    (0.00, 0.10, 0.05, 0.05, 0.15, 0.05, 0.10, 0.05),
    (0.10, 0.00, 0.10, 0.20, 0.05, 0.30, 0.05, 0.10),
    (0.05, 0.10, 0.00, 0.05, 0.05, 0.05, 0.15, 0.10),
    (0.05, 0.20, 0.05, 0.00, 0.05, 0.10, 0.05, 0.05),
    (0.15, 0.05, 0.05, 0.05, 0.00, 0.05, 0.05, 0.05),
    (0.05, 0.30, 0.05, 0.10, 0.05, 0.00, 0.05, 0.15),
    (0.10, 0.05, 0.15, 0.05, 0.05, 0.05, 0.00, 0.10),
    (0.05, 0.10, 0.10, 0.05, 0.05, 0.15, 0.10, 0.00),
)
ALMOST_ONE = 1 - 1e-12


def mass(b: Column, d: Column, u: Column, e: Column | None = None) -> Column:
    return F.struct(b.alias("b"), d.alias("d"), u.alias("u"), (F.lit(0.0) if e is None else e).alias("e"))


def bpa(score: Column, confidence: Column) -> Column:
    """The mass of a score that is held with some confidence; both are clamped to [0, 1]."""
    s, c = (F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) for x in (score, confidence))
    return mass(s * c, (1 - s) * c, 1 - c)


def risk(m: Column, eta: float = ETA) -> Column:
    return m["b"] + eta * m["u"]


def pignistic(m: Column) -> Column:
    """Belief with half of the uncertainty, over the closed world."""
    rest = 1 - m["e"]
    return F.when(rest < 1e-12, 0.5).otherwise((m["b"] + m["u"] / 2) / rest)


def discounted(m: Column, a: Column) -> Column:
    """Evidence trusted to degree a; what is taken away becomes uncertainty."""
    return mass(m["b"] * a, m["d"] * a, 1 - m["b"] * a - m["d"] * a - m["e"], m["e"])


def evidence(results: DataFrame, key: str | Sequence[str], order: Sequence[str], score: str = "score", confidence: str = "confidence", carry: Sequence[str] = ()) -> DataFrame:
    """(key, items): each session's evidence in a total order, with its masses."""
    item = F.struct(*order, *carry, bpa(F.col(score), F.col(confidence)).alias("m"))
    return results.groupBy(*([key] if isinstance(key, str) else key)).agg(F.sort_array(F.collect_list(item)).alias("items"))


def fold(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """An ordered fold of an array."""
    return F.aggregate(items, zero, step)


def _conflict(x: Column, y: Column) -> Column:
    return x["b"] * y["d"] + x["d"] * y["b"]


def _dempster(x: Column, y: Column) -> Column:
    """x and y by Dempster's rule; x also carries the conflict K so far."""
    k = _conflict(x, y)
    total = k >= ALMOST_ONE
    share = lambda v: v / (1 - k)
    return F.struct(
        F.when(total, 0.0).otherwise(share(x["b"] * y["b"] + x["b"] * y["u"] + x["u"] * y["b"])).alias("b"),
        F.when(total, 0.0).otherwise(share(x["d"] * y["d"] + x["d"] * y["u"] + x["u"] * y["d"])).alias("d"),
        F.when(total, 1.0).otherwise(share(x["u"] * y["u"])).alias("u"),
        F.when(total, 1.0).otherwise(1 - (1 - x["k"]) * (1 - k)).alias("k"),
    )


def dempster(masses: Column) -> Column:
    """All masses of an array, in order: b, d, u and the conflict k; of none, vacuous."""
    zero = F.struct(F.lit(0.0).alias("b"), F.lit(0.0).alias("d"), F.lit(1.0).alias("u"), F.lit(0.0).alias("k"))
    return fold(masses, zero, _dempster)


def conjunctive(masses: Column) -> Column:
    """The open-world rule: conflict goes to e, and the masses are normalised at each step."""

    def step(x: Column, y: Column) -> Column:
        b = x["b"] * y["b"] + x["b"] * y["u"] + x["u"] * y["b"]
        d = x["d"] * y["d"] + x["d"] * y["u"] + x["u"] * y["d"]
        u = x["u"] * y["u"]
        e = _conflict(x, y) + x["e"] * (y["b"] + y["d"] + y["u"] + y["e"]) + y["e"] * (x["b"] + x["d"] + x["u"])
        n = b + d + u + e
        return mass(b / n, d / n, u / n, e / n)

    return fold(masses, mass(F.lit(0.0), F.lit(0.0), F.lit(1.0)), step)


def cautious(x: Column, y: Column) -> Column:
    """The larger belief, disbelief and openness, the smaller uncertainty, normalised."""
    b, d, u, e = F.greatest(x["b"], y["b"]), F.greatest(x["d"], y["d"]), F.least(x["u"], y["u"]), F.greatest(x["e"], y["e"])
    n = b + d + u + e
    return mass(b / n, d / n, u / n, e / n)


def distance(x: Column, y: Column) -> Column:
    """The distance of two masses."""
    db, dd, du, de = (x[c] - y[c] for c in "bdue")
    return F.sqrt(F.greatest(F.lit(0.0), 0.5 * (db * db + dd * dd + du * du + de * de + db * du + dd * du)))


def murphy(masses: Column) -> Column:
    """The credibility-weighted mean of the masses, combined with itself once less than there are masses."""

    def combined(m: Column) -> Column:
        support = F.transform(m, lambda x: F.aggregate(m, F.lit(0.0), lambda s, y: s + 1 - distance(x, y)) - 1)
        n, none = F.size(m), F.array().cast("array<struct<b:double,d:double,u:double,e:double>>")

        def shares(weights: Column) -> Column:
            total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
            uniform = lambda t: (t <= 1e-8) | F.exists(weights, lambda w: w / t > 0.99)
            return bound(total, lambda t: bound(uniform(t), lambda even: F.transform(weights, lambda w: F.when(even, 1.0 / n).otherwise(w / t))))

        def mean(share: Column) -> Column:
            part = lambda c: F.aggregate(F.zip_with(m, share, lambda x, w: x[c] * w), F.lit(0.0), lambda s, v: s + v)
            return mass(part("b"), part("d"), part("u"))

        once = bound(bound(support, shares), mean)
        return bound(once, lambda x: dempster(F.when(n == 0, none).otherwise(F.transform(F.sequence(F.lit(1), n), lambda _: x))))

    return bound(masses, combined)


def correlation_discount(items: Column, engine: str = "engine") -> Column:
    """Each item's mass, discounted by the largest correlation of its engine (from 0) with another one present, from 0.1 up."""
    table = F.array(*(F.array(*map(F.lit, row)) for row in CORRELATION))

    def one(x: Column) -> Column:
        rho = F.array_max(F.transform(F.filter(items, lambda y: y[engine] != x[engine]), lambda y: F.get(F.get(table, x[engine]), y[engine])))
        return discounted(x["m"], F.when(rho >= 0.1, 1 - rho).otherwise(1.0))

    return F.transform(items, one)


def weight_cap(weights: Column, cap: float = 0.40) -> Column:
    """Weights of which none holds more than a share of the total; the excess goes to the others in proportion, for as many rounds as there are weights."""

    def total(w: Column) -> Column:
        return F.aggregate(w, F.lit(0.0), lambda s, x: s + x)

    def step(w: Column, _: Column) -> Column:
        def spread(limit: Column) -> Column:
            over = F.aggregate(w, F.lit(0.0), lambda s, x: s + F.greatest(x - limit, F.lit(0.0)))
            free = F.aggregate(w, F.lit(0.0), lambda s, x: s + F.when(x <= limit, x).otherwise(0.0))
            return bound(F.when(free > 0, over / free).otherwise(0.0), lambda more: F.transform(w, lambda x: F.when(x > limit, limit).otherwise(x + x * more)))

        return bound(cap * total(w), spread)

    done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(weights), F.lit(1))), weights, step)
    return bound(done, lambda w: bound(total(w), lambda t: F.transform(w, lambda x: F.when(t > 0, x / t).otherwise(x))))


def without_each(masses: Column) -> Column:
    """The largest change of the combined risk when one mass is left out."""
    one = lambda m: bound(dempster(m), risk)
    others = bound(one(masses), lambda whole: F.transform(masses, lambda _, i: F.abs(whole - one(F.filter(masses, lambda m, j: j != i)))))
    return F.coalesce(F.array_max(others), F.lit(0.0))


def noisy_or(parts: Column) -> Column:
    """1 - prod(1 - x), as an aggregate."""
    return 1 - F.product(1 - parts)


def pillar_scores(results: DataFrame, key: str, pillar: str, weight: Column | float = 1.0) -> DataFrame:
    """(key, pillar, t): the noisy-or of the weighted scores of a pillar."""
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return results.groupBy(key, pillar).agg(noisy_or(F.least(F.lit(1.0), F.col("score") * w)).alias("t"))


def noisy_or_verdict(pillars: DataFrame, key: str, pillar: str) -> DataFrame:
    """(key, score): the noisy-or over weighted pillars, raised by how many of the five speak."""
    weights = F.array(*map(F.lit, PILLAR_WEIGHTS))
    base = noisy_or(F.least(F.lit(1.0), F.col("t") * F.get(weights, F.col(pillar).cast("int"))))
    rows = pillars.groupBy(key).agg(base.alias("base"), (F.count_if(F.col("t") > 0.05) / 5.0).alias("diversity"))
    return rows.select(key, (F.col("base") + (1 - F.col("base")) * F.col("diversity") * 0.20).alias("score"))
