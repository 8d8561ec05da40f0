"""Text, DLP and URL jobs: one pass over a table gives findings rows or signal columns.

Everything is built-in expressions. Patterns stay in the subset that all
regular-expression dialects read alike: no look-around, borders are spelled out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.functions.arrays import bound


def without_frame(text: Column, notices: Sequence[str], footers: Sequence[str]) -> Column:
    """A text without the notice lines it begins with, and without what follows a footer's first words."""
    is_notice = lambda line: reduce(Column.__or__, (F.lower(line).contains(n) for n in notices), F.lit(False)) | (F.trim(line) == "")
    cut = reduce(lambda t, f: F.split_part(t, F.lit(f), F.lit(1)), footers, text)

    def body(lines: Column) -> Column:
        own = F.filter(F.transform(lines, lambda x, i: F.when(~is_notice(x), i)), lambda i: i.isNotNull())
        first = F.coalesce(F.get(own, F.lit(0)), F.size(lines))
        return F.array_join(F.slice(lines, first + 1, F.greatest(F.size(lines) - first, F.lit(0))), "\n")

    return bound(F.split(cut, "\n"), body)


def keyword_score(docs: DataFrame, strong: Sequence[str], weak: Sequence[str], business: Sequence[str] = (), notices: Sequence[str] = (), footers: Sequence[str] = (), id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, strong, weak, phrases, words, score) of the terms that a text holds.

    Strong terms count .08 each up to .5; three weak ones or more .03 each up to
    .15; business phrases .15 each up to .5, or three single words or more .05
    each up to .15.
    """
    low = F.lower(without_frame(F.coalesce(F.col(text), F.lit("")), notices, footers))

    def counted(t: Column) -> Column:
        hits = lambda words: sum((t.contains(w).cast("long") for w in words), F.lit(0).cast("long"))
        kinds = {"strong": strong, "weak": weak, "phrases": [w for w in business if " " in w], "words": [w for w in business if " " not in w]}
        return F.struct(*(hits(words).alias(k) for k, words in kinds.items()))

    rows = docs.select(id_, bound(low, counted).alias("k")).select(id_, "k.*")
    some = lambda c, each, most: F.when(F.col(c) >= 3, F.least(F.lit(most), each * F.col(c))).otherwise(0.0)
    plot = F.when(F.col("phrases") > 0, F.least(F.lit(0.5), 0.15 * F.col("phrases"))).otherwise(some("words", 0.05, 0.15))
    return rows.withColumn("score", F.least(F.lit(0.5), 0.08 * F.col("strong")) + some("weak", 0.03, 0.15) + plot)


#: What sensitive data in a text adds to its score.
DATA_BONUS = {"credit_card": 0.3, "id_number": 0.25, "credential_leak": 0.2}


def with_data_bonus(scores: DataFrame, findings: DataFrame, id_: str = "doc_id") -> DataFrame:
    """scores raised by the classes found in the same text, up to 1."""
    bonus = reduce(lambda rest, k: F.when(F.col("class") == k, DATA_BONUS[k]).otherwise(rest), DATA_BONUS, F.lit(0.0))
    per = findings.groupBy(id_).agg(F.sum(bonus).alias("_bonus"))
    return scores.join(per, id_, "left").withColumn("score", F.least(F.lit(1.0), F.col("score") + F.coalesce("_bonus", F.lit(0.0)))).drop("_bonus")


def pattern_hits(docs: DataFrame, rules: Sequence[tuple[str, str, str, Sequence[str]]], id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rule, severity) of rules (name, severity, "any" or "all", strings) that a text meets."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def hit(condition: str, strings: Sequence[str]) -> Column:
        out = F.lit(condition == "all")
        for s in strings:
            out = (out & whole.contains(s)) if condition == "all" else (out | whole.contains(s))
        return out

    found = F.array(*(F.when(hit(c, strings), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, c, strings in rules))
    return docs.select(id_, F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r")).select(id_, "r.*")


#: Set phrases, connectives, and full forms with their contractions.
PHRASES = (
    "i hope this email finds you well", "i hope this message finds you well", "i am reaching out regarding", "i am writing to inform you", "i am writing to let you know", "please do not hesitate to",
    "should you have any questions", "should you require any further", "thank you for your time and consideration", "looking forward to your prompt response", "we appreciate your understanding",
    "we kindly ask that you", "as previously mentioned", "in light of recent", "我希望这封邮件", "希望您一切顺利", "如有任何疑问，请随时", "如您有任何问题", "感谢您的理解与配合", "期待您的及时回复", "请您务必在", "为了确保您的账户",
)
CONNECTIVES = ("furthermore", "moreover", "additionally", "consequently", "subsequently", "nevertheless", "nonetheless", "henceforth", "thereafter", "in conclusion", "to summarize")
HAN_CONNECTIVES = ("此外", "然而", "尽管如此", "综上所述", "因此", "鉴于此", "与此同时")
FULL_FORMS, SHORT_FORMS = ("do not ", "will not ", "cannot ", "i am ", "we are ", "you are "), ("don't ", "won't ", "can't ", "i'm ", "we're ", "you're ")
LEAST_PROSE, LONG_SENTENCE = 80, 80


def prose_signals(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, phrases, connectives, han_connectives, long_share, formal, n_signals, score) of texts of 80 characters or more.

    Signals: set phrases, three connectives or more in either language, mostly
    long sentences, and full forms without a contraction. Two signals score
    .15, three .22, four or more .30.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(id_, t.alias("_t")).filter(F.length("_t") >= LEAST_PROSE).select(id_, "_t", F.lower("_t").alias("_low"))
    held = lambda words: sum((F.col("_low").contains(w).cast("long") for w in words), F.lit(0).cast("long"))
    times = lambda words: sum(((F.length("_low") - F.length(F.replace("_low", F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0))
    lengths = F.filter(F.transform(F.split("_t", "[.!?。！？\n]"), lambda s: F.length(F.regexp_replace(s, "\\s", ""))), lambda n: n > 0)
    share = bound(lengths, lambda n: F.when(F.size(n) >= 4, F.size(F.filter(n, lambda x: x >= LONG_SENTENCE)) / F.size(n)).otherwise(0.0))
    rows = rows.select(
        id_, held(PHRASES).alias("phrases"), held(CONNECTIVES).alias("connectives"), held(HAN_CONNECTIVES).alias("han_connectives"), share.alias("long_share"),
        ((times(FULL_FORMS) > 3.5) & (times(SHORT_FORMS) < 0.5)).alias("formal"),
    )
    signs = (F.col("phrases") > 0, F.col("connectives") >= 3, F.col("han_connectives") >= 3, F.col("long_share") >= 0.5, F.col("formal"))
    n = sum((s.cast("long") for s in signs), F.lit(0).cast("long"))
    score = F.when(F.col("n_signals") >= 4, 0.30).when(F.col("n_signals") == 3, 0.22).when(F.col("n_signals") == 2, 0.15).otherwise(0.0)
    return rows.withColumn("n_signals", n).withColumn("score", score)


#: Ideographs of the basic block and those that are rare; the least number that is judged, the normal range of their entropy, and the least shares that are odd.
IDEOGRAPHS = "\\x{4E00}-\\x{9FFF}"
RARE = "\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B820}-\\x{2EBEF}\\x{2F800}-\\x{2FA1F}\\x{30000}-\\x{3134F}"
LEAST_IDEOGRAPHS, LEAST_PAIRS, CALM, WILD, RARE_SHARE, UNIQUE_SHARE = 10, 50, 4.0, 7.5, 0.05, 0.92


def entropy(values: Column) -> Column:
    """Bits of entropy of the values of an array: equal ones lie side by side once it is sorted, so one pass counts them."""
    n = F.size(values)
    of = lambda last, run, total: F.struct(last.alias("last"), run.alias("run"), total.alias("total"))
    bits = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    start = of(F.lit(None).cast("string"), F.lit(0.0), F.lit(0.0))
    step = lambda s, x: F.when(x.eqNullSafe(s["last"]), of(x, s["run"] + 1, s["total"])).otherwise(of(x, F.lit(1.0), s["total"] + bits(s["run"])))
    total = F.aggregate(F.sort_array(values), start, step, lambda s: s["total"] + bits(s["run"]))
    found = F.log2(n.cast("double")) - total / n
    return F.when((n > 0) & (found > 1e-12), found).otherwise(0.0)  # a single value may leave last bits


def script_mix(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, n_other, ratio, n_ideographs, rare, entropy, unique_pairs, score) of each text.

    n and n_other are letters and those that are not ASCII. Of the ideographs:
    the share of rare ones, the entropy, the share of different pairs among
    neighbours, and how odd these are together (0 to 1).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    letters = F.length(F.regexp_replace(t, "[^\\p{L}]", ""))
    other = F.length(F.regexp_replace(t, "[^\\p{L}]|[A-Za-z]", ""))
    signs = F.regexp_extract_all(t, F.lit(f"([{IDEOGRAPHS}{RARE}])"), 1)
    rows = docs.select(id_, letters.cast("long").alias("n"), other.cast("long").alias("n_other"), signs.alias("_s"))
    n = F.size("_s")
    rare = F.size(F.filter("_s", lambda c: c.rlike(f"[{RARE}]")))
    pairs = F.zip_with(F.slice("_s", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("_s", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    rows = rows.select(
        id_, "n", "n_other", F.when(F.col("n") > 0, F.col("n_other") / F.col("n")).otherwise(0.0).alias("ratio"), n.cast("long").alias("n_ideographs"), F.when(n > 0, rare / n).otherwise(0.0).alias("rare"),
        entropy(F.col("_s")).alias("entropy"), F.when(n > 1, F.size(F.array_distinct(pairs)) / (n - 1)).otherwise(0.0).alias("unique_pairs"),
    )
    upto1 = lambda x: F.least(x, F.lit(1.0))
    odd_rare = F.when(F.col("rare") > RARE_SHARE, upto1((F.col("rare") - RARE_SHARE) / 0.25)).otherwise(0.0)
    e, u, enough = F.col("entropy"), F.col("unique_pairs"), F.col("n_ideographs") - 1 >= LEAST_PAIRS
    odd_entropy = F.when((e > 0) & (e < CALM), upto1((CALM - e) / CALM)).when(e > WILD, upto1((e - WILD) / 3)).otherwise(0.0)
    odd_pairs = F.when(~enough, 0.0).when(u > UNIQUE_SHARE, upto1((u - UNIQUE_SHARE) / (1 - UNIQUE_SHARE))).when(u < 0.1, 1.0).otherwise(0.0)
    counted = lambda x: F.when(x > 0.1, x).otherwise(0.0)
    score = upto1(0.4 * odd_rare + 0.3 * counted(odd_entropy) + 0.3 * counted(odd_pairs))
    return rows.withColumn("score", F.when(F.col("n_ideographs") < LEAST_IDEOGRAPHS, 0.0).otherwise(score))


HTML_CHAIN = (("(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " "), ("<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("[ \\t\\r\\n]+", " "))


def html_to_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags; entities decoded; white space collapsed."""
    for pattern, to in HTML_CHAIN:
        html = F.regexp_replace(html, pattern, to)
    return F.trim(html)


def html_signals(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """Counts of active content, handlers, hidden parts, refreshes, script links, and invisible characters."""
    h = F.coalesce(F.col(html), F.lit(""))
    count = lambda p, name: F.regexp_count(h, F.lit(p)).cast("long").alias(name)
    return pages.select(id_, count("<(?:script|iframe|object|embed)", "active"), count(" on[a-z]+ ?=", "handlers"), count("display: ?none|visibility: ?hidden", "hidden"), count("http-equiv=.refresh", "refreshes"), count("href=.javascript:", "script_links"), count("[\\x{200B}\\x{200C}\\x{200D}\\x{202A}-\\x{202E}]", "invisible"))


def links(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """(id, n, url): every link of a page, in order."""
    return pages.select(id_, F.posexplode(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), 1)).alias("n", "url"))


#: Words of addresses that ask for secrets, and houses that may use them.
ASKING = ("login", "signin", "account", "verify", "secure", "update", "confirm", "password", "credential", "authenticate")
HOUSES = ("google.com", "microsoft.com", "apple.com", "amazon.com")
ANCHOR = "(?is)<a[^>]*href=(?:\"[^\">]*\"|'[^'>]*')[^>]*>(?:.*?</a>)?"


def suspicious(url: Column) -> Column:
    """Whether a URL's host is an IPv4 address, or it asks for secrets and names none of the known houses."""
    low = F.lower(url)
    some = lambda words: reduce(Column.__or__, (low.contains(w) for w in words))
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return url.rlike(f"^https?://{octet}(?:[.]{octet}){{3}}(?:[:/]|$)") | (some(ASKING) & ~some(HOUSES))


def anchored_links(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """(id, n, url, text, suspicious, other_host): every different http link of a page.

    Anchors come first, with their text without tags and spare blanks, then
    other href and src values; of one URL the first text counts. other_host
    tells that the text names a host of another registered domain.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    quoted = lambda name, q: f"(?i){name}={q}([^{q}]*){q}"
    attribute = lambda m, q: F.nullif(F.regexp_extract(F.regexp_extract(m, "^<[^>]*>", 0), quoted("href", q), 1), F.lit(""))
    plain = lambda m: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "(?i)^<[^>]*>|</a>$", ""), "<[^>]*(?:>|$)", " "), "\\s+", " "))
    link = lambda url, text: F.struct(url.alias("url"), text.alias("text"))
    anchors = F.transform(F.regexp_extract_all(h, F.lit(ANCHOR), 0), lambda m: link(F.coalesce(attribute(m, '"'), attribute(m, "'")), F.nullif(plain(m), F.lit(""))))
    values = [F.regexp_extract_all(h, F.lit(quoted(name, q)), 1) for name in ("href", "src") for q in ('"', "'")]
    others = F.transform(F.concat(*values), lambda u: link(u, F.lit(None).cast("string")))
    rows = pages.select(id_, F.filter(F.concat(anchors, others), lambda x: x["url"].rlike("^https?://")).alias("_l"))
    told = lambda u: F.get(F.filter("_l", lambda x: (x["url"] == u) & x["text"].isNotNull()), F.lit(0))["text"]
    each = rows.select(id_, F.posexplode(F.transform(F.array_distinct("_l.url"), lambda u: link(u, told(u)))).alias("n", "x")).select(id_, "n", "x.url", "x.text")
    named = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "((?:[A-Za-z0-9-]+[.])+[A-Za-z]{2,})", 1))
    other = (named != "") & (registrable(named) != registrable(host_of(F.col("url"))))
    return each.withColumns({"suspicious": suspicious(F.col("url")), "other_host": other})


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.]*://(?:[^/@]*@)?([^/:?#]+)", 1))


#: Common second-level public suffixes.
COMPOUND_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "com.cn", "net.cn", "org.cn", "gov.cn", "com.hk", "com.tw", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.sg", "co.in", "co.nz", "com.mx", "co.za")


def registrable(host: Column) -> Column:
    """The domain that was registered: two labels, or three under a compound suffix."""
    parts = F.split(host, "[.]")
    last = lambda k: F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k), ".")
    return F.when(last(2).isin(*COMPOUND_SUFFIXES), last(3)).otherwise(last(2))


def url_signals(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct URLs with checks of host and shape, and a score; join back by the URL."""
    u = F.col(url)
    host = host_of(u)
    rows = urls.select(u).distinct().select(
        url, host.alias("host"),
        host.rlike("^[0-9.]+$").alias("ip_host"), u.contains("@").alias("has_at"), (F.size(F.split(host, "[.]")) > 4).alias("deep"),
        (F.length(u) > 100).alias("long_url"), host.contains("xn--").alias("punycode"), u.rlike("(?:redirect|url|target|next)=http").alias("redirects"), (~u.startswith("https:")).alias("plain"),
    )
    weight = {"ip_host": 0.3, "has_at": 0.25, "deep": 0.1, "long_url": 0.1, "punycode": 0.25, "redirects": 0.2, "plain": 0.05}
    return rows.withColumn("score", F.least(F.lit(1.0), sum((F.when(F.col(k), w).otherwise(0.0) for k, w in weight.items()), F.lit(0.0))))


def redirect_targets(urls: DataFrame, url: str = "url") -> DataFrame:
    """(url, target): the URL inside a URL's query, decoded twice."""
    inner = F.regexp_extract(F.col(url), "[?&](?:url|redirect|target|next|to)=([^&#]+)", 1)
    target = F.try_url_decode(F.try_url_decode(inner))
    return urls.select(url, target.alias("target")).filter("target LIKE 'http%'")


#: Look-alike characters folded to one, and pairs read as one letter.
FOLD_FROM, FOLD_TO = "0135789|", "olesbtgl"


def folded(name: Column) -> Column:
    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return F.translate(name, FOLD_FROM, FOLD_TO)


def deletions(name: Column, most: int) -> Column:
    """A name, and what is left of it without one, two, ... ``most`` of its characters.

    Two names within so many edits have one of these in common.
    """
    without = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    found = F.array(name)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, without))))
    return found


def _bands(name: Column) -> Column:
    """Keys that bring an edited name and its model together: (band, what is left of the name).

    One edit is allowed among names of six letters, two among those of up to
    twelve. Longer ones may have three, so one of the model's halves has one at
    most: that half is the key, and a name offers what it could be.
    """
    n = F.length(name)
    keys = lambda band, found: F.transform(found, lambda x: F.concat(F.lit(band), x))
    none = F.array().cast("array<string>")
    return F.concat(F.when(n <= 6, keys("1:", deletions(name, 1))).otherwise(none), F.when(n.between(5, 12), keys("2:", deletions(name, 2))).otherwise(none))


def _halves(name: Column, model: bool) -> Column:
    """The keys of a long name by halves: its own if it is the model, else those of every model that it may come from."""
    n = F.length(name)
    keys = lambda side, half, part: F.transform(deletions(part, 1), lambda x: F.concat(F.lit(side), half.cast("string"), F.lit(":"), x))

    def of(half: Column, rest: Column, ahead: Column, behind: Column) -> Column:
        return F.concat(keys("<", half, F.substr(name, F.lit(1), ahead)), keys(">", rest, F.substr(name, F.greatest(n - behind + 1, F.lit(1)), behind)))

    if model:
        half = F.floor(n / 2).cast("int")
        return of(half, n - half, half, n - half)
    sizes = F.sequence(F.greatest(F.lit(10), n - 3), n + 3)
    each = F.flatten(F.transform(sizes, lambda m: F.transform(F.array(*(F.lit(d) for d in (-1, 0, 1))), lambda d: F.struct(m.alias("m"), d.alias("d")))))
    return F.array_distinct(F.flatten(F.transform(each, lambda x: bound(F.floor(x["m"] / 2).cast("int"), lambda h: of(h, x["m"] - h, h + x["d"], x["m"] - h + x["d"])))))


def _affixes(name: Column) -> Column:
    """What a name of another one with something before or behind it begins or ends with, from four letters on."""
    n = F.length(name)
    some = F.filter(F.sequence(F.lit(4), F.greatest(n, F.lit(4))), lambda k: k < n)
    return F.transform(F.concat(F.transform(some, lambda k: F.substr(name, F.lit(1), k)), F.transform(some, lambda k: F.substr(name, n - k + 1, k))), lambda x: F.concat(F.lit("a:"), x))


def candidates(names: DataFrame, models: DataFrame) -> DataFrame:
    """Distinct (base, pbase): names and models that may be within the edits that their length allows, or one the other's beginning or end."""
    none = F.array().cast("array<string>")
    long = lambda c, model: F.when(F.length(c) >= 10, _halves(F.col(c), model)).otherwise(none)
    own = names.select("base", F.explode(F.array_distinct(F.concat(_bands(F.col("base")), long("base", False), _affixes(F.col("base"))))).alias("key"))
    whole = F.when(F.length("pbase") >= 4, F.array(F.concat(F.lit("a:"), "pbase"))).otherwise(none)
    theirs = models.select("pbase", F.explode(F.array_distinct(F.concat(_bands(F.col("pbase")), long("pbase", True), whole))).alias("key"))
    return own.join(theirs, "key").select("base", "pbase").distinct()


def lookalikes(domains: DataFrame, protected: DataFrame) -> DataFrame:
    """(domain, protected, kind, score): each domain's best resemblance to a protected one.

    Equi-joins bring candidates together, so the work is linear in the domains:
    an edited name and its model have what is left after deletions in common,
    and a homoglyph folds to the same name.
    """
    split = lambda c, x, y: (F.regexp_replace(c, "[.][^.]*$", "").alias(x), F.regexp_extract(c, "[.]([^.]*)$", 1).alias(y))
    d = domains.select("domain").distinct().select("domain", *split("domain", "base", "tld")).filter(F.length("base") >= 3)
    p = protected.select(F.col("domain").alias("protected")).distinct().select("protected", *split("protected", "pbase", "ptld")).filter(F.length("pbase") >= 3)
    names, models = d.select("base").distinct(), p.select("pbase").distinct()
    folds = names.withColumn("f", folded(F.col("base"))).join(models.withColumn("f", folded(F.col("pbase"))), "f")
    met = candidates(names, models).unionByName(folds.select("base", "pbase")).distinct()
    near = F.levenshtein("base", "pbase", 3)
    longest = F.greatest(F.length("base"), F.length("pbase"))
    allowed = F.when(longest <= 6, 1).when(longest <= 12, 2).otherwise(3)
    edited = (near >= 1) & (near <= allowed) & (F.length("pbase") >= 4)
    affix = (F.col("base") != F.col("pbase")) & (F.length("pbase") >= 4) & (F.col("base").startswith(F.col("pbase")) | F.col("base").endswith(F.col("pbase")))
    same = F.col("base") == F.col("pbase")
    of = lambda score, kind: F.struct(score.alias("score"), F.lit(kind).alias("kind"))
    kind = (
        F.when(~same & (folded(F.col("base")) == folded(F.col("pbase"))), of(F.lit(0.95), "homoglyph"))
        .when(same & (F.col("tld") != F.col("ptld")), of(F.lit(0.90), "tld_swap"))
        .when(edited, of(F.when(near == 1, 0.85).when(near == 2, 0.75).otherwise(0.65), "edit_distance"))
        .when(affix, of(F.lit(0.70), "affix"))
    )
    pairs = met.join(d, "base").join(p, "pbase").filter("domain <> protected").withColumn("k", kind).filter("k is not null")
    best = pairs.groupBy("domain").agg(F.max(F.struct("k.score", F.col("protected"), "k.kind")).alias("b"))
    return best.select("domain", "b.protected", "b.kind", "b.score")
