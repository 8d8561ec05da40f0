"""Text, DLP and URL queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierlens.functions.arrays import round6
from courierlens.operators import dlp
from courierlens.operators import text as op
from courierlens.operators import urls
from courierlens.plans.registry import query

LUHN_SQL = "list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN (length(c) - i) % 2 = 1 THEN CASE WHEN CAST(c[i] AS INT) > 4 THEN 2 * CAST(c[i] AS INT) - 9 ELSE 2 * CAST(c[i] AS INT) END ELSE CAST(c[i] AS INT) END)) % 10 = 0"
IBAN_SQL = "list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN CAST(unicode(x) - 48 AS BIGINT) ELSE CAST(unicode(x) - 55 AS BIGINT) END)), lambda s, x: CASE WHEN x > 9 THEN (s * 100 + x) % 97 ELSE (s * 10 + x) % 97 END) = 1"
_sum_sql = lambda weights, value: " + ".join(f"{w} * ({value.format(f'c[{i}]')})" for i, w in enumerate(weights, 1))
_in_sql = lambda names: ", ".join(map(repr, names))
CREDIT_REST = f"((31 - ({_sum_sql(dlp.CREDIT_WEIGHTS, f'strpos(' + repr(dlp.CREDIT_DIGITS) + ', {}) - 1')}) % 31) % 31)"
CHECK_SQL = {
    "credit_card": f"list_filter(list_distinct(list_transform(v, lambda x: regexp_replace(x, '[ -]', '', 'g'))), lambda c: {LUHN_SQL} AND regexp_matches(c, '{dlp.ISSUERS}'))",
    "id_number": f"list_filter(v, lambda c: substr('{dlp.ID_CHECKS}', CAST(({_sum_sql(dlp.ID_WEIGHTS, 'CAST({} AS INT)')}) % 11 AS INT) + 1, 1) = upper(c[18]))",
    "bank_card": f"list_filter(v, lambda c: {LUHN_SQL})",
    "email_address": f"list_filter(list_distinct(list_transform(v, lambda x: lower(x))), lambda x: split_part(x, '@', 1) NOT IN ({_in_sql(dlp.SYSTEM_MAILBOXES)}))",
    "social_credit_code": f"list_filter(v, lambda c: {CREDIT_REST} < {len(dlp.CREDIT_DIGITS)} AND substr('{dlp.CREDIT_DIGITS}', CAST({CREDIT_REST} AS INT) + 1, 1) = c[18])",
    "credential_leak": f"list_filter(v, lambda x: length(x) > 1 AND lower(x) NOT IN ({_in_sql(dlp.NO_SECRETS)}))",
    "iban": f"list_filter(v, lambda c: {IBAN_SQL} AND length(c) = CASE substr(c, 1, 2) " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in dlp.IBAN_LENGTHS.items()) + " END)",
    "vehicle_info": "list_filter(v, lambda x: regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]'))",
}


def _values_sql(kind: dlp.Kind) -> str:
    """The values of a class as lists, in the order and with the flags of its pattern."""
    plain = kind.pattern.removeprefix("(?i)")
    flags = "(?i)" if plain != kind.pattern else ""
    if not kind.run:
        found = f"regexp_extract_all(t, '{kind.pattern}', 1)"
    else:
        tail = "" if "@" in plain else dlp.TAIL
        found = f"list_filter(regexp_extract_all(t, '{flags}{dlp.LEAD}({plain}{tail})', 1), lambda x: regexp_full_match(x, '{flags}(?:{plain})'))"
    return f"list_distinct({found})"


def _dlp_sql(text: str, found: str) -> str:
    """What is found (f: doc_id, class, v, least) in texts, from the SELECTs of classes over them."""
    return (
        f"WITH d AS (SELECT doc_id, translate({text}, "
        f"'{dlp.FOLDED[0]}{dlp.INVISIBLE}', '{dlp.FOLDED[1]}') AS t FROM fx_dlp), c AS ({found}"
        "), x AS (SELECT doc_id, COALESCE(list(v) FILTER (WHERE class = 'credit_card'), [[]])[1] AS cards, len(COALESCE(list(v) FILTER (WHERE class = 'cvv_code'), [[]])[1]) AS cvv FROM c GROUP BY 1)"
        ", f AS (SELECT c.doc_id, class, CASE WHEN class = 'bank_card' THEN list_filter(v, lambda y: NOT list_contains(cards, y)) WHEN class = 'otp_verification' AND cvv > 0 THEN [] ELSE v END AS v, least FROM c JOIN x ON x.doc_id = c.doc_id)"
    )


DLP_SQL = _dlp_sql(
    "list_reduce(list_prepend(COALESCE(text, ''), list_distinct(regexp_extract_all(COALESCE(text, ''), '&#([0-9]+);', 1))), lambda s, e: replace(s, '&#' || e || ';', chr(CAST(e AS INT))))",
    " UNION ALL ".join(f"SELECT doc_id, '{k}' AS class, {CHECK_SQL.get(k, 'v')} AS v, {kind.least} AS least FROM (SELECT doc_id, {_values_sql(kind)} AS v FROM d)" for k, kind in dlp.KINDS.items()),
)

WHOLE_CHECK_SQL = CHECK_SQL | {
    "credit_card": CHECK_SQL["credit_card"].replace("'[ -]'", "'[^0-9]'"),
    "vehicle_any": "list_filter(v, lambda x: length(x) < 17 OR (regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]')))",
    "swift_bank": f"list_filter(v, lambda x: x[5:6] IN ({_in_sql(dlp.SWIFT_COUNTRIES)}) AND x[1:4] NOT IN ({_in_sql(dlp.NO_BANKS)}))",
}


def _whole_sql(kind: dlp.Kind) -> str:
    if not kind.free:
        return _values_sql(kind)
    bordered = f"(?:{kind.pattern}){dlp.TAIL}"
    each = f"list_transform(regexp_extract_all(t, '({kind.free}|{dlp.LEAD}{bordered})', 1), lambda x: regexp_replace(x, '^{dlp.BORDER}({bordered})$', '\\1'))"
    return f"list_distinct(list_filter({each}, lambda x: regexp_full_match(x, '(?:{kind.free}|{kind.pattern})')))"


CODE_SQL = "CAST(CASE WHEN lower(e[1]) = 'x' THEN '0x' || e[2:] ELSE e END AS BIGINT)"
WHOLE_SQL = _dlp_sql(
    f"list_reduce(list_prepend(COALESCE(text, ''), list_distinct(regexp_extract_all(COALESCE(text, ''), '{dlp.ENTITY}', 1))), lambda s, e: CASE WHEN {CODE_SQL} > 1114111 OR {CODE_SQL} BETWEEN 55296 AND 57343 OR {CODE_SQL} BETWEEN 127 AND 159 OR ({CODE_SQL} < 32 AND {CODE_SQL} NOT IN (9, 10)) THEN s ELSE replace(s, '&#' || e || ';', chr(CAST(least({CODE_SQL}, 1114111) AS INT))) END)",
    " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS class, list_distinct(list_concat({', '.join(f'v{i}' for i in range(len(several)))})) AS v, {several[0].least} AS least FROM (SELECT doc_id, "
        + ", ".join(f"(SELECT {WHOLE_CHECK_SQL.get(kind.check or k, 'v')} FROM (SELECT {_whole_sql(kind)} AS v)) AS v{i}" for i, kind in enumerate(several)) + " FROM d)"
        for k, several in dlp.WHOLE.items()
    ),
)


@query(
    "dlp_scan", "fx_dlp",
    sql=f"{WHOLE_SQL} SELECT doc_id, class, CAST(len(v) AS BIGINT) AS n, list_transform(list_sort(v), lambda x: x[1:2] || '***' || substr(x, CAST(greatest(length(x) - 1, 3) AS BIGINT))) AS samples FROM f WHERE len(v) >= least",
)
def _dlp(d):
    return dlp.dlp_findings(d, kinds=dlp.WHOLE).drop("snippets")


LEVEL_SQL = "CASE " + " ".join(f"WHEN class IN ({', '.join(repr(n) for n in names)}) THEN {level}" for level, names in dlp.LEVELS.items()) + " ELSE 0 END"


@query(
    "dlp_level_counts", "fx_dlp",
    sql=f"{DLP_SQL}, l AS (SELECT doc_id % 20 AS user_id, doc_id // 20 % 7 AS day, len(v) AS n, {LEVEL_SQL} AS level FROM f WHERE len(v) >= least) SELECT user_id, day, " + ", ".join(f"CAST(SUM(CASE WHEN level >= {k} THEN n ELSE 0 END) AS BIGINT) AS items{k}" for k in (2, 3, 4)) + ", CASE MAX(level) WHEN 4 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS severity FROM l GROUP BY 1, 2",
)
def _levels(d):
    found = dlp.dlp_findings(d).withColumns({"user_id": F.col("doc_id") % 20, "day": F.floor(F.col("doc_id") / 20) % 7})
    return dlp.level_counts(found, "user_id", "day")


STRONG, WEAK = ("worthless", "disgusting", "pathetic", "moron"), ("licensed", "released", "public", "work", "version")


BUSINESS = ("the the", "and the", "in the", "with", "for", "ing")
NOTICES, FOOTERS = ("for the", "with the"), (" Th",)
_count = lambda words: " + ".join(f"CAST(contains(low, '{w}') AS BIGINT)" for w in words)


@query(
    "keyword_scan", "fx_dlp",
    sql=f"""{DLP_SQL}, ln AS (SELECT doc_id, string_split(split_part(COALESCE(text, ''), '{FOOTERS[0]}', 1), chr(10)) AS l FROM fx_dlp),
      own AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: NOT ({' OR '.join(f"contains(lower(l[i]), '{n}')" for n in NOTICES)} OR trim(l[i]) = '')) AS o FROM ln),
      w AS (SELECT doc_id, lower(CASE WHEN len(o) = 0 THEN '' ELSE array_to_string(l[o[1]:], chr(10)) END) AS low FROM own),
      k AS (SELECT doc_id, {_count(STRONG)} AS strong, {_count(WEAK)} AS weak, {_count([w for w in BUSINESS if ' ' in w])} AS phrases, {_count([w for w in BUSINESS if ' ' not in w])} AS words FROM w),
      p AS (SELECT doc_id, SUM(CASE class WHEN 'credit_card' THEN 0.3 WHEN 'id_number' THEN 0.25 WHEN 'credential_leak' THEN 0.2 ELSE 0 END) AS bonus FROM f WHERE len(v) >= least GROUP BY 1)
      SELECT k.doc_id, strong, weak, phrases, words, R6(LEAST(1.0, LEAST(0.5, 0.08 * strong) + CASE WHEN weak >= 3 THEN LEAST(0.15, 0.03 * weak) ELSE 0 END
        + CASE WHEN phrases > 0 THEN LEAST(0.5, 0.15 * phrases) WHEN words >= 3 THEN LEAST(0.15, 0.05 * words) ELSE 0 END + COALESCE(bonus, 0)), 6) AS score FROM k LEFT JOIN p ON p.doc_id = k.doc_id""",
)
def _keywords(d):
    scores = op.keyword_score(d, STRONG, WEAK, BUSINESS, NOTICES, FOOTERS)
    return op.with_data_bonus(scores, dlp.dlp_findings(d, classes=op.DATA_BONUS)).withColumn("score", round6("score"))


RULES = (("free_license", "low", "all", ("Licensed", "License")), ("insult", "high", "any", ("moron", "worthless")), ("markup", "medium", "any", ("###", "$$$")))


@query(
    "pattern_rules", "documents",
    sql=" UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, '{s}' AS severity FROM documents WHERE " + (" AND " if c == "all" else " OR ").join(f"contains(text, '{x}')" for x in xs) for n, s, c, xs in RULES),
)
def _patterns(d):
    return op.pattern_hits(d, RULES)


_held = lambda words: " + ".join("CAST(contains(low, '{}') AS BIGINT)".format(w.replace("'", "''")) for w in words)
_times = lambda words: " + ".join("(length(low) - length(replace(low, '{0}', ''))) / {1}".format(w.replace("'", "''"), len(w)) for w in words)


@query(
    "generated_prose_signals", "fx_prose",
    sql=f"""WITH t AS (SELECT doc_id, trim(text, ' ') AS t, lower(trim(text, ' ')) AS low FROM fx_prose WHERE length(trim(text, ' ')) >= {op.LEAST_PROSE}),
      n AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '[.!?。！？\n]'), lambda s: length(regexp_replace(s, '\\s', '', 'g'))), lambda x: x > 0) AS l FROM t),
      g AS (SELECT doc_id, {_held(op.PHRASES)} AS phrases, {_held(op.CONNECTIVES)} AS connectives, {_held(op.HAN_CONNECTIVES)} AS han_connectives,
        CASE WHEN len(l) >= 4 THEN len(list_filter(l, lambda x: x >= {op.LONG_SENTENCE})) / len(l) ELSE 0.0 END AS long_share, {_times(op.FULL_FORMS)} > 3.5 AND {_times(op.SHORT_FORMS)} < 0.5 AS formal FROM n),
      c AS (SELECT *, CAST(phrases > 0 AS BIGINT) + CAST(connectives >= 3 AS BIGINT) + CAST(han_connectives >= 3 AS BIGINT) + CAST(long_share >= 0.5 AS BIGINT) + CAST(formal AS BIGINT) AS n_signals FROM g)
      SELECT doc_id, phrases, connectives, han_connectives, R6(long_share, 6) AS long_share, formal, n_signals, CASE WHEN n_signals >= 4 THEN CAST(0.30 AS DOUBLE) WHEN n_signals = 3 THEN 0.22 WHEN n_signals = 2 THEN 0.15 ELSE 0.0 END AS score FROM c""",
)
def _prose(d):
    return op.prose_signals(d).withColumn("long_share", round6("long_share"))


@query(
    "script_mix", "fx_signs",
    sql=f"""WITH t AS (SELECT doc_id, length(regexp_replace(COALESCE(text, ''), '[^\\pL]', '', 'g')) AS n, length(regexp_replace(COALESCE(text, ''), '[^\\pL]|[A-Za-z]', '', 'g')) AS n_other, regexp_extract_all(COALESCE(text, ''), '[{op.IDEOGRAPHS}{op.RARE}]') AS l FROM fx_signs),
      u AS (SELECT *, len(l) AS m, list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1]) AS p FROM t),
      v AS (SELECT *, CASE WHEN m > 0 THEN len(list_filter(l, lambda c: NOT regexp_matches(c, '[{op.IDEOGRAPHS}]'))) / m ELSE 0 END AS rare, CASE WHEN m > 0 THEN list_aggregate(l, 'entropy') ELSE 0 END AS e, CASE WHEN m > 1 THEN len(list_distinct(p)) / (m - 1) ELSE 0 END AS q FROM u),
      w AS (SELECT *, CASE WHEN rare > 0.05 THEN least(1.0, (rare - 0.05) / 0.25) ELSE 0 END AS a, CASE WHEN e > 0 AND e < 4 THEN (4 - e) / 4 WHEN e > 7.5 THEN least(1.0, (e - 7.5) / 3) ELSE 0 END AS b, CASE WHEN m < 51 THEN 0 WHEN q > 0.92 THEN least(1.0, (q - 0.92) / 0.08) WHEN q < 0.1 THEN 1 ELSE 0 END AS c FROM v)
      SELECT doc_id, n, n_other, R6(CASE WHEN n > 0 THEN n_other / n ELSE 0 END, 6) AS ratio, CAST(m AS BIGINT) AS n_ideographs, R6(rare, 6) AS rare, R6(e, 6) AS entropy, R6(q, 6) AS unique_pairs,
        R6(CASE WHEN m < 10 THEN 0 ELSE 0.4 * a + CASE WHEN b > 0.1 THEN 0.3 * b ELSE 0 END + CASE WHEN c > 0.1 THEN 0.3 * c ELSE 0 END END, 6) AS score FROM w""",
)
def _script(d):
    return op.script_mix(d).withColumns({c: round6(c) for c in ("ratio", "rare", "entropy", "unique_pairs", "score")})


def _html_sql(column: str) -> str:
    for pattern, to in op.HTML_CHAIN:
        quoted = pattern.replace("'", "''")
        column = f"regexp_replace({column}, '{quoted}', '{to.replace(chr(39), chr(39) * 2)}', 'g')"
    return f"trim({column})"


@query("html_to_text", "pages", sql=f"SELECT page_id, t AS text, CAST(length(t) AS BIGINT) AS n FROM (SELECT page_id, {_html_sql('html')} AS t FROM pages)")
def _html_text(p):
    return p.select("page_id", op.html_to_text(F.col("html")).alias("text")).withColumn("n", F.length("text").cast("long"))


@query(
    "html_signals", "pages",
    sql="SELECT page_id, " + ", ".join(f"CAST(len(regexp_extract_all(html, '{p}')) AS BIGINT) AS {n}" for n, p in (("active", "<(?:script|iframe|object|embed)"), ("handlers", " on[a-z]+ ?="), ("hidden", "display: ?none|visibility: ?hidden"), ("refreshes", "http-equiv=.refresh"), ("script_links", "href=.javascript:"), ("invisible", "[\\x{200B}\\x{200C}\\x{200D}\\x{202A}-\\x{202E}]"))) + " FROM pages",
)
def _html_signals(p):
    return op.html_signals(p)


LINKS_SQL = "SELECT page_id, url, generate_subscripts(u, 1) - 1 AS n, unnest(u) AS link FROM (SELECT page_id, url, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS u FROM pages)"


@query(
    "extract_links", "fx_html",
    sql="""WITH m AS (SELECT page_id, html, regexp_extract_all(html, '(?is)<a[^>]*href=(?:"[^">]*"|''[^''>]*'')[^>]*>(?:.*?</a>)?') AS a FROM fx_html),
      l AS (SELECT page_id, list_concat(list_transform(a, lambda x: {'url': regexp_extract(x, '(?i)href=["'']([^"''>]*)["'']', 1), 'text': trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^<[^>]*>', ''), '(?i)</a>$', ''), '<[^>]*>', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g'))}),
        list_transform(list_concat(regexp_extract_all(html, '(?i)href="([^"]*)"', 1), regexp_extract_all(html, '(?i)href=''([^'']*)''', 1), regexp_extract_all(html, '(?i)src="([^"]*)"', 1), regexp_extract_all(html, '(?i)src=''([^'']*)''', 1)), lambda u: {'url': u, 'text': ''})) AS l FROM m),
      e AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l), g AS (SELECT page_id, x.url AS url, MIN(i) AS i, arg_min(x.text, i) FILTER (WHERE x.text <> '') AS text FROM e WHERE starts_with(x.url, 'http://') OR starts_with(x.url, 'https://') GROUP BY 1, 2),
      n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS n, lower(regexp_extract(url, '://([^/:]+)', 1)) AS host, lower(regexp_extract(COALESCE(text, ''), '((?:[A-Za-z0-9-]+[.])+[A-Za-z]{2,})', 1)) AS named FROM g),
      o AS (SELECT *, regexp_extract(host, '([^.]+[.](?:co[.]uk|[^.]+))$', 1) AS top, regexp_extract(named, '([^.]+[.](?:co[.]uk|[^.]+))$', 1) AS named_top FROM n)
      SELECT page_id, CAST(n AS INT) AS n, url, text, host = '10.0.0.1' OR regexp_matches(lower(url), 'login|signin|account|verify|secure|update|confirm|password|credential|authenticate') AND NOT contains(url, 'google.com') AS suspicious, named <> '' AND named_top <> top AS other_host FROM o""",
)
def _links(p):
    return op.anchored_links(p)


HOST_SQL = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.]*://(?:[^/@]*@)?([^/:?#]+)', 1))"


@query(
    "url_signals", "pages",
    sql=f"WITH u AS (SELECT DISTINCT url, {HOST_SQL} AS host FROM pages), s AS (SELECT url, host, regexp_matches(host, '^[0-9.]+$') AS ip_host, contains(url, '@') AS has_at, len(string_split(host, '.')) > 4 AS deep, length(url) > 100 AS long_url, contains(host, 'xn--') AS punycode, regexp_matches(url, '(?:redirect|url|target|next)=http') AS redirects, NOT starts_with(url, 'https:') AS plain FROM u) SELECT *, R6(LEAST(1.0, 0.3 * ip_host::INT + 0.25 * has_at::INT + 0.1 * deep::INT + 0.1 * long_url::INT + 0.25 * punycode::INT + 0.2 * redirects::INT + 0.05 * plain::INT), 6) AS score FROM s",
)
def _url_signals(p):
    return op.url_signals(p).withColumn("score", round6("score"))


@query(
    "domain_profile", "pages",
    sql=f"SELECT array_to_string(list_slice(string_split({HOST_SQL}, '.'), -2, -1), '.') AS domain, COUNT(*) AS urls, COUNT(DISTINCT {HOST_SQL}) AS hosts, bool_and(regexp_matches(url, '[.](?:css|js|png|jpg|gif|woff2?)(?:[?#]|$)')) AS assets_only FROM pages GROUP BY 1",
)
def _profile(p):
    host = op.host_of(F.col("url"))
    return p.groupBy(op.registrable(host).alias("domain")).agg(F.count(F.lit(1)).alias("urls"), F.count_distinct(host).alias("hosts"), F.bool_and(F.col("url").rlike("[.](?:css|js|png|jpg|gif|woff2?)(?:[?#]|$)")).alias("assets_only"))


@query(
    "url_redirect_targets", "pages",
    sql="SELECT 'https://track.example/?url=' || url_encode(url_encode(url)) AS url, url AS target FROM pages WHERE url LIKE 'http%'",
)
def _redirects(p):
    nested = p.select(F.concat(F.lit("https://track.example/?url="), F.url_encode(F.url_encode("url"))).alias("url"))
    return op.redirect_targets(nested)


PROTECTED = ("the.example.com", "thther.example.org", "www.ththhe.example.net", "blog.tionsh.example.com")


def lookalikes_sql(protected) -> str:
    names = ", ".join(map(repr, protected))
    return f"""WITH d AS (SELECT DISTINCT {HOST_SQL} AS domain FROM pages), p AS (SELECT unnest([{names}]) AS protected),
      b AS (SELECT domain, protected, regexp_replace(domain, '[.][^.]*$', '') AS base, regexp_extract(domain, '[.]([^.]*)$', 1) AS tld, regexp_replace(protected, '[.][^.]*$', '') AS pbase, regexp_extract(protected, '[.]([^.]*)$', 1) AS ptld FROM d JOIN p ON domain <> protected),
      l AS (SELECT *, levenshtein(base, pbase) AS near, CASE WHEN greatest(length(base), length(pbase)) <= 6 THEN 1 WHEN greatest(length(base), length(pbase)) <= 12 THEN 2 ELSE 3 END AS allowed,
             translate(replace(replace(replace(base, 'rn', 'm'), 'cl', 'd'), 'vv', 'w'), '{op.FOLD_FROM}', '{op.FOLD_TO}') AS fb, translate(replace(replace(replace(pbase, 'rn', 'm'), 'cl', 'd'), 'vv', 'w'), '{op.FOLD_FROM}', '{op.FOLD_TO}') AS fp FROM b WHERE length(base) >= 3 AND length(pbase) >= 3),
      k AS (SELECT domain, protected, CASE WHEN base <> pbase AND fb = fp THEN 'homoglyph' WHEN base = pbase AND tld <> ptld THEN 'tld_swap' WHEN near >= 1 AND near <= allowed AND length(pbase) >= 4 THEN 'edit_distance' WHEN base <> pbase AND length(pbase) >= 4 AND (starts_with(base, pbase) OR ends_with(base, pbase)) THEN 'affix' END AS kind, near FROM l),
      s AS (SELECT domain, protected, kind, CASE kind WHEN 'homoglyph' THEN 0.95 WHEN 'tld_swap' THEN 0.90 WHEN 'affix' THEN 0.70 ELSE CASE near WHEN 1 THEN 0.85 WHEN 2 THEN 0.75 ELSE 0.65 END END AS score FROM k WHERE kind IS NOT NULL)
      SELECT domain, protected, kind, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, protected DESC) AS i FROM s) WHERE i = 1"""


@query("domain_lookalikes", "pages", sql=lookalikes_sql(PROTECTED))
def _lookalikes(p):
    return op.lookalikes(p.select(op.host_of(F.col("url")).alias("domain")), p.sparkSession.createDataFrame([(x,) for x in PROTECTED], "domain string"))


LISTS = urls.Lists(tlds=("top", "xyz"), hosters=("pages.example",), readable=("thonth",), numeric=("163.com",), trusted=("google.com",), paths=("login", "verify", "account"), params=("token", "redirect"))
#: The checks written out for DuckDB: one row for each link of a page, host and URL findings side by side.
FOUND_URLS_SQL = """u AS (SELECT DISTINCT url, lower(replace(url, '&amp;', '&')) AS l, lower(regexp_extract(url, '://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM fx_urls),
  a AS (SELECT *, string_split(host, '.') AS labels, split_part(host, '.', 1) AS one, regexp_extract(host, '([^.]+)[.](?:co[.]uk|[^.]+)$', 1) AS main, split_part(split_part(regexp_replace(l, '^https?://', ''), '#', 1), '?', 1) AS hp, regexp_extract(l, '[?]([^#]*)', 1) AS q, regexp_extract(l, '#(.*)$', 1) AS frag FROM u),
  b AS (SELECT *, CASE WHEN contains(hp, '/') THEN substr(hp, strpos(hp, '/')) ELSE '/' END AS path FROM a),
  c AS (SELECT *, CAST(contains(path || ' ' || frag, 'login') AS INT) + CAST(contains(path || ' ' || frag, 'verify') AS INT) + CAST(contains(path || ' ' || frag, 'account') AS INT) AS words,
    CAST(regexp_matches(q, '(^|&)token(=|&|$)') AS INT) + CAST(regexp_matches(q, '(^|&)redirect(=|&|$)') AS INT) AS names, regexp_matches(host, '(^|[.])google[.]com$') AS trusted FROM b),
  f AS (SELECT url, host, unnest(list_filter([
    CASE WHEN labels[-1] IN ('top', 'xyz') THEN {'f': 'domain', 'c': 'suspicious_tld', 's': 0.15} END, CASE WHEN one LIKE 'www_%' AND NOT regexp_full_match(one, 'www-*[0-9]+-*') THEN {'f': 'domain', 'c': 'www_impersonation', 's': 0.25} END,
    CASE WHEN ends_with(host, 'pages.example') THEN {'f': 'domain', 'c': 'free_hosting', 's': 0.20} END, CASE WHEN length(host) > 40 THEN {'f': 'domain', 'c': 'long_domain', 's': 0.15} END, CASE WHEN len(labels) >= 5 THEN {'f': 'domain', 'c': 'deep_subdomain', 's': 0.15} END,
    CASE WHEN main <> 'thonth' AND (length(main) >= 6 AND regexp_matches(main, '[b-df-hj-np-tv-z]{4}') OR length(main) >= 5 AND length(regexp_replace(main, '[^b-df-hj-np-tv-z]', '', 'g')) / length(main) >= 0.7) THEN {'f': 'domain', 'c': 'random_domain', 's': 0.20} END,
    CASE WHEN regexp_full_match(main, '[0-9]{4,}') THEN {'f': 'domain', 'c': 'numeric_domain', 's': 0.15} END, CASE WHEN regexp_full_match(one, '([0-9]{1,3}-){3}[0-9]{1,3}') AND list_max(list_transform(string_split(one, '-'), lambda o: CAST(o AS INT))) <= 255 THEN {'f': 'domain', 'c': 'embedded_ip', 's': 0.20} END,
    CASE WHEN NOT trusted AND words > 0 THEN {'f': 'content', 'c': 'suspicious_path', 's': CASE WHEN words >= 3 THEN 0.30 ELSE words / 10 END} END, CASE WHEN NOT trusted AND names > 0 THEN {'f': 'content', 'c': 'suspicious_params', 's': names * 0.08} END,
    CASE WHEN NOT trusted AND length(l) > 400 THEN {'f': 'content', 'c': 'long_url', 's': 0.10} END, CASE WHEN NOT trusted AND contains(path, '%25') THEN {'f': 'content', 'c': 'double_encoding', 's': 0.25} END,
    CASE WHEN NOT trusted AND regexp_matches(path, '%2f|%5c') THEN {'f': 'content', 'c': 'encoded_separator', 's': 0.15} END, CASE WHEN NOT trusted AND regexp_matches(l, '^https?://[^/?#]*@') THEN {'f': 'content', 'c': 'at_sign_obfuscation', 's': 0.35} END], lambda x: x IS NOT NULL)) AS x FROM c)"""


@query("url_findings", "fx_urls", sql=f"WITH {FOUND_URLS_SQL} SELECT url, host, x.f AS family, x.c AS category, R6(CAST(x.s AS DOUBLE), 6) AS score FROM f")
def _url_findings(u):
    return urls.findings(u, LISTS).withColumn("score", round6("score"))


@query(
    "url_message_scores", "fx_urls",
    sql=f"""WITH {FOUND_URLS_SQL}, s AS (SELECT url, least(1.0, SUM(CASE WHEN x.f = 'domain' THEN CAST(x.s AS DOUBLE) ELSE 0 END)) AS d, least(1.0, SUM(CASE WHEN x.f = 'content' THEN CAST(x.s AS DOUBLE) ELSE 0 END)) AS c FROM f GROUP BY 1)
      SELECT page_id, COUNT(*) AS n_links, R6(COALESCE(MAX(d), 0), 6) AS domain_score, R6(COALESCE(MAX(c), 0), 6) AS content_score FROM (SELECT DISTINCT page_id, url FROM fx_urls) p LEFT JOIN s ON s.url = p.url GROUP BY 1""",
)
def _url_scores(u):
    return urls.message_scores(u, urls.findings(u, LISTS), "page_id").withColumns({c: round6(c) for c in ("domain_score", "content_score")})


@query(
    "url_domain_scores", "fx_urls",
    sql=f"""WITH {FOUND_URLS_SQL}, s AS (SELECT url, least(1.0, SUM(CAST(x.s AS DOUBLE))) AS score FROM f GROUP BY 1), d AS (SELECT p.page_id, p.url, regexp_extract(lower(regexp_extract(p.url, '://(?:[^/@]*@)?([^/:?#]+)', 1)), '([^.]+[.](?:co[.]uk|[^.]+))$', 1) AS domain, score FROM fx_urls p LEFT JOIN s ON s.url = p.url)
      SELECT domain, COUNT(DISTINCT page_id) AS n_messages, COUNT(DISTINCT url) AS n_urls, R6(MAX(score), 6) AS score FROM d GROUP BY 1 HAVING MAX(score) IS NOT NULL""",
)
def _url_domains(u):
    return urls.domain_scores(u, urls.findings(u, LISTS), "page_id").withColumn("score", round6("score"))
